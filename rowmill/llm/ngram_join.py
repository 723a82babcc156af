"""N-gram Jaccard self-join of documents over a token-group matrix, and the classes it links.

A document's set holds its distinct 5-word shingles (all its words as one, if fewer). Two documents link when the Jaccard
similarity of their sets is at least `percent` / 100. The join is exact and never lists the pairs within a group of copies:

1. Documents with the same set are one class, found by a 128-bit digest of the set and its size; a class has a number.
2. Sets that can have no partner are ruled out. Of each set a prefix in hash order travels, long enough that linked sets share
   at least `EXTRA` of the smaller one in it; a class with fewer prefix shingles that another class has stays alone. A batch
   settles the shingles that several of its classes have itself and sends two rows of each, so a shingle that every document
   has costs two rows a batch; what arrives is sorted and read as a stream.
3. The remaining similar classes are partitioned into groups. Classes that share a min-hash form a bucket, whose leader is the
   class with the most bucket mates; a class, the leaders it shares `VOTES` buckets with, and so on are a group. Each class is
   compared with its leader first, in rounds with other leaders while they link many, so that copies become one component
   at one comparison a member and round. What is left are classes outside their group's largest component: they alone are
   compared with the others of the group, in blocks of bounded size whose token union they must overlap, and links that only
   close a ring are not reported.
4. Links between groups. The token-group matrix has a row for each shingle and group whose members hold it: each group's token union. For a query
   class, shingles are ordered by the number of groups that hold them, so common passages come last; only groups that hold
   enough of its first shingles are looked at, and its overlap with the group's union bounds its overlap with any member.
   Groups below the bound stay closed. Members of an opened group that share a first shingle with the query are verified:
   of each component within the group the likeliest one first, and all others only of components that it did not link.
5. Links of all steps give connected components.

Defined cases: texts without words have an empty set and link with nothing; null text is empty; rows equal in id and text
count once each and are one class; null ids are carried, and a component's id is its smallest non-null doc_id; an empty
table gives no rows; extra columns do not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, components, int_lists, mix, packed, slices, small, span_hashes, word_spans
from .spans import row_key

N, PERCENT = 5, 75
#: The share of a set that is added to its prefix so that more than one shingle must be shared.
EXTRA = 0.1
#: Min-hashes of a class that name its buckets, how many it shares with a leader of its group, and the share of classes that a
#: round of leaders must link to be followed by another.
BUCKETS, VOTES, ENOUGH = 16, 6, 0.02
#: Shingles of a block of a group's sets, and of a row of a group's token union.
BLOCK, UNION = 200_000, 4096
_STEPS = np.random.default_rng(5).integers(0, 2**64, N + 1, dtype=np.uint64) | np.uint64(1)
_TURNS = np.random.default_rng(9).integers(0, 2**64, BUCKETS, dtype=np.uint64) | np.uint64(1)


def shingles(data: np.ndarray, offs: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles of every text (of all words, if a text has fewer), and where each text's begin."""
    starts, ends, first = word_spans(data, offs)
    w = span_hashes(data, starts, ends)
    count = np.diff(first)
    size = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    begin = np.r_[0, np.cumsum(size)]
    doc = np.repeat(np.arange(len(count)), size)
    at = np.arange(int(begin[-1])) - begin[doc] + first[doc]
    length = np.minimum(count[doc], n)
    h = length.astype(np.uint64) * _STEPS[n]
    padded = np.r_[w, np.zeros(n, np.uint64)]
    for j in range(n):
        h = h + np.where(j < length, mix(padded[at + j] + _STEPS[j]), np.uint64(0)) * _STEPS[j]
    return mix(h), begin


def sets(data: np.ndarray, offs: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text, and where each text's begin."""
    h, begin = shingles(data, offs, n)
    parts = [np.unique(h[a:b]) for a, b in zip(begin[:-1].tolist(), begin[1:].tolist())]
    return np.concatenate(parts) if parts else h, np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int64)


def _reduce(f, values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """f over each text's values; 0 where there are none."""
    out = np.zeros(len(begin) - 1, np.uint64)
    full = np.flatnonzero(np.diff(begin) > 0)
    if len(full):
        out[full] = f.reduceat(values, begin[:-1][full])
    return out


def _class_of(s: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    one = mix(_reduce(np.add, mix(s + np.uint64(0x51)), begin))
    two = mix(_reduce(np.bitwise_xor, mix(s ^ np.uint64(0xA7A7)), begin) + np.diff(begin).astype(np.uint64))
    return one.view(np.int64), two.view(np.int64)


SKETCH = "doc_id long, k binary, n_shingles long, c long, c2 long"


def _sketch(batches):
    for batch in batches:
        for a, b, data, offs in slices(batch.column("text")):
            s, begin = sets(data, offs)
            one, two = _class_of(s, begin)
            part = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("k"), pa.array(np.diff(begin)), pa.array(one), pa.array(two)], names=["doc_id", "k", "n_shingles", "c", "c2"])


def _room(n: np.ndarray, percent: int) -> np.ndarray:
    """How many of a set's n shingles make up its prefix."""
    return np.minimum(n, n - -(-n * percent // 100) + 1 + np.floor(EXTRA * n).astype(np.int64))


PREFIX = "h long, c long, n int"


def _prefixes(percent: int):
    """Prefix shingles h of the classes c of a run of texts. n is 0, or 1 if the run has counted the shingle for the class
    already; rows with n below 0 carry these counts."""

    def run(batches):
        for batch in batches:
            for _, _, data, offs in slices(batch.column("text")):
                s, begin = sets(data, offs)
                one, _ = _class_of(s, begin)
                size = np.diff(begin)
                keep = np.unique(one, return_index=True)[1]
                keep = np.sort(keep[size[keep] > 0])
                if not len(keep):
                    continue
                size, begin, one = _room(size[keep], percent), begin[:-1][keep], one[keep]
                doc = np.repeat(np.arange(len(size)), size)
                h = s[begin[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size)].view(np.int64)
                least = s[begin].view(np.int64)
                order = np.argsort(h, kind="stable")
                h, doc = h[order], doc[order]
                first = np.r_[True, h[1:] != h[:-1]]
                last = np.r_[first[1:], True]
                several = ~(first & last)
                hits = np.bincount(doc[several], minlength=len(one))
                sent = first | last
                own = np.flatnonzero(hits)
                columns = (np.r_[h[sent], least[own]], np.r_[one[doc[sent]], one[own]], np.r_[several[sent].astype(np.int32), -hits[own].astype(np.int32)])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["h", "c", "n"])

    return run


def _hits(batches):
    """(c, hits): shingles of class c that another class has, from rows of PREFIX that arrive ordered by h."""
    none = np.zeros(0, np.int64)
    held = (none, none, none)

    def solve(h, c, n):
        new = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        mixed = np.repeat(np.minimum.reduceat(c, new) != np.maximum.reduceat(c, new), np.diff(np.r_[new, len(h)]))
        return c[mixed & (n == 0)], mixed

    for batch in batches:
        h, c, n = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("h", "c", "n"))
        counted = n < 0
        values, weights = c[counted], -n[counted].astype(np.int64)
        h, c, n = (np.r_[x, y[~counted]] for x, y in zip(held, (h, c, n)))
        if len(h):
            at = int(np.searchsorted(h, h[-1]))  # the last shingle may go on in the next batch
            if at:
                found, _ = solve(h[:at], c[:at], n[:at])
                values, weights = np.r_[values, found], np.r_[weights, np.ones(len(found), np.int64)]
            h, c, n = h[at:], c[at:], n[at:]
            found, mixed = solve(h, c, n)
            if mixed[0]:  # two classes that are counted stand for all that were met
                values, weights = np.r_[values, found], np.r_[weights, np.ones(len(found), np.int64)]
                two = [int(np.argmin(c)), int(np.argmax(c))]
                h, c, n = h[two], c[two], np.ones(2, np.int64)
            else:
                h, c, n = h[:1], c[:1], n.min(keepdims=True)
            held = (h, c, n)
        if len(values):
            u, back = np.unique(values, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(np.bincount(back, weights).astype(np.int64))], names=["c", "hits"])


def _sets(batches):
    for batch in batches:
        for a, b, data, offs in slices(batch.column("text")):
            s, begin = sets(data, offs)
            buckets = np.stack([mix(_reduce(np.minimum, mix(s * t), begin) ^ t).view(np.int64) for t in _TURNS], axis=1)
            rows = np.arange(b - a + 1, dtype=np.int64)
            part = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays([part.column("c"), part.column("n"), int_lists(s.view(np.int64), begin), int_lists(buckets.ravel(), rows * BUCKETS)], names=["c", "n", "s", "buckets"])


def _linked(pairs: DataFrame, of: DataFrame, percent: int, size: int) -> DataFrame:
    """Of pairs (a, b) of classes, those whose sets, of about `size` bytes in all, reach the similarity."""
    left = of.select(F.col("c").alias("a"), F.col("s").alias("sa"))
    right = of.select(F.col("c").alias("b"), F.col("s").alias("sb"))
    both = packed(packed(pairs.join(left, "a"), size).join(right, "b"), 2 * size).withColumn("i", F.size(F.array_intersect("sa", "sb")))
    return both.where(100 * F.col("i") >= percent * (F.size("sa") + F.size("sb") - F.col("i"))).select("a", "b")


def _compare(percent: int):
    """Links of asking classes with others of a block of sets; of links that close a ring one is left out."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        c, asks, part = (table.column(x).to_numpy() for x in ("c", "asks", "part"))
        lists = table.column("s").combine_chunks()
        begin = lists.offsets.to_numpy()
        values, flat = np.unique(lists.values.to_numpy()[begin[0] : begin[-1]], return_inverse=True)
        begin = begin - begin[0]
        size = np.diff(begin)
        root = np.unique(part, return_inverse=True)[1]
        out: list[tuple[int, int]] = []
        held = np.flatnonzero(~asks)
        held = held[np.argsort(size[held], kind="stable")]  # sets of about the same size stand together
        asking = np.flatnonzero(asks)
        if len(held) and len(asking):
            sizes = size[held]
            place = np.concatenate([flat[begin[i] : begin[i + 1]] for i in held])
            ends = np.cumsum(sizes)
            starts = ends - sizes
            union, seen = np.zeros(len(values), bool), np.zeros(len(values), bool)
            union[place] = True
            for i in asking.tolist():
                mine = flat[begin[i] : begin[i + 1]]
                if 100 * int(union[mine].sum()) < percent * size[i]:
                    continue
                a, b = np.searchsorted(sizes, -(-size[i] * percent // 100), "left"), np.searchsorted(sizes, size[i] * 100 // percent, "right")
                if a == b:
                    continue
                seen[mine] = True
                both = np.add.reduceat(seen[place[starts[a] : ends[b - 1]]].astype(np.int32), starts[a:b] - starts[a])
                seen[mine] = False
                for j in held[a:b][100 * both.astype(np.int64) >= percent * (size[i] + sizes[a:b] - both)].tolist():
                    if root[i] != root[j]:
                        root[root == root[j]] = root[i]
                        out.append((int(c[i]), int(c[j])))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return run


def _groups(tables: DataFrame, n_live: int, size: int, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(a, b): links within groups; and (c, g): every class's group. tables has n_live rows (c, n, s, buckets), s of `size` bytes in all."""
    spark = tables.sparkSession
    one, each = 64 * n_live, 48 * BUCKETS * n_live  # bytes of a row a class and of a row a bucket
    bucket = tables.select("c", F.posexplode("buckets").alias("i", "h"))
    mates = bucket.groupBy("i", "h").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    bucket = scratch.settle(packed(bucket.join(scratch.settle(packed(mates, each)), ["i", "h"]), each))
    weight = scratch.settle(packed(bucket.groupBy("c").agg(F.sum("m").alias("w")), one))
    bucket = scratch.settle(packed(bucket.join(weight, "c").select("c", "i", "h", "w"), each))

    def placed(edges: DataFrame, name: str) -> DataFrame:
        root = components(spark, edges, scratch, BUCKETS * n_live).withColumnRenamed("node", "c")
        return scratch.settle(packed(tables.select("c").join(root, "c", "left").select("c", F.coalesce("root", "c").alias(name)), one))

    edges = None
    part, turn, n = tables.select("c", F.col("c").alias("part")), 0, n_live
    while n > ENOUGH * n_live:
        # the first leader is the class with the most mates, the centre of its copies; later ones are drawn by hash
        rank = F.struct("w", "c") if not turn else F.struct(F.xxhash64("c", F.lit(turn)), "c")
        leader = scratch.settle(packed(bucket.groupBy("i", "h").agg(F.max(rank)["c"].alias("lead")), each))
        seen = packed(bucket.join(leader, ["i", "h"]), each).where("c <> lead").groupBy("c", "lead").agg(F.count(F.lit(1)).alias("votes"))
        seen = packed(seen, each)
        if turn:
            seen = seen.join(part, "c").join(part.select(F.col("c").alias("lead"), F.col("part").alias("lead_part")), "lead").where("part <> lead_part")
            seen = packed(seen, each)
        pairs = seen.groupBy("c").agg(F.max(F.struct("votes", "lead")).alias("x")).select(F.col("c").alias("a"), F.col("x.lead").alias("b"), "x.votes")
        if not turn:
            near = scratch.settle(seen.where(F.col("votes") >= VOTES).select(F.col("c").alias("a"), F.col("lead").alias("b")))
        found = scratch.settle(_linked(packed(pairs, one).select("a", "b"), tables, percent, size))
        n, turn = found.count(), turn + 1
        edges = found if edges is None else edges.union(found)
        part = placed(edges, "part") if n else part
    if edges is None:
        return spark.createDataFrame([], "a long, b long"), part.select("c", F.col("part").alias("g"))

    # a group: classes joined by shared buckets or by links; those outside its largest component are compared with the others
    group = placed(near.union(edges), "g")
    here = packed(group.join(part, "c").join(tables.select("c", "n"), "c"), one)
    sizes = here.groupBy("g", "part").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("size"))
    sizes = packed(sizes, one).groupBy("g").agg(F.max(F.struct("m", "part", "size")).alias("bulk"), F.sum("size").alias("size")).select("g", "size", "bulk.part", F.col("bulk.size").alias("bulk_size"))
    sizes = scratch.settle(packed(sizes, one).where("size > bulk_size").select("g", F.col("part").alias("bulk"), F.ceil(F.col("size") / BLOCK).cast("int").alias("p_n"), F.ceil((F.col("size") - F.col("bulk_size")) / BLOCK).cast("int").alias("q_n")))
    here = scratch.settle(packed(here.join(sizes, "g"), one))
    deal = lambda n: F.pmod(F.xxhash64("c"), F.col(n)).cast("int")
    held = here.select("c", "part", "g", F.lit(False).alias("asks"), deal("p_n").alias("p"), F.explode(F.sequence(F.lit(0), F.col("q_n") - 1)).alias("q"))
    asking = here.where("part <> bulk").select("c", "part", "g", F.lit(True).alias("asks"), F.explode(F.sequence(F.lit(0), F.col("p_n") - 1)).alias("p"), deal("q_n").alias("q"))
    within = held.union(asking).join(tables.select("c", "s"), "c").groupBy("g", "p", "q").applyInArrow(_compare(percent), "a long, b long")
    return edges.union(scratch.settle(within)), group


def linked_rows(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, k, n_shingles, component_id, component) of every row of docs (doc_id, text); component is a number, null without words."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngrams")
    t = percent / 100
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("k"), F.col("text").cast("string").alias("text"))
    rows = scratch.settle(texts.mapInArrow(_sketch, SKETCH))
    kinds = rows.where("n_shingles > 0").groupBy("c", "c2", "n_shingles").agg(F.min("k").alias("k"), F.min("doc_id").alias("least"))
    n_rows = rows.count()
    kinds = scratch.settle(packed(kinds, 128 * n_rows).withColumn("id", F.monotonically_increasing_id()))

    # 2. classes with enough prefix shingles that another class has
    sent = texts.select("text").mapInArrow(_prefixes(percent), PREFIX)
    seen = sent.repartition("h").sortWithinPartitions("h").mapInArrow(_hits, "c long, hits long").groupBy("c").agg(F.sum("hits").alias("hits"))
    enough = F.col("hits") >= F.floor(F.col("n_shingles") * (t * EXTRA)) + 1
    live = packed(kinds.join(scratch.settle(packed(seen, 256 * n_rows)), "c"), 128 * n_rows)
    live = scratch.settle(live.where(enough).select("k", F.col("id").alias("c"), F.col("n_shingles").alias("n")))

    # 3. groups of similar classes
    n_live, size = live.agg(F.count(F.lit(1)), 8 * F.coalesce(F.sum("n"), F.lit(0))).first()
    chosen = texts.select("k", "text").join(small(live, n_live, 48), "k").dropDuplicates(["c"])
    tables = scratch.settle(packed(chosen.select("c", "n", "text"), 2 * size).mapInArrow(_sets, "c long, n long, s array<long>, buckets array<long>"))
    edges, group = _groups(tables, n_live, size, percent, scratch)
    member = packed(group.join(live.select("c", "n"), "c"), 64 * n_live)

    # 4. the matrix of shingles and groups, without the rows that only one group has
    cells = tables.select("c", F.explode("s").alias("s")).join(small(member, n_live, 48), "c")
    spread = cells.groupBy("s").agg(F.min("g").alias("a"), F.max("g").alias("b")).where("a <> b").select("s")
    shared = scratch.settle(packed(cells.join(scratch.settle(packed(spread, 3 * size)), "s").select("c", "n", "g", "s"), 4 * size))
    matrix = scratch.settle(packed(shared.select("s", "g").distinct(), 3 * size))
    order = scratch.settle(packed(matrix.groupBy("s").agg(F.count(F.lit(1)).alias("df")), 3 * size))
    # a class's shingles that no other group has come first; what is left of its prefix goes to the rarest others
    need = F.ceil(F.col("n") * F.lit(percent) / 100)
    ranks = packed(shared.join(order, "s"), 4 * size).groupBy("c", "n", "g").agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("x"))
    room = F.size("x") - need + 1
    more = F.floor(F.col("n") * EXTRA)
    first = scratch.settle(packed(ranks, 4 * size).where(room > 0).select("c", "n", "g", F.explode(F.slice("x", F.lit(1), (room + more).cast("int"))).alias("y")).select("c", "n", "g", "y.s"))
    # with so many more shingles in either prefix, linked sets have at least so many of them in common
    least_shared = F.floor(F.col("n") * (t * EXTRA)) + 1
    held = scratch.settle(packed(first.select("s", F.col("g").alias("h")).distinct(), 3 * size))
    asked = packed(first.join(held, "s"), 4 * size).where("g <> h").groupBy("c", "n", "h").agg(F.count(F.lit(1)).alias("o")).where(F.col("o") >= least_shared)
    asked = scratch.settle(packed(asked, 4 * size).select("c", "n", "h"))
    # the token union of a group as rows of about UNION shingles; a query meets each row of a group it asks once
    wanted = packed(matrix.join(packed(asked.select(F.col("h").alias("g")).distinct(), 64 * n_live), "g"), 3 * size)
    rows_of = scratch.settle(packed(wanted.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / UNION).alias("rows")), 64 * n_live))
    union = packed(matrix.join(rows_of, "g"), 3 * size).groupBy(F.col("g").alias("h"), F.pmod(F.xxhash64("s"), F.col("rows")).alias("row")).agg(F.collect_list("s").alias("u"))
    mine = packed(shared.join(packed(asked.select("c").distinct(), 64 * n_live), "c"), 4 * size).groupBy("c").agg(F.collect_list("s").alias("x"))
    bound = packed(packed(asked.join(packed(mine, size), "c"), 4 * size).join(packed(union, size), "h"), 4 * size).select("c", "n", "h", F.size(F.array_intersect("x", "u")).alias("o"))
    bound = packed(bound.groupBy("c", "n", "h").agg(F.sum("o").alias("o")), 4 * size)
    opened = scratch.settle(bound.where(F.col("o") * 100 >= F.col("n") * percent).select("c", "h"))
    inside = first.select(F.col("c").alias("d"), F.col("n").alias("m"), F.col("g").alias("h"), "s")
    sized = (F.col("m") * 100 >= F.col("n") * percent) & (F.col("n") * 100 >= F.col("m") * percent)
    pairs = packed(packed(first.select("c", "n", "s").join(opened, "c"), 4 * size).join(inside, ["s", "h"]), 4 * size)
    pairs = pairs.where(sized).groupBy(F.col("c").alias("a"), F.col("d").alias("b"), "h", F.least("n", "m").alias("n")).agg(F.count(F.lit(1)).alias("o"))
    pairs = scratch.settle(packed(pairs, 4 * size).where(F.col("o") >= least_shared).select("a", "b", "h", "o"))
    # a group may hold several components: a query that links to a member is linked to its component, and to no other
    inner = scratch.settle(components(spark, edges, scratch, 2 * n_live))
    whole = pairs.join(inner.select(F.col("node").alias("b"), "root"), "b", "left").select("a", "b", "o", F.coalesce("root", "b").alias("part"))
    whole = scratch.settle(packed(whole, 4 * size))
    likely = packed(whole.groupBy("a", "part").agg(F.max(F.struct("o", "b"))["b"].alias("b")), size)
    across = scratch.settle(_linked(likely.select("a", "b"), tables, percent, size))
    done = packed(across.join(whole, ["a", "b"]), size).select("a", "part")
    again = packed(whole.join(done, ["a", "part"], "left_anti"), size).where("a < b").select("a", "b")
    again = scratch.settle(_linked(again, tables, percent, size))

    # 5. components of classes, then of documents
    root = components(spark, inner.select(F.col("node").alias("a"), F.col("root").alias("b")).union(across).union(again), scratch, 3 * n_live)
    named = kinds.join(root.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("root", "id"))
    named = packed(named, 128 * n_rows)
    least = scratch.settle(packed(named.groupBy("component").agg(F.min("least").alias("component_id")), 128 * n_rows))
    named = scratch.settle(packed(named.select("c", "c2", "n_shingles", "component").join(least, "component"), 128 * n_rows))
    scratch.drop(live, tables, shared, matrix, order, first, held, asked, rows_of, opened, pairs, whole)
    out = packed(rows.join(named, ["c", "c2", "n_shingles"], "left"), 128 * n_rows)
    alone = F.col("n_shingles") == 0
    return out.select("doc_id", "k", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "component")


def join_classes(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, k, n_shingles, component_id) of every row of docs (doc_id, text)."""
    return linked_rows(docs, percent).drop("component")


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each component: the one of least doc_id, null last, and of rows equal in id and text any one.
    Rows without words stay, repeated ones too."""
    scratch = Scratch(docs.sparkSession, "near")
    rows = scratch.settle(linked_rows(docs, percent).where("n_shingles > 0").select("doc_id", "k", "component"))
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "k")
    size = 96 * rows.count()
    stays = scratch.settle(packed(rows.groupBy("component").agg(F.min(rank)["k"].alias("stay")), size))
    again = packed(rows.join(stays, "component"), size).groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("k") == F.col("stay")).alias("stay"))
    marked = scratch.settle(packed(again, size).where("not stay or n > 1").select(F.col("k").alias("__rm_key"), F.col("stay").alias("__rm_stay")))
    keyed = docs.withColumn("__rm_key", row_key()).join(small(marked, marked.count(), 32), "__rm_key", "left")
    once = keyed.where("__rm_stay").dropDuplicates(["__rm_key"])
    return keyed.where("__rm_stay is null").union(once).select(docs.columns)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("k")


QUERIES = {"op2_ngram_join": op2_ngram_join}
ORACLE = {
    "op2_ngram_join": r"""
    with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
    g as (select distinct doc_id, case when len(w) < 5 then array_to_string(w, ' ') else array_to_string(w[i:i + 4], ' ') end as s
          from (select doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, least(len(w), 1)))) as i from w) x),
    n as (select doc_id, count(*) as n from g group by doc_id),
    p as (select a.doc_id as a, b.doc_id as b, count(*) as i from g a join g b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
    e as (select p.a, p.b from p join n x on x.doc_id = p.a join n y on y.doc_id = p.b where 100 * p.i >= 75 * (x.n + y.n - p.i)),
    r as (select doc_id as node, doc_id as c from n union select e.b, r.c from r join e on e.a = r.node),
    m as (select node, min(c) as c from r group by node)
    select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(m.c, w.doc_id) as component_id
    from w left join n on n.doc_id = w.doc_id left join m on m.node = w.doc_id"""
}
