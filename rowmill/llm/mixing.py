"""Mix sources to target weights with hash-threshold histograms.

Sources, in code-point order with null last, weigh 5, 2, 1 in turn and share all words; a target stops at three times its
source's words and the excess goes to the rest by weight. Every document is taken as often as the target holds its whole
source (`target // source_size`), and once more if its hash lies below the source's threshold; the document at the threshold
gives as many of its first words as the target still lacks, so a target is met to the word. Thresholds come from histograms
of words by hash bucket: cumulate, find the bucket in which the budget runs out, refine only that bucket. No document is
sorted, and reruns agree because the hash is of the id.

Defined cases: null or empty text has size 0 and takes 0; rows that repeat an id, or have none, are told apart by a hash of
their text, and of equal rows as many are taken as fit; one document longer than its source's target is taken in part; an
empty table gives an empty result; extra columns do not matter and stay as they are, also on a document taken in part.
Sources are few: their sums pass through one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, small

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
CAP = 3
BITS, STEP = 60, 12


def mix_hash(doc_id: Column) -> Column:
    """The first 60 bits of an md5 of the id."""
    return F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, cap=CAP) -> DataFrame:
    """(sid, source, source_size, target) from (source, size): weighted shares of all words, filled up to each source's cap."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    per = per.withColumn("sid", F.row_number().over(by_name))
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("sid") - 1) % len(weights) + 1).cast("int")).cast("long"))
    per = per.withColumn("total", F.sum("source_size").over(every)).withColumn("all_w", F.sum("w").over(every))
    filled = Window.orderBy((F.col("source_size") / F.col("w")).asc(), F.col("sid"))
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("cap_before", F.coalesce(F.sum(F.col("source_size") * cap).over(before), F.lit(0)))
    per = per.withColumn("w_left", F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0)))
    per = per.withColumn("capped", F.col("source_size") * cap * F.col("w_left") <= (F.col("total") - F.col("cap_before")) * F.col("w"))
    per = per.withColumn("cap_sum", F.sum(F.when(F.col("capped"), F.col("source_size") * cap).otherwise(0)).over(every))
    per = per.withColumn("w_open", F.sum(F.when(F.col("capped"), 0).otherwise(F.col("w"))).over(every))
    share = (F.col("total") - F.col("cap_sum")).cast("double") * F.col("w") / F.when(F.col("w_open") > 0, F.col("w_open"))
    return per.select("sid", "source", "source_size", F.when(F.col("capped"), (F.col("source_size") * cap).cast("double")).otherwise(share).alias("target"))


#: A row's place in hash order: by id, then by text, then by a number that no other row has.
KEY = ("h", "h2", "h3")


def thresholds(rows: DataFrame, budgets: DataFrame, scratch: Scratch) -> DataFrame:
    """(sid, t, t2, t3, rest): rows (sid, *KEY, size) below it are the longest run in order of KEY whose sizes fit budgets
    (sid, left); the row at it, if any, does not fit, and rest of the budget is left for it."""
    none = F.lit(0).cast("long")
    front, done = scratch.settle(budgets.select("sid", "left", none.alias("t"), none.alias("t2"), none.alias("prefix"))), []
    for place, key in enumerate(KEY):
        above = [F.col(k) == F.col(t) for k, t in zip(KEY[:place], ("t", "t2"))]

        def bound(of):
            return [F.col(t) for t in ("t", "t2")[:place]] + [of] + [none] * (2 - place)

        for shift in range(BITS - STEP, -1, -STEP):
            n = front.count()
            if not n:
                break
            inside = rows.join(small(front, n, 64), "sid").where(F.shiftright(key, shift + STEP) == F.col("prefix"))
            for same in above:
                inside = inside.where(same)
            ends = [f(k).alias(name + k) for k in KEY for f, name in ((F.min, "lo_"), (F.max, "hi_"))]
            hist = inside.groupBy("sid", "left", F.shiftright(key, shift).alias("b")).agg(F.sum("size").alias("s"), *ends)
            cum = hist.withColumn("cum", F.sum("s").over(Window.partitionBy("sid").orderBy("b")))
            edge = cum.where(F.col("cum") > F.col("left")).groupBy("sid").agg(F.min_by(F.struct("b", (F.col("left") - F.col("cum") + F.col("s")).alias("left"), *[x + k for k in KEY for x in ("lo_", "hi_")]), "b").alias("e"))
            state = scratch.settle(front.select("sid", "t", "t2", "prefix").join(edge, "sid", "left"))
            single = (F.col("e.lo_h") == F.col("e.hi_h")) & (F.col("e.lo_h2") == F.col("e.hi_h2")) & (F.col("e.lo_h3") == F.col("e.hi_h3"))
            past = bound(F.shiftleft(F.col("prefix") + 1, shift + STEP))
            done.append(state.where("e is null").select("sid", *[c.alias(t) for c, t in zip(past, ("t", "t2", "t3"))], none.alias("rest")))
            done.append(state.where("e is not null").where(single).select("sid", F.col("e.lo_h").alias("t"), F.col("e.lo_h2").alias("t2"), F.col("e.lo_h3").alias("t3"), F.col("e.left").alias("rest")))
            front = scratch.settle(state.where("e is not null").where(~single).select("sid", F.col("e.left").alias("left"), "t", "t2", F.col("e.b").alias("prefix")))
        # several rows of one hash: it is settled, and the next one tells them apart
        if place < 2:
            name = ("t", "t2")[place]
            front = front.withColumn(name, F.col("prefix")).withColumn("prefix", none)
    out = front.where("false").select("sid", none.alias("t"), none.alias("t2"), none.alias("t3"), none.alias("rest"))
    for d in done:
        out = out.union(d)
    return scratch.settle(out)


def numbered(docs: DataFrame) -> DataFrame:
    """docs with a number in __rm_row that no other row has; to be settled before it is used."""
    return docs.withColumn("__rm_row", F.monotonically_increasing_id())


def _short(text: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(text), 64 - BITS)


def plan_mix(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row."""
    return _plan(numbered(docs), scratch).drop("__rm_row")


def _plan(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """plan_mix of numbered rows, with their numbers."""
    rows = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("size"), mix_hash(F.col("doc_id")).alias("h"), _short(F.col("text")).alias("h2"), F.col("__rm_row").alias("h3"))
    rows = scratch.settle(rows)
    goal = scratch.settle(targets(rows))
    n = goal.count()
    goals = goal.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    goals = goals.withColumn("left", F.floor(F.col("target") - F.col("whole") * F.col("source_size")))
    rows = rows.withColumnRenamed("source", "src").join(small(goals, n, 256), F.col("src").eqNullSafe(F.col("source"))).select("doc_id", "size", *KEY, "sid", "source_size", "target", "whole")
    budgets = goals.where("left >= 1").select("sid", "left")
    theta = thresholds(rows.where("size > 0").select("sid", *KEY, "size"), budgets, scratch)
    placed = rows.join(small(theta, n, 64), "sid", "left")
    below = "h < t or h = t and (h2 < t2 or h2 = t2 and h3 < t3)"
    extra = F.when(F.expr(below), F.col("size")).when(F.expr("h = t and h2 = t2 and h3 = t3"), F.col("rest")).otherwise(0)
    return placed.select("doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + extra).cast("long").alias("taken"), F.col("h3").alias("__rm_row"))


def _first_words(text: Column, n: Column) -> Column:
    """text up to the end of its n-th word."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1)), F.lit(1), n), "")


def mix(docs: DataFrame) -> DataFrame:
    """The documents as the mix takes them: each row as often as it is taken whole, and a row taken in part once more with as
    many of its first words. Rows without words are left out, as no words are taken from them."""
    scratch = Scratch(docs.sparkSession, "mix")
    rows = scratch.settle(numbered(docs))
    plan = _plan(rows, scratch).where("taken > 0").select("__rm_row", F.floor(F.col("taken") / F.col("size")).cast("int").alias("__rm_times"), (F.col("taken") % F.col("size")).cast("int").alias("__rm_rest"))
    out = rows.join(plan, "__rm_row").withColumn("__rm_last", F.col("__rm_times") + F.when(F.col("__rm_rest") > 0, 1).otherwise(0))
    out = out.withColumn("__rm_copy", F.explode(F.sequence(F.lit(1), F.col("__rm_last"))))
    part = F.when(F.col("__rm_copy") > F.col("__rm_times"), _first_words(F.col("text"), F.col("__rm_rest"))).otherwise(F.col("text"))
    return out.withColumn("text", part).select(docs.columns)


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "mix"))


ORACLE_SQL = rf"""
    with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORDS}'))::bigint as size,
                      ('0x' || substr(md5('mix:' || coalesce(doc_id::varchar, 'null')), 1, 15))::bigint as h from documents),
    s as (select source, sum(size)::bigint as source_size from d group by source),
    n as (select *, row_number() over (order by source asc nulls last) as sid from s),
    w as (select *, [5, 2, 1][((sid - 1) % 3 + 1)::int]::bigint as w from n),
    f as (select *, sum(source_size) over () as total, sum(w) over () as all_w,
                 coalesce(sum(source_size * 3) over (order by source_size / w, sid rows between unbounded preceding and 1 preceding), 0) as cap_before,
                 coalesce(sum(w) over (order by source_size / w, sid rows between unbounded preceding and 1 preceding), 0) as w_before from w),
    c as (select *, source_size * 3 * (all_w - w_before) <= (total - cap_before) * w as capped from f),
    o as (select *, sum(case when capped then source_size * 3 else 0 end) over () as cap_sum, sum(case when capped then 0 else w end) over () as w_open from c),
    g0 as (select sid, source, source_size, case when capped then (source_size * 3)::double else (total - cap_sum)::double * w / nullif(w_open, 0) end as target from o),
    g as (select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as whole from g0),
    r as (select d.doc_id, d.size, g.source_size, g.target, g.whole, floor(g.target - g.whole * g.source_size)::bigint as lft,
                 coalesce(sum(d.size) over (partition by g.sid order by d.h rows between unbounded preceding and 1 preceding), 0) as before
          from d join g on d.source is not distinct from g.source)
    select doc_id, size, source_size, target, (whole * size + greatest(0, least(size, lft - before)))::bigint as taken from r"""


QUERIES = {"op3_mix_sources": op3_mix_sources}
ORACLE = {"op3_mix_sources": ORACLE_SQL}
