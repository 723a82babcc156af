"""Quality rules judged by host.

Every text is measured once: words, symbols, lines said before, words in repeated windows of three. Failures of each rule are
summed by host (`source` of the documents), the hosts' rates are shrunk by a beta prior that is fitted to all hosts (its mean is
the pooled rate, its strength comes from the spread of the hosts beyond what chance gives), and a host of which the shrunk rate
of a rule reaches `HOST_RATE` and `WORSE` times the pooled rate is condemned. Verdicts go back to the documents: those of a condemned host go, as do those that
fail the base rules themselves.

Defined cases: null text has no words and fails; a document without a host is judged by itself alone; rows that repeat an id are
documents of their own; a corpus of one host, or of hosts that do not differ, has a prior of the greatest strength at the
pooled rate and none is condemned; an empty table gives an empty result; extra columns do not matter. Lines and windows are told apart by 64-bit
hashes within a text. One text and its words are held in memory at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _SPACE, Scratch, mix, slices, small, span_hashes, word_spans

LEAST_WORDS, REPEAT_SHARE, WINDOW = 50, 50, 3
#: The other rules, in percent: symbols a word, repeated lines a line; the bounds of a word's mean length.
SYMBOL_SHARE, LINE_SHARE, MEAN_LENGTH = 10, 30, (3, 10)
#: A host is condemned where its shrunk rate of failures reaches this, and this many times the rate of all hosts.
HOST_RATE, WORSE = 0.5, 1.5
#: The prior counts as at least and at most so many documents.
STRENGTH = (2.0, 1000.0)
RULES = ("short", "repeats", "symbols", "lines", "lengths")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def _per_text(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """How many bytes of each text are flagged."""
    return np.diff(np.r_[0, np.cumsum(flags)][offs])


def _in_text(keys: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry: whether its key stands earlier in its text, and whether it stands there twice or more. Entries come in order of place."""
    order = np.lexsort((keys, text))
    same = np.r_[False, (keys[order][1:] == keys[order][:-1]) & (text[order][1:] == text[order][:-1])]
    before, twice = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    before[order] = same
    twice[order] = same | np.r_[same[1:], np.zeros(min(1, len(same)), bool)]
    return before, twice


def _measure(data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    n = len(offs) - 1
    starts, ends, first = word_spans(data, offs)
    n_words = np.diff(first)
    chars = _per_text(~_SPACE[data] & ((data & 0xC0) != 0x80), offs)
    symbols = _per_text(_SYMBOL[data], offs)
    # lines with a word
    cut = np.flatnonzero(data == 10)
    a, b = np.sort(np.r_[offs[:-1], cut + 1]), np.sort(np.r_[cut, offs[1:]])
    said = np.searchsorted(starts, b) > np.searchsorted(starts, a)
    a, b = a[said], b[said]
    line_text = np.searchsorted(offs, a, "right") - 1
    again, _ = _in_text(span_hashes(data, a, b, folded=False), line_text)
    n_lines, n_dup = np.bincount(line_text, minlength=n), np.bincount(line_text[again], minlength=n)
    # words in windows that stand twice
    text = np.repeat(np.arange(n), n_words)
    word = span_hashes(data, starts, ends, folded=False)
    covered = np.zeros(len(word), bool)
    if len(word) >= WINDOW:
        at = np.flatnonzero(text[: len(text) - WINDOW + 1] == text[WINDOW - 1 :])
        key = word[at]
        for j in range(1, WINDOW):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) ^ word[at + j])
        _, twice = _in_text(key, text[at])
        for j in range(WINDOW):
            covered[at[twice] + j] = True
    return [n_words, chars, symbols, n_lines, n_dup, np.bincount(text[covered], minlength=n)]


def _measures(batches):
    for batch in batches:
        text = batch.column("text")
        for a, b, data, offs in slices(text):
            values = _measure(data, offs)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), batch.column("host").slice(a, b - a), *[pa.array(v.astype(np.int64)) for v in values]], names=["doc_id", "host", *MEASURES])


def failures() -> dict[str, Column]:
    """Each rule as a condition on the measures of a document."""
    n = F.col("n_words")
    return {
        "short": n < LEAST_WORDS,
        "repeats": 100 * F.col("n_repeat_words") > REPEAT_SHARE * n,
        "symbols": 100 * F.col("n_symbols") > SYMBOL_SHARE * n,
        "lines": 100 * F.col("n_dup_lines") > LINE_SHARE * F.col("n_lines"),
        "lengths": (F.col("word_chars") < MEAN_LENGTH[0] * n) | (F.col("word_chars") > MEAN_LENGTH[1] * n),
    }


def condemned(measured: DataFrame, scratch: Scratch) -> DataFrame:
    """(host) of hosts that fail a rule: per-host sums, a prior from all of them, shrunk rates."""
    sums = [F.count_if(c).alias(r) for r, c in failures().items()]
    hosts = scratch.settle(measured.where("host is not null").groupBy("host").agg(F.count(F.lit(1)).alias("n"), *sums))
    totals = [F.sum("n").alias("n"), F.count(F.lit(1)).alias("hosts")]
    totals += [x for r in RULES for x in (F.sum(r).alias(r), F.sum(F.col(r).cast("double") * F.col(r) / F.col("n")).alias(f"{r}_2"))]
    t = hosts.agg(*totals).first()  # one row
    bad = F.lit(False)
    for r in RULES if t.hosts else ():
        m = t[r] / t.n
        spread = t[f"{r}_2"] / t.n - m * m - t.hosts * m * (1 - m) / t.n
        strength = m * (1 - m) / spread - 1 if spread > 0 else STRENGTH[1]
        strength = min(max(strength, STRENGTH[0]), STRENGTH[1])
        bad = bad | ((F.col(r) + m * strength) / (F.col("n") + strength) >= max(HOST_RATE, WORSE * m))
    return hosts.where(bad).select("host")


def judge(docs: DataFrame, scratch: Scratch, host: str = "source") -> DataFrame:
    """(doc_id, the measures, base_failed, host_failed, kept) of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), "text")
    measured = scratch.settle(rows.mapInArrow(_measures, ", ".join(["doc_id long", "host string", *[f"{m} long" for m in MEASURES]])))
    bad = condemned(measured, scratch)
    rules = failures()
    out = measured.join(small(bad.withColumn("host_failed", F.lit(True)), bad.count(), 256), "host", "left").withColumn("host_failed", F.coalesce("host_failed", F.lit(False)))
    out = out.withColumn("base_failed", rules["short"] | rules["repeats"])
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed")).select("doc_id", *MEASURES, "base_failed", "host_failed", "kept")


def keep_good(docs: DataFrame, host: str = "source") -> DataFrame:
    """The documents that are kept, with all their columns."""
    scratch = Scratch(docs.sparkSession, "host-rules")
    numbered = scratch.settle(docs.withColumn("__rm_row", F.monotonically_increasing_id()))
    kept = judge(numbered.select(F.col("__rm_row").alias("doc_id"), "text", F.col(host).alias("__rm_host")), scratch, "__rm_host").where("kept").select(F.col("doc_id").alias("__rm_row"))
    return numbered.join(kept, "__rm_row", "left_semi").drop("__rm_row")


def op12_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "host-rules"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_failed")


def _oracle() -> str:
    rate = lambda r: f"""case when sum_{r} is null then false else ({r} + m_{r} * least(greatest(case when v_{r} > 0 then m_{r} * (1 - m_{r}) / v_{r} - 1 else {STRENGTH[1]} end, {STRENGTH[0]}), {STRENGTH[1]}))
        / (n + least(greatest(case when v_{r} > 0 then m_{r} * (1 - m_{r}) / v_{r} - 1 else {STRENGTH[1]} end, {STRENGTH[0]}), {STRENGTH[1]})) >= greatest({HOST_RATE}, {WORSE} * m_{r}) end"""  # noqa: E731
    total = ", ".join(f"sum({r}) over () as sum_{r}, sum({r}) over () / sum(n) over ()::double as m_{r}, sum({r}::double * {r} / n) over () / sum(n) over () as sq_{r}" for r in RULES)
    spread = ", ".join(f"sq_{r} - m_{r} * m_{r} - count(*) over () * m_{r} * (1 - m_{r}) / sum(n) over () as v_{r}" for r in RULES)
    return rf"""with d as (select row_number() over () as i, doc_id, source, coalesce(text, '') as text from documents),
    w as (select i, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws from d),
    u as (select i, unnest(ws) as a, generate_subscripts(ws, 1) as p from w),
    g as (select *, lead(a, 1) over (partition by i order by p) as b, lead(a, 2) over (partition by i order by p) as c from u),
    t as (select i, p, count(*) over (partition by i, a, b, c) as n from g where c is not null),
    r as (select i, count(distinct q) as n_repeat_words from (select i, unnest([p, p + 1, p + 2]) as q from t where n > 1) group by i),
    l as (select i, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines from (select i, unnest(string_split(text, chr(10))) as line from d) where regexp_matches(line, '[^\x20\x09-\x0D]') group by i),
    f as (select d.doc_id, d.source as host, len(ws)::bigint as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
        coalesce(n_lines, 0) as n_lines, coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words from d join w using (i) left join r using (i) left join l using (i)),
    x as (select *, n_words < {LEAST_WORDS} as short, 100 * n_repeat_words > {REPEAT_SHARE} * n_words as repeats, 100 * n_symbols > {SYMBOL_SHARE} * n_words as symbols, 100 * n_dup_lines > {LINE_SHARE} * n_lines as lines,
        word_chars < {MEAN_LENGTH[0]} * n_words or word_chars > {MEAN_LENGTH[1]} * n_words as lengths from f),
    h as (select host, count(*) as n, {", ".join(f"count(*) filter ({r}) as {r}" for r in RULES)} from x where host is not null group by host),
    h1 as (select *, {total} from h), h2 as (select *, {spread} from h1),
    b as (select host, {" or ".join(rate(r) for r in RULES)} as bad from h2)
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short or repeats as base_failed, not (short or repeats) and not coalesce(bad, false) as kept, coalesce(bad, false) as host_failed
    from x left join b on x.host = b.host"""


QUERIES = {"op12_host_rules": op12_host_rules}
ORACLE = {"op12_host_rules": _oracle()}
