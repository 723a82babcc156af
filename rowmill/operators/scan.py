"""Credentials in text, and lost ids in raw lines. Values found are never emitted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import BEARER_PATTERN, CODE_VALUE_PATTERN, PLACEHOLDER_PARTS, PLACEHOLDERS, SECRET_KEY_PATTERN, URL_SECRET_PATTERN
from ..functions.ids import ids_in_text
from .rows import with_seq

#: A name, a sign, and a value in quotes or up to a comment.
NAMED = r"""^\s*["']?([\w.-]+)["']?\s*[=:]\s*(?:"([^"]*)"|'([^']*)'|([^#;]*))"""
#: Values that follow a word of their own anywhere in a line, by kind.
LOOSE = {"bearer_token": BEARER_PATTERN, "url_credential": URL_SECRET_PATTERN}
#: Signs of a mask.
MASK = r"^[-_.*xX]+$"


def is_placeholder(v: Column) -> Column:
    """Values that stand for a credential and are none: stated placeholders, code, masks, paths of a secrets folder."""
    low = F.lower(v)
    parts = F.exists(F.array(*[F.lit(p) for p in PLACEHOLDER_PARTS]), lambda p: F.contains(low, p))
    return low.isin(PLACEHOLDERS) | parts | v.rlike(CODE_VALUE_PATTERN) | v.rlike(MASK) | v.rlike(r"^secrets[/\\]")


def _loose(kind: str, pattern: str, finding) -> Column:
    hits = F.regexp_extract_all("line", F.lit(pattern), F.lit(1))
    return F.transform(hits, lambda h: finding(kind, F.lit(kind), F.rtrim(h, F.lit(",);]}"))))


def scan_secrets(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line_no, kind, key, value_length, value_sha256) of each distinct finding."""
    lines = df.select(id_col, F.posexplode(F.split(text_col, r"\r?\n")).alias("at", "line"))
    # a line without any of the words cannot hold a finding; this is checked once before the patterns
    lines = lines.where(F.col("line").rlike(r"(?i)key|token|passw|secret|bearer|folder"))
    finding = lambda kind, key, v: F.struct(F.lit(kind).alias("kind"), key.alias("key"), v.alias("v"))
    key = F.regexp_extract("line", NAMED, 1)
    value = F.btrim(F.concat(*[F.regexp_extract("line", NAMED, i) for i in (2, 3, 4)]), F.lit(" \t'\""))
    found = [F.when(key.rlike(SECRET_KEY_PATTERN) & (value != ""), F.array(finding("credential_assignment", key, value))).otherwise(F.array())]
    found += [_loose(kind, pattern, finding) for kind, pattern in LOOSE.items()]
    out = lines.select(id_col, (F.col("at") + 1).alias("line_no"), F.explode(F.concat(*found)).alias("f")).where(~is_placeholder(F.col("f.v")))
    return out.select(id_col, "line_no", "f.kind", "f.key", F.length("f.v").alias("value_length"), F.substring(F.sha2(F.col("f.v"), 256), 1, 12).alias("value_sha256")).distinct()


def findings_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("kind").agg(F.count(F.lit(1)).alias("n_findings"))


def findings_report(df: DataFrame, id_col: str) -> DataFrame:
    """Findings in order of source, line and kind, for reading; the sort is by ranges."""
    return df.select(id_col, "line_no", "kind", "key", "value_length", "value_sha256").orderBy(id_col, "line_no", "kind", "key")


def files_report(files: DataFrame, path: str = "path", size: str = "size") -> DataFrame:
    """Files with their place in a report: the largest first, of equal ones by path without regard to case."""
    return with_seq(files, [F.col(size).desc(), F.lower(path), F.col(path)], "place")


def recover_lost_ids(lines: DataFrame, final: DataFrame, text: str = "line", inn: str = "inn", only_missing: bool = True) -> DataFrame:
    """Ids in raw lines with a flag whether the final layer has them, or only those it lacks."""
    found = lines.withColumn(inn, F.explode(ids_in_text(text)))
    known = final.select(inn).where(F.col(inn).isNotNull()).distinct()
    if only_missing:
        return found.join(known, inn, "left_anti")
    return found.join(known.withColumn("_in", F.lit(True)), inn, "left").withColumn("in_final", F.coalesce("_in", F.lit(False))).drop("_in")
