"""Raw lines and fields against plain walks."""

import csv
import random
import time

import pytest
from pyspark.sql import functions as F

from rowmill.functions import text
from rowmill.sources import assembly, ingest


def walk(lines, delimiter, expected, max_lines):
    """Records of one file, line by line: (first line, number among those that are not blank, text)."""
    out, held, first = [], [], 0

    def close():
        body = "\n".join(held)
        if body.strip():
            out.append((first, len(out) + 1, body))

    for no, line in enumerate(lines, 1):
        if not held:
            first = no
        held.append(line)
        quotes, i = 0, 0
        body = "\n".join(held)
        while i < len(body):
            if body[i] == "\\" and i + 1 < len(body) or body[i : i + 2] == '""':
                i += 2
                continue
            quotes += body[i] == '"'
            i += 1
        if quotes % 2 == 0 or body.count(delimiter) >= expected - 1 or len(held) >= max_lines:
            close()
            held = []
    if held:
        close()
    return out


@pytest.mark.parametrize("chunk,expected,max_lines", [(1, 12, 10), (3, 4, 10), (7, 12, 4), (5, 3, 1), (4, 1, 10), (1000, 12, 10)])
def test_assembly(spark, chunk, expected, max_lines, monkeypatch):
    rng = random.Random(chunk)
    files = {f"f{k}": ["".join(rng.choice(['"', ",", "a", " ", ", ", "x" * 3]) for _ in range(rng.randint(0, 5))) for _ in range(n)] for k, n in enumerate([0, 1, 2, 90, 250])}
    rows = [(f, i, x) for f, lines in files.items() for i, x in enumerate(lines, 1)]
    df = spark.createDataFrame(rows, "source_file string, line_no long, line string").repartition(3)
    monkeypatch.setattr(assembly.entries, "__defaults__", (4,))  # maps of maps, several levels deep
    monkeypatch.setattr(assembly.line_records, "__defaults__", (chunk, 4))
    got = sorted(map(tuple, ingest.assemble_records(df, ",", expected, max_lines, chunk).select("source_file", "physical_line", "record_no", "raw_line").collect()))
    assert got == sorted((f, *r) for f, lines in files.items() for r in walk(lines, ",", expected, max_lines))


def test_assembly_uses_many_tasks(spark):
    """One file of 120 chunks: the walk is spread, and each chunk's first state comes from the maps before it."""
    rows = spark.range(60_000).select(F.lit("one.csv").alias("source_file"), (F.col("id") + 1).alias("line_no"), F.when(F.col("id") % 3 == 0, 'a,"b').when(F.col("id") % 3 == 1, 'c",d').otherwise("x,y").alias("line"))
    placed = assembly.line_records(rows, ",", 12, 10, chunk=500)
    assert placed.where("physical_line <> case when line_no % 3 = 2 then line_no - 1 else line_no end").count() == 0
    assert placed.agg(F.max("record_no")).first()[0] == 40_000
    small = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}  # else these few chunks are put together
    before = {k: spark.conf.get(k) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        placed = assembly.line_records(rows, ",", 12, 10, chunk=500)
        assert placed.select(F.spark_partition_id()).distinct().count() > 1
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def plain_split(t, delimiter):
    out, held, inside, i = [], [], False, 0
    while i < len(t):
        if t[i] == '"' and inside and t[i + 1 : i + 2] == '"':
            held.append('"')
            i += 2
            continue
        if t[i] == '"':
            inside = not inside
        if t[i] == delimiter and not inside:
            out.append("".join(held).strip())
            held = []
        else:
            held.append(t[i])
        i += 1
    return [*out, "".join(held).strip()]


def strict(t, delimiter, escape):
    try:
        return next(csv.reader([t], delimiter=delimiter, quotechar='"', doublequote=True, escapechar="\\" if escape else None, strict=False), [])
    except csv.Error:
        return None


@pytest.mark.parametrize("delimiter", [",", ";", "\t", "|"])
def test_fields(spark, delimiter):
    rng = random.Random(ord(delimiter))
    texts = ["", '"', '""', '"""', '""""', f'"a""b"{delimiter}c', f'a"b{delimiter}c"d', 'x"" y', f'"open{delimiter}to the end', f'"a"b"c{delimiter}"d"', '"two\nlines"']
    texts += ["".join(rng.choice(['"', '""', delimiter, "a", " ", "\\", "\n", "é"]) for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select("i", text.split_quoted("t", delimiter).alias("a"), text.csv_fields("t", delimiter).alias("b"), text.csv_fields("t", delimiter, escape=True).alias("e"), text.field_counts("t", [delimiter, "#"]).alias("n")).collect()
    for r in got:
        t = texts[r.i]
        assert r.a == plain_split(t, delimiter), t
        assert list(r.n) == [len(plain_split(t, delimiter)), 1], t
        for mine, escape in ((r.b, False), (r.e, True)):
            want = strict(t, delimiter, escape)
            if mine is not None:
                assert mine == want, (t, escape)
            elif want is not None:  # only line ends at the end of the record, or an escape of nothing, are left to the forgiving split
                assert t[-1] in "\n\\" or "\\\n" in t, (t, escape)


def test_long_line(spark):
    """A megabyte of quotes and delimiters takes time in proportion to its length."""

    def took(n):
        line = ('a,"b, ""c""",' * n) + '"open'
        df = spark.createDataFrame([(line,)], "t string").select(F.size(text.split_quoted("t", ",")).alias("a"), F.size(text.csv_fields("t", ",")).alias("b"), F.get(text.field_counts("t", [",", ";"]), F.lit(0)).alias("c"))
        began = time.perf_counter()
        assert tuple(df.first()) == (2 * n + 1,) * 3
        return time.perf_counter() - began

    took(100)
    assert took(80_000) < 20
