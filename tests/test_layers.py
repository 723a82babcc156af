"""Aliases, addresses, numbering, faulty files, held rows and providers on small inputs."""

import datetime as dt
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from rowmill.operators import enrich, regions, reports, rows
from rowmill.plans import suite
from rowmill.sources import registry
from rowmill.streaming import flows


def test_aliases_as_patterns(spark):
    """The same aliases as a pattern of each alias between non-letters finds."""
    rng = random.Random(3)
    bits = ["край", "мой", "б", "-", " ", "1", ",", "№", "республика", "a"]
    word = lambda n: "".join(rng.choice(bits) for _ in range(rng.randint(1, n)))
    aliases, texts = sorted({word(4) for _ in range(60)}), sorted({word(9) for _ in range(300)})
    got = regions.aliases_in(spark.createDataFrame([(t,) for t in texts], "t string"), "t", spark.createDataFrame([(a,) for a in aliases], "alias string"))
    want = {(t, a) for t in texts for a in aliases if re.search(rf"(?<![а-яa-z]){re.escape(a)}(?![а-яa-z])", t)}
    assert {(r.t, r.alias) for r in got.collect()} == want
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "address,region",
    [
        ("185035, Республика Карелия, г Петрозаводск", "Республика Карелия"),
        ("Ленинградская   область, Гатчина", "Ленинградская область"),
        ("101000, г.Москва, ул Мира", "г.Москва"),
        ("685000, Магаданская обл., Магадан", "Магадан"),  # the short form ends at a letter only
        ("Магаданская обл.Магадан, ул 1", "Магаданская обл."),
        ("689000, Чукотский АО, Анадырь", "Чукотский АО"),
        ("Town, Somewhere, 5", "Somewhere"),
        ("Town, abc, 5", None),
        ("one part", None),
        (None, None),
        ("", None),
    ],
)
def test_addresses(spark, address, region):
    assert spark.createDataFrame([(address,)], "a string").select(regions.address_region("a")).first()[0] == region


def test_address_title_and_alias(spark):
    _, alias = regions.load_regions(spark)
    df = spark.createDataFrame([("1, ЧУКОТСКИЙ АО, Анадырь",), ("город Санкт-Петербург, Невский 1",), ("x, ааа край, y",)], "a string")
    got = {r.a: r.region_from_address for r in regions.region_from_address(df, "a", alias).collect()}
    assert got["x, ааа край, y"] == "Ааа Край" and got["город Санкт-Петербург, Невский 1"] == "Санкт-Петербург"
    assert spark.range(1).select(regions.title_region(F.lit("чукотский  ао"))).first()[0] == "Чукотский автономный округ"


def test_numbers_of_equal_keys(spark):
    df = spark.range(5000).repartition(5).withColumn("k", F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(7))
    got = rows.with_seq(df, ["k"], "n", buckets=8)
    assert got.columns == ["id", "k", "n"]
    seen = sorted((r.n, r.k) for r in got.collect())
    assert [n for n, _ in seen] == list(range(1, 5001)) and [k for _, k in seen] == sorted(k for _, k in seen)
    assert rows.with_seq(df.limit(0), ["k"], "n").count() == 0


def test_concat_is_bounded(spark):
    df = spark.range(20_000).select(F.lit("k").alias("key"), F.col("id").cast("string").alias("v"), (-F.col("id")).alias("at"))
    got = reports.ordered_distinct(df.union(df), "key", "v", "at", cap=50).first()
    assert got.v_list == " | ".join(str(i) for i in range(19_999, 19_900, -1))[:50]


def test_faulty_files(spark, tmp_path):
    """Several broken files of one trigger, then more in a second run; an error of the step is no file's fault."""
    box, out = tmp_path / "in", tmp_path / "out"
    spark.range(40).repartition(4).write.parquet(str(box))
    for i in range(3):
        (box / f"broken{i}.parquet").write_bytes(b"not parquet" * i)
    read = lambda paths: spark.read.schema("id long").parquet(*paths)

    def run(step=None):
        flows.ingest_files(flows.file_arrivals(spark, [str(box)]), read, str(out), str(tmp_path / "cp"), step=step, bad="id = 5").awaitTermination()

    run()
    (box / "more.parquet").write_bytes(b"PAR1 cut off")
    spark.range(40, 50).coalesce(1).write.mode("append").parquet(str(box))
    run()
    assert sorted(r.id for r in spark.read.parquet(f"{out}/rows").collect()) == [i for i in range(50) if i != 5]
    broken = {r.source_file: bytes(r.content) for r in spark.read.parquet(f"{out}/broken").collect()}
    assert broken == {"broken1.parquet": b"not parquet", "broken2.parquet": b"not parquet" * 2, "more.parquet": b"PAR1 cut off", **({"broken0.parquet": b""} if "broken0.parquet" in broken else {})}
    (box / "last.parquet").write_bytes((next(p for p in box.iterdir() if p.name.startswith("part"))).read_bytes())
    with pytest.raises(Exception, match="raise_error|no file"):
        run(lambda df: df.withColumn("id", F.raise_error(F.lit("no file is at fault")).cast("long")))


def test_archive(spark, tmp_path):
    """Files that are done move to the archive once a later batch is committed."""
    box, gone = tmp_path / "in", tmp_path / "gone"
    os.makedirs(box)

    def run(i):
        spark.range(i, i + 1).coalesce(1).write.mode("append").parquet(str(box))
        stream = flows.file_stream(spark, [str(box)], spark.range(1).schema, archive=str(gone))
        flows.stream_ingest(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()

    for i in range(3):
        run(i)
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out/rows")).collect()) == [0, 1, 2]
    assert [p for p in gone.rglob("*.parquet")]


def test_first_held(spark, tmp_path):
    """Out of order over two runs: the lowest number wins although it comes later; what is older than the watermark is dropped; a forgotten key begins anew."""
    day = lambda d: dt.datetime(2024, 1, d)
    schema, box = "k string, n int, at timestamp, note string", str(tmp_path / "in")

    def run(*some):
        spark.createDataFrame(list(some), schema).coalesce(1).write.mode("append").parquet(box)
        stream = spark.readStream.schema(schema).parquet(box)
        held = flows.held_first(stream, ["k"], "n", "at", "3 days", "1 day")
        held.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.k, r.n, r.note) for r in spark.read.schema(schema).parquet(str(tmp_path / "out")).collect())

    assert run(("a", 5, day(2), None), ("b", 9, day(2), "x")) == []
    assert run(("a", 3, day(3), "later"), ("a", None, day(2), "no number"), ("a", 8, day(2), "z"), ("c", 1, day(4), "c"), ("c", 0, None, "no time")) == []
    assert run(("d", 1, day(20), "d"), ("b", 2, day(1), "too late")) == [("a", 3, "later"), ("b", 9, "x"), ("c", 1, "c")]
    assert run(("a", 1, day(25), "anew"), ("e", 1, day(30), "e")) == [("a", 1, "anew"), ("a", 3, "later"), ("b", 9, "x"), ("c", 1, "c"), ("d", 1, "d")]


def test_held_keys_share_states(spark, tmp_path):
    """Keys of one state are held and let go apart, as a walk over single keys does; states are as many as buckets at most."""
    rng, start = random.Random(11), dt.datetime(2024, 1, 1)
    schema, box, states = "k double, j string, n int, at timestamp", str(tmp_path / "in"), []
    keys = [(x, y) for x in (None, 0.0, 1.5, 2.0, 3.0) for y in (None, "", "a")]
    held, mark, want = {}, dt.datetime(1970, 1, 1), []

    def go(but=()):
        for k in [k for k, (_, due) in held.items() if due < mark and k not in but]:
            want.append((*k, held.pop(k)[0]))

    for run in range(5):
        some = [(*rng.choice(keys), rng.choice([None, *range(50)]), start + dt.timedelta(hours=run * 40 + rng.randint(-40, 40))) for _ in range(25)]
        spark.createDataFrame([(-x if x == 0 and i % 2 else x, *r) for i, (x, *r) in enumerate(some)], schema).coalesce(1).write.mode("append").parquet(box)
        stream = spark.readStream.schema(schema).parquet(box)
        q = flows.held_first(stream, ["k", "j"], "n", "at", "2 days", "1 day", buckets=3).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        states += [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress]
        seen = set()
        for x, y, n, at in [r for r in some if r[3] > mark]:
            n = 1 << 62 if n is None else n
            best, due = held.get((x, y), (n, at + dt.timedelta(days=2)))
            held[x, y] = (min(best, n), min(due, at + dt.timedelta(days=2)))
            seen.add((x, y))
        for k in seen:
            held[k] = (held[k][0], max(held[k][1], mark + dt.timedelta(milliseconds=1)))
        go(seen)
        mark = max(mark, max(r[3] for r in some) - dt.timedelta(days=1))
        go()
    got = spark.read.schema(schema).parquet(str(tmp_path / "out")).collect()
    assert sorted(map(repr, want)) == sorted(repr((abs(r.k) if r.k == 0 else r.k, r.j, 1 << 62 if r.n is None else r.n)) for r in got) and len(want) > 15
    assert 0 < max(states) <= 3


def test_provider_gives_up_and_is_asked_again(spark, tmp_path):
    log, down = tmp_path / "log", tmp_path / "down"
    os.makedirs(log)
    down.write_text("")

    def call(keys):
        if os.path.exists(down) and any(k % 4 == 0 for k in keys):
            raise TimeoutError
        with open(f"{log}/{os.getpid()}", "a") as f:
            f.write("".join(f"{k}\n" for k in keys))
        return [(k, f"n{k}") for k in keys]

    schema, cache = "key long, name string", str(tmp_path / "cache")
    df = spark.range(30).select(F.col("id").alias("key")).union(spark.range(30).select("id"))
    provider = enrich.map_provider(call, schema, size=1, retries=1, backoff=0.0)
    assert enrich.fill_cache(df, "key", cache, provider, schema, keys_a_wave=10) == 30
    enrich.merge_cache(spark, cache, "key", schema)
    assert enrich.read_cache(spark, cache, "key", schema).count() == 22
    down.unlink()
    assert enrich.fill_cache(df, "key", cache, provider, schema) == 8
    enrich.merge_cache(spark, cache, "key", schema)
    assert enrich.fill_cache(df, "key", cache, provider, schema) == 0
    asked = [x for p in log.iterdir() for x in p.read_text().split()]
    assert sorted(map(int, asked)) == list(range(30))
    assert sorted(os.listdir(cache)) and len(os.listdir(cache)) == 1


def test_tables_of_unlike_headers(spark, tmp_path):
    for i in range(120):
        head, body = [("ИНН;x", "77000000{0:02d};"), ('"employees","INN"', '"{0}","78000000{0:02d}"'), ("﻿Название,инн", '"a, {0}",79000000{0:02d}')][i % 3]
        (tmp_path / f"t{i}.csv").write_text(f"{head}\n{body.format(i % 90)}\n\n".replace(";", ","), "utf-8")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "head.csv").write_text("ИНН\n")
    df = registry.registry_tables(spark, f"{tmp_path}/*.csv")
    got = [(r.source_file, r.inn, r.employees, r.name) for r in df.collect()]
    assert len(got) == 120 and {i[:2] for _, i, _, _ in got} == {"77", "78", "79"}
    assert all((n or "").startswith("a, ") == i.startswith("79") for _, i, _, n in got) and all((e is not None) == i.startswith("78") for _, i, e, _ in got)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Relation") <= 2


def test_tables_of_a_folder(spark, tmp_path):
    """A folder's tables by the pattern of their names are those that a path with the pattern finds."""
    for i in range(4):
        (tmp_path / f"t{i}.csv").write_text(f"ИНН,Численность\n770000000{i},{i}\n", "utf-8")
    (tmp_path / "note.txt").write_text("ИНН\n7800000000\n", "utf-8")
    a, b = registry.registry_tables(spark, str(tmp_path), pattern="*.csv"), registry.registry_tables(spark, f"{tmp_path}/*.csv")
    told = [sorted((r.source_file, r.inn, r.employees) for r in df.collect()) for df in (a, b)]
    assert told[0] == told[1] == [(f"t{i}.csv", f"770000000{i}", i) for i in range(4)]


def test_headers_are_written_by_all_tasks(spark, sf, monkeypatch):
    """Several tasks make the files of each kind, and their folder is listed at once."""
    seen, read = [], registry.registry_tables
    monkeypatch.setattr(registry, "registry_tables", lambda spark, paths, *more, **named: seen.append(paths) or read(spark, paths, *more, **named))
    suite.QUERIES["registry_headers"](spark, sf)
    files = os.listdir(seen[0].removeprefix("file://"))
    assert len({f.split("-")[1] for f in files if f.endswith(".csv")}) > 1


def test_observed_gate_equals_scans(spark, tmp_path):
    df = spark.range(100).select(F.col("id").cast("string").alias("record_id"), F.lpad(F.col("id").cast("string"), 10, "0").alias("inn"), F.lit("5").alias("employees"), F.lit("7").alias("revenue_rub"), F.when(F.col("id") < 60, "include").otherwise("review").alias("status"))
    m = reports.write_observed(df, f"{tmp_path}/r", [*reports.layer_metrics(df, "routed"), *reports.route_metrics(3, 3, issues=F.col("status") == "review")], ["status"])
    assert (m["routed_rows"], m["included_rows"], m["review_rows"], m["bad_included"], m["issues_rows"], m["routed_no_record"]) == (100, 60, 40, 0, 40, 0)
    gate = {r.check_name: r.status for r in reports.quality_gate_observed(spark, m | {"active_rows": 100, "exported_rows": 59}, {"routed": f"{tmp_path}/r", "x": f"{tmp_path}/x"}).collect()}
    assert gate["export_row_count"] == "FAIL" and gate["routed_exists"] == "PASS" and gate["x_exists"] == "FAIL" and gate["routing_issues"] == "WARN" and gate["partition_sum"] == "PASS"
