"""Queries on record numbers, fields, addresses, faulty files, held rows, observed gates and reports, each against its value."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import SUPPLEMENT_COLUMNS
from ..functions import facts, money, names, text
from ..operators import describe, enrich, regions, reports, restore, route, rows, scan
from ..sources import ingest, registry, sinks
from ..streaming import flows
from .suite_rows import routed
from .suite_text import _raw_lines
from .tables import ENTITIES, MIN_EMPLOYEES, MIN_REVENUE, ROUTED, entities, table, work_dir

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


@query(f"""with {ENTITIES}, n as (select *, lower(subindustry) || '.csv' as source_file, row_number() over (partition by subindustry order by row_no) as record_no,
    1 + row_number() over (partition by subindustry order by row_no) - 1 + coalesce(sum((row_no % 4 = 1)::int) over (partition by subindustry order by row_no rows between unbounded preceding and 1 preceding), 0) as physical_line from e)
    select source_file, inn, record_no, physical_line::bigint as physical_line from n""")
def record_numbers(spark, sf_dir):
    """Number and first line of every record, assembled in chunks of 64 lines."""
    r = ingest.assemble_records(_raw_lines(spark, sf_dir), chunk=64)
    return r.select("source_file", F.regexp_extract("raw_line", r",(\d{10}),", 1).alias("inn"), "record_no", "physical_line")


@query(r"""with b as (select doc_id, regexp_replace(coalesce(text, ''), '"(?:[^"]|"")*"?', '', 'g') as t from documents)
    select doc_id, (length(t) - length(replace(t, ',', '')) + 1)::int as commas, (length(t) - length(replace(t, ';', '')) + 1)::int as semicolons, (length(t) - length(replace(t, chr(9), '')) + 1)::int as tabs, (length(t) - length(replace(t, '|', '')) + 1)::int as bars from b""")
def field_counts_documents(spark, sf_dir):
    n = table(spark, sf_dir, "documents").select("doc_id", text.field_counts(F.coalesce("text", F.lit("")), ingest.DELIMITERS).alias("n"))
    return n.select("doc_id", *[F.get("n", F.lit(i)).alias(x) for i, x in enumerate(("commas", "semicolons", "tabs", "bars"))])


@query("""select c_custkey, 'f' || c_custkey as first, 'say "' || c_name || '", ' || c_mktsegment as second, case when c_custkey % 3 = 0 then 'x' || chr(10) || 'y' else '' end as third, 3 as n_fields from customer""")
def quoted_fields(spark, sf_dir):
    """Fields with doubled quotes, delimiters and line breaks inside quotes."""
    third = F.when(F.col("c_custkey") % 3 == 0, F.lit('"x\ny"')).otherwise("")
    raw = F.concat(F.lit("f"), F.col("c_custkey").cast("string"), F.lit(',"say ""'), "c_name", F.lit('"", '), "c_mktsegment", F.lit('",'), third)
    t = table(spark, sf_dir, "customer").select("c_custkey", ingest.parse_fields(raw).alias("f"))
    return t.select("c_custkey", *[F.get("f", F.lit(i)).alias(x) for i, x in enumerate(("first", "second", "third"))], F.size("f").alias("n_fields"))


@query("""select c_custkey, case c_custkey % 7 when 0 then 'Республика ' || n_name when 1 then 'Заречная-' || (c_custkey % 9) || ' область' when 2 then 'Южный край' when 3 then 'г. Москва' when 4 then 'Северный автономный округ' when 5 then 'Ward ' || c_custkey end as region,
    case c_custkey % 7 when 0 then 'Республика ' || upper(n_name[1]) || lower(n_name[2:]) when 1 then null when 2 then 'Южный Край' when 3 then 'Г. Москва' when 4 then 'Северный Автономный Округ' when 5 then 'Ward ' || c_custkey end as title from customer join nation on c_nationkey = n_nationkey where n_name not like '% %' and c_custkey % 7 <> 1""")
def address_regions(spark, sf_dir):
    """Regions that addresses name by pattern, or by their second part."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation").where("n_name not like '% %'"), F.col("c_nationkey") == F.col("n_nationkey")).where(k % 7 != 1)
    body = (
        F.when(k % 7 == 0, F.concat(F.lit("Республика  "), "n_name", F.lit(", г. Посёлок, ул. Мира ")))
        .when(k % 7 == 2, "Россия, Южный край, Городок ").when(k % 7 == 3, "г. Москва, пер. Тихий ").when(k % 7 == 4, "Посёлок, Северный автономный округ, дом ")
        .when(k % 7 == 5, F.concat(F.lit("Town, Ward "), k.cast("string"), F.lit(", Street "))).otherwise("Town, abc, ")
    )
    address = F.concat(F.when(k % 2 == 0, F.concat(F.lpad(k.cast("string"), 6, "1"), F.lit(", "))).otherwise(""), body, F.lit("7"))
    # an index in front is no part between commas
    return c.select("c_custkey", regions.address_region(address).alias("region"), regions.title_region(regions.address_region(address)).alias("title"))


@query("select o_orderkey, case when o_custkey % 11 = 0 then 'any customer' else least(o_custkey, o_custkey % 7 + 1)::varchar end as official from orders")
def aliases_in_orders(spark, sf_dir):
    """Every customer is an alias: of those in a text the longest counts, of equal ones the first by name."""
    c = table(spark, sf_dir, "customer").select(F.col("c_name").alias("a"), F.col("c_custkey").cast("string").alias("region"))
    general = spark.createDataFrame([("customer", "any customer"), ("customer#0", "zero")], "a string, region string")
    alias = c.unionByName(general).select(regions.alias_key("a").alias("alias"), "region")
    name = lambda k: F.concat(F.lit("Customer#"), F.lpad(k.cast("string"), 9, "0"))
    two = F.concat(F.lit("Ship to "), name(F.col("o_custkey")), F.lit("; else ("), name(F.col("o_custkey") % 7 + 1), F.lit(")"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 11 == 0, "To a customer; no precustomer#1").otherwise(two).alias("text"))
    return regions.normalize_region(o, "text", alias, "official").select("o_orderkey", "official")


@query("select event_type, count(*) as n_rows, 1::bigint as n_broken, (select sum(length(event_id::varchar) + 1)::bigint from events) as broken_bytes from events where event_id % 10 <> 0 group by 1")
def stream_broken_file(spark, sf_dir):
    """Good files and one that is none: the good rows arrive, the other's bytes and name are set aside, twice run."""
    base = work_dir(spark, "faulty")
    e = table(spark, sf_dir, "events")
    e.repartition(3).write.parquet(f"{base}/incoming")
    e.select(F.col("event_id").cast("string")).coalesce(1).write.text(f"{base}/retry")
    read = lambda paths: spark.read.schema(e.schema).parquet(*paths)
    for _ in range(2):
        arrivals = flows.file_arrivals(spark, [f"{base}/incoming", f"{base}/retry"])
        flows.ingest_files(arrivals, read, f"{base}/out", f"{base}/checkpoint", bad="event_id % 10 = 0").awaitTermination()
    good = spark.read.parquet(f"{base}/out/rows").groupBy("event_type").agg(F.count(F.lit(1)).alias("n_rows"))
    broken = spark.read.parquet(f"{base}/out/broken").where("source_file like 'part-%.txt' and fault is not null")
    return good.crossJoin(broken.agg(F.count(F.lit(1)).alias("n_broken"), F.sum(F.length("content")).cast("long").alias("broken_bytes")))


@query("""with x as (select *, min(ts) over (partition by user_id, event_type) as first_ts, row_number() over (partition by user_id, event_type order by event_id) as r from events)
    select user_id, event_type, event_id, value from x where r = 1 and epoch_ms(first_ts) + 5 * 86400000 < (select epoch_ms(max(ts)) from events) - 86400000""")
def stream_first_held(spark, sf_dir):
    """The first event of a user and kind by its number, whatever comes first, once five days have passed since the earliest."""
    base = work_dir(spark, "held")
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    e.orderBy(F.desc("event_id")).write.parquet(f"{base}/incoming")
    stream = spark.readStream.schema(e.schema).parquet(f"{base}/incoming")
    held = flows.held_first(stream, ["user_id", "event_type"], "event_id", "ts", "5 days", "1 day")
    held.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out").select("user_id", "event_type", "event_id", "value")


@query("""select user_id, date_trunc('day', ts)::timestamp as day, count(*) as n_rows from events where date_trunc('day', ts) + interval 1 day <= (select max(ts) from events) - interval 2 days group by 1, 2""")
def windows_closed(spark, sf_dir):
    """Counts by user and day that go out once the watermark has passed the day; open days stay in the state."""
    base = work_dir(spark, "closed")
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    e.repartition(3).write.parquet(f"{base}/incoming")
    stream = spark.readStream.schema(e.schema).parquet(f"{base}/incoming")
    counts = flows.windowed_counts(stream, "ts", "1 day", ["user_id"], "2 days")
    counts.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out").select("user_id", F.col("window.start").alias("day"), "n_rows")


def _written_layers(spark, sf_dir):
    """The active and routed layers written once, and the metrics of these writes."""
    base = work_dir(spark, "layers")
    active = entities(spark, sf_dir).withColumn("record_id", F.when(F.col("row_no") % 100 != 0, F.col("row_no").cast("string")))
    metrics = reports.write_observed(active, f"{base}/active", reports.layer_metrics(active, "active"))
    r = routed(spark, sf_dir).withColumn("record_id", F.when(F.col("row_no") % 100 != 0, F.col("row_no").cast("string")))
    issues = F.col("industry").startswith("U")
    measures = [*reports.layer_metrics(r, "routed"), *reports.route_metrics(MIN_EMPLOYEES, MIN_REVENUE, issues=issues)]
    metrics |= reports.write_observed(r, f"{base}/routed", measures, ["status"])
    metrics["exported_rows"] = spark.read.parquet(f"{base}/routed/status=include").count()  # from the files' footers
    return metrics, {"active": f"{base}/active", "routed": f"{base}/routed", "export": f"{base}/never_written"}


@query(f"""with {ROUTED}, n as (select count(*) as n, count(*) filter (status = 'include') as i, count(*) filter (status = 'exclude') as x, count(*) filter (status = 'review') as r, count(*) filter (row_no % 100 = 0) as no_record,
      count(*) filter (industry like 'U%') as issues from s)
    select 'active_rows' as check_name, case when n > 0 then 'PASS' else 'FAIL' end as status, 'rows=' || n as details from n union all select 'partition_sum', 'PASS', n || ' ' || i || ' ' || x || ' ' || r from n
    union all select 'included_thresholds', 'PASS', 'bad=0' union all select 'export_row_count', 'PASS', i || ' ' || i from n
    union all select a || '_has_record', case when no_record = 0 then 'PASS' else 'FAIL' end, 'missing=' || no_record from n, (select unnest(['active', 'routed']) as a)
    union all select a || '_has_inn', 'PASS', 'missing=0' from (select unnest(['active', 'routed']) as a)
    union all select a || '_exists', case when a = 'export' then 'FAIL' else 'PASS' end, '' from (select unnest(['active', 'routed', 'export']) as a)
    union all select 'routing_issues', case when issues = 0 then 'PASS' else 'WARN' end, 'rows=' || issues from n union all select 'overall', 'FAIL', ''""")
def quality_gate_written(spark, sf_dir):
    """The whole gate from what was counted while the layers were written: record ids, ids, routes, thresholds, issues, existence."""
    return reports.quality_gate_observed(spark, *_written_layers(spark, sf_dir))


@query(f"with {ROUTED} select 'active' as layer, count(*) as n_rows from e union all select 'routed', count(*) from s union all select case status when 'include' then 'included' when 'exclude' then 'excluded' else 'review' end, count(*) from s group by status union all select 'issues', count(*) filter (industry like 'U%') from s union all select 'exported', count(*) filter (status = 'include') from s")
def layer_status_written(spark, sf_dir):
    return reports.layer_status_observed(spark, _written_layers(spark, sf_dir)[0])


@query("""select lpad(c_custkey::varchar, 10, '0') as inn, case when c_custkey % 5 in (0, 1, 4) then (c_custkey % 100)::bigint end as employees, case c_custkey % 5 when 0 then (c_custkey % 40 + 1) * 1e6 when 2 then (c_custkey % 40 + 1) * 1.0 when 4 then (c_custkey % 40 + 1) * 1e3 end::double as revenue_rub,
    case when c_custkey % 5 in (1, 2) then c_name end as name from customer""")
def registry_headers(spark, sf_dir):
    """Tables of five kinds of header, many files each, in one scan: columns are found by name wherever they stand."""
    base = work_dir(spark, "headers")
    k, id_ = F.col("c_custkey"), F.lpad(F.col("c_custkey").cast("string"), 10, "0")
    staff, sales = (k % 100).cast("string"), (k % 40 + 1).cast("string")
    c = table(spark, sf_dir, "customer")
    kinds = [
        {"ИНН": id_, "Численность": staff, "Выручка, млн руб": sales},
        {"note": F.lit('a "quoted", note'), "Название": F.col("c_name"), "INN": id_, "employees": staff},
        {"companyname": F.col("c_name"), "x": F.lit(""), "CompanyRevenueRawRUB": sales, "inn": id_},
        {"y": F.lit("1"), "z": F.lit("2"), "ИНН компании": id_},
        {"Сотрудники, чел": staff, "ИНН": id_, "Выручка, тыс руб": sales},
    ]
    for i, cols in enumerate(kinds):
        told = c.where(k % 5 == i).repartition(spark.sparkContext.defaultParallelism)  # making files takes the time, so every core makes some
        told.select(*[v.alias(n) for n, v in cols.items()]).write.mode("append").option("header", True).option("escape", '"').option("maxRecordsPerFile", 50).csv(base)
    return registry.registry_tables(spark, base, pattern="*.csv").select("inn", "employees", "revenue_rub", "name")


@query("""select 'table' as method, count(*) as n_rows, sum(c_custkey % 100)::bigint as employees, count(*) as with_inn from customer
    union all select 'text', count(distinct c_mktsegment), sum(n) filter (true), count(distinct c_mktsegment) from (select c_mktsegment, count(*)::bigint as n from customer group by 1)""")
def registry_texts(spark, sf_dir):
    """Tables and free texts of one folder: a text a segment, which states how many rows it has."""
    base = work_dir(spark, "texts")
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer")
    c.select(F.lpad(k.cast("string"), 10, "0").alias("ИНН"), (k % 100).cast("string").alias("Численность")).write.mode("append").option("header", True).csv(base)
    told = c.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n")).select(F.concat(F.lit("ИНН 7700000001. Численность - "), F.col("n").cast("string"), F.lit(" чел.")).alias("value"))
    told.coalesce(1).write.mode("append").option("maxRecordsPerFile", 1).text(base)
    found = registry.registry_all(spark, base)
    return found.groupBy("method").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("employees").alias("employees"), F.count("inn").alias("with_inn"))


@query("select event_type, substr(string_agg('value ' || event_id, ' | ' order by event_id desc), 1, 2000) as v_list from events group by 1")
def concat_of_many_values(spark, sf_dir):
    """Keys with thousands of values each: no more are kept than the text can hold."""
    e = table(spark, sf_dir, "events").select("event_type", F.concat(F.lit("value "), F.col("event_id").cast("string")).alias("v"), (-F.col("event_id")).alias("place"))
    return reports.ordered_distinct(e, "event_type", "v", "place")


@query("""with k as (select case when l_orderkey % 10 <> 0 then 'same' else l_shipdate::date::varchar end as key from lineitem), n as (select key, count(*) as n from k group by 1)
    select key, n as n_rows, coalesce(sum(n) over (order by key rows between unbounded preceding and 1 preceding), 0)::bigint + 1 as first, sum(n) over (order by key)::bigint as last, n as n_numbers from n""")
def equal_keys_numbered(spark, sf_dir):
    """Nine tenths of the rows have one order key; numbers are still without gaps and in order."""
    key = F.when(F.col("l_orderkey") % 10 != 0, "same").otherwise(F.col("l_shipdate").cast("date").cast("string"))
    n = rows.with_seq(table(spark, sf_dir, "lineitem").select(key.alias("key")), ["key"], "n")
    return n.groupBy("key").agg(F.count(F.lit(1)).alias("n_rows"), F.min("n").alias("first"), F.max("n").alias("last"), F.count_distinct("n").alias("n_numbers"))


@query("select o_orderkey, case when o_orderkey % 3 <> 0 then 'r' || o_orderkey else row_number() over (order by o_orderkey)::varchar end as id from orders")
def public_ids(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("r"), F.col("o_orderkey").cast("string"))).otherwise(" ").alias("record_id"))
    return rows.with_public_id(o, ["o_orderkey"]).select("o_orderkey", "id")


@query("select o_orderkey, 'n' || o_custkey as name, (select count(distinct o_custkey) from orders) as asked_first, 0::bigint as asked_again, (select count(distinct o_custkey) from orders) as n_cached from orders")
def enrich_retried(spark, sf_dir):
    """A provider whose every call fails at first: each key is looked up once, cached once, and not asked for again."""
    base, tried = work_dir(spark, "cache"), set()

    def call(keys):
        if keys[0] not in tried:
            tried.add(keys[0])
            raise ConnectionError("try later")
        return [(k, f"n{k}") for k in keys]

    schema = "key long, name string"
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("key"))
    provider = enrich.map_provider(call, schema, backoff=0.0)
    first = enrich.fill_cache(o, "key", base, provider, schema, keys_a_wave=5000)
    again = enrich.fill_cache(o, "key", base, provider, schema)
    enrich.merge_cache(spark, base, "key", schema)
    cache = enrich.read_cache(spark, base, "key", schema)
    told = spark.read.option("recursiveFileLookup", True).schema(schema).parquet(base).agg(F.count(F.lit(1)).alias("n_cached"))
    return enrich.enrich_cached(o, "key", cache, None)[0].select("o_orderkey", "name", F.lit(first).cast("long").alias("asked_first"), F.lit(again).cast("long").alias("asked_again")).crossJoin(told)


@query("select c_custkey, case when c_nationkey % 4 = 0 then '78' else lpad((100 + n_nationkey)::varchar, 3, '0') end as code, case when c_nationkey % 4 = 0 then 'Own of 78' else 'Land ' || n_name end as region, case when c_nationkey % 4 = 0 then 'District 0' else 'District ' || n_regionkey end as district from customer join nation on c_nationkey = n_nationkey")
def region_file(spark, sf_dir):
    """A file of regions beside the built-in ones: nations under codes and aliases of their own, and a new name for a built-in code."""
    path = work_dir(spark, "regions")
    n = table(spark, sf_dir, "nation")
    own = n.select((100 + F.col("n_nationkey")).cast("string").alias("region_code"), F.concat(F.lit("Land "), "n_name").alias("region_name"), F.concat(F.lit("District "), F.col("n_regionkey").cast("string")).alias("federal_district"), F.concat(F.lit("nation "), F.lower("n_name"), F.lit("|the "), F.lower("n_name")).alias("aliases"))
    replaced = n.where("n_nationkey = 0").select(F.lit("78").alias("region_code"), F.lit("Own of 78").alias("region_name"), F.lit("District 0").alias("federal_district"), F.lit("seventy-eight").alias("aliases"))
    own.unionByName(replaced).write.option("header", True).csv(path)
    dim, alias = regions.load_regions(spark, path)
    c = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    c = c.select("c_custkey", F.when(F.col("c_nationkey") % 4 == 0, "in Seventy-Eight, house 1").when(F.col("c_nationkey") % 4 == 1, F.concat(F.lit("The "), "n_name")).otherwise(F.concat(F.lit("some nation "), "n_name", F.lit(" (land)"))).alias("stated"))
    named = regions.normalize_region(c, "stated", alias, "region")
    return named.join(dim, "region", "left").select("c_custkey", "code", "region", "district")


@query(f"with {ENTITIES} select 'd' || row_no % 4 as district, sector, industry, subindustry, count(*) as n_rows, 1::bigint as n_folders from e group by 1, 2, 3, 4")
def nested_sink(spark, sf_dir):
    """Folders of district, sector, industry and branch, read again by their names."""
    base = work_dir(spark, "nested")
    keys = ["district", "sector", "industry", "subindustry"]
    e = entities(spark, sf_dir).withColumn("district", F.concat(F.lit("d"), (F.col("row_no") % 4).cast("string")))
    sinks.write_partitioned(e, base, keys)
    folders = F.struct(*[F.col(f"p_{k}") for k in keys])
    return spark.read.parquet(base).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(folders).alias("n_folders"))


@query("select unnest(['Description', 'URL', 'raw_line']) as cell, unnest([(select count(*) from orders where o_orderkey % 3 = 0), (select count(*) from orders where o_orderkey % 5 = 0), (select count(*) from orders where o_orderkey % 2 = 0)]) as n_cells")
def supplement_cells(spark, sf_dir):
    """Cells of an export filled from the clean layer, over all columns that are supplemented; rows without an id match by key."""
    o = table(spark, sf_dir, "orders")
    full = {x: F.concat(F.lit(f"{x} "), F.col("o_orderkey").cast("string")) for x in SUPPLEMENT_COLUMNS}
    full |= {"RegionRegistration": F.lit("r"), "Sector": F.lit("s"), "Industry": F.lit("i"), "Subindustry": F.col("o_orderkey").cast("string")}
    clean = o.select(F.col("o_orderkey").alias("n"), F.col("o_orderkey").cast("string").alias("record_id"), F.lpad(F.col("o_custkey").cast("string"), 10, "0").alias("INN"), *[v.alias(k) for k, v in full.items()])
    lost = {"Description": 3, "URL": 5, "raw_line": 2}
    target = clean.withColumns({x: F.when(F.col("n") % m == 0, F.lit(" ")).otherwise(F.col(x)) for x, m in lost.items()}).withColumn("record_id", F.when(F.col("n") % 7 != 0, F.col("record_id")))
    _, cells = restore.restore(target, clean, SUPPLEMENT_COLUMNS)
    return cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n_cells"))


@query("select c_custkey, case when c_custkey % 3 = 0 or c_custkey % 4 = 0 then 'source ' || c_mktsegment else 'about ' || c_name end as told from customer")
def stale_texts(spark, sf_dir):
    k = F.col("c_custkey")
    old = F.when(k % 3 == 0, F.concat(F.lit("Выручка НЕИЗВЕСТНА у "), "c_name")).when(k % 4 == 0, "  ").otherwise(F.concat(F.lit("about "), "c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", describe.stale_text(old, F.concat(F.lit("source "), "c_mktsegment")).alias("told"))


@query("""select o_orderkey, 'Численность работников — около ' || case when o_custkey >= 1000 then regexp_replace(replace(printf('%.1f', round_even(o_custkey / 1000.0, 1)), '.', ','), ',0$', '') || ' тыс.' else o_custkey::varchar end || ' человек' || case when o_orderkey % 2 = 0 then ' по данным за 2021 год' else '' end || ', ' ||
    case when o_orderkey % 3 = 0 then 'годовой бюджет' else 'годовая выручка' end || ' — около ' || (o_orderkey % 90 + 1) || ',5 млрд руб.' || case when o_orderkey % 5 = 0 then ' по данным за ' || year(o_orderdate) || ' год' else '' end || '.' as told from orders""")
def tail_sentences(spark, sf_dir):
    k = F.col("o_orderkey")
    staff = facts.fmt_employees(F.col("o_custkey").cast("string"))
    sales = facts.fmt_revenue(F.concat((k % 90 + 1).cast("string"), F.lit(",5 млрд")))
    told = facts.tail(staff, sales, F.when(k % 2 == 0, "2021"), F.when(k % 5 == 0, F.year("o_orderdate").cast("string")), k % 3 == 0)
    return table(spark, sf_dir, "orders").select("o_orderkey", told.alias("told"))


@query("""with t as (select *, 'По переданным данным ' || c_name || '.' as a, case when c_custkey % 5 = 0 then repeat('long ', 100) || 'end.' else 'Second.' end as b from customer)
    select c_custkey, a || ' ' || b || ' Third one' || case when c_custkey % 5 = 0 then '' else '; ' || case when c_custkey % 6 = 0 then 'операционная роль компании описана на основе переданных регистрационных и отраслевых данных'
      else concat_ws(', а ', case when c_custkey % 3 <> 0 then 'региональная привязка сформирована по направлению «R' || c_nationkey || '»' end, case when c_custkey % 2 <> 0 then 'профиль деятельности относится к направлению «' || c_mktsegment || '»' end) end end || '. Fourth.' as told from t""")
def short_texts_expanded(spark, sf_dir):
    k = F.col("c_custkey")
    second = F.when(k % 5 == 0, F.concat(F.repeat(F.lit("long "), 100), F.lit("end."))).otherwise("Second.")
    t = F.concat(F.lit("По открытым данным "), "c_name", F.lit(".  "), second, F.lit(" Third one. Fourth."))
    region, profile = F.when(k % 3 != 0, F.concat(F.lit("R"), F.col("c_nationkey").cast("string"))), F.when(k % 2 != 0, F.col("c_mktsegment")).otherwise(" ")
    return table(spark, sf_dir, "customer").select("c_custkey", text.expand_short(t, region, profile).alias("told"))


@query("select c_custkey, case when c_custkey % 3 = 0 then 'Завод ' || c_custkey || ', ООО' when c_custkey % 3 = 1 then 'Firm ' || c_custkey || ', АО' else 'Plain ' || c_custkey end as name from customer")
def short_names(spark, sf_dir):
    """`Name, FORM` from the official name, from a short one with the form in it, or as it stands."""
    k, s = F.col("c_custkey"), F.col("c_custkey").cast("string")
    official = F.when(k % 3 == 0, F.concat(F.lit("ООО «Завод "), s, F.lit("»"))).when(k % 3 == 1, F.concat(F.lit("АО «Other "), s, F.lit("»"))).otherwise(F.concat(F.lit("Plain "), s))
    short = F.when(k % 3 == 1, F.concat(F.lit("АО Firm "), s))
    return table(spark, sf_dir, "customer").select("c_custkey", names.short_name(official, short).alias("name"))


@query("select count(*) as n_rows, count(*) filter (o_orderkey % 6 < 2) as n_active, count(*) filter (o_orderkey % 6 >= 2) as n_dropped from orders")
def active_filter_dropped(spark, sf_dir):
    flag = F.get(F.array(*[F.lit(x) for x in ("1", " TRUE ", "0", "no", "")]), (F.col("o_orderkey") % 6).cast("int"))
    return route.active_dropped(table(spark, sf_dir, "orders").select(flag.alias("is_active")))


@query("""select doc_id::varchar as record_id, lpad(doc_id::varchar, 10, '0') as "INN", 'Firm ' || doc_id as "CompanyNameOfficial", case when doc_id % 3 = 0 then 'ok' else 'needs_review' end as description_status,
    (100 - 12 * (doc_id % 3))::int as description_quality_score, case doc_id % 3 when 0 then '' when 1 then 'too_short' else 'too_short;missing_year' end as description_issues, 'rules' as text_origin from documents""")
def quality_projection(spark, sf_dir):
    k = F.col("doc_id")
    issues = F.when(k % 3 == 0, F.array().cast("array<string>")).when(k % 3 == 1, F.array(F.lit("too_short"))).otherwise(F.array(F.lit("too_short"), F.lit("missing_year")))
    d = table(spark, sf_dir, "documents").select(k.cast("string").alias("record_id"), F.lpad(k.cast("string"), 10, "0").alias("INN"), F.concat(F.lit("Firm "), k.cast("string")).alias("CompanyNameOfficial"), issues.alias("description_issues"), F.lit("rules").alias("text_origin"))
    d = d.withColumns({"description_quality_score": 100 - 12 * F.size("description_issues"), "description_status": F.when(F.size("description_issues") == 0, "ok").otherwise("needs_review")})
    return describe.quality_rows(d)


@query("select path, size, row_number() over (order by size desc, lower(path), path) as place from (select case when p_partkey % 2 = 0 then upper(p_brand) else lower(p_brand) end || '/' || p_partkey as path, p_size as size from part)")
def files_by_size(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    path = F.concat(F.when(F.col("p_partkey") % 2 == 0, F.upper("p_brand")).otherwise(F.lower("p_brand")), F.lit("/"), F.col("p_partkey").cast("string"))
    return scan.files_report(p.select(path.alias("path"), F.col("p_size").alias("size")))


@query("""with w as (select p_partkey, string_split(p_name || ' no' || p_partkey, ' ') as ws, ['ООО', 'ПАО', 'ГУП', 'АО'][p_partkey % 4 + 1] as form from part),
    t as (select p_partkey, form, list_aggregate(list_transform(ws, lambda x: case when regexp_full_match(x, '[a-z]+-?[0-9]+') then upper(x) else upper(x[1]) || x[2:] end), 'string_agg', ' ') as name from w)
    select p_partkey, form, form || ' «' || name || '»' as official, name as short from t""")
def official_names_of_parts(spark, sf_dir):
    """Names of many words under long and short forms, quoted or bare, in any case."""
    k = F.col("p_partkey")
    name = F.concat("p_name", F.lit(" no"), k.cast("string"))
    form = F.get(F.array(*[F.lit(x) for x in ("Общество с ограниченной ответственностью", "ПАО", "гуп", "АКЦИОНЕРНОЕ ОБЩЕСТВО")]), (k % 4).cast("int"))
    whole = F.when(k % 3 == 0, F.concat(form, F.lit(' "'), F.upper(name), F.lit('"'))).when(k % 3 == 1, F.concat(form, F.lit("  «"), name, F.lit("»"))).otherwise(F.concat(form, F.lit(" "), name))
    p = rows.spread(table(spark, sf_dir, "part").select("p_partkey", "p_name")).select("p_partkey", whole.alias("whole"))
    return p.withColumn("official", names.official_name("whole")).select("p_partkey", names.legal_form("whole")["form"].alias("form"), "official", names.bare_name("official").alias("short"))


@query("""with x as (select o_orderkey, o_totalprice::decimal(18, 2) as p from orders), y as (select *, (case o_orderkey % 4 when 0 then 1000 when 1 then 1000000 when 2 then 1000000000 else 1 end)::double * p::double as v from x)
    select o_orderkey, v as rub, ['thousand_rub', 'million_rub', 'billion_rub', 'rub'][o_orderkey % 4 + 1] as unit, case when v < 0 then 'negative_revenue' when v > 0 and v < 1000000 then 'revenue_below_1m' when v > 10000000000000 then 'revenue_extremely_high_check_unit' else '' end as issue from y""")
def revenues_of_orders(spark, sf_dir):
    """Prices as revenue with a decimal comma and spaces between thousands, in four units."""
    k, p = F.col("o_orderkey") % 4, F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2)
    written = F.translate(F.translate(p, ",", " "), ".", ",")
    told = F.concat(written, F.get(F.array(*[F.lit(x) for x in (" тыс руб", " млн руб", " млрд руб", " руб")]), k.cast("int")))
    o = table(spark, sf_dir, "orders").select("o_orderkey", money.money_to_unit(told).alias("m"))
    return o.select("o_orderkey", "m.rub", "m.unit", money.revenue_issue(F.format_string("%.2f", "m.rub")).alias("issue"))


@query("select event_type, count(*) as n_rows, 3::bigint as n_batches, true as archived from events group by 1")
def stream_archived(spark, sf_dir):
    """Three runs of a stream whose finished files move to an archive; what moved is whole and no row comes twice."""
    base = work_dir(spark, "archived")
    e = table(spark, sf_dir, "events")
    for i in range(3):
        e.where(F.col("event_id") % 3 == i).write.mode("append").parquet(f"{base}/incoming")
        stream = flows.file_stream(spark, [f"{base}/incoming"], e.schema, archive=f"{base}/archive")
        flows.stream_ingest(stream, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    rows_ = spark.read.parquet(f"{base}/out/rows")
    moved = spark.read.schema(e.schema).option("recursiveFileLookup", True).parquet(f"{base}/archive").agg(F.count(F.lit(1)).alias("n"))
    good = rows_.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("event_id").alias("n_ids"))
    told = rows_.agg(F.count_distinct("batch").alias("n_batches"))
    return good.crossJoin(told).crossJoin(moved).select("event_type", "n_rows", "n_batches", ((F.col("n") > 0) & (F.col("n_rows") == F.col("n_ids"))).alias("archived"))
