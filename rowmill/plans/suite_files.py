"""Queries on files written and read again, repeated right sides, restarted streams, reports and layouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import payloads, text
from ..operators import describe, enrich, overrides, regions, reports, route, rows, scan
from ..sources import ingest, registry, sinks
from ..streaming import flows
from .suite_rows import routed
from .suite_text import _raw_lines
from .tables import ENTITIES, ROUTED, entities, table, work_dir

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


@query("select o_orderstatus, o_orderpriority, count(*) as n_rows, count(*) filter (o_custkey % 3 <> 0) as n_filled from orders group by 1, 2")
def strings_reread(spark, sf_dir):
    base = work_dir(spark, "strings")
    o = table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority", F.when(F.col("o_custkey") % 3 != 0, F.concat(F.lit('say "x", '), F.col("o_custkey").cast("string"))).otherwise("  ").alias("note"))
    o.write.option("header", True).option("escape", '"').csv(base)
    read = ingest.read_strings(spark, base)
    return read.groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n_rows"), F.count("note").alias("n_filled"))


@query("select event_type, count(*) as n_rows from events where event_type <> 'click' group by 1")
def folders_scanned(spark, sf_dir):
    base = work_dir(spark, "scan")
    e = table(spark, sf_dir, "events").select(F.col("event_id").cast("string"), "event_type", F.when(F.col("event_type") == "click", "Archive").otherwise("live").alias("place"))
    e.write.option("header", True).partitionBy("place").csv(base)
    read = ingest.scan_dir(spark, [f"{base}/*/"], exclude=["place=archive"])
    return read.where("source_file like 'part-%'").groupBy("event_type").agg(F.count(F.lit(1)).alias("n_rows"))


@query("select count(*) as n_lines, count(*) as n_places, count(*) as n_in_order from customer")
def lines_of_files(spark, sf_dir):
    """Line numbers of files that are read in blocks: no number twice, and ascending with what was written."""
    from pyspark.sql import Window

    base = work_dir(spark, "lines")
    table(spark, sf_dir, "customer").repartitionByRange(3, "c_custkey").sortWithinPartitions("c_custkey").select(F.col("c_custkey").cast("string").alias("value")).write.text(base)
    lines = ingest.scan_lines(spark, base)
    before = F.lag(F.col("line").cast("long")).over(Window.partitionBy("source_file").orderBy("line_no"))
    lines = lines.withColumn("ok", F.coalesce(before < F.col("line").cast("long"), F.lit(True)) & (F.col("line_no") >= 1))
    return lines.agg(F.count(F.lit(1)).alias("n_lines"), F.count_distinct("source_file", "line_no").alias("n_places"), F.count_if("ok").alias("n_in_order"))


@query("select 'table' as method, count(*) as n_rows, count(*) filter (c_custkey % 5 = 0) as n_review, sum(c_custkey % 100)::bigint as employees from customer union all select 'xml', count(*), count(*) filter (s_suppkey % 4 = 0), null from supplier")
def registry_folder(spark, sf_dir):
    base = work_dir(spark, "registry")
    k = F.col("c_custkey")
    t = table(spark, sf_dir, "customer").select(F.when(k % 5 != 0, F.lpad(k.cast("string"), 10, "0")).alias("ИНН"), F.concat((k % 100).cast("string"), F.lit(" чел")).alias("Численность"))
    t.write.mode("append").option("header", True).csv(base)
    s = F.col("s_suppkey")
    x = table(spark, sf_dir, "supplier").select(F.when(s % 4 != 0, F.lpad(s.cast("string"), 10, "0")).alias("INN"), F.col("s_name").alias("ShortNameRus"))
    x.write.mode("append").format("xml").option("rowTag", "Report").option("rootTag", "Reports").save(base)
    found = registry.registry_all(spark, base)
    method = F.when(F.col("method") == "table", "table").otherwise("xml")
    return found.groupBy(method.alias("method")).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("status") == "review").alias("n_review"), F.sum("employees").alias("employees"))


@query("select run_id, o_orderstatus, count(*) as n_rows from (select 'first' as run_id, o_orderstatus from orders union all select 'second', o_orderstatus from orders where o_orderkey % 2 = 0) group by 1, 2")
def audit_appended(spark, sf_dir):
    base = work_dir(spark, "audit")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    sinks.append_audit(o, base, "first")
    sinks.append_audit(o.where("o_orderkey % 2 = 0"), base, "second")
    return spark.read.parquet(base).groupBy("run_id", "o_orderstatus").agg(F.count(F.lit(1)).alias("n_rows"))


@query(f"with {ENTITIES} select count(*) as n_rows, count(*) as n_numbers, count(*) filter (row_no % 3 = 0) as n_names, 0::bigint as n_absent from e where row_no % 10 = 0")
def overrides_file(spark, sf_dir):
    base = work_dir(spark, "overrides")
    e = entities(spark, sf_dir).where("row_no % 10 = 0")
    cols = {"record_id": F.col("row_no").cast("string"), "INN": F.col("inn"), "CompanyNameOfficial": F.when(F.col("row_no") % 3 == 0, F.col("official_name"))}
    rest = ["RegionRegistration", "RegionHeadOffice", "RegionOperation", "Sector", "Industry", "Subindustry", "OverrideReason"]
    e.select(*[v.alias(k) for k, v in cols.items()], *[F.lit("x").alias(x) for x in rest]).write.option("header", True).csv(base)
    read = overrides.read_overrides(spark, base)
    absent = overrides.read_overrides(spark, f"{base}-absent").agg(F.count(F.lit(1)).alias("n_absent"))
    return read.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("override_no").alias("n_numbers"), F.count("CompanyNameOfficial").alias("n_names")).crossJoin(absent)


@query(f"with {ENTITIES} select subindustry as source_file, count(*) as n_rows, count(*) filter (row_no % 50 = 0) as n_header_like from e group by 1")
def headers_dropped(spark, sf_dir):
    """A header as a file's first record goes; rows like it further down stay."""
    from ..constants import SOURCE_COLUMNS

    names = F.array(*[F.lit(x) for x in SOURCE_COLUMNS])
    e = entities(spark, sf_dir)
    body = e.select(F.col("subindustry").alias("source_file"), (F.col("row_no") + 1).alias("record_no"), F.when(F.col("row_no") % 50 == 0, names).otherwise(F.array(F.col("official_name"), F.lit("b"))).alias("fields"))
    first = e.select(F.col("subindustry").alias("source_file")).distinct().select("source_file", F.lit(0).cast("long").alias("record_no"), names.alias("fields"))
    kept = ingest.drop_headers(body.unionByName(first))
    return kept.groupBy("source_file").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.get("fields", F.lit(0)) == SOURCE_COLUMNS[0]).alias("n_header_like"))


@query("select o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as last_key, count(*) as n_rows from orders group by 1")
def latest_of_list(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", F.col("o_orderdate").cast("string").alias("day")))).alias("items"))
    return o.select("o_custkey", payloads.latest_by("items", "day")["o_orderkey"].alias("last_key"), F.size("items").cast("long").alias("n_rows"))


@query("select conv_id, turn, 'One of ' || role || '. Two. Three. ' || case when turn % 2 = 0 then 'The end of ' || conv_id || '.' else 'Four.' end as told from conversations")
def tails_enforced(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    body = F.concat(F.lit("One of "), F.col("role"), F.lit(". Two. Three. Four."))
    tail = F.concat(F.lit("The end of "), F.col("conv_id").cast("string"), F.lit("."))
    return t.select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, text.enforce_tail(body, tail)).otherwise(body).alias("told"))


@query("""select c_custkey, sha1('{"c_mktsegment":"' || c_mktsegment || '","c_name":"' || c_name || '"}') as fingerprint from customer""")
def row_fingerprints(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", text.fingerprint("c_name", "c_mktsegment").alias("fingerprint"))


@query("select event_type, count(*) as n_rows, count(distinct event_id) as n_events, (select count(*) from events where event_id % 10 = 0) as n_aside, (select count(*) from events) as n_audited from events where event_id % 10 <> 0 group by 1")
def stream_restarted(spark, sf_dir):
    """Half of the files arrive before a restart, half after it in the retry folder; each row is taken once and audited."""
    base = work_dir(spark, "restart")
    e = table(spark, sf_dir, "events").withColumn("value", F.coalesce("value", F.lit(0.0)))
    e.where("event_id % 2 = 0").repartition(3).write.parquet(f"{base}/incoming")
    e.limit(0).write.parquet(f"{base}/retry")

    def run():
        stream = flows.file_stream(spark, [f"{base}/incoming", f"{base}/retry"], e.schema)
        flows.stream_ingest(stream, f"{base}/out", f"{base}/checkpoint", bad="event_id % 10 = 0", audit=f"{base}/audit").awaitTermination()

    run()
    e.where("event_id % 2 <> 0").repartition(3).write.mode("append").parquet(f"{base}/retry")
    run()
    run()
    good = spark.read.parquet(f"{base}/out/rows").groupBy("event_type").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("event_id").alias("n_events"))
    told = spark.read.parquet(f"{base}/audit").agg(F.sum("n_aside").alias("n_aside"), F.sum("n_rows").alias("n_audited"))
    return good.crossJoin(told)


@query("select user_id, date_trunc('day', ts)::timestamp as day, count(*) as n_rows from events group by 1, 2")
def windowed_event_counts(spark, sf_dir):
    """Counts by user and a day's window, all windows given out anew with each batch."""
    base = work_dir(spark, "windows")
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    e.repartition(3).write.parquet(f"{base}/incoming")
    stream = spark.readStream.schema(e.schema).parquet(f"{base}/incoming")
    counts = flows.windowed_counts(stream, "ts", "1 day", ["user_id"], "2 days")

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    counts.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{base}/out")
    last = out.agg(F.max("batch").alias("batch"))
    return out.join(last, "batch").select("user_id", F.col("window.start").alias("day"), "n_rows")


def _findings(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    body = F.format_string("name: %s\npassword = 'k7-%s'\nAuthorization: Bearer 9/%s", F.col("c_name"), F.substring(F.md5("c_name"), 1, 12), F.substring(F.md5("c_name"), 1, 14))
    return scan.scan_secrets(c.select("c_custkey", body.alias("text")), "c_custkey", "text")


@query("select kind, count(*) as n_findings from (select unnest(['credential_assignment', 'bearer_token']) as kind from customer) group by 1")
def findings_counted(spark, sf_dir):
    return scan.findings_summary(_findings(spark, sf_dir))


@query("""select c_custkey, 2 as line_no, 'credential_assignment' as kind, 'password' as key, 15::int as value_length, substr(sha256('k7-' || substr(md5(c_name), 1, 12)), 1, 12) as value_sha256 from customer
    union all select c_custkey, 3, 'bearer_token', 'bearer_token', 16, substr(sha256('9/' || substr(md5(c_name), 1, 14)), 1, 12) from customer""")
def findings_listed(spark, sf_dir):
    return scan.findings_report(_findings(spark, sf_dir), "c_custkey")


@query(f"with {ROUTED} select inn, official_name, sector, industry, subindustry, employees, revenue_rub, status, reason, status = 'exclude' as excluded, case when status = 'exclude' then 'excluded by thresholds: ' || reason end as exclusion_text from s")
def routing_report(spark, sf_dir):
    return route.routing_report(routed(spark, sf_dir), ("inn", "official_name", "sector", "industry", "subindustry"))


@query("select n_name as region, case when n_nationkey % 5 = 0 then '__DISTRICT_NOT_MAPPED__' else 'a' || n_regionkey end as district, count(*) as n_rows from customer join nation on c_nationkey = n_nationkey group by 1, 2")
def district_of_repeated_names(spark, sf_dir):
    """A dimension that names each region under several codes: the first district counts and no row multiplies."""
    n = table(spark, sf_dir, "nation")
    dim = n.where("n_nationkey % 5 <> 0").select(F.col("n_name").alias("region"), F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("p"), "n_regionkey").select("region", F.concat("p", F.col("n_regionkey").cast("string")).alias("district"))
    c = table(spark, sf_dir, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("region"))
    return regions.with_district(c, dim, "region")[0].groupBy("region", "district").agg(F.count(F.lit(1)).alias("n_rows"))


@query("select o_orderkey, case when o_custkey % 2 = 0 then '1' end as lat, case when o_custkey % 2 = 0 then 'lookup' end as geo_source from orders")
def coords_of_repeated_addresses(spark, sf_dir):
    """Two lookup rows of an address, one without coordinates: each order stays one row."""
    none = F.lit(None).cast("string")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("address"), none.alias("lat"), none.alias("lon"))
    look = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").cast("string").alias("address"), F.explode(F.array(F.lit("1"), F.lit("2"), none)).alias("lat"))
    full, _ = enrich.fill_coords(o, look.withColumns({"lon": F.col("lat"), "status": F.lit("ok")}))
    return full.select("o_orderkey", "lat", "geo_source")


@query("select o_orderkey, case when o_custkey % 2 = 0 then 'a' || o_custkey end as name from orders")
def cache_of_repeated_keys(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("key"))
    cache = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("key"), F.explode(F.array(F.lit("b"), F.lit("a"))).alias("p")).select("key", F.concat("p", F.col("key").cast("string")).alias("name"))
    return enrich.enrich_cached(o, "key", cache, None)[0].select("o_orderkey", "name")


@query("select c_custkey::varchar as id, c_name as title, null::varchar as note from customer")
def final_layout(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_name").alias("title"), F.col("c_custkey").cast("string").alias("id"), "c_acctbal")
    return rows.final_columns(c, ["id", "title", "note"])


@query("select doc_id from documents where doc_id % 3 = 0")
def reviewed_only(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "needs_review").otherwise("ok").alias("description_status"))
    return describe.needs_review(d).select("doc_id")


@query("select event_id, case when event_id % 4 <> 0 then '7' else row_number() over (order by event_id)::varchar end as source_row_no, true as has_id from events")
def row_numbers_filled(spark, sf_dir):
    """Blank row numbers take the row's place in order of event_id; every row has an id."""
    e = table(spark, sf_dir, "events").withColumns({"source_row_no": F.when(F.col("event_id") % 4 != 0, F.lit("7")), "INN": F.lit("0000000001"), "Sector": F.col("event_type"), "Industry": F.lit("i"), "Subindustry": F.lit("s")})
    done = rows.ensure_record_id(e, "events.csv", order=["event_id"])
    return done.select("event_id", "source_row_no", F.col("record_id").isNotNull().alias("has_id"))


def _report_text(spark, sf_dir):
    """A report a customer, every seventh cut off, and the name of its file, which for every eighth holds the id."""
    k = F.col("c_custkey")
    say = lambda t: F.format_string(t, *[k] * t.count("%"))
    some = lambda cond, t: F.when(cond, say(t)).otherwise("")
    parts = [
        say('<Report ActualDate="2024-01-01"><SparkID>%d</SparkID>'), some(k % 4 != 0, "<INN>%010d</INN>"), say("<ShortNameRus>N%d</ShortNameRus><FullNameRus>Full %d</FullNameRus><NormName>n%d</NormName>"),
        F.concat(F.lit("<DateFirstReg>"), (1990 + k % 30).cast("string"), F.lit("-05-06</DateFirstReg>")),
        F.when(k % 2 == 0, '<Status Type="acting" Code="1" IsActing="1"/>').otherwise('<Status GroupName="closing" Code="2"/><IsActing>0</IsActing>'),
        F.when(k % 3 != 0, say('<LegalAddresses><Address Region="R" City="C" Address="Street %d" Latitude="55,50" Longitude="none" FiasRegion="F"/></LegalAddresses>')).otherwise(""),
        say('<OKATO RegionName="O" RegionCode="7"/><Www>w%d.ru</Www>'),
        some(k % 6 != 0, '<StaffNumberFTS><Number ActualDate="2021-01-01">%d</Number><Number ActualDate="2020-01-01">5</Number></StaffNumberFTS>'),
        F.when(k % 10 != 0, F.concat(F.lit('<CompanySize Revenue="'), (k % 50 + 1).cast("string"), F.lit('" ActualDate="2022-02-02"/>'))).otherwise(""),
        F.when(k % 7 != 0, "</Report>").otherwise("<Report>"),
    ]
    return table(spark, sf_dir, "customer").select("c_custkey", F.concat(*parts).alias("xml"), F.when(k % 8 == 0, say("r_%010d.xml")).otherwise("x.xml").alias("source_file"))


RECORDS = """r as (select c_custkey as k, c_custkey % 7 = 0 as broken, case when c_custkey % 8 = 0 or (c_custkey % 4 <> 0 and c_custkey % 7 <> 0) then lpad(c_custkey::varchar, 10, '0') end as inn,
      case when c_custkey % 7 <> 0 and c_custkey % 6 <> 0 then c_custkey end as staff, case when c_custkey % 7 <> 0 and c_custkey % 10 <> 0 then c_custkey % 50 + 1 end as size from customer),
    f as (select k, broken, inn, staff::bigint as employees, size * 1e6::double as revenue_rub, rtrim(rtrim(printf('%.3f', size / 1000.0), '0'), '.') as revenue_bln,
      concat_ws(';', case when broken then 'malformed_report' end, case when staff is null then 'missing_employees' end, case when size is null then 'missing_revenue' end, case when inn is null then 'missing_inn' end) as issues,
      concat_ws(' | ', 'employees ' || staff || ' on 2021-01-01', 'revenue ' || size || '000000 in 2022') as evidence,
      case when broken then 'failed' when inn is null then 'review' else 'ok' end as status from r)"""


def _records(spark, sf_dir):
    parsed = _report_text(spark, sf_dir).select(F.from_xml("xml", registry.REPORT).alias("r"), "source_file", F.col("c_custkey"))
    return parsed.select("c_custkey", F.struct("r.*", "source_file").alias("x"))


@query(f"""with {RECORDS} select inn, case when not broken then k::varchar end as registry_id, status, issues, case when broken or inn is null then 'low' when issues <> '' then 'medium' else 'high' end as confidence,
      case when not broken then '2024-01-01' end as report_date, case when not broken then 'N' || k end as name, case when not broken then 'Full ' || k end as full_name, case when not broken then 'n' || k end as norm_name,
      case when not broken then case when k % 2 = 0 then 'acting' else 'closing' end end as state, case when not broken then case when k % 2 = 0 then '1' else '2' end end as state_code,
      case when not broken then case when k % 2 = 0 then '1' else '0' end end as is_acting, case when not broken then (1990 + k % 30) || '-05-06' end as registered_on, case when not broken then (1990 + k % 30)::int end as founded_year,
      case when not broken then case when k % 3 <> 0 then 'R' else 'O' end end as region, case when not broken then case when k % 3 <> 0 then 'F' else '7' end end as region_code, case when not broken and k % 3 <> 0 then 'C' end as city,
      case when not broken and k % 3 <> 0 then 'Street ' || k end as address, case when not broken and k % 3 <> 0 then '55.5' end as latitude, null::varchar as longitude, case when not broken then 'w' || k || '.ru' end as website,
      employees, case when employees is not null then 2021 end as employees_year, case when employees is not null then '2021-01-01' end as employees_date, case when employees is not null then 'staff_list' end as employees_source,
      revenue_rub, revenue_bln, case when revenue_rub is not null then 'million_rub' end as revenue_unit, case when revenue_rub is not null then 2022 end as revenue_year, case when revenue_rub is not null then 'company_size' end as revenue_source,
      evidence, timestamp '2024-02-03 00:00:00' as extracted_at, case when k % 8 = 0 then 'r_' || lpad(k::varchar, 10, '0') || '.xml' else 'x.xml' end as source_file, 'xml' as method, null::varchar as okved_code, null::varchar as okved_name,
      case when revenue_rub is not null then 'stated 2022-02-02; value ' || (k % 50 + 1) end as revenue_evidence, null::double as budget_rub, null::varchar as budget_bln, null::int as budget_year, null::varchar as budget_source from f""")
def registry_records(spark, sf_dir):
    """Every field of an extract, of whole and of broken reports."""
    return registry.registry_reports(_records(spark, sf_dir).select("x.*"), as_of="2024-02-03 00:00:00")


@query(f"with {RECORDS} select count(*) as n_rows, count(inn) as with_inn, count(employees) as with_employees, count(revenue_rub) as with_revenue, count(*) filter (broken) as failed from f")
def extraction_summary(spark, sf_dir):
    return registry.extraction_summary(registry.registry_reports(_records(spark, sf_dir).select("x.*")))


@query("select 'failed' as status, count(distinct o_orderpriority) as n_rows from orders union all select 'ok', count(*) from supplier")
def registry_broken_files(spark, sf_dir):
    """Files that break off or hold no report, one a priority, beside a folder of good ones."""
    base = work_dir(spark, "broken")
    good = table(spark, sf_dir, "supplier").select(F.lpad(F.col("s_suppkey").cast("string"), 10, "0").alias("INN"))
    good.write.format("xml").option("rowTag", "Report").option("rootTag", "Reports").save(f"{base}/good")
    text = F.when(F.col("o_orderpriority").like("1%"), "<Other></Other>").otherwise("<Report><INN>1</INN>")
    table(spark, sf_dir, "orders").select(text.alias("value"), "o_orderpriority").distinct().repartition("o_orderpriority").write.partitionBy("o_orderpriority").text(f"{base}/bad")
    found = registry.registry_xml(spark, [f"{base}/good/*.xml", f"{base}/bad/*/*.txt"])
    return found.groupBy("status").agg(F.count(F.lit(1)).alias("n_rows"))


@query("select o_orderkey, true as excluded, 'inactive' as exclusion_code, 'the status is not active' as exclusion_text, 'status check' as exclusion_source, true as can_be_restored, timestamp '2024-02-03 00:00:00' as excluded_at from orders where o_orderstatus <> 'F'")
def inactive_notes(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "active").otherwise("closed").alias("status"))
    _, closed = route.status_split(o)
    told = route.annotate_inactive(closed, "status check", as_of="2024-02-03 00:00:00")
    return told.select("o_orderkey", "excluded", "exclusion_code", "exclusion_text", "exclusion_source", "can_be_restored", "excluded_at")


@query(f"""with {ENTITIES} select lower(subindustry) || '.csv' as source_file, case when row_no % 4 in (2, 3) then 'repaired_needs_review' else 'exact' end as status, count(*) as n_rows, count(*) as n_ids, count(*) as n_places from e group by 1, 2""")
def record_audit(spark, sf_dir):
    told = ingest.record_audit(ingest.repair_records(ingest.assemble_records(_raw_lines(spark, sf_dir))))
    return told.where("reason <> ''").groupBy("source_file", "status").agg(F.count(F.lit(1)).alias("n_rows"), F.count("record_id").alias("n_ids"), F.count_distinct("source_row_no").alias("n_places"))


@query("select count(*) as n_rows, count(*) filter (doc_id % 3 <> 0) as ok, count(*) filter (doc_id % 3 = 0) as for_review, count(*) filter (doc_id % 5 <> 0) as from_rules from documents")
def description_summary(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 3 == 0, "needs_review").otherwise("ok").alias("description_status"), F.when(F.col("doc_id") % 5 == 0, "service").otherwise("rules").alias("text_origin"))
    return describe.description_summary(d)


@query("select count(*) as n_rows, count(*) filter (o_custkey % 2 = 0) as with_id, count(distinct case when o_custkey % 2 = 0 then o_custkey end) as n_ids from orders")
def request_summary(spark, sf_dir):
    k = F.col("o_custkey")
    return reports.request_summary(table(spark, sf_dir, "orders").select(F.when(k % 2 == 0, F.lpad(k.cast("string"), 10, "0")).otherwise("12-34").alias("inn")), "inn")
