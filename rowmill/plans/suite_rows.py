"""Queries on identity, matching, routing, restoring, regions, overrides, exports and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import operation_codes, record_id
from ..functions.text import first_nonblank, is_missing
from ..operators import export, overrides, regions, reports, restore, route, rows
from ..sources import sinks
from .tables import ENTITIES, FACTS, MIN_EMPLOYEES, MIN_REVENUE, ROUTED, entities, facts, table, work_dir

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return route.size_route(route.match_registry(entities(spark, sf_dir), facts(spark, sf_dir)), MIN_EMPLOYEES, MIN_REVENUE)


@query(f"with {ROUTED} select status, reason, count(*) as n_rows from s group by 1, 2")
def route_summary(spark, sf_dir):
    return route.route_summary(routed(spark, sf_dir))


@query(f"with {ROUTED} select row_no, inn, employees, revenue_rub, matched, status, reason from s")
def route_rows(spark, sf_dir):
    return routed(spark, sf_dir).select("row_no", "inn", "employees", "revenue_rub", "matched", "status", "reason")


@query(f"""with {ROUTED}, x as (select status as subroute, row_no from s union all select 'unmatched', row_no from s where reason = 'unmatched' union all select 'missing_facts', row_no from s where status = 'review' and reason like '%missing%')
    select subroute, count(*) as n_rows, sum(row_no)::bigint as rows_sum from x group by 1""")
def route_subroutes(spark, sf_dir):
    parts = [df.select(F.lit(n).alias("subroute"), "row_no") for n, df in route.split_routes(routed(spark, sf_dir)).items()]
    return rows.union_sources(parts).groupBy("subroute").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("row_no").alias("rows_sum"))


@query(f"with {ROUTED} select count(*) as n_rows, count(*) filter (matched) as matched_rows, count(*) filter (status = 'include') as included_rows, count(*) filter (status = 'exclude') as excluded_rows, count(*) filter (status = 'review') as review_rows from s")
def match_summary(spark, sf_dir):
    return route.match_summary(routed(spark, sf_dir))


@query(f"""with {ROUTED} select row_no, status, status = 'exclude' as excluded, case when status = 'exclude' then reason end as exclusion_code, case when status = 'exclude' then 'registry' end as exclusion_source,
    status = 'exclude' as can_be_restored, case when status = 'exclude' then 'update facts' end as restore_condition from s""")
def exclusion_notes(spark, sf_dir):
    return route.annotate_exclusion(routed(spark, sf_dir), "registry", "update facts").select("row_no", "status", "excluded", "exclusion_code", "exclusion_source", F.coalesce("can_be_restored", F.lit(False)).alias("can_be_restored"), "restore_condition")


@query(f"""with {ENTITIES}, {FACTS}, x as (select e.row_no, e.inn, case when row_no % 3 = 0 then 1 end as own, g.employees, g.revenue_rub from e left join g on e.inn = g.inn)
    select row_no, coalesce(employees, own)::bigint as employees, revenue_rub from x""")
def match_fact_precedence(spark, sf_dir):
    own = entities(spark, sf_dir).withColumn("employees", F.when(F.col("row_no") % 3 == 0, F.lit(1).cast("long")))
    return route.match_registry(own, facts(spark, sf_dir)).select("row_no", "employees", "revenue_rub")


@query("""select event_id, coalesce(nullif(trim(case when event_id % 3 = 0 then '  ' else event_type end), ''), 'none') as v, (event_id % 5 = 0 or event_id % 7 = 0) as missing from events""")
def first_nonblank_of(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("a", F.when(F.col("event_id") % 3 == 0, F.lit("  ")).otherwise(F.col("event_type")))
    e = e.withColumn("m", F.when(F.col("event_id") % 5 == 0, F.lit(" NaN")).when(F.col("event_id") % 7 == 0, F.lit(None).cast("string")).otherwise(F.lit("x")))
    return e.select("event_id", first_nonblank("a", F.lit("none")).alias("v"), is_missing("m").alias("missing"))


_RID = "substr(sha1('customer|' || row_no || '|' || inn || '|' || lower(sector) || '|' || lower(industry) || '|' || lower(subindustry)), 1, 20)"


@query(f"with {ENTITIES} select row_no, {_RID} as record_id from e")
def record_ids(spark, sf_dir):
    return entities(spark, sf_dir).select("row_no", record_id(F.lit("customer"), "row_no", "inn", "sector", "industry", "subindustry").alias("record_id"))


@query(f"with {ENTITIES} select row_no::varchar as source_row_no, case when row_no % 4 = 0 then 'given' else {_RID} end as record_id from e")
def ensure_record_id(spark, sf_dir):
    e = entities(spark, sf_dir).select(F.col("row_no").cast("string").alias("source_row_no"), F.when(F.col("row_no") % 4 == 0, "given").otherwise(" ").alias("record_id"), F.col("inn").alias("INN"), F.col("sector").alias("Sector"), F.col("industry").alias("Industry"), F.col("subindustry").alias("Subindustry"))
    return rows.ensure_record_id(e, "customer").select("source_row_no", "record_id")


def _items(spark, sf_dir):
    item = table(spark, sf_dir, "lineitem")
    return item.withColumn("inn", F.when(F.col("l_partkey") % 10 != 0, F.lpad(F.col("l_partkey").cast("string"), 10, "0")))


_ITEM_KEY = dict(inn="inn", region="l_returnflag", sector="l_linestatus", industry="l_suppkey", subindustry="l_returnflag")
_ITEMS = "i as (select *, l_partkey % 10 <> 0 as known, row_number() over (partition by l_partkey, l_returnflag, l_linestatus, l_suppkey order by l_orderkey, l_linenumber, l_quantity, l_extendedprice) as rn from lineitem)"


@query(f"with {_ITEMS} select l_orderkey, l_linenumber, l_partkey from i where not known or rn = 1")
def dedup_keep_first(spark, sf_dir):
    kept, _ = rows.dedup_composite(_items(spark, sf_dir), scope=(), order=("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"), **_ITEM_KEY)
    return kept.select("l_orderkey", "l_linenumber", "l_partkey")


@query(f"with {_ITEMS} select l_returnflag, count(*) as n_rows from i where known and rn > 1 group by 1")
def dedup_report(spark, sf_dir):
    _, dropped = rows.dedup_composite(_items(spark, sf_dir), scope=(), order=("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"), **_ITEM_KEY)
    return dropped.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n_rows"))


@query("with i as (select *, row_number() over (partition by l_partkey order by l_orderkey, l_linenumber, l_quantity, l_extendedprice) as rn from lineitem) select l_partkey, l_orderkey, l_linenumber from i where rn = 1 or l_partkey % 10 = 0")
def dedup_by_id(spark, sf_dir):
    return rows.dedup_by_id(_items(spark, sf_dir), "inn", ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"])[0].select("l_partkey", "l_orderkey", "l_linenumber")


@query("""with x as (select *, case o_orderpriority when '1-URGENT' then 3 when '2-HIGH' then 2 when '3-MEDIUM' then 1 else 0 end as c, (o_orderkey % 2 = 0)::int + (o_orderkey % 3 = 0)::int as rich from orders),
    y as (select *, row_number() over (partition by o_custkey order by c desc, rich desc, o_orderkey) as rn from x) select o_custkey, o_orderkey from y where rn = 1""")
def best_record_per_key(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("confidence", F.when(F.col("o_orderpriority") == "1-URGENT", "high").when(F.col("o_orderpriority") == "2-HIGH", "medium").when(F.col("o_orderpriority") == "3-MEDIUM", "low"))
    o = o.withColumns({"a": F.when(F.col("o_orderkey") % 2 == 0, "x"), "b": F.when(F.col("o_orderkey") % 3 == 0, "x"), "key": F.col("o_custkey").cast("string")})
    return rows.best_record(o, "key", "confidence", ["a", "b"], ["o_orderkey"]).select("o_custkey", "o_orderkey")


@query(f"with {ENTITIES} select row_no, row_number() over (order by official_name, row_no) as seq from e")
def sequence_numbers(spark, sf_dir):
    return rows.with_seq(entities(spark, sf_dir), ["official_name", "row_no"], "seq").select("row_no", "seq")


def _blanked(spark, sf_dir):
    """Orders with cells lost by a modulus, and the rows they are restored from: every second one has lost its record id as well."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("record_id"), F.col("o_custkey").cast("string").alias("inn"), F.col("o_orderstatus").alias("region"), F.col("o_orderpriority").alias("sector"), F.col("o_orderdate").cast("date").cast("string").alias("day"), F.col("o_orderkey").alias("n"))
    lost = o.withColumn("day", F.when(F.col("n") % 3 == 0, F.lit("")).otherwise(F.col("day")))
    ref = o.withColumn("record_id", F.when(F.col("n") % 2 == 0, F.col("record_id")))
    return restore.restore(lost, ref, ["day"], "record_id", ["inn", "region", "sector"], ["n"])


_RESTORE = """o as (select o_orderkey as n, o_custkey, o_orderstatus, o_orderpriority, o_orderdate::date::varchar as day from orders),
    k as (select o_custkey, o_orderstatus, o_orderpriority, arg_min(day, n) as kday from o group by 1, 2, 3),
    x as (select o.n, o.n % 3 = 0 as lost, o.n % 2 = 0 as by_id, case when o.n % 3 <> 0 then day when o.n % 2 = 0 then day else kday end as day from o join k using (o_custkey, o_orderstatus, o_orderpriority))"""


@query(f"with {_RESTORE} select n, day from x")
def restore_rows(spark, sf_dir):
    return _blanked(spark, sf_dir)[0].select("n", "day")


@query(f"with {_RESTORE} select 'day' as cell, case when by_id then 'record_id' else 'composite' end as \"by\", count(*) as n_cells from x where lost group by 1, 2")
def restore_cell_report(spark, sf_dir):
    return restore.restored_cells(_blanked(spark, sf_dir)[1])


@query("select 'restore' as stage, count(*) as n_before, count(*) as n_after, 'PASS' as status from orders")
def row_conservation(spark, sf_dir):
    return restore.check_same_count(table(spark, sf_dir, "orders"), _blanked(spark, sf_dir)[0], "restore")


@query("select o_orderstatus, o_orderstatus = 'F' as is_active, count(*) as n_rows from orders group by 1, 2")
def status_split(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("status", F.when(F.col("o_orderstatus") == "F", " active ").otherwise("closed"))
    a, b = route.status_split(o)
    return a.unionByName(b).groupBy("o_orderstatus", "is_active").agg(F.count(F.lit(1)).alias("n_rows"))


@query("select count(*) as n_rows from orders where o_orderkey % 2 = 0")
def active_rows(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("is_active", F.when(F.col("o_orderkey") % 2 == 0, "Yes").otherwise("0"))
    return route.active_only(o).agg(F.count(F.lit(1)).alias("n_rows"))


@query(f"with {ENTITIES} select sector, industry, subindustry, count(*) as n_rows from e group by 1, 2, 3")
def group_counts(spark, sf_dir):
    return reports.group_counts(entities(spark, sf_dir), ["sector", "industry", "subindustry"])


@query(f"with {ENTITIES} select sector, industry, subindustry, count(*) as n_rows, (3 - bit_count(grouping(sector, industry, subindustry)::int))::int as level from e group by rollup (sector, industry, subindustry)")
def group_rollup(spark, sf_dir):
    return reports.group_rollup(entities(spark, sf_dir), ["sector", "industry", "subindustry"])


@query("""with f as (select l_orderkey, l_returnflag || l_linestatus as flag, min(l_linenumber) as first_at from lineitem group by 1, 2)
    select l_orderkey, substr(array_to_string(list_transform(list_sort(list({'a': first_at, 'f': flag})), lambda x: x.f), ' | '), 1, 2000) as flag_list from f group by 1""")
def ordered_distinct_concat(spark, sf_dir):
    item = table(spark, sf_dir, "lineitem").withColumn("flag", F.concat("l_returnflag", "l_linestatus"))
    return reports.ordered_distinct(item, "l_orderkey", "flag", "l_linenumber")


@query(f"with {ENTITIES} select inn, official_name, sector from e where row_no % 2 = 0")
def request_rows(spark, sf_dir):
    e = entities(spark, sf_dir).withColumn("inn", F.when(F.col("row_no") % 2 == 0, F.col("inn")).otherwise("12-34"))
    return reports.request_rows(e, ["inn", "official_name", "sector", "absent"], "inn")


def _dim(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select(F.lpad(F.col("n_nationkey").cast("string"), 2, "0").alias("code"), F.col("n_name").alias("region"), F.col("r_name").alias("district"))


def _coded(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lpad((F.col("c_custkey") % 30).cast("string"), 2, "0"), F.lpad(F.col("c_custkey").cast("string"), 8, "0")).alias("INN"), "c_nationkey")


_DIM = "d as (select lpad(n_nationkey::varchar, 2, '0') as code, n_name as region, r_name as district, n_nationkey from nation join region on n_regionkey = r_regionkey)"


@query(f"with {_DIM} select c_custkey, lpad((c_custkey % 30)::varchar, 2, '0') as id_code, region as id_region, district as id_district from customer left join d on lpad((c_custkey % 30)::varchar, 2, '0') = code")
def region_from_id(spark, sf_dir):
    return regions.region_from_id(_coded(spark, sf_dir), _dim(spark, sf_dir)).select("c_custkey", "id_code", "id_region", "id_district")


def _addressed(spark, sf_dir):
    """Addresses around nation names; every fourth one names none."""
    n = F.broadcast(table(spark, sf_dir, "nation"))
    c = _coded(spark, sf_dir).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey")
    text = F.when(k % 4 == 0, F.lit(" elsewhere;")).when(k % 4 == 1, F.col("n_name")).when(k % 4 == 2, F.concat(F.lit("Box 7, "), F.lower("n_name"), F.lit(", Floor 2"))).otherwise(F.concat(F.lit("x"), F.col("n_name"), F.lit("x")))
    return c.withColumn("address", text)


def _alias(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return n.select(regions.alias_key("n_name").alias("alias"), F.col("n_name").alias("region"))


_ADDRESSED = """a as (select c_custkey, n_name, c_nationkey, case c_custkey % 4 when 0 then ' elsewhere;' when 1 then n_name when 2 then 'Box 7, ' || lower(n_name) || ', Floor 2' else 'x' || n_name || 'x' end as address from customer join nation on c_nationkey = n_nationkey),
    f as (select c_custkey, c_nationkey, case c_custkey % 4 when 0 then 'elsewhere' when 3 then address else n_name end as region_name from a)"""


@query(f"with {_ADDRESSED} select c_custkey, region_name from f")
def region_normalize(spark, sf_dir):
    return regions.normalize_region(_addressed(spark, sf_dir), "address", _alias(spark, sf_dir)).select("c_custkey", "region_name")


@query(f"""with {_DIM}, {_ADDRESSED}, g as (select f.c_custkey, case when f.c_custkey % 8 = 0 then null else region_name end as stated, d.region as id_region, d.district as id_district from f left join d on lpad((f.c_custkey % 30)::varchar, 2, '0') = d.code)
    select c_custkey, coalesce(stated, id_region) as region, coalesce((select min(district) from d where d.region = coalesce(stated, id_region)), id_district) as district from g""")
def region_cascade(spark, sf_dir):
    a = _addressed(spark, sf_dir).withColumn("address", F.when(F.col("c_custkey") % 8 != 0, F.col("address")))
    return regions.region_cascade(a, _dim(spark, sf_dir), _alias(spark, sf_dir), "address").select("c_custkey", "region", "district")


@query("""with x as (select c_custkey, lpad((c_custkey % 30)::varchar, 2, '0') as own, lpad((c_custkey % 25)::varchar, 2, '0') as a from customer)
    select c_custkey, case when own <= '24' and own <> a and own <> '01' then own || ',' else '' end || a || case when a <> '01' then ',01' else '' end as codes from x""")
def operation_codes_of(spark, sf_dir):
    c = _coded(spark, sf_dir).withColumn("raw", F.concat(F.lpad((F.col("c_custkey") % 25).cast("string"), 2, "0"), F.lit("; 99, 01 and 123")))
    return c.select("c_custkey", operation_codes("raw", "INN", [f"{i:02d}" for i in range(25)]).alias("codes"))


@query(f"with {_DIM}, x as (select case when c_nationkey % 5 = 0 then 'nowhere' else n_name end as region from customer join nation on c_nationkey = n_nationkey) select x.region, coalesce(d.district, '__DISTRICT_NOT_MAPPED__') as district, count(*) as n_rows from x left join d on x.region = d.region group by 1, 2")
def district_map(spark, sf_dir):
    c = _addressed(spark, sf_dir).select(F.when(F.col("c_nationkey") % 5 == 0, "nowhere").otherwise(F.col("n_name")).alias("region"))
    return regions.with_district(c, _dim(spark, sf_dir).select("region", "district"), "region")[0].groupBy("region", "district").agg(F.count(F.lit(1)).alias("n_rows"))


def _override_sides(spark, sf_dir):
    e = entities(spark, sf_dir).select(F.col("row_no").cast("string").alias("record_id"), F.concat(F.lit("9"), F.lpad(F.floor(F.col("row_no") / 2).cast("string"), 9, "0")).alias("INN"), F.col("official_name").alias("CompanyNameOfficial"), F.col("sector").alias("Sector"), F.col("industry").alias("Industry"), "row_no")
    k = F.col("row_no")
    ov = e.where(k % 10 == 0).select(
        k.alias("override_no"), F.when(k % 30 == 0, F.col("record_id")).alias("record_id"), "INN", F.when(k % 30 == 10, F.col("CompanyNameOfficial")).otherwise("").alias("CompanyNameOfficial"),
        F.when(k % 40 != 0, F.lit("moved")).alias("Sector"), F.lit(" ").alias("Industry"), F.concat(F.lit("r"), k.cast("string")).alias("OverrideReason"),
    )
    return e, ov


# ids are shared by pairs of rows 2k and 2k+1; an id alone matches only where one row has it, which is row 1's (of rows 0 and 1)
_OVERRIDES = f"""{ENTITIES}, m as (select row_no as override_no, row_no, row_no % 40 <> 0 as has_value, (row_no % 30 in (0, 10) or (select count(*) from e y where y.row_no // 2 = e.row_no // 2) = 1) as hit from e where row_no % 10 = 0)"""


@query(f"with {_OVERRIDES} select e.row_no, case when m.hit and m.has_value then 'moved' else e.sector end as sector, coalesce(m.hit and m.has_value, false) as override_applied, case when m.hit and m.has_value then 'r' || e.row_no end as override_reason from e left join m on m.row_no = e.row_no")
def overrides_apply(spark, sf_dir):
    e, ov = _override_sides(spark, sf_dir)
    return overrides.apply_overrides(e, ov)[0].select("row_no", F.col("Sector").alias("sector"), "override_applied", "override_reason")


@query(f"with {_OVERRIDES} select override_no, hit::int::bigint as matched_rows, case when not hit then 'not_matched' when has_value then 'applied' else 'matched_no_values' end as status, case when hit and has_value then 'Sector' else '' end as fields, 'r' || override_no as reason from m")
def overrides_audit(spark, sf_dir):
    return overrides.apply_overrides(*_override_sides(spark, sf_dir))[1]


def _export(spark, sf_dir):
    e = entities(spark, sf_dir)
    k = F.col("row_no")
    e = e.withColumns({"region": F.when(k % 11 != 0, F.col("region")), "industry": F.when(k % 13 != 0, F.when(k % 2 == 0, F.col("sector")).otherwise(F.replace("sector", F.lit(" "), F.lit("_")))).otherwise(" ")})
    return export.export_routing(e, "region", "industry", "subindustry")


_EXPORT = f"""{ENTITIES}, x as (select row_no, case when row_no % 11 <> 0 then region else '__REGION_NOT_MAPPED__' end as export_region, case when row_no % 13 = 0 then '__INDUSTRY_MISSING__' when row_no % 2 = 0 then sector else replace(sector, ' ', '_') end as export_industry, subindustry as export_subindustry from e),
    y as (select *, replace(export_region, ' ', '_') || '/' || replace(export_industry, ' ', '_') || '/' || export_subindustry || '.csv' as export_path from x)"""


@query(f"with {_EXPORT} select row_no, export_region, export_industry, export_subindustry, export_path from y")
def export_routing(spark, sf_dir):
    return _export(spark, sf_dir).select("row_no", *export.ROUTES, "export_path")


@query(f"with {ENTITIES} select issue, count(*) as n_rows from (select 'missing_region' as issue from e where row_no % 11 = 0 union all select 'missing_industry' from e where row_no % 13 = 0) group by 1")
def export_issues(spark, sf_dir):
    return export.routing_issues(_export(spark, sf_dir)).groupBy("issue").agg(F.count(F.lit(1)).alias("n_rows"))


@query(f"with {_EXPORT} select export_path, count(*) as n_rows, string_agg(distinct export_region, ';' order by export_region) as export_region, string_agg(distinct export_industry, ';' order by export_industry) as export_industry, string_agg(distinct export_subindustry, ';' order by export_subindustry) as export_subindustry from y group by 1")
def export_manifest(spark, sf_dir):
    return export.export_manifest(_export(spark, sf_dir))


@query(f"with {_EXPORT} select export_path, count(*) as n_rows, count(distinct (export_region, export_industry, export_subindustry)) as n_routes from y group by 1 having count(distinct (export_region, export_industry, export_subindustry)) > 1")
def export_collisions(spark, sf_dir):
    return export.export_collisions(_export(spark, sf_dir))


@query("select count(*) as n_rows from customer")
def export_written(spark, sf_dir):
    out = work_dir(spark, "export")
    sinks.write_partitioned(_export(spark, sf_dir).drop("issues"), out, export.ROUTES)
    return sinks.count_export(spark, out)


@query(f"with {ROUTED} select 'active' as layer, count(*) as n_rows from s union all select 'included', count(*) filter (status = 'include') from s union all select 'picked', count(*) filter (status = 'include') from s")
def layer_status(spark, sf_dir):
    s = routed(spark, sf_dir)
    inc = s.where("status = 'include'")
    _, picked = reports.pick_layer({"described": s.where("status = 'described'"), "included": inc, "active": s})
    return reports.layer_status({"active": s, "included": inc, "picked": picked})


def _flat(spark, sf_dir):
    e = entities(spark, sf_dir).withColumns({"rid": F.col("row_no").cast("string"), "name2": F.when(F.col("row_no") % 2 == 0, F.concat(F.lit('ООО "'), F.col("official_name"), F.lit('", 0,75'))), "lat": F.concat((F.col("row_no") % 90).cast("string"), F.lit(",500")), "lon": F.when(F.col("row_no") % 3 != 0, F.lit("37.6200")), "text": F.concat(F.col("sector"), F.lit("; "), F.col("industry"), F.lit("|\n"), F.col("subindustry"))})
    return export.flat_export(e, {"id": ["rid"], "title": ["name2", "official_name"], "lat": ["lat"], "lon": ["lon"], "description": ["text"], "inn": ["inn"], "region": ["region"], "industry": ["industry"], "subindustry": ["subindustry"]})


@query(f"""with {ENTITIES} select row_no::varchar as id, case when row_no % 2 = 0 then 'ООО ''' || official_name || ''' 0 75' else official_name end as title, (row_no % 90) || '.5' as lat, case when row_no % 3 <> 0 then '37.62' else '' end as lon, '' as address,
    sector || ' ' || industry || ' ' || subindustry as description, inn, region, industry, subindustry, '' as website, '' as description_status from e""")
def flat_export(spark, sf_dir):
    return _flat(spark, sf_dir)


@query("select count(*) as n_lines, 0::bigint as bad_lines, count(*) filter (c_custkey % 3 <> 0) as with_coordinates from customer")
def flat_validate(spark, sf_dir):
    out = work_dir(spark, "flat")
    sinks.write_flat(_flat(spark, sf_dir), out)
    return export.flat_validate(spark.read.text(out))


@query(f"""with {ROUTED}, n as (select count(*) as a, count(*) filter (status = 'include') as i, count(*) filter (status = 'exclude') as x, count(*) filter (status = 'review') as r from s)
    select unnest(['active_rows', 'partition_sum', 'included_thresholds', 'export_row_count', 'active_has_inn', 'routed_has_inn', 'included_has_inn', 'excluded_has_inn', 'review_has_inn', 'overall']) as check_name, unnest(['PASS', 'PASS', 'PASS', 'PASS', 'PASS', 'PASS', 'PASS', 'PASS', 'PASS', 'PASS']) as status,
      unnest(['rows=' || a, a || ' ' || i || ' ' || x || ' ' || r, 'bad=0', i || ' ' || i, 'missing=0', 'missing=0', 'missing=0', 'missing=0', 'missing=0', '']) as details from n""")
def quality_gate(spark, sf_dir):
    s = routed(spark, sf_dir)
    return reports.quality_gate_routed(entities(spark, sf_dir), s, MIN_EMPLOYEES, MIN_REVENUE)


@query(f"with {ENTITIES} select subindustry, case subindustry when 'MACHINERY' then 1 when 'BUILDING' then 2 else 9999 end as position, count(*) as n_rows from e group by 1, 2")
def category_order(spark, sf_dir):
    order = spark.sql("select * from values ('MACHINERY', 1), ('BUILDING', 2) as t(name, position)")
    return reports.order_by_category(group_counts(spark, sf_dir).groupBy("subindustry").agg(F.sum("n_rows").alias("n_rows")), "subindustry", order).select("subindustry", "position", "n_rows")


@query("select src, count(*) as n_rows, count(k) as with_key from (select 'customer' as src, c_custkey as k from customer union all select 'supplier', null from supplier) group by 1")
def union_sources(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.lit("customer").alias("src"), F.col("c_custkey").alias("k"))
    b = table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("src"))
    return rows.union_sources([a, b]).groupBy("src").agg(F.count(F.lit(1)).alias("n_rows"), F.count("k").alias("with_key"))


@query("with f as (select o_custkey, arg_min(o_orderstatus, o_orderkey) as first_status from orders group by 1), l as (select o_custkey, arg_max(o_orderkey, o_orderkey) as last_key from orders group by 1) select c_custkey, first_status, last_key from customer left join f on c_custkey = f.o_custkey left join l on c_custkey = l.o_custkey")
def assemble_layers(spark, sf_dir):
    from ..operators.enrich import assemble
    from ..operators.rows import keep_first

    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    last = keep_first(o, ["c_custkey"], [F.desc("o_orderkey")]).select("c_custkey", F.col("o_orderkey").alias("last_key"), F.lit(1).alias("o_orderkey"))
    out = assemble(table(spark, sf_dir, "customer"), o.select("c_custkey", "o_orderkey", F.col("o_orderstatus").alias("first_status")), last.drop("o_orderkey").withColumn("o_orderkey", F.lit(1)), "c_custkey", ["o_orderkey"])
    return out.select("c_custkey", "first_status", "last_key")
