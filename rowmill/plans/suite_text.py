"""Queries on text, names, money, facts, descriptions, lookups, scans, ingest, registry readers and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import REFERENCE_SITES
from ..functions import facts as fact
from ..functions import money, names, payloads, text
from ..functions.ids import ids_in_text
from ..operators import describe, enrich, rows, scan
from ..sources import ingest, registry
from ..streaming import flows
from .tables import ENTITIES, entities, table, work_dir

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(r"select doc_id, nullif(trim(regexp_replace(regexp_replace(regexp_replace(text, '\[[^\]]*\]', ' ', 'g'), 'https?://[^\s]+', ' ', 'g'), '\s+', ' ', 'g'), ' ;,.—-'), '') as clean from documents")
def clean_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.clean_text("text").alias("clean"))


@query(r"""select doc_id, trim(regexp_replace(translate(text, ',;|"', '   '''), '\s+', ' ', 'g')) as flat, length(trim(regexp_replace(text, '\s+', ' ', 'g'))) as n from documents""")
def flat_values(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", text.flat_clean("text").alias("flat"), F.length(text.squeeze("text")).cast("long").alias("n"))



def _named(spark, sf_dir):
    """Customers under names with legal forms, spelled in five ways."""
    k = F.col("c_custkey") % 5
    cases = ['общество с ограниченной ответственностью "северный ветер"', "ПАО «НЛМК»", "гуп водоканал-2 карелии", "АКЦИОНЕРНОЕ ОБЩЕСТВО Тгк-2", "просто имя"]
    name = F.element_at(F.array(*[F.lit(x) for x in cases]), (k + 1).cast("int"))
    return rows.spread(table(spark, sf_dir, "customer").select("c_custkey")).select("c_custkey", k.alias("i"), name.alias("name"))


@query("""select c_custkey, ['ООО', 'ПАО', 'ГУП', 'АО', ''][c_custkey % 5 + 1] as form, ['ООО «Северный Ветер»', 'ПАО «НЛМК»', 'ГУП «Водоканал-2 Карелии»', 'АО «Тгк-2»', 'Просто Имя'][c_custkey % 5 + 1] as official,
    ['Северный Ветер', 'НЛМК', 'Водоканал-2 Карелии', 'Тгк-2', 'Просто Имя'][c_custkey % 5 + 1] as short from customer""")
def official_names(spark, sf_dir):
    return _named(spark, sf_dir).select("c_custkey", names.legal_form("name")["form"].alias("form"), names.official_name("name").alias("official"), names.short_from_official("name").alias("short"))


@query("""select c_custkey, ['общество с ограниченной ответственностью "северный ветер"|Северный Ветер', 'НЛМК', 'водоканал-2 карелии', 'АКЦИОНЕРНОЕ ОБЩЕСТВО Тгк-2|Тгк-2', 'просто имя'][c_custkey % 5 + 1] as variants from customer""")
def name_variants(spark, sf_dir):
    return _named(spark, sf_dir).select("c_custkey", F.array_join(names.name_variants("name"), "|").alias("variants"))


@query(r"select page_id, regexp_replace(lower(regexp_replace(regexp_replace(url, '^https?://', ''), '[/?#].*$', '')), '^www\.', '') as host from pages")
def site_extract(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", text.site([F.concat(F.lit("see https://www.yandex.ru/maps and sub.list-org.com, "), F.col("url"))], REFERENCE_SITES).alias("host"))


@query("""with x as (select o_orderkey, o_orderkey % 5 as k, (o_orderkey % 900) + 0.5 as v from orders) select o_orderkey, case k when 0 then v * 1e9 when 1 then v * 1e6 when 2 then v * 1e3 when 3 then v when 4 then v * 1e9 end as rub,
    ['billion_rub', 'million_rub', 'thousand_rub', 'rub', 'billion_rub_inferred'][k + 1] as unit from x""")
def money_units(spark, sf_dir):
    k, v = F.col("o_orderkey") % 5, F.concat((F.col("o_orderkey") % 900).cast("string"), F.lit(",5"))
    value = F.when(k == 0, F.concat(v, F.lit(" млрд руб"))).when(k == 1, F.concat(v, F.lit(" млн"))).when(k == 2, F.concat(v, F.lit(" тыс руб"))).when(k == 3, F.concat(v, F.lit(" руб"))).otherwise(v)
    o = table(spark, sf_dir, "orders").select("o_orderkey", money.money_to_unit(value).alias("m"))
    return o.select("o_orderkey", "m.rub", "m.unit")


@query("""select case when o_orderkey % 4 = 0 then 'missing_revenue' when o_orderkey % 4 = 1 then 'negative_revenue' when o_orderkey % 4 = 2 then 'revenue_below_1m' else 'revenue_extremely_high_check_unit' end as issue, count(*) as n_rows from orders group by 1""")
def revenue_issues(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    v = F.when(k == 0, "-").when(k == 1, "-1 234,5").when(k == 2, "999.999,99").otherwise("20,000,000,000,000.00")
    return table(spark, sf_dir, "orders").select(money.revenue_issue(v).alias("issue")).where("issue <> ''").groupBy("issue").agg(F.count(F.lit(1)).alias("n_rows"))


@query("""select o_orderkey, case o_orderkey % 3 when 0 then (o_orderkey % 50 + 0.5) * 1e9 when 1 then (o_orderkey % 50) * 1e3 end as v, case o_orderkey % 3 when 0 then (o_orderkey % 50) || '.5' when 1 then '0' end as bln from orders""")
def numbers_clean(spark, sf_dir):
    k, n = F.col("o_orderkey") % 3, (F.col("o_orderkey") % 50).cast("string")
    v = F.when(k == 0, F.concat(F.lit("около "), n, F.lit(",5 млрд"))).when(k == 1, F.concat(n, F.lit(" тыс."))).otherwise("нет данных")
    o = table(spark, sf_dir, "orders").select("o_orderkey", money.number(v).alias("v"))
    return o.select("o_orderkey", "v", F.when(F.col("o_orderkey") % 3 == 1, "0").otherwise(money.to_billions("v")).alias("bln"))


def _told(spark, sf_dir):
    """Customers with a text that states facts."""
    k = F.col("c_custkey")
    told = F.concat(F.lit("Основано в "), (1990 + k % 30).cast("string"), F.lit(" году, численность около "), (k % 9 + 1).cast("string"), F.lit(" тыс. человек, выручка примерно "), (k % 7 + 1).cast("string"), F.lit(",5 млн рублей"))
    address = F.concat(F.lit("185000, Республика Карелия, г Городок"), (k % 4).cast("string"), F.lit(", ул Ленина"))
    return rows.spread(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")).select("*", told.alias("Description"), address.alias("address"))


@query("select c_custkey, (1990 + c_custkey % 30)::varchar as year, (c_custkey % 9 + 1) * 1000 as employees, ((c_custkey % 7 + 1) + 0.5)::double / 1000.0 as revenue, 'Городок' || (c_custkey % 4) as city from customer")
def text_facts(spark, sf_dir):
    t = _told(spark, sf_dir)
    return t.select("c_custkey", fact.text_year("Description").alias("year"), fact.text_employees("Description").alias("employees"), fact.text_revenue("Description").alias("revenue"), fact.text_city("address").alias("city"))


def _described(spark, sf_dir):
    t = _told(spark, sf_dir).withColumns({"CompanyNameOfficial": F.concat(F.lit("ООО Фирма "), F.col("c_custkey").cast("string")), "Subindustry": F.when(F.col("c_custkey") % 2 == 0, "Теплоснабжение").otherwise(F.col("c_mktsegment")), "Industry": F.lit("Энергетика"), "region": F.lit("Республика Карелия"), "Description": F.when(F.col("c_custkey") % 5 != 0, F.col("Description"))})
    return describe.rule_description(t)


@query("""select c_custkey, case when c_custkey % 5 = 0 then 'missing_year;missing_employees;missing_revenue_or_budget' else '' end as missing,
    'ООО «Фирма ' || c_custkey || '» работает' || case when c_custkey % 5 <> 0 then ' с ' || (1990 + c_custkey % 30) || ' года' else '' end || ' в Городок' || (c_custkey % 4) || ' и занимается ' ||
    case when c_custkey % 5 = 0 then 'деятельностью в подотрасли ' || case when c_custkey % 2 = 0 then 'теплоснабжение' else lower(c_mktsegment) end
         else 'основано в ' || (1990 + c_custkey % 30) || ' году, численность около ' || (c_custkey % 9 + 1) || ' тыс' end || '.' as first_sentence,
    case when c_custkey % 2 = 0 then 'Ключевая функция компании связана с эксплуатацией тепловой инфраструктуры и теплоснабжением потребителей.' else 'Ключевая функция компании связана с эксплуатацией энергетической инфраструктуры и обеспечением потребителей ресурсами.' end as key_fact from customer""")
def rule_description(spark, sf_dir):
    d = _described(spark, sf_dir)
    cut = F.substring_index(F.col("description"), " Компания обслуживает", 1)
    k = F.regexp_extract("description", r"(Ключевая функция[^.]*\.)", 1)
    return d.select("c_custkey", F.array_join("missing", ";").alias("missing"), cut.alias("first_sentence"), k.alias("key_fact"))


@query("""select c_custkey, case when c_custkey % 5 = 0 then 'too_short;missing_year;missing_required_tail;missing_financial_or_employees_values' else 'sentence_count_3;too_short' end as issues, case when c_custkey % 5 = 0 then 52 else 76 end as score, 'needs_review' as status from customer""")
def description_qa(spark, sf_dir):
    d = text.text_qa(_described(spark, sf_dir), "description")
    return d.select("c_custkey", F.array_join("description_issues", ";").alias("issues"), F.col("description_quality_score").alias("score"), F.col("description_status").alias("status"))


@query("select c_custkey, case when c_custkey % 5 = 0 then 'service' else 'rules' end as text_origin from customer")
def description_pick(spark, sf_dir):
    d = _described(spark, sf_dir).withColumn("other", F.when(F.col("c_custkey") % 5 == 0, F.lit("Работает с 2001 года. Два. Три. Численность работников — около 5 человек.")).otherwise(F.lit("лидер")))
    return describe.pick_text(d, "description", "other").select("c_custkey", "text_origin")


@query(r"select doc_id, len(list_filter(regexp_split_to_array(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.!?]) ', '\1' || chr(2), 'g'), chr(2)), lambda x: x <> ''))::bigint as n_sentences from documents")
def sentence_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.sentences("text")).cast("long").alias("n_sentences"))


def _orders_cached(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("key"))
    cache = o.select("key").distinct().where("key % 2 = 0").select("key", F.concat(F.lit("c"), F.col("key").cast("string")).alias("name"))
    provider = enrich.map_provider(lambda keys: [(k, f"p{k}") for k in keys if k % 3 == 0], "key long, name string")
    return enrich.enrich_cached(o, "key", cache, provider)


@query("select o_orderkey, case when o_custkey % 2 = 0 then 'c' || o_custkey when o_custkey % 3 = 0 then 'p' || o_custkey end as name from orders")
def enrich_cached(spark, sf_dir):
    return _orders_cached(spark, sf_dir)[0].select("o_orderkey", "name")


@query("select count(distinct o_custkey) as n_new from orders where o_custkey % 2 <> 0 and o_custkey % 3 = 0")
def enrich_new_rows(spark, sf_dir):
    return _orders_cached(spark, sf_dir)[1].agg(F.count(F.lit(1)).alias("n_new"))


@query("""select case when o_orderkey % 4 = 0 then 'stated' when o_orderkey % 4 in (1, 2) and o_custkey % 2 = 0 then 'lookup' else 'none' end as geo_source, count(*) as n_rows, count(*) filter (o_orderkey % 4 = 3) as no_address from orders group by 1""")
def coords_fill(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(k != 3, F.concat(F.lit("a"), F.col("o_custkey").cast("string"))).alias("address"), F.when(k == 0, "55.1").alias("lat"), F.when(k == 0, "37.1").alias("lon"))
    look = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.concat(F.lit("a"), F.col("c_custkey").cast("string")).alias("address"), F.lit("1").alias("lat"), F.lit("2").alias("lon"), F.lit("ok").alias("status"))
    full, missing = enrich.fill_coords(o, look)
    gone = missing.where("reason = 'no_address_for_geocoding'").select("o_orderkey", F.lit(1).alias("gone"))
    out = full.join(gone, "o_orderkey", "left")
    return out.groupBy(F.coalesce("geo_source", F.lit("none")).alias("geo_source")).agg(F.count(F.lit(1)).alias("n_rows"), F.count("gone").alias("no_address"))


@query("""select event_id, case when event_id % 3 <> 0 then event_type end as inn, case when event_id % 3 <> 0 then 'val' end as name, case when event_id % 2 = 0 then event_id::varchar end as lat, case when event_id % 2 = 0 then user_id::varchar end as lon, case when event_id % 2 = 0 then 'ok' else 'not_found' end as status from events""")
def payload_parse(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    company = F.when(F.col("event_id") % 3 != 0, F.format_string('{"suggestions":[{"value":"val","data":{"inn":"%s","name":{"full_with_opf":" "}}}]}', "event_type")).otherwise('{"suggestions":[]}')
    place = F.when(F.col("event_id") % 2 == 0, F.format_string('{"response":{"GeoObjectCollection":{"featureMember":[{"GeoObject":{"Point":{"pos":"%s %s"}}}]}}}', F.col("user_id").cast("string"), F.col("event_id").cast("string"))).otherwise('{"response":{"GeoObjectCollection":{"featureMember":[]}}}')
    p = e.select("event_id", payloads.company_payload(company).alias("c"), payloads.place_payload(place).alias("p"))
    return p.select("event_id", "c.inn", "c.name", "p.lat", "p.lon", "p.status")


@query("select count(*) filter (k = 0) as n_assignment, count(*) filter (k = 1) as n_bearer, count(*) filter (k = 2) as n_url from (select c_custkey % 4 as k from customer)")
def secret_scan(spark, sf_dir):
    k, v = F.col("c_custkey") % 4, F.substring(F.md5("c_name"), 1, 16)
    line = F.when(k == 0, F.concat(F.lit("x\napi_key = '7-"), v, F.lit("' # live"))).when(k == 1, F.concat(F.lit("Authorization: Bearer 7-"), v)).when(k == 2, F.concat(F.lit("GET /a?token=7-"), v, F.lit("&b=1"))).otherwise("password = your_secret")
    found = scan.scan_secrets(table(spark, sf_dir, "customer").select("c_custkey", line.alias("text")), "c_custkey", "text")
    kinds = {r: F.count_if(F.col("kind") == f).alias(r) for r, f in (("n_assignment", "credential_assignment"), ("n_bearer", "bearer_token"), ("n_url", "url_credential"))}
    return found.agg(*kinds.values())


@query(r"select count(*) as n_findings from (select unnest(regexp_extract_all(text, '(?i)\bbearer\s+([A-Za-z0-9._~+/=-]{12,})', 1)) as v from documents) where not regexp_full_match(v, '[A-Za-z_][A-Za-z0-9_.]*')")
def secret_scan_documents(spark, sf_dir):
    return scan.scan_secrets(table(spark, sf_dir, "documents"), "doc_id", "text").where("kind = 'bearer_token'").agg(F.count(F.lit(1)).alias("n_findings"))


@query("select c_custkey, c_custkey % 3 = 0 as blocked_dir, c_custkey % 2 = 0 as blocked_suffix, c_custkey % 5 = 0 as large_file from customer")
def path_filter(spark, sf_dir):
    from ..functions.paths import path_flags

    k = F.col("c_custkey")
    p = F.concat(F.when(k % 3 == 0, "src/Cache/").otherwise("src/lib/"), F.col("c_name"), F.when(k % 2 == 0, ".SQLITE").otherwise(".py"))
    c = table(spark, sf_dir, "customer").select("c_custkey", p.alias("path"), F.when(k % 5 == 0, 1 << 21).otherwise(10).alias("size"))
    return path_flags(c, "path", "size").select("c_custkey", "blocked_dir", "blocked_suffix", "large_file")


@query("select lpad(o_custkey::varchar, 10, '7') as inn, count(*) as n_lines from orders where o_custkey % 2 <> 0 group by 1")
def recover_lost_ids(spark, sf_dir):
    inn = F.lpad(F.col("o_custkey").cast("string"), 10, "7")
    lines = table(spark, sf_dir, "orders").select(F.concat(F.lit("x;"), inn, F.lit(";12345678901;"), F.col("o_orderstatus")).alias("line"))
    final = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.lpad(F.col("c_custkey").cast("string"), 10, "7").alias("inn"))
    return scan.recover_lost_ids(lines, final).groupBy("inn").agg(F.count(F.lit(1)).alias("n_lines"))


@query("select lpad(c_custkey::varchar, 10, '7') as \"INN\", c_name as note, (select count(*) from customer) > 0 as blank_rest from customer where c_custkey % 2 = 0")
def retry_template(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.lpad(F.col("c_custkey").cast("string"), 10, "7").alias("inn"), F.col("c_name").alias("note"))
    t = rows.retry_template(c)
    return t.select("INN", "note", (F.col("Sector").isNull() & F.col("Source").isNull()).alias("blank_rest"))


def _raw_lines(spark, sf_dir):
    """Customers as lines of raw files, one file a segment: well-formed, quoted over two lines, too long around the id, or short."""
    e = entities(spark, sf_dir)
    k = F.col("row_no") % 4
    head = F.concat_ws(",", "sector", "industry", "subindustry", F.lit("Short"))
    name = F.when(k == 1, F.concat(F.lit('"Line\nBreak, '), F.col("official_name"), F.lit('"'))).when(k == 2, F.concat(F.lit("Firm, "), F.col("official_name"))).otherwise(F.col("official_name"))
    tail = F.when(k == 2, F.lit("r1,r2,01,some, text,www.x.ru,src, more")).when(k == 3, F.lit("r1,r2")).otherwise(F.lit("r1,r2,01,text,www.x.ru,src"))
    line = F.concat(head, F.lit(","), name, F.lit(","), "inn", F.lit(","), tail)
    files = e.select(F.concat(F.lower("subindustry"), F.lit(".csv")).alias("source_file"), "row_no", F.posexplode(F.split(line, "\n")).alias("i", "line"))
    lines = files.select("source_file", F.floor(F.col("row_no") / 4096).alias("block"), F.struct("row_no", "i").alias("_id"), "line")
    return ingest.number_lines(lines, "source_file").select("source_file", "line_no", "line")


@query(f"with {ENTITIES} select lower(subindustry) || '.csv' as source_file, count(*) + count(*) filter (row_no % 4 = 1) as n_lines, (count(*) + count(*) filter (row_no % 4 = 1))::bigint as last_line from e group by 1")
def raw_line_scan(spark, sf_dir):
    return _raw_lines(spark, sf_dir).groupBy("source_file").agg(F.count(F.lit(1)).alias("n_lines"), F.max("line_no").alias("last_line"))


@query(f"with {ENTITIES} select distinct lower(subindustry) || '.csv' as source_file, ',' as delimiter from e")
def delimiter_choice(spark, sf_dir):
    return ingest.best_delimiter(ingest.score_delimiters(_raw_lines(spark, sf_dir)))


@query(f"with {ENTITIES} select lower(subindustry) || '.csv' as source_file, count(*) as n_records, count(*) filter (row_no % 4 = 1) as n_two_lines from e group by 1")
def record_assemble(spark, sf_dir):
    r = ingest.assemble_records(_raw_lines(spark, sf_dir))
    return r.groupBy("source_file").agg(F.count(F.lit(1)).alias("n_records"), F.count_if(F.col("raw_line").contains("\n")).alias("n_two_lines"))


@query(f"""with {ENTITIES} select inn as "INN", sector as "Sector", case row_no % 4 when 1 then 'Line' || chr(10) || 'Break, ' || official_name when 2 then 'Firm,' || official_name else official_name end as "CompanyNameOfficial",
    case row_no % 4 when 2 then 'some,text' when 3 then null else 'text' end as "Description", case row_no % 4 when 3 then null else 'www.x.ru' end as "URL", case row_no % 4 when 2 then 'src,more' when 3 then null else 'src' end as "Source",
    case when row_no % 4 in (2, 3) then 'repaired_needs_review' else 'exact' end as parse_status from e""")
def record_repair(spark, sf_dir):
    r = ingest.repair_records(ingest.assemble_records(_raw_lines(spark, sf_dir)))
    return r.select("INN", "Sector", "CompanyNameOfficial", "Description", "URL", "Source", "parse_status")


@query(f"with {ENTITIES} select lower(subindustry) || '.csv' as source_file, count(*) as total, count(*) filter (row_no % 4 in (0, 1)) as exact, 0::bigint as repaired, count(*) filter (row_no % 4 in (2, 3)) as repaired_needs_review from e group by 1")
def ingest_audit(spark, sf_dir):
    return ingest.ingest_audit(ingest.repair_records(ingest.assemble_records(_raw_lines(spark, sf_dir))))


@query("""with x as (select o_custkey, max(o_orderdate::date) as d, arg_max(o_totalprice::decimal(18, 2), (o_orderdate, o_orderkey))::double as v, min(year(o_orderdate))::int as y from orders group by 1)
    select lpad(o_custkey::varchar, 10, '0') as inn, 'C' || o_custkey as name, y as founded_year, v as revenue_rub, year(d)::int as revenue_year, '62.01' as okved_code, 'ok' as status from x""")
def registry_reports(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    line = F.format_string('<FinPeriod PeriodName="%s" DateEnd="%s"><StringList><String Code="2110" Name="x" Value="%s"/><String Code="2400" Name="y" Value="1"/></StringList></FinPeriod>', F.lpad(F.col("o_orderkey").cast("string"), 12, "0"), F.col("o_orderdate").cast("date").cast("string"), F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
    body = o.groupBy("o_custkey").agg(F.array_join(F.collect_list(line), "").alias("fin"), F.min(F.year("o_orderdate")).alias("y"))
    xml = F.format_string('<Report><INN>%s</INN><ShortNameRus>C%s</ShortNameRus><DateFirstReg>%s-01-01</DateFirstReg><OKVED2List><OKVED Code="1" Name="a"/><OKVED IsMain="true" Code="62.01" Name="b"/></OKVED2List><Finance>%s</Finance></Report>', F.lpad(F.col("o_custkey").cast("string"), 10, "0"), F.col("o_custkey").cast("string"), F.col("y").cast("string"), "fin")
    parsed = body.select(F.from_xml(xml, registry.REPORT).alias("r"), F.lit("x.xml").alias("source_file")).select("r.*", "source_file")
    return registry.registry_reports(parsed).select("inn", "name", "founded_year", "revenue_rub", "revenue_year", "okved_code", "status")


@query("""select nullif(case when c_custkey % 5 <> 0 then lpad(c_custkey::varchar, 10, '0') end, '') as inn, c_custkey % 100 as employees, (c_custkey % 40 + 0.5) * 1e6 as revenue_rub, 'million_rub' as revenue_unit, case when c_custkey % 5 = 0 then 'review' else 'ok' end as status from customer""")
def registry_table(spark, sf_dir):
    k = F.col("c_custkey")
    t = table(spark, sf_dir, "customer").select(F.when(k % 5 != 0, F.lpad(k.cast("string"), 10, "0")).alias("ИНН компании"), F.concat((k % 100).cast("string"), F.lit(" чел")).alias("Численность"), F.concat((k % 40).cast("string"), F.lit(",5")).alias("Выручка, млн руб"))
    return registry.registry_table(t, "t.csv").select("inn", "employees", "revenue_rub", "revenue_unit", "status")


@query("""select lpad(c_custkey::varchar, 10, '7') as inn, 1990 + (c_custkey % 30)::int as founded_year, (c_custkey % 9 + 1) * 100 as employees, ((c_custkey % 7 + 1) + 0.5) * 1e6 as revenue_rub from customer""")
def registry_text(spark, sf_dir):
    k = F.col("c_custkey")
    body = F.concat(F.lit("Дата регистрации - "), (1990 + k % 30).cast("string"), F.lit(". Численность - "), ((k % 9 + 1) * 100).cast("string"), F.lit(" чел. Выручка "), (k % 7 + 1).cast("string"), F.lit(",5 млн руб."))
    t = table(spark, sf_dir, "customer").select(F.concat(F.lit("report_"), F.lpad(k.cast("string"), 10, "7"), F.lit(".txt")).alias("path"), body.alias("text"))
    return registry.registry_text(t, "path", "text").select("inn", "founded_year", "employees", "revenue_rub")


@query("select doc_id, len(list_distinct(list_filter(regexp_extract_all(text, '[0-9]+'), lambda x: length(x) in (10, 12))))::bigint as n_ids from documents")
def ids_in_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(ids_in_text("text")).cast("long").alias("n_ids"))


@query("select event_type, count(*) as n_rows, 0::bigint as n_files from (select * from events where value is not null and event_id % 10 <> 0) group by 1")
def stream_ingest(spark, sf_dir):
    base = work_dir(spark, "stream")
    e = table(spark, sf_dir, "events")
    e.repartition(4).write.parquet(f"{base}/incoming")
    e.limit(0).write.parquet(f"{base}/retry")
    stream = flows.file_stream(spark, [f"{base}/incoming", f"{base}/retry"], e.schema)
    flows.stream_ingest(stream, f"{base}/out", f"{base}/checkpoint", bad="value is null or event_id % 10 = 0", audit=f"{base}/audit").awaitTermination()
    return spark.read.parquet(f"{base}/out/rows").groupBy("event_type").agg(F.count(F.lit(1)).alias("n_rows"), F.lit(0).cast("long").alias("n_files"))


@query("select user_id, event_type from events group by 1, 2")
def stream_dedup(spark, sf_dir):
    base = work_dir(spark, "dedup")
    e = table(spark, sf_dir, "events")
    e.repartition(4).write.parquet(f"{base}/incoming")
    stream = spark.readStream.schema(e.schema).parquet(f"{base}/incoming").withColumn("ts", F.col("ts").cast("timestamp"))
    done = flows.stream_dedup(stream, ["user_id", "event_type"], "ts", "4000 days")
    done.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out").select("user_id", "event_type")
