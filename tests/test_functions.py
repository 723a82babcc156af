"""Known values of column functions and operators, on rows typed here."""

import pytest
from pyspark.sql import functions as F

from rowmill.functions import facts, ids, money, names, paths, text
from rowmill.operators import describe, regions, reports, rows, route
from rowmill.plans import suite
from rowmill.sources import ingest


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()[0]


SOURCE = [
    ("0000000001", "Infrastructure", "Utilities", "Water supply", "f573a542d2e42e05e017"),
    ("0000000002", "Energy", "Electric power", "Distribution", "968bfe0a214345861951"),
    ("0000000003", "Transport", "Logistics", "Terminal services", "51a497779306820ca96b"),
    ("0000000004", "Infrastructure", "Municipal services", "Waste management", "68f217bf1bc69482c303"),
    ("0000000005", "Transport", "Passenger transport", "Urban transport", "8157dc61a4788a9ef167"),
]


def test_record_ids(spark):
    df = spark.createDataFrame([(i + 2, *r) for i, r in enumerate(SOURCE)], "n int, inn string, a string, b string, c string, want string")
    got = df.select(ids.record_id(F.lit("sample_source.csv"), "n", "inn", "a", "b", "c").alias("x"), "want").collect()
    assert all(r.x == r.want for r in got)


def test_size_routes(spark):
    entities = spark.createDataFrame([(f"000000000{i}", None) for i in range(1, 8)], "inn string, employees string")
    registry = spark.createDataFrame([("0000000001", "145", "750000000"), ("2", "45", "25000000"), ("0000000003", "45", "500000"), ("0000000004", None, "500000"), ("0000000006", None, None), ("0000000007", "45", None), (None, "900", "1")], "inn string, employees string, revenue_rub string")
    got = route.size_route(route.match_registry(entities, registry), 100, 1_000_000)
    assert {r.inn[-1]: (r.status, r.reason) for r in got.collect()} == {
        "1": ("include", "employees_at_least_min"), "2": ("include", "revenue_at_least_min"), "3": ("exclude", "employees_and_revenue_below"), "4": ("review", "missing_employees_and_revenue_below"),
        "5": ("review", "unmatched"), "6": ("review", "missing_employees_and_revenue"), "7": ("review", "employees_below_and_missing_revenue"),
    }


def test_blank_ids_never_match(spark):
    blank = spark.createDataFrame([("",), (None,), ("нет",)], "inn string")
    assert route.match_registry(blank, blank.withColumn("employees", F.lit("5"))).where("matched").count() == 0


@pytest.mark.parametrize("value,want", [("1.234,5", 1234.5), ("1,234.5", 1234.5), ("12 000", 12000.0), ("-", None), ("", None), (None, None), ("1.2.3", None)])
def test_money(spark, value, want):
    assert one(spark, money.money("v"), v=value) == want


@pytest.mark.parametrize("value,hint,want", [("1,5", "млрд", (1.5e9, "billion_rub")), ("2 млн", "тыс", (2e6, "million_rub")), ("5", "", (5e9, "billion_rub_inferred")), ("5000000", "", (5e6, "rub_inferred")), ("x", "руб", (None, "rub"))])
def test_money_units(spark, value, hint, want):
    assert tuple(one(spark, money.money_to_unit("v", "h"), v=value, h=hint)) == want


def test_names(spark):
    assert one(spark, names.official_name("v"), v='Общество с ограниченной ответственностью "северный ветер"') == "ООО «Северный Ветер»"
    assert one(spark, names.short_name("v"), v="ПАО «НЛМК»") == "НЛМК, ПАО"
    assert one(spark, names.official_name("v"), v=" ") is None


def test_paths(spark):
    assert one(spark, paths.safe_segment("v", ext=".csv"), v="Вода/Щука: №1") == "Voda_Schuka_1.csv"
    assert one(spark, paths.safe_segment("v"), v="con") == "_con"
    assert one(spark, paths.safe_segment("v"), v=None) == "__MISSING__"


def test_sentences(spark):
    assert one(spark, text.sentences("v"), v="Около 5 тыс. человек, 2 млрд. руб. в год. Да! г. Тверь?") == ["Около 5 тыс. человек, 2 млрд. руб. в год.", "Да!", "г. Тверь?"]
    assert one(spark, text.sentences("v"), v=None) == []


def test_years_in_names(spark):
    """A number inside a quoted name is no year; one outside it is, whatever the names hold."""
    lacks = lambda v: "missing_year" in one(spark, text.text_issues("v"), v=v)
    assert lacks("ООО «Фирма 1950» работает в Городок0.") and lacks("АО «А 1990» и АО «Б 2001» работают.")
    assert not lacks("ООО «Фирма 1950» работает с 2001 года.") and not lacks("С 2001 года работает ООО «Фирма 7».") and not lacks("Открыто «в 1950")


def test_sentences_after_abbreviations(spark):
    assert one(spark, text.sentences("v"), v=" Тыс.  и аг. Г. Тверь.\n1г. вн. Да.. Нет") == ["Тыс. и аг.", "Г. Тверь.", "1г. вн. Да..", "Нет"]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_facts_are_found_once(spark):
    """A description and the facts it lacks rest on one search of the text each, and a choice scores each text once."""
    df = spark.createDataFrame([("ООО А", "Штат 5 человек", "x")], "CompanyNameOfficial string, Description string, region string")
    d = describe.rule_description(df)
    assert _plan(d).count("среднесписочная") <= 2 and _plan(d).count("годовая выручка|бюджет") <= 2
    assert _plan(describe.pick_text(d, "description", "region")).count("sentence_count_") == 2


def test_forms_are_compared_with_one_text(spark):
    """The name is put in upper case once, not for each legal form."""
    assert "StartsWith(trim(" not in _plan(spark.range(1).select(names.legal_form(F.uuid())))


@pytest.mark.parametrize("query", ["rule_description", "description_pick", "official_names", "official_names_of_parts"])
def test_short_rows_are_spread(spark, sf, query):
    """Costly expressions on short rows do not stay in the one task that reads a small file."""
    assert "RepartitionByExpression" in _plan(suite.QUERIES[query](spark, sf))


def test_spread_keeps_rows(spark):
    df = spark.range(500).select(F.lit(7).alias("k"), F.create_map(F.lit("a"), "id").alias("m")).coalesce(1)
    got = rows.spread(df)
    assert got.columns == ["k", "m"] and sorted(r.m["a"] for r in got.collect()) == list(range(500))


def test_flat_values(spark):
    assert one(spark, text.flat_clean("v"), v='ООО "X", 0,75;\n|') == "ООО 'X' 0 75"
    assert one(spark, money.coord("v"), v="59.376100") == "59.3761"
    assert one(spark, money.coord("v"), v="abc") is None


def test_facts(spark):
    assert one(spark, facts.fmt_employees("v"), v="1234") == "1,2 тыс."
    assert one(spark, facts.fmt_revenue("v"), v="750000000") == "0,8 млрд руб."


def test_regions(spark):
    dim, alias = regions.load_regions(spark)
    df = spark.createDataFrame([("7801",), ("1001",), (None,)], "INN string").withColumn("t", F.when(F.col("INN") == "7801", "РЕСП БУРЯТИЯ, г Улан-Удэ"))
    got = {r.INN: (r.region, r.district) for r in regions.region_cascade(df, dim, alias, "t").collect()}
    assert got == {"7801": ("Республика Бурятия", "ДФО"), "1001": ("Республика Карелия", "СЗФО"), None: (None, None)}


def test_repair(spark):
    lines = ["a,b,c,s,Firm, Ltd,0000000001,r,r,01,x, y,www.a.ru,src", "s,Firm,0000000002,r,r", "only,three,fields", 'a,b,c,s,"q, ""z""",0000000003,r,r,01,d,u,src']
    df = spark.createDataFrame([("f.csv", i + 1, i + 1, x) for i, x in enumerate(lines)], "source_file string, record_no long, physical_line long, raw_line string")
    got = {r.source_row_no: r for r in ingest.repair_records(df).collect()}
    assert (got[1].CompanyNameOfficial, got[1].Description, got[1].URL, got[1].Source) == ("Firm,Ltd", "x,y", "www.a.ru", "src")
    assert (got[2].Sector, got[2].CompanyName, got[2].CompanyNameOfficial, got[2].INN) == (None, "s", "Firm", "0000000002")
    assert got[3].parse_reason.startswith("padded") and got[4].CompanyNameOfficial == 'q, "z"' and got[4].parse_status == "exact"


def test_assembly_is_bounded(spark):
    df = spark.createDataFrame([("f", i, '"open' if i == 1 else "x") for i in range(1, 25)], "source_file string, line_no long, line string")
    got = ingest.assemble_records(df).orderBy("physical_line").collect()
    assert got[0].raw_line.count("\n") == 9 and got[1].physical_line == 11


def test_keep_first_keeps_one(spark):
    df = spark.createDataFrame([(1, "a", 3), (1, "a", 2), (None, "a", 1), (None, "a", 0)], "inn string, g string, n int")
    kept, dropped = rows.dedup_composite(df, scope=(), order=("n",), inn="inn", region="g", sector="g", industry="g", subindustry="g")
    assert sorted(r.n for r in kept.collect()) == [0, 1, 2] and [r.n for r in dropped.collect()] == [3]


def test_gate_fails(spark):
    layer = spark.createDataFrame([("1", "5", "5")], "inn string, employees string, revenue_rub string")
    got = {r.check_name: r.status for r in reports.quality_gate({"active": layer, "routed": layer, "included": layer, "excluded": layer.limit(0), "review": layer.limit(0)}, 2, 100, 1e6).collect()}
    assert got["included_thresholds"] == got["export_row_count"] == got["overall"] == "FAIL" and got["partition_sum"] == "PASS"
