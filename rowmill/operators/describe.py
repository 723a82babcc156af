"""Rule-based descriptions and the choice between two texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import FORBIDDEN_WORDS
from ..functions.facts import fmt_employees, fmt_revenue, is_budget_org, key_fact, tail, text_city, text_employees, text_revenue, text_year
from ..functions.names import official_name
from ..functions.text import blank, clean_text, drop_forbidden, first_nonblank, let, text_issues
from .reports import condition_counts


def rule_description(df: DataFrame, region: str = "region") -> DataFrame:
    """df with `description` (four sentences) and `missing`, the facts it lacks. Needs the source columns; facts may be null."""
    cols = [x for x in ("Description", "Source") if x in df.columns]
    have = lambda x: F.col(x) if x in df.columns else F.lit(None).cast("string")
    name = official_name("CompanyNameOfficial", have("CompanyName"))
    year = F.coalesce(blank(have("founded_year")), text_year(*cols))
    city = text_city(have("address"), region)
    employees = fmt_employees(F.coalesce(blank(have("employees")), text_employees(*cols).cast("string")))
    revenue = fmt_revenue(F.coalesce(blank(have("revenue_rub")), text_revenue(*cols).cast("string")))
    begin = lambda told: F.btrim(F.get(F.split(told, r"(?<=[.!?])\s+"), F.lit(0)), F.lit(" ."))
    fit = lambda lead: F.when(lead != "", F.lower(F.substring(drop_forbidden(lead, FORBIDDEN_WORDS), 1, 220)))
    lead = let(clean_text(have("Description")), lambda told: F.when(F.length(told) > 40, let(begin(told), fit)))
    lower = lambda x: F.lower(blank(have(x)))
    # fixed values: the parts of sentences from here on
    activity = F.coalesce(
        lead,
        F.concat(F.lit("деятельностью в подотрасли "), lower("Subindustry")),
        F.concat(F.lit("деятельностью в отрасли "), lower("Industry")),
        F.concat(F.lit("деятельностью по ОКВЭД "), blank(have("okved"))),
        F.lit("профильной деятельностью, указанной в исходных данных"),
    )
    # columns of their own, so that each fact is looked for once: a struct of them would be taken apart and computed where it is read
    facts = {"company_name": name, "year": year, "city": city, "region": blank(region), "employees": employees, "revenue_or_budget": revenue, "activity": activity}
    at = {n: F.col(f"__rm_{n}") for n in facts}
    have_facts = df.withColumns({f"__rm_{n}": v for n, v in facts.items()})
    missing = F.array_compact(F.array(*[F.when(at[n].isNull(), F.lit(f"missing_{n}")) for n in facts if n != "activity"]))
    parts = F.struct(F.coalesce(at["company_name"], F.lit("Компания")).alias("name"), F.coalesce(at["city"], F.lit("указанном регионе")).alias("place"), at["year"].alias("year"), at["employees"].alias("employees"), at["revenue_or_budget"].alias("revenue"), at["activity"].alias("activity"))

    def told_as(p):
        since = F.coalesce(F.concat(F.lit(" с "), p["year"], F.lit(" года")), F.lit(""))
        first = F.concat(p["name"], F.lit(" работает"), since, F.lit(" в "), p["place"], F.lit(" и занимается "), p["activity"], F.lit("."))
        second = F.concat(F.lit("Компания обслуживает "), F.coalesce(at["region"], F.lit("указанный регион")), F.lit("; основная база связана с "), p["place"], F.lit("."))
        last = F.coalesce(tail(p["employees"], p["revenue"], F.substring(have("employees_year"), 1, 4), F.substring(have("revenue_year"), 1, 4), is_budget_org(p["name"], have("CompanyName"))), F.lit("Данные о численности работников и годовых финансовых показателях требуют уточнения."))
        return F.concat_ws(" ", first, second, key_fact(have("Industry"), have("Subindustry")), last)

    return have_facts.withColumns({"missing": missing, "description": let(parts, told_as)}).drop(*[f"__rm_{n}" for n in facts])


def pick_text(df: DataFrame, rules: str, other: str) -> DataFrame:
    """df with the text of higher quality in `text` and its origin; rules win ties and blanks."""
    score = lambda x: 100 - 12 * F.size(text_issues(x))
    use_rules = blank(other).isNull() | (score(rules) >= score(other))
    text = F.when(F.col("__rm_rules"), F.col(rules)).otherwise(F.col(other))
    return df.withColumn("__rm_rules", use_rules).withColumns({"text": text, "text_origin": F.when(F.col("__rm_rules"), "rules").otherwise("service")}).drop("__rm_rules")


def needs_review(df: DataFrame) -> DataFrame:
    return df.where("description_status <> 'ok'")


def quality_rows(df: DataFrame, ids=("record_id", "INN", "CompanyNameOfficial"), origin: str = "text_origin") -> DataFrame:
    """Of each description: whose it is, status, score, issues joined by `;`, and where the text came from."""
    return df.select(*ids, "description_status", "description_quality_score", F.array_join("description_issues", ";").alias("description_issues"), origin)


def description_summary(df: DataFrame) -> DataFrame:
    """Descriptions in all, fit ones, ones for review, and ones that rest on the rules alone."""
    return condition_counts(df, ok="description_status = 'ok'", for_review="description_status <> 'ok'", from_rules="text_origin = 'rules'")


def stale_text(primary: str, fallback: str, words=("неизвестн",)):
    """A text without disallowed words, else the fallback."""
    return F.coalesce(blank(drop_forbidden(primary, words)), first_nonblank(fallback))
