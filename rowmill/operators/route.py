"""Match entities to registry facts and route every row to include, exclude or review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import ACTIVE_STATUSES
from ..functions.ids import match_key
from ..functions.money import to_double
from .rows import keep_first, truthy

#: Registry columns that take the place of the entity's own.
FACTS = ["employees", "employees_year", "employees_source", "revenue", "revenue_rub", "revenue_year", "revenue_source", "budget", "budget_year", "budget_source", "founded_year"]


def is_active(x) -> Column:
    return F.coalesce(F.upper(F.trim(F.col(x).cast("string"))).isin(ACTIVE_STATUSES), F.lit(False))


def status_split(df: DataFrame, status: str = "status", keep: str = "all") -> tuple[DataFrame, DataFrame]:
    """(active, inactive), or active alone and nothing."""
    df = df.withColumn("is_active", is_active(status))
    active, rest = df.where("is_active"), df.where("not is_active")
    return active, rest if keep == "all" else rest.limit(0)


def active_only(df: DataFrame, flag: str = "is_active") -> DataFrame:
    return df.where(truthy(flag))


def active_dropped(df: DataFrame, flag: str = "is_active") -> DataFrame:
    """One row: how many rows the active filter sees, keeps and drops."""
    on = truthy(flag)
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(on).alias("n_active"), F.count_if(~on).alias("n_dropped"))


def match_registry(entities: DataFrame, registry: DataFrame, entity_id: str = "inn", registry_id: str = "inn", order=(), as_of=None, prefix: str = "reg_") -> DataFrame:
    """Each entity with its registry record, if there is one.

    The registry keeps its first row of each key, so no entity is multiplied. Where both have a fact the registry's counts;
    its other columns that clash get the prefix. Rows without digits in the id have a null key, which never matches and
    which Spark filters out of the build side.
    """
    facts = keep_first(registry.withColumn("_key", match_key(registry_id)).where("_key is not null"), ["_key"], list(order) or [registry_id]).drop(registry_id)
    clash = {x: (f"_{x}" if x in FACTS else f"{prefix}{x}") for x in facts.columns if x in entities.columns}
    facts = facts.withColumnsRenamed(clash).withColumn("_hit", F.lit(True))
    out = entities.withColumn("_key", match_key(entity_id)).join(facts, "_key", "left")
    out = out.withColumns({x: F.coalesce(F.col(f"_{x}"), F.col(x)) for x in clash if x in FACTS}).drop(*[f"_{x}" for x in clash if x in FACTS])
    out = out.withColumn("matched", F.coalesce("_hit", F.lit(False))).drop("_hit", "_key")
    out = out.withColumn("match_status", F.when(F.col("matched"), "matched").otherwise("unmatched"))
    return out.withColumn("matched_at", F.lit(as_of).cast("timestamp")) if as_of is not None else out


def size_route(df: DataFrame, min_employees: float, min_revenue: float, employees: str = "employees", revenue: str = "revenue_rub") -> DataFrame:
    """df with `status` and `reason`. Reasons name the rule, whatever the thresholds."""
    e, r = to_double(employees), to_double(revenue)
    say = lambda status, reason: F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"))
    route = (
        F.when(~F.col("matched"), say("review", "unmatched"))
        .when(e >= min_employees, say("include", "employees_at_least_min"))
        .when(r >= min_revenue, say("include", "revenue_at_least_min"))
        .when(e.isNull() & r.isNull(), say("review", "missing_employees_and_revenue"))
        .when(r.isNull(), say("review", "employees_below_and_missing_revenue"))
        .when(e.isNull(), say("review", "missing_employees_and_revenue_below"))
        .otherwise(say("exclude", "employees_and_revenue_below"))
    )
    return df.withColumn("_route", route).withColumns({"status": F.col("_route.status"), "reason": F.col("_route.reason")}).drop("_route")


def split_routes(df: DataFrame) -> dict[str, DataFrame]:
    """Filtered views; the two sub-routes of review overlap by design."""
    review = df.where("status = 'review'")
    return {"include": df.where("status = 'include'"), "exclude": df.where("status = 'exclude'"), "review": review, "unmatched": review.where("reason = 'unmatched'"), "missing_facts": review.where("reason like '%missing%'")}


def annotate_exclusion(df: DataFrame, source: str, condition: str, as_of=None, told=None) -> DataFrame:
    """df with what an excluded row is told: flag, reason as code and text (`told` maps codes to texts, else the code), source, and when it may come back."""
    out, text = F.col("status") == "exclude", F.col("reason")
    for code, words in (told or {}).items():
        text = F.when(F.col("reason") == code, words).otherwise(text)
    df = df.withColumns({"excluded": out, "exclusion_code": F.when(out, F.col("reason")), "exclusion_text": F.when(out, text), "exclusion_source": F.when(out, source), "can_be_restored": F.when(out, True), "restore_condition": F.when(out, condition)})
    return df.withColumn("excluded_at", F.when(out, F.lit(as_of).cast("timestamp"))) if as_of is not None else df


def annotate_inactive(df: DataFrame, source: str, as_of=None) -> DataFrame:
    """Rows that a status check set aside, told as excluded for being inactive."""
    set_aside = df.withColumns({"status": F.lit("exclude"), "reason": F.lit("inactive")})
    return annotate_exclusion(set_aside, source, "the status becomes active again", as_of, {"inactive": "the status is not active"})


def route_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("status", "reason").agg(F.count(F.lit(1)).alias("n_rows"))


def match_summary(df: DataFrame) -> DataFrame:
    one = lambda name, cond: F.count_if(F.expr(cond)).alias(name)
    return df.agg(F.count(F.lit(1)).alias("n_rows"), one("matched_rows", "matched"), one("included_rows", "status = 'include'"), one("excluded_rows", "status = 'exclude'"), one("review_rows", "status = 'review'"))


def routing_report(df: DataFrame, identity) -> DataFrame:
    """What a reader of the routing gets: who a row is, its facts, where it went and, if it was excluded, why in words."""
    out = F.col("status") == "exclude"
    told = F.when(out, F.concat(F.lit("excluded by thresholds: "), F.col("reason")))
    return df.select(*identity, "employees", "revenue_rub", "status", "reason", out.alias("excluded"), told.alias("exclusion_text"))
