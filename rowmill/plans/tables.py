"""The given tables in the roles of the entity pipeline, for the registered queries, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import work_dir

#: Order counts and sums stand in for employees and revenue; these are the thresholds the queries route by.
MIN_EMPLOYEES, MIN_REVENUE = 12, 1_500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as entity rows, classified by region, nation and segment. The two dimensions have 25 and 5 rows."""
    nation = F.broadcast(table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")))
    c = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select(F.col("c_custkey").alias("row_no"), F.lpad(F.col("c_custkey").cast("string"), 10, "0").alias("inn"), F.col("r_name").alias("sector"), F.col("n_name").alias("industry"), F.col("c_mktsegment").alias("subindustry"), F.col("n_name").alias("region"), F.col("c_name").alias("official_name"), "c_acctbal")


ENTITIES = """e as (select c_custkey as row_no, lpad(c_custkey::varchar, 10, '0') as inn, r_name as sector, n_name as industry, c_mktsegment as subindustry, n_name as region, c_name as official_name, c_acctbal
    from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by customer as registry facts; every seventh id has no employees. Sums are decimal, so their order does not matter."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("revenue_rub"), F.max(F.year("o_orderdate")).alias("revenue_year"))
    return o.select(F.lpad(F.col("o_custkey").cast("string"), 10, "0").alias("inn"), F.when(F.col("o_custkey") % 7 != 0, F.col("n")).alias("employees"), "revenue_rub", "revenue_year")


FACTS = """g as (select lpad(o_custkey::varchar, 10, '0') as inn, case when o_custkey % 7 <> 0 then count(*) end as employees, sum(o_totalprice::decimal(18, 2))::double as revenue_rub, max(year(o_orderdate))::int as revenue_year
    from orders group by o_custkey)"""

ROUTED = f"""{ENTITIES}, {FACTS}, r as (select e.*, g.employees, g.revenue_rub, g.revenue_year, g.inn is not null as matched from e left join g on e.inn = g.inn),
    s as (select *, case when not matched then 'review' when employees >= {MIN_EMPLOYEES} or revenue_rub >= {MIN_REVENUE} then 'include' when employees is null or revenue_rub is null then 'review' else 'exclude' end as status,
      case when not matched then 'unmatched' when employees >= {MIN_EMPLOYEES} then 'employees_at_least_min' when revenue_rub >= {MIN_REVENUE} then 'revenue_at_least_min' when employees is null and revenue_rub is null then 'missing_employees_and_revenue'
      when revenue_rub is null then 'employees_below_and_missing_revenue' when employees is null then 'missing_employees_and_revenue_below' else 'employees_and_revenue_below' end as reason from r)"""
