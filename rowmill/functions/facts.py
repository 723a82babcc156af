"""Facts in free text, and how descriptions word them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .money import trim_zeros
from .text import blank, c, has_any, let

# Patterns of stated facts.
EMPLOYEES = [
    r"(?iuU)(?:численность|среднесписочная численность|штат|сотрудников|работников)[^0-9]{0,80}(?:около|примерно|более|свыше)?\s*(\d+[\d\s,.]*)\s*(тыс\.?|тысяч)?",
    r"(?iuU)(?:около|примерно|более|свыше)\s*(\d+[\d\s,.]*)\s*(тыс\.?|тысяч)?\s*(?:человек|сотрудник|сотрудников|работник|работников)",
]
REVENUE = [
    r"(?iuU)(?:выручка|доходы|годовая выручка|бюджет)[^0-9]{0,80}(?:около|примерно|более|свыше)?\s*(\d+[\d\s,.]*)\s*(млрд|млн|тыс)?",
    r"(?iuU)(?:около|примерно|более|свыше)\s*(\d+[\d\s,.]*)\s*(млрд|млн)\s*руб",
]
YEAR = r"(?U)\b((?:19|20)\d{2})\b"
BUDGET_MARKS = ["ГБУ", "ГКУ", "МКУ", "ГУП", "ФГУП", "МУП", "КАЗЕН", "БЮДЖЕТ"]


def _first(cols, patterns, make) -> Column:
    one = lambda x, p: let(F.regexp_extract(c(x), p, 1), lambda n: F.when(n != "", let(F.regexp_extract(c(x), p, 2), lambda unit: make(n, unit))))
    return F.coalesce(*[one(x, p) for x in cols for p in patterns])


def _value(text: Column) -> Column:
    return F.regexp_replace(F.translate(F.regexp_replace(text, r"(?U)\s", ""), ",", "."), r"\.+$", "").try_cast("double")


def text_year(*cols) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(F.coalesce(c(x), F.lit("")), YEAR, 1), F.lit("")) for x in cols])


def text_employees(*cols) -> Column:
    """Stated number of employees."""
    return _first(cols, EMPLOYEES, lambda n, unit: (_value(n) * F.when(unit != "", 1000).otherwise(1)).cast("long"))


def text_revenue(*cols) -> Column:
    """Stated yearly revenue or budget, in billions."""
    return _first(cols, REVENUE, lambda n, unit: _value(n) / F.when(F.lower(unit) == "млн", 1e3).when(F.lower(unit) == "тыс", 1e6).otherwise(1.0))


def text_city(address, region=None) -> Column:
    """The part of an address that names a town, else the first that names no region, else the region."""

    def named(parts: Column) -> Column:
        town = F.get(F.filter(parts, lambda p: p.rlike(r"(?iuU)\bг\.?\s+")), F.lit(0))
        other = F.get(F.filter(parts, lambda p: ~F.lower(p).rlike("область|респ|край") & (F.length(p) > 2)), F.lit(0))
        return F.coalesce(F.trim(F.regexp_replace(town, r"(?iuU)^г\.?\s*", "")), other)

    out = let(F.filter(F.transform(F.split(F.coalesce(c(address), F.lit("")), ","), lambda p: F.trim(p)), lambda p: p != ""), named)
    return out if region is None else F.coalesce(out, blank(region))


def _clean(x) -> Column:
    digits = lambda low: F.btrim(F.translate(F.regexp_replace(low, "[^0-9,.]", ""), ",", "."), F.lit("."))
    told = lambda low: F.when(low.contains("неизвест") | low.contains("нет данных"), F.lit(None)).otherwise(digits(low))
    return let(F.lower(F.coalesce(blank(x), F.lit(""))), told).try_cast("double")


def fmt_employees(x) -> Column:
    return let(_clean(x), lambda n: F.when(n >= 1000, F.concat(F.translate(trim_zeros(F.format_string("%.1f", F.bround(n / 1000, 1))), ".", ","), F.lit(" тыс."))).otherwise(F.bround(n, 0).cast("long").cast("string")))


def fmt_revenue(x) -> Column:
    """Billions with one decimal; more than a million counts as roubles."""
    words = lambda n: F.concat(F.translate(F.replace(F.format_string("%.1f", F.when(n > 1e6, n / 1e9).otherwise(n)), F.lit(".0"), F.lit("")), ".", ","), F.lit(" млрд руб."))
    return let(_clean(x), lambda n: F.when(n.isNotNull(), words(n)))


def is_budget_org(*names) -> Column:
    return has_any(F.upper(F.concat_ws(" ", *[F.coalesce(c(x), F.lit("")) for x in names])), BUDGET_MARKS)


def tail(employees, revenue, employees_year, revenue_year, budget) -> Column:
    """The closing sentence with both figures. Its parts."""
    of = lambda y: F.when(blank(y).isNotNull(), F.concat(F.lit(" по данным за "), blank(y), F.lit(" год"))).otherwise("")
    kind = F.when(c(budget), "годовой бюджет").otherwise("годовая выручка")
    return F.concat(F.lit("Численность работников — около "), c(employees), F.lit(" человек"), of(employees_year), F.lit(", "), kind, F.lit(" — около "), c(revenue), of(revenue_year), F.lit("."))


# What a branch's key function is said to be, by marks in the branch (or industry) name, in order.
KEY_FACTS = [
    (("sub", "водоснаб"), "Ключевая функция компании связана с эксплуатацией систем водоснабжения и водоотведения."),
    (("sub", "водоотвед"), "Ключевая функция компании связана с эксплуатацией систем водоснабжения и водоотведения."),
    (("sub", "тепл"), "Ключевая функция компании связана с эксплуатацией тепловой инфраструктуры и теплоснабжением потребителей."),
    (("sub", "элект"), "Ключевая функция компании связана с эксплуатацией энергетической инфраструктуры и обеспечением потребителей ресурсами."),
    (("ind", "энерг"), "Ключевая функция компании связана с эксплуатацией энергетической инфраструктуры и обеспечением потребителей ресурсами."),
    (("sub", "транспорт"), "Ключевая функция компании связана с организацией перевозок и эксплуатацией транспортной инфраструктуры."),
    (("sub", "перевоз"), "Ключевая функция компании связана с организацией перевозок и эксплуатацией транспортной инфраструктуры."),
    (("sub", "отход"), "Ключевая функция компании связана с обращением с отходами и эксплуатацией коммунальной инфраструктуры."),
]


def key_fact(industry, subindustry) -> Column:

    def told(low: Column) -> Column:
        out = F.when(low["sub"] != "", F.concat(F.lit("Ключевая функция компании связана с направлением «"), low["sub"], F.lit("»."))).otherwise("Ключевая функция компании связана с обслуживанием профильной инфраструктуры.")
        for (where, mark), text in reversed(KEY_FACTS):
            out = F.when(low[where].contains(mark), text).otherwise(out)
        return out

    low = lambda x: F.lower(F.coalesce(blank(x), F.lit("")))
    return let(F.struct(low(subindustry).alias("sub"), low(industry).alias("ind")), told)
