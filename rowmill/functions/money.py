"""Numbers and money written as text. Null where nothing can be read; NaN never comes out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import c, let


def _finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) < 1.7e308), x)


def to_double(x) -> Column:
    """A number with spaces in it and a comma or point for decimals."""
    t = F.replace(F.regexp_replace(c(x).cast("string"), " ", ""), F.lit(","), F.lit("."))
    return _finite(F.when(t.rlike(r"^[+-]?[0-9.]+([eE][+-]?[0-9]+)?$"), t.try_cast("double")))


def money(x) -> Column:
    """A sum: of comma and point, the later one is the decimal sign."""

    def plain(t: Column) -> Column:
        comma, point = F.instr(F.reverse(t), ","), F.instr(F.reverse(t), ".")
        later = F.when((comma > 0) & (point > 0) & (comma > point), F.replace(t, F.lit(","), F.lit(""))).when((comma > 0) & (point > 0), F.translate(F.replace(t, F.lit("."), F.lit("")), ",", "."))
        return _finite(F.coalesce(later, F.translate(t, ",", ".")).try_cast("double"))

    return let(F.regexp_replace(c(x).cast("string"), r"[^0-9,.\-]", ""), plain)


#: Marks of a unit in a header or value, in order of precedence, and what they multiply by.
UNITS = {"billion_rub": (("млрд", "миллиард"), 1e9), "million_rub": (("млн", "миллион"), 1e6), "thousand_rub": (("тыс", "тысяч"), 1e3), "rub": (("руб", "rur", "rub"), 1.0)}


def money_unit(x) -> Column:
    marks = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(u).alias("u")) for u, (ms, _) in UNITS.items() for m in ms])
    return let(F.lower(F.coalesce(c(x).cast("string"), F.lit(""))), lambda low: F.coalesce(F.get(F.filter(marks, lambda k: low.contains(k["m"])), F.lit(0))["u"], F.lit("unknown")))


def money_to_unit(x, hint=None) -> Column:
    """struct<rub, unit>: by the unit in the value, else in the header, else by size: up to a million counts as billions."""
    factors = F.create_map(*[y for u, (_, f) in UNITS.items() for y in (F.lit(u), F.lit(f))])
    unit = let(money_unit(x), lambda own: F.when(own != "unknown", own).otherwise(money_unit(hint))) if hint is not None else money_unit(x)
    pair = lambda rub, u: F.struct(rub.alias("rub"), u.alias("unit"))

    def sized(s: Column) -> Column:
        value, u = s["v"], s["u"]
        guess = F.when(value > 1e6, pair(value, F.lit("rub_inferred"))).otherwise(pair(value * 1e9, F.lit("billion_rub_inferred")))
        return F.when(value.isNull(), pair(F.lit(None).cast("double"), u)).when(u != "unknown", pair(value * F.element_at(factors, u), u)).otherwise(guess)

    return let(F.struct(money(x).alias("v"), unit.alias("u")), sized)


def trim_zeros(x) -> Column:
    return F.regexp_replace(F.regexp_replace(x, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def to_billions(x) -> Column:
    """Billions with up to three decimals."""
    return F.when(c(x).isNotNull(), trim_zeros(F.format_string("%.3f", c(x) / 1e9)))


def raw_rub(x) -> Column:
    """Whole roubles, halves to even."""
    return F.bround(c(x), 0).cast("decimal(30,0)").cast("string")


def revenue_issue(x) -> Column:
    """What looks wrong with a revenue in roubles; empty if nothing does."""
    return let(money(x), lambda v: F.when(v.isNull(), "missing_revenue").when(v < 0, "negative_revenue").when((v > 0) & (v < 1e6), "revenue_below_1m").when(v > 1e13, "revenue_extremely_high_check_unit").otherwise(""))


def number(x) -> Column:
    """A quantity with a magnitude word, scaled."""
    low = F.lower(c(x).cast("string"))
    t = F.regexp_replace(F.translate(F.regexp_replace(low, "[^0-9,.-]", ""), ",", "."), r"^[.-]+|[.-]+$", "")
    factor = F.when(low.contains("млрд"), 1e9).when(low.contains("млн"), 1e6).when(low.contains("тыс"), 1e3).otherwise(1.0)
    unknown = low.contains("неизвест") | low.contains("нет данных")
    return _finite(F.when(~unknown, t.try_cast("double") * factor))


def coord(x) -> Column:
    """A coordinate with up to six decimals as text, null if it cannot be read."""
    v = to_double(F.trim(c(x).cast("string")))
    return F.when(v.isNotNull(), trim_zeros(F.format_string("%.6f", v)))
