"""Company names: legal forms, title case, variants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import GENERIC_NAMES, LEGAL_FORM_PATTERN, LEGAL_FORMS, SHORT_FORMS, UPPER_WORDS
from .text import blank, c, let, squeeze

_FORM = f"(?iU){LEGAL_FORM_PATTERN}"
_QUOTED = '[«"]([^»"]+)[»"]'
_SHORT = rf"(?iU)\b({SHORT_FORMS})\b"


def _title_word(w: Column, upper) -> Column:
    keep = lambda up: up.isin(list(upper)) | w.rlike("(?iu)^[а-яёa-z]+-?[0-9]+$")
    first = F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))
    return let(F.upper(w), lambda up: F.when(keep(up), up).otherwise(first))


def title_name(x, upper=UPPER_WORDS) -> Column:
    """Title case by word and by part of a hyphenated word; listed acronyms and words that end in digits are upper case."""
    words = F.split(F.lower(F.coalesce(blank(x), F.lit(""))), r"(?U)(?<=[\s-])|(?=[\s-])")
    return F.array_join(F.transform(words, lambda w: F.when((F.length(w) < 2) & w.rlike(r"(?U)^[\s-]?$"), w).otherwise(_title_word(w, upper))), "")


def legal_form(x, forms=LEGAL_FORMS) -> Column:
    """struct<form, rest>: the legal form of a name, from its long text in front or a short one anywhere, and what is left."""
    table = F.array(*[F.struct(F.lit(long).alias("long"), F.lit(forms[long]).alias("short")) for long in sorted(forms, key=len, reverse=True)])
    pair = lambda form, rest: F.struct(form.alias("form"), rest.alias("rest"))

    def short(t: Column) -> Column:
        cut = lambda m: F.when(m == "", pair(F.lit(""), t)).otherwise(pair(squeeze(F.upper(m)), F.concat(F.left(t, F.position(m, t) - 1), F.substring(t, F.position(m, t) + F.length(m), F.length(t)))))
        return let(F.regexp_extract(t, _FORM, 1), cut)

    def form(t: Column) -> Column:
        named = let(squeeze(F.upper(t)), lambda upper: F.get(F.filter(table, lambda f: upper.startswith(f["long"])), F.lit(0)))
        return let(named, lambda f: F.when(f.isNotNull(), pair(f["short"], F.trim(F.substring(t, F.length(f["long"]) + 1, F.length(t))))).otherwise(short(t)))

    return let(F.coalesce(c(x), F.lit("")), form)


def official_name(x, fallback=None) -> Column:
    """`FORM «Name»` of a full name."""

    def whole(t: Column) -> Column:
        def made(form: Column) -> Column:
            bare = F.btrim(form["rest"], F.lit(" \t\r\n.,;:-«»\""))
            name = title_name(let(F.regexp_extract(t, _QUOTED, 1), lambda quoted: F.when(quoted != "", quoted).otherwise(bare)))
            return let(name, lambda n: F.when((form["form"] != "") & (n != ""), F.concat(form["form"], F.lit(" «"), n, F.lit("»"))).when(n != "", n).otherwise(title_name(F.btrim(t, F.lit('«»"')))))

        return F.when(t.isNotNull(), let(legal_form(t), made))

    given = blank(x) if fallback is None else F.coalesce(blank(x), blank(fallback))
    return let(F.regexp_replace(F.translate(given, "“”„", '"""'), r"(?U)\s+", " "), whole)


def bare_name(official) -> Column:
    """An official name without its form."""
    bare = lambda n: let(F.regexp_extract(n, _QUOTED, 1), lambda q: F.when(q != "", F.trim(q)).otherwise(F.btrim(F.regexp_replace(n, _FORM, ""), F.lit(' «»".,;:-'))))
    return let(F.coalesce(c(official), F.lit("")), bare)


def short_from_official(x) -> Column:
    """The official name of a full name, without its form."""
    return bare_name(official_name(x))


def short_name(official, original=None) -> Column:
    """`Name, FORM` from the short name, or from the official one."""
    form = F.upper(F.regexp_extract(F.coalesce(c(official), F.lit("")), _FORM, 1))
    base = short_from_official(official) if original is None else F.coalesce(blank(original), short_from_official(official))
    base = F.btrim(F.regexp_replace(base, _SHORT, ""), F.lit(' ,;«»"'))
    return F.when((form != "") & (base != "") & ~F.upper(base).endswith(form), F.concat(base, F.lit(", "), form)).otherwise(F.coalesce(F.nullif(base, F.lit("")), c(official)))


def name_variants(*cols, cap: int = 5) -> Column:
    """Up to `cap` spellings, in order of value, official form, short form; without forms, generic words and repeats in other case."""
    forms = lambda v: F.when(v.isNotNull(), let(official_name(v), lambda o: F.array(v, o, bare_name(o)))).otherwise(F.array().cast("array<string>"))
    every = F.array_compact(F.flatten(F.transform(F.array(*[blank(x) for x in cols]), forms)))
    bare = F.transform(every, lambda v: F.btrim(F.regexp_replace(F.regexp_replace(v, _SHORT, ""), r"(?U)\s+", " "), F.lit(" ,;«»")))
    good = F.filter(bare, lambda v: (F.length(v) >= 3) & ~F.lower(v).isin(GENERIC_NAMES))
    first = lambda g: F.filter(g, lambda v, i: F.array_position(F.transform(g, lambda w: F.lower(w)), F.lower(v)) == i + 1)
    return F.slice(let(good, first), 1, cap)
