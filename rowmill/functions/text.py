"""Column expressions on text. Null means missing throughout; every function gives null or an empty array for it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import DESCRIPTION_MAX, DESCRIPTION_MIN, DESCRIPTION_SENTENCES, EXTEND_NONE, EXTEND_PROFILE, EXTEND_REGION, FORBIDDEN_WORDS, ISSUE_COST, MISSING_WORDS, URL_PATTERN


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(x, f) -> Column:
    """f(x) with x computed once, however often f uses it; keeps generated code small where expressions nest."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def squeeze(x) -> Column:
    """Runs of white space, any Unicode kind, as one space; trimmed."""
    return F.trim(F.regexp_replace(c(x), r"(?U)\s+", " "))


def blank(x) -> Column:
    """Null for blank text, else the trimmed text."""
    return F.nullif(F.regexp_replace(c(x).cast("string"), r"(?U)^\s+|\s+$", ""), F.lit(""))


def first_nonblank(*cols) -> Column:
    return F.coalesce(*[blank(x) for x in cols])


def is_missing(x) -> Column:
    return F.coalesce(F.lower(F.trim(c(x).cast("string"))).isin(MISSING_WORDS), F.lit(True))


def norm_text(x) -> Column:
    return F.lower(squeeze(F.coalesce(c(x).cast("string"), F.lit(""))))


def strip_chars(x, chars: str) -> Column:
    """Without leading and trailing characters of the set."""
    return F.btrim(c(x), F.lit(chars))


def clean_text(x, remove_urls: bool = True) -> Column:
    """Text without NULs, bracketed remarks, links and edge punctuation."""
    t = F.regexp_replace(F.replace(c(x), F.lit("\0"), F.lit(" ")), r"\[[^\]]*\]", " ")
    if remove_urls:
        t = F.regexp_replace(t, r"(?U)https?://\S+", " ")
    return F.nullif(strip_chars(F.regexp_replace(t, r"(?U)\s+", " "), " \t\r\n;,.—-"), F.lit(""))


def flat_clean(x, max_len: int | None = None) -> Column:
    """A value for a file whose lines are split by comma alone."""
    t = F.translate(F.coalesce(c(x).cast("string"), F.lit("")), ",;|\"", "   '")
    t = squeeze(t)
    if max_len:
        t = F.when(F.length(t) > max_len, F.concat(F.rtrim(F.substring(t, 1, max_len - 1)), F.lit("…"))).otherwise(t)
    return t


def has_any(x, words) -> Column:
    """Whether the text holds one of the words; the text is computed once."""
    return let(c(x), lambda t: reduce(lambda a, b: a | b, [t.contains(w) for w in words], F.lit(False)))


def drop_forbidden(x, words) -> Column:
    """Null where the text has one of the words."""
    return F.when(~has_any(F.lower(c(x)), words), c(x))


def sanitize_line(x) -> Column:
    """A raw line without NULs and without brackets around links."""
    t = F.replace(F.replace(F.replace(c(x), F.lit("\0"), F.lit("")), F.lit("[https://"), F.lit("https://")), F.lit("[http://"), F.lit("http://"))
    return F.regexp_replace(t, r"(?U)(https?://[^\s\]]+)\]", "$1")


def clean_field(x) -> Column:
    """A field without byte-order marks, edge space and one pair of quotes around it."""
    t = F.trim(F.regexp_replace(F.coalesce(c(x), F.lit("")), "^﻿+", ""))
    t = F.regexp_replace(t, r"(?U)^\s+|\s+$", "")
    return F.trim(F.when((F.length(t) >= 2) & t.startswith('"') & t.endswith('"'), F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(t))


def quote_count(x) -> Column:
    """Quotes that neither a backslash nor a second quote escapes."""
    t = F.regexp_replace(c(x), r'(?s)\\.|""', "")
    return F.length(t) - F.length(F.replace(t, F.lit('"'), F.lit("")))


#: A run in double quotes, in which doubled quotes stand for one; it may be open at the end. Nothing is tried twice.
QUOTED = r'"(?:[^"]++|"")*+"?'


def outside_quotes(x) -> Column:
    """A text without its quoted runs."""
    return F.regexp_replace(c(x), QUOTED, "")


def field_counts(x, delimiters) -> Column:
    """How many fields each delimiter would give, of one pass over the line's quotes."""
    return let(outside_quotes(x), lambda t: F.array(*[F.length(t) - F.length(F.replace(t, F.lit(d), F.lit(""))) + 1 for d in delimiters]))


def _class(delimiter: str) -> str:
    import re

    return r"\t" if delimiter == "\t" else re.escape(delimiter)


def split_quoted(x, delimiter: str = ",") -> Column:
    """Fields split at delimiters outside quotes, trimmed; doubled quotes inside quotes count as one. Forgiving: a quote may
    open anywhere and need not close. Every character is passed once."""
    d = _class(delimiter)
    fields = F.regexp_extract_all(F.concat(F.lit(delimiter), c(x)), F.lit(rf'{d}((?:[^"{d}]++|{QUOTED})*+)'), F.lit(1))
    # inside quotes: from the first opening quote, or from the last pair, past runs that close and open again
    pair = r'(\G(?:^[^"]*+"|(?!^))(?:[^"]*+"(?!")[^"]*+")*+[^"]*+)""'
    single = lambda f: F.when(f.contains('""'), F.replace(F.regexp_replace(f, pair, "$1\u0001"), F.lit("\u0001"), F.lit('"'))).otherwise(f)
    return F.transform(fields, lambda f: F.regexp_replace(single(f), r"(?U)^\s+|\s+$", ""))


def csv_fields(x, delimiter: str = ",", escape: bool = False) -> Column:
    r"""Fields of one CSV record as a strict reader takes them, or null where it would refuse: a quoted field begins with its
    quote, what follows its end belongs to it as it stands, and a line break outside quotes is an error. With `escape`, a
    backslash makes the next character plain."""
    d = _class(delimiter)
    bare = rf"(?:[^{d}\r\n\\]++|\\(?s:.))*+" if escape else rf"[^{d}\r\n]*+"
    inner = r'(?:[^"\\]++|""|\\(?s:.))*+' if escape else r'(?:[^"]++|"")*+'
    t = F.concat(F.lit(delimiter), c(x))
    found = F.regexp_extract_all(t, F.lit(rf'{d}(?:"{inner}(?:"(?:[^{d}\r\n]{bare})?)?|{bare})'), F.lit(0))

    def value(f: Column) -> Column:
        f = F.substring(f, F.lit(2), F.length(f))
        inside, rest = F.regexp_extract(f, f'^"({inner})', 1), F.regexp_extract(f, f'(?s)^"{inner}"?(.*)$', 1)
        if escape:
            plain = lambda t: F.regexp_replace(t, r"(?s)\\(.)", "$1")
            after = F.concat(F.substring(rest, 1, 1), plain(F.substring(rest, F.lit(2), F.length(rest))))  # what follows the closing quote at once is taken as it is
            return F.when(f.startswith('"'), F.concat(F.regexp_replace(inside, r'(?s)"(")|\\(.)', "$1$2"), after)).otherwise(plain(f))
        return F.when(f.startswith('"'), F.concat(F.replace(inside, F.lit('""'), F.lit('"')), rest)).otherwise(f)

    whole = F.length(F.array_join(found, "")) == F.length(t)
    return F.when(c(x) == "", F.array().cast("array<string>")).when(whole, F.transform(found, value))


#: Space after an end of sentence that is no common abbreviation's. The single character is looked at first.
_BETWEEN = r"(?<=[.!?])(?<!(?iU:\b(?:руб|тыс|млн|млрд|вн|тер)\.))(?<!(?<![А-Яа-яA-Za-z])[Гг]\.)\s+"


def sentences(x) -> Column:
    """Sentences of a text; common abbreviations do not end one."""
    return _sentences(squeeze(F.coalesce(c(x), F.lit(""))))


def _sentences(squeezed: Column) -> Column:
    return F.filter(F.split(squeezed, _BETWEEN), lambda s: s != "")


_YEAR = r"(?U)\b(19|20)\d{2}\b"


#: Phrases that descriptions are freed of.
PHRASES = {
    "на дату поиска действует": "является действующей организацией",
    "На дату поиска действует": "Является действующей организацией",
    "по открытым данным": "по переданным данным",
    "По открытым данным": "По переданным данным",
    "по открытым источникам": "по переданным данным",
    "По открытым источникам": "По переданным данным",
}


def sanitize_text(x) -> Column:
    t = squeeze(c(x))
    for old, new in PHRASES.items():
        t = F.replace(t, F.lit(old), F.lit(new))
    return squeeze(t)


def enforce_tail(x, tail) -> Column:
    """The first three sentences and the required last one, where there are three."""
    s = sentences(x)
    return F.when(F.size(s) >= 3, F.array_join(F.array_append(F.slice(s, 1, 3), c(tail)), " ")).otherwise(c(x))


def expand_short(x, region, profile, min_len: int = DESCRIPTION_MIN) -> Column:
    """A text of four sentences that is too short, with its third one extended by region and profile."""
    t = sanitize_text(x)
    s = sentences(t)
    r, p = blank(region), blank(profile)
    parts = F.array_compact(F.array(F.concat(F.lit(EXTEND_REGION), r, F.lit("»")), F.concat(F.lit(EXTEND_PROFILE), p, F.lit("»"))))
    none = F.array(F.lit(EXTEND_NONE))
    extra = F.concat(F.lit("; "), F.array_join(F.when(F.size(parts) > 0, parts).otherwise(none), ", а "))
    third = F.concat(F.regexp_replace(F.get(s, F.lit(2)), r"\.+$", ""), extra, F.lit("."))
    longer = F.concat_ws(" ", F.get(s, F.lit(0)), F.get(s, F.lit(1)), third, F.get(s, F.lit(3)))
    return F.when((F.size(s) == DESCRIPTION_SENTENCES) & (F.length(t) < min_len), longer).otherwise(t)


def text_issues(x, forbidden=FORBIDDEN_WORDS) -> Column:
    """Names of what is wrong with a description. A number inside a quoted name, as in «Фирма 1950», is no year."""

    def issues(t: Column) -> Column:
        return let(F.lower(t), lambda low: found(t, low))

    def found(t: Column, low: Column) -> Column:
        n = F.size(_sentences(t))
        words = F.transform(F.filter(F.array(*[F.lit(w) for w in forbidden]), lambda w: low.contains(w)), lambda w: F.concat(F.lit("forbidden_word_"), w))
        size = [let(n, lambda m: F.when(m != DESCRIPTION_SENTENCES, F.concat(F.lit("sentence_count_"), m.cast("string")))), F.when(F.length(t) < DESCRIPTION_MIN, F.lit("too_short")), F.when(F.length(t) > DESCRIPTION_MAX, F.lit("too_long"))]
        # fixed values: the patterns of a link, a year and the tail
        rest = [
            F.when(low.contains("http://") | low.contains("https://") | low.contains("www."), F.lit("contains_link")),
            F.when(~(t.rlike(_YEAR) & F.regexp_replace(t, "«[^»]*»", "«»").rlike(_YEAR)), F.lit("missing_year")),
            F.when(~t.rlike(r"(?U)Численность работников\s+—\s+около"), F.lit("missing_required_tail")),
            F.when(low.contains("требуют уточнения"), F.lit("missing_financial_or_employees_values")),
        ]
        return F.concat(F.array_compact(F.array(*size)), words, F.array_compact(F.array(*rest)))

    return let(squeeze(F.coalesce(c(x), F.lit(""))), issues)


def text_qa(df, col: str, forbidden=FORBIDDEN_WORDS):
    """df with `description_issues`, `description_quality_score` and `description_status` of a text column."""
    df = df.withColumn("description_issues", text_issues(F.col(col), forbidden))
    df = df.withColumn("description_quality_score", F.greatest(F.lit(0), 100 - ISSUE_COST * F.size("description_issues")))
    return df.withColumn("description_status", F.when(F.size("description_issues") == 0, "ok").otherwise("needs_review"))


def fingerprint(*cols) -> Column:
    """A stable hash of several columns, by name."""
    return F.sha1(F.to_json(F.struct(*[F.coalesce(F.col(x).cast("string"), F.lit("")).alias(x) for x in sorted(cols)])))


def domain(x) -> Column:
    """Host of a link or bare domain, in lower case without www."""
    t = F.regexp_replace(F.trim(c(x)), r"[/.,;)\]}]+$", "")
    t = F.regexp_replace(F.regexp_replace(t, r"(?i)^https?://", ""), r"[/?#].*$", "")
    return F.nullif(F.regexp_replace(F.lower(t), r"^www\.", ""), F.lit(""))


def site(cols, blacklist) -> Column:
    """The first domain in the columns that is no listed site or a part of one."""
    found = F.flatten(F.array(*[F.regexp_extract_all(F.coalesce(c(x), F.lit("")), F.lit(f"(?i){URL_PATTERN}"), F.lit(0)) for x in cols]))
    hosts = F.transform(found, lambda u: domain(u))
    bad = F.array(*[F.lit(b) for b in blacklist])
    good = F.filter(hosts, lambda h: h.isNotNull() & ~F.exists(bad, lambda b: (h == b) | h.endswith(F.concat(F.lit("."), b))))
    return F.get(good, F.lit(0))
