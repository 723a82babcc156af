"""Portable path segments."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import BLOCKED_DIRS, BLOCKED_SUFFIXES, LATIN, RESERVED_NAMES
from .text import blank, c


def _letters() -> dict[str, str]:
    """Transliteration, and accented Latin letters without their accents."""
    out = LATIN | {k.upper(): v.capitalize() for k, v in LATIN.items()}
    for code in range(0xC0, 0x250):
        plain = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        if plain:
            out.setdefault(chr(code), plain)
    return out


def latin(x) -> Column:
    """Text in ASCII: single letters by translate(), those with several letters one by one, what is left out removed."""
    letters = _letters()
    one = {k: v for k, v in letters.items() if len(v) == 1}
    t = F.translate(c(x), "".join(one), "".join(one.values()))
    for k, v in letters.items():
        if len(v) > 1:
            t = F.replace(t, F.lit(k), F.lit(v))
    return F.regexp_replace(t, r"[^\x00-\x7F]", "")


def safe_segment(x, default: str = "__MISSING__", max_len: int = 120, ext: str = "") -> Column:
    """A name for a folder or file that every common system takes. The signs replaced and the order of steps, as paths must agree."""
    raw = F.coalesce(blank(x), F.lit(default))
    technical = raw.startswith("__") & raw.endswith("__")
    t = F.regexp_replace(F.regexp_replace(latin(raw), r'[\\/:*?"<>|]+', "_"), r"\s+", "_")
    t = F.when(technical, F.btrim(t, F.lit(" ."))).otherwise(F.btrim(F.regexp_replace(t, "_+", "_"), F.lit(" ._")))
    t = F.when(t == "", default).otherwise(t)
    t = F.when(F.upper(t).isin(RESERVED_NAMES), F.concat(F.lit("_"), t)).otherwise(t)
    room = max(1, max_len - len(ext))
    t = F.when(F.length(t) > room, F.rtrim(F.substring(t, 1, room), F.lit(" ._"))).otherwise(t)
    return F.concat(t, F.lit(ext)) if ext else t


def path_flags(df, path: str, size: str | None = None, large: int = 1 << 20):
    """df with blocked_dir, blocked_suffix and, with sizes, large_file of each path."""
    low = F.lower(F.translate(F.col(path), "\\", "/"))
    parts = F.split(low, "/")
    out = df.withColumn("blocked_dir", F.arrays_overlap(parts, F.array(*[F.lit(d) for d in BLOCKED_DIRS])))
    out = out.withColumn("blocked_suffix", F.regexp_extract(F.element_at(parts, -1), r"(\.[^.]+)$", 1).isin(BLOCKED_SUFFIXES))
    return out.withColumn("large_file", F.col(size) >= large) if size else out
