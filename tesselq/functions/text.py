"""Small text functions, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column, delimiters: str) -> Column:
    """Non-empty parts between any of the characters ``delimiters``."""
    cls = "".join("\\" + c if not c.isalnum() and not c.isspace() else c for c in delimiters)
    return F.filter(F.split(text, f"[{cls}]"), lambda w: w != "")


def padded(number: Column, digits: int) -> Column:
    """Decimal digits with leading zeros; longer numbers stay whole."""
    s = number.cast("string")
    return F.when(F.length(s) >= digits, s).otherwise(F.lpad(s, digits, "0"))


def duration_seconds(text: Column) -> Column:
    """Seconds of ``d:h:m:s``, with leading parts left out at will; null where a part is no number."""
    parts = F.reverse(F.split(F.trim(text), ":"))
    units = F.array(*(F.lit(u) for u in (1.0, 60.0, 3600.0, 86400.0)))
    return F.when(F.size(parts) <= 4, F.aggregate(F.zip_with(parts, F.slice(units, F.lit(1), F.size(parts)), lambda p, u: p.try_cast("double") * u), F.lit(0.0), lambda s, v: s + v))


def setting(text: Column, key: str) -> Column:
    """The rest of the line ``key: value``; null without such a line."""
    found = F.regexp_extract(text, rf"(?m)^\s*{key}\s*:[ \t]*(.*)$", 1)
    return F.nullif(F.trim(found), F.lit(""))
