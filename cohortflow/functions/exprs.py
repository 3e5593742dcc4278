"""Column expressions shared by the operators (all JVM-side, codegen-friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortflow import config


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def md5_int(*parts, digits: int = 8) -> Column:
    """Non-negative integer from the first ``digits`` hex digits of md5 of the
    parts joined by '|'.  Same value as DuckDB's
    ``('0x' || substr(md5(s), 1, digits))::BIGINT``; independent of
    partitioning, so sampling and splits are reproducible on any cluster."""
    s = F.concat_ws("|", *[col_(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(s), 1, digits), 16, 10).cast("long")


def md5_unit(*parts) -> Column:
    """Uniform-ish number in [0, 1) from md5 (8 hex digits)."""
    return md5_int(*parts) / F.lit(float(16 ** 8))


def strip_prefix(c, start: int = 7) -> Column:
    """Drops ``CIM10:``; the whole rest of the code stays."""
    return F.substring(col_(c), start, 2 ** 31 - 1)


def recode(c, mapping: dict[str, str]) -> Column:
    """Value replacement, identity when the value is unknown."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(m[col_(c)], col_(c))


def normalize_label_value(c) -> Column:
    """True -> "1", False -> "0", otherwise the first character."""
    v = col_(c).cast("string")
    return (F.when(F.lower(v) == "true", "1")
            .when(F.lower(v) == "false", "0")
            .otherwise(F.substring(v, 1, 1)))


def age_years(start, birth) -> Column:
    """Whole years of 365.2425 days, truncated toward zero."""
    days = F.datediff(F.to_date(col_(start)), F.to_date(col_(birth)))
    return F.floor(days / F.lit(365.2425)).cast("int")


def safe_pct(num, den) -> Column:
    """100 * num / den, NULL when den = 0 (ANSI-safe)."""
    return F.lit(100.0) * F.try_divide(col_(num).cast("double"), col_(den).cast("double"))


def f1(ppv, sens) -> Column:
    return F.try_divide(F.lit(2.0) * col_(ppv) * col_(sens), col_(ppv) + col_(sens))


def display_name(c) -> Column:
    return recode(c, config.DISPLAY_NAMES)
