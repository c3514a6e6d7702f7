"""Small column-expression helpers shared by the operators.

All are built-in Spark expressions (JVM side, inside whole-stage codegen).
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

# Money is summed exactly: line values are carried as DECIMAL with 6 places so
# sums do not depend on the order rows arrive in (floating sums would).
MONEY = T.DecimalType(28, 6)


def money(col: Column | str) -> Column:
    """Cast to the exact money type DECIMAL(28,6)."""
    c = F.col(col) if isinstance(col, str) else col
    return c.cast(MONEY)


def as_double(col: Column | str) -> Column:
    """Cast to DOUBLE."""
    c = F.col(col) if isinstance(col, str) else col
    return c.cast(T.DoubleType())


def safe_div(num: Column, den: Column, default: float = 0.0) -> Column:
    """num / den as DOUBLE, ``default`` when den is 0 or null (ANSI-safe)."""
    return F.coalesce(F.try_divide(as_double(num), as_double(den)), F.lit(float(default)))


def round_money(col: Column, scale: int) -> Column:
    """Round an exact DECIMAL and return it as DOUBLE."""
    return F.round(col, scale).cast(T.DoubleType())


def calendar_day_span(first: Column, last: Column) -> Column:
    """UTC calendar days between two timestamps, inclusive, whatever the
    session's time zone."""
    def day(ts: Column) -> Column:
        return F.floor(F.unix_micros(ts.cast(T.TimestampType())) / F.lit(86_400_000_000))

    return (day(last) - day(first) + F.lit(1)).cast(T.LongType())


def elapsed_day_span(first: Column, last: Column) -> Column:
    """Whole 24-hour periods between two timestamps, plus one (floor semantics)."""
    micros = F.unix_micros(last.cast(T.TimestampType())) - F.unix_micros(first.cast(T.TimestampType()))
    return F.floor(micros / F.lit(86_400_000_000)).cast(T.LongType()) + F.lit(1)


def py_bool_text(col: Column) -> Column:
    """Boolean rendered the way the original evidence strings show it."""
    return F.when(col, F.lit("True")).otherwise(F.lit("False"))


def lookup(mapping: dict, key: Column, default=None) -> Column:
    """Literal map lookup with a default for missing keys."""
    pairs = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v)]
    # try_element_at returns null for missing keys under ANSI mode
    found = F.try_element_at(F.create_map(*pairs), key)
    return found if default is None else F.coalesce(found, F.lit(default))
