"""Personal-data removal and audits.

* ``minimize_document`` / ``minimize_shop`` / ``minimize_orders``: remove the
  personal fields (shop owner/customer e-mail and name, order customer e-mail).
  The shop is reduced to an allow-list of six analytical fields.
* ``pii_column_audit``: column names (nested fields included) containing a
  personal-data fragment -- a schema walk, no data read.
* ``pii_column_value_audit``: the flagged top-level columns with their value
  counts (the name audit joined with a scan of those columns).
* ``pii_value_scan``: every value of every string column (complex columns as
  JSON text) tested against the e-mail pattern in ONE distributed pass; no
  sampling. Returns counts per column.
* ``assert_no_pii``: raises on any hit of either audit.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..schemas import (EMAIL_PATTERN, ORDER_PII_KEY, PII_COLUMN_FRAGMENTS, SHOP_COLUMNS,
                       SHOP_PII_KEYS)


def minimize_shop(shop: DataFrame) -> DataFrame:
    """Allow-list projection of the shop (six analytical fields)."""
    return shop.select(*SHOP_COLUMNS)


def minimize_orders(orders: DataFrame) -> DataFrame:
    """Orders without the customer e-mail field."""
    return orders.drop(ORDER_PII_KEY)


def minimize_document(doc: DataFrame) -> DataFrame:
    """Export document with shop PII fields and every order's customer e-mail
    removed (nested fields dropped in place; no explode)."""
    out = doc.withColumn("shop", F.col("shop").dropFields(*SHOP_PII_KEYS))
    return out.withColumn("orders", F.transform("orders", lambda o: o.dropFields(ORDER_PII_KEY)))


def _walk(dtype: T.DataType, prefix: str):
    if isinstance(dtype, T.StructType):
        for f in dtype.fields:
            name = f"{prefix}.{f.name}" if prefix else f.name
            yield name, f.name
            yield from _walk(f.dataType, name)
    elif isinstance(dtype, T.ArrayType):
        yield from _walk(dtype.elementType, prefix + "[]")
    elif isinstance(dtype, T.MapType):
        yield from _walk(dtype.valueType, prefix + "{}")


def pii_column_hits(df: DataFrame, table: str) -> list[tuple[str, str, str]]:
    """(table, column path, fragment) for every column name holding a personal-data fragment."""
    hits = []
    for path, leaf in _walk(df.schema, ""):
        low = leaf.lower()
        for frag in PII_COLUMN_FRAGMENTS:
            if frag in low:
                hits.append((table, path, frag))
    return hits


def pii_column_audit(spark: SparkSession, frames: dict[str, DataFrame]) -> DataFrame:
    """Rows (table, column, fragment) for every column name holding a
    personal-data fragment, nested fields included."""
    rows = [h for name, df in frames.items() for h in pii_column_hits(df, name)]
    return spark.createDataFrame(rows, "table string, column string, fragment string")


def pii_column_value_audit(frames: dict[str, DataFrame]) -> DataFrame:
    """Column-name audit joined with the data: one row per (table, flagged
    column, fragment), nested columns by their path, with the non-null and
    e-mail-like value counts of the top-level column that holds it (one
    aggregate pass per frame over its flagged columns)."""
    out = None
    for name, df in frames.items():
        hits = [(path, re.split(r"[.\[{]", path)[0], frag) for _, path, frag in pii_column_hits(df, name)]
        if not hits:
            continue
        tops = sorted({top for _, top, _ in hits})
        scan = pii_value_scan(df.select(*tops), name).withColumnRenamed("column", "top")
        frag_rows = df.sparkSession.createDataFrame(hits, "column string, top string, fragment string")
        part = frag_rows.join(scan, "top").select("table", "column", "fragment", "n_values", "n_matches")
        out = part if out is None else out.unionByName(part)
    if out is None:
        spark = next(iter(frames.values())).sparkSession
        out = spark.createDataFrame(
            [], "table string, column string, fragment string, n_values bigint, n_matches bigint")
    return out


def _as_text(f: T.StructField) -> Column | None:
    c = F.col(f"`{f.name}`")
    if isinstance(f.dataType, T.StringType):
        return c
    if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(c)
    return None


# a text that a value must hold to match the pattern
NEEDLES = {EMAIL_PATTERN: "@"}
_PLAIN = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def _may_hold(c: Column, dtype: T.DataType, needle: str) -> Column:
    """Whether the JSON text of ``c`` can hold ``needle`` (a character that JSON
    doesn't escape and numbers and times don't have): true if a text in it or a
    field's name does, and for types that aren't looked into."""
    if isinstance(dtype, T.StringType):
        return F.coalesce(c.contains(needle), F.lit(False))
    if isinstance(dtype, T.ArrayType):
        inner = dtype.elementType
        return F.lit(False) if isinstance(inner, _PLAIN) else F.coalesce(
            F.exists(c, lambda x: _may_hold(x, inner, needle)), F.lit(False))
    if isinstance(dtype, T.MapType):
        return (_may_hold(F.map_keys(c), T.ArrayType(dtype.keyType), needle)
                | _may_hold(F.map_values(c), T.ArrayType(dtype.valueType), needle))
    if isinstance(dtype, T.StructType):
        found = F.lit(any(needle in f.name for f in dtype.fields))
        for f in dtype.fields:
            if not isinstance(f.dataType, _PLAIN):
                found |= _may_hold(c.getField(f.name), f.dataType, needle)
        return found
    return F.lit(not isinstance(dtype, _PLAIN))


def _matches(f: T.StructField, text: Column, pattern: str) -> Column:
    """Whether the text of a column matches. With a needle, only values that hold
    it are written as JSON and searched."""
    needle = NEEDLES.get(pattern)
    if needle is None:
        return text.rlike(pattern)
    return _may_hold(F.col(f"`{f.name}`"), f.dataType, needle) & text.rlike(pattern)


def pii_value_scan(df: DataFrame, table: str, pattern: str = EMAIL_PATTERN) -> DataFrame:
    """(table, column, n_values, n_matches) for every text-bearing column, from
    one aggregate pass over all rows (partial counts per task, no sampling)."""
    checks = [(f, _as_text(f)) for f in df.schema.fields]
    checks = [(f, c) for f, c in checks if c is not None]
    if not checks:
        return df.sparkSession.createDataFrame(
            [], "table string, column string, n_values bigint, n_matches bigint")
    aggs = []
    for i, (f, c) in enumerate(checks):
        # a value and its JSON text are null together
        aggs += [F.count(F.col(f"`{f.name}`")).alias(f"v{i}"), F.count(F.when(_matches(f, c, pattern), 1)).alias(f"m{i}")]
    wide = df.agg(*aggs)
    entries = [F.struct(F.lit(table).alias("table"), F.lit(f.name).alias("column"),
                        F.col(f"v{i}").alias("n_values"), F.col(f"m{i}").alias("n_matches"))
               for i, (f, _) in enumerate(checks)]
    return wide.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def assert_no_pii(frames: dict[str, DataFrame]) -> None:
    """Raise ValueError if any frame has a personal-data column name or an
    e-mail-like value."""
    for name, df in frames.items():
        hits = pii_column_hits(df, name)
        if hits:
            _, col, frag = hits[0]
            raise ValueError(f"{name}: the column name '{col}' points to personal data ('{frag}')")
    for name, df in frames.items():
        found = pii_value_scan(df, name).where(F.col("n_matches") > 0).first()
        if found is not None:
            raise ValueError(f"{name}: {found['n_matches']} value(s) of '{found['column']}' look like e-mail addresses")
