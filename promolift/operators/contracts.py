"""The export's record contract, walked over its declared types.

One recursive walk turns a contract (declared struct, required fields, contracts
of nested records) into a single expression that lists every breach of a record,
at any depth, with its path: ``line_items[2].campaign_discounts[0].campaignName``.
Nested lists are walked in place by higher-order functions: no explode, no
shuffle, one pass; only breaches become rows.

Two forms of records are walked:

* VARIANT records (``sources.export.read_records``) keep what the text said, so
  an absent field, an explicit null and a value of another type differ, and
  records that aren't objects or no JSON are told apart. ``typed_records`` then
  gives the declared columns.
* Typed rows (declared columns, as from Parquet) can only miss required values.

JSON numbers without fraction are integers whatever their spelling (5, 5.0);
numbers in quotes and 0/1 for booleans are of another type. A list may be
absent, which means empty, but not null.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..schemas import (CAMPAIGN, CAMPAIGN_DISCOUNT, LINE_ITEM, ORDER, ORDER_CAMPAIGN, ORDER_PII_KEY, REQUIRED_FIELDS, SHOP,
                       SHOP_COLUMNS)

RECORD = "record"  # name of the VARIANT column
FOUND = "_breaches"  # and of the breaches listed with a record
BREACH = "array<struct<path:string,reason:string>>"


@dataclass(frozen=True)
class Contract:
    """A record's declared fields, which of them are required, and the contracts
    of its nested records by field name."""

    schema: T.StructType
    required: tuple[str, ...]
    nested: dict[str, "Contract"] = field(default_factory=dict)


_DISCOUNT = Contract(CAMPAIGN_DISCOUNT, REQUIRED_FIELDS["discounts"])
_ORDER_CAMPAIGN = Contract(ORDER_CAMPAIGN, REQUIRED_FIELDS["discounts"])
_LINE = Contract(LINE_ITEM, REQUIRED_FIELDS["lineitems"], {"campaign_discounts": _DISCOUNT})
CONTRACTS: dict[str, Contract] = {
    "orders": Contract(T.StructType([f for f in ORDER.fields if f.name != ORDER_PII_KEY]), REQUIRED_FIELDS["orders"],
                       {"line_items": _LINE, "applied_campaigns": _DISCOUNT, "order_campaigns": _ORDER_CAMPAIGN}),
    "campaigns": Contract(CAMPAIGN, REQUIRED_FIELDS["campaigns"]),
    "shop": Contract(T.StructType([SHOP[c] for c in SHOP_COLUMNS]), REQUIRED_FIELDS["shop"]),
}


def contract_of(table: str) -> Contract:
    """The contract of 'orders', 'campaigns' or 'shop'."""
    if table not in CONTRACTS:
        raise ValueError(f"no contract for {table!r}; there are {sorted(CONTRACTS)}")
    return CONTRACTS[table]


# The walk is written as SQL text: one parsed expression instead of thousands of
# column objects. Values are bound to a lambda variable where they are used more
# than once, so each is extracted once.

_NONE = f"CAST(array() AS {BREACH})"


def _one(path: str, reason: str) -> str:
    return f"array(named_struct('path', {path}, 'reason', '{reason}'))"


def _let(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _path(above: str, name: str) -> str:
    return f"'{name}'" if above == "''" else f"concat({above}, '.{name}')"


def _element(above: str, at: str) -> str:
    return f"concat({above}, '[', CAST({at} AS string), ']')"


# -- VARIANT records ---------------------------------------------------------------
#
# A record is taken apart once: one cast gives all its scalars and one each list
# of nested records, as structs of VARIANT scalars (``_probed``). Taking out a
# VARIANT copies all that it holds, so nothing but scalars and innermost lists is
# ever taken out as one. The declared values are read from those structs, and the
# walk looks at a VARIANT again only where the declared value is null.

def _get(value: str, kind: str, path: str = "$") -> str:
    return f"try_variant_get({value}, '{path}', '{kind}')"


def _fits(x: str, dtype: T.DataType) -> str:
    """Whether a VARIANT scalar is of the declared type; null without one."""
    kind = f"schema_of_variant({x})"
    number = f"substr({kind}, 1, 3) IN ('BIG', 'DEC', 'DOU', 'FLO')"
    if isinstance(dtype, T.StringType):
        return f"{kind} = 'STRING'"
    if isinstance(dtype, T.BooleanType):
        return f"{kind} = 'BOOLEAN'"
    if isinstance(dtype, T.DoubleType):
        return number
    if isinstance(dtype, (T.LongType, T.IntegerType)):
        whole = f"{_get(x, 'decimal(38,6)')} = CAST({_get(x, 'bigint')} AS decimal(38,6))"
        here = f"{_get(x, dtype.simpleString())} IS NOT NULL"
        return f"({kind} = 'BIGINT' OR ({number} AND coalesce({whole}, false))) AND {here}"
    if isinstance(dtype, T.TimestampType):
        return f"{kind} = 'STRING' AND try_cast({_get(x, 'string')} AS timestamp) IS NOT NULL"
    raise TypeError(f"no VARIANT reading of {dtype.simpleString()}")


def _scalar(x: str, dtype: T.DataType) -> str:
    """The value of a VARIANT scalar in its declared type, null if it is of another."""
    if isinstance(dtype, T.TimestampType):
        return f"CASE WHEN schema_of_variant({x}) = 'STRING' THEN try_cast({_get(x, 'string')} AS timestamp) END"
    return f"CASE WHEN {_fits(x, dtype)} THEN {_get(x, dtype.simpleString())} END"


def _nests(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.ArrayType, T.StructType))


def _apart(dtype: T.DataType) -> str:
    """The type by which a VARIANT of the declared type is taken apart: its fields
    or elements stay VARIANTs."""
    if isinstance(dtype, T.ArrayType):
        inner = dtype.elementType
        return f"array<{_apart(inner) if isinstance(inner, T.StructType) else 'variant'}>"
    return f"struct<{', '.join(f'`{f.name}`: variant' for f in dtype.fields)}>"


PROBE = "_x"  # a record's scalars, and the prefix of its nested values


def _probed(records: DataFrame, table: str) -> DataFrame:
    """VARIANT records with the columns that hold them taken apart."""
    schema = contract_of(table).schema
    scalars = T.StructType([f for f in schema.fields if not _nests(f.dataType)])
    parts = [F.expr(_get(RECORD, _apart(scalars))).alias(PROBE)]
    parts += [F.expr(_get(RECORD, _apart(f.dataType), f"$.{f.name}")).alias(f"{PROBE}_{f.name}")
              for f in schema.fields if _nests(f.dataType)]
    return records.select("*", *parts)


def _typed(apart: str, dtype: T.DataType, nested: Contract | None, depth: int) -> str:
    """The declared value of what was taken apart."""
    if isinstance(dtype, T.ArrayType):
        e, inner = f"e{depth}", dtype.elementType
        value = _typed(e if isinstance(inner, T.StructType) else _let(_get(e, _apart(inner)), f"a{depth}", f"a{depth}") if _nests(inner) else e,
                       inner, nested, depth + 1)
        return f"transform({apart}, {e} -> {value})"
    if isinstance(dtype, T.StructType):
        fields = ", ".join(f"'{f.name}', {_typed_field(f'{apart}.{f.name}', f, nested, depth)}" for f in nested.schema.fields)
        return f"CASE WHEN {apart} IS NOT NULL THEN named_struct({fields}) END"
    return _scalar(apart, dtype)


def _typed_field(x: str, f: T.StructField, contract: Contract, depth: int) -> str:
    return _typed(_get(x, _apart(f.dataType)) if _nests(f.dataType) else x, f.dataType, contract.nested.get(f.name), depth)


def _lacking(x: str, path: str, required: bool, is_list: bool) -> str:
    """Breaches of a VARIANT that has no value of its declared type."""
    absent = _one(path, "absent") if required else _NONE
    null = _one(path, "null") if required or is_list else _NONE
    return f"CASE WHEN {x} IS NULL THEN {absent} WHEN is_variant_null({x}) THEN {null} ELSE {_one(path, 'type')} END"


def _found_in(x: str, apart: str, typed: str, path: str, f: T.StructField, contract: Contract, depth: int) -> str:
    """Breaches of a field: ``x`` is its VARIANT, ``apart`` that taken apart,
    ``typed`` the declared value."""
    required, nested = f.name in contract.required, contract.nested.get(f.name)
    lacking = _lacking(x, path, required, isinstance(f.dataType, T.ArrayType))
    if isinstance(f.dataType, T.ArrayType):
        e, at, inner = f"e{depth}", f"i{depth}", f.dataType.elementType
        here, value = _element(path, at), f"{typed}[{at}]"
        if isinstance(inner, T.StructType):
            bad = _lacking(f"{_get(x, 'array<variant>')}[{at}]", here, True, False)
            walk = f"CASE WHEN {e} IS NULL THEN {bad} ELSE {_found_in_fields(e, value, here, nested, depth + 1)} END"
        elif isinstance(inner, T.ArrayType):
            walk = _let(_get(e, _apart(inner)), f"l{depth}", _found_in(
                e, f"l{depth}", value, here, T.StructField(f.name, inner), Contract(contract.schema, (), contract.nested), depth + 1))
        else:
            walk = f"CASE WHEN {value} IS NOT NULL THEN {_NONE} ELSE {_lacking(e, here, True, False)} END"
        return f"CASE WHEN {apart} IS NULL THEN {lacking} ELSE flatten(transform({apart}, ({e}, {at}) -> {walk})) END"
    if isinstance(f.dataType, T.StructType):
        return f"CASE WHEN {apart} IS NULL THEN {lacking} ELSE {_found_in_fields(apart, typed, path, nested, depth)} END"
    return f"CASE WHEN {typed} IS NOT NULL THEN {_NONE} ELSE {lacking} END"


def _found_in_fields(apart: str, typed: str, path: str, contract: Contract, depth: int) -> str:
    parts = []
    for f in contract.schema.fields:
        x, value, here = f"{apart}.{f.name}", f"{typed}.{f.name}", _path(path, f.name)
        if _nests(f.dataType):
            name = f"l{depth}"
            parts.append(_let(_get(x, _apart(f.dataType)), name, _found_in(x, name, value, here, f, contract, depth + 1)))
        else:
            parts.append(_found_in(x, x, value, here, f, contract, depth + 1))
    return f"concat({', '.join(parts)})"


TYPED = "_typed_"  # prefix of the declared columns while the walk reads them


def _walked(records: DataFrame, table: str) -> DataFrame:
    """VARIANT records with their declared values (``TYPED`` columns) and breaches.
    Each step is a projection of its own whose columns the next ones read more
    than once, so that none is worked out twice."""
    contract = contract_of(table)
    fields = contract.schema.fields
    apart = {f.name: f"{PROBE}_{f.name}" if _nests(f.dataType) else f"{PROBE}.{f.name}" for f in fields}
    df = _probed(records, table)
    df = df.select("*", *[F.expr(_typed(apart[f.name], f.dataType, contract.nested.get(f.name), 0)).alias(TYPED + f.name) for f in fields])
    parts = [_found_in(_get(RECORD, "variant", f"$.{f.name}") if _nests(f.dataType) else apart[f.name], apart[f.name],
                       TYPED + f.name, f"'{f.name}'", f, contract, 0) for f in fields]
    empty = chr(39) * 2
    return df.withColumn(FOUND, F.expr(
        f"CASE WHEN {RECORD} IS NULL THEN {_one(empty, 'syntax')} WHEN {PROBE} IS NULL THEN {_one(empty, 'type')} "
        f"ELSE concat({', '.join(parts)}) END"))


def record_breaches(records: DataFrame, table: str) -> DataFrame:
    """(table, row_id, path, reason) for every breach in VARIANT records (column
    ``record``). Reasons: ``syntax`` (no JSON: the path is empty), ``type`` (of
    another type; for the whole record: no object), ``absent``, ``null``. row_id
    is the record's id as text, null where it has none."""
    row_id = F.try_variant_get(F.col(RECORD), "$.id", "string").alias("row_id")
    return _rows(_walked(records, table).select(row_id, FOUND), table)


def _rows(listed: DataFrame, table: str) -> DataFrame:
    return (listed.where(F.size(FOUND) > 0).select("row_id", F.explode(FOUND).alias("_b"))
            .select(F.lit(table).alias("table"), "row_id", "_b.path", "_b.reason"))


def typed_records(records: DataFrame, table: str) -> DataFrame:
    """The declared columns of VARIANT records, without personal fields. A value
    of another type is null in its place, and so are all values of a record that
    is no object; other columns of ``records`` are kept."""
    rest = [c for c in records.columns if c != RECORD]
    return _declared(_walked(records, table), table, rest)


def _declared(walked: DataFrame, table: str, rest: list[str]) -> DataFrame:
    return walked.select(*[F.col(TYPED + f.name).alias(f.name) for f in contract_of(table).schema.fields], *rest)


# -- typed rows ----------------------------------------------------------------------

def _missing_in(value: str, path: str, contract: Contract, depth: int) -> str:
    """Required values that are null, in a row (``value`` is empty) or a nested struct."""
    parts = []
    for f in contract.schema.fields:
        x, here, nested = f"{value}{f.name}", _path(path, f.name), contract.nested.get(f.name)
        if f.name in contract.required:
            parts.append(f"CASE WHEN {x} IS NULL THEN {_one(here, 'missing')} ELSE {_NONE} END")
        if nested is not None:
            e, at = f"e{depth}", f"i{depth}"
            inside = _element(here, at)
            walked = (f"CASE WHEN {e} IS NULL THEN {_one(inside, 'missing')} "
                      f"ELSE {_missing_in(e + '.', inside, nested, depth + 1)} END")
            parts.append(f"CASE WHEN {x} IS NULL THEN {_NONE} ELSE flatten(transform({x}, ({e}, {at}) -> {walked})) END")
    return f"concat({', '.join(parts)})"


def _complete(value: str, contract: Contract, depth: int) -> str:
    """Whether a row or a nested struct lacks no required value, true or false."""
    parts = []
    for f in contract.schema.fields:
        x, nested = f"{value}{f.name}", contract.nested.get(f.name)
        if f.name in contract.required:
            parts.append(f"{x} IS NOT NULL")
        if nested is not None:
            e = f"e{depth}"
            parts.append(f"({x} IS NULL OR forall({x}, {e} -> {e} IS NOT NULL AND {_complete(e + '.', nested, depth + 1)}))")
    return " AND ".join(parts) or "true"


def _row_found(df: DataFrame, table: str) -> Column:
    contract = contract_of(table)
    found, complete = _missing_in("", "''", contract, 0), _complete("", contract, 0)
    if "record_ok" in df.columns:
        found = f"concat({found}, CASE WHEN record_ok THEN {_NONE} ELSE {_one(chr(39) * 2, 'syntax')} END)"
        complete = f"coalesce(record_ok, false) AND {complete}"
    # the walk makes a path and a list of every value: only rows that lack some are walked
    return F.expr(f"CASE WHEN {complete} THEN {_NONE} ELSE {found} END")


def row_breaches(df: DataFrame, table: str) -> DataFrame:
    """(table, row_id, path, reason) for every required value that is null in
    typed rows, at any depth; reason is ``missing``, or ``syntax`` for rows that
    were read as no record or with values of other types (``record_ok`` false)."""
    return _rows(df.select(F.col("id").cast("string").alias("row_id"), _row_found(df, table).alias(FOUND)), table)


# -- results ---------------------------------------------------------------------------

def breaches(df: DataFrame, table: str) -> DataFrame:
    """``record_breaches`` of VARIANT records, else ``row_breaches``."""
    return record_breaches(df, table) if RECORD in df.columns else row_breaches(df, table)


def listed(df: DataFrame, table: str) -> DataFrame:
    """The typed columns of ``df`` (VARIANT records or typed rows) with the list
    of breaches of each record in ``_breaches``, so that one pass over the input
    gives both."""
    if RECORD in df.columns:
        return _declared(_walked(df, table), table, [*[c for c in df.columns if c != RECORD], FOUND])
    return df.withColumn(FOUND, _row_found(df, table))


def listed_breaches(kept: DataFrame, table: str) -> DataFrame:
    """The breach rows of what ``listed`` returned."""
    return _rows(kept.select(F.col("id").cast("string").alias("row_id"), FOUND), table)


def breach_counts(found: DataFrame) -> DataFrame:
    """(table, rule, n_violations): breaches per field, list positions left out.
    The rule reads ``reason:path``, as ``absent:line_items[].price``."""
    rule = F.concat_ws(":", "reason", F.regexp_replace("path", r"\[\d+\]", "[]"))
    return (found.groupBy("table", rule.alias("rule")).agg(F.count("*").alias("n_violations")))
