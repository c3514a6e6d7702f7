"""Sinks: CSV tables, JSON records, and a sectioned result bundle.

* ``flatten_complex_to_json``: every array/struct/map column becomes JSON text
  (decided by the schema, not by sampling a value) so the table fits CSV.
* ``write_csv`` / ``read_csv``: header CSV datasets (one folder per table,
  written in parallel by the tasks).
* ``json_records`` / ``restore_records``: rows as JSON text with NaN -> null
  and ISO timestamps, and the way back with the declared schema.
* ``write_bundle``: one JSON Lines dataset per section (recommendations,
  campaign evaluation, segments) under one folder -- no single document is
  assembled on the driver.
"""

from __future__ import annotations

import json
import urllib.parse

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..session import materialize, remove_staged

TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
# quotes are doubled inside quoted fields, as other CSV readers expect; a quoted
# field may hold line ends
CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"', "timestampFormat": TS_FORMAT,
               "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
JSON_OPTIONS = {"ignoreNullFields": "false", "timestampFormat": TS_FORMAT}


def flatten_complex_to_json(df: DataFrame) -> DataFrame:
    """Array, struct and map columns as JSON text (chosen from the schema)."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            c = F.to_json(c, JSON_OPTIONS)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def write_csv(df: DataFrame, path: str, compression: str | None = None) -> None:
    """Header CSV dataset with nested columns as JSON text, its files compressed
    by the codec ``compression`` if one is given."""
    flatten_complex_to_json(df).write.mode("overwrite").options(**CSV_OPTIONS).csv(path, compression=compression)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read a CSV table back with the flattened (JSON-text) schema."""
    return spark.read.schema(schema).options(**CSV_OPTIONS, multiLine="true").csv(path)


def csv_schema(df: DataFrame) -> T.StructType:
    """Schema of the CSV form of ``df`` (nested columns as strings)."""
    return flatten_complex_to_json(df).schema


def _holds_fraction(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_holds_fraction(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _holds_fraction(kind.elementType)
    if isinstance(kind, T.MapType):
        return _holds_fraction(kind.valueType)
    return isinstance(kind, (T.DoubleType, T.FloatType))


def _finite(c: Column, kind: T.DataType) -> Column:
    """``c`` with NaN as null at every depth; other types stay as they are."""
    if not _holds_fraction(kind):
        return c
    if isinstance(kind, T.StructType):
        fields = [_finite(c[f.name], f.dataType).alias(f.name) for f in kind.fields]
        return F.when(c.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _finite(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, v: _finite(v, kind.valueType))
    return F.when(F.isnan(c), F.lit(None).cast(kind)).otherwise(c)


def _nan_to_null(df: DataFrame) -> DataFrame:
    return df.select(*[_finite(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def json_records(df: DataFrame) -> DataFrame:
    """One JSON text per row (column ``record``), NaN as null, ISO timestamps."""
    clean = _nan_to_null(df)
    return clean.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in clean.columns]),
                                  JSON_OPTIONS).alias("record"))


def restore_records(records: DataFrame, schema: T.StructType) -> DataFrame:
    """Parse JSON records back into typed columns (timestamps restored)."""
    return records.select(F.from_json("record", schema, JSON_OPTIONS).alias("r")).select("r.*")


def write_bundle(sections: dict[str, DataFrame], path: str) -> dict[str, str]:
    """Write each section as JSON Lines under ``path/<section>``."""
    out = {}
    for name, df in sections.items():
        target = f"{path.rstrip('/')}/{name}"
        _nan_to_null(df).write.mode("overwrite").options(**JSON_OPTIONS).json(target)
        out[name] = target
    return out


def read_bundle(spark: SparkSession, paths: dict[str, str], schemas: dict[str, T.StructType]) -> dict[str, DataFrame]:
    """Read the sections of a bundle back with their schemas."""
    return {name: spark.read.schema(schemas[name]).options(**JSON_OPTIONS).json(p) for name, p in paths.items()}


DOCUMENT_BYTES = 64 << 20  # largest document that one task writes as one file


def write_document(sections: dict[str, DataFrame], path: str, max_bytes: int | None = None) -> int:
    """Write the sections as one JSON document ``{section: [records]}`` and return
    its size in bytes, which is added up first: beyond ``max_bytes``, if given, a
    ValueError is raised and nothing written. Records are ordered by their text.

    Up to ``DOCUMENT_BYTES`` the document is one file. A larger one is written by
    many tasks: a folder per section, a line per record, and the files in the order
    of their paths, one after the other, are the document."""
    if not sections:
        raise ValueError("a document needs a section")
    records = {name: json_records(df) for name, df in sections.items()}
    size = 2
    for name, found in records.items():
        row = found.agg(F.coalesce(F.sum(F.octet_length("record")), F.lit(0)).alias("bytes"), F.count("*").alias("n")).first()
        size += row["bytes"] + row["n"] + len(name) + 6
    if max_bytes is not None and size > max_bytes:
        raise ValueError(f"a document of {size} bytes exceeds the {max_bytes} allowed: write the sections as a bundle")
    if size > DOCUMENT_BYTES:
        _write_parts(records, path)
        return size
    parts = []
    for i, (name, found) in enumerate(records.items()):
        listed = found.agg(F.array_join(F.array_sort(F.collect_list("record")), ",").alias("records")).scalar()
        parts += [F.lit(f'{"," if i else ""}{json.dumps(name)}:['), listed, F.lit("]")]
    spark = next(iter(sections.values())).sparkSession
    document = spark.range(1).select(F.concat(F.lit("{"), *parts, F.lit("}")).alias("value"))
    document.coalesce(1).write.mode("overwrite").text(path)
    return size


def _part_name(name: str) -> str:
    return urllib.parse.quote(name, safe="").replace("*", "%2A")


def _write_parts(records: dict[str, DataFrame], path: str) -> None:
    """The sections as sorted lines; every record but a section's first has a comma before it."""
    for i, (name, found) in enumerate(records.items()):
        spark, staged = found.sparkSession, []
        # written once: both reads below see the same numbers
        rows = materialize(found.withColumn("_n", F.monotonically_increasing_id()), "document-records", staged)
        first = rows.agg(F.min(F.struct("record", "_n")).alias("_first")).select("_first._n").scalar()
        lines = rows.select(F.lit(1).alias("_kind"), "record", "_n", F.concat(
            F.when(F.col("_n") == first, "").otherwise(","), F.col("record")).alias("value"))
        ends = [(0, None, None, f'{"," if i else "{"}{json.dumps(name)}:['), (2, None, None, "]}" if i == len(records) - 1 else "]")]
        lines = lines.unionByName(spark.createDataFrame(ends, "_kind int, record string, _n long, value string"))
        lines.orderBy("_kind", "record", "_n").select("value").write.mode("overwrite").text(f"{path.rstrip('/')}/{i:05d}-{_part_name(name)}")
        remove_staged(spark, staged)


def _part_path(spark: SparkSession, path: str, name: str) -> str | None:
    """The pattern of a section's folder in a document written by many tasks."""
    pattern = f"{path.rstrip('/')}/{'[0-9]' * 5}-{_part_name(name)}"
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hpath)
    return pattern if found is not None and len(found) else None


def read_document(spark: SparkSession, path: str, schemas: dict[str, T.StructType]) -> dict[str, DataFrame]:
    """The sections of a document, one row per record."""
    folders = {name: _part_path(spark, path, name) for name in schemas}
    if any(folders.values()):
        out = {}
        for name, schema in schemas.items():
            if folders[name] is None:
                out[name] = spark.createDataFrame([], schema)
                continue
            # the lines that open and close a section end or begin with a bracket
            lines = spark.read.text(folders[name]).where(F.col("value").endswith("}") & F.col("value").rlike(r"^,?\{"))
            out[name] = restore_records(lines.select(F.regexp_replace("value", "^,", "").alias("record")), schema)
        return out
    whole = T.StructType([T.StructField(n, T.ArrayType(s)) for n, s in schemas.items()])
    doc = spark.read.schema(whole).options(**JSON_OPTIONS).option("multiLine", True).json(path)
    return {name: doc.select(F.explode(name).alias("r")).select("r.*") for name in schemas}
