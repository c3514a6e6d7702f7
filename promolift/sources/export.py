"""Readers for the shop export.

Three intakes:

* ``read_export_document`` -- the original single JSON document
  ``{meta, shop, campaigns[], orders[]}`` read with a declared schema. A
  multi-line JSON document cannot be split, so one task parses it; it is the
  compatibility path for small exports.
* ``read_entity`` -- the scalable path: one JSON Lines (or Parquet) dataset
  per entity (orders with nested line items, campaigns, shop), split across
  tasks like any other file source.
* ``read_records`` -- the same JSON Lines as VARIANT records, for an intake that
  says what is wrong with a record and where.

Unknown fields are ignored (the declared schema drives parsing); absent
optional fields come back null and absent lists are defaulted to [] by the
flatten step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from ..operators.contracts import RECORD
from ..schemas import CAMPAIGN, EXPORT, ORDER, ORDER_PII_KEY, SHOP, SHOP_PII_KEYS
from ..session import materialize

ENTITY_SCHEMAS = {"orders": ORDER, "campaigns": CAMPAIGN, "shop": SHOP}
REQUIRED_TOP_LEVEL = ("shop", "campaigns", "orders")


def corrupt_schema(schema: T.StructType) -> T.StructType:
    """The schema with a column for the text of records that don't fit it."""
    return T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])


def _path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(hpath)


def require_path(spark: SparkSession, path: str) -> None:
    """Raise FileNotFoundError when the path does not exist (any Hadoop file system)."""
    if not _path_exists(spark, path):
        raise FileNotFoundError(f"no such input: {path}")


def read_export_document(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """One row per export document with columns meta, shop, campaigns, orders.

    With ``check`` the top-level contract is verified: the file exists, every
    file holds one JSON object and nothing else, and every document has shop,
    campaigns and orders (a missing key raises a ValueError naming it)."""
    require_path(spark, path)
    doc = spark.read.schema(EXPORT).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    if check:
        check_roots(document_roots(spark, path), path)
        check_top_level(doc, path)
    return doc


def document_roots(spark: SparkSession, path: str) -> DataFrame:
    """(file, root): what each file of single documents holds: ``object``,
    ``array``, ``scalar``, ``empty``, or ``text`` where it is no JSON value or
    more than one. A document is one task's work by nature; this reads it once."""
    files = spark.read.text(path, wholetext=True)
    text = F.regexp_replace("value", r"^[\s\uFEFF]+", "")
    inside = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    root = (F.when(text == "", "empty").when(inside.isNull() | (F.size(inside) != 1), "text")
            .when(text.startswith("{"), "object").when(text.startswith("["), "array").otherwise("scalar"))
    read = files.select(F.col("_metadata.file_path").alias("_read"), root.alias("root"))
    listed = spark.createDataFrame([(name,) for name in files.inputFiles()], "file string")   # empty files give no row

    def plain(name):
        return F.regexp_replace(F.url_decode(name), "^file:/+", "file:/")

    return (listed.join(read, plain("file") == plain("_read"), "left")
            .select("file", F.coalesce("root", F.lit("empty")).alias("root")))


def check_roots(roots: DataFrame, path: str = "") -> None:
    """Raise ValueError unless there is a file and every file holds one object."""
    row = roots.agg(F.count("*").alias("n"), F.min(F.when(F.col("root") != "object", F.struct("file", "root"))).alias("bad")).first()
    if row["bad"] is not None:
        raise ValueError(f"{row['bad']['file']}: expected one JSON object, found {row['bad']['root']}")
    if not row["n"]:
        raise ValueError(f"{path}: no document")


def check_top_level(doc: DataFrame, path: str = "") -> None:
    """Raise ValueError naming the first required top-level key that is
    missing (null) in any document, or if there is no document. One small
    aggregate job."""
    row = doc.agg(F.count("*").alias("_n"), *[F.count(F.when(F.col(k).isNull(), 1)).alias(k) for k in REQUIRED_TOP_LEVEL]).first()
    if not row["_n"]:
        raise ValueError(f"{path}: no document")
    for key in REQUIRED_TOP_LEVEL:
        if row[key]:
            raise ValueError(f"{path}: {row[key]} document(s) lack the top-level key '{key}'")


def document_orders(doc: DataFrame) -> DataFrame:
    """Orders of the export document(s), one row each (ORDER schema)."""
    return doc.select(F.explode("orders").alias("o")).select("o.*")


def document_campaigns(doc: DataFrame) -> DataFrame:
    """Campaigns in document order; ``campaign_pos`` keeps the position."""
    return doc.select(F.posexplode("campaigns").alias("campaign_pos", "c")).select("c.*", "campaign_pos")


def document_shop(doc: DataFrame) -> DataFrame:
    """The shop record of the export document(s)."""
    return doc.select("shop.*")


CORRUPT = "_corrupt_record"


def with_record_ok(parsed: DataFrame) -> DataFrame:
    """Replace the raw text of corrupt records by ``record_ok``: false where a
    line is no JSON object or a value doesn't fit its declared type (such values
    come back null). The raw text may hold personal data and isn't kept."""
    return parsed.withColumn("record_ok", F.col(CORRUPT).isNull()).drop(CORRUPT)


PERSONAL = frozenset((ORDER_PII_KEY, *SHOP_PII_KEYS))


def with_input_position(read: DataFrame, name: str, staged: list[str] | None = None) -> DataFrame:
    """``read`` (rows straight from a file source) with the place of each row in
    the input, from 0: files in the order of their paths, rows in that of the
    file, however the input is split.

    A row's place is the number of rows in earlier splits, from a table with one
    row per split, plus its place in its own. The rows are written once, without
    personal fields, so that ids and counts are of one reading; the path is added
    to ``staged``."""
    kept = [c for c in read.columns if c not in PERSONAL and c != "_metadata"]
    rows = materialize(read.select(
        *kept, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_row")), "positioned", staged)
    splits = rows.groupBy("_file", "_start").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)   # one row per split
    splits = splits.select("_file", "_start", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return (rows.join(F.broadcast(splits), ["_file", "_start"])
            .select(*kept, (F.col("_before") + F.col("_row") - F.col("_first")).cast("bigint").alias(name)))


def read_entity(spark: SparkSession, path: str, entity: str, fmt: str = "json", position: str | None = None,
                staged: list[str] | None = None) -> DataFrame:
    """One entity of the export as a splittable dataset (JSON Lines or Parquet).
    ``position`` names a column for each record's place in the input
    (``campaign_pos``: evidence then names campaigns in input order); personal
    fields are then dropped.

    JSON Lines come with ``record_ok``. Spark parses only the columns a query
    reads, so write all columns out (``build_clean_frames`` does) before relying
    on the flag."""
    if entity not in ENTITY_SCHEMAS:
        raise ValueError(f"unknown entity {entity!r}; expected one of {sorted(ENTITY_SCHEMAS)}")
    require_path(spark, path)
    schema = ENTITY_SCHEMAS[entity]
    if fmt not in ("json", "parquet"):
        raise ValueError(f"unsupported format {fmt!r}")
    if fmt == "json":
        read = (spark.read.schema(corrupt_schema(schema)).option("mode", "PERMISSIVE")
                .option("columnNameOfCorruptRecord", CORRUPT).json(path))
    else:
        read = spark.read.schema(schema).parquet(path)
    if position is not None:
        # the text of corrupt records may hold personal data: only the flag is written
        flag = [F.col(CORRUPT).isNull().alias("record_ok")] if fmt == "json" else []
        return with_input_position(read.select(*schema.names, *flag, "_metadata"), position, staged).drop("_metadata")
    return with_record_ok(read) if fmt == "json" else read


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """JSON Lines as they are: one VARIANT column ``record``, null for a line
    that is no JSON. Splittable like any line file. ``operators.contracts`` tells
    what is wrong with a record and gives its declared columns; the VARIANT holds
    personal fields too, so it isn't staged."""
    require_path(spark, path)
    return spark.read.option("singleVariantColumn", RECORD).option("mode", "PERMISSIVE").json(path)


def write_entity(df: DataFrame, path: str, fmt: str = "json", compression: str | None = None) -> None:
    """Write one entity as JSON Lines (ISO timestamps) or Parquet. ``compression``
    names a codec; a gzip file is read by one task, so a file per writing task of
    moderate size is best."""
    writer = df.write.mode("overwrite")
    if compression is not None:
        writer = writer.option("compression", compression)
    if fmt == "json":
        writer.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").json(path)
    else:
        writer.parquet(path)
