"""Incremental intake of export order files with Structured Streaming.

New JSON Lines files of nested orders are parsed with the declared schema,
stripped of personal data, flattened to line items and costed (order net
revenue folded from each order's own nested lines, so allocation needs
neither a shuffle nor streaming state), then appended to a Parquet
line-margin table. The checkpoint folder records which files were processed,
so a restarted or re-triggered run picks up only new files and a lost
executor just re-runs its micro-batch tasks.

Whole-dataset statistics (window length, tertiles, margin bands, verdicts)
are recomputed in batch from the appended table by ``PromoPipeline``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import flatten as FL
from ..operators import metrics as M
from ..operators import privacy as PV
from ..operators import validate as V
from ..schemas import ORDER, REQUIRED_FIELDS
from ..session import staging_path
from ..sources import export as EX


def line_margin_stream(spark: SparkSession, orders_source: str, max_files_per_trigger: int | None = None
                       ) -> DataFrame:
    """Streaming DataFrame of costed line items from nested order files."""
    good = order_stream(spark, orders_source, max_files_per_trigger).where("_fits").drop("_fits")
    items = FL.to_lineitems(good, with_order_net=True)
    return M.prepare_line_margin(items).select(*M.LINE_MARGIN_COLUMNS)


def order_stream(spark: SparkSession, orders_source: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming minimized orders with ``_fits``: false for a record that
    doesn't parse or lacks a required field, which must not reach the metrics."""
    reader = (spark.readStream.schema(EX.corrupt_schema(ORDER)).option("mode", "PERMISSIVE")
              .option("columnNameOfCorruptRecord", EX.CORRUPT))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    orders = PV.minimize_orders(EX.with_record_ok(reader.json(orders_source)))
    fits = F.col("record_ok")
    for rule in V.required_rules(REQUIRED_FIELDS["orders"]).values():
        fits &= ~rule

    def lacks_field(li):
        lacks = F.lit(False)
        for name in REQUIRED_FIELDS["lineitems"]:
            lacks |= li[name].isNull()
        return lacks

    fits &= ~F.exists(F.coalesce("line_items", F.array().cast(ORDER["line_items"].dataType)), lacks_field)
    return orders.withColumn("_fits", fits).drop("record_ok")


def start_quarantine_ingest(spark: SparkSession, orders_source: str, sink_path: str,
                            checkpoint_path: str | None = None) -> StreamingQuery:
    """Append what ``line_margin_stream`` leaves out to ``sink_path`` (Parquet):
    id, shop and file of each bad order; its raw text isn't kept."""
    checkpoint_path = checkpoint_path or staging_path(spark, "quarantine-checkpoint")
    bad = order_stream(spark, orders_source).where("NOT _fits").select(
        "id", "shop_id", F.size("line_items").alias("n_parsed_lines"), F.input_file_name().alias("file"))
    return (bad.writeStream.format("parquet").option("checkpointLocation", checkpoint_path).outputMode("append")
            .trigger(availableNow=True).start(sink_path))


def start_line_margin_ingest(spark: SparkSession, orders_source: str, sink_path: str,
                             checkpoint_path: str | None = None, available_now: bool = True) -> StreamingQuery:
    """Append costed line items to ``sink_path`` (Parquet). ``available_now``
    processes every unprocessed file and stops; otherwise runs continuously."""
    checkpoint_path = checkpoint_path or staging_path(spark, "stream-checkpoint")
    writer = (line_margin_stream(spark, orders_source).writeStream.format("parquet")
              .option("checkpointLocation", checkpoint_path).outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start(sink_path)
