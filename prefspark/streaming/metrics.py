"""The training-metric log as a stream, rolled up per time window.

The batch function and the streaming query share one aggregation
(``_rollup``), so the stream can be checked against its batch twin. Values are
aggregated as they are logged, in double precision.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefspark.functions.core import require_columns
from prefspark.session import ensure_checkpoint_dir

METRIC_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
ROLLUP_SCHEMA = "window_start timestamp_ntz, window_end timestamp_ntz, metric string, n long, sum_value double, mean_value double"


def _prepare(df: DataFrame) -> DataFrame:
    # windows are taken on the zone-less timestamp, so results do not depend on
    # the session time zone (only the watermark needs a TIMESTAMP column)
    require_columns(df, "ts", "user_id", "event_type", "value")
    return df.select("ts", F.col("user_id").alias("run"), F.col("event_type").alias("metric"), F.col("value"))


def _rollup(df: DataFrame, window: str, slide: str | None) -> DataFrame:
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    g = df.groupBy(w.alias("w"), "metric").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("sum_value"), F.avg("value").alias("mean_value"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "metric", "n",
                    "sum_value", "mean_value")


def metric_rollup(log: DataFrame, window: str = "1 day", slide: str | None = None) -> DataFrame:
    """Batch twin: per (window, metric) count, sum and mean of the logged values."""
    return _rollup(_prepare(log), window, slide)


def metric_rollup_stream(spark: SparkSession, source: str, out_path: str | None = None,
                         window: str = "1 day", watermark: str = "1 day", slide: str | None = None,
                         schema: str = METRIC_SCHEMA, max_files_per_trigger: int | None = None,
                         output_mode: str = "complete", checkpoint: str | None = None) -> DataFrame:
    """Run the rollup as a Structured Streaming query over the parquet files
    matching ``source`` (a folder, or a glob such as ``dir/events*.parquet``)
    until all available input is processed.

    ``complete``: one state row per (window, metric) (bounded by time range x
    metric count, not by rows); the last micro-batch holds the whole result, so
    the output equals the batch twin for any file order.
    ``append``: windows are emitted once the watermark passes their end and
    their state is dropped; rows older than the watermark are late and
    dropped; windows still open when the input ends are not emitted yet.

    Each micro-batch is written to its own ``epoch=<id>`` folder with
    overwrite, so a retried batch never duplicates rows. Name ``out_path`` and
    ``checkpoint`` to restart: a second call with the same two reads only what
    has arrived since. By default both are new folders under the shared
    checkpoint dir. Returns the written table.
    """
    if output_mode not in ("complete", "append"):
        raise ValueError("output_mode must be 'complete' or 'append'")
    if (out_path is None) != (checkpoint is None):
        raise ValueError("name both out_path and checkpoint, or neither")
    run = f"{ensure_checkpoint_dir(spark).rstrip('/')}/metric_rollup/{uuid.uuid4().hex[:12]}"
    out_path, checkpoint = out_path or f"{run}/table", checkpoint or f"{run}/checkpoint"
    reader = spark.readStream.schema(schema)
    if any(c in source for c in "*?["):
        reader = reader.option("basePath", source.rsplit("/", 1)[0])
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    src = (_prepare(reader.parquet(source)).withColumn("event_time", F.col("ts").cast("timestamp"))
           .withWatermark("event_time", watermark))
    if output_mode == "append":
        # state eviction needs the window on the watermarked column
        agg = _rollup(src.withColumn("ts", F.col("event_time")), window, slide).select(
            F.col("window_start").cast("timestamp_ntz").alias("window_start"),
            F.col("window_end").cast("timestamp_ntz").alias("window_end"), "metric", "n", "sum_value", "mean_value")
    else:
        agg = _rollup(src, window, slide)

    def sink(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_path}/epoch={epoch}")

    q = (agg.writeStream.outputMode(output_mode).foreachBatch(sink)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    try:
        table = spark.read.schema(f"{ROLLUP_SCHEMA}, epoch long").parquet(out_path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ROLLUP_SCHEMA)     # no micro-batch has run yet
    if output_mode == "complete":
        table = table.where(F.col("epoch") == table.agg(F.max("epoch")).first()[0])
    return table.drop("epoch")
