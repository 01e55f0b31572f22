"""Live summaries over an append-only decision log, by Structured Streaming.

The state is the last action of each image. Each trigger takes all new log files as one micro-batch, so bursts of
decisions make one summary, and every batch pushes the full summary.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from photolake import schema
from photolake.operators.review import check_actions, summary


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The log as a stream of JSON files."""
    return check_actions(spark.readStream.schema(schema.DECISION_LOG).json(path))


def latest(log: DataFrame) -> DataFrame:
    """The streaming counterpart of ``latest_decisions``, with tombstones: image_id, action, decided_at_unix."""
    last = log.groupBy("image_id").agg(F.max_by(F.struct("action", "decided_at_unix"), "seq").alias("l"))
    return last.select("image_id", "l.action", "l.decided_at_unix")


def live_decisions(log: DataFrame, name: str, checkpoint: str, **trigger) -> StreamingQuery:
    """An in-memory table ``name`` of current decisions."""
    return latest(log).where("action <> 'clear'").writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def live_summary(log: DataFrame, images: DataFrame, suggestions: DataFrame, push: Callable[[Row], None], checkpoint: str, decisions: DataFrame | None = None, **trigger) -> StreamingQuery:
    """Push the summary once at the start, of the ``decisions`` there are, and after each batch of decisions."""
    spark = images.sparkSession
    push(summary(images, suggestions, spark.createDataFrame([], schema.DECISIONS) if decisions is None else decisions).first())

    def each(batch: DataFrame, _: int) -> None:
        push(summary(images, suggestions, batch.where("action <> 'clear'")).first())

    return latest(log).writeStream.outputMode("complete").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
