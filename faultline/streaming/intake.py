"""Streams of requests: order, routes, idempotent results, accumulated training triggers."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TRAIN_ROUTE = "train_models"


def priority(timestamp: Column, default: Column) -> Column:
    """The millisecond time in a header, with or without an ``L``; messages without one get the default."""
    return F.coalesce(F.regexp_replace(timestamp, "[lL]$", "").try_cast("bigint"), default.cast("bigint"))


def routed(messages: DataFrame, training: bool) -> DataFrame:
    """Training requests, or all others."""
    return messages.where((F.col("route") == TRAIN_ROUTE) == F.lit(training))


def placed(messages: DataFrame, folder: str) -> DataFrame:
    """Adds ``place``, from 1, by (priority, number) over all messages, without one task for all of them.

    Messages are written in ranges of the priority; ranks in a range are added to the
    counts of the ranges before it.
    """
    cut = messages.repartitionByRange(F.col("priority"), F.col("number")).sortWithinPartitions("priority", "number")
    path = f"{folder}/placed-{uuid.uuid4().hex}"
    cut.withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    rows = messages.sparkSession.read.parquet(path).withColumn("_part", F.shiftright("_at", 33))
    counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = counts.select("_part", before.alias("_base"))  # one row per range
    return rows.join(bases, "_part").withColumn("place", F.col("_base") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_at", "_part", "_base")


def retried(route: str, error: Exception) -> bool:
    """Whether a failed request is worth another attempt; what can't succeed is not."""
    text = str(error)
    hopeless = {"item_remove": "no document was found", "remove_by_launch_start_time": "no such index", TRAIN_ROUTE: "contains NaN"}
    return hopeless.get(route, "\0") not in text


def process(messages: DataFrame, handlers: dict[str, Callable[[DataFrame], DataFrame]], results: str, checkpoint: str, max_attempts: int = 3, retry: Callable[[str, Exception], bool] = retried, seconds: float = 600.0, files_a_batch: int | None = None):
    """Runs each batch's messages by route, in order of priority, and writes replies with their correlation ids.

    A handler gets the rows of its route and gives (number, reply); if ``messages`` has a
    ``correlation_id``, replies carry that of their message.  A handler that fails is run
    again up to ``max_attempts`` times while ``retry`` says so and no longer than
    ``seconds``; then its messages are answered by the error.  A batch that is replayed
    overwrites its own replies, so each message counts once.
    """

    def run(batch: DataFrame, number: int) -> None:
        for route, handler in handlers.items():
            rows = batch.where(F.col("route") == route)
            ids = rows.select("number", *[c for c in ("correlation_id",) if c in rows.columns])
            out, began = f"{results}/route={route}/batch={number}", time.monotonic()
            for attempt in range(1, max_attempts + 1):
                try:
                    handler(rows.orderBy("priority", "number")).join(ids, "number").withColumn("attempt", F.lit(attempt)).write.mode("overwrite").parquet(out)
                    break
                except Exception as error:  # any failure of a handler is answered, the stream goes on
                    if attempt == max_attempts or not retry(route, error) or time.monotonic() - began > seconds:
                        ids.select("number", F.lit(None).cast("string").alias("reply"), *ids.columns[1:], F.lit(attempt).alias("attempt"), F.lit(str(error)[:500]).alias("error")).write.mode("overwrite").parquet(out)
                        break

    return messages.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def train_requests(indexed: DataFrame) -> DataFrame:
    """(route, project, body): for each project that had items indexed, a request to train each model.

    ``indexed`` has (project, indexed).
    """
    kinds = F.explode(F.array(*[F.lit(k) for k in ("suggestion", "auto_analysis", "defect_type")]))
    rows = indexed.where("indexed > 0").select("project", F.col("indexed").alias("gathered_metric_total"), kinds.alias("model_type"))
    return rows.select(F.lit(TRAIN_ROUTE).alias("route"), "project", F.to_json(F.struct("model_type", "project", "gathered_metric_total")).alias("body"))


def gathered_totals(spark: SparkSession, path: str, schema: StructType, folder: str) -> DataFrame:
    """(project, gathered): errors per project so far, kept as the state of a stream that reads all files there are."""
    name = f"gathered_{uuid.uuid4().hex}"
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path)
    totals = rows.groupBy((F.col("user_id") % 4).alias("project")).agg(F.sum((F.col("event_type") == "error").cast("long")).alias("gathered"))
    table = f"{folder}/{name}/totals"
    query = totals.writeStream.outputMode("complete").foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(table)).option("checkpointLocation", f"{folder}/{name}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(table)
