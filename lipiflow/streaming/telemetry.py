"""Structured Streaming: counters and request dispatch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.telemetry import hour_bucket
from ..sources.store import shared_dir


def shared_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"


def run_available(stream: DataFrame, out: str, mode: str = "append", checkpoint: str | None = None) -> None:
    """Everything that is there, once: written to `out` as Parquet, exactly once by the sink's log."""
    q = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint or f"{out}-offsets").trigger(availableNow=True).start(out)
    q.awaitTermination()


def partial_counters(commits: DataFrame) -> DataFrame:
    """install, h, counts of each micro-batch's rows; readers sum the parts, so late rows need no watermark."""
    return commits.select(
        "install", hour_bucket(F.col("ts")).alias("h"), F.lit(1).cast("bigint").alias("words"), (F.col("pos") == 0).cast("bigint").alias("top1_taken"), F.col("retyped").cast("bigint").alias("retyped")
    )


def hourly(parts: DataFrame) -> DataFrame:
    return parts.groupBy("install", "h").agg(*(F.sum(c).alias(c) for c in ("words", "top1_taken", "retyped")))


def stream_counters(commits: DataFrame) -> DataFrame:
    """Hourly counters of a finished stream: partial sums appended batch by batch and summed on reading."""
    spark = commits.sparkSession
    out = shared_folder(spark)

    def add(batch: DataFrame, batch_id: int) -> None:
        # a batch that is run again overwrites its own part
        hourly(partial_counters(batch)).write.mode("overwrite").parquet(f"{out}/parts/batch={batch_id}")

    commits.writeStream.foreachBatch(add).option("checkpointLocation", f"{out}/offsets").trigger(availableNow=True).start().awaitTermination()
    return hourly(spark.read.parquet(f"{out}/parts"))


def latest_requests(requests: DataFrame) -> DataFrame:
    """The newest request of each session; older ones are superseded."""
    return requests.groupBy("session").agg(F.max_by(F.struct("*"), "ts").alias("_r")).select("_r.*")


def dispatched(requests: DataFrame, handlers: dict) -> dict[str, DataFrame]:
    """For each op that has a handler, the handler's result on its requests."""
    return {op: f(requests.where(F.col("op") == op)) for op, f in handlers.items()}
