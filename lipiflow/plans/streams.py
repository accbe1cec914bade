"""Queries that run a table as a finished file stream; their SQL is that of the batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import keyed as K, telemetry as S
from ..operators.telemetry import hour_bucket
from .usage import COMMITS, NOW
from ..functions.scores import HALF_LIFE_DAYS, decayed

QUERIES, ORACLE_SQL = {}, {}


def _stream(spark, d):
    """The driver's events as a stream of one file, as commits."""
    path = f"{d}/events.parquet"
    schema = spark.read.parquet(path).schema
    # a glob may name a file or a folder
    e = spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    return e.select(F.col("user_id").alias("install"), "ts", F.concat("event_type", (F.col("k") % 7).cast("string")).alias("roman"), (F.col("k") % 5).alias("pos"), (F.col("event_type") == "error").alias("retyped"), "event_type")


def stream_hourly_counters(spark, d):
    return S.stream_counters(_stream(spark, d))


def stream_decayed_state(spark, d):
    t = F.unix_micros(F.to_timestamp_ltz(F.col("ts").cast("string"))) / 1e6
    commits = _stream(spark, d).where("event_type IN ('purchase', 'click')").select("install", "roman", F.col("roman").alias("word"), t.alias("t"), F.lit(False).alias("forget"))
    checkpoint = S.shared_folder(spark)
    K.learn(commits, checkpoint)
    return K.learned(spark, checkpoint).select("install", "roman", F.round(decayed("count", "last", F.lit(NOW)), 6).alias("count"), F.round("last", 3).alias("last"))


def stream_flushed_counters(spark, d):
    """Counters as installs flush them: parts of at most twenty words, the last of each install asked for at the end; summed up."""
    commits = _stream(spark, d).withColumn("h", hour_bucket(F.col("ts"))).select("install", "h", "ts", (F.col("pos") == 0).alias("top1_taken"), "retyped", F.lit(False).alias("flush"))
    last = commits.select("install", "h", F.lit(None).cast("timestamp").alias("ts"), F.lit(False).alias("top1_taken"), F.lit(False).alias("retyped"), F.lit(True).alias("flush"))
    out = S.shared_folder(spark)
    with K.on_disk(spark):
        S.run_available(K.flushed(commits.withColumn("ts", F.col("ts").cast("timestamp")).union(last)), out)
    parts = spark.read.parquet(out)
    return parts.groupBy("install", "h").agg(*(F.sum(c).alias(c) for c in ("words", "top1_taken", "retyped")), (F.max("words") <= K.FLUSH_EVERY).alias("in_parts"))


QUERIES |= {"stream_hourly_counters": stream_hourly_counters, "stream_decayed_state": stream_decayed_state, "stream_flushed_counters": stream_flushed_counters}
ORACLE_SQL |= {
    "stream_hourly_counters": f"WITH {COMMITS} SELECT install, h, count(*)::BIGINT AS words, count(*) FILTER (pos = 0)::BIGINT AS top1_taken, count(*) FILTER (retyped)::BIGINT AS retyped FROM com GROUP BY install, h",
    "stream_flushed_counters": f"WITH {COMMITS} SELECT install, h, count(*)::BIGINT AS words, count(*) FILTER (pos = 0)::BIGINT AS top1_taken, count(*) FILTER (retyped)::BIGINT AS retyped, true AS in_parts FROM com GROUP BY install, h",
    "stream_decayed_state": f"WITH {COMMITS} SELECT install, roman, round(sum(exp(-ln(2) / ({HALF_LIFE_DAYS} * 86400) * greatest(0, {NOW} - t))), 6) AS count, round(max(t), 3) AS last FROM com WHERE app IN ('purchase', 'click') GROUP BY install, roman",
}
