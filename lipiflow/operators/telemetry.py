"""Usage telemetry: hourly counters, chunks, sharing rules and the report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.metrics import pct, percentile_telemetry
from ..functions.text import clean_app, is_recordable

# Fixed values.
LAST_POSITION, MIN_INSTALLS, EXPORT_BYTES = 9, 2, 64 << 20


def hour_bucket(ts) -> F.Column:
    return F.date_format(F.date_trunc("HOUR", ts), "yyyy-MM-dd'T'HH")


def struggles(commits: DataFrame) -> DataFrame:
    """Commits worth an event: not the first choice or retyped, and private enough to keep."""
    shown = (F.col("we_said") == "") | is_recordable("roman", "we_said")
    return commits.where(((F.col("pos") > 0) | F.col("retyped")) & is_recordable("roman", "chose") & shown)


def hourly_counters(commits: DataFrame) -> DataFrame:
    """install, h, words, top1_taken, retyped, counters (position and app names to counts), lat_p50, lat_p95, lat_n."""
    named = commits.select("install", "h", F.explode(F.array(F.concat(F.lit("pos_"), F.least(F.col("pos"), F.lit(LAST_POSITION))), F.concat(F.lit("app_"), clean_app("app")))).alias("name"))
    counts = named.where("name <> 'app_'").groupBy("install", "h", "name").agg(F.count(F.lit(1)).alias("n"))
    maps = counts.groupBy("install", "h").agg(F.map_from_entries(F.collect_list(F.struct("name", "n"))).alias("counters"))
    latencies = F.sort_array(F.collect_list("latency"))
    core = commits.groupBy("install", "h").agg(
        F.count(F.lit(1)).alias("words"), F.count_if(F.col("pos") == 0).alias("top1_taken"), F.count_if("retyped").alias("retyped"), latencies.alias("_l")
    )
    core = core.withColumn("lat_p50", percentile_telemetry("_l", 0.5)).withColumn("lat_p95", percentile_telemetry("_l", 0.95)).withColumn("lat_n", F.size("_l").cast("bigint")).drop("_l")
    return core.join(maps, ["install", "h"], "left")


def install_health(metrics: DataFrame, events: DataFrame) -> DataFrame:
    """install, words, top1_pct, retyped, unweighted mean latencies over the rows that have them, misses, friction."""
    m = metrics.groupBy("install").agg(
        F.sum("words").alias("words"), F.sum("top1_taken").alias("top1"), F.sum("retyped").alias("retyped"), F.avg("lat_p50").alias("lat_p50"), F.avg("lat_p95").alias("lat_p95")
    )
    e = classified(events).groupBy("install").agg(F.count_if(F.col("kind") == "miss").alias("misses"), F.count_if(F.col("kind") == "friction").alias("friction"))
    out = m.join(e, "install", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("install", "words", F.round(pct("top1", "words"), 6).alias("top1_pct"), "retyped", F.round("lat_p50", 6).alias("lat_p50"), F.round("lat_p95", 6).alias("lat_p95"), zero("misses"), zero("friction"))


def classified(events: DataFrame) -> DataFrame:
    """kind: miss where another than the first choice was taken, else friction; rows without roman or word go."""
    return events.where("roman <> '' AND chose <> ''").withColumn("kind", F.when(F.col("pos") > 0, "miss").otherwise("friction"))


def shared_misses(events: DataFrame, min_installs: int = MIN_INSTALLS) -> DataFrame:
    """roman, chose, installs, we_said (the most frequent, of equals the least) of misses that enough installs share."""
    misses = classified(events).where("kind = 'miss'")
    # installs and wordings are distinct groups first, so that no set is held for a pair
    installs = misses.select("roman", "chose", "install").distinct().groupBy("roman", "chose").agg(F.count(F.lit(1)).alias("installs")).where(F.col("installs") >= min_installs)
    said = misses.where("we_said <> ''").groupBy("roman", "chose", "we_said").agg(F.count(F.lit(1)).alias("n"))
    mode = said.groupBy("roman", "chose").agg(F.min_by("we_said", F.struct(-F.col("n"), "we_said")).alias("we_said"))
    return installs.join(mode, ["roman", "chose"], "left")


def position_histogram(events: DataFrame) -> DataFrame:
    return classified(events).where("kind = 'miss'").groupBy("pos").agg(F.count(F.lit(1)).alias("n"))


def friction_top(events: DataFrame, n: int = 12) -> DataFrame:
    counts = classified(events).where("kind = 'friction'").groupBy("roman", "chose").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "roman", "chose").limit(n)


def chunk_dedup(chunks: DataFrame) -> DataFrame:
    """The first arrival of each (install, stream, seq)."""
    return chunks.groupBy("install", "stream", "seq").agg(F.min_by(F.struct("*"), "arrival").alias("_first")).select("_first.*")


def export(rows: DataFrame, since: str, cap_bytes: int = EXPORT_BYTES, order: tuple[str, ...] = ("chunk", "line_no")) -> DataFrame:
    """Lines of hour `since` and later within the byte cap of each install, and whether the install was cut short.

    The cap is this export's feature. Running sizes are kept for each install, whose export is a file of its own.
    """
    sized = rows.where(F.col("h") >= since).withColumn("_b", F.octet_length("line") + 1)
    run = Window.partitionBy("install").orderBy(*order)
    sized = sized.withColumn("_upto", F.sum("_b").over(run.rowsBetween(Window.unboundedPreceding, 0)))
    return sized.withColumn("truncated", F.max("_upto").over(Window.partitionBy("install")) > cap_bytes).where(F.col("_upto") <= cap_bytes).drop("_b", "_upto")
