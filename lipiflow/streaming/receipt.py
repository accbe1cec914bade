"""Deliveries: what is refused, what was delivered before, and what is stored, at any number of stored chunks.

A chunk is known by install, stream and number. Keys lie in a table of their own, a row for each chunk, parted by a hash
of the install, so that a batch reads the keys of its own parts only; chunks are written batch by batch. A batch that is run
again after a failure overwrites what it wrote before and does not take its own keys for earlier ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import HEADER_PATTERNS
from ..sources.writers import acceptable

KEY = ["install", "stream", "seq"]
PARTS = 256


def part_of(install) -> F.Column:
    return F.pmod(F.xxhash64(install), F.lit(PARTS)).cast("int")


def well_formed(batch: DataFrame) -> DataFrame:
    """Deliveries (install, stream, seq, body) with a header of the required form and a body that is acceptable."""
    good = [F.col(c).cast("string").rlike(HEADER_PATTERNS[c]) for c in KEY]
    return acceptable(batch.where(good[0] & good[1] & good[2]))


def stored_keys(spark: SparkSession, store: str, parts: list[int], batch_id: int) -> DataFrame | None:
    """The keys of the given parts that other batches have stored, or None where there are none: no other part is read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/keys")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    keys = spark.read.schema("install string, stream string, seq long, batch long, part int").parquet(f"{store}/keys")
    return keys.where(F.col("part").isin(parts) & (F.col("batch") != batch_id)).select(*KEY)


def take(batch: DataFrame, batch_id: int, store: str) -> DataFrame:
    """Stores the chunks of a batch that are well formed and new, and returns refused, duplicate and stored, how many there were.

    Of equal chunks in a batch the least body is stored. A null header or body is refused.
    """
    spark = batch.sparkSession
    good = well_formed(batch).select("install", "stream", F.col("seq").cast("long").alias("seq"), "body")
    once = good.groupBy(*KEY).agg(F.min("body").alias("body")).withColumn("part", part_of("install"))
    received = f"{store}/received/batch={batch_id}"
    once.write.mode("overwrite").partitionBy("part").parquet(received)  # read for the parts, the join and the counts
    once = spark.read.schema("install string, stream string, seq long, body string, part int").parquet(received)
    parts = [r.part for r in once.select("part").distinct().collect()]  # PARTS at most
    known = stored_keys(spark, store, parts, batch_id) if parts else None
    fresh = once if known is None else once.join(known, KEY, "left_anti")
    fresh.withColumn("line", F.explode(F.filter(F.split("body", "\n", -1), lambda x: F.trim(x) != ""))).select(*KEY, "line").write.mode("overwrite").parquet(f"{store}/chunks/batch={batch_id}")
    fresh.select(*KEY, "part").write.mode("overwrite").partitionBy("part").parquet(f"{store}/keys/batch={batch_id}")
    own = spark.read.schema("part int").parquet(f"{store}/keys/batch={batch_id}").count()
    every, fine = batch.count(), good.count()
    counts = spark.createDataFrame([(batch_id, every - fine, fine - own, own)], "batch long, refused long, duplicate long, stored long")
    counts.write.mode("overwrite").parquet(f"{store}/receipts/batch={batch_id}")
    return counts


def receive(stream: DataFrame, store: str, checkpoint: str) -> None:
    """Takes all deliveries (install, stream, seq, body) that a stream has now."""
    stream.writeStream.foreachBatch(lambda b, i: take(b, i, store) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def chunks(spark: SparkSession, store: str) -> DataFrame:
    """install, stream, seq, line of everything stored."""
    return spark.read.schema("install string, stream string, seq long, line string").parquet(f"{store}/chunks").select(*KEY, "line")


def forget_install(spark: SparkSession, store: str, install: str) -> None:
    """Removes the lines of one install, batch by batch; its keys stay, so that a late copy of a chunk is not stored again."""
    top = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/chunks")
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    for s in fs.listStatus(top):
        path = s.getPath().toString()
        rows = spark.read.schema("install string, stream string, seq long, line string").parquet(path)
        if not rows.where(F.col("install") == install).isEmpty():
            rows.where(F.col("install") != install).write.mode("overwrite").parquet(f"{path}.new")
            fs.delete(s.getPath(), True)
            fs.rename(spark._jvm.org.apache.hadoop.fs.Path(f"{path}.new"), s.getPath())
