"""Writers: sorted tables, reports, chunks, and the guards around them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

# Fixed values.
MIN_TUNE_ITEMS, BODY_BYTES = 2000, 1 << 20


def sorted_table(df: DataFrame, path: str, *keys: str, partitions: int | None = None) -> None:
    """Range-partitioned and sorted by the keys, so that a lookup reads few row groups."""
    ranged = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    ranged.sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def result_json(df: DataFrame, path: str) -> None:
    """A report, over the one of the same name."""
    df.write.mode("overwrite").json(path)


def reviewed_feedback(misses: DataFrame, path: str) -> None:
    """roman, gold, tags, installs of shared misses, as JSON lines for review."""
    misses.select("roman", F.array("chose").alias("gold"), F.array(F.lit("telemetry")).alias("tags"), "installs").write.mode("overwrite").json(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def acceptable(batch: DataFrame, body: str = "body") -> DataFrame:
    """The deliveries whose body is at most BODY_BYTES long and has at least one line, each a JSON object; blank lines do not count."""
    lines = F.filter(F.split(F.col(body), "\n", -1), lambda x: F.trim(x) != "")
    one = lambda x: F.coalesce(F.schema_of_variant(F.try_parse_json(x)).startswith("OBJECT"), F.lit(False))
    return batch.where((F.octet_length(body) <= BODY_BYTES) & (F.size(lines) > 0) & F.forall(lines, one))


def spaced_json(df: DataFrame):
    """A row as a JSON object with a space after each colon and comma between its columns, as the clients write their lines; nulls are left out."""
    value = lambda c: F.regexp_replace(F.to_json(F.array(F.col(f"`{c}`"))), r"^\[|\]$", "")
    one = lambda c: F.when(F.col(f"`{c}`").isNotNull(), F.concat(F.lit(json.dumps(c, ensure_ascii=False) + ": "), value(c)))
    return F.concat(F.lit("{"), F.concat_ws(", ", *map(one, df.columns)), F.lit("}"))


def export_lines(rows: DataFrame, path: str) -> None:
    """One JSON object a line with _install and _chunk, a file for each install."""
    rows.select(spaced_json(rows).alias("value"), "install").write.partitionBy("install").mode("overwrite").text(path)


def save_features(candidates: DataFrame, items: DataFrame, path: str) -> None:
    """The tuner's cache: a JSON line for each item (q, set, roman, golds, weight) with its candidates' features (q, word, ..) in order of the word."""
    features = [c for c in candidates.columns if c != "q"]
    entry = F.struct("word", *(c for c in features if c != "word"))
    lists = candidates.groupBy("q").agg(F.sort_array(F.collect_list(entry)).alias("cands"))
    items.join(lists, "q", "left").select("set", "roman", "golds", "weight", F.coalesce("cands", F.array()).alias("cands")).write.mode("overwrite").json(path)


def purge(spark: SparkSession, path: str) -> bool:
    """Removes a stored table; whether there was one."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True))


def save_weights(weights: dict[str, float], path: str, items: int, force: bool = False) -> None:
    """Refuses weights that were tuned on too few items."""
    if items < MIN_TUNE_ITEMS and not force:
        raise ValueError(f"tuned on {items} items, fewer than {MIN_TUNE_ITEMS}; not saved")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(dict(sorted(weights.items())), f, indent=2)
