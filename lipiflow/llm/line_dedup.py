"""Line deduplication with DataFrame functions only: drops lines that many documents share.

Lines are keyed by two 64-bit hashes. The key rows are range-partitioned by hash with the document as a further
range column, so that a line which very many documents hold spreads over several partitions, and sorted within each
by key, document (the largest first) and position. A window streams over the sorted runs without a further exchange
and marks the first occurrence of each key in each document; only these are counted, a row for each key and
partition, and the first document of a key's runs is the one that keeps it. The operator returns a sparse bitmap of
dropped lines for each document (64 lines a word, untouched words left out), no text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .common import stored

WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line):
    """Stripped of white space at both ends, A-Z in lower case; only non-ASCII lines take the slower route."""
    bare = F.btrim(line, F.lit(WHITE))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def text_hash():
    """With the doc_id it names a row: rows that agree in both hold the same lines."""
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")


def line_keys(docs: DataFrame, min_chars: int = 40) -> DataFrame:
    """doc_id, text_hash, pos, h1, h2 of the lines whose key has at least `min_chars` code points."""
    lines = docs.select("doc_id", text_hash(), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "line"))
    keys = lines.select("doc_id", "text_hash", "pos", line_key(F.col("line")).alias("k")).where(F.length("k") >= min_chars)
    return keys.select("doc_id", "text_hash", "pos", F.xxhash64("k").alias("h1"), F.xxhash64(F.lit(7), F.reverse("k")).alias("h2"))


def first_occurrences(keys: DataFrame) -> DataFrame:
    """h1, h2, down of the first line of each key and document; down is the complement of the doc_id, so the largest comes first."""
    n = max(int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = keys.select("h1", "h2", F.bitwise_not("doc_id").alias("down"), "pos")
    runs = rows.repartitionByRange(n, "h1", "h2", "down").sortWithinPartitions("h1", "h2", "down", "pos")
    nth = F.row_number().over(Window.partitionBy("h1", "h2", "down").orderBy("pos"))
    return runs.withColumn("nth", nth).where("nth = 1").select("h1", "h2", "down")


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """doc_id, text_hash, n_dropped and drop_words: a map from word to bits, for each document that loses lines.

    A line whose key has at least `min_chars` code points and occurs in at least `min_docs` documents goes
    from all of them but the one with the largest doc_id, which keeps all its occurrences. A null text is
    one empty line. doc_id names a document: rows that repeat one count once, and each has the bitmap of its own text.
    Lines of a null doc_id count as one more document's but are never dropped. Other columns are ignored, an empty table
    gives no rows.
    """
    keys = stored(line_keys(docs, min_chars), "line-keys")  # read again for the range bounds, the counts and the bitmaps
    # a row for each key and partition, then one for each key
    shared = stored(
        first_occurrences(keys).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.min("down").alias("first")).where(F.col("n_docs") >= min_docs),
        "shared-lines",
    )
    dropped = keys.join(shared, ["h1", "h2"]).where(F.bitwise_not("doc_id") != F.col("first"))
    words = dropped.groupBy("doc_id", "text_hash", F.expr("pos div 64").cast("int").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits")
    )
    return words.groupBy("doc_id", "text_hash").agg(
        F.sum(F.bit_count("bits")).cast("bigint").alias("n_dropped"), F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("drop_words")
    )


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs' doc_id with n_lines, n_dropped and kept_text: the lines that stay, joined by newlines."""
    text = F.coalesce("text", F.lit(""))
    lines = F.split(text, "\n", -1)
    bits = lambda i: F.coalesce(F.try_element_at("drop_words", F.floor(i / 64).cast("int")), F.lit(0).cast("bigint"))
    stays = lambda line, i: F.getbit(bits(i), i % 64) == 0
    return (
        docs.select("doc_id", "text", text_hash())
        .join(bitmaps, ["doc_id", "text_hash"], "left")
        .select(
            "doc_id",
            F.size(lines).cast("bigint").alias("n_lines"),
            F.coalesce("n_dropped", F.lit(0)).cast("bigint").alias("n_dropped"),
            F.when(F.col("drop_words").isNull(), text).otherwise(F.array_join(F.filter(lines, stays), "\n")).alias("kept_text"),
        )
    )
