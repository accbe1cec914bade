"""Lexicon tables from text corpora: counts, surfaces, romanizations, key and prefix indexes, word pairs.

Every "first seen" rule is an explicit ordinal, so that results do not depend on partitions. Counts combine
before they are exchanged; top-N per group is a row_number filter, which Spark limits within each task first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.keys import key_from_roman
from ..functions.scores import corpus_score

INT_MAX = 2147483647
START = "<s>"
# Sizes of the tables.
PREFIX_TOP, ROMAN_PREFIX_CHARS, KEY_PREFIX_CHARS = 24, 3, 2
FOLLOWERS_KEPT, BIGRAM_MIN = 60, 2


def surface_counts(tokens: DataFrame, key: str = "word", surface: str = "surface", ordinal: tuple[str, ...] = ("doc_id", "pos")) -> DataFrame:
    """key, surface, n, first: how often a key was written how, and where first."""
    return tokens.groupBy(key, surface).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*ordinal)).alias("first"))


def best_surface(counts: DataFrame, key: str = "word", surface: str = "surface") -> DataFrame:
    """The most frequent surface of each key, of equals the one seen first."""
    return counts.groupBy(key).agg(F.min_by(surface, F.struct(-F.col("n"), "first")).alias("best"))


def display_words(tokens: DataFrame, register: Column, priority: tuple[str, ...] = ("chat", "subs", "wiki")) -> DataFrame:
    """word, display: the most frequent surface in the first register of `priority` that has the word, of equals the one seen first."""
    place = F.array_position(F.array(*(F.lit(r) for r in priority)), register)
    counts = tokens.withColumn("_place", place).where("_place > 0").groupBy("word", "_place", "surface").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "pos")).alias("first"))
    return counts.groupBy("word").agg(F.min_by("surface", F.struct("_place", -F.col("n"), "first")).alias("display"))


def register_counts(tokens: DataFrame, register: Column, registers: tuple[str, ...] = ("wiki", "subs", "chat"), **more: Column) -> DataFrame:
    """A row for each word with its count in each register, and `more` aggregates by name: the full outer merge of the corpora in one aggregate."""
    named = tokens.withColumn("_register", register)
    return named.groupBy("word").agg(*(F.count(F.when(F.col("_register") == r, 1)).alias(r) for r in registers), *(c.alias(name) for name, c in more.items()))


def membership(unigrams: DataFrame, min_wiki: int = 2) -> DataFrame:
    """Words of the lexicon: any count outside wiki, or at least min_wiki in it."""
    return unigrams.where((F.col("wiki") >= min_wiki) | (F.col("subs") > 0) | (F.col("chat") > 0))


def scored(unigrams: DataFrame) -> DataFrame:
    return unigrams.withColumn("score", corpus_score())


def normaliser(scored_words: DataFrame) -> DataFrame:
    """One row: total = sum of scores + 1."""
    return scored_words.agg((F.coalesce(F.sum("score"), F.lit(0)) + 1).alias("total"))


def merge_romanizations(attested: DataFrame) -> DataFrame:
    """roman, word, count, src of attestations (roman, word, count, src bit); counts stop at the largest int."""
    return attested.groupBy("roman", "word").agg(F.least(F.sum("count"), F.lit(INT_MAX)).alias("count"), F.bit_or("src").alias("src"))


def source_ranked(romans: DataFrame) -> DataFrame:
    """rank within each roman: count descending, then the word."""
    return romans.withColumn("rank", F.row_number().over(Window.partitionBy("roman").orderBy(F.desc("count"), "word")))


def key_index(words: DataFrame, level: str = "coarse") -> DataFrame:
    """words with the phonetic key, ready to be joined by it."""
    key = F.col(level) if level in words.columns else key_from_roman("word", level)
    return words.withColumn("key", key).where(F.col("key") != "")


def prefix_top(entries: DataFrame, text: str, score: str, max_chars: int | None, top: int = PREFIX_TOP, keep_whole: bool = True) -> DataFrame:
    """prefix and the `top` entries with the largest score that begin with it, for prefixes of 1 to max_chars (None: of any length).

    Entries are exploded to their prefixes, hence the lookup is an equality join whatever the prefix. Each (prefix, word)
    counts with its best score. keep_whole: an entry counts as its own prefix.
    """
    whole = F.length(text) - (0 if keep_whole else 1)
    longest = whole if max_chars is None else F.least(whole, F.lit(max_chars))
    rows = entries.where(longest >= 1).select("*", F.explode(F.sequence(F.lit(1), longest)).alias("_n")).withColumn("prefix", F.substring(F.col(text), F.lit(1), F.col("_n")))
    best = rows.groupBy("prefix", "word").agg(F.max(score).alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("prefix").orderBy(F.desc("score"), "word")))
    return ranked.where(F.col("rank") <= top)


def with_previous(tokens: DataFrame, known: DataFrame, sentence: str = "sent") -> DataFrame:
    """tokens of known words with the word before: START at a sentence's beginning, NULL after an unknown word."""
    marked = tokens.join(known.select("word", F.lit(True).alias("_known")), "word", "left")
    marked = marked.withColumn("kept", F.when(F.col("_known"), F.col("word"))).drop("_known")
    before = F.lag("kept").over(Window.partitionBy(sentence).orderBy("pos"))
    return marked.withColumn("prev", F.when(F.col("pos") == 0, F.lit(START)).otherwise(before))


def pair_counts(paired: DataFrame, ordinal: tuple[str, ...] = ("sent", "pos"), weight: Column | None = None) -> DataFrame:
    """prev, word, count, first of the pairs whose chain is whole."""
    whole = paired.where(F.col("prev").isNotNull() & F.col("kept").isNotNull())
    return whole.groupBy("prev", "word").agg(F.sum(weight if weight is not None else F.lit(1)).alias("count"), F.min(F.struct(*ordinal)).alias("first"))


def pair_totals(pairs: DataFrame) -> DataFrame:
    """prev, total: over all pairs, those that followers() prunes included."""
    return pairs.groupBy("prev").agg(F.sum("count").alias("total"))


def followers(pairs: DataFrame, keep: int = FOLLOWERS_KEPT, least: int = BIGRAM_MIN) -> DataFrame:
    order = Window.partitionBy("prev").orderBy(F.desc("count"), "first")
    return pairs.withColumn("rank", F.row_number().over(order)).where((F.col("rank") <= keep) & (F.col("count") >= least))


def without_held_out(rows: DataFrame, held: DataFrame, *columns: str) -> DataFrame:
    """rows of which none of the columns is in held's only column."""
    name = held.columns[0]
    for c in columns:
        rows = rows.join(held.select(F.col(name).alias(c)), c, "left_anti")
    return rows


def build_meta(**tables: DataFrame) -> DataFrame:
    """A row for each table with its row count."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows"))
        out = row if out is None else out.union(row)
    return out
