"""The likeliest next words that some typed letters could begin, with their share of all the words that fit.

Words stand in the order of their phonetic keys, so that those which typed letters could begin are one contiguous range.
A range's probability is a difference of two running sums; these are read off for all typed keys in one sort, in which
each key's two ends lie between the words. The words that have followed the one before add what was counted for
them. No query meets the words of its range one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.store import stored
from .evaluate import running_sums
from .lexicon import prefix_top

#: Weight of the words' general frequency beside what was counted after the word before.
GENERAL = 0.1
#: Letters by which words that followed are met: longer keys are held against the range.
HEAD = 2
LAST = "\U0010ffff"


def offered_words(words: DataFrame, allowed: Column, score: str = "score") -> DataFrame:
    """word, key, p of the words (word, key, score) that may be offered: shares of their scores. Others have no probability at all."""
    rows = words.where(allowed & (F.col(score) > 0)).select("word", "key", F.col(score).alias("_s"))
    total = rows.agg(F.sum("_s").alias("_all"))
    return rows.crossJoin(F.broadcast(total)).select("word", "key", (F.col("_s") / F.col("_all")).alias("p"))


def key_ranges(typed: DataFrame, words: DataFrame) -> DataFrame:
    """typed, general: the probability of all words (word, key, p) whose key begins with typed, for distinct keys typed."""
    ends = typed.select("typed", F.inline(F.array(F.struct(F.col("typed").alias("key"), F.lit(0).alias("end")), F.struct(F.concat("typed", F.lit(LAST)).alias("key"), F.lit(1).alias("end")))))
    # both ends of a range stand before the words that have their key
    line = words.select("key", F.lit(2).alias("end"), F.lit(None).cast("string").alias("typed"), "p").unionByName(ends.withColumn("p", F.lit(0.0)))
    sums = running_sums(line, ["key", "end"], "p").where("typed IS NOT NULL")
    return sums.groupBy("typed").agg((F.max("_sum") - F.min("_sum")).alias("general"))


def best_within(asked: DataFrame, pairs: DataFrame, totals: DataFrame, words: DataFrame, k: int, general: float = GENERAL) -> DataFrame:
    """prev, typed, word, share, rank: for each distinct prev and typed key, the k likeliest of the words whose key begins with it.

    A word's probability after prev is general * p + (1 - general) * count / total, and p where prev was never seen; share is
    that over the sum of the whole range. words: word, key, p as offered_words gives them; pairs: prev, word, count; totals: prev,
    total, over all pairs, of words that are never offered too. Any word fits an empty key. Equal shares go to the lesser word.
    """
    asked = stored(asked.select("prev", "typed").distinct(), "asked-within")  # made once: it is met four times
    keys = asked.select("typed").distinct()
    seen = pairs.join(words, "word").join(totals, "prev").select("prev", "word", "key", "p", (F.col("count") / F.col("total")).alias("told"))
    heads = seen.select("*", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(HEAD)), lambda i: F.substring(F.col("key"), F.lit(1), i)))).alias("head"))
    mine = asked.withColumn("head", F.substring("typed", 1, HEAD)).join(heads, ["prev", "head"]).where(F.col("key").startswith(F.col("typed")))
    mine = mine.select("prev", "typed", "word", "p", "told")
    known = asked.join(totals.select("prev", F.lit(True).alias("known")), "prev", "left").join(key_ranges(keys, words), "typed")
    told = mine.groupBy("prev", "typed").agg(F.sum("told").alias("all_told"))
    mass = known.join(told, ["prev", "typed"], "left").select(
        "prev", "typed", F.coalesce("known", F.lit(False)).alias("known"),
        F.when(F.col("known"), general * F.col("general") + (1 - general) * F.coalesce("all_told", F.lit(0.0))).otherwise(F.col("general")).alias("mass"),
    )
    # words that did not follow keep their general order: of them, only the k first of a range can be among the k best
    empty = words.select("word", F.lit("").alias("prefix"), "p")
    top = prefix_top(words, "key", "p", None, k).select("prefix", "word", F.col("score").alias("p"))
    first = empty.orderBy(F.desc("p"), "word").limit(k)
    rest = asked.join(top.unionByName(first).withColumnRenamed("prefix", "typed"), "typed").select("prev", "typed", "word", "p", F.lit(0.0).alias("told"))
    best = mine.unionByName(rest).groupBy("prev", "typed", "word").agg(F.max("p").alias("p"), F.max("told").alias("told")).join(mass, ["prev", "typed"])
    own = F.when(F.col("known"), general * F.col("p") + (1 - general) * F.col("told")).otherwise(F.col("p"))
    ranked = best.withColumn("own", F.round(own, 12)).withColumn("rank", F.row_number().over(Window.partitionBy("prev", "typed").orderBy(F.desc("own"), "word")))
    return ranked.where(F.col("rank") <= k).select("prev", "typed", "word", (F.col("own") / F.col("mass")).alias("share"), "rank")


def predictor_tally(tested: DataFrame, guesses: DataFrame, bar: float = 0.5) -> DataFrame:
    """letters, spelled, asked, first_right, either_right, shown, shown_right: guesses held against what was written.

    tested: prev, typed, letters, word, spelled, n (how often); guesses: prev, typed, word, share, rank, of which the two best
    count. A guess is shown when its share is at least the bar. spelled 'yes' counts correctly spelt words only, 'all' every word.
    """
    two = guesses.where("rank <= 2").groupBy("prev", "typed").agg(
        F.max(F.when(F.col("rank") == 1, F.col("word"))).alias("one"), F.max(F.when(F.col("rank") == 2, F.col("word"))).alias("two"), F.max(F.when(F.col("rank") == 1, F.round("share", 9))).alias("share")
    )
    rows = tested.join(two, ["prev", "typed"], "left").withColumn("spelled", F.explode(F.when(F.col("spelled"), F.array(F.lit("all"), F.lit("yes"))).otherwise(F.array(F.lit("all")))))
    right = lambda c: F.coalesce(F.col(c) == F.col("word"), F.lit(False))
    shown = F.coalesce(F.col("share") >= bar, F.lit(False))
    total = lambda when, name: F.sum(F.when(when, F.col("n")).otherwise(0)).cast("bigint").alias(name)
    return rows.groupBy("letters", "spelled").agg(
        F.sum("n").cast("bigint").alias("asked"), total(right("one"), "first_right"), total(right("one") | right("two"), "either_right"), total(shown, "shown"), total(shown & right("one"), "shown_right")
    )
