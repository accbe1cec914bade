"""Next-word prediction from word pairs, its gates, audits and studies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.keys import key_from_roman
from ..sources.store import stored

# Fixed values.
FOLLOWERS_READ, MIN_SHARE, CONTEXT_WORDS = 300, 0.2, 3
THRESHOLDS = (0.0, 0.05, 0.1, 0.2, 0.3, 0.5)
PLACEHOLDER_WORDS = ("ইউজার",)


def offered(followers: DataFrame, excluded: tuple[str, ...] = PLACEHOLDER_WORDS) -> DataFrame:
    """followers (prev, word, count) that may be shown; their counts stay in the totals."""
    return followers.where(~F.col("word").isin(*excluded)) if excluded else followers


def ranked_followers(followers: DataFrame, k: int = FOLLOWERS_READ) -> DataFrame:
    order = Window.partitionBy("prev").orderBy(F.desc("count"), "word")
    return followers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def next_words(followers: DataFrame, totals: DataFrame, k: int = 3, min_share: float = MIN_SHARE) -> DataFrame:
    """prev, word, share, rank for the words whose best follower has at least min_share of the un-pruned total."""
    rows = ranked_followers(followers).join(totals, "prev").withColumn("share", F.col("count") / F.col("total"))
    best = F.max("share").over(Window.partitionBy("prev"))
    return rows.withColumn("_best", best).where((F.col("_best") >= min_share) & (F.col("rank") <= k)).drop("_best")


def next_completions(typed: DataFrame, followers: DataFrame, k: int = 2) -> DataFrame:
    """prev, roman, word, share: followers whose phonetic key begins with the typed letters' key, shares of those that fit.

    Keys are made once for each distinct word. Followers are cut to the best k of each beginning of a key before any typed
    letters meet them, so that a word with very many letters typed after it is looked up, not held against all that follow.
    """
    with_key = lambda rows, c, out: rows.join(stored(rows.select(c).distinct().withColumn(out, key_from_roman(c)), "next-keys"), c)
    ends = with_key(ranked_followers(followers).select("prev", "word", "count"), "word", "_key").where("_key <> ''")
    ends = ends.select("prev", "word", "count", F.explode(F.transform(F.sequence(F.lit(1), F.length("_key")), lambda i: F.substring(F.col("_key"), F.lit(1), i))).alias("_typed"))
    group = Window.partitionBy("prev", "_typed")
    rows = ends.withColumn("share", F.col("count") / F.sum("count").over(group)).withColumn("place", F.row_number().over(group.orderBy(F.desc("count"), "word")))
    return with_key(typed.where("roman IS NOT NULL"), "roman", "_typed").join(rows.where(F.col("place") <= k), ["prev", "_typed"]).select("prev", "roman", "word", "share", "place")


def audit(followers: DataFrame, totals: DataFrame, min_share: float) -> DataFrame:
    """Word that would be suggested, how often its contexts occur, and after how many words."""
    best = followers.groupBy("prev").agg(F.max_by("word", F.struct("count", "word")).alias("word"), F.max("count").alias("count"))
    shown = best.join(totals, "prev").where(F.col("count") / F.col("total") >= min_share)
    return shown.groupBy("word").agg(F.sum("total").alias("seen"), F.count(F.lit(1)).alias("after_words"))


def thresholds(tested: DataFrame, followers: DataFrame, totals: DataFrame, k: int = 3, values: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """For each threshold: positions, those that show a suggestion, and those whose word is among the k best."""
    top = ranked_followers(followers, k).groupBy("prev").agg(F.collect_list("word").alias("words"), F.max("count").alias("_top"))
    rows = tested.join(top.join(totals, "prev").select("prev", "words", (F.col("_top") / F.col("total")).alias("share")), "prev", "left")
    grid = rows.sparkSession.createDataFrame([(float(t),) for t in values], "threshold double")
    shown = F.coalesce(F.col("share") >= F.col("threshold"), F.lit(False))
    flagged = rows.crossJoin(F.broadcast(grid)).select("threshold", shown.alias("shown"), (shown & F.array_contains("words", F.col("word"))).alias("hit"))
    return flagged.groupBy("threshold").agg(F.count(F.lit(1)).alias("positions"), F.count_if("shown").alias("shown"), F.count_if("hit").alias("right"))


def prequential(paired: DataFrame, stream: str = "conv", order: tuple[str, ...] = ("sent", "pos")) -> DataFrame:
    """before: how often this pair, prev_before: how often this prev, occurred earlier in the stream."""
    past = lambda *by: F.count(F.lit(1)).over(Window.partitionBy(stream, *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return paired.withColumn("before", past("prev", "word")).withColumn("prev_before", past("prev"))


def blended(global_shares: DataFrame, personal: DataFrame, weight: float, k: int) -> DataFrame:
    """prev, word, score, rank: global share + weight * share of the personal counts (prev, word, n)."""
    mine = personal.withColumn("_s", weight * F.col("n") / F.sum("n").over(Window.partitionBy("prev"))).select("prev", "word", "_s")
    both = global_shares.select("prev", "word", F.col("share").alias("_s")).unionByName(mine).groupBy("prev", "word").agg(F.round(F.sum("_s"), 9).alias("score"))
    order = Window.partitionBy("prev").orderBy(F.desc("score"), "word")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def context(sentence: str = "sent", words: int = CONTEXT_WORDS, word: str = "word") -> Column:
    """Array of the words before, at most `words`."""
    return F.collect_list(word).over(Window.partitionBy(sentence).orderBy("pos").rowsBetween(-words, -1))


def merged(base: Column, predicted: Column, start: int | Column, n: int | Column, k: int) -> Column:
    """base with up to n predicted words put in after its first `start`, without repeats, k in all. Arrays of match keys."""
    start, n = (x if isinstance(x, Column) else F.lit(x) for x in (start, n))
    head = F.slice(base, F.lit(1), start)
    extra = F.slice(F.filter(predicted, lambda w: ~F.array_contains(head, w)), F.lit(1), n)
    rest = F.filter(F.slice(base, start + 1, F.size(base)), lambda w: ~F.array_contains(extra, w))
    return F.slice(F.concat(head, extra, rest), 1, k)


def arranged(base: Column, guess: Column, typed: Column, k: int, readings_kept: int = 3) -> Column:
    """The list shown: the typed Latin takes the last place unless it is seen anyway, a model's guess never one of the first three."""
    shown = F.array_contains(F.slice(base, 1, max(k - 1, 0)) if k > 1 else F.array().cast("array<string>"), typed)
    reserve = (typed != "") & ~shown
    slots = F.lit(k) - F.when(reserve, F.lit(1 if k > 1 else 0)).otherwise(F.lit(0))
    own = F.when(guess.isNotNull() & (guess != typed), guess)
    items = F.when(reserve, F.filter(base, lambda w: w != typed)).otherwise(base)
    add = own.isNotNull() & ~F.coalesce(F.array_contains(F.slice(items, F.lit(1), slots), own), F.lit(False)) & (slots > readings_kept)
    listed = F.when(add, F.concat(F.slice(F.filter(items, lambda w: w != own), F.lit(1), slots - 1), F.array(own))).otherwise(F.slice(items, F.lit(1), slots))
    return F.when(reserve, F.concat(listed, F.array(typed))).otherwise(listed)


def guess_pick(share: Column, word: Column, first: Column, typed: Column, least: float) -> Column:
    """A guess that is worth showing: confident, not the first choice, not what was typed."""
    return F.when((share >= least) & (word != first) & (word != typed), word)


def worth_refining(partial: Column, strong: Column) -> Column:
    return partial & ~strong


def letter_study(tested: DataFrame, followers: DataFrame, max_letters: int, bars: tuple[float, ...]) -> DataFrame:
    """letters, bar, positions, shown, right, saved: predicting tested (prev, word) from the first typed letters.

    A guess is shown when its share among the followers that fit is at least the bar; a right one saves the letters left.
    Guesses are made once for each distinct (prev, letters), then joined to the positions.
    """
    typed = tested.select("prev", "word", F.explode(F.sequence(F.lit(1), F.lit(max_letters))).alias("letters")).where(F.col("letters") < F.length("word"))
    typed = typed.withColumn("roman", F.substring(F.col("word"), F.lit(1), F.col("letters")))
    guesses = next_completions(typed.select("prev", "roman").distinct(), followers, 1).select("prev", "roman", F.col("word").alias("guess"), "share")
    grid = typed.sparkSession.createDataFrame([(float(b),) for b in bars], "bar double")
    rows = typed.join(guesses, ["prev", "roman"], "left").crossJoin(F.broadcast(grid))
    shown = F.coalesce(F.round("share", 9) >= F.col("bar"), F.lit(False))
    flagged = rows.select("letters", "bar", shown.alias("shown"), (shown & (F.col("guess") == F.col("word"))).alias("right"), (F.length("word") - F.col("letters")).alias("left"))
    return flagged.groupBy("letters", "bar").agg(
        F.count(F.lit(1)).alias("positions"), F.count_if("shown").alias("shown"), F.count_if("right").alias("right"), F.sum(F.when(F.col("right"), F.col("left")).otherwise(0)).alias("saved")
    )
