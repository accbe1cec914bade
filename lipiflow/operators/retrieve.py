"""Candidates for loosely spelled queries, and their ranking, for whole tables of queries at once.

A query row has q (its id), roman and whatever else is to come along. Channels are equality joins against
tables that hold at most a fixed number of rows for each lookup key, merged to one row for each (query, word).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.keys import key_from_roman
from ..functions.scores import BACKOFF, context_adjust, fast_supported, score_features, static_prescore, unigram_logp
from ..sources.store import stored

# Candidates of a channel.
PER_CHANNEL, LONGER_KEYS, MODEL_SCORED = 30, 15, 16


def keyed(df: DataFrame, text: str, level: str) -> DataFrame:
    """df with its key at the level as `key`, and no rows without one: the column of the level's name where df has it."""
    key = F.col(level) if level in df.columns else key_from_roman(text, level)
    return df.withColumn("key", key).where("key <> ''")


def top_by_key(words: DataFrame, level: str, top: int = PER_CHANNEL) -> DataFrame:
    """key, word: the best words of each key, score descending and then word descending."""
    order = Window.partitionBy("key").orderBy(F.desc("score"), F.desc("word"))
    rows = keyed(words, "word", level).select("word", "score", "key")
    return rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= top).drop("_r")


def top_by_longer_key(words: DataFrame, level: str, top: int = LONGER_KEYS) -> DataFrame:
    """key, word, gap: the best words whose key goes on after `key`, and by how many letters."""
    rows = keyed(words, "word", level).where(F.length("key") > 1)
    rows = rows.select("word", "score", F.col("key").alias("_k"), F.explode(F.sequence(F.lit(1), F.length("key") - 1)).alias("_n"))
    rows = rows.select(F.substring(F.col("_k"), F.lit(1), F.col("_n")).alias("key"), "word", "score", (F.length("_k") - F.col("_n")).alias("gap"))
    order = Window.partitionBy("key").orderBy(F.desc("score"), F.desc("word"))
    return rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= top).select("key", "word", "gap")


def top_completions(romans: DataFrame, words: DataFrame, top: int = PER_CHANNEL) -> DataFrame:
    """prefix, word, rom_prefix, gap: what longer romanizations a prefix may become; a row for each letter of a romanization goes in."""
    scored = romans.join(words.select("word", "score"), "word", "left").withColumn("_s", F.col("count") * 10000 + F.least(F.coalesce("score", F.lit(0)), F.lit(9999)))
    rows = scored.where(F.length("roman") > 1).select("word", "count", "_s", "roman", F.explode(F.sequence(F.lit(1), F.length("roman") - 1)).alias("_n"))
    rows = rows.select(F.substring(F.col("roman"), F.lit(1), F.col("_n")).alias("prefix"), "word", "count", "_s", (F.length("roman") - F.col("_n")).alias("gap"))
    order = Window.partitionBy("prefix").orderBy(F.desc("_s"), F.desc("word"), F.desc("count"), F.desc("gap"))
    kept = rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= top)
    return kept.groupBy("prefix", "word").agg(F.sum("count").alias("rom_prefix"), F.min("gap").alias("gap"))


#: Features that channels give, how those of one (query, word) are merged, and what they are where no channel gives one.
MERGED = {
    "rom_exact": (F.max, 0), "rom_prefix": (F.max, 0), "gap": (F.min, 0), "personal_sel": (F.max, 0.0), "personal_share": (F.max, 0.0),
    **dict.fromkeys(("key_fine", "key_coarse", "key_fine_prefix", "key_coarse_prefix", "avro", "is_latin"), (F.bool_or, False)),
}


def candidates(
    queries: DataFrame,
    words: DataFrame,
    romans: DataFrame,
    completions: DataFrame | None = None,
    rules: DataFrame | None = None,
    selections: DataFrame | None = None,
    own_words: DataFrame | None = None,
    spelling: DataFrame | None = None,
    key_indexes: dict[str, tuple[DataFrame, DataFrame]] | None = None,
) -> DataFrame:
    """q, word and features: those of MERGED that the given tables have, uni, in_lexicon, personal_word and spelled.

    Channels: romanizations that match, their completions, words of the query's key and of longer keys, the word that
    rules spell (rules: roman, word), and what was chosen for the query before (selections: roman, word, count), which may
    be the typed letters themselves. own_words (word, count) and spelling (word) add features to what is there.
    Completions and the gap count only for words without an exact romanization. queries and words may bring their keys along
    as columns fine and coarse. completions and key_indexes (for each level what top_by_key and top_by_longer_key give) are
    made here unless they are given. A null roman matches nothing.
    """
    longer = top_completions(romans, words) if completions is None else completions
    # merge joins at every size: tables that grow with the input never pass through the driver
    romans, longer = romans.hint("merge"), longer.hint("merge")
    channels = [queries.join(romans, "roman").select("q", "word", F.col("count").cast("bigint").alias("rom_exact"))]
    channels.append(queries.join(longer, queries.roman == longer.prefix).select("q", "word", F.col("rom_prefix").cast("bigint").alias("rom_prefix"), "gap"))
    for level in ("fine", "coarse"):
        typed = keyed(queries, "roman", level).select("q", "key")
        same, beyond = (x.hint("merge") for x in (key_indexes[level] if key_indexes else (top_by_key(words, level), top_by_longer_key(words, level))))
        channels.append(typed.join(same, "key").select("q", "word", F.lit(True).alias(f"key_{level}")))
        channels.append(typed.join(beyond, "key").select("q", "word", "gap", F.lit(True).alias(f"key_{level}_prefix")))
    if rules is not None:
        channels.append(queries.join(rules.where("word <> roman AND word <> ''"), "roman").select("q", "word", F.lit(True).alias("avro")))
    if selections is not None:
        shares = selections.withColumn("_share", F.col("count") / F.sum("count").over(Window.partitionBy("roman")))
        own = queries.select("q", "roman").join(shares, "roman")
        channels.append(own.select("q", "word", F.col("count").cast("double").alias("personal_sel"), F.col("_share").alias("personal_share"), (F.col("word") == F.col("roman")).alias("is_latin")))
    rows = channels[0]
    for c in channels[1:]:
        rows = rows.unionByName(c, allowMissingColumns=True)
    given = [f for f in MERGED if f in rows.columns]
    merged = rows.groupBy("q", "word").agg(*(F.coalesce(MERGED[f][0](f), F.lit(MERGED[f][1])).alias(f) for f in given))
    for f in ("rom_prefix", "gap"):
        merged = merged.withColumn(f, F.when(F.col("rom_exact") > 0, 0).otherwise(F.col(f)))
    if own_words is not None:
        merged = merged.join(own_words.select("word", F.col("count").alias("personal_word")), "word", "left")
        merged = merged.withColumn("personal_word", F.when(F.col("is_latin") | F.col("personal_word").isNull(), 0.0).otherwise(F.col("personal_word")))
    if spelling is not None:
        merged = merged.join(spelling.select("word", F.lit(True).alias("spelled")).distinct(), "word", "left").withColumn("spelled", F.coalesce("spelled", F.lit(False)))
    return with_prior(merged, words)


def with_context(candidates_: DataFrame, before: DataFrame, pairs: DataFrame, totals: DataFrame) -> DataFrame:
    """Adds context: what the word before (before: q, prev) does to each candidate's log probability.

    pairs: prev, word, count; totals: prev, total. Without a word before, or pairs of it, all candidates have 0.
    """
    # few words before may serve all queries: totals meet a row for each query, never its candidates
    told = before.select("q", "prev").join(totals.select("prev", F.col("total").alias("_total")), "prev", "left")
    rows = candidates_.join(told, "q", "left")
    rows = rows.join(pairs.select("prev", "word", F.col("count").alias("_count")), ["prev", "word"], "left")
    return rows.withColumn("context", context_adjust("_count", "_total", "uni")).drop("_total", "_count")


def with_prior(candidates_: DataFrame, words: DataFrame) -> DataFrame:
    """Adds uni, the unigram log probability, and in_lexicon; the normaliser is one row."""
    total = words.agg((F.coalesce(F.sum("score"), F.lit(0)) + 1).alias("total"))
    joined = candidates_.join(words.select("word", F.col("score").alias("lex_score")).hint("merge"), "word", "left").crossJoin(F.broadcast(total))
    return joined.withColumn("uni", unigram_logp("lex_score", "total")).withColumn("in_lexicon", F.col("lex_score").isNotNull()).drop("total")


def ranked(candidates_: DataFrame, weights: dict[str, float], k: int, fast: bool = False, context: str | None = None) -> DataFrame:
    """The k best words of each query: score rounded to six places, then the word."""
    s = F.round(score_features(candidates_.columns, weights, context, fast), 6)
    order = Window.partitionBy("q").orderBy(F.desc("score"), "word")
    return candidates_.withColumn("score", s).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def transliterated_sentences(tokens: DataFrame, candidates_: DataFrame, weights: dict[str, float], pairs: DataFrame, totals: DataFrame) -> DataFrame:
    """sent, words: each sentence word by word, the first choice of every word given the one chosen before it.

    tokens: sent, pos, core (the token as typed), roman (its normal form, NULL or empty where it has no Latin letter: such a
    token passes as it is and is no context). candidates_ has q = roman; pairs: prev, word, count; totals: prev, total. A word
    without candidates stays as typed. Ties go to the lesser word; both parts of a sum are rounded to six places.

    What is chosen depends on the word before alone. So the choices that a word before changes are made first (`choices`), once for
    each word and spelling; a sentence only looks them up, from left to right (`walked`). No row holds a whole list of candidates.
    """
    told = pairs.select("prev", "word", "count").join(totals, "prev")
    return walked(tokens, *choices(candidates_, weights, told))


def choices(candidates_: DataFrame, weights: dict[str, float], told: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(roman, first), the first choice of each spelling, and (prev, roman, word), where a word before changes it. Both are stored.

    candidates_ has q = roman; told: prev, word, count, total, what followed a word how often, and how often anything did. Spellings are
    independent of each other: those of a large table can be given in parts.
    """
    shift = lambda context: F.round(weights["bigram"] * context, 6)
    order = Window.partitionBy("roman").orderBy(F.desc("s"), "word")
    base = candidates_.select(F.col("q").alias("roman"), "word", "uni", F.round(score_features(candidates_.columns, weights), 6).alias("s"))
    base = stored(base.withColumn("place", F.row_number().over(order)).withColumn("first", F.first("word").over(order)).withColumn("most", F.first("s").over(order)), "scored-candidates")
    # what a pair adds is the pair's own, and known before it meets spellings
    prior = base.groupBy("word").agg(F.any_value("uni").alias("uni"))
    gains = stored(told.where("total > 0").join(prior, "word").select("prev", "word", shift(context_adjust("count", "total", "uni")).alias("gain")), "gains")
    none = shift(F.lit(BACKOFF))
    worth = lambda gain: (-F.round(F.col("s") + gain, 6)).alias("n")
    # a first choice that a word before does not put below one that never followed yields only to what beats it so
    rows = gains.join(base.select("roman", "word", "s", "place", "first", "most"), "word").withColumn("n", worth(F.col("gain")))
    rows = rows.where(F.struct("n", "word") <= F.struct(-F.round(F.col("most") + none, 6), "first"))
    rows = rows.select("prev", "roman", F.struct("n", "word", (F.col("place") == 1).alias("own")).alias("best"))
    better = rows.repartition("prev", "roman").groupBy("prev", "roman").agg(F.min("best").alias("best"))
    # of one that it does put below, which is rare, all candidates are looked at again
    below = gains.where(F.col("gain") < none).select("prev", F.col("word").alias("first")).join(base.where("place = 1").select("roman", "first"), "first").select("prev", "roman")
    again = below.join(base.select("roman", "word", "s", "place"), "roman").join(gains, ["prev", "word"], "left")
    again = again.select("prev", "roman", F.struct(worth(F.coalesce("gain", none)), "word", (F.col("place") == 1).alias("own")).alias("best")).groupBy("prev", "roman").agg(F.min("best").alias("best"))
    chosen = better.join(below, ["prev", "roman"], "left_anti").unionByName(again).where("NOT best.own").select("prev", "roman", "best.word")
    return base.where("place = 1").select("roman", "first"), stored(chosen, "chosen-words")


def walked(tokens: DataFrame, firsts: DataFrame, chosen: DataFrame) -> DataFrame:
    """sent, words: sentences of tokens (sent, pos, core, roman) by what `choices` made of all their spellings.

    Choices that a spelling's own ones may bring before another one are told to every two spellings that meet anywhere, so that
    all that a token needs is one lookup by itself and the one before.
    """
    latin = F.coalesce(F.col("roman") != "", F.lit(False))
    before = F.last(F.when(latin, F.col("roman")), ignorenulls=True).over(Window.partitionBy("sent").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    spoken = stored(tokens.select("sent", "pos", "core", F.when(latin, F.col("roman")).alias("roman"), F.coalesce(before, F.lit("")).alias("before")), "spoken")
    meet = spoken.where("roman IS NOT NULL").select("before", "roman").distinct()
    brought = firsts.union(chosen.select("roman", "word")).distinct().toDF("before", "prev")
    turns = meet.join(brought, "before").join(chosen, ["prev", "roman"]).groupBy("before", "roman").agg(F.map_from_entries(F.collect_list(F.struct("prev", "word"))).alias("turns"))
    known = meet.join(firsts, "roman", "left").join(turns, ["before", "roman"], "left")
    rows = spoken.join(known, ["before", "roman"], "left")
    whole = rows.groupBy("sent").agg(F.collect_list(F.struct("pos", "core", "roman", "first", "turns")).alias("t"))
    step = lambda acc, x: F.coalesce(F.when(x["roman"].isNotNull(), F.coalesce(F.try_element_at(x["turns"], acc["last"]), x["first"])), x["core"])
    walk = F.aggregate(
        F.array_sort("t", lambda a, b: a["pos"].cast("int") - b["pos"].cast("int")),
        F.struct(F.array().cast("array<string>").alias("words"), F.lit("").alias("last")),
        lambda acc, x: F.struct(F.concat(acc["words"], F.array(step(acc, x))).alias("words"), F.when(x["roman"].isNotNull(), step(acc, x)).otherwise(acc["last"]).alias("last")),
        lambda acc: acc["words"],
    )
    return whole.select("sent", walk.alias("words"))


def fast_ranked(candidates_: DataFrame, weights: dict[str, float], k: int) -> DataFrame:
    """ranked without a model: unsupported words go below where an attested spelling has five votes; strong: any has two."""
    some = Window.partitionBy("q")
    rows = candidates_.withColumn("_best", F.max("rom_exact").over(some)).withColumn("_demote", (F.col("_best") >= 5) & (F.col("rom_exact") == 0) & (F.col("rom_prefix") > 0))
    rows = rows.withColumn("strong", F.col("_best") >= 2).withColumn("score", F.round(score_features(candidates_.columns, weights, None, True), 6))
    order = Window.partitionBy("q").orderBy("_demote", F.desc("score"), "word")
    return rows.where(fast_supported(candidates_.columns)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("_best", "_demote")


def for_model(candidates_: DataFrame, n: int = MODEL_SCORED) -> DataFrame:
    """The n candidates of each query that are worth a model's score."""
    order = Window.partitionBy("q").orderBy(F.desc(F.round(static_prescore(candidates_.columns), 6)), "word")
    return candidates_.withColumn("prerank", F.row_number().over(order)).where(F.col("prerank") <= n)


def prefix_join(queries: DataFrame, words: DataFrame, prefix: str = "prefix", head: int = 3) -> DataFrame:
    """Words that begin with a query's prefix: equality on the first `head` characters, then the rest as a filter."""
    start = lambda c: F.substring(c, 1, head)
    short = queries.where(F.length(prefix) < head)
    long_ = queries.where(F.length(prefix) >= head).withColumn("_head", start(prefix)).join(words.withColumn("_head", start("word")), "_head").where(F.col("word").startswith(F.col(prefix))).drop("_head")
    exploded = words.withColumn("_head", F.explode(F.transform(F.sequence(F.lit(1), F.lit(head - 1)), lambda i: F.substring(F.col("word"), F.lit(1), i)))).where(F.length("word") >= F.length("_head")).distinct()
    few = short.join(exploded, short[prefix] == exploded["_head"]).drop("_head")
    return long_.unionByName(few.select(long_.columns))
