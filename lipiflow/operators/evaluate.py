"""Accuracy of ranked lists: weighted top-k, reciprocal rank, error rates, keystroke replay, grids and averages."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.metrics import cer
from ..functions.scores import score_features
from ..sources.store import stored, tasks_of


def grouped_wordset(rows: DataFrame) -> DataFrame:
    """roman, golds by falling weight (of equals the one seen first), weight, source of the first row.

    rows: roman, gold, weight, source, ord (what was seen first has the least).
    """
    golds = rows.groupBy("roman", "gold").agg(F.sum("weight").alias("w"), F.min("ord").alias("first"), F.min_by("source", "ord").alias("source"))
    entry = F.struct((-F.col("w")).alias("nw"), "first", "gold")
    return golds.groupBy("roman").agg(
        F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["gold"]).alias("golds"), F.sum("w").alias("weight"), F.min_by("source", "first").alias("source")
    )


def gold_ranks(items: DataFrame, ranked: DataFrame) -> DataFrame:
    """items (q, gold, weight ..) with rank, the least rank of the gold among ranked (q, word, rank), or NULL."""
    hits = ranked.select("q", F.col("word").alias("gold"), F.col("rank")).groupBy("q", "gold").agg(F.min("rank").alias("rank"))
    return items.join(hits.hint("merge"), ["q", "gold"], "left")


def word_eval(ranks: DataFrame, ks: tuple[int, ...] = (1, 3, 5), weight: str = "weight", by: tuple[str, ...] = ()) -> DataFrame:
    """n, top<k> in per cent for each k, and mrr: all weighted."""
    total = F.sum(weight)
    share = lambda k: F.round(100.0 * F.sum(F.when(F.col("rank") <= k, F.col(weight)).otherwise(0)) / total, 6).alias(f"top{k}")
    mrr = F.round(F.sum(F.when(F.col("rank").isNotNull(), F.col(weight) / F.col("rank")).otherwise(0.0)) / total, 6)
    return ranks.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(share(k) for k in dict.fromkeys(ks)), mrr.alias("mrr"))


def mean_least_cer(items: DataFrame, weight: str = "weight") -> DataFrame:
    """cer, in per cent: for each item (word, golds) the least error rate over the golds, weighted mean; no word counts as empty."""
    best = F.array_min(F.transform("golds", lambda g: cer(F.coalesce(F.col("word"), F.lit("")), g)))
    return items.agg(F.round(100.0 * F.sum(best * F.col(weight)) / F.sum(weight), 6).alias("cer"))


def misses_by_source(ranks: DataFrame) -> DataFrame:
    return ranks.where(F.col("rank").isNull() | (F.col("rank") != 1)).groupBy("source").agg(F.count(F.lit(1)).alias("misses"))


def first_misses(ranks: DataFrame, n: int, ordinal: str) -> DataFrame:
    """The first n misses in the data's order."""
    return ranks.where(F.col("rank").isNull() | (F.col("rank") != 1)).orderBy(ordinal).limit(n)


def replay(items: DataFrame, prefix_ranks: DataFrame, k: int) -> DataFrame:
    """keystrokes, saved and never counts, if words were picked as soon as they show at rank 1, or among k.

    items: q, roman, gold; prefix_ranks: prefix, word, rank.
    """
    typed = items.select("q", "gold", F.length("roman").alias("n"), F.explode(F.transform(F.sequence(F.lit(1), F.length("roman")), lambda i: F.substring(F.col("roman"), F.lit(1), i))).alias("prefix"))
    ranks = typed.join(prefix_ranks.select("prefix", F.col("word").alias("gold"), "rank"), ["prefix", "gold"], "left")
    first = lambda most: F.min(F.when(F.col("rank") <= most, F.length("prefix")))
    each = ranks.groupBy("q", "n").agg(first(1).alias("f1"), first(k).alias("fk"))
    saved = lambda f: F.sum(F.coalesce(F.col("n") - F.col(f), F.lit(0)))
    return each.agg(
        F.sum("n").alias("keystrokes"), saved("f1").alias("saved_top1"), saved("fk").alias("saved_topk"), F.count_if(F.col("f1").isNull()).alias("never_top1"), F.count_if(F.col("fk").isNull()).alias("never_topk")
    )


def rerank_grid(candidates: DataFrame, model_weights: list[float], offsets: list[float]) -> DataFrame:
    """model_weight, offset, hits: whose candidate of largest score + weight * (logp + offset * unknown) is the gold.

    candidates: q, gold, word, score, logp, unknown, ord; the earliest of equal sums wins.
    """
    spark = candidates.sparkSession
    grid = spark.createDataFrame([(float(w), float(c)) for w in model_weights for c in offsets], "model_weight double, offset double")
    total = F.round(F.col("score") + F.col("model_weight") * (F.col("logp") + F.col("offset") * F.col("unknown").cast("int")), 6)
    best = candidates.crossJoin(F.broadcast(grid)).groupBy("q", "gold", "model_weight", "offset").agg(F.max_by("word", F.struct(total, -F.col("ord"))).alias("word"))
    return best.groupBy("model_weight", "offset").agg(F.count_if(F.col("word") == F.col("gold")).alias("hits"), F.count(F.lit(1)).alias("n"))


def macro_average(evaluated: DataFrame, metrics: tuple[str, ...] = ("top1", "top3", "mrr")) -> DataFrame:
    """The mean over sets of each set's figure; evaluated has a row for each set."""
    return evaluated.agg(F.count(F.lit(1)).alias("sets"), *(F.avg(m).alias(m) for m in metrics))


def percentiles(rows: DataFrame, group: str, value: str, wanted: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """group and a column for each wanted percentile: the value at the index that it makes of the group's number of values.

    Equal values are counted before they are exchanged; running sums over range partitions of the distinct ones find the index,
    so that a group with very many values is spread over tasks. Nulls are left out.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("_n"))
    run = running_sums(counts, [group, value], "_n")
    sizes = run.groupBy(group).agg(F.min("_sum").alias("_before"), F.sum("_n").alias("_all"))  # a row a group
    placed = run.join(sizes.withColumnRenamed(group, "_group"), F.col(group).eqNullSafe(F.col("_group"))).drop("_group")
    at = lambda index: F.max(F.when((F.col("_sum") + F.col("_n") - F.col("_before") > index) & (F.col("_sum") - F.col("_before") <= index), F.col(value)))
    return placed.groupBy(group).agg(*(at(index(F.col("_all"))).alias(name) for name, index in wanted.items()))


def running_sums(rows: DataFrame, order: list[str], value: str) -> DataFrame:
    """rows with _sum, the values of all rows before, by `order` (equal rows in any order): sums of range partitions give each its offset.

    The rows are stored in their order first, so that partitions stay what they are; a sum for each partition is all that is broadcast.
    """
    dealt = rows.repartitionByRange(tasks_of(rows), *order).sortWithinPartitions(*order)
    kept = stored(dealt.withColumn("_p", F.spark_partition_id()), "running")
    before = lambda w: F.coalesce(F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = kept.groupBy("_p").agg(F.sum(value).alias(value)).withColumn("_offset", before(Window.orderBy("_p"))).select("_p", "_offset")
    return kept.join(F.broadcast(sums), "_p").withColumn("_sum", F.col("_offset") + before(Window.partitionBy("_p").orderBy(*order))).drop("_p", "_offset")


def report_order(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The n first rows by `order` with their place, from 1: a report. Tasks send their n first rows only."""
    top = rows.orderBy(*order).limit(n)
    return top.select(F.row_number().over(Window.orderBy(*order)).cast("bigint").alias("place"), "*")


def stride_sample(rows: DataFrame, n: int, order: str) -> DataFrame:
    """Every ceil(N / n)-th row by `order`, n at most. A sampling operator; ordinals come from a range-partitioned sort."""
    total = rows.count()
    step = max(1, -(-total // max(n, 1)))
    ranked = ordinals(rows, order)
    return ranked.where((F.col("_ordinal") % step == 0) & (F.col("_ordinal") < step * n)).drop("_ordinal")


def ordinals(rows: DataFrame, order: str) -> DataFrame:
    """_ordinal: 0, 1, .. by `order`, without a single-task sort: counts of range partitions give each its offset."""
    return running_sums(rows.withColumn("_one", F.lit(1)), [order], "_one").withColumnRenamed("_sum", "_ordinal").drop("_one")


def leading(candidates: DataFrame) -> DataFrame:
    """candidates (q, gold, word, uni and other features) without those that cannot come first, whatever the weights, if that of uni is not negative.

    Of a query's candidates of equal features on the same side of the gold in order, that of largest uni scores at least as much as
    the others, and whether it comes before the gold is the same.
    """
    features = [c for c in candidates.columns if c not in ("word", "uni")]
    side = F.when(F.col("word") == F.col("gold"), 0).when(F.col("word") < F.col("gold"), -1).otherwise(1).alias("_side")
    return candidates.groupBy(*features, side).agg(F.max(F.struct("uni", "word")).alias("_most")).select(*features, "_most.uni", "_most.word")


def weight_hits(candidates: DataFrame, weights: list[dict[str, float]]) -> DataFrame:
    """setting, hits, n: for each of the weights, by their number, how often the best word is the gold. One job for all of them.

    candidates: q, gold, word and features; a query's candidates are scored under every setting, of equals the lesser word wins. A
    gold is the best if no lesser word scores as much and no greater one more: sums of numbers, no list is sorted.
    """
    names = sorted(weights[0])
    schema = "setting int, w struct<" + ", ".join(f"{n}: double" for n in names) + ">"
    grid = candidates.sparkSession.createDataFrame([(i, tuple(float(w[n]) for n in names)) for i, w in enumerate(weights)], schema)
    s = F.round(score_features(candidates.columns, {n: F.col("w")[n] for n in names}), 6)
    rows = candidates.crossJoin(F.broadcast(grid)).select("q", "gold", "setting", s.alias("s"), (F.col("word") == F.col("gold")).alias("is"), (F.col("word") < F.col("gold")).alias("less"))
    most = lambda when, name: F.max(F.when(when, F.col("s"))).alias(name)
    best = rows.groupBy("q", "gold", "setting").agg(most(F.col("is"), "own"), most(F.col("less"), "lesser"), most(~F.col("is") & ~F.col("less"), "greater"))
    hit = F.col("own").isNotNull() & F.coalesce(F.col("own") > F.col("lesser"), F.lit(True)) & F.coalesce(F.col("own") >= F.col("greater"), F.lit(True))
    return best.groupBy("setting").agg(F.count_if(hit).alias("hits"), F.count(F.lit(1)).alias("n"))


def coordinate_ascent(scores, start: dict[str, float], grid: dict[str, Sequence[float]], least: float = 1e-9) -> tuple[dict[str, float], float]:
    """Weights of best score: each in turn over its grid, until a round changes none, however many that takes.

    `scores` maps a list of weights to their numbers; it is called once for each grid, so that one job can serve all its values, and
    for no weights a second time. Every change raises the score, so that the search ends.
    """
    known: dict[tuple, float] = {}
    key = lambda w: tuple(sorted(w.items()))

    def score(settings):
        new = [w for w in settings if key(w) not in known]
        known.update(zip(map(key, new), scores(new) if new else []))
        return [known[key(w)] for w in settings]

    best, at = dict(start), score([dict(start)])[0]
    while True:
        before = dict(best)
        for name, values in grid.items():
            others = [best | {name: v} for v in values if v != best[name]]
            for w, s in zip(others, score(others)):
                if s > at + least:
                    best, at = w, s
        if best == before:
            return best, at


def context_eval(items: DataFrame, ranked: DataFrame, keys: DataFrame, bounds: tuple[int, ...] = (1, 3, 5, 10, 50)) -> DataFrame:
    """n, within<k> for each bound, absent, and of the misses those whose first choice has the gold's key or is another word.

    items: q, gold; ranked: q, word, rank; keys: word, key of each word.
    """
    first = ranked.where("rank = 1").select("q", F.col("word").alias("first"))
    key_of = lambda c: keys.select(F.col("word").alias(c), F.col("key").alias(f"{c}_key"))
    rows = gold_ranks(items, ranked).join(first, "q", "left").join(key_of("first"), "first", "left").join(key_of("gold"), "gold", "left")
    missed = F.col("rank").isNull() | (F.col("rank") > 1)
    same = F.coalesce(F.col("first_key") == F.col("gold_key"), F.lit(False))
    return rows.agg(
        F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("rank") <= k).alias(f"within{k}") for k in bounds), F.count_if(F.col("rank").isNull()).alias("absent"),
        F.count_if(missed & same).alias("same_key"), F.count_if(missed & ~same).alias("other_word"),
    )


def seeded_sample(values: list, n: int, seed: int) -> list:
    """The first n after a shuffle by CPython's generator, for driver-side lists of bounded size."""
    import random

    out = list(values)
    random.Random(seed).shuffle(out)
    return out[:n]
