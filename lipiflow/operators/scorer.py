"""Scores of a dense head, and the plug-in for a model that scores candidates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyspark.sql.types as T
from pyspark.sql import DataFrame, Window, functions as F


def dot(a, b) -> F.Column:
    """Dot product of two arrays of equal size, in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def log_softmax(scored: DataFrame, group: list[str], score: str = "score") -> DataFrame:
    """logp within each group, by the largest score and the sum of exponentials.

    Both are made by aggregates that combine before they are exchanged; a join brings them back, which AQE can split for a group
    with very many rows. Groups with a null name have none.
    """
    most = scored.groupBy(*group).agg(F.max(score).alias("_most"))
    shifted = scored.join(most, group).withColumn("_z", F.col(score) - F.col("_most")).drop("_most")
    total = shifted.groupBy(*group).agg(F.log(F.sum(F.exp("_z"))).alias("_log"))
    return shifted.join(total, group).withColumn("logp", F.col("_z") - F.col("_log")).drop("_z", "_log")


#: Vectors of a block of queries and of a block of items: a pair of blocks is one matrix product in a task.
QUERY_BLOCK, ITEM_BLOCK = 1024, 8192
#: Scores are rounded: items so much below the last place may still be its equals.
ROUNDING = 1e-6


def _blocks(rows: DataFrame, name: str, vector: str, size: int) -> DataFrame:
    """A row for each block of about `size` vectors, dealt by hash: arrays of ids and of the vectors' values, end to end."""
    n = max(1, -(-rows.count() // size))
    dealt = rows.select(name, F.transform(vector, lambda x: x.cast("double")).alias(vector)).withColumn("_b", F.pmod(F.xxhash64(name), F.lit(n)))
    both = dealt.groupBy("_b").agg(F.collect_list(F.struct(name, vector)).alias("_l"))
    return both.select(F.col(f"_l.{name}").alias(name), F.flatten(F.col(f"_l.{vector}")).alias(vector))


def dense_top_k(queries: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """q, item, score, rank: the k items of largest dot product for each query, of equals the least item.

    queries: q, qv; items: item, v. Both are dealt to blocks; each two blocks meet once in a matrix product, of which only
    the k best of a query, with their ties, leave the task. Rows with a null id or vector are left out.
    """
    left = _blocks(queries.where("q IS NOT NULL AND qv IS NOT NULL"), "q", "qv", QUERY_BLOCK)
    right = _blocks(items.where("item IS NOT NULL AND v IS NOT NULL"), "item", "v", ITEM_BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                q, qv, item, v = (b.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("q", "qv", "item", "v"))
                scores = np.round(qv.reshape(len(q), -1) @ v.reshape(len(item), -1).T, 6)
                least = np.partition(scores, -min(k, len(item)), axis=1)[:, -min(k, len(item))]
                a, c = np.nonzero(scores >= least[:, None])
                yield pa.RecordBatch.from_arrays([pa.array(q[a]), pa.array(item[c]), pa.array(scores[a, c])], names=["q", "item", "score"])

    types = f"q {queries.schema['q'].dataType.simpleString()}, item {items.schema['item'].dataType.simpleString()}, score double"
    rows = left.crossJoin(right).mapInArrow(run, types)
    order = Window.partitionBy("q").orderBy(F.desc("score"), "item")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


#: Bytes of a block of vectors in eight bits.
SHORT_BLOCK = 1 << 19
_SHORT = "dim int, ids array<{t}>, values binary, scale array<double>, norm array<double>, short_norm array<double>"


def short_blocks(rows: DataFrame, name: str, vector: str, block_bytes: int = SHORT_BLOCK) -> DataFrame:
    """dim, ids, values, scale, norm, short_norm: a row for each block of vectors of one length, each component in eight bits.

    A component is its vector's scale times a whole number from -127 to 127, off by half a scale at most; norm and
    short_norm are the sums of the absolute values of the vector as it was and as it is in eight bits. Blocks are
    cut where the vectors are, by bytes: nothing is exchanged.
    """
    kind = rows.schema[name].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _SHORT.split(", ")]
        for b in batches:
            size = b.column(1).value_lengths().to_numpy()
            for dim in np.unique(size):
                some = b.filter(pa.array(size == dim))
                step = max(block_bytes // max(int(dim), 1), 1)
                for at in range(0, some.num_rows, step):
                    part = some.slice(at, step)
                    x = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(part.num_rows, dim)
                    scale = np.abs(x).max(axis=1, initial=0) / 127
                    q = np.rint(np.divide(x, scale[:, None], where=scale[:, None] > 0, out=np.zeros_like(x))).astype(np.int8)
                    short = np.abs(q.astype(float)).sum(axis=1) * scale
                    lists = [pa.array([v], pa.list_(pa.float64())) for v in (scale, np.abs(x).sum(axis=1), short)]
                    ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), pa.concat_arrays([part.column(0)]))
                    yield pa.RecordBatch.from_arrays([pa.array([int(dim)], pa.int32()), ids, pa.array([q.tobytes()], pa.binary()), *lists], names=names)

    good = rows.where(F.col(name).isNotNull() & F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull()))
    return good.select(name, F.transform(vector, lambda x: x.cast("double")).alias(vector)).mapInArrow(run, _SHORT.format(t=kind))


def _bounds(left: dict, right: dict) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all dot products of two blocks, from their short forms."""
    near = (left["values"] @ right["values"].T) * np.outer(left["scale"], right["scale"])
    # a product is off by what the one vector's rounding makes of the other and the other way round
    off = np.outer(left["scale"] / 2, right["norm"]) + np.outer(left["short_norm"], right["scale"] / 2)
    off = off * (1 + 1e-9) + 1e-12
    return near - off, near + off


def short_top_k(queries: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """As dense_top_k, with what is exchanged in eight bits: bounds leave few products to be worked out exactly.

    Blocks of queries meet blocks of items; of a query, only items whose upper bound reaches its kth lower bound
    leave a task, and after all blocks only those that reach the kth lower bound of all. The exact products of these decide,
    rounded to six places, of equals the least item. Rows with a null id, vector or component are left out;
    vectors of different lengths do not meet.
    """
    left, right = short_blocks(queries, "q", "qv"), short_blocks(items, "item", "v")
    apart = [c for c in right.columns if c != "dim"]
    pairs = left.join(right.select("dim", *(F.col(c).alias(f"i_{c}") for c in apart)), "dim")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                dim = b.column("dim")[r].as_py()
                side = lambda p: {c: b.column(p + c)[r].values.to_numpy() for c in ("scale", "norm", "short_norm")} | {"values": np.frombuffer(b.column(f"{p}values")[r].as_py(), np.int8).reshape(-1, dim).astype(float)}  # noqa: B023, E731
                low, high = _bounds(side(""), side("i_"))
                n = min(k, low.shape[1])
                least = np.partition(low, -n, axis=1)[:, -n]
                a, c = np.nonzero(high >= (least - ROUNDING)[:, None])
                yield pa.RecordBatch.from_arrays([b.column("ids")[r].values.take(pa.array(a)), b.column("i_ids")[r].values.take(pa.array(c)), pa.array(low[a, c]), pa.array(high[a, c])], names=["q", "item", "low", "high"])

    types = [f"{n} {df.schema[n].dataType.simpleString()}" for df, n in ((queries, "q"), (items, "item"))]
    found = pairs.mapInArrow(run, ", ".join([*types, "low double, high double"]))
    kth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("low")))
    bar = found.withColumn("_r", kth).withColumn("_bar", F.min(F.when(F.col("_r") <= k, F.col("low"))).over(Window.partitionBy("q")))
    likely = bar.where(F.col("high") >= F.col("_bar") - ROUNDING).select("q", "item")
    exact = likely.join(queries.select("q", "qv"), "q").join(items.select("item", "v"), "item").select("q", "item", F.round(dot("qv", "v"), 6).alias("score"))
    ranked = exact.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "item")))
    return ranked.where(F.col("rank") <= k)


def score_with(candidates: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.Series]], columns: list[str]) -> DataFrame:
    """Adds xlit_logp by a model that every task loads once: load() returns a function of a batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for b in batches:
            yield b.assign(xlit_logp=model(b[columns]).astype(float))

    return candidates.mapInPandas(run, T.StructType([*candidates.schema.fields, T.StructField("xlit_logp", T.DoubleType())]))
