"""Near-duplicate vectors by counting collisions on one-dimensional projections.

Unit vectors are projected on PROJECTIONS random directions. Two vectors collide on a projection if the one lies in
the window centred on the other. The projections of vectors whose cosine is the threshold differ by a normal value of
known spread, so the windows are made as wide as RECALL needs for a pair to collide on at least PROJECTIONS - MISSES
of them; pairs with that count are verified by their cosine.

With at most MISSES misses, one of MISSES + 1 groups of projections has none. So each group sorts its first
projection into cells as wide as a half window; a cell meets itself and the next one, in blocks of at most about BLOCK
vectors a side, and a pair goes on only if it collides on the whole group and on no earlier group as a whole. Pairs live
in numpy inside a block only: a block returns a row for each of its linked vectors, with the links it counted and one
edge of a spanning forest.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import stored
from .near_dedup import components

SIMILARITY, RECALL = 0.95, 0.995
PROJECTIONS, MISSES = 24, 2
#: Vectors of a cell that one block holds against as many others; steps of a projected unit.
BLOCK, STEPS, FAR = 4096, 1024, 16383
#: Pairs that are looked at, and verified, in one numpy pass.
LOOK, VERIFY = 1 << 20, 1 << 15


def recall_of(half: float, similarity: float = SIMILARITY, projections: int = PROJECTIONS, misses: int = MISSES) -> float:
    """Probability that vectors with that cosine miss each other's windows, `half` to either side, at most `misses` times."""
    far = math.sqrt(max(2 - 2 * similarity, 1e-18))
    miss = math.erfc(half / far / math.sqrt(2))
    return sum(math.comb(projections, k) * miss**k * (1 - miss) ** (projections - k) for k in range(misses + 1))


def half_window(similarity: float = SIMILARITY, recall: float = RECALL) -> float:
    """The narrowest half window with that recall at the threshold; nearer pairs are found with more."""
    low, high = 0.0, 16.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if recall_of(mid, similarity) >= recall else (mid, high)
    return high


@lru_cache(maxsize=8)
def directions(dim: int) -> np.ndarray:
    return np.random.default_rng([20, dim]).standard_normal((dim, PROJECTIONS))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def usable(embedding):
    """Whether a vector has a direction: not null, not zero, no component null, infinite or not a number."""
    good = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embedding.isNotNull() & good & F.exists(embedding, lambda x: x != 0)


def vector_classes(vectors: DataFrame) -> DataFrame:
    """node, embedding, least, size: one row for each distinct usable vector, stored, so that its number stays."""
    rows = vectors.where(usable(F.col("embedding"))).groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("size"))
    return stored(rows.withColumn("node", F.monotonically_increasing_id()), "vector-classes")


def sketches(classes: DataFrame, half: float) -> DataFrame:
    """node, size, dim, vector, places, cells: a vector's bytes, its projections in steps, and the cell of each group's first projection."""
    kind = np.float64 if "double" in dict(classes.dtypes)["embedding"] else np.float32
    lead = PROJECTIONS // (MISSES + 1)
    width = int(math.ceil(half * STEPS))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                part = batch.slice(at, 8192)
                dims = part.column("dim").to_numpy()
                for dim in np.unique(dims):
                    some = part.filter(pa.array(dims == dim))
                    x = some.column("embedding").flatten().to_numpy().reshape(-1, dim).astype(kind, copy=False)
                    # a place beyond FAR moves there, which brings none further apart; differences fit in 16 bits
                    place = np.clip(np.rint(unit(x.astype(float)) @ directions(int(dim)) * STEPS), -FAR, FAR).astype(np.int16)
                    cells = place[:, ::lead].astype(np.int32) // width
                    lists = pa.FixedSizeListArray.from_arrays(pa.array(cells.ravel()), cells.shape[1]).cast(pa.list_(pa.int32()))
                    columns = [some.column("node"), some.column("size"), some.column("dim"), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in place], pa.binary()), lists]
                    yield pa.RecordBatch.from_arrays(columns, names=["node", "size", "dim", "vector", "places", "cells"])

    schema = "node long, size long, dim int, vector binary, places binary, cells array<int>"
    return stored(classes.select("node", "size", F.size("embedding").alias("dim"), "embedding").mapInArrow(run, schema), "vector-sketches")


def block_pairs(sketched: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of sketched with dim, grp, cell, up, i, j, late: each row in all the block pairs that it has to be looked at in.

    The cells are few, as projections of unit vectors are bounded; their counts are all that is broadcast.
    """
    rows = sketched.select("node", "size", "dim", "vector", "places", F.posexplode("cells").alias("grp", "cell"))
    counts = stored(rows.groupBy("dim", "grp", "cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("own")), "vector-cells")
    near = lambda step, name: counts.select("dim", "grp", (F.col("cell") + step).alias("cell"), F.col("own").alias(name))
    around = counts.join(near(-1, "above"), ["dim", "grp", "cell"], "left").join(near(1, "below"), ["dim", "grp", "cell"], "left")
    dealt = rows.join(F.broadcast(around.na.fill(0, ["above", "below"])), ["dim", "grp", "cell"])
    dealt = dealt.withColumn("s", F.expr("cast(pmod(xxhash64(node, 3), own) AS int)"))
    numbers = lambda n: f"slice(sequence(0, greatest({n} - 1, 0)), 1, {n})"
    met = F.expr(f"""concat(
        transform({numbers('own')}, t -> struct(cell AS cell, 0 AS up, least(s, t) AS i, greatest(s, t) AS j, s > t AS late)),
        transform({numbers('above')}, t -> struct(cell AS cell, 1 AS up, s AS i, t AS j, false AS late)),
        transform({numbers('below')}, t -> struct(cell - 1 AS cell, 1 AS up, t AS i, s AS j, true AS late)))""")
    return dealt.select("dim", "grp", "node", "size", "vector", "places", F.explode(met).alias("m")).select("dim", "grp", "m.*", "node", "size", "vector", "places")


class Forest:
    """A spanning forest of n nodes, as the least node of each one's tree."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def tie(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.root[a], self.root[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while (self.root != self.root[self.root]).any():
                self.root = self.root[self.root]


def near(a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    """Whether places are at most width apart: one unsigned comparison, in 16 bits if the places are."""
    if a.dtype != np.int16 or width > FAR:
        return np.abs(a.astype(np.int32) - b) <= width
    d = a - b  # at most 2 * FAR, so it does not wrap; moved by width it may, to what is more than 2 * width
    d += np.int16(width)
    return d.view(np.uint16) <= np.uint16(2 * width)


def colliding(left: np.ndarray, right: np.ndarray, group: int, width: int, ordered: bool):
    """Pairs (places in left, places in right) of a block pair that pass the count and are left to this group, in pieces.

    ordered: left and right are the same rows, of which each pair is taken once.
    """
    lead = PROJECTIONS // (MISSES + 1)
    own = range(group * lead, group * lead + lead)
    step = max(LOOK // max(len(right), 1), 1)
    columns = np.ascontiguousarray(right.T)
    for at in range(0, len(left), step):
        part = left[at : at + step]
        may = near(part[:, own[0], None], columns[own[0]], width)
        for c in own[1:]:
            may &= near(part[:, c, None], columns[c], width)
        i, j = np.nonzero(may)
        i += at
        if ordered:
            i, j = i[i < j], j[i < j]
        for cut in range(0, len(i), VERIFY):
            p, q = i[cut : cut + VERIFY], j[cut : cut + VERIFY]
            hit = near(left[p], right[q], width)
            earlier = hit[:, : group * lead].reshape(len(p), group, lead).all(axis=2).any(axis=1) if group else np.zeros(len(p), bool)
            good = (hit.sum(axis=1) >= PROJECTIONS - MISSES) & ~earlier
            yield p[good], q[good]


def block_links(pairs: DataFrame, similarity: float, half: float) -> DataFrame:
    """node, n, root: for each block pair, its linked vectors with the rows that each is linked to and a vector of its tree."""
    width = int(math.ceil(half * STEPS)) + 1  # projections are rounded to whole steps

    def run(table: pa.Table) -> pa.Table:
        dim, group = table.column("dim")[0].as_py(), table.column("grp")[0].as_py()
        vectors = table.column("vector").to_pylist()
        x = unit(np.frombuffer(b"".join(vectors), f"f{len(vectors[0]) // dim}").reshape(-1, dim).astype(float))
        place = np.frombuffer(b"".join(table.column("places").to_pylist()), np.int16).reshape(-1, PROJECTIONS)
        node, size = (table.column(c).to_numpy() for c in ("node", "size"))
        late = table.column("late").to_numpy(zero_copy_only=False)
        ordered = table.column("up")[0].as_py() == 0 and table.column("i")[0].as_py() == table.column("j")[0].as_py()
        left, right = (np.arange(len(node)),) * 2 if ordered else (np.flatnonzero(~late), np.flatnonzero(late))
        links, forest = np.zeros(len(node), np.int64), Forest(len(node))
        for p, q in colliding(place[left], place[right], group, width, ordered):
            a, b = left[p], right[q]
            good = np.einsum("ij,ij->i", x[a], x[b]) >= similarity
            a, b = a[good], b[good]
            np.add.at(links, a, size[b])
            np.add.at(links, b, size[a])
            forest.tie(a, b)
        some = np.flatnonzero(links)
        return pa.table({"node": node[some], "n": links[some], "root": node[forest.root[some]]}, schema=pa.schema([("node", pa.int64()), ("n", pa.int64()), ("root", pa.int64())]))

    return pairs.groupBy("dim", "grp", "cell", "up", "i", "j").applyInArrow(run, "node long, n long, root long")


def vector_dedup(vectors: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row of vectors (vec_id, embedding).

    Vectors are linked if their cosine, in double precision, is at least `similarity` and they collide often enough, which
    pairs at the threshold do with probability `recall` and equal vectors always do. n_links counts the other rows linked
    to a row's vector; component_id is the least vec_id that links lead to. Vectors that are null, empty or zero, or hold
    a component that is null, infinite or not a number, are linked with nothing, not even with their like; vectors of
    different lengths are not linked. Rows that repeat a vec_id are vectors of their own; a null vec_id counts as a
    link, is never a component's id unless all of it is null, and such a row is kept only then. Other columns are ignored; an
    empty table gives no rows.
    """
    half = half_window(similarity, recall)
    classes = vector_classes(vectors.select("vec_id", "embedding"))
    sketched = sketches(classes, half)
    found = stored(block_links(block_pairs(sketched, block), similarity, half), "vector-links")
    degree = found.groupBy("node").agg(F.sum("n").alias("n"))
    tied = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = stored(classes.join(degree, "node", "left").join(tied, "node", "left").withColumn("label", F.coalesce("label", "node")), "vector-labels")
    least = named.groupBy("label").agg(F.min("least").alias("component"))
    known = named.join(least, "label").select("embedding", F.col("component"), (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n"), F.lit(True).alias("usable"))
    component = F.when(F.col("usable"), F.col("component")).otherwise(F.col("vec_id"))
    return (
        vectors.select("vec_id", "embedding")
        .join(known, "embedding", "left")
        .select("vec_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"), component.cast("bigint").alias("component_id"))
        .withColumn("kept", F.expr("vec_id <=> component_id"))
    )
