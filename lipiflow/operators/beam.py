"""Beam search over a model that scores the next symbol, for whole batches of inputs at once, and a model counted from a table.

A model is loaded once a task. Its start(inputs) gives the state of each input before anything is written, an array with a row
for each; step(state, last) gives log probabilities over the symbols and the state after the last symbol, row by row, and
symbols[0] ends an output.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# The longest output, and letters of output that each letter of input allows, beside some more.
LONGEST, PER_LETTER, SOME_MORE = 60, 3, 5
END = 0


def beam_search(model, inputs: list[str], beam: int, best: int, most: list[int] | None = None) -> list[list[tuple[str, float]]]:
    """For each input, outputs with their log probability over their length, the best first.

    The frontier of each input holds at most `beam` outputs. Of all continuations, the 2 * beam best are looked at, in order of
    score, of the output they continue, and of the symbol. An end counts only among the first `beam` of them and never
    as the first symbol; others go on, `beam` at most. A search ends with `beam` finished outputs, with none left, or at the
    greatest length, where outputs that are not finished count if none is. An empty input has no output.
    """
    n = len(inputs)
    most = most or [min(LONGEST, PER_LETTER * len(x) + SOME_MORE) if x else 0 for x in inputs]
    state = model.start(inputs)[:, None]  # input, output of its frontier, ..
    score, last = np.zeros((n, 1)), np.full((n, 1), END)
    written = np.zeros((n, 1, 0), np.int32)
    finished: list[list[tuple[float, tuple]]] = [[] for _ in range(n)]
    active = np.array([i for i in range(n) if most[i]], np.int64)
    state, score, last, written = (x[active] for x in (state, score, last, written))
    for step in range(max(most, default=0)):
        if not len(active):
            break
        rows, width = score.shape
        logp, state = model.step(state.reshape(rows * width, *state.shape[2:]), last.ravel())
        state = state.reshape(rows, width, *state.shape[1:])
        symbols = logp.shape[1]
        total = (score[:, :, None] + logp.reshape(rows, width, symbols)).reshape(rows, width * symbols)
        if step == 0:
            total[:, END::symbols] = -np.inf
        # a stable sort keeps the order of outputs and symbols among equal scores
        order = np.argsort(-total, axis=1, kind="stable")[:, : 2 * beam]
        value = np.take_along_axis(total, order, axis=1)
        source, symbol = order // symbols, order % symbols
        real = np.isfinite(value)
        ends = real & (symbol == END)
        for r, j in zip(*np.nonzero(ends[:, :beam])):
            finished[active[r]].append((value[r, j] / (step + 1), tuple(written[r, source[r, j]])))
        goes = real & ~ends
        goes &= np.cumsum(goes, axis=1) <= beam
        width = max(int(goes.sum(axis=1).max()), 1)
        # the places of those that go on, filled up with one that has no score
        at = np.argsort(~goes, axis=1, kind="stable")[:, :width]
        alive = np.take_along_axis(goes, at, axis=1)
        source, last = np.take_along_axis(source, at, axis=1), np.take_along_axis(symbol, at, axis=1)
        score = np.where(alive, np.take_along_axis(value, at, axis=1), -np.inf)
        rows_of = np.arange(rows)[:, None]
        state, written = state[rows_of, source], np.concatenate([written[rows_of, source], last[:, :, None].astype(np.int32)], axis=2)
        stay = np.zeros(rows, bool)
        for r, i in enumerate(active):
            stay[r] = len(finished[i]) < beam and alive[r].any()
            if stay[r] and step + 1 == most[i]:
                stay[r] = False
                if not finished[i]:
                    finished[i] = [(score[r, j] / most[i], tuple(written[r, j])) for j in range(width) if alive[r, j]]
        active, state, score, last, written = (x[stay] for x in (active, state, score, last, written))
    out = []
    for found in finished:
        unlike: dict[str, float] = {}
        for value, symbols in sorted(found, key=lambda x: -x[0]):
            unlike.setdefault("".join(model.symbols[s] for s in symbols), float(value))
        out.append([(w, s) for w, s in unlike.items() if w][:best])
    return out


def decoded(inputs: DataFrame, load: Callable[[], object], beam: int, best: int, column: str = "roman", batch: int = 1024) -> DataFrame:
    """column, rank, word, score: for each row of inputs, the `best` outputs of a beam search; null and empty inputs have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for b in batches:
            for at in range(0, b.num_rows, batch):
                texts = [x or "" for x in b.column(0).slice(at, batch).to_pylist()]
                rows = [(t, i, w, s) for t, found in zip(texts, beam_search(model, texts, beam, best)) for i, (w, s) in enumerate(found, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else ((),) * 4, (pa.string(), pa.int32(), pa.string(), pa.float64()))], names=["input", "rank", "word", "score"])

    return inputs.select(F.col(column).alias("input")).mapInArrow(run, "input string, rank int, word string, score double").withColumnRenamed("input", column)


class LetterModel:
    """log P(next | letter before, letter typed here), from counts of both pairs: the nth symbol stands at the nth letter typed."""

    def __init__(self, before: dict[tuple[str, str], int], typed: dict[tuple[str, str], int], smoothing: float = 0.1):
        letters = sorted({x for pair in (*before, *typed) for x in pair if x})
        self.symbols = ["", *letters]
        number = {x: i for i, x in enumerate(self.symbols)}
        self.number, n = number, len(self.symbols)
        tables = []
        for counts in (before, typed):
            table = np.full((n, n), smoothing)
            for (a, b), c in counts.items():
                table[number[a], number[b]] += c
            tables.append(np.log(table))
        joint = tables[0][:, None] + tables[1][None]
        joint -= joint.max(axis=2, keepdims=True)
        self.table = joint - np.log(np.exp(joint).sum(axis=2, keepdims=True))

    def start(self, inputs: list[str]) -> np.ndarray:
        """A row for each input: how far it is, then its letters' numbers, and no letter beyond its end."""
        width = max(map(len, inputs), default=0) + 1
        rows = np.zeros((len(inputs), width + 1), np.int32)
        for r, x in zip(rows, inputs):
            r[1 : len(x) + 1] = [self.number.get(c, 0) for c in x]
        return rows

    def step(self, state: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        here = np.minimum(state[:, 0] + 1, state.shape[1] - 1)
        typed = state[np.arange(len(state)), here]
        after = state.copy()
        after[:, 0] += 1
        return self.table[last, typed], after


def letter_pairs(pairs: DataFrame) -> DataFrame:
    """kind, a, b, count: how often symbol b follows a (kind 'before') or stands at letter a (kind 'typed'), over (roman, word, count).

    A word ends with an empty symbol; letters beyond the end of roman or word are empty.
    """
    letters = lambda c, i: F.coalesce(F.substring(F.col(c), i, F.lit(1)), F.lit(""))
    rows = pairs.where("length(word) > 0").select("roman", "word", "count", F.explode(F.sequence(F.lit(1), F.length("word") + 1)).alias("i"))
    rows = rows.select("count", F.when(F.col("i") > 1, letters("word", F.col("i") - 1)).otherwise("").alias("prev"), letters("roman", F.col("i")).alias("typed"), letters("word", F.col("i")).alias("b"))
    pair = lambda kind, a: F.struct(F.lit(kind).alias("kind"), F.col(a).alias("a"))
    both = rows.select("count", "b", F.inline(F.array(pair("before", "prev"), pair("typed", "typed"))))
    return both.groupBy("kind", "a", "b").agg(F.sum("count").alias("count"))


def letter_model(pairs: DataFrame, most: int = 512, smoothing: float = 0.1) -> LetterModel:
    """The model of a table; its counts are at most the square of the alphabet, of which the `most` most frequent symbols are kept."""
    counts = letter_pairs(pairs)
    kept = counts.where("b <> ''").groupBy("b").agg(F.sum("count").alias("n")).orderBy(F.desc("n"), "b").limit(most)
    letters = {r.b for r in kept.collect()} | {""}
    rows = counts.where(F.col("a").isin(*letters) & F.col("b").isin(*letters)).collect()
    table = lambda kind: {(r.a, r.b): r["count"] for r in rows if r.kind == kind}
    return LetterModel(table("before"), table("typed"), smoothing)
