"""Keyed state in a state store on disk: what installs have learned and forgotten, and counters flushed after some words.

State is read back from the checkpoint itself; no table repeats it batch by batch.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import islice

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.scores import HALF_LIFE_DAYS

# Fixed value: words after which counters are flushed.
FLUSH_EVERY = 20
#: Rows of an install that are summed up before they meet the state.
PART = 10_000
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
_RATE = math.log(2) / (HALF_LIFE_DAYS * 86400)
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def on_disk(spark: SparkSession):
    """State stores that hold their keys on disk, for streams that are started inside."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    # the process that reads a processor's schemas looks for this package where tasks do
    paths = [p for p in spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def _run(stream: DataFrame, checkpoint: str, mode: str) -> None:
    with on_disk(stream.sparkSession):
        stream.writeStream.format("noop").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _both(a: tuple[float, float] | None, b: tuple[float, float]) -> tuple[float, float]:
    """The sum of two decaying counts (count, time), as of the later time."""
    if a is None:
        return b
    newest = max(a[1], b[1])
    return a[0] * math.exp(-_RATE * (newest - a[1])) + b[0] * math.exp(-_RATE * (newest - b[1])), newest


class Learned(StatefulProcessor):
    """For each install a map from (roman, word) to a count that decays, and when the install last forgot everything."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getMapState("counts", "roman string, word string", "count double, last double")
        self.forgotten = handle.getValueState("forgotten", "t double")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        since, known = (self.forgotten.get() or (-math.inf,))[0], self.counts.exists()
        while part := list(islice(rows, PART)):
            if any(forget for *_, forget in part):
                since = max([since, *(t for *_, t, forget in part if forget and t is not None)])
                self.forgotten.update((since,))
                self.counts.clear()
                known = False
            # commits of a part are summed up first: the state is touched once for each word
            sums: dict[tuple, tuple[float, float]] = {}
            for _, roman, word, t, forget in part:
                if not forget and t is not None and t > since:
                    sums[roman, word] = _both(sums.get((roman, word)), (1.0, t))
            for entry, of_part in sums.items():
                self.counts.updateValue(entry, _both(self.counts.getValue(entry) if known else None, of_part))
            known = known or bool(sums)
        return iter(())

    def close(self) -> None:
        pass


def learn(commits: DataFrame, checkpoint: str) -> None:
    """Takes what has come of a stream of (install, roman, word, t, forget) into the state of the checkpoint.

    A row with forget set clears all that its install has learned and hides commits up to its time that come later. Late commits
    else count by what they have decayed to. An install's words lie in the state store, not in memory; its rows are
    handled in parts of PART.
    """
    rows = commits.select("install", "roman", "word", F.col("t").cast("double").alias("t"), F.coalesce("forget", F.lit(False)).alias("forget"))
    with on_disk(commits.sparkSession):
        kept = rows.groupBy("install").transformWithState(Learned(), "install long", "Update", "None")
        _run(kept, checkpoint, "update")


def learned(spark: SparkSession, checkpoint: str) -> DataFrame:
    """install, roman, word, count, last: the state of a checkpoint as its last batch left it."""
    state = spark.read.format("statestore").option("stateVarName", "counts").load(checkpoint)
    return state.select("key.install", "user_map_key.*", "user_map_value.*")


_PART = Row("install", "h", "words", "top1_taken", "retyped")
_TOP1, _RETYPED, _FLUSH = 1, 2, 4


class Flushed(StatefulProcessor):
    """For each install the counters of its hour so far; a row leaves after FLUSH_EVERY words, when the hour changes, and when asked."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.so_far = handle.getValueState("so_far", "h string, words long, top1_taken long, retyped long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        asked, words = False, []
        for _, h, ts, marks in rows:
            if marks & _FLUSH:
                asked = True
            else:
                late = ts is None or ts != ts  # words without a time come last
                words.append((late, 0 if late else ts, h, marks))
        words.sort(key=lambda w: w[:2])
        held = tuple(self.so_far.get() or (None, 0, 0, 0))
        h, n, top1_taken, retyped = held
        for _, _, hour, marks in words:
            if n and hour != h:
                yield _PART(key[0], h, n, top1_taken, retyped)
                n = top1_taken = retyped = 0
            h, n, top1_taken, retyped = hour, n + 1, top1_taken + bool(marks & _TOP1), retyped + bool(marks & _RETYPED)
            if n == FLUSH_EVERY:
                yield _PART(key[0], h, n, top1_taken, retyped)
                n = top1_taken = retyped = 0
        if n and asked:
            yield _PART(key[0], h, n, top1_taken, retyped)
            n = top1_taken = retyped = 0
        if (h, n, top1_taken, retyped) != held:
            self.so_far.update((h, n, top1_taken, retyped))

    def close(self) -> None:
        pass


def flushed(commits: DataFrame) -> DataFrame:
    """A stream of install, h, words, top1_taken, retyped: parts of hourly counters, of FLUSH_EVERY words at most, that add up to them.

    commits: install, h, ts, top1_taken, retyped, flush. A row with flush set ends the part of its install after all words that
    come with it, and counts for nothing else. The words that have come with one batch are counted in their order.
    """
    with on_disk(commits.sparkSession):
        marks = sum(F.coalesce(c, F.lit(False)).cast("int") * bit for c, bit in (("top1_taken", _TOP1), ("retyped", _RETYPED), ("flush", _FLUSH)))
        ts = F.unix_micros("ts") if dict(commits.dtypes)["ts"] == "timestamp" else F.col("ts")
        rows = commits.select("install", "h", ts.alias("ts"), marks.alias("marks"))
        return rows.groupBy("install").transformWithState(Flushed(), "install long, h string, words long, top1_taken long, retyped long", "Append", "None")
