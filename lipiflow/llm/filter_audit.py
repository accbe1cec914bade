"""Interaction audit of five filters: what each removes, alone and behind the others, in all orders.

Duplicates are found by sorting: rows are range-partitioned by text fingerprint and doc_id and sorted by fingerprint, full text
and doc_id, and each row is compared with its predecessor. A text that very many rows hold thus spreads over several
partitions. A partition can't see the rows before it, so the rows at its head that no predecessor decides stay open,
and each partition also returns the texts of its first and last fingerprint with their least doc_id: a row or two.
Where the same text begins with a smaller doc_id elsewhere, the open rows fail. Rows become counters by part, mask of failed
filters and labels, which add up; the figures of all orders are sums over these counters.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import stored, tasks_of

FILTERS = "ABCDE"
SEPARATORS, SPACES = "\t\n\x0b\x0c\r", "     "
_NONE = np.iinfo(np.int64).max
_ROW = "kind int, doc_id long, part string, mask int, head long, fingerprint long, text string, least long"


def fingerprint(text):
    """What range partitions and sorting begin with; texts that share one are told apart by comparing them."""
    return F.xxhash64(text)


def fingerprinted(docs: DataFrame) -> DataFrame:
    """doc_id, part, text and the text's fingerprint; a null text is empty, a null lang is part ''."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumn("fingerprint", fingerprint("text"))


def masked(rows: DataFrame) -> DataFrame:
    """doc_id, part, text, fingerprint, and mask: bits 1, 2, 4 and 8 for failing A, B, C and D."""
    words = F.array_remove(F.split(F.translate("text", SEPARATORS, SPACES), " "), "")
    sized = rows.withColumn("w", words).select(
        "doc_id", "part", "text", "fingerprint",
        F.size("w").alias("n"),
        F.size(F.array_distinct("w")).alias("d"),
        F.length("text").alias("points"),
        F.length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "")).alias("rest"),
    )
    fails = [F.col("n") < 200, F.col("d") * 100 < F.col("n") * 50, (F.col("points") - F.col("rest")).cast("long") * 100 > F.col("points").cast("long") * 3, F.col("text").rlike(r"[#$%&*|]")]
    mask = sum(F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails))
    return sized.select("doc_id", "part", "text", "fingerprint", mask.cast("int").alias("mask"))


class _Runs:
    """The runs of equal texts of one fingerprint, with the least doc_id of each: a single one but for fingerprints that clash."""

    def __init__(self, fingerprint: int | None = None):
        self.fingerprint, self.least = fingerprint, {}

    def add(self, text: str, least: int) -> None:
        self.least[text] = min(least, self.least.get(text, _NONE))


def _compare(batches):
    """Rows of a sorted partition with bit 16 for repeated texts and a number where that is open, then its edge texts."""
    base = TaskContext.get().partitionId() << 32
    text_before, hash_before, least_before = None, None, _NONE
    first, last = _Runs(), _Runs()
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        text, mask, part = batch.column("text"), batch.column("mask").to_numpy(), batch.column("part")
        hashes = batch.column("fingerprint").to_numpy()
        known = pc.is_valid(batch.column("doc_id")).to_numpy(zero_copy_only=False)
        ids = pc.fill_null(batch.column("doc_id"), _NONE).to_numpy()
        new = np.ones(n, bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | ~pc.equal(text.slice(1), text.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        new[0] = not (hash_before == hashes[0] and text_before == text[0].as_py())
        starts = np.flatnonzero(np.append(True, new[1:]))
        least = np.minimum.reduceat(ids, starts)
        if not new[0]:
            least[0] = min(least[0], least_before)
        run = np.cumsum(np.append(True, new[1:])) - 1
        repeated = known & (least[run] < ids)
        text_before, hash_before, least_before = text[n - 1].as_py(), hashes[-1], least[-1]
        if first.fingerprint is None:
            first.fingerprint = hashes[0]
        if last.fingerprint != hashes[-1]:
            last = _Runs(hashes[-1])
        for k in np.flatnonzero((hashes[starts] == first.fingerprint) | (hashes[starts] == last.fingerprint)):
            for edge in {id(first): first, id(last): last}.values():
                if hashes[starts[k]] == edge.fingerprint:
                    edge.add(text[int(starts[k])].as_py(), int(least[k]))
        numbers = {t: base + k for k, t in enumerate(first.least)}
        head = np.full(n, -1, np.int64)
        for k in np.flatnonzero(hashes[starts] == first.fingerprint):
            head[run == k] = numbers[text[int(starts[k])].as_py()]
        head[repeated | ~known] = -1
        nothing = lambda kind: pa.nulls(n, kind)
        columns = [pa.array(np.zeros(n, np.int32)), batch.column("doc_id"), part, pa.array((mask + 16 * repeated).astype(np.int32)), pa.array(head, mask=head < 0), nothing(pa.int64()), nothing(pa.string()), nothing(pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _ROW.split(", ")])
    edges = [(base + k, first.fingerprint, t, x) for k, (t, x) in enumerate(first.least.items())]
    if last.fingerprint != first.fingerprint:
        edges += [(None, last.fingerprint, t, x) for t, x in last.least.items()]
    if edges:
        heads, prints, texts, least = zip(*edges)
        n = len(edges)
        columns = [pa.array(np.ones(n, np.int32)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), pa.nulls(n, pa.int32()), pa.array(heads, pa.int64()), pa.array(prints, pa.int64()), pa.array(texts, pa.string()), pa.array(least, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _ROW.split(", ")])


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask of each row of docs: bit k of the mask says that filter k of FILTERS fails."""
    # bounds are drawn over fingerprints and ids, so that no texts go to the driver; equal texts need not share a partition
    dealt = fingerprinted(docs).repartitionByRange(tasks_of(docs), "fingerprint", "doc_id").sortWithinPartitions("fingerprint", "text", "doc_id")
    # the masks come after the exchange: before it they would be made once more, for the bounds
    compared = stored(masked(dealt).mapInArrow(_compare, _ROW), "audit-rows", partition_by="kind")
    edges = compared.where("kind = 1").select("head", "fingerprint", "text", "least")
    earliest = edges.groupBy("fingerprint", "text").agg(F.min("least").alias("earliest"))
    late = edges.where("head IS NOT NULL").join(earliest, ["fingerprint", "text"]).where("earliest < least").select("head", F.lit(16).alias("repeats"))
    # at most one row for each text of a task's first fingerprint: two numbers a task
    slim = compared.where("kind = 0").select("doc_id", "part", "mask", "head").join(F.broadcast(late), "head", "left")
    return slim.select("doc_id", "part", (F.col("mask") + F.coalesce("repeats", F.lit(0))).alias("mask"))


def counters(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: additive counts of rows; a row is good, or toxic, if any label of its id says so."""
    told = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = failed.join(told, "doc_id", "left")
    total = lambda c: F.sum(F.coalesce(c, F.lit(0))).cast("bigint").alias(c)
    return rows.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), total("good"), total("toxic"))


def steps() -> list[tuple[str, int, int, int]]:
    """Order, step from 1, bit of the step's filter, and mask of those before it."""
    found = []
    for order in permutations(range(len(FILTERS))):
        name = "".join(FILTERS[i] for i in order)
        found += [(name, k + 1, 1 << f, sum(1 << x for x in order[:k])) for k, f in enumerate(order)]
    return found


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and counts of documents: one row for each part, order of the filters and step.

    A row of docs is a document, whatever other rows share its id; a row that repeats a doc_id and text is not identical to
    a smaller doc_id's. A null doc_id is neither smaller than another nor repeats one. A null text is empty, and empty texts are equal;
    a null lang is part ''. Labels without a document count nowhere, null labels say nothing. Other columns are
    ignored; an empty table gives no rows.
    """
    order, step, bit, before = (F.lit(list(x)) for x in zip(*steps()))
    table = F.arrays_zip(order.alias("filter_order"), step.alias("step"), bit.alias("bit"), before.alias("before"))
    rows = counters(failures(docs), labels).select("part", "mask", "n", "good", "toxic", F.inline(table).alias("filter_order", "step", "bit", "before"))
    fails, earlier = F.expr("mask & bit <> 0"), F.expr("mask & before <> 0")
    total = lambda when, what, name: F.sum(F.when(when, F.col(what)).otherwise(0)).cast("bigint").alias(name)
    return rows.groupBy("part", "filter_order", "step").agg(
        total(F.expr("mask & (before | bit) = 0"), "n", "kept"),
        total(fails & ~earlier, "n", "removed"),
        total(fails & earlier, "n", "redundant"),
        total(F.expr("mask = bit"), "n", "unique_fails"),
        total(fails & ~earlier, "good", "good_lost"),
        total(fails & ~earlier, "toxic", "toxic_lost"),
        # of 120 orders, each of the filters that a document fails comes first in an equal number
        F.sum(F.when(fails, F.expr("n * 120 div bit_count(mask)")).otherwise(0)).cast("bigint").alias("shapley"),
    )
