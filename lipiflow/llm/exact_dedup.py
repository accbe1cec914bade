"""Grace hash deduplication of whole texts.

A task first collapses equal texts of its own input, so that a text which a third of all rows share leaves
each task once. The collapsed texts are then partitioned by hash over the cluster and collapsed again. Both
steps run the same Grace table: records go to an open-addressing table while they fit the memory bound;
beyond it they are partitioned by further hash bits to spill files, and each file is handled alike,
recursively. Table entries are equal only if their complete contents are.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import stored

#: Content bytes that one table holds, and spill files for each level.
TABLE_BYTES, FANOUT = 48 << 20, 16
MAX_DEPTH = 12


def _above(a: tuple, b: tuple) -> bool:
    """Members are (doc_id, row); a null id is below all others, of equal ids the least row stays."""
    if a[0] == b[0]:
        return a[1] < b[1]
    return b[0] is None or (a[0] is not None and a[0] > b[0])


class ContentTable:
    """Open addressing with linear probing; an entry is (hash, content, first member, largest member, records)."""

    def __init__(self):
        self.slots = np.full(1024, -1, np.int64)
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.first: list = []
        self.largest: list = []
        self.times: list[int] = []
        self.bytes = 0

    def _slot(self, h: int, content: bytes) -> int:
        """The slot of the content, or the empty one where it belongs."""
        mask = len(self.slots) - 1
        i = h & mask
        while (e := self.slots[i]) >= 0 and not (self.hashes[e] == h and self.contents[e] == content):
            i = (i + 1) & mask
        return i

    def find(self, h: int, content: bytes) -> int:
        return int(self.slots[self._slot(h, content)])

    def add(self, h: int, content: bytes, first, largest, times: int) -> int:
        i = self._slot(h, content)
        e = int(self.slots[i])
        if e < 0:
            e = self.slots[i] = len(self.contents)
            for column, x in ((self.hashes, h), (self.contents, content), (self.first, first), (self.largest, largest), (self.times, times)):
                column.append(x)
            self.bytes += len(content) + 200
            if len(self.contents) * 2 > len(self.slots):
                self._grow()
            return int(e)
        if _above(largest, self.largest[e]):
            self.largest[e] = largest
        self.times[e] += times
        return e

    def _grow(self) -> None:
        self.slots = np.full(len(self.slots) * 4, -1, np.int64)
        mask = len(self.slots) - 1
        for e, h in enumerate(self.hashes):
            i = h & mask
            while self.slots[i] >= 0:
                i = (i + 1) & mask
            self.slots[i] = e


def _local_folder() -> str | None:
    """Where Spark lets a task keep files, so that they count and go with the executor's own."""
    where = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
    return where if where and os.path.isdir(where) else None


def grace(records: Iterable[tuple], limit: int = TABLE_BYTES, each: int = 0, depth: int = 0) -> Iterator[list[tuple] | ContentTable]:
    """Yields lists of (member, first member of the same content), and full tables that share no content.

    records are (content, member, largest, times); a table comes after the lists of all its records. Once the table
    holds `limit` bytes, of which `each` record takes some, records of new contents go to spill files by four bits of their hash.
    """
    table, files, paths, told = ContentTable(), None, [], []
    shift = 64 + 4 * depth
    try:
        for content, member, largest, times in records:
            h = int.from_bytes(hashlib.blake2b(content, digest_size=16).digest(), "little")
            low = h & 0xFFFFFFFFFFFFFFFF
            if files is None and table.bytes > limit and depth < MAX_DEPTH:
                folder = tempfile.mkdtemp(prefix="grace-", dir=_local_folder())
                paths = [os.path.join(folder, str(i)) for i in range(FANOUT)]
                files = [open(p, "wb", 1 << 16) for p in paths]
            if files is not None and table.find(low, content) < 0:
                pickle.dump((content, member, largest, times), files[(h >> shift) % FANOUT], 5)
                continue
            e = table.add(low, content, member, largest, times)
            table.bytes += each
            told.append((member, table.first[e]))
            if len(told) == 4096:
                yield told
                told = []
        yield told
        yield table
        del table, told
        for f in files or ():
            f.close()
        for p in paths:
            yield from grace(_unspilled(p), limit, each, depth + 1)
            os.unlink(p)
    finally:
        for f in files or ():
            f.close()
        for p in paths:
            if os.path.exists(p):
                os.unlink(p)
        if paths:
            os.rmdir(os.path.dirname(paths[0]))


def _unspilled(path: str) -> Iterator[tuple]:
    with open(path, "rb", 1 << 20) as f:
        while True:
            try:
                yield pickle.load(f)
            except EOFError:
                return


_LOCAL = "doc_id long, row string, text_hash long, group_key string, text_sha256 string, content binary, largest long, largest_row string, times long"
_GLOBAL = "group_key string, keep_id long, keep_row string, group_size long"


def _batch(rows: list[tuple], types: str) -> pa.RecordBatch:
    arrow = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [pa.field(c.split()[0], arrow[c.split()[1]]) for c in types.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(fields)], schema=pa.schema(fields))


def _collapse_local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each record with its group's key in this task, and a row with content for each group."""
    task = uuid.uuid4().hex[:16]

    def records():
        n = 0
        for b in batches:
            for doc, text, text_hash in zip(b.column("doc_id").to_pylist(), b.column("text"), b.column("text_hash").to_pylist()):
                content = ("" if (t := text.as_py()) is None else t).encode("utf-8", "surrogatepass").lower()  # bytes: A-Z only
                row = f"{task}-{n:012d}"
                yield content, (doc, row, text_hash, hashlib.sha256(content).hexdigest()), (doc, row), 1
                n += 1

    for found in grace(records()):
        if isinstance(found, list):  # a row goes out as soon as its group is known
            yield _batch([(doc, row, text_hash, first[1], sha, None, None, None, None) for (doc, row, text_hash, sha), first in found], _LOCAL)
            continue
        rows, held = [], 0
        for first, content, largest, times in zip(found.first, found.contents, found.largest, found.times):
            rows.append((None, None, None, first[1], None, content, *largest, times))
            held += len(content)
            if held > 4 << 20:
                yield _batch(rows, _LOCAL)
                rows, held = [], 0
        if rows:
            yield _batch(rows, _LOCAL)


def _collapse_global(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each group key of a task, what the whole group comes to: keep_id, keep_row and group_size."""
    told: list[tuple] = []

    def records():
        for b in batches:
            columns = (b.column(c).to_pylist() for c in ("group_key", "largest", "largest_row", "times"))
            for key, largest, row, times, content in zip(*columns, b.column("content")):
                yield content.as_py(), (key,), (largest, row), times

    for found in grace(records(), each=200):
        if isinstance(found, list):
            told += found
            continue
        of = {first[0]: (*largest, times) for first, largest, times in zip(found.first, found.largest, found.times)}
        for a in range(0, len(told), 10_000):
            yield _batch([(member[0], *of[first[0]]) for member, first in told[a : a + 10_000]], _GLOBAL)
        told.clear()


def exact_rows(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash (of the text as it is), keep_id, group_size, kept, text_sha256: one row for each row of docs."""
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    local = stored(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(_collapse_local, _LOCAL), "exact-dedup")
    groups = (
        local.where(F.col("content").isNotNull())
        .select("group_key", "content", "largest", "largest_row", "times")
        .repartition(n, F.xxhash64("content"))
        .mapInArrow(_collapse_global, _GLOBAL)
    )
    rows = local.where(F.col("content").isNull()).select("doc_id", "row", "text_hash", "group_key", "text_sha256")
    return rows.join(groups, "group_key").select(
        "doc_id", "text_hash", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256"
    )


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of docs.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. One row of a group stays, that of the
    largest doc_id; a null doc_id counts below all others, and of rows that repeat the largest id one is kept. Rows that
    repeat both text and doc_id are members of their group each. Other columns are ignored; an empty table gives no rows.
    """
    return exact_rows(docs).drop("text_hash")
