"""What the training-data operators share: stored intermediate tables, word spans and fingerprints.

Words are the maximal runs of bytes other than 0x20 and 0x09 to 0x0D of a text's UTF-8 form.
Fingerprints are 64-bit and computed by numpy over a whole Arrow batch; they depend on the bytes only,
so equal words get equal fingerprints in every task without any exchange.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass handles; a longer document forms a pass of its own.
PASS_BYTES = 1 << 19

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_C1, _C2, _C3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def documents(spark, sf_dir: str):
    """The table `documents` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark) -> str:
    """The folder that all executors share; a temporary one only where the session names none and runs on this machine alone."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = found.get() if found.isDefined() else None
        if not where:
            master = spark.sparkContext.master
            if not master.startswith("local") or master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            where = tempfile.mkdtemp(prefix="lipiflow-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def stored(df, name: str, partition_by: str | None = None):
    """Writes df to the shared folder and returns the table that reads it: lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lipiflow/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tasks_of(df) -> int:
    """Tasks to deal rows of df to: the session's shuffle partitions, or as many as df has input splits if that is more."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions(), 1)


def surviving(docs, rows):
    """The rows of docs that `rows` (doc_id, text_hash, kept) keeps, with all their columns.

    A row is found by its id and its text's hash. Rows that repeat both are one document, of which one row stays.
    """
    names = [f"_{i}" for i in range(len(docs.columns))]  # whatever the columns are called
    key = ["_id", "_no_id", "_text_hash"]  # never null, so that the join keeps the partitions of dropDuplicates
    parts = lambda text_hash: (F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.col("doc_id").isNull(), text_hash)
    own = docs.select("*", *parts(F.xxhash64("text"))).toDF(*names, *key).dropDuplicates(key)
    kept = rows.where("kept").select(*parts(F.col("text_hash"))).toDF(*key).distinct()
    return own.join(kept, key, "left_semi").select(*names).toDF(*docs.columns)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _C2
    x = (x ^ (x >> np.uint64(27))) * _C3
    return x ^ (x >> np.uint64(31))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def passes(batch: pa.RecordBatch, column: str = "text", limit: int = PASS_BYTES):
    """Slices of a batch of about `limit` bytes of text."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    if not len(size):
        return
    group = np.cumsum(size) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), len(size)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


class Words:
    """The words of a slice of texts: byte spans, the document each belongs to, and fingerprints."""

    def __init__(self, texts: pa.Array, lower: bool = False, separator: np.ndarray = _SEPARATOR):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if texts.offset or len(texts.buffers()) < 3 or texts.buffers()[2] is None:
            texts = pa.concat_arrays([texts, pa.array([""], pa.large_string())]).slice(0, len(texts))
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        body = texts.buffers()[2]
        raw = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.zeros(0, np.uint8)
        self.bounds = offsets - offsets[0]
        n = len(raw)
        self.data = np.zeros(n + 8, np.uint8)
        self.data[:n] = _LOWER[raw] if lower else raw
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = ~separator[raw]
        edge = np.zeros(n + 1, bool)
        edge[self.bounds] = True
        starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
        self.starts = starts[starts < n] if n else starts[:0]
        ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
        self.ends = ends[ends > 0] if n else ends[:0]
        #: Word index at which each document begins, with the total at the end.
        self.first = np.searchsorted(self.starts, self.bounds, "left")
        self.n = len(self.starts)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self, seed: int = 0) -> np.ndarray:
        """Fingerprints of the words, eight bytes a step."""
        at, left = self.starts.copy(), self.ends - self.starts
        h = mix(left.astype(np.uint64) * _C1 + np.uint64(seed * 2 + 1))
        rows = np.lib.stride_tricks.as_strided(self.data, (max(len(self.data) - 7, 1), 8), (1, 1))
        alive = np.arange(self.n)
        while len(alive):
            word = np.ascontiguousarray(rows[at[alive]]).view(np.uint64).ravel()
            short = left[alive] < 8
            keep = (np.uint64(1) << (np.minimum(left[alive], 7).astype(np.uint64) * np.uint64(8))) - np.uint64(1)
            h[alive] = mix(h[alive] * _C1 + np.where(short, word & keep, word))
            left[alive] -= 8
            at[alive] += 8
            alive = alive[left[alive] > 0]
        return h

    def prefixes(self, points: int) -> Words:
        """The words cut to their first code points."""
        begins = np.flatnonzero((self.data[: self.bounds[-1]] & 0xC0) != 0x80)
        at = np.searchsorted(begins, self.starts) + points
        out = object.__new__(Words)
        limit = np.append(begins, self.bounds[-1])[np.minimum(at, len(begins))]
        out.data, out.bounds, out.starts, out.ends, out.first, out.n = self.data, self.bounds, self.starts, np.minimum(limit, self.ends), self.first, self.n
        return out

    def kept_text(self, document: int, keep: np.ndarray) -> bytes:
        """The kept words of a document, joined by one space."""
        a, b = self.first[document], self.first[document + 1]
        body = self.data
        return b" ".join(body[s:e].tobytes() for s, e, k in zip(self.starts[a:b], self.ends[a:b], keep) if k)


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """A fingerprint of each `width` consecutive values, by doubling: len(h) - width + 1 of them."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, at, span, power = None, 0, 1, h
    while span <= width:
        if width & span:
            part = power[at : at + n]
            out = part.copy() if out is None else mix(out * _C1 + part)
            at += span
        if span * 2 <= width:
            power = mix(power[:-span] * _C1 + (power[span:] ^ _C3))
        span *= 2
    return out
