"""Substring deduplication by recompression.

The words of every text are renamed in rounds: maximal runs of a symbol become one symbol, then adjacent pairs
whose left symbol falls in one half of a split of all names and whose right one falls in the other. Names and
splits are fingerprints of what they stand for, hence global: equal pairs get equal names in every
partition and every round, with no dictionary to exchange. Each symbol knows the interval of words that its
making depends on; wherever those words recur, so does the symbol. Of the symbols whose interval lies
inside a window of 35 words, one of the highest round, that of the least name, is the window's anchor; it is the
same for equal windows.

Consecutive windows with one anchor form a segment. Spark groups segments by anchor: anchors found once end
there; where all segments of an anchor hold the same words, all their windows are repeated; the rest, one
segment for each distinct text, is verified window by window. Grouped counts combine before every exchange, and
joins only bring flags back to the segments.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.types as T
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import _C1, _C2, _C3, Words, mix, passes, signed, stored, window_hashes

WINDOW, ROUNDS = 35, 4


class Ranges:
    """Fingerprints of any ranges of a sequence of fingerprints."""

    _powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))
    _base = _C2
    _inverse = np.uint64(pow(int(_C2), -1, 1 << 64))

    def __init__(self, h: np.ndarray):
        if len(Ranges._powers[0]) < len(h) + 1:
            up = np.full(len(h) + 1, Ranges._base)
            down = np.full(len(h) + 1, Ranges._inverse)
            up[0] = down[0] = 1
            Ranges._powers = (np.cumprod(up), np.cumprod(down))
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(h * Ranges._powers[0][: len(h)], dtype=np.uint64)])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.sums[b] - self.sums[a]) * Ranges._powers[1][a] + (b - a).astype(np.uint64) * _C1)


class Symbols:
    """One level of a parse: names, word spans [a, b), and the words [lo, hi) that decide on the symbol."""

    def __init__(self, name, a, b, lo, hi, doc):
        self.name, self.a, self.b, self.lo, self.hi, self.doc = name, a, b, lo, hi, doc

    def merged(self, first: np.ndarray, name: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Symbols:
        """Symbols from `first` to before the next `first` become one."""
        last = np.append(first[1:], len(self.a)) - 1
        return Symbols(name, self.a[first], self.b[last], lo, hi, self.doc[first])

    def neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """Whether each symbol has one before and one after it in its document."""
        joined = self.doc[1:] == self.doc[:-1]
        return np.append(False, joined), np.append(joined, False)


def compress_runs(s: Symbols, words: np.ndarray) -> Symbols:
    """Maximal runs of a symbol become one. That a run ends is seen from the next word, or from the next symbol if that word fits."""
    before, after = s.neighbours()
    n = len(s.name)
    new = np.ones(n, bool)
    new[1:] = ~before[1:] | (s.name[1:] != s.name[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], n) - 1
    length = last - first + 1
    name = np.where(length > 1, mix(s.name[first] * _C1 + length.astype(np.uint64)), s.name[first])
    lo, hi = s.lo[first].copy(), s.hi[last].copy()
    # to the left: the word before, or the whole symbol before where that word is the run's last word; a document's edge decides nothing
    has = before[first]
    prev = np.maximum(first - 1, 0)
    plain = words[np.maximum(s.a[first] - 1, 0)] != words[s.b[last] - 1]
    lo = np.where(has, np.minimum(lo, np.where(plain, s.a[first] - 1, s.lo[prev])), s.a[first] - 1)
    has = after[last]
    follow = np.minimum(last + 1, n - 1)
    plain = words[np.minimum(s.b[last], len(words) - 1)] != words[s.a[first]]
    hi = np.where(has, np.maximum(hi, np.where(plain, s.b[last] + 1, s.hi[follow])), s.b[last] + 1)
    return s.merged(first, name, lo, hi)


def compress_pairs(s: Symbols, round_: int) -> Symbols:
    """Adjacent symbols become one where the left one's side of the round's split is 0 and the right one's is 1."""
    before, after = s.neighbours()
    n = len(s.name)
    side = (mix(s.name + np.uint64(round_ * int(_C3) & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(40)) & np.uint64(1)
    joins = np.zeros(n, bool)  # with the symbol before
    joins[1:] = before[1:] & (side[:-1] == 0) & (side[1:] == 1)
    first = np.flatnonzero(~joins)
    paired = np.append(joins[1:], False)[first]
    nxt, prev = np.minimum(first + 1, n - 1), np.maximum(first - 1, 0)
    name = np.where(paired, mix(mix(s.name[first] + _C3) * _C1 + s.name[nxt]), s.name[first])
    lo, hi = s.lo[first], np.where(paired, s.hi[nxt], s.hi[first])
    # a symbol alone has been held against its neighbour on the other side of the split
    alone0, alone1 = ~paired & (side[first] == 0), ~paired & (side[first] == 1)
    hi = np.where(alone0, np.where(after[first], np.maximum(hi, s.hi[nxt]), s.b[first] + 1), hi)
    lo = np.where(alone1, np.where(before[first], np.minimum(lo, s.lo[prev]), s.a[first] - 1), lo)
    return s.merged(first, name, lo, hi)


def levels(h: np.ndarray, doc: np.ndarray, rounds: int = ROUNDS) -> Iterator[Symbols]:
    """The words, then what each round makes of them."""
    at = np.arange(len(h))
    s = Symbols(h, at, at + 1, at, at + 1, doc)
    yield s
    for r in range(1, rounds + 1):
        s = compress_pairs(compress_runs(s, h), r)
        yield s


def segments(h: np.ndarray, first: np.ndarray, window: int = WINDOW, rounds: int = ROUNDS, second: np.ndarray | None = None):
    """(window starts, anchor keys, span fingerprints, document) of the segments of documents that begin at `first`.

    h are the words' hashes, from which names are made; spans are told apart by `second`, hashes under another seed.
    """
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    n = len(h)
    starts = np.flatnonzero(doc[: max(n - window + 1, 0)] == doc[window - 1 :]) if n >= window else np.zeros(0, np.int64)
    if not len(starts):
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    anchor, key = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.uint64)
    ranges = Ranges(h)
    edge = first[doc]  # where each word's document begins
    open_ = np.arange(len(starts))
    for level, s in reversed(list(enumerate(levels(h, doc, rounds)))):
        if not len(open_):
            break
        fits = (s.lo >= edge[s.a]) & (s.hi - s.lo <= window)
        lo, hi, name = s.lo[fits], s.hi[fits], s.name[fits]
        if not len(lo):
            continue
        i = starts[open_]
        # symbols inside the window: from the first that begins in it to the last that ends in it; the least name of them
        j, end = np.searchsorted(lo, i), np.searchsorted(hi, i + window, "right")
        rank = mix(name ^ _C3)
        inside = j < end
        i, j, end = i[inside], j[inside], end[inside]
        best, left = j.copy(), np.flatnonzero(j + 1 < end)
        step = 1
        while len(left):
            k = j[left] + step
            less = rank[k] < rank[best[left]]
            best[left[less]] = k[less]
            step += 1
            left = left[j[left] + step < end[left]]
        j = best
        got = open_[inside]
        anchor[got] = lo[j]
        key[got] = mix(ranges.of(lo[j], hi[j]) + mix(name[j] + np.uint64(level)))
        open_ = open_[~inside]
    new = np.ones(len(starts), bool)
    new[1:] = (key[1:] != key[:-1]) | (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    at = np.flatnonzero(new)
    many = np.diff(np.append(at, len(starts)))
    begin = starts[at]
    other = Ranges(mix(h ^ _C3) if second is None else second)
    span = mix(other.of(begin, begin + many - 1 + window) + (anchor[at] - begin).astype(np.uint64) * _C2)
    return begin, key[at], span, many, doc[begin]


_ROW = "num long, doc long, row long, first int, keys array<long>, spans array<long>, starts array<int>, counts array<int>"


def _identified(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    return docs.select(*(F.col(c).alias(f"carried_{i}") for i, c in enumerate(carry)), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))


def _parse(window: int, rounds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        num = TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in passes(batch):
                w = Words(part.column("text"))
                got = segments(w.hashes(), w.first, window, rounds, w.hashes(seed=11))
                rows = part.num_rows
                if len(got[0]):
                    begin, key, span, many, doc = got
                    offsets = np.searchsorted(doc, np.arange(rows + 1)).astype(np.int32)
                    columns = [signed(key), signed(span), (begin - w.first[doc]).astype(np.int32), many.astype(np.int32)]
                    lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(c)) for c in columns]
                    out = pa.RecordBatch.from_arrays([pa.array(num + np.arange(rows)), part.column("doc"), part.column("row"), pa.array(np.zeros(rows, np.int32)), *lists], names=[c.split()[0] for c in _ROW.split(", ")])
                    yield out.filter(pa.array(np.diff(offsets) > 0))
                num += rows

    return run


def _window_rows(window: int):
    """The windows of the asked segments with two fingerprints each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in passes(batch):
                w = Words(part.column("text"))
                one, two = window_hashes(w.hashes(), window), window_hashes(w.hashes(seed=11), window)
                asked = part.column("asked")
                offsets = np.array(asked.offsets)
                start, count = (asked.flatten().field(i).to_numpy() for i in range(2))
                row = np.repeat(np.arange(part.num_rows), np.diff(offsets))
                each = np.repeat(np.arange(len(start)), count)
                local = start[each] + np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
                at = w.first[row[each]] + local
                take = pa.array(row[each])
                for a in range(0, len(each), 100_000):
                    c = slice(a, a + 100_000)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc").take(take[c]), part.column("row").take(take[c]), pa.array(signed(one[at[c]])), pa.array(signed(two[at[c]])), pa.array(local[c].astype(np.int32))],
                        names=["doc", "row", "w1", "w2", "start"],
                    )

    return run


def repeated_ranges(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """doc, row, ranges: array of (start, count), runs of window starts whose word sequence occurs at another place."""
    base = _identified(docs)
    parsed = stored(base.select("doc", "row", "text").mapInArrow(_parse(window, rounds), _ROW), "recompressed")
    found = parsed.select("num", F.inline(F.arrays_zip(F.col("keys").alias("key"), F.col("spans").alias("span"), F.col("starts").alias("start"), F.col("counts").alias("count"))))
    shared = stored(
        found.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("span").alias("s1"), F.max("span").alias("s2")).where("n > 1").select("key", F.expr("s1 <> s2").alias("mixed")),
        "shared-symbols",
    )
    flagged = stored(found.join(shared, "key"), "shared-segments")
    sure = flagged.where("NOT mixed").select("num", "start", "count")
    # of an anchor whose segments differ, each distinct one is asked for its windows once
    texts = stored(
        flagged.where("mixed").groupBy("key", "span").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("num", "start", "count")).alias("one")),
        "distinct-segments",
    )
    twice = flagged.where("mixed").join(texts.where("n > 1").select("key", "span"), ["key", "span"]).select("num", "start", "count")
    # of rows that repeat a document one speaks for all
    names = parsed.groupBy("doc", "row").agg(F.min("num").alias("num"))
    asked = (
        texts.select("one.*").groupBy("num").agg(F.collect_list(F.struct("start", "count")).alias("asked")).join(names, "num").select("doc", "row", "asked")
    )
    # rows that repeat a document hold one text: their segments were found twice above
    own = base.select("doc", "row", "text").join(asked, ["doc", "row"]).select("doc", "row", "text", "asked")
    windows = stored(own.mapInArrow(_window_rows(window), "doc long, row long, w1 long, w2 long, start int"), "windows")
    again = windows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("w1", "w2")
    single = windows.join(again, ["w1", "w2"], "left_semi").select("doc", "row", "start", F.lit(1).alias("count")).distinct()
    by_doc = sure.union(twice).groupBy("num").agg(F.collect_list(F.struct("start", "count")).alias("ranges")).join(names, "num").select("doc", "row", "ranges")
    singles = single.groupBy("doc", "row").agg(F.collect_list(F.struct("start", "count")).alias("ranges"))
    return by_doc.union(singles).groupBy("doc", "row").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))


def cut_documents(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """docs with the repeated passages cut from text, and n_chars, where there is one, made to fit; other columns stay."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    cut = substring_dedup(docs, window, rounds, carry=others)
    # the results stand before the carried columns, whatever those are called
    cut = cut.toDF("_doc_id", "_n_words", "_n_removed", "_kept_text", *(f"_carried_{i}" for i in range(len(others))))
    of = {"doc_id": F.col("_doc_id"), "text": F.col("_kept_text")} | {c: F.col(f"_carried_{i}") for i, c in enumerate(others)}
    if "n_chars" in others:
        of["n_chars"] = F.length("_kept_text").cast(docs.schema["n_chars"].dataType)
    return cut.select(*(of[c].alias(c) for c in docs.columns))


def substring_dedup(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS, digest: bool = False, carry: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text for each row of docs; kept_sha256 in place of the text if `digest`.

    The columns named in `carry` come along.
    A word goes if it is covered by `window` consecutive words of its document whose sequence also starts at
    another place, in the same or another document or in a row that repeats it; windows are judged on the input.
    Kept words are joined by one space. Null and empty texts have no words; a null doc_id is like any other id;
    other columns are ignored; an empty table gives no rows.
    """
    ranges = stored(repeated_ranges(docs, window, rounds), "repeated-ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in passes(batch):
                w = Words(part.column("text"))
                column = part.column("ranges")
                offsets = np.concatenate([[0], np.cumsum(np.where(column.is_valid(), np.array(column.value_lengths().fill_null(0)), 0))]).astype(np.int64)
                start, count = (column.flatten().field(i).to_numpy() for i in range(2))
                base = np.repeat(w.first[:-1], np.diff(offsets))
                edge = np.zeros(w.n + 1, np.int64)
                np.add.at(edge, base + start, 1)
                np.add.at(edge, base + start + count - 1 + window, -1)
                keep = np.cumsum(edge[:-1]) == 0
                gone = np.concatenate([[0], np.cumsum(~keep)])
                texts = [w.kept_text(d, keep[w.first[d] : w.first[d + 1]]) for d in range(part.num_rows)]
                last = pa.array([hashlib.sha256(t).hexdigest() for t in texts]) if digest else pa.array([t.decode("utf-8", "surrogatepass") for t in texts])
                own = [part.column(f"carried_{i}") for i in range(len(carry))]
                columns = [part.column("doc_id"), pa.array(np.diff(w.first)), pa.array(gone[w.first[1:]] - gone[w.first[:-1]]), last]
                yield pa.RecordBatch.from_arrays([*columns, *own], names=names)

    fields = [T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())]
    fields += [T.StructField("kept_sha256" if digest else "kept_text", T.StringType())]
    results = [f.name for f in fields]
    fields += [T.StructField(f"carried_{i}", docs.schema[c].dataType) for i, c in enumerate(carry)]  # carried columns may be called like results
    names = [f.name for f in fields]
    joined = _identified(docs, carry).join(ranges, ["doc", "row"], "left").drop("doc", "row")
    return joined.mapInArrow(run, T.StructType(fields)).toDF(*results, *carry)
