"""Quality rules by repetition coverage: characters inside duplicated n-grams and lines.

For several n-gram lengths, a fingerprint of each window of n words is taken from one rolling computation
over a whole Arrow batch; windows whose fingerprint is found twice or more within their document mark
their words, and the marked characters are measured against all word characters of the document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import _C1, Words, mix, passes

#: Words of a window and the largest share of a text's word characters inside windows that are found again.
NGRAM_LIMITS = {5: 0.20, 10: 0.18, 20: 0.16}
#: The largest share of word characters on lines that repeat an earlier one.
LINE_LIMIT = 0.30
SYMBOLS = b"#*$%&|<>"

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True


def repeated_windows(h: np.ndarray, doc: np.ndarray, width: int) -> np.ndarray:
    """Which words lie in a window of `width` words of their document that is found twice or more in it."""
    n = len(h) - width + 1
    marked = np.zeros(len(h), bool)
    if n <= 0:
        return marked
    rolled = h[:n].copy()
    for i in range(1, width):
        rolled = rolled * _C1 + h[i : i + n]
    whole = doc[:n] == doc[width - 1 :]
    at = np.flatnonzero(whole)
    key = mix(rolled[at] + doc[at].astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(at) + 1, bool)
    sorted_key = key[order]
    same[1:-1] = sorted_key[1:] == sorted_key[:-1]
    twice = at[order[same[1:] | same[:-1]]]
    edge = np.zeros(len(h) + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + width, -1)
    return np.cumsum(edge[:-1]) > 0


def line_spans(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word of each line that has a word, end of its words, and its document."""
    if not words.n:
        return (np.zeros(0, np.int64),) * 3
    line = np.searchsorted(np.flatnonzero(words.data[: words.bounds[-1]] == 10), words.starts)
    doc = words.doc()
    new = np.ones(words.n, bool)
    new[1:] = (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])
    a = np.flatnonzero(new)
    return a, np.append(a[1:], words.n), doc[a]


def _measure(texts: pa.Array) -> dict[str, np.ndarray]:
    w = Words(texts)
    docs, doc, h = len(w.first) - 1, w.doc(), w.hashes()
    at_start = (w.data & 0xC0) != 0x80  # first bytes of code points
    points = np.concatenate([[0], np.cumsum(at_start)])
    chars = points[w.ends] - points[w.starts]
    symbols = np.concatenate([[0], np.cumsum(_IS_SYMBOL[w.data])])
    per_doc = lambda x: np.bincount(doc, x, docs).astype(np.int64)
    out = {"n_words": np.diff(w.first), "word_chars": per_doc(chars), "n_symbols": symbols[w.bounds[1:]] - symbols[w.bounds[:-1]]}
    # lines: the raw bytes between newlines, compared by a fingerprint of the text between the line's ends
    line_a, line_b, line_doc = line_spans(w)
    keys = _line_keys(w, line_a, line_b, line_doc)
    order = np.lexsort((np.arange(len(keys)), keys, line_doc))
    again = np.zeros(len(keys), bool)
    k, d = keys[order], line_doc[order]
    again[order[1:]] = (k[1:] == k[:-1]) & (d[1:] == d[:-1])
    out["n_dup_lines"] = np.bincount(line_doc, again, docs).astype(np.int64)
    line_chars = np.add.reduceat(chars, line_a) if len(line_a) else np.zeros(0)
    total = np.maximum(out["word_chars"], 1)
    out["dup_line_share"] = np.bincount(line_doc, line_chars * again, docs) / total
    for n in NGRAM_LIMITS:
        marked = repeated_windows(h, doc, n)
        if n == 5:
            out["n_repeat_words"] = per_doc(marked)
        out[f"dup_{n}gram_share"] = np.bincount(doc, chars * marked, docs) / total
    return out


def _line_keys(w: Words, a: np.ndarray, b: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Fingerprints of the full lines, white space included."""
    if not len(a):
        return np.zeros(0, np.uint64)
    n = w.bounds[-1]
    newline = np.flatnonzero(w.data[:n] == 10)
    i = np.searchsorted(newline, w.starts[a])
    before = np.where(i > 0, newline[np.maximum(i - 1, 0)] + 1, 0) if len(newline) else np.zeros(len(a), np.int64)
    after = np.where(i < len(newline), newline[np.minimum(i, max(len(newline) - 1, 0))], n) if len(newline) else np.full(len(a), n)
    span = object.__new__(Words)
    span.data, span.starts, span.ends, span.n = w.data, np.maximum(before, w.bounds[doc]), np.minimum(after, w.bounds[doc + 1]), len(a)
    return span.hashes(seed=3)


COLUMNS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, dup_line_share double, " + ", ".join(
    f"dup_{n}gram_share double" for n in NGRAM_LIMITS
)


def _verdicts(texts: pa.Array) -> dict[str, np.ndarray]:
    m = _measure(texts)
    m["base_failed"] = (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])
    m["kept"] = ~m["base_failed"] & (m["dup_line_share"] <= LINE_LIMIT)
    for n, most in NGRAM_LIMITS.items():
        m["kept"] &= m[f"dup_{n}gram_share"] <= most
    return m


def _rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in passes(batch):
            m = _verdicts(part.column("text"))
            names = [c.split()[0] for c in COLUMNS.split(", ")]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(m[c].astype(float) if c.endswith("share") else m[c]) for c in names[1:])], names=names)


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: counts, shares of repeated text, base_failed and the verdict `kept`.

    A null or empty text has no words and fails. Rows with a null or repeated doc_id are measured alike, each
    on its own; other columns are ignored; an empty table gives no rows. No exchange takes place.
    """
    return docs.select("doc_id", "text").mapInArrow(_rules, COLUMNS)


def passing(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that quality_rules keeps: each row by its own text, without any join."""
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            judged = pa.RecordBatch.from_arrays([batch.column(place), pa.array(np.arange(batch.num_rows))], names=["text", "row"])
            keep = np.zeros(batch.num_rows, bool)
            for part in passes(judged):
                keep[part.column("row").to_numpy()] = _verdicts(part.column("text"))["kept"]
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
