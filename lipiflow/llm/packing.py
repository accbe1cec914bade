"""Hierarchical multi-length packing.

Documents are routed to the smallest context tier that holds them; longer ones give full windows of the
largest tier and a rest that is routed. Each tier, longest first, is packed best fit, longest piece first;
the gaps its windows leave are filled with whole pieces of shorter tiers and, last, with a cut one, so that
windows end exactly full. What the shortest tier leaves is cut at powers of two. Windows are grouped into
steps of one tier and an equal number of tokens. Every task packs the documents it reads: no exchange.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bpe import Remembered, byte_alphabet

TIERS = (512, 1024, 2048, 4096)
#: Tokens of a step group, and tokens packed at a time (they bound a task's memory).
STEP_TOKENS, BUFFER_TOKENS = 65_536, 3_000_000
END_ID = 2
#: Small letters of ASCII and Latin-1, which no normalisation changes.
_LATIN = re.compile("[a-zß-öø-ÿ]+").fullmatch
PUNCTUATION = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[list[tuple[int, int, int]]]:
    """Windows as lists of (document, start, length); each is as long as a power of two or the last tier.

    All tokens lie in exactly one window; a document of length 0 lies in none.
    """
    top = tiers[-1]
    windows: list[list[tuple[int, int, int]]] = []
    routed: list[list[tuple[int, int, int]]] = [[] for _ in tiers]  # sorted by (length, document, start)
    for doc, n in enumerate(lengths):
        full = n // top * top
        windows += [[(doc, a, top)] for a in range(0, full, top)]
        if n > full:
            routed[bisect_left(tiers, n - full)].append((n - full, doc, full))
    for pieces in routed:
        pieces.sort()
    for t in range(len(tiers) - 1, 0, -1):
        windows += _pack_tier(tiers[t], routed[t], routed[:t])
    # the shortest tier: one after another, cut where a window is full, the last at powers of two
    windows += _cut_stream([(doc, start, n) for n, doc, start in reversed(routed[0])], tiers[0])
    return windows


def _pack_tier(size: int, pieces: list, shorter: list[list]) -> list[list[tuple[int, int, int]]]:
    open_windows: list[tuple[int, int]] = []  # (gap, window), sorted
    contents: list[list[tuple[int, int, int]]] = []
    for n, doc, start in reversed(pieces):
        i = bisect_left(open_windows, (n, -1))
        if i < len(open_windows):
            gap, w = open_windows.pop(i)
        else:
            gap, w = size, len(contents)
            contents.append([])
        contents[w].append((doc, start, n))
        if gap > n:
            insort(open_windows, (gap - n, w))
    done = []
    for gap, w in open_windows:
        while gap:
            best = max((k for k in range(len(shorter)) if shorter[k] and shorter[k][0][0] <= gap), key=lambda k: shorter[k][bisect_right(shorter[k], (gap, 1 << 62)) - 1][0], default=None)
            if best is not None:
                n, doc, start = shorter[best].pop(bisect_right(shorter[best], (gap, 1 << 62)) - 1)
                contents[w].append((doc, start, n))
                gap -= n
                continue
            source = next((s for s in shorter if s), None)
            if source is None:
                break
            n, doc, start = source.pop(0)  # the shortest that is longer than the gap: its rest is routed again
            contents[w].append((doc, start, gap))
            rest = (n - gap, doc, start + gap)
            insort(shorter[0] if rest[0] <= size // (1 << len(shorter)) else source, rest)
            gap = 0
        if gap:
            done += _cut_stream(contents[w], size)
            contents[w] = []
    return done + [c for c in contents if c]


def _cut_stream(pieces: list[tuple[int, int, int]], size: int) -> list[list[tuple[int, int, int]]]:
    """Consecutive windows of `size`, then ever smaller powers of two."""
    left = sum(n for *_, n in pieces)
    out: list[list[tuple[int, int, int]]] = []
    want = 0
    for doc, start, n in pieces:
        while n:
            if not want:
                want = size if left >= size else 1 << (left.bit_length() - 1)
                out.append([])
            take = min(n, want)
            out[-1].append((doc, start, take))
            start, n, want, left = start + take, n - take, want - take, left - take
    return out


def step_groups(sizes: list[int], step_tokens: int = STEP_TOKENS) -> list[int]:
    """A step for each window: steps hold one window size and, but for the last of a size, equal tokens."""
    room: dict[int, tuple[int, int]] = {}
    steps, out = 0, []
    for size in sizes:
        step, left = room.get(size, (0, 0))
        if left < size:
            step, left, steps = steps, max(step_tokens, size), steps + 1
        out.append(step)
        room[size] = (step, left - size)
    return out


class WordIds:
    """Token ids as little-endian uint32 bytes, word by word.

    The vocabulary's normaliser turns white space into one space and its pattern crosses none, so that the ids
    of a text are those of its parts between spaces and newlines; parts met lately are not encoded again. A word of
    small Latin letters is one piece for the pattern: it goes to the vocabulary's model at once.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.merge = self.tokenizer.model.tokenize
        self.alphabet = byte_alphabet()
        self.words = Remembered(self._one, 300_000)

    def _one(self, word: str) -> bytes:
        if _LATIN(word):
            spelt = word if word.isascii() else "".join(map(self.alphabet.__getitem__, word.encode()))
            return np.array([t.id for t in self.merge(spelt)], "<u4").tobytes()
        if "<|" not in word:
            # as the normaliser and the pattern have it: in lower case, a run of letters apart from punctuation
            letters = word.rstrip(PUNCTUATION)
            if letters != word and letters.isascii() and letters.isalpha():
                return self.words[letters] + self.words[word[len(letters) :]]
            if word.isascii() and (low := word.lower()) != word:
                return self.words[low]
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        low = text.lower()
        # in lower case where that is sure to be what the normaliser makes of it: no special token, no mark to be composed
        if "<|" not in text and (text.isascii() or ("Σ" not in text and unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", low))):
            text = low
        return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))


_LOADED: dict[str, WordIds] = {}

COLUMNS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier long, step_group long"


def packed_sequences(docs: DataFrame, tokenizer_path: str, with_ids: bool = False, buffer_tokens: int = BUFFER_TOKENS) -> DataFrame:
    """One row for each piece: which part of which document lies where in which sequence.

    Each document's ids end with END_ID, so that an empty or null text has one token. Sequences have the length
    of a tier or a smaller power of two. with_ids adds the piece's ids as binary, little-endian uint32. Rows
    with null or repeated doc_id are documents of their own; other columns are ignored; an empty table
    gives no rows. sequence_id and step_group count within the task, whose number is their high part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _LOADED:
            _LOADED[tokenizer_path] = WordIds(tokenizer_path)
        encode, end = _LOADED[tokenizer_path].encode, END_ID.to_bytes(4, "little")
        base = TaskContext.get().partitionId() << 32
        sequence = step = base
        doc_ids: list = []
        tokens: list[bytes] = []
        held = 0

        def flush():
            nonlocal sequence, step
            lengths = [len(t) // 4 for t in tokens]
            windows = sorted(pack(lengths), key=lambda w: -sum(n for *_, n in w))
            sizes = [sum(n for *_, n in w) for w in windows]
            rows: list[tuple] = []
            for pieces, size, group in zip(windows, sizes, step_groups(sizes)):
                at = 0
                for doc, start, n in pieces:
                    ids = tokens[doc][4 * start : 4 * (start + n)]
                    row = (doc_ids[doc], start, n, zlib.crc32(ids), lengths[doc], sequence, at, size, step + group)
                    rows.append((*row, ids) if with_ids else row)
                    at += n
                sequence += 1
            step = max((r[8] for r in rows), default=step) + 1
            types = [pa.int64()] * 9 + [pa.binary()] * with_ids
            names = [c.split()[0] for c in COLUMNS.split(", ")] + ["ids"] * with_ids
            for a in range(0, len(rows), 20_000):
                part = rows[a : a + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], t) for i, t in enumerate(types)], names=names)
            doc_ids.clear()
            tokens.clear()

        for batch in batches:
            for doc, cell in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                doc_ids.append(doc)
                tokens.append(encode(cell.as_py() or "") + end)
                held += len(tokens[-1]) // 4
                if held >= buffer_tokens:
                    yield from flush()
                    held = 0
        if tokens:
            yield from flush()

    return docs.select("doc_id", "text").mapInArrow(run, COLUMNS + ", ids binary" * with_ids)
