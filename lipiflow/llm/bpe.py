"""Byte-level BPE: encoding by a priority queue of merge ranks over a doubly linked symbol list, and decoding.

A text is split by the vocabulary's pattern; each piece starts as one symbol a byte. The queue yields the
lowest rank, leftmost first; an entry whose symbols have been merged away since is stale and is skipped.
Decoding concatenates the vocabulary's byte strings. Pieces that a task met lately are not merged again.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: How these vocabularies split a text before merging (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces that a task remembers; the older half goes when as many new ones have come. Longer pieces are worked out each time.
REMEMBERED, REMEMBERED_CHARS = 300_000, 64
#: Bytes of a piece from which its symbols lie in arrays, and the bits of a place in it.
LONG_PIECE, PLACE = 4096, (1 << 40) - 1


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Remembered(dict):
    """Results of a function by argument, in two generations of bounded size."""

    def __init__(self, f, limit: int = REMEMBERED):
        super().__init__()
        self.f, self.limit, self.old = f, limit, {}

    def __missing__(self, key):
        if (value := self.old.get(key)) is None:
            value = self.f(key)
        self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(key) > REMEMBERED_CHARS:
            return
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value


class ByteBpe:
    """A byte-level BPE vocabulary read from a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, alphabet = spec["model"]["vocab"], byte_alphabet()
        byte_of = {c: b for b, c in enumerate(alphabet)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.byte_ids = [vocab[c] for c in alphabet]
        size = max([*vocab.values(), *special.values()]) + 1
        self.strings = [b""] * size
        for token, i in vocab.items():
            self.strings[i] = bytes(byte_of[c] for c in token)
        for token, i in special.items():
            self.strings[i] = token.encode()
        self.decimal = [str(i) for i in range(size)]
        #: (left id, right id) in one integer to (rank, merged id)
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[left] << 20 | vocab[right]] = (rank, vocab[left + right])
        self.special = special
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.split = regex.compile(PATTERN).findall
        self.pieces = Remembered(self.merge)

    def merge(self, piece: str) -> tuple[int, ...]:
        """Token ids of one piece."""
        byte_ids, merges = self.byte_ids, self.merges
        ids = [byte_ids[b] for b in piece.encode("utf-8", "surrogatepass")]
        n = len(ids)
        if n < 2:
            return tuple(ids)
        # a merge waits as one integer, rank and place; numbers lie in arrays where the piece is long
        many = (lambda x: array("q", x)) if n > LONG_PIECE else list
        ids = many(ids)
        queue = [found[0] << 40 | i for i in range(n - 1) if (found := merges.get(ids[i] << 20 | ids[i + 1])) is not None]
        if not queue:
            return tuple(ids)
        heapq.heapify(queue)
        after, before = many(range(1, n + 1)), many(range(-1, n - 1))
        pop, push = heapq.heappop, heapq.heappush
        while queue:
            first = pop(queue)
            i = first & PLACE
            left = ids[i]
            j = after[i]
            if left < 0 or j >= n:
                continue
            found = merges.get(left << 20 | ids[j])
            if found is None or found[0] != first >> 40:
                continue  # stale: one of the symbols is another by now
            merged = found[1]
            ids[i], ids[j] = merged, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (found := merges.get(merged << 20 | ids[k])) is not None:
                    push(queue, found[0] << 40 | i)
            h = before[i]
            if h >= 0 and (found := merges.get(ids[h] << 20 | merged)) is not None:
                push(queue, found[0] << 40 | h)
        return tuple(x for x in ids if x >= 0)

    def encode(self, text: str) -> list[int]:
        if self.split_special is None or not any(s in text for s in self.special):
            return list(chain.from_iterable(map(self.pieces.__getitem__, self.split(text))))
        ids: list[int] = []
        for i, part in enumerate(self.split_special.split(text)):
            ids += [self.special[part]] if i % 2 else chain.from_iterable(map(self.pieces.__getitem__, self.split(part)))
        return ids

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


_LOADED: dict[str, ByteBpe] = {}


def loaded(path: str) -> ByteBpe:
    """The vocabulary of a path, read once by a Python worker."""
    if path not in _LOADED:
        _LOADED[path] = ByteBpe(path)
    return _LOADED[path]


def bpe_round_trip(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, ids (array of int), decoded (string) for each row of docs; null texts are empty.

    Rows with null or repeated doc_id are encoded each on its own, other columns are ignored, an empty table
    gives no rows. There is no exchange; memory is bounded by a batch and the remembered pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(tokenizer_path)
        for doc_id, text in _rows(batches):
            ids = bpe.encode(text)
            yield pa.RecordBatch.from_arrays([doc_id, pa.array([ids], pa.list_(pa.int32())), pa.array([bpe.decode(ids)])], names=["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def _rows(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.column("doc_id").slice(i, 1), batch.column("text")[i].as_py() or ""


def bpe_digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """The round trip of bpe_round_trip, with its ids and text reduced to digests where they are made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(tokenizer_path)
        for batch in batches:
            counts, id_digests, text_digests = [], [], []
            for cell in batch.column("text"):
                ids = bpe.encode(cell.as_py() or "")
                counts.append(len(ids))
                id_digests.append(hashlib.sha256(",".join(map(bpe.decimal.__getitem__, ids)).encode()).hexdigest())
                text_digests.append(hashlib.sha256(bpe.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(id_digests, pa.string()), pa.array(text_digests, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
