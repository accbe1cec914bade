"""A hidden Markov language model of the corpus.

Symbols are the most frequent words, one each, and classes of spelling for all other words; a word of a class
is drawn by its count within the class, whatever the state. Baum-Welch counts are summed over partitions, a
Spark job for each iteration; only the model itself, of fixed size, passes the driver. A text's probability
is exact: the scaled forward recursion over all its symbols, times the probabilities within classes.

Word counts are a table as large as the vocabulary. A task knows the counts of the HEAD most frequent words
(a bounded broadcast); counts of rarer words are joined, a row for each document and rare word.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import Words, passes, signed, stored

STATES, ITERATIONS = 8, 6
#: Words that are symbols, and words whose counts every task holds.
TOP, HEAD = 8192, 1 << 19
CLASSES = 64
END, FIRST_WORD = 0, 1 + CLASSES
SYMBOLS = FIRST_WORD + TOP
#: Fingerprint that stands for the end of a text, and what is added to counts.
END_HASH, ADDED = np.uint64(0x5EED0E4D5EED0E4D), 0.1
#: Tokens of whole texts that training takes at once, and steps between the forward states that it keeps.
TOGETHER, BLOCK = 4_000_000, 32


def held_out(doc_id) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10 == 0


_KIND = np.full(256, 3, np.int64)  # of a byte: 0 vowel, 1 other letter or part of a non-ASCII one, 2 digit, 3 other
_KIND[[*range(97, 123), *range(128, 256)]] = 1
_KIND[list(b"aeiou")] = 0
_KIND[list(b"0123456789")] = 2


def word_classes(w: Words) -> np.ndarray:
    """1 to CLASSES: by length, kind of the last and the first byte, and whether all is ASCII."""
    wide = np.concatenate([[0], np.cumsum(w.data >= 128)])
    length = np.minimum((w.ends - w.starts) // 3, 3)
    first = (_KIND[w.data[w.starts]] > 1).astype(np.int64)
    return 1 + ((length * 4 + _KIND[w.data[w.ends - 1]]) * 2 + first) * 2 + (wide[w.ends] > wide[w.starts])


def count_words(docs: DataFrame) -> DataFrame:
    """h, class, c of every word and the end in the training texts; stored. Tasks combine before the exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def combined():
            h, cls, c = (np.concatenate(x) for x in zip(*held))
            keys, first, inverse = np.unique(h, return_index=True, return_inverse=True)
            return [(keys, cls[first], np.bincount(inverse, c).astype(np.int64))]

        def out():
            ((h, cls, c),) = combined()
            for a in range(0, len(h), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(signed(h[a : a + 100_000])), pa.array(cls[a : a + 100_000].astype(np.int32)), pa.array(c[a : a + 100_000])], names=["h", "class", "c"])

        size = 0
        for batch in batches:
            train = [not held_out(d) for d in batch.column("doc_id").to_pylist()]
            for part in passes(batch.filter(pa.array(train, pa.bool_()))):
                w = Words(part.column("text"), lower=True)
                h, first, c = np.unique(w.hashes(), return_index=True, return_counts=True)
                held.append((np.append(h, END_HASH), np.append(word_classes(w)[first], 0), np.append(c, part.num_rows)))
                size += len(h)
                if size > 1_500_000:
                    held = combined()
                    size = len(held[0][0])
                    if size > 750_000:
                        yield from out()
                        held, size = [], 0
        if held:
            yield from out()

    rows = docs.select("doc_id", "text").mapInArrow(run, "h long, class int, c long")
    return stored(rows.groupBy("h").agg(F.max("class").alias("class"), F.sum("c").alias("c")), "hmm-counts")


@dataclass
class Vocabulary:
    """What every task knows of the counts: the HEAD words sorted by fingerprint, and totals."""

    hashes: np.ndarray
    counts: np.ndarray
    symbols: np.ndarray  # of the head words; 0 where only the class counts
    tokens: int
    types: int
    class_tokens: np.ndarray
    class_types: np.ndarray
    symbol_counts: np.ndarray

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index among the head words, and whether the word is one."""
        at = np.minimum(np.searchsorted(self.hashes, h), max(len(self.hashes) - 1, 0))
        return at, (self.hashes[at] == h if len(self.hashes) else np.zeros(len(h), bool))

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + ADDED) / (self.tokens + ADDED * (self.types + 1)))

    def in_class(self, cls: np.ndarray, c: np.ndarray) -> np.ndarray:
        """log10 of a word's probability within its class."""
        return np.log10((c + ADDED) / (self.class_tokens[cls] + ADDED * (self.class_types[cls] + 1)))


def vocabulary(counts: DataFrame, head: int = HEAD, top: int = TOP) -> Vocabulary:
    """At most `head` rows, a histogram of fixed size and one row for each class come to the driver.

    The head words are those from a count on, found in the histogram: nothing is sorted or gathered in one task.
    """
    end = int(END_HASH.view(np.int64))
    step = F.floor(F.log2("c") * 16).cast("int")
    words = counts.where(F.col("h") != end).withColumn("step", step)
    histogram = sorted(((r.step, r.n) for r in words.groupBy("step").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    room, least = head, 1 << 30
    for at, n in histogram:
        if n > room:
            break
        room, least = room - n, at
    got = words.where(F.col("step") >= least).select("h", "class", "c").toArrow()
    h, cls, c = (got.column(i).to_numpy() for i in range(3))
    order = np.lexsort((h, -c))
    h, cls, c = h[order].astype(np.int64).view(np.uint64), cls[order], c[order]
    per_class = words.groupBy("class").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).toArrow()
    class_tokens, class_types = np.zeros(CLASSES + 1, np.int64), np.zeros(CLASSES + 1, np.int64)
    class_tokens[per_class.column(0).to_numpy()] = per_class.column(1).to_numpy()
    class_types[per_class.column(0).to_numpy()] = per_class.column(2).to_numpy()
    ends = sum(r.c for r in counts.where(F.col("h") == end).collect())
    tokens, types = int(class_tokens.sum()) + ends, int(class_types.sum()) + (ends > 0)
    own = min(top, len(h))
    class_tokens = class_tokens - np.bincount(cls[:own], c[:own], CLASSES + 1).astype(np.int64)
    class_types = class_types - np.bincount(cls[:own], minlength=CLASSES + 1)
    symbol_counts = np.zeros(SYMBOLS)
    symbol_counts[END] = ends
    symbol_counts[1:FIRST_WORD] = class_tokens[1:]
    symbol_counts[FIRST_WORD : FIRST_WORD + own] = c[:own]
    symbols = np.zeros(len(h), np.int32)
    symbols[:own] = np.arange(FIRST_WORD, FIRST_WORD + own)
    order = np.argsort(h)
    return Vocabulary(h[order], c[order].astype(np.int64), symbols[order], tokens, types, class_tokens, class_types, symbol_counts)


_TEXTS = (
    "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, within double, "
    "symbols array<int>, rare_h array<long>, rare_class array<int>, rare_n array<int>"
)


def symbol_texts(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """A row for each document: its symbols, what the head words add to its scores, and its rare words; stored."""
    sent = docs.sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = sent.value
        row = TaskContext.get().partitionId() << 36
        end_count = int(v.symbol_counts[END])
        for batch in batches:
            for part in passes(batch):
                n = part.num_rows
                w = Words(part.column("text"), lower=True)
                h, cls, doc = w.hashes(), word_classes(w), w.doc()
                at, known = v.look_up(h)
                c = np.where(known, v.counts[at], 0) if len(v.counts) else np.zeros(len(h), np.int64)
                own = known & (v.symbols[at] > 0) if len(v.counts) else known
                symbol = np.where(own, v.symbols[at], cls) if len(v.counts) else cls
                base = np.bincount(doc, np.where(known, v.base(c), 0), n) + v.base(end_count)
                within = np.bincount(doc, np.where(known & ~own, v.in_class(cls, c), 0), n)
                # each document's symbols, then the end
                places = np.arange(len(h)) + doc
                symbols = np.full(len(h) + n, END, np.int32)
                symbols[places] = symbol
                rare = np.flatnonzero(~known)
                order = rare[np.lexsort((h[rare], doc[rare]))]
                new = np.ones(len(order), bool)
                new[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
                a = np.flatnonzero(new)
                times = np.diff(np.append(a, len(order)))
                rare_offsets = np.searchsorted(doc[order][a], np.arange(n + 1)).astype(np.int32)
                lists = lambda x: pa.ListArray.from_arrays(pa.array(rare_offsets), pa.array(x))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row + np.arange(n)),
                        part.column("doc_id"),
                        pa.array([held_out(d) for d in part.column("doc_id").to_pylist()], pa.bool_()),
                        pa.array(np.diff(w.first) + 1),
                        pa.array(np.bincount(doc, known, n).astype(np.int64) + (end_count > 0)),
                        pa.array(base, pa.float64()),
                        pa.array(within, pa.float64()),
                        pa.ListArray.from_arrays(pa.array((w.first + np.arange(n + 1)).astype(np.int32)), pa.array(symbols)),
                        lists(signed(h[order][a])),
                        lists(cls[order][a].astype(np.int32)),
                        lists(times.astype(np.int32)),
                    ],
                    names=[c.split()[0] for c in _TEXTS.split(", ")],
                )
                row += n

    return stored(docs.select("doc_id", "text").mapInArrow(run, _TEXTS), "hmm-texts")


@dataclass
class Hmm:
    start: np.ndarray  # (states,)
    moves: np.ndarray  # (states, states), rows sum to 1
    emits: np.ndarray  # (symbols, states), columns sum to 1

    @staticmethod
    def initial(symbol_counts: np.ndarray, states: int = STATES, seed: int = 1) -> Hmm:
        rng = np.random.default_rng(seed)
        unigram = (symbol_counts + 0.01) / (symbol_counts + 0.01).sum()
        emits = unigram[:, None] * np.exp(rng.normal(0, 1.0, (len(unigram), states)))
        moves = np.full((states, states), 0.05 / max(states - 1, 1))
        np.fill_diagonal(moves, 0.95 if states > 1 else 1.0)
        return Hmm(np.full(states, 1 / states), moves, emits / emits.sum(0))

    def log10(self, symbols: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Exact log10 probability of each text, by the scaled forward recursion."""
        sizes = np.diff(offsets)
        out, ones = np.zeros(len(sizes)), np.ones(len(self.start))
        order = np.argsort(-sizes, kind="stable")
        for a in range(0, len(order), 512):
            which = order[a : a + 512]
            n, base = sizes[which], offsets[which]
            alpha, logs = np.tile(self.start, (len(which), 1)), np.zeros(len(which))
            alive = len(which)
            for t in range(n[0] if len(n) else 0):
                while n[alive - 1] <= t:
                    alive -= 1
                alpha = alpha[:alive] if not t else alpha[:alive] @ self.moves
                alpha = alpha * self.emits[symbols[base[:alive] + t]]
                scale = alpha @ ones  # faster than a sum over so few columns
                alpha /= scale[:, None]
                logs[:alive] += np.log10(scale)
            out[which] = logs
        return out

    def expected(self, symbols: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Baum-Welch counts of whole texts: starts, moves, emissions, and the log-likelihood.

        All texts go forward together, the longest first, so that those not yet ended are the first rows. Of the scaled
        forward states every BLOCK-th is kept; going backward, those between are made again.
        """
        states = len(self.start)
        starts, moves, emits, total = np.zeros(states), np.zeros((states, states)), np.zeros((len(self.emits), states)), 0.0
        sizes = np.diff(offsets)
        order = np.argsort(-sizes, kind="stable")[: np.count_nonzero(sizes)]
        if not len(order):
            return starts, moves, emits, total
        begin, n = offsets[:-1][order], sizes[order]
        steps = int(n[0])
        alive = np.searchsorted(-n, -np.arange(steps), "left")  # with more than t symbols

        ones = np.ones((states, 1))

        def forward(alpha, t):
            k = alive[t]
            s = symbols[begin[:k] + t]
            e = self.emits.take(s, axis=0)
            alpha = alpha[:k] @ self.moves if t else np.tile(self.start, (k, 1))
            alpha *= e
            c = alpha @ ones  # faster than a sum over so few columns
            alpha /= c
            return alpha, s, e, c

        kept, alpha = [], None
        for t in range(steps):
            if t % BLOCK == 0:
                kept.append(alpha)
            alpha, _, _, c = forward(alpha, t)
            total += np.log(c).sum()
        beta = onward = None
        for block in range(len(kept) - 1, -1, -1):
            first = block * BLOCK
            made, alpha = [], kept.pop()
            before = alpha
            for t in range(first, min(first + BLOCK, steps)):
                made.append(forward(alpha, t))
                alpha = made[-1][0]
            gammas = []
            for t in range(first + len(made) - 1, first - 1, -1):
                alpha, s, e, c = made[t - first]
                if onward is not None and len(onward) == alive[t]:
                    beta = onward @ self.moves.T
                else:
                    beta = np.ones((alive[t], states))
                    if onward is not None:  # of the texts that go on after t
                        beta[: len(onward)] = onward @ self.moves.T
                gammas.append(alpha * beta)
                beta *= e
                beta /= c
                onward = beta
                if t:
                    previous = made[t - first - 1][0] if t > first else before
                    moves += previous[: alive[t]].T @ onward
            s, g = np.concatenate([m[1] for m in reversed(made)]), np.ascontiguousarray(np.concatenate(gammas).T)
            for j in range(states):
                emits[:, j] += np.bincount(s, g[j], len(emits))
            if not block:
                starts += gammas[-1].sum(0)
        return starts, moves * self.moves, emits, total


def _symbol_lists(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    column = batch.column(batch.schema.get_field_index("symbols"))
    offsets = np.array(column.offsets, np.int64)
    return column.values.to_numpy(), offsets


def _together(batches: Iterator[pa.RecordBatch], most: int = TOGETHER) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Symbols and offsets of many texts at once, of at most `most` symbols but for a longer text."""
    held: list[np.ndarray] = []
    sizes: list[int] = []
    size = 0
    for batch in batches:
        symbols, offsets = _symbol_lists(batch)
        cuts = [0, *(np.flatnonzero(np.diff((offsets - offsets[0]) // (most // 4))) + 1), len(offsets) - 1]
        for a, b in zip(cuts, cuts[1:]):
            n = int(offsets[b] - offsets[a])
            if held and size + n > most:
                yield np.concatenate(held), np.concatenate([[0], np.cumsum(sizes)])
                held, sizes, size = [], [], 0
            held.append(symbols[offsets[a] : offsets[b]])
            sizes += np.diff(offsets[a : b + 1]).tolist()
            size += n
    if held:
        yield np.concatenate(held), np.concatenate([[0], np.cumsum(sizes)])


def baum_welch(texts: DataFrame, vocab: Vocabulary, states: int = STATES, iterations: int = ITERATIONS) -> Hmm:
    """Each iteration is one job over all training texts; a task adds up its counts, Spark adds up the tasks'."""
    spark = texts.sparkSession
    model = Hmm.initial(vocab.symbol_counts, states)
    unigram = (vocab.symbol_counts + 0.01) / (vocab.symbol_counts + 0.01).sum()
    names = [f"s{j}" for j in range(states)]
    train = texts.where(~F.col("held_out")).select("symbols")
    for _ in range(iterations):
        sent = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            m, total = sent.value, None
            for symbols, offsets in _together(batches):
                got = m.expected(symbols, offsets)
                total = [x + y for x, y in zip(total, got)] if total else list(got)
            if total:
                rows = np.concatenate([total[2], total[1], total[0][None, :]])
                some = np.flatnonzero(rows.any(1))
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array(rows[some, j]) for j in range(len(names)))], names=["i", *names])

        sums = train.mapInArrow(run, "i int, " + ", ".join(f"{n} double" for n in names)).groupBy("i").agg(*(F.sum(n).alias(n) for n in names)).toArrow()
        counts = np.zeros((SYMBOLS + states + 1, states))
        counts[sums.column("i").to_numpy()] = np.column_stack([sums.column(n).to_numpy() for n in names])
        emits = counts[:SYMBOLS] + 50.0 * unigram[:, None]
        moves, start = counts[SYMBOLS:-1] + 0.1, counts[-1] + 0.1
        model = Hmm(start / start.sum(), moves / moves.sum(1, keepdims=True), emits / emits.sum(0))
        sent.unpersist()
    return model


def hmm_scores(docs: DataFrame, states: int = STATES, iterations: int = ITERATIONS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row for each row of docs.

    Words are lower-cased (A-Z) runs of non-blank bytes; each text ends with one end token. Texts whose doc_id's
    crc32 is no multiple of 10 train the model; a null doc_id counts as the empty string and is held out. Null
    texts are empty. base_score is the add-0.1 unigram's log10 probability, score the hidden Markov model's. Rows that
    repeat a doc_id are scored each; other columns are ignored; an empty table gives no rows.
    """
    counts = count_words(docs)
    vocab = vocabulary(counts)
    texts = symbol_texts(docs, vocab)
    model = baum_welch(texts, vocab, states, iterations)
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    sent_vocab = spark.sparkContext.broadcast((vocab.tokens, vocab.types, vocab.class_tokens, vocab.class_types))

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                logs = sent.value.log10(*_symbol_lists(part))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(logs)], names=[*kept, "forward"])

    def rare_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, types, class_tokens, class_types = sent_vocab.value
        v = Vocabulary(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), tokens, types, class_tokens, class_types, np.zeros(0))
        for b in batches:
            row, cls, n, c = (b.column(i).to_numpy() for i in range(4))
            known = pa.array(np.where(c > 0, n, 0).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(row), known, pa.array(n * v.base(c)), pa.array(n * v.in_class(cls, c))], names=["row", "rare_known", "rare_base", "rare_within"])

    kept = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "within"]
    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, within double, forward double"
    scored = texts.select(*kept, "symbols").mapInArrow(forward, schema)
    rare = texts.select("row", F.inline(F.arrays_zip("rare_h", "rare_class", "rare_n")))
    found = rare.join(counts.select(F.col("h").alias("rare_h"), "c"), "rare_h", "left").select("row", "rare_class", "rare_n", F.coalesce("c", F.lit(0)).alias("c"))
    per_row = (
        found.mapInArrow(rare_scores, "row long, rare_known long, rare_base double, rare_within double")
        .groupBy("row")
        .agg(F.sum("rare_known").alias("rare_known"), F.sum("rare_base").alias("rare_base"), F.sum("rare_within").alias("rare_within"))
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    return scored.join(per_row, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + zero("rare_known")).alias("n_known"),
        F.lit(vocab.tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + zero("rare_base")).alias("base_score"),
        (F.col("forward") + F.col("within") + zero("rare_within")).alias("score"),
    )
