"""Near-duplicate classes by Order MinHash.

A text's k-mers are its runs of three words, labelled by occurrence: at a similarity of 0.8, edits may leave no longer
run. Each of 64 sketches takes the two labelled k-mers that hash lowest and keeps them in text order, so that a
collision is likely only for texts with a small edit distance. Pairs of fewer than 24 words are found without
chance instead, by triples of the words that come first in one order of all words (prefix filter). Texts that share
a sketch are candidates. Each first meets the bucket's first text: one pair a text, which joins most copies. Word
counts rule out most unlike pairs, a banded alignment of the words verifies the others; verified pairs are joined
to classes by alternating star contractions. Then all pairs of a bucket whose texts are still in different classes
and near enough in length are met in blocks, once however many sketches they share, and those verified that word
counts do not rule out; so the classes are those that verifying every pair of every bucket would give.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import _C1, Words, mix, passes, signed, stored, tasks_of, window_hashes

SIMILARITY = 0.8
#: Words of a k-mer and sketches of a text, alike at every length.
KMER, SKETCHES = 3, 64
#: Pairs whose longer text has fewer words than this are found by triples.
SHORT = 24
#: Texts of a bucket that one block holds against as many others, words that they have in all, and counters of a text's words.
BLOCK, BLOCK_WORDS, BINS = 2048, 4_000_000, 256


def occurrences(value: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which occurrence of its value in its document each one is, from 0."""
    own = mix(value + doc.astype(np.uint64) * _C1)
    order = np.argsort(own, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = own[order][1:] != own[order][:-1]
    runs = np.flatnonzero(new)
    nth = np.empty(len(order), np.uint64)
    nth[order] = np.arange(len(order)) - np.repeat(runs, np.diff(np.append(runs, len(order))))
    return nth


def omh_sketches(h: np.ndarray, first: np.ndarray, which: np.ndarray, k: int, sketches: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, fingerprints by document and sketch) of the documents of a mask that have k words; h are all words' hashes."""
    sizes = np.diff(first)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    kmers = window_hashes(h, k)
    whole = np.flatnonzero((doc[: len(kmers)] == doc[k - 1 : k - 1 + len(kmers)]) & which[doc[: len(kmers)]]) if len(kmers) else np.zeros(0, np.int64)
    kmer, kdoc = kmers[whole], doc[whole]
    if not len(kmer):
        return np.zeros(0, np.int64), np.zeros((0, sketches), np.uint64)
    nth = occurrences(kmer, kdoc)
    label = mix(kmer + nth * np.uint64(0xD1B54A32D192ED03))
    starts = np.flatnonzero(np.append(True, kdoc[1:] != kdoc[:-1]))
    docs, single = kdoc[starts], np.diff(np.append(starts, len(kdoc))) == 1
    seeds = mix(np.arange(1, 2 * sketches + 1, dtype=np.uint64))
    # half of a value is the k-mer's hash, the other its place: a least value names the k-mer that it belongs to
    place, low_half = np.arange(len(label), dtype=np.uint64), np.uint64(0xFFFFFFFF)
    v, out = np.empty(len(label), np.uint64), np.empty((len(docs), sketches), np.uint64)
    for i in range(sketches):
        np.bitwise_xor(label, seeds[2 * i], out=v)
        np.multiply(v, seeds[2 * i + 1] | np.uint64(1), out=v)
        np.bitwise_and(v, ~low_half, out=v)
        np.bitwise_or(v, place, out=v)
        first = (np.minimum.reduceat(v, starts) & low_half).astype(np.int64)
        v[first] = np.uint64(0xFFFFFFFFFFFFFFFF)
        second = np.where(single, first, (np.minimum.reduceat(v, starts) & low_half).astype(np.int64))
        a, b = label[np.minimum(first, second)], label[np.maximum(first, second)]  # in text order
        out[:, i] = mix(mix(a + np.uint64(1000 * k + i)) * _C1 + b)
    return docs, out


def short_triples(h: np.ndarray, first: np.ndarray, similarity: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """(document, fingerprint) of what texts of 3 to SHORT - 1 words share with every text so similar that has fewer than SHORT.

    At most d = (1 - similarity) * n edits leave two texts, n words the longer one, n - d labelled words in common. Of
    texts with that many in common, the first d + 3 in any order of all labelled words share three. This holds where
    n - d is 3 or more unless d is 0: for similarities of 0.75 and more.
    """
    sizes = np.diff(first)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    some = np.flatnonzero(sizes[doc] < SHORT)
    label = np.zeros(len(h), np.uint64)
    label[some] = mix(h[some] + occurrences(h[some], doc[some]) * np.uint64(0xD1B54A32D192ED03))
    docs, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for n in range(3, SHORT):
        at = np.flatnonzero(sizes == n)
        if not len(at):
            continue
        least = np.sort(label[first[at][:, None] + np.arange(n)], axis=1)[:, : int((1 - similarity) * n + 1e-9) + 3]
        for i, j, k in combinations(range(least.shape[1]), 3):
            docs.append(at)
            keys.append(mix(mix(mix(least[:, i] + _C1) * _C1 + least[:, j]) * _C1 + least[:, k]))
    return np.concatenate(docs), np.concatenate(keys)


def text_sketches(w: Words, similarity: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets and values of the sketches of each document, and halves of those of k-mers in a table, each sketch in its column.

    A text has triples if it is short, sketches of k-mers if texts similar to it may not be, and both at the border.
    """
    sizes, h = np.diff(w.first), w.hashes()
    at, values = omh_sketches(h, w.first, sizes >= SHORT - int((1 - similarity) * SHORT + 1e-9), KMER, SKETCHES)
    table = np.zeros((len(sizes), SKETCHES), np.uint32)
    table[at] = values.astype(np.uint32)
    docs, keys = (np.concatenate(x) for x in zip(short_triples(h, w.first, similarity), (np.repeat(at, SKETCHES), values.ravel())))
    order = np.argsort(docs, kind="stable")
    return np.append(0, np.cumsum(np.bincount(docs, minlength=len(sizes)))).astype(np.int32), keys[order], table


def edit_distance_within(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """The edit distance of two sequences if it is at most `most`; only diagonals that near are walked."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = differ[0] if len(differ) else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    tail = differ[0] if len(differ) else n
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b):
        d = max(len(a), len(b))
        return d if d <= most else None
    if abs(len(a) - len(b)) > most:
        return None
    values, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    balance = np.bincount(inverse[: len(a)], minlength=len(values)) - np.bincount(inverse[len(a) :], minlength=len(values))
    if max(balance[balance > 0].sum(), -balance[balance < 0].sum()) > most:
        return None
    x, y = inverse[: len(a)].tolist(), inverse[len(a) :].tolist()
    near = min(most, 14)  # most copies need a narrow band only
    d = _banded(x, y, near)
    return d if d is not None or near == most else _banded(x, y, most)


def _banded(a: list[int], b: list[int], most: int) -> int | None:
    """As edit_distance_within, of sequences that are not empty: a column of the band is two integers.

    Bit i of `up` and of `down` says that the distance rises or falls by one from the row before to row i of the band,
    which moves down a row with each column. The distance is followed along the band's lower edge, then the last row.
    """
    if len(a) < len(b):
        a, b = b, a
    m, n = len(a), len(b)
    if m - n > most:
        return None
    below, above = min(most, m - 1), min(most, n)
    width = below + above + 1
    whole, edge = (1 << width) - 1, 1 << (width - 1)
    places: dict[int, int] = {}
    for i, x in enumerate(a, above):
        places[x] = places.get(x, 0) | 1 << i
    up, down, d = whole ^ ((1 << above) - 1), 0, below
    turn = m - below
    give_up = most + n - turn
    for j, y in enumerate(b):
        equal = places.get(y, 0) >> j & whole
        same = (((equal & up) + up) ^ up | equal | down) & whole  # no more than on the diagonal before
        right, left = down | (whole ^ (same | up)), same & up
        if j >= turn:
            at = width - 2 - (j - turn)
            d += (right >> at & 1) - (left >> at & 1)
        elif same < edge:
            d += 1
            if d > give_up:
                return None
        same >>= 1
        up, down = left | (whole ^ (same | right)), same & right
    return d if d <= most else None


def bucket_members(nodes: DataFrame) -> DataFrame:
    """node, words, key, rep, size: the texts of each bucket of two or more, without buckets of one text twice."""
    rows = nodes.select("node", "words", F.explode(F.array_distinct("sketches")).alias("key"))
    buckets = stored(rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("rep")).where("size > 1"), "omh-buckets")
    return stored(rows.join(buckets, "key"), "omh-members")


def first_pairs(members: DataFrame) -> DataFrame:
    """Distinct pairs a < b of nodes: each text of a bucket with the first one."""
    return members.where(F.col("node") != F.col("rep")).select(F.col("rep").alias("a"), F.col("node").alias("b")).distinct()


def plausible(pairs: DataFrame, nodes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs that lengths and word counts do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                words = [part.column(c).to_numpy() for c in ("words_a", "words_b")]
                shapes = [_shapes(part.column(c)) for c in ("shape_a", "shape_b")]
                good = _least_edits(*words, *shapes, similarity) <= 1
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    side = lambda x: nodes.select(F.col("node").alias(x), F.col("words").alias(f"words_{x}"), F.col("shape").alias(f"shape_{x}"))
    return pairs.hint("merge").join(side("a"), "a").hint("merge").join(side("b"), "b").mapInArrow(run, "a long, b long")


def _shapes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BINS)


def _least_edits(words_a: np.ndarray, words_b: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Edits that lengths and word counts, row by row, prove, as a share of those that the similarity allows; over 1 rules out."""
    apart = np.abs(words_a - words_b)
    most = ((1 - similarity) * np.maximum(words_a, words_b) + 1e-9).astype(np.int64)
    share = np.full(len(most), 2.0)
    some = np.flatnonzero(apart <= most)
    differ = (np.maximum(a[some], b[some]) - np.minimum(a[some], b[some])).sum(axis=1, dtype=np.int64)
    share[some] = (differ + apart[some]) / np.maximum(2 * most[some], 1) + (differ + apart[some] > 2 * most[some])
    return share


def word_shapes(w: Words) -> np.ndarray:
    """(documents, BINS) counts of words by hash, 255 at most: an edit changes one counter by one, or two if it replaces."""
    docs = len(w.first) - 1
    cell = w.doc() * BINS + (w.hashes(seed=2) % np.uint64(BINS)).astype(np.int64)
    return np.minimum(np.bincount(cell, minlength=docs * BINS), 255).astype(np.uint8).reshape(docs, BINS)


#: Lengths of texts that are similar enough differ by one level at most: a little wider than 1 / SIMILARITY.
LEVEL = 1.26
#: Steps of length within a level: lengths that are similar enough differ by so many steps at most.
STEPS = 8


def _unlike(c: dict[str, np.ndarray], shape: np.ndarray, table: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of a group of two blocks that are in different classes, may be similar enough, and share no earlier sketch.

    Of a group of two levels, pairs of the upper one are left to the next group; within a block, each pair is met once.
    """
    across = c["i"][0] != c["j"][0]
    late = c["own"] != c["i"]
    left, right = (np.flatnonzero(~late), np.flatnonzero(late)) if across else (np.arange(len(late)),) * 2
    node, label, words, low = c["node"], c["label"], c["words"], c["level"] == c["lower"]
    longest = words / similarity + 1e-3  # of texts that this length allows, a little more than exact
    here = np.uint32(int(c["key"][0]) & 0xFFFFFFFF)
    found_p, found_q = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    step = max(65536 // max(len(right), 1), 1)
    for at in range(0, len(left), step):
        x = left[at : at + step]
        may = (label[x][:, None] != label[right][None]) & (low[x][:, None] | low[right][None])
        may &= (words[x][:, None] <= longest[right][None]) & (words[right][None] <= longest[x][:, None])
        if not across:
            may &= node[x][:, None] < node[right][None]
        i, j = np.nonzero(may)
        for cut in range(0, len(i), 4096):
            p, q = x[i[cut : cut + 4096]], right[j[cut : cut + 4096]]
            good = np.flatnonzero(_least_edits(words[p], words[q], shape[p], shape[q], similarity) <= 1)
            p, q = p[good], q[good]
            # a pair that shares several k-mer sketches is left to the first one's bucket
            same = (table[p] == table[q]) & (table[p] != 0)
            first = table[p, same.argmax(axis=1)]
            good = ~same.any(axis=1) | (first == here)
            found_p.append(p[good])
            found_q.append(q[good])
    return np.concatenate(found_p), np.concatenate(found_q)


def _groups(batches: Iterator[pa.RecordBatch], by: list[str], parsed):
    """The runs of rows with equal `by` of sorted batches, whatever batches they lie in; parsed(batch) gives columns of equal length."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        c = parsed(b)
        if held:
            c = {x: held[x] + c[x] if isinstance(c[x], list) else np.concatenate([held[x], c[x]]) for x in c}
        new = np.logical_or.reduce([c[x][1:] != c[x][:-1] for x in by])
        cuts = [0, *(np.flatnonzero(new) + 1)]
        for s, e in zip(cuts, cuts[1:]):
            yield {x: v[s:e] for x, v in c.items()}
        held = {x: v[cuts[-1] :] for x, v in c.items()}
    if held:
        yield held


_GROUP = ["key", "lower", "i", "j"]


def remaining_links(members: DataFrame, labels: DataFrame, nodes: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs a < b that share a bucket, are in different classes, and reach the similarity: all such pairs are verified.

    members has node, words, key and size; nodes has node, shape and places. A bucket is parted by levels of length, each
    level meeting itself and the next one; a text stays out if no text of another class is near enough to it in length. The rest
    is dealt to blocks of about BLOCK texts, or BLOCK_WORDS words if that is less: each two blocks meet in a group of their own,
    so that no task holds more of a bucket, however large it is. Word counts tell which texts of a group have to be held against
    which; only the texts of these go there, once each, and are aligned.
    """
    n = tasks_of(members)
    exact = F.log(F.greatest("words", F.lit(1)).cast("double")) / float(np.log(max(LEVEL, 1.008 / similarity)))
    length = (F.floor(exact).cast("int").alias("level"), F.floor(exact * STEPS).cast("int").alias("step"))
    known = members.where("size > 2").join(labels, "node", "left").select("node", "words", "key", *length, F.coalesce("label", "node").alias("label"))
    parts = stored(known.withColumn("lower", F.explode(F.array(F.col("level") - 1, F.col("level")))), "omh-known")
    # stored, so that the join exchanges both sides anew and a bucket with very many texts can be split
    counts = parts.groupBy("key", "lower", "step").agg(F.count(F.lit(1)).alias("texts"), F.sum("words").alias("total"), F.min("label").alias("low"), F.max("label").alias("high"), F.min(F.col("level") - F.col("lower")).alias("own"))
    # two levels have 2 * STEPS + 1 steps at most, so a window is as short; a text is met if one of another class is near enough in length
    all_ = Window.partitionBy("key", "lower")
    near = all_.orderBy("step").rangeBetween(-STEPS, STEPS)
    blocks = F.ceil(F.greatest(F.sum("texts").over(all_) / BLOCK, F.sum("total").over(all_) / BLOCK_WORDS)).cast("int").alias("blocks")
    # of the upper level, texts meet those of the lower one only
    around = lambda f, c: F.when(F.col("own") == 0, f(c).over(near)).otherwise(f(F.when(F.col("own") == 0, F.col(c))).over(near)).alias(c)
    split = stored(counts.select("key", "lower", "step", blocks, around(F.min, "low"), around(F.max, "high")).where("low IS NOT NULL"), "omh-open")
    with_other = (F.col("label") != F.col("low")) | (F.col("label") != F.col("high"))
    open_ = stored(parts.join(split, ["key", "lower", "step"]).where(with_other).drop("step", "low", "high"), "omh-unlike")
    dealt = open_.join(nodes.select("node", "shape", "places"), "node").withColumn("own", F.expr("cast(pmod(xxhash64(node, 8), blocks) AS int)"))
    met = dealt.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    met = met.select("key", "lower", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "level", "node", "label", "words", "shape", "places")

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parsed(b):
            table = np.frombuffer(b"".join(b.column("places").to_pylist()), np.uint32).reshape(b.num_rows, -1)
            return {x: b.column(x).to_numpy() for x in b.schema.names[:-2]} | {"shape": _shapes(b.column("shape")), "places": table}

        for c in _groups(batches, _GROUP, parsed):
            shape, table = c.pop("shape"), c.pop("places")
            p, q = _unlike(c, shape, table, similarity)
            if not len(p):
                continue
            some = np.unique(np.concatenate([p, q]))
            order = np.argsort(p, kind="stable")
            offsets = np.append(np.searchsorted(p[order], some), len(p)).astype(np.int32)
            against = pa.ListArray.from_arrays(pa.array(offsets), pa.array(c["node"][q[order]]))
            yield pa.RecordBatch.from_arrays([*(pa.array(c[x][some]) for x in (*_GROUP, "node")), against], names=[*_GROUP, "node", "against"])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parsed(b):
            hashes = []
            for part in passes(b):
                w = Words(part.column("text"))
                hashes += np.split(w.hashes(), w.first[1:-1])
            return {x: b.column(x).to_numpy() for x in (*_GROUP, "node")} | {"against": b.column("against").to_pylist(), "hashes": hashes}

        for c in _groups(batches, _GROUP, parsed):
            place = {x: k for k, x in enumerate(c["node"].tolist())}
            ends = []
            for x, others, h in zip(c["node"].tolist(), c["against"], c["hashes"]):
                for y in others:
                    o = c["hashes"][place[y]]
                    if edit_distance_within(h, o, int((1 - similarity) * max(len(h), len(o)) + 1e-9)) is not None:
                        ends.append((min(x, y), max(x, y)))
            if ends:
                yield pa.RecordBatch.from_arrays([pa.array(e, pa.int64()) for e in zip(*ends)], names=["a", "b"])

    by_group = lambda df: df.repartition(n, *_GROUP).sortWithinPartitions(*_GROUP)
    asked = stored(by_group(met).mapInArrow(plan, "key long, lower int, i int, j int, node long, against array<long>"), "omh-rest")
    # merge joins at every size, as in verified_links
    with_texts = asked.hint("merge").join(texts, "node").select(*_GROUP, "node", "against", "text")
    return by_group(with_texts).mapInArrow(align, "a long, b long").distinct()


def verified_links(pairs: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs whose word sequences have an edit similarity, 1 - distance / longer length, of at least `similarity`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in range(0, batch.num_rows, 256):
                part = batch.slice(step, 256)
                wa, wb = Words(part.column("text_a")), Words(part.column("text_b"))
                ha, hb = wa.hashes(), wb.hashes()
                good = []
                for i in range(part.num_rows):
                    x, y = ha[wa.first[i] : wa.first[i + 1]], hb[wb.first[i] : wb.first[i + 1]]
                    longer = max(len(x), len(y))
                    good.append(edit_distance_within(x, y, int((1 - similarity) * longer + 1e-9)) is not None)
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    # merge joins at every size: what is shuffled stays in proportion to the input
    with_a = pairs.hint("merge").join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    both = with_a.hint("merge").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(run, "a long, b long")


def node_texts(docs: DataFrame, nodes: DataFrame, members: DataFrame) -> DataFrame:
    """node, text of the texts that share a bucket; stored. A node's document is found by its id and its text's hash."""
    wanted = nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", "doc_id", "hash")
    rows = docs.select("doc_id", F.xxhash64("text").alias("hash"), "text")
    # of rows that repeat a document, whose text is the same, one is taken
    return stored(rows.join(wanted.hint("merge"), ["doc_id", "hash"]).select("node", "text").dropDuplicates(["node"]), "omh-texts")


def components(links: DataFrame) -> DataFrame:
    """node, label: the least node of each node's component, for the nodes of links (a, b).

    Alternating stars: neighbours are tied to the least one around, until no edge changes. A step is two grouped
    minima and joins over the edges; edges never leave the executors. They are done when all are stars: no node has two
    edges to lesser ones, or one to a lesser node and one to a greater.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # minima are stored, so that the join exchanges both sides anew and a node with very many edges can be split
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stored(large, "large-star")
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()
        edges = stored(small, "edges")
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1").isEmpty():
            return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label"))


def near_classes(docs: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, hash, f1, f2 of each row; f1, f2, class_id, class_row of each text), both stored.

    A row's number is given when it is read here. class_row is the row of the class with the least (doc_id, row).
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in passes(batch):
                w = Words(part.column("text"))
                (offsets, found, table), sizes = text_sketches(w, similarity), np.diff(w.first)
                at = (np.arange(w.n) - np.repeat(w.first[:-1], sizes)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                totals = [np.concatenate([[np.uint64(0)], np.cumsum(mix(w.hashes(seed) + at), dtype=np.uint64)]) for seed in (1, 7)]
                f1, f2 = (t[w.first[1:]] - t[w.first[:-1]] for t in totals)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(signed(found)))
                shape = pa.array([x.tobytes() for x in word_shapes(w)], pa.binary())
                columns = [pa.array(row + np.arange(part.num_rows)), part.column("doc_id"), part.column("hash"), pa.array(signed(f1)), pa.array(signed(f2)), pa.array(sizes.astype(np.int64)), lists, shape, pa.array([x.tobytes() for x in table], pa.binary())]
                row += part.num_rows
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _SKETCHED.split(", ")])

    base = stored(docs.select("doc_id", F.xxhash64("text").alias("hash"), "text").mapInArrow(sketch, _SKETCHED), "omh-sketches")
    same = [F.any_value(c).alias(c) for c in ("sketches", "words", "shape", "places")]
    nodes = base.where("doc_id IS NOT NULL").groupBy("f1", "f2").agg(F.min(F.struct("doc_id", "row", "hash")).alias("least"), *same)
    nodes = stored(nodes.select("f1", "f2", F.col("least.row").alias("node"), "least.doc_id", "least.hash", "sketches", "words", "shape", "places"), "omh-nodes")
    members = bucket_members(nodes)
    texts = node_texts(docs, nodes, members)
    pairs = stored(plausible(first_pairs(members), nodes, similarity), "omh-pairs")
    links = stored(verified_links(pairs, texts, similarity), "omh-links")
    links = links.union(stored(remaining_links(members, components(links), nodes, texts, similarity), "omh-links"))
    labelled = nodes.select("f1", "f2", "node", "doc_id").join(components(links), "node", "left")
    labelled = stored(labelled.select("f1", "f2", "node", "doc_id", F.coalesce("label", "node").alias("label")), "omh-labels")
    heads = stored(labelled.groupBy("label").agg(F.min(F.struct("doc_id", "node")).alias("head")), "omh-heads")
    named = labelled.join(heads, "label").select("f1", "f2", F.col("head.doc_id").alias("class_id"), F.col("head.node").alias("class_row"))
    return base.select("row", "doc_id", "hash", "f1", "f2"), stored(named, "omh-classes")


_SKETCHED = "row long, doc_id long, hash long, f1 long, f2 long, words long, sketches array<long>, shape binary, places binary"


def near_dedup(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id, kept: one row for each row of docs.

    Texts with the same words in the same order are one node, linked to another if the edit similarity of their
    words is at least `similarity` and they were candidates; classes are connected components. class_id is the
    least doc_id of the class, and one row of that id and class is kept. Null and empty texts are equal to each other.
    Rows with a null doc_id are kept and in no class (class_id is null); rows that repeat a doc_id with another text are documents of their own. Other columns
    are ignored; an empty table gives no rows.
    """
    return near_rows(docs, similarity).drop("text_hash")


def near_rows(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """As near_dedup, with text_hash, that of the row's text as it is."""
    rows, classes = near_classes(docs, similarity)
    joined = rows.join(classes, ["f1", "f2"], "left")
    return joined.select(
        "doc_id",
        F.col("hash").alias("text_hash"),
        F.when(F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id"),
        (F.col("doc_id").isNull() | (F.col("row") == F.col("class_row"))).alias("kept"),
    )
