"""The best documents for each item, by branch and bound over hierarchical maxima of document ranges.

Documents are sorted by id and cut to leaves of LEAF documents, groups of leaves and ranges of groups. For each term a node
holds the greatest value that any of its documents has; weighted and summed over an item's terms, these bound the
score of every document below the node. First, each item opens its most promising groups, which gives a score that its
last place needs at least. Then every range, and every group of a range, whose bound reaches that score is opened, an
equal one too, since a document of equal score and smaller id wins. Inside a group the node with the highest bound
is opened next, until no bound reaches the last place.

Groups are of bounded size, and what a group gives an item is bounded too; the search takes items in batches of
bounded size, so that the terms which the tasks look for are bounded as well.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import Words, passes, stored, tasks_of

TOP = 50
#: Documents of a leaf, leaves of an inner node, inner nodes of a group, groups of a range.
LEAF, INNER, GROUP, RANGE = 256, 8, 4, 64
#: Postings after which a group is closed early, and terms of a batch of items, counted once for each item.
POSTINGS, BATCH_TERMS = 1 << 22, 1 << 17
#: Groups that an item opens first.
FIRST = 2
#: The bytes of terms: ASCII digits and letters, and all bytes of other characters.
_APART = np.ones(256, bool)
_APART[48:58] = _APART[65:91] = _APART[97:123] = _APART[128:] = False
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def item_terms(items: DataFrame) -> DataFrame:
    """no, item_id, terms: each row of items with its number and distinct terms; stored."""
    terms = F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), F.lit(r"[0-9a-z\x{80}-\x{10FFFF}]+"), F.lit(0))
    return stored(items.select("item_id", F.array_distinct(terms).alias("terms")).withColumn("no", F.monotonically_increasing_id()), "search-items")


class Vocabulary:
    """Distinct terms by number, found by two fingerprints."""

    def __init__(self, terms: list[str]):
        w = Words(pa.array(terms, pa.string()), separator=_APART)
        one, two = w.hashes(), w.hashes(seed=5)
        self.order = np.argsort(one)
        self.one, self.two = one[self.order], two[self.order]

    def numbers(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(words, terms): which words are terms of the vocabulary, and which ones."""
        h = w.hashes()
        at = np.minimum(np.searchsorted(self.one, h), max(len(self.one) - 1, 0))
        found = np.flatnonzero(self.one[at] == h) if len(self.one) else np.zeros(0, np.int64)
        some = object.__new__(Words)
        some.data, some.starts, some.ends, some.n = w.data, w.starts[found], w.ends[found], len(found)
        good = self.two[at[found]] == some.hashes(seed=5)
        return found[good], self.order[at[found[good]]]


def document_terms(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, n, terms, counts of each row of docs: all its terms' number, and those of the vocabulary with how often they occur."""

    def run(batches):
        for batch in batches:
            for part in passes(batch):
                w = Words(part.column("text"), lower=True, separator=_APART)
                words, terms = vocabulary.numbers(w)
                size = len(vocabulary.order) or 1
                pair, count = np.unique(w.doc()[words] * size + terms, return_counts=True)
                offsets = pa.array(np.searchsorted(pair, np.arange(part.num_rows + 1) * size).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (pair % size, count)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(w.first)), *lists], names=["doc_id", "n", "terms", "counts"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stored(rows.mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<int>"), "search-terms")


_NODE = "level int, grp long, leaf int, ids array<long>, terms array<int>, tops array<int>, first array<int>, docs array<int>, gains array<int>"


def _list(values: list[np.ndarray]) -> pa.ListArray:
    offsets = np.append(0, np.cumsum([len(x) for x in values])).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values).astype(np.int32)))


def _maxima(term: np.ndarray, gain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms of sorted ones, where each begins (and the end), and the greatest gain of each."""
    starts = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
    return term[starts], np.append(starts, len(term)), np.maximum.reduceat(gain, starts)


def tree_nodes(counted: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """The leaves (level 0) with their documents and postings, and the groups (level 1) with their maxima; stored by level."""

    def nodes(number: int, ids: pa.Array, lengths: np.ndarray, sizes: np.ndarray, term: np.ndarray, tf: np.ndarray):
        m = 50 + (50 * lengths * n_docs) // n_terms
        doc = np.repeat(np.arange(len(sizes)), sizes)
        gain = (1000000000 * tf) // (1000 * tf + 20 * m[doc])
        order = np.lexsort((doc, term, doc // LEAF))
        doc, term, gain = doc[order], term[order], gain[order]
        cuts = np.searchsorted(doc // LEAF, np.arange(-(-len(sizes) // LEAF) + 1))
        rows = [_maxima(term[a:b], gain[a:b]) for a, b in zip(cuts, cuts[1:])]
        by_term = np.argsort(term, kind="stable")
        whole = _maxima(term[by_term], gain[by_term])
        none = [np.zeros(0, np.int32)]
        k = len(rows)
        leaf_ids = pa.ListArray.from_arrays(pa.array(np.append(np.minimum(np.arange(k + 1) * LEAF, len(ids)), len(ids)).astype(np.int32)), ids)
        columns = [
            pa.array([0] * k + [1], pa.int32()), pa.array([number] * (k + 1), pa.int64()), pa.array([*range(k), -1], pa.int32()), leaf_ids,
            _list([r[0] for r in rows] + [whole[0]]), _list([r[2] for r in rows] + [whole[2]]), _list([r[1] for r in rows] + none),
            _list([doc[a:b] - i * LEAF for i, (a, b) in enumerate(zip(cuts, cuts[1:]))] + none), _list([gain[a:b] for a, b in zip(cuts, cuts[1:])] + none),
        ]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _NODE.split(", ")])

    def run(batches):
        number = TaskContext.get().partitionId() << 24
        held: list[tuple] = []
        docs = postings = 0

        def close():
            ids, *rest = zip(*held)
            return nodes(number, pa.concat_arrays(ids), *(np.concatenate(x).astype(np.int64) for x in rest))

        for batch in batches:
            sizes = np.diff(np.asarray(batch.column("terms").offsets))
            at = 0
            while at < batch.num_rows:
                room = LEAF * INNER * GROUP - docs
                fitting = int(np.searchsorted(np.cumsum(sizes[at:]), POSTINGS - postings, "right"))
                take = min(room, max(fitting, 0 if docs else 1), batch.num_rows - at)
                if take:
                    part = batch.slice(at, take)
                    held.append((part.column("doc_id"), part.column("n").to_numpy(), sizes[at : at + take], part.column("terms").flatten().to_numpy(), part.column("counts").flatten().to_numpy()))
                    docs, postings, at = docs + take, postings + int(sizes[at : at + take].sum()), at + take
                if docs and (at < batch.num_rows or docs == LEAF * INNER * GROUP):
                    yield close()
                    number, held[:], docs, postings = number + 1, [], 0, 0
        if docs:
            yield close()

    rows = counted.where(F.size("terms") > 0)
    place = [F.col("doc_id").asc_nulls_last(), F.col("n")]
    dealt = rows.repartitionByRange(tasks_of(counted), *place).sortWithinPartitions(*place)
    return stored(dealt.mapInArrow(run, _NODE), "search-nodes", partition_by="level")


def open_group(leaves: pa.Table, wanted: pa.Table, terms_of: dict, weights: np.ndarray, top: int) -> pa.Table:
    """no, doc_id, score of the best of a group for each wanted item: best first, down to the score that the item's last place needs."""
    out = {"no": [], "doc_id": [], "score": []}
    leaves = leaves.sort_by("leaf").combine_chunks()
    if leaves.num_rows and wanted.num_rows:
        column = {c: leaves.column(c).combine_chunks() if isinstance(leaves.column(c), pa.ChunkedArray) else leaves.column(c) for c in ("ids", "terms", "tops", "first", "docs", "gains")}
        lists = {c: [x.values.to_numpy() for x in column[c]] for c in ("terms", "tops", "first", "docs", "gains")}
        ids = column["ids"].flatten()
        numbers = wanted.column("no").to_pylist()
        known = np.unique(np.concatenate([terms_of[x] for x in numbers]))
        k = leaves.num_rows
        tops, slot = np.zeros((k, len(known)), np.int64), np.full((k, len(known)), -1)
        for i in range(k):
            at = np.minimum(np.searchsorted(known, lists["terms"][i]), len(known) - 1)
            good = np.flatnonzero(known[at] == lists["terms"][i])
            tops[i, at[good]], slot[i, at[good]] = lists["tops"][i][good], good
        levels = [tops]
        for fan in (INNER, GROUP):
            levels.append(np.maximum.reduceat(levels[-1], np.arange(0, len(levels[-1]), fan)))
        for no, least in zip(numbers, wanted.column("least").to_pylist()):
            at = np.searchsorted(known, terms_of[no])
            weight = weights[terms_of[no]]
            bounds = [x[:, at] @ weight for x in levels]
            need, places, scores = max(least, 1), np.zeros(0, np.int64), np.zeros(0, np.int64)
            heap = [(-int(b), 2, i) for i, b in enumerate(bounds[2])]
            heapq.heapify(heap)
            while heap and -heap[0][0] >= need:
                _, level, i = heapq.heappop(heap)
                if level:
                    fan = GROUP if level == 2 else INNER
                    for j in range(i * fan, min((i + 1) * fan, len(bounds[level - 1]))):
                        if bounds[level - 1][j] >= need:
                            heapq.heappush(heap, (-int(bounds[level - 1][j]), level - 1, j))
                    continue
                own = slot[i, at]
                held = np.flatnonzero(own >= 0)
                a, b = lists["first"][i][own[held]], lists["first"][i][own[held] + 1]
                size = b - a
                posting = np.arange(size.sum()) + np.repeat(a - np.append(0, np.cumsum(size)[:-1]), size)
                # sums are far below 2 ** 53, so that they are whole in doubles
                score = np.bincount(lists["docs"][i][posting], np.repeat(weight[held], size) * lists["gains"][i][posting]).astype(np.int64)
                good = np.flatnonzero(score >= need)
                if len(good):
                    places, scores = np.append(places, good + i * LEAF), np.append(scores, score[good])
                    best = np.lexsort((places, -scores))[:top]  # a place is as high as its doc_id
                    places, scores = places[best], scores[best]
                    if len(scores) == top:
                        need = max(need, int(scores[-1]))
            out["no"] += [no] * len(places)
            out["doc_id"] += ids.take(pa.array(places)).to_pylist()
            out["score"] += scores.tolist()
    return pa.table(out, schema=pa.schema([("no", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())]))


def _searched(items: list, docs: DataFrame, top: int) -> DataFrame:
    """no, doc_id, score, rank of one batch of items: rows with no and terms."""
    spark = docs.sparkSession
    names = sorted({t for r in items for t in r["terms"]})
    number = {t: i for i, t in enumerate(names)}
    counted = document_terms(docs, Vocabulary(names))
    n_docs, n_terms = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = {r["term"]: r["df"] for r in counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()}  # a row a term at most
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held.get(i, 0) + 1))) for i in range(len(names))], np.int64)
    terms_of = {r["no"]: np.array(sorted(number[t] for t in r["terms"]), np.int64) for r in items}
    asked = [(no, int(t), int(weights[t])) for no, terms in terms_of.items() for t in terms if t in held]
    if not asked:
        return spark.createDataFrame([], "no long, doc_id long, score long")
    asked = stored(spark.createDataFrame(asked, "no long, term int, weight long"), "search-asked")
    nodes = tree_nodes(counted, n_docs, n_terms)
    leaves = nodes.where("level = 0").select("grp", "leaf", "ids", "terms", "tops", "first", "docs", "gains")
    groups = stored(nodes.where("level = 1").select("grp", F.expr(f"grp div {RANGE}").alias("range"), F.inline(F.arrays_zip("terms", "tops")).alias("term", "top")), "search-groups")
    ranges = groups.groupBy("range", "term").agg(F.max("top").alias("top"))
    bound = F.sum(F.col("weight") * F.col("top")).alias("bound")
    range_bounds = stored(ranges.join(asked, "term").groupBy("no", "range").agg(bound), "search-ranges")

    def group_bounds(chosen: DataFrame) -> DataFrame:
        return groups.join(chosen.join(asked, "no"), ["range", "term"]).groupBy("no", "grp", "least").agg(bound)

    def best(df: DataFrame, place: str, k: int) -> DataFrame:
        order = Window.partitionBy("no").orderBy(F.desc("bound"), place)
        return df.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)

    def opened(wanted: DataFrame) -> DataFrame:
        some = leaves.join(wanted.select("grp").distinct(), "grp", "left_semi")
        search = lambda a, b: open_group(a, b, terms_of, weights, top)
        found = some.groupBy("grp").cogroup(wanted.select("grp", "no", "least").groupBy("grp")).applyInArrow(search, "no long, doc_id long, score long")
        return stored(found, "search-found")

    first = stored(best(group_bounds(best(range_bounds, "range", 1).select("no", "range", F.lit(1).cast("bigint").alias("least"))), "grp", FIRST).select("no", "grp", "least"), "search-first")
    found = opened(first)
    last = found.withColumn("place", F.row_number().over(Window.partitionBy("no").orderBy(F.desc("score")))).where(F.col("place") == top)
    least = last.select("no", F.col("score").alias("least"))
    open_ranges = range_bounds.join(least, "no", "left").withColumn("least", F.coalesce("least", F.lit(1))).where("bound >= least").select("no", "range", "least")
    rest = stored(group_bounds(open_ranges).where("bound >= least").join(first.select("no", "grp"), ["no", "grp"], "left_anti"), "search-rest")
    return found.union(opened(rest))


def ranked_search(items: DataFrame, docs: DataFrame, top: int = TOP, batch_terms: int = BATCH_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the `top` best documents with a score above 0 for each row of items (item_id, text).

    Equal scores are ranked by ascending doc_id, a null one last. A row of either table counts on its own, whatever its
    id; a null text has no terms, and an item without terms, or whose terms no document holds, has no rows. Other columns are
    ignored; empty tables give no rows.
    """
    asked = item_terms(items)
    total = asked.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    batches = max(-(-total // batch_terms), 1)
    found = None
    for i in range(batches):  # each batch, of bounded size, is a search of its own over all documents
        batch = asked.select("no", "terms").where(F.expr(f"pmod(xxhash64(no), {batches}) = {i}") & (F.size("terms") > 0)).collect()
        part = _searched(batch, docs, top)
        found = part if found is None else found.union(part)
    order = Window.partitionBy("no").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(asked.select("no", "item_id"), "no").select("item_id", "rank", "doc_id", "score")
