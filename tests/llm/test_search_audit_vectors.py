"""Vector near-duplicates, the filter audit and ranked search against brute force."""

import math
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lipiflow.llm import filter_audit as audit, vector_dedup as vectors
from lipiflow.llm.filter_audit import filter_audit
from lipiflow.llm.ranked_search import ranked_search
from lipiflow.llm.vector_dedup import vector_dedup

def scaled(v):
    """A vector whose squares neither overflow nor vanish, in the same direction."""
    most = max((abs(c) for c in v if c is not None), default=0) if v else 0
    return [c / most for c in v] if v and None not in v and 0 < most < math.inf else v


VECTORS = "vec_id long, embedding array<double>, label int, node long, size int, cell string"


def at_cosine(rng, x, cosine):
    """A vector at that cosine to x, of another length."""
    x = x / np.linalg.norm(x)
    y = rng.standard_normal(len(x))
    y -= (y @ x) * x
    return (cosine * x + math.sqrt(1 - cosine**2) * y / np.linalg.norm(y)) * rng.uniform(0.5, 2)


def brute_links(rows, similarity=0.95):
    good = [i for i, (_, v) in enumerate(rows) if v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    links = defaultdict(set)
    for a in good:
        for b in good:
            if a < b and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1]), np.array(rows[b][1])
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= similarity:
                    links[a].add(b)
                    links[b].add(a)
    out = []
    for i, (key, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        component = min(ids) if ids else None
        out.append((key, len(links[i]), component, key == component))
    return Counter(out)


def vector_rows(rng):
    rows, number = [], iter(range(10_000))
    for _ in range(60):
        rows.append((next(number), rng.standard_normal(32)))
    for k in range(12):  # chains and balls well above and below the threshold
        x = rng.standard_normal(32)
        for _ in range(rng.integers(2, 9)):
            rows.append((next(number), x))
            x = at_cosine(rng, x, [0.99, 0.97, 0.9][k % 3])
    hot = rng.standard_normal(32)
    rows += [(next(number), hot + 0.01 * rng.standard_normal(32)) for _ in range(70)] + [(next(number), hot) for _ in range(20)]
    rows += [(next(number), 3 * hot), (5, hot), (5, hot), (None, hot), (None, rng.standard_normal(32)), (None, 1e-200 * hot), (next(number), 1e200 * hot), (next(number), -hot)]
    rows += [(next(number), x) for x in (None, [], [0.0] * 32, [1.0, None], [1.0, float("nan")], [float("inf")] + [0.0] * 31, [0.0] * 32, [1.0, 2.0], [2.0, 4.0], [-0.0, 1.0], [0.0, 1.0])]
    return [(i, None if v is None else [None if c is None else float(c) for c in v]) for i, v in rows]


@pytest.mark.parametrize("block", [16, 4096])
def test_links_are_brute_force(spark, block):
    rows = vector_rows(np.random.default_rng(4))
    df = spark.createDataFrame([(i, v, 1, 2, 3, "x") for i, v in rows], VECTORS).repartition(3)
    got = vector_dedup(df, recall=0.9999, block=block)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert Counter(map(tuple, got.collect())) == brute_links([(i, scaled(v)) for i, v in rows])


def test_recall_at_the_threshold(spark):
    rng, pairs = np.random.default_rng(8), 600
    first = rng.standard_normal((pairs, 64))
    rows = [(2 * i + k, [float(c) for c in v]) for i, x in enumerate(first) for k, v in enumerate((x, at_cosine(rng, x, 0.9501)))]
    found = vector_dedup(spark.createDataFrame([(i, v, 0, 0, 0, "") for i, v in rows], VECTORS)).where("n_links > 0").count() / 2
    assert found >= 0.98 * pairs
    assert vectors.recall_of(vectors.half_window()) >= vectors.RECALL
    assert 0 < vectors.recall_of(0.1) < 0.01


def test_no_vectors(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert vector_dedup(empty).collect() == []
    assert vector_dedup(spark.createDataFrame([(1, None, 0, 0, 0, "")], VECTORS)).collect() == [(1, 0, 1, True)]


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_audit(docs, labels):
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    rows = []
    for i, text, lang in docs:
        t = text or ""
        w = WORD.findall(t)
        e = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)
        fails = {f for f, x in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), bool(re.search(r"[#$%&*|]", t)), e)) if x}
        rows.append((lang or "", fails, i is not None and i in good, i is not None and i in toxic))
    out, shapley = {}, Counter()
    for part in {r[0] for r in rows}:
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                before = set(order[:k])
                here = [r for r in rows if r[0] == part and f in r[1]]
                gone = [r for r in here if not r[1] & before]
                shapley[part, f] += len(gone)
                out[part, "".join(order), k + 1] = [
                    sum(r[0] == part and not r[1] & (before | {f}) for r in rows), len(gone), len(here) - len(gone), sum(r[1] == {f} for r in here), sum(r[2] for r in gone), sum(r[3] for r in gone),
                ]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


DOCS = "doc_id long, text string, lang string, mask int, part string, head long, n long"


def audit_rows():
    rng = random.Random(5)
    letters = ["a", "b", "Ab", "C", "d#", "é", "word", "x|"]
    some = [" ".join(rng.choice(letters) + str(rng.randint(0, rng.choice([3, 400]))) for _ in range(rng.choice([0, 3, 150, 199, 200, 300]))) for _ in range(25)]
    some += [None, "", " ", "\n", "A" * 3, "a" * 97 + "BCD", "a" * 96 + "BCDE", "w " * 200, "long " * 50_000]
    docs = [(rng.randint(0, 60), rng.choice(some), rng.choice(["en", "de", None, ""])) for _ in range(150)]
    docs += [(i, "the same text in very many rows", "en") for i in range(100, 400)] + [(7, "the same text in very many rows", "fr")] * 40
    docs += [(None, "the same text in very many rows", "en"), (None, None, None), (3, None, None), (3, None, None)]
    return docs


@pytest.mark.parametrize("clash", [False, True])
def test_audit_is_brute_force(spark, monkeypatch, clash):
    if clash:  # unlike texts with equal fingerprints lie between equal ones
        monkeypatch.setattr(audit, "fingerprint", lambda text: F.length(text).cast("long") % 3)
    docs = audit_rows()
    labels = [(i, i % 2, None if i % 5 else 1) for i in range(0, 300, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (9999, 1, 1)]
    frame = spark.createDataFrame([(*d, 1, "p", 2, 3) for d in docs], DOCS).repartition(5)
    got = filter_audit(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    rows = {tuple(r[:3]): tuple(r[3:]) for r in got.collect()}
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert rows == brute_audit(docs, labels)


def test_one_text_in_all_rows_spreads_over_partitions(spark):
    docs = spark.range(0, 4000, 1, 3).select(F.col("id").alias("doc_id"), F.lit("one").alias("text"), F.lit("en").alias("lang"))
    assert audit.failures(docs).where("mask >= 16").count() == 3999


def test_audit_of_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit(empty, labels).collect() == []
    one = filter_audit(spark.createDataFrame([(1, "x", "en", 1, "", 1, 1)], DOCS), labels)
    assert one.count() == 600 and one.agg(F.sum("removed")).first()[0] == 120


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute_search(items, docs, top):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    lengths = [sum(b.values()) for _, b in bags]
    n, total = sum(x > 0 for x in lengths), sum(lengths)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        found = []
        for (i, b), size in zip(bags, lengths):
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * b[t] // (1000 * b[t] + 20 * (50 + 50 * size * n // total))) for t in set(terms(text)) if t in b)
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(found)[:top], 1)]
    return Counter(out)


ITEMS, SEARCHED = "item_id long, text string, no long, term string", "doc_id long, text string, grp long, score int, rank int"


@pytest.mark.parametrize("batch_terms", [1 << 17, 25])
def test_search_is_brute_force(spark, batch_terms):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(300)] + ["Ünï", "ÇA", "漢字", "a_b", "x-y", "\U0001f600", "İ"]
    weight = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(rng.choices(words, weight, k=rng.choice([1, 2, 2, 3, 9, 40])))) for i in range(3000)]
    docs += [(None, "w0 w1"), (None, None), (5, "w200 w201"), (5, "w200 w201"), (-3, "w200 w201"), (4000, ""), (4001, "--\x00--"), (4002, "w250 " * 30_000), (4003, "w" * 200_000), (4004, "W9\x00w9 Ünï")]
    rng.shuffle(docs)
    items = [(i, " ".join(rng.choices(words, k=rng.choice([1, 2, 5, 30])))) for i in range(12)] + [(90, "w0"), (91, "unknown"), (92, None), (93, ""), (94, "w200 w201 W200"), (94, "w5, w6"), (None, "w7"), (95, "w" * 200_000)]
    frame = spark.createDataFrame([(*d, 1, 2, 3) for d in docs], SEARCHED).repartition(3)
    got = ranked_search(spark.createDataFrame([(*i, 1, "x") for i in items], ITEMS), frame, top=20, batch_terms=batch_terms)
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and dict(got.dtypes)["rank"] == "int"
    assert Counter(map(tuple, got.collect())) == brute_search(items, docs, 20)


def test_search_with_equal_scores_everywhere(spark):
    docs = [(i, "same words here") for i in range(9000, 0, -1)] + [(0, "other")]
    got = ranked_search(spark.createDataFrame([(1, "same words", 0, "")], ITEMS), spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(got) == 0 or [r.doc_id for r in sorted(got, key=lambda r: r.rank)] == list(range(1, 51))
    got = ranked_search(spark.createDataFrame([(1, "other same", 0, "")], ITEMS), spark.createDataFrame(docs, "doc_id long, text string").where("doc_id % 3 = 0 OR doc_id > 8990"))
    assert got.where("rank = 1").first().doc_id == 0


def test_search_of_nothing(spark):
    items, docs = spark.createDataFrame([(1, "a", 0, "")], ITEMS), spark.createDataFrame([(1, "a b", 0, 0, 0), (2, None, 0, 0, 0)], SEARCHED)
    assert ranked_search(items.limit(0), docs).collect() == []
    assert ranked_search(items, docs.limit(0)).collect() == []
    assert ranked_search(items, docs.where("doc_id = 2")).collect() == []


def test_places_are_compared_in_sixteen_bits():
    from lipiflow.llm.vector_dedup import FAR, near

    rng = np.random.default_rng(4)
    ends = np.array([-FAR, -FAR + 1, -1, 0, 1, FAR - 1, FAR])
    a, b = (np.concatenate([ends, rng.integers(-FAR, FAR + 1, 500)]).astype(np.int16) for _ in range(2))
    for width in (0, 1, 700, FAR - 1, FAR, FAR + 1, 40_000):
        assert (near(a[:, None], b, width) == (np.abs(a[:, None].astype(int) - b) <= width)).all()
