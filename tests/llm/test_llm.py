"""The training-data operators against brute force, library round trips and hand-made cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lipiflow.llm import bpe, hmm, packing, token_counts, toxicity
from lipiflow.llm.common import Words, window_hashes
from lipiflow.llm.exact_dedup import exact_dedup, grace
from lipiflow.llm.line_dedup import apply_bitmaps, line_dedup
from lipiflow.llm.quality_rules import quality_rules
from lipiflow.llm.queries import tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = ["", None, " ", "\n\n", "a", "a a a a a a a a a a a a", "Ünï çødé x y", "x" * 5000, "w " * 3000, "tab\tand\x0bothers\x0c.\r\n", "é\n" * 50, "á ́b ﬁ İ ß \U0001f600\U0001f600"]


def frame(spark, texts, ids=None):
    ids = ids or list(range(len(texts)))
    return spark.createDataFrame([(i, t, "x", 1.0) for i, t in zip(ids, texts)], "doc_id long, text string, key string, h double")


def texts_of(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    return [r.doc_id for r in rows], [r.text for r in rows]


def test_words_are_the_pattern_s():
    w = Words(pa.array(ODD))
    got = [[bytes(w.data[s:e]).decode() for s, e in zip(w.starts[a:b], w.ends[a:b])] for a, b in zip(w.first, w.first[1:])]
    assert got == [WORD.findall(t or "") for t in ODD]
    flat = [x for g in got for x in g]
    h = w.hashes()
    assert len(set(h.tolist())) == len(set(flat))
    assert len({(a, b) for a, b in zip(flat, h.tolist())}) == len(set(flat))


def test_window_hashes_tell_windows_apart():
    h = np.array([1, 2, 3, 1, 2, 3, 1, 2, 4], np.uint64)
    got = window_hashes(h, 3)
    assert got[0] == got[3] and len(set(got.tolist())) == 4


def test_bpe_equals_the_library(spark, sf_dir):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    own = bpe.ByteBpe(tokenizer("byte_bpe_50k.json"))
    rng = random.Random(3)
    pool = "abc ABC  \n\t'sll've 12٣½éßñ漢字ीं  ​\x1c\x85🙂.,!?<|endoftext|>"
    texts = [t or "" for t in ODD] + texts_of(spark, sf_dir)[1][:60] + ["".join(rng.choice(pool) for _ in range(rng.randint(0, 80))) for _ in range(600)]
    texts += ["a<|endoftext|>b <|endoftext|>", "<|endoftext|>" * 3]
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == want, t
        assert own.decode(want) == library.decode(want, skip_special_tokens=False)


def test_bpe_query_digests(spark):
    got = {r.doc_id: r for r in bpe.bpe_digests(frame(spark, ODD), tokenizer("byte_bpe_50k.json")).collect()}
    trip = {r.doc_id: r for r in bpe.bpe_round_trip(frame(spark, ODD), tokenizer("byte_bpe_50k.json")).collect()}
    for i, t in enumerate(ODD):
        assert trip[i].decoded == (t or "")
        assert got[i].n_tokens == len(trip[i].ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, trip[i].ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_token_counts_equal_the_library():
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces = token_counts.unigram_pieces(tokenizer("piece_bpe_32k.model"))
    library = Tokenizer(models.Unigram([("\x00unknown", 0.0), *pieces], unk_id=0, byte_fallback=False))
    library.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    own = token_counts.CountingUnigram(pieces)
    rng = random.Random(5)
    pool = "the of and ing tion  éèà ß漢字龘🙂\n\t▁xyzqq012.,"
    texts = [t or "" for t in ODD] + ["".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(800)]
    for t in texts:
        e = library.encode(t, add_special_tokens=False)
        want = 0
        for i, (a, b) in zip(e.ids, e.offsets):
            want += len(t[a:b].encode()) if i == 0 else 1
        assert own.count(t) == want, (t, e.tokens)


def test_quality_counts(spark, sf_dir):
    ids, texts = texts_of(spark, sf_dir)
    texts = ODD + texts + ["one two three four five six\none two three four five six\n\n\nother"] + ["the same line of words\n" * 9]
    got = {r.doc_id: r for r in quality_rules(frame(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        words = WORD.findall(t or "")
        windows = Counter(tuple(words[j : j + 5]) for j in range(len(words) - 4))
        marked = set()
        for j in range(len(words) - 4):
            if windows[tuple(words[j : j + 5])] > 1:
                marked |= set(range(j, j + 5))
        seen, again = set(), 0
        for line in (t or "").split("\n"):
            if WORD.search(line):
                again += line in seen
                seen.add(line)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(words), sum(map(len, words)), len(marked), again), t
        assert r.n_symbols == sum((t or "").count(c) for c in "#*$%&|<>")
        assert r.base_failed == (len(words) < 10 or 100 * len(marked) > 20 * len(words))
        assert not (r.kept and r.base_failed)


def test_line_dedup_cases(spark):
    long = "This line has got at least forty code points, it has"
    texts = [f"{long}\nown {i}" for i in range(6)] + [f"  {long.upper()}\t\n{long}", None, "", "\n"]
    df = frame(spark, texts)
    got = {r.doc_id: r for r in apply_bitmaps(df, line_dedup(df)).collect()}
    assert [got[i].kept_text for i in range(6)] == [f"own {i}" for i in range(6)]
    assert got[6].kept_text == texts[6] and got[6].n_dropped == 0
    assert [(got[i].n_lines, got[i].kept_text) for i in (7, 8, 9)] == [(1, ""), (1, ""), (2, "\n")]
    many = "\n".join([long] * 130 + ["end"])
    df = frame(spark, [many] * 5)
    got = {r.doc_id: r for r in apply_bitmaps(df, line_dedup(df)).collect()}
    assert got[0].n_dropped == 130 and got[0].kept_text == "end" and got[4].n_dropped == 0
    empty = df.limit(0)
    assert apply_bitmaps(empty, line_dedup(empty)).count() == 0


def test_line_dedup_plan_has_no_python(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = apply_bitmaps(docs, line_dedup(docs))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_line_dedup_streams_sorted_ranges(spark, sf_dir):
    """One range exchange, its sort, then the window: nothing between them."""
    from lipiflow.llm.line_dedup import first_occurrences, line_keys

    plan = first_occurrences(line_keys(spark.read.parquet(f"{sf_dir}/documents.parquet")))._jdf.queryExecution().executedPlan().toString()
    names = re.findall(r"Exchange \w+|Sort \[|Window \[", plan)
    assert names == ["Window [", "Sort [", "Exchange rangepartitioning"], plan


def test_line_dedup_of_repeated_and_null_ids(spark):
    shared = "a shared line that has forty code points or more"
    texts = [shared] * 5 + [f"{shared}\nb", "a line that only this row has, of forty points\nb", f"x\n{shared}", f"x\n{shared}", shared, None]
    ids = [0, 1, 3, 4, 9, 2, 2, 7, 7, None, None]
    df = frame(spark, texts, ids)
    got = [(r.doc_id, r.n_dropped, r.kept_text) for r in apply_bitmaps(df, line_dedup(df)).collect()]
    want = [(i, 1, "") for i in (0, 1, 3, 4)] + [(9, 0, shared), (2, 1, "b"), (2, 0, texts[6]), (7, 1, "x"), (7, 1, "x"), (None, 0, shared), (None, 0, "")]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_grace_spills_and_collapses():
    rng = random.Random(1)
    contents = [rng.randbytes(300) for _ in range(400)]
    records = [(c, i, (i, ""), 1) for i, c in enumerate(rng.choices(contents, k=9000))]
    found = list(grace(iter(records), limit=20_000))
    first = {m: f for x in found if isinstance(x, list) for m, f in x}
    tables = [x for x in found if not isinstance(x, list)]
    assert len(tables) > 3 and max(len(x) for x in found if isinstance(x, list)) <= 4096
    by_content = {}
    for c, i, *_ in records:
        by_content.setdefault(c, []).append(i)
    got = {c: (f, m[0], t) for table in tables for c, f, m, t in zip(table.contents, table.first, table.largest, table.times)}
    assert got == {c: (x[0], x[-1], len(x)) for c, x in by_content.items()}
    assert all(first[i] == by_content[c][0] for c, i, *_ in records)


def test_exact_dedup_cases(spark):
    texts = ["Same", "sAME", "same", "É", "é", None, "", " ", "Same"]
    ids = [5, 9, 2, 3, 4, 7, 6, 8, 9]
    got = sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup(frame(spark, texts, ids)).collect())
    # of the two rows that repeat the largest id one stays
    assert got == sorted([(5, 9, 4, False), (9, 9, 4, True), (2, 9, 4, False), (9, 9, 4, False), (3, 3, 1, True), (4, 4, 1, True), (7, 7, 2, True), (6, 7, 2, False), (8, 8, 1, True)])
    assert exact_dedup(frame(spark, texts, ids).limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_pack_covers_all_without_padding(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([1, 2, rng.randint(1, 600), rng.randint(1, 4096), rng.randint(4000, 20_000)]) for _ in range(rng.choice([1, 3, 200]))]
    windows = packing.pack(lengths)
    parts = sorted(p for w in windows for p in w)
    at = 0
    for doc, n in enumerate(lengths):
        own = [(s, k) for d, s, k in parts if d == doc]
        assert own[0][0] == 0 and all(a + k == b for (a, k), (b, _) in zip(own, own[1:])) and sum(own[-1]) == n
        at += n
    assert sum(k for *_, k in parts) == at
    for w in windows:
        size = sum(k for *_, k in w)
        assert size <= 4096 and size & (size - 1) == 0


def test_packing_ids_equal_the_library(spark, sf_dir):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    rng = random.Random(9)
    pool = "abJHjhtT\u030c\u0331 CD  \n\t'sll've 12é́ßΣς漢İ  🙂.,<|endoftext|>"
    texts = ODD + texts_of(spark, sf_dir)[1][:80] + ["".join(rng.choice(pool) for _ in range(40)) for _ in range(300)] + ["a<|endoftext|>b ΑΣ ς"]
    ids: dict[int, dict[int, list[int]]] = {}
    rows = packing.packed_sequences(frame(spark, texts), tokenizer("word_bpe_49k.json"), with_ids=True, buffer_tokens=20_000).collect()
    place = {}
    for r in rows:
        own = np.frombuffer(r.ids, "<u4")
        assert len(own) == r.length and zlib.crc32(r.ids) == r.ids_crc32
        ids.setdefault(r.doc_id, {})[r.start] = own.tolist()
        place.setdefault(r.sequence_id, []).append((r.offset, r.length, r.tier))
    for i, t in enumerate(texts):
        want = library.encode(t or "", add_special_tokens=False).ids + [2]
        assert [x for s in sorted(ids[i]) for x in ids[i][s]] == want, t
    for pieces in place.values():
        pieces.sort()
        assert [o for o, *_ in pieces] == np.cumsum([0] + [n for _, n, _ in pieces])[:-1].tolist()
        assert sum(n for _, n, _ in pieces) == pieces[0][2]


def test_step_groups_hold_one_size():
    sizes = [4096] * 40 + [1024] * 100 + [8]
    steps = packing.step_groups(sizes)
    of = {}
    for s, g in zip(sizes, steps):
        of.setdefault(g, []).append(s)
    assert all(len(set(x)) == 1 and sum(x) <= packing.STEP_TOKENS for x in of.values())


def test_hmm_counts_and_base(spark, sf_dir):
    ids, texts = texts_of(spark, sf_dir)
    ids, texts = ids + [10_000 + i for i in range(len(ODD))], texts + ODD
    tokens = {i: [w.lower() if w.isascii() else "".join(c.lower() if c < "\x80" else c for c in w) for w in WORD.findall(t or "")] + ["\0end"] for i, t in zip(ids, texts)}
    train = Counter(w for i in ids if zlib.crc32(str(i).encode()) % 10 for w in tokens[i])
    total, types = sum(train.values()), len(train)
    got = {r.doc_id: r for r in hmm.hmm_scores(frame(spark, texts, ids), states=3, iterations=2).collect()}
    assert len(got) == len(ids)
    for i in ids:
        r = got[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 10 == 0)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens[i]), sum(train[w] > 0 for w in tokens[i]), total)
        want = sum(np.log10((train[w] + 0.1) / (total + 0.1 * (types + 1))) for w in tokens[i])
        assert abs(r.base_score - want) < 1e-6 * max(1, abs(want))
        assert r.score < 0
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_hmm_forward_is_the_sum_over_paths():
    import itertools

    rng = np.random.default_rng(0)
    norm = lambda x, axis: x / x.sum(axis, keepdims=True)
    m = hmm.Hmm(norm(rng.random(2), 0), norm(rng.random((2, 2)), 1), norm(rng.random((hmm.SYMBOLS, 2)), 0))
    texts = [[3, 70, 5, 0], [0], [1, 1, 1, 2, 0]]
    flat, offsets = np.array(sum(texts, [])), np.cumsum([0] + [len(t) for t in texts])
    for got, t in zip(m.log10(flat, offsets), texts):
        total = 0
        for path in itertools.product(range(2), repeat=len(t)):
            p = m.start[path[0]] * m.emits[t[0], path[0]]
            for a, b, s in zip(path, path[1:], t[1:]):
                p *= m.moves[a, b] * m.emits[s, b]
            total += p
        assert abs(got - np.log10(total)) < 1e-9
    starts, moves, emits, _ = m.expected(flat, offsets.astype(int))
    assert abs(starts.sum() - 3) < 1e-9 and abs(emits.sum() - len(flat)) < 1e-9 and abs(moves.sum() - len(flat) + 3) < 1e-9


def test_hmm_counts_are_the_sum_over_paths():
    """Counts by enumerating paths of short texts, and by a plain unscaled recursion of texts over several blocks."""
    import itertools

    rng = np.random.default_rng(3)
    norm = lambda x, axis: x / x.sum(axis, keepdims=True)
    m = hmm.Hmm(norm(rng.random(2), 0), norm(rng.random((2, 2)), 1), norm(rng.random((5, 2)), 0))

    def paths(text):
        starts, moves, emits, all_ = np.zeros(2), np.zeros((2, 2)), np.zeros((5, 2)), 0
        for path in itertools.product(range(2), repeat=len(text)):
            p = m.start[path[0]] * m.emits[text[0], path[0]]
            for a, b, s in zip(path, path[1:], text[1:]):
                p *= m.moves[a, b] * m.emits[s, b]
            all_ += p
            starts[path[0]] += p
            for a, b in zip(path, path[1:]):
                moves[a, b] += p
            for s, a in zip(text, path):
                emits[s, a] += p
        return starts / all_, moves / all_, emits / all_

    def recursion(text):
        alpha, beta = [m.start * m.emits[text[0]]], [np.ones(2)]
        for s in text[1:]:
            alpha.append((alpha[-1] @ m.moves) * m.emits[s])
        for s in text[:0:-1]:
            beta.insert(0, m.moves @ (m.emits[s] * beta[0]))
        all_, emits, moves = alpha[-1].sum(), np.zeros((5, 2)), np.zeros((2, 2))
        for t, s in enumerate(text):
            emits[s] += alpha[t] * beta[t] / all_
            if t:
                moves += np.outer(alpha[t - 1], m.emits[s] * beta[t]) * m.moves / all_
        return alpha[0] * beta[0] / all_, moves, emits

    short = [rng.integers(0, 5, n) for n in (1, 2, 5, 9, 9)]
    long = [rng.integers(0, 5, n) for n in (31, 32, 33, 64, 65, 150, 200)]
    for texts in (short, long, short + long):
        flat, offsets = np.concatenate(texts), np.cumsum([0] + [len(t) for t in texts])
        starts, moves, emits, total = m.expected(flat, offsets)
        want = [paths(t) if len(t) < 10 else recursion(t) for t in texts]
        for got, each in zip((starts, moves, emits), zip(*want)):
            assert np.allclose(got, sum(each), atol=1e-9)
        assert abs(total / np.log(10) - m.log10(flat, offsets).sum()) < 1e-6


def test_texts_taken_together_are_whole():
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, 9, n) for n in rng.integers(1, 400, 300)]
    lists = pa.array([t.tolist() for t in texts], pa.list_(pa.int32()))
    batches = [pa.RecordBatch.from_arrays([lists.slice(a, 70)], names=["symbols"]) for a in range(0, 300, 70)]
    got = []
    for symbols, offsets in hmm._together(batches, 2000):
        got += [symbols[a:b].tolist() for a, b in zip(offsets, offsets[1:])]
    assert got == [t.tolist() for t in texts]


def test_toxicity_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    chain = toxicity.train(docs, labels.where("doc_id % 2 = 0"))
    test = labels.where("doc_id % 2 = 1")
    rows = toxicity.toxicity(docs.join(test.select("doc_id"), "doc_id"), chain).join(test, "doc_id").collect()
    hit = sum(r.is_toxic for r in rows if r.toxic)
    assert hit > 0.7 * sum(r.toxic for r in rows)  # the labels themselves are noisy
    assert sum(r.is_toxic for r in rows if not r.toxic) < 0.02 * len(rows)


def test_linear_model_is_the_penalised_optimum():
    """The gradient of the ridge likelihood, by a dense matrix made here, is zero; predictions follow the formula."""
    rng = np.random.default_rng(5)
    docs = [np.unique(rng.integers(0, 40, rng.integers(1, 12))) for _ in range(400)]
    y = np.array([float(rng.random() < (0.8 if 3 in d else 0.1)) for d in docs])
    words, offsets = np.concatenate(docs).astype(np.int32), np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    before = rng.random((400, 2))
    m = toxicity.fit_linear(words, offsets, before, y)
    assert 3 in m.buckets
    x = np.array([[*(float(b in d) for b in m.buckets), *before[i], 1.0] for i, d in enumerate(docs)])
    beta = np.concatenate([m.weights, m.chain, [m.bias]])
    p = 1 / (1 + np.exp(-x @ beta))
    penalty = np.array([1.0] * (len(beta) - 1) + [1e-3])
    assert np.abs(x.T @ (y - p) - penalty * beta).max() < 1e-4
    assert np.allclose(m.predict(words, offsets, before), p)


def test_chain_feeds_out_of_fold_probabilities():
    """Each later model equals one fitted here to the earlier ones' predictions for folds that they have not seen."""
    rng = np.random.default_rng(8)
    docs = [np.unique(rng.integers(0, 30, rng.integers(1, 9))) for _ in range(300)]
    words, offsets = np.concatenate(docs).astype(np.int32), np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    first = np.array([(1 in d) ^ (rng.random() < 0.1) for d in docs], float)
    last = np.array([bool(f) and rng.random() < 0.9 for f in first], float)
    chain = toxicity.fit_chain(words, offsets, np.column_stack([first, last]), ["first", "last"])
    part = lambda keep: (np.concatenate([docs[i] for i in keep]).astype(np.int32), np.concatenate([[0], np.cumsum([len(docs[i]) for i in keep])]))
    column = np.zeros(300)
    for k in range(toxicity.FOLDS):
        seen, held = [i for i in range(300) if i % toxicity.FOLDS != k], [i for i in range(300) if i % toxicity.FOLDS == k]
        column[held] = toxicity.fit_linear(*part(seen), np.zeros((len(seen), 0)), first[seen]).predict(*part(held), np.zeros((len(held), 0)))
    want = toxicity.fit_linear(words, offsets, column[:, None], last)
    assert np.array_equal(chain.models[1].buckets, want.buckets) and np.allclose(chain.models[1].weights, want.weights) and np.allclose(chain.models[1].chain, want.chain)
    assert chain.models[1].chain[0] > 1
    p = chain.predict(words, offsets)
    assert np.allclose(p[:, 1], want.predict(words, offsets, p[:, :1]))


def test_repeated_labels_and_rows_train_one_model(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    other = labels.select("doc_id", F.lit(9).alias("quality"), F.lit(1).alias("toxic"))  # a larger pair does not count
    models = [toxicity.train(*x).models for x in ((docs, labels), (docs.union(docs).repartition(7), labels.union(other).union(labels).repartition(5)))]
    for a, b in zip(*models):
        assert np.array_equal(a.buckets, b.buckets) and np.allclose(a.weights, b.weights) and abs(a.bias - b.bias) < 1e-9


def test_toxicity_odd_rows(spark):
    chain = toxicity.train(frame(spark, ODD), spark.createDataFrame([(0, 1, 0), (1, None, 1), (None, 0, 0), (4, 0, 1), (4, 0, 1)], "doc_id long, quality int, toxic int"))
    assert toxicity.toxicity(frame(spark, ODD), chain).count() == len(ODD)
    assert toxicity.toxicity(frame(spark, ODD).limit(0), chain).count() == 0


@pytest.mark.parametrize("run", [hmm.hmm_scores, quality_rules, lambda d: token_counts.token_counts(d, tokenizer("piece_bpe_32k.model"))])
def test_empty_table_and_null_ids(spark, run):
    assert run(frame(spark, ODD).limit(0)).count() == 0
    odd = spark.createDataFrame([(None, None), (None, "x y"), (1, "x y"), (1, "x y")], "doc_id long, text string")
    assert run(odd).count() == 4


def brute_substrings(texts, window):
    words = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


@pytest.mark.parametrize("window,rounds", [(35, 4), (6, 2), (12, 9)])
def test_substring_dedup_is_brute_force(spark, sf_dir, window, rounds):
    from lipiflow.llm.substring_dedup import substring_dedup

    rng = random.Random(window)
    passage = [rng.choice("abcdefgh") + str(i % 7) for i in range(3 * window)]
    few = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 3 * window))) for _ in range(60)]
    cut = [" ".join(rng.choice("xyz") + str(rng.randint(0, 99)) for _ in range(5)) + " " + " ".join(passage[rng.randint(0, window) : rng.randint(window, 3 * window)]) + " end" + str(i) for i in range(40)]
    texts = ODD + few + cut + ["a " * (2 * window), "a b " * window, "a " * (window + 3), "p q r " * window] + texts_of(spark, sf_dir)[1][:100]
    ids = [None, *range(1, len(texts) - 1), 1]
    got = substring_dedup(frame(spark, texts, ids), window, rounds).collect()
    want = brute_substrings(texts, window)
    assert sorted((r.doc_id or -1, r.n_words, r.n_removed, r.kept_text) for r in got) == sorted(((i or -1), *w) for i, w in zip(ids, want))


def test_substring_dedup_empty(spark):
    from lipiflow.llm.substring_dedup import substring_dedup

    assert substring_dedup(frame(spark, ODD).limit(0)).count() == 0


def test_repeated_rows_repeat_their_windows(spark):
    from lipiflow.llm.substring_dedup import substring_dedup

    text = " ".join(f"w{i}" for i in range(50))
    got = substring_dedup(frame(spark, [text, text, text + " x"], [1, 1, 2])).collect()
    assert sorted((r.doc_id, r.n_removed, r.kept_text) for r in got) == [(1, 50, ""), (1, 50, ""), (2, 50, "x")]


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_banded_alignment_is_the_edit_distance():
    from lipiflow.llm.near_dedup import edit_distance_within

    rng = random.Random(4)
    for _ in range(400):
        a = [rng.randint(0, 3) for _ in range(rng.randint(0, 14))]
        b = [x for x in a if rng.random() > 0.2]
        b = [rng.randint(0, 3) if rng.random() < 0.2 else x for x in b] + [1] * rng.randint(0, 2)
        d = edit_distance(a, b)
        for most in (0, 1, 3, 20):
            assert edit_distance_within(np.array(a, int), np.array(b, int), most) == (d if d <= most else None), (a, b)


def test_near_dedup_classes(spark):
    from lipiflow.llm.near_dedup import near_dedup

    rng = random.Random(8)
    new = lambda n: [f"{rng.choice('abcdefgh')}{rng.randint(0, 5000)}" for _ in range(n)]
    texts, group, shared = [], [], new(40)
    for g in range(30):
        base = new(rng.choice([120, 300]))
        for _ in range(rng.choice([1, 2, 9])):
            w = list(base)
            for _ in range(len(w) // 60):
                w[rng.randrange(len(w))] = "changed" + str(rng.randint(0, 99))
            texts.append(" ".join(w))
            group.append(g)
    for g in range(100, 160):  # one passage in different texts
        texts.append(" ".join(new(60) + shared + new(60)))
        group.append(g)
    texts += ["", None, " \n", "two words", "two  words"]
    group += [200, 200, 200, 201, 201]
    ids = list(range(len(texts)))
    rows = near_dedup(frame(spark, texts + ["a b c d e f"], ids + [None])).collect()
    got = {r.doc_id: r for r in rows if r.doc_id is not None}
    least = {}
    for i, g in zip(ids, group):
        least.setdefault(g, i)
    assert {i: r.class_id for i, r in got.items()} == {i: least[g] for i, g in zip(ids, group)}
    assert all(r.kept == (i == r.class_id) for i, r in got.items())
    assert [(r.class_id, r.kept) for r in rows if r.doc_id is None] == [(None, True)]
    assert near_dedup(frame(spark, texts[:3]).limit(0)).count() == 0


def test_near_copies_in_a_bucket_of_unlike_texts(spark):
    """Texts share a passage, and pairs of them every other word of the rest: only the passage's buckets hold such a pair."""
    from lipiflow.llm.near_dedup import near_dedup

    passage, pairs = [f"p{i}" for i in range(60)], 60
    own = lambda g, copy: [f"o{g}x{i}" if i % 2 else f"c{copy}g{g}x{i}" for i in range(20)]
    texts = [" ".join(passage + own(i % pairs, i // pairs)) for i in range(2 * pairs)]
    rows = near_dedup(frame(spark, texts)).collect()
    assert {r.doc_id: r.class_id for r in rows} == {i: i % pairs for i in range(2 * pairs)}


def test_sketches_find_pairs_near_the_threshold():
    """Of all pairs at 0.8 or more by brute force, every short one and nine of ten long ones share a sketch."""
    from lipiflow.llm.near_dedup import text_sketches

    rng, texts = random.Random(3), []
    for n in [4, 5, 6, 9, 10, 14, 15, 19, 20, 25, 40, 100, 200] * 12:
        base, d = [f"w{rng.randint(0, 3000)}" for _ in range(n)], n // 5
        places = [range(4, n, 5), rng.sample(range(n), d)]
        texts += [base] + [[f"z{rng.randint(0, 3000)}" if i in p else x for i, x in enumerate(base)] for p in places]
        texts.append([x for i, x in enumerate(base) if i not in places[1]])
    offsets, found, _ = text_sketches(Words(pa.array([" ".join(x) for x in texts])))
    own = [set(found[a:b].tolist()) for a, b in zip(offsets, offsets[1:])]
    near = [(a, b, max(len(texts[a]), len(texts[b]))) for a in range(len(texts)) for b in range(a) if set(texts[a]) & set(texts[b]) and edit_distance(texts[a], texts[b]) <= int(0.2 * max(len(texts[a]), len(texts[b])) + 1e-9)]
    short, long = ([bool(own[a] & own[b]) for a, b, n in near if (n < 24) == s] for s in (True, False))
    assert len(short) > 200 and all(short)
    assert len(long) > 150 and sum(long) >= 0.9 * len(long)


def edited(rng, base, edits, kind):
    """base with so many words replaced at random places or evenly, deleted, or inserted."""
    n, new = len(base), lambda: f"z{rng.randint(0, 30000)}"
    if kind == "inserted":
        out = list(base)
        for _ in range(edits):
            out.insert(rng.randint(0, len(out)), new())
        return out
    at = {int((i + 0.5) * n / edits) for i in range(edits)} if kind == "even" else set(rng.sample(range(n), edits))
    return [x for i, x in enumerate(base) if i not in at] if kind == "deleted" else [new() if i in at else x for i, x in enumerate(base)]


@pytest.mark.parametrize("kind", ["random", "even", "deleted", "inserted"])
@pytest.mark.parametrize("similarity", [0.8, 0.82, 0.85])
def test_recall_of_sketches(similarity, kind):
    """Of pairs with as many edits as the threshold lets, nine of ten share a sketch, for each kind and at any length."""
    from lipiflow.llm.near_dedup import text_sketches

    rng, pairs = random.Random(int(similarity * 100)), 200
    for n in (12, 20, 22, 24, 25, 30, 40, 60, 120, 200, 250, 260, 320, 600):
        texts = []
        for _ in range(pairs):
            base = [f"w{rng.randint(0, 30000)}" for _ in range(n)]
            # the longer text counts: that of the insertions
            edits = int((1 - similarity) * n / similarity + 1e-9) if kind == "inserted" else int((1 - similarity) * n + 1e-9)
            texts += [" ".join(base), " ".join(edited(rng, base, edits, kind))]
        offsets, found, _ = text_sketches(Words(pa.array(texts)))
        own = [set(found[a:b].tolist()) for a, b in zip(offsets, offsets[1:])]
        assert np.mean([bool(own[i] & own[i + 1]) for i in range(0, len(texts), 2)]) >= 0.9, n


def test_near_dedup_equals_all_pairs(spark):
    """Classes against the components of all similar pairs, where no pair is close to the threshold."""
    from lipiflow.llm.near_dedup import near_dedup

    rng, texts = random.Random(21), []
    for g in range(25):
        n = rng.choice([6, 18, 19, 22, 90, 240, 256, 300])
        base = [f"v{rng.randint(0, 4000)}" for _ in range(n)]
        for _ in range(rng.choice([1, 2, 4])):
            copy = list(base)
            for _ in range(n // 12):
                copy[rng.randrange(len(copy))] = f"e{rng.randint(0, 4000)}"
            texts.append(" ".join(copy + ["tail"] * rng.randint(0, n // 20)))
    label = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            x, y = texts[a].split(), texts[b].split()
            if set(x) & set(y) and edit_distance(x, y) <= int(0.2 * max(len(x), len(y)) + 1e-9):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if c == old else c for c in label]
    rows = near_dedup(frame(spark, texts)).collect()
    assert {r.doc_id: r.class_id for r in rows} == dict(enumerate(label))


def test_near_dedup_of_repeated_ids(spark):
    from lipiflow.llm.near_dedup import near_dedup

    one, two = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = near_dedup(frame(spark, [one, two, one + " x", two + " y", two], [1, 1, 5, 6, 1])).collect()
    assert sorted((r.doc_id, r.class_id, r.kept) for r in rows) == [(1, 1, False), (1, 1, True), (1, 1, True), (5, 1, False), (6, 1, False)]


def test_a_very_long_text_and_its_copy(spark):
    from lipiflow.llm.near_dedup import near_dedup

    rng = random.Random(6)
    base = [f"w{rng.randint(0, 9000)}" for _ in range(150_000)]
    copy = [x if i % 50 else "z" for i, x in enumerate(base)]
    rows = near_dedup(frame(spark, [" ".join(base), " ".join(copy), "q" * 2_000_000])).collect()
    assert sorted((r.doc_id, r.class_id) for r in rows) == [(0, 0), (1, 0), (2, 2)]


@pytest.mark.parametrize("block", [4, 1024])
def test_remaining_links_are_brute_force(spark, monkeypatch, block):
    from lipiflow.llm import near_dedup as nd

    monkeypatch.setattr(nd, "BLOCK", block)
    rng = random.Random(5)
    bases = [[rng.choice("abcdef") for _ in range(rng.randint(8, 14))] for _ in range(12)]
    texts = [" ".join(rng.choice("abcdef") if rng.random() < 0.15 else x for x in bases[i % 12]) for i in range(60)]
    w = nd.Words(pa.array(texts))
    shapes, sizes = nd.word_shapes(w), np.diff(w.first)
    nodes = spark.createDataFrame([(i, shapes[i].tobytes(), bytes(nd.text_sketches(w)[2][i])) for i in range(60)], "node long, shape binary, places binary")
    keys = {k: [i for i in range(60) if rng.random() < 0.5] for k in range(3)}
    members = spark.createDataFrame([(i, int(sizes[i]), k, len(v)) for k, v in keys.items() for i in v], "node long, words long, key long, size long")
    label = {i: rng.randint(0, 1) * 30 for i in range(40)}
    labels = spark.createDataFrame(list(label.items()), "node long, label long")
    rows = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    got = sorted((r.a, r.b) for r in nd.remaining_links(members, labels, nodes, rows).collect())
    met = {(a, b) for v in keys.values() for a in v for b in v if a < b and label.get(a, a) != label.get(b, b)}
    near = {(a, b) for a, b in met if edit_distance(texts[a].split(), texts[b].split()) <= int(0.2 * max(sizes[a], sizes[b]) + 1e-9)}
    assert near and got == sorted(near)


def test_texts_without_another_class_of_their_length_are_not_met(spark, monkeypatch):
    from lipiflow.llm import near_dedup as nd

    met, as_before = {}, nd.stored
    monkeypatch.setattr(nd, "stored", lambda df, name, *more: met.setdefault(name, as_before(df, name, *more)))
    long, short = ["a"] * 100, ["a"] * 66  # of one level of length and the next, but too far apart
    texts = [" ".join(long + ["b"] * (i % 3)) for i in range(30)] + [" ".join(short), " ".join(short[1:] + ["c"])]
    w = nd.Words(pa.array(texts))
    shapes, places, sizes = nd.word_shapes(w), nd.text_sketches(w)[2], np.diff(w.first)
    nodes = spark.createDataFrame([(i, shapes[i].tobytes(), bytes(places[i] * 0)) for i in range(32)], "node long, shape binary, places binary")
    members = spark.createDataFrame([(i, int(sizes[i]), 7, 32) for i in range(32)], "node long, words long, key long, size long")
    labels = spark.createDataFrame([(i, 0) for i in range(30)], "node long, label long")
    links = nd.remaining_links(members, labels, nodes, spark.createDataFrame(list(enumerate(texts)), "node long, text string"))
    assert [(r.a, r.b) for r in links.collect()] == [(30, 31)]
    assert {r.node for r in met["omh-unlike"].select("node").collect()} == {30, 31}


def test_components_of_chains_and_stars(spark):
    from lipiflow.llm.near_dedup import components

    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(201, 260)] + [(rng.randint(300, 400), rng.randint(300, 400)) for _ in range(60)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = {x: find(x) for x in parent if find(x) != x}
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {n: got.get(n, n) for n in parent} == {n: find(n) for n in parent} and set(want) <= set(got)


CLASHING = ["n_words", "n_removed", "kept_text", "_kept_id", "kept", "hash", "row", "class_id", "group_key", "text_hash", "label", "a b", "ranges"]


def test_pipeline_stages_with_odd_rows_and_clashing_columns(spark, sf_dir):
    import corpus_pipeline as p

    good = " ".join(f"word{i}" for i in range(60))
    other = " ".join(f"other{i}" for i in range(60))
    rows = [(None, good), (None, "too short"), (7, good.upper()), (7, good), (7, good), (8, other), (8, other + " tail"), (9, None)]
    extra = ", ".join(f"`{c}` string" for c in CLASHING)
    docs = spark.createDataFrame([(i, t, *(f"{c}{n}" for c in CLASHING)) for n, (i, t) in enumerate(rows)], f"doc_id long, text string, {extra}")
    named = lambda df: sorted(((r[0], r[1], r["a b"]) for r in df.collect()), key=str)
    for name, stage in p.STAGES:
        out = stage(spark, docs, sf_dir)
        if name == "packing":
            assert out.where("start = 0").count() == len(rows)
            continue
        assert out.columns == docs.columns
        got = named(out)
        if name == "quality_rules":
            assert got == sorted(((i, t, f"a b{n}") for n, (i, t) in enumerate(rows) if t and len(t.split()) > 10), key=str)
        if name == "exact_dedup":
            assert sorted((str(i), (t or "").lower()) for i, t, _ in got) == sorted([("7", good), ("None", "too short"), ("8", other), ("8", other + " tail"), ("9", "")])
        if name == "near_dedup":
            assert sorted(str(i) for i, *_ in got) == sorted(["None", "None", "7", "7", "8", "9"])  # upper case is another text
        if name == "substring_dedup":
            assert [r[1] for r in got] and len(got) == len(rows) and all(len((r[1] or "").split()) in (0, 1, 2, 60) for r in got)


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    start, seen = {r.doc_id: r for r in docs.collect()}, docs
    kept = {r.doc_id for r in quality_rules(docs).collect() if r.kept}
    for name, stage in p.STAGES[:-1]:
        seen = stage(spark, seen, sf_dir)
        assert seen.columns == docs.columns and seen.schema.simpleString() == docs.schema.simpleString()
        rows = {r.doc_id: r for r in seen.collect()}
        if name == "quality_rules":
            assert set(rows) == kept
        if name == "exact_dedup":
            lower = lambda t: "".join(c.lower() if c < "\x80" else c for c in t)
            largest = {}
            for i in kept:
                largest[lower(start[i].text)] = max(i, largest.get(lower(start[i].text), -1))
            assert set(rows) == set(largest.values())
    words = brute_substrings([start[i].text for i in rows], 35)
    assert [rows[i].text for i in rows] == [w[2] for w in words]
    pieces = p.run(spark, sf_dir).collect()
    assert {r.doc_id for r in pieces} == set(rows)
