"""Lexicon, retrieval, studies, telemetry, sources, sinks and streams on small cases."""

import json
import math
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from lipiflow.functions.scores import TUNED_WEIGHTS
from lipiflow.operators import evaluate as E, lexicon as L, nextword as N, personal as P, retrieve as R, rules, scorer, stress, telemetry as T
from lipiflow.sources import readers, writers
from lipiflow.streaming import telemetry as S


def sets(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def test_best_surface_ties_go_to_the_first_seen(spark):
    t = spark.createDataFrame([(1, 0, "Ab", "ab"), (1, 1, "AB", "ab"), (2, 0, "AB", "ab"), (2, 1, "Ab", "ab"), (0, 9, "aB", "ab")], "doc_id int, pos int, surface string, word string")
    assert sets(L.best_surface(L.surface_counts(t))) == [("ab", "Ab")]


def test_pairs_break_at_unknown_words(spark):
    t = spark.createDataFrame([(1, i, w) for i, w in enumerate("a b x a b".split())] + [(2, 0, "b"), (2, 1, "a")], "sent int, pos int, word string")
    known = spark.createDataFrame([("a",), ("b",)], "word string")
    pairs = L.pair_counts(L.with_previous(t, known))
    assert sets(pairs, "prev", "word", "count") == [("<s>", "a", 1), ("<s>", "b", 1), ("a", "b", 2), ("b", "a", 1)]
    assert sets(L.followers(pairs), "prev", "word") == [("a", "b")]
    assert sets(L.pair_totals(pairs)) == [("<s>", 2), ("a", 2), ("b", 1)]


def test_prefix_join_is_starts_with(spark):
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 6))) for _ in range(60)})
    prefixes = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 5))) for _ in range(20)})
    got = R.prefix_join(spark.createDataFrame([(p,) for p in prefixes], "prefix string"), spark.createDataFrame([(w,) for w in words], "word string"))
    assert sets(got, "prefix", "word") == sorted((p, w) for p in prefixes for w in words if w.startswith(p))
    assert "NestedLoop" not in got._jdf.queryExecution().toString()


def test_prefix_top_is_brute_force(spark):
    rng = random.Random(2)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 5))): rng.randint(1, 9) for _ in range(40)}
    df = spark.createDataFrame([(w, w, s) for w, s in words.items()], "text string, word string, score int")
    got = sets(L.prefix_top(df, "text", "score", 3, 2), "prefix", "word", "rank")
    want = []
    for p in {w[:i] for w in words for i in (1, 2, 3) if len(w) >= i}:
        best = sorted((w for w in words if w.startswith(p)), key=lambda w: (-words[w], w))[:2]
        want += [(p, w, i + 1) for i, w in enumerate(best)]
    assert got == sorted(want)


def test_candidates_and_ranking(spark):
    words = spark.createDataFrame([("korchi", 100), ("korci", 5), ("kori", 50), ("amar", 70)], "word string, score int")
    romans = spark.createDataFrame([("korci", "korchi", 9, 1), ("korchilam", "kori", 4, 2)], "roman string, word string, count int, src int")
    queries = spark.createDataFrame([(1, "korci"), (2, "korc"), (3, "zzz")], "q int, roman string")
    c = R.candidates(queries, words, romans)
    rows = {(r.q, r.word): r for r in c.collect()}
    assert rows[1, "korchi"].rom_exact == 9 and rows[1, "korchi"].gap == 0 and rows[1, "korchi"].key_coarse and rows[1, "korci"].key_coarse
    assert rows[2, "korchi"].rom_prefix == 9 and rows[2, "korchi"].gap == 1
    top = {r.q: r.word for r in R.ranked(c, TUNED_WEIGHTS, 1).collect()}
    assert top[1] == "korchi"
    assert {r.q: r.strong for r in R.fast_ranked(c, TUNED_WEIGHTS, 1).collect()}[1]


def test_next_words_and_gates(spark):
    f = spark.createDataFrame([("a", "x", 5), ("a", "y", 3), ("b", "x", 1)], "prev string, word string, count int")
    t = spark.createDataFrame([("a", 10), ("b", 10)], "prev string, total int")
    assert sets(N.next_words(f, t, 1), "prev", "word") == [("a", "x")]
    assert sets(N.audit(f, t, 0.1)) == [("x", 20, 2)]
    p = spark.createDataFrame([("a", "z", 4)], "prev string, word string, n int")
    g = f.join(t, "prev").withColumn("share", F.col("count") / F.col("total"))
    assert sets(N.blended(g, p, 0.5, 1), "prev", "word") == [("a", "x"), ("b", "x")]
    assert sets(N.next_completions(spark.createDataFrame([("a", "x")], "prev string, roman string"), spark.createDataFrame([("a", "kam", 3), ("a", "tar", 1)], "prev string, word string, count int"), 2), "word", "share") == [("kam", 1.0)]


def test_weighted_evaluation(spark):
    ranks = spark.createDataFrame([(3, 1), (1, 3)], "weight int, rank int")
    r = E.word_eval(ranks).first()
    assert (r.top1, r.top3, r.n) == (75.0, 100.0, 2) and abs(r.mrr - (3 + 1 / 3) / 4) < 1e-6
    rows = spark.createDataFrame([("a", "x", 1, "s1", 1), ("a", "y", 2, "s2", 2), ("a", "x", 1, "s3", 3)], "roman string, gold string, weight int, source string, ord int")
    assert sets(E.grouped_wordset(rows)) == [("a", ["x", "y"], 4, "s1")]
    got = E.replay(spark.createDataFrame([(1, "abc", "w"), (2, "ab", "v")], "q int, roman string, gold string"), spark.createDataFrame([("a", "w", 3), ("ab", "w", 1)], "prefix string, word string, rank int"), 5).first()
    assert list(got) == [5, 1, 2, 1, 1]
    assert E.mean_least_cer(spark.createDataFrame([("ab", ["ab", "x"], 1), (None, ["abcd"], 1)], "word string, golds array<string>, weight int")).first().cer == 50.0


def test_ordinals_samples_and_ascent(spark):
    df = spark.range(1000).withColumn("v", F.xxhash64("id"))
    got = {r.v: r._ordinal for r in E.ordinals(df, "v").collect()}
    assert got == {v: i for i, v in enumerate(sorted(got))}
    assert E.stride_sample(df, 10, "id").count() == 10
    best, at = E.coordinate_ascent(lambda ws: [-((w["a"] - 2) ** 2) - (w["b"] + 1) ** 2 for w in ws], {"a": 0.0, "b": 0.0}, {"a": [0.0, 1.0, 2.0], "b": [-1.0, 0.0]})
    assert best == {"a": 2.0, "b": -1.0} and at == 0


def test_decay_equals_step_by_step(spark):
    rng, rate = random.Random(3), math.log(2) / (90 * 86400)
    times = sorted(rng.uniform(0, 4e7) for _ in range(50))
    count, last = 0.0, None
    for t in times:
        count, last = 1 + (count * math.exp(-rate * (t - last)) if last is not None else 0), t
    got = P.decayed_counts(spark.createDataFrame([(1, t) for t in times], "k int, t double"), ["k"], times[-1]).first()
    assert abs(got["count"] - count) < 1e-9


def test_shared_misses(spark):
    rows = [(1, "r", "c", "b", 1), (2, "r", "c", "a", 2), (1, "r", "c", "", 1), (3, "r", "d", "a", 1), (1, "r", "d", "a", 0)]
    e = spark.createDataFrame(rows, "install int, roman string, chose string, we_said string, pos int")
    assert sets(T.shared_misses(e)) == [("r", "c", 2, "a")]


def test_rules_engine():
    r = rules.Rules(
        {
            "patterns": [
                {"find": "k", "replace": "K"},
                {"find": "a", "replace": "A", "rules": [{"replace": "^A", "matches": [{"type": "prefix", "scope": "punctuation"}]}, {"replace": "A$", "matches": [{"type": "suffix", "scope": "exact", "value": "z"}]}]},
            ],
            "vowel": "a", "consonant": "kz", "punctuation": " ", "exceptions": {"OUT": "kk"},
        }
    )
    assert r.transliterate("ak ka") == "^AK KA"
    assert r.transliterate("kazx") == "KA$zx"
    assert r.transliterate("kaz") == "KAz"  # at the very end an exact suffix is not seen
    assert r.transliterate("KKa") == "OUT^A"
    assert r.transliterate("éa") == "é^A"  # neither vowel nor consonant


def scan(bundle, text):
    """The bundle applied by looking at every pattern of the list at every letter."""
    vowels, consonants = set(bundle["vowel"]), set(bundle["consonant"])
    kind = lambda i: "punctuation" if not 0 <= i < len(text) else "vowel" if text[i] in vowels else "consonant" if text[i] in consonants else "punctuation"

    def holds(m, a, b):
        wanted = m["scope"].lstrip("!")
        if wanted == "exact":
            start, end = (a - len(m["value"]), a) if m["type"] == "prefix" else (b, b + len(m["value"]))
            found = start >= 0 and end < len(text) and text[start:end] == m["value"]
        else:
            found = kind(a - 1 if m["type"] == "prefix" else b) == wanted
        return found != m["scope"].startswith("!")

    out, i = "", 0
    while i < len(text):
        plain = next((p for p in bundle["patterns"] if "rules" not in p and text.startswith(p["find"], i)), None)
        ruled = next((p for p in bundle["patterns"] if "rules" in p and text.startswith(p["find"], i)), None)
        p = plain if plain and plain.get("replace") is not None else ruled
        if ord(text[i]) >= 128 or not p:
            out, i = out + text[i], i + 1
            continue
        end = i + len(p["find"])
        rule = next((r for r in p.get("rules", []) if all(holds(m, i, end) for m in r["matches"])), None)
        out, i = out + ((rule or {}).get("replace") or p.get("replace") or ""), end
    return out


def test_rules_are_a_scan_of_the_list():
    rng = random.Random(12)
    word = lambda most: "".join(rng.choices("abck", k=rng.randint(1, most)))
    for _ in range(30):
        patterns = []
        for i in range(40):
            p = {"find": word(4)} | ({"replace": f"<{i}>"} if rng.random() < 0.8 else {})
            if rng.random() < 0.5:
                match = lambda: {"type": rng.choice(["prefix", "suffix"]), "scope": rng.choice(["", "!"]) + rng.choice(["vowel", "consonant", "punctuation", "exact"]), "value": word(2)}
                p["rules"] = [{"replace": f"[{i}{j}]", "matches": [match() for _ in range(rng.randint(0, 2))]} for j in range(rng.randint(0, 2))]
            patterns.append(p)
        bundle = {"patterns": patterns, "vowel": "a", "consonant": "bc"}
        r = rules.Rules(bundle)
        for _ in range(40):
            text = "".join(rng.choices("abckéx -", k=rng.randint(0, 14)))
            assert r.transliterate(text) == scan(bundle, text)


def test_exceptions_are_applied_one_after_another():
    r = rules.Rules({"patterns": [{"find": "a", "replace": "A"}], "exceptions": [["X", "aa"], ["Y", "aXb"], ["Z", "b"]]})
    assert r.transliterate("aaa b") == "XA Z" and r.transliterate("AAB") == "XZ" and r.transliterate("a") == "A"


def test_short_vectors_give_the_exact_best(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    vectors = [[float(x) for x in v] for v in rng.standard_normal((300, 24))] + [[0.0] * 24, [1e-3] * 24] + [[float(x) for x in rng.standard_normal(24)]] * 5
    items = spark.createDataFrame([*enumerate(vectors), (900, None), (901, [1.0, None]), (902, [1.0, 2.0])], "item long, v array<double>").repartition(4)
    asked = spark.createDataFrame([(i, vectors[i]) for i in range(0, 307, 20)] + [(99, None)], "q long, qv array<double>")
    got = {(r.q, r["rank"]): (r.item, r.score) for r in scorer.short_top_k(asked, items, 7).collect()}
    assert got == {(r.q, r["rank"]): (r.item, r.score) for r in scorer.dense_top_k(asked, items.where("item < 900"), 7).collect()} and len(got) == 7 * 16
    assert scorer.short_top_k(asked.limit(0), items, 3).collect() == []


def test_log_softmax(spark):
    rows = [("a", 1.0), ("a", 3.0), ("b", -5.0), ("b", -5.0), ("b", 700.0)]
    got = scorer.log_softmax(spark.createDataFrame(rows, "g string, score double"), ["g"])
    for g in "ab":
        s = [x for k, x in rows if k == g]
        total = max(s) + math.log(sum(math.exp(x - max(s)) for x in s))
        assert sorted(r.logp for r in got.where(F.col("g") == g).collect()) == pytest.approx(sorted(x - total for x in s))


def test_word_errors_of_many_words(spark):
    from lipiflow.functions import metrics as M

    rng = random.Random(7)

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, before = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        return row[-1]

    pairs = [([rng.choice("abcd") for _ in range(rng.randint(0, 90))], [rng.choice("abcd") for _ in range(rng.randint(0, 90))]) for _ in range(60)]
    many = [f"w{i}" for i in range(40_000)]  # more than one character can name
    df = spark.createDataFrame([*pairs, (many, many[:100] + many[101:] + ["new"]), (None, ["a"])], "h array<string>, r array<string>")
    got = [r.e for r in df.select(M.word_errors("h", "r").alias("e")).collect()]
    assert got == [plain(h, r) for h, r in pairs] + [2, None]
    one = spark.createDataFrame([(["ক", "a", "খ"],)], "w array<string>").select(M.bengali_words("w").alias("w")).first()
    assert one.w == ["ক", "খ"]


def test_many_roots(spark):
    from lipiflow.functions.text import is_blocked

    rng = random.Random(8)
    roots = ["".join(rng.choices("abcdefgh", k=rng.randint(3, 6))) for _ in range(10_000)]
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(0, 9))) for _ in range(400)] + [None, "exact"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", is_blocked("w", ["exact"], roots).alias("b")).collect()
    assert [r.b for r in got] == [None if w is None else w == "exact" or any(x in w for x in roots) for w in words]


def test_scorer_plug_in(spark):
    c = spark.createDataFrame([(1, "ab"), (1, "abc")], "q int, word string")
    got = scorer.score_with(c, lambda: lambda b: b["word"].str.len() * -1.0, ["word"])
    assert sets(got, "word", "xlit_logp") == [("ab", -2.0), ("abc", -3.0)]
    assert c.columns == ["q", "word"]


def test_readers(spark, tmp_path):
    p = lambda name, text: (tmp_path / name).write_text(text, encoding="utf-8") and str(tmp_path / name)
    assert sets(readers.attestations(spark, p("a.tsv", "আ\ta\t3\nআ\tb\tx\nshort\n"))) == [("আ", "a", 3.0, False), ("আ", "b", 1.0, True)]
    mined = readers.mined_pairs(spark, p("m.json", '{"native word":"আ","english word":"a","source":"s","score":null}\n{torn\n'))
    assert [(r.roman, r.bad) for r in mined.orderBy("bad").collect()] == [("a", False), (None, True)]
    assert sets(readers.word_counts(spark, p("w.txt", "a 3\nb x\nc 1 2\n d  4 \n"))) == [("a", 3), ("d", 4)]
    assert sets(readers.feedback(spark, p("f.jsonl", '# c\n{"roman":"a","gold":["x","y"]}\n{"roman":"b","gold":"z"}\n')), "roman", "gold") == [("a", "x"), ("a", "y"), ("b", "z")]
    assert sets(readers.json_lines(spark, p("j.jsonl", '{"a":1}\n\n{"a":'), "a int")) == [(1,)]
    assert readers.block_list("# c\n=ab\nroot # x\n") == (["ab"], ["root"])
    train = p("t.csv", 'id,text_bengali,text_transliterated,x\n1,ক,k,\n2,"খ\nগ",kh,\n3,ঘ,gh,\n')
    assert sets(readers.train_rows(spark, train, [p("h.csv", "id,text_bengali,text_transliterated\n9,ক,k\n3,চ,c\n")]), "id") == [("2",)]
    df = spark.createDataFrame([(["আমি", "x"], ["ami", "x"]), (["আ"], ["a", "b"])], "b array<string>, r array<string>")
    assert sets(readers.aligned_pairs(df, "b", "r")) == [("আমি", "ami", 0)]
    assert readers.overlaid({"a": 1, "b": 2}, {"b": None, "a": 3}) == {"a": 3, "b": 2}


def test_chunks_metrics_and_sinks(spark, tmp_path):
    os.makedirs(tmp_path / "in" / "abcd1234")
    (tmp_path / "in/abcd1234/metrics-00001.jsonl").write_text(json.dumps({"h": "2024-01-01T00", "id": "abcd1234", "words": 3, "pos_0": 2, "lat_p50": 1.5}) + "\n")
    (tmp_path / "in/abcd1234/events-00002.jsonl").write_text('{"roman":"a"}\n')
    m = readers.metrics(spark, str(tmp_path / "in")).first()
    assert (m.install, m.h, m.words, m.top1_taken, m.lat_p50, m.counters) == ("abcd1234", "2024-01-01T00", 3, 0, 1.5, {"pos_0": 2})
    assert sets(readers.chunks(spark, str(tmp_path / "in"), "events"), "install", "stream", "seq") == [("abcd1234", "events", 2)]
    out = str(tmp_path / "store")
    batch = spark.createDataFrame([("i", "events", 1, "x"), ("i", "events", 2, "y")], "install string, stream string, seq int, line string")
    writers.sorted_table(batch, out, "seq")
    assert spark.read.parquet(out).count() == 2
    assert writers.purge(spark, out) and not writers.purge(spark, out)
    with pytest.raises(ValueError):
        writers.save_weights({"a": 1.0}, str(tmp_path / "w.json"), 10)
    writers.sorted_table(spark.createDataFrame([(3,), (1,)], "k int"), str(tmp_path / "t"), "k", partitions=1)
    assert [r.k for r in spark.read.parquet(str(tmp_path / "t")).collect()] == [1, 3]


def test_stress_variants(spark):
    got = dict(sets(stress.variants(spark.createDataFrame([("bhalochhi",)], "word string")), "style", "roman"))
    assert got == {"as_is": "bhalochhi", "c_for_ch": "bhaloci", "s_for_sh": "bhalochhi", "v_for_bh": "valochhi", "no_h": "balochi"}


def test_sentences_are_transliterated_with_what_was_chosen_before(spark):
    import itertools
    import math

    from lipiflow.functions.scores import BACKOFF, TUNED_WEIGHTS as W
    from lipiflow.operators import retrieve as R

    lexicon = {"ab": [("a1", -3.0), ("a2", -3.1), ("a3", -9.0)], "bc": [("b1", -2.0), ("b2", -2.0)], "cd": [("c1", -5.0), ("b1", -5.5)]}
    pairs = {("a1", "b2"): 30, ("a1", "a2"): 5, ("b2", "c1"): 1, ("b2", "b1"): 60, ("b1", "a3"): 90, ("c1", "a2"): 8, ("a2", "a1"): 3, ("a3", "b1"): 1}
    totals = {}
    for (p, _), n in pairs.items():
        totals[p] = totals.get(p, 0) + n + 1
    texts = [list(t) for n in (1, 2, 3, 4) for t in itertools.product(["ab", "bc", "cd", "zz", "12"], repeat=n)]

    def plain(core, prev):
        def score(c):
            context = 0.0 if prev not in totals else math.log(pairs[prev, c[0]] / totals[prev]) - c[1] if (prev, c[0]) in pairs else BACKOFF
            return round(W["unigram"] * c[1] - 15 * W["xlit_logp"], 6) + round(W["bigram"] * context, 6)

        return min(((-round(score(c), 6), c[0]) for c in lexicon[core]), default=(0, core))[1] if core in lexicon else core

    expected = {}
    for i, t in enumerate(texts):
        out, prev = [], None
        for core in t:
            out.append(core if core == "12" else plain(core, prev))
            prev = prev if core == "12" else out[-1]
        expected[i] = out
    tokens = spark.createDataFrame([(i, p, c, None if c == "12" else c) for i, t in enumerate(texts) for p, c in enumerate(t)], "sent int, pos int, core string, roman string")
    candidates = spark.createDataFrame([(r, w, u) for r, ws in lexicon.items() for w, u in ws], "q string, word string, uni double")
    pair_rows = spark.createDataFrame([(*k, n) for k, n in pairs.items()], "prev string, word string, count int")
    got = R.transliterated_sentences(tokens, candidates, W, pair_rows, spark.createDataFrame(list(totals.items()), "prev string, total int"))
    assert {r.sent: r.words for r in got.collect()} == expected
    assert any(out != [plain(c, None) if c != "12" else c for c in t] for out, t in zip(expected.values(), texts))


def test_deliveries_of_json_objects_alone_are_accepted(spark):
    from lipiflow.sources.writers import BODY_BYTES, acceptable

    bodies = ['{"a": 1}\n{"b": [2]}\n', "\n\n", "", None, '{"a": 1}\n[1]', '{"a": 1', '{"a": 1}\nnull', '{"a": "' + "x" * BODY_BYTES + '"}', '\n {"a": {}} ']
    df = spark.createDataFrame(list(enumerate(bodies)), "id int, body string")
    assert sorted(r.id for r in acceptable(df).collect()) == [0, 8]


def test_bundles_and_chunks_are_read_from_files(spark, tmp_path):
    from lipiflow.sources import readers

    (tmp_path / "bundle.json").write_text('{"patterns": [\n{"find": "k", "replace": "ক"}]}', encoding="utf-8")
    assert readers.rule_bundle(spark, str(tmp_path / "bundle.json")) == {"patterns": [{"find": "k", "replace": "ক"}]}
    for install, seq in (("b", 2), ("a", 10), ("a", 9)):
        (tmp_path / "store" / install).mkdir(parents=True, exist_ok=True)
        (tmp_path / "store" / install / f"events-{seq}.jsonl").write_text('{"x": 1}\n')
    assert [(r.install, r.seq) for r in readers.chunks(spark, str(tmp_path / "store"), "events", ordered=True).collect()] == [("a", 10), ("a", 9), ("b", 2)]


def test_sentences_make_their_candidates_once(spark):
    """Candidates are many for each spelling: they are scored once, and what a pair cannot change is not told to spellings."""
    made = spark.sparkContext.accumulator(0)

    def count(rows):
        for part in rows:
            made.add(len(part))
            yield part

    one = [(r, w, u, 0, 0, 0, k) for r, w, u, k in (("a", "x", -1.0, True), ("a", "y", -2.0, True), ("b", "v", -1.0, True), ("b", "w", -3.0, True))]
    schema = "q string, word string, uni double, rom_exact long, rom_prefix long, gap long, key_fine boolean"
    c = spark.createDataFrame(one, schema).mapInPandas(count, schema)
    tokens = spark.createDataFrame([(1, 0, "a", "a"), (1, 1, "b", "b"), (2, 0, "b", "b")], "sent long, pos int, core string, roman string")
    pairs = spark.createDataFrame([("x", "w", 9), ("x", "q", 1)], "prev string, word string, count long")
    got = R.transliterated_sentences(tokens, c, TUNED_WEIGHTS, pairs, spark.createDataFrame([("x", 10)], "prev string, total long"))
    assert {r.sent: r.words for r in got.collect()} == {1: ["x", "w"], 2: ["v"]} and made.value == len(one)


def test_totals_meet_queries_not_candidates(spark):
    """Two words before may serve all queries: candidates are never dealt by the word before alone, nor sent through the driver."""
    c = spark.createDataFrame([("q", "w", -2.0)], "q string, word string, uni double")
    pairs, totals = spark.createDataFrame([("p", "w", 3)], "prev string, word string, count long"), spark.createDataFrame([("p", 4)], "prev string, total long")
    found = R.with_context(c, spark.createDataFrame([("q", "p")], "q string, prev string"), pairs, totals)
    assert abs(found.first()["context"] - (math.log(0.75) + 2.0)) < 1e-9
    joins = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join LeftOuter" in x]
    assert len(joins) == 3 and "(q#" in joins[1]
    words = spark.createDataFrame([("w", 1)], "word string, score long")
    assert "rightHint=(strategy=merge)" in R.with_prior(c.drop("uni"), words)._jdf.queryExecution().optimizedPlan().toString()


def test_choices_are_those_of_all_candidates(spark):
    """Against brute force, with pairs that put the first choice of a spelling far below words that never followed."""
    rng = random.Random(11)
    names = [f"w{i:02}" for i in range(12)]
    uni = {w: rng.choice([-1.0, -2.0, -6.0]) for w in names}
    candidates = {(r, w): rng.choice([0, 3]) for r in "abcdef" for w in rng.sample(names, rng.randint(1, 8))}
    told = {(p, w): rng.choice([1, 1, 40]) for p in ("p", "q", "s") for w in rng.sample(names, 7)}
    total = {"p": 60, "q": 2000, "s": 100_000}
    c = spark.createDataFrame([(r, w, uni[w], x) for (r, w), x in candidates.items()], "q string, word string, uni double, rom_exact int")
    firsts, chosen = R.choices(c, TUNED_WEIGHTS, spark.createDataFrame([(p, w, n, total[p]) for (p, w), n in told.items()], "prev string, word string, count long, total long"))
    scored = {(x.q, x.word): x.score for x in R.ranked(c, TUNED_WEIGHTS, 100).collect()}

    def best(r, p=None):
        add = lambda w: 0 if p is None else TUNED_WEIGHTS["bigram"] * (math.log(told[p, w] / total[p]) - uni[w] if (p, w) in told else math.log(0.4))
        return min((-round(s + round(add(w), 6), 6), w) for (q, w), s in scored.items() if q == r)[1]

    first = {r: best(r) for r in "abcdef"}
    assert {x.roman: x["first"] for x in firsts.collect()} == first
    want = {(p, r, best(r, p)) for p in total for r in "abcdef"}
    assert {tuple(x) for x in chosen.collect()} == {x for x in want if x[2] != first[x[1]]} and len({x[2] for x in want}) > 3
    low = [(p, r) for p, r, w in want if (p, first[r]) in told and math.log(told[p, first[r]] / total[p]) - uni[first[r]] < math.log(0.4) and w != first[r]]
    assert any((p, best(r, p)) not in told for p, r in low)


def test_stored_tables_leave_no_shuffle_files(spark):
    """What a job of a stored table exchanged is off the disk when the table is written, and the session's setting as it was."""
    from lipiflow.sources import store

    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    found = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(files.getAllFiles()) if f.getName().startswith("shuffle_")}
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, was = found(), spark.conf.get(setting)
    store.stored(spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    end = time.time() + 20  # files are removed in the background
    while found() - before and time.time() < end:
        time.sleep(0.1)
    assert not found() - before and spark.conf.get(setting) == was


def test_sentences_in_parts_are_the_same(spark, sf_dir, monkeypatch):
    """Spellings and turns are worked on so many at a time; results do not depend on how many."""
    from lipiflow.plans import evaluation

    whole = sets(evaluation.sentence_transliteration(spark, sf_dir))
    monkeypatch.setattr(evaluation, "SPELLINGS", 1500)
    monkeypatch.setattr(evaluation, "CHARACTERS", 20_000)
    assert sets(evaluation.sentence_transliteration(spark, sf_dir)) == whole
