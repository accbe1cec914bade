"""Lists with predicted words, words within typed letters and beam search against brute force."""

import itertools
import math
import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lipiflow.operators import beam as B, evaluate as E, liststudy as S, within as W
from lipiflow.sources.store import built_once, shared_dir


def brute_merge(base, predicted, start, n, k=5):
    out = list(base[:start])
    extra = [w for w in predicted if w not in out][:n]
    return (out + extra + [w for w in base[start:] if w not in extra])[:k]


def study_rows(rng):
    words = ["".join(rng.choices("ab", k=rng.randint(1, 5))) for _ in range(30)]
    tested = [(f"p{rng.randint(0, 3)}", w, w, rng.randint(1, 4)) for w in set(words)]
    typed = {w[:i] for w in words for i in range(1, 6)}
    base = {t: rng.sample(words, rng.randint(0, 5)) for t in typed if rng.random() < 0.8}
    base = {t: list(dict.fromkeys(b)) for t, b in base.items()}
    more = {(f"p{p}", t): list(dict.fromkeys(rng.sample(words, rng.randint(0, 3)))) for p in range(4) for t in typed if rng.random() < 0.7}
    return tested, base, more


@pytest.mark.parametrize("seed", [1, 2])
def test_rules_are_brute_force(spark, seed):
    tested, base, more = study_rows(random.Random(seed))
    frames = [spark.createDataFrame(*x) for x in ((tested, "prev string, roman string, word string, n long"), (list(base.items()), "typed string, list array<string>"), ([(p, t, x) for (p, t), x in more.items()], "prev string, typed string, list array<string>"))]
    placed = S.typed_places(*frames, max_letters=3)
    got = {(r.start, r.put_in, r.letters): tuple(r)[3:] for r in S.by_letters(placed).collect()}
    keys = {(r.start, r.put_in): (r.words, r.plain, r.needed) for r in S.keystrokes(placed).collect()}
    want, needed = {}, {}
    for start, n in S.RULES:
        words = plain = need = 0
        for prev, roman, word, times in tested:
            if len(roman) < 2:
                continue
            seen = None
            for letters in range(1, min(3, len(roman)) + 1):
                b, m = base.get(roman[:letters], []), more.get((prev, roman[:letters]), [])[:2]
                shown = brute_merge(b, m, start, n)
                row = want.setdefault((start, n, letters), [0] * 10)
                at, own = (x.index(word) + 1 if word in x else 0 for x in (shown, b))
                for i, x in enumerate([True, bool(m), word in m, *(at == j for j in (1, 2, 3, 4, 5, 0)), letters == len(roman) and own > 0 and (at == 0 or at > own)]):
                    row[i] += times * x
                if seen is None and at and letters < len(roman):
                    seen = letters + 1 if at == 1 else min(letters + 2, len(roman) + 1)
            words, plain, need = words + times, plain + times * (len(roman) + 1), need + times * (seen or len(roman) + 1)
        needed[start, n] = (words, plain, need)
    assert got == {k: tuple(v) for k, v in want.items()} and keys == needed


def test_no_words_to_study(spark):
    empty = [spark.createDataFrame([], s) for s in ("prev string, roman string, word string, n long", "typed string, list array<string>", "prev string, typed string, list array<string>")]
    placed = S.typed_places(*empty, max_letters=3)
    assert S.by_letters(placed).collect() == [] and S.keystrokes(placed).collect() == []


def test_shares_within_typed_letters(spark):
    """Against brute force over all words; the shares of a range sum to one."""
    rng = random.Random(4)
    keys = ["", "a", "ab", "aba", "abb", "b", "ba", "bab", "c", "ক", "কখ"]
    words = [(f"w{i:03}", rng.choice(keys), rng.randint(0, 9)) for i in range(120)]
    counts = {(p, w[0]): rng.randint(1, 9) for p in ("x", "y") for w in rng.sample(words, 15)} | {("x", "never"): 5}
    totals = {p: sum(c for (q, _), c in counts.items() if q == p) for p in ("x", "y")}
    hidden = {"w003", "w050"}
    asked = [(p, t) for p in ("x", "y", "new") for t in ("", "a", "ab", "aba", "b", "bab", "ক", "zz")]
    offered = W.offered_words(spark.createDataFrame(words, "word string, key string, score long"), ~F.col("word").isin(*hidden))
    pairs = spark.createDataFrame([(p, w, c) for (p, w), c in counts.items()], "prev string, word string, count long")
    found = W.best_within(spark.createDataFrame(asked, "prev string, typed string"), pairs, spark.createDataFrame(list(totals.items()), "prev string, total long"), offered, 200, general=0.25)
    got = {}
    for r in found.collect():
        got.setdefault((r.prev, r.typed), []).append((r["rank"], r.word, r.share))
    everything = sum(s for w, _, s in words if w not in hidden)
    for p, t in asked:
        fits = [(w, s) for w, k, s in words if k.startswith(t) and s and w not in hidden]
        own = {w: s / everything if p not in totals else 0.25 * s / everything + 0.75 * counts.get((p, w), 0) / totals[p] for w, s in fits}
        mass = sum(own.values())
        want = sorted(own.items(), key=lambda x: (-round(x[1], 12), x[0]))
        mine = sorted(got.get((p, t), []))
        assert [w for _, w, _ in mine] == [w for w, _ in want]
        assert all(abs(s - x / mass) < 1e-9 for (_, _, s), (_, x) in zip(mine, want))
        assert not mine or abs(sum(s for *_, s in mine) - 1) < 1e-9


def plain_beam(model, text, beam, best, most):
    """One search, symbol by symbol, without arrays of many inputs."""
    live, done = [(0.0, (), model.start([text]), B.END)], []
    for step in range(most):
        found = []
        for h, (score, out, state, last) in enumerate(live):
            logp, after = model.step(state, np.array([last]))
            found += [(-(score + p), h, t, out, after) for t, p in enumerate(logp[0]) if not (step == 0 and t == B.END)]
        found = sorted(found, key=lambda x: x[:3])[: 2 * beam]
        new = []
        for j, (cost, _, t, out, after) in enumerate(found):
            if t == B.END:
                if j < beam:
                    done.append((-cost / (step + 1), out))
            elif len(new) < beam:
                new.append((-cost, (*out, t), after, t))
        if len(done) >= beam or not new:
            break
        live = new
    done = done or [(s / most, out) for s, out, *_ in live]
    names = {}
    for s, out in sorted(done, key=lambda x: -x[0]):
        names.setdefault("".join(model.symbols[i] for i in out), s)
    return [(w, s) for w, s in names.items() if w][:best]


def a_model():
    rng = random.Random(9)
    pairs = lambda: {(rng.choice(["", "a", "b", "c"]), rng.choice(["", "a", "b", "c"])): rng.randint(1, 30) for _ in range(9)}
    return B.LetterModel(pairs() | {("", "a"): 3, ("c", ""): 4}, pairs() | {("b", "c"): 5})


def test_beam_search_in_batches_is_the_search_of_each():
    model, texts = a_model(), ["", "a", "ab", "cab", "zz", "abcabc", "b"]
    for beam in (1, 2, 4):
        got = B.beam_search(model, texts, beam, 3)
        for t, found in zip(texts, got):
            want = plain_beam(model, t, beam, 3, 3 * len(t) + 5) if t else []
            assert [w for w, _ in found] == [w for w, _ in want] and np.allclose([s for _, s in found], [s for _, s in want])


def test_a_wide_beam_is_full_enumeration():
    model, text, most = a_model(), "ab", 4
    scores = {}
    for n in range(1, most):
        for out in itertools.product(range(1, len(model.symbols)), repeat=n):
            state, last, total = model.start([text]), B.END, 0.0
            for s in (*out, B.END):
                logp, state = model.step(state, np.array([last]))
                total, last = total + logp[0, s], s
            scores["".join(model.symbols[s] for s in out)] = total / (n + 1)
    found = B.beam_search(model, [text], 10_000, 10_000, [most])[0]
    assert {w: pytest.approx(s) for w, s in found} == scores
    assert [w for w, _ in found][0] == max(scores, key=scores.get)
    assert all(abs(np.exp(model.table).sum(axis=2) - 1).ravel() < 1e-9)


def test_letter_model_of_a_table(spark):
    df = spark.createDataFrame([("ka", "kha", 3), ("ka", "ka", 1), (None, "x", 1), ("q", "", 9)], "roman string, word string, count long")
    rows = {(r.kind, r.a, r.b): r["count"] for r in B.letter_pairs(df).collect()}
    assert rows["before", "", "k"] == 4 and rows["before", "k", "h"] == 3 and rows["typed", "a", "h"] == 3 and rows["typed", "", ""] == 5 and rows["before", "a", ""] == 4
    model = B.letter_model(df)
    got = B.decoded(spark.createDataFrame([("ka",), (None,), ("",), ("ka",)], "roman string"), lambda: model, 4, 2).collect()
    assert {r.roman for r in got} == {"ka"} and len(got) == 4 and {r["rank"] for r in got} == {1, 2}


def test_running_sums_and_percentiles_of_a_hot_group(spark):
    rng = random.Random(2)
    rows = [("hot", rng.random()) for _ in range(3000)] + [("cold", float(i % 3)) for i in range(7)] + [(None, 1.5), ("cold", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.g: (r.low, r.high) for r in E.percentiles(df, "g", "v", {"low": lambda n: F.floor(n * 0.5), "high": lambda n: n - 1}).collect()}
    for g in ("hot", "cold", None):
        v = sorted(x for k, x in rows if k == g and x is not None)
        assert got[g] == (v[math.floor(len(v) * 0.5)], v[-1])
    sums = sorted((r.v, r._sum) for r in E.running_sums(spark.range(50).selectExpr("id % 7 AS v"), ["v"], "v").collect())
    assert [s for _, s in sums] == [sum(v for v, _ in sums[:i]) for i in range(50)]


def test_tables_are_built_again_when_a_table_changes(spark, tmp_path):
    def words():
        return sorted(r.w for r in built_once(spark, str(tmp_path), "w", lambda: spark.read.parquet(f"{tmp_path}/t.parquet")).collect())

    spark.createDataFrame([("alpha",)], "w string").write.parquet(f"{tmp_path}/t.parquet")
    assert words() == words() == ["alpha"]
    time.sleep(0.01)
    spark.createDataFrame([("gamma",)], "w string").write.mode("overwrite").parquet(f"{tmp_path}/t.parquet")
    assert words() == ["gamma"]
    assert os.path.isdir(shared_dir(spark))


def test_the_feature_cache_is_written_and_read_back(spark, tmp_path):
    from lipiflow.sources import readers, writers

    fields = "q long, word string, uni double, rom_exact int, rom_prefix int, key_fine boolean, key_coarse boolean, key_fine_prefix boolean, key_coarse_prefix boolean, gap int, xlit_rank int, xlit_logp double, avro boolean, in_lexicon boolean, bigram double, spelled boolean"
    rows = [(1, w, -3.5, 2, 0, True, False, False, None, 1, None, None, False, True, 0.25, False) for w in ("b", "a")]
    candidates = spark.createDataFrame(rows, fields)
    items = spark.createDataFrame([(1, "s", "ka", ["a", "x"], 2.0), (2, "s", "none", ["y"], 1.0)], "q long, set string, roman string, golds array<string>, weight double")
    writers.save_features(candidates, items, str(tmp_path / "cache"))
    got = readers.features(spark, str(tmp_path / "cache"))
    assert sorted(tuple(r) for r in got.drop("q", "golds").collect()) == sorted(("s", "ka", 2.0, *r[1:]) for r in rows)
    assert spark.read.json(str(tmp_path / "cache")).count() == 2 and got.select("q").distinct().count() == 1
    scored = E.weight_hits(got.withColumn("gold", F.get("golds", F.lit(0))), [{"unigram": 1.0, **dict.fromkeys(W_NAMES, 0.0)}]).first()
    assert (scored.hits, scored.n) == (1, 1)


W_NAMES = [n for n in __import__("lipiflow.functions.scores", fromlist=["TUNED_WEIGHTS"]).TUNED_WEIGHTS if n != "unigram"]


def test_lines_are_spaced_json(spark):
    import json

    from lipiflow.sources.writers import spaced_json

    df = spark.createDataFrame([("a\"b", 1, 1.5, True, ["x", "y"]), (None, None, None, None, None)], "s string, n int, d double, `o.k` boolean, l array<string>")
    one, two = (r[0] for r in df.select(spaced_json(df)).collect())
    assert one == '{"s": "a\\"b", "n": 1, "d": 1.5, "o.k": true, "l": ["x","y"]}' and two == "{}" and json.loads(one)["l"] == ["x", "y"]


def test_typed_letters_are_looked_up_not_held_against_all_followers(spark):
    """Rows that typed letters meet are those of the answer, though all words follow one word; places need no lists."""
    from lipiflow.operators import nextword as N

    words = [f"{a}a{b}a" for a in "kgtdpb" for b in "nmrls"]
    followers = spark.createDataFrame([("<s>", w, i + 1) for i, w in enumerate(words)], "prev string, word string, count long")
    typed = spark.createDataFrame([("<s>", w[:i]) for w in words for i in (1, 2, 3)], "prev string, roman string").distinct()
    found = N.next_completions(typed, followers, 2)
    conditions = found._jdf.queryExecution().optimizedPlan().toString()
    assert "StartsWith" not in conditions
    from lipiflow.functions.keys import key_from_roman

    keys = {r.w: r.k for r in spark.createDataFrame([(x,) for x in {*words, *(w[:i] for w in words for i in (1, 2, 3))}], "w string").select("w", key_from_roman("w").alias("k")).collect()}
    want = set()
    for t in {w[:i] for w in words for i in (1, 2, 3)}:
        fit = sorted((-(i + 1), w) for i, w in enumerate(words) if keys[w].startswith(keys[t]))
        total = sum(-n for n, _ in fit)
        want |= {("<s>", t, w, round(-n / total, 9), p) for p, (n, w) in enumerate(fit[:2], 1)}
    assert {(r.prev, r.roman, r.word, round(r.share, 9), r.place) for r in found.collect()} == want


@pytest.mark.parametrize("seed", [3, 4])
def test_keystrokes_count_all_letters(spark, seed):
    """Without a number of letters, a word may be picked at each of its own but the last, as in brute force over whole words."""
    tested, base, more = study_rows(random.Random(seed))
    tested += [("p0", "abababab", "abababab", 7)]
    base |= {"abababab"[:i]: [] for i in range(1, 9)} | {"ababab": ["b", "abababab"]}
    frames = [spark.createDataFrame(*x) for x in ((tested, "prev string, roman string, word string, n long"), (list(base.items()), "typed string, list array<string>"), ([(p, t, x) for (p, t), x in more.items()], "prev string, typed string, list array<string>"))]
    placed = S.typed_places(*frames, max_letters=None)
    got = {(r.start, r.put_in): r.needed for r in S.keystrokes(placed).collect()}
    want = dict.fromkeys(S.RULES, 0)
    for (start, n), (prev, roman, word, times) in itertools.product(S.RULES, tested):
        if len(roman) >= 2:
            shown = [brute_merge(base.get(roman[:i], []), more.get((prev, roman[:i]), [])[:2], start, n) for i in range(1, len(roman))]
            seen = next((i + 1 if x[0] == word else min(i + 2, len(roman) + 1) for i, x in enumerate(shown, 1) if word in x), len(roman) + 1)
            want[start, n] += times * seen
    assert got == want


def test_words_are_looked_for_beyond_their_fourth_letter(spark, sf_dir):
    from lipiflow.plans import study

    needed = lambda most: {(r.start, r.put_in): (r.words, r.plain, r.needed) for r in S.keystrokes(study._placed(spark, sf_dir, most)).collect()}
    whole, four = {(r.start, r.put_in): (r.words, r.plain, r.needed) for r in study.merge_rule_keystrokes(spark, sf_dir).collect()}, needed(study.LETTERS)
    assert whole == needed(None) and all(whole[k][:2] == four[k][:2] and whole[k][2] < four[k][2] for k in four)


def test_parts_hold_every_row_once(spark):
    from lipiflow.sources.store import in_parts

    parts = in_parts(spark.range(1000).withColumn("k", F.col("id") % 300), "k", 150)
    found = [{r.k for r in p.collect()} for p in parts]
    assert sum(p.count() for p in parts) == 1000 and len(parts) == 7 and sum(map(len, found)) == 300 == len(set().union(*found))
    assert [p.count() for p in in_parts(spark.range(0), "id", 5)] == [0]


def test_ascent_goes_on_while_a_round_changes_anything():
    """A stair that is climbed by one step of each weight in a round: nine rounds, none of whose weights is scored twice."""
    asked = []

    def scores(settings):
        asked.extend((w["a"], w["b"]) for w in settings)
        return [w["a"] + w["b"] if 0 <= w["a"] - w["b"] <= 1 else -1.0 for w in settings]

    steps = [float(i) for i in range(10)]
    assert E.coordinate_ascent(scores, {"a": 0.0, "b": 0.0}, {"a": steps, "b": steps}) == ({"a": 9.0, "b": 9.0}, 18.0)
    assert len(asked) == len(set(asked))


def test_weights_are_tuned_to_the_end(spark, sf_dir, monkeypatch):
    """No value of any searched weight is better than the one found, judged by all candidates and their ranking, and every one was tried."""
    from lipiflow.functions.scores import SEARCHED, TUNED_WEIGHTS
    from lipiflow.operators import retrieve as R
    from lipiflow.plans import evaluation
    from lipiflow.plans.standins import queries

    tried, plain = [], E.weight_hits
    monkeypatch.setattr(E, "weight_hits", lambda c, settings: tried.extend(settings) or plain(c, settings))
    got = evaluation.tuned_weights(spark, sf_dir).collect()
    best, share = {r["name"]: r.weight for r in got}, got[0].share
    assert best.keys() == TUNED_WEIGHTS.keys() and len(SEARCHED) == 14
    assert all(any(w[n] == v for w in tried) for n, values in SEARCHED.items() for v in values)
    c = evaluation._candidates(spark, sf_dir).join(queries(spark, sf_dir).select("q", "gold"), "q")
    near = [best] + [best | {n: v} for n, values in SEARCHED.items() for v in values]
    hits = {r.setting: (r.hits, r.n) for r in plain(c, near).collect()}
    assert round(hits[0][0] / hits[0][1], 6) == share and all(h <= hits[0][0] for h, _ in hits.values())
    assert {r.setting: (r.hits, r.n) for r in plain(E.leading(c.drop("lex_score")), near).collect()} == hits
    for i in (0, 3, 40):
        assert R.ranked(c, near[i], 1).where("word = gold").count() == hits[i][0]


def test_equal_scores_go_to_the_lesser_word(spark):
    rows = [(1, "m", "m", -1.0), (1, "m", "a", -1.0), (2, "m", "m", -1.0), (2, "m", "z", -1.0), (3, "m", "m", -1.0), (3, "m", "z", -0.5), (4, "m", "z", -1.0), (5, "m", "m", -9.0)]
    c = spark.createDataFrame(rows, "q int, gold string, word string, uni double")
    zero = dict.fromkeys([*W_NAMES, "unigram"], 0.0)
    got = {r.setting: (r.hits, r.n) for r in E.weight_hits(c, [zero | {"unigram": 1.0}, zero]).collect()}
    assert got == {0: (2, 5), 1: (3, 5)} and E.weight_hits(c.limit(0), [zero]).count() == 0
