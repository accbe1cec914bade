"""Queries over lists that hold predicted words: how they are arranged, what rules of merging gain, what fits typed letters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions import scores
from ..functions.keys import key_from_roman
from ..functions.text import ascii_tokens
from ..operators import beam as B, lexicon as L, liststudy as S, nextword as N, retrieve as R, within as W
from ..sources.store import built_once, in_parts, stored
from .lexicon import CAND, PAIRS, SCORE_SQL, _W, _candidates, pairs, seen as seen_words
from .prediction import RANKED
from .standins import QUERY_SQL, SPELLINGS, WORDS, completions, key_indexes, keyed_words, queries, romans, sentences, sql_key, table, with_keys

QUERIES, ORACLE_SQL = {}, {}
LETTERS = 4
ONE_LETTER = "length(word) > 1"  # stands for the script's mask: words of one letter are never offered


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


# a list of at most five for each query, a word of the general ranking as the model's guess, and what was typed
ARRANGED = f"""{CAND}, fr AS (SELECT q, word, row_number() OVER (PARTITION BY q ORDER BY best >= 5 AND rom_exact = 0 AND rom_prefix > 0, score DESC, word) AS rank FROM
    (SELECT q, word, rom_exact, rom_prefix, key_fine, key_coarse, key_fine_prefix, key_coarse_prefix, max(rom_exact) OVER (PARTITION BY q) AS best, round({SCORE_SQL} + {_W['rom_exact_fast']} * ln(1.0 + rom_exact), 6) AS score FROM cand)
    WHERE key_fine OR key_coarse OR key_fine_prefix OR key_coarse_prefix OR rom_prefix > 0 OR rom_exact >= 2),
  bl AS (SELECT q, list(word ORDER BY rank) AS base FROM fr WHERE rank <= 5 GROUP BY q)"""


@query(f"""WITH {ARRANGED}, gu AS (SELECT q, word, row_number() OVER (PARTITION BY q ORDER BY score DESC, word) AS rank FROM (SELECT q, word, round({SCORE_SQL}, 6) AS score FROM cand)),
  x AS (SELECT bl.q, roman AS typed, base, gu.word AS guess, 4 + length(roman) % 2 AS k FROM bl JOIN qs ON qs.q = bl.q LEFT JOIN gu ON gu.q = bl.q AND gu.rank = length(roman) % 7 + 1),
  y AS (SELECT *, typed <> '' AND NOT list_contains(base[1:k - 1], typed) AS reserve FROM x),
  z AS (SELECT *, CASE WHEN reserve THEN k - 1 ELSE k END AS slots, CASE WHEN reserve THEN list_filter(base, lambda w: w <> typed) ELSE base END AS items, CASE WHEN guess <> typed THEN guess END AS own FROM y),
  l AS (SELECT *, CASE WHEN own IS NOT NULL AND slots > 3 AND NOT list_contains(items[1:slots], own) THEN list_append(list_filter(items, lambda w: w <> own)[1:slots - 1], own) ELSE items[1:slots] END AS listed FROM z)
  SELECT q, array_to_string(CASE WHEN reserve THEN list_append(listed, typed) ELSE listed END, '|') AS shown FROM l""")
def list_arrangement(spark, d):
    c, qs = _candidates(spark, d), queries(spark, d)
    base = _lists(R.fast_ranked(c, scores.TUNED_WEIGHTS, 5), "q")
    guess = R.ranked(c, scores.TUNED_WEIGHTS, 7).select("q", F.col("word").alias("guess"), "rank")
    rows = base.join(qs.select("q", "roman", (F.length("roman") % 7 + 1).alias("rank")), "q").join(guess, ["q", "rank"], "left")
    shown = [F.when(F.length("roman") % 2 == k - 4, F.array_join(N.arranged(F.col("list"), F.col("guess"), F.col("roman"), k), "|")) for k in (4, 5)]
    return rows.select("q", F.coalesce(*shown).alias("shown"))


def _lists(ranked, by, place="rank"):
    return ranked.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct(place, "word"))), lambda x: x["word"]).alias("list"))


def _placed(spark, d, most):
    """Where each word of the conversations is, under each rule, in the list of its letters so far (typed_letters)."""

    def make():
        tested = seen_words(spark, d).groupBy("prev", "word").agg(F.count(F.lit(1)).alias("n")).withColumn("roman", F.col("word"))
        letters = tested.where("length(roman) >= 2").select("prev", F.explode(F.transform(S.typed_letters("roman", most), lambda i: F.substring(F.col("roman"), F.lit(1), i))).alias("roman")).distinct()
        letters = stored(letters, "typed-letters")
        asked = stored(with_keys(letters.select("roman").distinct().withColumn("q", F.col("roman")), "roman"), "typed-asked")
        lists = []
        for part in in_parts(asked, "roman", SPELLINGS):
            found = R.candidates(part, keyed_words(spark, d), romans(spark, d), completions(spark, d), key_indexes=key_indexes(spark, d))
            lists.append(stored(_lists(R.fast_ranked(found, scores.TUNED_WEIGHTS, S.SHOWN), "q").withColumnRenamed("q", "typed"), "typed-lists"))
        predicted = N.next_completions(letters, L.followers(pairs(spark, d)), S.PREDICTED).withColumnRenamed("roman", "typed")
        predicted = predicted.groupBy("prev", "typed").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]).alias("list"))
        return S.typed_places(tested, reduce(DataFrame.unionByName, lists), predicted, most)

    return built_once(spark, d, f"typed-places-{most}", make)


def typed_sql(rows: str) -> str:
    return f"""te AS (SELECT prev, word, count(*) AS n FROM seq WHERE prev IS NOT NULL AND kept IS NOT NULL AND length(word) >= 2 GROUP BY prev, word),
  ty AS (SELECT prev, word, n, i AS letters, length(word) AS len, left(word, i) AS typed FROM {rows})"""


TYPED = typed_sql(f"te, (SELECT unnest(range(1, {LETTERS + 1})) AS i) WHERE i <= length(word)")
EVERY_LETTER = typed_sql("(SELECT *, unnest(range(1, length(word) + 1)) AS i FROM te)")
STUDY = f"""{PAIRS}, {RANKED}, {TYPED}, {ARRANGED.replace(QUERY_SQL, 'qs AS (SELECT DISTINCT typed AS q, typed AS roman FROM ty)')}, tr AS (SELECT DISTINCT typed AS word FROM ty),
  {sql_key('coarse', 'fol', out='kw')}, {sql_key('coarse', 'tr', out='kt')}, dt AS (SELECT DISTINCT prev, typed FROM ty),
  fit AS (SELECT dt.prev, typed, rf.word, rf.cnt FROM dt JOIN kt ON dt.typed = kt.word JOIN rf ON rf.prev = dt.prev JOIN kw ON kw.word = rf.word WHERE kt.key <> '' AND starts_with(kw.key, kt.key)),
  pl AS (SELECT prev, typed, list(word ORDER BY place) AS more FROM (SELECT *, row_number() OVER (PARTITION BY prev, typed ORDER BY cnt DESC, word) AS place FROM fit) WHERE place <= 2 GROUP BY prev, typed),
  ru AS (SELECT unnest([{', '.join(str(s) for s, _ in S.RULES)}]) AS start, unnest([{', '.join(str(n) for _, n in S.RULES)}]) AS put_in),
  x AS (SELECT ty.*, coalesce(base, []) AS base, coalesce(more, []) AS more FROM ty LEFT JOIN bl ON bl.q = typed LEFT JOIN pl ON pl.prev = ty.prev AND pl.typed = ty.typed),
  y AS (SELECT *, base[1:start] AS head FROM x, ru), z AS (SELECT *, list_filter(more, lambda w: NOT list_contains(head, w))[1:put_in] AS extra FROM y),
  a AS (SELECT *, coalesce(list_position(base, word), 0) AS own, coalesce(list_position(list_concat(head, extra, list_filter(base[start + 1:], lambda w: NOT list_contains(extra, w)))[1:5], word), 0) AS place FROM z)"""


@query(f"""WITH {STUDY} SELECT start, put_in, letters::BIGINT AS letters, sum(n)::BIGINT AS tried, coalesce(sum(n) FILTER (len(more) > 0), 0)::BIGINT AS offered, coalesce(sum(n) FILTER (list_contains(more, word)), 0)::BIGINT AS offered_right,
  {', '.join(f'coalesce(sum(n) FILTER (place = {i}), 0)::BIGINT AS at{i}' for i in range(1, 6))}, coalesce(sum(n) FILTER (place = 0), 0)::BIGINT AS absent,
  coalesce(sum(n) FILTER (letters = len AND own > 0 AND (place = 0 OR place > own)), 0)::BIGINT AS displaced FROM a GROUP BY start, put_in, letters""".replace("letters = len AND", 'letters = a."len" AND').replace("len(more)", "array_length(more)"))
def merge_rules(spark, d):
    return S.by_letters(_placed(spark, d, LETTERS)).withColumn("letters", F.col("letters").cast("bigint"))


@query(f"""WITH {STUDY.replace(TYPED, EVERY_LETTER)}, e AS (SELECT start, put_in, prev, word, n, a."len" AS l, min(letters) FILTER (place > 0 AND letters < a."len") AS seen, arg_min(place, letters) FILTER (place > 0 AND letters < a."len") AS place FROM a GROUP BY start, put_in, prev, word, n, a."len")
  SELECT start, put_in, sum(n)::BIGINT AS words, sum(n * (l + 1))::BIGINT AS plain, sum(n * CASE WHEN seen IS NULL THEN l + 1 WHEN place = 1 THEN seen + 1 ELSE least(seen + 2, l + 1) END)::BIGINT AS needed FROM e GROUP BY start, put_in""")
def merge_rule_keystrokes(spark, d):
    """Each word is looked for at each of its letters, however many it has."""
    return S.keystrokes(_placed(spark, d, None))


def within_sql(asked: str, k: int) -> str:
    """CTEs from asked (prev, typed) to bw (prev, typed, word, share, rank)."""
    g = f"{W.GENERAL}::DOUBLE"
    return f"""ow AS (SELECT words.word, key, score / (SELECT sum(score) FROM words WHERE {ONE_LETTER}) AS p FROM words JOIN kc ON kc.word = words.word WHERE length(words.word) > 1),
  ask AS ({asked}), gm AS (SELECT typed, sum(p) AS general FROM (SELECT DISTINCT typed FROM ask) JOIN ow ON starts_with(key, typed) GROUP BY typed),
  tp AS (SELECT typed, word, p FROM (SELECT typed, word, p, row_number() OVER (PARTITION BY typed ORDER BY p DESC, word) AS r FROM (SELECT DISTINCT typed FROM ask) JOIN ow ON starts_with(key, typed)) WHERE r <= {k}),
  my AS (SELECT ask.prev, typed, ow.word, p, cnt / total AS told FROM ask JOIN pairs ON pairs.prev = ask.prev JOIN totals ON totals.prev = ask.prev JOIN ow ON ow.word = pairs.word AND starts_with(key, typed)),
  tm AS (SELECT prev, typed, sum(told) AS t FROM my GROUP BY prev, typed),
  b AS (SELECT prev, typed, word, max(p) AS p, max(told) AS told FROM (SELECT * FROM my UNION ALL SELECT prev, typed, word, p, 0 FROM ask JOIN tp USING (typed)) GROUP BY prev, typed, word),
  o AS (SELECT b.prev, b.typed, word, round({g} * p + (1 - {g}) * told, 12) AS own, {g} * general + (1 - {g}) * coalesce(t, 0) AS mass FROM b JOIN gm USING (typed) LEFT JOIN tm ON tm.prev = b.prev AND tm.typed = b.typed),
  bw AS (SELECT prev, typed, word, own / mass AS share, rank FROM (SELECT *, row_number() OVER (PARTITION BY prev, typed ORDER BY own DESC, word) AS rank FROM o) WHERE rank <= {k})"""


SEEN = "FROM seq WHERE prev IS NOT NULL AND kept IS NOT NULL"
ASKED = "SELECT DISTINCT prev, key AS typed FROM seq JOIN kt ON kt.word = left(seq.word, 2) WHERE prev IS NOT NULL AND kept IS NOT NULL UNION SELECT DISTINCT prev, '' FROM pairs"


@query(f"""WITH {WORDS}, {PAIRS}, {sql_key('coarse', 'words', out='kc')}, tq AS (SELECT DISTINCT left(word, 2) AS word {SEEN}), {sql_key('coarse', 'tq', out='kt')}, {within_sql(ASKED, 3)}
  SELECT prev, typed, word, round(share, 6) AS share, rank::BIGINT AS rank FROM bw""")
def best_within(spark, d):
    seen, p = seen_words(spark, d), pairs(spark, d)
    starts = seen.select(F.substring("word", 1, 2).alias("roman")).distinct().withColumn("typed", key_from_roman("roman", "coarse"))
    asked = seen.select("prev", F.substring("word", 1, 2).alias("roman")).distinct().join(starts, "roman").select("prev", "typed")
    asked = asked.union(p.select("prev", F.lit("").alias("typed"))).distinct()
    offered = W.offered_words(keyed_words(spark, d).select("word", F.col("coarse").alias("key"), "score"), F.expr(ONE_LETTER))
    return W.best_within(asked, p, L.pair_totals(p), offered, 3).select("prev", "typed", "word", F.round("share", 6).alias("share"), F.col("rank").cast("bigint").alias("rank"))


TALLY = f"""te AS (SELECT prev, word, i AS letters, left(word, i) AS start, count(*) AS n FROM seq, (SELECT unnest(range(0, 4)) AS i) WHERE prev IS NOT NULL AND kept IS NOT NULL AND i < length(word) GROUP BY prev, word, i),
  tq AS (SELECT DISTINCT start AS word FROM te WHERE start <> ''), {sql_key('coarse', 'tq', out='kt')}, ty AS (SELECT te.prev, te.word, letters, n, coalesce(key, '') AS typed FROM te LEFT JOIN kt ON kt.word = te.start)"""


@query(f"""WITH {WORDS}, {PAIRS}, {sql_key('coarse', 'words', out='kc')}, {TALLY}, {within_sql('SELECT DISTINCT prev, typed FROM ty', 2)},
  sp AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS word FROM benchmark),
  x AS (SELECT ty.*, sp.word IS NOT NULL AS spelt, coalesce(one.word = ty.word, false) AS first_one, coalesce(two.word = ty.word, false) AS second_one, coalesce(round(one.share, 9) >= 0.5, false) AS seen
    FROM ty LEFT JOIN sp ON sp.word = ty.word LEFT JOIN (SELECT * FROM bw WHERE rank = 1) one ON one.prev = ty.prev AND one.typed = ty.typed LEFT JOIN (SELECT * FROM bw WHERE rank = 2) two ON two.prev = ty.prev AND two.typed = ty.typed),
  y AS (SELECT *, 'all' AS spelled FROM x UNION ALL SELECT *, 'yes' FROM x WHERE spelt)
  SELECT letters::BIGINT AS letters, spelled, sum(n)::BIGINT AS asked, coalesce(sum(n) FILTER (first_one), 0)::BIGINT AS first_right, coalesce(sum(n) FILTER (first_one OR second_one), 0)::BIGINT AS either_right,
  coalesce(sum(n) FILTER (seen), 0)::BIGINT AS shown, coalesce(sum(n) FILTER (seen AND first_one), 0)::BIGINT AS shown_right FROM y GROUP BY letters, spelled""")
def predictor_tally(spark, d):
    p = pairs(spark, d)
    words = seen_words(spark, d).groupBy("prev", "word").agg(F.count(F.lit(1)).alias("n"))
    rows = words.select("prev", "word", "n", F.explode(F.sequence(F.lit(0), F.least(F.lit(3), F.length("word") - 1))).alias("letters")).withColumn("start", F.substring(F.col("word"), F.lit(1), F.col("letters")))
    keys = rows.select("start").distinct().withColumn("typed", key_from_roman("start", "coarse"))
    spelled = table(spark, d, "benchmark").select(F.explode(ascii_tokens("text")).alias("w")).select(F.lower("w").alias("word"), F.lit(True).alias("spelled")).distinct()
    tested = rows.join(keys, "start").join(spelled, "word", "left").withColumn("spelled", F.coalesce("spelled", F.lit(False)))
    offered = W.offered_words(keyed_words(spark, d).select("word", F.col("coarse").alias("key"), "score"), F.expr(ONE_LETTER))
    guesses = W.best_within(tested.select("prev", "typed"), p, L.pair_totals(p), offered, 2)
    return W.predictor_tally(tested, guesses).withColumn("letters", F.col("letters").cast("bigint"))


@query()
def beam_decoded(spark, d):
    """Every query's spelling decoded by a model of letters that is counted from all of them: a search, which SQL has not."""
    typed = queries(spark, d).select("roman", F.col("gold").alias("word"), F.col("weight").alias("count"))
    model = B.letter_model(typed)
    return B.decoded(typed.select("roman").distinct(), lambda: model, 4, 3).select("roman", "rank", "word", F.round("score", 6).alias("score"))
