"""Queries over next-word prediction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lexicon as L, nextword as N
from .lexicon import PAIRS, pairs, seen
from .standins import SENT, TURNS, sentences, sql_key

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def _followers(spark, d):
    p = pairs(spark, d)
    return L.followers(p).select("prev", "word", "count"), L.pair_totals(p)


RANKED = "rf AS (SELECT prev, word, cnt, row_number() OVER (PARTITION BY prev ORDER BY cnt DESC, word) AS r FROM fol)"


@query(f"""WITH {PAIRS}, {RANKED}, s AS (SELECT prev, word, r, cnt / total AS share, max(cnt / total) OVER (PARTITION BY prev) AS best FROM rf JOIN totals USING (prev))
  SELECT prev, word, round(share, 6) AS share, r::BIGINT AS rank FROM s WHERE best >= 0.2 AND r <= 3""")
def next_words_gated(spark, d):
    f, t = _followers(spark, d)
    return N.next_words(N.offered(f), t).select("prev", "word", F.round("share", 6).alias("share"), F.col("rank").cast("bigint").alias("rank"))


@query(f"""WITH {PAIRS}, {RANKED}, ty AS (SELECT DISTINCT prev, left(word, 2) AS roman FROM seq WHERE prev IS NOT NULL AND kept IS NOT NULL), {sql_key('coarse', 'fol', out='kw')}, tr AS (SELECT DISTINCT roman AS word FROM ty), {sql_key('coarse', 'tr', out='kt')},
  fit AS (SELECT ty.prev, roman, rf.word, rf.cnt FROM ty JOIN kt ON ty.roman = kt.word JOIN rf ON rf.prev = ty.prev JOIN kw ON kw.word = rf.word WHERE kt.key <> '' AND starts_with(kw.key, kt.key))
  SELECT prev, roman, word, round(share, 6) AS share, place::BIGINT AS place FROM (SELECT *, cnt / sum(cnt) OVER (PARTITION BY prev, roman) AS share, row_number() OVER (PARTITION BY prev, roman ORDER BY cnt DESC, word) AS place FROM fit) WHERE place <= 2""")
def next_completions(spark, d):
    seq = seen(spark, d)
    typed = seq.select("prev", F.substring("word", 1, 2).alias("roman")).distinct()
    f, _ = _followers(spark, d)
    return N.next_completions(typed, f).select("prev", "roman", "word", F.round("share", 6).alias("share"), F.col("place").cast("bigint").alias("place"))


@query(f"""WITH {PAIRS}, b AS (SELECT prev, word, cnt FROM (SELECT *, row_number() OVER (PARTITION BY prev ORDER BY cnt DESC, word DESC) AS r FROM fol) WHERE r = 1)
  SELECT word, sum(total)::BIGINT AS seen, count(*)::BIGINT AS after_words FROM b JOIN totals USING (prev) WHERE cnt / total >= 0.1 GROUP BY word""")
def nextword_audit(spark, d):
    f, t = _followers(spark, d)
    return N.audit(f, t, 0.1)


@query(f"""WITH {PAIRS}, {RANKED}, top AS (SELECT prev, list(word) AS words, max(cnt) AS m FROM rf WHERE r <= 3 GROUP BY prev), x AS (SELECT seq.word, words, m / total AS share FROM seq LEFT JOIN top ON seq.prev = top.prev LEFT JOIN totals ON totals.prev = top.prev WHERE seq.prev IS NOT NULL AND kept IS NOT NULL)
  SELECT threshold, count(*)::BIGINT AS positions, count(*) FILTER (share >= threshold)::BIGINT AS shown, count(*) FILTER (share >= threshold AND list_contains(words, word))::BIGINT AS "right" FROM x, (SELECT unnest([0.0, 0.05, 0.1, 0.2, 0.3, 0.5])::DOUBLE AS threshold) GROUP BY threshold""")
def nextword_thresholds(spark, d):
    tested = seen(spark, d).select("prev", "word")
    return N.thresholds(tested, *_followers(spark, d))


@query(f"""WITH {PAIRS} SELECT sent, pos, count(*) OVER (PARTITION BY sent // {TURNS}, prev, word ORDER BY sent, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)::BIGINT AS before,
  count(*) OVER (PARTITION BY sent // {TURNS}, prev ORDER BY sent, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)::BIGINT AS prev_before FROM seq WHERE prev IS NOT NULL AND kept IS NOT NULL""")
def prequential_next(spark, d):
    paired = seen(spark, d)
    return N.prequential(paired.withColumn("conv", F.expr(f"sent div {TURNS}"))).select("sent", F.col("pos").cast("bigint").alias("pos"), "before", "prev_before")


@query(f"""WITH {PAIRS}, own AS (SELECT prev, word, count(*) AS n FROM seq WHERE prev IS NOT NULL AND kept IS NOT NULL AND role = 'user' GROUP BY prev, word),
  b AS (SELECT prev, word, cnt / total AS s FROM fol JOIN totals USING (prev) UNION ALL SELECT prev, word, 0.5 * n / sum(n) OVER (PARTITION BY prev) FROM own), g AS (SELECT prev, word, round(sum(s), 9) AS score FROM b GROUP BY prev, word)
  SELECT prev, word, round(score, 6) AS score, rank::BIGINT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY prev ORDER BY score DESC, word) AS rank FROM g) WHERE rank <= 3""")
def personal_blend(spark, d):
    seq = seen(spark, d)
    own = seq.where("role = 'user'").groupBy("prev", "word").agg(F.count(F.lit(1)).alias("n"))
    f, t = _followers(spark, d)
    shares = f.join(t, "prev").withColumn("share", F.col("count") / F.col("total"))
    return N.blended(shares, own, 0.5, 3).select("prev", "word", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(f"WITH {SENT} SELECT sent, pos, coalesce(array_to_string(list(word) OVER (PARTITION BY sent ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), ' '), '') AS context FROM sent")
def context_windows(spark, d):
    return sentences(spark, d).select("sent", F.col("pos").cast("bigint").alias("pos"), F.array_join(N.context(), " ").alias("context"))


@query(f"""WITH {PAIRS}, {RANKED}, te AS (SELECT prev, word FROM seq WHERE prev IS NOT NULL AND kept IS NOT NULL), ty AS (SELECT prev, word, i AS letters, left(word, i) AS roman FROM te, (SELECT unnest([1, 2, 3]) AS i) WHERE i < length(word)),
  tr AS (SELECT DISTINCT roman AS word FROM ty), {sql_key('coarse', 'fol', out='kw')}, {sql_key('coarse', 'tr', out='kt')}, dt AS (SELECT DISTINCT prev, roman FROM ty),
  fit AS (SELECT dt.prev, roman, rf.word, rf.cnt FROM dt JOIN kt ON dt.roman = kt.word JOIN rf ON rf.prev = dt.prev JOIN kw ON kw.word = rf.word WHERE kt.key <> '' AND starts_with(kw.key, kt.key)),
  g AS (SELECT prev, roman, word AS guess, share FROM (SELECT *, cnt / sum(cnt) OVER (PARTITION BY prev, roman) AS share, row_number() OVER (PARTITION BY prev, roman ORDER BY cnt DESC, word) AS place FROM fit) WHERE place = 1),
  x AS (SELECT letters, bar, coalesce(round(share, 9) >= bar, false) AS shown, coalesce(round(share, 9) >= bar AND guess = ty.word, false) AS ok, length(ty.word) - letters AS l FROM ty LEFT JOIN g ON g.prev = ty.prev AND g.roman = ty.roman, (SELECT unnest([0.2, 0.5])::DOUBLE AS bar))
  SELECT letters::BIGINT AS letters, bar, count(*)::BIGINT AS positions, count(*) FILTER (shown)::BIGINT AS shown, count(*) FILTER (ok)::BIGINT AS "right", coalesce(sum(l) FILTER (ok), 0)::BIGINT AS saved FROM x GROUP BY letters, bar""")
def first_letter_study(spark, d):
    tested = seen(spark, d).select("prev", "word")
    f, _ = _followers(spark, d)
    return N.letter_study(tested, f, 3, (0.2, 0.5)).select(F.col("letters").cast("bigint").alias("letters"), "bar", "positions", "shown", "right", "saved")
