"""Queries over accuracy, error rates, studies and scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import metrics as M
from ..functions.scores import SEARCHED, TUNED_WEIGHTS
from ..functions.text import BENGALI, ascii_tokens
from ..operators import evaluate as E, lexicon as L, retrieve as R, scorer as S
from ..sources.store import in_parts, stored
from .lexicon import CAND, SCORE_SQL, _candidates, pairs, score_sql
from .usage import LETTERS, SIGNS
from .standins import QUERY_SQL, ROMANS, SPELLINGS, STYLE_EXPRESSIONS, TOK, WORDS, completions, key_indexes, keyed_words, queries, romans, sent_of, sentences, sql_key, sql_style, table, tokens, with_keys, words

QUERIES, ORACLE_SQL = {}, {}
CHARACTERS = 100_000_000  # fixed value: characters of the turns that are worked on at a time


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


ITEMS = f"""{TOK}, it AS (SELECT {sql_style('no_h', 'word')} AS roman, word AS gold, quality + 1 AS weight, source, struct_pack(d := doc_id, p := pos) AS ord FROM tok JOIN labels USING (doc_id))"""


def _items(spark, d):
    t = tokens(spark, d).join(table(spark, d, "labels"), "doc_id")
    return t.select(F.expr(STYLE_EXPRESSIONS["no_h"].replace("{w}", "word").replace("{1}", "$1")).alias("roman"), F.col("word").alias("gold"), (F.col("quality") + 1).alias("weight"), "source", F.struct("doc_id", "pos").alias("ord"))


@query(f"""WITH {ITEMS}, g AS (SELECT roman, gold, sum(weight) AS w, min(ord) AS first, arg_min(source, ord) AS source FROM it GROUP BY roman, gold)
  SELECT roman, array_to_string(list(gold ORDER BY w DESC, first), '|') AS golds, sum(w)::BIGINT AS weight, arg_min(source, first) AS source FROM g GROUP BY roman""")
def wordset_grouped(spark, d):
    return E.grouped_wordset(_items(spark, d)).select("roman", F.array_join("golds", "|").alias("golds"), F.col("weight").cast("bigint").alias("weight"), "source")


RANKS = f"""{CAND}, rk AS (SELECT q, word, row_number() OVER (PARTITION BY q ORDER BY score DESC, word) AS rank FROM (SELECT q, word, round({SCORE_SQL}, 6) AS score FROM cand)),
  gr AS (SELECT qs.q, gold, weight, rank FROM qs LEFT JOIN (SELECT q, word, rank FROM rk WHERE rank <= 5) r ON qs.q = r.q AND qs.gold = r.word)"""


def _ranked(spark, d, k=5):
    return R.ranked(_candidates(spark, d), TUNED_WEIGHTS, k)


@query(f"""WITH {RANKS} SELECT count(*)::BIGINT AS n, round(100.0 * sum(CASE WHEN rank <= 1 THEN weight ELSE 0 END) / sum(weight), 6) AS top1, round(100.0 * sum(CASE WHEN rank <= 3 THEN weight ELSE 0 END) / sum(weight), 6) AS top3,
  round(100.0 * sum(CASE WHEN rank <= 5 THEN weight ELSE 0 END) / sum(weight), 6) AS top5, round(sum(coalesce(weight / rank, 0)) / sum(weight), 6) AS mrr FROM gr""")
def topk_mrr_weighted(spark, d):
    return E.word_eval(E.gold_ranks(queries(spark, d), _ranked(spark, d)))


@query(f"""WITH {RANKS}, s AS (SELECT length(gold) % 4 AS set_id, sum(CASE WHEN rank <= 1 THEN weight ELSE 0 END) * 100.0 / sum(weight) AS top1, sum(CASE WHEN rank <= 3 THEN weight ELSE 0 END) * 100.0 / sum(weight) AS top3, sum(coalesce(weight / rank, 0)) / sum(weight) AS mrr FROM gr GROUP BY 1)
  SELECT count(*)::BIGINT AS sets, round(avg(round(top1, 6)), 4) AS top1, round(avg(round(top3, 6)), 4) AS top3, round(avg(round(mrr, 6)), 4) AS mrr FROM s""")
def macro_average(spark, d):
    ranks = E.gold_ranks(queries(spark, d), _ranked(spark, d)).withColumn("set_id", F.length("gold") % 4)
    return E.macro_average(E.word_eval(ranks, by=("set_id",))).select("sets", *(F.round(m, 4).alias(m) for m in ("top1", "top3", "mrr")))


@query(f"""WITH {RANKS}, one AS (SELECT q, word FROM rk WHERE rank = 1), g AS (SELECT roman, list(gold) AS golds, sum(weight) AS w FROM qs GROUP BY roman), a AS (SELECT qs.roman, min(one.word) AS word FROM qs LEFT JOIN one USING (q) GROUP BY qs.roman)
  SELECT round(100.0 * sum(list_min(list_transform(golds, lambda g: levenshtein(coalesce(word, ''), g) / length(g))) * w) / sum(w), 6) AS cer FROM g JOIN a USING (roman)""")
def mean_least_cer(spark, d):
    """Of the golds of a spelling the one nearest to the first choice counts; a spelling's queries all have the same choice."""
    qs = queries(spark, d)
    golds = qs.groupBy("roman").agg(F.collect_list("gold").alias("golds"), F.sum("weight").alias("weight"))
    first = qs.select("q", "roman").join(_ranked(spark, d, 1).select("q", "word"), "q", "left").groupBy("roman").agg(F.min("word").alias("word"))
    return E.mean_least_cer(golds.join(first, "roman"))


@query("""WITH p AS (SELECT a.p_name AS h, b.p_name AS r FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1) SELECT h, r, CASE WHEN length(r) = 0 THEN (length(h) > 0)::INT ELSE round(levenshtein(h, r) / length(r), 6) END AS cer FROM p""")
def cer_ascii(spark, d):
    p = table(spark, d, "part")
    pairs = p.alias("a").join(p.alias("b"), F.expr("b.p_partkey = a.p_partkey + 1")).select(F.col("a.p_name").alias("h"), F.col("b.p_name").alias("r"))
    return pairs.select("h", "r", F.round(M.cer("h", "r"), 6).alias("cer"))


def wer_sql(word: str, keep: str) -> str:
    """Corpus word error rate of turns against the next ones; a row of the distance table at a time, as lists of numbers of words."""
    return f"""WITH t AS (SELECT conv_id, turn, list_filter(list_transform(regexp_extract_all(text, '[A-Za-z]+'), lambda w: {word}), lambda w: {keep}) AS w FROM conversations),
  p AS (SELECT a.w AS h, b.w AS r FROM t a JOIN t b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1), n AS (SELECT list_distinct(list_concat(h, r)) AS k, h, r FROM p),
  m AS (SELECT list_transform(h, lambda x: [list_position(k, x)::BIGINT]) AS h, list_transform(r, lambda x: list_position(k, x)::BIGINT) AS r FROM n),
  e AS (SELECT len(r) AS words, list_reduce(h, lambda row, x: list_reduce(list_transform(range(1, len(r) + 1), lambda j: [j]), lambda acc, j: list_append(acc, least(row[j[1] + 1] + 1, acc[j[1]] + 1, row[j[1]] + (x[1] <> r[j[1]])::BIGINT)), [row[1] + 1]), range(0, len(r) + 1))[-1] AS errors FROM m)
  SELECT sum(errors)::BIGINT AS errors, sum(words)::BIGINT AS words, round(100.0 * sum(errors) / sum(words), 6) AS wer FROM e"""


def _wer(spark, d, words):
    t = table(spark, d, "conversations").select("conv_id", "turn", words.alias("w"))
    pairs = t.join(t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("ref")), ["conv_id", "turn"])
    each = pairs.select(M.word_errors("w", "ref").alias("errors"), F.size("ref").cast("bigint").alias("words"))
    return each.agg(F.sum("errors").alias("errors"), F.sum("words").alias("words"), F.round(100.0 * F.sum("errors") / F.sum("words"), 6).alias("wer"))


@query(wer_sql("w", "true"))
def wer_corpus(spark, d):
    """Errors and words of each turn against the next of its conversation, and the corpus rate over all."""
    return _wer(spark, d, ascii_tokens("text"))


@query(wer_sql(f"CASE WHEN length(w) % 2 = 0 THEN translate(lower(w), '{LETTERS}', '{SIGNS}') ELSE w END", f"regexp_matches(w, '[{BENGALI}]')"))
def wer_bengali(spark, d):
    """The Bengali view of the rate: words of even length are in Bengali signs, the others are not counted."""
    mixed = F.transform(ascii_tokens("text"), lambda w: F.when(F.length(w) % 2 == 0, F.translate(F.lower(w), LETTERS, SIGNS)).otherwise(w))
    return _wer(spark, d, M.bengali_words(mixed))


def _percentiles(spark, d, index, ps):
    name = lambda p: f"p{round(p * 100 if p <= 1 else p)}"
    found = E.percentiles(table(spark, d, "events"), "event_type", "value", {name(p): lambda n, p=p: index(n, p) for p in ps})
    return found.select("event_type", *(F.round(name(p), 6).alias(name(p)) for p in ps))


VALUES = "v AS (SELECT event_type, list(value ORDER BY value) AS v, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1)"


@query(f"WITH {VALUES} SELECT event_type, " + ", ".join(f"round(v[greatest(1, least(n, round_even({p} / 100.0 * n + 0.5, 0)::BIGINT))], 6) AS p{p}" for p in (50, 95, 99)) + " FROM v")
def percentiles_eval(spark, d):
    return _percentiles(spark, d, M.index_eval, (50, 95, 99))


@query(f"WITH {VALUES} SELECT event_type, round(v[n // 2 + 1], 6) AS p50, round(v[least(n - 1, floor(n * 0.95::DOUBLE)::BIGINT) + 1], 6) AS p95 FROM v")
def percentiles_telemetry(spark, d):
    return _percentiles(spark, d, M.index_telemetry, (0.5, 0.95))


@query(f"WITH {VALUES} SELECT event_type, round(v[round((n - 1) * 0.5::DOUBLE)::BIGINT + 1], 6) AS p50, round(v[round((n - 1) * 0.9::DOUBLE)::BIGINT + 1], 6) AS p90 FROM v")
def percentiles_bench(spark, d):
    return _percentiles(spark, d, M.index_bench, (0.5, 0.9))


@query(f"""WITH {WORDS}, {QUERY_SQL}, px AS (SELECT left(word, i) AS prefix, word, score FROM (SELECT word, score, unnest(range(1, length(word) + 1)) AS i FROM words)),
  pr AS (SELECT prefix, word, row_number() OVER (PARTITION BY prefix ORDER BY score DESC, word) AS rank FROM px),
  ty AS (SELECT q, gold, length(gold) AS n, unnest(range(1, length(gold) + 1)) AS i FROM qs),
  e AS (SELECT q, n, min(CASE WHEN rank = 1 THEN i END) AS f1, min(CASE WHEN rank <= 5 THEN i END) AS fk FROM ty LEFT JOIN pr ON prefix = left(gold, i) AND pr.word = gold GROUP BY q, n)
  SELECT sum(n)::BIGINT AS keystrokes, sum(coalesce(n - f1, 0))::BIGINT AS saved_top1, sum(coalesce(n - fk, 0))::BIGINT AS saved_topk, count(*) FILTER (f1 IS NULL)::BIGINT AS never_top1, count(*) FILTER (fk IS NULL)::BIGINT AS never_topk FROM e""")
def keystroke_replay(spark, d):
    ranks = L.prefix_top(words(spark, d).withColumn("text", F.col("word")), "text", "score", None, 5)
    return E.replay(queries(spark, d).select("q", F.col("gold").alias("roman"), "gold"), ranks, 5)


@query(f"""WITH {CAND}, c AS (SELECT cand.q, gold, cand.word, round({SCORE_SQL}, 6) AS score, -length(cand.word) / 4.0 AS logp, ascii(cand.word) % 3 = 0 AS unknown FROM cand JOIN qs ON cand.q = qs.q),
  o AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, word) AS ord FROM c),
  g AS (SELECT q, gold, w, k, word, row_number() OVER (PARTITION BY q, w, k ORDER BY round(score + w * (logp + k * unknown::INT), 6) DESC, ord) AS r FROM (SELECT * FROM o WHERE ord <= 10), (SELECT unnest([0.0, 0.25, 0.5, 1.0])::DOUBLE AS w), (SELECT unnest([-1.0, 0.0])::DOUBLE AS k))
  SELECT w AS model_weight, k AS "offset", count(*) FILTER (word = gold)::BIGINT AS hits, count(*)::BIGINT AS n FROM g WHERE r = 1 GROUP BY w, k""")
def rerank_grid(spark, d):
    c = _ranked(spark, d, 10).withColumn("logp", -F.length("word") / 4.0).withColumn("unknown", F.ascii("word") % 3 == 0).withColumn("ord", F.col("rank"))
    return E.rerank_grid(c.join(queries(spark, d).select("q", "gold"), "q"), [0.0, 0.25, 0.5, 1.0], [-1.0, 0.0])


_STYLED = ", ".join(f"('{n}', {sql_style(n, 'word')})" for n in STYLE_EXPRESSIONS)


@query(f"""WITH {WORDS} SELECT word, style, roman FROM (SELECT word, s[1] AS style, s[2] AS roman FROM (SELECT word, unnest([{', '.join(f"['{n}', {sql_style(n, 'word')}]" for n in STYLE_EXPRESSIONS)}, ['as_is', word]]) AS s FROM words)) WHERE regexp_matches(roman, '[A-Za-z]')""")
def style_variants(spark, d):
    from ..operators.stress import variants

    return variants(words(spark, d).select("word"))


@query(f"""WITH {WORDS}, {sql_key('coarse', 'words', out='kc')}, v AS (SELECT word, s[1] AS style, s[2] AS roman FROM (SELECT word, unnest([{', '.join(f"['{n}', {sql_style(n, 'word')}]" for n in STYLE_EXPRESSIONS)}, ['as_is', word]]) AS s FROM words)),
  kv AS (SELECT roman AS word FROM v), {sql_key('coarse', 'kv', out='kq')}, tk AS (SELECT key, w.word, row_number() OVER (PARTITION BY key ORDER BY score DESC, w.word DESC) AS rank FROM words w JOIN kc USING (word) WHERE key <> '')
  SELECT style, count(*)::BIGINT AS n, round(100.0 * count(*) FILTER (rank = 1) / count(*), 6) AS top1, round(100.0 * count(*) FILTER (rank <= 5) / count(*), 6) AS top5 FROM v JOIN kq ON v.roman = kq.word LEFT JOIN tk ON tk.key = kq.key AND tk.word = v.word AND rank <= 30 GROUP BY style""")
def stress_summary(spark, d):
    from ..operators.stress import summary

    return summary(_stressed(spark, d), "style")


def _stressed(spark, d):
    """word, style, rank of every word under every habit, looked up by its key."""
    from pyspark.sql import Window

    from ..functions.keys import key_from_roman
    from ..operators.stress import variants

    w = keyed_words(spark, d)
    top = R.top_by_key(w, "coarse").withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), F.desc("word")))).select("key", "word", "rank")
    v = variants(w.select("word")).join(w.select(F.col("word").alias("roman"), "coarse"), "roman", "left")
    v = v.withColumn("key", F.coalesce("coarse", key_from_roman("roman")))
    return v.join(top, ["key", "word"], "left").select("word", "style", "rank")


@query(f"""WITH {WORDS}, {sql_key('coarse', 'words', out='kc')}, v AS (SELECT word, s[1] AS style, s[2] AS roman FROM (SELECT word, unnest([{', '.join(f"['{n}', {sql_style(n, 'word')}]" for n in STYLE_EXPRESSIONS)}, ['as_is', word]]) AS s FROM words)),
  kv AS (SELECT roman AS word FROM v), {sql_key('coarse', 'kv', out='kq')}, tk AS (SELECT key, w.word, row_number() OVER (PARTITION BY key ORDER BY score DESC, w.word DESC) AS rank FROM words w JOIN kc USING (word) WHERE key <> ''),
  r AS (SELECT v.word, style, rank FROM v JOIN kq ON v.roman = kq.word LEFT JOIN tk ON tk.key = kq.key AND tk.word = v.word AND rank <= 30), s AS (SELECT source, style, rank FROM r JOIN (SELECT DISTINCT word, lang AS source FROM tok) USING (word))
  SELECT coalesce(source, 'ALL') AS source, coalesce(style, 'ALL') AS style, count(*)::BIGINT AS n, round(100.0 * count(*) FILTER (rank = 1) / count(*), 6) AS top1, round(100.0 * count(*) FILTER (rank <= 5) / count(*), 6) AS top5 FROM s GROUP BY CUBE (source, style)""")
def stress_by_source(spark, d):
    """By style, by source (here the language), by both and over all."""
    from ..operators.stress import summary

    held = tokens(spark, d).select("word", F.col("lang").alias("source")).distinct()
    return summary(_stressed(spark, d).join(held, "word"), "source", "style", cube=True)


_GRID = [TUNED_WEIGHTS | {"key_coarse": c} for c in (0.2, 0.6, 1.5)] + [TUNED_WEIGHTS | {"unigram": u} for u in (0.1, 1.0)]
_SETTINGS = " UNION ALL ".join(f"SELECT {i} AS setting, q, word, round({score_sql(w)}, 6) AS score FROM cand" for i, w in enumerate(_GRID))


@query(f"""WITH {CAND}, s AS ({_SETTINGS}), o AS (SELECT setting, q, word FROM (SELECT *, row_number() OVER (PARTITION BY setting, q ORDER BY score DESC, word) AS r FROM s) WHERE r = 1)
  SELECT setting, count(*) FILTER (word = gold)::BIGINT AS hits, count(*)::BIGINT AS n FROM o JOIN qs ON o.q = qs.q GROUP BY setting""")
def weight_grid(spark, d):
    """Hits of the first choice under several weights: what one step of coordinate ascent asks for."""
    return E.weight_hits(_candidates(spark, d).join(queries(spark, d).select("q", "gold"), "q"), _GRID)


@query()
def sentence_transliteration(spark, d):
    """Every turn of conversations, typed without h, transliterated with the words chosen before as context; errors against what was meant."""
    meant = sentences(spark, d)
    typed = meant.select("sent", "pos", "word", F.expr(STYLE_EXPRESSIONS["no_h"].replace("{w}", "word").replace("{1}", "$1")).alias("roman"))
    qs = stored(with_keys(typed.select("roman").distinct(), "roman").withColumn("q", F.col("roman")), "typed-words")
    p = pairs(spark, d)
    told = stored(L.followers(p).select("prev", "word", "count").join(L.pair_totals(p), "prev"), "followed")
    made = []
    for part in in_parts(qs, "roman", SPELLINGS):
        c = R.candidates(part, keyed_words(spark, d), romans(spark, d), completions(spark, d), key_indexes=key_indexes(spark, d))
        made.append(R.choices(c, TUNED_WEIGHTS, told))
    firsts, chosen = (reduce(DataFrame.unionByName, x) for x in zip(*made))
    turns = table(spark, d, "conversations")
    n = max(1, -(-(turns.agg(F.sum(F.length("text"))).first()[0] or 0) // CHARACTERS))
    parts = [typed.where(F.pmod(F.xxhash64("sent"), F.lit(n)) == i).withColumn("core", F.col("roman")) for i in range(n)]
    out = reduce(DataFrame.unionByName, [stored(R.walked(x, firsts, chosen), "walked") for x in parts])
    said = turns.select(sent_of(), F.transform(ascii_tokens("text"), lambda w, i: F.struct(i.alias("pos"), F.lower(w).alias("word"))).alias("w"))
    gold = said.groupBy("sent").agg(F.transform(F.array_sort(F.flatten(F.collect_list("w"))), lambda x: x["word"]).alias("gold"))
    return out.join(gold, "sent").select("sent", F.array_join("words", " ").alias("output"), M.word_errors("words", "gold").alias("errors"), F.size("gold").alias("n_words"))


@query()
def stress_random_styles(spark, d):
    """All eleven habits over the benchmark's words, drawn as CPython's generator does from seed 13 for each word list."""
    from ..operators.stress import random_variants

    w = table(spark, d, "benchmark").select("item_id", ascii_tokens("text").alias("words"))
    return random_variants(w, "item_id", "words", 13)


EMB = "SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings"


@query(f"""WITH e AS ({EMB}), s AS (SELECT a.vec_id AS q, b.vec_id AS item, round(list_sum(list_transform(range(1, 65), lambda i: a.v[i] * b.v[i])), 6) AS score FROM e a JOIN e b ON a.vec_id % 20 = 0 WHERE a.vec_id <> b.vec_id)
  SELECT q, item, round(score, 4) AS score, rank::BIGINT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, item) AS rank FROM s) WHERE rank <= 10""")
def dense_top_k(spark, d):
    e = table(spark, d, "embeddings")
    qs = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv"))
    found = S.dense_top_k(qs, e.select(F.col("vec_id").alias("item"), F.col("embedding").alias("v")), 11).where("q <> item")
    order = Window.partitionBy("q").orderBy("rank")
    return found.withColumn("rank", F.row_number().over(order).cast("bigint")).where("rank <= 10").select("q", "item", F.round("score", 4).alias("score"), "rank")


@query(ORACLE_SQL["dense_top_k"])
def short_top_k(spark, d):
    """dense_top_k with vectors in eight bits and exact products of what bounds cannot rule out."""
    e = table(spark, d, "embeddings")
    qs = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv"))
    found = S.short_top_k(qs, e.select(F.col("vec_id").alias("item"), F.col("embedding").alias("v")), 11).where("q <> item")
    order = Window.partitionBy("q").orderBy("rank")
    return found.withColumn("rank", F.row_number().over(order).cast("bigint")).where("rank <= 10").select("q", "item", F.round("score", 4).alias("score"), "rank")


@query(f"WITH {VALUES}, a AS (SELECT event_type, round(avg(value), 6) AS mean FROM events WHERE value IS NOT NULL GROUP BY event_type) SELECT v.event_type, mean, " + ", ".join(f"round(v[greatest(1, least(n, round_even({p} / 100.0 * n + 0.5, 0)::BIGINT))], 6) AS p{p}" for p in (50, 95, 99)) + " FROM v JOIN a ON v.event_type = a.event_type")
def latency_summary(spark, d):
    e = table(spark, d, "events")
    mean = e.where("value IS NOT NULL").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"))
    return mean.join(_percentiles(spark, d, M.index_eval, (50, 95, 99)), "event_type")


@query()
def tuned_weights(spark, d):
    """All weights of the search by coordinate ascent to its end: a job for each grid, over the stored candidates; the score is the share of right first choices."""
    # stored with a query's candidates together: a grid's job then exchanges a row for each query and setting only
    c = _candidates(spark, d).drop("lex_score").hint("merge").join(queries(spark, d).select("q", "gold"), "q")
    c = stored(E.leading(c), "tuned")

    def shares(settings):
        found = {r.setting: r.hits / r.n for r in E.weight_hits(c, settings).collect()}
        return [found.get(i, 0.0) for i in range(len(settings))]

    best, share = E.coordinate_ascent(shares, TUNED_WEIGHTS, SEARCHED)
    return spark.createDataFrame([(n, float(w), round(share, 6)) for n, w in sorted(best.items())], "name string, weight double, share double")


@query(f"""WITH e AS ({EMB}), s AS (SELECT label, vec_id, list_sum(v) AS score FROM e), m AS (SELECT *, max(score) OVER (PARTITION BY label) AS m FROM s)
  SELECT label, vec_id, round(score - m - ln(sum(exp(score - m)) OVER (PARTITION BY label)), 5) AS logp FROM m""")
def softmax_scores(spark, d):
    e = table(spark, d, "embeddings").select("label", "vec_id", F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")).alias("score"))
    return S.log_softmax(e, ["label"]).select("label", "vec_id", F.round("logp", 5).alias("logp"))


@query(f"""WITH {CAND}, rk AS (SELECT q, word, row_number() OVER (PARTITION BY q ORDER BY score DESC, word) AS rank FROM (SELECT q, word, round({SCORE_SQL}, 6) AS score FROM cand)),
  {sql_key('coarse', 'words', out='ka')}, x AS (SELECT qs.q, g.rank, kf1.key = kg.key AS same FROM qs LEFT JOIN (SELECT * FROM rk WHERE rank <= 50) g ON g.q = qs.q AND g.word = qs.gold LEFT JOIN (SELECT q, word FROM rk WHERE rank = 1) f ON f.q = qs.q
    LEFT JOIN ka kf1 ON kf1.word = f.word LEFT JOIN ka kg ON kg.word = qs.gold)
  SELECT count(*)::BIGINT AS n, {', '.join(f'count(*) FILTER (rank <= {k})::BIGINT AS within{k}' for k in (1, 3, 5, 10, 50))}, count(*) FILTER (rank IS NULL)::BIGINT AS absent,
  count(*) FILTER ((rank IS NULL OR rank > 1) AND coalesce(same, false))::BIGINT AS same_key, count(*) FILTER ((rank IS NULL OR rank > 1) AND NOT coalesce(same, false))::BIGINT AS other_word FROM x""")
def context_eval(spark, d):
    return E.context_eval(queries(spark, d), _ranked(spark, d, 50), keyed_words(spark, d).select("word", F.col("coarse").alias("key")))
