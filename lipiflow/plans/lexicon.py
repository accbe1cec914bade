"""Queries over the lexicon tables, retrieval and ranking."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import scores
from ..functions.text import ascii_tokens, is_latin_only, normalize_roman
from ..operators import lexicon as L, retrieve as R
from ..sources.store import built_once
from .standins import QUERY_SQL, ROMANS, SENT, STYLE_EXPRESSIONS, TOK, WORDS, completions, key_indexes, keyed_words, queries, register, romans, sentences, sql_key, sql_style, table, tokens, words

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


@query("""SELECT form, count(*)::BIGINT AS n, count(*) FILTER (regexp_full_match(raw, '[A-Za-z'']+'))::BIGINT AS n_latin FROM
  (SELECT raw, regexp_replace(lower(replace(replace(raw, 'ß', 'ss'), 'ẞ', 'ss')), '[^a-z0-9'']', '', 'g') AS form FROM (SELECT unnest(string_split(text, ' ')) AS raw FROM documents)) GROUP BY form""")
def norm_roman_tokens(spark, d):
    raw = table(spark, d, "documents").select(F.explode(F.split("text", " ", -1)).alias("raw"))
    return raw.groupBy(normalize_roman("raw").alias("form")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(is_latin_only("raw"), 1)).alias("n_latin"))


def _keys(spark, d, level):
    return keyed_words(spark, d).select("word", F.col(level).alias("key"))


@query(f"WITH {TOK}, {sql_key('coarse', 'tok')} SELECT word, key FROM keyed")
def phonetic_key_coarse(spark, d):
    return _keys(spark, d, "coarse")


@query(f"WITH {TOK}, {sql_key('fine', 'tok')} SELECT word, key FROM keyed")
def phonetic_key_fine(spark, d):
    return _keys(spark, d, "fine")


@query(f"WITH {TOK} SELECT word, surface, count(*)::BIGINT AS n FROM tok GROUP BY word, surface")
def surface_counts(spark, d):
    return L.surface_counts(tokens(spark, d)).select("word", "surface", "n")


@query(f"""WITH {TOK}, c AS (SELECT word, surface, count(*) AS n, min(struct_pack(d := doc_id, p := pos)) AS first FROM tok GROUP BY word, surface)
  SELECT word, surface AS best FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY n DESC, first) AS r FROM c) WHERE r = 1""")
def best_surface(spark, d):
    return L.best_surface(L.surface_counts(tokens(spark, d)))


@query(f"""WITH {TOK}, p AS (SELECT word, surface, CASE WHEN lang = 'en' THEN 3 WHEN lang = 'fr' THEN 2 ELSE 1 END AS place, doc_id, pos FROM tok),
  c AS (SELECT word, surface, place, count(*) AS n, min(struct_pack(d := doc_id, p := pos)) AS first FROM p GROUP BY ALL)
  SELECT word, surface AS display FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY place, n DESC, first) AS r FROM c) WHERE r = 1""")
def display_words(spark, d):
    return L.display_words(tokens(spark, d), register())


@query(f"WITH {WORDS} SELECT word, wiki, subs, chat, score FROM words")
def unigrams_by_register(spark, d):
    return words(spark, d)


@query(f"WITH {WORDS} SELECT word, round(ln((score + 0.5) / t), 6) AS logp FROM words, total")
def unigram_logp(spark, d):
    w = words(spark, d)
    return w.crossJoin(F.broadcast(L.normaliser(w))).select("word", F.round(scores.unigram_logp("score", "total"), 6).alias("logp"))


@query(f"WITH {WORDS} SELECT word, wiki, subs, chat FROM words WHERE wiki >= 2 OR subs > 0 OR chat > 0")
def lexicon_membership(spark, d):
    return L.membership(words(spark, d)).select("word", "wiki", "subs", "chat")


@query("""WITH l AS (SELECT doc_id, lower(trim(unnest(string_split(text, E'\\n')))) AS line FROM documents),
  h AS (SELECT DISTINCT lower(trim(unnest(string_split(text, E'\\n')))) AS line FROM benchmark)
  SELECT doc_id, count(*)::BIGINT AS n_kept FROM l WHERE line NOT IN (SELECT line FROM h) GROUP BY doc_id""")
def heldout_antijoin(spark, d):
    lines = lambda t: F.explode(F.split("text", "\n", -1))
    rows = table(spark, d, "documents").select("doc_id", lines("text").alias("line")).withColumn("line", F.lower(F.trim("line")))
    held = table(spark, d, "benchmark").select(lines("text").alias("line")).select(F.lower(F.trim("line")).alias("line")).distinct()
    return L.without_held_out(rows, held, "line").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_kept"))


@query(f"WITH {TOK}, {ROMANS} SELECT roman, word, cnt AS count, src::BIGINT AS src FROM romans")
def romanizations(spark, d):
    return romans(spark, d).select("roman", "word", "count", F.col("src").cast("bigint").alias("src"))


@query(f"WITH {TOK}, {ROMANS} SELECT roman, word, row_number() OVER (PARTITION BY roman ORDER BY cnt DESC, word)::BIGINT AS rank FROM romans")
def romans_source_order(spark, d):
    return L.source_ranked(romans(spark, d)).select("roman", "word", F.col("rank").cast("bigint").alias("rank"))


@query(f"WITH {WORDS}, {sql_key('coarse', 'words')} SELECT key, w.word, score, row_number() OVER (PARTITION BY key ORDER BY score DESC, w.word)::BIGINT AS rank FROM words w JOIN keyed USING (word) WHERE key <> ''")
def key_index(spark, d):
    order = Window.partitionBy("key").orderBy(F.desc("score"), "word")
    return L.key_index(keyed_words(spark, d)).select("key", "word", "score", F.row_number().over(order).cast("bigint").alias("rank"))


@query(f"""WITH {WORDS}, {ROMANS}, p AS (SELECT left(roman, i) AS prefix, word, max(cnt * 10000 + least(coalesce(score, 0), 9999)) AS score FROM
    (SELECT roman, r.word, cnt, score, unnest(range(1, least(length(roman), 3) + 1)) AS i FROM romans r LEFT JOIN words w ON r.word = w.word) GROUP BY 1, 2)
  SELECT prefix, word, score::BIGINT AS score, rank::BIGINT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY score DESC, word) AS rank FROM p) WHERE rank <= 24""")
def prefix_top24(spark, d):
    spelled = romans(spark, d).join(words(spark, d).select("word", "score"), "word", "left")
    entries = spelled.withColumn("_s", F.col("count") * 10000 + F.least(F.coalesce("score", F.lit(0)), F.lit(9999)))
    return L.prefix_top(entries, "roman", "_s", L.ROMAN_PREFIX_CHARS).select("prefix", "word", "score", F.col("rank").cast("bigint").alias("rank"))


@query(f"""WITH {WORDS}, q AS (SELECT DISTINCT left(lower(w), 4) AS prefix FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM benchmark) WHERE length(w) >= 4)
  SELECT prefix, word, score, rank::BIGINT AS rank FROM (SELECT prefix, word, score, row_number() OVER (PARTITION BY prefix ORDER BY score DESC, word) AS rank FROM q JOIN words ON starts_with(word, prefix)) WHERE rank <= 30""")
def prefix_lookup(spark, d):
    w = table(spark, d, "benchmark").select(F.explode(ascii_tokens("text")).alias("w")).where(F.length("w") >= 4)
    q = w.select(F.lower(F.substring("w", 1, 4)).alias("prefix")).distinct()
    # words are cut to the best of each prefix before any query meets them
    order = Window.partitionBy("prefix").orderBy(F.desc("score"), "word")
    top = words(spark, d).where(F.length("word") >= 4).select(F.substring("word", 1, 4).alias("prefix"), "word", "score")
    top = top.withColumn("rank", F.row_number().over(order).cast("bigint")).where("rank <= 30")
    return q.join(top, "prefix").select("prefix", "word", "score", "rank")


@query(f"""WITH {WORDS}, {QUERY_SQL}, {sql_key('coarse', 'words')}, kq AS (SELECT roman AS word FROM qs), {sql_key('coarse', 'kq', out='keyedq')},
  best AS (SELECT key, word, score FROM (SELECT key, w.word, score, row_number() OVER (PARTITION BY key ORDER BY score DESC, w.word DESC) AS r FROM words w JOIN keyed USING (word) WHERE key <> '') WHERE r <= 30),
  s AS (SELECT q, roman, best.word, round(0.5 * ln((best.score + 0.5) / t) + 0.6, 6) AS score FROM qs JOIN keyedq ON qs.roman = keyedq.word JOIN best USING (key), total)
  SELECT roman, q AS gold, word, score, rank::BIGINT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, word) AS rank FROM s) WHERE rank <= 5""")
def suggest_by_key(spark, d):
    w, qs = words(spark, d), queries(spark, d)
    found = qs.select("q", "roman", F.col("coarse").alias("key")).join(key_indexes(spark, d)["coarse"][0], "key").select("q", "roman", "word", "score")
    s = F.round(scores.TUNED_WEIGHTS["unigram"] * scores.unigram_logp("score", "total") + scores.TUNED_WEIGHTS["key_coarse"], 6)
    order = Window.partitionBy("q").orderBy(F.desc("score"), "word")
    top = found.crossJoin(F.broadcast(L.normaliser(w))).withColumn("score", s).withColumn("rank", F.row_number().over(order).cast("bigint")).where("rank <= 5")
    return top.select("roman", F.col("q").alias("gold"), "word", "score", "rank")


# words of longer keys, by every key that theirs begins with
LONGER = lambda out, keys: f"""{out} AS (SELECT key, word, gap FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, word DESC) AS r FROM
  (SELECT left(key, i) AS key, word, score, length(key) - i AS gap FROM (SELECT key, w.word, score, unnest(range(1, length(key))) AS i FROM words w JOIN {keys} USING (word)))) WHERE r <= 15)"""  # noqa: E731
# the channels of R.candidates, written out
CAND = f"""{WORDS}, {ROMANS}, {QUERY_SQL}, kq AS (SELECT roman AS word FROM qs),
  {sql_key('coarse', 'words', out='kc')}, {sql_key('coarse', 'kq', out='kcq')}, {sql_key('fine', 'words', out='kf')}, {sql_key('fine', 'kq', out='kfq')},
  tc AS (SELECT key, word FROM (SELECT key, w.word, row_number() OVER (PARTITION BY key ORDER BY score DESC, w.word DESC) AS r FROM words w JOIN kc USING (word) WHERE key <> '') WHERE r <= 30),
  tf AS (SELECT key, word FROM (SELECT key, w.word, row_number() OVER (PARTITION BY key ORDER BY score DESC, w.word DESC) AS r FROM words w JOIN kf USING (word) WHERE key <> '') WHERE r <= 30),
  {LONGER('lc', 'kc')}, {LONGER('lf', 'kf')},
  cp AS (SELECT left(roman, i) AS prefix, word, cnt, cnt * 10000 + least(coalesce(score, 0), 9999) AS s, length(roman) - i AS gap FROM
    (SELECT roman, r.word, cnt, score, unnest(range(1, length(roman))) AS i FROM romans r LEFT JOIN words w ON r.word = w.word)),
  tp AS (SELECT prefix, word, sum(cnt) AS rp, min(gap) AS gap FROM (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY s DESC, word DESC, cnt DESC, gap DESC) AS r FROM cp) WHERE r <= 30 GROUP BY 1, 2),
  ch AS (SELECT q, word, cnt AS re, 0 AS rp, NULL AS gap, false AS kfi, false AS kco, false AS kfp, false AS kcp FROM qs JOIN romans USING (roman)
    UNION ALL SELECT q, tp.word, 0, rp, gap, false, false, false, false FROM qs JOIN tp ON roman = prefix
    UNION ALL SELECT q, tf.word, 0, 0, NULL, true, false, false, false FROM qs JOIN kfq ON roman = kfq.word JOIN tf USING (key)
    UNION ALL SELECT q, tc.word, 0, 0, NULL, false, true, false, false FROM qs JOIN kcq ON roman = kcq.word JOIN tc USING (key)
    UNION ALL SELECT q, lf.word, 0, 0, gap, false, false, true, false FROM qs JOIN kfq ON roman = kfq.word JOIN lf USING (key)
    UNION ALL SELECT q, lc.word, 0, 0, gap, false, false, false, true FROM qs JOIN kcq ON roman = kcq.word JOIN lc USING (key)),
  m AS (SELECT q, word, max(re)::BIGINT AS rom_exact, max(rp)::BIGINT AS rp, min(gap) AS gap, bool_or(kfi) AS key_fine, bool_or(kco) AS key_coarse, bool_or(kfp) AS key_fine_prefix, bool_or(kcp) AS key_coarse_prefix FROM ch GROUP BY q, word),
  cand AS (SELECT q, m.word, rom_exact, CASE WHEN rom_exact > 0 THEN 0 ELSE rp END AS rom_prefix, CASE WHEN rom_exact > 0 THEN 0 ELSE coalesce(gap, 0) END::BIGINT AS gap, key_fine, key_coarse, key_fine_prefix, key_coarse_prefix,
    ln((coalesce(score, 0) + 0.5) / t) AS uni FROM m LEFT JOIN words ON m.word = words.word, total)"""
_W = scores.TUNED_WEIGHTS


def score_sql(w):
    return f"""({w['unigram']} * uni + CASE WHEN rom_exact > 0 THEN {w['rom_exact']} + {w['rom_exact_log']} * ln(1.0 + rom_exact) ELSE 0 END
  + CASE WHEN rom_prefix > 0 AND rom_exact = 0 THEN {w['rom_prefix']} * ln(1.0 + rom_prefix) ELSE 0 END + CASE WHEN key_fine THEN {w['key_fine']} WHEN key_coarse THEN {w['key_coarse']} WHEN key_fine_prefix OR key_coarse_prefix THEN {w['key_prefix']} ELSE 0 END
  - 15 * {w['xlit_logp']} + CASE WHEN gap > 0 AND rom_exact = 0 THEN {w['gap']} * gap ELSE 0 END)"""


SCORE_SQL = score_sql(_W)


def _candidates(spark, d):
    make = lambda: R.candidates(queries(spark, d), keyed_words(spark, d), romans(spark, d), completions(spark, d), key_indexes=key_indexes(spark, d))
    return built_once(spark, d, "candidates", make)


@query(f"WITH {CAND} SELECT q, word, rom_exact, rom_prefix, gap, key_fine, key_coarse, key_fine_prefix, key_coarse_prefix, round(uni, 6) AS uni FROM cand")
def candidates(spark, d):
    c = _candidates(spark, d)
    return c.select("q", "word", "rom_exact", "rom_prefix", F.col("gap").cast("bigint").alias("gap"), "key_fine", "key_coarse", "key_fine_prefix", "key_coarse_prefix", F.round("uni", 6).alias("uni"))


@query(f"WITH {CAND} SELECT q, word, score, rank::BIGINT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, word) AS rank FROM (SELECT q, word, round({SCORE_SQL}, 6) AS score FROM cand)) WHERE rank <= 5")
def suggest_ranked(spark, d):
    return R.ranked(_candidates(spark, d), scores.TUNED_WEIGHTS, 5).select("q", "word", "score", F.col("rank").cast("bigint").alias("rank"))


@query(f"""WITH {CAND}, s AS (SELECT q, word, rom_exact, rom_prefix, key_fine, key_coarse, key_fine_prefix, key_coarse_prefix, max(rom_exact) OVER (PARTITION BY q) AS best, round({SCORE_SQL} + {_W['rom_exact_fast']} * ln(1.0 + rom_exact), 6) AS score FROM cand)
  SELECT q, word, score, best >= 2 AS strong, rank::BIGINT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY best >= 5 AND rom_exact = 0 AND rom_prefix > 0, score DESC, word) AS rank FROM s
  WHERE key_fine OR key_coarse OR key_fine_prefix OR key_coarse_prefix OR rom_prefix > 0 OR rom_exact >= 2) WHERE rank <= 5""")
def fast_suggest(spark, d):
    return R.fast_ranked(_candidates(spark, d), scores.TUNED_WEIGHTS, 5).select("q", "word", "score", "strong", F.col("rank").cast("bigint").alias("rank"))


@query(f"""WITH {CAND} SELECT q, word, prerank::BIGINT AS prerank FROM (SELECT q, word, row_number() OVER (PARTITION BY q ORDER BY round(uni + CASE WHEN rom_exact > 0 THEN 3.0 ELSE 0 END + 0.5 * ln(1.0 + rom_exact)
  + CASE WHEN key_fine THEN 1.5 ELSE 0 END + CASE WHEN key_coarse THEN 0.8 ELSE 0 END - CASE WHEN (rom_prefix > 0 OR key_fine_prefix OR key_coarse_prefix) AND rom_exact = 0 THEN 1 ELSE 0 END, 6) DESC, word) AS prerank FROM cand) WHERE prerank <= 16""")
def model_prescore(spark, d):
    return R.for_model(_candidates(spark, d)).select("q", "word", F.col("prerank").cast("bigint").alias("prerank"))


PAIRS = f"""{SENT}, known AS (SELECT word FROM sent GROUP BY word HAVING count(*) >= 2),
  seq AS (SELECT sent, role, pos, sent.word, known.word AS kept, CASE WHEN pos = 0 THEN '<s>' ELSE lag(known.word) OVER (PARTITION BY sent ORDER BY pos) END AS prev FROM sent LEFT JOIN known ON sent.word = known.word),
  pairs AS (SELECT prev, word, count(*) AS cnt, min(struct_pack(s := sent, p := pos)) AS first FROM seq WHERE prev IS NOT NULL AND kept IS NOT NULL GROUP BY prev, word),
  totals AS (SELECT prev, sum(cnt)::BIGINT AS total FROM pairs GROUP BY prev),
  fol AS (SELECT prev, word, cnt, rank FROM (SELECT *, row_number() OVER (PARTITION BY prev ORDER BY cnt DESC, first) AS rank FROM pairs) WHERE rank <= 60 AND cnt >= 2)"""


def seen(spark, d):
    """sent, role, pos, word, kept, prev of the words of conversations that follow a known word or begin a turn, and are known."""

    def make():
        s = sentences(spark, d)
        return L.with_previous(s, s.groupBy("word").count().where("count >= 2")).where("prev IS NOT NULL AND kept IS NOT NULL")

    return built_once(spark, d, "seen", make)


def pairs(spark, d):
    return built_once(spark, d, "pairs", lambda: L.pair_counts(seen(spark, d)))


_SEL = f"{sql_style('no_h', 'word')}"
#: All channels and the context: selections and own words are a user's turns, the rule writes f as ph, the benchmark's words are the spelling list.
EVIDENCE = f"""{CAND}, {PAIRS}, own AS (SELECT word, count(*) AS n FROM sent WHERE role = 'user' GROUP BY word),
  sel AS (SELECT roman, word, n, n / sum(n) OVER (PARTITION BY roman) AS share FROM (SELECT {_SEL} AS roman, word, n FROM own)),
  spl AS (SELECT DISTINCT lower(w) AS word FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM benchmark)),
  ev AS (SELECT q, word, rom_exact, rp, gap, key_fine, key_coarse, key_fine_prefix, key_coarse_prefix, false AS avro, 0 AS ps, 0 AS sh, false AS is_latin FROM m
    UNION ALL SELECT q, replace(roman, 'f', 'ph'), 0, 0, NULL, false, false, false, false, true, 0, 0, false FROM qs WHERE replace(roman, 'f', 'ph') <> roman
    UNION ALL SELECT q, sel.word, 0, 0, NULL, false, false, false, false, false, n, share, sel.word = roman FROM qs JOIN sel USING (roman)),
  e AS (SELECT q, word, max(rom_exact) AS rom_exact, max(rp) AS rp, min(gap) AS gap, bool_or(key_fine) AS key_fine, bool_or(key_coarse) AS key_coarse, bool_or(key_fine_prefix OR key_coarse_prefix) AS longer,
    bool_or(avro) AS avro, max(ps) AS ps, max(sh) AS sh, bool_or(is_latin) AS is_latin FROM ev GROUP BY q, word),
  x AS (SELECT e.*, CASE WHEN length(q) % 2 = 0 THEN '<s>' ELSE 'the' END AS prev, score IS NOT NULL AS known, spl.word IS NOT NULL AS spelled, CASE WHEN is_latin THEN 0 ELSE coalesce(own.n, 0) END AS pw, ln((coalesce(score, 0) + 0.5) / t) AS uni
    FROM e LEFT JOIN words ON e.word = words.word LEFT JOIN spl ON e.word = spl.word LEFT JOIN own ON e.word = own.word, total),
  y AS (SELECT x.*, CASE WHEN total IS NULL THEN 0 WHEN cnt > 0 THEN ln(cnt / total) - uni ELSE ln(0.4) END AS context FROM x LEFT JOIN totals ON x.prev = totals.prev LEFT JOIN fol ON x.prev = fol.prev AND x.word = fol.word),
  z AS (SELECT q, word, avro, is_latin, spelled, round(context, 6) AS context, round({_W['personal_sel']} * ln(1.0 + ps) * (0.5 + sh), 6) AS personal, round(CASE WHEN is_latin THEN {_W['latin_base'] + _W['latin']} + {_W['personal_sel']} * ln(1.0 + ps) * (0.5 + sh) ELSE
    {_W['unigram']} * uni + CASE WHEN rom_exact > 0 THEN {_W['rom_exact']} + {_W['rom_exact_log']} * ln(1.0 + rom_exact) ELSE 0 END + CASE WHEN rom_exact = 0 THEN {_W['rom_prefix']} * ln(1.0 + rp) + {_W['gap']} * coalesce(gap, 0) ELSE 0 END
    + CASE WHEN key_fine THEN {_W['key_fine']} WHEN key_coarse THEN {_W['key_coarse']} WHEN longer THEN {_W['key_prefix']} ELSE 0 END - 15 * {_W['xlit_logp']} + CASE WHEN avro THEN {_W['avro']} ELSE 0 END + CASE WHEN spelled THEN {_W['spelled']} ELSE 0 END
    + CASE WHEN known THEN 0 ELSE {_W['oov']} END + CASE WHEN ps > 0 THEN {_W['personal_sel']} * ln(1.0 + ps) * (0.5 + sh) ELSE 0 END + {_W['personal_word']} * ln(1.0 + pw) + {_W['bigram']} * context END, 6) AS score FROM y)"""


@query(f"""WITH {EVIDENCE} SELECT q, word, avro, is_latin, spelled, context, personal, score, rank::BIGINT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, word) AS rank FROM z) WHERE rank <= 8""")
def suggest_with_evidence(spark, d):
    qs, turns, f = queries(spark, d), sentences(spark, d), pairs(spark, d)
    own = turns.where("role = 'user'").groupBy("word").agg(F.count(F.lit(1)).alias("count"))
    chosen = own.select(F.expr(STYLE_EXPRESSIONS["no_h"].replace("{w}", "word").replace("{1}", "$1")).alias("roman"), "word", "count")
    rules = qs.select("roman", F.replace("roman", F.lit("f"), F.lit("ph")).alias("word")).distinct()
    spelling = table(spark, d, "benchmark").select(F.explode(ascii_tokens("text")).alias("w")).select(F.lower("w").alias("word"))
    c = R.candidates(qs, keyed_words(spark, d), romans(spark, d), completions(spark, d), rules, chosen, own, spelling, key_indexes(spark, d))
    before = qs.select("q", F.when(F.length("q") % 2 == 0, L.START).otherwise("the").alias("prev"))
    c = R.with_context(c, before, L.followers(f), L.pair_totals(f))
    personal = F.round(scores.personal_bonus("personal_sel", F.col("personal_share"), _W), 6)
    top = R.ranked(c, _W, 8, context="context")
    return top.select("q", "word", "avro", "is_latin", "spelled", F.round("context", 6).alias("context"), personal.alias("personal"), "score", F.col("rank").cast("bigint").alias("rank"))


@query(f"WITH {PAIRS} SELECT prev, word, cnt AS count, rank::BIGINT AS rank FROM fol")
def bigrams_top60(spark, d):
    return L.followers(pairs(spark, d)).select("prev", "word", "count", F.col("rank").cast("bigint").alias("rank"))


@query(f"WITH {PAIRS} SELECT prev, total FROM totals")
def bigram_totals(spark, d):
    return L.pair_totals(pairs(spark, d))


@query(f"""WITH {WORDS}, {ROMANS} SELECT 'unigrams' AS "table", count(*)::BIGINT AS "rows" FROM words UNION ALL SELECT 'romans', count(*)::BIGINT FROM romans""")
def build_meta(spark, d):
    return L.build_meta(unigrams=words(spark, d), romans=romans(spark, d))
