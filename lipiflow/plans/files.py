"""Queries that write what they derive from the tables in the engine's file formats, read it with its readers, and look at texts and requests."""

from __future__ import annotations

import uuid

from pyspark.sql import Window, functions as F

from ..functions import text as X
from ..functions.scores import TUNED_WEIGHTS
from ..operators import evaluate as E, nextword as N, retrieve as R
from ..sources import readers, writers
from ..sources.store import shared_dir
from ..streaming import telemetry as T
from ..streaming.receipt import chunks, receive
from . import evaluation, usage
from .lexicon import CAND, SCORE_SQL, _candidates
from .standins import ROMANS, TOK, WORDS, queries, romans, table, words
from .usage import LETTERS, SIGNS, SPELLED, spelled

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def _file(spark) -> str:
    return f"{shared_dir(spark)}/lipiflow/files-{uuid.uuid4().hex}"


def _lines(df, line, path):
    df.select(line.alias("value")).write.text(path)
    return path


@query(f"WITH {TOK}, {ROMANS} SELECT word, roman, CASE WHEN word LIKE 'q%' THEN 1 ELSE cnt END::DOUBLE AS count, word LIKE 'q%' AS bad FROM romans WHERE word NOT LIKE 'z%'")
def attestation_file(spark, d):
    """All romanizations as tab-separated lines; counts of words with q can't be read, lines of words with z are short."""
    count = F.when(F.col("word").startswith("q"), "many").otherwise(F.col("count").cast("string"))
    line = F.when(F.col("word").startswith("z"), F.col("word")).otherwise(F.concat_ws("\t", "word", "roman", count))
    return readers.attestations(spark, _lines(romans(spark, d), line, _file(spark)))


@query(f"WITH {WORDS} SELECT CASE WHEN NOT b THEN word END AS word, CASE WHEN NOT b THEN word || '''s' END AS roman, CASE WHEN NOT b THEN 's' || length(word) % 3 END AS source, b AS bad FROM (SELECT word, word LIKE 'z%' AS b FROM words) WHERE b OR length(word) % 3 < 2")
def mined_pair_file(spark, d):
    """All words as mined pairs in JSON lines, of three sources of which two are read; lines of words with z are torn."""
    good = F.to_json(F.struct(F.col("word").alias("native word"), F.concat("word", F.lit("'s")).alias("english word"), F.concat(F.lit("s"), (F.length("word") % 3).cast("string")).alias("source")))
    line = F.when(F.col("word").startswith("z"), F.concat(F.lit('{"native word": "'), "word")).otherwise(good)
    return readers.mined_pairs(spark, _lines(words(spark, d), line, _file(spark)), ["s0", "s1"])


@query(f"WITH {WORDS} SELECT word, score::BIGINT AS count FROM words WHERE word NOT LIKE 'q%'")
def word_count_file(spark, d):
    line = F.when(F.col("word").startswith("q"), F.concat_ws(" ", "word", "score", F.lit("more"))).otherwise(F.concat(F.lit(" "), "word", F.lit("  "), F.col("score").cast("string")))
    return readers.word_counts(spark, _lines(words(spark, d), line, _file(spark)))


@query(f"SELECT roman, chose AS gold, 'telemetry' AS tag FROM ({usage.ORACLE_SQL['shared_misses']})")
def feedback_file(spark, d):
    """Shared misses written for review and read back as feedback."""
    path = _file(spark)
    writers.reviewed_feedback(usage.QUERIES["shared_misses"](spark, d), path)
    return readers.feedback(spark, path).select("roman", "gold", F.get("tags", F.lit(0)).alias("tag"))


@query("SELECT conv_id, turn, role, text FROM conversations")
def log_file(spark, d):
    """Turns appended to a log of JSON lines, by two writers one after the other, and read back."""
    path, t = _file(spark), table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    for part in (0, 1):
        writers.append_log(t.where(F.col("turn") % 2 == part), path)
    return readers.json_lines(spark, path, "conv_id long, turn long, role string, text string")


@query("WITH c AS (SELECT conv_id || '-' || turn AS id, text, role, row_number() OVER (ORDER BY conv_id || '-' || turn) AS r, count(*) OVER () AS n FROM conversations) SELECT id, text AS text_bengali, role AS text_transliterated FROM c WHERE r > n // 2")
def chat_file(spark, d):
    """Turns in a CSV file with quoted line breaks, of which the second half by id is read."""
    path = _file(spark)
    t = table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text").alias("text_bengali"), F.col("role").alias("text_transliterated"))
    t.write.option("header", True).option("quoteAll", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return readers.half_split(readers.chat_sentences(spark, path), "id", first=False)


@query(f"WITH {WORDS} SELECT word, wiki, subs, chat FROM words")
def sorted_word_table(spark, d):
    path = _file(spark)
    writers.sorted_table(words(spark, d), path, "word")
    return spark.read.parquet(path).select("word", "wiki", "subs", "chat")


@query(f"WITH {WORDS}, r AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS i, count(*) OVER () AS n FROM words), s AS (SELECT *, greatest(1, (n + 499) // 500) AS step FROM r) SELECT word FROM s WHERE i % step = 0 AND i < step * 500")
def word_stride(spark, d):
    """Every so many words in their order, 500 at most: a sample by ordinals."""
    return E.stride_sample(words(spark, d).select("word"), 500, "word")


RANKED_GOLDS = f"""{CAND}, rk AS (SELECT q, word, row_number() OVER (PARTITION BY q ORDER BY score DESC, word) AS rank FROM (SELECT q, word, round({SCORE_SQL}, 6) AS score FROM cand)),
  gr AS (SELECT qs.q, gold, rank, 's' || length(gold) % 4 AS source FROM qs LEFT JOIN (SELECT q, word, rank FROM rk WHERE rank <= 5) r ON qs.q = r.q AND qs.gold = r.word)"""


def _ranks(spark, d):
    items = queries(spark, d).select("q", "gold", F.concat(F.lit("s"), (F.length("gold") % 4).cast("string")).alias("source"))
    return E.gold_ranks(items, R.ranked(_candidates(spark, d), TUNED_WEIGHTS, 5).select("q", "word", "rank"))


@query(f"WITH {RANKED_GOLDS} SELECT source, count(*)::BIGINT AS misses FROM gr WHERE rank IS NULL OR rank <> 1 GROUP BY source")
def misses_by_source(spark, d):
    return E.misses_by_source(_ranks(spark, d))


@query(f"WITH {RANKED_GOLDS} SELECT q, gold, source, coalesce(rank, 0)::BIGINT AS rank FROM gr WHERE rank IS NULL OR rank <> 1 ORDER BY q LIMIT 40")
def first_misses(spark, d):
    """A report of the first forty misses; rank 0 is none."""
    return E.first_misses(_ranks(spark, d), 40, "q").select("q", "gold", "source", F.coalesce("rank", F.lit(0)).cast("bigint").alias("rank"))


REQUESTS = """rq AS (SELECT conv_id::VARCHAR AS session, turn AS ts, CASE WHEN role = 'user' THEN 'suggest' ELSE 'learn' END AS op, left(text, 12) AS roman FROM conversations)"""


def _requests(spark, d):
    """Each turn as a raw request; those of users name no op."""
    t = table(spark, d, "conversations").withColumn("op", F.when(F.col("role") != "user", F.lit("learn"))).withColumn("roman", F.substring("text", 1, 12))
    raw = t.select(F.to_json(F.struct("op", "roman", F.col("conv_id").cast("string").alias("session"), F.col("turn").cast("int").alias("index"))).alias("value"))
    return readers.requests(raw).withColumnRenamed("index", "ts")


@query(f"WITH {REQUESTS} SELECT session, max(ts)::INT AS ts, arg_max(op, ts) AS op, arg_max(roman, ts) AS roman FROM rq GROUP BY session")
def latest_requests(spark, d):
    return T.latest_requests(_requests(spark, d)).select("session", "ts", "op", "roman")


@query(f"WITH {REQUESTS} SELECT op, session, count(*)::BIGINT AS n, CASE WHEN op = 'suggest' THEN max(length(roman)) ELSE min(length(roman)) END::INT AS letters FROM rq GROUP BY op, session")
def dispatched_requests(spark, d):
    """Requests by op, each op with a handler of its own."""
    by = lambda f: lambda r: r.groupBy("op", "session").agg(F.count(F.lit(1)).alias("n"), f(F.length("roman")).alias("letters"))
    out = T.dispatched(_requests(spark, d), {"suggest": by(F.max), "learn": by(F.min)})
    return out["suggest"].union(out["learn"])


@query(f"""WITH {CAND}, rk AS (SELECT q, word, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, word) AS rank, sum(exp(score)) OVER (PARTITION BY q) AS every, max(rom_exact) OVER (PARTITION BY q) AS best FROM (SELECT q, word, rom_exact, round({SCORE_SQL}, 6) AS score FROM cand)),
  a AS (SELECT one.q, two.word, one.word AS first_word, round(exp(two.score) / two.every, 6) AS share, one.best FROM rk one LEFT JOIN rk two ON two.q = one.q AND two.rank = 2 WHERE one.rank = 1)
  SELECT a.q, CASE WHEN share >= 0.2 AND word <> first_word AND word <> roman THEN word END AS guess, best % 2 = 0 AND NOT (best >= 2) AS refine FROM a JOIN qs ON qs.q = a.q""")
def guesses(spark, d):
    """For each query the second choice as a guess, where its share is worth it, and whether an answer is worth refining."""
    c = _candidates(spark, d)
    own = Window.partitionBy("q")
    r = R.ranked(c.withColumn("best", F.max("rom_exact").over(own)), TUNED_WEIGHTS, 10_000).withColumn("every", F.sum(F.exp("score")).over(own))
    one = r.where("rank = 1").select("q", F.col("word").alias("first_word"), "best")
    two = r.where("rank = 2").select("q", "word", F.round(F.exp("score") / F.col("every"), 6).alias("share"))
    rows = one.join(two, "q", "left").join(queries(spark, d).select("q", "roman"), "q")
    return rows.select("q", N.guess_pick(F.col("share"), F.col("word"), F.col("first_word"), F.col("roman"), 0.2).alias("guess"), N.worth_refining(F.col("best") % 2 == 0, F.col("best") >= 2).alias("refine"))


@query(f"""WITH c AS (SELECT conv_id, turn, list_transform(regexp_extract_all(text, '[A-Za-z]+'), lambda x: lower(x)) AS r FROM conversations), z AS (SELECT conv_id, turn, r, list_transform(CASE WHEN turn % 3 = 0 THEN r[1:-2] ELSE r END, lambda x: translate(x, '{LETTERS}', '{SIGNS}')) AS b FROM c),
  p AS (SELECT conv_id, turn, b[i] AS word, r[i] AS roman, i - 1 AS pos FROM (SELECT *, unnest(range(1, len(r) + 1)) AS i FROM z WHERE len(r) = len(b)))
  SELECT conv_id, turn, word, roman, pos::INT AS pos FROM p WHERE regexp_matches(word, '[{X.BENGALI}]')""")
def aligned_chat_pairs(spark, d):
    """Turns word for word, in Latin letters and in Bengali signs; every third turn lacks a word on one side."""
    t = table(spark, d, "conversations").select("conv_id", "turn", F.transform(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), F.lower).alias("r"))
    kept = F.when(F.col("turn") % 3 == 0, F.slice("r", F.lit(1), F.greatest(F.size("r") - 1, F.lit(0)))).otherwise(F.col("r"))
    return readers.aligned_pairs(t.withColumn("b", F.transform(kept, lambda x: F.translate(x, LETTERS, SIGNS))), "b", "r")


@query(f"""WITH {SPELLED}, t AS (SELECT word, translate(word, '{LETTERS}', '{SIGNS}') AS t FROM w)
  SELECT word, regexp_matches(t, '[{X.BENGALI}]') AS bengali, regexp_matches(lower(t || upper(left(word, length(word) % 2))), '[a-z]') AS romanish, regexp_replace(regexp_replace('« ' || t || word || '!»', '^[^A-Za-z{X.BENGALI}{X.ZWNJ}{X.ZWJ}]+', ''), '[^A-Za-z{X.BENGALI}{X.ZWNJ}{X.ZWJ}]+$', '') AS bare,
  NOT contains(word, 'qu') AND length(word) <= 12 AS safe FROM t""")
def script_predicates(spark, d):
    """Words in Bengali signs, in part with Latin letters; as part of a path, qu becomes a slash and long words too long."""
    part = F.when(F.length("word") > 12, F.repeat("word", 20)).otherwise(F.regexp_replace("word", "qu", "/"))
    mixed, framed = F.concat("t", F.upper(F.substring(F.col("word"), F.lit(1), F.length("word") % 2))), F.concat(F.lit("« "), "t", "word", F.lit("!»"))
    return spelled(spark, d).select("word", X.has_bengali("t").alias("bengali"), X.is_romanish(mixed).alias("romanish"), X.strip_punct(framed).alias("bare"), X.is_safe_component(part).alias("safe"))


NAMES_SQL = "[" + ", ".join(f"'{n}'" for n in X.LETTER_NAMES) + "]"


@query(f"""WITH RECURSIVE {SPELLED}, n AS (SELECT {NAMES_SQL} AS names), s AS (SELECT word, array_to_string(list_transform(string_split(word, ''), lambda c: names[ascii(c) - 96]), '') || CASE WHEN length(word) % 5 = 4 THEN 'ক' ELSE '' END AS t FROM w, n WHERE length(word) <= 5),
  walk(word, rest, taken) AS (SELECT word, t, 0 FROM s UNION ALL SELECT word, substr(rest, length(f) + 1), taken + 1 FROM (SELECT word, rest, taken, list_filter(names, lambda x: starts_with(rest, x))[1] AS f FROM walk, n) WHERE f IS NOT NULL)
  SELECT word, bool_or(rest = '' AND taken >= 2) AS acronym FROM walk GROUP BY word""")
def acronyms(spark, d):
    """Short words written as the names of their letters, some with another letter behind."""
    names = F.array(*map(F.lit, X.LETTER_NAMES))
    short = spelled(spark, d).where(F.length("word") <= 5)
    t = F.array_join(F.transform(F.split("word", ""), lambda c: F.coalesce(F.try_element_at(names, F.ascii(c) - 96), F.lit(""))), "")
    return short.select("word", X.looks_like_acronym(F.concat(t, F.when(F.length("word") % 5 == 4, "ক").otherwise(""))).alias("acronym"))


@query(f"""WITH k AS (SELECT unnest(regexp_extract_all(translate(lower(text), '{LETTERS}', '{SIGNS}'), '[{X.BENGALI}{X.ZWNJ}{X.ZWJ}]+')) AS token FROM conversations) SELECT token, count(*)::BIGINT AS n FROM k WHERE NOT regexp_full_match(token, '[{X.MARKS_OR_DIGITS}]+') GROUP BY token""")
def bangla_token_counts(spark, d):
    t = table(spark, d, "conversations").select(F.explode(X.bangla_tokens(F.translate(F.lower("text"), LETTERS, SIGNS))).alias("token"))
    return t.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT p_partkey, '{"p_partkey": ' || p_partkey || ', "p_name": "' || p_name || '", "p_size": ' || p_size || '}' AS line FROM part""")
def spaced_lines(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_size")
    return p.select("p_partkey", writers.spaced_json(p).alias("line"))


@query(f"WITH {CAND} SELECT q AS roman, word, rom_exact::BIGINT AS rom_exact, rom_prefix::BIGINT AS rom_prefix, gap::BIGINT AS gap, key_fine, key_coarse_prefix, round(uni, 6) AS uni FROM cand WHERE q IN (SELECT q FROM qs)")
def feature_cache(spark, d):
    """All candidates written as the tuner's cache, an item a line, and read back as a row for each candidate."""
    path = _file(spark)
    c = _candidates(spark, d)
    names = {"word": "word", "uni": "uni", **{x: x for x in ("rom_exact", "rom_prefix", "key_fine", "key_coarse", "key_fine_prefix", "key_coarse_prefix", "gap", "in_lexicon")}}
    items = queries(spark, d).select("q", F.lit("all").alias("set"), F.col("q").alias("roman"), F.array("gold").alias("golds"), F.col("weight").cast("double").alias("weight"))
    writers.save_features(c.select("q", *names), items, path)
    read = readers.features(spark, path)
    whole = [F.col(x).cast("bigint").alias(x) for x in ("rom_exact", "rom_prefix", "gap")]
    return read.select("roman", "word", *whole, "key_fine", "key_coarse_prefix", F.round("uni", 6).alias("uni"))


DELIVERED = """dl AS (SELECT printf('%08x', conv_id) AS install, turn AS seq, role, length(text) AS n FROM conversations)"""


@query(f"""WITH {DELIVERED}, ok AS (SELECT * FROM dl WHERE seq % 7 <> 3) SELECT install, 'events' AS stream, seq::BIGINT AS seq, '{{"role": "' || role || '"}}' AS line FROM ok
  UNION ALL SELECT install, 'events', seq::BIGINT, '{{"n": ' || n || '}}' FROM ok""")
def received_chunks(spark, d):
    """Turns as deliveries of two lines, each delivered twice, every seventh malformed: what a stream of them leaves in the store."""
    c = spark.readStream.schema(table(spark, d, "conversations").schema).parquet(f"{d}/conversations.parque[t]")
    lines = F.concat(F.lit('{"role": "'), "role", F.lit('"}\n\n{"n": '), F.length("text").cast("string"), F.lit("}\n"))
    body = F.when(F.col("turn") % 7 == 3, F.lit("[1]")).otherwise(lines)
    one = c.select(F.lpad(F.lower(F.hex("conv_id")), 8, "0").alias("install"), F.lit("events").alias("stream"), F.col("turn").cast("string").alias("seq"), body.alias("body"))
    where = T.shared_folder(spark)
    receive(one.union(one), f"{where}/store", f"{where}/offsets")
    return chunks(spark, f"{where}/store")


@query(f"WITH s AS ({usage.ORACLE_SQL['shared_misses']}) SELECT row_number() OVER (ORDER BY installs DESC, roman, chose)::BIGINT AS place, * FROM s ORDER BY place LIMIT 50")
def shared_miss_report(spark, d):
    """The fifty misses that most installs share, in their order."""
    return E.report_order(usage.QUERIES["shared_misses"](spark, d), [F.desc("installs"), F.asc("roman"), F.asc("chose")], 50)


@query(f"WITH s AS ({evaluation.ORACLE_SQL['stress_by_source']}) SELECT row_number() OVER (ORDER BY top1, {{by}})::BIGINT AS place, * FROM s ORDER BY place LIMIT 50".replace("{by}", "style, source"))
def worst_first(spark, d):
    """Habits and sources by their share of right first choices, the worst first."""
    return E.report_order(evaluation.QUERIES["stress_by_source"](spark, d), [F.asc("top1"), F.asc("style"), F.asc("source")], 50)
