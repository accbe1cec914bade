"""Queries over telemetry, the personal model and Bengali text forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.keys import BANGLA_CONSONANTS, BANGLA_UNITS, NUKTA_UNITS, key_from_bangla
from ..functions.scores import HALF_LIFE_DAYS
from ..operators import personal as P, rules, telemetry as T
from .standins import sql_finish, sql_map, table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


#: The driver's events as commits: users are installs, the number in props a position and a word.
COMMITS = """com AS (SELECT user_id AS install, strftime(ts, '%Y-%m-%dT%H') AS h, epoch(ts) AS t, event_type || (k % 7) AS roman, event_type || 'w' || (k % 3) AS chose, CASE WHEN k % 4 = 0 THEN '' ELSE event_type || 'w' || (k % 2) END AS we_said,
  k % 5 AS pos, event_type = 'error' AS retyped, event_type AS app, value AS latency, event_id FROM (SELECT *, json_extract_string(props, '$.k')::BIGINT AS k FROM events))"""


def commits(spark, d):
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    mod = lambda n: (F.col("k") % n).cast("string")
    t = F.unix_micros(F.to_timestamp_ltz(F.col("ts").cast("string"))) / 1e6
    return e.select(
        F.col("user_id").alias("install"), T.hour_bucket("ts").alias("h"), t.alias("t"), F.concat("event_type", mod(7)).alias("roman"), F.concat("event_type", F.lit("w"), mod(3)).alias("chose"),
        F.when(F.col("k") % 4 == 0, "").otherwise(F.concat("event_type", F.lit("w"), mod(2))).alias("we_said"), (F.col("k") % 5).alias("pos"), (F.col("event_type") == "error").alias("retyped"),
        F.col("event_type").alias("app"), F.col("value").alias("latency"), "event_id",
    )


REC = lambda a: f"(length({a}) > 0 AND length({a}) <= 32 AND NOT regexp_matches({a}, '[0-9@:/\\\\]'))"
# letters for the digits, so that some rows are recordable
PLAIN = COMMITS.replace("event_type || (k % 7)", "event_type || chr(97 + (k % 7)::INT)").replace("'w' || (k % 3)", "CASE WHEN k % 3 = 1 THEN '@' ELSE 'w' END").replace("'w' || (k % 2)", "CASE WHEN k % 2 = 1 THEN 'x' ELSE 'w' END")


def plain_commits(spark, d):
    k = F.get_json_object("props", "$.k").cast("bigint")
    c = table(spark, d, "events").withColumn("k", k)
    return c.select(
        F.col("user_id").alias("install"), T.hour_bucket("ts").alias("h"), F.concat("event_type", F.chr((97 + F.col("k") % 7).cast("int"))).alias("roman"), F.concat("event_type", F.when(F.col("k") % 3 == 1, "@").otherwise("w")).alias("chose"),
        F.when(F.col("k") % 4 == 0, "").otherwise(F.concat("event_type", F.when(F.col("k") % 2 == 1, "x").otherwise("w"))).alias("we_said"), (F.col("k") % 5).alias("pos"), (F.col("event_type") == "error").alias("retyped"), "event_id",
    )


@query(f"WITH {PLAIN} SELECT event_id, {REC('roman')} AND {REC('chose')} AS recordable FROM com")
def recordable_events(spark, d):
    return plain_commits(spark, d).select("event_id", X.is_recordable("roman", "chose").alias("recordable"))


@query(f"WITH {PLAIN} SELECT event_id, roman, chose, we_said, pos, retyped FROM com WHERE (pos > 0 OR retyped) AND {REC('roman')} AND {REC('chose')} AND (we_said = '' OR {REC('roman')} AND {REC('we_said')})")
def struggle_events(spark, d):
    return T.struggles(plain_commits(spark, d)).select("event_id", "roman", "chose", "we_said", "pos", "retyped")


METRICS = f"""{COMMITS}, ml AS (SELECT install, h, count(*) AS words, count(*) FILTER (pos = 0) AS top1_taken, count(*) FILTER (retyped) AS retyped, list(latency ORDER BY latency) FILTER (latency IS NOT NULL) AS l, count(latency) AS n,
    count(*) FILTER (pos = 0) AS pos_0, count(*) FILTER (pos = 1) AS pos_1, count(*) FILTER (app = 'click') AS app_click FROM com GROUP BY install, h),
  met AS (SELECT install, h, words, top1_taken, retyped, pos_0, pos_1, app_click, l[n // 2 + 1] AS lat_p50, l[least(n - 1, floor(n * 0.95::DOUBLE)::BIGINT) + 1] AS lat_p95, n AS lat_n FROM ml)"""


@query(f"WITH {METRICS} SELECT install, h, words, top1_taken, retyped, pos_0, pos_1, app_click, lat_p50, lat_p95, lat_n FROM met")
def hourly_counters(spark, d):
    c = T.hourly_counters(commits(spark, d))
    n = lambda k: F.coalesce(F.try_element_at("counters", F.lit(k)), F.lit(0)).alias(k)
    return c.select("install", "h", "words", "top1_taken", "retyped", n("pos_0"), n("pos_1"), n("app_click"), "lat_p50", "lat_p95", "lat_n")


@query(f"""WITH {METRICS}, m AS (SELECT install, sum(words)::BIGINT AS words, sum(top1_taken) AS t1, sum(retyped)::BIGINT AS retyped, avg(lat_p50) AS a, avg(lat_p95) AS b FROM met GROUP BY install),
  e AS (SELECT install, count(*) FILTER (pos > 0) AS misses, count(*) FILTER (pos = 0) AS friction FROM com WHERE pos > 0 OR retyped GROUP BY install)
  SELECT m.install, words, round(100.0 * t1 / greatest(words, 1), 6) AS top1_pct, retyped, round(a, 6) AS lat_p50, round(b, 6) AS lat_p95, coalesce(misses, 0) AS misses, coalesce(friction, 0) AS friction FROM m LEFT JOIN e ON m.install = e.install""")
def install_health(spark, d):
    c = commits(spark, d)
    return T.install_health(T.hourly_counters(c), c.where("pos > 0 OR retyped"))


@query(f"""WITH {COMMITS}, m AS (SELECT * FROM com WHERE pos > 0), s AS (SELECT roman, chose, we_said, count(*) AS n FROM m WHERE we_said <> '' GROUP BY ALL),
  mo AS (SELECT roman, chose, we_said FROM (SELECT *, row_number() OVER (PARTITION BY roman, chose ORDER BY n DESC, we_said) AS r FROM s) WHERE r = 1)
  SELECT m.roman, m.chose, count(DISTINCT install)::BIGINT AS installs, any_value(mo.we_said) AS we_said FROM m LEFT JOIN mo ON m.roman = mo.roman AND m.chose = mo.chose GROUP BY m.roman, m.chose HAVING count(DISTINCT install) >= 2""")
def shared_misses(spark, d):
    return T.shared_misses(commits(spark, d))


@query(f"WITH {COMMITS} SELECT pos, count(*)::BIGINT AS n FROM com WHERE pos > 0 GROUP BY pos")
def position_histogram(spark, d):
    return T.position_histogram(commits(spark, d))


@query(f"WITH {COMMITS} SELECT roman, chose, count(*)::BIGINT AS n FROM com WHERE pos = 0 AND retyped GROUP BY ALL ORDER BY n DESC, roman, chose LIMIT 12")
def friction_top(spark, d):
    return T.friction_top(commits(spark, d).where("pos > 0 OR retyped"))


@query(f"WITH {COMMITS} SELECT count(*)::BIGINT AS words, round(100.0 * count(*) FILTER (pos = 0) / greatest(count(*), 1), 6) AS top1_pct, count(*) FILTER (pos > 0)::BIGINT AS misses, round(100.0 * count(*) FILTER (pos = 1) / greatest(count(*) FILTER (pos > 0), 1), 6) AS second_pct FROM com")
def report_totals(spark, d):
    from ..functions.metrics import pct

    c = commits(spark, d).agg(F.count(F.lit(1)).alias("words"), F.count_if(F.col("pos") == 0).alias("t"), F.count_if(F.col("pos") > 0).alias("misses"), F.count_if(F.col("pos") == 1).alias("s"))
    return c.select("words", F.round(pct("t", "words"), 6).alias("top1_pct"), "misses", F.round(pct("s", "misses"), 6).alias("second_pct"))


@query(f"WITH {COMMITS} SELECT install, stream, seq, event_id FROM (SELECT *, row_number() OVER (PARTITION BY install, stream, seq ORDER BY event_id) AS r FROM (SELECT install, app AS stream, pos AS seq, event_id FROM com)) WHERE r = 1")
def chunk_dedup(spark, d):
    return T.chunk_dedup(commits(spark, d).select("install", F.col("app").alias("stream"), F.col("pos").alias("seq"), "event_id", F.col("event_id").alias("arrival"))).drop("arrival")


@query(f"""WITH {COMMITS}, l AS (SELECT install, h, event_id, sum(length(roman || ' ' || chose) + 1) OVER (PARTITION BY install ORDER BY h, event_id) AS u FROM com WHERE h >= '2024-01-10T00')
  SELECT install, event_id, t AS truncated FROM (SELECT *, max(u) OVER (PARTITION BY install) > {T.EXPORT_BYTES} AS t FROM l) WHERE u <= {T.EXPORT_BYTES}""")
def export_since(spark, d):
    rows = commits(spark, d).select("install", "h", F.col("h").alias("chunk"), F.col("event_id").alias("line_no"), F.concat("roman", F.lit(" "), "chose").alias("line"))
    return T.export(rows, "2024-01-10T00").select("install", F.col("line_no").alias("event_id"), "truncated")


NOW = 1706745600.0  # 2024-02-01


@query(f"WITH {COMMITS} SELECT install, roman, round(sum(exp(-ln(2) / ({HALF_LIFE_DAYS} * 86400) * greatest(0, {NOW} - t))), 6) AS count, round(max(t), 3) AS last FROM com WHERE app IN ('purchase', 'click') GROUP BY install, roman")
def decayed_selections(spark, d):
    c = P.decayed_counts(commits(spark, d).where("app IN ('purchase', 'click')"), ["install", "roman"], NOW)
    return c.select("install", "roman", F.round("count", 6).alias("count"), F.round("last", 3).alias("last"))


#: Latin letters to Bengali signs: every word of the tables becomes a text with joiners, khanda ta spelled out, nukta letters,
#: Assamese letters and candrabindus before vowel signs.
LETTERS = "abcdefghijklmnopqrstuvwxyz"
SIGNS = "াবচড" + X.ZWJ + "ফগ" + X.VIRAMA + "িজকলমঁে" + "প" + X.ZWNJ + "ৰসতুভৱ" + X.NUKTA + "যঢ"


SPELLED = f"""w AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS word FROM documents),
  c AS (SELECT word, regexp_replace(replace(nfc_normalize(translate(word, '{LETTERS}', '{SIGNS}')), 'ত{X.VIRAMA}{X.ZWJ}', 'ৎ'), '{X.CANDRABINDU}([{X.VOWEL_SIGNS}]+)', '\\1{X.CANDRABINDU}', 'g') AS canonical FROM w),
  f AS (SELECT word, canonical, translate(canonical, 'ৰৱ{X.ZWNJ}{X.ZWJ}', 'রব') AS match_key FROM c)"""


def spelled(spark, d):
    """The distinct words of documents (word) and the same in Bengali signs (t)."""
    words = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("word"))
    return words.select(F.lower("word").alias("word")).distinct().withColumn("t", F.translate("word", LETTERS, SIGNS))


@query(f"WITH {SPELLED} SELECT * FROM f")
def bangla_text_forms(spark, d):
    return spelled(spark, d).select("word", X.canonical("t").alias("canonical"), X.match_key("t").alias("match_key"))


@query(f"""WITH {SPELLED} SELECT word, replace(replace(replace(canonical, 'ড{X.NUKTA}', chr(2524)), 'ঢ{X.NUKTA}', chr(2525)), 'য{X.NUKTA}', chr(2527)) AS output FROM f""")
def output_forms(spark, d):
    return spelled(spark, d).select("word", X.to_output("t").alias("output"))


@query("""SELECT o_orderkey, translate(t, '0123456789', '০১২৩৪৫৬৭৮৯') AS bangla, t AS western, translate(replace(t, '.', '।'), '0123456789', '০১২৩৪৫৬৭৮৯') AS typed FROM (SELECT o_orderkey, o_orderdate::DATE || '.' || o_custkey AS t FROM orders)""")
def digit_forms(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.concat(F.to_date("o_orderdate").cast("string"), F.lit("."), F.col("o_custkey").cast("string")).alias("t"))
    return o.select("o_orderkey", X.to_bangla_digits("t").alias("bangla"), X.to_western_digits(X.to_bangla_digits("t")).alias("western"), X.outside_composition("t").alias("typed"))


@query("""SELECT p_partkey, left(regexp_replace(p_name || '/' || p_type, '[^A-Za-z0-9._-]', '', 'g'), 24) AS app, left(regexp_replace(p_name || '/' || p_type, '[^a-z0-9_]', '', 'g'), 32) AS counter, rpad(p_name, greatest(24, length(p_name))::INT, ' ') || '|' AS padded,
  p_name IN ('blue') OR contains(p_name, 'red') OR contains(p_name, 'lin') AS blocked FROM part""")
def cleaned_names(spark, d):
    both = F.concat("p_name", F.lit("/"), "p_type")
    return table(spark, d, "part").select(
        "p_partkey", X.clean_app(both).alias("app"), X.clean_counter(both).alias("counter"), F.concat(X.pad("p_name", 24), F.lit("|")).alias("padded"), X.is_blocked("p_name", ["blue"], ["red", "lin"]).alias("blocked")
    )


UNITS = BANGLA_UNITS | NUKTA_UNITS | {X.VIRAMA + "য": "y", X.VIRAMA + "ব": "?b"}


@query(f"""WITH {SPELLED}, p AS MATERIALIZED (SELECT word, list_transform(regexp_extract_all(match_key, '[{BANGLA_CONSONANTS}]{X.NUKTA}|{X.VIRAMA}য|{X.VIRAMA}ব|.'), lambda p: coalesce({sql_map(UNITS)}[p], CASE WHEN length(p) = 2 AND p[2] = '{X.NUKTA}' THEN {sql_map(BANGLA_UNITS)}[p[1]] END)) AS l FROM f),
  q AS MATERIALIZED (SELECT word, list_filter(list_transform(list_filter(l, lambda u: u IS NOT NULL), lambda u, i: CASE WHEN u <> '?b' THEN u WHEN i = 1 THEN 'b' END), lambda u: u IS NOT NULL) AS l FROM p),
  a_1 AS (SELECT * FROM q), {sql_finish("coarse", "a")}, b_1 AS (SELECT * FROM q), {sql_finish("fine", "b")} SELECT word, a.key AS coarse, b.key AS fine FROM a JOIN b USING (word)""")
def bangla_keys(spark, d):
    return spelled(spark, d).select("word", key_from_bangla("t", "coarse").alias("coarse"), key_from_bangla("t", "fine").alias("fine"))


#: A small bundle of our own for the query; production bundles are read from a file.
BUNDLE = {
    "patterns": [
        {"find": "kh", "replace": "খ"}, {"find": "k", "replace": "ক"}, {"find": "m", "replace": "ম"}, {"find": "r", "replace": "র"}, {"find": "t", "replace": "ত"}, {"find": "n", "replace": "ন"},
        {"find": "a", "replace": "া", "rules": [{"replace": "আ", "matches": [{"type": "prefix", "scope": "!consonant"}]}]},
        {"find": "i", "replace": "ি", "rules": [{"replace": "ই", "matches": [{"type": "prefix", "scope": "!consonant"}]}]},
    ],
    "vowel": "aeiou", "consonant": "bcdfghjklmnpqrstvwxyz", "punctuation": " .,!?", "casesensitive": "", "exceptions": {"তিনি": "tini"},
}


# the bundle written out: what the exception leaves is taken apart into kh and single letters, a and i by the letter before
_AFTER = "(i = 1 OR NOT contains('bcdfghjklmnpqrstvwxyz', right(regexp_extract_all(s, 'kh|.')[i - 1], 1)))"
RULES_SQL = f"""SELECT word, array_to_string(list_transform(string_split(word, 'tini'), lambda s: array_to_string(list_transform(regexp_extract_all(s, 'kh|.'), lambda p, i:
  CASE p WHEN 'kh' THEN 'খ' WHEN 'k' THEN 'ক' WHEN 'm' THEN 'ম' WHEN 'r' THEN 'র' WHEN 't' THEN 'ত' WHEN 'n' THEN 'ন' WHEN 'a' THEN CASE WHEN {_AFTER} THEN 'আ' ELSE 'া' END WHEN 'i' THEN CASE WHEN {_AFTER} THEN 'ই' ELSE 'ি' END ELSE p END), '')), 'তিনি') AS bangla
  FROM (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS word FROM documents)"""


@query(RULES_SQL)
def rule_transliteration(spark, d):
    """Every distinct Latin word of documents under a small bundle; tests hold the engine against a plain scan of the list."""
    from .standins import words

    return rules.transliterated(words(spark, d).select("word"), "word", BUNDLE)


#: Entries of a list that travels with the tasks, at most.
BLOCKED_MOST = 100_000
ROOTS_SQL = "SELECT DISTINCT left(word, 4) AS root FROM b WHERE length(word) >= 4"


@query(f"""WITH w AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS word FROM documents), b AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS word FROM benchmark),
  r AS ({ROOTS_SQL}) SELECT word, word IN (SELECT word FROM b WHERE length(word) < 4) OR EXISTS (SELECT 1 FROM r WHERE contains(word, root)) AS blocked FROM w""")
def blocked_words(spark, d):
    """Every distinct word of documents against a list made of the benchmark's words: short ones exact, the beginnings of others as roots."""
    found = lambda name: table(spark, d, name).select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("word")).select(F.lower("word").alias("word")).distinct()
    listed = found("benchmark").select(F.substring("word", 1, 4).alias("word")).distinct().limit(BLOCKED_MOST).collect()
    exact, roots = [r.word for r in listed if len(r.word) < 4], [r.word for r in listed if len(r.word) == 4]
    return found("documents").select("word", X.is_blocked("word", exact, roots).alias("blocked"))


@query("""SELECT conv_id, turn, array_to_string(list_concat([1], list_transform(string_split(array_to_string(w[-3:], ' '), ''), lambda c: CASE WHEN ascii(c) BETWEEN 97 AND 122 THEN ascii(c) - 87 ELSE 3 END), [4], list_transform(string_split(role, ''), lambda c: CASE WHEN ascii(c) BETWEEN 97 AND 122 THEN ascii(c) - 87 ELSE 3 END), [2]), ' ') AS ids
  FROM (SELECT conv_id, turn, role, list_transform(regexp_extract_all(text, '[A-Za-z]+'), lambda x: lower(x)) AS w FROM conversations) WHERE len(w) > 0""")
def source_in_context(spark, d):
    """Each turn's last words as the words before, its role as what is typed."""
    vocabulary = {"__mode__": 1, "__sep__": 4} | {chr(c): c - 87 for c in range(97, 123)}
    t = table(spark, d, "conversations").select("conv_id", "turn", "role", F.transform(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), F.lower).alias("w")).where(F.size("w") > 0)
    return t.select("conv_id", "turn", F.array_join(rules.encode_source_in_context(F.col("role"), F.col("w"), "__mode__", "__sep__", vocabulary, 3, 2), " ").alias("ids"))


@query("SELECT text, array_to_string(list_concat([7], list_transform(string_split(text, ''), lambda c: CASE WHEN ascii(c) BETWEEN 97 AND 122 THEN ascii(c) - 87 ELSE 3 END), [2]), ' ') AS ids FROM (SELECT DISTINCT lower(p_type) AS text FROM part) WHERE text <> ''")
def source_encoding(spark, d):
    vocabulary = {"__bn__": 7} | {chr(c): c - 87 for c in range(97, 123)}
    text = table(spark, d, "part").select(F.lower("p_type").alias("text")).distinct().where("text <> ''")
    return text.select("text", F.array_join(rules.encode_source(F.col("text"), vocabulary, "bn", 3, 2), " ").alias("ids"))
