"""The driver's tables as the engine's inputs, in DataFrames and, for the oracle, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.keys import key_from_roman
from ..functions.text import ascii_tokens
from ..operators import lexicon as L, retrieve as R
from ..sources.store import built_once


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def tokens(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, lang, source, pos, surface, word of documents: runs of Latin letters."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", F.posexplode(ascii_tokens("text")).alias("pos", "surface"))
    return docs.withColumn("word", F.lower("surface"))


def register() -> F.Column:
    return F.when(F.col("lang") == "en", "wiki").when(F.col("lang") == "fr", "subs").otherwise("chat")


def with_keys(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("fine", key_from_roman(text, "fine")).withColumn("coarse", key_from_roman(text, "coarse"))


def words(spark: SparkSession, d: str) -> DataFrame:
    """word, wiki, subs, chat, score."""
    return _counted(spark, d).drop("src")


def _counted(spark: SparkSession, d: str) -> DataFrame:
    """words with src, the bits of the sources that have it: all that is taken from the tokens, in one pass."""
    bit = F.expr("shiftleft(1, cast(substring(source, 4, 3) AS int) % 3)")
    return built_once(spark, d, "words", lambda: L.scored(L.register_counts(tokens(spark, d), register(), src=F.bit_or(bit))))


def keyed_words(spark: SparkSession, d: str) -> DataFrame:
    """words with their keys, fine and coarse."""
    return built_once(spark, d, "keyed-words", lambda: with_keys(words(spark, d), "word"))


def romans(spark: SparkSession, d: str) -> DataFrame:
    """roman, word, count, src."""
    return built_once(spark, d, "romans", lambda: L.merge_romanizations(attested(spark, d)))


def completions(spark: SparkSession, d: str) -> DataFrame:
    """prefix, word, rom_prefix, gap."""
    return built_once(spark, d, "completions", lambda: R.top_completions(romans(spark, d), words(spark, d)))


def key_indexes(spark: SparkSession, d: str) -> dict[str, tuple[DataFrame, DataFrame]]:
    """For each level the best words of each key, and of longer keys."""
    made = {"same": R.top_by_key, "longer": R.top_by_longer_key}
    return {level: tuple(built_once(spark, d, f"key-{level}-{n}", lambda f=f, level=level: f(keyed_words(spark, d), level)) for n, f in made.items()) for level in ("fine", "coarse")}


TURNS = 1 << 24
SPELLINGS = 100_000  # fixed value: spellings whose candidates are made at a time where all words of the conversations are asked for


def sent_of() -> F.Column:
    return (F.col("conv_id") * TURNS + F.col("turn")).alias("sent")


def sentences(spark: SparkSession, d: str) -> DataFrame:
    """sent, pos, word of conversations; conversations have fewer than TURNS turns."""
    turns = table(spark, d, "conversations").select(sent_of(), "role", F.posexplode(ascii_tokens("text")).alias("pos", "surface"))
    return turns.select("sent", "role", "pos", F.lower("surface").alias("word"))


STYLE_EXPRESSIONS = {
    "no_h": "regexp_replace({w}, '([kgcjtdpb])h', '{1}')",
    "c_for_ch": "replace(replace({w}, 'chh', 'ch'), 'ch', 'c')",
    "s_for_sh": "replace(replace({w}, 'sh', 's'), 'ss', 's')",
    "v_for_bh": "replace(replace(replace({w}, 'bh', 'v'), 'ph', 'f'), 'w', 'o')",
}


def attested(spark: SparkSession, d: str) -> DataFrame:
    """roman, word, count, src: every word under four typing habits; the source's number gives the bit."""
    counts = _counted(spark, d).select("word", (F.col("wiki") + F.col("subs") + F.col("chat")).alias("count"), "src")
    romans = F.array_distinct(F.array("word", *(F.expr(e.replace("{w}", "word").replace("{1}", "$1")) for e in STYLE_EXPRESSIONS.values())))
    return counts.select(F.explode(romans).alias("roman"), "word", "count", "src")


def queries(spark: SparkSession, d: str) -> DataFrame:
    """q, roman, gold, weight, fine, coarse: every word that is typed otherwise without h, and the keys of how it is typed."""

    def make():
        w = words(spark, d).withColumn("n", F.col("wiki") + F.col("subs") + F.col("chat"))
        typed = w.withColumn("roman", F.expr(STYLE_EXPRESSIONS["no_h"].replace("{w}", "word").replace("{1}", "$1"))).where("roman <> word")
        return with_keys(typed.select(F.col("word").alias("q"), "roman", F.col("word").alias("gold"), F.col("n").alias("weight")), "roman")

    return built_once(spark, d, "queries", make)


def sql_style(name: str, w: str) -> str:
    e = STYLE_EXPRESSIONS[name].replace("{w}", w).replace("{1}", "\\1")
    return e.replace("\\1')", "\\1', 'g')")


TOK = """tok AS (SELECT doc_id, lang, source, i - 1 AS pos, w[i] AS surface, lower(w[i]) AS word FROM (SELECT doc_id, lang, source, w, unnest(range(1, len(w) + 1)) AS i
  FROM (SELECT doc_id, lang, source, regexp_extract_all(text, '[A-Za-z]+') AS w FROM documents)))"""
WORDS = f"""{TOK}, words AS (SELECT *, wiki + 3 * subs + 20 * chat AS score FROM (SELECT word, count(*) FILTER (lang = 'en') AS wiki, count(*) FILTER (lang = 'fr') AS subs,
  count(*) FILTER (lang NOT IN ('en', 'fr')) AS chat FROM tok GROUP BY word)), total AS (SELECT (coalesce(sum(score), 0) + 1)::BIGINT AS t FROM words)"""
SENT = f"""sent AS (SELECT sent, role, i - 1 AS pos, lower(w[i]) AS word FROM (SELECT sent, role, w, unnest(range(1, len(w) + 1)) AS i
  FROM (SELECT conv_id * {TURNS} + turn AS sent, role, regexp_extract_all(text, '[A-Za-z]+') AS w FROM conversations)))"""
ROMANS = f"""att AS (SELECT unnest(list_distinct([word, {', '.join(sql_style(s, 'word') for s in STYLE_EXPRESSIONS)}])) AS roman, word, n, src FROM
  (SELECT word, source, count(*) AS n, 1 << (substr(source, 4, 3)::INT % 3) AS src FROM tok GROUP BY word, source)),
  romans AS (SELECT roman, word, least(sum(n), 2147483647)::BIGINT AS cnt, bit_or(src) AS src FROM att GROUP BY roman, word)"""
QUERY_SQL = f"""qs AS (SELECT word AS q, roman, word AS gold, n AS weight FROM (SELECT word, wiki + subs + chat AS n, {sql_style('no_h', 'word')} AS roman FROM words) WHERE roman <> word)"""


def sql_map(d: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in d.items()) + "}"


def sql_finish(level: str, out: str) -> str:
    """The CTEs from `out`_1 (word, list of units) to `out` (word, key)."""
    from ..functions.keys import COARSE, COARSE_VOWELS

    first = f"{sql_map(COARSE_VOWELS)}[u[2:]]" if level == "coarse" else "u[2:]"
    plain = f"coalesce({sql_map(COARSE)}[u], u)" if level == "coarse" else "u"
    return f"""{out}_2 AS (SELECT word, list_filter(list_transform(l, lambda u, i: CASE WHEN u[1] = 'V' THEN CASE WHEN i = 1 THEN {first} END WHEN u = 'y' THEN CASE WHEN i = 1 THEN 'j' END ELSE {plain} END), lambda u: u IS NOT NULL) AS l FROM {out}_1),
  {out} AS (SELECT word, coalesce(array_to_string(list_filter(l, lambda u, i: i = 1 OR u <> l[i - 1]), ''), '') AS key FROM {out}_2)"""


def sql_key(level: str, source: str, word: str = "word", out: str = "keyed") -> str:
    """A CTE `out` (word, key) over the distinct words of a relation that are in a-z already."""
    from ..functions.keys import ROMAN_PATTERN, ROMAN_UNITS

    pattern = ROMAN_PATTERN.replace("'", "''")
    return f"""{out}_0 AS (SELECT DISTINCT {word} AS word FROM {source}),
  {out}_1 AS (SELECT word, list_filter(list_transform(regexp_extract_all(word, '{pattern}'), lambda p: {sql_map(ROMAN_UNITS)}[p]), lambda u: u IS NOT NULL) AS l FROM {out}_0),
  {sql_finish(level, out)}"""
