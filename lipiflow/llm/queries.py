"""One query for each operator, over its whole table with production parameters, and its SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .bpe import bpe_digests
from .common import documents
from .exact_dedup import exact_dedup
from .filter_audit import filter_audit
from .line_dedup import apply_bitmaps, line_dedup
from .hmm import hmm_scores
from .near_dedup import near_dedup
from .packing import packed_sequences
from .quality_rules import quality_rules
from .ranked_search import ranked_search
from .substring_dedup import substring_dedup
from .token_counts import token_counts
from .toxicity import toxicity, train
from .vector_dedup import vector_dedup

WORDS_SQL = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir), window=35, digest=True)


def op2_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_scores(documents(spark, sf_dir))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), tokenizer("piece_bpe_32k.model"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    kept = apply_bitmaps(docs, line_dedup(docs, min_chars=40, min_docs=5))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(documents(spark, sf_dir))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_sequences(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


def op11_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), documents(spark, sf_dir))


OP7_SQL = rf"""
WITH l AS (
  SELECT doc_id, pos, lines[pos] AS line, len(lines) AS n,
         translate(trim(lines[pos], E' \t\n\x0b\x0c\r'), '{UP}', '{LOW}') AS k
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), E'\n') AS lines FROM documents))),
s AS (SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
f AS (SELECT l.*, s.k IS NOT NULL AND l.doc_id <> s.keeper AS gone FROM l LEFT JOIN s ON l.k = s.k)
SELECT doc_id, max(n)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, E'\n' ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""

OP10_SQL = f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UP}', '{LOW}') AS c FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY c) AS keep_id, count(*) OVER (PARTITION BY c) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY c) AS kept, sha256(c) AS text_sha256
FROM t
"""

OP11_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach(a, b) AS (SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a),
degree AS (SELECT a, count(*) AS n FROM pairs GROUP BY a), least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(l.b, vec_id))::BIGINT AS component_id,
       vec_id <= coalesce(l.b, vec_id) AS kept
FROM embeddings LEFT JOIN degree d ON d.a = vec_id LEFT JOIN least l ON l.a = vec_id
"""

OP12_SQL = rf"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, {WORDS_SQL} AS w FROM documents),
m AS (SELECT doc_id, part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
             100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t),
             regexp_matches(t, '[#$%&*|]'), coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false)] AS f FROM w),
r AS (SELECT part, f, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM m LEFT JOIN
      (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id) USING (doc_id)),
c AS (SELECT part, f, len(list_filter(f, lambda x: x)) AS fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
      FROM r GROUP BY part, f),
l AS (SELECT unnest(range(1, 6)) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT array_to_string(list_transform(o, lambda x: substr('ABCDE', x, 1)), '') AS filter_order, step, o[step] AS own, o[1:step - 1] AS before
      FROM o, (SELECT unnest(range(1, 6)) AS step)),
j AS (SELECT part, filter_order, step, n, good, toxic, fails, f[own] AS here, len(list_filter(before, lambda x: f[x])) > 0 AS earlier FROM c, s)
SELECT part, filter_order, step::INT AS step, coalesce(sum(n) FILTER (NOT here AND NOT earlier), 0)::BIGINT AS kept,
       coalesce(sum(n) FILTER (here AND NOT earlier), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (here AND earlier), 0)::BIGINT AS redundant,
       coalesce(sum(n) FILTER (here AND fails = 1), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (here AND NOT earlier), 0)::BIGINT AS good_lost,
       coalesce(sum(toxic) FILTER (here AND NOT earlier), 0)::BIGINT AS toxic_lost, coalesce(sum(n * 120 // greatest(fails, 1)) FILTER (here), 0)::BIGINT AS shapley
FROM j GROUP BY part, filter_order, step
"""

TERMS_SQL = rf"unnest(regexp_extract_all(translate(text, '{UP}', '{LOW}'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+'))"
OP13_SQL = f"""
WITH t AS (SELECT doc_id, {TERMS_SQL} AS term FROM documents),
q AS (SELECT DISTINCT item_id, {TERMS_SQL} AS term FROM benchmark),
len AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id), totals AS (SELECT count(*) AS nn, sum(n)::BIGINT AS l FROM len),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term),
w AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, totals GROUP BY term, nn),
g AS (SELECT tf.doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // l))) AS g
      FROM tf JOIN len USING (doc_id) JOIN w USING (term), totals),
s AS (SELECT item_id, doc_id, sum(g)::BIGINT AS score FROM q JOIN g USING (term) GROUP BY item_id, doc_id HAVING sum(g) > 0)
SELECT item_id, rank::INT AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 50
"""

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_hmm": op2_hmm,
    "op3_bpe": op3_bpe,
    "op4_token_counts": op4_token_counts,
    "op5_toxicity": op5_toxicity,
    "op6_quality_rules": op6_quality_rules,
    "op7_line_dedup": op7_line_dedup,
    "op8_near_dedup": op8_near_dedup,
    "op9_packing": op9_packing,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_vector_dedup": op11_vector_dedup,
    "op12_filter_audit": op12_filter_audit,
    "op13_ranked_search": op13_ranked_search,
}

ORACLE_SQL = {
    "op7_line_dedup": OP7_SQL,
    "op10_exact_dedup": OP10_SQL,
    "op11_vector_dedup": OP11_SQL,
    "op12_filter_audit": OP12_SQL,
    "op13_ranked_search": OP13_SQL,
}
