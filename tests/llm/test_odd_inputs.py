"""Every operator on texts of extreme length, nulls, ties and repeated rows, with columns whose names clash with its own."""

import random
from collections import Counter

import pytest

from lipiflow.llm import toxicity
from lipiflow.llm.bpe import bpe_digests
from lipiflow.llm.exact_dedup import exact_dedup
from lipiflow.llm.filter_audit import filter_audit
from lipiflow.llm.hmm import hmm_scores
from lipiflow.llm.line_dedup import apply_bitmaps, line_dedup
from lipiflow.llm.near_dedup import near_dedup
from lipiflow.llm.packing import packed_sequences
from lipiflow.llm.quality_rules import quality_rules
from lipiflow.llm.queries import tokenizer
from lipiflow.llm.ranked_search import ranked_search
from lipiflow.llm.substring_dedup import substring_dedup
from lipiflow.llm.token_counts import token_counts

CLASHING = [
    "n_words", "n_removed", "kept", "hash", "row", "class_id", "text_hash", "label", "words", "h", "h1", "h2", "key", "node", "size", "line", "pos", "part", "score", "down", "first", "n_dropped",
    "n_lines", "drop_words", "word", "bits", "bucket", "keep_id", "group_size", "sketches", "shape", "places", "doc", "num", "keys", "spans", "starts", "counts", "ranges", "held_out", "n_tokens", "y",
    "_h", "kind", "mask", "head", "fingerprint", "least", "grp", "leaf", "terms", "tops", "n", "item_id", "a b",
]


def rows():
    rng = random.Random(11)
    plain = " ".join(f"w{rng.randint(0, 400)}" for _ in range(120))
    long = " ".join(f"w{rng.randint(0, 3000)}" for _ in range(30_000))
    texts = [plain, plain, plain.upper(), None, None, "", " \n\n", long, long + " more", "x" * 200_000, "é" * 50_000 + "\n" + "line of forty code points and a few more ..\n" * 3, plain + "\nline of forty code points and a few more .."]
    ids = [1, 1, 2, 3, 3, 4, 5, 6, 7, 8, None, None]
    return list(zip(ids, texts)) + [(20 + i, f"line of forty code points and a few more ..\nrest {i}") for i in range(6)]


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 1), (6, 0, 0), (9, 1, 1), (None, 1, 1), (7, None, 1)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "op1": lambda spark, docs: substring_dedup(docs, digest=True),
    "op2": lambda spark, docs: hmm_scores(docs),
    "op3": lambda spark, docs: bpe_digests(docs, tokenizer("byte_bpe_50k.json")),
    "op4": lambda spark, docs: token_counts(docs, tokenizer("piece_bpe_32k.model")),
    "op5": lambda spark, docs: toxicity.toxicity(docs, toxicity.train(docs, labels(spark))),
    "op6": lambda spark, docs: quality_rules(docs),
    "op7": lambda spark, docs: apply_bitmaps(docs, line_dedup(docs)),
    "op8": lambda spark, docs: near_dedup(docs),
    "op9": lambda spark, docs: packed_sequences(docs, tokenizer("word_bpe_49k.json")).where("start = 0").select("doc_id", "doc_tokens"),
    "op10": lambda spark, docs: exact_dedup(docs),
    "op12": lambda spark, docs: filter_audit(docs, labels(spark)),
    "op13": lambda spark, docs: ranked_search(docs.select("doc_id", "text").withColumnsRenamed({"doc_id": "item_id"}).where("length(text) < 2000"), docs),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns_change_nothing(spark, name):
    data = rows()
    bare = spark.createDataFrame([(*r, "en") for r in data], "doc_id long, text string, lang string").coalesce(2)
    wide = spark.createDataFrame([(*r, "en", *(f"{c}{i}" for c in CLASHING)) for i, r in enumerate(data)], "doc_id long, text string, lang string, " + ", ".join(f"`{c}` string" for c in CLASHING)).coalesce(2)
    one, two = (OPERATORS[name](spark, df) for df in (bare, wide))
    assert one.columns == two.columns
    got = [Counter(map(str, df.collect())) for df in (one, two)]
    assert got[0] == got[1]
    if name not in ("op12", "op13"):
        assert sum(got[0].values()) == len(data)
    assert OPERATORS[name](spark, bare.limit(0)).collect() == []
