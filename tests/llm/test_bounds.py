"""Memory that stays bounded by what a text's parts are, and texts of extreme length."""

import random
import sys
import tracemalloc

import pyarrow as pa

from lipiflow.llm.bpe import ByteBpe, REMEMBERED_CHARS, bpe_digests
from lipiflow.llm.packing import WordIds
from lipiflow.llm.queries import tokenizer
from lipiflow.llm.token_counts import CountingUnigram, unigram_pieces


def test_long_pieces_are_not_remembered():
    bpe, words, rng = ByteBpe(tokenizer("byte_bpe_50k.json")), WordIds(tokenizer("word_bpe_49k.json")), random.Random(1)
    model = CountingUnigram(unigram_pieces(tokenizer("piece_bpe_32k.model")))
    for _ in range(60):
        text = " ".join("".join(rng.choices("abcdefgh", k=20_000)) for _ in range(2)) + " short"
        bpe.encode(text)
        words.encode(text)
        model.count(text)
    for held in (bpe.pieces, words.words, model.counts):
        assert held and all(len(k) <= REMEMBERED_CHARS for k in held) and sum(map(sys.getsizeof, held)) < 100_000


def test_a_long_piece_merges_as_the_library_does():
    from tokenizers import Tokenizer

    library, own, rng = Tokenizer.from_file(tokenizer("byte_bpe_50k.json")), ByteBpe(tokenizer("byte_bpe_50k.json")), random.Random(2)
    for text in ("".join(rng.choices("etaoinshr", k=50_000)), "w" * 30_001, "é" * 9_000):
        assert own.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_scores_of_a_long_word_take_no_room():
    model = CountingUnigram(unigram_pieces(tokenizer("piece_bpe_32k.model")))
    word = "".join(random.Random(3).choices("abcdefghijklmnop", k=2_000_000))
    tracemalloc.start()
    count = model.count_word(word)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 0 < count < len(word) and most < 5 * len(word)  # what the automaton makes of the word


def test_bpe_of_odd_rows_and_no_rows(spark):
    rows = [(None, "a b", 1), (3, None, 1), (3, "", 2), (3, "a b", 3), (3, "a b", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")
    got = sorted((r.doc_id or 0, r.n_tokens) for r in bpe_digests(docs, tokenizer("byte_bpe_50k.json")).collect())
    assert got == [(0, 2), (3, 0), (3, 0), (3, 2), (3, 2)]
    assert bpe_digests(docs.limit(0), tokenizer("byte_bpe_50k.json")).collect() == []


def test_word_hashes_of_two_seeds_are_independent():
    from lipiflow.llm.common import Words

    w = Words(pa.array([" ".join(f"w{i}" for i in range(5000))]))
    one, two = w.hashes(), w.hashes(seed=11)
    assert len(set(one.tolist())) == len(set(two.tolist())) == 5000 and not (one == two).any()
