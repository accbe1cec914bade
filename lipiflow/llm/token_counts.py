"""Token counts under a unigram vocabulary, by a Viterbi pass that keeps counts only.

An Aho-Corasick automaton over the pieces enumerates every vocabulary match in a word at once. For each end
position the dynamic program keeps the best score and how many pieces it took, no path. The rules are those
of the tokenizers library's Unigram model: matches are tried by increasing start and, from one start,
increasing length; only a strictly better score replaces an earlier one; a character that no single-character
piece covers is an unknown of the lowest score less 10; neighbouring unknowns fuse, and fall back to
one token a byte. White space is as in Metaspace: each space starts a word and is written U+2581.

The pieces are those of a public SentencePiece file. Its scores are ranks, -r; as log probabilities the model
takes -ln(1 + r), a Zipf law over the file's own order, so that nothing is trained.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import REMEMBERED_CHARS, Remembered

SPACE = "▁"
#: Below the lowest score, for an unknown character (fixed value).
UNKNOWN_PENALTY = 10.0


def unigram_pieces(model_path: str) -> list[tuple[str, float]]:
    """(piece, score) of a SentencePiece file, in its order; control, byte and unused pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    out = []
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i) or model.is_unused(i)):
            out.append((model.id_to_piece(i), -math.log1p(max(0.0, -model.get_score(i)))))
    return out


class CountingUnigram:
    """Counts tokens; a text is cut before each space, and every part starts with U+2581."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.longest = max(len(p) for p, _ in pieces)
        self.single = {p: s for p, s in pieces if len(p) == 1}
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.counts = Remembered(self.count_word)

    def count_word(self, word: str) -> int:
        return self.best(word)[1]

    def best(self, word: str) -> tuple[float, int]:
        """Best score of the word and the tokens of the segmentation that has it."""
        single, unknown, room = self.single, self.unknown, self.longest + 1
        # the automaton yields matches by end, of which only the scores of as many ends as a piece is long are kept
        matches = self.automaton.iter(word)
        last, match = next(matches, (-1, None))
        scores, tokens = [0.0] * room, [0] * room
        for end, letter in enumerate(word, 1):
            ending = []
            while last == end - 1:
                ending.append(match)
                last, match = next(matches, (-1, None))
            best, count = -math.inf, 0
            # among those of one end the longest, of the earliest start, first
            for length, score in sorted(ending, reverse=True):
                start = (end - length) % room
                if (candidate := scores[start] + score) > best:
                    best, count = candidate, tokens[start] + 1
            before = (end - 1) % room
            if letter not in single and (candidate := scores[before] + unknown) > best:
                # fallback: as many tokens as the character has bytes, fused with an unknown before it or not
                best, count = candidate, tokens[before] + len(letter.encode("utf-8", "surrogatepass"))
            scores[end % room], tokens[end % room] = best, count
        return scores[len(word) % room], tokens[len(word) % room]

    def count(self, text: str) -> int:
        if not text:
            return 0
        words = text.replace(SPACE, " ").split(" ")
        known, total = self.counts, 0
        # the part before the first space is a word of its own, written with a space in front like the others
        for i, word in enumerate(words):
            if not word and i == 0:
                continue
            marked = SPACE + word
            total += known[marked] if len(marked) <= REMEMBERED_CHARS else self.count_word(marked)
        return total


_LOADED: dict[str, CountingUnigram] = {}


def token_counts(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_chars, n_words (space-separated), n_tokens (all long) of every row; null and empty texts have none.

    Rows with null or repeated doc_id are counted each on its own; other columns are ignored; an empty table
    gives no rows. No exchange takes place; memory is bounded by a batch, the automaton and the remembered words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model_path not in _LOADED:
            _LOADED[model_path] = CountingUnigram(unigram_pieces(model_path))
        model = _LOADED[model_path]
        for batch in batches:
            texts = [cell.as_py() or "" for cell in batch.column("text")]
            columns = [[len(t) for t in texts], [sum(map(bool, t.split(" "))) for t in texts], [model.count(t) for t in texts]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", "n_chars", "n_words", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_chars long, n_words long, n_tokens long")
