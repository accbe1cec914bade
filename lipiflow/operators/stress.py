"""Typing habits: known spellings rewritten the way some people type, and accuracy by habit."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

# Neighbours on the keyboard.
NEIGHBOURS = {
    "q": "wa", "w": "qes", "e": "wrd", "r": "etf", "t": "ryg", "y": "tuh", "u": "yij", "i": "uok", "o": "ipl", "p": "o", "a": "qsz", "s": "awdz", "d": "sefx",
    "f": "drgc", "g": "fthv", "h": "gyjb", "j": "hukn", "k": "jilm", "l": "kop", "z": "asx", "x": "zsdc", "c": "xdfv", "v": "cfgb", "b": "vghn", "n": "bhjm", "m": "njk",
}
# Letters that an h may follow.
ASPIRABLE = "kgcjtdpb"


def deterministic_styles(word) -> dict[str, Column]:
    """The habits that need no draw, as expressions."""
    w = F.col(word) if isinstance(word, str) else word
    swap = lambda x, *pairs: swap(F.replace(x, F.lit(pairs[0][0]), F.lit(pairs[0][1])), *pairs[1:]) if pairs else x
    return {
        "as_is": w,
        "c_for_ch": swap(w, ("chh", "ch"), ("ch", "c")),
        "s_for_sh": swap(w, ("sh", "s"), ("ss", "s")),
        "v_for_bh": swap(w, ("bh", "v"), ("ph", "f"), ("w", "o")),
        "no_h": F.regexp_replace(w, f"([{ASPIRABLE}])h", "$1"),
    }


def variants(words: DataFrame, column: str = "word") -> DataFrame:
    """word, style, roman for the habits that need no draw; a variant has at least one letter."""
    styles = F.array(*(F.struct(F.lit(name).alias("style"), c.alias("roman")) for name, c in deterministic_styles(column).items()))
    return words.select(F.col(column).alias("word"), F.inline(styles)).where(F.col("roman").rlike("[A-Za-z]"))


def _inner(word: str, change: Callable[[str], str], shortest: int) -> str:
    """word with its inner letters changed one by one, in order."""
    return word if len(word) < shortest else word[0] + "".join(map(change, word[1:-1])) + word[-1]


def drawn(style: str, word: str, rng: random.Random) -> str:
    """The word under a habit that draws from rng: which draws are made, and in which order, is part of the habit."""
    if style == "drop_vowels":
        return _inner(word, lambda c: "" if c in "ao" and rng.random() < 0.7 else c, 4)
    if style == "double":
        return "".join(c * 2 if c in "aiu" and rng.random() < 0.5 else c for c in word)
    if style == "a_for_o":
        return _inner(word, lambda c: "a" if c == "o" and rng.random() < 0.6 else "o" if c == "a" and rng.random() < 0.3 else c, 3)
    if style == "y_for_j":
        return "".join(rng.choice("yz") if c == "j" else c for c in word.replace("jh", "j"))
    if style == "caps":
        return "".join(c.upper()[:1] if rng.random() < 0.3 else c for c in word)
    if style == "typo" and len(word) >= 4:
        at = rng.randrange(1, len(word) - 1)
        return word[:at] + rng.choice(NEIGHBOURS[word[at]]) + word[at + 1 :] if word[at] in NEIGHBOURS else word
    return word


# The order in which one generator serves the habits of a word.
STYLE_ORDER = ("as_is", "drop_vowels", "double", "a_for_o", "c_for_ch", "s_for_sh", "y_for_j", "v_for_bh", "caps", "typo", "no_h")


def all_styles(word: str, rng: random.Random) -> list[str]:
    plain = {
        "c_for_ch": lambda w: w.replace("chh", "ch").replace("ch", "c"),
        "s_for_sh": lambda w: w.replace("sh", "s").replace("ss", "s"),
        "v_for_bh": lambda w: w.replace("bh", "v").replace("ph", "f").replace("w", "o"),
        "no_h": lambda w: "".join(c for i, c in enumerate(w) if not (c == "h" and i and w[i - 1] in ASPIRABLE)),
    }
    return [plain[s](word) if s in plain else drawn(s, word, rng) for s in STYLE_ORDER]


def random_variants(lists: DataFrame, key: str, words: str, seed: int) -> DataFrame:
    """key, pos, word, style, roman: each row's word list under all habits, with one generator for the row.

    A row starts its own generator from `seed`, so that lists are independent and the table may be of any size.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, ws in zip(b[key], b[words]):
                rng = random.Random(seed)
                for pos, w in enumerate(ws):
                    rows += [(k, pos, w, s, v) for s, v in zip(STYLE_ORDER, all_styles(w, rng))]
            yield pd.DataFrame(rows, columns=[key, "pos", "word", "style", "roman"])

    return lists.select(key, words).mapInPandas(run, f"{key} long, pos long, word string, style string, roman string")


def summary(ranked: DataFrame, *by: str, cube: bool = False) -> DataFrame:
    """n, top1 and top5 in per cent; rank is NULL where the word was not found. cube: also over all values (`ALL`) of each column."""
    share = lambda k: F.round(100.0 * F.count_if(F.col("rank") <= k) / F.count(F.lit(1)), 6).alias(f"top{k}")
    figures = (F.count(F.lit(1)).alias("n"), share(1), share(5))
    if not cube:
        return ranked.groupBy(*by).agg(*figures)
    over_all = lambda c: F.when(F.col(f"_all_{c}") == 1, "ALL").otherwise(F.col(c)).alias(c)
    cubed = ranked.cube(*by).agg(*figures, *(F.grouping(c).alias(f"_all_{c}") for c in by))
    return cubed.select(*map(over_all, by), "n", "top1", "top5")
