"""Text forms: Column to Column, built-in expressions but for Unicode normalisation.

Lengths and positions are in code points throughout.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyspark.sql.types as T
from pyspark.sql import Column, functions as F

# Letters whose case folding is not their lower case.
ROMAN_FOLDS = {
    "ẚ": "a", "ẖ": "h", "ǰ": "j", "ŉ": "n", "ſ": "s", "ẗ": "t", "ẘ": "w", "ẙ": "y", "ß": "ss",
    "ẞ": "ss", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st",
}
# Code points of the Bengali block.
VIRAMA, KHANDA_TA, CANDRABINDU, NUKTA, ZWNJ, ZWJ = "্", "ৎ", "ঁ", "়", "‌", "‍"
VOWEL_SIGNS = "া-ৄেৈোৌৗ"
MARKS_OR_DIGITS = "০-৯ঁ-ঃ়া-্ৗ‌‍"
BENGALI = "ঀ-৿"
WESTERN_DIGITS, BANGLA_DIGITS = "0123456789", "০১২৩৪৫৬৭৮৯"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_roman(c) -> Column:
    """Case-folded, then only a-z, 0-9 and the apostrophe."""
    out = col(c)
    single = {k: v for k, v in ROMAN_FOLDS.items() if len(v) == 1}
    out = F.translate(out, "".join(single), "".join(single.values()))
    for k, v in ROMAN_FOLDS.items():
        if len(v) > 1:
            out = F.replace(out, F.lit(k), F.lit(v))
    return F.regexp_replace(F.lower(out), "[^a-z0-9']", "")


@F.pandas_udf(T.StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Spark has no built-in for this; ASCII and already composed texts are returned as they are."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def canonical(c) -> Column:
    """NFC; ta + virama + joiner as khanda ta; a candrabindu behind the vowel signs that follow it. One pass, not idempotent."""
    out = F.replace(nfc(col(c)), F.lit("ত" + VIRAMA + ZWJ), F.lit(KHANDA_TA))
    return F.regexp_replace(out, f"{CANDRABINDU}([{VOWEL_SIGNS}]+)", f"$1{CANDRABINDU}")


def match_key(c) -> Column:
    """canonical without joiners and with the Assamese letters folded: words with equal keys are one word."""
    return F.translate(canonical(c), "ৰৱ" + ZWNJ + ZWJ, "রব")


def to_output(c) -> Column:
    """canonical, with the nukta letters recomposed."""
    out = canonical(c)
    for base, composed in (("\u09a1", "\u09dc"), ("\u09a2", "\u09dd"), ("\u09af", "\u09df")):
        out = F.replace(out, F.lit(base + NUKTA), F.lit(composed))
    return out


def to_bangla_digits(c) -> Column:
    return F.translate(col(c), WESTERN_DIGITS, BANGLA_DIGITS)


def to_western_digits(c) -> Column:
    return F.translate(col(c), BANGLA_DIGITS, WESTERN_DIGITS)


def bangla_tokens(c) -> Column:
    """Array of the Bengali words of a text, not canonicalised; tokens of digits and marks only are dropped.

    Explode, then take canonical() of each: the normalisation runs once a token and not inside a lambda.
    """
    runs = F.regexp_extract_all(col(c), F.lit(f"[{BENGALI}{ZWNJ}{ZWJ}]+"), F.lit(0))
    return F.filter(runs, lambda t: ~t.rlike(f"^[{MARKS_OR_DIGITS}]+$"))


def strip_punct(c) -> Column:
    """Without what stands before the first and after the last word character."""
    outside = rf"[^\p{{IsAlphabetic}}\p{{Nd}}_{BENGALI}{ZWNJ}{ZWJ}]+"
    return F.regexp_replace(F.regexp_replace(col(c), f"^{outside}", ""), f"{outside}$", "")


def is_latin_only(c) -> Column:
    return col(c).rlike("^[A-Za-z']+$")


def has_bengali(c) -> Column:
    return col(c).rlike(f"[{BENGALI}]")


def is_romanish(c) -> Column:
    return F.lower(col(c)).rlike("[a-z]")


def is_recordable(roman, word) -> Column:
    """Both non-empty, at most 32 code points, without digits or the characters of addresses and paths."""
    ok = lambda x: (F.length(x) > 0) & (F.length(x) <= 32) & ~x.rlike(r"[0-9@:/\\]")
    return ok(col(roman)) & ok(col(word))


def is_safe_component(c) -> Column:
    """A name that may be part of a path."""
    x = col(c)
    return (F.octet_length(x) > 0) & (F.octet_length(x) <= 128) & ~x.rlike(r"[/\\\x00-\x1f\x7f]") & ~x.isin(".", "..")


HEADER_PATTERNS = {"install": "^[0-9a-f]{8,32}$", "stream": "^(metrics|events)$", "seq": "^[0-9]{1,9}$"}


#: Roots from which on they are looked for in one pass over a text instead of one after another.
MANY_ROOTS = 32


def is_blocked(c, exact: list[str], roots: list[str]) -> Column:
    """In the list of exact words, or with one of the roots inside; null of a null text."""
    x = col(c)
    out = x.isin(*exact) if exact else F.when(x.isNotNull(), F.lit(False))
    if len(roots) >= MANY_ROOTS:
        return out | holds_any(roots)(x)
    for r in roots:
        out = out | x.contains(r)
    return out


def holds_any(roots: list[str]):
    """A function of a text column: whether one of the roots is inside, by one automaton of all of them that a task builds once."""

    @F.pandas_udf("boolean")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for r in roots:
            automaton.add_word(r, True)
        automaton.make_automaton()
        for b in batches:
            yield pd.Series([None if t is None else "" in roots or next(automaton.iter(t), None) is not None for t in b], dtype="boolean")

    return found


# Fixed values, in order: Bengali spellings of the names of the Latin letters; the first that fits is taken.
LETTER_NAMES = [
    "ডব্লিউ", "এইচ", "কিউ", "এক্স", "ওয়াই", "জেড", "এফ", "এম", "এন", "এল", "এস", "আর", "বি", "সি",
    "ডি", "ই", "জি", "জে", "কে", "পি", "টি", "ইউ", "ভি", "ও", "আই", "এ",
]


def looks_like_acronym(c) -> Column:
    """Two or more letter names and nothing else; the atomic group keeps the first name that fits."""
    return col(c).rlike(f"^(?>{'|'.join(LETTER_NAMES)}){{2,}}+$")


def clean_app(c) -> Column:
    return F.left(F.regexp_replace(col(c), "[^A-Za-z0-9._-]", ""), F.lit(24))


def clean_counter(c) -> Column:
    return F.left(F.regexp_replace(col(c), "[^a-z0-9_]", ""), F.lit(32))


def pad(c, width: int) -> Column:
    """Padded with spaces to the width; longer texts stay whole."""
    x = col(c)
    return F.when(F.length(x) >= width, x).otherwise(F.rpad(x, width, " "))


def outside_composition(c) -> Column:
    """A typed full stop as danda and Western digits as Bangla ones."""
    return to_bangla_digits(F.replace(col(c), F.lit("."), F.lit("।")))


def ascii_tokens(c) -> Column:
    return F.regexp_extract_all(col(c), F.lit("[A-Za-z]+"), F.lit(0))
