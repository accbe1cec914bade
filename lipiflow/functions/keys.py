"""Phonetic keys: spellings that sound alike get equal keys. Built-in array functions only.

A word is cut into units; vowels count only in front, aspiration only in the fine key, and a unit like the one
before it is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import NUKTA, VIRAMA, col, match_key, normalize_roman

# Latin spellings of a unit, vowels marked V.
ROMAN_UNITS = {
    "chh": "ch", "ksh": "kh", "kkh": "kh",
    "kh": "kh", "gh": "gh", "ng": "ng", "ch": "ch", "jh": "jh", "th": "th", "dh": "dh", "bh": "bh", "sh": "sh", "ph": "f", "ck": "k", "ks": "k",
    "oi": "Voi", "ai": "Voi", "ou": "Vou", "au": "Vou", "ee": "Vi", "oo": "Vu", "aa": "Va",
    "b": "b", "c": "c", "d": "d", "f": "f", "g": "g", "h": "h", "j": "j", "k": "k", "l": "l", "m": "m", "n": "n", "p": "p", "q": "k", "r": "r",
    "s": "s", "t": "t", "v": "bh", "w": "Vo", "x": "k", "y": "y", "z": "j", "a": "Va", "e": "Ve", "i": "Vi", "o": "Vo", "u": "Vu",
}
# Bengali letters and signs of a unit.
BANGLA_UNITS = {
    "ক": "k", "খ": "kh", "গ": "g", "ঘ": "gh", "ঙ": "ng", "ং": "ng", "চ": "c", "ছ": "ch", "জ": "j", "য": "j", "ঝ": "jh", "ঞ": "n", "ণ": "n", "ন": "n",
    "ট": "t", "ত": "t", "ৎ": "t", "ঠ": "th", "থ": "th", "ড": "d", "দ": "d", "ঢ": "dh", "ধ": "dh", "প": "p", "ফ": "f", "ব": "b", "ভ": "bh", "ম": "m",
    "র": "r", "ল": "l", "শ": "sh", "ষ": "sh", "স": "s", "হ": "h", "ঃ": "h",
    "অ": "Vo", "ও": "Vo", "ো": "Vo", "আ": "Va", "া": "Va", "ই": "Vi", "ঈ": "Vi", "ি": "Vi", "ী": "Vi", "উ": "Vu", "ঊ": "Vu", "ু": "Vu", "ূ": "Vu",
    "এ": "Ve", "ে": "Ve", "ঋ": "Vri", "ৃ": "Vri", "ঐ": "Voi", "ৈ": "Voi", "ঔ": "Vou", "ৌ": "Vou", "ৗ": "Vou",
}
BANGLA_CONSONANTS = "কখগঘঙচছজযঝঞণনটতঠথডদঢধপফবভমরলশষসহ"
NUKTA_UNITS = {"ড" + NUKTA: "r", "ঢ" + NUKTA: "rh", "য" + NUKTA: "y"}
COARSE = {"kh": "k", "gh": "g", "ch": "c", "jh": "j", "th": "t", "dh": "d", "bh": "b", "sh": "s", "ng": "n", "rh": "r"}
COARSE_VOWELS = {"a": "a", "o": "a", "e": "e", "i": "i", "oi": "i", "u": "u", "ou": "u", "ri": "r"}
ROMAN_PATTERN = "|".join(ROMAN_UNITS) + "|[0-9']"


def _map(d: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in d.items() for x in kv))


def _finish(units: Column, level: str) -> Column:
    coarse = level == "coarse"

    def unit(u, i):
        vowel = F.substring(u, 2, 9)
        first = F.try_element_at(_map(COARSE_VOWELS), vowel) if coarse else vowel
        plain = F.coalesce(F.try_element_at(_map(COARSE), u), u) if coarse else u
        return F.when(F.substring(u, 1, 1) == "V", F.when(i == 0, first)).when(u == "y", F.when(i == 0, F.lit("j"))).otherwise(plain)

    kept = F.filter(F.transform(units, unit), lambda u: u.isNotNull())
    joined = F.aggregate(kept, F.array().cast("array<string>"), lambda acc, u: F.when(F.try_element_at(acc, F.lit(-1)).eqNullSafe(u), acc).otherwise(F.concat(acc, F.array(u))))
    return F.array_join(joined, "")


def key_from_roman(c, level: str = "coarse") -> Column:
    """level: coarse or fine. The word is normalised first."""
    parts = F.regexp_extract_all(normalize_roman(c), F.lit(ROMAN_PATTERN), F.lit(0))
    units = F.filter(F.transform(parts, lambda p: F.try_element_at(_map(ROMAN_UNITS), p)), lambda u: u.isNotNull())
    return _finish(units, level)


def key_from_bangla(c, level: str = "coarse") -> Column:
    consonant = f"[{BANGLA_CONSONANTS}]"
    parts = F.regexp_extract_all(match_key(c), F.lit(f"{consonant}{NUKTA}|{VIRAMA}য|{VIRAMA}ব|(?s:.)"), F.lit(0))

    def units_of(p):
        known = F.try_element_at(_map(BANGLA_UNITS | NUKTA_UNITS | {VIRAMA + "য": "y", VIRAMA + "ব": "?b"}), p)
        plain = F.try_element_at(_map(BANGLA_UNITS), F.substring(p, 1, 1))
        return F.coalesce(known, F.when(p.rlike(f"^{consonant}{NUKTA}$"), plain))

    units = F.filter(F.transform(parts, units_of), lambda u: u.isNotNull())
    # ba after a virama is silent, but for a word that begins with it
    units = F.filter(F.transform(units, lambda u, i: F.when(u != "?b", u).when(i == 0, F.lit("b"))), lambda u: u.isNotNull())
    return _finish(units, level)
