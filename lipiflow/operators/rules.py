"""Rule-based transliteration: an ordered list of patterns, some with context rules, and a table of exceptions.

The bundle is data: {"patterns": [{"find", "replace", "rules": [{"replace", "matches": [{"type", "scope", "value"}]}]}],
"vowel", "consonant", "casesensitive": strings of characters, "exceptions": {output: input}, or pairs of them}.
Patterns are compiled to tries, so that the work at a letter does not grow with the list; one search over all exceptions
at once tells the texts that hold any.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
import pyspark.sql.types as T
from pyspark.sql import DataFrame

#: What stands around the output of an exception until all of them have been applied (fixed value).
OPEN, CLOSE = "<rm>", "</rm>"


class Trie:
    """Of patterns by their text; finds the one that comes first in the list among those that match at a place."""

    def __init__(self, patterns: list[dict]):
        self.patterns, self.root = patterns, {}
        for number, p in enumerate(patterns):
            node = self.root
            for c in p["find"]:
                node = node.setdefault(c, {})
            node.setdefault("", number)

    def first(self, text: str, at: int) -> dict | None:
        node, best = self.root, self.root.get("", len(self.patterns))
        while at < len(text) and (node := node.get(text[at])) is not None:
            best, at = min(best, node.get("", best)), at + 1
        return self.patterns[best] if best < len(self.patterns) else None


class Rules:
    """A compiled bundle. Patterns without rules are tried before those with, each in list order."""

    def __init__(self, bundle: dict):
        self.vowels, self.consonants, self.keep_case = (set(bundle.get(name, "")) for name in ("vowel", "consonant", "casesensitive"))
        exceptions = bundle.get("exceptions", {})
        pairs = exceptions.items() if isinstance(exceptions, dict) else exceptions
        self.exceptions = [(out, re.compile(re.escape(text.lower()), re.IGNORECASE | re.ASCII)) for out, text in pairs if text]
        self.any_exception = re.compile("|".join(p.pattern for _, p in self.exceptions) or r"(?!)", re.IGNORECASE | re.ASCII)
        patterns = bundle.get("patterns", [])
        self.plain = Trie([p for p in patterns if p.get("rules") is None])
        self.ruled = Trie([p for p in patterns if p.get("rules") is not None])

    def _kind(self, c: str) -> str:
        """A letter is a vowel or a consonant by its lower case too; everything else is punctuation."""
        both = {c, *c.lower()}
        return "vowel" if both & self.vowels else "consonant" if both & self.consonants else "punctuation"

    def _holds(self, match: dict, text: str, a: int, b: int) -> bool:
        """Whether a condition on what stands before a, or from b on, holds."""
        kind, scope = match.get("type"), match.get("scope")
        if kind is None or scope is None:
            return False
        negative, scope = scope.startswith("!"), scope.removeprefix("!")
        before = kind == "prefix"
        if scope == "exact":
            value = match.get("value")
            if value is None:
                return False
            start = a - len(value) if before else b
            end = start + len(value)
            # the end must lie strictly inside the text: a suffix at its very end is not seen
            return (start >= 0 and end < len(text) and text[start:end] == value) != negative
        if scope not in ("vowel", "consonant", "punctuation"):
            return True
        at = a - 1 if before else b
        found = "punctuation" if at < 0 or at >= len(text) else self._kind(text[at])
        return (found == scope) != negative

    def _segment(self, text: str) -> str:
        out, i = [], 0
        while i < len(text):
            c = text[i]
            if ord(c) < 128:
                p = self.plain.first(text, i)
                if p and isinstance(p.get("replace"), str):
                    out.append(p["replace"])
                    i += len(p["find"]) or 1
                    continue
                if p := self.ruled.first(text, i):
                    end = i + len(p["find"])
                    rule = next((r for r in p["rules"] if all(self._holds(m, text, i, end) for m in r.get("matches", []))), None)
                    out.append((rule or {}).get("replace") or p.get("replace") or "")
                    i = max(end, i + 1)
                    continue
            out.append(c)
            i += 1
        return "".join(out)

    def transliterate(self, text: str) -> str:
        text = "".join(c if set(c.lower()) & self.keep_case else c.lower() for c in text)
        if not self.any_exception.search(text):
            return self._segment(text)
        # each exception is applied to what those before it have left, their outputs and marks included
        for out, pattern in self.exceptions:
            text = pattern.sub(lambda m, out=out: f"{OPEN}{out}{CLOSE}", text)
        parts = re.split(f"({OPEN}.*?{CLOSE})", text)
        return "".join(p[len(OPEN) : -len(CLOSE)] if i % 2 else self._segment(p) for i, p in enumerate(parts))


def transliterated(df: DataFrame, column: str, bundle: dict, out: str = "bangla") -> DataFrame:
    """Adds the transliteration of a column; the bundle travels with the task as text. Give distinct texts: each is worked out where it stands."""
    text = json.dumps(bundle)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rules = Rules(json.loads(text))
        for b in batches:
            yield b.assign(**{out: [None if t is None else rules.transliterate(t) for t in b[column]]})

    return df.mapInPandas(run, T.StructType([*df.schema.fields, T.StructField(out, T.StringType())]))


def encode_source(roman, vocabulary: dict[str, int], lang: str, unknown: int, end: int):
    """Array of ids: the language's token, one for each character, the end; as an expression."""
    from pyspark.sql import functions as F

    ids = _character_ids(roman, vocabulary, unknown)
    return F.concat(F.array(F.lit(vocabulary.get(f"__{lang}__", unknown))), ids, F.array(F.lit(end)))


def _character_ids(text, vocabulary: dict[str, int], unknown: int):
    from pyspark.sql import functions as F

    table = F.create_map(*(F.lit(x) for kv in vocabulary.items() for x in kv))
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.coalesce(F.try_element_at(table, c), F.lit(unknown)))


def encode_source_in_context(roman, context, mode: str, separator: str, vocabulary: dict[str, int], unknown: int, end: int, words: int = 3, word_ids=None, first_word_id: int = 0, unknown_word: int = 0):
    """Array of ids: the mode's token, the words before (at most `words`, the last ones), the separator, the letters, the end.

    context is an array of words. They are written letter by letter with spaces between; with word_ids, a map column from
    words to numbers, they also stand whole before that, numbered from first_word_id, those not in the map as unknown_word.
    """
    from pyspark.sql import functions as F

    kept = F.slice(context, F.greatest(F.size(context) - words + 1, F.lit(1)), words)
    one = lambda name: F.array(F.lit(vocabulary.get(name, unknown)))
    whole = [F.transform(kept, lambda w: F.lit(first_word_id) + F.coalesce(F.try_element_at(word_ids, w), F.lit(unknown_word)))] if word_ids is not None else []
    return F.concat(one(mode), *whole, _character_ids(F.array_join(kept, " "), vocabulary, unknown), one(separator), _character_ids(roman, vocabulary, unknown), F.array(F.lit(end)))
