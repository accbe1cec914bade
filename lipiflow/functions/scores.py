"""The ranker's formulas as expressions. A feature that was not measured is NULL."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from .text import col, looks_like_acronym

# The ranker's default weights, and the tuned ones.
DEFAULT_WEIGHTS = {
    "unigram": 1.0, "rom_exact": 2.5, "rom_exact_log": 0.8, "rom_exact_fast": 2.5, "rom_prefix": 0.3, "key_fine": 1.2, "key_coarse": 0.6, "key_prefix": -1.0,
    "gap": -0.4, "xlit_logp": 0.5, "xlit_top1": 1.5, "xlit_top3": 0.7, "avro": 0.8, "oov": -3.0, "personal_sel": 5.0, "personal_word": 0.6, "bigram": 0.7,
    "spelled": 0.0, "latin_base": -6.0, "latin": 0.0,
}
TUNED_WEIGHTS = {
    "avro": 0.0, "bigram": 0.5, "gap": -0.4, "key_coarse": 0.6, "key_fine": 0.6, "key_prefix": -2.0, "latin": 0.0, "latin_base": -6.0, "oov": -6.0,
    "personal_sel": 5.0, "personal_word": 0.6, "rom_exact": 2.0, "rom_exact_fast": 2.5, "rom_exact_log": 1.6, "rom_prefix": 0.0, "spelled": 4.0, "unigram": 0.5,
    "xlit_logp": 0.75, "xlit_top1": 1.5, "xlit_top3": 2.0,
}
# The weights that a search moves, and to what; none of unigram is negative.
SEARCHED = {
    "unigram": (0.5, 0.75, 1.0, 1.25, 1.5), "rom_exact": (0.0, 1.0, 2.0, 3.0, 4.0, 6.0), "rom_exact_log": (0.0, 0.4, 0.8, 1.2, 1.6), "rom_prefix": (-0.5, 0.0, 0.3, 0.6),
    "key_fine": (0.0, 0.6, 1.2, 2.0, 3.0), "key_coarse": (0.0, 0.3, 0.6, 1.2, 2.0), "key_prefix": (-3.0, -2.0, -1.0, 0.0), "gap": (-1.5, -1.0, -0.6, -0.4, -0.2, 0.0),
    "xlit_logp": (0.1, 0.2, 0.35, 0.5, 0.75, 1.0, 1.5), "xlit_top1": (0.0, 1.0, 1.5, 2.5, 4.0), "xlit_top3": (0.0, 0.5, 1.0, 2.0), "avro": (0.0, 0.5, 1.0, 2.0),
    "oov": (-6.0, -4.0, -3.0, -2.0, -1.0, 0.0), "bigram": (0.0, 0.25, 0.5, 0.7, 1.0, 1.5),
}
REGISTER_WEIGHTS = {"wiki": 1, "subs": 3, "chat": 20}
UNKNOWN_CONFIDENT_LOGP, BACKOFF = -11.0, math.log(0.4)
HALF_LIFE_DAYS = 90.0


def weights(overlay: dict[str, float] | None = None) -> dict[str, float]:
    """Defaults, overlaid by name."""
    return DEFAULT_WEIGHTS | (overlay or {})


def corpus_score(wiki="wiki", subs="subs", chat="chat") -> Column:
    return col(wiki) + REGISTER_WEIGHTS["subs"] * col(subs) + REGISTER_WEIGHTS["chat"] * col(chat)


def unigram_logp(score, total) -> Column:
    """ln((score + 0.5) / total); a word without a score, NULL, has the floor ln(0.5 / total)."""
    return F.log((F.coalesce(col(score), F.lit(0)) + 0.5) / col(total))


def context_adjust(pair_count, prev_total, unigram) -> Column:
    """How much the word before changes a word's log probability."""
    seen = F.log(col(pair_count) / col(prev_total)) - col(unigram)
    return F.when(col(prev_total).isNull() | (col(prev_total) == 0), F.lit(0.0)).when(col(pair_count) > 0, seen).otherwise(F.lit(BACKOFF))


def personal_bonus(count, share, w: dict[str, float]) -> Column:
    return w["personal_sel"] * F.log1p(col(count)) * (0.5 + col(share))


def decayed(count, last, now) -> Column:
    """A count after the days since `last`, in seconds, at the half-life."""
    return col(count) * F.exp(-math.log(2) / (HALF_LIFE_DAYS * 86400) * F.greatest(F.lit(0.0), (col(now) - col(last)).cast("double")))


def _feature(df_columns, name: str, default) -> Column:
    return F.coalesce(F.col(name), F.lit(default)) if name in df_columns else F.lit(default)


def score_features(columns: list[str], w: dict[str, float], context=None, fast: bool = False) -> Column:
    """The log-linear score over the feature columns that are there; others count as not measured.

    Features: uni, in_lexicon, word, rom_exact, rom_prefix, key_fine, key_coarse, key_fine_prefix, key_coarse_prefix, gap,
    xlit_rank, xlit_logp, avro, spelled, personal_sel, personal_share, personal_word, is_latin.
    """
    f = lambda name, default=0: _feature(columns, name, default)
    flag = lambda name: _feature(columns, name, False)
    xl = F.col("xlit_logp") if "xlit_logp" in columns else F.lit(None).cast("double")
    known, zero = xl.isNotNull(), F.lit(0.0)
    in_lexicon = _feature(columns, "in_lexicon", True)
    acronym = ~in_lexicon & (looks_like_acronym("word") if "word" in columns else F.lit(False))
    doubt = F.greatest(zero, F.least(F.lit(1.0), -xl / 3))
    uni = F.col("uni") + F.when(~in_lexicon & known & ~acronym, (UNKNOWN_CONFIDENT_LOGP - F.col("uni")) * (1 - doubt)).otherwise(zero)
    s = w["unigram"] * uni
    s += F.when(f("rom_exact") > 0, w["rom_exact"] + w["rom_exact_log"] * F.log1p(f("rom_exact"))).otherwise(zero)
    s += F.when((f("rom_prefix") > 0) & (f("rom_exact") == 0), w["rom_prefix"] * F.log1p(f("rom_prefix"))).otherwise(zero)
    s += (
        F.when(flag("key_fine"), F.lit(w["key_fine"]))
        .when(flag("key_coarse"), F.lit(w["key_coarse"]))
        .when(flag("key_fine_prefix") | flag("key_coarse_prefix"), F.lit(w["key_prefix"]))
        .otherwise(zero)
    )
    s += w["xlit_logp"] * F.when(known, F.greatest(xl, F.lit(-40.0))).otherwise(F.lit(-15.0))  # greatest() skips NULL
    s += F.when((f("gap") > 0) & (f("rom_exact") == 0), w["gap"] * f("gap")).otherwise(zero)
    s += F.when(f("xlit_rank") == 1, F.lit(w["xlit_top1"])).when(f("xlit_rank").between(2, 3), F.lit(w["xlit_top3"])).otherwise(zero)
    s += F.when(flag("avro"), F.lit(w["avro"])).otherwise(zero) + F.when(flag("spelled"), F.lit(w["spelled"])).otherwise(zero)
    s += F.when(~in_lexicon, w["oov"] * F.when(~known | acronym, F.lit(1.0)).otherwise(doubt)).otherwise(zero)
    bonus = w["personal_sel"] * F.log1p(f("personal_sel", 0.0)) * (0.5 + f("personal_share", 0.0))
    s += F.when(f("personal_sel", 0.0) != 0, bonus).otherwise(zero)
    s += F.when(f("personal_word", 0.0) != 0, w["personal_word"] * F.log1p(f("personal_word", 0.0))).otherwise(zero)
    if context is not None:
        s += w["bigram"] * F.coalesce(col(context), zero)
    if fast:
        s += w["rom_exact_fast"] * F.log1p(f("rom_exact"))
    return F.when(flag("is_latin"), w["latin_base"] + w["latin"] + bonus).otherwise(s)


def static_prescore(columns: list[str]) -> Column:
    """A ranking that no weight moves; it picks the candidates worth a model's score."""
    # The constants of the sum.
    f = lambda name, default=0: _feature(columns, name, default)
    one = lambda c: c.cast("int")
    some = f("rom_exact") > 0
    longer = _feature(columns, "key_fine_prefix", False) | _feature(columns, "key_coarse_prefix", False) | (f("rom_prefix") > 0)
    s = F.col("uni") + 3.0 * one(some) + 0.5 * F.log1p(f("rom_exact")) + 1.5 * one(_feature(columns, "key_fine", False)) + 0.8 * one(_feature(columns, "key_coarse", False))
    return s + 2.5 * one(f("xlit_rank") > 0) + 1.0 * one(_feature(columns, "avro", False)) - one(longer) * one(~some)


def fast_supported(columns: list[str]) -> Column:
    """Evidence that needs no model: a key hit, a rule spelling, a completion or two attestations."""
    keys = F.lit(False)
    for name in ("key_fine", "key_coarse", "key_fine_prefix", "key_coarse_prefix", "avro"):
        keys = keys | _feature(columns, name, False)
    return keys | (_feature(columns, "rom_prefix", 0) > 0) | (_feature(columns, "rom_exact", 0) >= 2)
