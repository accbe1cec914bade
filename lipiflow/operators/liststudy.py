"""What a list of candidates gains and loses if predicted words are put into it, for several rules of doing so at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Where predicted words are put in and how many at most; the first rule puts in none. Length of the list.
RULES = ((0, 0), (1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (3, 2))
SHOWN, PREDICTED = 5, 2


def places(size: Column, own: Column, at: list[Column], is_it: list[Column], rules: tuple[tuple[int, int], ...] = RULES, k: int = SHOWN) -> Column:
    """Array with an entry for each rule: the place of the wanted word, from 1, in the list that the rule makes, or 0.

    No list is made: the place follows from the ordinary list's size, the wanted word's place in it, and for each predicted word, in
    their order, its place in it (NULL: no such word) and whether it is the wanted one. Neither list holds a word twice.
    """
    table = F.array(*(F.struct(F.lit(start).alias("start"), F.lit(n).alias("n")) for start, n in rules))

    def place(r: Column) -> Column:
        used, moved, among = F.lit(0), F.lit(0), []
        for p, same in zip(at, is_it):
            # a predicted word is put in if it is there, not in the head, and not after n others
            goes = p.isNotNull() & ((p == 0) | (p > r["start"])) & (used < r["n"])
            among.append(F.when(goes & same, F.least(size, r["start"]) + used + 1))
            moved = moved + (goes & (p > 0) & (p < own)).cast("int")
            used = used + goes.cast("int")
        return F.when((own > 0) & (own <= r["start"]), own).otherwise(F.coalesce(*among, F.when(own > 0, own + used - moved), F.lit(0)))

    return F.transform(F.transform(table, place), lambda p: F.when(p <= k, p).otherwise(0).cast("bigint"))


def typed_letters(roman: str, max_letters: int | None) -> Column:
    """1, 2 .. as many letters as are typed: max_letters at most or, if that is None, all but the last, with which there is nothing left to save."""
    return F.sequence(F.lit(1), F.length(roman) - 1 if max_letters is None else F.least(F.lit(max_letters), F.length(roman)))


def typed_places(tested: DataFrame, base: DataFrame, predicted: DataFrame, max_letters: int | None, rules: tuple[tuple[int, int], ...] = RULES, k: int = SHOWN) -> DataFrame:
    """prev, roman, word, n, letters, length, offered, among, own, at: where the word is once so many letters are typed.

    tested: prev, roman, word, n (how often the word stands there); romans of one letter are left out. base: typed, list, the
    ordinary list of what is typed; predicted: prev, typed, list, the words that the word before predicts, PREDICTED at most. Lists
    and words are match keys. A list that is missing is empty. own is the word's place in the ordinary list, at that in the list of
    each rule. All rules are applied to a row as it is: nothing is multiplied but the letters.
    """
    rows = tested.where(F.length("roman") >= 2).withColumn("length", F.length("roman"))
    rows = rows.withColumn("letters", F.explode(typed_letters("roman", max_letters))).withColumn("typed", F.substring(F.col("roman"), F.lit(1), F.col("letters")))
    # the ordinary lists, which most rows have, come last: no exchange carries them beside a row
    rows = rows.join(predicted.select("prev", "typed", F.col("list").alias("_more")), ["prev", "typed"], "left").join(base.select("typed", F.col("list").alias("_base")), "typed", "left")
    none = F.array().cast("array<string>")
    listed, more = F.coalesce("_base", none), F.slice(F.coalesce("_more", none), 1, PREDICTED)
    at, same = [f"_at{i}" for i in range(PREDICTED)], [f"_same{i}" for i in range(PREDICTED)]
    rows = rows.select(
        "prev", "roman", "word", "n", "letters", "length", (F.size(more) > 0).alias("offered"), F.array_contains(more, F.col("word")).alias("among"),
        F.array_position(listed, F.col("word")).alias("own"), F.size(listed).alias("_size"),
        *(F.array_position(listed, F.get(more, F.lit(i))).alias(c) for i, c in enumerate(at)),
        *(F.coalesce(F.get(more, F.lit(i)) == F.col("word"), F.lit(False)).alias(c) for i, c in enumerate(same)),
    )
    told = places(F.col("_size"), F.col("own"), [F.col(c) for c in at], [F.col(c) for c in same], rules, k)
    return rows.withColumn("at", told).drop("_size", *at, *same)


def by_letters(placed: DataFrame, rules: tuple[tuple[int, int], ...] = RULES, k: int = SHOWN) -> DataFrame:
    """For each rule and number of letters: tried, offered, offered_right, at1 .. at<k>, absent, and displaced.

    offered and offered_right say whether anything was predicted and whether the word was in it; displaced counts whole words
    that the rule's list has further down than the ordinary one, or not at all.
    """
    table = F.array(*(F.struct(F.lit(start).alias("start"), F.lit(n).alias("put_in")) for start, n in rules))
    rows = placed.select("*", F.inline(F.arrays_zip(table.alias("rule"), F.col("at").alias("place")))).select("*", "rule.start", "rule.put_in")
    count = lambda when, name: F.sum(F.when(when, F.col("n")).otherwise(0)).cast("bigint").alias(name)
    down = (F.col("letters") == F.col("length")) & (F.col("own") > 0) & ((F.col("place") == 0) | (F.col("place") > F.col("own")))
    return rows.groupBy("start", "put_in", "letters").agg(
        F.sum("n").cast("bigint").alias("tried"), count(F.col("offered"), "offered"), count(F.col("among"), "offered_right"),
        *(count(F.col("place") == i, f"at{i}") for i in range(1, k + 1)), count(F.col("place") == 0, "absent"), count(down, "displaced"),
    )


def keystrokes(placed: DataFrame, rules: tuple[tuple[int, int], ...] = RULES) -> DataFrame:
    """For each rule: words, plain, the keys that typing them in full takes, and needed, if each is picked as soon as it is seen.

    A word seen in the first place takes its letters so far and a space, in another one its number besides, but never
    more than the whole word and a space. A word counts as seen before its last letter only.
    """
    seen = lambda i: F.min(F.when((F.get("at", F.lit(i)) > 0) & (F.col("letters") < F.col("length")), F.struct("letters", F.get("at", F.lit(i)).alias("place"))))
    words = placed.groupBy("prev", "roman", "word", "n", "length").agg(*(seen(i).alias(f"_{i}") for i in range(len(rules))))
    needed = lambda s: F.when(s.isNull(), F.col("length") + 1).when(s["place"] == 1, s["letters"] + 1).otherwise(F.least(s["letters"] + 2, F.col("length") + 1))
    one = words.agg(F.sum("n").alias("words"), F.sum(F.col("n") * (F.col("length") + 1)).alias("plain"), *(F.sum(F.col("n") * needed(F.col(f"_{i}"))).alias(f"k{i}") for i in range(len(rules))))
    stack = F.array(*(F.struct(F.lit(s).alias("start"), F.lit(n).alias("put_in"), F.col("words").alias("words"), F.col("plain").alias("plain"), F.col(f"k{i}").alias("needed")) for i, (s, n) in enumerate(rules)))
    return one.where("words IS NOT NULL").select(F.inline(stack))
