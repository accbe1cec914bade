"""The personal model: counts that decay, from a log of commits."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scores import HALF_LIFE_DAYS


def decayed_counts(log: DataFrame, keys: list[str], now: float, time: str = "t") -> DataFrame:
    """keys, count, last: the sum of each commit's decay up to `now`, which is what step-by-step updates come to."""
    rate = math.log(2) / (HALF_LIFE_DAYS * 86400)
    age = F.greatest(F.lit(0.0), F.lit(float(now)) - F.col(time))
    return log.groupBy(*keys).agg(F.sum(F.exp(-rate * age)).alias("count"), F.max(time).alias("last"))


def personal_shares(counts: DataFrame, roman: str = "roman") -> DataFrame:
    """share of a word among all that were chosen for its roman."""
    return counts.withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy(roman)))
