"""Roll-ups of measurements: ratios, repeats, thresholds, peaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, or null if b is not positive."""
    return F.when(b > 0, a / b)


def average_repeats(df: DataFrame, key: str, seconds: str, playback: str, peak: str, ok: str, error: str) -> DataFrame:
    """One row per key over its repeats: means over successful ones (0 without any), largest peak, all-or-nothing success, errors."""
    good = F.bool_and(ok)
    every = F.avg(seconds)
    out = df.groupBy(key).agg(
        F.count("*").alias("repeats"),
        good.alias("success"),
        F.coalesce(every, F.lit(0.0)).alias("seconds"),
        F.coalesce(F.avg(F.when(F.col(ok), F.col(playback))), F.lit(0.0)).alias("playback"),
        F.max(peak).alias("peak"),
        F.array_join(F.sort_array(F.collect_list(error)), "; ").alias("__errors"),
    )
    s, p = F.col("seconds"), F.col("playback")
    return out.select(
        key, "repeats", "success", "seconds", "playback", "peak",
        F.when(F.col("success"), ratio(s, p)).alias("rtf"),
        F.when(F.col("success"), ratio(p, s)).alias("speed"),
        F.when(~F.col("success"), F.coalesce(F.nullif("__errors", F.lit("")), F.lit("repeat failed"))).alias("error"),
    )


def first_under(df: DataFrame, group: str, order: str, value: str, thresholds: list[float]) -> DataFrame:
    """group, threshold, at: the first row in order whose value is at or below each threshold."""
    columns = [F.min(F.when(F.col(value) <= t, F.col(order))).alias(f"t{i}") for i, t in enumerate(thresholds)]
    wide = df.groupBy(group).agg(*columns)
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"t{i}").alias("at")) for i, t in enumerate(thresholds)]))
    return wide.select(group, each.alias("x")).select(group, "x.threshold", "x.at")


def until_limit(df: DataFrame, group: str, order: str, value: str, limit: float) -> DataFrame:
    """Rows in order up to and with the first whose value reaches the limit: one aggregate and a join, no ordered frame."""
    stop = df.groupBy(group).agg(F.min(F.when(F.col(value) >= limit, F.col(order))).alias("__stop"))
    return df.join(stop, group).filter(F.col("__stop").isNull() | (F.col(order) <= F.col("__stop"))).drop("__stop")


def gigabytes(c: Column) -> Column:
    return F.bround(c / F.lit(1024.0**3), 3)


def used_memory(free: Column, total: Column) -> Column:
    """Bytes in use, not below zero; null without a total."""
    return F.when(total > 0, F.greatest(F.lit(0), total - free))
