"""Registry upkeep: merge, incremental rebuild, resume points, unique slugs, progress."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import name_key


def ordered_distinct(df: DataFrame, key: str, order: str, value: str, name: str, separator: str = ",") -> DataFrame:
    """key and the values' first spellings by normalised key, in order of appearance, joined."""
    first = df.filter(F.trim(value) != "").groupBy(key, name_key(F.col(value)).alias("__k")).agg(F.min_by(value, order).alias("__v"), F.min(order).alias("__o"))
    rows = F.array_sort(F.collect_list(F.struct("__o", "__v")))
    return first.groupBy(key).agg(F.array_join(F.transform(rows, lambda x: x["__v"]), separator).alias(name))


def merge(df: DataFrame, key: str, order: str, fill: list[str], gather: list[str], absent: tuple[str, ...] = ("", "unknown")) -> DataFrame:
    """One row per key: the first known value of the fill columns, the distinct values of the gather columns in order.

    Rows that agree in their key are one record; the first one made it and the others fill what it lacks.
    """
    known = lambda c: F.when(~F.coalesce(F.col(c), F.lit("")).isin(*absent), F.col(c))
    first = [F.min_by(known(c), F.when(known(c).isNotNull(), F.col(order))).alias(c) for c in fill]
    out = df.groupBy(key).agg(F.count("*").alias("n_rows"), *first)
    for c in gather:
        out = out.join(ordered_distinct(df, key, order, c, c), key, "left")
    return out


def stale(current: DataFrame, stored: DataFrame, key: str, digest: str) -> DataFrame:
    """Keys to make anew: never stored, or stored under another digest; reason says which."""
    old = stored.select(key, F.col(digest).alias("__old"))
    rows = current.join(old, key, "left").filter(~F.col("__old").eqNullSafe(F.col(digest)))
    return rows.select(key, F.when(F.col("__old").isNull(), "missing").otherwise("changed").alias("reason"))


def resume_points(df: DataFrame, key: str, idx: str, stage: str, completed: str | None = None) -> DataFrame:
    """key and where to go on: the first failed chapter, else the running one, else (after an unfinished run) the last completed one,
    else the first that is stale or missing, else 0. completed: a column with the number of chapters the last run completed."""
    at = lambda *s: F.min(F.when(F.col(stage).isin(*s), F.col(idx)))
    last = [F.max(F.when((F.col(completed) > 0) & (F.col(completed) <= F.col("__n")), F.col(completed) - 1))] if completed else []
    if completed:
        df = df.join(df.groupBy(key).agg(F.count("*").alias("__n")), key)
    return df.groupBy(key).agg(F.coalesce(at("failed"), at("running"), *last, at("stale", "missing"), F.lit(0)).cast("long").alias("resume_at"))


def unique_slugs(df: DataFrame, slug: str, order: str, name: str = "unique_slug") -> DataFrame:
    """The first row of a slug keeps it; later ones get _2, _3 ... A slug that a third of all rows share is numbered by blocks."""
    from .sequence import running_sum

    counted = running_sum(df.withColumn("__one", F.lit(1)), slug, order, "__one", "__earlier")
    number = F.col("__earlier") + 1
    return counted.withColumn(name, F.when(number == 1, F.col(slug)).otherwise(F.concat_ws("_", F.col(slug), number.cast("string")))).drop("__one", "__earlier")


def progress(df: DataFrame, key: str, order: str, kind: str, idx: str) -> DataFrame:
    """A job's state from its events: completed is the most ever reached; a failure keeps its chapter; the last event is the status."""
    done = F.max(F.when(F.col(kind) == "completed", F.col(idx)).when(F.col(kind) == "started", F.col(idx) - 1))
    return df.groupBy(key).agg(
        F.coalesce(F.greatest(done, F.lit(0)), F.lit(0)).cast("long").alias("completed"),
        F.max_by(kind, order).alias("status"),
        F.max(F.when(F.col(kind) == "failed", F.col(idx))).cast("long").alias("failed_at"),
    )


def variants(df: DataFrame, person: str, role: str, label: str) -> DataFrame:
    """Each role with the labels of all records of its person, distinct and sorted: one aggregate, not a self-join of pairs."""
    labels = df.groupBy(person).agg(F.array_join(F.sort_array(F.collect_set(label)), ",").alias("variants"), F.count("*").alias("n_records"), F.min(role).alias("first_role"))
    return df.select(person, role).join(labels, person)

