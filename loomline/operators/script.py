"""From attributed quotes and narration to speakable jobs: decode joins, segments with offsets, job projections, pruning, halving."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrow import slices
from ..functions.text import SENTENCE_BREAK, sentences
from .sequence import ordered_fold, speech_windows

# Bounds of the named window profiles; any other name means balanced.
PROFILES = {"precise": (2400, 4), "balanced": (6000, 8), "fast": (9000, 8)}


def decoded(rows: DataFrame, codes: DataFrame, key: str, code: str, value: str, strict: bool = True) -> DataFrame:
    """rows with the value that their code stands for in their key's dictionary (codes: key, code, value).

    A code without a value is an error, or null if not strict.
    """
    one = codes.select(key, F.col(code).alias("__c"), F.col(value).alias("__v"))
    met = rows.join(one, (rows[key] == one[key]) & rows[code].eqNullSafe(F.col("__c")), "left").drop(one[key])
    failed = F.raise_error(F.concat(F.lit(f"no {value} for {code} "), F.coalesce(F.col(code).cast("string"), F.lit("null"))))
    found = F.coalesce("__v", failed.cast(codes.schema[value].dataType)) if strict else F.col("__v")
    return met.withColumn(value, found).drop("__c", "__v")


def attributed(quotes: DataFrame, attribution: DataFrame, key: str, idx: str, strict: bool = True) -> DataFrame:
    """quotes with the columns of their attribution; a quote without any is an error, or drops out if not strict."""
    side = attribution.withColumn("__has", F.lit(True))
    met = quotes.join(side, [key, idx], "left" if strict else "inner")
    if not strict:
        return met.drop("__has")
    failed = F.raise_error(F.concat(F.lit("no attribution of quote "), F.col(idx).cast("string")))
    return met.withColumn("__has", F.coalesce("__has", failed.cast("boolean"))).filter("__has").drop("__has")


def script_units(rows: DataFrame, units: DataFrame, key: str, idx: str) -> DataFrame:
    """Script rows with the columns of their units; a row of a unit that isn't there is an error, units without a row drop out."""
    met = rows.join(units.withColumn("__has", F.lit(True)), [key, idx], "left")
    failed = F.raise_error(F.concat(F.lit("unknown unit "), F.coalesce(F.col(idx).cast("string"), F.lit("null"))))
    return met.withColumn("__has", F.coalesce("__has", failed.cast("boolean"))).filter("__has").drop("__has")


def quote_segments(df: DataFrame, key: list[str], text: str, spoken: str) -> DataFrame:
    """key, part, is_quote, segment: a unit's quotes and what stands between them, trimmed, without blanks.

    A quote opens with either opening mark and closes with either closing mark; one that stays open runs on. A spoken unit that has
    closing marks alone begins inside a quote.
    """
    t = F.col(text)
    closes = F.col(spoken) & ~F.regexp_like(t, F.lit('["“]')) & F.contains(t, F.lit("”"))
    plain = F.transform(F.regexp_extract_all(t, F.lit('["“][^"”]*(?:["”]|\\z)|[^"“]+'), F.lit(0)), lambda x: F.struct(F.regexp_like(x, F.lit('^["“]')).alias("q"), F.btrim(F.regexp_replace(x, r"^\s+|\s+$", "")).alias("t")))
    inside = F.transform(F.regexp_extract_all(t, F.lit("[^”]*”|[^”]+"), F.lit(0)), lambda x, i: F.struct((i == 0).alias("q"), F.btrim(F.regexp_replace(x, r"^\s+|\s+$", "")).alias("t")))
    parts = F.filter(F.when(closes, inside).otherwise(plain), lambda x: x["t"] != "")
    rows = df.select(*key, F.posexplode(parts).alias("part", "__x"))
    return rows.select(*key, F.col("part").cast("long").alias("part"), F.col("__x.q").alias("is_quote"), F.col("__x.t").alias("segment"))


def narration_sentences(df: DataFrame, key: list[str], text: str, start: str) -> DataFrame:
    """key, part, sentence, begin, end: a narration span's sentences with their places in the chapter (start: the span's own).

    A sentence is looked for from where the one before ended; one whose white space was squeezed is taken to stand right there.
    One pass over each span, in Arrow batches.
    """
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in key)
    whole = F.btrim(F.regexp_replace(F.col(text), r"^\s+|\s+$", ""))
    rows = df.select(*key, F.col(text).alias("__t"), F.col(start).cast("long").alias("__s"), F.filter(sentences(whole), lambda x: F.btrim(x) != "").alias("__p"))

    def run(batches: Iterator[pa.RecordBatch]):
        n = len(key)
        for b in slices(batches, n):
            row, part, said, begin = [], [], [], []
            for r, (t, s, parts) in enumerate(zip(*(b.column(n + i).to_pylist() for i in range(3)))):
                cursor = len(t or "") - len((t or "").lstrip())
                for k, p in enumerate(parts or []):
                    at = t.find(p, cursor)
                    at = cursor if at < 0 else at
                    cursor = at + len(p)
                    row.append(r)
                    part.append(k)
                    said.append(p)
                    begin.append(s + at)
            at = pa.array(row, pa.int64())
            yield pa.record_batch([*(b.column(i).take(at) for i in range(n)), pa.array(part, pa.int64()), pa.array(said, pa.string()), pa.array(begin, pa.int64()), pa.array([x + len(p) for x, p in zip(begin, said)], pa.int64())], names=[*key, "part", "sentence", "begin", "end"])

    return rows.mapInArrow(run, f"{kinds}, part long, sentence string, begin long, end long")


def span_sentences(text: Column) -> Column:
    """A narration span's sentences without their places, in order."""
    return F.filter(sentences(F.coalesce(text, F.lit(""))), lambda x: F.btrim(x) != "")


def segments(quotes: DataFrame, narration: DataFrame, key: str, order: list[str], name: str = "unit_id") -> DataFrame:
    """Both tables as one, numbered densely from 0 by the order columns; ties keep the order of seq, which both carry."""
    both = quotes.unionByName(narration, allowMissingColumns=True)
    return both.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order, "seq")).cast("long") - 1)


def jobs(units: DataFrame) -> DataFrame:
    """The columns of a unit that speech generation needs, under its names; optional ones stay if they are there."""
    optional = [c for c in ("character", "voice_variant") if c in units.columns]
    return units.select("chapter", F.col("unit_id").alias("sentence_idx"), F.col("unit_id").alias("unit_idx"), "role", "role_id", "type", "text", "voice_config_path", F.col("start").alias("source_start"), F.col("end").alias("source_end"), *optional)


def unnested(windows: DataFrame, key: str, window: str, sections: str, items: str) -> DataFrame:
    """key, window, section, job and the job's fields, of windows that hold sections that hold jobs."""
    s = windows.select(key, window, F.posexplode(sections).alias("section", "__s"))
    j = s.select(key, window, "section", F.posexplode(F.col(f"__s.{items}")).alias("job", "__j"))
    return j.select(key, window, F.col("section").cast("long").alias("section"), F.col("job").cast("long").alias("job"), "__j.*")


def nested(rows: DataFrame, key: str, window: str, section: str, order: str, fields: list[str]) -> DataFrame:
    """key, windows: jobs in order inside sections inside windows, each once (the inverse of unnested)."""
    job = F.struct(F.col(order).alias("order"), *fields)
    each = rows.groupBy(key, window, section).agg(F.array_sort(F.collect_list(job)).alias("jobs"))
    each = each.groupBy(key, window).agg(F.array_sort(F.collect_list(F.struct(F.col(section).alias("section"), "jobs"))).alias("sections"))
    return each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(window).alias("window"), "sections"))).alias("windows"))


def profile_windows(df: DataFrame, key: str, order: list[str], role: str, text: str, mode: str | None = "balanced") -> DataFrame:
    """window_id by the bounds of a named profile."""
    most, roles = PROFILES.get(str(mode or "balanced").strip().lower(), PROFILES["balanced"])
    return speech_windows(df, key, order, role, text, most, roles, alone=True)


def pruned(roles: DataFrame, rows: DataFrame, key: str, code: str) -> tuple[DataFrame, DataFrame]:
    """roles that rows refer to, renumbered densely in their old order, and rows with the new numbers."""
    used = roles.join(rows.select(key, code).distinct(), [key, code], "left_semi")
    fresh = used.withColumn("__new", F.row_number().over(Window.partitionBy(key).orderBy(code)).cast("long") - 1)
    moved = rows.join(fresh.select(key, code, "__new"), [key, code]).withColumn(code, F.col("__new")).drop("__new")
    return fresh.withColumn(code, F.col("__new")).drop("__new"), moved


def halved(df: DataFrame, key: list[str], order: str, value: str, attempt: Callable[[list], bool]) -> DataFrame:
    """key, first, last, ok: the ranges of a window's rows that an attempt accepts, each failing one halved until it does or is one row.

    attempt is sent to the executors; a window, whose size its maker bounds, is one group.
    """
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in key)

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by(order)
        at, values = group[order].to_pylist(), group[value].to_pylist()
        todo, out = [(0, len(at))], []
        while todo:
            lo, hi = todo.pop()
            ok = attempt(values[lo:hi])
            if ok or hi - lo <= 1:
                out.append((at[lo], at[hi - 1], ok))
            else:
                middle = lo + (hi - lo) // 2
                todo += [(middle, hi), (lo, middle)]
        return pa.table([*(pa.array([group[c][0].as_py()] * len(out), group.schema.field(c).type) for c in key), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.bool_())], names=[*key, "first", "last", "ok"])

    return df.select(*key, F.col(order).cast("long").alias(order), value).groupBy(*key).applyInArrow(run, f"{kinds}, first long, last long, ok boolean")


def voice_paths(jobs_: DataFrame, order: str) -> DataFrame:
    """jobs with the voice that their role_id, or else their role, was last registered with; neither is an error."""
    def last(c: str) -> DataFrame:
        key = F.btrim(F.coalesce(c, F.lit("")))
        known = jobs_.filter((key != "") & F.col("voice_config_path").isNotNull())
        return known.groupBy(key.alias(f"__{c}")).agg(F.max_by("voice_config_path", order).alias(f"__{c}_path"))

    met = jobs_.join(last("role_id"), F.btrim(F.coalesce("role_id", F.lit(""))) == F.col("__role_id"), "left").join(last("role"), F.btrim(F.coalesce("role", F.lit(""))) == F.col("__role"), "left")
    failed = F.raise_error(F.concat(F.lit("no voice registered for role "), F.coalesce("role", F.lit("?")))).cast("string")
    return met.select(*jobs_.columns, F.coalesce("__role_id_path", "__role_path", failed).alias("voice_path"))


def tokenised(df: DataFrame, key: str, text: str, tokenizer: Callable[[str], list[str]]) -> DataFrame:
    """key, idx, sentence by any tokenizer that is a function of a text; blank sentences drop out after they are numbered."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]):
        for b in slices(batches, 1):
            rows = [(i, k, s.strip()) for i, t in enumerate(b.column(1).to_pylist()) for k, s in enumerate(tokenizer(t or "")) if s.strip()]
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.record_batch([b.column(0).take(at), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], names=[key, "idx", "sentence"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, idx long, sentence string")


def punkt(text: str) -> list[str]:
    """Sentences by the Punkt model where nltk and its data are installed, else by rule."""
    try:
        import nltk

        return nltk.sent_tokenize(text)
    except (ImportError, LookupError):
        import re

        squeezed = " ".join(text.split())
        return re.split(SENTENCE_BREAK, squeezed) if squeezed else []


def session(df: DataFrame, key: str, order: str, kind: str, seconds: str) -> DataFrame:
    """A playback session's commands folded in order: ready units, ready seconds and next unit after each one.

    generate appends a unit of so many seconds, consume takes the oldest ready one, end empties the buffer and all later commands do nothing.
    """

    def start():
        ready, total, made, ended = deque(), Fraction(0), 0, False  # an exact sum, as it goes up and down

        def step(k, s):
            nonlocal total, made, ended
            if k == "end":
                ended, total = True, Fraction(0)
                ready.clear()
            elif not ended and k == "generate":
                ready.append(Fraction(s or 0.0))
                total += ready[-1]
                made += 1
            elif not ended and k == "consume" and ready:
                total -= ready.popleft()
            return len(ready), float(total), made

        return step

    return ordered_fold(df, key, [order], start, [kind, seconds], {"n_ready": ("long", pa.int64()), "ready_seconds": ("double", pa.float64()), "next_unit": ("long", pa.int64())})
