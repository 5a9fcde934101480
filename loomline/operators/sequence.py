"""Ordered sequences: runs, greedy windows, prefix sums, timelines, apportionment.

Greedy windows depend on what came before, so they are folds: rows are dealt by group, sorted in the JVM, and streamed
through a Python state in Arrow batches; a group is never held as a whole. Windows of bounded sums can be folded by blocks, all at once. Everything else is window functions, at two levels:
within blocks of a key's order, and over one row for each block. So a key with a third of all rows is spread over its blocks.
Orders are whole numbers, one for each row of a key. Where depth() finds no key as long as a block, block may be None: one level
then gives the same rows with one shuffle less.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.text import speech, squeeze
from ..session import scratch


def ordered_fold(df: DataFrame, key: str | list[str], order: list[str], start: Callable[[], Callable], inputs: list[str], outputs: dict[str, tuple[str, pa.DataType]]) -> DataFrame:
    """df with columns that a stateful function yields row by row.

    start() makes a step function for a group; the step takes the inputs of a row and returns the outputs.
    """
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *(f"`{n}` {t}" for n, (t, _) in outputs.items())])
    key = _columns(key)

    def run(batches):
        current, step = object(), None
        for b in batches:
            names = b.schema.names
            keys = list(zip(*(b.column(names.index(k)).to_pylist() for k in key)))
            columns = [b.column(names.index(c)).to_pylist() for c in inputs]
            out = []
            for k, *row in zip(keys, *columns):
                if step is None or k != current:
                    current, step = k, start()
                out.append(step(*row))
            added = [pa.array([r[i] for r in out], kind) for i, (_, kind) in enumerate(outputs.values())]
            yield pa.record_batch([*b.columns, *added], names=[*names, *outputs])

    return df.repartition(*key).sortWithinPartitions(*key, *order).mapInArrow(run, schema)


LONG = ("long", pa.int64())
#: Rows of a key's order that are one block.
BLOCK = 10_000


def capacity_windows(df: DataFrame, key: str, order: list[str], size: str, most: int, most_rows: int = 0, alone: bool = False, block: int | None = None) -> DataFrame:
    """window_id from 0: a new window where the sizes' sum would pass most or the rows most_rows (0: no bound).

    A row larger than most is an error unless alone, when it may fill a window by itself; most of 0 is then no bound. With
    block, order is one whole number and keys are cut into blocks of so many of its values: a key of any length is worked on by as many
    tasks as it has blocks, and only a row for each block passes through one task.
    """
    if block is not None:
        return _windows_by_blocks(df, key, order[0], size, most, most_rows, alone, block)

    def start():
        window, total, rows = -1, 0, 0

        def step(n):
            nonlocal window, total, rows
            n = n or 0
            if n > most and not alone:
                raise ValueError(f"a row of size {n} exceeds the window size {most}")
            bound = most if most > 0 else math.inf
            if window < 0 or rows and (total + n > bound or most_rows and rows >= most_rows):
                window, total, rows = window + 1, 0, 0
            total, rows = total + n, rows + 1
            return (window,)

        return step

    return ordered_fold(df, key, order, start, [size], {"window_id": LONG})


def successors(sums: np.ndarray, most: float, most_rows: int) -> np.ndarray:
    """For each row the first row that no longer fits into a window which starts at it. sums: of the sizes before each row, and of all."""
    n = len(sums) - 1
    at = np.maximum(np.searchsorted(sums[1:], sums[:-1] + most, "right"), np.arange(1, n + 1))
    return np.minimum(at, np.arange(n) + most_rows) if most_rows else at


def block_paths(sizes: np.ndarray, most: float, most_rows: int) -> dict[str, np.ndarray]:
    """How the windows of a block go on for each row at which the first of them may start.

    sums: of the sizes before each such row, and up to the next; for each of them, starts: how many windows start from it on; total and rows: what the
    last one holds at the block's end. Rows at which nothing that came before the block could make a window start are left out.
    """
    sums = np.concatenate([[0], np.cumsum(sizes)])
    after, n = successors(sums, most, most_rows).tolist(), len(sizes)
    last, starts = list(range(n)), [1] * n
    for i in range(n - 1, -1, -1):
        if after[i] < n:
            last[i], starts[i] = last[after[i]], starts[after[i]] + 1
    reach = min(n, int(np.searchsorted(sums[:-1], most, "right")), most_rows + 1 if most_rows else n)
    last = np.array(last[:reach], np.int64)
    return {"sums": sums[: reach + 1].astype(np.int64), "starts": np.array(starts[:reach], np.int64), "total": (sums[-1] - sums[last]).astype(np.int64), "rows": n - last}


def _windows_by_blocks(df: DataFrame, key: str, order: str, size: str, most: int, most_rows: int, alone: bool, block: int) -> DataFrame:
    """Greedy windows in three steps: each block's paths from every row where a window may start, all blocks at once; one pass over the
    blocks of a key, a row each, to see where its first window starts; and the windows of all blocks at once."""
    bound = most if most > 0 else math.inf
    rows = df.withColumn("__block", F.floor(F.col(order) / block)).withColumn("__size", F.coalesce(F.col(size), F.lit(0)).cast("long"))
    if not alone:
        rows = rows.withColumn("__size", F.when(F.col("__size") <= most, F.col("__size")).otherwise(F.raise_error(F.concat(F.lit("a row of size "), F.col("__size").cast("string"), F.lit(f" exceeds the window size {most}"))).cast("long")))
    lists = ("sums", "starts", "total", "rows")
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, __block long, n long, whole long, " + ", ".join(f"{c} array<long>" for c in lists)

    def paths(batches):
        current, keys, held = None, None, []

        def close():
            sizes = np.concatenate(held)
            p = block_paths(sizes, bound, most_rows)
            return pa.record_batch([*keys, pa.array([len(sizes)]), pa.array([int(sizes.sum())]), *(pa.array([p[c]], pa.list_(pa.int64())) for c in lists)], names=[key, "__block", "n", "whole", *lists])

        for b in batches:
            sizes = b.column(2).to_numpy()
            both = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
            cuts = [i for i in range(len(both)) if i == 0 or both[i] != both[i - 1]]
            for lo, hi in zip(cuts, [*cuts[1:], len(both)]):
                if both[lo] != current and held:
                    yield close()
                    held = []
                if not held:
                    current, keys = both[lo], [b.column(0).slice(lo, 1), b.column(1).slice(lo, 1)]
                held.append(sizes[lo:hi])
        if held:
            yield close()

    narrow = rows.select(key, "__block", "__size", F.col(order).alias("__order"))
    blocks = narrow.repartition(key, "__block").sortWithinPartitions(key, "__block", "__order").select(key, "__block", "__size").mapInArrow(paths, schema)

    def start():
        window, held_total, held_rows = -1, 0, 0

        def step(n, whole, sums, starts, total, count):
            """The number of the block's rows before its first start, and the window that is open before them."""
            nonlocal window, held_total, held_rows
            before = window
            if window < 0:
                first = 0
            else:  # the first row that the open window has no room for
                first = bisect.bisect_right(sums, bound - held_total, 1) - 1
                first = min(first, max(0, most_rows - held_rows)) if most_rows else first
            if first < len(starts):
                window, held_total, held_rows = window + starts[first], total[first], count[first]
            else:
                first, held_total, held_rows = n, held_total + whole, held_rows + n
            return first, before

        return step

    entered = ordered_fold(blocks, key, ["__block"], start, ["n", "whole", *lists], {"__first": LONG, "__open": LONG})
    side = entered.select(F.col(key).alias("__key"), F.col("__block").alias("__b"), "__first", "__open")
    met = rows.join(side, rows[key].eqNullSafe(side["__key"]) & (rows["__block"] == side["__b"])).drop("__key", "__b")

    def inside():
        row, window, total, count = -1, 0, 0, 0

        def step(n, first, before):
            nonlocal row, window, total, count
            row += 1
            if row < first:
                return (before,)
            if row == first:
                window, total, count = before + 1, 0, 0
            elif total + n > bound or most_rows and count >= most_rows:
                window, total, count = window + 1, 0, 0
            total, count = total + n, count + 1
            return (window,)

        return step

    return ordered_fold(met, [key, "__block"], [order], inside, ["__size", "__first", "__open"], {"window_id": LONG}).drop("__block", "__size", "__first", "__open")


def speech_windows(df: DataFrame, key: str, order: list[str], role: str, text: str, most: int, most_roles: int, alone: bool = False) -> DataFrame:
    """window_id from 0: a new window where the dialogue as rendered, or its roles, would pass the bounds.

    A text too long for any window is an error unless alone, when it fills one by itself.

    Rendered: one line per run of a role, "role: texts", lines joined by line breaks. The length is kept up step by step.
    """

    def start():
        window, closed, line, last, roles = -1, 0, 0, None, set()

        def extended(r, n):
            """Lengths of the closed lines and the open one with a text of n characters of role r."""
            if line and r != last:
                return closed + line + 1, (len(r) + 2 + n if n else 0)
            if not n:
                return closed, line
            return closed, line + 1 + n if line else len(r) + 2 + n

        def step(r, n):
            nonlocal window, closed, line, last, roles
            if not alone and n and len(r) + 2 + n > most:
                raise ValueError(f"a text of {n} characters exceeds the window size {most}")
            c, o = extended(r, n)
            length = c + o if o else max(0, c - 1)
            if window < 0 or length > most or len(roles | {r}) > most_roles:
                window, closed, line, last, roles = window + 1, 0, 0, None, set()
                c, o = extended(r, n)
            closed, line, last = c, o, r
            roles.add(r)
            return (window,)

        return step

    sized = df.withColumn("__n", F.length(squeeze(F.coalesce(text, F.lit("")))))
    return ordered_fold(sized, key, order, start, [role, "__n"], {"window_id": LONG}).drop("__n")


def _columns(key: str | list[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


#: What depth() has found, by files, order and block; a stale answer changes a plan, never its rows.
_DEPTHS: dict[tuple, int | None] = {}


def depth(df: DataFrame, order: str, block: int = BLOCK) -> int | None:
    """block if any row's order reaches it, else None. Best on a stored table, whose statistics answer it almost alone; asked once for its files."""
    at = (tuple(sorted(df.inputFiles())), order, block)
    if not at[0] or at not in _DEPTHS:
        _DEPTHS[at] = None if df.filter(F.col(order) >= block).isEmpty() else block
    return _DEPTHS[at]


def blocks_of(df: DataFrame, key: list[str], order: str, block: int | None) -> tuple[DataFrame, WindowSpec]:
    """df with __block, and the window of a block's rows in order; without blocks, the window of a key's rows."""
    if block is None:
        return df, Window.partitionBy(*key).orderBy(order)
    return df.withColumn("__block", F.floor(F.col(order) / block)), Window.partitionBy(*key, "__block").orderBy(order)


def over_blocks(parts: DataFrame, totals: Callable[[], DataFrame], key: list[str], carried: Callable[[WindowSpec], dict[str, Column]], block: int | None) -> DataFrame:
    """parts with what their block gets from its key's other blocks: carried(window of blocks in order) of totals(), one row a block.

    Null for keys of one block: these, which are nearly all, are not joined, so that the other side stays small.
    """
    added = carried(Window.partitionBy(*key).orderBy("__block"))
    if block is None:
        return parts.withColumns({name: F.lit(None) for name in added})
    found = totals().withColumn("__several", F.count("*").over(Window.partitionBy(*key)) > 1)
    for name, made in added.items():  # each may use those before it
        found = found.withColumn(name, made)
    found = found.filter("__several")
    at = [*key, "__block"]
    side = found.select(*[F.col(k).alias(f"__at{i}") for i, k in enumerate(at)], *added)
    same = reduce(lambda x, y: x & y, [parts[k].eqNullSafe(side[f"__at{i}"]) for i, k in enumerate(at)])
    return parts.join(side, same, "left").drop(*[f"__at{i}" for i in range(len(at))])


def before(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, -1)


def islands(df: DataFrame, key: str | list[str], order: str, *changes: str, block: int | None = BLOCK) -> DataFrame:
    """island from 0: a new one where any of the columns differs from the row before."""
    key = _columns(key)
    parts, w = blocks_of(df, key, order, block)
    row = F.struct(*changes)

    def marked(rows):
        """__new: 1 where a row differs from the one before it in its block."""
        differs = reduce(lambda x, y: x | y, [~F.col(c).eqNullSafe(F.lag(c).over(w)) for c in changes])
        return rows.withColumn("__new", F.when(F.row_number().over(w) == 1, 0).otherwise(differs.cast("int")))

    def totals():
        found = marked(parts.select(*dict.fromkeys([*key, order, *changes]), "__block")).groupBy(*key, "__block")
        return found.agg(F.sum("__new").alias("__total"), F.min_by(row, order).alias("__first"), F.max_by(row, order).alias("__last"))

    def carried(v):
        ended = F.lag("__last").over(v)
        return {"__start": F.when(ended.isNull() | F.col("__first").eqNullSafe(ended), 0).otherwise(1), "__sum": F.col("__total") + F.col("__start"), "__base": F.coalesce(F.sum("__sum").over(before(v)), F.lit(0)) + F.col("__start")}

    rows = marked(over_blocks(parts, totals, key, carried, block))
    island = F.coalesce("__base", F.lit(0)) + F.sum("__new").over(w)
    return rows.withColumn("island", island.cast("long")).drop("__new", "__block", "__start", "__sum", "__base")


def ordered_text(order: str | Column, text: str | Column, separator: str) -> Column:
    """Aggregate: texts joined in order."""
    text = F.col(text) if isinstance(text, str) else text
    order = F.col(order) if isinstance(order, str) else order
    rows = F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t"))))
    return F.array_join(F.transform(rows, lambda x: x["t"]), separator)


def _cumulated(df: DataFrame, key: list[str], order: str, values: dict[str, Column], block: int | None) -> DataFrame:
    """df with __block and, for each value, name_before and name_all: its sums over the earlier rows and all rows of the key.

    Null where there is nothing to add up.
    """
    parts, w = blocks_of(df, key, order, block)

    def totals():
        return parts.groupBy(*key, "__block").agg(*[F.sum(v).alias(f"__{n}_total") for n, v in values.items()])

    def carried(v):
        out = {}
        for n in values:
            out |= {f"__{n}_earlier": F.sum(f"__{n}_total").over(before(v)), f"__{n}_key": F.sum(f"__{n}_total").over(Window.partitionBy(*key))}
        return out

    rows = over_blocks(parts, totals, key, carried, block)
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # in the order of w, so that one operator makes both sums
    for n, v in values.items():
        inside = F.sum(v).over(before(w))
        rows = rows.withColumn(f"{n}_before", F.coalesce(F.col(f"__{n}_earlier") + inside, f"__{n}_earlier", inside))
        rows = rows.withColumn(f"{n}_all", F.coalesce(f"__{n}_key", F.sum(v).over(every))).drop(f"__{n}_earlier", f"__{n}_key")
    return rows


def numbered(df: DataFrame, order: list[Column], name: str, first: int = 0) -> DataFrame:
    """name: places in the order of a whole table, whose rows it tells apart; ranges are sorted and counted by themselves.

    The sorted rows are written once, as ranges are drawn by chance; one row for each range is added up in one task.
    """
    scratch(df.sparkSession)
    place = F.monotonically_increasing_id()
    ranged = df.orderBy(*order).withColumns({"__range": F.shiftright(place, 33), "__in": place.bitwiseAND(F.lit((1 << 33) - 1))}).checkpoint()
    counts = ranged.groupBy("__range").agg(F.count("*").alias("__n"))
    starts = counts.select(F.col("__range").alias("__r"), F.coalesce(F.sum("__n").over(before(Window.orderBy("__range"))), F.lit(0)).alias("__before"))
    return ranged.join(F.broadcast(starts), F.col("__range") == F.col("__r")).withColumn(name, (F.col("__before") + F.col("__in") + first).cast("long")).drop("__range", "__in", "__r", "__before")


def running_sum(df: DataFrame, key: str | list[str], order: str, value: str, name: str, block: int | None = BLOCK) -> DataFrame:
    """name: the sum of value over the rows before this one, 0 for the first."""
    rows = _cumulated(df, _columns(key), order, {"__sum": F.col(value)}, block)
    return rows.withColumn(name, F.coalesce("__sum_before", F.lit(0))).drop("__sum_before", "__sum_all", "__block")


def timeline(df: DataFrame, key: str | list[str], order: str, samples: str, rate: int, pause_ms: int, inner_pause_ms: int | None = None, group: str | None = None, block: int | None = BLOCK) -> DataFrame:
    """start_ms and end_ms of each row: samples before it, with a pause after every row but the last.

    The pause is inner_pause_ms where the next row has the same group. Milliseconds are rounded half to even in whole numbers.
    """
    key = _columns(key)
    parts, w = blocks_of(df, key, order, block)
    long, short = rate * pause_ms // 1000, rate * (inner_pause_ms or 0) // 1000

    def pause(here, after):
        return F.lit(long) if group is None else F.when(after == here, short).otherwise(long)

    def paused(rows):
        """__pause: what follows a row within its block; 0 for the block's last."""
        last = F.lead(order).over(w).isNull()
        after = F.lead(group).over(w) if group is not None else None
        return rows.withColumn("__pause", F.when(last, 0).otherwise(pause(F.col(group) if group is not None else None, after)).cast("long"))

    own = F.col(group) if group is not None else F.lit(None).cast("string")

    def totals():
        found = paused(parts.select(*dict.fromkeys([*key, order, samples, *([group] if group is not None else [])]), "__block")).groupBy(*key, "__block")
        return found.agg(F.sum(F.col(samples) + F.col("__pause")).alias("__total"), F.min_by(F.struct(own.alias("g")), order).alias("__first"), F.max_by(F.struct(own.alias("g")), order).alias("__last"))

    def carried(v):
        after = F.lead("__first").over(v)
        tail = F.when(after.isNull(), 0).otherwise(pause(F.col("__last.g"), after["g"]))
        return {"__step": F.coalesce("__total", F.lit(0)) + tail, "__base": F.sum("__step").over(before(v))}

    rows = paused(over_blocks(parts, totals, key, carried, block))
    inside = F.sum(F.col(samples) + F.col("__pause")).over(before(w))
    start = F.coalesce("__base", F.lit(0)) + F.coalesce(inside, F.lit(0))
    rows = rows.withColumn("__start", start)
    return rows.withColumns({"start_ms": half_even(F.col("__start") * 1000, rate), "end_ms": half_even((F.col("__start") + F.col(samples)) * 1000, rate)}).drop("__pause", "__start", "__step", "__base", "__block")


def half_even(n: Column, d: int | Column) -> Column:
    """n / d of whole numbers, rounded half to even."""
    d = F.lit(d) if isinstance(d, int) else d
    twice = 2 * F.pmod(n, d)
    q = F.floor((n - F.pmod(n, d)) / d)
    return (q + F.when((twice > d) | ((twice == d) & (F.pmod(q, F.lit(2)) == 1)), 1).otherwise(0)).cast("long")


def apportion(df: DataFrame, key: str | list[str], order: str, weight: str, total: Callable[[Column], Column], block: int | None = BLOCK) -> DataFrame:
    """first and last: where each row's share of total(sum of weights) begins and ends, in proportion to weights, half to even.

    Weights are positive.
    """
    rows = _cumulated(df, _columns(key), order, {"__weight": F.col(weight)}, block)
    before, every = F.coalesce("__weight_before", F.lit(0)), F.col("__weight_all")
    reached = before + F.col(weight)
    last = F.when(reached == every, total(every)).otherwise(half_even(total(every) * reached, every))
    first = half_even(total(every) * before, every)
    return rows.withColumns({"first": first.cast("long"), "last": last.cast("long")}).drop("__weight_before", "__weight_all", "__block")


def counted_sums(df: DataFrame, key: str | list[str], order: str, size: str, block: int | None = BLOCK) -> DataFrame:
    """chars: the sum of size up to and with each row, null while there is none; rn: the row's number from 1."""
    rows = _cumulated(df, _columns(key), order, {"__size": F.col(size), "__one": F.lit(1)}, block)
    chars = F.coalesce(F.col("__size_before") + F.col(size), "__size_before", F.col(size))
    rows = rows.withColumns({"chars": chars.cast("long"), "rn": (F.coalesce("__one_before", F.lit(0)) + 1).cast("long")})
    return rows.drop("__size_before", "__size_all", "__one_before", "__one_all", "__block")


def prefix_take(df: DataFrame, key: str | list[str], order: str, size: str, most: int, block: int | None = BLOCK) -> DataFrame:
    """The rows whose sizes up to and with them stay within most, with that sum as chars; the first row is always taken."""
    return counted_sums(df, key, order, size, block).filter((F.col("chars") <= most) | (F.col("rn") == 1)).drop("rn")


def target_sweep(df: DataFrame, key: str, order: str, size: str, start: int, step: int, most: int, block: int | None = BLOCK) -> DataFrame:
    """The targets whose prefixes differ: key, target, n rows, n chars of the prefix; the first row is always taken."""
    cum = counted_sums(df, key, order, size, block)
    # row k enters the prefix at the first target that reaches its running sum
    at = F.when(F.col("rn") == 1, start).otherwise(start + step * F.greatest(F.lit(0), F.ceil((F.col("chars") - start) / step)))
    grown = cum.withColumn("target", at.cast("long")).groupBy(key, "target").agg(F.max("rn").alias("n_rows"), F.max("chars").alias("n_chars"))
    by = Window.partitionBy(key).orderBy("target")
    return grown.withColumn("__k", F.row_number().over(by)).filter(F.col("__k") <= most).drop("__k")


def first_appearance(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """code: dense numbers from 0 in the order in which values first appear in their group."""
    first = df.groupBy(key, value).agg(F.min(order).alias("__first"))
    coded = first.withColumn("code", F.row_number().over(Window.partitionBy(key).orderBy("__first")).cast("long") - 1).drop("__first")
    return df.join(coded, [key, value])


def buffer(df: DataFrame, key: str, order: str, seconds: str, target: float, most: float, limit: int, mode: str = "fast") -> DataFrame:
    """call: the number, from 0, of the generation call that makes a unit before the buffer holds target seconds; null for later ones."""
    target = min(most, max(0.1, target))

    def start():
        ready, count, call, left = 0.0, 0, -1, 0

        def step(s):
            nonlocal ready, count, call, left
            if left == 0:
                if ready >= target:
                    return (None,)
                widest = 1 if mode == "precise" else max(1, min(2, limit)) if mode == "balanced" else max(1, limit)
                left = widest
                if mode != "precise" and count and ready > 0:
                    left = max(1, min(widest, math.ceil(max(0.1, target - ready) / (ready / count))))
                call += 1
            ready, count, left = ready + s, count + 1, left - 1
            return (call,)

        return step

    return ordered_fold(df, key, [order], start, [seconds], {"call": LONG})


def next_limit(limit: int, blocks: int, peak: int, target: int) -> int:
    """Blocks for the next call: fewer if memory passed the target, half as many again far below it, unbounded (0) from 24 on."""
    if peak <= 0:
        return limit
    if peak > target:
        return max(1, int(max(1, blocks) * target / peak * 0.85))
    if limit > 0 and peak < int(target * 0.65):
        wider = limit + max(1, limit // 2)
        return 0 if wider >= 24 else wider
    return limit


def adaptive_limits(df: DataFrame, key: str, order: list[str], blocks: str, peak: str, target: int, first: int) -> DataFrame:
    """limit_before and limit_after of each call."""

    def start():
        limit = first

        def step(b, p):
            nonlocal limit
            before, limit = limit, next_limit(limit, int(b or 1), int(p or 0), target)
            return before, limit

        return step

    return ordered_fold(df, key, order, start, [blocks, peak], {"limit_before": LONG, "limit_after": LONG})


def dialogue(df: DataFrame, key: str, order: str, role: str, text: str, block: int | None = BLOCK) -> DataFrame:
    """key, n_runs, script: one line per run of a role, "role: texts"."""
    said = islands(df.withColumn("__t", speech(F.coalesce(text, F.lit("")))), key, order, role, block=block)
    lines = said.groupBy(key, "island", role).agg(ordered_text(order, F.when(F.col("__t") != "", F.col("__t")), " ").alias("__line"))
    lines = lines.withColumn("__line", F.concat(F.col(role), F.lit(": "), F.col("__line")))
    return lines.groupBy(key).agg(F.count("*").alias("n_runs"), ordered_text("island", "__line", "\n").alias("script"))
