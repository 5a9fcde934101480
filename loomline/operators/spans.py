"""Sentences, quotes and narration of texts, as rows with code-point offsets."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrow import slices
from ..functions.text import HEADING, QUOTE, SPACES, sentences, title
from .sequence import BLOCK, before, blocks_of, over_blocks, running_sum

WHITE = " \t\n\x0b\f\r"
#: Sentences of a text that are folded at once; lists grow inside of so many and by so many, so no list is copied for each sentence.
RUN = 500


def sentence_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, idx, sentence; blank sentences are dropped after they are numbered."""
    rows = df.select(key, F.posexplode(sentences(F.col(text))).alias("idx", "sentence"))
    return rows.filter(F.trim("sentence") != "").withColumn("idx", F.col("idx").cast("long"))


def chapter_rows(df: DataFrame, key: str, text: str, shortest: int = 20) -> DataFrame:
    """key, chapter (chapter_001 ...), body: what stands between heading lines; nothing for texts with fewer than two headings
    or a body that is too short."""
    cut = F.regexp_replace(F.col(text), HEADING, "\u0001")
    bodies = F.transform(F.slice(F.split(cut, "\u0001"), 2, 1 << 30), lambda b: F.regexp_replace(b, r"^\s+|\s+$", ""))
    sure = (F.size(bodies) >= 2) & F.forall(bodies, lambda b: F.length(b) >= shortest)
    rows = df.select(key, F.posexplode(F.when(sure, bodies)).alias("pos", "body"))
    return rows.select(key, F.format_string("chapter_%03d", F.col("pos") + 1).alias("chapter"), F.concat("body", F.lit("\n")).alias("body"))


def _spans(df: DataFrame, key: str, text: str) -> DataFrame:
    """Spans of each text with their number among all (unit_id): one linear pass over each text, in Arrow batches, no shuffle."""
    pattern = QUOTE.replace(r"\z", r"\Z")
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        import regex

        quotes = regex.compile(pattern)
        for b in slices(batches, 1):
            rows: list[tuple] = []
            for i, t in enumerate(b.column(1).to_pylist()):
                n, cursor = [0, 0, 0], 0

                def narration(lo: int, hi: int, i=i, t=t, n=n):
                    said = t[lo:hi].strip(WHITE)
                    if said:
                        at = lo + len(t[lo:hi]) - len(t[lo:hi].lstrip(WHITE))
                        rows.append((i, "narration", n[0], n[2], at, at + len(said), said))
                        n[0], n[2] = n[0] + 1, n[2] + 1

                for m in quotes.finditer(t or ""):
                    narration(cursor, m.start())
                    cursor = m.end()
                    rows.append((i, "quote", n[1] + 1, n[2], m.start(), cursor, m[0]))
                    n[1], n[2] = n[1] + 1, n[2] + 1
                narration(cursor, len(t or ""))
            columns = list(zip(*rows)) if rows else [()] * 7
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.record_batch([b.column(0).take(pa.array(columns[0], pa.int64())), *(pa.array(c, k) for c, k in zip(columns[1:], kinds))], names=[key, "kind", "idx", "unit_id", "start", "end", "text"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, kind string, idx long, unit_id long, start long, end long, text string")


def spans(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, kind (quote or narration), idx, start, end, text. Narration is trimmed, and dropped if blank; quotes count from 1.

    key names one text; rows of one key are numbered apart.
    """
    return _spans(df, key, text).drop("unit_id")


def reading_units(df: DataFrame, key: str, text: str) -> DataFrame:
    """Quotes and narration together, numbered densely by place: key, unit_id, kind, start, end, text."""
    return _spans(df, key, text).select(key, "unit_id", "kind", "start", "end", "text")


def marked(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, marked: |q001| and ||q001|| around each quote."""
    quotes = F.regexp_extract_all(F.col(text), F.lit(QUOTE), F.lit(0))
    between = F.split(F.col(text), QUOTE, -1)
    name = lambda i: F.format_string("q%03d", i)
    tagged = F.transform(quotes, lambda q, i: F.concat(F.lit("|"), name(i + 1), F.lit("| "), q, F.lit(" ||"), name(i + 1), F.lit("||")))
    return df.select(key, F.array_join(F.zip_with(between, tagged, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "").alias("marked"))


def titles(df: DataFrame, key: str, text: str, stem: str = "document_%s") -> DataFrame:
    return df.select(key, title(F.col(text), F.format_string(stem, F.col(key).cast("string"))).alias("title"))


#: Quotes of a sentence that begins outside of one: a mark is closed by its own kind, or runs on; and of one that began inside, where any closing mark ends a quote.
OUTSIDE, INSIDE = r'"[^"]*(?:"|\z)|“[^”]*(?:”|\z)', r'["“][^"”]*(?:["”]|\z)'
TAIL = r'\A[^"”]*["”]?'
#: Sentences without any of these are one unit, and leave a quote open or closed as it was.
MARK = '["“”]'


def _open_after(c: Column) -> tuple[Column, Column]:
    """Whether a quote is open after a sentence that begins outside, and after one that begins inside a quote: its transition."""
    out = F.regexp_like(F.regexp_replace(c, r'"[^"]*"|“[^”]*”', ""), F.lit('["“]'))
    rest = F.regexp_replace(c, TAIL, "")
    ended = F.regexp_like(c, F.lit('["”]'))
    return out, ~ended | F.regexp_like(F.regexp_replace(rest, r'["“][^"”]*["”]', ""), F.lit('["“]'))


def open_before(df: DataFrame, key: str, order: str, text: str, name: str, block: int | None = None) -> DataFrame:
    """name: whether a quote is open where each text begins, carried along the order of its key from closed at the start.

    A text is a transition of two states: it sets the state, keeps it, or turns it over. Such steps compose, so the state before a row is what the last setting row
    left, turned over once for each turning row since. Blocks compose in the same way: order is a whole number, and keys longer than block are
    spread over their blocks.
    """
    key_columns = [key]
    c = F.coalesce(text, F.lit(""))
    out, inside = _open_after(c)
    rows = df.withColumns({"__o": out, "__i": inside})
    rows = rows.withColumns({"__turn": (F.col("__o") & ~F.col("__i")).cast("int"), "__set": F.when(F.col("__o") == F.col("__i"), F.col("__o"))}).drop("__o", "__i")
    parts, w = blocks_of(rows, key_columns, order, block)
    turns = F.sum("__turn").over(w.rowsBetween(Window.unboundedPreceding, 0))
    parts = parts.withColumn("__turns", turns)
    mark = lambda: F.when(F.col("__set").isNotNull(), F.struct(F.col("__set").alias("v"), F.col("__turns").alias("t")))

    def totals():
        """A block as one step: what it sets, or how often it turns."""
        return parts.groupBy(*key_columns, "__block").agg(F.max_by(mark(), F.when(F.col("__set").isNotNull(), F.col(order))).alias("__m"), F.sum("__turn").alias("__n")).select(*key_columns, "__block", (F.col("__m.v") != ((F.col("__n") - F.col("__m.t")) % 2 == 1)).alias("__sets"), "__n")

    def carried(v):
        earlier = before(v)
        return {
            "__n_cum": F.sum("__n").over(v.rowsBetween(Window.unboundedPreceding, 0)),
            "__last": F.last(F.when(F.col("__sets").isNotNull(), F.struct(F.col("__sets").alias("v"), F.col("__n_cum").alias("t"))), ignorenulls=True).over(earlier),
            "__entry": F.coalesce(F.col("__last.v") != ((F.lag("__n_cum").over(v) - F.col("__last.t")) % 2 == 1), F.coalesce(F.lag("__n_cum").over(v), F.lit(0)) % 2 == 1),
        }

    met = over_blocks(parts, totals, key_columns, carried, block)
    last = F.last(mark(), ignorenulls=True).over(before(w))
    met = met.withColumn("__here", last).withColumn("__turned", F.coalesce(F.col("__turns") - F.col("__turn"), F.lit(0)))
    state = F.when(F.col("__here").isNotNull(), F.col("__here.v") != ((F.col("__turned") - F.col("__here.t")) % 2 == 1)).otherwise(F.coalesce(F.col("__entry").cast("boolean"), F.lit(False)) != (F.col("__turned") % 2 == 1))
    return met.withColumn(name, state).select(*df.columns, name)


def _once(value: Column, use) -> Column:
    """use(value), where value is worked out once, however often and in whatever lambda it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def role_units(text: Column, inside: Column) -> Column:
    """The units of a sentence, one for each quote: narration before the first quote joins it, later narration joins the unit before.

    inside: whether the sentence begins in an open quote. Blank parts drop out; a sentence without quotes is one unit.
    """
    clean = lambda c: F.regexp_replace(c, rf"\A{SPACES}|{SPACES}\z", "")
    said = F.coalesce(text, F.lit(""))
    joined = lambda *parts: F.array_join(F.filter(F.array(*parts), lambda x: x != ""), " ")

    def units(x: Column) -> Column:
        head, quotes, between = x["head"], x["quotes"], x["between"]
        first = F.element_at(between, 1)
        each = F.transform(quotes, lambda q, i: joined(F.when((i == 0) & (head == ""), first).otherwise(""), clean(q), F.element_at(between, i.cast("int") + 2)))
        led = F.when(head != "", F.array(joined(head, first))).when(F.size(quotes) == 0, F.array(first)).otherwise(F.array().cast("array<string>"))
        return F.concat(led, each)

    def cut(rest: Column, pattern: str, head: Column) -> Column:
        return F.struct(head.alias("head"), F.regexp_extract_all(rest, F.lit(pattern), F.lit(0)).alias("quotes"), F.transform(F.split(rest, pattern, -1), clean).alias("between"))

    tail = _once(F.regexp_replace(said, TAIL, ""), lambda rest: cut(rest, INSIDE, clean(F.regexp_extract(said, TAIL, 0))))
    found = F.when(~F.regexp_like(said, F.lit(MARK)), F.array(clean(said))).otherwise(_once(F.when(inside, tail).otherwise(cut(said, OUTSIDE, F.lit(""))), units))
    return F.filter(found, lambda u: u != "")


def insides(said: Column) -> Column:
    """Whether a quote is open where each of a text's sentences begins, from closed at the start: a fold over an array, runs of so many at once."""

    def step(c: Column) -> Column:
        """The state after a sentence: bit 0 where it begins outside, bit 1 where it begins inside."""
        out, inside = _open_after(c)
        return F.when(F.regexp_like(c, F.lit(MARK)), out.cast("int") + 2 * inside.cast("int")).otherwise(2)

    none = F.array().cast("array<boolean>")
    state = lambda open_, was: F.struct(open_.alias("open"), was.alias("was"))

    def after(a: Column, s: Column) -> Column:
        return state(F.when(a["open"], s >= 2).otherwise(s % 2 == 1), F.concat(a["was"], F.array(a["open"])))

    def fold(steps: Column) -> Column:
        runs = F.sequence(F.lit(0), F.floor((F.greatest(F.size(steps), F.lit(1)) - 1) / RUN).cast("int"))
        one = lambda a, k: F.aggregate(F.slice(steps, k * RUN + 1, RUN), state(a["open"], none), after)
        return F.aggregate(runs, state(F.lit(False), none), lambda a, k: _once(one(a, k), lambda run: state(run["open"], F.concat(a["was"], run["was"]))), lambda a: a["was"])

    return _once(F.transform(said, lambda c: step(F.coalesce(c, F.lit("")))), fold)


def text_role_units(df: DataFrame, key: str, text: str, as_read=lambda sentence: sentence) -> DataFrame:
    """key, idx, part, unit: what role_unit_rows gives for the sentences of each text, without any shuffle, as a text is one row.

    as_read: what a sentence is read as.
    """
    found = _once(F.transform(sentences(F.col(text)), as_read), lambda ss: F.zip_with(ss, insides(ss), lambda s, i: F.struct(s.alias("sentence"), i.alias("inside"))))
    rows = df.select(key, F.posexplode(found).alias("idx", "__s"))
    return rows.select(key, F.col("idx").cast("long").alias("idx"), F.posexplode(role_units(F.col("__s.sentence"), F.col("__s.inside"))).alias("part", "unit")).withColumn("part", F.col("part").cast("long"))


def text_units(text: Column) -> Column:
    """All role units of a text, in order."""
    return F.flatten(_once(sentences(text), lambda ss: F.zip_with(ss, insides(ss), role_units)))


def role_unit_rows(df: DataFrame, key: str, idx: str, sentence: str, block: int = BLOCK) -> DataFrame:
    """key, idx, part, unit: sentences in order split into role units; an open quote goes on into the next sentence.

    Null and blank sentences have no units. idx: a whole number, one for each row of a key; keys of any length are spread over blocks of so many of its values.
    """
    told = open_before(df.select(key, idx, sentence), key, idx, sentence, "__inside", block)
    return told.select(key, idx, F.posexplode(role_units(F.col(sentence), F.col("__inside"))).alias("part", "unit")).withColumn("part", F.col("part").cast("long"))


def stitched(df: DataFrame, key: str, group: str, text: str) -> DataFrame:
    """Offsets of texts laid end to end in their group, each after a marker line, two line breaks between them."""
    marker = F.length(F.concat(F.lit("["), F.col(key).cast("string"), F.lit("]\n")))
    sized = df.select(group, key, marker.cast("long").alias("marker"), F.length(F.coalesce(text, F.lit(""))).cast("long").alias("size"))
    laid = running_sum(sized.withColumn("step", F.col("marker") + F.col("size") + 2), group, key, "step", "marker_start")
    return laid.select(group, key, "marker_start", (F.col("marker_start") + F.col("marker")).alias("content_start"), (F.col("marker_start") + F.col("marker") + F.col("size")).alias("content_end"))

