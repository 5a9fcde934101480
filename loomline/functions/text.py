"""Text expressions: Column in, Column out, all native but for the rarer character references of HTML."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Every character that counts as white space, for regular expressions.
SPACES = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"

# Tags whose start and end break lines; the commonest entities with their characters, &amp; last, for SQL twins.
BLOCK_TAGS = "address|article|aside|blockquote|br|div|h1|h2|h3|h4|h5|h6|li|p|section|table|tr"
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&mdash;", "—"), ("&ndash;", "–"), ("&hellip;", "…"), ("&amp;", "&"))
# A sentence ends after one of .!? where white space and an opening quote, a capital or a digit follow.
SENTENCE_BREAK = r"""(?<=[.!?])\s+(?=["'“‘A-Z0-9])"""
# The three kinds of quotes; a single closing quote before a letter or digit is an apostrophe; an open quote runs on.
QUOTE = r"""“[^”]*(?:”|\z)|"[^"]*(?:"|\z)|‘(?:[^’]|’(?=[\p{L}\p{N}]))*(?:’|\z)"""
# What secrets look like.
SECRETS = (r"(?i)Bearer\s+[A-Za-z0-9._\-]+", r"(?i)sk-ant-[A-Za-z0-9._\-]+")
# Chapter headings, alone on a line.
HEADING = r"(?im)^\s*(?:chapter\s+(?:[0-9]+|[ivxlcdm]+|[a-z]+)|prologue|epilogue|part\s+[ivxlcdm]+)\s*$"


def squeeze(c: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, SPACES, " "))


def speech(c: Column) -> Column:
    """Text as it is spoken: # is a word."""
    return squeeze(F.replace(c, F.lit("#"), F.lit(" hashtag ")))


def name_key(c: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def slug(c: Column, separator: str = "_", strict: bool = False) -> Column:
    """Letters and digits with separators between them; text without any is blank, or an error if strict."""
    out = F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", separator), F.lit(separator))
    return F.when(out == "", F.raise_error(F.lit("no letter or digit in a name")).cast("string")).otherwise(out) if strict else out


def safe_slug(c: Column, default: str = "book", most: int = 80) -> Column:
    return F.coalesce(F.nullif(F.substring(slug(c, "-"), 1, most), F.lit("")), F.lit(default))


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"(?U)\b\w+\b"))


def title(c: Column, stem: Column, most: int = 120) -> Column:
    """The first line that is not blank, or the stem."""
    lines = F.filter(F.transform(F.split(c, "\n"), squeeze), lambda x: x != "")
    return F.coalesce(F.substring(F.try_element_at(lines, F.lit(1)), 1, most), stem)


def sentences(c: Column) -> Column:
    """Sentences of a text by rule, in order; numbers count blank ones, which only an empty text has."""
    return F.split(squeeze(c), SENTENCE_BREAK)


@F.pandas_udf(T.StringType())
def unescaped(text: pd.Series) -> pd.Series:
    """All character references of HTML as characters; for the texts that may hold some, in batches."""
    return text.map(html.unescape, na_action="ignore")


def html_text(c: Column, every: bool = True) -> Column:
    """Text of HTML: no script, style or comments; block tags break lines; entities; no blank lines.

    every: all references of HTML, also those without a semicolon, as browsers read them; else only ENTITIES, as the SQL twin has them.
    """
    x = F.regexp_replace(c, r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->", "")
    x = F.regexp_replace(x, rf"(?i)</?(?:{BLOCK_TAGS})\b[^>]*>", "\n")
    x = F.regexp_replace(x, r"(?s)<[a-zA-Z/!][^>]*>", "")
    # the commonest references natively; a text that holds any other goes through Python
    names = "|".join(name[1:-1] for name, _ in ENTITIES)
    plain = x
    for name, _ in ENTITIES:
        plain = F.replace(plain, F.lit(name), F.lit(html.unescape(name)))
    other = F.regexp_like(x, F.lit(rf"&(?!(?:{names});)[#A-Za-z]"))
    x = F.coalesce(unescaped(F.when(other, x)), plain) if every else plain
    lines = F.filter(F.transform(F.split(x, "\n"), squeeze), lambda line: line != "")
    return F.array_join(lines, "\n")


def redact(c: Column) -> Column:
    """Hides bearer tokens and values that follow key-like names."""
    x = c
    for secret in SECRETS:
        x = F.regexp_replace(x, secret, "[REDACTED]")
    return F.regexp_replace(x, r"""(?i)\b(?:token|api_key|secret|password)\s*=\s*"[^"]*\"""", "[REDACTED]")


def absent_to_null(c: Column, *absent: str) -> Column:
    """Null for blank text and for any of the named words, whatever their case."""
    t = F.trim(c)
    return F.when(F.lower(t).isin("", *absent), None).otherwise(t)


def distinct_by_key(values: Column, most: int, key=name_key) -> Column:
    """The first of the array's values for each of its first keys, in order."""
    keys = F.transform(values, key)
    return F.transform(F.slice(F.array_distinct(keys), 1, most), lambda k: F.element_at(values, F.array_position(keys, k).cast("int")))


def split_list(c: Column, most: int = 5) -> Column:
    """Values between commas and semicolons, trimmed, without blanks and repeats, the first few."""
    return distinct_by_key(F.filter(F.transform(F.split(c, "[,;]"), lambda x: F.trim(x)), lambda x: x != ""), most)


def clip(c: Column, most: int) -> Column:
    """Squeezed text, cut with three dots if it is longer."""
    x = squeeze(c)
    return F.when(F.length(x) > most, F.concat(F.rtrim(F.substring(x, 1, most)), F.lit("..."))).otherwise(x)


def two_part_key(name: Column, stage: Column) -> Column:
    """The name's slug with the stage's, unless the stage is unknown."""
    s = slug(stage)
    return F.concat_ws("_", slug(name), F.when((s != "") & (s != "unknown"), s))


# Quote marks around a quote's key.
QUOTE_MARKS = "\"'“”‘’"


def quote_key(c: Column) -> Column:
    """What a quote is compared by: its normalised text without quote marks around it."""
    return name_key(F.btrim(F.btrim(c), F.lit(QUOTE_MARKS)))


def join_filled(parts: Column, separator: str = " ") -> Column:
    """The parts that aren't blank, trimmed and joined."""
    return F.array_join(F.filter(F.transform(parts, lambda x: F.btrim(x)), lambda x: x != ""), separator)


def fixed(c: Column, places: int = 3) -> Column:
    """A number with so many decimal places; blank for null."""
    return F.coalesce(F.format_string(f"%.{places}f", c.cast("double")), F.lit(""))


def log_line(prefix: str, event: Column, **details: Column) -> Column:
    """prefix event key=value ... without details that are null."""
    return F.concat_ws(" ", F.lit(prefix), event, *[F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in details.items()])


def text_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def path_parts(c: Column, prefix: str, middle: str, suffix: str) -> tuple[Column, Column]:
    """The name and the number of prefix name/middle/number suffix; null for other paths."""
    p = rf"\A\Q{prefix}\E([^/]*)/\Q{middle}\E/(\d+)\Q{suffix}\E\z"
    hit = F.regexp_like(c, F.lit(p))
    return F.when(hit, F.regexp_extract(c, p, 1)), F.when(hit, F.regexp_extract(c, p, 2).cast("long"))


def prompt(template: str, **parts: Column) -> Column:
    """A template's {name} filled with columns: rows rendered on the executors, whatever the template says."""
    import string

    pieces = []
    for literal, name, _, _ in string.Formatter().parse(template):
        pieces += [F.lit(literal)] * bool(literal) + ([F.coalesce(parts[name].cast("string"), F.lit(""))] if name else [])
    return F.concat(*pieces)


# What stands for the cut middle of a text.
CUT = "\n\n[...truncated failed model response...]\n\n"


def bounded(c: Column, most: int = 12000) -> Column:
    """Head and tail of a text that is too long, CUT between them."""
    half = most // 2
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, half), F.lit(CUT), F.substring(c, -half, half))).otherwise(c)
