"""Text functions as columns; offsets count code points and ranges are half-open."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Endings that the Russian stemmer takes off, the longest that fits first.
ENDINGS = (
    "иями ями ами ого ему ому ыми ими иной ая яя ой ей ам ям ах ях ом ем ов ев ин ын ы и а я у ю е"
).split()

#: The largest place or length that Spark's substring takes.
MOST = (1 << 31) - 1
#: A sentence ends after . ! ? or … with an optional closing quote and white space, after line breaks, or at the end.
SENTENCE = r"(?sUd).+?(?:[.!?…][»”\"]?\s+|\n+|$)"
WORD = r"(?U)[^\W_]+"


def clean(text: Column) -> Column:
    """White space collapsed to single spaces and trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def match_key(text: Column) -> Column:
    """Lower case without anything but word characters; equal keys match."""
    return F.regexp_replace(F.lower(text), r"(?U)[\W]+", "")


def fold(text: Column) -> Column:
    """Lower case with ё as е."""
    return F.translate(F.lower(text), "ё", "е")


def tokens(text: Column) -> Column:
    """Lower-case words (with digits and underscores) in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), F.lit(0))


def terms(text: Column) -> Column:
    """Distinct lower-case words without underscores, by first occurrence."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))


def any_of(query: Column) -> Column:
    """A full-text query: each distinct word quoted, joined by OR."""
    return F.array_join(F.transform(F.array_distinct(F.regexp_extract_all(query, F.lit(WORD), F.lit(0))), lambda w: F.concat(F.lit('"'), w, F.lit('"'))), " OR ")


def normalised_name(name: Column) -> Column:
    """Words of a folded name joined by single spaces."""
    return F.array_join(F.regexp_extract_all(fold(name), F.lit(r"(?U)\w+"), F.lit(0)), " ")


def stem(token: Column) -> Column:
    """A lower-case token without the longest listed ending that leaves at least four letters."""
    return F.regexp_replace(token, "(?<=.{4})(" + "|".join(sorted(ENDINGS, key=len, reverse=True)) + ")$", "")


def stems(text: Column) -> Column:
    """Distinct stems of a text."""
    return F.array_distinct(F.transform(tokens(text), stem))


def jaccard(a: Column, b: Column) -> Column:
    """Shared part of two arrays taken as sets; 0 for two empty ones."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b)))


def sentence_units(text: Column) -> Column:
    """Pieces of text that end at sentence ends or line breaks; joined they give the text."""
    return F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0))


def slice_of(text: Column, start: Column, end: Column) -> Column:
    """text[start:end) in code points; places beyond any text's end, however large, hold nothing."""
    return F.substring(text, (F.least(start, F.lit(MOST - 1)) + 1).cast("int"), F.least(F.greatest(F.lit(0), end - start), F.lit(MOST)).cast("int"))


def window_around(text: Column, start: Column, end: Column, limit: int) -> Column:
    """At most ``limit`` code points around [start, end), as symmetric as the text allows."""
    left = F.greatest(F.lit(0), start - F.floor((F.lit(limit) - (end - start)) / 2))
    return F.substring(text, (F.greatest(F.lit(0), F.least(left, F.length(text) - limit)) + 1).cast("int"), F.lit(limit))


def shorten(text: Column, limit: int) -> Column:
    """At most ``limit`` code points; a cut text ends in an ellipsis."""
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, limit - 1)), F.lit("…")))


def first_sentence(text: Column) -> Column:
    """Up to the first sentence end."""
    return F.trim(F.regexp_extract(text, r"(?sUd)^.+?(?:[.!?…]+|$)", 0))


def slug(title: Column) -> Column:
    """A file name of word characters and hyphens."""
    s = F.regexp_replace(F.regexp_replace(F.lower(title), r"(?U)[^\w]+", "-"), r"^-+|-+$", "")
    return F.when(s == "", "untitled").otherwise(F.substring(s, 1, 80))


def uuid5_url(name: Column) -> Column:
    """UUID version 5 of a name in the URL namespace, as text."""
    h = F.substring(F.sha1(F.concat(F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8")), F.encode(name, "UTF-8"))), 1, 32)
    variant = F.element_at(F.array(*[F.lit(c) for c in "89ab"]), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1).cast("int"))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def uuid5_hex(name: Column) -> Column:
    """``uuid5_url`` without hyphens."""
    return F.translate(uuid5_url(name), "-", "")


def content_hash(text: Column) -> Column:
    """SHA-256 of the UTF-8 text in hex."""
    return F.sha2(text, 256)


def json_reply(reply: Column) -> Column:
    """A model reply without a surrounding code fence."""
    fenced = F.regexp_extract(reply, r"(?s)^\s*```(?:json)?\s*(.*?)\s*```\s*$", 1)
    return F.when(fenced != "", fenced).otherwise(F.trim(reply))


def markdown_escape(text: Column) -> Column:
    """Markdown's special characters with a backslash before each."""
    return F.regexp_replace(text, r"([\\`*_{}\[\]()#+\-.!|>])", r"\\$1")
