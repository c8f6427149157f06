"""Context windows around a phrase, as expressions over one text, and the relational merge of intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUFFER = 1500
SEPARATION = 100
#: Code points around a cut that are searched for white space before the whole text is.
NEAR = 64


def phrase_pattern(phrase: Column) -> Column:
    """A pattern for the phrase's whole words in any case, with any white space between them; null for a blank phrase."""
    literal = F.regexp_replace(F.regexp_replace(phrase, r"(?U)^\s+|\s+$", ""), r"(?U)[^\w\s]", r"\\$0")
    return F.when(literal != "", F.concat(F.lit(r"(?U)(?i)\b"), F.regexp_replace(literal, r"(?U)\s+", r"\\s+"), F.lit(r"\b")))


def places(text: Column, pattern: Column) -> Column:
    """Start and end of every match, in code points: lengths of the parts between matches, added up."""
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("hit"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(acc: Column, part: Column) -> Column:
        start = acc["at"] + F.char_length(part["gap"])
        end = start + F.char_length(part["hit"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end")))).alias("out"))

    return F.aggregate(F.filter(parts, lambda p: p["hit"].isNotNull()), zero, step, lambda acc: acc["out"])


def _back(text: Column, at: Column) -> Column:
    """Place of the last white space up to ``at``, or 0."""
    def within(n: Column) -> Column:
        piece = F.substring(text, at + 2 - n, n)
        word = F.char_length(F.regexp_extract(piece, r"(?U)\S*+\z", 0))
        return F.when(word < n, at - word)

    return F.coalesce(within(F.least(F.lit(NEAR), at + 1)), within(at + 1), F.lit(0))


def _forth(text: Column, at: Column, size: Column) -> Column:
    """The place after the first white space from the place before ``at`` on, or the text's end."""
    def within(n: Column) -> Column:
        word = F.char_length(F.regexp_extract(F.substring(text, at, n), r"(?U)^\S*+", 0))
        return F.when(word < n, at + word)

    left = size - at + 1
    return F.coalesce(within(F.least(F.lit(NEAR), left)), within(left), size)


def windows_column(text: Column, phrase: Column, buffer: int = BUFFER, separation: int = SEPARATION, limit: int | None = None) -> Column:
    """Array of snippets of ``text`` around ``phrase``; empty for a null or blank phrase and a null text.

    A match grows by ``buffer`` to both sides and then to the next white space.  Matches come in
    order, and so do both ends of what they grow to; so snippets that overlap or lie no more than ``separation``
    apart become one wherever the gap between neighbours is that small.
    """
    def grown(p: Column, size: Column) -> Column:
        start, end = F.greatest(p["start"] - buffer, F.lit(0)), F.least(p["end"] + buffer, size)
        return F.struct(_back(text, start).alias("start"), F.when(end < size, _forth(text, end, size)).otherwise(size).alias("end"))

    def cut(all_: Column, size: Column) -> Column:
        n = F.size(all_)
        order = F.sequence(F.lit(1), n)

        def apart(i: Column) -> Column:
            return F.element_at(all_, i + 1)["start"] - F.element_at(all_, i)["end"] > max(0, separation)

        first = F.filter(order, lambda i: F.when(i == 1, True).otherwise(apart(i - 1)))
        last = F.filter(order, lambda i: F.when(i == n, True).otherwise(apart(i)))

        def snippet(i: Column, j: Column) -> Column:
            start, end = F.element_at(all_, i)["start"], F.element_at(all_, j)["end"]
            inner = F.regexp_replace(F.substring(text, start + 1, end - start), r"(?U)^\s+|\s+$", "")
            return F.concat(F.when(start > 0, "... ").otherwise(""), inner, F.when(end < size, " ...").otherwise(""))

        return F.when(n > 0, F.zip_with(first, last, snippet))

    # lists of one element bind the size and the spans, so that they are computed once
    def whole(size: Column) -> Column:
        spans = F.transform(places(text, phrase_pattern(phrase)), lambda p: grown(p, size))
        return F.transform(F.array(spans), lambda all_: cut(all_, size))[0]

    found = F.transform(F.array(F.char_length(text)), whole)[0]
    found = F.coalesce(found, F.array().cast("array<string>"))
    return found if limit is None else F.slice(found, 1, limit)


def merge_intervals(spans: DataFrame, key: str, separation: int = SEPARATION) -> DataFrame:
    """key, start, end of the islands of (key, start, end): gaps of ``separation`` or less close.

    Islands are counted along the row numbers of the pass that finds where they begin; ordered by start and
    end anew, equal spans could come in another order and leave the first of them behind its copies.
    """
    order = Window.partitionBy(key).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col("start") - reach <= separation, 0).otherwise(1)
    marked = spans.select(key, "start", "end", F.row_number().over(order).alias("__at"), fresh.alias("__new"))
    along = Window.partitionBy(key).orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    islands = marked.withColumn("__island", F.sum("__new").over(along))
    return islands.groupBy(key, "__island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__island")
