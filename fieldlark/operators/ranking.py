"""Consolidation of answers and ranking by votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import no_punctuation

UNKNOWN, FAILED = "UNKNOWN", "FAILED"


def norm(part: Column) -> Column:
    return no_punctuation(F.lower(F.trim(part)))


def consolidate(answers: DataFrame, keys: list[str], answer: str = "answer") -> DataFrame:
    """keys and the distinct known answers in order, comma-joined; UNKNOWN where none is known."""
    groups = answers.select(*keys, answer).distinct()
    known = groups.where(~F.col(answer).isin(UNKNOWN, FAILED))
    joined = known.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(answer)), ",").alias("consolidated"))
    return groups.select(*keys).distinct().join(joined, keys, "left").withColumn("consolidated", F.coalesce("consolidated", F.lit(UNKNOWN)))


def vote_rank(consolidated: DataFrame, answers: DataFrame, keys: list[str], answer: str = "answer") -> DataFrame:
    """keys and ``ranked``: parts of the consolidated answer with their votes, most first, as ``part (n)``.

    Votes are counted by one aggregation over all parts of all answers; a stable order
    keeps the place of equal counts.
    """
    parts = consolidated.select(*keys, F.posexplode(F.split("consolidated", ",")).alias("pos", "part")).select(*keys, "pos", norm(F.col("part")).alias("part"))
    votes = answers.select(*keys, F.explode(F.split(answer, ",")).alias("part")).select(*keys, norm(F.col("part")).alias("part"))
    counts = votes.groupBy(*keys, "part").agg(F.count("*").alias("n"))
    ranked = parts.join(counts, [*keys, "part"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    items = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("order"), "pos", "part", "n")))
    text = F.array_join(F.transform(items, lambda s: F.concat(s["part"], F.lit(" ("), s["n"].cast("string"), F.lit(")"))), ", ")
    return ranked.groupBy(*keys).agg(text.alias("ranked"))


def smoothed(df: DataFrame, key: str, order: list[str], value: str, alpha: float = 0.001) -> DataFrame:
    """key and ``smoothed``, the exponentially weighted mean of a key's values up to its last, and ``n``, how many there are.

    The weights are known from a row's distance to the last, so a sum does it and no list is made.
    """
    back = F.row_number().over(Window.partitionBy(key).orderBy(*(F.col(c).desc() for c in order)))
    rows = df.where(F.col(value).isNotNull()).select(key, F.col(value).alias("__v"), back.alias("__back"), F.count("*").over(Window.partitionBy(key)).alias("__n"))
    weight = F.pow(F.lit(1 - alpha), F.col("__back") - 1) * F.when(F.col("__back") == F.col("__n"), F.lit(1.0)).otherwise(F.lit(alpha))
    return rows.groupBy(key).agg(F.sum(F.col("__v") * weight).alias("smoothed"), F.count("*").alias("n"))


def time_left(seconds_each: Column, left: Column) -> Column:
    """Hours, minutes and seconds, within a day, that so many items will take."""
    total = F.round(F.greatest(seconds_each * left, F.lit(0.0))).cast("long") % 86400
    return F.format_string("%02d:%02d:%02d", F.floor(total / 3600), F.floor(total / 60) % 60, total % 60)
