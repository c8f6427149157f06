"""Deletes and updates as new versions of tables: survivors by anti joins, with counts.

Nothing is changed in place; a caller writes the new version and swaps paths, so a run
that is repeated after a failure gives the same tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import Store

ERROR_LENGTH = 2000


def purge(store: Store, names: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Survivors of each table after the species in ``names`` (column ``name``) go, and one row of counts.

    All answers and links of their questions go, then their mappings, then every question
    without mapping and link, then the species.
    """
    gone = store.species.join(names.select("name"), "name", "left_semi").select(F.col("id").alias("species_id"))
    ids = store.species_questions.join(gone, "species_id", "left_semi").select("question_id").distinct()
    left = {
        "answers": store.answers.join(ids, "question_id", "left_anti"),
        "question_links": store.question_links.join(ids, "question_id", "left_anti"),
        "species_questions": store.species_questions.join(gone, "species_id", "left_anti"),
        "species": store.species.join(gone.withColumnRenamed("species_id", "id"), "id", "left_anti"),
    }
    used = left["species_questions"].select(F.col("question_id").alias("id")).union(left["question_links"].select("question_id"))
    left["questions"] = store.questions.join(used, "id", "left_semi")
    counts = None
    for table, after in left.items():
        n = F.count("*").alias("n")
        one = getattr(store, table).agg(n).crossJoin(after.agg(F.count("*").alias("m"))).select(F.lit(table).alias("table_name"), (F.col("n") - F.col("m")).alias("deleted"))
        counts = one if counts is None else counts.union(one)
    return left, counts


def preview(store: Store, names: DataFrame) -> DataFrame:
    """What a purge would touch: species with the number of their questions."""
    gone = store.species.join(names.select("name"), "name", "left_semi")
    return gone.join(store.species_questions, gone["id"] == store.species_questions["species_id"], "left").groupBy("name").agg(F.count("question_id").alias("questions"))


def set_fetch_error(links: DataFrame, errors: DataFrame) -> DataFrame:
    """``links`` with the errors (id, error) of failed fetches, cut to a bounded length."""
    e = errors.select("id", F.substring("error", 1, ERROR_LENGTH).alias("__error"))
    return links.join(e, "id", "left").withColumn("fetch_error", F.coalesce("__error", "fetch_error")).drop("__error")


def append_answers(answers: DataFrame, new: DataFrame) -> DataFrame:
    """New answers with larger ids, unique but with gaps, so that no task sees them all; a missing context is the empty text."""
    top = answers.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    fresh = new.withColumn("context", F.coalesce("context", F.lit(""))).withColumn("__n", F.monotonically_increasing_id())
    fresh = fresh.crossJoin(F.broadcast(top)).withColumn("id", F.col("__n") + F.col("top") + 1).drop("__n", "top")
    return answers.unionByName(fresh.select(*answers.columns))
