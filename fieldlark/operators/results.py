"""Result pages and wide exports: paging in a stable order, and the pivot of attribute rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import SAMPLE_LEVEL, STUDY_LEVEL
from ..sources.tables import Store
from .joins import bounded

#: Fixed columns of a page with their display order (fixed values).
SAMPLE_COLUMNS = (("row_number", -4.0), ("study_id", -3.0), ("observation", -2.0), ("latitude", -1.0), ("longitude", 0.0))
STUDY_COLUMNS = (("row_number", -1.0), ("study_id", 1.0))


def pivot_covariates(store: Store, owner: str, names: Sequence[str], keys: DataFrame | None = None) -> DataFrame:
    """A row for each ``owner`` (study_id or sample_id) with a column for each name; of duplicates the last by id wins.

    One aggregation over all names: no job is needed to find the columns.  Only the values of ``keys`` (a
    column named like the owner) are aggregated, if it is given.
    """
    defn = store.covariate_defn.where(F.col("name").isin(list(names))).select(F.col("id_key").alias("covariate_defn_id"), "name")
    rows = store.covariate_value.where(F.col(owner).isNotNull()).join(defn, "covariate_defn_id")
    if keys is not None:
        rows = rows.join(keys, owner, "left_semi")
    last = [F.max_by(F.when(F.col("name") == n, F.col("value")), F.when(F.col("name") == n, F.col("id_key"))).alias(n) for n in names]
    return rows.groupBy(owner).agg(*last) if last else rows.select(owner).distinct()


def page_of(fact: DataFrame, offset: int, limit: int) -> DataFrame:
    """A page in the order of sample ids, with row numbers that count from the start of the result."""
    page = fact.orderBy("id_key").offset(offset).limit(limit)
    return page.withColumn("row_number", (F.row_number().over(Window.orderBy("id_key")) + F.lit(offset)).cast("long"))


def page_samples(store: Store, fact: DataFrame, offset: int, limit: int, names: Sequence[str]) -> DataFrame:
    page = page_of(fact, offset, limit).select("row_number", "id_key", F.col("study_name").alias("study"), "observation", "latitude", "longitude", "year")
    wide = pivot_covariates(store, "sample_id", names, bounded(page.select(F.col("id_key").alias("sample_id")), limit))
    return page.join(wide, page["id_key"] == wide["sample_id"], "left").drop("sample_id")


def page_studies(fact: DataFrame, offset: int, limit: int) -> DataFrame:
    """The studies of a page by first appearance, numbered anew on each page."""
    first = page_of(fact, offset, limit).groupBy("study_id", "study_name").agg(F.min("row_number").alias("first_row"))
    return first.select(F.row_number().over(Window.orderBy("first_row")).cast("long").alias("row_number"), "study_id", "study_name", "first_row")


def has_more(fact: DataFrame, offset: int, limit: int) -> DataFrame:
    return fact.agg(F.count("*").alias("total")).select("total", (F.lit(offset + limit) < F.col("total")).alias("has_more"))


def column_order(names: Sequence[str], orders: dict[str, float], fixed: Sequence[tuple[str, float]]) -> list[str]:
    """Columns by display order; equal orders stay as given."""
    every = dict(fixed) | {n: orders[n] for n in names}
    return sorted(every, key=lambda n: every[n])


def export_samples(store: Store, fact: DataFrame, names: Sequence[str]) -> DataFrame:
    """All selected samples, wide; a missing value is the text ``None``."""
    base = fact.select("id_key", F.col("study_name").alias("study"), "observation", "latitude", "longitude", "year")
    wide = pivot_covariates(store, "sample_id", names, fact.select(F.col("id_key").alias("sample_id")))
    joined = base.join(wide, base["id_key"] == wide["sample_id"], "left").drop("sample_id")
    return joined.fillna("None", subset=list(names)) if names else joined


def export_studies(store: Store, fact: DataFrame, names: Sequence[str]) -> DataFrame:
    """The studies of the selected samples, wide; a missing value is the empty text."""
    base = fact.select("study_id", F.col("study_name").alias("study")).distinct()
    wide = pivot_covariates(store, "study_id", names, fact.select("study_id"))
    joined = base.join(wide, "study_id", "left")
    return joined.fillna("", subset=list(names)) if names else joined


def covariate_names(store: Store, level: int, fact: DataFrame | None = None) -> DataFrame:
    """Names with a value at that level, of the selected rows if ``fact`` is given, by display order and name."""
    owner = "study_id" if level == STUDY_LEVEL else "sample_id"
    values = store.covariate_value.where(F.col(owner).isNotNull())
    if fact is not None:
        key = fact.select(F.col("study_id" if level == STUDY_LEVEL else "id_key").alias(owner))
        values = values.join(key, owner, "left_semi")
    used = values.select(F.col("covariate_defn_id").alias("id_key")).distinct()
    return store.covariate_defn.join(used, "id_key", "left_semi").select("name", "display_order").orderBy("display_order", F.lower("name"))


__all__ = ["SAMPLE_LEVEL", "STUDY_LEVEL", "export_samples", "export_studies", "page_samples", "page_studies", "pivot_covariates"]
