"""The covariate catalog: searchable values, types, listings, places and updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import COVARIATE_TYPES, SAMPLE_LEVEL
from ..sources.tables import Store
from .joins import bounded


def type_name(code: Column) -> Column:
    out = F.when(code == 0, COVARIATE_TYPES[0])
    for i, name in enumerate(COVARIATE_TYPES[1:], 1):
        out = out.when(code == i, name)
    return out


def searchable_values(store: Store, limit: int | None = None) -> DataFrame:
    """name and the sorted distinct values of each covariate that is searched by value, the first ``limit`` if it is given.

    Pairs are made distinct with partial aggregation first, so an array grows with a
    covariate's distinct values and not with its rows, and with ``limit`` is bounded.
    """
    defn = store.covariate_defn.where("queryable and search_by_unique").select(F.col("id_key").alias("covariate_defn_id"), "name")
    pairs = store.covariate_value.join(defn, "covariate_defn_id").select("name", "value").distinct()
    if limit is not None:
        order = Window.partitionBy("name").orderBy("value")
        pairs = pairs.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= limit)
    return pairs.groupBy("name").agg(F.array_sort(F.collect_list("value")).alias("values"))


def continuous_covariates(store: Store) -> DataFrame:
    return store.covariate_defn.where("queryable and not search_by_unique").select("name", type_name(F.col("covariate_type")).alias("type_name"))


def covariate_listing(store: Store) -> DataFrame:
    """All definitions by association, display order and name; ``position`` gives the order."""
    order = Window.orderBy("covariate_association", "display_order", F.lower("name"))
    return store.covariate_defn.withColumn("position", F.row_number().over(order).cast("long"))


def places(store: Store, kind: str) -> DataFrame:
    return store.geolocation.where(F.col("geolocation_type") == kind).select("geolocation_name").distinct()


def study_names(store: Store) -> DataFrame:
    return store.study.select("name").distinct()


def group_concat_distinct(df: DataFrame, key: str, value: str) -> DataFrame:
    """Distinct values in order, comma-joined."""
    return df.select(key, value).distinct().groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(value)), ",").alias("joined"))


def usable(value: Column) -> Column:
    """Neither null nor the text null in any case; the text nan is a number."""
    return value.isNotNull() & (F.lower(value) != "null")


def unique_value_summary(store: Store, samples: int | None = None) -> DataFrame:
    """name and value: numbers count as ``true``, texts in lower case; distinct.  With ``samples``, those of the first so many samples by id."""
    defn = store.covariate_defn.select(F.col("id_key").alias("covariate_defn_id"), "name")
    rows = store.covariate_value.where(usable(F.col("value"))).join(defn, "covariate_defn_id")
    if samples is not None:
        first = store.sample.select(F.col("id_key").alias("sample_id")).orderBy("sample_id").limit(samples)
        rows = rows.join(bounded(first, samples), "sample_id", "left_semi")
    value = F.when(F.col("value").try_cast("double").isNotNull(), "true").otherwise(F.lower("value"))
    return rows.select("name", value.alias("value")).distinct()


def display_columns(store: Store, level: int) -> DataFrame:
    """Covariates that a table of that level shows: not hidden, and always shown or with a usable value."""
    at_level = (F.col("covariate_association") == level) | F.col("show_in_point_table")
    owner = "sample_id" if level == SAMPLE_LEVEL else "study_id"
    used = store.covariate_value.where(usable(F.col("value")) & F.col(owner).isNotNull()).select("covariate_defn_id").distinct()
    defn = store.covariate_defn.where(at_level & ~F.col("hidden"))
    marked = defn.join(used, defn["id_key"] == used["covariate_defn_id"], "left")
    return marked.where("always_display or covariate_defn_id is not null").select("name", "display_order").orderBy("display_order", F.lower("name"))


def update_covariates(defn: DataFrame, changes: DataFrame) -> DataFrame:
    """The definitions with the non-null fields of ``changes`` (by id_key) put in."""
    fields = [c for c in changes.columns if c != "id_key"]
    new = changes.select("id_key", *(F.col(c).alias(f"__{c}") for c in fields))
    joined = defn.join(new, "id_key", "left")
    return joined.select("id_key", *(F.coalesce(f"__{c}", c).alias(c) if c in fields else F.col(c) for c in defn.columns if c != "id_key"))
