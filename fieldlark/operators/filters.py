"""The dynamic filter: a specification becomes a chain of filters and semi joins.

Each membership test is a left semi join, so Catalyst may broadcast the small side it
measures and rows are never multiplied.  Thresholds apply to whole studies: they are
aggregated from all samples, with partial aggregation before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.spec import STUDY_ID, QuerySpec, SpecError, box_of, extract_years
from ..schemas import SAMPLE_LEVEL, STUDY_LEVEL
from ..sources.tables import Store


def base_fact(store: Store) -> DataFrame:
    """Samples with their study's name and their point's coordinates."""
    study = store.study.select(F.col("id_key").alias("study_id"), F.col("name").alias("study_name"))
    point = store.point.select(F.col("id_key").alias("point_id"), "latitude", "longitude")
    return store.sample.join(study, "study_id").join(point, "point_id")


def associations(store: Store, names: list[str]) -> dict[str, tuple[int, int]]:
    """id and association of the covariates named; the definitions are a small catalog."""
    rows = store.covariate_defn.where(F.col("name").isin(names)).select("name", "id_key", "covariate_association").collect() if names else []
    return {r[0]: (r[1], r[2]) for r in rows}


def with_covariate(fact: DataFrame, values: DataFrame, association: int) -> DataFrame:
    """Rows of ``fact`` whose study or sample is among ``values``."""
    if association == STUDY_LEVEL:
        return fact.join(values.select("study_id").where("study_id is not null"), "study_id", "left_semi")
    return fact.join(values.select(F.col("sample_id").alias("id_key")).where("sample_id is not null"), "id_key", "left_semi")


def in_place(fact: DataFrame, store: Store, name: str, kind: str | None = None) -> DataFrame:
    """Rows whose point lies in a place of that name, of that type if one is given."""
    place = store.geolocation.where(F.col("geolocation_name") == name)
    if kind:
        place = place.where(F.col("geolocation_type") == kind)
    points = store.geo_point.join(place.select(F.col("id_key").alias("geolocation_id")), "geolocation_id", "left_semi")
    return fact.join(points.select("point_id"), "point_id", "left_semi")


def in_box(fact: DataFrame, top: float, left: float, bottom: float, right: float) -> DataFrame:
    return fact.where(F.col("latitude").between(bottom, top) & F.col("longitude").between(left, right))


def studies_with_sites(sample: DataFrame, n: int) -> DataFrame:
    return sample.groupBy("study_id").agg(F.countDistinct("point_id").alias("n")).where(F.col("n") >= n).select("study_id")


def studies_with_years(sample: DataFrame, n: int) -> DataFrame:
    return sample.groupBy("study_id").agg(F.countDistinct("year").alias("n")).where(F.col("n") >= n).select("study_id")


def studies_with_observations(sample: DataFrame, n: int) -> DataFrame:
    """Studies with ``n`` samples or more in each year in which they have any."""
    yearly = sample.groupBy("study_id", "year").agg(F.count("id_key").alias("n"))
    return yearly.groupBy("study_id").agg(F.min("n").alias("n")).where(F.col("n") >= n).select("study_id")


def apply_spec(store: Store, spec: QuerySpec, strict: bool = False) -> DataFrame:
    """The base fact restricted to ``spec``.  An unknown covariate restricts nothing, or is an error if ``strict``."""
    fact = base_fact(store)
    known = associations(store, [n for n, v in spec.covariates if n and v] + [c[0] for c in spec.comparisons])
    for name, values in spec.covariates:
        if not name or not values:
            continue
        if name == STUDY_ID:
            fact = fact.where(F.col("study_name").isin(list(values)))
        elif name in known:
            defn, association = known[name]
            chosen = store.covariate_value.where((F.col("covariate_defn_id") == defn) & F.col("value").isin(list(values)))
            fact = with_covariate(fact, chosen, association)
        elif strict:
            raise SpecError(f"unknown covariate {name!r}")
    for name, op, bound in spec.comparisons:
        if name not in known:
            raise SpecError(f"unknown covariate {name!r}")
        number = F.col("value").try_cast("double")
        test = {"=": number == bound, "<": number < bound, ">": number > bound}[op]
        fact = with_covariate(fact, store.covariate_value.where((F.col("covariate_defn_id") == known[name][0]) & test), known[name][1])
    if spec.country:
        fact = in_place(fact, store, spec.country, "COUNTRY" if spec.typed_places else None)
    if spec.continent:
        fact = in_place(fact, store, spec.continent, "CONTINENT" if spec.typed_places else None)
    box = box_of(spec)
    if box:
        fact = in_box(fact, box.top, box.left, box.bottom, box.right)
    sample = store.sample
    for n, studies in ((spec.min_sites, studies_with_sites), (spec.min_years, studies_with_years), (spec.min_obs_per_year, studies_with_observations)):
        if n > 0:
            fact = fact.join(studies(sample, n), "study_id", "left_semi")
    if spec.years:
        fact = fact.where(F.col("year").isin(extract_years(spec.years)))
    return fact


def count_samples_studies(fact: DataFrame) -> DataFrame:
    return fact.agg(F.count("*").alias("sample_count"), F.countDistinct("study_id").alias("study_count"))


__all__ = ["SAMPLE_LEVEL", "STUDY_LEVEL", "apply_spec", "base_fact", "count_samples_studies"]
