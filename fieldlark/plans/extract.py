"""Point extraction: every dataset asked for as a column of the point table, in one plan."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import raster
from .expr import ExprError, parse, parse_transform, with_default_space

#: Points that a request of the form may hold.
MAX_POINTS = 5000
#: Sources of the form (fixed values): dataset and band with first and last date and the spatial statistics allowed.
PLAIN_STATS, FULL_STATS = ("mean",), ("mean", "min", "max", "sd")
SOURCES = {
    "*GOOGLE/DYNAMICWORLD/V1 landcover table": ("2015-06-27", "2025-03-04", PLAIN_STATS),
    "*MODIS/061/MCD12Q1 landcover table": ("2001-01-01", "2023-01-01", PLAIN_STATS),
    "GOOGLE/DYNAMICWORLD/V1:crops": ("2015-06-27", "2025-03-04", PLAIN_STATS),
    "ECMWF/ERA5/MONTHLY:dewpoint_2m_temperature": ("1979-01-01", "2020-06-01", FULL_STATS),
    "ECMWF/ERA5/MONTHLY:maximum_2m_air_temperature": ("1979-01-01", "2020-06-01", FULL_STATS),
    "ECMWF/ERA5/MONTHLY:mean_2m_air_temperature": ("1979-01-01", "2020-06-01", FULL_STATS),
    "ECMWF/ERA5/MONTHLY:minimum_2m_air_temperature": ("1979-01-01", "2020-06-01", FULL_STATS),
    "ECMWF/ERA5/MONTHLY:total_precipitation": ("1979-01-01", "2020-06-01", FULL_STATS),
    "MODIS/061/MCD12Q2:EVI_Amplitude_1": ("2001-01-01", "2023-01-01", FULL_STATS),
    "MODIS/061/MCD12Q2:EVI_Area_1": ("2001-01-01", "2023-01-01", FULL_STATS),
    "MODIS/061/MCD12Q2:Dormancy_1": ("2001-01-01", "2023-01-01", FULL_STATS),
    "MODIS/061/MCD12Q2:Greenup_1": ("2001-01-01", "2023-01-01", FULL_STATS),
    "MODIS/061/MCD12Q2:Peak_1": ("2001-01-01", "2023-01-01", FULL_STATS),
    "CSP/ERGo/1_0/Global/SRTM_topoDiversity:constant": ("2001-01-01", "2023-01-01", FULL_STATS),
}
#: Sources that may mask others (fixed values).
MASK_SOURCES = {"GOOGLE/DYNAMICWORLD/V1:label": ("2015-06-27", "2025-03-04"), "MODIS/061/MCD12Q1:LC_Type1": ("2001-01-01", "2023-01-01")}
#: Land-cover tables (fixed values): dataset, band and number of classes.
TABLES = {"*GOOGLE/DYNAMICWORLD/V1 landcover table": ("GOOGLE/DYNAMICWORLD/V1", "label", 9), "*MODIS/061/MCD12Q1 landcover table": ("MODIS/061/MCD12Q1", "LC_Type2", 16)}


@dataclass(frozen=True)
class Extraction:
    """One line of a dataset table, with an optional mask (dataset, band, codes) and the years the dataset has."""

    dataset: str
    band: str
    expression: str
    transform: str | None = None
    mask: tuple[str, str, tuple[float, ...]] | None = None
    years: tuple[int, int] | None = None


def check_form(points: DataFrame, wanted: Sequence[Extraction]) -> None:
    """What the form refuses: unknown sources and masks, statistics that a source does not offer, and too many points."""
    for x in wanted:
        source = x.dataset if x.dataset in TABLES else f"{x.dataset}:{x.band}"
        if source not in SOURCES:
            raise ExprError(f"unknown source {source}")
        for step in parse(x.expression):
            if step.kind == "spatial":
                check_stat(source, step.stat)
        if x.mask and f"{x.mask[0]}:{x.mask[1]}" not in MASK_SOURCES:
            raise ExprError(f"unknown mask {x.mask[0]}:{x.mask[1]}")
    if points.limit(MAX_POINTS + 1).count() > MAX_POINTS:
        raise ExprError(f"more than {MAX_POINTS} points")


def years_of(source: str) -> tuple[int, int]:
    """First and last year of a source of the form."""
    first, last = (SOURCES[source] if source in SOURCES else MASK_SOURCES[source])[:2]
    return int(first[:4]), int(last[:4])


def check_stat(source: str, stat: str) -> None:
    """A source of the form only takes its own statistics; other sources take all."""
    allowed = SOURCES[source][2] if source in SOURCES else FULL_STATS
    if stat not in allowed:
        raise ExprError(f"{source} allows {', '.join(allowed)}, not {stat}")


def _band(pixels: DataFrame, dataset: str, band: str) -> DataFrame:
    return pixels.where((F.col("dataset_id") == dataset) & (F.col("band") == band))


def located(points: DataFrame, locations: DataFrame) -> DataFrame:
    """``points`` (latitude, longitude and others) with the pixel at the point itself, the one of the smallest id if several are there, or null."""
    at = locations.groupBy(F.col("lat").alias("latitude"), F.col("lon").alias("longitude")).agg(F.min("pixel_id").alias("pixel_id"))
    return points.join(at, ["latitude", "longitude"], "left")


def _jobs(x: Extraction, cli: bool) -> tuple[str, str, list[tuple[str, str | None]]]:
    """Dataset, band, and the columns of one extraction as (name, transform)."""
    if x.dataset in TABLES:
        dataset, band, classes = TABLES[x.dataset]
        return dataset, band, [(f"{dataset}_lulc_prop_area_{k}_{x.expression}", f"mask[{k}]") for k in range(classes)]
    return x.dataset, x.band, [(raster.column_name(x.dataset, x.band, x.expression, x.transform, cli), x.transform)]


def extract(points: DataFrame, pixels: DataFrame, locations: DataFrame, wanted: Sequence[Extraction], cli: bool = False, form: bool = False) -> DataFrame:
    """``points`` with a column for each extraction, or for each class of a land-cover table.

    ``pixels``: dataset_id, band, ts, pixel_id, value; ``locations``: pixel_id, lat, lon.
    Requests of years that a dataset lacks get the text ``Outside …``.  With ``form`` what the
    form refuses is refused here too.

    Extractions of one dataset, band, expression, mask and years share one pass over its pixels, whatever their
    transforms; a land-cover table is one pass.  Points of one place and year share one request, and all
    columns meet the points in one join.
    """
    if form:
        check_form(points, wanted)
    asked = F.struct("latitude", "longitude", "year")
    requests = located(points.select("latitude", "longitude", "year").distinct(), locations).withColumn("row_id", asked)
    names: list[str] = []
    texts: set[int] = set()
    passes: dict[tuple, list[tuple[int, str | None]]] = {}
    for x in wanted:
        dataset, band, columns = _jobs(x, cli)
        for name, transform in columns:
            if x.years:
                texts.add(len(names))
            passes.setdefault((dataset, band, x.expression, x.mask, x.years), []).append((len(names), transform))
            names.append(name)
    rows = None
    for (dataset, band, expression, masked, years), columns in passes.items():
        steps = with_default_space(parse(expression))
        span, _ = raster.ranges(steps)
        mask = None
        if masked:
            codes = _band(pixels, masked[0], masked[1]).withColumn("label", F.col("value"))
            mask = raster.mode_mask(codes, requests, span, masked[2])
        values = {f"__{i}": raster.transformed(F.col("value"), parse_transform(transform)) for i, transform in columns}
        got = raster.evaluate_columns(requests, _band(pixels, dataset, band), steps, values, mask, locations)

        def cell(i: int, years: tuple[int, int] | None = years, span: tuple[int, int] = span) -> Column:
            number = F.col(f"__{i}").cast("double")
            text = raster.outside_guard(F.col("row_id.year"), number, span, *years) if years else F.lit(None).cast("string")
            return F.struct(F.lit(i).alias("slot"), number.alias("number"), text.alias("text"))

        long = got.select("row_id", F.inline(F.array(*(cell(i) for i, _ in columns))))
        rows = long if rows is None else rows.union(long)
    if rows is None:
        return points
    wide = rows.groupBy("row_id").agg(*(F.max(F.when(F.col("slot") == i, F.col("text" if i in texts else "number"))).alias(f"__{i}") for i in range(len(names))))
    joined = points.withColumn("__asked", asked).join(wide.withColumnRenamed("row_id", "__asked"), "__asked", "left")
    return joined.select(*points.columns, *(F.col(f"__{i}").alias(name) for i, name in enumerate(names)))
