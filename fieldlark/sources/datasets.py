"""Raster dataset definitions: the shipped catalog, INI definitions and catalog pages."""

from __future__ import annotations

import ast
import configparser
import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import safe_filename

#: Shipped definitions (fixed values, but for the first dataset, a substitute for a private upload): name, dataset, band, first and last year or the years
#: listed, how images are chosen, cultivated and natural codes (pairs are inclusive), season.
CATALOG = (
    ("clum_landcover", "CLUM-50m-{year}", "b1", [2020], "dataset_year_pattern", [(300, 353), 361, 364, (400, 454), 461, 464, (510, 515)], [(100, 210), 360, 362, 363, 365, 460, 462, 463, 465], None),
    ("corine", "COPERNICUS/CORINE/V20/100m/{year}", "landcover", [1990, 2000, 2006, 2012, 2018], "dataset_year_pattern", [(211, 244)], [(311, 423)], None),
    ("dea_landcover", "dea_landcover_{year}_compressed", "b1", (1998, 2020), "dataset_year_pattern", [1, (3, 8), (14, 18)], [(19, 36), (55, 92), (94, 97)], None),
    ("era5_max_air_temp", "ECMWF/ERA5/DAILY", "maximum_2m_air_temperature", (1979, 2019), "date", [], [], "max"),
    ("era5_mean_air_temp", "ECMWF/ERA5/DAILY", "mean_2m_air_temperature", (1979, 2019), "date", [], [], "mean"),
    ("era5_min_air_temp", "ECMWF/ERA5/DAILY", "minimum_2m_air_temperature", (1979, 2019), "date", [], [], "min"),
    ("era5_precip", "ECMWF/ERA5/DAILY", "total_precipitation", (1979, 2019), "date", [], [], "sum"),
    ("gdw", "GOOGLE/DYNAMICWORLD/V1", "label", (2015, 2022), "date", [4], [(1, 3), 5], None),
    ("gfsad", "USGS/GFSAD1000_V1", "landcover", [2010], "None", [(1, 5)], [0], None),
    ("modis", "MODIS/061/MCD12Q1", "LC_Type2", (2001, 2020), "date", [12, 14], [(1, 11)], None),
    ("nass", "USDA/NASS/CDL", "cropland", (1997, 2020), "date", [(1, 77), (204, 254)], [87, (141, 195)], None),
    ("nlcd", "USGS/NLCD_RELEASES/2016_REL", "landcover", [1992, 2001, 2004, 2006, 2008, 2011, 2013, 2016], "date", [81, 82], [(41, 74), (90, 95)], None),
    ("precip_daymet", "NASA/ORNL/DAYMET_V4", "prcp", (1980, 2020), "dataset_string", [], [], "sum"),
)
DISABLED = ("gdw", "precip_daymet")
SCHEMA = "section string, dataset string, band string, valid_years array<int>, filter_by string, cultivated string, natural string, seasonal string, disabled boolean"


def catalog(spark: SparkSession) -> DataFrame:
    rows = [(s, d, b, list(range(y[0], y[1] + 1)) if isinstance(y, tuple) else y, f, json.dumps(c), json.dumps(n), season, s in DISABLED) for s, d, b, y, f, c, n, season in CATALOG]
    return spark.createDataFrame(rows, SCHEMA)


def with_scale(wanted: DataFrame, pages: DataFrame, default: int = 30) -> DataFrame:
    """``wanted`` (with ``dataset_id``) with the native scale in meters that the catalog pages give, or the default."""
    scales = pages.groupBy("dataset_id").agg(F.min("nominal_scale").alias("__scale"))
    return wanted.join(scales, "dataset_id", "left").withColumn("scale", F.coalesce("__scale", F.lit(default))).drop("__scale")


def _years(text: str) -> list[int]:
    """A literal list, or ``list(range(a, b))``; nothing is evaluated."""
    text = text.strip()
    if text.startswith("list(range("):
        a, b = (int(x) for x in text.removeprefix("list(range(").rstrip(")").split(","))
        return list(range(a, b))
    return list(ast.literal_eval(text))


def read_definitions(spark: SparkSession, texts: Iterable[str]) -> DataFrame:
    """Definitions from INI texts, in the schema of the catalog."""
    rows = []
    for text in texts:
        ini = configparser.ConfigParser()
        ini.read_string(text)
        name = next(s for s in ini.sections() if s not in ("mask_types", "seasonal"))
        codes = {k: json.dumps(ast.literal_eval(ini.get("mask_types", k, fallback="[]"))) for k in ("cultivated", "natural")}
        season = ini.get("seasonal", "aggregate_function", fallback=None)
        main = ini[name]
        rows.append((name, main["gee_dataset"], main["band_name"], _years(main["valid_years"]), main.get("filter_by"), codes["cultivated"], codes["natural"], season.strip("'\"") if season else None, main.get("disabled", "").lower() == "true"))
    return spark.createDataFrame(rows, SCHEMA)


def viewer_script(template: str, name: Column | None = None, image_only: bool = False) -> list[Column]:
    """file and script of each definition: the template with its placeholders replaced, and the names below it."""
    years = F.concat(F.lit("["), F.array_join(F.transform("valid_years", lambda y: F.concat(F.lit("'"), y.cast("string"), F.lit("'"))), ", "), F.lit("]"))
    title = F.coalesce(name, F.col("dataset")) if name is not None else F.col("dataset")
    script = F.lit(template)
    for key, value in (("VALID_YEARS", years), ("DATASET_NAME", title), ("DATASET_ID", F.col("dataset")), ("BAND_ID", F.col("band")), ("IMAGE_ONLY", F.lit(str(image_only).lower()))):
        script = F.replace(script, F.lit(f"${key}$"), value)
    file = safe_filename(F.concat("section", F.lit(".js")))
    return [file.alias("file"), F.concat(script, F.lit("\n"), title, F.lit("\n"), "section", F.lit(".js\n")).alias("script")]


def matches(code: Column, codes: Iterable[int | tuple[int, int] | list[int]]) -> Column:
    """Whether a code is one of the numbers or within one of the inclusive pairs."""
    out = F.lit(False)
    for c in codes:
        out = out | (code.between(c[0], c[1]) if isinstance(c, (tuple, list)) else code == c)
    return out


def mask_class(code: Column, section: str) -> Column:
    """natural, cultivated or null by the dataset's codes."""
    row = next(r for r in CATALOG if r[0] == section)
    return F.when(matches(code, row[6]), "natural").when(matches(code, row[5]), "cultivated")


#: What a catalog page looks like (fixed values): dates, snippet, cadence and the two ways to give a resolution.
PAGE_DATES = r"(?s)Dataset Availability.*?(\d{4}-\d{2}-\d{2})T.*?(\d{4}-\d{2}-\d{2})T"
PAGE_SNIPPET = r'(?s)Earth Engine Snippet.*?ee\.(ImageCollection|Image)\("([^"]+)"\)'
PAGE_CADENCE = r"(?s)Cadence.*?\b(Year|Month|Day)\b"
PAGE_PIXEL = r"(?s)Pixel Size.*?(\d+) meters"
PAGE_RESOLUTION = r"(?s)<p>\s*<b>Resolution</b>\s*<br>\s*([\d,]+)\s*meters"


def parse_catalog_page(page: Column) -> list[Column]:
    """start_date, end_date, dataset_type, dataset_id, temporal_resolution and nominal_scale of a catalog page."""

    def found(pattern: str, group: int = 1) -> Column:
        return F.nullif(F.regexp_extract(page, pattern, group), F.lit(""))

    cadence = found(PAGE_CADENCE)
    scale = F.coalesce(found(PAGE_PIXEL), F.replace(found(PAGE_RESOLUTION), F.lit(","), F.lit("")))
    resolution = F.when(cadence == "Year", "years").when(cadence.isNotNull(), "julian")
    return [
        found(PAGE_DATES, 1).alias("start_date"), found(PAGE_DATES, 2).alias("end_date"), found(PAGE_SNIPPET, 1).alias("dataset_type"), found(PAGE_SNIPPET, 2).alias("dataset_id"),
        resolution.alias("temporal_resolution"), scale.cast("int").alias("nominal_scale"),
    ]
