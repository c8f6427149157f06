"""Raster time series at points: windows of days, aggregations by step, spatial joins and masks.

Pixels are a long table (dataset_id, band, ts, pixel_id, value and others); requests
are rows (row_id, latitude, longitude, year).  Only the distinct request years are
expanded into windows, a small table that is broadcast; pixels meet it by an equi-join
on the calendar year, with the exact bounds as a condition, and the outer bounds are
pushed down to the scan.  Before that only the pixels that a request can reach are kept: at its
own place or within its circle, by bounds that the scan sees and a semi-join, and then only with the years
asked of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import bounded
from .expr import Step, Transform, with_default_space

EARTH_M = 6371008.8
DEFAULT_JULIAN = (1, 365)


def day_window(year: Column, first: int, last: int) -> tuple[Column, Column]:
    """Start, and exclusive end, of days ``first`` to ``last`` of a year.

    Day 1 is January 1; 0 and -1 are both December 31 before, -2 the day before that;
    days over 365 run on into the next year.
    """
    new_year = F.make_date(year, F.lit(1), F.lit(1))
    start = F.date_add(F.make_date(year - 1, F.lit(12), F.lit(31)), first + 1) if first < 0 else F.date_add(new_year, first - 1)
    end = F.date_add(F.make_date(year + 1, F.lit(1), F.lit(1)), last - 365) if last > 365 else F.date_add(new_year, last)
    return start, end


def ranges(steps: Sequence[Step]) -> tuple[tuple[int, int], tuple[int, int]]:
    """The years before and after a point's year, and the days, that an expression reads."""
    years = next((s.span for s in steps if s.kind == "years"), (0, 0))
    days = next((s.span for s in steps if s.kind == "julian"), DEFAULT_JULIAN)
    return (years[0], years[1]), (days[0], days[1])


def window_table(years: DataFrame, span: tuple[int, int], days: tuple[int, int]) -> DataFrame:
    """request_year, year, start, end and each calendar year that the window touches."""
    w = years.select(F.col("year").cast("int").alias("request_year")).distinct().select("request_year", F.explode(F.sequence(F.col("request_year") + span[0], F.col("request_year") + span[1])).alias("year"))
    start, end = day_window(F.col("year"), *days)
    w = w.withColumn("start", start.cast("timestamp")).withColumn("end", end.cast("timestamp"))
    return w.withColumn("calendar", F.explode(F.sequence(F.year("start"), F.greatest(F.year(F.col("end") - F.expr("INTERVAL 1 SECOND")), F.year("start")))))


def in_windows(pixels: DataFrame, years: DataFrame, span: tuple[int, int], days: tuple[int, int]) -> DataFrame:
    """Pixels within the windows, with request_year and year; one that is in two windows comes twice."""
    low, high = years.agg(F.min("year"), F.max("year")).first()
    if low is None:
        return pixels.limit(0).select("*", F.lit(0).alias("request_year"), F.lit(0).alias("year"))
    outer = window_table(years.sparkSession.createDataFrame([(int(low),), (int(high),)], "year int"), span, days).agg(F.min("start"), F.max("end")).first()
    near = pixels.where((F.col("ts") >= F.lit(outer[0])) & (F.col("ts") < F.lit(outer[1]))).withColumn("calendar", F.year("ts"))
    table = bounded(window_table(years, span, days), (high - low + 1) * (span[1] - span[0] + 1) * 3)
    return near.join(table, "calendar").where((F.col("ts") >= F.col("start")) & (F.col("ts") < F.col("end"))).drop("calendar", "start", "end")


def reduce_by(df: DataFrame, keys: list[str], stat: str, top: int | None = None, value: str | Sequence[str] = "value") -> DataFrame:
    """keys and the statistic of ``value``, or of several values; the standard deviation is that of a population."""
    values = [value] if isinstance(value, str) else list(value)
    if top is not None:
        # each value has its own extremes, so values become rows
        rows = df.select(*keys, F.explode(F.array(*(F.struct(F.lit(v).alias("__name"), F.col(v).alias("__value")) for v in values))).alias("__x")).select(*keys, "__x.*")
        order = F.col("__value").desc() if stat == "mean_n_max" else F.col("__value").asc()
        best = rows.where(F.col("__value").isNotNull()).withColumn("__r", F.row_number().over(Window.partitionBy(*keys, "__name").orderBy(order))).where(F.col("__r") <= top)
        return best.groupBy(*keys).agg(*(F.avg(F.when(F.col("__name") == v, F.col("__value"))).alias(v) for v in values))
    fn = {"mean": F.avg, "min": F.min, "max": F.max, "sd": F.stddev_pop}[stat]
    return df.groupBy(*keys).agg(*(fn(v).alias(v) for v in values))


def transformed(value: Column, transform: Transform | None) -> Column:
    if transform is None:
        return value
    if transform.kind == "mask":
        return F.when(value.isNotNull(), value.isin(*transform.args).cast("double"))
    return value * F.lit(transform.args[0]) if transform.kind == "mult" else value + F.lit(transform.args[0])


def mode_mask(pixels: DataFrame, years: DataFrame, span: tuple[int, int], codes: Sequence[float], code: str = "label") -> DataFrame:
    """pixel_id, request_year and mask: whether the codes were the commoner state over the years; ties are 0."""
    seen = in_windows(pixels.withColumn("on", F.col(code).isin(list(codes)).cast("int")), years, span, DEFAULT_JULIAN)
    counts = seen.groupBy("pixel_id", "request_year").agg(F.sum("on").alias("ones"), F.count("on").alias("n"))
    return counts.select("pixel_id", "request_year", (F.col("ones") * 2 > F.col("n")).cast("double").alias("mask"))


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.least(F.sqrt(h), F.lit(1.0)))


def within_radius(points: DataFrame, pixels: DataFrame, radius_m: float) -> DataFrame:
    """row_id, pixel_id of the pixels (pixel_id, lat, lon) at most ``radius_m`` from a point (row_id, latitude, longitude).

    An equi-join on grid cells: bands of latitude, and cells of longitude whose width follows
    the band, wrapping at the antimeridian.  A point goes to the cells its circle may touch.
    """
    step = max(radius_m / 111_000.0, 1e-4)
    band = F.floor((F.col("lat") + 90) / step)

    delta = radius_m / EARTH_M

    def cells(b: Column) -> Column:
        """Number of cells of a band: each as wide as the reach of a circle around a point in a band beside it."""
        far = F.greatest(F.abs(b * step - 90), F.abs((b + 1) * step - 90)) + step
        reach = F.degrees(F.asin(F.least(F.sin(F.lit(delta)) / F.cos(F.radians(F.least(far, F.lit(89.9)))), F.lit(1.0))))
        polar = (far + step >= 89.9) | F.lit(delta >= 1.5)
        return F.when(polar, F.lit(1).cast("long")).otherwise(F.greatest(F.floor(360 / reach), F.lit(1)))

    px = pixels.withColumn("band", band)
    px = px.withColumn("cell", F.floor(F.pmod(F.col("lon") + 180, F.lit(360.0)) / 360 * cells(F.col("band"))))
    own = F.floor((F.col("latitude") + 90) / step)
    pt = points.withColumn("band", F.explode(F.sequence(own - 1, own + 1)))
    pt = pt.withColumn("n", cells(F.col("band"))).withColumn("at", F.floor(F.pmod(F.col("longitude") + 180, F.lit(360.0)) / 360 * F.col("n")))
    around = F.when(F.col("n") <= 3, F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda i: F.pmod(F.col("at") + i, F.col("n")))))
    pt = pt.withColumn("cell", F.explode(around))
    joined = pt.join(px, ["band", "cell"])
    near = haversine(F.col("latitude"), F.col("longitude"), F.col("lat"), F.col("lon")) <= radius_m
    return joined.where(near).select("row_id", "pixel_id")


def _reached(keyed: DataFrame, steps: Sequence[Step], locations: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """The pairs (pixel_id, request_year) that requests can reach, and the circles (latitude, longitude, pixel_id) if there are any."""
    radius = max((s.span[0] for s in steps if s.kind == "spatial"), default=0)
    if not radius:
        return keyed.select("pixel_id", "request_year").where("pixel_id is not null").distinct(), None
    places = keyed.select("latitude", "longitude").distinct()
    low, high = places.agg(F.min("latitude"), F.max("latitude")).first()
    if low is not None:  # the circles' bounds in latitude reach the scan; those in longitude may wrap
        reach = radius / 110_000.0
        locations = locations.where(F.col("lat").between(low - reach, high + reach))
    # equal places share one circle
    points = places.select(F.struct("latitude", "longitude").alias("row_id"), "latitude", "longitude")
    near = within_radius(points, locations, radius).select("row_id.latitude", "row_id.longitude", "pixel_id")
    asked = keyed.select("latitude", "longitude", "request_year").distinct()
    return near.join(asked, ["latitude", "longitude"]).select("pixel_id", "request_year").distinct(), near


def reachable(pixels: DataFrame, reached: DataFrame) -> DataFrame:
    """``pixels`` whose id is among those of ``reached``; the ids' bounds are pushed down to the scan."""
    ids = reached.select("pixel_id").distinct()
    n, low, high = ids.agg(F.count("*"), F.min("pixel_id"), F.max("pixel_id")).first()
    if not n:
        return pixels.limit(0)
    return pixels.where(F.col("pixel_id").between(low, high)).join(bounded(ids, n, 32), "pixel_id", "left_semi")


def evaluate(requests: DataFrame, pixels: DataFrame, steps: Sequence[Step], transform: Transform | None = None, mask: DataFrame | None = None, locations: DataFrame | None = None) -> DataFrame:
    """row_id and value of each request: date filter, transform, mask, then the steps from the inside out.

    ``requests``: row_id, latitude, longitude, year and pixel_id, the pixel at the point itself.
    ``pixels``: ts, pixel_id, value of one dataset and band.  ``mask``: pixel_id, request_year,
    mask.  ``locations``: pixel_id, lat, lon, needed for a radius over 0.
    Requests with no pixel have a null value.
    """
    return evaluate_columns(requests, pixels, steps, {"value": transformed(F.col("value"), transform)}, mask, locations)


def evaluate_columns(requests: DataFrame, pixels: DataFrame, steps: Sequence[Step], values: dict[str, Column], mask: DataFrame | None = None, locations: DataFrame | None = None) -> DataFrame:
    """As ``evaluate``, but for several values of a pixel, by name, in one pass: row_id and a column for each."""
    steps, names = with_default_space(list(steps)), list(values)
    span, days = ranges(steps)
    keyed = requests.select("row_id", "latitude", "longitude", F.col("year").cast("int").alias("request_year"), "pixel_id")
    reached, near = _reached(keyed, steps, locations)
    now = in_windows(reachable(pixels, reached).select("ts", "pixel_id", *(v.alias(n) for n, v in values.items())), requests, span, days)
    now = now.join(reached, ["pixel_id", "request_year"], "left_semi")
    if mask is not None:
        now = now.join(mask, ["pixel_id", "request_year"]).withColumns({n: F.col(n) * F.col("mask") for n in names})
    place = ["pixel_id", "request_year"]
    for i, step in enumerate(steps):
        if step.kind == "julian":
            now = reduce_by(now, [*place, "year"], step.stat, step.top, names)
        elif step.kind == "years":
            now = reduce_by(now, place, step.stat, step.top, names)
        else:
            last = i == len(steps) - 1
            if step.span[0] > 0:
                asked = keyed.select("latitude", "longitude", "request_year").distinct()
                now = now.join(near, "pixel_id").join(asked, ["latitude", "longitude", "request_year"], "left_semi")
                place = ["latitude", "longitude", "request_year"]
            elif last and i:
                # one value for each pixel and request year
                now = now.withColumns({n: F.col(n) * 0 for n in names}) if step.stat == "sd" else now
                break
            kept = [c for c in ("year", "ts") if c in now.columns and not last]
            now = reduce_by(now, [*place, *kept], step.stat, step.top, names)
    return keyed.join(now.select(*place, *names), place, "left").select("row_id", *names)


def outside_guard(year: Column, value: Column, span: tuple[int, int], first: int, last: int, relaxed: bool = False) -> Column:
    """The value as text, or ``Outside a-b: (y0, y1)`` for years that the dataset lacks.

    y1 is the exclusive end; that it must not pass the last year rejects the last year itself,
    unless ``relaxed``.
    """
    y0, y1 = year + span[0], year + span[1] + 1
    late = (y1 - 1 if relaxed else y1) > last
    return F.when((y0 < first) | late, F.format_string(f"Outside {first}-{last}: (%d, %d)", y0, y1)).otherwise(value.cast("string"))


def batch_numbers(requests: DataFrame, size: int = 50) -> DataFrame:
    order = Window.partitionBy("year").orderBy("row_id")
    return requests.withColumn("batch", F.floor((F.row_number().over(order) - 1) / size).cast("long"))


def landcover_shares(pixels: DataFrame, keys: list[str], classes: int, code: str = "label") -> DataFrame:
    """Share of each class 0..classes-1 in one pass."""
    return pixels.groupBy(*keys).agg(*(F.avg((F.col(code) == k).cast("double")).alias(f"lulc_prop_area_{k}") for k in range(classes)))


def yearly_then_mean(pixels: DataFrame, stat: str = "max", around: int | None = None) -> DataFrame:
    """A statistic by pixel and year, then the mean over all years, or by pixel and year over that year and ``around`` before and after it."""
    yearly = reduce_by(pixels.withColumn("year", F.year("ts")), ["pixel_id", "year"], stat)
    if around is None:
        return yearly.groupBy("pixel_id").agg(F.avg("value").alias("value"))
    near = Window.partitionBy("pixel_id").orderBy("year").rangeBetween(-around, around)  # a row for each year of a pixel
    return yearly.select("pixel_id", "year", F.avg("value").over(near).alias("value"))


def yearly_mode(pixels: DataFrame, code: str = "label") -> DataFrame:
    """The commonest code by pixel and year; the smallest of equally common ones."""
    counts = pixels.groupBy("pixel_id", F.year("ts").alias("year"), code).agg(F.count("*").alias("n"))
    best = F.max(F.struct("n", (-F.col(code)).alias("least")))
    return counts.groupBy("pixel_id", "year").agg((-best["least"]).alias("mode"))


#: Rank error of the approximate percentiles that bracket the exact ones, as a share of a group's rows.
_BRACKET = 1e-4


def exact_percentiles(df: DataFrame, keys: list[str], shares: Sequence[float], value: str = "value") -> DataFrame:
    """keys and ``p0``, ``p1``, … the exact percentiles, interpolated, of each group; groups may be of any size.

    Approximate percentiles bracket each share; what lies below a bracket is only counted, and
    only the distinct values within it are sorted, a few ten-thousandths of a group.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v"))
    ends = [min(max(p + side * 2 * _BRACKET, 0.0), 1.0) for p in shares for side in (-1, 1)]
    groups = rows.groupBy(*keys).agg(F.count("*").alias("__n"), F.percentile_approx("__v", ends, round(1 / _BRACKET)).alias("__ends"))
    out = groups.select(*keys)
    large = F.col("__n") > round(1 / _BRACKET)  # smaller groups are sorted whole
    distinct = rows.groupBy(*keys, "__v").agg(F.count("*").alias("__c")).join(groups, keys)
    for i, p in enumerate(shares):
        low, high = F.when(large, F.col("__ends")[2 * i]), F.when(large, F.col("__ends")[2 * i + 1])
        below = distinct.groupBy(*keys).agg(F.coalesce(F.sum(F.when(F.col("__v") < low, F.col("__c"))), F.lit(0)).alias("__below"))
        inside = distinct.where(~F.coalesce((F.col("__v") < low) | (F.col("__v") > high), F.lit(False))).join(below, keys)
        upto = F.col("__below") + F.sum("__c").over(Window.partitionBy(*keys).orderBy("__v"))
        placed = inside.withColumn("__to", upto).withColumn("__from", F.col("__to") - F.col("__c"))
        at = F.lit(p) * (F.col("__n") - 1)
        first, second = F.floor(at), F.least(F.floor(at) + 1, F.col("__n") - 1)
        holds = lambda rank: F.max(F.when((F.col("__from") <= rank) & (rank < F.col("__to")), F.col("__v")))
        both = placed.groupBy(*keys, "__n").agg(holds(first).alias("__a"), holds(second).alias("__b"))
        out = out.join(both.select(*keys, (F.col("__a") + (F.col("__b") - F.col("__a")) * (at - first)).alias(f"p{i}")), keys)
    return out


def percentile_stretch(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """p10 and p90 of each group; p10 is 0 where both are equal."""
    both = exact_percentiles(pixels, keys, (0.1, 0.9))
    return both.select(*keys, F.when(F.col("p0") == F.col("p1"), F.lit(0.0)).otherwise(F.col("p0")).alias("low"), F.col("p1").alias("high"))


def first_image(pixels: DataFrame) -> DataFrame:
    """The value at the earliest time of a pixel's year; the smallest of several."""
    first = F.min(F.struct("ts", "value"))
    return pixels.groupBy("pixel_id", F.year("ts").alias("year")).agg(first["value"].alias("value"))


def focal_mean(values: DataFrame, locations: DataFrame, radius_m: float) -> DataFrame:
    """Mean of the values (pixel_id, value) of all pixels within the radius of each pixel.

    Pixels at one place share one circle and enter others as one sum and count: the pairs are those of
    places, and they are added up where they arise instead of being dealt out.
    """
    sums = locations.join(values, "pixel_id").groupBy("lat", "lon").agg(F.sum("value").alias("total"), F.count("value").alias("n"))
    places = locations.select("lat", "lon").distinct()
    points = places.select(F.struct("lat", "lon").alias("row_id"), F.col("lat").alias("latitude"), F.col("lon").alias("longitude"))
    pairs = within_radius(points, sums.select(F.struct("total", "n").alias("pixel_id"), "lat", "lon"), radius_m)
    around = pairs.groupBy("row_id").agg(F.sum("pixel_id.total").alias("total"), F.sum("pixel_id.n").alias("n"))
    mine = locations.join(around.select("row_id.lat", "row_id.lon", "total", "n"), ["lat", "lon"])
    return mine.groupBy("pixel_id").agg(F.try_divide(F.sum("total"), F.sum("n")).alias("value"))


def clamp_year(year: Column, first: int = 2016, last: int = 2023) -> Column:
    return F.least(F.greatest(year, F.lit(first)), F.lit(last))


def label_lookup(code: Column, labels: dict[int, str]) -> Column:
    table = F.create_map(*(x for k, v in labels.items() for x in (F.lit(k), F.lit(v))))
    return F.coalesce(table[code], F.lit("Unknown"))


def find_closest(values: Column, x: Column) -> Column:
    """The nearest value of an array; of two equally near the lower."""
    near = F.array_min(F.transform(values, lambda v: F.struct(F.abs(v - x).alias("d"), v.alias("v"))))
    return near["v"]


def column_name(dataset: str, band: str, expression: str, transform: str | None = None, cli: bool = False) -> str:
    return f"{dataset}_{band}_{expression}_{transform}" if cli else f"{dataset}:{band}_{expression}"
