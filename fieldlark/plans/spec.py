"""The query specification: what a form of the observation service selects."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

#: Pseudo-field that stands for the study's name.
STUDY_ID = "Study_ID"
#: Comparisons that an extension of the covariate filter may use.
OPERATIONS = ("=", "<", ">")


class SpecError(ValueError):
    """A form field that can't be understood."""


@dataclass(frozen=True)
class QuerySpec:
    """All active parts are joined by AND; a threshold of 0 and an empty part are inactive."""

    covariates: tuple[tuple[str, tuple[str, ...]], ...] = ()
    center_point: str | None = None
    center_buffer: str | None = None
    upper_left: str | None = None
    lower_right: str | None = None
    country: str | None = None
    continent: str | None = None
    min_sites: int = 0
    min_years: int = 0
    min_obs_per_year: int = 0
    years: str | None = None
    #: Numeric comparisons (field, one of OPERATIONS, value): an extension.
    comparisons: tuple[tuple[str, str, float], ...] = ()
    #: Match country and continent by type as well as by name: an extension.
    typed_places: bool = False
    #: The box of a center point has half the edges asked for.
    legacy_buffer: bool = True


@dataclass(frozen=True)
class Box:
    """Inclusive at all sides; no wrap at the antimeridian."""

    top: float
    left: float
    bottom: float
    right: float
    text: str = field(default="", compare=False)


def extract_years(text: str) -> list[int]:
    """Years and ranges such as ``1990, 1992 1995-2000``: sorted and distinct.

    Parts are separated by commas or white space; a range whose end lies before its
    start is empty.  Blanks around the dash and a trailing comma are errors.
    """
    found: set[int] = set()
    if text.strip() == "":
        raise SpecError("no years")
    for part in re.split(r"[,\s]+", text):
        m = re.fullmatch(r"([0-9]+)(?:-([0-9]+))?", part)
        if not m:
            raise SpecError(f"not a year or a range of years: {part!r} in {text!r}")
        found.update(range(int(m[1]), int(m[2] or m[1]) + 1))
    return sorted(found)


def _pair(text: str, separators: str) -> tuple[float, float]:
    m = re.match(separators, text)
    try:
        return float(m[1]), float(m[2])
    except (TypeError, ValueError) as e:
        raise SpecError(f"not a pair of coordinates: {text!r}") from e


#: How a center and a corner are written (fixed values).
CENTER = r"[(]?([^, \t]+)[, \t]+([^, )]+)[\)]?"
CORNER = r"[(]?([^, ]+)[, ]*([^, )]+)[\)]?"


def box_of(spec: QuerySpec) -> Box | None:
    """The box of the corners, else that of the center point, else None."""
    box = None
    center = (spec.center_point or "").strip()
    if center:
        lat, lng = _pair(center, CENTER)
        try:
            edge = float((spec.center_buffer or "").strip()) / 2
        except ValueError as e:
            raise SpecError("a center point needs a buffer") from e
        half = edge / 2 if spec.legacy_buffer else edge
        box = Box(lat + half, lng - half, lat - half, lng + half, f"center point at ({lat},{lng}) + +/-{edge}\n")
    corner = (spec.upper_left or "").strip()
    if corner:
        top, left = _pair(corner, CORNER)
        bottom, right = _pair((spec.lower_right or "").strip(), CORNER)
        text = f"bounding box ({top},{left}) ({bottom},{right})\n"
        box = Box(top, left, bottom, right, (box.text if box else "") + text)
    return box


def spec_from_form(form: Mapping[str, object]) -> QuerySpec:
    """A spec from a flat form: ``covariate``, ``values`` and ``valueCounts`` are lists, all else single values."""

    def many(name: str) -> Sequence[str]:
        v = form.get(name) or []
        return [v] if isinstance(v, str) else list(v)

    def number(name: str) -> int:
        return int(form.get(name) or 0)

    flat, at, groups = many("values"), 0, []
    for count in map(int, many("valueCounts")):
        groups.append(tuple(flat[at : at + count]))
        at += count
    one = {k: (form.get(k) or None) for k in ("centerPoint", "centerPointBuffer", "upperLeft", "lowerRight", "countrySelect", "continentSelect", "yearRange")}
    return QuerySpec(
        tuple(zip(many("covariate"), groups)), one["centerPoint"], one["centerPointBuffer"], one["upperLeft"], one["lowerRight"], one["countrySelect"], one["continentSelect"],
        number("minSitesPerStudy"), number("sampleSizeMinYears"), number("sampleSizeMinObservationsPerYear"), one["yearRange"],
    )


def filter_text(spec: QuerySpec, associations: Mapping[str, int]) -> str:
    """The filter in words, a line for each part."""
    lines = [f"{name}({associations.get(name)}) = {'|'.join(values)}\n" for name, values in spec.covariates if name and values]
    box = box_of(spec)
    lines.append(box.text if box else "")
    parts = (
        (spec.country, "country is {}"), (spec.continent, "continent is {}"), (spec.min_sites, "min sites per study {}"),
        (spec.min_years, "min sample size min years {}"), (spec.min_obs_per_year, "min observations per year {}"), (spec.years, "years in {{{}}}"),
    )
    return "".join([*lines, *(form.format(value) + "\n" for value, form in parts if value)])
