"""The small language of nested aggregations over raster time series.

    spatial_mean(100;years_mean(-2,0;julian_max(100,200)))

The innermost function acts first.  ``parse`` gives the steps in that order.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

KINDS = ("spatial", "years", "julian")
STATS = ("mean", "max", "min", "sd", "mean_n_min", "mean_n_max")
NAMES = tuple(f"{k}_{s}" for k in KINDS for s in STATS)


class ExprError(ValueError):
    """An expression that isn't valid; the message names the part."""


@dataclass(frozen=True)
class Step:
    """One aggregation: over space, years or days of the year."""

    kind: str
    stat: str
    args: tuple[int, ...]

    @property
    def top(self) -> int | None:
        """How many extreme values a mean_n statistic takes."""
        return self.args[0] if self.stat.startswith("mean_n") else None

    @property
    def span(self) -> tuple[int, ...]:
        return self.args[1:] if self.top is not None else self.args


_CALL = re.compile(r"([A-Za-z_]+)\(([^();]*)(?:;(.*))?\)", re.DOTALL)


def parse(text: str) -> list[Step]:
    """Steps, innermost first."""
    rest, calls = re.sub(r"\s+", "", text), []
    while rest is not None:
        m = _CALL.fullmatch(rest)
        if not m:
            raise ExprError(f"not a function call: {rest!r}")
        try:
            args = tuple(int(a) for a in m[2].split(","))
        except ValueError as e:
            raise ExprError(f"arguments of {m[1]} must be integers: {m[2]!r}") from e
        calls.append((m[1], args))
        rest = m[3]
    steps = []
    for depth, (name, args) in enumerate(calls):
        if name not in NAMES:
            raise ExprError(f"unknown function {name!r}; one of {', '.join(NAMES)}")
        kind, stat = name.split("_", 1)
        if any(kind == s.kind for s in steps):
            raise ExprError(f"{kind} is used twice")
        if kind == "julian" and not any(c[0].startswith("years_") for c in calls[:depth]):
            raise ExprError("julian must stand within years")
        need = (1 if kind == "spatial" else 2) + stat.startswith("mean_n")
        if len(args) != need:
            raise ExprError(f"{name} takes {need} arguments, not {len(args)}")
        steps.append(Step(kind, stat, args))
    return steps[::-1]


def with_default_space(steps: list[Step]) -> list[Step]:
    """``steps`` with a mean at the point itself when none is spatial; the list given stays as it is."""
    return list(steps) if any(s.kind == "spatial" for s in steps) else [*steps, Step("spatial", "mean", (0,))]


def compose(spatial: str, radius: int, back: int, julian: str, first: int, last: int) -> str:
    """The expression of the extraction form."""
    return f"spatial_{spatial}({radius};years_mean({-back},0;julian_{julian}({first},{last})))"


@dataclass(frozen=True)
class Transform:
    """mask: 1 where the value is among the codes, else 0; mult and add: by a number."""

    kind: str
    args: tuple[float, ...]


def parse_transform(text: object) -> Transform | None:
    """A pixel transform such as ``mask[1,2]``, ``mult[0.1]`` or ``add[-273.15]``; none for n/a."""
    if not isinstance(text, str) or text.strip().lower() in ("", "na", "n/a", "none"):
        return None
    m = re.fullmatch(r"\s*(mask|mult|add)\s*(\[.*\]|[-+0-9.eE]+)\s*", text, re.DOTALL)
    if not m:
        raise ExprError(f"not a pixel transform: {text!r}")
    try:
        value = json.loads(m[2])
    except ValueError as e:
        raise ExprError(f"arguments of {m[1]} are no JSON: {m[2]!r}") from e
    numbers = tuple(value) if isinstance(value, list) else (value,)
    if m[1] != "mask" and len(numbers) != 1:
        raise ExprError(f"{m[1]} takes one number")
    return Transform(m[1], numbers)
