"""Boxes as column expressions. A box is a struct or a prefix of columns x0, y0, x1, y1; the origin
is the top left corner."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("x0", "y0", "x1", "y1")


def box(prefix: str = "") -> dict[str, Column]:
    return {s: F.col(prefix + s) for s in SIDES}


def width(b) -> Column:
    return b["x1"] - b["x0"]


def height(b) -> Column:
    return b["y1"] - b["y0"]


def area(b) -> Column:
    return F.greatest(width(b), F.lit(0.0)) * F.greatest(height(b), F.lit(0.0))


def is_empty(b) -> Column:
    return (width(b) <= 0) | (height(b) <= 0)


def union(a, b) -> dict[str, Column]:
    return {s: (F.least if s[1] == "0" else F.greatest)(a[s], b[s]) for s in SIDES}


def intersect(a, b) -> dict[str, Column]:
    return {s: (F.greatest if s[1] == "0" else F.least)(a[s], b[s]) for s in SIDES}


def expand(b, dx: float, dy: float | None = None) -> dict[str, Column]:
    dy = dx if dy is None else dy
    return {"x0": b["x0"] - dx, "y0": b["y0"] - dy, "x1": b["x1"] + dx, "y1": b["y1"] + dy}


clamp = intersect


def scale(b, f: float) -> dict[str, Column]:
    return {s: b[s] * f for s in SIDES}


def contains(a, b, tol: float = 0.0) -> Column:
    return (b["x0"] >= a["x0"] - tol) & (b["y0"] >= a["y0"] - tol) & (b["x1"] <= a["x1"] + tol) & (b["y1"] <= a["y1"] + tol)


def contains_point(a, x: Column, y: Column) -> Column:
    return x.between(a["x0"], a["x1"]) & y.between(a["y0"], a["y1"])


def overlap_fraction(a, b) -> Column:
    """The share of b that a covers; 0 for an empty b."""
    return F.when(area(b) > 0, area(intersect(a, b)) / area(b)).otherwise(0.0)


def gap(a, b) -> Column:
    """The Euclidean distance between two boxes, 0 if they touch."""
    dx = F.greatest(a["x0"] - b["x1"], b["x0"] - a["x1"], F.lit(0.0))
    dy = F.greatest(a["y0"] - b["y1"], b["y0"] - a["y1"], F.lit(0.0))
    return F.sqrt(dx * dx + dy * dy)


def vertical_overlap(a, b) -> Column:
    return F.greatest(F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]), F.lit(0.0))


def rounded(b, digits: int = 1) -> Column:
    return F.array(*[F.bround(b[s], digits) for s in SIDES])
