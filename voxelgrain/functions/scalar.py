"""Scalar helpers of measurement tables, all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nm_to_voxels(nm: Column, voxel_size: float) -> Column:
    """At least one voxel, halves to even."""
    return F.greatest(F.lit(1), F.bround(nm / voxel_size).cast("int"))


def clipped_distance(d: Column, limit: float) -> Column:
    """Distance as a share of a limit, 1 beyond it."""
    return F.least(d, F.lit(limit)) / limit


def diameter(radius: Column, factor: float = 1.0) -> Column:
    return 2 * radius * factor


def stem(path: Column) -> Column:
    """File name without folders and its last extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def relative_to(path: Column, root: str) -> Column:
    return F.regexp_replace(path, f"^{root.rstrip('/')}/", "")


def clean_name(name: Column) -> Column:
    """Lower case, without question marks at the end."""
    return F.regexp_replace(F.lower(name), r"\?+$", "")


def euclidean(a: list[Column], b: list[Column], size: list[float]) -> Column:
    parts = [((p - q) * F.lit(float(s))) for p, q, s in zip(a, b, size, strict=True)]
    total = parts[0] * parts[0]
    for p in parts[1:]:
        total = total + p * p
    return F.sqrt(total)
