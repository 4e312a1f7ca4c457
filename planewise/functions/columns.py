"""Keys and column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One segmentation of one field of view by one technique.
KEYS = ("region", "fov", "method")
#: One image, whatever segmented it.
IMAGE = ("region", "fov")


def labels_first(keys: tuple[str, ...]) -> list[str]:
    """The keys of a label, the label before those of its segmentation.

    Sorts of joins, windows and aggregates compare a whole number then; by ``region`` first, nearly all of their
    comparisons would be of equal strings.
    """
    return ["label", *keys]


def number_of(keys: tuple[str, ...], salt: int = 0) -> Column:
    """A whole number for a segmentation, short to carry and to compare; nulls count as values.

    Whether no two of them share one must be checked where all are known; another ``salt`` gives other numbers.
    """
    return F.xxhash64(F.lit(salt), *(c for k in keys for c in (F.col(k).isNull(), F.col(k))))


def flag(value: Column, cutoff: Column | float) -> Column:
    """Strictly above the cutoff; what cannot be measured is not flagged."""
    return F.coalesce(value > cutoff, F.lit(False))


def ratio(a: Column, b: Column) -> Column:
    """``a / b`` as double, null where ``b`` is 0 or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def first_of_largest(value: Column, place: Column) -> Column:
    """Aggregate: the smallest ``place`` among the largest ``value``."""
    return -F.max(F.struct(value.alias("v"), (-place).alias("p"))).getField("p")
