"""Aggregates that compare predicted with actual flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _n(c: Column) -> Column:
    return F.count_if(F.coalesce(c, F.lit(False))).cast("double")


def iou(predicted: Column, actual: Column) -> Column:
    """Intersection over union; 1 if the union is empty."""
    union = _n(predicted | actual)
    return F.when(union == 0, 1.0).otherwise(_n(predicted & actual) / union)


def dice(predicted: Column, actual: Column) -> Column:
    total = _n(predicted) + _n(actual)
    return F.when(total == 0, 1.0).otherwise(2 * _n(predicted & actual) / total)


def precision(predicted: Column, actual: Column) -> Column:
    return F.when(_n(predicted) == 0, 1.0).otherwise(_n(predicted & actual) / _n(predicted))


def recall(predicted: Column, actual: Column) -> Column:
    return F.when(_n(actual) == 0, 1.0).otherwise(_n(predicted & actual) / _n(actual))
