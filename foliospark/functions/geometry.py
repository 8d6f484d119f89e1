"""Boxes, points and draw positions as Spark Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def axis(box, i: int) -> Column:
    return F.transform(_c(box), lambda p: p[i])


def mean(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda s, x: s + x) / F.size(xs)


def rect(box) -> Column:
    """Quad of [x, y] points to struct x0, y0, x1, y1; null for an empty quad."""
    x, y = axis(box, 0), axis(box, 1)
    return F.when(F.size(_c(box)) > 0, F.struct(F.array_min(x).alias("x0"), F.array_min(y).alias("y0"), F.array_max(x).alias("x1"), F.array_max(y).alias("y1")))


def centre_y(box) -> Column:
    return mean(axis(box, 1))


def scale_box(box, sx, sy) -> Column:
    return F.transform(_c(box), lambda p: F.array(p[0] * _c(sx), p[1] * _c(sy)))


def quad(x0, y0, x1, y1) -> Column:
    a, b, c, d = map(_c, (x0, y0, x1, y1))
    return F.array(F.array(a, b), F.array(c, b), F.array(c, d), F.array(a, d))


def coverage(boxes, width, height) -> Column:
    """Largest image area over the page's area (at least 1); 0 without images."""
    area = F.transform(_c(boxes), lambda b: F.greatest(b[2] - b[0], F.lit(0.0)) * F.greatest(b[3] - b[1], F.lit(0.0)))
    return F.coalesce(F.array_max(area), F.lit(0.0)) / F.greatest(_c(width) * _c(height), F.lit(1.0))


def font_size(height: Column, width: Column, natural: Column) -> Column:
    return F.greatest(F.lit(3.0), F.least(height * 0.86, width / F.greatest(natural, F.lit(0.1)), F.lit(36.0)))


def baseline(y0: Column, y1: Column) -> Column:
    return y1 - (y1 - y0) * 0.12
