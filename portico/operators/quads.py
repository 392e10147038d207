"""Overlap of quadrangles: exact areas by clipping on candidate pairs, and the quick bound by rectangles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .boxes import overlap_join

_EPS = 1e-9


def _cross(o: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[..., 0] - o[..., 0]) * (b[..., 1] - o[..., 1]) - (a[..., 1] - o[..., 1]) * (b[..., 0] - o[..., 0])


def _around(points: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Points of each row in order of the angle around their mean; those that are not there repeat the first."""
    count = np.maximum(there.sum(axis=1), 1)
    mean = (points * there[..., None]).sum(axis=1) / count[:, None]
    angle = np.where(there, np.arctan2(points[..., 1] - mean[:, None, 1], points[..., 0] - mean[:, None, 0]), np.inf)
    order = np.argsort(angle, axis=1, kind="stable")
    ordered = np.take_along_axis(points, order[..., None], axis=1)
    return np.where(np.take_along_axis(there, order, axis=1)[..., None], ordered, ordered[:, :1])


def area(rings: np.ndarray) -> np.ndarray:
    after = np.roll(rings, -1, axis=1)
    return np.abs((rings[..., 0] * after[..., 1] - after[..., 0] * rings[..., 1]).sum(axis=1)) / 2


def hulls(quads: np.ndarray) -> np.ndarray:
    """Convex hulls of rows of eight numbers as rings of four points; a point inside gives way to its neighbour."""
    rings = _around(quads.reshape(-1, 4, 2), np.ones((len(quads), 4), bool))
    before, after = np.roll(rings, 1, axis=1), np.roll(rings, -1, axis=1)
    return np.where((_cross(before, rings, after) < 0)[..., None], before, rings)


def common_area(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Area that convex rings share: their corners inside each other and where edges meet, in order."""
    a1, b1 = np.roll(a, -1, axis=1), np.roll(b, -1, axis=1)
    inside = lambda p, ring, ring1: (_cross(ring[:, None], ring1[:, None], p[:, :, None]) >= -_EPS).all(axis=2)
    p, r, q, s = a[:, :, None], (a1 - a)[:, :, None], b[:, None], (b1 - b)[:, None]
    slope = r[..., 0] * s[..., 1] - r[..., 1] * s[..., 0]
    safe = np.where(np.abs(slope) > _EPS, slope, 1.0)
    d = q - p
    t, u = (d[..., 0] * s[..., 1] - d[..., 1] * s[..., 0]) / safe, (d[..., 0] * r[..., 1] - d[..., 1] * r[..., 0]) / safe
    meet = (np.abs(slope) > _EPS) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
    points = np.concatenate([a, b, (p + t[..., None] * r).reshape(len(a), -1, 2)], axis=1)
    there = np.concatenate([inside(a, b, b1), inside(b, a, a1), meet.reshape(len(a), -1)], axis=1)
    ring = _around(points, there)
    return np.where(there.sum(axis=1) > 2, area(ring), 0.0)


@F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in ("inter", "area_a", "area_b")]))
def _overlaps(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for left, right in batches:
        a, b = (hulls(np.array(x.tolist(), dtype=float).reshape(-1, 8)) for x in (left, right))
        yield pd.DataFrame({"inter": common_area(a, b), "area_a": area(a), "area_b": area(b)})


def _bounds(quad: str) -> dict[str, Column]:
    side = lambda k: F.filter(quad, lambda _, i: i % 2 == k)
    return {"x1": F.array_min(side(0)), "y1": F.array_min(side(1)), "x2": F.array_max(side(0)), "y2": F.array_max(side(1))}


def quad_overlaps(a: DataFrame, b: DataFrame, id_a: str, id_b: str) -> DataFrame:
    """image_id, both ids, inter, area_a, area_b, iou, iod (share of b) and rough (by rectangles) of quads that meet.

    quad is eight numbers x, y; its convex hull counts. Pairs come from the grid join of bounding
    rectangles; only those are clipped.
    """
    left = a.withColumns(_bounds("quad")).withColumnRenamed("quad", "qa").withColumn("__a", F.col(id_a))
    right = b.withColumns(_bounds("quad")).withColumnRenamed("quad", "qb").withColumn("__b", F.col(id_b))
    pairs = overlap_join(left, right, ("__a", "qa"), ("__b", "qb"))
    rough = (F.least("a_x2", "b_x2") - F.greatest("a_x1", "b_x1")) * (F.least("a_y2", "b_y2") - F.greatest("a_y1", "b_y1"))
    out = pairs.select("image_id", F.col("a___a").alias(id_a), F.col("b___b").alias(id_b), rough.alias("rough"), _overlaps("a_qa", "b_qb").alias("o"))
    out = out.select("image_id", id_a, id_b, "rough", "o.*").filter("inter > 0")
    share = lambda over: F.when(over > 0, F.col("inter") / over).otherwise(0.0)
    return out.withColumns({"iou": share(F.col("area_a") + F.col("area_b") - F.col("inter")), "iod": share(F.col("area_b"))})
