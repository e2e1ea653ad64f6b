"""Merges whose result depends on the order of taking; each runs over one bounded group (a page) at a time."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _iou(a: np.ndarray, b: np.ndarray) -> float:
    w = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
    h = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    return w * h / (a[2] * a[3] + b[2] * b[3] - w * h)


def merge_boxes(pdf: pd.DataFrame, least: float = 0.35, gain: float = 0.04, cap: float = 0.995) -> pd.DataFrame:
    """Boxes of a page, the surest first; one that overlaps a kept box raises its confidence and goes."""
    rows = pdf.sort_values(["confidence", "ord"], ascending=[False, True])
    boxes = rows[["x", "y", "width", "height"]].to_numpy(float)
    kept: list[int] = []
    sure = rows["confidence"].to_numpy(float).copy()
    merged = np.ones(len(rows), int)
    for i in range(len(rows)):
        j = next((k for k in kept if _iou(boxes[k], boxes[i]) >= least), None)
        if j is None:
            kept.append(i)
        else:
            sure[j] = min(cap, sure[j] + gain)
            merged[j] += 1
    out = rows.iloc[kept].copy()
    out["confidence"], out["merged"] = sure[kept], merged[kept]
    return out


def distinct_faces(pdf: pd.DataFrame, least: float = 0.30, near: float = 0.35) -> pd.DataFrame:
    """Face boxes of a page, the surest first, without those that overlap a kept one or lie on its centre."""
    rows = pdf.sort_values(["confidence", "ord"], ascending=[False, True])
    boxes = rows[["x", "y", "width", "height"]].to_numpy(float)
    kept: list[int] = []
    for i, b in enumerate(boxes):
        centre = b[:2] + b[2:] / 2
        same = any(_iou(boxes[k], b) >= least or math.dist(boxes[k][:2] + boxes[k][2:] / 2, centre) <= near * max(boxes[k][2:].max(), b[2:].max()) for k in kept)
        if not same:
            kept.append(i)
    return rows.iloc[kept]


def distinct_peaks(pdf: pd.DataFrame, apart: float = 20, most: int = 12) -> pd.DataFrame:
    """The strongest peaks that stand apart from each other."""
    rows = pdf.sort_values(["strength", "ord"], ascending=[False, True])
    points = rows[["x", "y"]].to_numpy(float)
    kept: list[int] = []
    for i, p in enumerate(points):
        if len(kept) == most:
            break
        if all(math.dist(points[k], p) >= apart for k in kept):
            kept.append(i)
    return rows.iloc[kept]


def orientation_families(pdf: pd.DataFrame, within: float = 12) -> pd.DataFrame:
    """Angles (degrees, a half turn is none) joined to the first family whose seed is near; adds ``family``."""
    rows = pdf.sort_values("ord")
    seeds: list[float] = []
    family = []
    for angle in rows["angle"].to_numpy(float):
        gap = [min(abs(angle - s) % 180, 180 - abs(angle - s) % 180) for s in seeds]
        near = next((k for k, g in enumerate(gap) if g <= within), None)
        if near is None:
            seeds.append(angle)
            near = len(seeds) - 1
        family.append(near)
    return rows.assign(family=family)


def text_lines(pdf: pd.DataFrame, share: float = 0.6) -> pd.DataFrame:
    """Components grouped to lines, by their centres downwards: one joins the line before it if its centre is within ``share`` of the median height of that line's mean; adds ``line``."""
    rows = pdf.assign(_c=pdf["y"] + pdf["height"] / 2).sort_values(["_c", "ord"])
    near = max(float(rows["height"].median()) * share, 1.0)
    line, at, mean, n = [], 0, 0.0, 0
    for centre in rows["_c"].to_numpy(float):
        if n and abs(centre - mean) > near:
            at, mean, n = at + 1, 0.0, 0
        mean, n = (mean * n + centre) / (n + 1), n + 1
        line.append(at)
    return rows.drop(columns="_c").assign(line=line)


def by_group(rows: DataFrame, keys: list[str], merge, added: str = "", alone: Column | None = None) -> DataFrame:
    """One of the merges above over each group of ``keys``.

    ``added`` names its new column with its type, ``alone`` is that column's
    value where a row is alone in its group: such rows, mostly the most, never
    leave the JVM.
    """
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), *([added] if added else [])])
    counted = rows.withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    merged = counted.where("_n > 1").drop("_n").groupBy(*keys).applyInPandas(lambda pdf: merge(pdf), schema)
    single = counted.where("_n = 1").drop("_n")
    if added:
        name, kind = added.split()
        single = single.withColumn(name, alone.cast(kind))
    return single.unionByName(merged)
