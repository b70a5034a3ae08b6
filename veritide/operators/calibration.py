"""Isotonic calibration, global and by group with shrinkage."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST, SHRINK = 20, 50.0


def pool(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[list[float], list[float]]:
    """Knots of the weighted isotonic fit of y on x (x distinct and ascending)."""
    blocks: list[list[float]] = []
    for a, b, c in zip(x, y, w, strict=True):
        blocks.append([b, c, a, a])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v, u, _, hi = blocks.pop()
            last = blocks[-1]
            last[0] = (last[0] * last[1] + v * u) / (last[1] + u)
            last[1] += u
            last[3] = hi
    xs, ys = [], []
    for v, _, lo, hi in blocks:
        xs += [lo] if lo == hi else [lo, hi]
        ys += [v] * (1 if lo == hi else 2)
    return [float(v) for v in xs], [float(v) for v in ys]


def fit_cells(rows: DataFrame, p: str, y: str, group: str, digits: int = 4) -> DataFrame:
    """(cell, n, xs, ys): one isotonic curve over all rows (cell null) and one for each group with enough rows of both classes.

    Scores are summed to ``digits`` decimals first, so a curve is fitted on a bounded number of points.
    """
    x = F.round(F.col(p), digits)
    cells = rows.select(x.alias("x"), F.col(y).cast("double").alias("y"), F.explode(F.array(F.lit(None).cast("string"), F.col(group))).alias("cell"))
    sums = cells.groupBy("cell", "x").agg(F.avg("y").alias("y"), F.count("*").cast("double").alias("w"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("x")
        n, pos = pdf["w"].sum(), (pdf["w"] * pdf["y"]).sum()
        cell = pdf["cell"].iloc[0]
        if cell is not None and (n < LEAST or pos <= 0 or pos >= n):
            return pd.DataFrame({"cell": [], "n": [], "xs": [], "ys": []})
        xs, ys = pool(pdf["x"].to_numpy(), pdf["y"].to_numpy(), pdf["w"].to_numpy())
        return pd.DataFrame({"cell": [cell], "n": [int(n)], "xs": [xs], "ys": [ys]})

    return sums.groupBy("cell").applyInPandas(fit, "cell string, n long, xs array<double>, ys array<double>")


def interpolate(xs: Column, ys: Column, x: Column) -> Column:
    """Piecewise linear through the knots, constant beyond them."""
    k = F.size(F.filter(xs, lambda v: v <= x))
    x0, x1, y0, y1 = F.get(xs, k - 1), F.get(xs, k), F.get(ys, k - 1), F.get(ys, k)
    inner = y0 + (y1 - y0) * (x - x0) / F.nullif(x1 - x0, F.lit(0.0))
    return F.when(k == 0, F.get(ys, F.lit(0))).when(k >= F.size(xs), F.element_at(ys, -1)).otherwise(inner)


def calibrate(rows: DataFrame, cells: DataFrame, p: str, group: str) -> DataFrame:
    """``rows`` with ``calibrated``: the group's curve blended with the global one by n / (n + 50); thin or unknown groups use the global one.

    The global curve is one row; the groups' are joined as Spark sees fit, since their number is not bounded.
    """
    whole = cells.where("cell is null").select(F.col("xs").alias("_gx"), F.col("ys").alias("_gy"))
    own = cells.where("cell is not null").select(F.col("cell").alias("_cell"), F.col("n").alias("_n"), "xs", "ys")
    out = rows.join(F.broadcast(whole), F.lit(True)).join(own, F.col(group) == F.col("_cell"), "left")
    x = F.col(p).cast("double")
    base = interpolate(F.col("_gx"), F.col("_gy"), x)
    w = F.col("_n") / (F.col("_n") + SHRINK)
    mixed = F.when(F.col("_cell").isNotNull(), w * interpolate(F.col("xs"), F.col("ys"), x) + (1 - w) * base).otherwise(base)
    return out.withColumn("calibrated", F.least(F.lit(1.0), F.greatest(F.lit(0.0), mixed))).select(*rows.columns, "calibrated")
