"""A watchdog over a certified guarantee: each batch is judged by the threshold that the last one left."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STEP, LEAST = 0.02, 30
SCHEMA = "batch long, n_denied long, n_legit_denied long, realised_fdr double, t_deny double, breached boolean, action string"


def batch_profile(scores: DataFrame, batch: str, p: str, y: str, start: float) -> DataFrame:
    """Counts per batch and threshold step from ``start`` on: all that the fold needs, whatever the batch size."""
    level = F.least(F.floor((F.col(p) - start) / STEP + 1e-9), F.lit(1000)).cast("int")
    return scores.groupBy(F.col(batch).cast("long").alias("batch"), F.when(F.col(p) >= start, level).otherwise(-1).alias("level")).agg(F.count("*").alias("n"), F.sum((F.col(y) == 0).cast("long")).alias("legit"))


def fold_watchdog(profile: pd.DataFrame, start: float, alpha: float) -> pd.DataFrame:
    rows, raised = [], 0
    for batch, part in profile.sort_values(["batch", "level"]).groupby("batch"):
        over = part[part["level"] >= raised]
        n, legit = int(over["n"].sum()), int(over["legit"].sum())
        t = min(1.0, round(start + STEP * raised, 10))
        fdr = legit / n if n >= LEAST else float("nan")
        breached = n >= LEAST and fdr > alpha
        rows.append((batch, n, legit, fdr, t, breached, "no action" if n < LEAST else "raise threshold" if breached else "ok"))
        raised += breached and t < 1.0
    return pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])


def watchdog(scores: DataFrame, batch: str, p: str, y: str, start: float = 0.9, alpha: float = 0.1) -> DataFrame:
    """One row for each batch, in order. A breach raises the threshold for the batches after it.

    Rows are summed to at most a few dozen counts a batch before the fold sees them.
    """
    profile = batch_profile(scores, batch, p, y, start).withColumn("_all", F.lit(0))
    return profile.groupBy("_all").applyInPandas(lambda pdf: fold_watchdog(pdf, start, alpha), SCHEMA)
