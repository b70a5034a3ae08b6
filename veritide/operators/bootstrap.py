"""Bootstrap intervals by Poisson weights, without resampled copies of the rows.

Rows that count alike are summed first; each sum draws Poisson(count) for every resample from a
generator that depends on nothing but the seed and what it stands for, so tasks may be repeated.
What reaches the driver is one vector of resamples for each range of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritide.functions.hashing import uniform
from veritide.operators.metrics import global_rank, ranged

RESAMPLES = 2_000


@dataclass(frozen=True)
class Interval:
    point: float
    low: float
    high: float
    resamples: int

    @property
    def width(self) -> float:
        return self.high - self.low

    def overlaps(self, other: Interval) -> bool:
        return self.low <= other.high and other.low <= self.high

    def as_dict(self) -> dict[str, float]:
        return {"point": self.point, "ci_lower": self.low, "ci_upper": self.high, "n_resamples": self.resamples}


def _interval(point: float, drawn: np.ndarray, level: float) -> Interval:
    low = (1 - level) / 2
    if not len(drawn):
        return Interval(point, float("nan"), float("nan"), 0)
    return Interval(point, float(np.quantile(drawn, low)), float(np.quantile(drawn, 1 - low)), len(drawn))


def _draws(seed: int, stands_for: int, counts: list[int], resamples: int) -> list[np.ndarray]:
    rng = np.random.Generator(np.random.Philox(key=np.array([stands_for & (1 << 64) - 1, seed], np.uint64)))
    return [rng.poisson(n, resamples).astype(float) if n else np.zeros(resamples) for n in counts]


def resampled_precision(rows: DataFrame, resamples: int, seed: int) -> tuple[float, np.ndarray]:
    """Average precision of rows(score, pos, neg, of) as they are, and of every resample (NaN where it has one class).

    Scores lie in written ranges. One pass sums each range for every resample, a second one reads the
    precision at every score with the sums of the ranges above it.
    """
    parts = ranged(rows, [F.desc("score")])

    def walk(table: pa.Table, above: np.ndarray | None) -> Iterator[np.ndarray]:
        order = np.argsort(-table["score"].to_numpy(), kind="stable")
        score, pos, neg, of = (table[c].to_numpy()[order] for c in ("score", "pos", "neg", "of"))
        tp, both = (np.zeros(resamples + 1), np.zeros(resamples + 1)) if above is None else (above[0].copy(), above[1].copy())
        here = np.zeros(resamples + 1)
        gained = np.zeros(resamples + 1)
        for i in range(len(score)):
            p, n = _draws(seed, int(of[i]), [int(pos[i]), int(neg[i])], resamples)
            here += np.concatenate([[pos[i]], p])
            both += np.concatenate([[pos[i] + neg[i]], p + n])
            if i + 1 == len(score) or score[i + 1] != score[i]:  # scores that tie are one step
                tp += here
                gained += here * np.divide(tp, both, out=np.zeros(resamples + 1), where=both > 0)
                here[:] = 0
        yield tp
        yield both
        yield gained

    def sums(table: pa.Table) -> pa.Table:
        tp, both, _ = walk(table, None)
        return pa.table({"part": pa.array([table["_part"][0].as_py()], pa.int32()), "tp": [tp.tolist()], "n": [both.tolist()]})

    got = sorted(parts.groupBy("_part").applyInArrow(sums, "part int, tp array<double>, n array<double>").collect(), key=lambda r: r.part)
    if not got:
        return float("nan"), np.zeros(0)
    tp, n = (np.array([r[c] for r in got]) for c in ("tp", "n"))
    sent = rows.sparkSession.sparkContext.broadcast({r.part: (tp[:i].sum(axis=0), n[:i].sum(axis=0)) for i, r in enumerate(got)})

    def precision(table: pa.Table) -> pa.Table:
        *_, gained = walk(table, sent.value[table["_part"][0].as_py()])
        return pa.table({"gained": [gained.tolist()]})

    gained = np.array([r.gained for r in parts.groupBy("_part").applyInArrow(precision, "gained array<double>").collect()]).sum(axis=0)
    positives, total = tp.sum(axis=0), n.sum(axis=0)
    ap = np.where((positives > 0) & (positives < total), gained / np.maximum(positives, 1e-300), np.nan)
    return float(ap[0]), ap[1:]


def ranking_interval(rows: DataFrame, score: str, y: str, resamples: int = RESAMPLES, seed: int = 5, level: float = 0.95, digits: int | None = None) -> Interval:
    """Average precision with its percentile interval. Rows of one score are one sum. Resamples of one class are left out."""
    s = F.col(score).cast("double") if digits is None else F.round(F.col(score).cast("double"), digits)
    by = rows.groupBy(s.alias("score")).agg(F.sum(F.col(y).cast("long")).alias("pos"), F.sum(1 - F.col(y).cast("long")).alias("neg")).withColumn("of", F.xxhash64("score"))
    point, drawn = resampled_precision(by, resamples, seed)
    return _interval(point, drawn[~np.isnan(drawn)], level)


def difference_interval(rows: DataFrame, a: str, b: str, y: str, key: str, resamples: int = RESAMPLES, seed: int = 5, level: float = 0.95) -> Interval:
    """Average precision of score ``a`` less that of ``b``, paired: a row has one weight in both of a resample's rankings."""
    one = lambda s: rows.select(F.col(s).cast("double").alias("score"), F.col(y).cast("long").alias("pos"), (1 - F.col(y)).cast("long").alias("neg"), F.xxhash64(key).alias("of"))
    (pa_, da), (pb, db) = resampled_precision(one(a), resamples, seed), resampled_precision(one(b), resamples, seed)
    both = da - db
    return _interval(pa_ - pb, both[~np.isnan(both)], level)


def mean_interval(rows: DataFrame, value: str, resamples: int = RESAMPLES, seed: int = 5, level: float = 0.95) -> Interval:
    """A mean with its percentile interval: equal values are one sum, and tasks give one vector of sums each."""
    by = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("x")).agg(F.count("*").alias("n")).withColumn("of", F.xxhash64("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, n = np.zeros(resamples + 1), np.zeros(resamples + 1)
        for batch in batches:
            for x, count, of in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                w = np.concatenate([[count], _draws(seed, of, [count], resamples)[0]])
                top, n = top + w * x, n + w
        yield pa.RecordBatch.from_pydict({"r": np.arange(resamples + 1, dtype=np.int32), "top": top, "n": n})

    got = by.mapInArrow(run, "r int, top double, n double").groupBy("r").agg(F.sum("top").alias("top"), F.sum("n").alias("n")).collect()
    means = {r.r: r.top / r.n for r in got if r.n}
    return _interval(means.pop(0, float("nan")), np.array([*means.values()]), level)


def bootstrap_ranking(rows: DataFrame, score: str, y: str, key: str, resamples: int = RESAMPLES, seed: int = 5, level: float = 0.95, digits: int | None = None) -> DataFrame:
    """One row: estimate, low, high and resamples of ``ranking_interval``."""
    x = ranking_interval(rows, score, y, resamples, seed, level, digits)
    return rows.sparkSession.createDataFrame([(x.point, x.low, x.high, x.resamples)], "estimate double, low double, high double, resamples long")


def bootstrap_means(rows: DataFrame, value: str, key: str, resamples: int = RESAMPLES, seed: int = 5, level: float = 0.95) -> DataFrame:
    """One row: estimate, n, low, high and resamples of ``mean_interval``."""
    x = mean_interval(rows, value, resamples, seed, level)
    point = rows.agg(F.count("*").alias("n"))
    return point.select(F.lit(x.low).alias("low"), F.lit(x.high).alias("high"), F.lit(x.resamples).alias("resamples"), F.lit(x.point).alias("estimate"), "n")


def overlaps(low_a: Column, high_a: Column, low_b: Column, high_b: Column) -> Column:
    return (low_a <= high_b) & (low_b <= high_a)


def shuffled_labels(rows: DataFrame, y: str, key: str, seed: int = 9) -> DataFrame:
    """``rows`` with the labels of other rows: ranks by two hashes of the key are matched up."""
    a = global_rank(rows.withColumn("_u", uniform(seed, F.col(key))), ["_u", key], "_at").drop("_u", y)
    b = global_rank(rows.select(F.col(key).alias("_k"), F.col(y).alias(y), uniform(seed + 1, F.col(key)).alias("_v")), ["_v", "_k"], "_at").select("_at", y)
    return a.join(b, "_at").drop("_at")


def noise_features(rows: DataFrame, features: list[str], key: str, seed: int = 11) -> DataFrame:
    """``rows`` with every feature replaced by standard normal noise from a hash of the key and the feature's name."""
    u, v = (lambda c, s: uniform(s, F.col(key), F.lit(c)), lambda c: F.lit(2 * np.pi) * uniform(seed + 1, F.col(key), F.lit(c)))
    return rows.withColumns({c: F.sqrt(-2.0 * F.log(1.0 - u(c, seed))) * F.cos(v(c)) for c in features})
