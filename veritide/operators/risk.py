"""Finite-sample certification of denial thresholds."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The ladder of (alpha, delta) rungs, the least number of denials, the planning rate.
LADDER = [(0.03, 0.10), (0.05, 0.10), (0.10, 0.10), (0.10, 0.20)]
MIN_DENIED, PLANNING = 30, 0.3


def kl_bernoulli(p: float, q: float) -> float:
    p, q = (min(max(x, 1e-12), 1 - 1e-12) for x in (p, q))
    return p * math.log(p / q) + (1 - p) * math.log((1 - p) / (1 - q))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction: work grows with the root of a + b."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1.0 / (1 - (a + b) * x / (a + 1) or tiny)
    out, m = d, 1
    while True:
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / (1 + step * d or tiny)
            c = 1 + step / c or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15 or m > 10_000_000:
            return front * out
        m += 1


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(at most k successes in n trials), without a sum over k terms."""
    return 1.0 if k >= n else incomplete_beta(n - k, k + 1, 1 - p) if k >= 0 else 0.0


def hb_p_value(rate: float, n: int, alpha: float) -> float:
    """Hoeffding-Bentkus p-value of "the true rate exceeds alpha" from ``n`` trials."""
    if n <= 0 or not 0 < alpha < 1 or not 0 <= rate <= 1:
        raise ValueError("needs n > 0, 0 < alpha < 1 and a rate in [0, 1]")
    if rate >= alpha:
        return 1.0
    return min(1.0, math.exp(-n * kl_bernoulli(rate, alpha)), math.e * binomial_cdf(math.ceil(n * rate), n, alpha))


@F.pandas_udf(T.DoubleType())
def hb_pvalue(rate: pd.Series, n: pd.Series, alpha: pd.Series) -> pd.Series:
    return pd.Series([hb_p_value(r, int(k), a) if k > 0 else 1.0 for r, k, a in zip(rate, n, alpha, strict=True)])


def min_n_zero_errors(alpha: float, delta: float, floor: int = MIN_DENIED) -> int:
    return max(math.ceil(math.log(delta) / math.log(1 - alpha)), floor)


def min_n_for_rate(alpha: float, delta: float, rate: float, floor: int = MIN_DENIED, most: int = 2_000_000) -> int | None:
    """The least n from which on every n certifies; None if the rate is not below alpha or no n up to ``most`` certifies.

    The p-value is not monotone in n, but its exponential bound is: beyond the n where that bound
    meets delta everything certifies, so only what lies below it is looked at, from the top.
    """
    if rate >= alpha:
        return None
    if rate <= 0:
        return min_n_zero_errors(alpha, delta, floor)
    n = min(math.ceil(math.log(1 / delta) / kl_bernoulli(rate, alpha)), most)
    if hb_p_value(rate, n, alpha) > delta:
        return None
    while n > floor and hb_p_value(rate, n - 1, alpha) <= delta:
        n -= 1
    return max(n, floor)


def power_curve(spark: SparkSession, alphas: list[float], fractions: list[float], delta: float = 0.10) -> DataFrame:
    rows = [(a, f, min_n_for_rate(a, delta, f * a)) for a in alphas for f in fractions]
    return spark.createDataFrame(rows, "alpha double, fraction double, min_denied int")


def corpus_sizes(spark: SparkSession, ladder: list[tuple[float, float]] = LADDER, practical: int | None = None, fraction: float = PLANNING, deny_rate: float = 0.08, test_share: float = 0.20, floor: int = MIN_DENIED) -> DataFrame:
    """One row for each rung tried: the denials, test claims and claims in all that certifying at it takes (null if out of reach).

    With ``practical`` rungs are tried in order up to the first that needs no more claims than that
    (``chosen``); if none does, the last one is chosen.
    """
    rows: list[list] = []
    for rung, (alpha, delta) in enumerate(ladder):
        n = min_n_for_rate(alpha, delta, fraction * alpha, floor)
        test = math.ceil(n / deny_rate) if n else None
        whole = math.ceil(test / test_share) if test else None
        rows.append([rung, alpha, delta, fraction * alpha, n, deny_rate, test_share, test, whole, False])
        if practical is not None and whole is not None and whole <= practical:
            break
    if practical is not None and rows:
        rows[-1][-1] = True
    return spark.createDataFrame([tuple(r) for r in rows], "rung int, alpha double, delta double, rate double, min_denied int, deny_rate double, test_share double, test_claims long, all_claims long, chosen boolean")


def power_report(spark: SparkSession, practical: int = 35_000) -> dict:
    """What a certificate would take: the power curve, each rung's sizes and the first practical rung."""
    curve = power_curve(spark, [0.03, 0.05, 0.10, 0.15, 0.20], [0.0, 0.3, 0.5])
    sizes = [r.asDict() for r in corpus_sizes(spark).collect()]
    chosen = corpus_sizes(spark, practical=practical).where("chosen").collect()
    return {"power_curve": [r.asDict() for r in curve.collect()], "sizes": sizes, "practical": practical, "primary": chosen[0].asDict() if chosen else None}


def threshold_counts(scores: DataFrame, p: str, y: str, grid: list[float]) -> DataFrame:
    """Denials and legitimate denials at every threshold: scores fall into grid buckets once, and sums run down the grid."""
    cut = F.size(F.filter(F.array(*map(F.lit, grid)), lambda t: t <= F.col(p)))
    by = scores.groupBy(cut.alias("k")).agg(F.count("*").alias("c"), F.sum((F.col(y) == 0).cast("long")).alias("legit"))
    table = scores.sparkSession.createDataFrame([(i + 1, t) for i, t in enumerate(grid)], "k int, threshold double")
    total = by.agg(F.sum("c").alias("n_total"))
    down = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    filled = table.join(by, "k", "left").select("threshold", F.sum(F.coalesce("c", F.lit(0))).over(down).alias("n_denied"), F.sum(F.coalesce("legit", F.lit(0))).over(down).alias("n_legit_denied"))
    return filled.join(F.broadcast(total), F.lit(True))


def certify_thresholds(scores: DataFrame, p: str, y: str, alpha: float, delta: float, grid: list[float] | None = None, floor: int | None = None) -> DataFrame:
    """Fixed-sequence testing from the largest threshold down.

    Thresholds with too few denials are passed over; the first tested failure ends the sequence
    and later thresholds get no row.
    """
    grid = grid or [round(i / 100, 4) for i in range(50, 100)]
    floor = floor if floor is not None else max(MIN_DENIED, min_n_for_rate(alpha, delta, PLANNING * alpha) or MIN_DENIED)
    counts = threshold_counts(scores, p, y, grid)
    skip = F.col("n_denied") < floor
    rate = F.col("n_legit_denied") / F.greatest("n_denied", F.lit(1))
    tested = counts.withColumns({"skipped": skip, "rate": rate, "unconditional_rate": F.col("n_legit_denied") / F.greatest("n_total", F.lit(1))})
    tested = tested.withColumn("p_value", F.when(skip, F.lit(None)).otherwise(hb_pvalue("rate", "n_denied", F.lit(alpha))))
    tested = tested.withColumn("unconditional_p_value", F.when(skip, F.lit(None)).otherwise(hb_pvalue("unconditional_rate", "n_total", F.lit(alpha))))
    passed = F.coalesce(F.col("p_value") <= delta, F.lit(False))
    before = Window.orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, -1)
    failed = F.coalesce(F.sum(F.when(~skip & ~passed, 1).otherwise(0)).over(before), F.lit(0))
    return tested.withColumns({"_failed": failed, "certified": passed}).where("_failed = 0").drop("_failed")


def walk_ladder(scores: DataFrame, p: str, y: str, ladder: list[tuple[float, float]] = LADDER, grid: list[float] | None = None) -> DataFrame:
    """Attempts up to and including the first rung that certifies something, one row for each threshold tested."""
    out = None
    for rung, (alpha, delta) in enumerate(ladder):
        got = certify_thresholds(scores, p, y, alpha, delta, grid).withColumns({"rung": F.lit(rung), "alpha": F.lit(alpha), "delta": F.lit(delta)})
        out = got if out is None else out.unionByName(got)
    won = out.where("certified").agg(F.min("rung").alias("won"))
    return out.join(F.broadcast(won), F.lit(True)).where("won is null or rung <= won").drop("won")


def least_conservative(certified: DataFrame) -> DataFrame:
    """The row of the smallest certified threshold of ``certify_thresholds``; no row if nothing is certified."""
    return certified.where("certified").orderBy("threshold").limit(1)


def describe_certified(certified: DataFrame, alpha: float, delta: float) -> str:
    """One sentence about a set of certified thresholds, whose rows are as many as the grid has."""
    rows = certified.where("certified").orderBy("threshold").collect()
    if not rows:
        return f"no threshold is certified at alpha {alpha:g} and delta {delta:g}"
    best = rows[0]
    return f"{len(rows)} thresholds are certified at alpha {alpha:g} and delta {delta:g}; the least conservative, {best.threshold:.4f}, denies {best.n_denied} claims, {best.rate:.4f} of them legitimate (p = {best.p_value:.4f})"


def calibration_seal(rows: DataFrame, claim: str, label: str, sha: str) -> DataFrame:
    """Order-independent digest of a split, with its row and fraud counts.

    The digest is of all lines in order, so one task reads the sorted ranges one after the other, a
    batch at a time; no list of lines is ever held.
    """
    line = F.concat_ws("\t", F.col(claim), F.col(label).cast("string"), F.col(sha))
    ordered = rows.select(line.alias("line"), F.col(label).cast("long").alias("y")).orderBy("line").coalesce(1)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, n, fraud = hashlib.sha256(), 0, 0
        for batch in batches:
            lines = batch.column(0).to_pylist()
            h.update("".join(x + "\n" for x in lines).encode())
            n, fraud = n + len(lines), fraud + sum(y for y in batch.column(1).to_pylist() if y == 1)
        yield pa.RecordBatch.from_pydict({"content_sha256": [h.hexdigest()], "n_claims": [n], "n_fraud": [fraud]})

    return ordered.mapInArrow(digest, "content_sha256 string, n_claims long, n_fraud long")


def frozen_certificate(scores: DataFrame, p: str, y: str, threshold: float, alpha: float, condition: str | None = None) -> DataFrame:
    """Realised rate of legitimate denials at a frozen threshold, for each condition; with no denial the rate is 0 and holds."""
    keys = [condition] if condition else []
    denied = (F.col(p) >= threshold).cast("long")
    wrong = F.when((F.col(p) >= threshold) & (F.col(y) == 0), 1).otherwise(0)
    out = scores.groupBy(*keys).agg(F.sum(denied).alias("n_denied"), F.sum(wrong).alias("n_legit_denied"))
    rate = F.coalesce(F.col("n_legit_denied") / F.nullif(F.col("n_denied"), F.lit(0)), F.lit(0.0))
    return out.withColumn("realised_fdr", rate).withColumn("holds", rate <= alpha)


def shift_matrix(scores: DataFrame, p: str, y: str, condition: str, threshold: float, alpha: float, delta: float) -> DataFrame:
    """For each condition: does the frozen threshold hold, and if not, would certifying again there help?

    Counts at all thresholds come from one pass; only counts reach the p-values.
    """
    grid = [round(i / 100, 4) for i in range(50, 100)]
    frozen = frozen_certificate(scores, p, y, threshold, alpha, condition)
    cut = F.size(F.filter(F.array(*map(F.lit, grid)), lambda t: t <= F.col(p)))
    by = scores.groupBy(condition, cut.alias("_k")).agg(F.count("*").alias("_c"), F.sum((F.col(y) == 0).cast("long")).alias("_l"))
    down = Window.partitionBy(condition).orderBy(F.desc("_k")).rowsBetween(Window.unboundedPreceding, 0)
    sums = by.where("_k > 0").withColumns({"_n": F.sum("_c").over(down), "_bad": F.sum("_l").over(down)})
    floor = max(MIN_DENIED, min_n_for_rate(alpha, delta, PLANNING * alpha) or MIN_DENIED)
    tested = sums.where(F.col("_n") >= floor).withColumn("_ok", hb_pvalue(F.col("_bad") / F.col("_n"), F.col("_n"), F.lit(alpha)) <= delta)
    again = tested.withColumn("_run", F.min(F.col("_ok").cast("int")).over(down)).groupBy(condition).agg((F.max("_run") == 1).alias("recertified"))
    out = frozen.join(again, condition, "left").withColumn("recertified", F.coalesce("recertified", F.lit(False)))
    return out.withColumn("recoverable", ~F.col("holds") & F.col("recertified"))


def shift_report(matrix: DataFrame, condition: str = "condition") -> str:
    """A table in Markdown of ``shift_matrix`` with counts of conditions that hold, and that could be certified again."""
    rows = matrix.orderBy(condition).collect()  # one row for each condition
    lines = ["| condition | denied | realised rate | holds | recoverable |", "|---|---|---|---|---|"]
    lines += [f"| {r[condition]} | {r.n_denied} | {r.realised_fdr:.4f} | {'yes' if r.holds else 'no'} | {'yes' if r.recoverable else 'no'} |" for r in rows]
    return "\n".join([*lines, f"{sum(r.holds for r in rows)} of {len(rows)} conditions hold, {sum(r.recoverable for r in rows)} could be certified again"])
