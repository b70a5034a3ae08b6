"""What a model has to beat: constants, a rules engine, and linear probes on one family of features."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritide.operators.gbdt import rules_score


def known(column: str) -> Column:
    """A feature with 0 for what was not computed."""
    x = F.col(column).cast("double")
    return F.coalesce(F.when(~F.isnan(x), x), F.lit(0.0))


def rules_engine(prior: int = 2, prior_30d: int = 1, ratio: float = 3.0) -> Column:
    """The share of four hand-made triggers that fire: counts, a burst, a jump in value, a match."""
    return rules_score([
        known("behaviour_n_prior_claims") > prior, known("behaviour_n_prior_claims_30d") > prior_30d,
        known("behaviour_order_value_vs_prior_mean") > ratio, known("reuse_matched_prior_claim") > 0,
    ])


RULE_FEATURES = ["behaviour_n_prior_claims", "behaviour_n_prior_claims_30d", "behaviour_order_value_vs_prior_mean", "reuse_matched_prior_claim"]


def rules_of(rows: DataFrame) -> Column:
    """``rules_engine``, if ``rows`` has its features."""
    if missing := [c for c in RULE_FEATURES if c not in rows.columns]:
        raise ValueError(f"the rules need {missing}")
    return rules_engine()


@dataclass(frozen=True)
class Probe:
    """A logistic regression: coefficients by feature, and an intercept."""

    columns: list[str]
    weights: list[float]
    intercept: float

    def score(self) -> Column:
        z = F.lit(self.intercept)
        for c, w in zip(self.columns, self.weights, strict=True):
            z = z + F.lit(w) * known(c)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def fit_probe(rows: DataFrame, prefix: str, label: str = "label", penalty: float = 1.0, rounds: int = 50) -> Probe:
    """Logistic regression with half the squared weights times ``penalty`` added to the summed loss, by Newton steps.

    A step sums a gradient and a matrix of the features' number in every task; only these sums come to the driver.
    """
    columns = [c for c in rows.columns if c.startswith(prefix)]
    if not columns:
        raise ValueError(f"no features that begin with {prefix!r}")
    data = rows.select(*[known(c).alias(f"x{i}") for i, c in enumerate(columns)], F.col(label).cast("double").alias("y"))
    d = len(columns) + 1
    scale = data.agg(*[F.greatest(F.max(F.abs(f"x{i}")), F.lit(1e-12)) for i in range(d - 1)]).collect()[0]
    unit = np.array([1.0, *[float(v) if v and v > 1e-12 else 1.0 for v in scale]])  # for the solver only: the penalty is on the features as they are
    beta, shrink = np.zeros(d), np.array([0.0, *[penalty] * (d - 1)]) / unit**2

    def loss(b: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, grad, hess = 0.0, np.zeros(d), np.zeros((d, d))
            for pdf in batches:
                x = np.column_stack([np.ones(len(pdf)), pdf.iloc[:, : d - 1].to_numpy(float)]) / unit
                z, y = x @ b, pdf["y"].to_numpy()
                p = 1 / (1 + np.exp(-z))
                total += float((np.logaddexp(0, z) - y * z).sum())
                grad += x.T @ (p - y)
                hess += (x * (p * (1 - p))[:, None]).T @ x
            yield pd.DataFrame({"loss": [total], "grad": [grad.tolist()], "hess": [hess.ravel().tolist()]})

        got = data.mapInPandas(part, "loss double, grad array<double>, hess array<double>").collect()  # one row a task
        grad, hess = sum(np.array(r.grad) for r in got), sum(np.array(r.hess).reshape(d, d) for r in got)
        return sum(r.loss for r in got) + float((shrink * b * b).sum()) / 2, grad + shrink * b, hess + np.diag(shrink + 1e-10)

    value, grad, hess = loss(beta)
    for _ in range(rounds):
        step, size = np.linalg.solve(hess, grad), 1.0
        while size > 1e-6 and (new := loss(beta - size * step))[0] > value + 1e-12:
            size /= 2
        beta, (value, grad, hess) = beta - size * step, new
        if np.abs(step).max() < 1e-9 or np.abs(grad).max() < 1e-9:
            break
    return Probe(columns, (beta[1:] / unit[1:]).tolist(), float(beta[0]))


#: The standard set, in the order of reports: name, what it is, and how it scores after fitting on rows with ``label``.
BASELINES: list[tuple[str, str, Callable[[DataFrame], Column]]] = [
    ("approve_all", "constant score 0", lambda rows: F.lit(0.0)),
    ("deny_all", "constant score 1", lambda rows: F.lit(1.0)),
    ("rules_engine", "thresholds on counts and values, set by hand", rules_of),
    ("clip_probe", "linear probe on reuse features", lambda rows: fit_probe(rows, "reuse_").score()),
    ("resnet_style_pixel_probe", "linear probe on forensic features", lambda rows: fit_probe(rows, "forensics_").score()),
    ("behaviour_only_gbm", "linear probe on behaviour features", lambda rows: fit_probe(rows, "behaviour_").score()),
]
