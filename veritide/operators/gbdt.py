"""Gradient-boosted trees by histograms that Spark sums: monotone constraints, and a learned side for missing values."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritide.operators.graph import written
from veritide.operators.metrics import global_rank

# Features whose direction of risk is known.
MONOTONE = {
    "reuse_n_distinct_claimants_sharing": 1, "reuse_n_matches": 1, "reuse_max_clip_similarity": 1, "reuse_best_hamming": -1, "ring_distinct_claimants": 1, "ring_is_first_seen": -1,
    "provenance_declares_ai_generation": 1, "provenance_declares_camera_capture": -1, "forensics_thumbnail_mismatch": 1, "behaviour_order_value_vs_prior_mean": 1, "behaviour_n_prior_claims_30d": 1,
}
SCHEMA_VERSION = "1"
#: Combinations of bins and labels up to which training rows are grouped by them.
GROUPS = 1 << 20


class SplitDisciplineError(ValueError):
    """Rows of another split in a training set."""


@dataclass
class Gbdt:
    """Trees as rows (feature, cut, missing goes left, left, right, value, rows); feature -1 is a leaf."""

    features: list[str]
    base: float
    trees: list[list[tuple]] = field(default_factory=list)
    gain: dict[str, float] = field(default_factory=dict)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for nodes in self.trees:
            at = np.zeros(len(x), int)
            table = np.array([[n[0], n[1], n[2], n[3], n[4], n[5]] for n in nodes], float)
            while True:
                f = table[at, 0].astype(int)
                open_ = f >= 0
                if not open_.any():
                    break
                v = x[np.arange(len(x)), np.maximum(f, 0)]
                left = np.where(np.isnan(v), table[at, 2] > 0, v <= table[at, 1])
                at = np.where(open_, np.where(left, table[at, 3], table[at, 4]).astype(int), at)
            out += table[at, 5]
        return out

    def predict(self, df: DataFrame, name: str = "p") -> DataFrame:
        sent = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("double")  # a session exists here
        def score(cols: pd.DataFrame) -> pd.Series:
            return pd.Series(1 / (1 + np.exp(-sent.value.margin(cols.to_numpy(float)))))

        return df.withColumn(name, score(F.struct(*[F.col(f).cast("double").alias(f) for f in self.features])))

    def expected(self) -> float:
        """The mean margin by the rows that each node saw in training."""
        return self.base + sum(_mean(nodes, 0) for nodes in self.trees)

    def attributions(self, x: np.ndarray) -> np.ndarray:
        """Exact Shapley values of rows [row, feature]: with ``expected`` they sum to the margins.

        A leaf is a product game: a feature on its path is met or not (o), and is met by a share z of
        the rows that reach its splits. Its value times (o - z), weighted over the sizes of coalitions
        by the coefficients of the product of (z + o t) over the path's other features, is the
        feature's part.
        """
        out = np.zeros((len(x), len(self.features)))
        for nodes in self.trees:
            for value, path in _leaves(nodes, x):
                d = len(path)
                for f, (met, share) in path.items():
                    poly = np.zeros((d, len(x)))
                    poly[0] = 1.0
                    for size, g in enumerate([g for g in path if g != f], 1):
                        o, z = path[g]
                        poly[1 : size + 1] = poly[1 : size + 1] * z + poly[:size] * o
                        poly[0] *= z
                    weight = np.array([math.factorial(k) * math.factorial(d - 1 - k) / math.factorial(d) for k in range(d)])
                    out[:, f] += value * (met - share) * (weight @ poly)
        return out

    def contributions(self, row: np.ndarray) -> np.ndarray:
        """The Shapley values of one row."""
        return self.attributions(row[None])[0]

    def explain(self, df: DataFrame, name: str = "shap") -> DataFrame:
        """``df`` with a map from each feature to its Shapley value."""
        sent = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("array<double>")
        def values(cols: pd.DataFrame) -> pd.Series:
            return pd.Series(list(sent.value.attributions(cols.to_numpy(float))))

        names = F.array(*map(F.lit, self.features))
        return df.withColumn(name, F.map_from_arrays(names, values(F.struct(*[F.col(f).cast("double").alias(f) for f in self.features]))))

    def to_json(self) -> str:
        return json.dumps({"schema": SCHEMA_VERSION, "features": self.features, "base": self.base, "trees": self.trees, "gain": self.gain})

    @staticmethod
    def from_json(text: str) -> Gbdt:
        got = json.loads(text)
        if got["schema"] != SCHEMA_VERSION:
            raise ValueError(f"the model has schema {got['schema']}, this code {SCHEMA_VERSION}")
        return Gbdt(got["features"], got["base"], [[tuple(n) for n in t] for t in got["trees"]], got["gain"])


def _mean(nodes: list[tuple], at: int) -> float:
    f, _, _, left, right, value, _ = nodes[at]
    if f < 0:
        return value
    a, b = nodes[left][6], nodes[right][6]
    return (a * _mean(nodes, left) + b * _mean(nodes, right)) / max(a + b, 1e-12)


def _leaves(nodes: list[tuple], x: np.ndarray) -> Iterator[tuple[float, dict[int, tuple[np.ndarray, float]]]]:
    """(value, {feature: (which rows meet its splits on the way, share of training rows that do)}) of every leaf."""
    todo: list[tuple[int, dict]] = [(0, {})]
    while todo:
        at, path = todo.pop()
        f, cut, missing, left, right, value, _ = nodes[at]
        if f < 0:
            yield value, path
            continue
        v = x[:, f]
        goes_left = np.where(np.isnan(v), bool(missing), v <= cut)
        total = max(nodes[left][6] + nodes[right][6], 1e-12)
        met, share = path.get(f, (np.ones(len(x)), 1.0))
        for child, goes in ((left, goes_left), (right, ~goes_left)):
            todo.append((child, path | {f: (met * goes, share * nodes[child][6] / total)}))


def check_split(rows: DataFrame, split: str = "split", only: str = "train") -> None:
    if not rows.where(F.col(split) != only).isEmpty():
        raise SplitDisciplineError(f"a training set may hold rows of {only} only")


def _edges(rows: DataFrame, features: list[str], bins: int) -> list[np.ndarray]:
    steps = [i / bins for i in range(1, bins)]
    finite = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    got = rows.agg(*[F.percentile_approx(finite(f), steps, 10_000).alias(f"e{i}") for i, f in enumerate(features)]).collect()[0]
    return [np.unique(got[i] or [0.0]) for i in range(len(features))]


def _last_of_bin(x: Column, edges: np.ndarray) -> Column:
    """The edge that closes the bin of a value: infinity after the last, NaN for missing values."""
    bin_ = sum(((x > float(e)).cast("int") for e in edges), F.lit(0))
    return F.when(x.isNull() | F.isnan(x), math.nan).otherwise(F.get(F.array(*[F.lit(float(e)) for e in edges], F.lit(math.inf)), bin_))


def fit_gbdt(rows: DataFrame, features: list[str], label: str, trees: int = 20, depth: int = 5, rate: float = 0.1, least: float = 20, bins: int = 32, monotone: dict[str, int] | None = None, shrink: float = 1.0, leaves: int = 31, margins_every: int = 5) -> Gbdt:
    """Boosted trees on the logistic loss, of at most ``leaves`` leaves, the largest gains of a level first.

    In every level of every tree one job sums gradients by (node, feature, bin): what reaches the driver
    is bounded by nodes x features x bins, whatever the number of rows. Margins are written with the
    rows every few trees, so a job walks the trees since then and not all.
    """
    monotone = MONOTONE if monotone is None else monotone
    spark = rows.sparkSession
    edges = _edges(rows, features, bins)
    rate_ = rows.agg(F.avg(F.col(label).cast("double"))).collect()[0][0]
    if not rate_ or rate_ >= 1:
        raise ValueError("training needs rows of both classes")
    model = Gbdt(features, math.log(rate_ / (1 - rate_)))
    d = len(features)
    names = [f"x{i}" for i in range(d)]
    data = rows.select(*[F.col(f).cast("double").alias(x) for f, x in zip(features, names, strict=True)], F.col(label).cast("double").alias("y"))
    if 2 * math.prod(len(e) + 2 for e in edges) <= GROUPS:
        # Cuts are edges, so rows of the same bins and label go the same ways: one row stands for them, by the last value of each bin.
        data = data.select(*[_last_of_bin(F.col(x), e).alias(x) for x, e in zip(names, edges, strict=True)], "y").groupBy(*names, "y").agg(F.count("*").cast("double").alias("n"))
    else:
        data = data.withColumn("n", F.lit(1.0))
    data = written(data.withColumn("m", F.lit(model.base)), "boosting")
    since = 0

    def place(tree: np.ndarray, x: np.ndarray, levels: int) -> np.ndarray:
        at = np.zeros(len(x), int)
        for _ in range(levels):
            f = tree[at, 0].astype(int)
            v = x[np.arange(len(x)), np.maximum(f, 0)]
            left = np.where(np.isnan(v), tree[at, 2] > 0, v <= tree[at, 1])
            at = np.where(f >= 0, np.where(left, tree[at, 3], tree[at, 4]).astype(int), at)
        return at

    for number in range(trees):
        nodes: list[list] = [[-1, 0.0, True, -1, -1, 0.0, 0.0, -math.inf, math.inf]]
        frontier = [0]
        if number - since >= margins_every:
            recent = spark.sparkContext.broadcast(Gbdt(features, 0.0, model.trees[since:]))

            def move(batches):
                for pdf in batches:
                    yield pdf.assign(m=pdf["m"] + recent.value.margin(pdf[names].to_numpy(float)))

            data, since = written(data.mapInPandas(move, data.schema), "boosting"), number
        for level in range(depth + 1):
            sent = spark.sparkContext.broadcast((Gbdt(features, 0.0, model.trees[since:]), np.array([[*n[:6]] for n in nodes], float), edges))

            def sums(batches):
                known, tree, cuts = sent.value
                width = max(len(e) for e in cuts) + 2
                total = np.zeros((len(tree), d, width, 3))
                for pdf in batches:
                    x, y, n = pdf[names].to_numpy(float), pdf["y"].to_numpy(), pdf["n"].to_numpy()
                    p = 1 / (1 + np.exp(-(pdf["m"].to_numpy() + known.margin(x))))
                    g, h = (y - p) * n, p * (1 - p) * n
                    at = place(tree, x, level)
                    for j in range(d):
                        b = np.where(np.isnan(x[:, j]), width - 1, np.searchsorted(cuts[j], x[:, j], side="left"))
                        flat = at * width + b
                        for k, w in enumerate((g, h, n)):
                            total[:, j, :, k] += np.bincount(flat, w, len(tree) * width).reshape(len(tree), width)
                i, j, b = np.nonzero(total[..., 2])
                yield pd.DataFrame({"i": i, "j": j, "b": b, "g": total[i, j, b, 0], "h": total[i, j, b, 1], "n": total[i, j, b, 2]})

            got = data.mapInPandas(sums, "i int, j int, b int, g double, h double, n double").groupBy("i", "j", "b").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).toPandas()
            width = max(len(e) for e in edges) + 2
            total = np.zeros((len(nodes), d, width, 3))
            total[got["i"], got["j"], got["b"]] = got[["g", "h", "n"]].to_numpy()
            found = []
            for i in frontier:
                g, h, n = total[i, 0].sum(0)
                lo, hi = nodes[i][7], nodes[i][8]
                nodes[i][5], nodes[i][6] = float(np.clip(rate * g / (h + shrink), lo, hi)), float(n)
                if level == depth:
                    continue
                best = (1e-6, None)
                for j in range(d):
                    missing = total[i, j, width - 1]
                    run = np.cumsum(total[i, j, : len(edges[j]) + 1], axis=0)
                    for c in range(len(edges[j])):
                        for to_left in (True, False):
                            a = run[c] + (missing if to_left else 0)
                            b = np.array([g, h, n]) - a
                            if a[2] < least or b[2] < least:
                                continue
                            va, vb = (float(np.clip(rate * s[0] / (s[1] + shrink), lo, hi)) for s in (a, b))
                            side = monotone.get(features[j], 0)
                            if side and (vb - va) * side < 0:
                                continue
                            gain = a[0] ** 2 / (a[1] + shrink) + b[0] ** 2 / (b[1] + shrink) - g**2 / (h + shrink)
                            if gain > best[0]:
                                best = (gain, (j, float(edges[j][c]), to_left, va, vb, side))
                if best[1]:
                    found.append((best[0], i, best[1]))
            room = leaves - sum(n[0] < 0 for n in nodes)
            frontier = []
            for gain, i, (j, cut, to_left, va, vb, side) in sorted(found, key=lambda f: (-f[0], f[1]))[: max(0, room)]:
                lo, hi = nodes[i][7], nodes[i][8]
                mid = (va + vb) / 2
                bounds = [[lo, hi], [lo, hi]]
                if side > 0:
                    bounds = [[lo, mid], [mid, hi]]
                elif side < 0:
                    bounds = [[mid, hi], [lo, mid]]
                left = len(nodes)
                nodes[i][:5] = [j, cut, to_left, left, left + 1]
                nodes += [[-1, 0.0, True, -1, -1, v, 0.0, *b] for v, b in zip((va, vb), bounds, strict=True)]
                model.gain[features[j]] = model.gain.get(features[j], 0.0) + float(gain)
                frontier += [left, left + 1]
            if not frontier:
                break
        model.trees.append([tuple(n[:7]) for n in nodes])
    return model


def gain_by_prefix(model: Gbdt) -> dict[str, float]:
    out: dict[str, float] = {}
    for name, gain in model.gain.items():
        out[name.split("_")[0]] = out.get(name.split("_")[0], 0.0) + gain
    return out


def cross_fit(rows: DataFrame, features: list[str], label: str, key: str, folds: int = 5, **options) -> DataFrame:
    """Out-of-fold scores: each row is scored by a model that did not see its fold.

    Folds are stratified: rows of a class are ranked by a hash of their key and dealt in turn.
    """
    from veritide.functions.hashing import uniform

    ranked = global_rank(rows.withColumn("_u", uniform(3, F.col(key))), [label, "_u", key], "_at")
    placed = written(ranked.withColumn("_fold", F.pmod("_at", F.lit(folds)).cast("int")).drop("_u", "_at"), "folds")
    out = None
    for k in range(folds):
        part = fit_gbdt(placed.where(F.col("_fold") != k), features, label, **options).predict(placed.where(F.col("_fold") == k), "oof")
        out = part if out is None else out.unionByName(part)
    return out.drop("_fold")


def blank(df: DataFrame, prefix: str) -> DataFrame:
    """Columns of a family set to NaN, the schema kept: for ablations."""
    return df.withColumns({c: F.lit(float("nan")) for c in df.columns if c.startswith(prefix)})


def rules_score(triggers: list[Column]) -> Column:
    return sum((t.cast("double") for t in triggers), F.lit(0.0)) / len(triggers)
