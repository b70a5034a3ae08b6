"""The fusion model: a schema with constraints, cross-fitted scores, a calibrator fitted on them, and a model of all rows."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritide.operators.calibration import SHRINK, calibrate, fit_cells
from veritide.operators.gbdt import MONOTONE, Gbdt, check_split, cross_fit, fit_gbdt
from veritide.operators.graph import written
from veritide.operators.metrics import brier_score
from veritide.sources.corpus import write_json

SCHEMA_VERSION = "1"
#: Why each constrained feature has its direction: a table of metadata.
RATIONALE = {
    "reuse_n_distinct_claimants_sharing": "several claimants with one image are what a ring is",
    "reuse_n_matches": "an image seen more often is likelier recycled",
    "reuse_max_clip_similarity": "likeness to earlier evidence speaks for reuse only",
    "reuse_best_hamming": "distance from all earlier evidence speaks against reuse",
    "ring_distinct_claimants": "more people around one image are stronger evidence",
    "ring_is_first_seen": "whoever shows an image first must not be blamed for copies of it",
    "provenance_declares_ai_generation": "a signed statement of synthesis",
    "provenance_declares_camera_capture": "a signed statement of capture",
    "forensics_thumbnail_mismatch": "a stale thumbnail shows later editing",
    "behaviour_order_value_vs_prior_mean": "claims far above the own history are escalation",
    "behaviour_n_prior_claims_30d": "a burst of claims",
}


class ModelNotTrainedError(FileNotFoundError):
    """A tier without a stored model."""


def validate_schema(features: list[str], monotone: dict[str, int] = MONOTONE) -> None:
    """A constraint on a feature that does not exist would silently be lost, so it is an error."""
    if unknown := sorted(set(monotone) - set(features)):
        raise ValueError(f"constraints on unknown features: {unknown}")


def constraint_table(spark: SparkSession, features: list[str], monotone: dict[str, int] = MONOTONE) -> DataFrame:
    """(place, name, direction, rationale) of every feature in the model's order."""
    rows = [(i, f, monotone.get(f, 0), RATIONALE.get(f, "")) for i, f in enumerate(features)]
    return spark.createDataFrame(rows, "place int, name string, direction int, rationale string")


def aligned(rows: DataFrame, features: list[str]) -> list[str]:
    """The features, if ``rows`` has them all; constraints go by name, so their order in ``rows`` does not matter."""
    if missing := [f for f in features if f not in rows.columns]:
        raise ValueError(f"missing features: {missing}")
    return features


@dataclass(frozen=True)
class FusionConfig:
    """Fixed values of production: trees, leaves, rate, least rows of a leaf, folds."""

    trees: int = 300
    leaves: int = 31
    depth: int = 5
    rate: float = 0.05
    least: int = 20
    folds: int = 5
    constrained: bool = True

    def options(self, monotone: dict[str, int]) -> dict:
        return {"trees": self.trees, "leaves": self.leaves, "depth": self.depth, "rate": self.rate, "least": self.least, "monotone": monotone if self.constrained else {}}


@dataclass
class FusionModel:
    features: list[str]
    model: Gbdt
    cells: DataFrame
    oof: DataFrame
    report: dict = field(default_factory=dict)

    def predict_uncalibrated(self, rows: DataFrame, name: str = "p") -> DataFrame:
        aligned(rows, self.features)
        return self.model.predict(rows, name)

    def predict(self, rows: DataFrame, group: str = "group") -> DataFrame:
        """``rows`` with ``p`` (raw) and ``calibrated``."""
        return calibrate(self.predict_uncalibrated(rows), self.cells, "p", group)

    def feature_importance(self) -> dict[str, float]:
        return {f: self.model.gain.get(f, 0.0) for f in self.features}

    def explain(self, rows: DataFrame) -> DataFrame:
        return self.model.explain(rows)

    def save(self, folder: str) -> None:
        """The trees and the report as JSON, the calibrator and the out-of-fold scores as Parquet."""
        os.makedirs(folder, exist_ok=True)
        self.cells.write.mode("overwrite").parquet(f"{folder}/calibrator")
        self.oof.write.mode("overwrite").parquet(f"{folder}/oof")
        write_json(f"{folder}/model.json", json.loads(self.model.to_json()))
        write_json(f"{folder}/metadata.json", {"schema_version": SCHEMA_VERSION, "features": self.features, "report": self.report})

    @staticmethod
    def load(spark: SparkSession, folder: str) -> FusionModel:
        try:
            with open(f"{folder}/metadata.json") as file:
                meta = json.load(file)
            with open(f"{folder}/model.json") as file:
                model = Gbdt.from_json(file.read())
        except FileNotFoundError as error:
            raise ModelNotTrainedError(f"no model in {folder}; train one first") from error
        if meta["schema_version"] != SCHEMA_VERSION:
            raise ValueError(f"the model has feature schema {meta['schema_version']}, this code {SCHEMA_VERSION}")
        return FusionModel(meta["features"], model, spark.read.parquet(f"{folder}/calibrator"), spark.read.parquet(f"{folder}/oof"), meta["report"])


def cell_names(cells: DataFrame) -> list[str]:
    """The groups that have a curve of their own."""
    return sorted(r.cell for r in cells.where("cell is not null").select("cell").collect())


def shrinkage_weight(n):
    """The weight of a group's own curve against the global one."""
    return n / (n + SHRINK)


def fit_fusion(rows: DataFrame, features: list[str], label: str = "label", group: str = "group", key: str = "claim_id", split: str | None = None, config: FusionConfig = FusionConfig(), monotone: dict[str, int] | None = None) -> FusionModel:
    """Scores that no row's own model gave, a calibrator on them, then a model of all rows.

    Rows of another split than train are an error, and so are rows of one class.
    """
    if split:
        check_split(rows, split)
    monotone = {f: d for f, d in MONOTONE.items() if f in features} if monotone is None else monotone
    validate_schema(aligned(rows, features), monotone)
    n = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    if not n.get(0) or not n.get(1):
        raise ValueError("training needs rows of both classes")
    options = config.options(monotone)
    oof = written(cross_fit(rows, features, label, key, config.folds, **options).select(key, F.col(label).alias("label"), F.col(group).alias("group"), "oof"), "oof")
    cells = written(fit_cells(oof, "oof", "label", "group"), "cells")
    oof = written(calibrate(oof, cells, "oof", "group"), "oof")
    brier = oof.agg(brier_score("oof", "label").alias("raw"), brier_score("calibrated", "label").alias("calibrated")).collect()[0]
    report = {
        "n_train": sum(n.values()), "n_features": len(features), "schema_version": SCHEMA_VERSION, "n_folds": config.folds, "monotone_constraints_applied": len(options["monotone"]),
        "calibrator_cells": cell_names(cells), "oof_brier_uncalibrated": brier.raw, "oof_brier_calibrated": brier.calibrated, "config": asdict(config),
    }
    return FusionModel(features, fit_gbdt(rows, features, label, **options), cells, oof, report)
