"""What a model loses without a family of features or a part of its configuration, and controls that must find nothing."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritide.operators.bootstrap import noise_features, shuffled_labels
from veritide.operators.fusion import FusionConfig, fit_fusion
from veritide.operators.gbdt import blank
from veritide.operators.metrics import brier_score, calibration_error, ranking_metrics

FAMILIES = {"full": None, "no_provenance": "provenance_", "no_forensics": "forensics_", "no_reuse": "reuse_", "no_behaviour": "behaviour_", "no_rings": "ring_"}
SCHEMA = "name string, subset string, pr_auc double, brier double, ece double, delta_pr_auc double, n long"
TOLERANCE = 0.05


def source_controlled(source: str = "source_dataset", other: str = "GenImage") -> Column:
    """Rows whose source is the one that honest and false claims share."""
    return ~F.coalesce(F.contains(F.col(source), F.lit(other)), F.lit(False))


def _measures(oof: DataFrame, score: str, key: str) -> tuple[float, float, float]:
    auc = ranking_metrics(oof, "oof", "label").collect()[0].pr_auc
    brier = oof.agg(brier_score(score, "label").alias("b")).collect()[0].b
    return auc, brier, calibration_error(oof, score, "label", key).collect()[0].ece


def run_ablations(rows: DataFrame, features: list[str], subset: Column | None = None, config: FusionConfig = FusionConfig(trees=200), key: str = "claim_id", **columns) -> DataFrame:
    """One row for each family left out, on all rows and, with ``subset``, on those it holds for.

    A family is blanked with NaN and not dropped, so the schema stays. A subset of one class is passed over.
    """
    out = []
    for name, part in (("all", rows), *([("abo_only", rows.where(subset))] if subset is not None else [])):
        label = columns.get("label", "label")
        if part.select(label).distinct().count() < 2:
            continue
        base = None
        for ablation, prefix in FAMILIES.items():
            if prefix and not any(f.startswith(prefix) for f in features):
                raise ValueError(f"{ablation} blanks nothing")
            model = fit_fusion(blank(part, prefix) if prefix else part, features, key=key, config=config, **columns)
            auc, brier, ece = _measures(model.oof, "calibrated", key)
            base = auc if base is None else base
            out.append((ablation, name, auc, brier, ece, auc - base, model.report["n_train"]))
    return rows.sparkSession.createDataFrame(out, SCHEMA)


def run_configuration_ablations(rows: DataFrame, features: list[str], config: FusionConfig = FusionConfig(trees=200), key: str = "claim_id", **columns) -> DataFrame:
    """The full model, the same without calibration (the ranking stays), and one without constraints."""
    full = fit_fusion(rows, features, key=key, config=config, **columns)
    free = fit_fusion(rows, features, key=key, config=replace(config, constrained=False), **columns)
    n, out = full.report["n_train"], []
    for name, model, score in (("full", full, "calibrated"), ("no_calibration", full, "oof"), ("no_monotone_constraints", free, "calibrated")):
        auc, brier, ece = _measures(model.oof, score, key)
        out.append((name, "all", auc, brier, ece, auc - (out[0][2] if out else auc), n))
    return rows.sparkSession.createDataFrame(out, SCHEMA)


def run_controls(rows: DataFrame, features: list[str], base: float, config: FusionConfig = FusionConfig(trees=150), key: str = "claim_id", label: str = "label", tolerance: float = TOLERANCE, **columns) -> DataFrame:
    """Labels of other rows, and noise for every feature: the ranking must fall to the prevalence, give or take ``tolerance``."""
    prevalence = rows.agg(F.avg(F.col(label).cast("double"))).collect()[0][0]
    out = []
    for name, changed in (("label_shuffle", shuffled_labels(rows, label, key)), ("random_features", noise_features(rows, features, key))):
        auc = _measures(fit_fusion(changed, features, label=label, key=key, config=config, **columns).oof, "oof", key)[0]
        out.append((name, auc, base, prevalence, auc <= prevalence + tolerance))
    return rows.sparkSession.createDataFrame(out, "name string, pr_auc double, baseline_pr_auc double, prevalence double, passed boolean")
