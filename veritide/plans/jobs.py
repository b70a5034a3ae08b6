"""The jobs: train a model, certify its thresholds on a sealed split, evaluate it. Each writes small JSON reports."""

from __future__ import annotations

import os
import subprocess
import time
from dataclasses import asdict
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritide.operators import ablations, baselines, metrics, policy, risk
from veritide.operators.bootstrap import mean_interval, ranking_interval
from veritide.operators.fusion import FusionConfig, FusionModel, fit_fusion
from veritide.operators.graph import written
from veritide.operators.seal import current_seal, write_seal
from veritide.sources.corpus import write_json


def train(rows: DataFrame, features: list[str], folder: str, config: FusionConfig = FusionConfig(), **columns) -> FusionModel:
    """Fit on the rows of the train split and store the model."""
    model = fit_fusion(rows, features, config=config, **columns)
    model.save(folder)
    return model


def attempts_of(tested: DataFrame) -> DataFrame:
    """One row for each rung of ``walk_ladder``: how many thresholds were tested and certified, and the least conservative one."""
    by = tested.groupBy("rung", "alpha", "delta").agg(
        F.count_if(~F.col("skipped")).alias("n_tested"), F.count_if("certified").alias("n_certified"),
        F.min(F.when(F.col("certified"), F.col("threshold"))).alias("least_conservative"),
        F.max(F.when(~F.col("skipped") & ~F.col("certified"), F.col("threshold"))).alias("stopped_at"),
    )
    return by.withColumn("certified", F.col("n_certified") > 0)


def certify(rows: DataFrame, tier: str, root: str | None = None, p: str = "calibrated", y: str = "label", claim: str = "claim_id", sha: str = "image_sha256", ladder: list[tuple[float, float]] = risk.LADDER) -> dict:
    """Seal the calibration split, then walk the ladder on it: every rung tried is in the certificate, with every threshold.

    With ``root`` the seal and the certificate are written under it; a split that changed since it was
    sealed is an error. The thresholds of a rung are as many as the grid has.
    """
    if rows.isEmpty():
        raise ValueError(f"the calibration split of {tier} has no rows")
    seal = write_seal(rows, root, tier, claim, y, sha) if root else current_seal(rows, tier, claim, y, sha)
    tested = written(risk.walk_ladder(rows, p, y, ladder), "ladder")
    rungs = [r.asDict() for r in attempts_of(tested).orderBy("rung").collect()]
    for r in rungs:
        r["results"] = [t.asDict() for t in tested.where(F.col("rung") == r["rung"]).orderBy(F.desc("threshold")).collect()]
    chosen = next((r for r in rungs if r["certified"]), None)
    out = {
        "tier": tier, "scale_warning": None if tier == "full" else f"{tier}: the mechanism only, no result to report", "n_calibration": seal.n_claims, "n_fraud": seal.n_fraud,
        "calibration_seal": asdict(seal), "ladder": [list(r) for r in ladder], "certified": chosen is not None, "chosen": chosen, "attempts": rungs,
    }
    if root:
        write_json(os.path.join(root, tier, "certificate.json"), out)
    return out


def summarise_certificate(c: dict) -> str:
    lines = [f"certificate of {c['tier']}: {c['n_calibration']} claims, {c['n_fraud']} of them false, seal {c['calibration_seal']['content_sha256'][:16]}"]
    lines += [f"  alpha {r['alpha']:g}, delta {r['delta']:g}: " + (f"{r['n_certified']} thresholds, from {r['least_conservative']:.2f} on" if r["certified"] else "nothing certified") for r in c["attempts"]]
    if c["chosen"]:
        lines.append(f"at most {c['chosen']['alpha']:.1%} of denied claims are legitimate, with confidence {1 - c['chosen']['delta']:.0%}")
    return "\n".join(lines)


def evaluate(rows: DataFrame, tier: str, root: str | None = None, features: list[str] | None = None, split: str = "test", subset: Column | None = None, resamples: int = 2_000, slow: bool = False, config: FusionConfig = FusionConfig(trees=200), costs: policy.Costs = policy.Costs()) -> dict:
    """Ranking, calibration, baselines, policy and cost, exploration, maturity and, if ``slow``, ablations and controls of
    rows (claim_id, label, group, value, ts, p, calibrated, features).

    Thresholds are certified anew on the evaluated rows, as an estimate of what a policy costs: that is
    not the certificate.
    """
    began = time.time()
    rows = written(rows, "evaluated")
    n, prevalence = rows.agg(F.count("*"), F.avg(F.col("label").cast("double"))).collect()[0]
    ranking = ranking_interval(rows, "p", "label", resamples)
    rank = metrics.ranking_metrics(rows, "p", "label").collect()[0]
    overall = metrics.calibration_error(rows, "calibrated", "label", "claim_id").collect()[0]
    groups = metrics.calibration_error(rows, "calibrated", "label", "claim_id", group="group", least=30)
    brier = rows.agg(metrics.brier_score("calibrated", "label")).collect()[0][0]
    out = {
        "tier": tier, "split_evaluated": split, "is_reportable_result": tier == "full", "n_claims": n, "prevalence": prevalence, "pr_auc": ranking.as_dict(),
        "p_at_90r": rank.precision_at_recall, "r_at_95p": rank.recall_at_precision,
        "calibration": {"overall": {"brier": brier, "ece": overall.ece, "mce": overall.mce, "n": overall.n}, "worst_groups": [r.asDict() for r in groups.orderBy(F.desc("ece"), "group").limit(5).collect()]},
    }
    out["baselines"] = []
    for name, what, fit in baselines.BASELINES if features else ():
        try:
            scored = rows.withColumn("b", fit(rows))
        except ValueError:
            continue  # no features of this family
        out["baselines"].append({"name": name, "description": what} | ranking_interval(scored, "b", "label", min(resamples, 500)).as_dict())
    certified = [r.threshold for r in risk.certify_thresholds(rows, "calibrated", "label", 0.10, 0.10).where("certified").orderBy(F.desc("threshold")).collect()]
    chosen = policy.select_policy(rows, "calibrated", "label", "value", certified, costs).collect()[0]
    summary = policy.policy_summary(rows, "calibrated", "label", "value", chosen.t_approve, chosen.t_deny, costs).collect()[0]
    action = policy.decide(F.col("calibrated"), chosen.t_approve, chosen.t_deny)
    acted = rows.withColumn("action", action).withColumn("cost", costs.realised(action, F.col("label"), F.col("value")))
    fixed = lambda a: acted.agg((F.sum(costs.realised(F.lit(a), F.col("label"), F.col("value"))) / F.count("*") * 1000)).collect()[0][0]
    out["policy"] = chosen.asDict() | summary.asDict() | {"candidates": [r.asDict() for r in policy.policy_candidates(rows, "calibrated", "label", "value", certified, costs=costs).orderBy("place").collect()]}
    out["cost"] = {
        "per_1000_claims": summary.cost_per_1000, "per_claim_ci": mean_interval(acted, "cost", min(resamples, 1000)).as_dict(), "review_load_pct": 100 * summary.review_rate,
        "baselines_per_1000": {"approve_all": fixed("APPROVE"), "deny_all": fixed("DENY"), "review_all": fixed("REVIEW")},
    }
    log = policy.explore(acted, "action", "claim_id", costs.epsilon)
    out["exploration"] = policy.exploration_cost(log, "label", "value", costs).collect()[0].asDict() | policy.censoring_report(log).collect()[0].asDict()
    out["label_maturity"] = policy.maturity_report(rows, "ts").collect()[0].asDict()
    if "exit_stage" in rows.columns:
        out["cascade"] = {f"stage_{r.exit_stage}": r["count"] / n for r in rows.groupBy("exit_stage").count().collect()}
    if slow and features:
        out["ablations"] = [r.asDict() for r in ablations.run_ablations(rows, features, subset, config).collect()]
        out["configuration_ablations"] = [r.asDict() for r in ablations.run_configuration_ablations(rows, features, config).collect()]
        out["negative_controls"] = [r.asDict() for r in ablations.run_controls(rows, features, ranking.point, config).collect()]
    out["elapsed_seconds"] = round(time.time() - began, 1)
    if root:
        write_json(os.path.join(root, tier, "metrics.json"), out)
        write_json(os.path.join(root, tier, "run_manifest.json"), {"git_sha": git_sha(), "generated_at": datetime.now(UTC).isoformat(timespec="seconds"), "tier": tier, "split_evaluated": split, "model_config": asdict(config), "n_resamples": resamples})
    return out


def git_sha() -> str:
    try:
        return subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True, check=True, timeout=10).stdout.strip()
    except (OSError, subprocess.SubprocessError):
        return "unknown"


def summarise_metrics(m: dict) -> str:
    pr, cal = m["pr_auc"], m["calibration"]["overall"]
    lines = [
        f"evaluation of {m['tier']} on {m['split_evaluated']}: {m['n_claims']} claims, prevalence {m['prevalence']:.3f}",
        f"  average precision {pr['point']:.4f} [{pr['ci_lower']:.4f}, {pr['ci_upper']:.4f}], Brier {cal['brier']:.4f}, ECE {cal['ece']:.4f}, MCE {cal['mce']:.4f}",
        f"  {m['cost']['per_1000_claims']:,.0f} per 1,000 claims, {m['cost']['review_load_pct']:.1f} % reviewed",
    ]
    lines += [f"  {r['name']} [{r['subset']}] {r['delta_pr_auc']:+.4f}" for r in m.get("ablations", []) if r["name"] != "full"]
    lines += [f"  {r['name']}: {'pass' if r['passed'] else 'FAIL'} ({r['pr_auc']:.4f}, prevalence {r['prevalence']:.4f})" for r in m.get("negative_controls", [])]
    return "\n".join(lines)


def build_bench(spark, n: int, shared: DataFrame, generated: DataFrame, seed: int = 1337) -> tuple[DataFrame, dict]:
    """(claims with their source images, summary): simulate a ledger, keep every identity and ring in one split, check the
    splits, and draw sources without replacement."""
    from veritide.functions import canonical as c
    from veritide.operators import bench, identity, simulate

    claims = written(simulate.simulate_ledger(spark, n, seed=seed), "ledger")
    origins = claims.where("image_group_id is not null").groupBy("image_group_id").agg(F.min_by("claim_id", F.struct("claim_timestamp", "claim_id")).alias("origin"))
    claims = claims.join(origins, "image_group_id", "left").withColumn("image_group_id", F.coalesce("origin", "claim_id")).drop("origin")  # a group is named after its first claim
    signals = claims.select(F.col("claim_id").alias("id"), c.phone_key(F.col("phone")).alias("phone"), c.email_key(F.col("email")).alias("email"), c.address_key(F.col("address")).alias("address"), c.pin_key(F.col("pin")).alias("pin"))
    identities = written(identity.resolve_identities(signals), "identities")
    rows = claims.select(F.col("claim_id").alias("id"), F.col("claim_timestamp").alias("ts"), "split", "image_group_id", "generator_family").join(identities, "id")
    links = rows.groupBy("entity").agg(F.min("id").alias("a")).join(rows, "entity").select("a", F.col("id").alias("b"))
    rings = rows.select(F.col("image_group_id").alias("a"), F.col("id").alias("b")).join(rows.select(F.col("id").alias("a")), "a", "left_semi")
    reconciled = written(identity.reconcile_splits(rows, links.union(rings)), "reconciled")
    kept = claims.join(reconciled.where("dropped").select(F.col("id").alias("claim_id")), "claim_id", "left_anti")
    report = identity.verify_splits(identity.without_dropped(rows, reconciled), ["train", "calibration", "test"])
    broken = [r.check for r in report.where("not passed").collect()]
    if broken:
        raise bench.BenchBuildError(f"the splits break {broken}")
    built = written(bench.assign_sources(kept, shared, generated, seed, synthetic="generated"), "bench")
    summary = {"n": built.count(), "n_dropped": n - built.count(), "splits": {r[0]: r[1] for r in built.groupBy("split").count().collect()}, "classes": {r[0]: r[1] for r in built.groupBy("fraud_class").count().collect()}}
    return built, summary
