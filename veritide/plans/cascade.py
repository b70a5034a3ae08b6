"""The cost-ordered cascade as one batch plan: cheap features decide exits, dear ones run on what is left."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritide.operators.graph import written
from veritide.operators.reuse import interim_score, near_hash_pairs, reuse_features, similar_vectors
from veritide.operators.rings import ring_features


@dataclass(frozen=True)
class CascadeConfig:
    low: float = 0.02
    high: float = 0.98
    forensics: bool = True
    reuse: bool = True
    radius: int = 2
    similar: float = 0.98


def run_cascade(claims: DataFrame, early: DataFrame, forensics: DataFrame | None, config: CascadeConfig = CascadeConfig()) -> DataFrame:
    """Exit stage and features of claims(id, ts, claimant, merchant, phash, embedding).

    ``early`` has the first stage's features by id (provenance and history), ``forensics`` the
    second's. A claim leaves when its interim score is strictly outside [low, high]. One that left
    is still indexed by its hash, but neither asks for nor adds a vector. Features of stages that
    did not run are NaN, never 0.
    """
    pick = lambda df, names: {k: df[v] if v in df.columns else F.lit(None).cast("double") for k, v in names.items()}
    first = {"ai_declared": "declares_ai_generation", "camera_declared": "declares_camera_capture", "n_prior": "n_prior_claims", "value_ratio": "value_vs_prior_mean", "n_prior_30d": "n_prior_claims_30d"}
    none = {k: F.lit(None).cast("double") for k in ("matched", "sharing", "in_ring", "thumbnail")}
    rows = claims.join(early, "id")
    score1 = interim_score(none | pick(rows, first))
    out = lambda s: (s < config.low) | (s > config.high)
    rows = rows.withColumn("_exit1", out(score1))
    dear: list[str] = []
    if config.forensics and forensics is not None:
        dear = [c for c in forensics.columns if c != "id"]
        rows = rows.join(forensics, "id", "left")
        score2 = interim_score(none | pick(rows, first | {"thumbnail": "thumbnail_mismatch"}))
        rows = rows.withColumns({c: F.when(F.col("_exit1"), F.lit(float("nan"))).otherwise(F.col(c).cast("double")) for c in dear})
        rows = rows.withColumn("_exit2", ~F.col("_exit1") & out(score2))
    else:
        rows = rows.withColumn("_exit2", F.lit(False))
    stage = F.when(F.col("_exit1"), 1).when(F.col("_exit2"), 2).otherwise(3)
    rows = rows.withColumn("exit_stage", stage).drop("_exit1", "_exit2")
    if not config.reuse:
        return rows.drop("embedding", "phash")
    # Written once: several features and the rings read them.
    hashes = written(near_hash_pairs(claims, config.radius), "hashes")
    vectors = written(similar_vectors(claims.join(rows.where("exit_stage = 3").select("id"), "id", "left_semi")), "similar")
    reuse = reuse_features(claims, hashes, vectors, config.radius, config.similar)
    matches = hashes.select("q", "c").union(vectors.where(F.col("similarity") >= config.similar).select("q", "c")).distinct()
    rings = ring_features(claims.select("id", "claimant", "merchant", "ts"), matches)
    late = [c for c in [*reuse.columns, *rings.columns] if c != "id"]
    joined = rows.join(reuse, "id").join(rings, "id")
    blank = {c: F.when(F.col("exit_stage") < 3, F.lit(float("nan"))).otherwise(F.col(c).cast("double")) for c in late}
    return joined.withColumns(blank).drop("embedding", "phash")


def stage_distribution(rows: DataFrame) -> DataFrame:
    return rows.groupBy("exit_stage").agg(F.count("*").alias("n"))


def adjudicate(rows: DataFrame, predict: Callable[[DataFrame], DataFrame], approve: float, deny: float, certified: bool) -> DataFrame:
    """What a caller may see: the decision and never the probability. Without a certificate nothing is denied."""
    from veritide.operators.policy import decide

    scored = predict(rows)
    return scored.select("id", decide(F.col("p"), approve, deny if certified else 1.01).alias("action"))
