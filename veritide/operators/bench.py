"""Building a benchmark corpus: every image group of a ledger gets a source image of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritide.functions.hashing import uniform
from veritide.operators.graph import written
from veritide.operators.metrics import global_rank

SYNTHETIC = "fraud_synthetic_image"


class BenchBuildError(RuntimeError):
    """A corpus that cannot be built as asked."""


def _numbered(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """``rows`` with ``nth``: their place in an order by a hash of the key."""
    return global_rank(rows.withColumn("_u", uniform(seed, F.col(key))), ["_u", key], "nth").drop("_u")


def assign_sources(claims: DataFrame, shared: DataFrame, generated: DataFrame, seed: int = 1337, synthetic: str = SYNTHETIC) -> DataFrame:
    """``claims`` (claim_id, image_group_id, fraud_class, generator_family) with ``source_sha256``.

    Distinct groups get distinct images, drawn without replacement: from ``generated`` (sha256,
    family) for synthetic claims, by family, and from ``shared`` (sha256) for all others. Members of a
    ring share the image of the claim that their group is named after; if that one is gone, the group
    gets a fresh one. A pool that is too small is an error: drawing twice would make reuse.
    """
    origins = claims.where(F.col("claim_id") == F.col("image_group_id"))
    plain = origins.where(F.col("fraud_class") != synthetic).select("image_group_id")
    orphans = claims.join(origins.select("image_group_id"), "image_group_id", "left_anti").select("image_group_id").distinct()
    wanted = written(_numbered(plain.withColumn("late", F.lit(0)).union(orphans.withColumn("late", F.lit(1))).withColumn("at", F.concat_ws("|", "late", "image_group_id")), "at", seed), "groups")
    pool = _numbered(shared.select("sha256").distinct(), "sha256", seed + 1)
    if (short := wanted.count() - pool.count()) > 0:
        raise BenchBuildError(f"the shared pool lacks {short} images")
    one = wanted.join(pool, "nth").select("image_group_id", F.col("sha256").alias("source_sha256"))
    rank = lambda key: F.row_number().over(Window.partitionBy("family").orderBy(uniform(seed + 2, F.col(key)), key))
    asked = origins.where(F.col("fraud_class") == synthetic).select("image_group_id", F.col("generator_family").alias("family")).withColumn("n", rank("image_group_id"))
    made = generated.select("sha256", "family").distinct().withColumn("n", rank("sha256"))
    two = written(asked.join(made, ["family", "n"], "left").select("image_group_id", "family", F.col("sha256").alias("source_sha256")), "generated")
    lacking = [r.family for r in two.where("source_sha256 is null").select("family").distinct().collect()]
    if lacking:
        raise BenchBuildError(f"too few images of {sorted(map(str, lacking))}")
    return claims.join(one.union(two.select("image_group_id", "source_sha256")), "image_group_id")


def manifest(claims: DataFrame, transform: str = "fraud_class") -> DataFrame:
    """The manifest of a built corpus: claim, split, class, group, merchant, source and what was done to it."""
    columns = [c for c in ("claim_id", "split", "fraud_class", "label", "generator_family", "image_group_id", "merchant_id", "source_sha256") if c in claims.columns]
    named = F.when(F.col(transform) == "fraud_recycled_prior_claim", "recycle").when(F.col(transform) == "fraud_screen_rephotograph", "rephotograph").when(F.col(transform) == "fraud_metadata_inconsistent", "edit").otherwise("transport")
    return claims.select(*columns, named.alias("transform"))
