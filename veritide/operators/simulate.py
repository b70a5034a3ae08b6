"""A claims ledger made from hashes of the row number: any size, in parallel, the same each time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritide.functions.hashing import uniform

# Cohorts with their shares and windows in days, and the share of each kind of claim.
COHORTS = [("train", 0.6, 0, 180), ("calibration", 0.2, 180, 270), ("test", 0.2, 270, 365)]
KINDS = {"legit": 0.85, "recycled": 0.04, "ring": 0.04, "edited": 0.03, "generated": 0.04}
FAMILIES = {"train": ["SD15", "ADM"], "calibration": ["GLIDE"], "test": ["Midjourney", "VQDM"]}


def _choice(u: Column, shares: list[tuple[str, float]]) -> Column:
    out, total = None, 0.0
    for name, share in shares[:-1]:
        total += share
        out = F.when(u < total, name) if out is None else out.when(u < total, name)
    return out.otherwise(shares[-1][0])


def simulate_ledger(spark: SparkSession, n: int, merchants: int = 3, seed: int = 1, repeat: float = 0.10, start: str = "2025-01-01") -> DataFrame:
    """``n`` claims: cohorts in separate time windows, rings that share an image a few days apart, repeat claimants within a cohort."""
    k = F.col("id")
    u = lambda name, *keys: uniform(seed, F.lit(name), *(keys or (k,)))
    rows = spark.range(n).withColumn("split", _choice(u("cohort"), [(c[0], c[1]) for c in COHORTS]))
    rows = rows.withColumn("fraud_class", _choice(u("kind"), list(KINDS.items())))
    ring = F.col("fraud_class") == "ring"
    rows = rows.withColumn("image_group_id", F.when(ring, F.concat_ws("-", F.lit("g"), "split", F.floor(k / 40).cast("string"))))
    low, high = (F.coalesce(*[F.when(F.col("split") == c[0], F.lit(float(c[i]))) for c in COHORTS]) for i in (2, 3))
    base = low + F.when(ring, u("when", F.col("image_group_id"))).otherwise(u("when")) * (high - low - 11)
    day = F.least(base + F.when(ring, 1 + 9 * u("later")).otherwise(0.0), high - 0.01)
    ts = F.timestamp_seconds(F.unix_timestamp(F.lit(start).cast("timestamp")) + (day * 86400).cast("long"))
    person = F.when(u("repeat") < repeat, F.concat_ws("-", "split", F.floor(u("who") * F.lit(max(1, n // 50))).cast("string"))).otherwise(F.concat_ws("-", F.lit("solo"), k.cast("string")))
    families = F.coalesce(*[F.when(F.col("split") == s, F.element_at(F.array(*map(F.lit, f)), (F.floor(u("family") * len(f)) + 1).cast("int"))) for s, f in FAMILIES.items()])
    value = (500 + 9500 * F.pow(u("value"), 2)).cast("int")
    rows = rows.withColumns({"claim_timestamp": ts, "claimant_id": F.concat(F.lit("claimant_"), person)})
    phone = F.conv(F.substring(F.sha2("claimant_id", 256), 1, 12), 16, 10).cast("bigint") % 1_000_000_000 + 9_000_000_000
    return rows.select(
        F.format_string("claim_%09d", k).alias("claim_id"), "claim_timestamp", F.timestamp_seconds(F.unix_timestamp("claim_timestamp") - (86400 * (1 + 6 * u("lag"))).cast("long")).alias("order_date"),
        F.concat(F.lit("merchant_"), F.floor(u("merchant") * merchants).cast("string")).alias("merchant_id"), "claimant_id", phone.cast("string").alias("phone"), F.concat("claimant_id", F.lit("@mail.example")).alias("email"),
        F.concat_ws(" ", F.lit("Flat"), (phone % 97).cast("string"), F.lit("Lake Road")).alias("address"), F.lpad((phone % 900 + 560000).cast("string"), 6, "0").alias("pin"),
        F.element_at(F.array(*map(F.lit, ["electronics", "apparel", "grocery"])), (F.floor(u("category") * 3) + 1).cast("int")).alias("category"),
        F.when(value < 1500, "low").when(value < 5000, "mid").otherwise("high").alias("price_band"), value.alias("order_value_inr"), (F.col("fraud_class") != "legit").cast("int").alias("label"),
        "fraud_class", F.when(F.col("fraud_class") == "generated", families).alias("generator_family"), "image_group_id", "split",
    )
