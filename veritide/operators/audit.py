"""Reason codes and signed evidence records as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritide.functions.hashing import hmac_sha256

MIN_SHAP, TOP = 0.01, 3
# Reason codes and their wording; {name:format} stands for a feature value.
REASONS = {
    "reuse_n_distinct_claimants_sharing": ("REUSE_MULTI_CLAIMANT", None),
    "reuse_matched_prior_claim": ("REUSE_PRIOR_CLAIM", ("Submitted image matches evidence from an earlier claim (closest perceptual distance %.0f).", ["reuse_min_hamming"])),
    "reuse_max_clip_similarity": ("REUSE_SEMANTIC_MATCH", ("Submitted image is semantically near-identical to a prior claim's image (similarity %.2f).", ["reuse_max_clip_similarity"])),
    "ring_distinct_claimants": ("RING_MEMBERSHIP", ("Image belongs to a cluster shared by %.0f claimants across %.0f merchant(s).", ["ring_distinct_claimants", "ring_distinct_merchants"])),
    "provenance_declares_ai_generation": ("PROVENANCE_AI_DECLARED", ("Image carries a signed C2PA manifest declaring AI generation.", [])),
    "provenance_declares_camera_capture": ("PROVENANCE_CAMERA_CAPTURE", ("Image carries a signed C2PA manifest declaring hardware capture.", [])),
    "forensics_thumbnail_mismatch": ("METADATA_THUMBNAIL_DESYNC", ("Embedded thumbnail does not match the image content (divergence %.2f), consistent with post-capture editing.", ["forensics_thumbnail_mismatch"])),
    "forensics_estimated_quality": ("COMPRESSION_HISTORY", ("Compression history is inconsistent with the stated delivery route.", [])),
    "behaviour_order_value_vs_prior_mean": ("VALUE_ESCALATION", ("Claim value is %.1fx this claimant's historical average.", ["behaviour_order_value_vs_prior_mean"])),
    "behaviour_n_prior_claims_30d": ("CLAIM_FREQUENCY", ("%.0f prior claim(s) from this claimant in the last 30 days.", ["behaviour_n_prior_claims_30d"])),
}


def _text(values: Column, feature: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, (code, wording) in REASONS.items():
        if wording is None:  # its wording asks for values that live features do not have under these names
            text = F.lit(code.replace("_", " ").capitalize())
        else:
            got = [F.coalesce(F.try_element_at(values, F.lit(n)), F.lit(None).cast("double")) for n in wording[1]]
            text = F.format_string(wording[0], *[F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0)) for v in got]) if got else F.lit(wording[0])
            for n in wording[1]:
                text = F.when(F.map_contains_key(values, n), text).otherwise(F.lit(code.replace("_", " ").capitalize()))
        out = F.when(feature == name, text).otherwise(out)
    return out


def reason_codes(shap: Column, values: Column, top: int = TOP) -> Column:
    """array<struct<code, text, shap, feature>>: the largest positive attributions that have a wording."""
    codes = F.create_map(*[F.lit(x) for name, (code, _) in REASONS.items() for x in (name, code)])
    entries = F.filter(F.map_entries(shap), lambda e: (e["value"] >= MIN_SHAP) & F.map_contains_key(codes, e["key"]))
    ordered = F.array_sort(F.transform(entries, lambda e: F.struct((-e["value"]).alias("s"), e["key"].alias("k"))))
    return F.transform(F.slice(ordered, 1, top), lambda e: F.struct(F.try_element_at(codes, e["k"]).alias("code"), _text(values, e["k"]).alias("text"), F.bround(-e["s"], 3).alias("shap"), e["k"].alias("feature")))


def canonical_json(**fields: Column) -> Column:
    """JSON with sorted keys, no blanks, nulls kept."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def signature(payload: Column, key: bytes) -> Column:
    return hmac_sha256(key, payload.cast("binary"))


def is_signed(payload: Column, signed: Column, key: bytes) -> Column:
    return signature(payload, key) == signed


def evidence_records(rows: DataFrame, key: bytes, claim: str = "claim_id", action: str = "action", p: str = "p", reasons: str = "reasons", **extra: Column) -> DataFrame:
    """``rows`` with ``payload`` (canonical JSON: the score at 4 decimals, reasons, ``extra``) and its ``signature``."""
    payload = canonical_json(claim_id=F.col(claim).cast("string"), action=F.col(action), p_hat=F.bround(F.col(p), 4), reasons=F.col(reasons), **extra)
    return rows.withColumn("payload", payload).withColumn("signature", signature(F.col("payload"), key))


def verify_records(records: DataFrame, key: bytes) -> DataFrame:
    """One row: how many records there are, and how many do not bear out their signature."""
    good = F.coalesce(is_signed(F.col("payload"), F.col("signature"), key), F.lit(False))
    return records.agg(F.count("*").alias("n"), F.count_if(~good).alias("n_broken"))
