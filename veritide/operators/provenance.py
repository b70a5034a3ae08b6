"""Provenance manifests: what a signed manifest declares, by JSON expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Public manifest vocabulary.
AI = ["trainedalgorithmicmedia", "generativeai", "ai_generated", "digitalsourcetype/trainedalgorithmicmedia", "digitalsourcetype/compositewithtrainedalgorithmicmedia"]
CAMERA = ["c2pa.captured", "digitalsourcetype/digitalcapture"]
EDIT = ["c2pa.edited", "c2pa.cropped", "c2pa.filtered", "c2pa.placed"]


def provenance(manifest: Column) -> Column:
    """A struct of status and six features. No manifest is unknown, never adverse; an unreadable one is invalid."""
    valid = F.try_parse_json(manifest).isNotNull()
    blob = F.lower(manifest)
    holds = lambda words: valid & F.coalesce(F.greatest(*[F.contains(blob, F.lit(w)) for w in words]), F.lit(False))
    active = F.get_json_object(manifest, "$.active_manifest")
    manifests = F.from_json(F.get_json_object(manifest, "$.manifests"), "map<string,struct<assertions:array<string>>>")
    n = F.coalesce(F.size(F.try_element_at(manifests, active)["assertions"]), F.lit(0))
    n = F.when(valid & (n > 0), n).otherwise(0)
    ai, camera, edit, has = holds(AI), holds(CAMERA), holds(EDIT), F.coalesce(F.length(manifest) > 0, F.lit(False))
    status = F.when(~has, "UNKNOWN").when(~valid, "INVALID").when(ai, "VALID_AI_GENERATED").when(edit, "VALID_EDITED").when(camera, "VALID_CAMERA").otherwise("UNKNOWN")
    flag = lambda c: F.coalesce((has & c).cast("double"), F.lit(0.0))
    return F.struct(
        status.alias("status"), flag(F.lit(True)).alias("has_manifest"), flag(valid).alias("manifest_valid"), flag(ai).alias("declares_ai_generation"),
        flag(camera).alias("declares_camera_capture"), flag(edit).alias("declares_editing"), n.cast("double").alias("n_assertions"),
    )
