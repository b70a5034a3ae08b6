"""The seal of a calibration split: what a certificate rests on, recorded before it is computed."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame

from veritide.operators.risk import calibration_seal
from veritide.sources.corpus import write_json

FILE = "calibration_seal.json"
NOTE = "Digest of the claim ids, labels and image digests of the calibration split. A certificate holds for exactly these rows."


class CalibrationSealBroken(RuntimeError):
    """The calibration split is not the one that was sealed, or was never sealed."""


@dataclass(frozen=True)
class CalibrationSeal:
    tier: str
    n_claims: int
    n_fraud: int
    content_sha256: str
    sealed_at: str
    note: str = NOTE


def seal_path(root: str, tier: str) -> str:
    return os.path.join(root, tier, FILE)


def read_seal(root: str, tier: str) -> CalibrationSeal | None:
    try:
        with open(seal_path(root, tier)) as file:
            got = json.load(file)
    except FileNotFoundError:
        return None
    return CalibrationSeal(**{k: got.get(k, "") for k in CalibrationSeal.__dataclass_fields__})


def current_seal(rows: DataFrame, tier: str, claim: str, label: str, sha: str) -> CalibrationSeal:
    found = calibration_seal(rows, claim, label, sha).collect()[0]
    return CalibrationSeal(tier, found.n_claims, found.n_fraud, found.content_sha256, datetime.now(UTC).isoformat(timespec="seconds"))


def write_seal(rows: DataFrame, root: str, tier: str, claim: str = "claim_id", label: str = "label", sha: str = "image_sha256", overwrite: bool = False) -> CalibrationSeal:
    """Seal a split. An equal seal that is there is kept; a different one is an error unless ``overwrite``."""
    now, old = current_seal(rows, tier, claim, label, sha), read_seal(root, tier)
    if old and not overwrite:
        if old.content_sha256 != now.content_sha256:
            raise CalibrationSealBroken(f"the split of {tier} was sealed as {old.content_sha256} and is now {now.content_sha256}")
        return old
    write_json(seal_path(root, tier), asdict(now))
    return now


def verify_seal(rows: DataFrame, root: str, tier: str, claim: str = "claim_id", label: str = "label", sha: str = "image_sha256") -> CalibrationSeal:
    """The recorded seal, if the split still is what it says; else an error, never a warning."""
    old = read_seal(root, tier)
    if old is None:
        raise CalibrationSealBroken(f"the split of {tier} was never sealed")
    now = current_seal(rows, tier, claim, label, sha)
    if now.content_sha256 != old.content_sha256:
        raise CalibrationSealBroken(f"the split of {tier} was sealed as {old.content_sha256} on {old.sealed_at} and is now {now.content_sha256}")
    return old


def well_formed(root: str, tier: str) -> list[str]:
    """What is wrong with the recorded seal of a tier; nothing if there is none."""
    seal, wrong = read_seal(root, tier), []
    if seal is None:
        return wrong
    if seal.tier != tier:
        wrong.append(f"it names tier {seal.tier!r}")
    if len(str(seal.content_sha256)) != 64 or set(str(seal.content_sha256)) - set("0123456789abcdef"):
        wrong.append("its digest is no SHA-256")
    if not isinstance(seal.n_claims, int) or not isinstance(seal.n_fraud, int) or not 0 <= seal.n_fraud <= seal.n_claims:
        wrong.append("its counts do not fit")
    try:
        datetime.fromisoformat(str(seal.sealed_at))
    except ValueError:
        wrong.append("its time cannot be read")
    return wrong
