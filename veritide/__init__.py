"""Claim-evidence analytics expressed as Spark plans."""
