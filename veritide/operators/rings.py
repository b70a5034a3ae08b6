"""Reuse rings as they stood at each claim: components first, then an ordered replay of each."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritide.operators.graph import connected_components, written

COLUMNS = "in_ring boolean, ring_size int, ring_claimants int, ring_merchants int, ring_span_days double, is_first_seen boolean"


def replay(claims: pd.DataFrame) -> pd.DataFrame:
    """Claims of one component in order of (ts, id); ``matches`` are ids of earlier claims."""
    parent: dict = {}
    held: dict = {}
    out = []

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for r in claims.sort_values(["ts", "id"]).itertuples():
        roots = {root(m) for m in (r.matches if r.matches is not None else []) if m in parent}
        parent[r.id] = r.id
        mine = {"members": 1, "claimants": {r.claimant}, "merchants": {r.merchant}, "first": (r.ts, r.id, r.claimant), "last": r.ts}
        for other in sorted(roots, key=lambda x: held[x]["first"][:2]):
            old = held.pop(other)
            parent[other] = r.id
            mine = {
                "members": mine["members"] + old["members"], "claimants": mine["claimants"] | old["claimants"], "merchants": mine["merchants"] | old["merchants"],
                "first": min(mine["first"], old["first"], key=lambda f: f[:2]), "last": max(mine["last"], old["last"]),
            }
        held[r.id] = mine
        first = not roots or mine["first"][2] == r.claimant
        ring = not first and len(mine["claimants"]) >= 2
        span = (mine["last"] - mine["first"][0]).total_seconds() / 86400 if ring else 0.0
        out.append((r.id, ring, mine["members"] if ring else 0, len(mine["claimants"]) if ring else 0, len(mine["merchants"]) if ring else 0, span, first))
    return pd.DataFrame(out, columns=["id", *[c.split()[0] for c in COLUMNS.split(", ")]])


def ring_features(claims: DataFrame, matches: DataFrame) -> DataFrame:
    """Ring features of claims(id, claimant, merchant, ts) with matches(q, c), in order of (ts, id); ids are of any type.

    Claims without any match are first seen and need no replay, so only linked claims are grouped. A
    component is replayed in one task, a few numbers a claim: rings feed back into themselves. Matches
    are written once, since several steps read them.
    """
    matches = written(matches.select("q", "c"), "matches")
    linked = matches.select(F.col("q").alias("id")).union(matches.select("c")).distinct()
    comp = connected_components(linked.select(F.col("id").alias("node")), matches.select(F.col("q").alias("a"), F.col("c").alias("b")))
    listed = matches.groupBy(F.col("q").alias("id")).agg(F.sort_array(F.collect_list("c")).alias("matches"))
    rows = claims.join(comp.select(F.col("node").alias("id"), "component"), "id").join(listed, "id", "left").select("id", "claimant", "merchant", F.col("ts").cast("timestamp").alias("ts"), "matches", "component")
    replayed = rows.groupBy("component").applyInPandas(lambda pdf: replay(pdf), f"id {claims.schema['id'].dataType.simpleString()}, {COLUMNS}")
    alone = claims.join(linked, "id", "left_anti").select(
        "id", F.lit(False).alias("in_ring"), *[F.lit(0).alias(c) for c in ("ring_size", "ring_claimants", "ring_merchants")], F.lit(0.0).alias("ring_span_days"), F.lit(True).alias("is_first_seen")
    )
    return replayed.unionByName(alone)


def ring_clusters(claims: DataFrame, matches: DataFrame) -> DataFrame:
    """Final clusters with at least two distinct claimants: size, claimants, merchants, span."""
    comp = connected_components(claims.select(F.col("id").alias("node")), matches.select(F.col("q").alias("a"), F.col("c").alias("b")))
    rows = claims.join(comp, F.col("id") == F.col("node"))
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return rows.groupBy("component").agg(
        F.count("*").alias("size"), F.count_distinct("claimant").alias("claimants"), F.count_distinct("merchant").alias("merchants"), ((F.max(at) - F.min(at)) / 86_400_000_000).alias("span_days")
    ).where("claimants >= 2")


def ring_of(claims: DataFrame, matches: DataFrame) -> DataFrame:
    """(id, component, size): the final cluster of every claim, alone in its own if nothing matches."""
    comp = connected_components(claims.select(F.col("id").alias("node")), matches.select(F.col("q").alias("a"), F.col("c").alias("b")))
    sizes = comp.groupBy("component").agg(F.count("*").alias("size"))
    return comp.join(sizes, "component").select(F.col("node").alias("id"), "component", "size")
