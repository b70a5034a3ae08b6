"""Queries on rows that the driver's small tables do not hold."""

import datetime as dt
import decimal
import glob
import os

import duckdb
import numpy as np
import pandas as pd

from tests.test_queries import plain
from veritide.functions.canonical import token_set_similarity
from veritide.operators import gbdt, graph, identity, reuse, rings
from veritide.plans import cascade, registry


def embeddings(folder, ids):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(7, 64))
    rows = pd.DataFrame({"vec_id": ids, "embedding": [(base[i % 7] + rng.normal(size=64) * 0.7).astype(np.float32) for i in ids], "label": [np.int32(i % 7) for i in ids]})
    rows.to_parquet(f"{folder}/embeddings.parquet", index=False)
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{folder}/embeddings.parquet')")
    return con


def test_federated_answers_on_evidence_after_their_day(spark, tmp_path):
    con = embeddings(tmp_path, [*range(8740, 8790), *range(9240, 9290), *range(20_000, 20_020)])
    got, want = plain(registry.QUERIES["federated_answers"](spark, str(tmp_path)).toPandas()), plain(con.execute(registry.ORACLE_SQL["federated_answers"]).df())
    assert (want["decayed_weight"] > 1).any()
    pd.testing.assert_frame_equal(got, want, check_dtype=False, atol=2e-6)


def test_address_pairs_of_a_large_place_are_the_work_of_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(identity, "LIST_IDS", 3)
    monkeypatch.setattr(identity, "TASK_PAIRS", 20)
    address = ["flat number 7 road", "flat number 7 roads", "flat number 8 road", "flat number road"]
    rows = [(i, f"{i % 2}", address[i % 3 if i % 11 else 3]) for i in range(70)]
    pairs = identity.address_pairs(spark.createDataFrame(rows, "id long, pin string, address string"))
    want = {(a, b) for a, p, x in rows for b, q, y in rows if a < b and p == q and (x == y or {x, y} != {address[0], address[2]} and {x, y} != {address[1], address[2]} and token_set_similarity(x, y) >= 85)}
    got = [tuple(r) for r in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    sizes = [len(p) for p in pairs.rdd.glom().collect()]
    assert len(sizes) > 20 and max(sizes) < len(want) / 5


def test_lists_of_a_place_are_in_order_of_ids(spark, monkeypatch):
    kept = {}
    monkeypatch.setattr(identity, "written", lambda df, name: kept.setdefault(name, graph.written(df, name)))
    ids = [(7919 * i) % 1000 for i in range(200)]
    pairs = identity.address_pairs(spark.createDataFrame([(i, "1", f"flat number {i % 2} road") for i in ids], "id long, pin string, address string").repartition(5)).collect()
    assert len(pairs) == len({tuple(r) for r in pairs}) == sum(1 for i in ids for j in ids if i < j and i % 2 == j % 2)
    lists = [r.ids for r in kept["lists"].collect()]
    assert sum(map(len, lists)) == 200 and all(x == sorted(x) for x in lists)


def test_pairs_of_lists_are_made_some_at_a_time_for_ids_of_any_type(spark, monkeypatch):
    monkeypatch.setattr(identity, "LIST_IDS", 7)
    monkeypatch.setattr(identity, "HELD_PAIRS", 10)
    address = ["flat number 7 road", "flat number 7 roads", "flat number 8 road"]
    day = lambda i: dt.date(2026, 1, 1) + dt.timedelta(days=i)
    order = lambda v: v.encode() if isinstance(v, str) else v
    both = lambda p: tuple(map(order, p))
    for kind, key in (("long", lambda i: i - 20), ("int", int), ("string", lambda i: f"é{i}" if i % 5 else f"𐍈{i}"), ("date", day), ("decimal(9,2)", lambda i: decimal.Decimal(i) / 4)):
        # One id stands twice at a place and once at a similar one.
        rows = [(key(i * 7 % 40), address[i % 3]) for i in range(40)] + [(key(7), address[1]), (key(7), address[0])]
        signals = spark.createDataFrame([(i, "1", x) for i, x in rows], f"id {kind}, pin string, address string").repartition(3)
        pairs = identity.address_pairs(signals)
        met = [(i, j) for n, (i, x) in enumerate(rows) for j, y in rows[n + 1 :] if (i != j if x == y else address[2] not in (x, y))]
        assert any(i == j for i, j in met)
        assert sorted(map(tuple, pairs.collect()), key=both) == sorted((tuple(sorted(p, key=order)) for p in met), key=both)
        assert pairs.schema["a"].dataType == pairs.schema["b"].dataType == signals.schema["id"].dataType
        # Generated code that explodes a list holds all its rows before it gives one.
        assert "explode(" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_keys_of_addresses_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def key(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = [(i, "1" if i % 7 else None, f"flat number {i % 3} road" if i % 5 else "") for i in range(50)]
    kept = [(i, x) for i, pin, x in rows if pin and x]
    signals = spark.createDataFrame(rows, "id long, pin string, address string").mapInArrow(key, "id long, pin string, address string")
    assert len(identity.address_pairs(signals, 100.0).collect()) == sum(1 for i, x in kept for j, y in kept if i < j and x == y)
    assert made.value == 50
    assert identity.address_edges(signals, 100.0).count() == len(kept) - 3
    assert made.value == 100


def test_address_pairs_take_little_room(spark, tmp_path):
    signals = spark.range(3000).selectExpr("id * 7919 % 100003 id", "'1' pin", "'flat number 7 road' address").repartition(3)
    identity.address_pairs(signals).write.parquet(f"{tmp_path}/pairs")
    written = sum(os.path.getsize(f) for f in glob.glob(f"{tmp_path}/pairs/*.parquet"))
    pairs = spark.read.parquet(f"{tmp_path}/pairs")
    assert pairs.distinct().count() == pairs.count() == 3000 * 2999 // 2 and pairs.where("a >= b").isEmpty()
    assert written < 0.3 * 3000 * 2999 / 2


def test_boosted_trees_of_grouped_rows_are_those_of_all_rows(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 2)).round(2)
    y = (x[:, 0] - x[:, 1] + rng.normal(size=1500) > 0).astype(int)
    x[rng.random(x.shape) < 0.1] = np.nan
    rows = spark.createDataFrame([(None if np.isnan(a) and i % 2 else float(a), float(b), int(c)) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))], "a double, b double, y int")
    written, sizes = gbdt.written, []
    monkeypatch.setattr(gbdt, "written", lambda df, name: sizes.append((out := written(df, name)).count()) or out)
    models = []
    for groups in (gbdt.GROUPS, 0):
        monkeypatch.setattr(gbdt, "GROUPS", groups)
        models.append(gbdt.fit_gbdt(rows, ["a", "b"], "y", trees=7, depth=3, bins=8, monotone={"a": 1}))
    assert sizes[0] == sizes[1] <= 2 * 9 * 9 and sizes[2] == 1500
    for one, other in zip(*(m.trees for m in models), strict=True):
        assert [n[:5] for n in one] == [n[:5] for n in other] and np.allclose([n[5:] for n in one], [n[5:] for n in other])


def test_vectors_go_to_a_bounded_number_of_blocks(spark, tmp_path, monkeypatch):
    con = embeddings(tmp_path, [*range(400)])
    monkeypatch.setattr(reuse, "BLOCKS", 3)
    monkeypatch.setattr(reuse, "LEAST_ROWS", 20)
    monkeypatch.setattr(reuse, "PRODUCT", 1000)
    kept = []
    monkeypatch.setattr(reuse, "written", lambda df, name: kept.append(out := graph.written(df, name)) or out)
    got, want = plain(registry.QUERIES["vector_top20"](spark, str(tmp_path)).toPandas()), plain(con.execute(registry.ORACLE_SQL["vector_top20"]).df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False, atol=2e-6)
    assert kept[0].select("block").distinct().count() == 3


def test_ring_features_make_their_matches_once(spark, monkeypatch):
    names = []
    for module in (rings, graph):
        monkeypatch.setattr(module, "written", lambda df, name, write=graph.written: names.append(name) or write(df, name), raising=False)
    claims = spark.createDataFrame([(i, i % 3, i % 2, f"2025-01-0{i + 1}") for i in range(5)], "id long, claimant long, merchant long, ts string").selectExpr("id", "claimant", "merchant", "timestamp(ts) ts")
    got = {r.id: (r.in_ring, r.ring_size) for r in rings.ring_features(claims, spark.createDataFrame([(1, 0), (4, 1)], "q long, c long")).collect()}
    assert names[0] == "matches" and names.count("matches") == 1
    assert got == {0: (False, 0), 1: (True, 2), 2: (False, 0), 3: (False, 0), 4: (True, 3)}


def test_pairs_of_a_cascade_are_made_once(spark, tmp_path, monkeypatch):
    con = embeddings(tmp_path, [*range(120)])
    names = []
    for module in (cascade, registry):
        monkeypatch.setattr(module, "written", lambda df, name: names.append(name) or graph.written(df, name))
    for query in ("reuse_features", "cascade_stages"):
        got, want = plain(registry.QUERIES[query](spark, str(tmp_path)).toPandas()), plain(con.execute(registry.ORACLE_SQL[query]).df())
        pd.testing.assert_frame_equal(got, want, check_dtype=False, atol=2e-6)
    assert names == ["hashes", "similar"] * 2


def hashed(spark, n, times=None, text=False):
    """n claims with copies, in no order, and two of them without a hash or a time."""
    rng = np.random.default_rng(9)
    hashes = [int(h) for h in rng.integers(-(2**63), 2**63, size=n)]
    hashes[1::9] = hashes[: len(hashes[1::9])]
    rows = [(f"c{7919 * i % n}" if text else 7919 * i % n, dt.datetime(2026, 1, 1) + dt.timedelta(hours=i % (times or n)), h) for i, h in enumerate(hashes)]
    rows[n // 2], rows[n // 3] = (*rows[n // 2][:2], None), (rows[n // 3][0], None, rows[n // 3][2])
    return rows, spark.createDataFrame(rows, f"id {'string' if text else 'long'}, ts timestamp, phash long").repartition(5)


def banded(rows, earlier_only):
    """The pairs of rows that share a band, by a look at all of them."""
    out = []
    for q, t, h in rows:
        for c, u, g in rows:
            if None not in (h, g) and ((t and u and u < t) if earlier_only else c != q):
                x = (h ^ g) & (1 << 64) - 1
                if any(x >> 4 * k & 15 == 0 for k in range(16)):
                    out.append((q, c, x.bit_count()))
    return sorted(out)


def test_band_candidates_in_tiles_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(reuse, "HELD", 8)
    monkeypatch.setattr(reuse, "ASKING", 32)
    monkeypatch.setattr(reuse, "TILE_CELLS", 40)
    for most in (20_000, 7):
        monkeypatch.setattr(reuse, "MOST_TILES", most)
        for times, text, earlier_only in ((None, False, True), (11, True, True), (1, False, True), (11, True, False), (None, False, False)):
            rows, claims = hashed(spark, 150, times, text)
            found = reuse.band_candidates(claims, earlier_only)
            parts = [[tuple(r) for r in p] for p in found.rdd.glom().collect()]
            assert sorted(r for p in parts for r in p) == banded(rows, earlier_only)
            if most > 7:
                assert all(len({c for _, c, _ in p}) <= 8 and len({q for q, _, _ in p}) <= 32 for p in parts)
                assert all(a[2] <= b[2] for p in parts for a, b in zip(p, p[1:]) if a[0] == b[0])
    assert not reuse.band_candidates(claims.limit(0)).collect()


def test_band_candidates_take_little_room(spark, tmp_path):
    rows, claims = hashed(spark, 1500)
    reuse.band_candidates(claims).write.parquet(f"{tmp_path}/pairs")
    written = sum(os.path.getsize(f) for f in glob.glob(f"{tmp_path}/pairs/*.parquet"))
    pairs = spark.read.parquet(f"{tmp_path}/pairs").count()
    assert pairs > 600_000 and written < 1.5 * pairs
