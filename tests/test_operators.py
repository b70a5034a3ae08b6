import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from veritide.operators import audit, bootstrap, calibration, federated, forensics, gbdt, graph, identity, metrics, monitoring, policy, provenance, reuse, rings, risk, simulate
from veritide.plans import cascade

BASE = dt.datetime(2026, 1, 1)


def claims(spark, rows):
    return spark.createDataFrame([(i, BASE + dt.timedelta(days=d), c, m, h, v) for i, d, c, m, h, v in rows], "id long, ts timestamp, claimant string, merchant string, phash long, embedding array<double>")


def test_components_of_random_graphs(spark):
    rng = random.Random(2)
    for n, m in ((40, 20), (40, 45)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        root = list(range(n))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
        got = graph.connected_components(spark.range(n).toDF("node"), spark.createDataFrame(edges, "a long, b long")).collect()
        assert {r.node: r.component for r in got} == {i: find(i) for i in range(n)}


def test_transitive_identity(spark):
    rows = [("c1", "1", None, "", None), ("c2", "1", "e", "", None), ("c3", None, "e", "", None), ("c4", None, None, "flat 12 green road", "p"), ("c5", None, None, "green road", "p"), ("c6", None, None, "flat 13 green road", "q")]
    got = {r.id: r.entity for r in identity.resolve_identities(spark.createDataFrame(rows, "id string, phone string, email string, address string, pin string")).collect()}
    assert got == {"c1": "entity_c1", "c2": "entity_c1", "c3": "entity_c1", "c4": "entity_c4", "c5": "entity_c4", "c6": "entity_c6"}


def test_blocked_addresses_equal_all_pairs(spark):
    from veritide.functions.canonical import token_set_similarity

    rng = random.Random(7)
    rows = [(i, f"flat {rng.randint(1, 6)} lake road" if rng.random() < 0.7 else rng.choice(["lake road", "hill road north"]), str(rng.randint(0, 1))) for i in range(60)]
    want = set()
    for i, a, p in rows:
        for j, b, q in rows:
            na, nb = ({t for t in x.split() if t.isdigit()} for x in (a, b))
            if i < j and p == q and (not na or not nb or na & nb) and token_set_similarity(a, b) >= 85:
                want.add((i, j))
    got = {(r.a, r.b) for r in identity.address_pairs(spark.createDataFrame(rows, "id long, address string, pin string")).collect()}
    assert got == want
    root = {i: i for i, *_ in rows}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for edges in (want, {(r.a, r.b) for r in identity.address_edges(spark.createDataFrame(rows, "id long, address string, pin string")).collect()}):
        for i, j in edges:
            x, y = sorted((top(i), top(j)))
            root[y] = x
        if edges is want:
            by_pairs, root = {i: top(i) for i in root}, {i: i for i in root}
    assert {i: top(i) for i in root} == by_pairs


def test_reuse_is_strictly_earlier(spark):
    h = 0x2BCD123456789F01
    df = claims(spark, [(1, 0, "a", "m", h, [1.0, 0.0]), (2, 1, "b", "m", h, [1.0, 0.0]), (3, 1, "c", "n", h ^ 3, [0.0, 1.0]), (4, 5, "a", "m", ~h, [1.0, 0.0])])
    pairs = reuse.near_hash_pairs(df, 10)
    assert {(r.q, r.c, r.hamming) for r in pairs.collect()} == {(2, 1, 0), (3, 1, 2)}
    f = {r.id: r for r in reuse.reuse_features(df, pairs, reuse.similar_vectors(df), 10, 0.9).collect()}
    assert (f[1].n_matches, f[1].min_hamming, f[1].matched_prior_claim) == (0, 64, False)
    assert (f[2].n_matches, f[2].n_distinct_claimants, f[2].max_clip, f[2].best_clip, f[2].days_since_first_seen) == (1, 1, 0.0, 1.0, 1)
    assert (f[4].n_matches, f[4].min_hamming, f[4].n_distinct_claimants, f[4].max_clip) == (2, 64, 1, 1.0)
    leak = {r.variant: r.match_rate for r in reuse.leak_control(df.withColumn("label", F.lit(0)), 10).collect()}
    assert leak == {"honest": 0.5, "leaky": 0.75}


def test_band_candidates_equal_all_pairs(spark):
    rng = random.Random(3)
    rows = [(i, i // 3, "a", "m", rng.getrandbits(63), [1.0]) for i in range(40)]
    want = set()
    for i, d, *_, h, _ in rows:
        for j, e, *_, g, _ in rows:
            if e < d and any(h >> 4 * k & 15 == g >> 4 * k & 15 for k in range(16)):
                want.add((i, j, (h ^ g).bit_count()))
    assert {(r.q, r.c, r.hamming) for r in reuse.band_candidates(claims(spark, rows)).collect()} == want


def test_rings_as_seen_at_claim_time(spark):
    df = claims(spark, [(1, 0, "victim", "m", 0, None), (2, 1, "attacker", "n", 0, None), (3, 2, "victim", "m", 0, None), (4, 3, "x", "m", 0, None), (5, 4, "x", "m", 0, None)])
    matches = spark.createDataFrame([(2, 1), (3, 1), (5, 4)], "q long, c long")
    got = {r.id: r for r in rings.ring_features(df, matches).collect()}
    assert got[1].is_first_seen and not got[1].in_ring and got[2].in_ring and (got[2].ring_size, got[2].ring_claimants, got[2].ring_merchants) == (2, 2, 2)
    assert got[3].is_first_seen and not got[3].in_ring and got[5].is_first_seen and not got[5].in_ring
    assert [r.claimants for r in rings.ring_clusters(df, matches).collect()] == [2]


def test_p_values_and_power():
    assert risk.hb_p_value(0, 75, 0.03) > 0.10 >= risk.hb_p_value(0, 76, 0.03)
    assert risk.hb_p_value(0.5, 10, 0.1) == 1.0
    with pytest.raises(ValueError):
        risk.hb_p_value(0.1, 0, 0.1)
    for alpha, share, n in ((0.03, 0, 76), (0.03, 0.3, 222), (0.03, 0.5, 489), (0.05, 0, 45), (0.05, 0.3, 131), (0.10, 0.3, 64), (0.10, 0.5, 134)):
        assert risk.min_n_for_rate(alpha, 0.10, share * alpha) == n


def test_certificates(spark):
    rng = np.random.default_rng(1)
    y = (rng.random(6000) < 0.15).astype(int)
    p = np.where(y == 1, rng.uniform(0.85, 1, 6000), np.where(rng.random(6000) < 0.004, rng.uniform(0.85, 1, 6000), rng.uniform(0, 0.3, 6000)))
    good = spark.createDataFrame(pd.DataFrame({"p": p, "y": y}))
    rows = risk.certify_thresholds(good, "p", "y", 0.10, 0.10).collect()
    assert any(r.certified for r in rows) and all(r.n_denied >= 64 for r in rows if not r.skipped)
    bad = spark.createDataFrame(pd.DataFrame({"p": rng.random(4000), "y": y[:4000]}))
    assert not any(r.certified for r in risk.walk_ladder(bad, "p", "y").collect())


def test_policy_costs_and_ties(spark):
    c = policy.Costs()
    df = spark.createDataFrame([(0.0, 1000.0), (1.0, 1000.0), (0.5, 1000.0), (0.02, 100.0)], "p double, v double")
    assert [r.a for r in df.select(c.optimal_action(F.col("p"), F.col("v")).alias("a")).collect()] == ["APPROVE", "DENY", "REVIEW", "APPROVE"]
    assert c.crossover_value() is None and c.churn == 1050.0
    both = df.select(policy.decide(F.col("p"), 0.6, 0.5).alias("a")).collect()
    assert [r.a for r in both] == ["APPROVE", "DENY", "DENY", "APPROVE"]
    none = policy.select_policy(df.withColumn("y", F.lit(0)), "p", "y", "v", []).collect()[0]
    assert none.t_deny == 1.01 and not none.certified and none.uncertified_cost_per_1000 <= none.cost_per_1000


def test_off_policy_checks_propensities(spark):
    df = spark.createDataFrame([("APPROVE", 0.0, -1.0, 1.0, 0.0)], "a string, prop double, r double, t1 double, t2 double")
    with pytest.raises(Exception, match="propensity"):
        policy.doubly_robust(df.withColumn("q", F.lit(0.0)), "r", "a", "prop", {"APPROVE": "q", "DENY": "q"}, {"APPROVE": "t1", "DENY": "t2"}).collect()


def test_equal_mass_bins(spark):
    rows = spark.createDataFrame([(i, float(i % 4)) for i in range(11)], "id long, p double")
    got = metrics.equal_mass_bins(rows, "p", "id", 4)
    assert [r["count"] for r in got.groupBy("bin").count().orderBy("bin").collect()] == [3, 3, 3, 2]
    assert metrics.equal_mass_bins(rows.limit(3), "p", "id", 4).agg(F.max("bin")).collect()[0][0] == 3
    assert [r.r for r in metrics.global_rank(rows, ["p", "id"], "r").orderBy("p", "id").collect()] == list(range(11))


def test_drift_of_a_constant_and_of_odd_values(spark):
    a = spark.createDataFrame([("k", 1.0)] * 20 + [("k", float("nan"))], "feature string, x double")
    assert metrics.population_stability(a, a).collect()[0].psi == 0.0
    assert metrics.ks_statistic(a, a).collect()[0].ks == 0.0


def test_isotonic_cells(spark):
    rng = np.random.default_rng(4)
    p = rng.random(3000).round(3)
    df = spark.createDataFrame(pd.DataFrame({"p": p, "y": (rng.random(3000) < p**2).astype(int), "g": np.where(rng.random(3000) < 0.01, "thin", np.where(rng.random(3000) < 0.5, "a", "b"))}))
    cells = calibration.fit_cells(df, "p", "y", "g")
    assert None in {r.cell for r in cells.collect()}
    got = calibration.calibrate(df, cells, "p", "g").toPandas()
    assert got["calibrated"].between(0, 1).all() and abs(got["calibrated"].mean() - got["y"].mean()) < 0.02
    one = got[got["g"] == "a"].sort_values("p")["calibrated"].to_numpy()
    assert (np.diff(one) >= -1e-9).all()
    xs, ys = calibration.pool(np.array([1.0, 2, 3]), np.array([1.0, 0, 2]), np.ones(3))
    assert xs == [1.0, 2.0, 3.0] and ys == [0.5, 0.5, 2.0]


def test_watchdog_raises_its_threshold(spark):
    df = spark.createDataFrame([(b, 0.95, int(i >= 30)) for b in range(2) for i in range(100)] + [(9, 0.95, 1)] * 5, "b int, p double, y int")
    got = monitoring.watchdog(df, "b", "p", "y", 0.9, 0.1).orderBy("batch").collect()
    assert [(r.breached, round(r.t_deny, 2), r.action) for r in got] == [(True, 0.9, "raise threshold"), (True, 0.92, "raise threshold"), (False, 0.94, "no action")]
    assert got[2].realised_fdr is None or math.isnan(got[2].realised_fdr)


def test_rate_limit_counts_accepted_posts_only(spark):
    df = spark.createDataFrame([(i, "m", BASE + dt.timedelta(hours=i)) for i in range(30)], "id long, merchant string, ts timestamp")
    assert [r.id for r in federated.rate_limited(df, 5).where("accepted").orderBy("id").collect()] == [0, 1, 2, 3, 4, 24, 25, 26, 27, 28]


def test_federated_suppression_order(spark):
    rows = [(1, 5, "victim", "m1", BASE), (2, 5, "other", "m2", BASE + dt.timedelta(days=1)), (3, 77, "x", "m1", BASE)]
    posts = spark.createDataFrame(rows, "id long, phash long, identity_group string, merchant string, ts timestamp")
    asks = spark.createDataFrame([(1, 5, "victim"), (2, 5, "new"), (3, 77, "y"), (4, 123456789, "z")], "id long, phash long, identity_group string")
    as_of = F.unix_micros(F.lit("2026-06-30 00:00:00").cast("timestamp"))
    ev = federated.cluster_evidence(posts, b"k")
    got = {r.id: r for r in federated.query_index(asks, ev, federated.published_bands(posts, b"k"), b"k", as_of).collect()}
    assert [got[i].suppression_reason for i in (1, 2, 3, 4)] == ["first_seen", "", "not_independent", "no_cluster"]
    assert abs(got[2].decayed_weight - 0.5 ** (179 / 180)) < 1e-9 and got[1].decayed_weight == 0
    assert federated.prune(ev, as_of).count() == 2


def test_hash_chain_shows_edits(spark):
    chain = federated.hash_chain(spark.createDataFrame([("a", i, f"p{i}") for i in range(5)], "log string, seq long, payload string"), b"k")
    assert federated.verify_chain(chain, b"k").collect()[0].valid
    assert not federated.verify_chain(chain.withColumn("payload", F.when(F.col("seq") == 2, "edited").otherwise(F.col("payload"))), b"k").collect()[0].valid
    assert not federated.verify_chain(chain.where("seq <> 1"), b"k").collect()[0].valid


def test_cuckoo_filter():
    f = federated.CuckooFilter(1024)
    items = [str(i).encode() for i in range(600)]
    for x in items:
        f.insert(x)
    assert all(map(f.contains, items)) and f.delete(items[0]) and not f.delete(b"never") and f.n_items == 599 and 0 < f.load_factor < 1
    with pytest.raises(ValueError):
        federated.CuckooFilter(1000)
    small = federated.CuckooFilter(4)
    with pytest.raises(OverflowError):
        for x in items:
            small.insert(x)


def test_reason_codes_and_records(spark):
    df = spark.createDataFrame([({"reuse_matched_prior_claim": 0.2, "ring_distinct_claimants": 0.3, "unknown": 0.9, "behaviour_n_prior_claims_30d": 0.001, "reuse_n_distinct_claimants_sharing": 0.1}, {"reuse_min_hamming": 2.0, "ring_distinct_claimants": 3.0})], "s map<string,double>, v map<string,double>")
    got = df.select(audit.reason_codes(F.col("s"), F.col("v")).alias("r")).collect()[0].r
    assert [(r.code, r.shap) for r in got] == [("RING_MEMBERSHIP", 0.3), ("REUSE_PRIOR_CLAIM", 0.2), ("REUSE_MULTI_CLAIMANT", 0.1)]
    assert got[0].text == "Ring membership" and "distance 2)" in got[1].text and got[2].text == "Reuse multi claimant"
    rec = spark.createDataFrame([("c", 0.94125)], "id string, p double").withColumn("j", audit.canonical_json(id=F.col("id"), p_hat=F.bround("p", 4), none=F.lit(None).cast("string"))).collect()[0].j
    assert rec == '{"id":"c","none":null,"p_hat":0.9412}'


def test_provenance(spark):
    rows = [None, "", "{", '{"active_manifest":"a","manifests":{"a":{"assertions":[{"l":"c2pa.captured"},{}]}}}', '{"x":"TrainedAlgorithmicMedia"}', "{}"]
    got = [r.s.asDict() for r in spark.createDataFrame([(r,) for r in rows], "m string").select(provenance.provenance(F.col("m")).alias("s")).collect()]
    assert [g["status"] for g in got] == ["UNKNOWN", "UNKNOWN", "INVALID", "VALID_CAMERA", "VALID_AI_GENERATED", "UNKNOWN"]
    assert [g["n_assertions"] for g in got] == [0, 0, 0, 2, 0, 0] and got[2]["has_manifest"] == 1 and got[2]["manifest_valid"] == 0


def test_split_guards(spark):
    rows = spark.createDataFrame([(1, "train", BASE, "g1", "A"), (2, "test", BASE + dt.timedelta(1), "g1", "B"), (3, "train", BASE + dt.timedelta(2), None, None)], "id long, split string, ts timestamp, g string, fam string")
    assert [r.g for r in identity.group_violations(rows, "g").collect()] == ["g1"] and identity.temporal_violations(rows, ["train", "test"]).count() == 1
    assert identity.holdout_violations(rows, "fam", spark.createDataFrame([("train", "A")], "split string, fam string")).count() == 1
    got = {r.id: (r.kept_split, r.dropped) for r in identity.reconcile_splits(rows, spark.createDataFrame([(1, 2)], "a long, b long")).collect()}
    assert got == {1: ("train", False), 2: ("train", True), 3: ("train", False)}
    with pytest.raises(gbdt.SplitDisciplineError):
        gbdt.check_split(rows)


def test_boosted_trees(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 3))
    y = (rng.random(1500) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(int)
    x[rng.random(1500) < 0.1, 1] = np.nan
    df = spark.createDataFrame(pd.DataFrame({"a_up": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y}))
    model = gbdt.fit_gbdt(df, ["a_up", "b", "c"], "y", trees=6, depth=3, monotone={"a_up": 1})
    again = gbdt.Gbdt.from_json(model.to_json())
    p = again.predict(df).toPandas()["p"].to_numpy()
    assert np.mean((p > 0.5) == y) > 0.7 and max(gbdt.gain_by_prefix(model), key=gbdt.gain_by_prefix(model).get) == "a"
    line = np.column_stack([np.linspace(-3, 3, 50), np.zeros(50), np.zeros(50)])
    assert (np.diff(model.margin(line)) >= -1e-12).all()
    row = x[0]
    assert abs(model.contributions(row).sum() + model.expected() - model.margin(row[None])[0]) < 1e-9


def test_bootstrap(spark):
    df = spark.createDataFrame([(i, float(i % 2), i % 2) for i in range(400)], "id long, x double, y int")
    r = bootstrap.bootstrap_means(df, "x", "id", 100).collect()[0]
    assert r.low < 0.5 < r.high and r.high - r.low < 0.2 and r.estimate == 0.5
    got = bootstrap.bootstrap_ranking(df, "x", "y", "id", 20).collect()[0]
    assert got.estimate == 1.0 and got.low == 1.0 and got.resamples == 20
    mixed = bootstrap.shuffled_labels(df, "y", "id").toPandas()
    assert mixed["y"].sum() == 200 and 0.3 < (mixed["y"] == mixed["x"]).mean() < 0.7


def test_ledger(spark):
    df = simulate.simulate_ledger(spark, 600)
    assert df.count() == 600 and df.select("claim_id").distinct().count() == 600
    assert identity.temporal_violations(df.withColumnRenamed("claim_timestamp", "ts"), ["train", "calibration", "test"]).count() == 0
    assert identity.group_violations(df, "image_group_id").count() == 0 and df.where("order_date >= claim_timestamp").count() == 0
    assert df.exceptAll(simulate.simulate_ledger(spark, 600)).count() == 0


def test_image_features(spark):
    g = (np.add.outer(np.arange(64), np.arange(64)) % 256).astype(np.uint8)
    dqt = b"\xff\xd8\xff\xdb\x00\x43\x00" + bytes(forensics.LUMA[i] for i in forensics._ZIGZAG) + b"\xff\xda"
    assert forensics._ZIGZAG[:10] == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and sorted(forensics._ZIGZAG) == list(range(64))
    assert forensics.quantisation_tables(dqt) == [forensics.LUMA] and forensics.estimated_quality(forensics.LUMA) == 50.0
    df = spark.createDataFrame([("a", dqt, 64, 64, g.tobytes()), ("b", None, 64, 64, (255 - g).tobytes())], "claim_id string, content binary, width int, height int, pixels binary")
    got = {r.claim_id: r for r in forensics.image_features(df).collect()}
    assert got["a"].n_quant_tables == 1 and got["b"].n_quant_tables == 0 and bin((got["a"].phash ^ got["b"].phash) & (1 << 64) - 1).count("1") > 20
    assert forensics.blockiness(np.zeros((10, 10))) == 0.0
    blocks = np.kron(np.arange(64).reshape(8, 8) * 3.0, np.ones((8, 8)))
    assert forensics.blockiness(blocks) == 0.0 and forensics.blockiness(blocks + np.arange(64) * 0.1) > 10  # without any step inside there is nothing to compare with


def test_cascade_keeps_nan_apart_from_zero(spark):
    df = claims(spark, [(1, 0, "a", "m", 5, [1.0, 0.0]), (2, 1, "b", "m", 5, [1.0, 0.0]), (3, 2, "c", "m", 5, [1.0, 0.0])])
    early = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 1.0, 0.0), (2, 1.0, 0.0, 5.0, 9.0, 5.0), (3, 0.0, 0.0, 0.0, 1.0, 0.0)], "id long, declares_ai_generation double, declares_camera_capture double, n_prior_claims double, value_vs_prior_mean double, n_prior_claims_30d double")
    got = {r.id: r for r in cascade.run_cascade(df, early, None).collect()}
    assert got[2].exit_stage == 1 and math.isnan(got[2].n_matches) and got[1].n_matches == 0 and got[3].n_matches == 2
    seen = cascade.adjudicate(df, lambda x: x.withColumn("p", F.lit(0.99)), 0.02, 0.9, False)
    assert seen.columns == ["id", "action"] and {r.action for r in seen.collect()} == {"REVIEW"}


def test_registered_sql_functions(spark):
    from veritide.functions.register import register_functions

    assert "hamming64" in register_functions(spark)
    r = spark.sql("SELECT hamming64(5, 6) a, lsh_bands(255)[1] b, pin_key('56 0001') c, policy_decide(0.9, 0.1, 0.8) d, token_set_ratio('a b', 'b a') e, hb_pvalue(0.0D, 76L, 0.03D) f").collect()[0]
    assert (r.a, r.b, r.c, r.d, r.e) == (2, 15, "560001", "DENY", 100.0) and r.f <= 0.1


def test_shift_matrix(spark):
    rows = [("good", 0.9, 1)] * 200 + [("bad", 0.7, 0)] * 100 + [("bad", 0.9, 1)] * 200 + [("none", 0.1, 0)] * 5
    got = {r.c: r for r in risk.shift_matrix(spark.createDataFrame(rows, "c string, p double, y int"), "p", "y", "c", 0.6, 0.1, 0.1).collect()}
    assert got["good"].holds and not got["bad"].holds and got["bad"].recoverable and got["none"].holds and not got["none"].recertified
