"""Models, jobs and what surrounds them: seals, power, attributions, fusion, ablations, baselines, intervals, images, corpus building."""

import datetime as dt
import itertools
import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from veritide.functions import pixels
from veritide.operators import ablations, baselines, bench, bootstrap, federated, forensics, fusion, gbdt, identity, policy, risk, seal, simulate
from veritide.plans import jobs
from veritide.sources import config
from veritide.sources import corpus as corpus_source


def split(spark, rows):
    return spark.createDataFrame(rows, "claim_id string, label int, image_sha256 string")


ROWS = [("b", 0, "s2"), ("a", 1, "s1"), ("c", 0, "s3")]


def test_seals(spark, tmp_path):
    root = str(tmp_path)
    assert seal.read_seal(root, "dev") is None and seal.well_formed(root, "dev") == []
    with pytest.raises(seal.CalibrationSealBroken, match="never"):
        seal.verify_seal(split(spark, ROWS), root, "dev")
    first = seal.write_seal(split(spark, ROWS), root, "dev")
    assert (first.n_claims, first.n_fraud) == (3, 1) and seal.well_formed(root, "dev") == []
    again = seal.write_seal(split(spark, ROWS[::-1]).repartition(3), root, "dev")
    assert again == first == seal.verify_seal(split(spark, ROWS), root, "dev") == seal.read_seal(root, "dev")
    for changed in (ROWS[:2], [("b", 1, "s2"), *ROWS[1:]], [("b", 0, "other"), *ROWS[1:]]):
        with pytest.raises(seal.CalibrationSealBroken):
            seal.verify_seal(split(spark, changed), root, "dev")
        with pytest.raises(seal.CalibrationSealBroken):
            seal.write_seal(split(spark, changed), root, "dev")
    assert seal.write_seal(split(spark, ROWS[:2]), root, "dev", overwrite=True).n_claims == 2
    (tmp_path / "dev" / seal.FILE).write_text(json.dumps({"tier": "x", "n_claims": 1, "n_fraud": 2, "content_sha256": "z", "sealed_at": "never"}))
    assert len(seal.well_formed(root, "dev")) == 4


def test_power_analysis(spark):
    assert [risk.min_n_for_rate(a, 0.1, f * a) for a in (0.03, 0.05, 0.10) for f in (0, 0.3, 0.5)] == [76, 222, 489, 45, 131, 288, 30, 64, 134]
    assert risk.min_n_for_rate(0.1, 0.1, 0.1) is None and risk.min_n_for_rate(0.1, 0.1, 0.2) is None and risk.min_n_for_rate(0.03, 0.1, 0.0299, most=1_000) is None
    for n in range(489, 900):
        assert risk.hb_p_value(0.015, n, 0.03) <= 0.1
    assert risk.hb_p_value(0.015, 488, 0.03) > 0.1
    sizes = risk.corpus_sizes(spark, fraction=0.5, practical=35_000).collect()
    assert [(r.min_denied, r.test_claims, r.all_claims, r.chosen) for r in sizes] == [(489, 6113, 30565, True)]
    assert [r.chosen for r in risk.corpus_sizes(spark, practical=10).collect()] == [False, False, False, True]
    assert risk.power_report(spark)["primary"]["rung"] == 0
    exact = lambda k, n, p: sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
    assert all(abs(risk.binomial_cdf(k, n, p) - exact(k, n, p)) < 1e-12 for n in (1, 7, 40) for k in range(n) for p in (0.02, 0.5, 0.9))


def test_attributions_are_shapley_values(spark):
    """Held against the sum over all coalitions, where absent features follow the training rows down both sides."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(800, 3))
    x[rng.random((800, 3)) < 0.1] = np.nan
    y = (np.nan_to_num(x[:, 0]) * np.nan_to_num(x[:, 1]) + rng.normal(size=800) > 0).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y}))
    model = gbdt.fit_gbdt(df, ["a", "b", "c"], "y", trees=4, depth=4, least=10, leaves=9, monotone={}, margins_every=2)
    assert all(sum(n[0] < 0 for n in t) <= 9 for t in model.trees) and max(len(t) for t in model.trees) > 9

    def value(nodes, row, known, at=0):
        f, cut, missing, left, right, v, _ = nodes[at]
        if f < 0:
            return v
        if f in known:
            return value(nodes, row, known, left if (missing if math.isnan(row[f]) else row[f] <= cut) else right)
        a, b = nodes[left][6], nodes[right][6]
        return (a * value(nodes, row, known, left) + b * value(nodes, row, known, right)) / (a + b)

    got = model.attributions(x[:15])
    for i in range(15):
        for f in range(3):
            want, others = 0.0, [g for g in range(3) if g != f]
            for size in range(3):
                for s in itertools.combinations(others, size):
                    w = math.factorial(size) * math.factorial(2 - size) / 6
                    want += w * sum(value(t, x[i], {*s, f}) - value(t, x[i], set(s)) for t in model.trees)
            assert abs(got[i, f] - want) < 1e-9
    mapped = model.explain(df.limit(3)).collect()
    assert all(abs(sum(r.shap.values()) + model.expected() - model.margin(np.array([[np.nan if v is None else v for v in (r.a, r.b, r.c)]]))[0]) < 1e-9 for r in mapped)


def corpus(spark, n=600):
    rng = np.random.default_rng(8)
    y = (rng.random(n) < 0.3).astype(int)
    frame = {"claim_id": [f"c{i}" for i in range(n)], "label": y, "group": np.where(np.arange(n) % 2, "g|a", "g|b"), "value": rng.integers(100, 3000, n), "source_dataset": np.where(np.arange(n) % 3, "ABO", "GenImage v1")}
    frame |= {"ts": pd.Timestamp("2025-01-01") + pd.to_timedelta(np.arange(n), "h")}
    for c, w in (("reuse_n_matches", 1.6), ("forensics_a", 0.0), ("behaviour_b", 0.7), ("ring_c", 0.0), ("provenance_d", 0.0)):
        frame[c] = y * w + rng.normal(size=n)
    return spark.createDataFrame(pd.DataFrame(frame))


FEATURES = ["reuse_n_matches", "forensics_a", "behaviour_b", "ring_c", "provenance_d"]
SMALL = fusion.FusionConfig(trees=3, folds=2, depth=2, rate=0.3)


def test_fusion_jobs(spark, tmp_path):
    rows = corpus(spark).cache()
    model = jobs.train(rows, FEATURES, str(tmp_path / "m"), SMALL)
    assert model.report["n_train"] == 600 and model.report["oof_brier_calibrated"] <= model.report["oof_brier_uncalibrated"] + 0.02 and model.report["calibrator_cells"] == ["g|a", "g|b"]
    again = fusion.FusionModel.load(spark, str(tmp_path / "m"))
    pick = lambda m: [(r.claim_id, round(r.calibrated, 12)) for r in m.predict(rows).orderBy("claim_id").collect()]
    assert pick(model) == pick(again) and max(again.feature_importance(), key=again.feature_importance().get) == "reuse_n_matches"
    with pytest.raises(fusion.ModelNotTrainedError):
        fusion.FusionModel.load(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError, match="missing"):
        model.predict(rows.drop("ring_c"))
    with pytest.raises(ValueError, match="unknown"):
        fusion.validate_schema(["a"], {"b": 1})
    with pytest.raises(ValueError, match="both"):
        fusion.fit_fusion(rows.where("label = 1"), FEATURES, config=SMALL)
    with pytest.raises(gbdt.SplitDisciplineError):
        fusion.fit_fusion(rows.withColumn("split", F.lit("test")), FEATURES, split="split", config=SMALL)
    assert {r.name: r.direction for r in fusion.constraint_table(spark, FEATURES).collect()}["reuse_n_matches"] == 1
    scored = model.oof.withColumnRenamed("oof", "p").drop("label", "group").join(rows, "claim_id").withColumn("image_sha256", F.col("claim_id"))
    made = jobs.certify(scored, "dev", str(tmp_path), ladder=[(0.03, 0.1), (0.6, 0.2)])
    assert made["n_calibration"] == 600 and "certificate of dev" in jobs.summarise_certificate(made) and (tmp_path / "dev" / "certificate.json").exists()
    with pytest.raises(seal.CalibrationSealBroken):
        jobs.certify(scored.limit(10), "dev", str(tmp_path))
    with pytest.raises(ValueError, match="no rows"):
        jobs.certify(scored.limit(0), "dev")
    found = jobs.evaluate(scored, "dev", str(tmp_path), FEATURES, resamples=30, config=SMALL)
    assert found["n_claims"] == 600 and [b["name"] for b in found["baselines"]] == [n for n, *_ in baselines.BASELINES if n != "rules_engine"] and len(found["policy"]["candidates"]) == 20 and "evaluation of dev" in jobs.summarise_metrics(found)
    assert found["pr_auc"]["ci_lower"] <= found["pr_auc"]["point"] <= found["pr_auc"]["ci_upper"] and json.loads((tmp_path / "dev" / "metrics.json").read_text())["n_claims"] == 600
    assert found["cost"]["baselines_per_1000"]["review_all"] == 40_000


def test_ablations_and_controls(spark):
    rows = corpus(spark, 300).cache()
    got = {(r.name, r.subset): r for r in ablations.run_ablations(rows, FEATURES[:2] + ["behaviour_b", "ring_c", "provenance_d"], None, fusion.FusionConfig(trees=2, folds=2, depth=1, rate=0.3)).collect()}
    assert set(got) == {(n, "all") for n in ablations.FAMILIES} and got["full", "all"].delta_pr_auc == 0 and got["no_reuse", "all"].delta_pr_auc < 0
    assert rows.where(ablations.source_controlled()).count() == 200
    conf = {r.name: r for r in ablations.run_configuration_ablations(rows, FEATURES, fusion.FusionConfig(trees=2, folds=2, depth=1, rate=0.3)).collect()}
    assert conf["no_calibration"].pr_auc == conf["full"].pr_auc
    for r in ablations.run_controls(rows, FEATURES, 0.8, fusion.FusionConfig(trees=2, folds=2, depth=1, rate=0.3), tolerance=0.2).collect():
        assert r.passed and abs(r.prevalence - 0.3) < 0.1


def test_probe_is_at_the_optimum(spark):
    rows = corpus(spark).select("label", "behaviour_b", F.when(F.col("reuse_n_matches") > 2, F.lit(float("nan"))).otherwise(F.col("reuse_n_matches") * 100).alias("behaviour_c"))
    probe = baselines.fit_probe(rows, "behaviour_")
    pdf = rows.toPandas().fillna(0.0)
    x, y = pdf[probe.columns].to_numpy(float), pdf["label"].to_numpy()
    p = 1 / (1 + np.exp(-(x @ probe.weights + probe.intercept)))
    assert abs((p - y).sum()) < 1e-5 and np.abs(x.T @ (p - y) + np.array(probe.weights)).max() < 1e-4
    assert np.allclose(sorted(p), sorted(r.s for r in rows.select(probe.score().alias("s")).collect()))
    with pytest.raises(ValueError, match="no features"):
        baselines.fit_probe(rows, "nothing_")


def test_intervals(spark):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 300)
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(300), "y": y, "good": y + rng.normal(size=300) * 0.5, "bad": rng.normal(size=300), "v": rng.normal(size=300)}))
    good, bad = bootstrap.ranking_interval(df, "good", "y", 200), bootstrap.ranking_interval(df, "bad", "y", 200)
    assert good.low > bad.high and not good.overlaps(bad) and 0 < good.width < 0.2
    gap = bootstrap.difference_interval(df, "good", "bad", "y", "id", 200)
    assert gap.low > 0 and abs(gap.point - (good.point - bad.point)) < 1e-12 and bootstrap.difference_interval(df, "good", "good", "y", "id", 50).width == 0
    mean = bootstrap.mean_interval(df, "v", 500)
    assert mean.low < mean.point < mean.high and abs(mean.width - 2 * 1.96 / math.sqrt(300)) < 0.06
    assert bootstrap.ranking_interval(df.limit(0), "good", "y", 10).resamples == 0


def test_forensics_follow_compression():
    rng = np.random.default_rng(4)
    smooth = pixels.resize(rng.integers(0, 256, (12, 12, 3)).astype(np.uint8), 96, 80)
    noisy = pixels.eight_bit(smooth + rng.normal(size=smooth.shape) * 12)
    levels = [forensics.error_levels(pixels.recompressed(noisy, q))[0] for q in (30, 60, 95)]
    assert levels[0] < levels[2] and forensics.error_levels(noisy)[0] > levels[0]
    grey = lambda x: x.astype(float).mean(axis=2)
    assert forensics.blockiness(grey(pixels.recompressed(noisy, 10))) > forensics.blockiness(grey(noisy))
    base = forensics.perceptual_hash(pixels.luminance(noisy))
    apart = lambda x: bin((forensics.perceptual_hash(pixels.luminance(x)) ^ base) & (1 << 64) - 1).count("1")
    assert all(apart(f(noisy)) <= 24 for f in pixels.SHIFTS.values()) and apart(pixels.recompressed(noisy, 60)) <= 4
    u = np.full(7, 0.5)
    assert max(pixels.transported(noisy, u).shape) == 512 and pixels.rephotographed(noisy, u).shape == noisy.shape and pixels.recycled(noisy, u).ndim == 3
    image, thumb = pixels.edited(noisy, u)
    assert forensics.thumbnail_mismatch(image, thumb) > forensics.thumbnail_mismatch(noisy, thumb)
    assert len(forensics.describe(None, noisy)) == len(forensics.NAMES) == 14 and forensics.describe(None, noisy[:3, :3])[-1] == 0


def test_sources_are_drawn_without_replacement(spark):
    claims = [(f"c{i}", f"c{i}", "legit" if i % 3 else bench.SYNTHETIC, None if i % 3 else "FA") for i in range(30)] + [("r1", "c1", "ring", None), ("r2", "gone", "ring", None), ("r3", "gone", "ring", None)]
    df = spark.createDataFrame(claims, "claim_id string, image_group_id string, fraud_class string, generator_family string")
    shared, made = (spark.createDataFrame([(f"{k}{i}", "FA") for i in range(25)], "sha256 string, family string") for k in ("s", "m"))
    got = {r.claim_id: r.source_sha256 for r in bench.assign_sources(df, shared, made).collect()}
    assert len(got) == 33 and got["r1"] == got["c1"] and got["r2"] == got["r3"] and len(set(got.values())) == 31
    assert all(v.startswith("m") == (int(k[1:]) % 3 == 0) for k, v in got.items() if k[0] == "c")
    for a, b in ((shared.limit(5), made), (shared, made.limit(3))):
        with pytest.raises(bench.BenchBuildError):
            bench.assign_sources(df, a, b)
    assert bench.manifest(df).columns[-1] == "transform"


def test_policy_words():
    assert "review between" in policy.describe_policy(0.1, 0.9) and "nothing" in policy.describe_policy(0.9, 0.5)


def test_configurations(tmp_path):
    text = "# risk\nalpha_delta_ladder:\n  - alpha: 0.03\n    delta: 0.1   # first\n  - {x}\ntiers:\n  dev:\n    n: 3_000\n    on: true\n  names: [a, 'b c', 1.5]\nnone:\n".replace("  - {x}\n", "  - alpha: 0.05\n    delta: 0.1\n")
    (tmp_path / "c.yaml").write_text(text)
    got = config.load(str(tmp_path / "c.yaml"))
    assert got["tiers"] == {"dev": {"n": 3000, "on": True}, "names": ["a", "b c", 1.5]} and got["none"] is None
    assert config.ladder_of(got) == [(0.03, 0.1), (0.05, 0.1)] and config.parse('{"a": [1]}') == {"a": [1]} and config.parse("") == {}
    assert corpus_source.is_injected("<!-- m:begin -->\nx\n<!-- m:end -->", "m", "x") and not corpus_source.is_injected("<!-- m:begin -->y<!-- m:end -->", "m", "x")


def test_split_report_and_identities(spark):
    rows = spark.createDataFrame([("a", "train", 1, "e1", "g1", "F"), ("b", "test", 2, "e1", "g2", "H"), ("c", "test", 3, None, None, None)], "id string, split string, ts long, entity string, image_group_id string, generator_family string")
    report = {r.check: (r.violations, r.passed) for r in identity.verify_splits(rows, ["train", "test"], spark.createDataFrame([("train", "F")], "split string, generator_family string")).collect()}
    assert report == {"holdout": (1, False), "temporal": (0, True), "entity": (1, False), "group": (0, True)}
    merged = identity.reconcile_splits(rows.withColumnRenamed("entity", "who"), spark.createDataFrame([("a", "b")], "a string, b string"))
    assert sorted(r.id for r in identity.without_dropped(rows, merged).collect()) == ["a", "c"]
    named = identity.register_identities(rows.withColumn("claimant", F.concat(F.lit("raw"), "id")), spark.createDataFrame([("a", "entity_a")], "id string, entity string"))
    assert {r.id: r.identity for r in named.collect()} == {"a": "entity_a", "b": "rawb", "c": "rawc"}


def test_published_index(spark):
    rows = [(f"p{i}", 5 + i % 2, f"g{i % 3}", f"m{i % 2}", dt.datetime(2025, 1, 1) + dt.timedelta(hours=i)) for i in range(60)]
    posts = spark.createDataFrame(rows, "id string, phash long, identity_group string, merchant string, ts timestamp")
    judged, evidence, bands = federated.publish(posts, b"k", 5)
    assert judged.where("accepted").count() == 2 * 15  # 5 of the 12 posts of a merchant in each of 2.5 days
    stats = federated.index_stats(judged, evidence, bands, 3, 0.5).collect()[0]
    assert stats.n_accepted + stats.n_rejected == 60 and stats.n_clusters == 2 and stats.epsilon_spent == 1.5
    filt = federated.CuckooFilter(64)
    filt.insert(b"x")
    assert filt.stats()["n_items"] == 1 and 0 < filt.stats()["false_positive_rate"] < 0.01


def test_a_bench_is_built(spark, tmp_path):
    families = [r[0] for r in simulate.simulate_ledger(spark, 300).select("generator_family").where("generator_family is not null").distinct().collect()]
    shared = spark.createDataFrame([(f"s{i}",) for i in range(400)], "sha256 string")
    made = spark.createDataFrame([(f"{f}{i}", f) for f in families for i in range(100)], "sha256 string, family string")
    built, summary = jobs.build_bench(spark, 300, shared, made)
    assert summary["n"] + summary["n_dropped"] == 300 and summary["n"] > 200 and set(summary["splits"]) == {"train", "calibration", "test"}
    again = built.groupBy("source_sha256").agg(F.count_distinct("image_group_id").alias("g")).where("g > 1")
    assert again.count() == 0
    for i in range(4):
        (tmp_path / f"{i}.jpg").write_bytes(bytes([i]))
    for n in (2, 2, 3):
        assert corpus_source.cached_images(spark, str(tmp_path), str(tmp_path / "cache"), n).count() == n
    built.write.parquet(str(tmp_path / "shard"))
    assert corpus_source.open_shard(spark, str(tmp_path / "shard")).count() == summary["n"]


def test_shift_report(spark):
    matrix = spark.createDataFrame([("a", 10, 0, 0.0, True, True, False), ("b", 10, 5, 0.5, False, True, True)], "condition string, n_denied long, n_legit_denied long, realised_fdr double, holds boolean, recertified boolean, recoverable boolean")
    assert risk.shift_report(matrix).endswith("1 of 2 conditions hold, 1 could be certified again")
