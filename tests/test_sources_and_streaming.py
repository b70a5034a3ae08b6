import datetime as dt
import random

import pytest

from veritide.operators import behaviour, monitoring, reuse, rings, simulate
from veritide.sources import corpus
from veritide.streaming import evidence, stateful

BASE = dt.datetime(2026, 1, 1)


def test_corpus_round_trip_and_guards(spark, tmp_path):
    made = simulate.simulate_ledger(spark, 50)
    for c in ("device_ua", "device_screen", "device_timezone", "device_fonts"):
        made = made.selectExpr("*", f"cast(null as string) {c}")
    made = made.withColumn("label", made["label"].cast("int"))
    corpus.write_corpus(made, str(tmp_path / "c"))
    back = corpus.load_corpus(spark, str(tmp_path / "c"))
    assert back.count() == 50 and back.where("pin rlike '^[0-9]{6}$'").count() == 50
    assert corpus.split_rows(back, "train").count() > 0
    with pytest.raises(KeyError, match="train"):
        corpus.split_rows(back, "nope")
    with pytest.raises(corpus.CorpusNotBuilt):
        corpus.load_corpus(spark, str(tmp_path / "missing")).count()
    assert corpus.fingerprint(back, "claim_id") == corpus.fingerprint(back.orderBy("claimant_id"), "claim_id")
    built = []
    build = lambda d: built.append(1) or d.select("claim_id")
    for _ in range(2):
        assert corpus.cached_features(back, str(tmp_path / "cache"), build).count() == 50
    assert len(built) == 1
    assert corpus.inject("a <!-- m:begin -->old<!-- m:end --> b", "m", "new") == "a <!-- m:begin -->\nnew\n<!-- m:end --> b"


def test_images_and_quota(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"claim_{i}.jpg").write_bytes(bytes([i]))
    got = corpus.read_images(spark, str(tmp_path)).orderBy("claim_id").collect()
    assert [(r.claim_id, bytes(r.content)) for r in got] == [(f"claim_{i}", bytes([i])) for i in range(3)]
    pool = spark.createDataFrame([("A", str(i % 4)) for i in range(12)] + [("B", "9"), ("C", "7")], "generator string, sha256 string")
    assert sorted(r.generator for r in corpus.pooled(pool, ["A", "B"], 3).collect()) == ["A", "A", "A", "B"]


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, f"u{rng.randrange(3)}", BASE + dt.timedelta(minutes=i // 2), float(rng.randrange(100)), rng.choice(["a", "b", None])) for i in range(60)]
    schema = "event_id long, who string, ts timestamp, value double, kind string"
    for part in range(3):
        spark.createDataFrame(rows[part * 20 : part * 20 + 20], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{part}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = stateful.behaviour_stream(stream, "who", "event_id", "ts", "value", "kind").writeStream.format("memory").queryName("got").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {r.event_id: r for r in spark.table("got").collect()}
    want = behaviour.behaviour_features(spark.createDataFrame(rows, schema), "who", "ts", "event_id", "value", distinct={"n_kinds": "kind"}).collect()
    assert len(got) == 60
    for r in want:
        g = got[r.event_id]
        assert not g.late and (g.n_prior_claims, g.max_prior_value, g.n_kinds, g.is_first_claim) == (r.n_prior_claims, r.max_prior_value, r.n_kinds, r.is_first_claim)
        assert abs(g.mean_prior_value - r.mean_prior_value) < 1e-9 and abs(g.value_vs_prior_mean - r.value_vs_prior_mean) < 1e-9
        assert all(g[c] == r[c] for c in ("n_prior_claims_30d", "n_prior_claims_90d", "days_since_first_claim", "days_since_last_claim"))


def test_watchdog_sink_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(b, 0.95, int(i >= 30)) for b in range(3) for i in range(100)], "b int, p double, y int")
    out = []
    sink = stateful.watchdog_sink("b", "p", "y", 0.9, 0.1, str(tmp_path / "counts"), out.append)
    for b in (0, 1, 1, 2):  # one is replayed
        sink(df.where(df.b == b), b)
    assert out[-1].to_dict("list") == monitoring.watchdog(df, "b", "p", "y", 0.9, 0.1).orderBy("batch").toPandas().to_dict("list")


def test_evidence_stream_equals_batch(spark, tmp_path):
    """Ids are texts that run against time; batches give the rows of the whole, replays change nothing, and old claims are errors."""
    rng = random.Random(6)
    bits = [rng.getrandbits(63) for _ in range(4)]
    rows = []
    for i in range(60):
        h = bits[rng.randrange(4)] ^ (1 << rng.randrange(60) if rng.random() < 0.5 else 0)
        rows.append((f"c{99 - i}", BASE + dt.timedelta(hours=i // 2), f"u{rng.randrange(6)}", f"m{rng.randrange(3)}", h, [rng.choice([0.6, 0.8, -0.6]), rng.choice([0.8, 0.6])]))
    schema = "id string, ts timestamp, claimant string, merchant string, phash long, embedding array<double>"
    claims = spark.createDataFrame(rows, schema)
    stream, got = evidence.EvidenceStream(str(tmp_path / "s"), 2, 0.99), []
    sink = stream.sink(lambda df, n: got.append((n, {r.id: r for r in df.collect()})))
    for n, (a, b) in enumerate(((0, 20), (20, 40), (40, 60))):
        sink(spark.createDataFrame(rows[a:b], schema), n)
    sink(spark.createDataFrame(rows[40:60], schema), 2)
    hashes, vectors = reuse.near_hash_pairs(claims, 2), reuse.similar_vectors(claims)
    matches = hashes.select("q", "c").union(vectors.where("similarity >= 0.99").select("q", "c")).distinct()
    want = {r.id: r for r in reuse.reuse_features(claims, hashes, vectors, 2, 0.99).join(rings.ring_features(claims, matches), "id").collect()}
    assert sum(r.in_ring for r in want.values()) > 5 and len(want) == 60
    assert {k: v for n, part in got for k, v in part.items()} == want and got[2][1] == got[3][1]
    with pytest.raises(evidence.TemporalLeakError):
        sink(spark.createDataFrame([("new", BASE, "u", "m", 1, [1.0, 0.0])], schema), 3)
    with pytest.raises(ValueError, match="before"):
        sink(spark.createDataFrame([rows[59]], schema), 3)


def test_vectors_match_in_order_of_time(spark):
    schema = "id string, ts timestamp, embedding array<double>"
    rows = [("a", BASE + dt.timedelta(days=1), [1.0, 0.0]), ("b", BASE, [1.0, 0.0]), ("c", BASE, [1.0, 0.0])]
    assert sorted((r.q, r.c) for r in reuse.similar_vectors(spark.createDataFrame(rows, schema), block_rows=2).collect()) == [("a", "b"), ("a", "c")]
    pairs = reuse.similar_vectors(spark.createDataFrame(rows, schema), k=1)
    assert [(r.q, r.c) for r in pairs.collect()] == [("a", "b")]
    hits = spark.createDataFrame([("a", "c", 1)], "q string, c string, hamming int")
    assert [(m.c, m.stage) for m in reuse.ordered_matches(hits, pairs, 2, 0.9).collect()[0].matches] == [("c", "hash"), ("b", "vector")]
