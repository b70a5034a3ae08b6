import numpy as np

from veritide.llm.ann import assign, eta, fit, nearest, padded

VECS = "vec_id long, embedding array<float>, label int, id string, x double"


def brute(vectors, queries, k):
    out = {}
    for q in queries:
        d = sorted((float(np.sqrt(((np.array(v, np.float64) - np.array(vectors[q], np.float64)) ** 2).sum())), i) for i, v in vectors.items() if i != q)
        out[q] = d[:k]
    return out


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(1)
    vectors = {i: rng.normal(size=64).astype(np.float32).tolist() for i in range(3000)}
    df = spark.createDataFrame([(i, v, 0, "c", 0.0) for i, v in vectors.items()], VECS)
    rows = nearest(df, lambda i: i % 100 == 0, 10, block_rows=1000).collect()
    want = brute(vectors, range(0, 3000, 100), 10)
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert set(got) == set(want)
    hits = sum(len({i for _, i in want[q]} & {i for _, i in got[q]}) for q in want)
    assert hits / (10 * len(want)) >= 0.9
    for q, found in got.items():
        assert found == sorted(found) and len(found) == 10
        exact = dict((i, d) for d, i in brute(vectors, [q], 3000)[q])
        assert all(abs(exact[i] - d) < 1e-9 for d, i in found)


def test_odd_vectors_ties_and_few_rows(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0, 0.0]), (100, [1.0, 0.0, 0.0]), (7, [1.0, 0.0, 0.0]), (3, [0.0, 1.0, 0.0]), (200, None), (4, [0.0, 0.0, 0.0]), (5, [nan, 1.0, 0.0]), (6, [None, 1.0, 0.0]), (8, [1.0]), (None, [1.0, 0.0, 0.0]), (3, [0.0, 1.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1, "c", 1.0) for i, v in rows], VECS)
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in nearest(df, lambda i: i % 100 == 0, 10).collect())
    assert got == [(0, 1, 7), (0, 2, 100), (0, 3, 3), (100, 1, 0), (100, 2, 7), (100, 3, 3)]
    assert nearest(spark.createDataFrame([], VECS), lambda i: i % 100 == 0).count() == 0


def test_many_equal_vectors_give_the_smallest_ids(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0], 0, "c", 0.0) for i in range(500)], VECS)
    got = [r.vec_id for r in nearest(df, lambda i: i == 400, 10).orderBy("rank").collect()]
    assert got == list(range(10))


def test_descent_lowers_the_anisotropic_loss():
    x = padded(np.random.default_rng(2).normal(size=(400, 8)))
    books = fit(x)
    flat = x.reshape(400, -1, 2)

    def loss(codes):
        r = (flat - books[np.arange(len(books)), codes]).reshape(400, -1)
        along = (r * x).sum(1) / np.linalg.norm(x, axis=1)
        return (r**2).sum() + (eta(8) - 1) * (along**2).sum()

    nearest_codes = np.stack([((flat[:, s, None] - books[s]) ** 2).sum(-1).argmin(1) for s in range(len(books))], 1)
    assert loss(assign(x, books)) <= loss(nearest_codes)


def test_recall_at_the_ratio_of_production(spark):
    """128 of 8,192 rows are measured, as in production; vectors without any structure are the hardest."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(8_192, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 0, "c", 0.0) for i, v in enumerate(x)], VECS)
    rows = nearest(df, lambda i: i % 200 == 0, 10).collect()
    hits, asked = 0, range(0, 8_192, 200)
    for q in asked:
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        hits += len({r.vec_id for r in rows if r.query_id == q} & set(np.argsort(d, kind="stable")[:10].tolist()))
    assert hits / (10 * len(asked)) >= 0.9


def test_vectors_of_every_length_have_neighbours(spark):
    """Short vectors too, and a single one of its length has none."""
    rows = [(i, [float(i), 1.0], 0, "c", 0.0) for i in range(1, 30)] + [(100 + i, [1.0, float(i), 2.0], 0, "c", 0.0) for i in range(5)] + [(300, [5.0] * 5_000, 0, "c", 0.0)]
    got = {}
    for r in nearest(spark.createDataFrame(rows, VECS), lambda i: i % 10 == 0, 3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {10: [9, 11, 8], 20: [19, 21, 18], 100: [101, 102, 103]}
