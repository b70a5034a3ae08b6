"""Nearest neighbours by score-aware quantisation and four-bit tables.

Smallest Euclidean distance is the largest inner product of (q, 1) with (x, -|x|^2 / 2). Vectors
are product-quantised to four bits for each pair of dimensions. Codebooks and codes minimise an
anisotropic loss, in which residuals parallel to the vector weigh more, since these move the inner
products of near queries. A scan adds up table entries for every indexed row; the best of each
block are measured exactly on the original vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritide.session import ship_package

#: Vectors that the codebooks are fitted on; rows of an index block; queries of a query block.
FIT_ROWS, BLOCK_ROWS, BLOCK_QUERIES = 10_000, 8_192, 2_048
#: Rows of each block, for each query, that are measured exactly.
RERANK = 128
SUB, CENTRES = 2, 16
#: Cosine from which on a query counts for the loss.
THRESHOLD = 0.2


def eta(dims: int, threshold: float = THRESHOLD) -> float:
    return max(1.0, (dims - 1) * threshold**2 / (1 - threshold**2))


def padded(x: np.ndarray) -> np.ndarray:
    """Dimensions filled up with zeros so that two sub-spaces share a byte."""
    return np.pad(x, ((0, 0), (0, -x.shape[1] % (2 * SUB))))


def assign(x: np.ndarray, books: np.ndarray, rounds: int = 2) -> np.ndarray:
    """Codes [row, sub-space] that minimise the anisotropic loss, by coordinate descent."""
    n, subs = len(x), len(books)
    parts = x.reshape(n, subs, SUB)
    unit = parts / np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None, None]
    extra = eta(x.shape[1]) - 1
    codes = np.stack([((parts[:, s, None] - books[s]) ** 2).sum(-1).argmin(1) for s in range(subs)], 1)
    along = np.stack([((parts[:, s] - books[s][codes[:, s]]) * unit[:, s]).sum(-1) for s in range(subs)], 1)
    total = along.sum(1)
    for _ in range(rounds):
        for s in range(subs):
            residual = parts[:, s, None] - books[s]
            own = (residual * unit[:, s, None]).sum(-1)
            loss = (residual**2).sum(-1) + extra * (own + (total - along[:, s])[:, None]) ** 2
            codes[:, s] = loss.argmin(1)
            new = own[np.arange(n), codes[:, s]]
            total += new - along[:, s]
            along[:, s] = new
    return codes


def fit(x: np.ndarray, rounds: int = 4, seed: int = 5) -> np.ndarray:
    """Codebooks [sub-space, centre, SUB] from a sample."""
    x = padded(x)
    n, subs = len(x), x.shape[1] // SUB
    parts = x.reshape(n, subs, SUB)
    unit = parts / np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None, None]
    extra = eta(x.shape[1]) - 1
    rng = np.random.default_rng(seed)
    books = parts[rng.integers(0, n, (subs, CENTRES)), np.arange(subs)[:, None]].astype(float)
    for _ in range(6):  # plain k-means first
        for s in range(subs):
            near = ((parts[:, s, None] - books[s]) ** 2).sum(-1).argmin(1)
            count = np.bincount(near, minlength=CENTRES)
            for d in range(SUB):
                mean = np.bincount(near, parts[:, s, d], CENTRES) / np.maximum(count, 1)
                books[s, :, d] = np.where(count, mean, books[s, :, d])
    for _ in range(rounds):
        codes = assign(x, books, 1)
        along = np.stack([((parts[:, s] - books[s][codes[:, s]]) * unit[:, s]).sum(-1) for s in range(subs)], 1)
        total = along.sum(1)
        for s in range(subs):
            rest = (total - along[:, s])[:, None]
            outer = np.eye(SUB) + extra * unit[:, s, :, None] * unit[:, s, None, :]
            right = (outer @ parts[:, s, :, None])[..., 0] + extra * rest * unit[:, s]
            left_sum, right_sum = np.zeros((CENTRES, SUB, SUB)), np.zeros((CENTRES, SUB))
            np.add.at(left_sum, codes[:, s], outer)
            np.add.at(right_sum, codes[:, s], right)
            used = np.bincount(codes[:, s], minlength=CENTRES) > 0
            books[s, used] = np.linalg.solve(left_sum[used], right_sum[used][..., None])[..., 0]
    return books


def pack(codes: np.ndarray) -> np.ndarray:
    """Two four-bit codes a byte."""
    return (codes[:, 0::2] | codes[:, 1::2] << 4).astype(np.uint8)


def scan(query: np.ndarray, books: np.ndarray, packed: np.ndarray, half_norms: np.ndarray) -> np.ndarray:
    """Estimated score q.x - |x|^2 / 2 of every packed row."""
    tables = (books * query.reshape(len(books), 1, SUB)).sum(-1)  # [sub-space, centre]
    byte = np.arange(256)
    pairs = tables[0::2][:, byte & 15] + tables[1::2][:, byte >> 4]
    score = -half_norms
    for table, column in zip(pairs, packed.T, strict=True):
        score = score + table[column]
    return score


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    x = F.col(vec_col).cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    return vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), x.alias("x")).where(F.coalesce(fine, F.lit(False)))


def nearest(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", block_rows: int = BLOCK_ROWS, rerank: int = RERANK) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``k`` nearest rows found for each row that ``is_query`` holds for.

    A row is no neighbour of its own id; ties go to the smaller id; repeated rows count once; ids are
    integers and rows with a null one take no part. Nor do vectors that are null, zero, or hold null
    or non-finite components. Distances are between vectors of one length: each length has an index
    of its own. Of rows with equal vectors only the ``k`` + 1 smallest ids can be in a result, so only
    these are indexed. Very long vectors make blocks larger, not more numerous. An empty table gives
    an empty result; other columns are ignored. Blocks of rows meet blocks of queries in separate
    tasks of bounded size.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    good = usable(vectors, id_col, vec_col)
    lengths = good.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy("d").collect()
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = [_nearest_of_length(good.where(F.size("x") == r.d), is_query, k, r.d, r.n, block_rows, rerank) for r in lengths]
    top = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = reduce(DataFrame.union, found).withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _nearest_of_length(good: DataFrame, is_query, k: int, dims: int, rows: int, block_rows: int, rerank: int) -> DataFrame:
    """(query_id, vec_id, score): for each query the ``k`` nearest of every block, among vectors of one length."""
    spark = good.sparkSession
    sample = good.where(F.pmod(F.xxhash64(F.lit(11), "id"), F.lit(1 << 20)) < max(1.0, min(1.0, FIT_ROWS / rows) * (1 << 20))).limit(2 * FIT_ROWS)
    known = np.array([r.x for r in sample.collect()] or [r.x for r in good.limit(100).collect()])
    books = fit(known)
    sent = spark.sparkContext.broadcast(books)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            codes = pack(assign(padded(x), sent.value))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes() for c in codes], pa.binary())], names=["id", "x", "codes"])

    same = Window.partitionBy("x").orderBy("id")
    index = good.withColumn("nth", F.dense_rank().over(same)).where(F.col("nth") <= k + 1).drop("nth")
    index = index.mapInArrow(encode, "id long, x array<double>, codes binary")
    queries = good.where(is_query(F.col("id")))
    n_queries = queries.count()
    row_blocks, query_blocks = max(1, math.ceil(rows / block_rows)), max(1, math.ceil(n_queries / BLOCK_QUERIES))
    left = index.select(
        F.pmod(F.xxhash64("id"), F.lit(row_blocks)).cast("int").alias("rb"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qb"), F.lit(False).alias("q"), "id", "x", "codes"
    )
    right = queries.select(
        F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))).alias("rb"), F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(query_blocks)).cast("int").alias("qb"), F.lit(True).alias("q"), "id", "x", F.lit(None).cast("binary").alias("codes")
    )

    def search(block: pa.Table) -> pa.Table:
        books = sent.value
        ids = block["id"].to_numpy()
        x = block["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
        asks = block["q"].to_numpy(zero_copy_only=False).astype(bool)
        q_ids, first = np.unique(ids[asks], return_index=True)
        q_rows = x[asks][first]
        codes = np.frombuffer(b"".join(c.as_py() for c in block["codes"].filter(pa.array(~asks))), np.uint8).reshape(-1, len(books) // 2)
        ids, x = ids[~asks], x[~asks]
        order = np.argsort(ids, kind="stable")
        ids, x, packed = ids[order], x[order], codes[order]
        half = (x * x).sum(1) / 2
        got: list[tuple[np.ndarray, ...]] = []
        for q_id, q in zip(q_ids, q_rows, strict=True):
            score = scan(padded(q[None])[0], books, packed, half)
            best = np.flatnonzero(score >= np.partition(score, len(score) - rerank)[len(score) - rerank]) if len(score) > rerank else np.arange(len(score))
            best = best[ids[best] != q_id]  # estimates that tie with the last one are measured too
            exact = np.sqrt(((x[best] - q) ** 2).sum(1))
            near = np.lexsort((ids[best], exact))
            near = near[np.sort(np.unique(ids[best][near], return_index=True)[1])][:k]
            got.append((np.full(len(near), q_id), ids[best][near], exact[near]))
        columns = [np.concatenate(c) for c in zip(*got, strict=True)] if got else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})

    return left.unionByName(right).groupBy("rb", "qb").applyInArrow(search, "query_id long, vec_id long, score double")
