"""Streaming reuse and rings: each micro-batch asks what came before it and is then added."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritide.operators.reuse import near_hash_pairs, reuse_features, similar_vectors
from veritide.operators.rings import ring_features


class TemporalLeakError(RuntimeError):
    """A claim older than what was already added: its features would know of later claims."""


class EvidenceStream:
    """Claims (id, ts, claimant, merchant, phash, embedding) in a folder that all executors share.

    ``sink`` is a foreachBatch function. Claims of a batch ask in order of (ts, id), so a batch gives
    the rows that its claims would get one by one. Claims older than the newest added one are an
    error, and so are repeated ids. Batches are written under their number: one that is replayed after
    a failure replaces itself and is not counted twice.
    """

    def __init__(self, folder: str, radius: int = 2, similar: float = 0.98):
        self.folder, self.radius, self.similar = folder, radius, similar

    def _past(self, spark: SparkSession, name: str, number: int) -> DataFrame | None:
        try:
            rows = spark.read.parquet(f"{self.folder}/{name}")
        except Exception as error:
            if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
                return None
            raise
        return rows.where(F.col("batch") < number).drop("batch")

    def add(self, batch: DataFrame, number: int) -> DataFrame:
        """The features of a batch, which is added to the folder."""
        spark = batch.sparkSession
        batch = batch.select("id", "ts", "claimant", "merchant", "phash", "embedding")
        past = self._past(spark, "claims", number)
        if not batch.groupBy("id").count().where("count > 1").isEmpty() or (past is not None and not batch.join(past, "id", "left_semi").isEmpty()):
            raise ValueError("an id was added before")
        if past is not None:
            newest, oldest = past.agg(F.max("ts")).collect()[0][0], batch.agg(F.min("ts")).collect()[0][0]
            if newest is not None and oldest is not None and oldest < newest:
                raise TemporalLeakError(f"a claim of {oldest} comes after one of {newest}")
        both = batch if past is None else past.unionByName(batch)
        hashes = near_hash_pairs(both, self.radius, queries=batch)
        vectors = similar_vectors(both, queries=batch)
        reuse = reuse_features(batch, hashes, vectors, self.radius, self.similar, candidates=both)
        new = hashes.select("q", "c").union(vectors.where(F.col("similarity") >= self.similar).select("q", "c")).distinct()
        new.write.mode("overwrite").parquet(f"{self.folder}/matches/batch={number}")
        known = self._past(spark, "matches", number + 1)
        rings = ring_features(both.select("id", "claimant", "merchant", "ts"), known)
        reuse.join(rings, "id").write.mode("overwrite").parquet(f"{self.folder}/features/batch={number}")
        batch.write.mode("overwrite").parquet(f"{self.folder}/claims/batch={number}")
        return spark.read.parquet(f"{self.folder}/features/batch={number}")

    def sink(self, emit: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
        return lambda batch, number: emit(self.add(batch, number), number)
