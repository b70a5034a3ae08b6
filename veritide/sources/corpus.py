"""Reading and writing claim corpora: fixed schemas, explicit row order, content-addressed caches."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CLAIMS = (
    "claim_id string, claim_timestamp timestamp, order_date timestamp, merchant_id string, claimant_id string, phone string, email string, address string, pin string, "
    "device_ua string, device_screen string, device_timezone string, device_fonts string, category string, price_band string, order_value_inr int, label int, "
    "fraud_class string, generator_family string, image_group_id string, split string"
)


class CorpusNotBuilt(FileNotFoundError):
    """A tier that has not been written yet."""


def load_corpus(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Claims with ``row_idx``, their place in the file, which breaks ties of the timestamp.

    Columns keep their declared types, so codes with leading zeros stay text.
    """
    try:
        reader = spark.read.schema(CLAIMS)
        rows = reader.csv(path, header=True) if fmt == "csv" else reader.parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            raise CorpusNotBuilt(f"no corpus at {path}; write one with write_corpus first") from error
        raise
    return rows.withColumn("row_idx", F.monotonically_increasing_id())


def ordered(claims: DataFrame) -> DataFrame:
    """Claims by (claim_timestamp, row_idx): a range sort, never collected."""
    return claims.orderBy("claim_timestamp", "row_idx")


def split_rows(claims: DataFrame, split: str) -> DataFrame:
    """Rows of one split; an unknown name is an error that lists those there are."""
    rows = claims.where(F.col("split") == split)
    if rows.isEmpty():
        raise KeyError(f"no split {split!r}; there are {sorted(r[0] for r in claims.select('split').distinct().collect())}")
    return rows


def write_corpus(claims: DataFrame, path: str, fmt: str = "csv") -> None:
    writer = claims.select([c.strip().split()[0] for c in CLAIMS.split(",")]).write.mode("overwrite")
    writer.csv(path, header=True) if fmt == "csv" else writer.parquet(path)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(claim_id, content, sha256): image bytes as stored, keyed by file name."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("claim_id"), "content", F.sha2("content", 256).alias("sha256"))


def read_pool_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("file string, sha256 string, source_dataset string, source_license string, label string, generator string").csv(path, sep="\t", header=True)


def pooled(pool: DataFrame, families: list[str], quota: int, family: str = "generator", key: str = "sha256", order: str | None = None) -> DataFrame:
    """Up to ``quota`` rows of each wanted family in ``order`` (default: ``key``), one for each content key, its first;
    the filter reaches the scan."""
    order = order or key
    one = pool.where(F.col(family).isin(families)).withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1")
    return one.withColumn("_n", F.row_number().over(Window.partitionBy(family).orderBy(order))).where(F.col("_n") <= quota).drop("_n")


def fingerprint(rows: DataFrame, key: str) -> str:
    """16 hexadecimal digits that depend on the set of keys and not on their order.

    Keys are summed as 128-bit hash halves, so no list of them is ever built.
    """
    h = F.sha2(F.col(key).cast("string"), 256)
    part = lambda at: F.sum(F.conv(F.substring(h, at, 12), 16, 10).cast("decimal(38,0)"))
    r = rows.agg(part(1).alias("a"), part(13).alias("b"), F.count("*").alias("n")).collect()[0]
    import hashlib

    return hashlib.sha256(f"{r.a}:{r.b}:{r.n}".encode()).hexdigest()[:16]


def cached_features(claims: DataFrame, folder: str, build: Callable[[DataFrame], DataFrame], key: str = "claim_id") -> DataFrame:
    """The features of exactly these claims, from the cache if they are there."""
    spark = claims.sparkSession
    path = f"{folder}/features_{fingerprint(claims, key)}"
    try:
        return spark.read.parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
    build(claims).write.parquet(path)
    return spark.read.parquet(path)


def write_json(path: str, what: dict) -> None:
    """A small report (certificate, metrics, manifest); keys sorted, written whole or not at all."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path + ".part", "w") as out:
        json.dump(what, out, indent=2, sort_keys=True, default=str)
    os.replace(path + ".part", path)


def inject(readme: str, marker: str, body: str) -> str:
    """``readme`` with the text between the begin and end comments of ``marker`` replaced."""
    begin, end = f"<!-- {marker}:begin -->", f"<!-- {marker}:end -->"
    if begin not in readme or end not in readme:
        raise ValueError(f"no block {marker}")
    head, rest = readme.split(begin, 1)
    return f"{head}{begin}\n{body}\n{end}{rest.split(end, 1)[1]}"


def is_injected(readme: str, marker: str, body: str) -> bool:
    """Whether the block of ``marker`` already says ``body``: a check that writes nothing."""
    return inject(readme, marker, body) == readme


def require_columns(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``rows``, if they have these columns; else an error that lists those that are missing."""
    if missing := sorted(set(columns) - set(rows.columns)):
        raise ValueError(f"missing columns: {missing}")
    return rows


def open_shard(spark: SparkSession, path: str, attempts: int = 3, wait: float = 1.0) -> DataFrame:
    """A Parquet shard, tried again with doubling pauses while its listing fails; a path that does not exist fails at once."""
    for attempt in range(attempts):
        try:
            return spark.read.parquet(path)
        except Exception as error:
            if attempt + 1 == attempts or "PATH_NOT_FOUND" in str(error):
                raise
            time.sleep(wait * 2**attempt)
    raise ValueError("at least one attempt is needed")


def cached_images(spark: SparkSession, source: str, cache: str, n: int) -> DataFrame:
    """The first ``n`` images of a folder by path, from a Parquet cache; what the cache lacks is added, so an interrupted run goes on."""
    files = spark.read.format("binaryFile").load(source).select("path", "content", F.sha2("content", 256).alias("sha256"))
    wanted = files.select("path").orderBy("path").limit(n)
    try:
        held = spark.read.parquet(cache)
        lacking = wanted.join(held, "path", "left_anti")
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        lacking = wanted
    if not lacking.isEmpty():
        files.join(lacking, "path", "left_semi").write.mode("append").parquet(cache)
    return spark.read.parquet(cache).join(wanted, "path", "left_semi")
