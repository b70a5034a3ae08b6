"""How the star-schema tables stand for claims, scores, identities, evidence and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritide.functions.hashing import sign_bits


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, cust, y, p, grp, v, ts: orders as scored and labelled claims."""
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    y = (F.col("o_orderstatus") == "F").cast("long")
    band = F.when(F.col("o_totalprice") < 100000, "low").when(F.col("o_totalprice") < 250000, "mid").otherwise("high")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cust"), y.alias("y"),
        (F.lit(0.6) * y + F.lit(0.4) * ((F.col("o_orderkey") * 7919) % 10007) / F.lit(10007.0)).alias("p"),
        F.concat_ws("|", "c_mktsegment", band).alias("grp"), F.col("o_totalprice").alias("v"), F.col("o_orderdate").alias("ts"),
    )


SCORES = """s AS (SELECT o_orderkey AS id, o_custkey AS cust, CAST(o_orderstatus = 'F' AS BIGINT) AS y,
  CAST(0.6 AS DOUBLE) * CAST(o_orderstatus = 'F' AS INT) + CAST(0.4 AS DOUBLE) * ((o_orderkey * 7919) % 10007) / CAST(10007 AS DOUBLE) AS p,
  c_mktsegment || '|' || CASE WHEN o_totalprice < 100000 THEN 'low' WHEN o_totalprice < 250000 THEN 'mid' ELSE 'high' END AS grp,
  o_totalprice AS v, o_orderdate AS ts FROM orders JOIN customer ON o_custkey = c_custkey)"""


def event_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select("event_id", "ts", "user_id", "event_type", "value", (F.col("event_id") % 7).alias("merchant"))


def hashed_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, ts, claimant, merchant, label, phash, embedding: vectors as evidence, in order of their id."""
    e = read(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("id"), F.timestamp_seconds(F.lit(1735689600) + F.col("vec_id") * 3600).alias("ts"), (F.col("vec_id") % 37).alias("claimant"), F.col("label").alias("merchant"),
        (F.col("label") % 2).alias("label"), sign_bits(F.col("embedding")).alias("phash"), "embedding",
    )


HASHED = """h AS (SELECT vec_id AS id, vec_id % 37 AS claimant, label AS merchant, label % 2 AS label, embedding,
  [embedding[i + 1] > 0 FOR i IN range(64)] AS bits FROM embeddings)"""


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw contact details of customers, written in several ways; every third and fifth customer share some."""
    c = read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    ten = F.lpad(((k % 10 + F.floor(k / 3) * 10) + 9000000000).cast("string"), 10, "0")
    phone = F.when(k % 4 == 0, F.concat(F.lit("+91 "), F.substring(ten, 1, 5), F.lit(" "), F.substring(ten, 6, 5))).when(k % 4 == 1, F.concat(F.lit("0"), ten)).when(k % 11 == 2, F.lit("12345")).otherwise(ten)
    user = F.concat(F.lit("user"), F.floor(k / 5).cast("string"))
    email = F.when(k % 3 == 0, F.concat(F.upper(user), F.lit("+tag@Gmail.com"))).when(k % 3 == 1, F.concat(F.lit("u.ser"), F.floor(k / 5).cast("string"), F.lit("@googlemail.com"))).otherwise(F.concat(F.lit(" only"), k.cast("string"), F.lit("@shop.example ")))
    street = F.concat_ws(" ", F.lit("Flt No."), (k % 40).cast("string"), F.lit("Opp"), F.col("c_mktsegment"), F.lit("Rd, The Soc"))
    pin = F.when(k % 9 == 0, "12 34").otherwise(F.concat(F.lit("56 "), F.lpad((F.col("c_nationkey") % 3).cast("string"), 4, "0")))
    return c.select(k.alias("id"), phone.alias("phone_raw"), email.alias("email_raw"), street.alias("address_raw"), pin.alias("pin_raw"), "c_acctbal")


SIGNALS = """g AS (SELECT c_custkey AS id, c_custkey AS k, c_mktsegment AS seg, c_acctbal,
  lpad(CAST((c_custkey % 10 + (c_custkey // 3) * 10) + 9000000000 AS VARCHAR), 10, '0') AS ten,
  CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE '56' || lpad(CAST(c_nationkey % 3 AS VARCHAR), 4, '0') END AS pin_key FROM customer),
 keys AS (SELECT id, k, seg, pin_key, CASE WHEN k % 4 IN (0, 1) THEN ten WHEN k % 11 = 2 THEN NULL ELSE ten END AS phone_key,
  CASE WHEN k % 3 = 2 THEN 'only' || CAST(k AS VARCHAR) || '@shop.example' ELSE 'user' || CAST(k // 5 AS VARCHAR) || '@gmail.com' END AS email_key,
  'flat number ' || CAST(k % 40 AS VARCHAR) || ' opposite ' || lower(seg) || ' road society' AS address_key FROM g)"""
