"""SQL names for the engine's functions: SQL bodies where Catalyst can inline them, Arrow functions otherwise."""

from __future__ import annotations

from pyspark.sql import SparkSession

from veritide.functions.canonical import token_set_ratio
from veritide.operators.risk import hb_pvalue

_SQL = {
    "hamming64(a BIGINT, b BIGINT) RETURNS INT": "bit_count(a ^ b)",
    "lsh_bands(h BIGINT) RETURNS ARRAY<BIGINT>": "transform(sequence(0, 15), i -> shiftrightunsigned(h, 4 * i) & 15L)",
    "pin_key(raw STRING) RETURNS STRING": "CASE WHEN length(regexp_replace(raw, '[^0-9]', '')) = 6 THEN regexp_replace(raw, '[^0-9]', '') END",
    "policy_decide(p DOUBLE, t_approve DOUBLE, t_deny DOUBLE) RETURNS STRING": "CASE WHEN p >= t_deny THEN 'DENY' WHEN p <= t_approve THEN 'APPROVE' ELSE 'REVIEW' END",
    "half_life_weight(days DOUBLE) RETURNS DOUBLE": "pow(0.5D, days / 180.0D)",
    "false_negative_cost(order_value DOUBLE) RETURNS DOUBLE": "order_value + 180.0D",
    "false_positive_cost(order_value DOUBLE) RETURNS DOUBLE": "order_value + 1300.0D",
}


def register_functions(spark: SparkSession) -> list[str]:
    """Registers all functions for the session and returns their names."""
    for head, body in _SQL.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udf.register("token_set_ratio", token_set_ratio)
    spark.udf.register("hb_pvalue", hb_pvalue)
    return [h.split("(")[0] for h in _SQL] + ["token_set_ratio", "hb_pvalue"]
