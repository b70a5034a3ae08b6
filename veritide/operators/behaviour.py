"""Strictly backward-looking history of a claimant, by window functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400_000_000


def behaviour_features(claims: DataFrame, identity: str, ts: str, order: str, value: str, ordered_at: str | None = None, distinct: dict[str, str] | None = None) -> DataFrame:
    """``claims`` with what was known of its identity before each row.

    Rows are ordered by (``ts``, ``order``); of rows at the same time the earlier in that order
    count. "30 days" holds differences under 31 days, as whole days are compared. ``distinct``
    names columns to count different non-null values of: {output: column}.
    """
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    who = Window.partitionBy(identity)
    prior = who.orderBy("_us", order).rowsBetween(Window.unboundedPreceding, -1)
    df = claims.withColumn("_us", at)
    df = df.withColumn("_nth_tied", F.row_number().over(Window.partitionBy(identity, "_us").orderBy(order)))
    df = df.withColumn("_tied", F.count("*").over(Window.partitionBy(identity, "_us")))

    def within(days: int):
        span = who.orderBy("_us").rangeBetween(-(days + 1) * DAY + 1, 0)
        return F.count("*").over(span) - (F.col("_tied") - F.col("_nth_tied") + 1)

    n = F.row_number().over(who.orderBy("_us", order)) - 1
    mean = F.avg(value).over(prior)
    whole_days = lambda past: F.floor((F.col("_us") - past) / DAY)
    out = {
        "n_prior_claims": n.cast("long"),
        "n_prior_claims_30d": within(30),
        "n_prior_claims_90d": within(90),
        "days_since_first_claim": F.coalesce(whole_days(F.min("_us").over(prior)), F.lit(0)),
        "days_since_last_claim": F.coalesce(whole_days(F.max("_us").over(prior)), F.lit(0)),
        "mean_prior_value": F.coalesce(mean, F.lit(0.0)),
        "max_prior_value": F.coalesce(F.max(value).over(prior), F.lit(0.0)),
        "value_vs_prior_mean": F.when(F.coalesce(mean, F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.col(value) / F.nullif(mean, F.lit(0.0))),
        "is_first_claim": n == 0,
    }
    if ordered_at:
        out["claim_to_order_days"] = F.floor((F.col("_us") - F.unix_micros(F.col(ordered_at).cast("timestamp"))) / DAY)
    for name, column in (distinct or {}).items():
        df = df.withColumn(f"_new_{name}", F.when(F.col(column).isNotNull() & (F.row_number().over(Window.partitionBy(identity, column).orderBy("_us", order)) == 1), 1).otherwise(0))
        out[name] = F.coalesce(F.sum(f"_new_{name}").over(prior), F.lit(0))
    return df.withColumns(out).select(*claims.columns, *out)
