"""Costs, three-way decisions, policy search, exploration and off-policy estimates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritide.functions.hashing import uniform


@dataclass(frozen=True)
class Costs:
    """Fixed values of the cost model, in rupees."""

    fn_fixed: float = 180.0
    fp_fixed: float = 250.0
    p_churn: float = 0.35
    ltv: float = 3000.0
    review: float = 40.0
    epsilon: float = 0.01

    @property
    def churn(self) -> float:
        return self.p_churn * self.ltv

    def crossover_value(self) -> float | None:
        """Both costs grow alike with the order value, so one is dearer everywhere."""
        return None if self.fp_fixed + self.churn > self.fn_fixed else float("inf")

    def false_negative(self, value: Column) -> Column:
        return value + self.fn_fixed

    def false_positive(self, value: Column) -> Column:
        return value + self.fp_fixed + self.churn

    def expected(self, p: Column, value: Column) -> dict[str, Column]:
        return {"APPROVE": p * self.false_negative(value), "DENY": (1.0 - p) * self.false_positive(value), "REVIEW": F.lit(self.review)}

    def optimal_action(self, p: Column, value: Column) -> Column:
        c = self.expected(p, value)
        a, d, r = c["APPROVE"], c["DENY"], c["REVIEW"]
        return F.when((a <= d) & (a <= r), "APPROVE").when(d <= r, "DENY").otherwise("REVIEW")

    def realised(self, action: Column, y: Column, value: Column) -> Column:
        return (
            F.when((action == "APPROVE") & (y == 1), self.false_negative(value))
            .when((action == "DENY") & (y == 0), self.false_positive(value))
            .when(action == "REVIEW", F.lit(self.review))
            .otherwise(0.0)
        )


def decide(p: Column, approve: float, deny: float) -> Column:
    """REVIEW between the thresholds; DENY wins where they overlap."""
    return F.when(p >= deny, "DENY").when(p <= approve, "APPROVE").otherwise("REVIEW")


def policy_summary(scores: DataFrame, p: str, y: str, value: str, approve: float, deny: float, costs: Costs = Costs()) -> DataFrame:
    action = decide(F.col(p), approve, deny)
    rows = scores.select(action.alias("a"), costs.realised(action, F.col(y), F.col(value)).alias("cost"))
    rate = lambda name: F.coalesce(F.avg((F.col("a") == name).cast("double")), F.lit(0.0))
    return rows.agg(
        rate("APPROVE").alias("approve_rate"), rate("REVIEW").alias("review_rate"), rate("DENY").alias("deny_rate"),
        F.coalesce(F.sum("cost") / F.count("*") * 1000, F.lit(0.0)).alias("cost_per_1000"),
    )


APPROVE_GRID = [-1.0, *[round(i / 100, 4) for i in range(51)]]
UNCERTIFIED_GRID = [*[round(0.5 + i / 50, 4) for i in range(25)], 1.01]


def policy_grid(scores: DataFrame, p: str, y: str, value: str, deny_grid: list[float], approve_grid: list[float] = APPROVE_GRID, costs: Costs = Costs()) -> DataFrame:
    """Cost per 1000 of every (approve, deny) pair with approve < deny.

    The cost separates: one pass sums fraud and legitimate costs by grid bucket, and the pairs read
    prefix and suffix sums of at most a few dozen buckets.
    """
    spark = scores.sparkSession
    below = F.size(F.filter(F.array(*map(F.lit, approve_grid)), lambda t: t < F.col(p)))  # the first index with t >= p
    above = F.size(F.filter(F.array(*map(F.lit, deny_grid)), lambda t: t <= F.col(p)))
    fa = F.when(F.col(y) == 1, costs.false_negative(F.col(value))).otherwise(0.0)
    fd = F.when(F.col(y) == 0, costs.false_positive(F.col(value))).otherwise(0.0)
    by = scores.groupBy(below.alias("i"), above.alias("j")).agg(F.sum(fa).alias("fa"), F.sum(fd).alias("fd"), F.count("*").alias("n"))
    a = spark.createDataFrame([(i, t) for i, t in enumerate(approve_grid)], "k int, t_approve double")
    d = spark.createDataFrame([(i, t) for i, t in enumerate(deny_grid)], "k int, t_deny double")
    up = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    sums = lambda grid, key, cost: grid.join(by.groupBy(F.col(key).alias("k")).agg(F.sum(cost).alias("cost"), F.sum("n").alias("n")), "k", "left")
    approved = sums(a, "i", "fa").select("t_approve", F.sum(F.coalesce("cost", F.lit(0.0))).over(up).alias("ca"), F.sum(F.coalesce("n", F.lit(0))).over(up).alias("na"), F.col("k").alias("ka"))
    denied = sums(d.withColumn("k", F.col("k") + 1), "j", "fd").select(
        "t_deny", F.sum(F.coalesce("cost", F.lit(0.0))).over(down).alias("cd"), F.sum(F.coalesce("n", F.lit(0))).over(down).alias("nd"), F.col("k").alias("kd")
    )
    total = by.agg(F.sum("n").alias("n"))
    pairs = approved.join(F.broadcast(denied), F.col("t_approve") < F.col("t_deny")).join(F.broadcast(total), F.lit(True))
    cost = (F.col("ca") + F.col("cd") + costs.review * (F.col("n") - F.col("na") - F.col("nd"))) / F.col("n") * 1000
    return pairs.select("t_approve", "t_deny", "kd", "ka", cost.alias("cost_per_1000"))


def select_policy(scores: DataFrame, p: str, y: str, value: str, certified: list[float], costs: Costs = Costs()) -> DataFrame:
    """The cheapest certified pair (deny thresholds in the given order, then approve ascending, break ties).

    Without a certified threshold nothing is denied, and the cheapest uncertified pair is given beside it.
    """
    grid = policy_grid(scores, p, y, value, sorted(certified) or [1.01], costs=costs)
    order = {t: i for i, t in enumerate(certified)}
    place = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), F.col("t_deny")), F.lit(0)) if order else F.lit(0)
    best = F.min_by(F.struct("t_approve", "t_deny", "cost_per_1000"), F.struct("cost_per_1000", place, "ka"))
    out = grid.agg(best.alias("b")).select("b.*", F.lit(bool(certified)).alias("certified"))
    if certified:
        return out
    free = policy_grid(scores, p, y, value, UNCERTIFIED_GRID, costs=costs).agg(F.min_by(F.struct("t_approve", "t_deny", "cost_per_1000"), F.struct("cost_per_1000", "kd", "ka")).alias("u"))
    return out.join(F.broadcast(free.select(F.col("u.t_approve").alias("uncertified_t_approve"), F.col("u.t_deny").alias("uncertified_t_deny"), F.col("u.cost_per_1000").alias("uncertified_cost_per_1000"))), F.lit(True))


def policy_candidates(scores: DataFrame, p: str, y: str, value: str, certified: list[float], k: int = 20, costs: Costs = Costs()) -> DataFrame:
    """The ``k`` cheapest certified pairs with their ``place``; ties in the order of the search (deny as given, approve ascending)."""
    grid = policy_grid(scores, p, y, value, sorted(certified) or [1.01], costs=costs)
    order = F.create_map(*[F.lit(x) for i, t in enumerate(certified) for x in (t, i)]) if certified else None
    place = F.coalesce(F.try_element_at(order, F.col("t_deny")), F.lit(0)) if certified else F.lit(0)
    first = Window.orderBy(F.round("cost_per_1000", 6), place, "ka")  # at most a few thousand pairs of thresholds
    return grid.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k).select("t_approve", "t_deny", "cost_per_1000", F.col("place").cast("int").alias("place"))


def band_width(approve: Column, deny: Column) -> Column:
    """How much of the score range goes to review: never less than nothing."""
    return F.greatest(F.lit(0.0), deny - approve)


def describe_policy(approve: float, deny: float) -> str:
    if deny <= approve:
        return f"deny from {deny:.4f} on, approve below; nothing is reviewed"
    return f"approve up to {approve:.4f}, deny from {deny:.4f} on, review between ({deny - approve:.4f} wide)"


def explore(decisions: DataFrame, action: str, key: str, epsilon: float = 0.01, seed: int = 1337) -> DataFrame:
    """Flips a share epsilon of denials to approval, by a hash of the key; logs the propensity of what was done."""
    flip = (F.col(action) == "DENY") & (uniform(seed, F.col(key)) < epsilon)
    propensity = F.when(F.col(action) != "DENY", 1.0).when(flip, epsilon).otherwise(1.0 - epsilon)
    return decisions.withColumns({"explored": flip, "logged_action": F.when(flip, "APPROVE").otherwise(F.col(action)), "propensity": propensity})


def exploration_cost(log: DataFrame, y: str, value: str, costs: Costs = Costs()) -> DataFrame:
    """What exploration cost on frauds and what it saved on honest claims; the two are never netted."""
    seen = log.where("explored")
    return seen.agg(
        F.count("*").alias("n_explored"), F.sum((F.col(y) == 1).cast("long")).alias("n_fraud"),
        F.coalesce(F.sum(F.when(F.col(y) == 1, costs.false_negative(F.col(value)))), F.lit(0.0)).alias("cost"),
        F.coalesce(F.sum(F.when(F.col(y) == 0, costs.false_positive(F.col(value)))), F.lit(0.0)).alias("saved"),
    )


def censoring_report(log: DataFrame) -> DataFrame:
    """Shares of claims denied, and of denied claims whose label exploration lets us see."""
    n = F.count("*")
    denied = F.sum(F.when(F.col("action") == "DENY", 1).otherwise(0))
    seen = F.sum(F.when(F.col("explored"), 1).otherwise(0))
    return log.agg(n.alias("n"), F.coalesce(denied, F.lit(0)).alias("n_denied"), F.coalesce(denied / n, F.lit(0.0)).alias("deny_share"), F.coalesce(seen / F.nullif(denied, F.lit(0)), F.lit(0.0)).alias("observed_share"))


ACTIONS = ["APPROVE", "REVIEW", "DENY"]


def reward_model(p: Column, value: Column, costs: Costs = Costs()) -> dict[str, Column]:
    return {a: -c for a, c in costs.expected(p, value).items()}


def doubly_robust(log: DataFrame, reward: str, action: str, propensity: str, q: dict[str, str], target: dict[str, str], clip: float = 10.0) -> DataFrame:
    """Value of a target policy from logged decisions, with weights clipped, and its diagnostics."""
    pick = lambda names: F.coalesce(*[F.when(F.col(action) == a, F.col(c)) for a, c in names.items()])
    direct = sum((F.col(target[a]) * F.col(q[a]) for a in q), F.lit(0.0))
    checked = F.assert_true(F.col(propensity) > 0, F.lit("a logged action needs a positive propensity"))
    sums = F.assert_true(F.abs(sum((F.col(c) for c in target.values()), F.lit(0.0)) - 1) < 1e-6, F.lit("target probabilities must sum to 1"))
    w = pick(target) / F.col(propensity)
    rows = log.where(checked.isNull() & sums.isNull()).select(direct.alias("direct"), w.alias("w"), F.least(w, F.lit(clip)).alias("wc"), (F.col(reward) - pick(q)).alias("rest"), pick(target).alias("agree"))
    rows = rows.withColumn("per", F.col("direct") + F.col("wc") * F.col("rest"))
    n = F.count("*")
    return rows.agg(
        F.avg("per").alias("dr_value"), F.avg("direct").alias("direct_term"), F.avg(F.col("wc") * F.col("rest")).alias("correction_term"), n.alias("n"),
        F.avg((F.col("w") > clip).cast("double")).alias("clipped_fraction"),
        F.coalesce(F.pow(F.sum("wc"), 2) / F.nullif(F.sum(F.col("wc") * F.col("wc")), F.lit(0.0)), F.lit(0.0)).alias("effective_sample_size"),
        F.when(n > 1, F.stddev_samp("per") / F.sqrt(n)).otherwise(0.0).alias("standard_error"),
        F.avg("agree").alias("mean_target_prob"), F.avg((F.col("agree") == 0).cast("double")).alias("off_support"), F.max("w").alias("max_weight"), F.avg("w").alias("mean_weight"),
    )


def matured(claims: DataFrame, ts: str, days: int = 120, as_of: str | None = None) -> DataFrame:
    """``claims`` with ``is_mature``: old enough at ``as_of`` (default: the newest claim) for a label."""
    now = F.lit(as_of).cast("timestamp") if as_of else None
    at = F.col(ts).cast("timestamp")
    if now is not None:
        return claims.withColumn("is_mature", at <= now - F.expr(f"INTERVAL {days} DAYS"))
    newest = claims.agg(F.max(at).alias("_as_of"))
    return claims.join(F.broadcast(newest), F.lit(True)).withColumn("is_mature", at <= F.col("_as_of") - F.expr(f"INTERVAL {days} DAYS")).drop("_as_of")


def maturity_report(claims: DataFrame, ts: str, days: int = 120) -> DataFrame:
    rows = matured(claims, ts, days)
    return rows.agg(F.count("*").alias("n_total"), F.count_if("is_mature").alias("n_mature"), F.count_if(~F.col("is_mature")).alias("n_censored"), F.coalesce(F.avg(F.col("is_mature").cast("double")), F.lit(0.0)).alias("mature_rate"))


def matured_rows(claims: DataFrame, ts: str, days: int = 120, as_of: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(the matured claims, the report on all of them)."""
    return matured(claims, ts, days, as_of).where("is_mature").drop("is_mature"), maturity_report(claims, ts, days)
