"""Streaming forms of the stateful operators; their rows equal those of the batch forms."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from veritide.operators.monitoring import batch_profile, fold_watchdog

_OUT = (
    "event_id long, identity string, n_prior_claims long, n_prior_claims_30d long, n_prior_claims_90d long, days_since_first_claim long, days_since_last_claim long, "
    "mean_prior_value double, max_prior_value double, value_vs_prior_mean double, n_kinds long, is_first_claim boolean, late boolean"
)
_STATE = "n long, total double, top double, kinds array<string>, first_us long, last_us long, recent array<long>"
_DAY = 86_400_000_000


def behaviour_stream(events: DataFrame, identity: str, key: str, ts: str, value: str, kind: str, delay: str = "1 hour") -> DataFrame:
    """History features of a stream of events, by identity.

    Within a micro-batch events are taken in order of (time, key). An event older than its
    identity's newest comes out with ``late`` set and does not enter the state.
    """

    def step(who: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total, top, kinds, first, last, recent = state.get if state.exists else (0, 0.0, 0.0, [], 0, -(1 << 62), [])
        seen, recent, rows = set(kinds), list(recent), []
        for r in pd.concat(list(batches)).sort_values(["us", "key"]).itertuples():
            late = r.us < last
            since = lambda days, us=r.us: sum(us - x < (days + 1) * _DAY for x in recent)
            mean = total / n if n else 0.0
            rows.append((r.key, who[0], n, since(30), since(90), (r.us - first) // _DAY if n else 0, (r.us - last) // _DAY if n else 0, mean, top, r.value / mean if mean else 1.0, len(seen), n == 0, late))
            if not late:
                first = r.us if n == 0 else first
                n, total, top, last = n + 1, total + r.value, max(top, r.value) if n else r.value, r.us
                recent = [x for x in recent if r.us - x < 91 * _DAY] + [r.us]  # what no later event can count goes
                if r.kind is not None:
                    seen.add(r.kind)
        state.update((n, total, top, sorted(seen), first, last, recent))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in _OUT.split(", ")])

    at = F.col(ts).cast("timestamp")
    slim = events.select(F.col(identity).cast("string").alias("identity"), F.col(key).cast("long").alias("key"), at.alias("ts"), F.unix_micros(at).alias("us"), F.col(value).cast("double").alias("value"), F.col(kind).cast("string").alias("kind"))
    keyed = slim.withWatermark("ts", delay).groupBy("identity")
    return keyed.applyInPandasWithState(step, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


def watchdog_sink(scores_batch: str, p: str, y: str, start: float, alpha: float, folder: str, emit: Callable[[pd.DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: each micro-batch adds its counts to ``folder``, and the fold over all counts is emitted.

    Counts are written under the number of the micro-batch, so a restart loses none and a replay
    counts none twice; the driver holds a few counts for each batch of scores only while it folds.
    """

    def run(batch: DataFrame, number: int) -> None:
        batch_profile(batch, scores_batch, p, y, start).coalesce(1).write.mode("overwrite").parquet(f"{folder}/number={number}")
        counts = batch.sparkSession.read.parquet(folder).groupBy("batch", "level").agg(F.sum("n").alias("n"), F.sum("legit").alias("legit")).toPandas()
        if len(counts):
            emit(fold_watchdog(counts, start, alpha))

    return run


def event_windows(events: DataFrame, ts: str, every: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Counts and sums per tumbling window and kind, for monitoring a claims stream."""
    return events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", delay).groupBy(F.window("_ts", every), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
