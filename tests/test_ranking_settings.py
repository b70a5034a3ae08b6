"""The ranking queries at the settings of the reference."""

import os

import pytest

from veritide.operators import bootstrap
from veritide.plans import registry
from veritide.plans.bindings import scores

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_unrounded_scores_and_all_resamples(spark):
    rows = sorted(((r.p, r.y) for r in scores(spark, SF).collect()), reverse=True)
    positives, seen, total, at = sum(y for _, y in rows), 0, 0.0, 0
    while at < len(rows):
        end = next((i for i in range(at, len(rows)) if rows[i][0] != rows[at][0]), len(rows))
        here = sum(y for _, y in rows[at:end])
        seen += here
        total += here * seen / end
        at = end
    exact = registry.QUERIES["exact_ranking_metrics"](spark, SF).collect()[0]
    interval = registry.QUERIES["bootstrap_interval"](spark, SF).collect()[0]
    assert exact.pr_auc == pytest.approx(total / positives, abs=2e-6) and interval.estimate == pytest.approx(total / positives, abs=2e-6)
    assert interval.resamples == 2000 and interval.low <= interval.estimate <= interval.high


def test_scores_that_round_to_one_stay_apart(spark):
    rows = spark.createDataFrame([(i, 0.5 + i * 1e-6, int(i >= 30)) for i in range(60)], "id long, p double, y int")
    out = bootstrap.bootstrap_ranking(rows, "p", "y", "id", 20, digits=None).collect()[0]
    assert [out.estimate, out.low, out.high] == pytest.approx([1.0, 1.0, 1.0])
