"""Bootstrap draws where neither a session nor a group fits into one task."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from depthframe.operators import bootstrap as bs
from depthframe.operators import ranked
from depthframe.operators.bootstrap import bootstrap_intervals
from depthframe.plans import evaluate as ev
from depthframe.registry.evaluation_queries import TAIL_ERROR, tail_error
from tests.test_evaluation import frame, naive_draws

N = 90
DAYS = ["2025-01-01"] * 50 + ["2025-01-02"] * 40
SESSIONS = ["am"] * 31 + ["pm"] * 19 + ["am"] * 40


def table(spark, seed):
    """Ties, a value that a third of the rows share, and pairs that are not finite."""
    rng = np.random.default_rng(seed)
    t = np.round(rng.normal(size=N), 1)
    p = np.round(0.4 * t + rng.normal(size=N), 1)
    t[:30] = p[20:50] = 0.3
    p[7], t[61] = np.nan, np.inf
    return p, t, frame(spark, p.tolist(), t.tolist(), DAYS, SESSIONS).repartition(4)


def drawn(spark, p, t, seed, draws, block):
    groups, numbers = {}, {}
    for i, key in enumerate(zip(DAYS, SESSIONS)):
        groups.setdefault(key, []).append(i)
    for key in groups:
        numbers[key] = spark.range(1).select(bs.session_number(F.lit("A"), F.lit(key[0]), F.lit(key[1]))).first()[0]
    for a, b in [(p, t), *naive_draws(p, t, groups, seed + 1, draws, block, numbers)]:
        ok = np.isfinite(a) & np.isfinite(b)
        yield a[ok], b[ok]


@pytest.fixture(params=["whole", "parts"])
def limits(request, monkeypatch):
    if request.param == "parts":
        monkeypatch.setattr(bs, "CHUNK_ROWS", 12)
        monkeypatch.setattr(bs, "MAX_DRAWN_ROWS", 48)  # four draws a task
        monkeypatch.setattr(ranked, "RANK_ROWS", 16)
        monkeypatch.setattr(bs.group_draws, "MAX_GROUP_ROWS", 10)  # no group in one task


def check(got, values):
    assert got["estimate"] == pytest.approx(values[0])
    assert (got["lower"], got["upper"]) == pytest.approx(tuple(np.quantile(values[1:], [0.025, 0.975])))


def test_ranked_metric_equals_the_opaque_one(spark, limits):
    p, t, df = table(spark, 4)
    got = bootstrap_intervals(df, names=[], draws=9, block=5, seed=3, ranked={"tail": TAIL_ERROR}).first()
    check(got, [tail_error(a, b) for a, b in drawn(spark, p, t, 3, 9, 5)])


def test_column_metric_of_chunks(spark, limits):
    p, t, df = table(spark, 5)
    custom = {"spread": lambda a, b: F.max(F.abs(a - b)), "bias": lambda a, b: F.avg(a - b)}
    rows = bootstrap_intervals(df, names=[], draws=9, block=5, seed=3, custom=custom).collect()
    got, want = {r["metric"]: r for r in rows}, list(drawn(spark, p, t, 3, 9, 5))
    check(got["spread"], [np.abs(a - b).max() for a, b in want])
    check(got["bias"], [np.mean(a - b) for a, b in want])


def test_rank_correlation_of_draws(spark, limits):
    def ranks(v):
        return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])

    p, t, df = table(spark, 6)
    got = bootstrap_intervals(df, names=["rank_ic"], draws=9, block=5, seed=3).first()
    check(got, [np.corrcoef(ranks(a), ranks(b))[0, 1] for a, b in drawn(spark, p, t, 3, 9, 5)])


def test_no_task_joins_a_whole_group(spark, monkeypatch):
    """The centre of a group's sums comes without a join that sorts the group's rows."""
    p, t, df = table(spark, 7)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        drawing = {"draws": 3, "block": 5, "seed": 3, "group": bs.CANDIDATE, "sample_order": bs.SAMPLE}
        plan = bs.resample_sums(df, **drawing)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_ranked_metric_of_a_group_beyond_one_task(spark, limits):
    p, t, df = table(spark, 8)
    ok = np.isfinite(p) & np.isfinite(t)
    got = ev.custom_ranked_metric(df, TAIL_ERROR, "tail").first()["tail"]
    assert got == pytest.approx(tail_error(p[ok], t[ok]))
    few = ev.custom_ranked_metric(df.limit(3), TAIL_ERROR, "tail").collect()
    assert all(r["tail"] is not None for r in few)
