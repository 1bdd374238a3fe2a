"""As-of and range joins and sessions against brute force, and the plans that are features."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators.joins import asof_join, interval_join, join_lateral_aggregate, join_lateral_top, range_join, top_of_each
from tessera.operators.ordering import top_k
from tessera.operators.windows import sessions, top_n_per_group

T0 = dt.datetime(2024, 1, 1)
quick = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
points = st.lists(st.tuples(st.sampled_from([1, 2, None]), st.integers(0, 20)), min_size=1, max_size=12)


def _rows(xs, first=0):
    return [(first + i, k, T0 + dt.timedelta(minutes=t)) for i, (k, t) in enumerate(xs)]


@quick
@given(left=points, right=points, width=st.sampled_from([60, 150, 900, 604800]))
def test_asof(spark, left, right, width):
    a, b = _rows(left), _rows(right, 100)
    found = asof_join(spark.createDataFrame(a, "id long, k int, ts timestamp_ntz"), spark.createDataFrame(b, "rid long, k int, ts timestamp_ntz"), "k", "ts", ["rid"], "rid", width)
    want = []
    for i, k, t in a:
        before = [(u, r) for r, j, u in b if k is not None and j == k and u <= t]
        if before:
            want.append((i, max(before)[1]))
    assert sorted((r["id"], r["rid"]) for r in found.collect()) == sorted(want)


@quick
@given(left=points, right=points, width=st.integers(1, 400))
def test_range(spark, left, right, width):
    a, b = _rows(left), _rows(right, 100)
    right_df = spark.createDataFrame(b, "rid long, k int, low timestamp_ntz").withColumn("high", F.col("low") + F.expr("interval 7 minutes"))
    found = range_join(spark.createDataFrame(a, "id long, k int, ts timestamp_ntz"), right_df, "k", "ts", "low", "high", width)
    want = [(i, r) for i, k, t in a for r, j, u in b if k is not None and k == j and u <= t < u + dt.timedelta(minutes=7)]
    assert sorted((r["id"], r["rid"]) for r in found.collect()) == sorted(want)


def test_session_edges(spark):
    rows = [(1, T0), (1, T0 + dt.timedelta(minutes=30)), (1, T0 + dt.timedelta(minutes=61)), (2, T0)]
    found = sessions(spark.createDataFrame(rows, "u int, ts timestamp_ntz"), "u", "ts", "30 MINUTES").orderBy("u", "ts").collect()
    assert [r["session"] for r in found] == [0, 0, 1, 0]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    assert "TakeOrderedAndProject" in _plan(top_k(spark, "/root/testdata/sf0.001"))
    assert "WindowGroupLimit" in _plan(top_n_per_group(spark, "/root/testdata/sf0.001"))


lengths = st.sampled_from([1, 2, 59, 3600, 86_400, 86_401, 1 << 20, 31_536_000, 5 * 31_536_000])
spans = st.lists(st.tuples(st.sampled_from([1, 2, None]), st.integers(0, 3 * 31_536_000), lengths), min_size=1, max_size=12)
moments = st.lists(st.tuples(st.sampled_from([1, 2, None]), st.integers(0, 6 * 31_536_000)), min_size=1, max_size=20)


@quick
@given(left=moments, right=spans)
def test_intervals_from_seconds_to_years(spark, left, right):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    left = left + [(k, s + d) for k, s, n in right for d in (-1, 0, n - 1, n)]  # the ends of every interval
    a, b = [(i, k, at(s)) for i, (k, s) in enumerate(left)], [(100 + i, k, at(s), at(s + n)) for i, (k, s, n) in enumerate(right)]
    b += [(900, 1, at(5), at(5)), (901, 1, at(9), at(3)), (902, 1, None, at(3)), (903, 1, at(3), None)]
    found = interval_join(spark.createDataFrame(a, "id long, k int, ts timestamp_ntz"), spark.createDataFrame(b, "rid long, k int, low timestamp_ntz, high timestamp_ntz"), "k", "ts", "low", "high")
    want = [(i, r) for i, k, t in a for r, j, u, v in b if k is not None and k == j and u is not None and v is not None and u <= t < v]
    assert sorted((r["id"], r["rid"]) for r in found.collect()) == sorted(want)


def test_an_interval_is_copied_twice_at_most(spark):
    rows = [(i, 1, T0 + dt.timedelta(seconds=i * 997), T0 + dt.timedelta(seconds=i * 997 + n)) for i, n in enumerate([1, 60, 86_400, 31_536_000, 10 * 31_536_000] * 40)]
    right = spark.createDataFrame(rows, "rid long, k int, low timestamp_ntz, high timestamp_ntz")
    left = spark.createDataFrame([(0, 1, T0)], "id long, k int, ts timestamp_ntz")
    joined = interval_join(left, right, "k", "ts", "low", "high")
    joined.collect()
    import re

    plan = joined._jdf.queryExecution().executedPlan()
    made = [int(m["value"]) for m in _metrics(plan) if re.search("Generate", m["node"])]
    assert made and max(made) <= 2 * len(rows)


def _metrics(plan):
    """Output rows of every node of an executed plan."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        yield from _metrics(plan.executedPlan())
        return
    if name.endswith("QueryStageExec"):
        yield from _metrics(plan.plan())
        return
    metrics = plan.metrics()
    if metrics.contains("numOutputRows"):
        yield {"node": plan.nodeName(), "value": metrics.apply("numOutputRows").value()}
    children = plan.children()
    for i in range(children.size()):
        yield from _metrics(children.apply(i))


def test_lateral_joins_have_no_nested_loop(spark):
    for query in (join_lateral_top, join_lateral_aggregate):
        plan = _plan(query(spark, "/root/testdata/sf0.001"))
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert "WindowGroupLimit" in _plan(join_lateral_top(spark, "/root/testdata/sf0.001"))


def test_lateral_keeps_rows_without_a_match(spark):
    outer = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    inner = spark.createDataFrame([(1, 5), (1, 7), (1, 6), (3, 1), (None, 2)], "j int, v int")
    found = top_of_each(outer, inner, "k", "j", [F.desc("v")], 2)
    assert sorted(map(str, found.select("k", "v").collect())) == sorted(["Row(k=1, v=7)", "Row(k=1, v=6)", "Row(k=2, v=None)", "Row(k=None, v=None)"])
