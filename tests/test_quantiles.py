"""Exact quantiles against sorting, on values of every size."""

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import quantiles
from tests.test_catalogue import SF

quick = settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
values = st.one_of(st.none(), st.floats(allow_nan=True, allow_infinity=True), st.sampled_from([0.0, -0.0, 5e-324, -5e-324, 1.7976931348623157e308, -1.7976931348623157e308, 1.0, 1.0000000000000002]))


def _ranks(rows):
    by = {}
    for k, v in rows:
        if v is not None and not math.isnan(v):
            by.setdefault(k, []).append(v + 0.0)
    return {(k, i): v for k, vs in by.items() for i, v in enumerate(sorted(vs))}


@quick
@given(rows=st.lists(st.tuples(st.sampled_from(["a", "b", None]), values), max_size=25))
def test_every_rank(spark, rows):
    want = _ranks(rows)
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    asked = spark.createDataFrame([(k, r) for k in ("a", "b", None) for r in range(-1, 26)], "k string, rank long")
    found = quantiles.order_statistics(df, ["k"], "v", asked).collect()
    assert len(found) == len(want)
    assert {(r["k"], r["rank"]): r["value"] for r in found} == want


@pytest.mark.parametrize("spread", ["exponents", "copies", "near"])
def test_hard_distributions(spark, monkeypatch, spread):
    """Values over all exponents, one value in a third of all rows, and neighbours a bit apart, with few buckets."""
    monkeypatch.setattr(quantiles, "BUCKETS", 64)
    rng = np.random.default_rng(1)
    x = {"exponents": np.ldexp(rng.standard_normal(3000), rng.integers(-1000, 1000, 3000)), "copies": np.where(rng.random(3000) < 0.4, 7.5, rng.standard_normal(3000)), "near": 1 + rng.integers(0, 500, 3000) * 2.0**-52}[spread]
    df = spark.createDataFrame([(v,) for v in x.tolist()], "v double").withColumn("g", F.lit(1))
    got = quantiles.exact_quantiles(df, ["g"], "v", [0.0, 0.25, 0.5, 0.9, 1.0]).first()
    want = np.sort(x)
    assert got["n"] == 3000 and got["q0"] == want[0] and got["q4"] == want[-1]
    for name, q in (("q1", 0.25), ("q2", 0.5), ("q3", 0.9)):
        low, part = divmod(q * 2999, 1)
        a, b = want[int(low)], want[int(low) + 1]
        assert got[name] == (a if a == b else a * (1 - part) + b * part)


def test_same_as_the_built_in_function(spark):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    got = {(r[0], r[1]): r[2:] for r in quantiles.exact_quantiles(lines, ["l_returnflag", "l_linestatus"], "l_tax", [0.1, 0.5]).collect()}
    want = lines.groupBy("l_returnflag", "l_linestatus").agg(F.count("l_tax"), F.percentile("l_tax", 0.1), F.percentile("l_tax", 0.5)).collect()
    assert got.keys() == {(r[0], r[1]) for r in want}
    assert all(got[r[0], r[1]] == pytest.approx(tuple(r[2:]), abs=1e-12) for r in want)


def test_empty(spark):
    df = spark.createDataFrame([("a", None), ("b", math.nan)], "k string, v double")
    assert quantiles.exact_quantiles(df, ["k"], "v", [0.5]).count() == 0
    assert quantiles.exact_quantiles(df.limit(0), ["k"], "v", [0.5]).count() == 0


def test_percentiles_hold_no_group(spark, tmp_path):
    """No task gets a group's values; NaN and groups without values are as in SQL."""
    from tessera import catalogue
    from tests.oracle import connect, differences

    rows = [("a", float(i * 7 % 101) / 8) for i in range(50)] + [("b", None), (None, 2.5), (None, 3.25), ("c", math.nan), ("c", 1.0), ("c", 2.0), ("d", None), ("d", math.nan), ("d", 4.0), ("e", math.inf), ("e", 1.0), ("e", 0.5)]
    spark.createDataFrame(rows, "l_returnflag string, l_extendedprice double").coalesce(1).write.parquet(f"{tmp_path}/t")
    (next((tmp_path / "t").glob("*.parquet"))).rename(tmp_path / "lineitem.parquet")
    found = catalogue.queries()["percentiles"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in plan and "median(" not in plan
    # NaN equals nothing, so it is compared as a great number
    told = "SELECT l_returnflag, if(isnan(quarter), 1e300, quarter) AS quarter, if(isnan(middle), 1e300, middle) AS middle FROM "
    mine = found.selectExpr("l_returnflag", "if(isnan(quarter), 1e300D, quarter) quarter", "if(isnan(middle), 1e300D, middle) middle")
    assert not differences(mine, connect(str(tmp_path)), f"{told} ({catalogue.oracle_sql()['percentiles']})")
