"""Arithmetic that overflows, against Python's integers."""

import itertools
import time

from pyspark.sql import functions as F

from tessera.functions import scalar

LOW, HIGH = -(1 << 63), (1 << 63) - 1
EDGES = [None, LOW, LOW + 1, -(1 << 62), -3037000500, -3, -2, -1, 0, 1, 2, 3, 107, 3037000499, 3037000500, 1 << 62, 9223372036854775700, HIGH - 1, HIGH]


def test_sums_and_products(spark):
    rows = list(itertools.product(EDGES, EDGES))
    df = spark.createDataFrame(rows, "a long, b long")
    within = lambda x: x if LOW <= x <= HIGH else None
    want = [(None, None) if a is None or b is None else (within(a + b), within(a * b)) for a, b in rows]
    a, b = F.col("a"), F.col("b")
    for ansi in ("true", "false"):
        spark.conf.set("spark.sql.ansi.enabled", ansi)
        try:
            found = df.select("a", "b", scalar.safe_sum(a, b), scalar.safe_product(a, b)).collect()
        finally:
            spark.conf.unset("spark.sql.ansi.enabled")
        assert {tuple(r)[:2]: tuple(r)[2:] for r in found} == dict(zip(rows, want, strict=True))


def test_overflow_costs_no_more(spark, tmp_path):
    """A row that overflows takes about as long as one that does not; an error for each takes many times that."""

    def seconds(shift):
        folder = str(tmp_path / f"s{shift}")
        if not (tmp_path / f"s{shift}").exists():
            rows = spark.range(1_000_000).selectExpr("id l_orderkey", f"cast({shift} as int) l_linenumber", f"{shift} + 0 * id l_partkey")
            rows.write.parquet(f"{folder}/lineitem.parquet")
        start = time.time()
        scalar.safe_arithmetic(spark, folder).write.format("noop").mode("overwrite").save()
        return time.time() - start

    fit, over = (min(seconds(x) for _ in range(3)) for x in (1, 1000))
    assert over < 5 * fit + 0.2
