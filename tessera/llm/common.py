"""Shared plumbing of the text operators: worker set-up, shared scratch tables, bounded batches."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows in one Arrow batch. Texts run to hundreds of kilobytes, so Spark's default of 10,000 rows is too many.
BATCH_ROWS = 1000

#: Workers live on between tasks; with these, arrays above 2 MB go back to the system as soon as they are freed.
LEAN = {"MALLOC_MMAP_THRESHOLD_": "2097152", "MALLOC_TRIM_THRESHOLD_": "2097152", "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package, bound their batches, and make sure a shared scratch folder is set."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    for name, value in LEAN.items():
        env.setdefault(name, value)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    shared_dir(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir. Where that is unset, one of this machine in local mode; an error on a cluster, whose machines would not share it."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        named = sc.getCheckpointDir()
    return named


#: Written tables that are still there.
_TABLES: set[str] = set()


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: the lineage ends there, and a lost executor costs no recomputation.

    The table goes by release(), or when this process ends.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _TABLES.add(path)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete kept tables that nothing is to read any more: what was made from them is itself kept, or was collected."""
    for table in tables:
        _delete(table.sparkSession, table.kept_at)


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    there = sc._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(sc._jsc.hadoopConfiguration()).delete(there, True)
    _TABLES.discard(path)


@atexit.register
def _clean() -> None:
    """Delete what is left, if Spark still runs."""
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        for path in sorted(_TABLES):
            _delete(spark, path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df has not, made from names; working columns never clash with a caller's."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
