"""Session helpers: where intermediate results live and how lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession

_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local-mode session (tests, a laptop) may go without the setting; it
    then gets one private temporary folder.  On a cluster a missing setting is
    an error, because a machine-local folder would lose data with its machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="lineloom-")
    return _local_dirs[app]


def scratch_root(spark: SparkSession) -> str:
    """The application's own folder under the shared one."""
    return f"{shared_dir(spark)}/lineloom/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path for one result; never reused, so retries cannot collide."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete what this application wrote; no DataFrame may still read it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame, label: str, **metrics) -> tuple[DataFrame, dict]:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the plan's lineage, survives executor loss, keeps column pruning and
    gives the optimizer real file sizes for its join choices.  ``metrics`` are
    named aggregate columns computed while writing, so loops get their stop
    condition without a second job.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    observed = {}
    if metrics:
        probe = Observation()
        watched = df.observe(probe, *[c.alias(n) for n, c in metrics.items()])
        watched.write.parquet(path)
        observed = probe.get
    else:
        df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.scratch = path
    return stored, observed


def discard(*stored: DataFrame) -> None:
    """Delete tables of ``materialize`` that no result reads any more."""
    for df in stored:
        where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.scratch)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
