"""Reading and writing tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lineloom.sources import versions


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def path_exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def create_table(df: DataFrame, path: str, replace: bool = False) -> DataFrame:
    """CREATE [OR REPLACE] TABLE AS: without ``replace`` an existing table is an error.

    Each call writes a new version and then makes it current, so ``df`` may read the table that it
    replaces, and a failed write leaves the table as it was.
    """
    spark = df.sparkSession
    if not replace and path_exists(spark, path):
        raise FileExistsError(f"table {path} exists")
    data = versions.new_version(path)
    df.write.parquet(data)
    versions.publish(spark, path, data)
    return spark.read.schema(df.schema).parquet(data)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The current version of a table that ``create_table`` made."""
    data = versions.current(spark, path)
    if data is None:
        raise FileNotFoundError(f"no table at {path}")
    return spark.read.parquet(data)


def create_view(df: DataFrame, name: str, replace: bool = False) -> DataFrame:
    """CREATE [OR REPLACE] VIEW AS, as a session view."""
    if replace:
        df.createOrReplaceTempView(name)
    else:
        df.createTempView(name)
    return df.sparkSession.table(name)


def _partitions(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(partition folder, write that holds it) of the current version, as its manifest lists them."""
    manifest = versions.current(spark, path)
    return [] if manifest is None else [tuple(r) for r in spark.read.schema("folder string, holder string").parquet(manifest).collect()]


def _put(df: DataFrame, path: str, columns: tuple[str, ...], replaced) -> DataFrame:
    """Write ``df`` beside the table and publish a manifest of its partitions and the old ones that ``replaced`` spares."""
    spark, base = df.sparkSession, path.rstrip("/")
    holder = uuid.uuid4().hex
    data = f"{base}/data/holder={holder}"
    # The hint gathers each partition value into few files and lets adaptive execution split a large one.
    df.hint("rebalance", *columns).write.partitionBy(*columns).parquet(data)
    where = spark._jvm.org.apache.hadoop.fs.Path(data + "/*=*" * len(columns))
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    new = ["/".join(f.getPath().toString().rsplit("/", len(columns))[1:]) for f in found]
    old = [(folder, by) for folder, by in _partitions(spark, base) if not replaced(folder, set(new))]
    manifest = versions.new_version(base)
    spark.createDataFrame(old + [(f, holder) for f in new], "folder string, holder string").coalesce(1).write.parquet(manifest)
    versions.publish(spark, base, manifest)
    return read_partitioned(spark, base, df.schema)


def write_partitioned(df: DataFrame, path: str, *columns: str) -> DataFrame:
    """Table partitioned by columns, in place of what was there.

    Each write has a folder of its own, and a manifest, one row per partition, becomes current when all is written.  So ``df`` may read the
    table that it replaces, a reader sees the old table or the new one, and a failed write changes nothing.
    """
    return _put(df, path, columns, lambda folder, new: True)


def replace_partitions(df: DataFrame, path: str, *columns: str) -> DataFrame:
    """The partitions that ``df`` has rows of are replaced as a whole, all at once; the others stay as they are.

    Writing a day twice leaves one copy of it.  Of two writers at once the later marker decides for all partitions, so
    writers of one table take turns.
    """
    return _put(df, path, columns, lambda folder, new: folder in new)


def read_partitioned(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The current partitions; readers made before a later write go on seeing theirs."""
    base = path.rstrip("/")
    folders = [f"{base}/data/holder={by}/{folder}" for folder, by in _partitions(spark, base)]
    if not folders:
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(T.StructType([*schema.fields, T.StructField("holder", T.StringType())]))
    return reader.option("basePath", f"{base}/data").parquet(*folders).select(*[F.col(f"`{c}`") for c in schema.names])


def drop_unused(spark: SparkSession, path: str) -> None:
    """Delete old manifests and the data that no current partition reads, once nothing reads them any more."""
    base = path.rstrip("/")
    versions.drop_old(spark, base)
    used = {by for _, by in _partitions(spark, base)}
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/data")
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.listStatus(where) if fs.exists(where) else []:
        if status.getPath().getName().removeprefix("holder=") not in used:
            fs.delete(status.getPath(), True)
