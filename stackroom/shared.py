"""The folder that the driver and all executors share, and what is kept there.

A cluster names it in ``spark.checkpoint.dir``. Only where that setting is absent
(local runs and tests, where driver and executors are one machine) is a temporary
folder made and set.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The URI or path of the shared folder, without a slash at its end."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("name a folder that the driver and all executors share in spark.checkpoint.dir")
        named = tempfile.mkdtemp(prefix="stackroom-")
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used before."""
    return f"{shared_dir(spark)}/stackroom-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Writes df as Parquet into the shared folder and returns the table read back.

    This cuts the lineage: the files survive the loss of any executor.
    """
    spark = df.sparkSession
    path = path or scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Removes a path below the shared folder through Hadoop's file system API."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def open_store(uri: str):
    """(filesystem, path) of a URI, for tasks that write or read raw files there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def deal_files(files: DataFrame, manifest: DataFrame, each: int = 256 << 20) -> DataFrame:
    """files, a row for each file of a written manifest (with their ``bytes``), dealt to tasks: about `each`
    bytes to a task, but a few tasks for each core if there are files enough."""
    n, size = manifest.agg(F.count(F.lit(1)), F.sum("bytes")).first()
    cores = manifest.sparkSession.sparkContext.defaultParallelism
    return files.repartition(max(1, min(n, max(4 * cores, (size or 0) // each))))


def small_table(spark: SparkSession, rows: list[dict], ddl: str) -> DataFrame:
    """A table of constants as a plan whose small size the planner knows (so it may broadcast it)."""
    import json

    return spark.sql(
        "SELECT inline(from_json(:rows, :ddl))", args={"rows": json.dumps(rows, ensure_ascii=False), "ddl": f"array<struct<{ddl}>>"}
    )


def fresh(columns: list[str], base: str) -> str:
    """A column name that starts with base and, whatever its case, is not among columns."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base += "_"
    return base


def named(column: str) -> Column:
    """The column of that very name, dots and backticks in it too."""
    return F.col("`" + column.replace("`", "``") + "`")


def plain_names(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with its columns named c0, c1 and so on, which functions over Arrow batches can take whatever they
    were called, and the new name of each old one."""
    now = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.select(*[named(c).alias(x) for c, x in now.items()]), now


def old_names(df: DataFrame, now: dict[str, str]) -> DataFrame:
    """The columns that plain_names() renamed, under their old names."""
    return df.select(*[F.col(x).alias(c) for c, x in now.items()])


def wide_rows(spark: SparkSession) -> None:
    """Smaller Arrow batches, for rows that hold whole texts: what Python workers take at a time is
    bounded by bytes, and by a number of rows that suits them. Settings that were changed stay."""
    for key, usual, ours in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", ("10000",), "512"),
        ("spark.sql.execution.arrow.maxBytesPerBatch", ("64MB", "67108864b"), "8MB"),
    ):
        if spark.conf.get(key) in usual:
            spark.conf.set(key, ours)
