"""Incremental maintenance as Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackroom.operators import index as ix
from stackroom.shared import materialize, scratch


def dedup_stream(stream: DataFrame, key: str, time_col: str | None = None, delay: str = "1 day") -> DataFrame:
    """The first row of each key. With a time column, state is dropped once it is older than delay."""
    if time_col is None:
        return stream.dropDuplicates([key])
    return stream.withWatermark(time_col, delay).dropDuplicatesWithinWatermark([key])


def index_stream(stream: DataFrame, path: str, checkpoint: str):
    """Keeps versions of postings and statistics below path: each micro-batch adds the rows of its records.

    Readers take the newest version of a record (``current``), so no file is rewritten and
    a batch that runs twice writes the same version.
    """

    def write(batch: DataFrame, version: int) -> None:
        batch = batch.persist()
        for name, table in (("postings", ix.postings(batch)), ("docstats", ix.docstats(batch))):
            table.withColumn("version", F.lit(version)).write.mode("overwrite").parquet(f"{path}/{name}/batch={version}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The rows of the newest version of each record."""
    rows = spark.read.parquet(f"{path}/{name}")
    newest = spark.read.parquet(f"{path}/docstats").groupBy("record_id").agg(F.max("version").alias("version"))
    return rows.join(newest, ["record_id", "version"]).drop("version", "batch")


def stale(records: DataFrame, stored: DataFrame, signature) -> DataFrame:
    """Records whose signature is not the stored one: what a vector refresh has to embed again."""
    now = records.withColumn("sig", signature)
    return now.join(stored.select("record_id", F.col("sig").alias("__stored")), "record_id", "left").where(~F.col("sig").eqNullSafe(F.col("__stored"))).drop("__stored")


def refresh(records: DataFrame, stored: DataFrame, signature, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Vectors (record_id, sig, vector) of all records: those stored with the signature that the record still has, and
    new ones, by embed(records), of the others. Vectors of records that are gone go."""
    # written once: signatures read whole texts and are needed three times
    now = materialize(records.select("record_id", signature.alias("sig")), "signatures")
    todo = stale(now, stored, F.col("sig"))
    made = embed(records.join(todo.select("record_id"), "record_id", "left_semi")).join(todo, "record_id").select("record_id", "sig", "vector")
    return stored.select("record_id", "sig", "vector").join(now, ["record_id", "sig"], "left_semi").unionByName(made)


def save_vectors(vectors: DataFrame, path: str) -> None:
    vectors.select("record_id", "sig", "vector").write.mode("overwrite").parquet(path)


def load_vectors(spark: SparkSession, path: str, id_type: str = "string") -> DataFrame:
    """Stored vectors; none if there are none or they can't be read, so that all are made again."""
    schema = f"record_id {id_type}, sig string, vector array<double>"
    try:
        rows = spark.read.parquet(path)
        return rows.select("record_id", "sig", "vector") if {"record_id", "sig", "vector"} <= set(rows.columns) else spark.createDataFrame([], schema)
    except (AnalysisException, Py4JJavaError):
        return spark.createDataFrame([], schema)


def run_through(stream: DataFrame, name: str, complete: bool = False) -> DataFrame:
    """All available input of a stream, written to a table in the shared folder and read back.

    complete: the stream is an aggregation, of which each batch writes the whole result.
    """
    spark = stream.sparkSession
    path = scratch(spark, name)
    sink = stream.writeStream.option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True)
    if complete:
        sink = sink.outputMode("complete").foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path))
    else:
        sink = sink.format("parquet").option("path", path)
    sink.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
