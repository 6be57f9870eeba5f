"""Incremental feeds: news files and term counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kotonoha import fixed
from kotonoha.functions import text
from kotonoha.session import scratch_path
from kotonoha.sources import records


def stream_files(spark: SparkSession, folder: str, schema, name_filter: str | None = None,
                 fmt: str = "parquet", per_trigger: int = 100) -> DataFrame:
    """Stream of the files of ``folder``, or of the table ``name_filter`` in it, which is
    one file or a folder of files.  (A glob, as a stream's path may only so be a file.)"""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger)
    if name_filter:
        folder = f"{folder}/{name_filter[:-1]}[{name_filter[-1]}]"
    return reader.format(fmt).load(folder)


def count_terms(stream: DataFrame, col: str = "text") -> DataFrame:
    """term, freq as a stateful aggregate over arriving text."""
    tok = stream.select(F.explode(text.letter_terms(col)).alias("term"))
    return tok.groupBy("term").agg(F.count(F.lit(1)).alias("freq"))


def run_to_table(df: DataFrame, mode: str, path: str | None = None) -> str:
    """Drive a stream over all available input and keep its last state as Parquet
    below the shared folder; returns the path of the table."""
    spark = df.sparkSession
    path = path or scratch_path(spark, "stream-table")
    checkpoint = scratch_path(spark, "stream-checkpoint")

    def save(batch: DataFrame, batch_id: int) -> None:
        target = f"{path}/v={batch_id}" if mode == "complete" else f"{path}/b={batch_id}"
        batch.write.mode("overwrite").parquet(target)

    query = (df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).foreachBatch(save).start())
    query.awaitTermination()
    return path


def latest_state(spark: SparkSession, path: str) -> DataFrame:
    """The newest version written by a complete-mode stream."""
    versions = spark.read.parquet(path)
    last = versions.agg(F.max("v").alias("v"))
    return versions.join(F.broadcast(last), "v", "left_semi").drop("v")


def newest_upsert(stored: DataFrame | None, batch: DataFrame, limit: int = fixed.NEWS_LIMIT) -> DataFrame:
    """The newest entries of a stored table and a batch, one row per id."""
    every = batch if stored is None else stored.unionByName(batch)
    one = every.groupBy("id").agg(F.max_by(F.struct(*every.columns), "creation_time").alias("r")).select("r.*")
    return records.keep_newest(one, limit)


def keep_news(stream: DataFrame, path: str | None = None, limit: int = fixed.NEWS_LIMIT) -> str:
    """Follow a stream of news entries, keeping the newest ones as a table.

    Each batch writes a new version; the table holds at most ``limit`` rows.
    """
    spark = stream.sparkSession
    path = path or scratch_path(spark, "news-table")
    checkpoint = scratch_path(spark, "news-checkpoint")

    def upsert(batch: DataFrame, batch_id: int) -> None:
        stored = None
        if batch_id > 0:
            stored = spark.read.parquet(f"{path}/v={batch_id - 1}")
        newest_upsert(stored, batch, limit).write.mode("overwrite").parquet(f"{path}/v={batch_id}")

    query = (stream.writeStream.option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).foreachBatch(upsert).start())
    query.awaitTermination()
    return path


def stream_news_files(spark: SparkSession, folder: str) -> DataFrame:
    """Stream of news entries from files called ``epoch;title``."""
    files = (spark.readStream.schema("value string").option("wholetext", True).format("text").load(folder)
             .select("value", F.url_decode(F.col("_metadata.file_name")).alias("file_name")))
    return records.parse_news_files(files)
