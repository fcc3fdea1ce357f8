"""Streaming ingest of late and corrected rows into the monthly store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from terazi.operators.panel import dedupe_last
from terazi.sources.readers import GENERAL_SCHEMA
from terazi.sources.store import load_store, replace_period, save_snapshot


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether the store has any entry; an error of the file system rises."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.exists(p) and len(files.listStatus(p)) > 0


def upsert(spark: SparkSession, batch: DataFrame, path: str, sequence: str | None = None) -> None:
    """Bring a batch into the store: a row with the same fund and day replaces the old one. Months without news stay untouched.

    Of rows of one batch with the same fund and day that with the highest ``sequence`` (a column of the batch that tells
    the order of arrival) counts, without one the last in the batch's order. Only where nothing is stored yet a store is
    begun; a store that can't be opened is an error and stays as it is.
    """
    new = batch.filter("date is not null and fund_code is not null").withColumn("@seq", F.col(sequence) if sequence else F.monotonically_increasing_id())
    if sequence:
        new = new.drop(sequence)
    new = dedupe_last(new, ["fund_code", "date"], "@seq").drop("@seq")
    first = new.agg(F.min("date")).first()[0]
    if first is None:
        return
    if not _exists(spark, path):
        save_snapshot(new, path)
        return
    old = load_store(spark, path).filter(F.col("date") >= F.lit(first))
    both = old.withColumn("@new", F.lit(0)).unionByName(new.withColumn("@new", F.lit(1)))
    replace_period(spark, path, dedupe_last(both, ["fund_code", "date"], "@new").drop("@new"), first)


def stream_general(spark: SparkSession, source: str, path: str, checkpoint: str, schema: str = GENERAL_SCHEMA, sequence: str | None = None) -> StreamingQuery:
    """Follow a folder of Parquet files; every micro-batch is an upsert, so a repeated batch changes nothing."""
    rows = spark.readStream.schema(schema).parquet(source)
    return rows.writeStream.foreachBatch(lambda batch, _: upsert(batch.sparkSession, batch, path, sequence)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_totals(rows: DataFrame, time: str = "ts", delay: str = "1 day") -> DataFrame:
    """Counts and sums of an event stream per day and type, late rows up to ``delay``."""
    return rows.withWatermark(time, delay).groupBy(F.window(time, "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("day"), "event_type", "n", "total")
