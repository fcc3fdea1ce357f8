"""Parquet store by month: snapshots, latest day, replacement of a period, calendar check."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _by_month(df: DataFrame) -> DataFrame:
    return df.withColumn("month", F.date_format("date", "yyyy-MM"))


def save_snapshot(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write all rows, partitioned by month; rows of a month are gathered before writing, so files stay few."""
    _by_month(df).repartition("month", F.pmod(F.xxhash64("fund_code"), F.lit(8))).sortWithinPartitions("fund_code", "date").write.mode(mode).partitionBy("month").parquet(path)


def load_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("month")


def latest_date(spark: SparkSession, path: str) -> dt.date | None:
    """The last day of the store; None if there is none yet."""
    try:
        return spark.read.option("aggregatePushdown", True).parquet(path).agg(F.max("date")).first()[0]
    except Exception:  # an absent path or an empty folder
        return None


def replaced(old: DataFrame, new: DataFrame, start) -> DataFrame:
    """Old rows before ``start`` and the new ones from it on."""
    s = F.lit(str(start)).cast("date")
    return old.filter((F.col("date") < s) | F.col("date").isNull()).unionByName(new.filter(F.col("date") >= s))


def replace_period(spark: SparkSession, path: str, new: DataFrame, start: dt.date) -> bool:
    """Replace the rows from ``start`` on; only months from it on are rewritten. Nothing happens if ``new`` is empty.

    Months after the start that the new rows lack lose their old rows as well.
    """
    from terazi.session import cut

    if new.isEmpty():
        return False
    month = start.strftime("%Y-%m")
    old = spark.read.parquet(path)
    touched = old.filter(F.col("month") >= month)
    keep = cut(replaced(touched.drop("month"), new, start))  # written aside first: the months it came from are overwritten
    stale = [r[0] for r in touched.select("month").distinct().collect()]  # one row per month
    have = {r[0] for r in _by_month(keep).select("month").distinct().collect()}
    mode = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        save_snapshot(keep, path)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", mode)
    jvm = spark.sparkContext._jvm
    for m in stale:
        if m not in have:
            p = jvm.org.apache.hadoop.fs.Path(f"{path}/month={m}")
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    return True


def update_start(latest: dt.date | None, end: dt.date, overlap_days: int = 2, years: int = 5) -> dt.date:
    """First day to fetch: a little before the store's last, so late corrections come in; years back for an empty store."""
    if latest is not None:
        return latest - dt.timedelta(days=overlap_days)
    try:
        return end.replace(year=end.year - years)
    except ValueError:
        return end.replace(year=end.year - years, day=28)


def update_store(spark: SparkSession, path: str, end: dt.date, base_url: str, fund_type: str = "EMK", **options) -> bool:
    """Fetch from a little before the store's last day (years back for an empty one) to ``end`` and replace that period in both tables.

    A month that doesn't answer is an error before anything is replaced; False if there was nothing to fetch.
    """
    from terazi.session import cut
    from terazi.sources.fetch import read_api

    start = update_start(latest_date(spark, f"{path}/general"), end)
    if start > end:
        return False
    general, allocation = (cut(x) for x in read_api(spark, str(start), str(end), base_url, fund_type, **options))  # complete, or an error here
    for name, new in (("general", general), ("allocation", allocation)):
        if latest_date(spark, f"{path}/{name}") is None:
            save_snapshot(new, f"{path}/{name}")
        else:
            replace_period(spark, f"{path}/{name}", new, start)
    return True


def calendar_gaps(panel: DataFrame, holidays: DataFrame) -> DataFrame:
    """Business days between the first and last day of a panel on which no fund has a row. holidays: a column date."""
    bounds = panel.agg(F.min("date").alias("a"), F.max("date").alias("b")).filter("a is not null")
    days = bounds.select(F.explode(F.sequence("a", "b")).alias("date")).filter(F.weekday("date") < 5)
    return days.join(holidays.select("date"), "date", "left_anti").join(panel.select("date").distinct(), "date", "left_anti")
