"""Sources and sinks: CSV, Parquet, SQLite, JSON lines, vendor frames, Markdown and CSV files."""

from __future__ import annotations

import sqlite3
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terazi.functions.labels import day_of
from terazi.operators.dna import to_long

GENERAL_SCHEMA = "fund_code string, fund_name string, date date, price double, units double, holders bigint, aum double"
ALLOCATION_SCHEMA = "fund_code string, date date, code string, weight double"
#: Canonical name of each vendor column (compared in lower case).
NAMES = {"fonkodu": "fund_code", "fonunvan": "fund_name", "tarih": "date", "fiyat": "price", "tedpaysayisi": "units", "kisisayisi": "holders", "portfoybuyukluk": "aum"}
#: Tables of a SQLite file.
GENERAL_TABLE, ALLOCATION_TABLE = "fon_genel_bilgiler", "fon_dagilim_bilgileri"


def canonical_general(df: DataFrame) -> DataFrame:
    """Vendor columns to the general schema; text dates and numbers are parsed, bad values become null, NaN too."""
    by = {c.lower(): c for c in df.columns}
    named = {NAMES.get(k, k): v for k, v in by.items()}
    missing = [c for c in ("fund_code", "date", "price", "units", "aum") if c not in named]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")

    def number(c: str):
        x = F.col(f"`{named[c]}`").try_cast("double") if c in named else F.lit(None).cast("double")
        return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)

    date = F.col(f"`{named['date']}`")
    if dict(df.dtypes)[named["date"]] == "string":
        date = day_of(date)
    return df.select(
        F.upper(F.trim(F.col(f"`{named['fund_code']}`"))).alias("fund_code"), (F.col(f"`{named['fund_name']}`") if "fund_name" in named else F.lit(None).cast("string")).alias("fund_name"), date.cast("date").alias("date"),
        number("price").alias("price"), number("units").alias("units"), number("holders").cast("bigint").alias("holders"), number("aum").alias("aum"),
    )


def canonical_allocation(df: DataFrame) -> DataFrame:
    """Wide vendor allocation to the long schema."""
    by = {c.lower(): c for c in df.columns}
    named = df.withColumnsRenamed({v: NAMES[k] for k, v in by.items() if k in NAMES})
    if dict(named.dtypes)["date"] == "string":
        named = named.withColumn("date", day_of(F.col("date")))
    return to_long(named.withColumns({"date": F.col("date").cast("date"), "fund_code": F.upper(F.trim("fund_code"))}))


def read_csv(spark: SparkSession, general: str, allocation: str) -> tuple[DataFrame, DataFrame]:
    """Two CSV files with headers; types come from the schemas, not from the data."""
    read = lambda p: spark.read.option("header", True).csv(p)
    return canonical_general(read(general)), canonical_allocation(read(allocation))


def read_parquet(spark: SparkSession, general: str, allocation: str) -> tuple[DataFrame, DataFrame]:
    return canonical_general(spark.read.parquet(general)), canonical_allocation(spark.read.parquet(allocation))


def read_sqlite(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Both tables of a SQLite file, read on the driver in chunks (a single-machine format, for import only)."""

    def table(name: str) -> DataFrame:
        with sqlite3.connect(path) as db:
            cursor = db.execute(f"select * from {name}")
            columns = [c[0] for c in cursor.description]
            out, schema = None, ", ".join(f"`{c}` string" for c in columns)
            while rows := cursor.fetchmany(200_000):
                part = spark.createDataFrame([[None if v is None else str(v) for v in r] for r in rows], schema)
                out = part if out is None else out.unionByName(part)
            return out if out is not None else spark.createDataFrame([], schema)

    return canonical_general(table(GENERAL_TABLE)), canonical_allocation(table(ALLOCATION_TABLE))


def split_vendor_frame(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A merged upper-case frame to general and long allocation; ValueError without keys; the display price is dropped."""
    by = {c.upper(): c for c in df.columns}
    if not {"FONKODU", "TARIH"} <= set(by):
        raise ValueError("FONKODU and TARIH are needed")
    general_columns = {c.upper() for c in NAMES} | {"FIYAT_6DEC", "BORSABULTENFIYAT"}
    codes = [by[c] for c in by if c not in general_columns]
    general = canonical_general(df.select(*(by[c] for c in by if c in {n.upper() for n in NAMES})))
    return general, canonical_allocation(df.select(by["FONKODU"], by["TARIH"], *codes))


def from_frames(general: DataFrame, allocation: DataFrame) -> tuple[DataFrame, DataFrame]:
    return canonical_general(general), canonical_allocation(allocation)


SOURCES: dict[str, Callable] = {"csv": read_csv, "parquet": read_parquet, "sqlite": read_sqlite}


def load(spark: SparkSession, source: str, **options) -> tuple[DataFrame, DataFrame]:
    """General and allocation of a named source; ValueError for another name."""
    if source == "api":
        from terazi.sources.fetch import read_api

        return read_api(spark, **options)
    if source not in SOURCES:
        raise ValueError(f"unknown source {source!r}: csv, parquet, sqlite or api")
    return SOURCES[source](spark, **options)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed lines of a text file, without blanks and those that begin with #."""
    return spark.read.text(path).select(F.trim("value").alias("value")).filter("value <> '' and value not like '#%'")


def write_markdown(text: str, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(text, encoding="utf-8")


def write_csv(df: DataFrame, path: str) -> None:
    """CSV files with a header, one per partition."""
    df.write.mode("overwrite").option("header", True).csv(path)
