"""Irregular readings: cleaning, splitting of hot sources, streaming by source.

A source that holds a large share of all rows is cut into blocks along time, so no
task ever receives an unbounded group. Operators hand state from block to block
through a summary of fixed size per block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terazi.session import cut

BLANKS = " \t\r\n "
#: Most rows of one source that a task handles at once; larger sources are cut.
BLOCK_ROWS = 100_000
#: Hot sources at most: the least size of one rises with the table, so that there can't be more.
HOT_LIST = 500_000
#: Hot sources that are named in the filter itself; more are sent as a table.
NAMED = 2_000
NO_TIME = -(2**63) + 1
DAY_MICROS = 86_400_000_000


def source_code(c: Column) -> Column:
    """Trimmed, upper-case code; null when nothing is left."""
    code = F.upper(F.btrim(c, F.lit(BLANKS)))
    return F.when(code != "", code)


def micros(c: Column, df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone."""
    if dict(df.dtypes)[name] == "date":
        return F.unix_date(c).cast("bigint") * F.lit(86_400_000_000)
    return F.unix_micros(c.cast("timestamp"))


def reading_rows(general: DataFrame, *extra: Column) -> DataFrame:
    """All rows with a source and a moment: ``fund, t, loaded, row_id, unpublished`` and ``extra``.

    Rows are not yet unique; ``latest`` (SQL) or ``latest_in`` (streamed) keeps, of the
    rows with the same source and moment, the one loaded last.
    """
    zero = F.lit(True)
    for c in ("fiyat", "tedpaysayisi", "portfoybuyukluk"):
        zero = zero & F.coalesce(F.col(c) == 0, F.lit(False))
    return general.select(
        source_code(F.col("fonkodu")).alias("fund"),
        micros(F.col("tarih"), general, "tarih").alias("t"),
        F.coalesce(micros(F.col("yukleme"), general, "yukleme"), F.lit(NO_TIME)).alias("loaded"),
        F.coalesce(F.col("kayit_no"), F.lit(NO_TIME)).alias("row_id"),
        zero.alias("unpublished"),
        *extra,
    ).filter("fund is not null and t is not null")


def finite(c: Column) -> Column:
    """Double value; NaN and infinities become null."""
    x = c.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


@dataclass(frozen=True)
class Split:
    """Rows of ordinary sources, and of hot sources with a ``block`` number (None if there are none)."""

    cold: DataFrame
    hot: DataFrame | None


def split_hot(rows: DataFrame, block_rows: int = BLOCK_ROWS, hot_list: int = HOT_LIST, named: int = NAMED) -> Split:
    """Cut sources of more than ``block_rows`` rows into blocks of neighbouring moments, of about half as many rows.

    Counts are combined map-side, one row per source leaves a task. At most ``hot_list`` sources can have more than
    total / ``hot_list`` rows; that is the limit where it is larger, so the list that is sent is bounded whatever
    the table. Their rows are range-partitioned by source and moment (by Spark's sample of the rows, so bunched
    readings make short blocks) and written once with the number of their partition, the block; rows of one source
    and moment share a block.
    """
    spark = rows.sparkSession
    counts = rows.groupBy("fund").agg(F.count("*").alias("n"))
    limit = block_rows
    found = counts.filter(F.col("n") > limit).limit(hot_list + 1).collect()
    if len(found) > hot_list:
        limit = -(-counts.agg(F.sum("n")).first()[0] // hot_list)
        found = counts.filter(F.col("n") > limit).collect()
    if not found:
        return Split(rows, None)
    names = [r["fund"] for r in found]
    if len(names) <= named:
        hot, cold = rows.filter(F.col("fund").isin(names)), rows.filter(~F.col("fund").isin(names))
    else:
        table = F.broadcast(spark.createDataFrame([(x,) for x in names], "fund string"))
        hot, cold = rows.join(table, "fund", "left_semi"), rows.join(table, "fund", "left_anti")
    blocks = -(-2 * sum(r["n"] for r in found) // limit)
    return Split(cold, cut(hot.repartitionByRange(blocks, "fund", "t").withColumn("block", F.spark_partition_id())))


def with_heads(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """Rows (role 1) and, before them, one row of state per source and block (role 0): no join, nothing is repeated per row."""
    filled = {f.name: F.lit(0 if f.dataType.typeName() in ("long", "integer") else False).cast(f.dataType) for f in rows.schema if f.name not in heads.columns and f.dataType.typeName() in ("long", "integer", "boolean")}
    return rows.withColumn("role", F.lit(1)).unionByName(heads.withColumns(filled | {"role": F.lit(0)}), allowMissingColumns=True)


def headed(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, pd.Series, pd.DataFrame]]:
    """Key, state and rows of each group of ``with_heads``, sorted by role; groups without either are skipped."""
    for key, pdf in groups(batches, keys):
        if len(pdf) > 1 and pdf["role"].iloc[0] == 0 and pdf["role"].iloc[1] == 1:
            yield key, pdf.iloc[0], pdf.iloc[1:]


#: Width of the bins that medians are counted in, on a logarithmic scale.
BIN = math.log(1.001)


def bins_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bins of positive values and their counts."""
    return np.unique(np.floor(np.log(x) / BIN).astype(np.int64), return_counts=True)


def binned_median(bins: np.ndarray, counts: np.ndarray) -> float:
    """Median of values counted in bins, which may repeat: the middle of the bin that reaches half. Sums of counts give the same whatever the parts."""
    order = np.argsort(bins, kind="stable")
    upto = np.cumsum(counts[order])
    return math.exp((bins[order][np.searchsorted(upto, (upto[-1] + 1) // 2)] + 0.5) * BIN)


def by_key(df: DataFrame, keys: list[str], order: list[str], parts: int) -> DataFrame:
    """Hash-partition by ``keys`` and sort, ready for ``groups``."""
    return df.repartition(parts, *keys).sortWithinPartitions(*keys, *order)


def groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Contiguous groups of sorted batches; a group may run over several batches."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        change = np.zeros(len(pdf), dtype=bool)
        for k in keys:
            v = pdf[k].to_numpy()
            change[1:] |= v[1:] != v[:-1]
        starts = np.flatnonzero(change)
        if held:
            last = held[-1].iloc[-1]
            if any(last[k] != pdf[k].iloc[0] for k in keys):
                yield _group(held, keys)
                held = []
        edges = [0, *starts.tolist(), len(pdf)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if held and a:
                yield _group(held, keys)
                held = []
            held.append(pdf.iloc[a:b])
    if held:
        yield _group(held, keys)


def _group(parts: list[pd.DataFrame], keys: list[str]) -> tuple[tuple, pd.DataFrame]:
    pdf = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
    return tuple(pdf[k].iloc[0] for k in keys), pdf


def latest_in(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of rows sorted by ``t, loaded, row_id``: the last of each moment, without unpublished moments."""
    t = pdf["t"].to_numpy()
    keep = np.ones(len(t), dtype=bool)
    keep[:-1] = t[1:] != t[:-1]
    return pdf[keep & ~pdf["unpublished"].to_numpy(dtype=bool)]
