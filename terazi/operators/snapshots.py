"""What changed between full snapshots (problem 5).

All snapshots are range-partitioned by key and sorted by snapshot and key inside each
range. A task walks the snapshots of its range in order and merges each with the one
before it with two pointers; it holds the keys of one range and two snapshots at most, and
there are as many ranges as keep a range under ``RANGE_ROWS`` rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terazi.operators.series import BLANKS, source_code
from terazi.session import shuffle_partitions

OUT = "fonkodu string, tarih int, change string, field string, old_value string, new_value string"
NAMES = [x.split()[0] for x in OUT.split(", ")]
#: Rows of a range, all snapshots together.
RANGE_ROWS = 400_000


def title(c: Column) -> Column:
    """Title without leading, trailing and repeated blanks; null stays null."""
    return F.regexp_replace(F.btrim(c, F.lit(BLANKS)), "[ \\t\\r\\n\\u00a0]+", " ")


def merge(old: list[tuple], new: list[tuple]) -> Iterator[tuple]:
    """Two-pointer merge of two lists of (key, values), sorted by key without repeats: key, change, old and new values."""
    i = j = 0
    while i < len(old) or j < len(new):
        if j == len(new) or (i < len(old) and old[i][0] < new[j][0]):
            yield old[i][0], "removed", old[i][1], None
            i += 1
        elif i == len(old) or new[j][0] < old[i][0]:
            yield new[j][0], "added", None, new[j][1]
            j += 1
        else:
            if old[i][1] != new[j][1]:
                yield new[j][0], "changed", old[i][1], new[j][1]
            i += 1
            j += 1


def snapshot_changes(snapshots: DataFrame, compare: tuple[str, ...] = ("fonunvan",), range_rows: int = RANGE_ROWS) -> DataFrame:
    """Typed changes between neighbouring snapshots: fonkodu, tarih (yyyy-MM-dd, the later), change, field, old_value, new_value.

    change is added or removed (a row for each compared column, with its value) or changed (a row for each compared
    column that differs: text by more than blanks; a null differs from any value). Of a snapshot delivered more than once
    only the highest teslim_no counts (null is the lowest). Repeated rows count once; of rows of one key and delivery
    with different values the smallest counts, by the compared columns in order. Rows without key or day are ignored,
    but a day delivered empty can't be seen. The first snapshot and an empty table give nothing.
    """
    spark = snapshots.sparkSession
    text = [F.col(f"`{c}`").cast("string") for c in compare]
    values = [title(x) if kind == "string" else x for x, kind in zip(text, (dict(snapshots.dtypes)[c] for c in compare), strict=True)]
    rows = snapshots.select(
        F.unix_date(F.col("tarih").cast("date")).alias("day"), F.coalesce(F.col("teslim_no").cast("bigint"), F.lit(-(2**62))).alias("delivery"), source_code(F.col("fonkodu")).alias("k"), *(v.alias(f"v{i}") for i, v in enumerate(values)),
    ).filter("day is not null")
    # one row per day: its number doesn't grow with the rows of a snapshot
    found = sorted(tuple(r) for r in rows.groupBy("day").agg(F.max("delivery"), F.count("*")).collect())
    days = [d for d, _, _ in found]
    number = spark.createDataFrame([(d, n, i) for i, (d, n, _) in enumerate(found)], "day int, delivery long, at int")
    names = [f"v{i}" for i in range(len(compare))]
    one = F.min("v0").alias("v0") if len(compare) == 1 else F.min(F.struct(*names)).alias("v")
    last = rows.join(F.broadcast(number), ["day", "delivery"]).filter("k is not null").groupBy("k", "at").agg(one)
    last = last if len(compare) == 1 else last.select("k", "at", "v.*")
    parts = max(shuffle_partitions(spark), -(-sum(n for _, _, n in found) // range_rows))
    ranged = last.repartitionByRange(parts, "k").sortWithinPartitions("at", "k")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        old: list[tuple] = []
        new: list[tuple] = []
        at = 0

        def step(to: int) -> list[tuple]:
            nonlocal old, new, at
            out = []
            while at < to:
                if at:
                    for k, what, a, b in merge(old, new):
                        out += [(k, days[at], what, c, a and a[i], b and b[i]) for i, c in enumerate(compare) if what != "changed" or a[i] != b[i]]
                old, new, at = new, [], at + 1
                if not old and not new and at < to:
                    at = to
            return out

        for pdf in batches:
            out = []
            for k, n, *v in zip(pdf["k"], pdf["at"], *(pdf[c] for c in names), strict=True):
                if n != at:
                    out += step(n)
                new.append((k, tuple(v)))
            if out:
                yield pd.DataFrame(out, columns=NAMES)
        if (new or old) and (out := step(min(at + 2, len(days)))):
            yield pd.DataFrame(out, columns=NAMES)

    return ranged.mapInPandas(walk, OUT).withColumn("tarih", F.date_format(F.date_from_unix_date("tarih"), "yyyy-MM-dd"))
