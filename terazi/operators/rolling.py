"""Totals over trailing days by binary doubling (problem 3).

On the dense calendar of a source, s1 is the value of the day, s2 = s1 + s1 shifted by 1,
s4 = s2 + s2 shifted by 2, and so on. Any window is a sum of such blocks, shifted by
what is already covered: 7 = 4 + 2 + 1, 30 = 16 + 8 + 4 + 2. One shuffle and one sort
serve all windows, and a row costs log2(window) additions, whatever the window.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terazi.operators.series import DAY_MICROS, finite, reading_rows

MONEY = "decimal(38,2)"


def daily_last(general: DataFrame, field: str) -> DataFrame:
    """``fund, day, v``: the value of the last reading of each day; v is null if that reading has none."""
    rows = reading_rows(general, finite(F.col(field)).alias("v")).withColumn("day", F.floor(F.col("t") / DAY_MICROS).cast("int"))
    w = Window.partitionBy("fund", "day").orderBy("t", "loaded", "row_id")
    latest = rows.withColumn("next_t", F.lead("t").over(w)).filter("(next_t is null or next_t <> t) and not unpublished")
    return latest.withColumn("later", F.lead("t").over(w)).filter("later is null").select("fund", "day", "v")


def dense(daily: DataFrame) -> DataFrame:
    """One row per calendar day from a source's first to its last day; ``seen`` is 1 on days with a reading."""
    w = Window.partitionBy("fund").orderBy("day")
    end = F.coalesce(F.lead("day").over(w) - 1, F.col("day"))
    spans = daily.select("fund", F.col("day").alias("from_day"), "v", end.alias("to_day"))
    days = spans.select("fund", "from_day", "v", F.explode(F.sequence("from_day", "to_day")).alias("day"))
    here = F.col("day") == F.col("from_day")
    return days.select("fund", "day", F.when(here, F.col("v")).alias("v"), here.cast("int").alias("seen"))


def shifted(c: str, by: int, w) -> Column:
    """Column ``by`` days earlier, zero before the first day."""
    return F.coalesce(F.lag(c, by).over(w), F.lit(0)) if by else F.col(c)


def doubled(df: DataFrame, columns: list[str], key: str, at: str, windows: tuple[int, ...]) -> DataFrame:
    """Adds ``{column}_{window}``, the trailing total, to a dense calendar."""
    w = Window.partitionBy(key).orderBy(at)
    top = max(windows).bit_length()
    for level in range(1, top):
        half = 2 ** (level - 1)
        df = df.withColumns({f"{c}@{2 * half}": (F.col(f"{c}@{half}" if half > 1 else c) + shifted(f"{c}@{half}" if half > 1 else c, half, w)).cast(df.schema[c].dataType) for c in columns})
    totals = {}
    for n in windows:
        for c in columns:
            terms, done = [], 0
            for level in reversed(range(n.bit_length())):
                size = 2**level
                if n & size:
                    terms.append(shifted(f"{c}@{size}" if size > 1 else c, done, w))
                    done += size
            totals[f"{c}_{n}"] = reduce(lambda a, b: a + b, terms).cast(df.schema[c].dataType)
    return df.withColumns(totals).drop(*(f"{c}@{2**k}" for c in columns for k in range(1, top)))


def trailing(general: DataFrame, field: str = "portfoybuyukluk", windows: tuple[int, ...] = (7, 30)) -> DataFrame:
    """Trailing totals and averages of ``field`` for each source and calendar day, first to last reading.

    Columns: fonkodu, gun (date), deger (null on days without a reading or without a value), and for each
    window n: toplam_n (the total; days without a value add 0), ortalama_n (total over all calendar days
    of the window that exist, days without a reading included), okuma_n (days with a value) and
    okuma_ort_n (total over those; null if there are none). Windows are cut at the first reading. Money is
    summed as decimals with two places. NaN and infinite values count as no value. Rows without source
    or moment are ignored; an empty table gives no rows.
    """
    d = dense(daily_last(general, field)).withColumns({"total": F.coalesce(F.col("v").cast(MONEY), F.lit(0).cast(MONEY)), "seen": F.col("v").isNotNull().cast("bigint"), "days": F.lit(1).cast("bigint")})
    d = doubled(d, ["total", "seen", "days"], "fund", "day", windows)
    out = [F.col("fund").alias("fonkodu"), F.date_from_unix_date("day").alias("gun"), F.col("v").alias("deger")]
    for n in windows:
        total = F.col(f"total_{n}").cast("double")
        out += [total.alias(f"toplam_{n}"), (total / F.col(f"days_{n}")).alias(f"ortalama_{n}"), F.col(f"seen_{n}").alias(f"okuma_{n}"), F.try_divide(total, F.col(f"seen_{n}")).alias(f"okuma_ort_{n}")]
    return d.select(*out)
