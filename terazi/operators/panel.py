"""Panels of (fund_code, date): preparation, windows in time and flow decomposition."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terazi.functions.labels import div, yes

PANEL = ("fund_code", "fund_name", "date", "price", "units", "holders", "aum")


def unpublished() -> Column:
    """A row without a published value: price at or below 0, or less than one unit; unknown is published."""
    return yes(F.col("price") <= 0) | yes(F.col("units") < 1)


def published(panel: DataFrame) -> DataFrame:
    return panel.filter(~unpublished())


def unpublished_funds(panel: DataFrame) -> DataFrame:
    """Funds with such rows: their number and the fund's largest size, largest first."""
    return panel.groupBy("fund_code").agg(F.count_if(unpublished()).alias("rows"), F.max("aum").alias("max_aum")).filter("rows > 0").orderBy(F.desc_nulls_last("max_aum"), "fund_code")


def dedupe_last(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Of rows with the same keys the one with the highest sequence (ties: any equal one)."""
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(seq))
    return rows.withColumn("@rank", F.row_number().over(w)).filter("`@rank` = 1").drop("@rank")


def join_allocation(panel: DataFrame, allocation: DataFrame) -> DataFrame:
    """Panel with the total weight of each row's long allocation (null: none); duplicates of the panel stay."""
    total = allocation.groupBy("fund_code", "date").agg(F.sum("weight").alias("total_weight"), F.count("*").alias("codes"))
    return panel.join(total, ["fund_code", "date"], "left")


def diagnostics(joined: DataFrame, low: float = 90.0, high: float = 105.0) -> DataFrame:
    """One row: rows, repeated keys, rows with a total outside [low, high] (none counts as outside), null dates, unpublished rows."""
    return joined.agg(
        F.count("*").alias("n_rows"), (F.count("*") - F.count_distinct(F.struct("fund_code", "date"))).alias("repeated_keys"),
        F.count_if(~yes(F.col("total_weight").between(low, high))).alias("outside_total"), F.count_if(F.col("date").isNull()).alias("null_dates"), F.count_if(unpublished()).alias("unpublished_rows"),
    )


def date_window(panel: DataFrame, start: dt.date | str, end: dt.date | str) -> DataFrame:
    """Rows of [start, end]; ValueError if start is after end."""
    if str(start) > str(end):
        raise ValueError(f"start {start} is after end {end}")
    return panel.filter(F.col("date").between(F.lit(str(start)).cast("date"), F.lit(str(end)).cast("date")))


def window_intervals(panel: DataFrame) -> int:
    """Intervals between the published days of a window; ValueError below two days."""
    days = panel.agg(F.count_distinct("date")).first()[0]
    if days < 2:
        raise ValueError("the window has fewer than two published days")
    return days - 1


def flow_features(panel: DataFrame) -> DataFrame:
    """Previous values, price check, return, changes and both flow estimates of each row.

    One shuffle and sort by fund serve all lags; everything else is arithmetic in the same stage.
    """
    w = Window.partitionBy("fund_code").orderBy("date")
    before = panel.withColumns({f"prev_{c}": F.lag(c).over(w) for c in ("date", "price", "aum", "holders", "units")})
    p, u, a, h = (F.col(c).cast("double") for c in ("price", "units", "aum", "holders"))
    pp, pu, pa, ph = (F.col(f"prev_{c}").cast("double") for c in ("price", "units", "aum", "holders"))
    ret = div(p, pp) - 1
    first = before.withColumns({
        "calculated_price": div(a, u), "calculated_price_6": F.bround(div(a, u), 6), "days_since_prev": F.date_diff("date", "prev_date"), "fund_return": ret,
        "aum_change": a - pa, "aum_change_pct": div(a, pa) - 1, "holder_change": h - ph, "holder_change_pct": div(h, ph) - 1, "unit_change": u - pu, "unit_change_pct": div(u, pu) - 1,
        "flow_aum": a - pa * (1 + ret), "flow_unit": (u - pu) * p,
    })
    c = F.col
    return first.withColumns({
        "price_diff": p - c("calculated_price_6"), "price_diff_pct": div(p - c("calculated_price_6"), p) * 100,
        "flow_aum_pct": div(c("flow_aum"), pa), "flow_unit_pct": div(c("flow_unit"), pa), "flow_diff": c("flow_aum") - c("flow_unit"), "flow_diff_pct": div(c("flow_aum") - c("flow_unit"), pa), "flow_per_holder": div(c("flow_unit"), ph),
    })


def window_totals(features: DataFrame, n: int) -> DataFrame:
    """One row per fund over its last n intervals (n + 1 rows; funds with fewer are dropped); sums skip the first row.

    market effect + net flow = change of size wherever size = price x units.
    """
    w = Window.partitionBy("fund_code").orderBy(F.desc_nulls_last("date"))
    last = features.withColumn("back", F.row_number().over(w)).filter(F.col("back") <= n + 1)
    inner = F.col("back") <= n
    money = lambda x: F.coalesce(F.sum(F.when(inner, x)), F.lit(0.0))
    t = last.groupBy("fund_code").agg(
        F.count("*").alias("rows"), F.max_by("fund_name", "date").alias("fund_name"),
        F.min("date").alias("start_date"), F.max("date").alias("end_date"),
        *(F.min_by(c, "date").alias(f"start_{c}") for c in ("price", "aum", "holders")), *(F.max_by(c, "date").alias(f"end_{c}") for c in ("price", "aum", "holders")),
        money(F.col("prev_aum") * F.col("fund_return")).alias("market_effect"), money(F.col("flow_unit")).alias("net_flow"), money(F.col("flow_aum")).alias("net_flow_aum"),
        F.avg(F.when(inner, F.col("flow_per_holder"))).alias("avg_flow_per_holder"),
    ).filter(F.col("rows") == n + 1)
    c = F.col
    return t.drop("rows").withColumns({
        "aum_change": c("end_aum") - c("start_aum"), "aum_change_pct": div(c("end_aum"), c("start_aum")) - 1, "flow_pct": div(c("net_flow"), c("start_aum")), "market_effect_pct": div(c("market_effect"), c("start_aum")),
        "cumulative_return": div(c("end_price"), c("start_price")) - 1, "participant_change": c("end_holders") - c("start_holders"), "participant_change_pct": div(c("end_holders").cast("double"), c("start_holders").cast("double")) - 1,
    })
