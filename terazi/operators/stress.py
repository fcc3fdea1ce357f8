"""Stress signals: daily index, event, freezes, flows around the event, founders."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terazi.config import StressConfig
from terazi.functions.labels import div, founder, yes
from terazi.operators.panel import dedupe_last, flow_features, published, unpublished


def daily(panel: DataFrame) -> DataFrame:
    """Published rows with the day's flow; still: units and holders unchanged; price_moved: also true where there was no price before.

    Of rows of the same fund and day the last counts: by the column ``loaded`` if there is one, else by the order of the rows.
    """
    rows = published(panel).filter("date is not null")
    order = F.col("loaded") if "loaded" in panel.columns else F.monotonically_increasing_id()
    f = flow_features(dedupe_last(rows.withColumn("@order", order), ["fund_code", "date"], "@order").drop("@order"))
    c = F.col
    return f.select(
        "fund_code", "fund_name", "date", "price", "units", "holders", "aum", "prev_aum", "fund_return", c("flow_unit").alias("flow"), c("flow_unit_pct").alias("flow_pct"),
        (yes(c("units") == c("prev_units")) & yes(c("holders") == c("prev_holders"))).alias("still"), F.coalesce(c("price") != c("prev_price"), F.lit(True)).alias("price_moved"),
    )


def robust_z(x: Column, w, config: StressConfig) -> Column:
    """Distance from the median of the days before, in their scaled median deviations; null with too few days."""
    past = F.collect_list(x).over(w)
    median = F.percentile(x, 0.5).over(w)
    deviations = F.array_sort(F.transform(past, lambda v: F.abs(v - median)))
    n = F.size(past)
    middle = (F.element_at(deviations, F.greatest(F.lit(1), F.floor((n + 1) / 2)).cast("int")) + F.element_at(deviations, F.greatest(F.lit(1), F.ceil((n + 1) / 2)).cast("int"))) / 2
    return F.when(n >= config.min_baseline_days, (x - median) / F.greatest(middle * 1.4826, F.lit(config.min_deviation)))


def stress_index(rows: DataFrame, config: StressConfig = StressConfig()) -> DataFrame:
    """One row per day: shares of eligible funds with a bad day, their z-scores, the worst outflow ahead, the stress score.

    The shares are combined map-side; what follows runs over days, one row each, in a single partition.
    """
    days = rows.filter(F.col("prev_aum") >= config.min_aum).groupBy("date").agg(
        F.count("*").alias("funds"), F.avg(yes(F.col("fund_return") <= config.price_drop).cast("int")).alias("price_drop_share"), F.avg(yes(F.col("flow_pct") <= config.heavy_outflow).cast("int")).alias("outflow_share"),
    )
    order = Window.partitionBy().orderBy("date")
    past = order.rowsBetween(-config.baseline_days, -1)
    z = days.withColumns({"price_z": robust_z(F.col("price_drop_share"), past, config), "outflow_z": robust_z(F.col("outflow_share"), past, config)})
    z = z.withColumn("outflow_z_ahead", F.max("outflow_z").over(order.rowsBetween(0, config.outflow_lag_days)))
    return z.withColumn("stress", F.when(F.col("price_z").isNotNull() & F.col("outflow_z_ahead").isNotNull(), F.least("price_z", "outflow_z_ahead")))


def event_of(index: DataFrame, config: StressConfig = StressConfig()) -> DataFrame:
    """One row: event_date and event_kind (run, else shock); none if no score reaches the threshold. Of equal scores the earliest day."""
    best = lambda c: F.max_by("date", F.when(F.col(c).isNotNull(), F.struct(F.col(c), -F.unix_date("date"))))
    peaks = index.agg(best("stress").alias("run_day"), F.max("stress").alias("run"), best("price_z").alias("shock_day"), F.max("price_z").alias("shock"))
    t = config.event_threshold
    return peaks.select(
        F.when(F.col("run") >= t, F.col("run_day")).when(F.col("shock") >= t, F.col("shock_day")).alias("event_date"), F.when(F.col("run") >= t, "run").when(F.col("shock") >= t, "shock").alias("event_kind")
    ).filter("event_date is not null")


def freezes(rows: DataFrame, config: StressConfig = StressConfig()) -> DataFrame:
    """The longest still spell (earliest of equals) of each fund that stopped dealing after dealing, while its price moved."""
    w = Window.partitionBy("fund_code").orderBy("date")
    runs = rows.withColumn("i", F.row_number().over(w))
    runs = runs.withColumn("island", F.col("i") - F.row_number().over(Window.partitionBy("fund_code", "still").orderBy("date")))
    spells = runs.filter("still").groupBy("fund_code", "island").agg(F.count("*").alias("frozen_days"), F.min("i").alias("first_i"), F.min("date").alias("frozen_since"), F.max("date").alias("frozen_until"), F.avg(F.col("price_moved").cast("int")).alias("moved"))
    longest = spells.withColumn("pos", F.row_number().over(Window.partitionBy("fund_code").orderBy(F.desc("frozen_days"), "frozen_since"))).filter((F.col("pos") == 1) & (F.col("frozen_days") >= config.freeze_min_days))
    before = runs.join(longest.select("fund_code", "first_i"), "fund_code").filter((F.col("i") > 1) & (F.col("i") < F.col("first_i")))
    history = before.groupBy("fund_code").agg(F.count("*").alias("history"), F.avg((~F.col("still")).cast("int")).alias("activity"))
    kept = longest.join(history, "fund_code").filter((F.col("history") >= config.freeze_min_history) & (F.col("activity") >= config.freeze_min_activity) & (F.col("moved") >= 0.5))
    end = rows.agg(F.max("date").alias("last_day"))
    return kept.crossJoin(F.broadcast(end)).select("fund_code", "frozen_since", "frozen_until", F.col("frozen_days").cast("int"), (F.col("frozen_until") == F.col("last_day")).alias("frozen_ongoing"))  # one row


def event_flows(window: DataFrame, event: DataFrame, config: StressConfig = StressConfig()) -> DataFrame:
    """Flows before the event (from the first day's size) and from it on (from that of the day before): fund_code, flow_before, flow_after, turned."""
    bounds = window.crossJoin(F.broadcast(event.select("event_date"))).groupBy("event_date").agg(F.min("date").alias("first_day"), F.max(F.when(F.col("date") < F.col("event_date"), F.col("date"))).alias("base_day"))
    c = F.col
    rows = window.crossJoin(F.broadcast(bounds))  # one row
    f = rows.groupBy("fund_code").agg(
        F.sum(F.when((c("date") < c("event_date")) & (c("date") > c("first_day")), c("flow"))).alias("before"), F.sum(F.when(c("date") >= c("event_date"), c("flow"))).alias("after"),
        F.max(F.when(c("date") == c("first_day"), c("aum"))).alias("aum0"), F.max(F.when(c("date") == c("base_day"), c("aum"))).alias("aum1"),
    )
    f = f.select("fund_code", div(c("before"), c("aum0")).alias("flow_before"), div(c("after"), c("aum1")).alias("flow_after"))
    return f.withColumn("turned", yes(c("flow_before") >= config.turn_threshold) & yes(c("flow_after") <= -config.turn_threshold))


def founder_summary(funds: DataFrame, window: DataFrame, event: DataFrame) -> DataFrame:
    """Funds' signals summed by founder; most stressed size first, then the largest outflow."""
    stressed = F.col("frozen") | F.col("unpublished")
    g = funds.groupBy("founder").agg(
        F.count("*").alias("funds"), F.sum("start_aum").alias("start_aum"), F.count_if("frozen").alias("frozen"), F.count_if("unpublished").alias("unpublished"), F.count_if("turned").alias("turned"),
        F.coalesce(F.sum(F.when(stressed, F.col("start_aum"))), F.lit(0.0)).alias("stressed_aum"),
    ).withColumn("stressed_aum_share", div(F.col("stressed_aum"), F.col("start_aum")))
    c = F.col
    bounds = window.crossJoin(F.broadcast(event.select("event_date"))).groupBy("event_date").agg(F.max(F.when(c("date") < c("event_date"), c("date"))).alias("base_day"))
    rows = window.join(funds.select("fund_code", "founder"), "fund_code").crossJoin(F.broadcast(bounds))
    after = rows.groupBy("founder").agg(div(F.sum(F.when(c("date") >= c("event_date"), c("flow"))), F.sum(F.when(c("date") == c("base_day"), c("aum")))).alias("flow_after"))
    return g.join(after, "founder", "left").orderBy(F.desc_nulls_last("stressed_aum"), F.asc_nulls_last("flow_after"), "founder")


@dataclass(frozen=True)
class Stress:
    """Results for one window: frames, all lazy; event has at most one row."""

    event: DataFrame
    index: DataFrame
    funds: DataFrame
    founders: DataFrame
    daily: DataFrame


def stress_signals(panel: DataFrame, start: dt.date | str, end: dt.date | str, event_date: dt.date | str | None = None, config: StressConfig = StressConfig()) -> Stress:
    """Everything above for [start, end]; days before the start only serve comparison. A given event_date has the kind manual."""
    a, b = F.lit(str(start)).cast("date"), F.lit(str(end)).cast("date")
    near = panel.filter(F.col("date") <= b)
    if config.history_days is not None:
        near = near.filter(F.col("date") >= F.date_sub(a, config.history_days))
    rows = daily(near)
    window = rows.filter(F.col("date") >= a)
    index = stress_index(rows, config).filter(F.col("date") >= a)
    spark = panel.sparkSession
    event = event_of(index, config) if event_date is None else spark.createDataFrame([(str(event_date), "manual")], "event_date string, event_kind string").withColumn("event_date", F.col("event_date").cast("date"))
    funds = window.groupBy("fund_code").agg(F.min_by("fund_name", F.when(F.col("fund_name").isNotNull(), F.col("date"))).alias("fund_name"), F.min_by("aum", F.when(F.col("aum").isNotNull(), F.col("date"))).alias("start_aum"))
    hidden = near.filter((F.col("date") >= a) & unpublished()).select("fund_code").distinct().withColumn("unpublished", F.lit(True))
    frozen = freezes(rows, config).filter((F.col("frozen_since") <= b) & (F.col("frozen_until") >= a))
    funds = (
        funds.withColumn("founder", founder(F.col("fund_name"))).join(hidden, "fund_code", "left").join(frozen, "fund_code", "left").join(event_flows(window, event, config), "fund_code", "left")
        .withColumns({"unpublished": yes(F.col("unpublished")), "frozen": F.col("frozen_since").isNotNull(), "turned": yes(F.col("turned"))})
    )
    return Stress(event, index, funds, founder_summary(funds, window, event), window)
