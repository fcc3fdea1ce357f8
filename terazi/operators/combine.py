"""Results side by side: windows between dates, classes and stress signals on the universe, provenance, selections and study sums."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terazi.config import ClassificationConfig, LensConfig
from terazi.functions.labels import div, yes
from terazi.metadata import ROWS
from terazi.operators.classifier import Model
from terazi.operators.dna import archetypes, latest_allocation
from terazi.operators.lens import with_segments
from terazi.operators.panel import flow_features, published, unpublished, window_totals

#: Columns of a classification in the order of its reports; further ones follow.
RESULT = (
    "fund_code", "class_id", "class_name", "family", "confidence", "class_stability", "allocation_volatility", "style_drift", "drift_flag", "participation_class", "risk_band", "currency_band", "lookthrough_band",
    "is_classifiable", "days", "first_day", "last_day", "fund_name",
)


def cut_window(df: DataFrame, start: dt.date | str | None, end: dt.date | str | None) -> DataFrame:
    """Rows with a date in [start, end]; an end that is None stays open. ValueError if start is after end."""
    if start is not None and end is not None and str(start) > str(end):
        raise ValueError(f"start {start} is after end {end}")
    out = df.filter("date is not null")
    if start is not None:
        out = out.filter(F.col("date") >= F.lit(str(start)).cast("date"))
    return out if end is None else out.filter(F.col("date") <= F.lit(str(end)).cast("date"))


def universe_window(panel: DataFrame, allocation: DataFrame, start: dt.date | str | None, end: dt.date | str | None, config: LensConfig = LensConfig(), include_unpublished: bool = False) -> DataFrame:
    """The universe between two dates: totals over every interval of the window, by what funds held in it.

    The intervals are those between the days on which any fund published (also with ``include_unpublished``, which
    keeps unpublished rows in the panel); a fund that lacks one of the days has no row. The bounds are pushed down to
    the scan, so only the window is read. ValueError below two published days.
    """
    inside = cut_window(panel, start, end)
    days = published(inside).agg(F.count_distinct("date")).first()[0]
    if days < 2:
        raise ValueError(f"the window {start or '...'} to {end or '...'} holds {days} published day(s); two are needed")
    totals = window_totals(flow_features(inside if include_unpublished else published(inside)), days - 1)
    return with_segments(totals.join(archetypes(latest_allocation(cut_window(allocation, start, end))), "fund_code"), config)


def beside(left: DataFrame, right: DataFrame, key: str = "fund_code") -> DataFrame:
    """Left join by the key; columns that both have are those of the left."""
    return left.join(right.drop(*(c for c in right.columns if c != key and c in left.columns)), key, "left")


def with_classes(lens: DataFrame, classified: DataFrame) -> DataFrame:
    """The universe with each fund's class; funds that weren't classified keep nulls."""
    return beside(lens, classified)


def with_stress(lens: DataFrame, funds: DataFrame) -> DataFrame:
    """The universe with each fund's stress signals; a fund without any has false."""
    marks = ("unpublished", "frozen", "turned")
    out = beside(lens, funds.select("fund_code", *marks, "frozen_since", "frozen_days", "flow_before", "flow_after"))
    return out.withColumns({c: yes(F.col(c)) for c in marks})


def provenance(rows: DataFrame, panel: DataFrame) -> DataFrame:
    """Where a fund's vector comes from: days with an allocation, the first and last of them, the last name: fund_code, days, first_day, last_day, fund_name."""
    seen = rows.groupBy("fund_code").agg(F.count_distinct("date").alias("days"), F.min("date").alias("first_day"), F.max("date").alias("last_day"))
    names = panel.groupBy("fund_code").agg(F.max_by("fund_name", F.when(F.col("fund_name").isNotNull(), F.col("date"))).alias("fund_name"))
    return seen.join(names, "fund_code", "left")


def all_funds(classified: DataFrame, funds: DataFrame) -> DataFrame:
    """Every fund of ``funds`` (fund_code): those without a usable vector have class -1, null labels and is_classifiable false."""
    out = funds.select("fund_code").distinct().join(classified, "fund_code", "left").withColumn("is_classifiable", F.col("class_id").isNotNull())
    return out.withColumn("class_id", F.coalesce("class_id", F.lit(-1)))


def ordered(classified: DataFrame) -> DataFrame:
    """Columns in the order of RESULT, then the others."""
    return classified.select(*(c for c in RESULT if c in classified.columns), *(c for c in classified.columns if c not in RESULT))


def most_frequent(df: DataFrame, group: str, value: str) -> DataFrame:
    """The value most rows of a group have, nulls aside; of equals the first in order: group, value."""
    n = df.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"))
    first = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), value))
    return n.withColumn("pos", first).filter("pos = 1").select(group, value)


def low_confidence(classified: DataFrame, config: ClassificationConfig = ClassificationConfig()) -> DataFrame:
    """Classified funds per class, and those below the configured confidence: class_name, funds, low."""
    return classified.filter("class_name is not null").groupBy("class_name").agg(F.count("*").alias("funds"), F.count_if(F.col("confidence") < config.low_confidence_threshold).alias("low"))


def centroid_table(spark, model: Model) -> DataFrame:
    """The model's centroids, one row per class and feature: class_id, class_name, feature, weight."""
    rows = [(i, model.names[i], f, float(w)) for i, c in enumerate(model.centroids) for f, w in zip(model.features, c, strict=True)]
    return spark.createDataFrame(rows, "class_id int, class_name string, feature string, weight double")


def search(lens: DataFrame, text: str) -> DataFrame:
    """Funds whose code or name holds the text, whatever the case (also of Turkish letters); all funds for a blank text."""
    plain = lambda c: F.upper(F.translate(F.coalesce(c, F.lit("")), "iı", "İI"))
    want = plain(F.lit(text.strip()))
    return lens.filter(F.contains(plain(F.col("fund_code")), want) | F.contains(plain(F.col("fund_name")), want))


def moving(lens: DataFrame, market: str | None = None, flow: str | None = None) -> DataFrame:
    """Funds by the direction of market and flow (Positive, Negative, Neutral, Unknown), read off the quadrant's label."""
    out = lens
    for part, way in (("Market", market), ("Flow", flow)):
        if way is not None:
            out = out.filter(F.col("market_flow_quadrant").contains(f"{way} {part}"))
    return out


def axis_limits(lens: DataFrame, columns: tuple[str, ...], lower: float = 0.01, upper: float = 0.99, pad: float = 0.1) -> DataFrame:
    """Limits of a chart's axes, outliers aside: field, low, high (percentiles, and a tenth of their distance on each side).

    The percentiles are exact; the universe has a row per fund.
    """
    cells = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("v")) for c in columns))
    ends = lens.select(F.explode(cells).alias("x")).select("x.*").filter("v is not null and not isnan(v)").groupBy("field").agg(F.percentile("v", F.array(F.lit(lower), F.lit(upper))).alias("p"))
    room = (F.col("p")[1] - F.col("p")[0]) * pad
    return ends.select("field", (F.col("p")[0] - room).alias("low"), (F.col("p")[1] + room).alias("high"))


def active_codes(allocation: DataFrame) -> DataFrame:
    """Known instrument codes that some fund holds, and codes held that aren't known: code, known."""
    held = allocation.filter("weight <> 0").select(F.lower("code").alias("code")).distinct()
    return held.withColumn("known", F.col("code").isin([r[0] for r in ROWS]))


def flow_list(lens: DataFrame, n: int = 25, outflows: bool = False) -> DataFrame:
    """The n funds with the largest net flow in money, or the largest outflow."""
    key = F.asc_nulls_last("net_flow") if outflows else F.desc_nulls_last("net_flow")
    return lens.filter("net_flow < 0" if outflows else "net_flow > 0").orderBy(key, "fund_code").limit(n)


def before_event(daily: DataFrame, event_day: dt.date | str | Column) -> DataFrame:
    """How a fund dealt before the event: share of days on which units or holders moved, holders on its last day before: fund_code, activity_before, holders_before."""
    day = event_day if isinstance(event_day, Column) else F.lit(str(event_day)).cast("date")
    before = daily.filter(F.col("date") < day)
    return before.groupBy("fund_code").agg(
        F.avg(F.when(F.col("prev_aum").isNotNull() | F.col("fund_return").isNotNull(), (~F.col("still")).cast("int"))).alias("activity_before"), F.max_by("holders", F.when(F.col("holders").isNotNull(), F.col("date"))).alias("holders_before"),
    )


def founder_flows(window: DataFrame, funds: DataFrame, event_day: dt.date | str) -> DataFrame:
    """Sums of each founder around the event: size on the first day and on the day before it, flow in money before and after, as shares of these sizes."""
    day = F.lit(str(event_day)).cast("date")
    bounds = window.agg(F.min("date").alias("first_day"), F.max(F.when(F.col("date") < day, F.col("date"))).alias("base_day"))
    rows = window.join(funds.select("fund_code", "founder"), "fund_code").crossJoin(F.broadcast(bounds))  # one row
    d = F.col("date")
    g = rows.groupBy("founder").agg(
        F.sum(F.when(d == F.col("first_day"), F.col("aum"))).alias("start_aum"), F.sum(F.when(d == F.col("base_day"), F.col("aum"))).alias("base_aum"),
        F.sum(F.when((d > F.col("first_day")) & (d < day), F.col("flow"))).alias("before"), F.sum(F.when(d >= day, F.col("flow"))).alias("after"),
    )
    return g.withColumns({"before_pct": div(F.col("before"), F.col("start_aum")), "after_pct": div(F.col("after"), F.col("base_aum"))})


def receivers(funds_flows: DataFrame, lens: DataFrame, group: str = "archetype") -> DataFrame:
    """Where money went after the event: flow by group of funds, the largest first: group, funds, inflow, outflow, net."""
    rows = funds_flows.join(lens.select("fund_code", group), "fund_code")
    x = F.col("flow")
    return rows.groupBy(group).agg(F.count_distinct("fund_code").alias("funds"), F.coalesce(F.sum(F.when(x > 0, x)), F.lit(0.0)).alias("inflow"), F.coalesce(F.sum(F.when(x < 0, x)), F.lit(0.0)).alias("outflow"), F.sum(x).alias("net")).orderBy(F.desc_nulls_last("net"), group)


def day_sums(window: DataFrame) -> DataFrame:
    """Per day: funds, size, flow and the median return: date, funds, aum, flow, median_return. The median is exact over the funds of a day."""
    return window.groupBy("date").agg(F.count("*").alias("funds"), F.sum("aum").alias("aum"), F.sum("flow").alias("flow"), F.median("fund_return").alias("median_return"))


def unpublished_shares(panel: DataFrame) -> DataFrame:
    """Per day, the share of rows without a published value: date, rows, share."""
    return panel.groupBy("date").agg(F.count("*").alias("rows"), F.avg(unpublished().cast("int")).alias("share"))


def fund_summary(lens: DataFrame, language: str = "en") -> DataFrame:
    """The period of a fund in a sentence of its own numbers: fund_code, summary."""
    per = lambda c: F.format_string("%.2f", F.col(c) * 100)
    mio = lambda c: F.format_string("%.1f", F.col(c) / 1e6)
    rank = F.rank().over(Window.partitionBy("archetype").orderBy(F.desc_nulls_last("cumulative_return")))
    peers = F.count("*").over(Window.partitionBy("archetype"))
    x = lens.withColumns({"@rank": rank, "@peers": peers})
    if language == "tr":
        text = F.concat(
            F.col("fund_code"), F.lit(": getiri yüzde "), per("cumulative_return"), F.lit("; hacim "), mio("start_aum"), F.lit(" milyondan "), mio("end_aum"), F.lit(" milyona geldi, bunun yüzde "), per("market_effect_pct"), F.lit(" kadarı piyasadan, yüzde "), per("flow_pct"),
            F.lit(" kadarı para akımından. Türündeki "), F.col("@peers").cast("string"), F.lit(" fon içinde getiri sırası "), F.col("@rank").cast("string"), F.lit("."),
        )
    else:
        text = F.concat(
            F.col("fund_code"), F.lit(" returned "), per("cumulative_return"), F.lit("%; its size went from "), mio("start_aum"), F.lit(" to "), mio("end_aum"), F.lit(" million, "), per("market_effect_pct"), F.lit("% by markets and "), per("flow_pct"),
            F.lit("% by flows. Return rank "), F.col("@rank").cast("string"), F.lit(" of "), F.col("@peers").cast("string"), F.lit(" funds of its type."),
        )
    return x.select("fund_code", text.alias("summary"))
