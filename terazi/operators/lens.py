"""Universe ("lens") analysis: one row per fund, segments, summaries, screens, ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terazi.config import LensConfig, intervals
from terazi.functions.labels import aum_segment, div, dominance, flow_regime, holder_segment, intensity, magnitude, quadrant, yes
from terazi.operators.dna import archetypes, latest_allocation
from terazi.operators.panel import flow_features, published, window_totals


def universe(panel: DataFrame, allocation: DataFrame, config: LensConfig = LensConfig(), include_unpublished: bool = False) -> DataFrame:
    """One row per fund that has enough days and an allocation: window totals, archetype, segments, quadrant, regime."""
    totals = window_totals(flow_features(panel if include_unpublished else published(panel)), intervals(config.lookback))
    rows = totals.join(archetypes(latest_allocation(allocation)), "fund_code")
    return with_segments(rows, config)


def with_segments(rows: DataFrame, config: LensConfig = LensConfig()) -> DataFrame:
    c = F.col
    valid = yes(c("start_aum") > config.min_start_aum) & yes(c("start_holders") > 0) & c("flow_pct").isNotNull() & c("market_effect_pct").isNotNull() & c("participant_change_pct").isNotNull()
    return rows.withColumns({
        "aum_segment": aum_segment(c("start_aum"), config.aum_edges), "participant_segment": holder_segment(c("start_holders"), config.holder_edges), "flow_intensity": intensity(c("flow_pct")),
        "market_magnitude": magnitude(c("market_effect_pct")), "market_flow_quadrant": quadrant(c("market_effect_pct"), c("flow_pct"), config.neutral), "flow_regime": flow_regime(c("flow_pct"), c("participant_change")),
        "is_valid": valid,
    })


def universe_summary(lens: DataFrame) -> DataFrame:
    """One row over the whole universe."""
    return lens.agg(
        F.count("*").alias("fund_count"), *(F.sum(a).alias(b) for a, b in (("start_aum", "total_start_aum"), ("end_aum", "total_end_aum"), ("net_flow", "total_net_flow"), ("market_effect", "total_market_effect"))),
        F.avg("flow_pct").alias("avg_flow_pct"), F.avg("market_effect_pct").alias("avg_market_effect_pct"), F.median("flow_pct").alias("median_flow_pct"), F.median("market_effect_pct").alias("median_market_effect_pct"),
    )


def summary_by(lens: DataFrame, column: str, min_funds: int = 1) -> DataFrame:
    """Totals, weighted ratios, share of the universe, means and medians per group; the null group stays, largest first.

    Shares refer to the whole universe, also where small groups are left out afterwards.
    """
    g = lens.groupBy(column).agg(
        F.count("*").alias("fund_count"), F.sum("start_aum").alias("total_start_aum"), F.sum("end_aum").alias("total_end_aum"), F.sum("net_flow").alias("total_net_flow"), F.sum("market_effect").alias("total_market_effect"),
        F.sum("participant_change").alias("total_participant_change"), F.avg("flow_pct").alias("avg_flow_pct"), F.median("flow_pct").alias("median_flow_pct"),
        F.avg("participant_change_pct").alias("avg_participant_change_pct"), F.median("participant_change_pct").alias("median_participant_change_pct"),
    )
    c = F.col
    g = g.withColumns({
        "start_aum_share": div(c("total_start_aum"), F.sum("total_start_aum").over(Window.partitionBy())), "weighted_flow_pct": div(c("total_net_flow"), c("total_start_aum")),
        "weighted_market_effect_pct": div(c("total_market_effect"), c("total_start_aum")), "weighted_aum_change_pct": div(c("total_end_aum"), c("total_start_aum")) - 1,
    })
    return g.filter(c("fund_count") >= min_funds).orderBy(F.desc_nulls_last("total_start_aum"), F.asc_nulls_last(column))


def crosstab(lens: DataFrame, rows: str = "archetype", columns: str = "market_flow_quadrant") -> DataFrame:
    """Long crosstab of size: rows, columns, start_aum, share of the row. Null labels are left out."""
    t = lens.filter(F.col(rows).isNotNull() & F.col(columns).isNotNull()).groupBy(rows, columns).agg(F.sum("start_aum").alias("start_aum"))
    return t.withColumn("share", div(F.col("start_aum"), F.sum("start_aum").over(Window.partitionBy(rows))))


def dominant(lens: DataFrame, rows: str = "archetype", columns: str = "market_flow_quadrant") -> DataFrame:
    """The largest column of each row by size; of equals the first in order."""
    t = crosstab(lens, rows, columns).withColumn("total_start_aum", F.sum("start_aum").over(Window.partitionBy(rows)))
    best = t.withColumn("pos", F.row_number().over(Window.partitionBy(rows).orderBy(F.desc_nulls_last("share"), columns))).filter("pos = 1")
    return best.select(rows, F.col(columns).alias("dominant_quadrant"), F.col("share").alias("dominant_quadrant_share"), dominance(F.col("share")).alias("dominance_strength"), "total_start_aum").orderBy(F.desc_nulls_last("total_start_aum"), rows)


def top(lens: DataFrame, by: str, n: int = 20, ascending: bool = False, where: Column | None = None) -> DataFrame:
    """The first n funds by a column, nulls last, ties by fund_code."""
    key = F.asc_nulls_last(by) if ascending else F.desc_nulls_last(by)
    return (lens if where is None else lens.filter(where)).orderBy(key, "fund_code").limit(n)


def top_inflows(lens: DataFrame, n: int = 20) -> DataFrame:
    return top(lens, "flow_pct", n)


def top_outflows(lens: DataFrame, n: int = 20) -> DataFrame:
    return top(lens, "flow_pct", n, ascending=True)


def pure_performance(lens: DataFrame, n: int = 20, neutral: float = 0.0005) -> DataFrame:
    return top(lens, "market_effect_pct", n, where=(F.col("market_effect_pct") > 0.01) & (F.abs("flow_pct") < neutral))


def performance_led(lens: DataFrame, n: int = 20) -> DataFrame:
    return top(lens, "market_effect_pct", n, where=(F.col("market_effect_pct") > 0.01) & (F.abs("market_effect_pct") > F.abs("flow_pct")))


def holder_growth_neutral(lens: DataFrame, n: int = 20, neutral: float = 0.0005) -> DataFrame:
    return top(lens, "participant_change_pct", n, where=(F.col("participant_change_pct") > 0.005) & (F.abs("flow_pct") < neutral))


def high_lookthrough(lens: DataFrame, n: int = 20) -> DataFrame:
    return top(lens, "lookthrough_weight", n)


def high_growth(lens: DataFrame, n: int = 30, least: float = 0.25) -> DataFrame:
    return top(lens, "flow_pct", n, where=F.col("flow_pct") > least)


def established(lens: DataFrame, min_aum: float = 1e9, min_holders: float = 1e4) -> DataFrame:
    return lens.filter((F.col("start_aum") >= min_aum) & (F.col("start_holders") >= min_holders))


def selected(lens: DataFrame, codes: list[str], by: str = "flow_pct", ascending: bool = False) -> DataFrame:
    """Given funds (codes in any case, with blanks), sorted."""
    wanted = [c.strip().upper() for c in codes if c and c.strip()]
    key = F.asc_nulls_last(by) if ascending else F.desc_nulls_last(by)
    return lens.filter(F.upper(F.trim("fund_code")).isin(wanted)).orderBy(key, "fund_code")


def peer_ranks(lens: DataFrame, group: str = "archetype") -> DataFrame:
    """Ranks of return, flow and size in the group (a null value has none) and the group's size."""
    def rank(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.rank().over(Window.partitionBy(group).orderBy(F.desc_nulls_last(c))))
    return lens.select("fund_code", group, *(rank(c).alias(f"{n}_rank") for c, n in (("cumulative_return", "return"), ("flow_pct", "flow"), ("end_aum", "aum"))), F.count("*").over(Window.partitionBy(group)).alias("peer_count"))


def similar(lens: DataFrame, group: str = "archetype", each_side: int = 3) -> DataFrame:
    """Up to three larger and three smaller funds beside each fund by size in its group: fund_code, other, step."""
    w = Window.partitionBy(group).orderBy(F.desc_nulls_last("end_aum"), "fund_code")
    sides = lens.select("fund_code", *(F.lag("fund_code", k).over(w).alias(f"m{k}") for k in range(1, each_side + 1)), *(F.lead("fund_code", k).over(w).alias(f"p{k}") for k in range(1, each_side + 1)))
    pairs = F.array(*(F.struct(F.col(f"{s}{k}").alias("other"), F.lit(k if s == "p" else -k).alias("step")) for s in "mp" for k in range(1, each_side + 1)))
    return sides.select("fund_code", F.explode(pairs).alias("x")).select("fund_code", "x.other", "x.step").filter("other is not null")


def validation(lens: DataFrame) -> DataFrame:
    """One row: funds, invalid ones, missing ratios, extremes of flow and market effect, repeated codes."""
    return lens.agg(
        F.count("*").alias("funds"), F.count_if(~F.col("is_valid")).alias("invalid"), F.count_if(F.col("flow_pct").isNull()).alias("missing_flow"), F.count_if(F.col("market_effect_pct").isNull()).alias("missing_effect"),
        *(f(c).alias(f"{n}_{c}") for c in ("flow_pct", "market_effect_pct") for n, f in (("min", F.min), ("max", F.max))), (F.count("*") - F.count_distinct("fund_code")).alias("repeated_codes"),
    )


def founder_totals(universes: list[DataFrame]) -> DataFrame:
    """Funds, size and flow of each founder over several universes (frames with fund_name), largest first."""
    from functools import reduce

    from terazi.functions.labels import founder

    both = reduce(DataFrame.unionByName, (u.select("fund_code", founder(F.col("fund_name")).alias("founder"), "start_aum", "end_aum", "net_flow", "is_valid") for u in universes))
    g = both.groupBy("founder").agg(F.count("*").alias("funds"), F.count_if("is_valid").alias("analysed"), F.sum("start_aum").alias("start_aum"), F.sum("end_aum").alias("end_aum"), F.sum("net_flow").alias("net_flow"))
    return g.withColumn("flow_pct", div(F.col("net_flow"), F.col("start_aum"))).orderBy(F.desc_nulls_last("start_aum"), "founder")


def listed_titles(listed: DataFrame, panel: DataFrame) -> DataFrame:
    """Fund codes of listed titles: both sides upper case, letters and digits only. listed: a column title."""
    key = lambda c: F.regexp_replace(F.upper(F.translate(c, "iı", "İI")), "[^0-9A-ZÇĞİÖŞÜ]", "")
    codes = panel.select("fund_code", key(F.col("fund_name")).alias("k")).filter("k <> ''").distinct()
    return listed.withColumn("k", key(F.col("title"))).join(codes, "k", "left").select("title", "fund_code")
