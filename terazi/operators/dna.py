"""Portfolio DNA: long instrument weights rolled up to asset, scope and currency groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terazi.functions import labels
from terazi.metadata import BROAD_GROUPS, CURRENCIES, SCOPES, instruments

GROUPINGS = {"broad": ("broad_group", BROAD_GROUPS), "scope": ("market_scope", SCOPES), "currency": ("currency", CURRENCIES), "asset": ("asset_group", None)}
#: Weights below this are no exposure; broad groups beyond the tenth count as 0 in the rules.
LEAST_WEIGHT, BROAD_LIMIT = 0.01, 10


def to_long(wide: DataFrame, ids: tuple[str, ...] = ("fund_code", "fund_name", "date")) -> DataFrame:
    """fund_code, date, code, weight of a wide allocation; every other column is a code, nulls are left out."""
    codes = [c for c in wide.columns if c.lower() not in ids]
    cells = F.array(*(F.struct(F.lit(c.lower()).alias("code"), F.col(f"`{c}`").try_cast("double").alias("weight")) for c in codes))
    return wide.select("fund_code", "date", F.explode(cells).alias("x")).select("fund_code", "date", "x.code", "x.weight").filter("weight is not null")


def group_weights(allocation: DataFrame, grouping: str) -> DataFrame:
    """fund_code, date, grp, weight: sums over the codes of a group; codes without a group are left out."""
    dim = F.broadcast(instruments(allocation.sparkSession).select("code", F.col(GROUPINGS[grouping][0]).alias("grp")))  # 54 rows
    return allocation.join(dim, "code").groupBy("fund_code", "date", "grp").agg(F.sum("weight").alias("weight"))


def group_columns(allocation: DataFrame, grouping: str, prefix: str = "dna") -> DataFrame:
    """One column per group, 0 without weight; the group list is fixed, so no action is needed to find it."""
    names = GROUPINGS[grouping][1]
    dim = F.broadcast(instruments(allocation.sparkSession).select("code", F.col(GROUPINGS[grouping][0]).alias("grp")))
    rows = allocation.join(dim, "code")
    return rows.groupBy("fund_code", "date").agg(*(F.coalesce(F.sum(F.when(F.col("grp") == g, F.col("weight"))), F.lit(0.0)).alias(f"{prefix}_{grouping}_{_safe(g)}") for g in names))


def _safe(name: str) -> str:
    return "_".join("".join(c if c.isalnum() else " " for c in name.lower()).split())


def latest_allocation(allocation: DataFrame) -> DataFrame:
    """The weights of each fund's latest day with an allocation."""
    w = Window.partitionBy("fund_code")
    return allocation.withColumn("latest_date", F.max("date").over(w)).filter("date = latest_date").drop("date")


def exposures(latest: DataFrame, grouping: str, top: int | None = None) -> DataFrame:
    """Ranked groups of each fund's latest allocation: fund_code, latest_date, grp, weight, pos."""
    dim = F.broadcast(instruments(latest.sparkSession).select("code", F.col(GROUPINGS[grouping][0]).alias("grp")))
    sums = latest.join(dim, "code").groupBy("fund_code", "latest_date", "grp").agg(F.sum("weight").alias("weight")).filter(F.abs("weight") >= LEAST_WEIGHT)
    ranked = sums.withColumn("pos", F.row_number().over(Window.partitionBy("fund_code").orderBy(F.desc("weight"), "grp")))
    return ranked.filter(F.col("pos") <= top) if top else ranked


def archetypes(latest: DataFrame) -> DataFrame:
    """fund_code, archetype and the top group of each grouping, in one aggregation over the latest weights.

    A broad group beyond the tenth by weight, and any below 0.01, counts as 0.
    """
    dim = F.broadcast(instruments(latest.sparkSession).select("code", "broad_group", "market_scope", "currency"))
    rows = latest.join(dim, "code")
    per = rows.groupBy("fund_code", "latest_date").agg(*(
        F.map_from_entries(F.array(*(F.struct(F.lit(g), F.coalesce(F.sum(F.when(F.col(c) == g, F.col("weight"))), F.lit(0.0))) for g in names))).alias(k)
        for k, c, names in (("broad", "broad_group", BROAD_GROUPS), ("scope", "market_scope", SCOPES), ("currency", "currency", CURRENCIES))
    ))

    def ranked(k: str) -> Column:
        kept = F.filter(F.map_entries(F.col(k)), lambda x: F.abs(x["value"]) >= LEAST_WEIGHT)
        return F.array_sort(kept, lambda a, b: F.when(a["value"] > b["value"], -1).when(a["value"] < b["value"], 1).when(a["key"] < b["key"], -1).otherwise(1))

    r = per.select("fund_code", "latest_date", F.slice(ranked("broad"), 1, BROAD_LIMIT).alias("broad"), ranked("scope").alias("scope"), ranked("currency").alias("currency"))
    m = r.withColumns({f"{k}_map": F.map_from_entries(k) for k in ("broad", "scope", "currency")})
    weight = lambda k: lambda g: F.coalesce(F.try_element_at(F.col(f"{k}_map"), F.lit(g)), F.lit(0.0))
    top = lambda k, part: F.try_element_at(F.col(k), F.lit(1))[part]
    return m.select(
        "fund_code", "latest_date", labels.archetype(weight("broad"), weight("scope"), weight("currency"), top("broad", "key"), top("broad", "value")).alias("archetype"),
        *(x for k in ("broad", "scope", "currency") for x in (top(k, "key").alias(f"top_{k}"), top(k, "value").alias(f"top_{k}_weight"))), weight("scope")("Look-through Required").alias("lookthrough_weight"),
    )
