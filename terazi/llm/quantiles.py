"""Percentiles of very large numeric columns (problem 2).

Values are reduced to counts on a grid of 1 / ``STEPS`` (an error of half a step at most;
the partial results of separate days, files or tables add up exactly). Ranks are then
found by cumulative frequencies: the counts are range-sorted by group and step, so a
partition holds about as many counts as any other, whatever the values; partition totals
give each one its offset, and only partitions that hold a target rank are sorted for running
sums, which start at the offset. The first value that reaches the rank is the percentile.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terazi.session import cut, shuffle_partitions

UNIVERSE = ("fonkodu", "start_date", "end_date", "archetype", "start_aum", "end_aum", "end_participants", "flow_pct", "market_effect_pct")
FIELDS = ("flow_pct", "market_effect_pct")
#: Percentiles in thousandths.
TARGETS = (10, 50, 100, 250, 500, 750, 900, 950, 990)
#: Grid steps per unit: an absolute error of 5e-7 at most.
STEPS = 1_000_000
#: Partitions with a target rank that are sent to every task; more are joined by a shuffle.
SENT = 20_000


def label(c: Column) -> Column:
    """Lower-case label without outer blanks; null if nothing is left."""
    x = F.lower(F.btrim(c, F.lit(" \t\r\n ")))
    return F.when(x != "", x)


def value_counts(universe: DataFrame, fields: Sequence[str] = FIELDS, steps: int = STEPS) -> DataFrame:
    """Partial results per day: archetype, end_date, field, step (a whole number of grid steps, as double), n.

    Repeated rows count once; nulls and NaN not at all; infinities are extreme values. Rows without an
    archetype form a group of their own, with a null name.
    """
    rows = universe.select(*UNIVERSE).distinct()
    each = rows.select(label(F.col("archetype")).alias("archetype"), "end_date", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("v")) for f in fields))).alias("x"))
    known = each.select("archetype", "end_date", "x.field", "x.v").filter("v is not null and not isnan(v)")
    return known.groupBy("archetype", "end_date", "field", (F.rint(F.col("v") * steps) + F.lit(0.0)).alias("step")).agg(F.count("*").alias("n"))


def range_sorted(counts: DataFrame, parts: int) -> DataFrame:
    """The counts, range-partitioned by group and step, with the number of their partition in ``part``; written once.

    Equal steps of several days meet in one partition.
    """
    return cut(counts.select("archetype", "field", "step", "n").repartitionByRange(parts, "archetype", "field", "step").withColumn("part", F.spark_partition_id()))


def percentiles(counts: DataFrame, targets: Sequence[int] = TARGETS, steps: int = STEPS, parts: int | None = None, sent: int = SENT) -> DataFrame:
    """Percentiles of combined partial results: archetype, field, permille, value, rank, n.

    value is the first whose cumulative count reaches rank = max(1, ceil(permille n / 1000)), so the
    median of an even number is the lower one. A group without values gives no rows.
    """
    group = ["archetype", "field"]
    counts = range_sorted(counts, parts or shuffle_partitions(counts.sparkSession))
    before = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = counts.groupBy(*group, "part").agg(F.sum("n").alias("size")).withColumns({"offset": F.coalesce(F.sum("size").over(before), F.lit(0)), "all": F.sum("size").over(Window.partitionBy(*group))})
    ranks = totals.withColumn("permille", F.explode(F.array(*(F.lit(int(t)) for t in targets)))).withColumn("rank", F.greatest(F.lit(1), F.expr("(permille * `all` + 999) div 1000")))
    within = ranks.filter((F.col("rank") > F.col("offset")) & (F.col("rank") <= F.col("offset") + F.col("size")))
    wanted = within.groupBy(*group, "part").agg(F.first("offset").alias("offset"), F.first("all").alias("all"), F.collect_list(F.struct("permille", "rank")).alias("targets"))
    # a row per group and target at most: sent to the tasks while there are few groups, else joined by a shuffle
    few = wanted.limit(sent + 1).collect()
    if len(few) <= sent:
        wanted = F.broadcast(counts.sparkSession.createDataFrame([tuple(r) for r in few], wanted.schema))
    same = [F.col(f"c.{x}").eqNullSafe(F.col(f"w.{x}")) for x in (*group, "part")]
    picked = counts.alias("c").join(wanted.alias("w"), same).select(*(F.col(f"c.{x}").alias(x) for x in (*group, "part", "step", "n")), "offset", "all", "targets")
    total = picked.groupBy(*group, "part", "step", "offset", "all", "targets").agg(F.sum("n").alias("n"))
    run = Window.partitionBy(*group, "part").orderBy("step")
    at = total.withColumn("upto", F.col("offset") + F.sum("n").over(run))
    hits = at.select(*group, "step", "all", F.explode(F.filter("targets", lambda x: (x["rank"] <= F.col("upto")) & (x["rank"] > F.col("upto") - F.col("n")))).alias("x"))
    return hits.select(*group, F.col("x.permille").alias("permille"), (F.col("step") / steps).alias("value"), F.col("x.rank").alias("rank"), F.col("all").alias("n"))
