"""Queries that put results side by side, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terazi.config import ClassificationConfig
from terazi.operators import allocation as al
from terazi.operators import classifier as cl
from terazi.operators import combine as co
from terazi.operators import stress
from terazi.plans import reference_queries as rq
from terazi.plans.panels import DIM, P, U, W, supplier_month, supplier_weights, user_day
from terazi.plans.reference_queries import DAILY, FLOWS, LENS, LENS_SQL, ROWS_SQL, r, rs

Q: dict = {}
SQL: dict[str, str] = {}
START, END = "1994-03-01", "1995-08-01"
DAY = "2024-01-20"


def query(sql: str):
    def add(f):
        Q[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


INSIDE = f"date BETWEEN DATE '{START}' AND DATE '{END}'"
#: The universe's SQL over a window: its rows only, and as many intervals as it has days.
WINDOW_SQL = (
    LENS_SQL.replace("FROM p WINDOW", f"FROM (SELECT * FROM p WHERE {INSIDE}) WINDOW").replace("FROM a QUALIFY", f"FROM a WHERE {INSIDE} QUALIFY")
    .replace("back <= 20", f"back <= (SELECT count(DISTINCT date) - 1 FROM p WHERE {INSIDE})").replace("back <= 21", f"back <= (SELECT count(DISTINCT date) FROM p WHERE {INSIDE})").replace("count(*) = 21", f"count(*) = (SELECT count(DISTINCT date) FROM p WHERE {INSIDE})")
)


@query(f"WITH {WINDOW_SQL} SELECT fund_code, start_date, end_date, archetype, is_valid, {rs(*rq.LENS_COLUMNS)} FROM lens")
def universe_window(spark: SparkSession, d: str) -> DataFrame:
    return co.universe_window(supplier_month(spark, d), supplier_weights(spark, d), START, END, LENS).select("fund_code", "start_date", "end_date", "archetype", "is_valid", *r(*rq.LENS_COLUMNS))


def _predicted(spark: SparkSession, d: str) -> DataFrame:
    v = cl.wide(al.mean_vectors(rq._rows(spark, d), ["fund_code"], rq.CLASSES), rq.FEATURE_LIST, ["fund_code"])
    return rq.FIXED.predict(v)


PREDICTED = f"{rq._vectors_sql('broad_group')}, {rq._predict_sql('fund_code')}, cls AS (SELECT fund_code, class_id, chr(65 + class_id) AS class_name, least(1, greatest(0, CASE WHEN nxt > 0 THEN 1 - dist / nxt ELSE 0 END)) AS confidence FROM pd WHERE i = 1)"
BOTH = LENS_SQL + ", " + ROWS_SQL.split(f"{W}, {DIM}, ")[1] + ", " + PREDICTED


@query(f"WITH {BOTH} SELECT lens.fund_code, archetype, class_id, class_name, round(confidence, 6) AS confidence FROM lens LEFT JOIN cls USING (fund_code)")
def universe_with_classes(spark: SparkSession, d: str) -> DataFrame:
    return co.with_classes(rq._lens(spark, d), _predicted(spark, d)).select("fund_code", "archetype", "class_id", "class_name", *r("confidence"))


@query(f"WITH {P}, {ROWS_SQL}, {PREDICTED} SELECT fund_code, coalesce(class_id, -1) AS class_id, class_name, class_id IS NOT NULL AS is_classifiable FROM (SELECT DISTINCT fund_code FROM p) LEFT JOIN (SELECT * FROM cls WHERE right(fund_code, 1) <> '7') USING (fund_code)")
def classes_of_all(spark: SparkSession, d: str) -> DataFrame:
    some = _predicted(spark, d).filter("right(fund_code, 1) <> '7'")  # the others stand for funds without a usable vector
    return co.ordered(co.all_funds(some, supplier_month(spark, d))).select("fund_code", "class_id", "class_name", "is_classifiable")


@query(f"WITH {P}, {ROWS_SQL} SELECT x.fund_code, days, first_day, last_day, fund_name FROM (SELECT fund_code, count(DISTINCT date) AS days, min(date) AS first_day, max(date) AS last_day FROM rr GROUP BY 1) x LEFT JOIN (SELECT fund_code, arg_max(fund_name, date) AS fund_name FROM p GROUP BY 1) USING (fund_code)")
def class_provenance(spark: SparkSession, d: str) -> DataFrame:
    return co.provenance(rq._rows(spark, d), supplier_month(spark, d))


@query(f"WITH {LENS_SQL} SELECT archetype, market_flow_quadrant FROM (SELECT archetype, market_flow_quadrant, count(*) AS n FROM lens GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY archetype ORDER BY n DESC, market_flow_quadrant) = 1")
def most_frequent_quadrant(spark: SparkSession, d: str) -> DataFrame:
    return co.most_frequent(rq._lens(spark, d), "archetype", "market_flow_quadrant")


@query(f"WITH {ROWS_SQL}, {PREDICTED} SELECT class_name, count(*) AS funds, count(*) FILTER (WHERE confidence < 0.1) AS low FROM cls GROUP BY 1")
def low_confidence(spark: SparkSession, d: str) -> DataFrame:
    return co.low_confidence(_predicted(spark, d), ClassificationConfig(low_confidence_threshold=0.1))


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{'ABC'[i]}', '{f}', {float(c[j])}::DOUBLE)" for i, c in enumerate(rq.CENTROIDS) for j, f in enumerate(rq.FEATURE_LIST)) + ") AS t(class_id, class_name, feature, weight)")
def centroids(spark: SparkSession, d: str) -> DataFrame:
    return co.centroid_table(spark, rq.FIXED)


@query(f"WITH {LENS_SQL} SELECT fund_code, fund_name FROM lens WHERE upper(fund_name) LIKE '%R#00000001%' OR upper(fund_code) LIKE '%R#00000001%'")
def search_names(spark: SparkSession, d: str) -> DataFrame:
    return co.search(rq._lens(spark, d), " r#00000001 ").select("fund_code", "fund_name")


@query(f"WITH {LENS_SQL} SELECT fund_code, market_flow_quadrant FROM lens WHERE contains(market_flow_quadrant, 'Negative Market') AND contains(market_flow_quadrant, 'Positive Flow')")
def falling_with_inflow(spark: SparkSession, d: str) -> DataFrame:
    return co.moving(rq._lens(spark, d), "Negative", "Positive").select("fund_code", "market_flow_quadrant")


def _limits(c: str) -> str:
    a, b = (f"quantile_cont({c}, {q})" for q in (0.01, 0.99))
    return f"SELECT '{c}' AS field, round({a} - ({b} - {a}) * 0.1, 6) AS low, round({b} + ({b} - {a}) * 0.1, 6) AS high FROM lens"


@query(f"WITH {LENS_SQL} " + " UNION ALL ".join(_limits(c) for c in ("flow_pct", "market_effect_pct")))
def chart_limits(spark: SparkSession, d: str) -> DataFrame:
    return co.axis_limits(rq._lens(spark, d), ("flow_pct", "market_effect_pct")).select("field", *r("low", "high"))


@query(f"WITH {DIM}, {W} SELECT DISTINCT code, code IN (SELECT code FROM dim) AS known FROM a WHERE weight <> 0 AND code IS NOT NULL")
def active_instruments(spark: SparkSession, d: str) -> DataFrame:
    return co.active_codes(supplier_weights(spark, d).filter("code is not null"))


@query(f"WITH {LENS_SQL} SELECT fund_code, round(net_flow, 4) AS net_flow FROM lens WHERE net_flow > 0 ORDER BY net_flow DESC, fund_code LIMIT 15")
def money_in(spark: SparkSession, d: str) -> DataFrame:
    return co.flow_list(rq._lens(spark, d), 15).select("fund_code", *r("net_flow", digits=4))


@query(f"WITH {DAILY} SELECT fund_code, round(avg(CASE WHEN prev_aum IS NOT NULL OR fund_return IS NOT NULL THEN CASE WHEN still THEN 0 ELSE 1 END END), 6) AS activity_before, arg_max(holders, date) AS holders_before FROM dl WHERE date < DATE '{DAY}' GROUP BY 1")
def dealing_before_event(spark: SparkSession, d: str) -> DataFrame:
    return co.before_event(stress.daily(user_day(spark, d)), DAY).select("fund_code", *r("activity_before"), "holders_before")


FOUNDERS = "fu AS (SELECT fund_code, regexp_extract(arg_min(fund_name, date), '^(.*?PORTFÖY)', 1) AS founder FROM wd GROUP BY 1)"


@query(f"""WITH {DAILY}, {FLOWS}, {FOUNDERS}, g AS (SELECT founder, sum(aum) FILTER (WHERE date = first_day) AS start_aum, sum(aum) FILTER (WHERE date = base_day) AS base_aum, sum(flow) FILTER (WHERE date > first_day AND date < event_date) AS bf, sum(flow) FILTER (WHERE date >= event_date) AS af
  FROM wd JOIN fu USING (fund_code), bd GROUP BY 1) SELECT founder, round(start_aum, 4) AS start_aum, round(base_aum, 4) AS base_aum, round(bf / nullif(start_aum, 0), 4) AS before_pct, round(af / nullif(base_aum, 0), 4) AS after_pct FROM g""")
def founder_flows(spark: SparkSession, d: str) -> DataFrame:
    s = rq._manual(spark, d)
    return co.founder_flows(s.daily, s.funds, DAY).select("founder", *r("start_aum", "base_aum", "before_pct", "after_pct", digits=4))


@query(f"WITH {DAILY}, {FLOWS} SELECT date, count(*) AS funds, round(sum(aum), 4) AS aum, round(sum(flow), 4) AS flow, round(median(fund_return), 6) AS median_return FROM wd GROUP BY 1")
def sums_by_day(spark: SparkSession, d: str) -> DataFrame:
    return co.day_sums(rq._manual(spark, d).daily).select("date", "funds", *r("aum", "flow", digits=4), *r("median_return"))


@query(f"WITH {DAILY}, {FLOWS}, {FOUNDERS} SELECT founder, count(DISTINCT fund_code) AS funds, round(coalesce(sum(flow) FILTER (WHERE flow > 0), 0), 2) AS inflow, round(coalesce(sum(flow) FILTER (WHERE flow < 0), 0), 2) AS outflow, round(sum(flow), 2) AS net FROM wd JOIN fu USING (fund_code) WHERE date >= DATE '{DAY}' GROUP BY 1")
def receivers(spark: SparkSession, d: str) -> DataFrame:
    s = rq._manual(spark, d)
    after = s.daily.filter(F.col("date") >= F.lit(DAY).cast("date"))
    return co.receivers(after, s.funds, "founder").select("founder", "funds", *r("inflow", "outflow", "net", digits=2))


@query(f"""WITH {U} SELECT fund_code, false AS unpublished, coalesce(turned, false) AS turned FROM (SELECT DISTINCT fund_code FROM p) LEFT JOIN (WITH {DAILY}, {FLOWS} SELECT fund_code, turned FROM ef) USING (fund_code)""")
def universe_with_stress(spark: SparkSession, d: str) -> DataFrame:
    s = rq._manual(spark, d)
    return co.with_stress(user_day(spark, d).select("fund_code").distinct(), s.funds).select("fund_code", "unpublished", "turned")


@query(f"""WITH {LENS_SQL}, x AS (SELECT *, rank() OVER (PARTITION BY archetype ORDER BY cumulative_return DESC NULLS LAST) AS rk, count(*) OVER (PARTITION BY archetype) AS peers FROM lens)
SELECT fund_code, CAST(rk AS BIGINT) AS place, peers FROM x""")
def summary_places(spark: SparkSession, d: str) -> DataFrame:
    s = co.fund_summary(rq._lens(spark, d))
    at = lambda i: F.regexp_extract("summary", r"rank (\d+) of (\d+)", i).cast("bigint")
    return s.select("fund_code", at(1).alias("place"), at(2).alias("peers"))

