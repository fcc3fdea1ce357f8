"""Queries of the panel, allocation, universe, stress and classification operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terazi.config import ClassificationConfig, LensConfig, StressConfig
from terazi.functions import labels
from terazi.metadata import BROAD_GROUPS, CURRENCIES, GROWTH_GROUPS, LOOKTHROUGH_GROUPS, ROWS, SCOPES, instruments
from terazi.operators import allocation as al
from terazi.operators import classifier as cl
from terazi.operators import dna, lens, panel, stress
from terazi.plans.panels import DIM, F_SQL, P, U, W, supplier_month, supplier_weights, table, user_day
from terazi.sources.store import calendar_gaps, replaced

#: Sizes of the derived panels are far below those of funds, so the thresholds that depend on size are set here.
LENS = LensConfig(lookback=20, min_start_aum=1e5, aum_edges=(2e5, 4e5, 8e5), holder_edges=(5, 10, 20))
STRESS = StressConfig(min_aum=0.01, price_drop=-0.5, heavy_outflow=-0.5, event_threshold=1.0, freeze_min_days=2, freeze_min_activity=0.3, freeze_min_history=3, history_days=None)
START, END = "2024-01-12", "2024-01-30"
CLASSES = ClassificationConfig(min_total=90.0, max_total=105.0)
LAST = 24

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r(*names: str, digits: int = 6) -> list:
    """Columns rounded for comparison."""
    return [F.round(F.col(c), digits).alias(c) for c in names]


def rs(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in names)


def sql_steps(x: str, edges, names, unknown: str = "Unknown") -> str:
    return f"CASE WHEN {x} IS NULL THEN '{unknown}' " + " ".join(f"WHEN {x} < {e} THEN '{n}'" for e, n in zip(edges, names, strict=False)) + f" ELSE '{names[-1]}' END"


def sql_direction(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN 'Unknown' WHEN {x} > 0.0005 THEN 'Positive' WHEN {x} < -0.0005 THEN 'Negative' ELSE 'Neutral' END"


# --- panels and flows --------------------------------------------------------------------------

T_SQL = """b AS (SELECT *, row_number() OVER (PARTITION BY fund_code ORDER BY date DESC) AS back FROM f),
t0 AS (SELECT fund_code, arg_max(fund_name, date) AS fund_name, min(date) AS start_date, max(date) AS end_date, arg_min(price, date) AS start_price, arg_min(aum, date) AS start_aum, arg_min(holders, date) AS start_holders,
    arg_max(price, date) AS end_price, arg_max(aum, date) AS end_aum, arg_max(holders, date) AS end_holders, coalesce(sum(CASE WHEN back <= 20 THEN prev_aum * fund_return END), 0) AS market_effect,
    coalesce(sum(CASE WHEN back <= 20 THEN flow_unit END), 0) AS net_flow, coalesce(sum(CASE WHEN back <= 20 THEN flow_aum END), 0) AS net_flow_aum, avg(CASE WHEN back <= 20 THEN flow_unit / nullif(prev_holders, 0) END) AS avg_flow_per_holder
  FROM b WHERE back <= 21 GROUP BY fund_code HAVING count(*) = 21),
t AS (SELECT *, end_aum - start_aum AS aum_change, end_aum / nullif(start_aum, 0) - 1 AS aum_change_pct, net_flow / nullif(start_aum, 0) AS flow_pct, market_effect / nullif(start_aum, 0) AS market_effect_pct,
    end_price / nullif(start_price, 0) - 1 AS cumulative_return, end_holders - start_holders AS participant_change, CAST(end_holders AS DOUBLE) / nullif(start_holders, 0) - 1 AS participant_change_pct FROM t0)"""
FLOW_COLUMNS = ("market_effect", "net_flow", "aum_change", "flow_pct", "market_effect_pct", "cumulative_return", "participant_change_pct", "avg_flow_per_holder")


@query(f"WITH {P}, {F_SQL}, {T_SQL} SELECT fund_code, start_date, end_date, {rs(*FLOW_COLUMNS)} FROM t")
def flow_decomposition(spark: SparkSession, d: str) -> DataFrame:
    t = panel.window_totals(panel.flow_features(panel.published(supplier_month(spark, d))), 20)
    return t.select("fund_code", "start_date", "end_date", *r(*FLOW_COLUMNS))


FEATURES = ("fund_return", "aum_change", "aum_change_pct", "unit_change", "unit_change_pct", "flow_aum", "flow_unit", "flow_aum_pct", "flow_unit_pct", "flow_diff", "flow_per_holder")


@query(f"""WITH {P}, {F_SQL} SELECT fund_code, date, date_diff('day', prev_date, date) AS days_since_prev, CAST(holders - prev_holders AS DOUBLE) AS holder_change, round(fund_return, 6) + 0.0 AS fund_return, round(aum - prev_aum, 6) + 0.0 AS aum_change,
  round(aum / nullif(prev_aum, 0) - 1, 6) + 0.0 AS aum_change_pct, round(units - prev_units, 6) + 0.0 AS unit_change, round(units / nullif(prev_units, 0) - 1, 6) + 0.0 AS unit_change_pct, round(flow_aum, 6) + 0.0 AS flow_aum, round(flow_unit, 6) + 0.0 AS flow_unit,
  round(flow_aum / nullif(prev_aum, 0), 6) + 0.0 AS flow_aum_pct, round(flow_unit / nullif(prev_aum, 0), 6) + 0.0 AS flow_unit_pct, round(flow_aum - flow_unit, 6) + 0.0 AS flow_diff, round(flow_unit / nullif(prev_holders, 0), 6) + 0.0 AS flow_per_holder FROM f""")
def flow_features_daily(spark: SparkSession, d: str) -> DataFrame:
    return panel.flow_features(supplier_month(spark, d)).select("fund_code", "date", "days_since_prev", "holder_change", *r(*FEATURES))


@query(f"WITH {P} SELECT fund_code, date, aum / nullif(units, 0) AS calculated_price, abs(price - round_even(aum / nullif(units, 0), 6)) < 1e-6 AS agrees FROM p")
def price_check(spark: SparkSession, d: str) -> DataFrame:
    return panel.flow_features(supplier_month(spark, d)).select("fund_code", "date", "calculated_price", (F.abs("price_diff") < 1e-6).alias("agrees"))


@query(f"WITH {P}, {W} SELECT p.fund_code, p.date, round(sum(a.weight), 6) AS total_weight, count(a.code) AS codes FROM p LEFT JOIN a ON a.fund_code = p.fund_code AND a.date = p.date GROUP BY 1, 2")
def panel_join(spark: SparkSession, d: str) -> DataFrame:
    return panel.join_allocation(supplier_month(spark, d), supplier_weights(spark, d)).select("fund_code", "date", *r("total_weight"), F.coalesce("codes", F.lit(0)).alias("codes"))


G_SQL = "p AS (SELECT upper(trim(fonkodu)) AS fund_code, fonunvan AS fund_name, CAST(tarih AS DATE) AS date, fiyat AS price, tedpaysayisi AS units, kisisayisi AS holders, portfoybuyukluk AS aum, kayit_no, yukleme FROM general)"
UNPUBLISHED = "(coalesce(price <= 0, false) OR coalesce(units < 1, false))"


def general_panel(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "general")
    return g.select(F.upper(F.trim("fonkodu")).alias("fund_code"), F.col("fonunvan").alias("fund_name"), F.col("tarih").cast("date").alias("date"), F.col("fiyat").alias("price"), F.col("tedpaysayisi").alias("units"), F.col("kisisayisi").alias("holders"), F.col("portfoybuyukluk").alias("aum"), "kayit_no", "yukleme")


@query(f"WITH {G_SQL} SELECT count(*) AS n_rows, count(*) - count(DISTINCT (fund_code, date)) AS repeated_keys, count(*) AS outside_total, count(*) FILTER (date IS NULL) AS null_dates, count(*) FILTER {UNPUBLISHED} AS unpublished_rows FROM p".replace("FILTER (date IS NULL)", "FILTER (WHERE date IS NULL)").replace(f"FILTER {UNPUBLISHED}", f"FILTER (WHERE {UNPUBLISHED})"))
def panel_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return panel.diagnostics(general_panel(spark, d).withColumn("total_weight", F.lit(None).cast("double")))


@query(f"WITH {G_SQL} SELECT fund_code, count(*) FILTER (WHERE {UNPUBLISHED}) AS rows, max(aum) AS max_aum FROM p GROUP BY 1 HAVING count(*) FILTER (WHERE {UNPUBLISHED}) > 0")
def unpublished_entities(spark: SparkSession, d: str) -> DataFrame:
    return panel.unpublished_funds(general_panel(spark, d))


@query(f"WITH {P} SELECT fund_code, date, round(aum, 2) AS aum FROM p WHERE date BETWEEN DATE '1994-01-01' AND DATE '1995-12-31'")
def date_window_slice(spark: SparkSession, d: str) -> DataFrame:
    return panel.date_window(supplier_month(spark, d), "1994-01-01", "1995-12-31").select("fund_code", "date", *r("aum", digits=2))


@query(f"WITH {G_SQL} SELECT kayit_no, fund_code, date, price FROM (SELECT DISTINCT kayit_no, fund_code, date, price, yukleme FROM p) QUALIFY row_number() OVER (PARTITION BY fund_code, date ORDER BY yukleme DESC NULLS LAST, kayit_no DESC NULLS LAST) = 1")
def keyed_dedupe_last(spark: SparkSession, d: str) -> DataFrame:
    g = general_panel(spark, d).select("kayit_no", "fund_code", "date", "price", "yukleme").distinct()
    return panel.dedupe_last(g.withColumn("seq", F.struct("yukleme", "kayit_no")), ["fund_code", "date"], "seq").select("kayit_no", "fund_code", "date", "price")


@query("SELECT DISTINCT feed, file_seq, line_no, payload FROM allocation_raw")
def chunk_union_distinct(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "allocation_raw").select("feed", "file_seq", "line_no", "payload")
    return x.filter("file_seq <= 3").unionByName(x.filter("file_seq > 3 or file_seq is null")).distinct()


@query(f"WITH {P}, h AS (SELECT fund_code, date, aum FROM p WHERE date < DATE '1996-06-01'), n AS (SELECT fund_code, date, aum + 1 AS aum FROM p WHERE date >= DATE '1996-03-01') SELECT fund_code, date, round(aum, 2) AS aum FROM h WHERE date < DATE '1996-03-01' UNION ALL SELECT fund_code, date, round(aum, 2) FROM n")
def period_replacement(spark: SparkSession, d: str) -> DataFrame:
    p = supplier_month(spark, d).select("fund_code", "date", "aum")
    return replaced(p.filter("date < date'1996-06-01'"), p.filter("date >= date'1996-03-01'").withColumn("aum", F.col("aum") + 1), "1996-03-01").select("fund_code", "date", *r("aum", digits=2))


@query("""WITH d AS (SELECT DISTINCT CAST(tarih AS DATE) AS date FROM fund_snapshots WHERE tarih IS NOT NULL), g AS (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM d)
SELECT date FROM g WHERE isodow(date) <= 5 AND date NOT IN (SELECT tatil FROM holidays WHERE tatil IS NOT NULL) AND date NOT IN (SELECT date FROM d)""")
def calendar_gaps_universe(spark: SparkSession, d: str) -> DataFrame:
    return calendar_gaps(table(spark, d, "fund_snapshots").select(F.col("tarih").cast("date").alias("date")), table(spark, d, "holidays").select(F.col("tatil").alias("date")))


# --- portfolio DNA -------------------------------------------------------------------------------


def _group_sql(column: str) -> str:
    return f"WITH {W}, {DIM} SELECT fund_code, date, {column} AS grp, round(sum(weight), 6) AS weight FROM a JOIN dim USING (code) GROUP BY 1, 2, 3"


@query(_group_sql("broad_group"))
def dna_broad(spark: SparkSession, d: str) -> DataFrame:
    return dna.group_weights(supplier_weights(spark, d), "broad").select("fund_code", "date", "grp", *r("weight"))


@query(_group_sql("market_scope"))
def dna_scope(spark: SparkSession, d: str) -> DataFrame:
    return dna.group_weights(supplier_weights(spark, d), "scope").select("fund_code", "date", "grp", *r("weight"))


@query(_group_sql("currency"))
def dna_currency(spark: SparkSession, d: str) -> DataFrame:
    return dna.group_weights(supplier_weights(spark, d), "currency").select("fund_code", "date", "grp", *r("weight"))


def _safe(prefix: str, g: str) -> str:
    return f"dna_{prefix}_{dna._safe(g)}"


@query(f"WITH {W}, {DIM} SELECT fund_code, date, " + ", ".join(f"round(coalesce(sum(CASE WHEN currency = '{g}' THEN weight END), 0), 6) AS {_safe('currency', g)}" for g in CURRENCIES) + " FROM a JOIN dim USING (code) GROUP BY 1, 2")
def dna_columns(spark: SparkSession, d: str) -> DataFrame:
    return dna.group_columns(supplier_weights(spark, d), "currency").select("fund_code", "date", *r(*(_safe("currency", g) for g in CURRENCIES)))


LATEST = "l AS (SELECT fund_code, code, weight, date AS latest_date FROM a QUALIFY date = max(date) OVER (PARTITION BY fund_code))"
TOP = "s AS (SELECT fund_code, latest_date, broad_group AS grp, sum(weight) AS weight FROM l JOIN dim USING (code) GROUP BY 1, 2, 3 HAVING abs(sum(weight)) >= 0.01), e AS (SELECT *, row_number() OVER (PARTITION BY fund_code ORDER BY weight DESC, grp) AS pos FROM s)"


@query(f"WITH {W}, {DIM}, {LATEST}, {TOP} SELECT fund_code, latest_date, grp, round(weight, 6) AS weight, pos FROM e WHERE pos <= 3")
def dna_top_exposures(spark: SparkSession, d: str) -> DataFrame:
    return dna.exposures(dna.latest_allocation(supplier_weights(spark, d)), "broad", 3).select("fund_code", "latest_date", "grp", *r("weight"), "pos")


@query(f"WITH {W}, {LATEST} SELECT fund_code, latest_date, code, round(weight, 6) AS weight FROM l")
def dna_latest_row(spark: SparkSession, d: str) -> DataFrame:
    return dna.latest_allocation(supplier_weights(spark, d)).select("fund_code", "latest_date", "code", *r("weight"))


def _weights(column: str, names: list[str], prefix: str) -> str:
    cells = (f"coalesce(sum(CASE WHEN {column} = '{g}' THEN weight END), 0)" for g in names)
    return ", ".join(f"CASE WHEN abs({x}) >= 0.01 THEN {x} ELSE 0 END AS {prefix}{i}" for i, x in enumerate(cells))


def _archetype_sql() -> str:
    b, s, c = (lambda g: f"b{BROAD_GROUPS.index(g)}"), (lambda g: f"s{SCOPES.index(g)}"), (lambda g: f"c{CURRENCIES.index(g)}")
    side = " + ".join([*(b(g) for g in ("Equity", "Foreign Equity", "Deposit", "Participation Account", "Lease Certificates", "Fund", "ETF", "Real Estate / Alternative", "Venture Capital / Alternative")), s("Look-through Required")])
    place = lambda tail: f"CASE WHEN {s('Domestic')} >= 50 THEN 'Domestic {tail}' WHEN {s('Foreign / International')} >= 50 THEN 'Foreign {tail}' ELSE '{tail}' END"
    return (
        f"CASE WHEN top_broad IS NULL THEN 'Unknown Fund Type' WHEN {b('Precious Metals')} >= 50 OR {c('Gold')} >= 50 THEN 'Gold / Precious Metals Fund' WHEN {c('FX')} >= 50 AND {b('Fixed Income')} >= 50 THEN 'FX / Eurobond Fixed-Income Fund' "
        f"WHEN {b('Foreign Equity')} >= 50 THEN 'Foreign Equity Fund' WHEN {b('Equity')} >= 50 THEN 'Domestic Equity Fund' WHEN {b('Money Market')} >= 50 THEN 'Money Market Fund' "
        f"WHEN {b('Fixed Income')} >= 50 AND ({side} >= 20 OR {b('Equity')} >= 10 OR {s('Look-through Required')} >= 10) THEN {place('Fixed-Income Dominant Multi-Asset Fund')} WHEN {b('Fixed Income')} >= 50 THEN {place('Fixed-Income Fund')} "
        "WHEN top_broad_weight < 50 THEN 'Multi-Asset / Mixed Allocation Fund' WHEN top_broad = 'Fund' THEN 'Fund Allocation Dominant Fund' ELSE top_broad || ' Dominant Fund' END"
    )


ARCH = f"""g AS (SELECT fund_code, latest_date, {_weights('broad_group', BROAD_GROUPS, 'b')}, {_weights('market_scope', SCOPES, 's')}, {_weights('currency', CURRENCIES, 'c')} FROM l JOIN dim USING (code) GROUP BY 1, 2),
top1 AS (SELECT fund_code, grp AS top_broad, weight AS top_broad_weight FROM e WHERE pos = 1),
ar AS (SELECT g.fund_code, g.latest_date, {_archetype_sql()} AS archetype, top_broad, top_broad_weight, s{SCOPES.index('Look-through Required')} AS lookthrough_weight FROM g LEFT JOIN top1 USING (fund_code))"""
ARCHETYPES = f"{W}, {DIM}, {LATEST}, {TOP}, {ARCH}"


@query(f"WITH {ARCHETYPES} SELECT fund_code, latest_date, archetype, top_broad, round(top_broad_weight, 6) AS top_broad_weight, round(lookthrough_weight, 6) AS lookthrough_weight FROM ar")
def archetype(spark: SparkSession, d: str) -> DataFrame:
    return dna.archetypes(dna.latest_allocation(supplier_weights(spark, d))).select("fund_code", "latest_date", "archetype", "top_broad", *r("top_broad_weight", "lookthrough_weight"))


# --- universe ------------------------------------------------------------------------------------

BIG = sql_steps("abs({})", (0.0005, 0.0025, 0.01), ("Neutral / negligible", "Small", "Moderate", "Strong"))
REGIME = f"""CASE {sql_direction('flow_pct')} WHEN 'Neutral' THEN CASE WHEN participant_change > 0 THEN 'Neutral flow with participant growth' WHEN participant_change < 0 THEN 'Neutral flow with participant decline' ELSE 'Neutral flow regime' END
  WHEN 'Positive' THEN {BIG.format('flow_pct', *['flow_pct'] * 4).replace('abs({})', 'abs(flow_pct)')} || CASE WHEN participant_change > 0 THEN ' net inflow with participant growth' WHEN participant_change < 0 THEN ' net inflow without participant growth' ELSE ' net inflow with stable participant count' END
  WHEN 'Negative' THEN {BIG.format('flow_pct', *['flow_pct'] * 4).replace('abs({})', 'abs(flow_pct)')} || CASE WHEN participant_change > 0 THEN ' net outflow despite participant growth' WHEN participant_change < 0 THEN ' net outflow with participant decline' ELSE ' net outflow with stable participant count' END
  ELSE 'Unknown flow regime' END""".replace("abs({})", "abs(flow_pct)")
QUADRANT = f"CASE WHEN market_effect_pct IS NULL OR flow_pct IS NULL THEN 'Unknown Market / Unknown Flow' ELSE ({sql_direction('market_effect_pct')}) || ' Market / ' || ({sql_direction('flow_pct')}) || ' Flow' END"
LENS_SQL = f"""{P}, {F_SQL}, {T_SQL}, {ARCHETYPES}, lens AS (SELECT t.*, ar.archetype, ar.latest_date, ar.top_broad, ar.lookthrough_weight, {sql_steps('start_aum', LENS.aum_edges, ('Small AUM', 'Mid AUM', 'Large AUM', 'Mega AUM'))} AS aum_segment,
  {sql_steps('start_holders', LENS.holder_edges, ('Small Participant Base', 'Mid Participant Base', 'Large Participant Base', 'Mega Participant Base'))} AS participant_segment,
  {sql_steps('abs(flow_pct)', (0.0005, 0.0025, 0.01, 0.05, 0.25), ('Neutral', 'Small', 'Moderate', 'Strong', 'Very Strong', 'Extreme'))} AS flow_intensity, {QUADRANT} AS market_flow_quadrant, {REGIME} AS flow_regime,
  coalesce(start_aum > {LENS.min_start_aum}, false) AND coalesce(start_holders > 0, false) AND flow_pct IS NOT NULL AND market_effect_pct IS NOT NULL AND participant_change_pct IS NOT NULL AS is_valid FROM t JOIN ar USING (fund_code))"""


def _lens(spark: SparkSession, d: str) -> DataFrame:
    return lens.universe(supplier_month(spark, d), supplier_weights(spark, d), LENS)


LENS_COLUMNS = ("start_aum", "end_aum", "flow_pct", "market_effect_pct", "participant_change_pct", "cumulative_return")


@query(f"WITH {LENS_SQL} SELECT fund_code, archetype, latest_date, start_date, end_date, is_valid, {rs(*LENS_COLUMNS)} FROM lens")
def lens_universe(spark: SparkSession, d: str) -> DataFrame:
    return _lens(spark, d).select("fund_code", "archetype", "latest_date", "start_date", "end_date", "is_valid", *r(*LENS_COLUMNS))


@query(f"WITH {LENS_SQL} SELECT fund_code, aum_segment, participant_segment, flow_intensity FROM lens")
def segments(spark: SparkSession, d: str) -> DataFrame:
    return _lens(spark, d).select("fund_code", "aum_segment", "participant_segment", "flow_intensity")


@query(f"WITH {LENS_SQL} SELECT fund_code, market_flow_quadrant FROM lens")
def quadrants(spark: SparkSession, d: str) -> DataFrame:
    return _lens(spark, d).select("fund_code", "market_flow_quadrant")


@query(f"WITH {LENS_SQL} SELECT fund_code, flow_regime FROM lens")
def flow_regime(spark: SparkSession, d: str) -> DataFrame:
    return _lens(spark, d).select("fund_code", "flow_regime")


UNIVERSE = ("total_start_aum", "total_end_aum", "total_net_flow", "total_market_effect", "avg_flow_pct", "avg_market_effect_pct", "median_flow_pct", "median_market_effect_pct")


@query(f"""WITH {LENS_SQL} SELECT count(*) AS fund_count, round(sum(start_aum), 4) AS total_start_aum, round(sum(end_aum), 4) AS total_end_aum, round(sum(net_flow), 4) AS total_net_flow, round(sum(market_effect), 4) AS total_market_effect,
  round(avg(flow_pct), 4) AS avg_flow_pct, round(avg(market_effect_pct), 4) AS avg_market_effect_pct, round(median(flow_pct), 4) AS median_flow_pct, round(median(market_effect_pct), 4) AS median_market_effect_pct FROM lens""")
def universe_summary(spark: SparkSession, d: str) -> DataFrame:
    return lens.universe_summary(_lens(spark, d)).select("fund_count", *r(*UNIVERSE, digits=4))


SUMMARY = ("total_start_aum", "start_aum_share", "weighted_flow_pct", "weighted_market_effect_pct", "weighted_aum_change_pct", "avg_flow_pct", "median_flow_pct", "avg_participant_change_pct", "median_participant_change_pct")


def _summary_sql(c: str, least: int = 1) -> str:
    return f"""WITH {LENS_SQL}, z AS (SELECT {c}, count(*) AS fund_count, sum(start_aum) AS total_start_aum, sum(sum(start_aum)) OVER () AS whole, sum(end_aum) AS e, sum(net_flow) AS n, sum(market_effect) AS m, CAST(sum(participant_change) AS BIGINT) AS total_participant_change,
  avg(flow_pct) AS avg_flow_pct, median(flow_pct) AS median_flow_pct, avg(participant_change_pct) AS avg_participant_change_pct, median(participant_change_pct) AS median_participant_change_pct FROM lens GROUP BY {c})
SELECT {c}, fund_count, total_participant_change, round(total_start_aum, 4) AS total_start_aum, round(total_start_aum / nullif(whole, 0), 4) AS start_aum_share, round(n / nullif(total_start_aum, 0), 4) AS weighted_flow_pct, round(m / nullif(total_start_aum, 0), 4) AS weighted_market_effect_pct,
  round(e / nullif(total_start_aum, 0) - 1, 4) AS weighted_aum_change_pct, round(avg_flow_pct, 4) AS avg_flow_pct, round(median_flow_pct, 4) AS median_flow_pct, round(avg_participant_change_pct, 4) AS avg_participant_change_pct, round(median_participant_change_pct, 4) AS median_participant_change_pct FROM z WHERE fund_count >= {least}"""


def _summary(spark: SparkSession, d: str, c: str, least: int = 1) -> DataFrame:
    return lens.summary_by(_lens(spark, d), c, least).select(c, "fund_count", "total_participant_change", *r(*SUMMARY, digits=4))


@query(_summary_sql("archetype"))
def summary_by_archetype(spark: SparkSession, d: str) -> DataFrame:
    return _summary(spark, d, "archetype")


@query(_summary_sql("market_flow_quadrant"))
def summary_by_quadrant(spark: SparkSession, d: str) -> DataFrame:
    return _summary(spark, d, "market_flow_quadrant")


@query(_summary_sql("aum_segment", 3))
def summary_by_segment(spark: SparkSession, d: str) -> DataFrame:
    return _summary(spark, d, "aum_segment", 3)


@query(f"WITH {LENS_SQL}, x AS (SELECT archetype, market_flow_quadrant, sum(start_aum) AS start_aum FROM lens GROUP BY 1, 2) SELECT archetype, market_flow_quadrant, round(start_aum, 4) AS start_aum, round(start_aum / nullif(sum(start_aum) OVER (PARTITION BY archetype), 0), 6) AS share FROM x")
def crosstab_aum(spark: SparkSession, d: str) -> DataFrame:
    return lens.crosstab(_lens(spark, d)).select("archetype", "market_flow_quadrant", *r("start_aum", digits=4), *r("share"))


@query(f"""WITH {LENS_SQL}, x AS (SELECT archetype, market_flow_quadrant, sum(start_aum) AS v FROM lens GROUP BY 1, 2), y AS (SELECT *, sum(v) OVER (PARTITION BY archetype) AS total FROM x)
SELECT archetype, market_flow_quadrant AS dominant_quadrant, round(v / nullif(total, 0), 6) AS dominant_quadrant_share, {sql_steps('v / nullif(total, 0)', (0.35, 0.5, 0.75), ('Fragmented', 'Weak dominance', 'Moderate dominance', 'High dominance'))} AS dominance_strength, round(total, 4) AS total_start_aum
FROM y QUALIFY row_number() OVER (PARTITION BY archetype ORDER BY v / nullif(total, 0) DESC NULLS LAST, market_flow_quadrant) = 1""")
def dominant_quadrant(spark: SparkSession, d: str) -> DataFrame:
    return lens.dominant(_lens(spark, d)).select("archetype", "dominant_quadrant", *r("dominant_quadrant_share"), "dominance_strength", *r("total_start_aum", digits=4))


@query(f"""WITH {LENS_SQL} SELECT count(*) AS funds, count(*) FILTER (WHERE NOT is_valid) AS invalid, count(*) FILTER (WHERE flow_pct IS NULL) AS missing_flow, count(*) FILTER (WHERE market_effect_pct IS NULL) AS missing_effect, round(min(flow_pct), 6) AS min_flow_pct, round(max(flow_pct), 6) AS max_flow_pct,
  round(min(market_effect_pct), 6) AS min_market_effect_pct, round(max(market_effect_pct), 6) AS max_market_effect_pct, count(*) - count(DISTINCT fund_code) AS repeated_codes FROM lens""")
def universe_validation(spark: SparkSession, d: str) -> DataFrame:
    return lens.validation(_lens(spark, d)).select("funds", "invalid", "missing_flow", "missing_effect", *r("min_flow_pct", "max_flow_pct", "min_market_effect_pct", "max_market_effect_pct"), "repeated_codes")


@query(f"""WITH {LENS_SQL} SELECT split_part(fund_name, ' ', 1) AS founder, count(*) AS funds, count(*) FILTER (WHERE is_valid) AS analysed, round(sum(start_aum), 4) AS start_aum, round(sum(net_flow) / nullif(sum(start_aum), 0), 4) AS flow_pct FROM lens GROUP BY 1""")
def founder_totals(spark: SparkSession, d: str) -> DataFrame:
    return lens.founder_totals([_lens(spark, d)]).select("founder", "funds", "analysed", *r("start_aum", "flow_pct", digits=4))


def _top_sql(by: str, n: int, where: str = "true", order: str = "DESC") -> str:
    return f"WITH {LENS_SQL} SELECT fund_code, round({by}, 6) AS {by} FROM lens WHERE {where} ORDER BY lens.{by} {order} NULLS LAST, fund_code LIMIT {n}"


def _screen(name: str, f, by: str, sql: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return f(_lens(spark, d)).select("fund_code", *r(by))

    run.__name__ = name
    query(sql)(run)


_screen("top_inflows", lens.top_inflows, "flow_pct", _top_sql("flow_pct", 20))
_screen("top_outflows", lens.top_outflows, "flow_pct", _top_sql("flow_pct", 20, order="ASC"))
_screen("pure_performance", lambda x: lens.pure_performance(x, neutral=0.25), "market_effect_pct", _top_sql("market_effect_pct", 20, "market_effect_pct > 0.01 AND abs(flow_pct) < 0.25"))
_screen("performance_led", lens.performance_led, "market_effect_pct", _top_sql("market_effect_pct", 20, "market_effect_pct > 0.01 AND abs(market_effect_pct) > abs(flow_pct)"))
_screen("holder_growth_neutral", lambda x: lens.holder_growth_neutral(x, neutral=0.5), "participant_change_pct", _top_sql("participant_change_pct", 20, "participant_change_pct > 0.005 AND abs(flow_pct) < 0.5"))
_screen("high_lookthrough", lens.high_lookthrough, "lookthrough_weight", _top_sql("lookthrough_weight", 20))
_screen("high_growth", lens.high_growth, "flow_pct", _top_sql("flow_pct", 30, "flow_pct > 0.25"))
_screen("established", lambda x: lens.established(x, 3e5, 8), "start_aum", f"WITH {LENS_SQL} SELECT fund_code, round(start_aum, 6) AS start_aum FROM lens WHERE start_aum >= 300000 AND start_holders >= 8")
_screen("compare_selected", lambda x: lens.selected(x, [" s00001", "S00007 ", "S00042"]), "flow_pct", f"WITH {LENS_SQL} SELECT fund_code, round(flow_pct, 6) AS flow_pct FROM lens WHERE fund_code IN ('S00001', 'S00007', 'S00042')")


@query(f"""WITH {LENS_SQL} SELECT fund_code, archetype, rank() OVER (PARTITION BY archetype ORDER BY cumulative_return DESC NULLS LAST) AS return_rank, rank() OVER (PARTITION BY archetype ORDER BY flow_pct DESC NULLS LAST) AS flow_rank,
  rank() OVER (PARTITION BY archetype ORDER BY end_aum DESC NULLS LAST) AS aum_rank, count(*) OVER (PARTITION BY archetype) AS peer_count FROM lens""")
def peer_ranks(spark: SparkSession, d: str) -> DataFrame:
    return lens.peer_ranks(_lens(spark, d))


@query(f"""WITH {LENS_SQL}, o AS (SELECT fund_code, archetype, row_number() OVER (PARTITION BY archetype ORDER BY end_aum DESC NULLS LAST, fund_code) AS i FROM lens)
SELECT x.fund_code, y.fund_code AS other, CAST(y.i - x.i AS INTEGER) AS step FROM o x JOIN o y ON x.archetype = y.archetype AND y.i <> x.i AND abs(y.i - x.i) <= 3""")
def similar_entities(spark: SparkSession, d: str) -> DataFrame:
    return lens.similar(_lens(spark, d))


# --- allocation classification -------------------------------------------------------------------

ROWS_SQL = f"""{W}, {DIM}, q AS (SELECT *, sum(weight) OVER (PARTITION BY fund_code, date) AS total FROM a), k AS (SELECT *, dense_rank() OVER (PARTITION BY fund_code ORDER BY date DESC) AS back FROM q WHERE total BETWEEN 90 AND 105),
rr AS (SELECT * FROM k WHERE back <= {LAST})"""


def _vectors_sql(column: str, keys: str = "fund_code") -> str:
    return f"""days AS (SELECT {keys}, count(DISTINCT date) AS days FROM rr GROUP BY {keys}), m AS (SELECT {keys}, {column} AS feature, sum(weight) / max(days) AS v FROM rr JOIN dim USING (code) JOIN days USING ({keys}) GROUP BY {keys}, {column}),
v AS (SELECT {keys}, feature, v / nullif(sum(v) OVER (PARTITION BY {keys}), 0) * 100 AS value FROM m)"""


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return al.last_days(al.quality_days(supplier_weights(spark, d), CLASSES), LAST)


@query(f"WITH {ROWS_SQL}, {_vectors_sql('broad_group')} SELECT fund_code, feature, round(value, 6) AS value FROM v")
def alloc_features(spark: SparkSession, d: str) -> DataFrame:
    return al.mean_vectors(_rows(spark, d), ["fund_code"], CLASSES).select("fund_code", "feature", *r("value"))


@query(f"WITH {ROWS_SQL}, {_vectors_sql('asset_group')} SELECT fund_code, feature, round(value, 6) AS value FROM v")
def alloc_features_detailed(spark: SparkSession, d: str) -> DataFrame:
    return al.mean_vectors(_rows(spark, d), ["fund_code"], ClassificationConfig(feature_space="detailed")).select("fund_code", "feature", *r("value"))


SLICES_SQL = ROWS_SQL.replace("rr AS", "rq AS") + ", rr AS (SELECT *, 3 - least(CAST(floor((back - 1) / ceil((SELECT max(back) FROM rq) / 4.0)) AS BIGINT), 3) AS slice FROM rq)"


def _slices(spark: SparkSession, d: str) -> DataFrame:
    return al.mean_vectors(al.slices(_rows(spark, d), 4), ["fund_code", "slice"], CLASSES)


@query(f"WITH {SLICES_SQL}, {_vectors_sql('broad_group', 'fund_code, slice')} SELECT fund_code, slice, feature, round(value, 6) AS value FROM v")
def alloc_subwindows(spark: SparkSession, d: str) -> DataFrame:
    return _slices(spark, d).select("fund_code", "slice", "feature", *r("value"))


@query(f"""WITH {SLICES_SQL}, {_vectors_sql('broad_group', 'fund_code, slice')}, fs AS (SELECT DISTINCT fund_code, slice FROM v), pr AS (SELECT x.fund_code, x.slice AS a, y.slice AS b FROM fs x JOIN fs y ON x.fund_code = y.fund_code AND (y.slice = x.slice + 1 OR (x.slice = 0 AND y.slice = 3))),
u AS (SELECT pr.*, feature, value FROM pr JOIN v ON v.fund_code = pr.fund_code AND v.slice = a UNION ALL SELECT pr.*, feature, -value FROM pr JOIN v ON v.fund_code = pr.fund_code AND v.slice = b),
dd AS (SELECT fund_code, a, b, feature, sum(value) AS x FROM u GROUP BY ALL), l1 AS (SELECT fund_code, a, b, sum(abs(x)) AS distance FROM dd GROUP BY ALL)
SELECT fund_code, round(avg(CASE WHEN b = a + 1 THEN distance END), 6) AS allocation_volatility, round(max(CASE WHEN a = 0 AND b = 3 THEN distance END), 6) AS style_drift FROM l1 GROUP BY fund_code""")
def style_drift(spark: SparkSession, d: str) -> DataFrame:
    return al.drift(_slices(spark, d)).select("fund_code", *r("allocation_volatility", "style_drift"))


def _in(at: int, *values: str) -> str:
    return "(" + ", ".join(f"'{x[0]}'" for x in ROWS if x[at] in values) + ")"


SUPPORT = f"""days AS (SELECT fund_code, count(DISTINCT date) AS days FROM rr GROUP BY 1), mc AS (SELECT fund_code, code, sum(weight) / max(days) AS weight FROM rr JOIN days USING (fund_code) GROUP BY 1, 2),
sw AS (SELECT fund_code, coalesce(sum(abs(weight)) FILTER (WHERE code IN {_in(6, 'I')}), 0) AS interest_bearing_weight, coalesce(sum(weight) FILTER (WHERE code IN {_in(6, 'P')}), 0) AS participation_asset_weight,
  coalesce(sum(weight) FILTER (WHERE code IN {_in(3, *GROWTH_GROUPS)}), 0) AS growth_asset_weight, coalesce(sum(weight) FILTER (WHERE code IN {_in(3, *LOOKTHROUGH_GROUPS)}), 0) AS lookthrough_weight,
  coalesce(sum(weight) FILTER (WHERE code IN {_in(5, 'TRY')}), 0) AS try_weight, coalesce(sum(weight) FILTER (WHERE code IN {_in(5, 'FX')}), 0) AS fx_weight, coalesce(sum(weight) FILTER (WHERE code IN {_in(5, 'Gold')}), 0) AS gold_weight FROM mc GROUP BY 1)"""
SUPPORT_COLUMNS = ("interest_bearing_weight", "participation_asset_weight", "growth_asset_weight", "lookthrough_weight", "try_weight", "fx_weight", "gold_weight")
AXES = ClassificationConfig(participation_tolerance=35.0, participation_min_coverage=50.0, currency_band_threshold=45.0, lookthrough_band_edges=(12.0, 18.0), risk_band_edges=(25.0, 32.0, 40.0))


def _support(spark: SparkSession, d: str) -> DataFrame:
    return al.support_weights(al.mean_codes(_rows(spark, d)), AXES)


@query(f"WITH {ROWS_SQL}, {SUPPORT} SELECT fund_code, {rs(*SUPPORT_COLUMNS)} FROM sw")
def support_weights(spark: SparkSession, d: str) -> DataFrame:
    return _support(spark, d).select("fund_code", *r(*SUPPORT_COLUMNS))


@query(f"WITH {ROWS_SQL}, {SUPPORT} SELECT fund_code, CASE WHEN interest_bearing_weight + participation_asset_weight <= 0 THEN 'Unknown' WHEN interest_bearing_weight <= 35 AND participation_asset_weight >= 50 THEN 'Participation' WHEN interest_bearing_weight <= 35 THEN 'Mixed' ELSE 'Conventional' END AS participation_class FROM sw")
def participation(spark: SparkSession, d: str) -> DataFrame:
    return _support(spark, d).select("fund_code", al.participation(AXES).alias("participation_class"))


BANDS = ("Conservative", "Balanced", "Aggressive", "Specialised")


@query(f"WITH {ROWS_SQL}, {SUPPORT} SELECT fund_code, {sql_steps('growth_asset_weight', AXES.risk_band_edges, BANDS)} AS risk_band FROM sw")
def risk_band_fixed(spark: SparkSession, d: str) -> DataFrame:
    return _support(spark, d).select("fund_code", al.risk_band(AXES.risk_band_edges).alias("risk_band"))


@query(f"""WITH {ROWS_SQL}, {SUPPORT}, qq AS (SELECT quantile_cont(growth_asset_weight, 0.25) AS e1, quantile_cont(growth_asset_weight, 0.5) AS e2, quantile_cont(growth_asset_weight, 0.75) AS e3 FROM sw)
SELECT fund_code, CASE WHEN growth_asset_weight < e1 THEN '{BANDS[0]}' WHEN growth_asset_weight < e2 THEN '{BANDS[1]}' WHEN growth_asset_weight < e3 THEN '{BANDS[2]}' ELSE '{BANDS[3]}' END AS risk_band FROM sw, qq""")
def risk_band_quantile(spark: SparkSession, d: str) -> DataFrame:
    s = _support(spark, d)
    return s.select("fund_code", al.risk_band(al.risk_edges(s, ClassificationConfig(risk_band_method="quantile"))).alias("risk_band"))


@query()
def risk_band_kmeans1d(spark: SparkSession, d: str) -> DataFrame:
    s = _support(spark, d)
    return s.select("fund_code", al.risk_band(al.risk_edges(s, ClassificationConfig(risk_band_method="kmeans1d"))).alias("risk_band"))


@query(f"WITH {ROWS_SQL}, {SUPPORT} SELECT fund_code, CASE WHEN gold_weight >= 45 THEN 'Gold Weighted' WHEN fx_weight >= 45 THEN 'FX Weighted' WHEN try_weight >= 45 THEN 'TRY Weighted' ELSE 'Mixed Currency' END AS currency_band FROM sw")
def currency_band(spark: SparkSession, d: str) -> DataFrame:
    return _support(spark, d).select("fund_code", al.currency_band(AXES).alias("currency_band"))


@query(f"WITH {ROWS_SQL}, {SUPPORT} SELECT fund_code, {sql_steps('lookthrough_weight', (12, 18), ('Transparent', 'Partial Look-through', 'Heavy Look-through'))} AS lookthrough_band FROM sw")
def lookthrough_band(spark: SparkSession, d: str) -> DataFrame:
    return _support(spark, d).select("fund_code", al.lookthrough_band(AXES).alias("lookthrough_band"))


FEATURE_LIST = cl.features_of(CLASSES)
RULE = ClassificationConfig(dominant_threshold=40.0, primary_threshold=22.0)


@query(f"""WITH {ROWS_SQL}, {_vectors_sql('broad_group')}, rk AS (SELECT fund_code, feature, value, row_number() OVER (PARTITION BY fund_code ORDER BY value DESC, feature) AS i FROM v WHERE value > 0), o AS (SELECT fund_code, max(feature) FILTER (WHERE i = 1) AS f1, max(value) FILTER (WHERE i = 1) AS v1, max(feature) FILTER (WHERE i = 2) AS f2 FROM rk GROUP BY 1)
SELECT fund_code, CASE WHEN v1 >= 40 THEN f1 || ' Weighted' WHEN v1 >= 22 THEN f1 || ' Tilted' ELSE 'Multi-Asset (' || f1 || ' / ' || coalesce(f2, f1) || ')' END AS class_name FROM o""")
def rule_fallback_classes(spark: SparkSession, d: str) -> DataFrame:
    v = cl.wide(al.mean_vectors(_rows(spark, d), ["fund_code"], CLASSES), FEATURE_LIST, ["fund_code"])
    return v.select("fund_code", cl.rule_label(FEATURE_LIST, RULE).alias("class_name"))


def _centre(**weights: float) -> list[float]:
    return [float(weights.get(dna._safe(f), 0.0)) for f in FEATURE_LIST]


CENTROIDS = [_centre(equity=30, fixed_income=40, fund=10, lease_certificates=10, precious_metals=10), _centre(equity=10, fixed_income=30, fund=25, lease_certificates=15, precious_metals=20), _centre(equity=20, fixed_income=30, fund=10, lease_certificates=25, precious_metals=15)]
FIXED = cl.Model(FEATURE_LIST, CENTROIDS, ["A", "B", "C"], ["Equity", "Multi-Asset", "Other"], "rule")


def _predict_sql(keys: str) -> str:
    cells = ", ".join(f"({i}, '{f}', {c[j]})" for i, c in enumerate(CENTROIDS) for j, f in enumerate(FEATURE_LIST))
    return f"""cc AS (SELECT * FROM (VALUES {cells}) AS t(class_id, feature, c)), kk AS (SELECT DISTINCT {keys} FROM v), ds AS (SELECT {', '.join('kk.' + x.strip() for x in keys.split(','))}, class_id, sqrt(sum((coalesce(value, 0) - c) * (coalesce(value, 0) - c))) AS dist FROM kk CROSS JOIN cc LEFT JOIN v ON v.feature = cc.feature AND {' AND '.join(f'v.{x.strip()} = kk.{x.strip()}' for x in keys.split(','))} GROUP BY ALL),
pd AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY dist, class_id) AS i, lead(dist) OVER (PARTITION BY {keys} ORDER BY dist, class_id) AS nxt FROM ds)"""


@query(f"WITH {ROWS_SQL}, {_vectors_sql('broad_group')}, {_predict_sql('fund_code')} SELECT fund_code, class_id, round(dist, 6) AS distance, round(least(1, greatest(0, CASE WHEN nxt > 0 THEN 1 - dist / nxt ELSE 0 END)), 6) AS confidence FROM pd WHERE i = 1")
def predict_fixed_centroids(spark: SparkSession, d: str) -> DataFrame:
    v = cl.wide(al.mean_vectors(_rows(spark, d), ["fund_code"], CLASSES), FEATURE_LIST, ["fund_code"])
    return FIXED.predict(v).select("fund_code", "class_id", *r("distance", "confidence"))


@query(f"WITH {SLICES_SQL}, {_vectors_sql('broad_group', 'fund_code, slice')}, {_predict_sql('fund_code, slice')}, n AS (SELECT fund_code, class_id, count(*) AS n FROM pd WHERE i = 1 GROUP BY ALL) SELECT fund_code, round(max(n) / sum(n), 6) AS class_stability FROM n GROUP BY 1")
def class_stability(spark: SparkSession, d: str) -> DataFrame:
    return cl.modal_share(FIXED.predict(cl.wide(_slices(spark, d), FEATURE_LIST, ["fund_code", "slice"]))).select("fund_code", *r("class_stability"))


@query(f"WITH {ROWS_SQL}, {_vectors_sql('broad_group')}, {_predict_sql('fund_code')}, z AS (SELECT class_id, round(least(1, greatest(0, CASE WHEN nxt > 0 THEN 1 - dist / nxt ELSE 0 END)), 12) AS confidence FROM pd WHERE i = 1) SELECT chr(65 + class_id) AS class_name, count(*) AS funds, round(avg(confidence), 6) AS avg_confidence, round(count(*) / sum(count(*)) OVER (), 6) AS fund_share FROM z GROUP BY class_id")
def class_summary(spark: SparkSession, d: str) -> DataFrame:
    v = cl.wide(al.mean_vectors(_rows(spark, d), ["fund_code"], CLASSES), FEATURE_LIST, ["fund_code"])
    return cl.class_summary(FIXED.predict(v).withColumn("class_stability", F.lit(1.0))).select("class_name", "funds", *r("avg_confidence", "fund_share"))


@query(f"""WITH {ROWS_SQL}, {_vectors_sql('broad_group')}, {_predict_sql('fund_code')}, w1 AS (SELECT fund_code, class_id FROM pd WHERE i = 1) SELECT w1.fund_code, w1.class_id <> w2.class_id AS drift_flag FROM w1 JOIN (
  WITH rr AS (SELECT * FROM k WHERE back <= 1), {_vectors_sql('broad_group')}, {_predict_sql('fund_code')} SELECT fund_code, class_id FROM pd WHERE i = 1) w2 USING (fund_code)""")
def drift_flag(spark: SparkSession, d: str) -> DataFrame:
    at = lambda n: FIXED.predict(cl.wide(al.mean_vectors(al.last_days(al.quality_days(supplier_weights(spark, d), CLASSES), n), ["fund_code"], CLASSES), FEATURE_LIST, ["fund_code"]))
    return at(LAST).select("fund_code", "class_id").join(at(1).select("fund_code", F.col("class_id").alias("latest")), "fund_code").select("fund_code", (F.col("class_id") != F.col("latest")).alias("drift_flag"))


@query()
def kmeans_classes(spark: SparkSession, d: str) -> DataFrame:
    _, out = cl.classify(supplier_weights(spark, d), LAST, ClassificationConfig())
    return out.select("fund_code", "class_id", "class_name", "family", "confidence", "class_stability", "style_drift", "drift_flag", "participation_class", "risk_band", "currency_band", "lookthrough_band")


@query()
def silhouette_by_k(spark: SparkSession, d: str) -> DataFrame:
    kept = cl.classifiable(cl.wide(al.mean_vectors(_rows(spark, d), ["fund_code"], CLASSES), FEATURE_LIST, ["fund_code"])).cache()
    try:
        return spark.createDataFrame([(k, score) for k, score, _ in cl.candidates(kept, kept.count(), ClassificationConfig())], "k int, silhouette double")
    finally:
        kept.unpersist()


# --- stress --------------------------------------------------------------------------------------

DAILY = f"{U}, {F_SQL}, dl AS (SELECT *, flow_unit AS flow, flow_unit / nullif(prev_aum, 0) AS flow_pct, coalesce(units = prev_units, false) AND coalesce(holders = prev_holders, false) AS still, coalesce(price <> prev_price, true) AS price_moved FROM f WHERE date IS NOT NULL)"
DAILY = DAILY.replace("FROM p WINDOW", "FROM (SELECT * FROM p WHERE NOT (coalesce(price <= 0, false) OR coalesce(units < 1, false))) WINDOW")
INDEX = """dy AS (SELECT date, count(*) AS funds, avg(CASE WHEN fund_return <= -0.5 THEN 1 ELSE 0 END) AS price_drop_share, avg(CASE WHEN flow_pct <= -0.5 THEN 1 ELSE 0 END) AS outflow_share FROM dl WHERE prev_aum >= 0.01 GROUP BY date),
zz AS (SELECT *, CASE WHEN count(*) OVER w >= 10 THEN (price_drop_share - median(price_drop_share) OVER w) / greatest(mad(price_drop_share) OVER w * 1.4826, 0.005) END AS price_z,
  CASE WHEN count(*) OVER w >= 10 THEN (outflow_share - median(outflow_share) OVER w) / greatest(mad(outflow_share) OVER w * 1.4826, 0.005) END AS outflow_z FROM dy WINDOW w AS (ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
za AS (SELECT *, max(outflow_z) OVER (ORDER BY date ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS outflow_z_ahead FROM zz), ix AS (SELECT *, CASE WHEN price_z IS NOT NULL AND outflow_z_ahead IS NOT NULL THEN least(price_z, outflow_z_ahead) END AS stress FROM za)"""
Z = ("price_drop_share", "outflow_share", "price_z", "outflow_z", "outflow_z_ahead", "stress")


@query(f"WITH {DAILY} SELECT fund_code, date, round(flow, 6) AS flow, round(flow_pct, 6) AS flow_pct, still, price_moved FROM dl")
def daily_panel(spark: SparkSession, d: str) -> DataFrame:
    return stress.daily(user_day(spark, d)).select("fund_code", "date", *r("flow", "flow_pct"), "still", "price_moved")


@query(f"WITH {DAILY}, {INDEX} SELECT date, funds, {rs(*Z)} FROM ix")
def stress_index(spark: SparkSession, d: str) -> DataFrame:
    return stress.stress_index(stress.daily(user_day(spark, d)), STRESS).select("date", "funds", *r(*Z))


EVENT = f"""wi AS (SELECT * FROM ix WHERE date BETWEEN DATE '{START}' AND DATE '{END}'), ru AS (SELECT date, stress FROM wi WHERE stress IS NOT NULL ORDER BY stress DESC, date LIMIT 1), sh AS (SELECT date, price_z FROM wi WHERE price_z IS NOT NULL ORDER BY price_z DESC, date LIMIT 1),
ev AS (SELECT date AS event_date, 'run' AS event_kind FROM ru WHERE stress >= 1.0 UNION ALL SELECT date, 'shock' FROM sh WHERE price_z >= 1.0 AND NOT EXISTS (SELECT 1 FROM ru WHERE stress >= 1.0))"""


def _signals(spark: SparkSession, d: str) -> stress.Stress:
    return stress.stress_signals(user_day(spark, d), START, END, config=STRESS)


@query(f"WITH {DAILY.replace('FROM p WHERE NOT', f'FROM p WHERE date <= DATE {chr(39)}{END}{chr(39)} AND NOT')}, {INDEX}, {EVENT} SELECT * FROM ev")
def stress_event(spark: SparkSession, d: str) -> DataFrame:
    return _signals(spark, d).event


FREEZE = """rn AS (SELECT *, row_number() OVER (PARTITION BY fund_code ORDER BY date) AS i, max(date) OVER () AS last_day FROM dl), isl AS (SELECT *, i - row_number() OVER (PARTITION BY fund_code, still ORDER BY date) AS island FROM rn),
sp AS (SELECT fund_code, island, count(*) AS frozen_days, min(i) AS first_i, min(date) AS frozen_since, max(date) AS frozen_until, avg(CASE WHEN price_moved THEN 1 ELSE 0 END) AS moved, max(last_day) AS last_day FROM isl WHERE still GROUP BY 1, 2),
lo AS (SELECT * FROM sp QUALIFY row_number() OVER (PARTITION BY fund_code ORDER BY frozen_days DESC, frozen_since) = 1),
hi AS (SELECT rn.fund_code, count(*) AS history, avg(CASE WHEN still THEN 0 ELSE 1 END) AS activity FROM rn JOIN lo ON lo.fund_code = rn.fund_code AND rn.i > 1 AND rn.i < lo.first_i GROUP BY 1),
fz AS (SELECT lo.fund_code, frozen_since, frozen_until, CAST(frozen_days AS INTEGER) AS frozen_days, frozen_until = last_day AS frozen_ongoing FROM lo JOIN hi USING (fund_code) WHERE frozen_days >= 2 AND history >= 3 AND activity >= 0.3 AND moved >= 0.5)"""


@query(f"WITH {DAILY}, {FREEZE} SELECT * FROM fz")
def freezes(spark: SparkSession, d: str) -> DataFrame:
    return stress.freezes(stress.daily(user_day(spark, d)), STRESS)


FLOWS = f"""wd AS (SELECT * FROM dl WHERE date BETWEEN DATE '{START}' AND DATE '{END}'), bd AS (SELECT DATE '2024-01-20' AS event_date, min(date) AS first_day, max(date) FILTER (WHERE date < DATE '2024-01-20') AS base_day FROM wd),
ef0 AS (SELECT fund_code, sum(flow) FILTER (WHERE date < event_date AND date > first_day) / nullif(max(aum) FILTER (WHERE date = first_day), 0) AS flow_before, sum(flow) FILTER (WHERE date >= event_date) / nullif(max(aum) FILTER (WHERE date = base_day), 0) AS flow_after FROM wd, bd GROUP BY 1),
ef AS (SELECT *, coalesce(flow_before >= 0.2, false) AND coalesce(flow_after <= -0.2, false) AS turned FROM ef0)"""


def _manual(spark: SparkSession, d: str) -> stress.Stress:
    return stress.stress_signals(user_day(spark, d), START, END, "2024-01-20", STRESS)


@query(f"WITH {DAILY}, {FLOWS} SELECT fund_code, round(flow_before, 6) AS flow_before, round(flow_after, 6) AS flow_after, turned FROM ef")
def event_flows(spark: SparkSession, d: str) -> DataFrame:
    return _manual(spark, d).funds.select("fund_code", *r("flow_before", "flow_after"), "turned")


@query(f"""WITH {DAILY.replace('FROM p WHERE NOT', f'FROM p WHERE date <= DATE {chr(39)}{END}{chr(39)} AND NOT')}, {FREEZE}, {FLOWS}, fu AS (SELECT fund_code, regexp_extract(arg_min(fund_name, date), '^(.*?PORTFÖY)', 1) AS founder, arg_min(aum, date) AS start_aum FROM wd GROUP BY 1),
un AS (SELECT DISTINCT fund_code FROM p WHERE date BETWEEN DATE '{START}' AND DATE '{END}' AND (coalesce(price <= 0, false) OR coalesce(units < 1, false))),
al AS (SELECT fu.*, fz.fund_code IS NOT NULL AS frozen, un.fund_code IS NOT NULL AS unpublished, coalesce(ef.turned, false) AS turned FROM fu LEFT JOIN (SELECT * FROM fz WHERE frozen_since <= DATE '{END}' AND frozen_until >= DATE '{START}') fz USING (fund_code) LEFT JOIN un USING (fund_code) LEFT JOIN ef USING (fund_code)),
aft AS (SELECT founder, sum(flow) FILTER (WHERE date >= event_date) / nullif(sum(aum) FILTER (WHERE date = base_day), 0) AS flow_after FROM wd JOIN fu USING (fund_code), bd GROUP BY 1)
SELECT al.founder, count(*) AS funds, round(sum(start_aum), 4) AS start_aum, count(*) FILTER (WHERE frozen) AS frozen, count(*) FILTER (WHERE unpublished) AS unpublished, count(*) FILTER (WHERE turned) AS turned, round(coalesce(sum(start_aum) FILTER (WHERE frozen OR unpublished), 0), 4) AS stressed_aum,
  round(coalesce(sum(start_aum) FILTER (WHERE frozen OR unpublished), 0) / nullif(sum(start_aum), 0), 4) AS stressed_aum_share, round(max(flow_after), 4) AS flow_after FROM al LEFT JOIN aft USING (founder) GROUP BY al.founder""")
def founder_summary(spark: SparkSession, d: str) -> DataFrame:
    return _manual(spark, d).founders.select("founder", "funds", *r("start_aum", "stressed_aum", "stressed_aum_share", "flow_after", digits=4), "frozen", "unpublished", "turned")


# --- scalar functions ----------------------------------------------------------------------------


FOUNDER_SQL = r"""WITH t AS (SELECT DISTINCT fonunvan AS name, trim(fonunvan) AS t FROM general),
x AS (SELECT *, regexp_extract(t, '^(.*?(?:^|[^\p{L}\p{N}_])PORTFÖY)(?:$|[^\p{L}\p{N}_])', 1) AS a, regexp_extract(t, '^(.*?(?:^|[^\p{L}\p{N}_])PYŞ)(?:$|[^\p{L}\p{N}_])', 1) AS b, regexp_extract(t, '^(.*?)[\s\p{Z}]+A\.Ş\.', 0) AS c0, regexp_extract(t, '^(.*?)[\s\p{Z}]+A\.Ş\.', 1) AS c FROM t),
y AS (SELECT *, coalesce(nullif(length(a), 0), 1000000) AS la, coalesce(nullif(length(b), 0), 1000000) AS lb, coalesce(nullif(length(c0), 0), 1000000) AS lc FROM x)
SELECT name, CASE WHEN name IS NULL THEN NULL WHEN la < 1000000 AND la <= lb AND la <= lc THEN a WHEN lb < 1000000 AND lb <= lc THEN b WHEN lc < 1000000 THEN c ELSE split_part(t, ' ', 1) END AS founder FROM y"""


@query(FOUNDER_SQL)
def founder_extract(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "general").select(F.col("fonunvan").alias("name")).distinct().select("name", labels.founder(F.col("name")).alias("founder"))


@query("SELECT name, slug FROM eylul_2026_fon_krizi")
def slugify(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eylul_2026_fon_krizi").select("name", labels.slug(F.col("name")).alias("slug"))


@query(f"WITH {DIM}, {W} SELECT code, name_en, broad_group, count(*) AS n FROM a JOIN dim USING (code) GROUP BY ALL")
def label_lookup(spark: SparkSession, d: str) -> DataFrame:
    dim = F.broadcast(instruments(spark).select("code", "name_en", "broad_group"))
    return supplier_weights(spark, d).join(dim, "code").groupBy("code", "name_en", "broad_group").agg(F.count("*").alias("n"))


BARE = "translate(t, ' ' || chr(9) || chr(13) || chr(10) || chr(160) || '%', '')"
BARE_NUMBER = f"try_cast(CASE WHEN contains({BARE}, ',') AND contains({BARE}, '.') THEN CASE WHEN strpos(reverse({BARE}), ',') < strpos(reverse({BARE}), '.') THEN replace(replace({BARE}, '.', ''), ',', '.') ELSE replace({BARE}, ',', '') END ELSE replace({BARE}, ',', '.') END AS DOUBLE)"


@query(" UNION ALL ".join(f"SELECT {k} AS file, fonkodu, code, {BARE_NUMBER} AS weight FROM (SELECT fonkodu, COLUMNS(* EXCLUDE (fonkodu, fonunvan, tarih))::VARCHAR FROM allocation_h{k}) UNPIVOT INCLUDE NULLS (t FOR code IN (COLUMNS(* EXCLUDE (fonkodu))))" for k in (1, 2, 3, 4)))
def weight_text(spark: SparkSession, d: str) -> DataFrame:
    """Every weight of the four tables, written as a number or as text."""
    from functools import reduce

    from terazi.operators.drift import number_of

    def cells(k: int) -> DataFrame:
        t = table(spark, d, f"allocation_h{k}")
        codes = [c for c in t.columns if c.lower() not in ("fonkodu", "fonunvan", "tarih")]
        return t.select(F.lit(k).alias("file"), "fonkodu", F.explode(F.array(*(F.struct(F.lit(c).alias("code"), F.col(f"`{c}`").cast("string").alias("t")) for c in codes))).alias("x")).select("file", "fonkodu", "x.code", number_of(F.col("x.t")).alias("weight"))

    return reduce(DataFrame.unionByName, (cells(k) for k in (1, 2, 3, 4)))
