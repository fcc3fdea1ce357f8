"""Decomposition, labels, DNA, universe, windows: cases known by construction."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from terazi.config import ClassificationConfig, LensConfig, intervals
from terazi.functions import labels
from terazi.operators import dna, lens, panel
from terazi.reports.text import money, number, percent, translate

SCHEMA = "fund_code string, fund_name string, date date, price double, units double, holders bigint, aum double"
DAY = dt.date(2026, 1, 1)


def fund(code, prices, units, holders=None, name="X PORTFÖY FON", start=DAY):
    return [(code, name, start + dt.timedelta(days=i), float(p), float(u), (holders or [10] * len(prices))[i], float(p * u)) for i, (p, u) in enumerate(zip(prices, units, strict=True))]


def weights(rows, **w):
    return [(r[0], r[2], c, float(x)) for r in rows for c, x in w.items()]


def frames(spark, rows, alloc):
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(alloc, "fund_code string, date date, code string, weight double")


def totals(spark, prices, units, n=2):
    return panel.window_totals(panel.flow_features(spark.createDataFrame(fund("AAA", prices, units), SCHEMA)), n).first()


@pytest.mark.parametrize(("prices", "units", "change", "market", "flow"), [([1, 1.05, 1.10], [1000] * 3, 0.10, 0.10, 0.0), ([1, 1, 1], [1000, 1050, 1100], 0.10, 0.0, 0.10), ([1, 1.05, 1.10], [1000, 1050, 1100], 0.21, None, None)])
def test_decomposition(spark, prices, units, change, market, flow):
    r = totals(spark, prices, units)
    assert r.aum_change_pct == pytest.approx(change)
    assert r.market_effect + r.net_flow == pytest.approx(r.aum_change)
    if market is not None:
        assert r.market_effect_pct == pytest.approx(market) and r.flow_pct == pytest.approx(flow)


def test_too_long_lookback_gives_no_row(spark):
    assert totals(spark, [1, 1, 1], [1, 1, 1], 120) is None
    with pytest.raises(ValueError):
        intervals("7w")
    assert intervals("3m") == 60 and intervals(5) == 5


def test_zero_values_divide_to_null(spark):
    rows = panel.flow_features(spark.createDataFrame(fund("A", [0, 1, 2], [0, 10, 10]), SCHEMA)).orderBy("date").collect()
    assert rows[1].fund_return is None and rows[1].flow_unit_pct is None and rows[2].fund_return == pytest.approx(1.0)


def test_unpublished_rows(spark):
    rows = fund("HALT", [1] * 6 + [0] * 4, [1000] * 6 + [0] * 4) + fund("LIVE", [1] * 10, [1000] * 10) + fund("DONE", [55] * 8 + [1] * 2, [100] * 8 + [0.01] * 2) + [("NUL", None, DAY, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [r.fund_code for r in panel.unpublished_funds(df).collect()] == ["DONE", "HALT"]
    assert panel.published(df).count() == 6 + 10 + 8 + 1


def test_windows_in_time(spark):
    df = spark.createDataFrame(fund("A", [1 + i / 100 for i in range(10)], [1000] * 10), SCHEMA)
    w = panel.date_window(df, "2026-01-03", "2026-01-07")
    assert panel.window_intervals(w) == 4
    assert panel.window_totals(panel.flow_features(w), 4).first().cumulative_return == pytest.approx(1.06 / 1.02 - 1)
    for a, b in (("2026-02-01", "2026-01-01"), ("2026-01-01", "2026-01-01")):
        with pytest.raises(ValueError):
            panel.window_intervals(panel.date_window(df, a, b))


def label(spark, f, *values):
    cols = [F.lit(v).cast("double") for v in values]
    return spark.range(1).select(f(*cols)).first()[0]


@pytest.mark.parametrize(("x", "size", "way"), [(0.0005, "Small", "Neutral"), (0.00049, "Neutral / negligible", "Neutral"), (-0.0025, "Moderate", "Negative"), (0.01, "Strong", "Positive"), (None, "Unknown", "Unknown")])
def test_edges(spark, x, size, way):
    assert label(spark, labels.magnitude, x) == size and label(spark, labels.direction, x) == way


def test_composed_labels(spark):
    assert label(spark, labels.quadrant, -0.1, 0.4) == "Negative Market / Positive Flow"
    assert label(spark, labels.quadrant, None, 0.4) == "Unknown Market / Unknown Flow"
    assert label(spark, labels.flow_regime, 0.005, 3) == "Moderate net inflow with participant growth"
    assert label(spark, labels.flow_regime, -0.5, None) == "Strong net outflow with stable participant count"
    assert label(spark, labels.flow_regime, 0.0, -1) == "Neutral flow with participant decline"
    assert label(spark, labels.flow_regime, None, 1) == "Unknown flow regime"
    assert label(spark, labels.aum_segment, 1e8) == "Mid AUM" and label(spark, labels.intensity, -0.3) == "Extreme"


def test_founder_and_slug(spark):
    names = ["TERA PORTFÖY BİRİNCİ FON", "İŞ PORTFÖY YÖNETİMİ A.Ş. FON", "AZİMUT PYŞ İKİNCİ FON", "HDI FİBA EMEKLİLİK VE HAYAT A.Ş. FON", "TEK KELİME", "", None]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(labels.founder(F.col("n"))).collect()]
    assert got == ["TERA PORTFÖY", "İŞ PORTFÖY", "AZİMUT PYŞ", "HDI FİBA EMEKLİLİK VE HAYAT", "TEK", "", None]
    assert spark.range(1).select(labels.slug(F.lit("Şavkınay Portföy (İÇ)"))).first()[0] == "savkinay-portfoy-ic"


@pytest.mark.parametrize(
    ("alloc", "want"),
    [({"km": 55, "dt": 45}, "Gold / Precious Metals Fund"), ({"eut": 60, "hs": 40}, "FX / Eurobond Fixed-Income Fund"), ({"yhs": 70, "dt": 30}, "Foreign Equity Fund"), ({"hs": 90, "bpp": 10}, "Domestic Equity Fund"), ({"bpp": 80}, "Money Market Fund"),
     ({"dt": 70, "hs": 20, "bpp": 10}, "Domestic Fixed-Income Dominant Multi-Asset Fund"), ({"dt": 95}, "Domestic Fixed-Income Fund"), ({"hs": 40, "dt": 35, "bpp": 25}, "Multi-Asset / Mixed Allocation Fund"), ({"yyf": 80, "hs": 20}, "Fund Allocation Dominant Fund"), ({"kkstl": 60, "hs": 40}, "Lease Certificates Dominant Fund"), ({"zz": 50}, None)],
)
def test_archetypes(spark, alloc, want):
    a = spark.createDataFrame([("A", DAY, c, float(w)) for c, w in alloc.items()], "fund_code string, date date, code string, weight double")
    got = dna.archetypes(dna.latest_allocation(a)).first()
    assert (got and got.archetype) == want


def test_totals_agree_across_groupings(spark):
    a = spark.createDataFrame([("A", DAY, c, w) for c, w in (("hs", 40.0), ("eut", 35.5), ("km", 30.0), ("r", -5.5))], "fund_code string, date date, code string, weight double")
    for g in ("broad", "scope", "currency", "asset"):
        assert dna.group_weights(a, g).agg(F.sum("weight")).first()[0] == pytest.approx(100.0)
    cols = dna.group_columns(a, "broad").first().asDict()
    assert cols["dna_broad_equity"] == 40.0 and cols["dna_broad_deposit"] == 0.0


def test_universe(spark):
    rows = fund("OLD", [1, 0.95, 0.90], [2e6, 2.4e6, 2.8e6], [10, 11, 12]) + fund("NEW", [1, 1], [5e6, 5e6], start=DAY + dt.timedelta(days=1)) + fund("TINY", [1, 1.1, 1.2], [10, 10, 10])
    p, a = frames(spark, rows, weights(rows[:2], dt=100) + weights(rows[2:3], hs=100) + weights(rows[3:], hs=100))
    u = {r.fund_code: r for r in lens.universe(p, a, LensConfig(lookback=2)).collect()}
    assert set(u) == {"OLD", "TINY"}
    assert u["OLD"].market_flow_quadrant == "Negative Market / Positive Flow" and u["OLD"].archetype == "Domestic Equity Fund" and u["OLD"].is_valid and not u["TINY"].is_valid
    s = lens.summary_by(lens.universe(p, a, LensConfig(lookback=2)), "archetype").collect()
    assert sum(r.start_aum_share for r in s) == pytest.approx(1.0)


def test_formats_and_translations():
    assert percent(0.1234, "tr") == "%12,34" and percent(-0.05, "tr") == "-%5,00" and money(2.71e9, "tr") == "2,71 milyar TL" and number(1968, 0, "tr") == "1.968" and number(None) == "-"
    assert translate("Negative Market / Positive Flow", "tr") == "Piyasa Negatif, Akım Pozitif"
    assert translate("Multi-Asset (Fixed Income / Money Market / Collateral)", "tr") == "Karma (Borçlanma / Para Piyasası / Teminat)"
    assert translate("Equity Weighted", "tr") == "Hisse Çoğunlukta" and translate("x", "en") == "x"


@pytest.mark.parametrize("bad", [{"feature_space": "x"}, {"transform": "x"}, {"risk_band_method": "x"}, {"k_range": (5, 4)}, {"k": 1}, {"sub_window_count": 0}, {"primary_threshold": 70.0}, {"risk_band_edges": (3.0, 2.0, 1.0)}])
def test_config_validation(bad):
    with pytest.raises(ValueError):
        ClassificationConfig(**bad)
