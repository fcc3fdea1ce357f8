"""Results side by side: windows, classes and signals on the universe, selections."""

import datetime as dt

import pytest

from terazi.config import ClassificationConfig, LensConfig
from terazi.operators import combine as co
from terazi.operators.allocation import drift, risk_edges
from terazi.operators.stress import daily

PANEL = "fund_code string, fund_name string, date date, price double, units double, holders bigint, aum double"
ALLOC = "fund_code string, date date, code string, weight double"


def panel(spark, days=8, skip=()):
    rows = []
    for f in "ABC":
        for k in range(days):
            if (f, k) not in skip:
                rows.append((f, f"İŞ {f}", dt.date(2026, 1, 5) + dt.timedelta(days=k), 1.0 + k / 10, 1e7 + k, 100 + k, (1.0 + k / 10) * (1e7 + k)))
    rows.append(("D", "HİÇ", dt.date(2026, 1, 6), 0.0, 0.0, 1, 0.0))
    return spark.createDataFrame(rows, PANEL)


def allocation(spark, days=8):
    return spark.createDataFrame([(f, dt.date(2026, 1, 5) + dt.timedelta(days=k), "hs", 100.0) for f in "ABC" for k in range(days)], ALLOC)


def test_window_between_dates(spark):
    a, b = dt.date(2026, 1, 6), dt.date(2026, 1, 9)
    got = {r.fund_code: r for r in co.universe_window(panel(spark, skip=(("C", 2),)), allocation(spark), a, b, LensConfig()).collect()}
    assert set(got) == {"A", "B"}  # C lacks a day of the window
    assert got["A"].start_date == a and got["A"].end_date == b and got["A"].cumulative_return == pytest.approx(1.4 / 1.1 - 1)
    assert {r.fund_code for r in co.universe_window(panel(spark), allocation(spark), None, None).collect()} == {"A", "B", "C"}
    assert set(r.fund_code for r in co.universe_window(panel(spark), allocation(spark), a, b, include_unpublished=True).collect()) == {"A", "B", "C"}
    with pytest.raises(ValueError, match="after end"):
        co.universe_window(panel(spark), allocation(spark), b, a)
    with pytest.raises(ValueError, match="holds 1 published"):
        co.universe_window(panel(spark), allocation(spark), a, a)


def test_joins_keep_the_left(spark):
    lens = spark.createDataFrame([("A", 1.0), ("B", 2.0)], "fund_code string, confidence double")
    classes = spark.createDataFrame([("A", 7.0, "x"), ("Z", 1.0, "y")], "fund_code string, confidence double, class_name string")
    assert sorted(map(tuple, co.with_classes(lens, classes).collect())) == [("A", 1.0, "x"), ("B", 2.0, None)]
    known = spark.createDataFrame([("A", 3, "x")], "fund_code string, class_id int, class_name string")
    assert sorted(map(tuple, co.ordered(co.all_funds(known, lens)).collect())) == [("A", 3, "x", True), ("B", -1, None, False)]
    assert co.ordered(known.select("class_name", "class_id", "fund_code")).columns == ["fund_code", "class_id", "class_name"]


def test_selections(spark):
    lens = spark.createDataFrame([("AB1", "Işık Fonu", "Negative Market / Positive Flow"), ("XYZ", None, "Positive Market / Neutral Flow")], "fund_code string, fund_name string, market_flow_quadrant string")
    assert [r.fund_code for r in co.search(lens, " ışık").collect()] == ["AB1"] and co.search(lens, "xy").count() == 1 and co.search(lens, " ").count() == 2
    assert [r.fund_code for r in co.moving(lens, market="Negative").collect()] == ["AB1"] and co.moving(lens, "Positive", "Positive").count() == 0
    ties = spark.createDataFrame([("g", "b"), ("g", "a"), ("g", None), ("g", None), ("h", None)], "g string, v string")
    assert list(map(tuple, co.most_frequent(ties, "g", "v").collect())) == [("g", "a")]
    low = spark.createDataFrame([("x", 0.1), ("x", 0.9), (None, 0.0)], "class_name string, confidence double")
    assert list(map(tuple, co.low_confidence(low, ClassificationConfig(low_confidence_threshold=0.5)).collect())) == [("x", 2, 1)]
    wide = spark.createDataFrame([(float(i), None) for i in range(101)] + [(float("nan"), 1.0)], "a double, b double")
    got = {r.field: (r.low, r.high) for r in co.axis_limits(wide, ("a", "b")).collect()}
    assert got["a"] == pytest.approx((1 - 9.8, 99 + 9.8)) and got["b"] == (1.0, 1.0)


def test_last_row_of_a_day_counts(spark):
    """Repeats of a day make no still rows: the row loaded last is the day's."""
    d = [dt.date(2026, 1, 5) + dt.timedelta(days=k) for k in range(3)]
    rows = [("A", "T", d[0], 1.0, 10.0, 1, 10.0, 1), ("A", "T", d[1], 1.0, 12.0, 2, 12.0, 2), ("A", "T", d[1], 1.0, 15.0, 3, 15.0, 3), ("A", "T", d[1], 1.0, 11.0, 2, 11.0, 1), ("A", "T", d[2], 1.0, 15.0, 4, 15.0, 4)]
    got = daily(spark.createDataFrame(rows, PANEL + ", loaded int")).orderBy("date").collect()
    assert [(r.units, r.still) for r in got] == [(10.0, False), (15.0, False), (15.0, False)]


def test_drift_and_edges(spark):
    v = [("A", s, f, x) for s, w in enumerate(({"e": 100.0}, {"e": 50.0, "m": 50.0}, {"m": 100.0})) for f, x in w.items()] + [("B", 0, "e", 100.0), ("C", 1, "e", 0.0), ("C", 2, "e", 9.0)]
    got = {r.fund_code: (r.allocation_volatility, r.style_drift) for r in drift(spark.createDataFrame(v, "fund_code string, slice int, feature string, value double")).collect()}
    assert got == {"A": (100.0, 200.0), "B": (None, None), "C": (None, None)}
    same = spark.createDataFrame([(x,) for x in [0.0] * 9 + [1.0, 2.0, 3.0]], "growth_asset_weight double")
    edges = risk_edges(same, ClassificationConfig(risk_band_method="quantile"))
    assert edges == sorted(set(edges)) and edges[0] == 0.0
    spread = spark.createDataFrame([(float(x + n),) for x in (0, 30, 60, 90) for n in range(5)], "growth_asset_weight double")
    assert risk_edges(spread, ClassificationConfig(risk_band_method="kmeans1d", n_init=5)) == pytest.approx([17.0, 47.0, 77.0])
