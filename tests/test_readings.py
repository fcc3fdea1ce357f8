"""Problems 1, 3 and 7 on small tables, against brute force."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terazi.operators.faults import FaultRules, faults_of, find_faults
from terazi.operators.grid import TrendModel, missing_days, smooth, to_grid
from terazi.operators.rolling import trailing
from terazi.operators.series import reading_rows, split_hot

SCHEMA = "kayit_no bigint, fonkodu string, fonunvan string, tarih timestamp, fiyat double, tedpaysayisi double, kisisayisi bigint, portfoybuyukluk double, borsabultenfiyat double, yukleme timestamp"


def rows_of(seed=1, funds=("AAA", "BBB"), days=80, hot=None):
    """Random walks with gaps; ``hot`` gets several readings a day."""
    rng = np.random.default_rng(seed)
    out, k = [], 0
    for f in funds:
        p = 10.0
        for d in range(days):
            for _ in range(6 if f == hot else 1):
                if rng.random() < 0.2:
                    continue
                p *= math.exp(rng.normal(0, 0.01))
                at = dt.datetime(2025, 1, 1) + dt.timedelta(days=d, seconds=int(rng.integers(0, 86400)))
                k += 1
                out.append((k, f, "T", at, p, 1000.0 + k, 5, p * (1000 + k), None, at + dt.timedelta(minutes=5)))
    return out


def general(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def holidays(spark, *days):
    return spark.createDataFrame([(d,) for d in days], "tatil date")


def dense_smoother(t, y, g, m):
    """Generalised least squares with the covariance of the whole path; no recursion."""
    ok = ~np.isnan(y)
    t, y = t[ok], y[ok]
    t0 = t[0]
    a, b = np.meshgrid(np.r_[t, g] - t0, np.r_[t, g] - t0)
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    k = m.prior_level + m.prior_slope * a * b + m.level_var * lo + m.slope_var * (lo**2 * hi / 2 - lo**3 / 6)
    n = len(t)
    kyy = k[:n, :n] + m.obs_var * np.eye(n)
    w = np.linalg.solve(kyy, k[:n, n:])
    return y[0] + w.T @ (y - y[0]), np.diag(k[n:, n:] - k[n:, :n] @ w)


def test_smoother_equals_the_dense_solution():
    rng = np.random.default_rng(3)
    m = TrendModel(level_var=1.0, slope_var=0.01, obs_var=0.3, prior_level=100.0, prior_slope=1.0)
    t = np.sort(rng.uniform(0, 60, 50))
    y = np.cumsum(rng.normal(0, 1, 50))
    y[7] = np.nan
    g = np.arange(1.0, 61.0)
    g = g[g > t[0]]
    level, var, _ = smooth(t, y, g, m)
    want, wvar = dense_smoother(t, y, g, m)
    assert np.allclose(level, want, atol=1e-6)
    assert np.allclose(var, wvar, atol=1e-5)


def test_blocks_of_a_hot_source_give_the_same_grid(spark):
    df = general(spark, rows_of(hot="BBB"))
    h = holidays(spark, dt.date(2025, 1, 6))
    one = {(r.fonkodu, r.gun): r for r in to_grid(df, h).collect()}
    cut = {(r.fonkodu, r.gun): r for r in to_grid(df, h, block_rows=60).collect()}
    assert one.keys() == cut.keys() and len(one) > 100
    for k, a in one.items():
        assert (a.okuma, a.eksik) == (cut[k].okuma, cut[k].eksik)
        assert a.deger == pytest.approx(cut[k].deger, rel=1e-9)
        assert a.sapma == pytest.approx(cut[k].sapma, rel=1e-6)
    assert not any(g == "2025-01-06" for _, g in one)


def test_grid_edge_cases(spark):
    day = dt.datetime(2025, 1, 2, 10)
    step = dt.timedelta(days=1)
    rows = [
        (1, " aaa", None, day, 1.0, 1.0, 1, 1.0, None, day),
        (1, " aaa", None, day, 1.0, 1.0, 1, 1.0, None, day),
        (2, "AAA", None, day + 5 * step, None, 2.0, 1, 1.0, None, day),
        (3, "AAA", None, day + 4 * step, 0.0, 0.0, 1, 0.0, None, day),
        (4, None, None, day, 1.0, 1.0, 1, 1.0, None, day),
        (5, "AAA", None, None, 1.0, 1.0, 1, 1.0, None, day),
        (6, "NUL", None, day, None, float("nan"), None, None, None, None),
        (7, "NUL", None, day + step, -1.0, None, None, None, None, None),
    ]
    df = general(spark, rows)
    got = {(r.fonkodu, r.gun): r for r in to_grid(df, holidays(spark)).collect()}
    assert {k for k, r in got.items() if r.eksik} == {("AAA", "2025-01-03"), ("AAA", "2025-01-06")}
    assert got["AAA", "2025-01-02"].okuma == 1 and got["AAA", "2025-01-02"].deger == pytest.approx(1.0)
    assert got["NUL", "2025-01-02"].deger is None and not got["NUL", "2025-01-02"].eksik
    assert missing_days(to_grid(general(spark, []), holidays(spark))).count() == 0
    assert to_grid(df.selectExpr("*", "1 as fund", "2 as t", "'x' as day", "3 as v"), holidays(spark)).count() == len(got)


def test_trailing_against_brute_force(spark):
    rows = rows_of(seed=5, hot="BBB", days=50)
    df = general(spark, rows).selectExpr("*", "1 as day", "2 as total")
    daily = {}
    for r in sorted(rows, key=lambda r: r[3]):
        daily[r[1], r[3].date()] = r[7]
    got = {(r.fonkodu, r.gun): r for r in trailing(df, windows=(7, 30, 1, 12)).collect()}
    for f in ("AAA", "BBB"):
        days = sorted(d for g, d in daily if g == f)
        assert len([1 for g, _ in got if g == f]) == (days[-1] - days[0]).days + 1
    for (f, d), r in got.items():
        for n in (7, 30, 1, 12):
            own = [daily.get((f, d - dt.timedelta(days=i))) for i in range(n)]
            known = [x for x in own if x is not None]
            assert r[f"toplam_{n}"] == pytest.approx(sum(round(x, 2) for x in known), abs=0.01)
            assert r[f"okuma_{n}"] == len(known)
    assert trailing(general(spark, [])).count() == 0


def test_faults_of_a_series():
    rng = np.random.default_rng(7)
    v = 10 * np.exp(np.cumsum(rng.normal(0, 0.01, 300)))
    v[50] *= 1.5
    v[100:102] *= 0.1
    v[150:] *= 1.4  # a lasting change of level
    v[200:208] = v[200]
    v[250] = 0.0
    v[260] = -1.0
    v[270] = np.nan
    kind, _ = faults_of(v, FaultRules())
    assert set(np.flatnonzero(kind == 2)) == {50, 100, 101}
    assert set(np.flatnonzero(kind == 3)) == set(range(201, 208))
    assert set(np.flatnonzero(kind == 1)) == {250, 260}


def test_constant_and_short_series_have_no_faults():
    for v in ([], [1.0], [1.0, 900.0], [5.0] * 40, [np.nan] * 9):
        assert not faults_of(np.array(v, dtype=float), FaultRules())[0].any()


def test_blocks_of_a_hot_source_give_the_same_faults(spark):
    rows = [list(r) for r in rows_of(seed=9, hot="BBB", days=120)]
    for i in range(20, len(rows), 61):
        rows[i][4] *= 1.7
    for i in range(40, len(rows), 173):
        for j in range(i, min(i + 9, len(rows))):
            rows[j][5] = rows[i][5]
    rows.append(rows[20])
    df = general(spark, [tuple(r) for r in rows])
    key = lambda d: sorted((r.kayit_no, r.field, r.kind) for r in d.collect())
    one = key(find_faults(df))
    assert len(one) > 15 and one == key(find_faults(df, block_rows=90))
    assert len(one) == len(set(one))
    assert find_faults(general(spark, [])).count() == 0


def test_hot_sources(spark):
    rows = reading_rows(general(spark, rows_of(funds=("AAA", "BBB", "CCC"), hot="BBB", days=40)))
    named, sent = split_hot(rows, 20), split_hot(rows, 20, named=1)
    key = lambda d: sorted(map(tuple, d.select("fund", "t").collect()))
    assert key(named.hot) == key(sent.hot) and named.cold.count() == sent.cold.count() == 0
    assert {r.fund for r in split_hot(rows, 100).hot.select("fund").distinct().collect()} == {"BBB"}
    # the list can't be longer than asked for: the limit becomes the total over its length
    short = split_hot(rows, 20, hot_list=2)
    assert {r.fund for r in short.hot.select("fund").distinct().collect()} == {"BBB"} and short.cold.count() + short.hot.count() == rows.count()


def test_bunched_readings_make_even_blocks(spark):
    """All but a few readings in one hour of ten years: blocks follow the rows, not the time; one moment stays in one block."""
    first, last = dt.datetime(2015, 1, 1), dt.datetime(2025, 1, 1)
    moments = [first, *(dt.datetime(2020, 1, 1) + dt.timedelta(seconds=i) for i in range(3000)), last]
    rows = [(i, "HOT", None, t, 1.0 + i, 1.0, 1, 1.0, None, t) for i, t in enumerate(moments)]
    rows += [(9000 + i, "HOT", None, moments[77], 5.0, 1.0, 1, 1.0, None, last) for i in range(40)]
    split = split_hot(reading_rows(general(spark, rows)), 400)
    sizes = [r["count"] for r in split.hot.groupBy("block").count().collect()]
    assert len(sizes) > 8 and max(sizes) < 800
    assert split.hot.groupBy("t").agg(F.countDistinct("block").alias("n")).filter("n > 1").count() == 0


def test_the_ellipsoid_decides(spark):
    """With an ellipsoid of no size every bump that returns would be a spike; with a huge one none is."""
    df = general(spark, [tuple(r[:4]) + (r[4] * (1.6 if i % 50 == 30 else 1.0),) + tuple(r[5:]) for i, r in enumerate(rows_of(seed=4, days=200))])
    n = [find_faults(df, FaultRules(reach=x)).filter("kind = 'spike'").count() for x in (0.0, 4.5, 1e6)]
    assert n[0] > 5 * n[1] and n[1] > 4 and n[2] == 0
