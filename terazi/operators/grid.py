"""Irregular readings onto a regular grid of business days (problem 1).

Model per source, in continuous time, on the logarithm of a positive field::

    d level = slope dt + sqrt(level_var) dW1      d slope = sqrt(slope_var) dW2
    y = level + noise(obs_var)                    all variances in units of sigma^2 per day

The smoothed level at the end of every business day is the filled value. The scale
sigma^2 of a source comes from its own standardised innovations (their median, so odd
readings don't inflate it). Smoothed means don't depend on it, only the uncertainty does.

A source that is too large for one task is cut into blocks. A first pass reduces each
block to its conditional element (A, b, C, eta, J), that is 14 numbers; composing the
elements gives the exact state before, and the exact information after, every block.
A second pass then smooths each block, with the same result as one pass over the source;
its squared innovations are counted in bins of a thousandth, as those of uncut sources are,
so the scale is the same too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terazi.operators.series import BLOCK_ROWS, DAY_MICROS, binned_median, bins_of, by_key, finite, groups, headed, latest_in, reading_rows, split_hot, with_heads
from terazi.session import cut, shuffle_partitions

#: Median of a chi-square variable with one degree of freedom (fixed value).
CHI2_MEDIAN = 0.4549364231195724


@dataclass(frozen=True)
class TrendModel:
    """Variances relative to sigma^2, per day; prior of level and slope at the first reading."""

    level_var: float = 1.0
    slope_var: float = 1e-4
    obs_var: float = 0.05
    prior_level: float = 1e6
    prior_slope: float = 1.0


OUT = "fund string, day int, value double, sd double, readings long, grid boolean"
#: Of a block: rows of days, or counts of squared innovations by bin.
PARTS = f"{OUT}, bin long, n long"
PARTS_COLUMNS = [x.split()[0] for x in PARTS.split(", ")]
#: Squared innovations below this are as good as none.
TINY = 1e-30


def business_days(first: int, last: int, holidays: np.ndarray) -> np.ndarray:
    """Days since 1970, Monday to Friday without ``holidays``, ends included."""
    days = np.arange(first, last + 1)
    days = days[(days + 3) % 7 < 5]
    return days[~np.isin(days, holidays)]


def smooth(t: np.ndarray, y: np.ndarray, grid: np.ndarray, m: TrendModel, start: tuple | None = None, start_at: float | None = None, end: tuple | None = None, end_at: float | None = None):
    """Smoothed level and its variance (without sigma^2) at ``grid``; sorted days, ``y`` may hold NaN.

    ``start``: m1, m2, p11, p12, p22 of the state at ``start_at``, before any reading here.
    ``end``: e1, e2, j11, j12, j22, the information of all later readings on the state at ``end_at``.
    Returns level, variance and the squared standardised innovations. NaN where no value is known at all.
    """
    ok = ~np.isnan(y)
    nan = np.full(len(grid), np.nan)
    if start is None:
        if not ok.any():
            return nan, nan, np.zeros(0)
        start = (float(y[ok][0]), 0.0, m.prior_level, 0.0, m.prior_slope)
    # events: readings (by value) and grid times (NaN), in time; a reading comes before a grid time
    times = np.concatenate([t[ok], grid])
    what = np.concatenate([y[ok], np.full(len(grid), np.nan)])
    order = np.argsort(times, kind="stable")
    te, ye = times[order].tolist(), what[order].tolist()
    if not te:
        return nan, nan, np.zeros(0)
    q1, q2, r = m.level_var, m.slope_var, m.obs_var
    m1, m2, p11, p12, p22 = start
    now = te[0] if start_at is None else start_at
    seen, white = [], []
    for at, v in zip(te, ye, strict=True):
        d = at - now
        if d:
            now = at
            m1 += d * m2
            p11 += d * (2 * p12 + d * p22) + q1 * d + q2 * d * d * d / 3
            p12 += d * p22 + q2 * d * d / 2
            p22 += q2 * d
        if v == v:
            s = p11 + r
            e = v - m1
            k1, k2 = p11 / s, p12 / s
            white.append(e * e / s)
            m1 += k1 * e
            m2 += k2 * e
            p22 -= k2 * p12
            p11 -= k1 * p11
            p12 -= k1 * p12
            seen.append(None)
        else:
            seen.append((m1, m2, p11, p12, p22))
    e1, e2, j11, j12, j22 = end or (0.0, 0.0, 0.0, 0.0, 0.0)
    level, var = [], []
    now = te[-1] if end_at is None else end_at
    for i in range(len(te) - 1, -1, -1):
        at, v = te[i], ye[i]
        d = now - at
        if d:
            now = at
            a, b, c = q1 * d + q2 * d * d * d / 3, q2 * d * d / 2, q2 * d
            # W = (I + J Q)^-1
            w11, w12, w21, w22 = 1 + j11 * a + j12 * b, j11 * b + j12 * c, j12 * a + j22 * b, 1 + j12 * b + j22 * c
            det = w11 * w22 - w12 * w21
            n1, n2 = (w22 * e1 - w12 * e2) / det, (w11 * e2 - w21 * e1) / det
            k11, k12, k22 = (w22 * j11 - w12 * j12) / det, (w22 * j12 - w12 * j22) / det, (w11 * j22 - w21 * j12) / det
            e1, e2 = n1, n2 + d * n1
            j11, j12, j22 = k11, k12 + d * k11, k22 + d * (2 * k12 + d * k11)
        if v == v:
            j11 += 1 / r
            e1 += v / r
        else:
            m1, m2, p11, p12, p22 = seen[i]
            # (I + P J)^-1 (m + P e)
            g11, g12, g21, g22 = 1 + p11 * j11 + p12 * j12, p11 * j12 + p12 * j22, p12 * j11 + p22 * j12, 1 + p12 * j12 + p22 * j22
            det = g11 * g22 - g12 * g21
            x1, x2 = m1 + p11 * e1 + p12 * e2, m2 + p12 * e1 + p22 * e2
            level.append((g22 * x1 - g12 * x2) / det)
            var.append((g22 * p11 - g12 * p12) / det)
    return np.array(level[::-1]), np.array(var[::-1]), np.array(white)


def element(t: np.ndarray, y: np.ndarray, m: TrendModel) -> tuple:
    """Conditional element of a block, from before its first to after its last reading.

    (a11 a12 a21 a22, b1 b2, c11 c12 c22, e1 e2, j11 j12 j22): given the state x at the start, the end is
    A x + b with covariance C; eta and J hold what the block says about x.
    """
    q1, q2, r = m.level_var, m.slope_var, m.obs_var
    a11, a12, a21, a22, b1, b2, c11, c12, c22 = 1.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0
    e1 = e2 = j11 = j12 = j22 = 0.0
    now = float(t[0])
    for at, v in zip(t.tolist(), y.tolist(), strict=True):
        d = at - now
        if d:
            now = at
            a11 += d * a21
            a12 += d * a22
            b1 += d * b2
            c11 += d * (2 * c12 + d * c22) + q1 * d + q2 * d * d * d / 3
            c12 += d * c22 + q2 * d * d / 2
            c22 += q2 * d
        if v == v:
            s = c11 + r
            e = v - b1
            e1 += a11 * e / s
            e2 += a12 * e / s
            j11 += a11 * a11 / s
            j12 += a11 * a12 / s
            j22 += a12 * a12 / s
            k1, k2 = c11 / s, c12 / s
            b1 += k1 * e
            b2 += k2 * e
            a21, a22 = a21 - k2 * a11, a22 - k2 * a12
            a11, a12 = a11 - k1 * a11, a12 - k1 * a12
            c22 -= k2 * c12
            c11, c12 = c11 - k1 * c11, c12 - k1 * c12
    return a11, a12, a21, a22, b1, b2, c11, c12, c22, e1, e2, j11, j12, j22


def _transition(d: float, m: TrendModel) -> tuple[np.ndarray, np.ndarray]:
    q = np.array([[m.level_var * d + m.slope_var * d**3 / 3, m.slope_var * d * d / 2], [m.slope_var * d * d / 2, m.slope_var * d]])
    return np.array([[1.0, d], [0.0, 1.0]]), q


def compose(blocks: pd.DataFrame, m: TrendModel) -> pd.DataFrame:
    """State before, and information after, each block of one source (rows sorted by block).

    In: block, t0, t1 (first and last reading, days), y0 (first value), e0..e13. Out: one row per block:
    block, next_t (start of the next block, else null), s0..s4 (state at t0), z0..z4 (information at next_t).
    """
    n = len(blocks)
    el = blocks[[f"e{i}" for i in range(14)]].to_numpy(dtype=float)
    t0, t1 = blocks["t0"].to_numpy(dtype=float), blocks["t1"].to_numpy(dtype=float)
    eye = np.eye(2)
    values = blocks["y0"].dropna()
    x, p = np.array([values.iloc[0] if len(values) else 0.0, 0.0]), np.diag([m.prior_level, m.prior_slope])
    before = []
    for i in range(n):
        if i:
            f, q = _transition(t0[i] - t1[i - 1], m)
            x, p = f @ x, f @ p @ f.T + q
        before.append((x[0], x[1], p[0, 0], p[0, 1], p[1, 1]))
        a, b, c = el[i, 0:4].reshape(2, 2), el[i, 4:6], np.array([[el[i, 6], el[i, 7]], [el[i, 7], el[i, 8]]])
        eta, j = el[i, 9:11], np.array([[el[i, 11], el[i, 12]], [el[i, 12], el[i, 13]]])
        g = np.linalg.inv(eye + p @ j)
        x, p = a @ (g @ (x + p @ eta)) + b, a @ (g @ p) @ a.T + c
    after: list[tuple] = [()] * n
    eta, j = np.zeros(2), np.zeros((2, 2))
    for i in range(n - 1, -1, -1):
        after[i] = (eta[0], eta[1], j[0, 0], j[0, 1], j[1, 1])
        if i < n - 1:
            f, q = _transition(t0[i + 1] - t1[i], m)
            w = np.linalg.inv(eye + j @ q)
            eta, j = f.T @ (w @ eta), f.T @ (w @ j) @ f
        a, b, c = el[i, 0:4].reshape(2, 2), el[i, 4:6], np.array([[el[i, 6], el[i, 7]], [el[i, 7], el[i, 8]]])
        w = np.linalg.inv(eye + j @ c)
        eta, j = a.T @ (w @ (eta - j @ b)) + el[i, 9:11], a.T @ (w @ j) @ a + np.array([[el[i, 11], el[i, 12]], [el[i, 12], el[i, 13]]])
    out = {"block": blocks["block"].to_numpy(), "next_t": [*t0[1:], math.nan]}
    out |= {f"s{k}": [x[k] for x in before] for k in range(5)} | {f"z{k}": [x[k] for x in after] for k in range(5)}
    return pd.DataFrame(out).assign(any_value=bool(len(values)))


def scale_of(bins: np.ndarray, counts: np.ndarray) -> float:
    """sigma^2 from the counted squared innovations; NaN for fewer than two."""
    return binned_median(bins, counts) / CHI2_MEDIAN if counts.sum() > 1 else math.nan


def _rows(fund: str, t: np.ndarray, grid: np.ndarray, level: np.ndarray, var: np.ndarray, scale: float = 1.0) -> pd.DataFrame:
    """One row per grid day, and one of each other day with readings (grid false)."""
    day, n = np.unique(t // DAY_MICROS, return_counts=True)
    days = np.union1d(day, grid)
    at = np.searchsorted(days, grid)
    value, sd, count = np.full(len(days), np.nan), np.full(len(days), np.nan), np.zeros(len(days), dtype=np.int64)
    count[np.searchsorted(days, day)] = n
    value[at] = np.exp(level)
    sd[at] = value[at] * np.sqrt(var * scale)
    return pd.DataFrame({"fund": fund, "day": days.astype(np.int32), "value": value, "sd": sd, "readings": count, "grid": np.isin(days, grid)})


def _arrays(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    v = pdf["v"].to_numpy(dtype=float)
    y = np.full(len(v), np.nan)
    y[v > 0] = np.log(v[v > 0])
    return pdf["t"].to_numpy(), y


def to_grid(general: DataFrame, holidays: DataFrame, field: str = "fiyat", model: TrendModel = TrendModel(), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per source and business day from its first to its last reading.

    Columns: fonkodu, gun (yyyy-MM-dd), deger (smoothed ``field`` at the end of the day), sapma (its
    standard deviation), okuma (readings of the day), eksik (true if there are none). Rows without
    source or moment are ignored; of the same moment the row loaded last counts; unpublished moments
    (all three values 0) are no reading. Null, NaN, zero and negative values are readings without a
    value. A source without any positive value has null deger; one with a single value null sapma.
    No rows for an empty table or a source whose readings span no business day.
    """
    spark = general.sparkSession
    off = np.array(sorted({r[0] for r in holidays.select(F.unix_date(F.col("tatil").cast("date"))).filter("tatil is not null").distinct().collect()}), dtype=np.int64)
    rows = reading_rows(general, finite(F.col(field)).alias("v"))
    parts = shuffle_partitions(spark)
    split = split_hot(rows, block_rows)

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, size = [], 0
        for (fund,), pdf in groups(batches, ["fund"]):
            t, y = _arrays(latest_in(pdf))
            if not len(t):
                continue
            grid = business_days(t[0] // DAY_MICROS, t[-1] // DAY_MICROS, off)
            level, var, white = smooth(t / DAY_MICROS, y, grid + 1.0, model)
            out.append(_rows(fund, t, grid, level, var, scale_of(*bins_of(np.maximum(white, TINY)))))
            size += len(out[-1])
            if size > 20_000:
                yield pd.concat(out)
                out, size = [], 0
        if out:
            yield pd.concat(out)

    order = ["t", "loaded", "row_id"]
    found = by_key(split.cold, ["fund"], order, parts).mapInPandas(whole, OUT)
    if split.hot is not None:
        found = found.unionByName(_hot(split.hot, model, off, parts))
    return found.filter("grid").select(
        F.col("fund").alias("fonkodu"),
        F.date_format(F.date_from_unix_date("day"), "yyyy-MM-dd").alias("gun"),
        F.when(~F.isnan("value"), F.col("value")).alias("deger"),
        F.when(~F.isnan("sd"), F.col("sd")).alias("sapma"),
        F.col("readings").alias("okuma"),
        (F.col("readings") == 0).alias("eksik"),
    )


def _hot(rows: DataFrame, model: TrendModel, off: np.ndarray, parts: int) -> DataFrame:
    numbers = [f"e{i}" for i in range(14)]
    keys, order = ["fund", "block"], ["t", "loaded", "row_id"]

    def elements(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (fund, block), pdf in groups(batches, keys):
            t, y = _arrays(latest_in(pdf))
            if len(t):
                first = y[~np.isnan(y)][:1]
                yield pd.DataFrame([(fund, block, t[0] / DAY_MICROS, t[-1] / DAY_MICROS, first[0] if len(first) else math.nan, *element(t / DAY_MICROS, y, model))], columns=["fund", "block", "t0", "t1", "y0", *numbers])

    def states(pdf: pd.DataFrame) -> pd.DataFrame:
        out = compose(pdf.sort_values("block"), model)
        out.insert(0, "fund", pdf["fund"].iloc[0])
        first = math.floor(pdf["t0"].min())
        return out.assign(first=first, last=math.floor(pdf["t1"].max()))

    state = [*(f"s{k}" for k in range(5)), *(f"z{k}" for k in range(5))]
    each = by_key(rows, keys, order, parts).mapInPandas(elements, "fund string, block int, t0 double, t1 double, y0 double, " + ", ".join(f"{x} double" for x in numbers))
    # one row of 14 numbers per block: a source of a billion readings has some ten thousand
    known = each.groupBy("fund").applyInPandas(states, "fund string, block int, next_t double, " + ", ".join(f"{x} double" for x in state) + ", any_value boolean, first int, last int")

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (fund, _), s, pdf in headed(batches, keys):
            t, y = _arrays(latest_in(pdf))
            if not len(t):
                continue
            days = business_days(int(s["first"]), int(s["last"]), off)
            lo, more = t[0] / DAY_MICROS, s["next_t"] == s["next_t"]
            mine = days[(days + 1.0 > lo) & ((days + 1.0 <= s["next_t"]) if more else True)]
            level = var = np.full(len(mine), np.nan)
            if s["any_value"]:
                start, end = tuple(s[f"s{k}"] for k in range(5)), tuple(s[f"z{k}"] for k in range(5))
                level, var, white = smooth(t / DAY_MICROS, y, mine + 1.0, model, start, lo, end, s["next_t"] if more else None)
                if len(white):
                    at, n = bins_of(np.maximum(white, TINY))
                    yield pd.DataFrame({"fund": fund, "bin": at, "n": n}).reindex(columns=PARTS_COLUMNS)
            yield _rows(fund, t, mine, level, var).reindex(columns=PARTS_COLUMNS)

    out = cut(by_key(with_heads(rows, known), keys, ["role", *order], parts).mapInPandas(blocks, PARTS))
    scale = F.pandas_udf(lambda b, n: scale_of(np.asarray(b), np.asarray(n)), "double", F.PandasUDFType.GROUPED_AGG)
    # sums of counts by bin of each hot source, then one number per source
    noise = out.filter("bin is not null").groupBy("fund", "bin").agg(F.sum("n").alias("n")).groupBy("fund").agg(scale("bin", "n").alias("scale"))
    days = out.filter("bin is null").groupBy("fund", "day").agg(F.max("value").alias("value"), F.max("sd").alias("sd"), F.sum("readings").alias("readings"), F.max("grid").alias("grid"))
    return days.join(noise, "fund", "left").select("fund", "day", "value", (F.col("sd") * F.sqrt("scale")).alias("sd"), "readings", "grid")


def missing_days(grid: DataFrame) -> DataFrame:
    """The days marked as missing: fonkodu, gun."""
    return grid.filter("eksik").select("fonkodu", "gun")

