"""Implausible spikes, stuck and impossible values (problem 7).

Per source and field, on the logarithm of the positive values in time:

* Phase-space thresholding: the value less its running median, its first and its second
  difference are a point in phase space. Robust scales (medians of those that aren't zero)
  and quadrant correlations of the whole source give a rotated ellipsoid; its radius is
  ``reach`` times sqrt(2 ln n), the largest of n normal deviates. Points outside are replaced by
  the running median and all points are taken again beside the replaced ones, until the set
  outside stays the same; so neighbours of a spike come back in. Only points outside can be
  spikes.
* Of these, one or two neighbours are a spike if the readings before and after agree and
  both lie on the same side of it. A lasting change of level isn't one.
* Six or more consecutive equal values (zero first differences) are stuck, where the field
  otherwise changes.
* Zero and negative values are impossible.

The scales, the correlations and the share of changes belong to the whole source and come
from counts that add up: deviations in bins of a thousandth, signs of products, lengths of
runs. A source that is too large for one task is counted block by block, and its blocks are
searched with the same figures and ``HALO`` readings of context, so cutting it changes nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terazi.operators.series import BLOCK_ROWS, binned_median, bins_of, by_key, finite, groups, headed, latest_in, reading_rows, split_hot, with_heads
from terazi.session import cut, shuffle_partitions

FIELDS = ("fiyat", "tedpaysayisi", "portfoybuyukluk")
#: Half the window of the running median.
HALF = 3
#: Replacements at most; each reaches HALF + 1 readings further, HALO all of them.
ROUNDS = 8
HALO = ROUNDS * (HALF + 1) + 8


@dataclass(frozen=True)
class FaultRules:
    """Thresholds; none depends on the data's size."""

    reach: float = 4.5  # radius of the ellipsoid, in largest normal deviates
    back_share: float = 0.35  # readings before and after agree: within this share of the deviation
    spike_length: int = 2
    stuck_length: int = 6
    changing_share: float = 0.5  # of all steps
    otherwise_share: float = 0.9  # of the steps outside stuck runs
    level_readings: int = 3
    smallest_move: float = 1e-6


@dataclass(frozen=True)
class Usual:
    """What is usual for a source and field: inverse scatter in phase space (9 numbers), movement, shares of changing steps, readings."""

    inverse: tuple[float, ...]
    move: float
    changing: float
    otherwise: float
    n: int

    def numbers(self) -> list[float]:
        return [*self.inverse, self.move, self.changing, self.otherwise, float(self.n)]

    @classmethod
    def of(cls, x: list[float]) -> Usual:
        return cls(tuple(map(float, x[:9])), float(x[9]), float(x[10]), float(x[11]), int(x[12]))


PAIRS = ((0, 1), (0, 2), (1, 2))


@dataclass
class Counts:
    """Additive figures of a stretch of readings: ``n`` by kind and bin.

    Kinds: 0 to 2 deviations in each coordinate that aren't zero, by bin; 3 to 5 all of them; 6 to 8 products of two
    coordinates above less below zero; 9 to 11 such products that aren't zero; 12 steps; 13 steps inside stuck runs; 14 readings.
    """

    n: dict[tuple[int, int], int] = field(default_factory=dict)

    def add(self, kind: int, value: int, bin_: int = 0) -> None:
        if value:
            self.n[kind, bin_] = self.n.get((kind, bin_), 0) + int(value)

    def points(self, x: np.ndarray) -> None:
        """Points of phase space (rows; NaN where a coordinate isn't defined)."""
        known = ~np.isnan(x)
        for k in range(3):
            v = np.abs(x[known[:, k], k])
            self.add(3 + k, len(v))
            if len(v := v[v > 0]):
                for b, c in zip(*(a.tolist() for a in bins_of(v)), strict=True):
                    self.add(k, c, b)
        for i, (a, b) in enumerate(PAIRS):
            sign = np.sign(x[:, a]) * np.sign(x[:, b])
            sign = sign[~np.isnan(sign)]
            self.add(6 + i, int(sign.sum()))
            self.add(9 + i, int(np.count_nonzero(sign)))

    def usual(self, rules: FaultRules) -> Usual:
        one = lambda k: self.n.get((k, 0), 0)
        scale, changing = [], 0
        for k in range(3):
            bins = {b: c for (kind, b), c in self.n.items() if kind == k}
            moved = sum(bins.values())
            changing = moved if k == 1 else changing
            # in a field that rarely changes most readings don't move at all
            scale.append(1.4826 * binned_median(np.array(list(bins)), np.array(list(bins.values()))) * math.sqrt(moved / one(3 + k)) if moved else 0.0)
        steps, inside, n = one(12), one(13), one(14)
        if not scale[1]:
            return Usual((0.0,) * 9, math.nan, 0.0, 0.0, n)
        move = max(scale[1], rules.smallest_move)
        s = np.array([max(scale[0], move / 2), move, max(scale[2], move)])
        r = np.eye(3)
        for i, (a, b) in enumerate(PAIRS):
            r[a, b] = r[b, a] = math.sin(math.pi / 2 * one(6 + i) / max(1, one(9 + i)))
        values, vectors = np.linalg.eigh(r)
        inverse = (vectors / np.maximum(values, 0.1)) @ vectors.T / np.outer(s, s)
        return Usual(tuple(inverse.ravel().tolist()), move, changing / max(1, steps), changing / max(1, steps - inside), n)


def equal_runs(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each element: the first index and the length of its run of equal values."""
    at = np.flatnonzero(np.r_[True, y[1:] != y[:-1]])
    length = np.diff(np.r_[at, len(y)])
    return np.repeat(at, length), np.repeat(length, length)


def running_median(y: np.ndarray, half: int = HALF) -> np.ndarray:
    """Median over 2 half + 1 values, the ends repeated."""
    return np.median(np.lib.stride_tricks.sliding_window_view(np.pad(y, half, mode="edge"), 2 * half + 1), axis=1)


def phase(y: np.ndarray, clean: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Points of phase space: each reading beside its cleaned neighbours (NaN where it has none)."""
    x = np.full((len(y), 3), np.nan)
    x[:, 0] = y - level
    x[1:, 1] = y[1:] - clean[:-1]
    x[1:-1, 2] = clean[2:] - 2 * y[1:-1] + clean[:-2]
    return x


def usual(y: np.ndarray, rules: FaultRules) -> Usual:
    """Figures of one whole series of logarithms."""
    c = Counts()
    if len(y):
        c.points(phase(y, y, running_median(y)))
        _, length = equal_runs(y)
        c.add(12, len(y) - 1)
        c.add(13, int(((length[1:] >= rules.stuck_length) & (y[1:] == y[:-1])).sum()))
    c.add(14, len(y))
    return c.usual(rules)


def outside(y: np.ndarray, known: Usual, rules: FaultRules) -> np.ndarray:
    """Readings outside the ellipsoid, each beside neighbours that are inside or replaced by their level."""
    inverse = np.array(known.inverse).reshape(3, 3)
    radius = rules.reach * math.sqrt(2 * math.log(max(known.n, 3)))
    found, clean = np.zeros(len(y), dtype=bool), y
    for _ in range(ROUNDS):
        level = running_median(clean)
        x = np.nan_to_num(phase(y, clean, level))
        now = ((x @ inverse) * x).sum(axis=1) > radius * radius
        if (now == found).all():
            break
        found, clean = now, np.where(now, level, y)
    return found


def spikes(y: np.ndarray, known: Usual, rules: FaultRules) -> np.ndarray:
    """Marks of spikes of a series of logarithms."""
    n, k = len(y), rules.level_readings
    out = np.zeros(n, dtype=bool)
    if n < 3 or not known.move > 0:
        return out
    found = outside(y, known, rules)
    for length in range(1, rules.spike_length + 1):
        for i in np.flatnonzero(found).tolist():
            j = i + length
            if not i or j >= n or not found[i:j].all() or out[i:j].any():
                continue
            before, after = y[max(0, i - 64) : i][~out[max(0, i - 64) : i]][-k:], y[j : j + k]
            if not len(before):
                continue
            lo, hi = _near(before[::-1], y[i - 1]), _near(after, y[j])
            off = y[i:j]
            low, high = min(lo, hi), max(lo, hi)
            gap = float((off - high if off[0] > high else low - off).min())
            # the readings beside it are nearer to the level than to the spike
            if gap > 0 and high - low <= rules.back_share * gap and min(abs(y[i] - y[i - 1]), abs(y[j - 1] - y[j])) >= gap / 2:
                out[i:j] = True
    return out


def _near(level: np.ndarray, next_to: float) -> float:
    """Median of the readings beside a stretch; of two, the nearer one."""
    return float(np.median(level)) if len(level) > 2 else float(next_to)


def stuck(y: np.ndarray, known: Usual, rules: FaultRules) -> np.ndarray:
    """Marks of all but the first of six or more equal values, in a field that otherwise changes."""
    if not len(y) or known.changing < rules.changing_share or known.otherwise < rules.otherwise_share:
        return np.zeros(len(y), dtype=bool)
    first, length = equal_runs(y)
    return (length >= rules.stuck_length) & (np.arange(len(y)) > first)


def faults_of(v: np.ndarray, rules: FaultRules, known: Usual | None = None, before: np.ndarray = np.zeros(0), after: np.ndarray = np.zeros(0)) -> tuple[np.ndarray, np.ndarray]:
    """Kinds and distances of one series of values in time (NaN: no value).

    Kinds: 0 none, 1 impossible, 2 spike, 3 stuck. Distance: from the running median, in usual movements.
    ``before`` and ``after``: logarithms of the readings around a block.
    """
    kind, distance = np.zeros(len(v), dtype=np.int8), np.full(len(v), np.nan)
    kind[v <= 0] = 1
    at = np.flatnonzero(v > 0)
    if not len(at):
        return kind, distance
    y = np.r_[before, np.log(v[at]), after]
    own = slice(len(before), len(before) + len(at))
    known = known or usual(y, rules)
    kind[at[stuck(y, known, rules)[own]]] = 3
    kind[at[spikes(y, known, rules)[own]]] = 2
    if known.move > 0:
        distance[at] = ((y - running_median(y)) / known.move)[own]
    return kind, distance


KINDS = np.array(["", "impossible", "spike", "stuck"], dtype=object)
OUT = "row_id long, fund string, t long, field string, kind string, value double, distance double"


def _found(fund: str, pdf: pd.DataFrame, rules: FaultRules, head: pd.Series | None = None) -> list[pd.DataFrame]:
    out = []
    for f in FIELDS:
        v = pdf[f].to_numpy(dtype=float)
        about = () if head is None else (Usual.of(head[f"{f}_known"]), *(np.array(head[f"{f}_{x}"], dtype=float) for x in ("before", "after")))
        kind, distance = faults_of(v, rules, *about)
        hit = np.flatnonzero(kind > 0)
        if len(hit):
            out.append(pd.DataFrame({"row_id": pdf["row_id"].to_numpy()[hit], "fund": fund, "t": pdf["t"].to_numpy()[hit], "field": f, "kind": KINDS[kind[hit]], "value": v[hit], "distance": distance[hit]}))
    return out


def find_faults(general: DataFrame, rules: FaultRules = FaultRules(), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Faulty values of readings: kayit_no, fonkodu, tarih, field, kind, value, distance.

    kind is impossible, spike or stuck. Null, NaN and infinite values are no cases and are skipped, so
    they don't end a run. Of the same source and moment only the row loaded last counts; unpublished
    moments (all three values 0) and rows without source or moment are ignored; a repeated row comes out
    once. A source with fewer than three values of a field has no spike, one with equal values only
    nothing stuck. Empty tables give no rows. A null kayit_no comes out as null.
    """
    rows = reading_rows(general, *(finite(F.col(f)).alias(f) for f in FIELDS))
    parts = shuffle_partitions(general.sparkSession)
    split = split_hot(rows, block_rows)

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[pd.DataFrame] = []
        for (fund,), pdf in groups(batches, ["fund"]):
            out += _found(fund, latest_in(pdf), rules)
            if len(out) > 500:
                yield pd.concat(out)
                out = []
        if out:
            yield pd.concat(out)

    found = by_key(split.cold, ["fund"], ORDER, parts).mapInPandas(whole, OUT)
    if split.hot is not None:
        found = found.unionByName(_hot(split.hot, rules, parts))
    return found.select(
        F.when(F.col("row_id") > -(2**62), F.col("row_id")).alias("kayit_no"), F.col("fund").alias("fonkodu"), F.timestamp_micros("t").alias("tarih"), "field", "kind", "value",
        F.when(~F.isnan("distance"), F.col("distance")).alias("distance"),
    )


# --- sources that are too large for one task ---------------------------------------------------

ORDER = ["t", "loaded", "row_id"]
#: Readings at the ends of a block whose points need its neighbours.
EDGE = HALF + 1
COUNTED = "fund string, field string, kind int, bin long, n long"
RIMS = "block int, size int, head array<double>, tail array<double>, lead int, trail int"


def _counted(fund: str, name: str, c: Counts) -> pd.DataFrame:
    return pd.DataFrame([(fund, name, k, b, n) for (k, b), n in c.n.items()], columns=["fund", "field", "kind", "bin", "n"])


def _stacked(a: pd.DataFrame, b: pd.DataFrame, columns: list[str], arrays: tuple[str, ...]) -> pd.DataFrame:
    """Both below each other; arrays that are absent become null."""
    out = pd.concat([a, b]).reindex(columns=columns)
    return out.assign(**{c: [x if isinstance(x, np.ndarray | list) else None for x in out[c]] for c in arrays})


def _hot(rows: DataFrame, rules: FaultRules, parts: int) -> DataFrame:
    """Blocks of hot sources: count, with what only the block sees; join the rims; search."""
    keys = ["fund", "block"]
    columns = [x.split()[0] for x in f"{COUNTED}, {RIMS}".split(", ")]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (fund, block), pdf in groups(batches, keys):
            pdf = latest_in(pdf)
            for f in FIELDS:
                v = pdf[f].to_numpy(dtype=float)
                y = np.log(v[v > 0])
                c, n = Counts(), len(y)
                if not n:
                    continue
                first, length = equal_runs(y)
                if n > 2 * HALO:
                    c.points(phase(y, y, running_median(y))[EDGE:-EDGE])
                inner = (first > 0) & (first + length < n) & (length >= rules.stuck_length)
                c.add(12, n - 1)
                c.add(13, int((inner[1:] & (y[1:] == y[:-1])).sum()))
                c.add(14, n)
                rim = {"fund": fund, "field": f, "block": block, "size": n, "head": y[:HALO] if n > 2 * HALO else y, "tail": y[-HALO:] if n > 2 * HALO else y[:0], "lead": length[0], "trail": length[-1]}
                yield _stacked(_counted(fund, f, c), pd.DataFrame([rim]), columns, ("head", "tail"))

    # written once: counts by bin, and two rims of HALO readings per block
    each = cut(by_key(rows, keys, ORDER, parts).mapInPandas(count, f"{COUNTED}, {RIMS}"))

    def joints(pdf: pd.DataFrame) -> pd.DataFrame:
        """Of one source and field: the readings around each block, and counts of the points at the ends of blocks."""
        fund, name = pdf["fund"].iloc[0], pdf["field"].iloc[0]
        blocks = list(pdf.sort_values("block").itertuples(index=False))
        c, out = Counts(), []
        run, value = 0, None  # a run that may go on in the next block
        y, mine, gap = [], [], []  # readings at hand, those to be counted here, whether readings between are left out

        def flush() -> None:
            a = np.array(y)
            points = phase(a, a, running_median(a))
            c.points(points[np.array(mine)])

        for i, b in enumerate(blocks):
            head, tail = np.array(b.head, dtype=float), np.array(b.tail, dtype=float)
            last = tail[-1] if len(tail) else head[-1]
            c.add(12, int(i > 0))
            run = run + b.lead if value is not None and value == head[0] else _close(c, run, rules) + b.lead
            if b.lead < b.size:
                _close(c, run, rules)
                run = b.trail
            value = last
            if len(tail):
                y += head.tolist()
                mine += [k < EDGE for k in range(len(head))]
                flush()
                y, mine = tail.tolist(), [k >= len(tail) - EDGE for k in range(len(tail))]
            else:
                y += head.tolist()
                mine += [True] * len(head)
            before, after, j = [], [], i - 1
            while j >= 0 and len(before) < HALO:
                before = [*(blocks[j].tail if len(blocks[j].tail) else blocks[j].head), *before]
                j -= 1
            j = i + 1
            while j < len(blocks) and len(after) < HALO:
                after = [*after, *blocks[j].head]
                j += 1
            out.append({"fund": fund, "field": name, "block": b.block, "before": before[-HALO:], "after": after[:HALO]})
        if y:
            flush()
        _close(c, run, rules)
        return _stacked(_counted(fund, name, c), pd.DataFrame(out), ["fund", "field", "kind", "bin", "n", "block", "before", "after"], ("before", "after"))

    joined = cut(each.filter("block is not null").drop("kind", "bin", "n").groupBy("fund", "field").applyInPandas(joints, f"{COUNTED}, block int, before array<double>, after array<double>"))

    def figures(pdf: pd.DataFrame) -> pd.DataFrame:
        c = Counts({(int(k), int(b)): int(n) for k, b, n in zip(pdf["kind"], pdf["bin"], pdf["n"], strict=True)})
        return pd.DataFrame({"fund": [pdf["fund"].iloc[0]], "field": [pdf["field"].iloc[0]], "known": [c.usual(rules).numbers()]})

    counted = [x.split()[0] for x in COUNTED.split(", ")]
    sums = each.filter("kind is not null").select(*counted).unionByName(joined.filter("kind is not null").select(*counted)).groupBy("fund", "field", "kind", "bin").agg(F.sum("n").alias("n"))
    known = sums.groupBy("fund", "field").applyInPandas(figures, "fund string, field string, known array<double>")
    state = joined.filter("block is not null").select("fund", "field", "block", "before", "after").join(known, ["fund", "field"])
    wide = state.groupBy("fund", "block").agg(*(F.max(F.when(F.col("field") == f, F.col(x))).alias(f"{f}_{x}") for f in FIELDS for x in ("known", "before", "after")))
    # a block without a value of some field still has a head for it
    empty = F.array().cast("array<double>")
    none = F.array(*(F.lit(0.0) for _ in range(13)))
    heads = wide.select("fund", "block", *(F.coalesce(f"{f}_{x}", none if x == "known" else empty).alias(f"{f}_{x}") for f in FIELDS for x in ("known", "before", "after")))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (fund, _), head, pdf in headed(batches, keys):
            yield from _found(fund, latest_in(pdf), rules, head)

    return by_key(with_heads(rows, heads), keys, ["role", *ORDER], parts).mapInPandas(search, OUT)


def _close(c: Counts, run: int, rules: FaultRules) -> int:
    """Count the steps inside a run that ended, if it is long enough; 0, the length of the next."""
    c.add(13, run - 1 if run >= rules.stuck_length else 0)
    return 0
