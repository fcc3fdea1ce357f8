"""Problem 2 against sorted lists."""

import datetime as dt
import math
import random

from terazi.llm.quantiles import TARGETS, percentiles, range_sorted, value_counts

SCHEMA = "fonkodu string, start_date date, end_date date, archetype string, start_aum double, end_aum double, end_participants bigint, flow_pct double, market_effect_pct double"
DAY = dt.date(2025, 1, 1)


def rows(n=400, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        v = rng.choice([0.0, rng.gauss(0, 0.05), rng.gauss(0, 1e6), float("nan"), None, float("inf")])
        name = rng.choice(["Gold", "gold ", "EQUITY", "Equity", "one", None, "  "])
        out.append((f"F{i}", DAY, DAY + dt.timedelta(days=rng.randrange(5)), name, 1.0, 1.0, 1, v, rng.choice([None, rng.gauss(0, 1)])))
    return out + out[:50]


def expected(data, field):
    groups = {}
    seen = set()
    for r in data:
        key = tuple("nan" if isinstance(x, float) and math.isnan(x) else x for x in r)
        if key in seen:
            continue
        seen.add(key)
        v = r[field]
        if v is not None and not math.isnan(v):
            groups.setdefault((r[3] or "").strip().lower() or None, []).append(v)
    out = {}
    for g, vs in groups.items():
        vs.sort()
        for t in TARGETS:
            out[g, t] = vs[max(1, -(-t * len(vs) // 1000)) - 1]
    return out


def test_percentiles_within_half_a_step(spark):
    data = rows()
    got = percentiles(value_counts(spark.createDataFrame(data, SCHEMA).selectExpr("*", "1 as step", "'x' as field", "2 as n"))).collect()
    for field, at in (("flow_pct", 7), ("market_effect_pct", 8)):
        want = expected(data, at)
        mine = {(r.archetype, r.permille): r.value for r in got if r.field == field}
        assert mine.keys() == want.keys()
        for k, v in want.items():
            assert mine[k] == v or abs(mine[k] - v) <= 5e-7 + abs(v) * 1e-15


def test_partial_results_add_up(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    parts = [value_counts(df.filter(f"end_date = date'2025-01-0{k}'")) for k in range(1, 6)]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    assert sorted(map(str, percentiles(union).collect())) == sorted(map(str, percentiles(value_counts(df)).collect()))


def test_empty_and_single(spark):
    assert percentiles(value_counts(spark.createDataFrame([], SCHEMA))).count() == 0
    one = spark.createDataFrame([("A", DAY, DAY, "x", 1.0, 1.0, 1, 0.25, None)], SCHEMA)
    assert {(r.field, r.value) for r in percentiles(value_counts(one)).collect()} == {("flow_pct", 0.25)}


def test_any_partitions_and_joins(spark):
    """The ranges follow the counts: partitions of large values are as small as others, and give the same result."""
    rng = random.Random(2)
    data = [(f"F{i}", DAY, DAY + dt.timedelta(days=i % 3), "big", 1.0, 1.0, 1, rng.uniform(1e6, 1.01e6), float(i % 2)) for i in range(3000)]
    counts = value_counts(spark.createDataFrame(data, SCHEMA))
    sizes = [r["count"] for r in range_sorted(counts, 8).filter("field = 'flow_pct'").groupBy("part").count().collect()]
    assert len(sizes) >= 4 and max(sizes) < 1200
    results = [sorted(map(str, percentiles(counts, parts=p, sent=s).collect())) for p, s in ((1, 100), (8, 100), (8, 0))]
    assert results[0] == results[1] == results[2] and len(results[0]) == 2 * len(TARGETS)
