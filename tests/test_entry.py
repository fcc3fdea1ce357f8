"""The driver's contract: names, columns, and queries against their SQL on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no tables here")


def test_entry(spark):
    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["flow_decomposition", "lens_universe", "dna_top_exposures", "stress_index", "p1_found", "p1_days", "p3_trailing", "p4_found", "p4_table", "p5_found", "p5_changes", "p7_fixed", "universe_window", "universe_with_classes", "founder_extract", "weight_text", "style_drift", "class_stability", "founder_flows"])
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    df = entry.queries()[name](spark, DATA)
    rel = c.sql(entry.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    at = [rel.columns.index(x) for x in cols]
    key = lambda r: repr([f"{x:.9g}" if isinstance(x, float) else str(x) for x in r])
    assert sorted(key([r[x] for x in cols]) for r in df.collect()) == sorted(key([r[i] for i in at]) for r in rel.fetchall())
