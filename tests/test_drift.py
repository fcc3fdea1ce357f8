"""Problems 4 and 5: scripts between schemas and snapshots, on cases known by construction."""

import datetime as dt
import itertools
import json
import random

import numpy as np

from terazi.operators.drift import Drift, agreement, assign, edit, tree, with_moves
from terazi.operators.snapshots import merge, snapshot_changes

RAW = "feed string, file_seq int, line_no int, delivered timestamp, payload string"
FUNDS = [f"F{i:03d}" for i in range(12)]


def file_of(feed, seq, fields, seed=0, text=(), drop=()):
    """Records of all funds; a field's weights depend on what it stands for, with small noise."""
    rng = random.Random(seed * 100 + seq)
    rows = []
    for k, f in enumerate(FUNDS):
        rec = {"fonKodu": f" {f.lower()}", "tarih": f"2025-0{seq}-01", "fonUnvan": "T"}
        for name, what in fields.items():
            w = random.Random(f"{feed}{what}{f}").uniform(1, 40) * rng.uniform(0.97, 1.03)
            rec[name] = None if k in drop else (f"{w:.2f}".replace(".", ",") + "%" if name in text else round(w, 2))
        rows.append((feed, seq, k, dt.datetime(2025, 1, 1), json.dumps(rec)))
    return rows


def script(df, tables=()):
    return {(r.feed, r.file_seq, r.change, r.field, r.new_field) for r in Drift(df, list(tables)).report().collect()}


def test_script_of_a_feed(spark):
    rows = file_of("A", 1, {"a": 1, "b": 2, "c": 3}) + file_of("A", 2, {"a": 1, "bb": 2, "d": 4}) + file_of("A", 3, {"a": 1, "bb": 2, "d": 4}, text=("a",)) + file_of("B", 5, {"x": 1}) + file_of("B", 9, {"x": 1, "y": 2}, drop=(0, 1))
    rows += rows[:5] + [("A", 1, 99, None, '{"fonKodu": "F1", "zz": 1'), ("A", 2, 99, None, None), ("A", 2, 99, None, "[1]"), ("A", 7, 1, None, "broken"), (None, 1, 1, None, '{"q": 1}'), ("A", None, 1, None, '{"q": 1}')]
    random.Random(1).shuffle(rows)
    got = script(spark.createDataFrame(rows, RAW).selectExpr("*", "1 as field", "2 as kind", "3 as fund"))
    assert got == {("A", 2, "renamed", "b", "bb"), ("A", 2, "removed", "c", ""), ("A", 2, "added", "d", ""), ("A", 3, "retyped", "a", ""), ("B", 9, "added", "y", "")}


def test_tables_and_the_consistent_table(spark):
    def wide(fields, text=()):
        rows = [(f, "T", dt.date(2025, 1, 1), *((f"{w:.2f}" if n in text else w) for n, s in fields.items() for w in [random.Random(f"{s}{f}").uniform(1, 40)])) for f in FUNDS]
        return spark.createDataFrame(rows, "fonkodu string, fonunvan string, tarih date, " + ", ".join(f"{n} {'string' if n in text else 'double'}" for n in fields))

    tables = [wide({"kks": 1, "vm": 2}), wide({"kkstl": 1, "vm": 2}, text=("vm",)), wide({"kkstl2": 1, "vm": 2}, text=("vm",)).limit(0), wide({"kkstl2": 1})]
    d = Drift(spark.createDataFrame([], RAW), tables)
    got = {tuple(r) for r in d.report().collect()}
    assert got == {("TABLE", 2, "renamed", "kks", "kkstl"), ("TABLE", 2, "retyped", "vm", ""), ("TABLE", 3, "added", "kkstl2", ""), ("TABLE", 3, "removed", "kkstl", ""), ("TABLE", 4, "removed", "vm", "")}
    rows = d.table().collect()
    assert {(r.file_seq, r.source_field, r.field) for r in rows} == {(1, "kks", "kkstl"), (1, "vm", "vm"), (2, "kkstl", "kkstl"), (2, "vm", "vm"), (4, "kkstl2", "kkstl2")}
    assert all(r.weight is not None and r.fonkodu in FUNDS for r in rows)


def test_assignment_is_the_cheapest():
    rng = np.random.default_rng(1)
    for n in (1, 2, 4, 6):
        c = rng.uniform(0, 9, (n, n))
        best = min(sum(c[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
        assert np.isclose(sum(c[i, j] for i, j in enumerate(assign(c))), best)


def test_nested_trees_rename_and_move():
    old, new = tree(["a", "w.x", "w.y", "p.k"]), tree(["a", "v.x", "v.y", "q", "k"])
    _, s = edit(old, new, {})
    assert ("renamed", "w.x", "v.x") in s and ("renamed", "w.y", "v.y") in s
    assert set(with_moves([("removed", "p.k", ""), ("added", "k", ""), ("added", "q", "")])) == {("moved", "p.k", "k"), ("added", "q", "")}
    assert edit(tree(["a"]), tree(["a"]), {}) == (0.0, [])
    assert edit(tree(["a"]), tree(["b"]), {("a", "b"): 0.9})[1] == [("renamed", "a", "b")]
    assert sorted(edit(tree(["a"]), tree(["b"]), {("a", "b"): 0.2})[1]) == [("added", "b", ""), ("removed", "a", "")]


SNAP = "tarih date, teslim_no int, fonkodu string, fonunvan string, kisisayisi bigint"


def brute(rows):
    days = sorted({r[0] for r in rows if r[0]})
    last = {d: max(-1 if r[1] is None else r[1] for r in rows if r[0] == d) for d in days}
    at = {d: {} for d in days}
    for d, n, k, t, _ in rows:
        k = (k or "").strip().upper()
        if d and k and (-1 if n is None else n) == last[d]:
            t = None if t is None else " ".join(t.split())
            at[d][k] = t
    out = set()
    for a, b in zip(days[:-1], days[1:], strict=True):
        for k in at[a].keys() | at[b].keys():
            what = "added" if k not in at[a] else "removed" if k not in at[b] else "changed" if at[a][k] != at[b][k] else None
            if what:
                out.add((k, str(b), what))
    return out


def test_snapshots_against_brute_force(spark):
    rng = random.Random(6)
    rows = []
    for i in range(7):
        d = dt.date(2025, 1, 1) + dt.timedelta(days=9 * i)
        for n in (1, 2) if i == 3 else (1,):
            rows += [(d, n, rng.choice([f, f" {f.lower()} "]), rng.choice([f"T {f}", f"T  {f} "]) if rng.random() < 0.8 else f"T{rng.randrange(3)}", 5) for f in FUNDS if rng.random() < 0.7]
    seen, unique = set(), []
    for r in rows:
        k = (r[0], r[1], r[2].strip().upper())
        if k not in seen:
            seen.add(k)
            unique.append(r)
    rows = unique + unique[:20] + [(None, 1, "F000", "x", 1), (dt.date(2025, 1, 1), 1, None, "x", 1), (dt.date(2025, 1, 1), 1, "  ", "x", 1), (dt.date(2025, 1, 10), 1, "NULLT", None, 1)]
    got = [(r.fonkodu, r.tarih, r.change) for r in snapshot_changes(spark.createDataFrame(rows, SNAP).selectExpr("*", "1 as k", "2 as at", "'x' as title")).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    assert snapshot_changes(spark.createDataFrame([], SNAP)).count() == 0
    assert snapshot_changes(spark.createDataFrame(rows, SNAP).filter("tarih = date'2025-01-01'")).count() == 0


def test_two_pointers():
    assert list(merge([("a", 1), ("b", 2)], [("b", 3), ("c", None)])) == [("a", "removed", 1, None), ("b", "changed", 2, 3), ("c", "added", None, None)]
    assert list(merge([], [])) == []


def test_many_ranges_and_columns(spark):
    """Small ranges give the same rows; each compared column that differs has a row of its own."""
    rows = [(dt.date(2025, 1, d), 1, f"F{k:03d}", f"T{k % (d + 2)}", k * d % 3) for d in (1, 5, 9) for k in range(60) if (k + d) % 7]
    df = spark.createDataFrame(rows, SNAP)
    key = lambda **x: sorted(map(str, snapshot_changes(df, ("fonunvan", "kisisayisi"), **x).collect()))
    assert key() == key(range_rows=10) and len(key()) > 100
    by = {(r[0], r[2]): r for r in rows}
    for r in snapshot_changes(df, ("kisisayisi",)).collect():
        if r.change == "changed":
            day = dt.date.fromisoformat(r.tarih)
            assert r.old_value != r.new_value == str(by[day, r.fonkodu][4])


def test_pairs_without_doubt():
    one = [{"field": "a", "new_field": "b", "agree": 1, "sources": 1}]
    assert agreement(one) == {("a", "b"): 1.0}
    assert agreement([*one, {"field": "a", "new_field": "c", "agree": 1, "sources": 1}]) == {("a", "b"): 0.0, ("a", "c"): 0.0}
    assert agreement([{"field": "a", "new_field": "b", "agree": 1, "sources": 2}]) == {("a", "b"): 0.0}


def test_moves_of_one_name():
    script_ = [("removed", "p.x", ""), ("removed", "q.x", ""), ("added", "r.x", ""), ("added", "s.x", ""), ("added", "t.y", "")]
    assert sorted(with_moves(script_)) == [("added", "t.y", ""), ("moved", "p.x", "r.x"), ("moved", "q.x", "s.x")]


def test_two_at_once(spark):
    """Records of two operators are read side by side: neither sees the other's."""
    a, b = (Drift(spark.createDataFrame(file_of("A", 1, f) + file_of("A", 2, f), RAW), []) for f in ({"a": 1}, {"b": 2}))
    assert {r.field for r in a.fields.collect()} == {"a"} and {r.field for r in b.fields.collect()} == {"b"}


def test_numbers_in_texts(spark):
    from pyspark.sql import functions as F

    from terazi.operators.drift import number_of

    cases = {" 3.17": 3.17, "7,28": 7.28, "30,53%": 30.53, "1.234,5": 1234.5, "1,234.5": 1234.5, "": None, "n/a": None, "-2": -2.0, "NaN": None, None: None, "1e400": None}
    got = {r.t: r.x for r in spark.createDataFrame([(k,) for k in cases], "t string").select("t", number_of(F.col("t")).alias("x")).collect()}
    assert got == cases
