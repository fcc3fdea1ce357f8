"""Schemas that drift between files (problem 4).

Each file's schema is a tree: the root, its fields, and their fields where values are
nested (paths with dots). The script from one file to the next is that of the least tree
edit distance: keeping a field of the same path costs nothing, adding or deleting a node 1,
and renaming ``RENAME_COST`` times the share of sources whose weights the new field does
not carry on; siblings are matched by a minimum-cost assignment. A subtree deleted under
one parent and added under another with the same fields is a move. Scripts of all steps of
a feed are compiled into one projection per file, from its names to the latest ones, and
applied to every file.

Evidence for renaming is counted by joins on file and source; only fields that left or
entered take part, so nothing is compared across sources.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terazi.operators.series import source_code
from terazi.session import cut

IDS = ("fonkodu", "tarih", "fonunvan")
#: A renaming is dearer than a deletion and an addition (2) below an agreement of one half.
RENAME_COST = 4.0
#: Weights agree within this share of the larger one, or this many points.
CLOSE_SHARE, CLOSE_POINTS = 0.2, 0.05
#: Sources with a weight other than zero in either field; with fewer, all must agree, and no other field may agree with either.
LEAST_SOURCES = 3
#: Fields of open steps that are sent to every task; more are joined by a shuffle.
SENT_FIELDS = 100_000


def number_of(text: Column) -> Column:
    """Number written as text, with blanks, a percent sign, a decimal comma or point (the last sign, if both occur); null if it is none."""
    t = F.translate(text, " \t\r\n\u00a0%", "")
    mixed = t.contains(",") & t.contains(".")
    comma_last = F.instr(F.reverse(t), ",") < F.instr(F.reverse(t), ".")
    t = F.when(~mixed, F.translate(t, ",", ".")).when(comma_last, F.translate(F.translate(t, ".", ""), ",", ".")).otherwise(F.translate(t, ",", ""))
    x = t.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


LONG = ("feed", "file_seq", "fund", "day", "field", "kind", "weight")


def raw_long(raw: DataFrame, depth: int = 1) -> DataFrame:
    """One row per readable record and field: LONG. kind is text, number, null or other; broken lines give nothing.

    With ``depth`` above 1, fields of nested objects become paths with dots.
    """
    lines = raw.select("feed", F.col("file_seq").cast("int").alias("file_seq"), "payload").filter("feed is not null and file_seq is not null and payload is not null").distinct()
    # a record is an object: its first sign tells, without a schema of all it holds
    parsed = lines.filter("ltrim(' \t\r\n', payload) like '{%'").select("feed", "file_seq", F.expr("try_parse_json(payload)").alias("v")).filter("v is not null")
    ids = parsed.select(
        "feed", "file_seq", "v", source_code(F.expr("try_variant_get(v, '$.fonKodu', 'string')")).alias("fund"),
        F.expr("try_to_date(try_variant_get(v, '$.tarih', 'string'), 'yyyy-MM-dd')").alias("day"), F.lit("").alias("parent"),
    )
    levels, at = [], ids
    for level in range(depth):
        each = at.lateralJoin(at.sparkSession.tvf.variant_explode(F.col("v").outer()).select("key", "value")).select("feed", "file_seq", "fund", "day", "parent", "key", "value")
        typed = each.withColumns({"field": F.concat("parent", "key"), "type": F.expr("schema_of_variant(value)")}).filter(~F.lower("field").isin(*IDS))
        nested = F.col("type").like("OBJECT<%") if level + 1 < depth else F.lit(False)
        kind = F.when(F.col("type") == "VOID", "null").when(F.col("type") == "STRING", "text").when(F.col("type").rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)"), "number").otherwise("other")
        leaf = typed.filter(~nested).select("feed", "file_seq", "fund", "day", "field", kind.alias("kind"), "value")
        told = F.expr("try_variant_get(value, '$', 'double')")
        weight = F.when(F.col("kind") == "text", number_of(F.expr("try_variant_get(value, '$', 'string')"))).when((F.col("kind") == "number") & (F.abs(told) != float("inf")), told)
        levels.append(leaf.select("feed", "file_seq", "fund", "day", "field", "kind", weight.alias("weight")))
        at = typed.filter(nested).select("feed", "file_seq", F.col("value").alias("v"), "fund", "day", F.concat("field", F.lit(".")).alias("parent"))
    return reduce(DataFrame.unionByName, levels)


def table_long(tables: list[DataFrame], feed: str = "TABLE") -> DataFrame:
    """The same of wide tables, numbered from 1 in their order; kind is that of the column (null for a null value)."""
    out = []
    for seq, t in enumerate(tables, 1):
        by = {c.lower(): c for c in t.columns}
        codes = [c for c in t.columns if c.lower() not in IDS]
        day = F.col(by["tarih"]).cast("date") if "tarih" in by else F.lit(None).cast("date")
        t = t.distinct()
        cells = [F.struct(F.lit(c).alias("field"), F.when(F.col(f"`{c}`").isNull(), "null").otherwise(F.lit(_kind(t, c))).alias("kind"), F.col(f"`{c}`").cast("string").alias("text")) for c in codes]
        if cells:
            out.append(t.select(F.lit(feed).alias("feed"), F.lit(seq).alias("file_seq"), source_code(F.col(by["fonkodu"])).alias("fund"), day.alias("day"), F.explode(F.array(*cells)).alias("x")).select("feed", "file_seq", "fund", "day", "x.field", "x.kind", number_of(F.col("x.text")).alias("weight")))
    return reduce(DataFrame.unionByName, out)


def _kind(t: DataFrame, c: str) -> str:
    return "text" if dict(t.dtypes)[c] == "string" else "number"


def table_fields(spark: SparkSession, tables: list[DataFrame], feed: str = "TABLE") -> DataFrame:
    """Fields of wide tables by their schemas, so that empty tables have theirs too."""
    rows = [(feed, seq, c, _kind(t, c)) for seq, t in enumerate(tables, 1) for c in t.columns if c.lower() not in IDS]
    return spark.createDataFrame(rows, "feed string, file_seq int, field string, type string")


def fields_of(long: DataFrame) -> DataFrame:
    """Fields of each raw file with their type, that of most non-null values (null: there are none)."""
    n = long.groupBy("feed", "file_seq", "field").agg(F.count_if(F.col("kind") == "text").alias("t"), F.count_if(F.col("kind") == "number").alias("n"))
    return n.select("feed", "file_seq", "field", F.when(F.col("t") > F.col("n"), "text").when(F.col("n") > 0, "number").alias("type"))


def steps_of(fields: DataFrame) -> DataFrame:
    """One row per file after the first of its feed: before and after (arrays of field and type), left and entered (names)."""
    files = fields.groupBy("feed", "file_seq").agg(F.sort_array(F.collect_list(F.struct("field", "type"))).alias("after"))
    w = Window.partitionBy("feed").orderBy("file_seq")
    pairs = files.withColumns({"before": F.lag("after").over(w), "prior": F.lag("file_seq").over(w)}).filter("before is not null")
    return pairs.withColumns({"left": F.array_except("before.field", "after.field"), "entered": F.array_except("after.field", "before.field")})


def evidence(long: DataFrame, steps: DataFrame) -> DataFrame:
    """Agreement of each field that left with each that entered: feed, file_seq, field, new_field, sources, agree.

    Only values of such fields are shuffled, once, by step and source; a source's row then holds the few
    fields of its step.
    """
    open_steps = steps.filter("size(left) > 0 and size(entered) > 0")
    old = open_steps.select("feed", F.col("prior").alias("at"), F.col("file_seq").alias("step"), F.explode("left").alias("field"), F.lit(0).alias("role"))
    new = open_steps.select("feed", F.col("file_seq").alias("at"), F.col("file_seq").alias("step"), F.explode("entered").alias("field"), F.lit(1).alias("role"))
    wanted = old.unionByName(new)
    few = wanted.limit(SENT_FIELDS + 1).collect()
    if len(few) <= SENT_FIELDS:
        wanted = F.broadcast(long.sparkSession.createDataFrame([tuple(r) for r in few], wanted.schema))
    values = long.filter("fund is not null and weight is not null").withColumnRenamed("file_seq", "at").join(wanted, ["feed", "at", "field"])
    each = values.groupBy("feed", "step", "fund", "role", "field").agg(F.avg("weight").alias("w"))
    rows = each.groupBy("feed", "step", "fund").agg(*(F.collect_list(F.when(F.col("role") == k, F.struct("field", "w"))).alias(n) for k, n in enumerate(("old", "new"))))
    both = rows.select("feed", "step", F.explode("old").alias("o"), "new").select("feed", "step", "o", F.explode("new").alias("n")).select("feed", F.col("step").alias("file_seq"), F.col("o.field").alias("field"), F.col("o.w").alias("w0"), F.col("n.field").alias("new_field"), F.col("n.w").alias("w1")).filter("w0 <> 0 or w1 <> 0")
    near = F.abs(F.col("w0") - F.col("w1")) <= F.greatest(F.lit(CLOSE_POINTS), CLOSE_SHARE * F.greatest(F.abs("w0"), F.abs("w1")))
    return both.groupBy("feed", "file_seq", "field", "new_field").agg(F.count("*").alias("sources"), F.count_if(near).alias("agree"))


# --- the tree edit distance of one step ----------------------------------------------------------


def assign(cost: np.ndarray) -> list[int]:
    """Column of each row in a minimum-cost assignment of a square matrix (shortest augmenting paths)."""
    n = len(cost)
    u, v, owner = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, dtype=int)
    for row in range(1, n + 1):
        owner[0], col = row, 0
        best, via, used = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=int), np.zeros(n + 1, dtype=bool)
        while True:
            used[col] = True
            free = np.flatnonzero(~used[1:]) + 1
            new = cost[owner[col] - 1, free - 1] - u[owner[col]] - v[free]
            nearer = new < best[free]
            best[free[nearer]], via[free[nearer]] = new[nearer], col
            nxt = free[np.argmin(best[free])]
            d = best[nxt]
            u[owner[used]] += d
            v[used] -= d
            best[free] -= d
            col = nxt
            if not owner[col]:
                break
        while col:
            owner[col] = owner[via[col]]
            col = via[col]
    out = [0] * n
    for c in range(1, n + 1):
        out[owner[c] - 1] = c - 1
    return out


def tree(fields: list[str]) -> dict:
    """Nested dict of paths."""
    root: dict = {}
    for f in fields:
        at = root
        for part in f.split("."):
            at = at.setdefault(part, {})
    return root


def size(t: dict) -> int:
    return sum(1 + size(x) for x in t.values())


def leaves(t: dict, path: str = "") -> list[str]:
    return [x for k, v in t.items() for x in (leaves(v, f"{path}{k}.") if v else [f"{path}{k}"])]


def edit(old: dict, new: dict, agree: dict[tuple[str, str], float], at: tuple[str, str] = ("", "")) -> tuple[float, list[tuple[str, str, str]]]:
    """Cost and script of the least edit of one tree into the other: (change, path, new path) of leaves."""
    same = [k for k in old if k in new]
    gone, come = sorted(k for k in old if k not in new), sorted(k for k in new if k not in old)
    total, script = 0.0, []
    for k in same:
        c, s = edit(old[k], new[k], agree, (f"{at[0]}{k}.", f"{at[1]}{k}."))
        if bool(old[k]) != bool(new[k]):  # a leaf became an object or the other way
            s = [x for x in s if x[0] != "kept"]
        total, script = total + c, script + s
    n = len(gone) + len(come)
    if n:
        cost, scripts = np.zeros((n, n)), {}
        for i, a in enumerate(gone):
            for j, b in enumerate(come):
                pa, pb = at[0] + a, at[1] + b
                if not old[a] and not new[b]:
                    scripts[i, j] = (RENAME_COST * (1 - agree.get((pa, pb), 0.0)), [("renamed", pa, pb)])
                else:
                    c, s = edit(old[a], new[b], agree, (pa + ".", pb + "."))
                    kept = [("renamed", pa + x[len(pa) :], pb + x[len(pa) :]) for x in leaves({a: {k: v for k, v in old[a].items() if k in new[b]}}, at[0]) if "." in x[len(at[0]) :]]
                    scripts[i, j] = (1.0 + c, kept + s)
                cost[i, j] = scripts[i, j][0]
            cost[i, len(come) :] = 1 + size(old[a])
        for j, b in enumerate(come):
            cost[len(gone) :, j] = 1 + size(new[b])
        cols = assign(cost)
        for i, j in enumerate(cols):
            if i < len(gone) and j < len(come) and cost[i, j] < 2 + size(old[gone[i]]) + size(new[come[j]]):
                script += scripts[i, j][1]
            else:
                if i < len(gone):
                    script += [("removed", x, "") for x in leaves({gone[i]: old[gone[i]]}, at[0])]
                if j < len(come):
                    script += [("added", x, "") for x in leaves({come[j]: new[come[j]]}, at[1])]
            total += cost[i, j]
    return total, script


def with_moves(script: list[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    """A field deleted under one parent and added under another keeps its name: moved (flat schemas have none).

    Where several parents lost or got a field of one name, they are paired in order of their paths.
    """
    name = lambda p: p.rsplit(".", 1)[-1]
    gone: dict[str, list[str]] = {}
    for c, p, _ in sorted(script):
        if c == "removed":
            gone.setdefault(name(p), []).append(p)
    moved = {}
    for c, p, _ in sorted(script):
        if c == "added" and gone.get(name(p)):
            moved[p] = gone[name(p)].pop(0)
    left = set(moved.values())
    return [("moved", moved[p], p) if c == "added" and p in moved else (c, p, q) for c, p, q in script if not (c == "removed" and p in left)]


def agreement(proof) -> dict[tuple[str, str], float]:
    """Share of sources that agree, by old and new field; a pair of fewer than ``LEAST_SOURCES`` counts only if it is without doubt."""
    pairs = {(p["field"], p["new_field"]): (p["agree"], p["sources"]) for p in proof}
    out = {}
    for (f, g), (agree, sources) in pairs.items():
        rival = any(a for (x, y), (a, _) in pairs.items() if (x == f) != (y == g))
        out[f, g] = agree / sources if sources >= LEAST_SOURCES or (agree == sources and not rival) else 0.0
    return out


CHANGES = "feed string, file_seq int, change string, field string, new_field string"


def changes(fields: DataFrame, long: DataFrame) -> DataFrame:
    """The script of every step: feed, file_seq (of the later file), change, field, new_field (empty unless renamed or moved)."""
    steps = cut(steps_of(fields))  # a row per file
    proof = evidence(long, steps).groupBy("feed", "file_seq").agg(F.collect_list(F.struct("field", "new_field", "sources", "agree")).alias("proof"))
    rows = steps.select("feed", "file_seq", "before", "after", "left", "entered").join(proof, ["feed", "file_seq"], "left")

    def scripts(batches):
        for pdf in batches:
            out = []
            for feed, seq, before, after, proof in zip(pdf["feed"], pdf["file_seq"], pdf["before"], pdf["after"], pdf["proof"], strict=True):
                old, new = {x["field"]: x["type"] for x in before}, {x["field"]: x["type"] for x in after}
                agree = agreement(proof if proof is not None else ())
                _, script = edit(tree(list(old)), tree(list(new)), agree)
                script = with_moves(script) + [("retyped", f, "") for f in old if f in new and old[f] and new[f] and old[f] != new[f]]
                out += [(feed, seq, *x) for x in script]
            yield pd.DataFrame(out, columns=["feed", "file_seq", "change", "field", "new_field"])

    return rows.select("feed", "file_seq", "before", "after", "proof").mapInPandas(scripts, CHANGES)


def projections(fields: DataFrame, report: DataFrame) -> DataFrame:
    """Compiled scripts: feed, file_seq, field, canonical (the field's name in the latest file that has it).

    Only the renamings of a feed, which are few, are followed one after the other; its files and fields are joined
    with what they come to: a name means what its first renaming after the file leads to.
    """

    def compiled(pdf: pd.DataFrame) -> pd.DataFrame:
        later: dict[str, str] = {}
        out = []
        for seq, step in sorted(pdf.groupby("file_seq"), reverse=True):  # from the last file back
            here = {f: later.get(g, g) for f, g in zip(step["field"], step["new_field"], strict=True)}
            later |= here
            out += [(pdf["feed"].iloc[0], f, seq, c) for f, c in here.items()]
        return pd.DataFrame(out, columns=["feed", "field", "seq", "canonical"])

    renamed = report.filter("change in ('renamed', 'moved')").groupBy("feed").applyInPandas(compiled, "feed string, field string, seq int, canonical string")
    both = fields.select("feed", "file_seq", "field").join(renamed.withColumnRenamed("seq", "until"), ["feed", "field"], "left").filter("until is null or until > file_seq or canonical is not null")
    after = F.when(F.col("until") > F.col("file_seq"), F.col("until"))
    return both.groupBy("feed", "file_seq", "field").agg(F.coalesce(F.min_by("canonical", after), F.col("field")).alias("canonical"))


class Drift:
    """Fields, changes and the consistent table of raw files and wide tables.

    Raw records: feed, file_seq and a JSON payload; repeated lines count once, broken lines, null
    payloads and lines that aren't an object not at all. Fields named only with nulls belong to the file
    but have no type. Files follow each other by file_seq, whatever their delivery; a file without a
    readable record is no file. Empty tables: no rows for raw files, and the fields of its columns for a
    wide table. Columns beside feed, file_seq and payload are ignored.
    """

    def __init__(self, raw: DataFrame, tables: list[DataFrame], depth: int = 1) -> None:
        records = cut(raw_long(raw, depth))
        self.fields, self.long = fields_of(records), records
        if tables:
            self.fields = self.fields.unionByName(table_fields(raw.sparkSession, tables))
            self.long = records.unionByName(table_long(tables))
        self.fields = cut(self.fields)  # a row per file and field

    def report(self) -> DataFrame:
        return changes(self.fields, self.long)

    def table(self) -> DataFrame:
        """feed, file_seq, fonkodu, tarih, field (canonical), source_field, weight; one row per record and field named."""
        where = projections(self.fields, cut(self.report()))
        out = self.long.join(where, ["feed", "file_seq", "field"])
        return out.select("feed", "file_seq", F.col("fund").alias("fonkodu"), F.col("day").alias("tarih"), F.col("canonical").alias("field"), F.col("field").alias("source_field"), "weight")
