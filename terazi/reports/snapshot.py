"""One fund's snapshot and short comments on groups, in English and Turkish."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terazi.config import LensConfig
from terazi.operators import dna
from terazi.operators import lens as ln
from terazi.reports.text import markdown_table, money, number, percent, translate


def fund_snapshot(panel: DataFrame, allocation: DataFrame, code: str, config: LensConfig = LensConfig()) -> dict | None:
    """Window totals, labels and the DNA tables of a fund (code in any case); None if it lacks days or an allocation.

    The fund is filtered before anything is computed, so only its own rows are read.
    """
    code = code.strip().upper()
    own, weights = panel.filter(F.col("fund_code") == code), allocation.filter(F.col("fund_code") == code)
    row = ln.universe(own, weights, config).first()
    if row is None:
        return None
    latest = dna.latest_allocation(weights)
    tables = {g: [(r["grp"], r["weight"]) for r in dna.exposures(latest, g, n).orderBy("pos").collect()] for g, n in (("broad", 10), ("scope", 6), ("currency", 7))}
    return row.asDict() | {"tables": tables}


def snapshot_text(s: dict, language: str = "en") -> str:
    """Markdown of a snapshot: what it holds, what moved it, what its holders did."""
    tr = language == "tr"
    top = s["tables"]["broad"][0] if s["tables"]["broad"] else ("Unknown", 0.0)
    holds = f"{translate(top[0], language)} {percent(top[1] / 100, language, 1)}"
    lines = [
        f"# {s['fund_code']} {s['fund_name'] or ''}".rstrip(),
        f"{translate(s['archetype'], language)}; " + (f"en büyük varlık {holds}." if tr else f"largest exposure {holds}."),
        (f"Büyüklük {money(s['start_aum'], 'tr')} iken {money(s['end_aum'], 'tr')} oldu ({percent(s['aum_change_pct'], 'tr')}): piyasa {percent(s['market_effect_pct'], 'tr')}, akış {percent(s['flow_pct'], 'tr')}."
         if tr else f"Size went from {money(s['start_aum'])} to {money(s['end_aum'])} ({percent(s['aum_change_pct'])}): market {percent(s['market_effect_pct'])}, flow {percent(s['flow_pct'])}."),
        f"{translate(s['flow_regime'], language)}; " + (f"katılımcı {number(s['start_holders'], 0, 'tr')} → {number(s['end_holders'], 0, 'tr')}." if tr else f"holders {number(s['start_holders'])} → {number(s['end_holders'])}."),
    ]
    if s["lookthrough_weight"] and s["lookthrough_weight"] >= 10:
        lines.append("Portföyün bir kısmı başka fonlarda, görünmüyor." if tr else "Part of the portfolio lies in other funds and can't be seen through.")
    for g, title in (("broad", ("Assets", "Varlıklar")), ("scope", ("Scope", "Kapsam")), ("currency", ("Currency", "Para birimi"))):
        lines += [f"## {title[tr]}", markdown_table([title[tr], "%"], [[translate(k, language), number(w, 2, language)] for k, w in s["tables"][g]])]
    return "\n\n".join(lines) + "\n"


def group_comments(lens: DataFrame, column: str, language: str = "en", n: int = 3) -> list[str]:
    """Sentences on the groups with the largest inflow and outflow for their size, and on the largest group."""
    groups = ln.summary_by(lens, column)
    rows = groups.limit(1).collect()  # the largest comes first
    if not rows:
        return []
    tr = language == "tr"
    ends = lambda key: groups.filter("weighted_flow_pct is not null").orderBy(key, column).limit(n).collect()
    flows, back = ends(F.desc("weighted_flow_pct")), ends(F.asc("weighted_flow_pct"))
    out = [(f"En büyük grup {translate(rows[0][column], 'tr')}: toplamın {percent(rows[0]['start_aum_share'], 'tr')} kadarı." if tr else f"The largest group is {rows[0][column]} with {percent(rows[0]['start_aum_share'])} of the total.")]
    out += [f"{translate(r[column], language)}: " + (f"ağırlıklı akış {percent(r['weighted_flow_pct'], 'tr')}." if tr else f"weighted flow {percent(r['weighted_flow_pct'])}.") for r in flows if r["weighted_flow_pct"] > 0]
    out += [f"{translate(r[column], language)}: " + (f"ağırlıklı akış {percent(r['weighted_flow_pct'], 'tr')}." if tr else f"weighted flow {percent(r['weighted_flow_pct'])}.") for r in back if r["weighted_flow_pct"] < 0]
    return out


def dominance_comments(lens: DataFrame, language: str = "en") -> list[str]:
    """A sentence per fund type on its dominant regime."""
    return [f"{translate(r['archetype'], language)}: {translate(r['dominant_quadrant'], language)}, {percent(r['dominant_quadrant_share'], language)} ({translate(r['dominance_strength'], language)})." for r in ln.dominant(lens).collect()]
