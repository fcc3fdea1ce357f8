"""Column builders for guarded arithmetic and the labels of the analyses. Missing values are NULL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def div(a: Column, b: Column) -> Column:
    """a / b; null if either is null or b is 0."""
    return a / F.nullif(b, F.lit(0.0))


def yes(c: Column) -> Column:
    """A predicate that is false where it is unknown."""
    return F.coalesce(c, F.lit(False))


def steps(x: Column, edges: list[float], labels: list[str], unknown: str | None = "Unknown") -> Column:
    """Label of the half-open interval [edge, next edge) that holds x."""
    c = F.when(x.isNull(), F.lit(unknown))
    for e, label in zip(edges, labels, strict=False):
        c = c.when(x < e, label)
    return c.otherwise(labels[-1])


def magnitude(x: Column) -> Column:
    return steps(F.abs(x), [0.0005, 0.0025, 0.01], ["Neutral / negligible", "Small", "Moderate", "Strong"])


def direction(x: Column, neutral: float = 0.0005) -> Column:
    """Strictly beyond the neutral zone: exactly at its edge is Neutral."""
    return F.when(x.isNull(), "Unknown").when(x > neutral, "Positive").when(x < -neutral, "Negative").otherwise("Neutral")


def intensity(flow: Column) -> Column:
    return steps(F.abs(flow), [0.0005, 0.0025, 0.01, 0.05, 0.25], ["Neutral", "Small", "Moderate", "Strong", "Very Strong", "Extreme"])


def aum_segment(aum: Column, edges: tuple = (1e8, 1e9, 1e10)) -> Column:
    return steps(aum, list(edges), ["Small AUM", "Mid AUM", "Large AUM", "Mega AUM"])


def holder_segment(holders: Column, edges: tuple = (1e3, 1e4, 1e5)) -> Column:
    return steps(holders, list(edges), ["Small Participant Base", "Mid Participant Base", "Large Participant Base", "Mega Participant Base"])


def dominance(share: Column) -> Column:
    return steps(share, [0.35, 0.50, 0.75], ["Fragmented", "Weak dominance", "Moderate dominance", "High dominance"])


def quadrant(market: Column, flow: Column, neutral: float = 0.0005) -> Column:
    """Directions of market effect and flow; either unknown makes both unknown."""
    m, f = direction(market, neutral), direction(flow, neutral)
    return F.when(market.isNull() | flow.isNull(), "Unknown Market / Unknown Flow").otherwise(F.concat(m, F.lit(" Market / "), f, F.lit(" Flow")))


def flow_regime(flow: Column, holder_change: Column) -> Column:
    """Direction and size of the flow with the change of holders; an unknown change counts as none."""
    d, size = direction(flow), magnitude(flow)
    up, down = yes(holder_change > 0), yes(holder_change < 0)
    by = lambda a, b, c: F.when(up, a).when(down, b).otherwise(c)
    tail_in = by(" net inflow with participant growth", " net inflow without participant growth", " net inflow with stable participant count")
    tail_out = by(" net outflow despite participant growth", " net outflow with participant decline", " net outflow with stable participant count")
    return (
        F.when(d == "Neutral", by("Neutral flow with participant growth", "Neutral flow with participant decline", "Neutral flow regime"))
        .when(d == "Positive", F.concat(size, tail_in)).when(d == "Negative", F.concat(size, tail_out)).otherwise("Unknown flow regime")
    )


def archetype(broad, scope, currency, top_group: Column, top_weight: Column) -> Column:
    """The first rule of the chain that holds. ``broad``, ``scope``, ``currency``: functions from a group to its weight."""
    fixed, equity, fx = broad("Fixed Income"), broad("Equity"), currency("FX")
    domestic, foreign, through = scope("Domestic"), scope("Foreign / International"), scope("Look-through Required")
    others = ("Equity", "Foreign Equity", "Deposit", "Participation Account", "Lease Certificates", "Fund", "ETF", "Real Estate / Alternative", "Venture Capital / Alternative")
    side = reduce(lambda a, b: a + b, (broad(g) for g in others)) + through
    mixed = (side >= 20) | (equity >= 10) | (through >= 10)
    place = lambda tail: F.when(domestic >= 50, F.lit("Domestic " + tail)).when(foreign >= 50, F.lit("Foreign " + tail)).otherwise(F.lit(tail))
    return (
        F.when(top_group.isNull(), "Unknown Fund Type")
        .when((broad("Precious Metals") >= 50) | (currency("Gold") >= 50), "Gold / Precious Metals Fund")
        .when((fx >= 50) & (fixed >= 50), "FX / Eurobond Fixed-Income Fund")
        .when(broad("Foreign Equity") >= 50, "Foreign Equity Fund")
        .when(equity >= 50, "Domestic Equity Fund")
        .when(broad("Money Market") >= 50, "Money Market Fund")
        .when((fixed >= 50) & mixed, place("Fixed-Income Dominant Multi-Asset Fund"))
        .when(fixed >= 50, place("Fixed-Income Fund"))
        .when(top_weight < 50, "Multi-Asset / Mixed Allocation Fund")
        .when(top_group == "Fund", "Fund Allocation Dominant Fund")
        .otherwise(F.concat(top_group, F.lit(" Dominant Fund")))
    )


def founder(title: Column) -> Column:
    """The company at the front of a fund's title: up to PORTFÖY, PYŞ or before A.Ş., whichever ends first; else the first word."""
    t = F.trim(title)
    at = [F.regexp_extract(t, p, 0) for p in (r"(?U)^(.*?\bPORTFÖY)\b", r"(?U)^(.*?\bPYŞ)\b", r"(?U)^(.*?)\s+A\.Ş\.")]
    got = [F.regexp_extract(t, p, 1) for p in (r"(?U)^(.*?\bPORTFÖY)\b", r"(?U)^(.*?\bPYŞ)\b", r"(?U)^(.*?)\s+A\.Ş\.")]
    best = F.array_min(F.array(*(F.when(F.length(a) > 0, F.struct(F.length(a).alias("n"), F.lit(i).alias("i"), g.alias("name"))) for i, (a, g) in enumerate(zip(at, got, strict=True)))))
    return F.when(title.isNull(), F.lit(None)).otherwise(F.coalesce(best["name"], F.split_part(t, F.lit(" "), F.lit(1))))


def slug(name: Column) -> Column:
    """Lower-case ASCII words joined by hyphens."""
    folded = F.lower(F.translate(name, "çÇğĞıİöÖşŞüÜâÂîÎûÛ", "ccggiioossuuaaiiuu"))
    return F.btrim(F.regexp_replace(folded, "[^a-z0-9]+", "-"), F.lit("-"))


def column_name(name: Column) -> Column:
    """Safe column name: lower case, runs of other characters become one underscore."""
    return F.btrim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), F.lit("_"))


def day_of(text: Column) -> Column:
    """Date of an ISO or a day-first text; null if it is neither."""
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(text, F.lit("dd.MM.yyyy")), F.try_to_timestamp(text, F.lit("dd/MM/yyyy")), F.try_to_timestamp(text, F.lit("yyyyMMdd"))).cast("date")
