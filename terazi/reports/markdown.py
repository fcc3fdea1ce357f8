"""Market, selection, classification and stress reports as Markdown. Only their few rows reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terazi.config import ClassificationConfig
from terazi.operators import lens as ln
from terazi.operators.classifier import Model, class_summary, describe
from terazi.operators.combine import low_confidence, most_frequent
from terazi.operators.stress import Stress
from terazi.reports.text import markdown_table, money, number, percent, translate

# Headings and column heads in both languages.
TEXT = {
    "en": {
        "market": "Market report", "overview": "Overview", "funds": "Funds", "start": "Start size", "end": "End size", "flow": "Net flow", "effect": "Market effect", "share": "Share", "by": "By", "archetype": "fund type", "quadrant": "market and flow",
        "segment": "size", "inflows": "Largest inflows", "outflows": "Largest outflows", "dominant": "Dominant regimes", "strength": "Strength", "fund": "Fund", "type": "Type", "regime": "Regime", "return": "Return", "selected": "Selected funds",
        "classes": "Classification", "class": "Class", "confidence": "Confidence", "stability": "Stability", "content": "Composition", "quality": "Model", "drift": "Largest drift", "axes": "Axes", "stress": "Stress signals", "event": "Event", "none": "No event", "founder": "Founder", "stressed": "Stressed size", "after": "Flow after", "low": "Low confidence",
        "sentence": "Size changed by {change}: {flow} from flows and {effect} from markets.",
    },
    "tr": {
        "market": "Piyasa raporu", "overview": "Genel görünüm", "funds": "Fon", "start": "Başlangıç büyüklüğü", "end": "Bitiş büyüklüğü", "flow": "Net akış", "effect": "Piyasa etkisi", "share": "Pay", "by": "Kırılım:", "archetype": "fon türü", "quadrant": "piyasa ve akış",
        "segment": "büyüklük", "inflows": "En büyük girişler", "outflows": "En büyük çıkışlar", "dominant": "Baskın rejimler", "strength": "Güç", "fund": "Fon", "type": "Tür", "regime": "Rejim", "return": "Getiri", "selected": "Seçilen fonlar",
        "classes": "Sınıflandırma", "class": "Sınıf", "confidence": "Güven", "stability": "İstikrar", "content": "Bileşim", "quality": "Model", "drift": "En büyük kayma", "axes": "Eksenler", "stress": "Stres sinyalleri", "event": "Olay", "none": "Olay yok", "founder": "Kurucu", "stressed": "Stresli büyüklük", "after": "Sonraki akış", "low": "Düşük güven",
        "sentence": "Büyüklük {change} değişti: {flow} akıştan, {effect} piyasadan.",
    },
}


def _t(language: str) -> dict[str, str]:
    return TEXT["tr" if language == "tr" else "en"]


def _summary(lens: DataFrame, column: str, language: str) -> str:
    """A row per label of the column; labels come from fixed lists, so there are a few dozen at most."""
    t = _t(language)
    rows = [[translate(r[column], language), number(r["fund_count"], 0, language), money(r["total_start_aum"], language), percent(r["start_aum_share"], language), percent(r["weighted_flow_pct"], language), percent(r["weighted_market_effect_pct"], language)] for r in ln.summary_by(lens, column).collect()]
    return markdown_table([t["type"], t["funds"], t["start"], t["share"], t["flow"], t["effect"]], rows)


def _funds(rows: DataFrame, language: str) -> str:
    t = _t(language)
    cells = [[r["fund_code"], translate(r["archetype"], language), money(r["start_aum"], language), percent(r["flow_pct"], language), percent(r["market_effect_pct"], language), percent(r["cumulative_return"], language), translate(r["flow_regime"], language)] for r in rows.collect()]
    return markdown_table([t["fund"], t["type"], t["start"], t["flow"], t["effect"], t["return"], t["regime"]], cells)


def market_report(lens: DataFrame, language: str = "en", n: int = 20) -> str:
    """Overview, summaries by type, regime and size, extremes and dominant regimes of the valid funds."""
    t = _t(language)
    lens = lens.filter("is_valid").cache()
    try:
        s = ln.universe_summary(lens).first()
        parts = [f"# {t['market']}", f"## {t['overview']}", f"{t['funds']}: {number(s['fund_count'], 0, language)}"]
        if s["total_start_aum"]:
            a = s["total_start_aum"]
            parts.append(t["sentence"].format(change=percent(s["total_end_aum"] / a - 1, language), flow=percent(s["total_net_flow"] / a, language), effect=percent(s["total_market_effect"] / a, language)))
        for c, k in (("archetype", "archetype"), ("market_flow_quadrant", "quadrant"), ("aum_segment", "segment")):
            parts += [f"## {t['by']} {t[k]}", _summary(lens, c, language)]
        parts += [f"## {t['inflows']}", _funds(ln.top_inflows(lens, n), language), f"## {t['outflows']}", _funds(ln.top_outflows(lens, n), language)]
        d = [[translate(r[0], language), translate(r[1], language), percent(r[2], language), translate(r[3], language)] for r in ln.dominant(lens).collect()]
        parts += [f"## {t['dominant']}", markdown_table([t["type"], t["regime"], t["share"], t["strength"]], d)]
        return "\n\n".join(parts) + "\n"
    finally:
        lens.unpersist()


def selected_report(lens: DataFrame, codes: list[str], language: str = "en") -> str:
    return f"# {_t(language)['selected']}\n\n{_funds(ln.selected(lens, codes), language)}\n"


def classification_report(model: Model, classified: DataFrame, language: str = "en", config: ClassificationConfig = ClassificationConfig(), n: int = 10) -> str:
    """Classes with their family and composition, axes, model quality, funds of low confidence and the largest drifts."""
    t = _t(language)
    content = dict(zip(model.names, (describe(c, model.features) for c in model.centroids), strict=True))
    kin = {r[0]: r[1] for r in most_frequent(classified, "class_name", "family").collect()}
    rows = [[translate(r["class_name"], language), translate(kin.get(r["class_name"]), language), number(r["funds"], 0, language), percent(r["fund_share"], language), number(r["avg_confidence"], 2, language), number(r["avg_stability"], 2, language), content.get(r["class_name"], "-")] for r in class_summary(classified).collect()]
    parts = [f"# {t['classes']}", markdown_table([t["class"], t["type"], t["funds"], t["share"], t["confidence"], t["stability"], t["content"]], rows), f"## {t['axes']}"]
    for axis in ("participation_class", "risk_band", "currency_band", "lookthrough_band"):
        counts = classified.groupBy(axis).count().orderBy(F.desc("count"), axis).collect()
        parts.append(", ".join(f"{translate(r[0], language)}: {r[1]}" for r in counts))
    unsure = low_confidence(classified, config).collect()  # a row per class
    parts += [f"## {t['quality']}", f"{model.method}, k = {len(model.names)}" + (f", silhouette {number(model.silhouette, 3, language)}" if model.silhouette is not None else "") + f". {t['low']} (< {number(config.low_confidence_threshold, 2, language)}): {sum(r['low'] for r in unsure)}."]
    parts += ["; ".join(f"{translate(r['class_name'], language)}: {r['low']} / {r['funds']}" for r in sorted(unsure, key=lambda r: r["class_name"]))]
    faint = classified.filter(F.col("confidence") < config.low_confidence_threshold).orderBy("confidence", "fund_code").limit(n).collect()
    if faint:
        parts += [f"## {t['low']}", markdown_table([t["fund"], t["class"], t["confidence"]], [[r["fund_code"], translate(r["class_name"], language), number(r["confidence"], 2, language)] for r in faint])]
    top = classified.filter("style_drift is not null").orderBy(F.desc("style_drift"), "fund_code").limit(n).collect()
    parts += [f"## {t['drift']}", markdown_table([t["fund"], t["class"], "L1"], [[r["fund_code"], translate(r["class_name"], language), number(r["style_drift"], 1, language)] for r in top])]
    return "\n\n".join(parts) + "\n"


def stress_report(signals: Stress, language: str = "en", n: int = 20) -> str:
    t = _t(language)
    e = signals.event.first()
    rows = [[r["founder"] or "-", number(r["funds"], 0, language), money(r["start_aum"], language), money(r["stressed_aum"], language), percent(r["flow_after"], language)] for r in signals.founders.limit(n).collect()]
    event = f"{t['event']}: {e['event_date']} ({translate(e['event_kind'], language)})" if e else t["none"]
    return "\n\n".join([f"# {t['stress']}", event, markdown_table([t["founder"], t["funds"], t["start"], t["stressed"], t["after"]], rows)]) + "\n"


def fund_sentences(r, language: str = "en") -> str:
    """One fund of the universe in a sentence or two."""
    flow, effect = percent(r["flow_pct"], language), percent(r["market_effect_pct"], language)
    if language == "tr":
        return f"{r['fund_code']} ({translate(r['archetype'], 'tr')}): {_t('tr')['sentence'].format(change=percent(r['aum_change_pct'], 'tr'), flow=flow, effect=effect)} {translate(r['flow_regime'], 'tr')}."
    return f"{r['fund_code']} ({r['archetype']}): {_t('en')['sentence'].format(change=percent(r['aum_change_pct']), flow=flow, effect=effect)} {r['flow_regime']}."
