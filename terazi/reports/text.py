"""Number formats and translations of labels."""

from __future__ import annotations

# The English labels on the left are those the engine emits; the Turkish on the right is free wording, of which only
# single words (Pozitif, Hisse, Altın) have no other natural form.
WORDS = {
    "Positive": "Pozitif", "Negative": "Negatif", "Neutral": "Nötr", "Unknown": "Bilinmiyor", "Market": "Piyasa", "Flow": "Akım",
    "Neutral / negligible": "Önemsiz", "Small": "Hafif", "Moderate": "Orta", "Strong": "Kuvvetli", "Very Strong": "Pek Kuvvetli", "Extreme": "Uç",
    "Small AUM": "Ufak Hacimli", "Mid AUM": "Orta Hacimli", "Large AUM": "İri Hacimli", "Mega AUM": "Dev Hacimli",
    "Small Participant Base": "Az Yatırımcılı", "Mid Participant Base": "Orta Sayıda Yatırımcılı", "Large Participant Base": "Çok Yatırımcılı", "Mega Participant Base": "Kitlesel Yatırımcılı",
    "High dominance": "tek eğilim hâkim", "Moderate dominance": "bir eğilim önde", "Weak dominance": "hafif bir eğilim", "Fragmented": "eğilim yok",
    "Participation": "Katılım", "Conventional": "Faizli", "Mixed": "Karma", "Conservative": "Temkinli", "Balanced": "Dengeli", "Aggressive": "Cesur", "Specialised": "Tek Alana Odaklı",
    "TRY Weighted": "Lirası Çok", "FX Weighted": "Dövizi Çok", "Gold Weighted": "Altını Çok", "Mixed Currency": "Kurları Karışık",
    "Transparent": "İçi Görünür", "Partial Look-through": "İçi Kısmen Görünür", "Heavy Look-through": "İçi Görünmez",
    "Equity": "Hisse", "Foreign Equity": "Yabancı Hisse", "Fixed Income": "Borçlanma", "Lease Certificates": "Kira Sertifikası", "Money Market": "Para Piyasası", "Money Market / Collateral": "Para Piyasası / Teminat",
    "Deposit": "Mevduat", "Participation Account": "Katılma Hesabı", "Precious Metals": "Kıymetli Maden", "Fund": "Fon Payı", "ETF": "Borsa Fonu", "Foreign ETF": "Yabancı Borsa Fonu",
    "Real Estate / Alternative": "Taşınmaz / Alternatif", "Venture Capital / Alternative": "Girişim / Alternatif", "Foreign Securities": "Yabancı Kıymet", "Derivatives": "Türev", "Other": "Diğer",
    "Fund of Funds": "Fonların Fonu", "Alternative": "Alternatif", "Multi-Asset": "Birden Çok Varlık", "Unclassified": "Sınıfı Yok",
    "Domestic": "Yerli", "Foreign / International": "Yabancı", "Look-through Required": "İçine Bakılmalı", "Commodity / Global Pricing": "Dünya Fiyatlı Emtia", "Other / Unknown": "Diğer ya da Belirsiz", "Operational / Cash-like": "Nakit ve Benzeri",
    "TRY": "TRY", "FX": "Döviz", "Gold": "Altın", "Mixed / Unknown": "Karışık ya da Belirsiz", "Operational / Collateral": "Nakit ve Teminat",
    "Gold / Precious Metals Fund": "Altın ve Maden Fonu", "FX / Eurobond Fixed-Income Fund": "Dövizli Borçlanma Fonu", "Foreign Equity Fund": "Yabancı Hisse Fonu", "Domestic Equity Fund": "Yerli Hisse Fonu", "Money Market Fund": "Para Piyasası Fonu",
    "Fixed-Income Fund": "Borçlanma Fonu", "Domestic Fixed-Income Fund": "Yerli Borçlanma Fonu", "Foreign Fixed-Income Fund": "Yabancı Borçlanma Fonu", "Fixed-Income Dominant Multi-Asset Fund": "Çoğu Borçlanma Olan Karma Fon",
    "Domestic Fixed-Income Dominant Multi-Asset Fund": "Çoğu Yerli Borçlanma Olan Karma Fon", "Foreign Fixed-Income Dominant Multi-Asset Fund": "Çoğu Yabancı Borçlanma Olan Karma Fon",
    "Multi-Asset / Mixed Allocation Fund": "Karma Fon", "Fund Allocation Dominant Fund": "Çoğu Fon Payı Olan Fon", "Unknown Fund Type": "Türü Belirsiz Fon",
    "Neutral flow with participant growth": "para yerinde, yatırımcı arttı", "Neutral flow with participant decline": "para yerinde, yatırımcı azaldı", "Neutral flow regime": "para da yatırımcı da yerinde", "Unknown flow regime": "akım belirsiz",
    "net inflow with participant growth": "para girdi, yatırımcı arttı", "net inflow without participant growth": "para girdi, yatırımcı azaldı", "net inflow with stable participant count": "para girdi, yatırımcı aynı",
    "net outflow despite participant growth": "para çıktı, yatırımcı yine de arttı", "net outflow with participant decline": "para çıktı, yatırımcı azaldı", "net outflow with stable participant count": "para çıktı, yatırımcı aynı",
    "run": "kaçış", "shock": "şok", "manual": "elle verilen",
}


def translate(label: str | None, language: str) -> str:
    """A label in the language; composed labels by their parts; what has no translation stays."""
    if label is None:
        return "-"
    if language != "tr" or label in WORDS:
        return label if language != "tr" else WORDS[label]
    if " Market / " in label and label.endswith(" Flow"):
        m, f = label[: -len(" Flow")].split(" Market / ")
        return f"Piyasa {translate(m, language)}, Akım {translate(f, language)}"
    for size in ("Neutral / negligible", "Small", "Moderate", "Strong"):
        if label.startswith(size + " net "):
            return f"{translate(size, language)} ölçüde {translate(label[len(size) + 1 :], language)}"
    if label.startswith("Multi-Asset (") and label.endswith(")"):
        return "Karma (" + " / ".join(translate(x, language) for x in _pair(label[len("Multi-Asset (") : -1])) + ")"
    for tail, tr in ((" Weighted", " Çoğunlukta"), (" Tilted", " Yönlü"), (" Dominant Fund", " Önde Olan Fon")):
        if label.endswith(tail):
            return translate(label[: -len(tail)], language) + tr
    return label


def _pair(text: str) -> list[str]:
    """Two group names joined by a slash, of which either may hold one."""
    at = [i for i in range(len(text)) if text.startswith(" / ", i)]
    best = next((i for i in at if text[:i] in WORDS and text[i + 3 :] in WORDS), at[0] if at else len(text))
    return [text[:best], text[best + 3 :]]


def number(x: float | None, digits: int = 0, language: str = "en") -> str:
    if x is None or x != x:
        return "-"
    s = f"{x:,.{digits}f}"
    return s.translate(str.maketrans(",.", ".,")) if language == "tr" else s


def percent(x: float | None, language: str = "en", digits: int = 2) -> str:
    """Share given as a decimal: 12.34% or %12,34."""
    if x is None or x != x:
        return "-"
    s = number(abs(x) * 100, digits, language)
    sign = "-" if x < 0 and s.strip("0.,") else ""
    return f"{sign}%{s}" if language == "tr" else f"{sign}{s}%"


def money(x: float | None, language: str = "en") -> str:
    """Amount with its unit: 2.71 billion TL or 2,71 milyar TL."""
    if x is None or x != x:
        return "-"
    for size, en, tr in ((1e12, "trillion", "trilyon"), (1e9, "billion", "milyar"), (1e6, "million", "milyon")):
        if abs(x) >= size:
            return f"{number(x / size, 2, language)} {tr if language == 'tr' else en} TL"
    return f"{number(x, 0, language)} TL"


def markdown_table(head: list[str], rows: list[list[str]]) -> str:
    return "\n".join(["| " + " | ".join(head) + " |", "|" + "---|" * len(head), *("| " + " | ".join(r) + " |" for r in rows)])
