"""Per-document text quality statistics (problem 10).

One Arrow pass computes fourteen statistics of whole texts; line patterns (items, rows of
cells) are two of them, as shares of the text. Each language's prose has a robust mean and
covariance over all statistics: concentration steps from the coordinatewise median and
median deviation, over the half of the documents nearest to it, then reweighting with the
97.5 % ellipsoid. The squared Mahalanobis distance is the sum of the statistics'
contributions, which are reported. A statistic of n tokens has a sampling variance that
falls with n, so distances of short texts are shrunk by n / (n + ``SHORT``).

A document is a case if its distance exceeds ``LIMIT``. Its kind is read off the
contributions: list or table if the share of items or of cells is itself beyond the limit
of one statistic, else junk.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terazi.session import cut, spread

# Frequent words of each language, in alphabetical order.
COMMON = {
    "en": "a about after all also although an and any are as at be because been before but by came can could did do each even for from had has have he her his how if in into is it its many may more most new no nor not of on one only or other our out over say she should since so some such than that the their them then there these they this those though through to two under until up upon us was we were what when where whether which while who why will with would you your",
    "tr": "ama ancak az bazı ben bile bir biri biz bu buna bunu bunun böyle büyük da daha de değil diye diğer dolayı en gibi göre hem hep her hiç iki ile ilk ise için kadar karşı ki kim konusundaki mi mu mı mü nasıl ne neden o olan olarak oldu oldukça olduğu olur on ona onu onun oysa sonra sonunda şey şu tarafında tarihinde tüm var ve veya ya yani yerine yeni yine yok yılının yüzde zaten zira çok çünkü önce üzere",
}
#: The same with and without accents.
FOLDED = {k: {*v.split(), *v.translate(str.maketrans("ıİşğçöüâî", "iisgcouai")).split()} for k, v in COMMON.items()}

#: The statistics of the distance, in order, with the least standard deviation that each is given: below it, differences say
#: nothing about quality (a share of item lines of a quarter, a tenth more of ended lines).
FLOORS = {
    "words_log": 0.3, "word_length": 0.25, "symbol_ratio": 0.01, "digit_ratio": 0.02, "end_punctuation": 0.3, "common_words": 0.03, "line_words_log": 0.6, "list_lines": 0.12, "cell_lines": 0.12, "distinct_words": 0.08,
    "compression": 0.05, "code_words": 0.02, "longest_token_log": 0.15, "voiceless_words": 0.02,
}
STATISTICS = tuple(FLOORS)
#: Squared distance beyond which a text isn't prose; beyond which one statistic's contribution marks the kind.
LIMIT, LIMIT_OF_ONE = 56.0, 6.6
#: Tokens at which the distance of a short text counts half.
SHORT = 10
#: Floors from zero at which the counts of the robust start end.
REACH = 200
#: A document is a case of p10.
CASES = "kind is not null"
#: Documents that a language needs for a mean of its own; below, all languages together serve.
LEAST = 50

WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
BULLET = re.compile(r"\s*(?:[-*+•◦▪▫‣⁃●○■□–—·»>]\s+|\(?\d{1,3}[.)]\s+|\(?[a-zA-Z][.)]\s+|\[[ xX✓]?\]\s+|[☐☑☒✓✗✔]\s*)\S")
LEADER = re.compile(r"\S.*?(?:\.{4,}|(?: \.){4,}|_{4,}|…{2,})\s*\d*\s*$")
SENTENCE_END = re.compile(r"[.!?…:;][\"'”’»)\]]*\s*$")
STOP = re.compile(r"[.!?…][\"'”’»)\]]*\s*$")
LINE = re.compile("[^\n\r\x0b\x0c\x85\u2028\u2029]+")
TURKISH = re.compile("[ışğİŞĞ]")
VOWEL = re.compile("[aeıioöuüâîûyáéíóúàèäAEIİOÖUÜÂÎÛY0-9]|[^\x00-\u024f]")
RULE = re.compile(r"^[\s+\-=|_:│┼├┤┬┴─═╔╗╚╝╠╣╬*~]+$")
CELL_VALUE = re.compile(r"^[-+]?[\d.,%/:-]*\d[\d.,%/:-]*$|^-$|^n/a$|^$", re.I)
CODE = re.compile(r"^(?=.*\d)(?=.*[A-Za-z])[0-9A-Za-z_\-=+/:.]{6,}$|^0x[0-9a-fA-F]+$|^[0-9A-Fa-f]{12,}$|^\d{8,}$")
PAIR = re.compile(r"^[^\W\d]\w*[=:]\S*$")
TAG = re.compile(r"</?t[rdh][^>]*>")
NUMERALS = re.compile(r"\d+")
READ = re.compile(r"[\w\s]")
GAPS = re.compile(r" {2,}")
GAP = re.compile(r" {2,}|\t")


#: Classes of characters: 1 letter, 2 digit, 3 other visible, 0 blank; beyond this table by category.
LETTER, DIGIT, OTHER = 1, 2, 3
CLASSES = np.array([1 if (c := chr(i)).isalpha() else 2 if c.isdigit() else 0 if c.isspace() else 3 for i in range(0x3000)], dtype=np.int8)


def classes(text: str) -> np.ndarray:
    """Class of each code point."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if len(points) and points.max() >= len(CLASSES):
        return np.where(points < len(CLASSES), CLASSES[np.minimum(points, len(CLASSES) - 1)], np.where((points >= 0x1F000) | ((points >= 0xFE00) & (points < 0xFE10)), OTHER, LETTER)).astype(np.int8)
    return CLASSES[points]


def is_value(field: str) -> bool:
    """A number, date, code with digits, dash or nothing, as cells hold."""
    x = field.strip()
    return not x or CELL_VALUE.match(x) is not None or (NUMERALS.search(x) is not None and len(x.split()) <= 2 and sum(c.isalnum() for c in x) >= 0.6 * len(x))


def cells_of(line: str, words: list[str]) -> int:
    """Fields of a row of cells, 1 if the line is none: parted by signs or gaps, and values for two fifths or more."""
    most = len(NUMERALS.findall(line)) + line.count("-") + line.count("/")  # no more fields than this are values, but for empty ones
    for sign in ("</td>", "</th>", "|", "│", "\t", ";"):
        if line.count(sign) >= 2:
            fields = [TAG.sub("", f).strip() for f in line.strip(" |│").split(sign)]
            filled = [f for f in fields if f]
            size = sum(map(len, filled))
            if 0 < size <= 24 * len(fields) and sum(map(is_value, fields)) >= 0.4 * len(fields) and len(READ.findall("".join(filled))) >= 0.65 * size:
                return len(fields)
    if "  " in line.strip():
        fields = GAP.split(line.strip())
        if len(fields) >= 3 and most + fields.count("") >= 0.4 * len(fields) and sum(map(is_value, fields)) >= (0.4 if max(map(len, GAPS.findall(line))) > 2 else 0.6) * len(fields):
            return len(fields)
    if len(words) >= 2 and "=" in line and sum(PAIR.match(w) is not None for w in words) >= max(2, 0.6 * len(words)):
        return max(3, len(words))
    if line.count(",") >= 2:
        fields = line.strip().split(",")
        if most + sum(map(str.isspace, fields)) + fields.count("") >= 0.5 * len(fields) and sum(map(is_value, fields)) >= max(2, 0.5 * len(fields)) and max(len(f.split()) for f in fields) <= 4:
            return len(fields)
    if len(words) >= 3 and most > 0.6 * len(words) and sum(CELL_VALUE.match(w) is not None for w in words) > 0.6 * len(words):
        return len(words)
    return 1


def is_head(line: str) -> bool:
    """A row of column heads: three or more short fields without a sentence's end."""
    if STOP.search(line):
        return False
    for sign in ("</th>", "|", "│", "\t", ";"):
        if line.count(sign) >= 2:
            return len(line) <= 24 * (line.count(sign) + 1)
    return len(GAP.split(line.strip())) >= 3


@lru_cache(maxsize=200_000)
def voiceless(word: str) -> bool:
    return VOWEL.search(word) is None


def is_code(token: str) -> bool:
    return len(token) >= 6 and not token.isalpha() and CODE.match(token.strip(".,;:()[]\"'")) is not None


def line_shares(lines: list[str]) -> tuple[float, float]:
    """Shares of the text, by characters, in lines that are items and in lines that are rows of cells."""
    tokens = [x.split() for x in lines]
    counts = list(map(len, tokens))
    kinds: list[str] = []
    for line, words in zip(lines, tokens, strict=True):
        if RULE.match(line):
            kinds.append("rule")
        elif cells_of(line, words) >= 3:
            kinds.append("cells")
        elif BULLET.match(line) and not (len(words) > 4 and STOP.search(line)) and not (len(words) > 7 and line.lstrip()[0] == "—"):
            kinds.append("item")
        elif ("..." in line or ". . ." in line or "___" in line or "…" in line) and LEADER.match(line):
            kinds.append("item")
        else:
            kinds.append("plain")
    plain = [i for i, k in enumerate(kinds) if k == "plain"]
    # items without marks: short, uneven, not ended, each another one; wrapped sentences fill their lines
    if len(plain) >= 3:
        n, size = np.array([counts[i] for i in plain]), np.array([len(lines[i].strip()) for i in plain])
        ended = np.array([STOP.search(lines[i]) is not None for i in plain])
        even = (np.abs(n[:-1] - np.median(n[:-1])) <= 1).mean() >= 0.7 and np.median(n[:-1]) >= 5
        filled = np.median(size) >= 0.75 * size.max() and np.median(n) >= 5 and size.max() > 50
        short = (n <= 7) & ~ended
        other = len({lines[i].strip() for i in plain}) >= 0.6 * len(plain)
        if other and short.mean() >= 0.6 and not even and not filled and np.median(n[short]) <= 5 and ended.mean() < 0.25:
            for i, s in zip(plain, short, strict=True):
                if s:
                    kinds[i] = "item"
    # heads and rules belong to the cells beside them, a heading to the items below
    for i, k in enumerate(kinds):
        near = kinds[max(0, i - 1) : i + 2]
        if "cells" in near and (k == "rule" or (k == "plain" and is_head(lines[i]))):
            kinds[i] = "cells"
        elif k == "plain" and i + 1 < len(kinds) and kinds[i + 1] in ("item", "cells") and counts[i] <= 5 and not STOP.search(lines[i]):
            kinds[i] = kinds[i + 1]
    weight = {"item": 0, "cells": 0, "rule": 0, "plain": 0}
    for k, x in zip(kinds, lines, strict=True):
        weight[k] += len(x.strip())
    solid = max(1, sum(weight.values()))
    return weight["item"] / solid, weight["cells"] / solid


def statistics(text: str | None, lang: str | None) -> tuple:
    """Language, words, tokens and statistics of one text (blank texts: zeros)."""
    text = text or ""
    said = (lang or "").strip().lower()[:2]
    tokens = text.split()
    lines = [x for x in LINE.findall(text) if not x.isspace()]
    if not tokens or not lines:
        return (said if said in COMMON else "other", 0, 0, *([0.0] * len(STATISTICS)))
    totals = np.bincount(classes(text), minlength=4)
    words = WORD.findall(text)
    folded = " ".join(words).replace("İ", "i").lower().split(" ")
    hits = {k: sum(map(v.__contains__, folded)) for k, v in FOLDED.items()}
    hits["tr"] += len(TURKISH.findall(text)) // 4
    top = max(hits, key=lambda k: (hits[k], k == said))
    language = top if hits[top] >= 2 else said if said in COMMON else "other"
    symbols, digits, visible = int(totals[OTHER]), int(totals[DIGIT]), max(1, int(totals[1:].sum()))
    raw = text.encode("utf-8", "replace")
    mute = [w for w in words if len(w) > 2]
    items, cells = line_shares(lines)
    values = (
        np.log1p(len(words)),
        sum(map(len, words)) / max(1, len(words)),
        symbols / visible,
        digits / visible,
        sum(SENTENCE_END.search(x) is not None for x in lines) / len(lines),
        hits.get(language, max(hits.values())) / max(1, len(words)),
        np.log1p(len(tokens) / len(lines)),
        items,
        cells,
        len({t.lower() for t in tokens}) / len(tokens),
        len(zlib.compress(raw, 1)) / len(raw),
        sum(is_code(t) for t in tokens if len(t) > 5 and not t.isalpha()) / len(tokens),
        np.log1p(max(map(len, tokens))),
        sum(map(voiceless, mute)) / max(1, len(mute)),
    )
    return (language, len(words), len(tokens), *map(float, values))


MEASURED = "doc_id bigint, language string, words int, tokens int, " + ", ".join(f"{x} double" for x in STATISTICS)


def measure(documents: DataFrame) -> DataFrame:
    """Statistics of every document, null and empty texts included."""
    names = [x.strip().split(" ")[0] for x in MEASURED.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, *statistics(t, g)) for i, t, g in zip(pdf["doc_id"], pdf["text"], pdf["lang"], strict=True)]
            out = pd.DataFrame(rows, columns=names)
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    texts = documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), F.col("lang").cast("string"))
    return spread(texts, "doc_id").mapInPandas(run, MEASURED)


def chi_square(p: int, z: float) -> float:
    """Quantile of a chi-square variable with p degrees of freedom (Wilson and Hilferty), z that of a normal one."""
    return p * (1 - 2 / (9 * p) + z * (2 / (9 * p)) ** 0.5) ** 3


#: Count, mean and covariance of each language ("*": all together).
Model = dict[str, tuple[int, np.ndarray, np.ndarray]]


def contributions(pdf: pd.DataFrame, model: Model) -> np.ndarray:
    """Each statistic's part of the squared distance, by the document's language; shrunk for short texts."""
    x = pdf[list(STATISTICS)].to_numpy(dtype=float)
    out = np.zeros_like(x)
    named = pdf["language"].to_numpy()
    floor = np.diag(np.square(list(FLOORS.values())))
    for k in set(named):
        here = np.flatnonzero(named == k)
        _, mean, cov = model[k] if k in model and model[k][0] >= LEAST else model["*"]
        d = x[here] - mean
        out[here] = d * (d @ np.linalg.inv(cov + floor))
    n = pdf["tokens"].to_numpy(dtype=float)
    return out * (n / (n + SHORT))[:, None]


def spreads(rows: DataFrame) -> Model:
    """A robust start: medians, and squared median deviations on the diagonal.

    One pass counts each statistic in bins of a fifth of its floor, within ``REACH`` floors of zero, so that at most
    10 * REACH counts per language and statistic reach the driver, whatever the corpus.
    """
    p, width = len(STATISTICS), np.array(list(FLOORS.values())) / 5

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            bins = np.rint(np.clip(pdf[list(STATISTICS)].to_numpy(dtype=float) / width, -5 * REACH, 5 * REACH)).astype(int)
            for k in set(pdf["language"]):
                here = bins[(pdf["language"] == k).to_numpy()]
                for i in range(p):
                    at, n = np.unique(here[:, i], return_counts=True)
                    yield pd.DataFrame({"language": k, "i": i, "bin": at, "n": n})

    counts = rows.mapInPandas(run, "language string, i int, bin int, n long").groupBy("language", "i", "bin").agg(F.sum("n").alias("n")).toPandas()
    if not len(counts):
        return {"*": (0, np.zeros(p), np.zeros((p, p)))}

    def middle(x: np.ndarray, n: np.ndarray) -> float:
        order = np.argsort(x)
        return float(x[order][np.searchsorted(np.cumsum(n[order]), n.sum() / 2)])

    out: Model = {}
    for k, part in [*counts.groupby("language"), ("*", counts)]:
        centre, wide, size = np.zeros(p), np.zeros(p), 0
        for i, x in part.groupby("i"):
            at, n = x["bin"].to_numpy(), x["n"].to_numpy()
            m = middle(at, n)
            centre[i], wide[i], size = m * width[i], middle(np.abs(at - m), n) * width[i], int(n.sum())
        out[k] = (size, centre, np.diag((1.4826 * wide) ** 2))
    return out


def moments(rows: DataFrame, model: Model, limits: dict[str, float]) -> Model:
    """Means and covariances of the documents within their language's limit; each task sends 120 sums per language."""
    p = len(STATISTICS)
    upper = np.triu_indices(p)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for pdf in batches:
            d, x, named = contributions(pdf, model).sum(axis=1), pdf[list(STATISTICS)].to_numpy(dtype=float), pdf["language"].to_numpy()
            for k in set(named):
                y = x[(named == k) & (d <= limits.get(k, limits["*"]))]
                sums[k] = sums.get(k, 0) + np.r_[len(y), y.sum(axis=0), (y.T @ y)[upper]]
        for k, v in sums.items():
            yield pd.DataFrame({"language": k, "i": np.arange(len(v)), "v": v})

    total: dict[str, np.ndarray] = {}
    for r in rows.mapInPandas(run, "language string, i int, v double").groupBy("language", "i").agg(F.sum("v").alias("v")).collect():
        total.setdefault(r["language"], np.zeros(1 + p + len(upper[0])))[r["i"]] = r["v"]
    out: Model = {}
    for k, v in (total | {"*": sum(total.values())}).items() if total else ():
        if v[0] > 0:
            mean, square = v[1 : p + 1] / v[0], np.zeros((p, p))
            square[upper] = v[p + 1 :] / v[0]
            out[k] = (int(v[0]), mean, square + np.triu(square, 1).T - np.outer(mean, mean))
    return out


def halves(rows: DataFrame, model: Model) -> dict[str, float]:
    """Median distance of each language, from counts of distances in bins of two percent."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            d = contributions(pdf, model).sum(axis=1)
            at = pd.DataFrame({"language": pdf["language"], "bin": np.floor(np.log(np.maximum(d, 1e-9)) / 0.02).astype(int)})
            yield at.value_counts().rename("n").reset_index()

    counts = rows.mapInPandas(run, "language string, bin int, n long").groupBy("language", "bin").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("language")
    upto = counts.withColumns({"upto": F.sum("n").over(w.orderBy("bin")), "all": F.sum("n").over(w)})
    got = {r["language"]: math.exp(0.02 * (r["bin"] + 1)) for r in upto.filter("2 * upto >= all").groupBy("language").agg(F.min("bin").alias("bin")).collect()}
    return got | {"*": max(got.values(), default=0.0)}


def prose_model(rows: DataFrame, rounds: int = 3) -> Model:
    """Robust mean and covariance of each language: one concentration on the nearer half, then ``rounds`` of reweighting."""
    model = spreads(rows)
    model |= moments(rows, model, halves(rows, model))
    for _ in range(rounds):
        model |= moments(rows, model, {"*": chi_square(len(STATISTICS), 1.959964)})
    return model


def document_quality(documents: DataFrame, limit: float = LIMIT) -> DataFrame:
    """Statistics, distance from prose and kind of every document.

    Columns: doc_id, language (found in the text; the given one only where it says nothing), words, the
    statistics, distance (squared Mahalanobis), contributions (map from statistic to its part of the
    distance), kind (list, table, junk, or null for prose and for null, empty and blank texts). A language
    with fewer than ``LEAST`` documents is held against all languages together. Repeated documents are
    measured alike and each comes out. An empty table gives no rows.
    """
    rows = cut(measure(documents))
    model = prose_model(rows.filter("tokens > 0").select("language", "tokens", *STATISTICS))

    def held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            c = contributions(pdf, model)
            yield pdf.assign(distance=c.sum(axis=1), parts=list(c), doc_id=pdf["doc_id"].astype("Int64"))

    out = rows.mapInPandas(held, f"{MEASURED}, distance double, parts array<double>")
    item, cell = (F.element_at("parts", STATISTICS.index(c) + 1) for c in ("list_lines", "cell_lines"))
    kind = F.when((item > cell) & (item > LIMIT_OF_ONE), "list").when(cell > LIMIT_OF_ONE, "table").otherwise("junk")
    case = (F.col("tokens") > 0) & (F.col("distance") > limit)
    return out.select("doc_id", "language", "words", *STATISTICS, "distance", F.map_from_arrays(F.array(*(F.lit(c) for c in STATISTICS)), "parts").alias("contributions"), F.when(case, kind).alias("kind"))
