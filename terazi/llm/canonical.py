"""Mapping of freely typed values to a canonical list (problem 6).

Each distinct value is repaired (text that was decoded with the wrong charset), folded
(case, accents, punctuation) and searched, without its blanks, by a multi-pattern
automaton over the canonical names, their aliases (name core with every spelling of the
company form) and the bare cores; the longest non-overlapping mention wins. Values without
a mention go to token-set similarity: the share of a name's token set, by letters, that the
value's token set holds, where two tokens are alike by 1 - edits / length, within the
allowed edits (misspelt tokens are never equal).

The canonical list is the operator's dictionary: it is sent to every task in parts of at most
``MAX_NAMES`` names. A longer list has several parts; each value collects its mentions and similar
names from all of them, and the longest mentions are chosen over all together.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UNMATCHED = "UNMATCHED"
#: Names that a task holds at once.
MAX_NAMES = 200_000
#: Least token-set similarity.
LEAST_SET = 0.6

# Words of company forms, by kind (P portfolio manager, E pension and life company),
# folded, in the spellings in use; words that belong to neither; and the letters folding treats alike.
FORMS = {
    "P": ["portfoy yonetimi", "portfoy yonetim sirketi", "portfoy yonetim", "portfoy yon", "portfoy", "portf yon", "portf", "prtf yon", "prtf", "port yon", "port", "portfolio", "portfoyu", "pys", "p y s", "py"],
    "E": ["emeklilik ve hayat", "hayat ve emeklilik", "emeklilik hayat", "hayat emeklilik", "emeklilik", "emek ve hayat", "hayat ve emek", "emek hayat", "hayat emek", "emek", "emk", "hayat"],
}
GENERIC = {"portfoy", "portfolio", "pys", "emeklilik", "hayat", "ve", "yatirim", "yonetimi", "yonetim", "as", "a", "s", "sti"}
LETTERS = str.maketrans({"ı": "i", "İ": "i", "I": "i", "ş": "s", "Ş": "s", "ğ": "g", "Ğ": "g", "ø": "o", "ł": "l", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe"})


def repair(text: str) -> str:
    """Undo UTF-8 that was decoded as Latin-1 or Windows-1252, fully or in part."""
    if not any("Â" <= c <= "ô" for c in text):
        return text

    def back(m: re.Match) -> str:
        run = m.group()
        for charset in ("latin-1", "cp1252"):
            try:
                return run.encode(charset).decode("utf-8")
            except UnicodeError:
                pass
        return run

    return re.sub("[Â-ô][\u0080-¿ŒœŠšŸŽžƒˆ˜–-›€™]{1,3}", back, text)


def fold(text: str) -> str:
    """Lower-case ASCII words, single blanks between them."""
    text = unicodedata.normalize("NFKD", repair(text).translate(LETTERS)).lower().translate(LETTERS)
    text = "".join(c for c in text if not unicodedata.combining(c))
    return " ".join(re.findall("[a-z0-9]+", text))


def edits(a: str, b: str, most: int) -> int:
    """Edit distance with transpositions of neighbours; ``most`` + 1 if larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    old, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, old[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        old, last = last, row
    return min(last[-1], most + 1)


def allowed(core: str) -> int:
    """Edits that a misspelt core may have."""
    return 0 if len(core) < 5 else 1 if len(core) < 6 else 2


def core_of(name: str) -> tuple[list[str], str]:
    """Words of a name that aren't generic (all, if there are no others), and the kind of company: P, E or empty."""
    words = fold(name).split()
    core = [w for w in words if w not in GENERIC] or words
    rest = {w for w in words if w not in core}
    return core, "E" if {"emeklilik", "hayat"} & rest else "P" if {"portfoy", "pys", "portfolio"} & rest else ""


def alike(a: str, b: str) -> float:
    """Similarity of two tokens: 1 less edits per letter, 0 beyond the allowed edits."""
    d = edits(a, b, allowed(b))
    return 1 - d / max(len(a), len(b)) if d <= allowed(b) else 0.0


#: What a value's words say about one core: where it is mentioned (or -1), how alike the token sets are, the kind that the value names
#: (null: none), and the canonical names of that core by kind.
EVIDENCE = "start int, stop int, score double, core string, kind string, names map<string,string>"


@dataclass
class Matcher:
    """Automaton and token sets of a canonical list."""

    names: list[str]
    cores: dict[str, dict[str, str]] = field(default_factory=lambda: defaultdict(dict))  # core -> kind -> name
    automaton: ahocorasick.Automaton = field(default_factory=ahocorasick.Automaton)

    def __post_init__(self) -> None:
        self.forms = sorted(((f.replace(" ", ""), kind) for kind, fs in FORMS.items() for f in fs), key=lambda x: -len(x[0]))
        self.tokens: dict[str, list[list[str]]] = {}  # core -> its token sets: its words, and all of them written as one
        for name in sorted(set(self.names)):
            words, kind = core_of(name)
            core = "".join(words)
            if core not in self.tokens:
                self.tokens[core] = [words] if len(words) == 1 else [words, [core]]
            self.cores[core].setdefault(kind, name)
        self.grams: dict[str, set[str]] = defaultdict(set)
        for core, kinds in self.cores.items():
            self._add(core, core, None)
            for kind in ("P", "E"):
                if kind in kinds:
                    for form, k in self.forms:
                        if k == kind:
                            for between in ("", "yatirim"):
                                self._add(core + between + form, core, kind)
            for token in {t for ts in self.tokens[core] for t in ts}:
                for g in _grams(token):
                    self.grams[g].add(core)
        self.automaton.make_automaton()

    def _add(self, pattern: str, core: str, kind: str | None) -> None:
        self.automaton.add_word(pattern, (len(pattern), core, kind))

    def form_after(self, text: str, at: int) -> str | None:
        """Kind of the company form that follows in a text without blanks."""
        rest = text[at:]
        if rest.startswith("yatirim"):
            rest = rest[7:]
        return next((kind for form, kind in self.forms if rest.startswith(form)), None)

    def mentions(self, words: list[str]) -> list[tuple]:
        """EVIDENCE of each pattern that begins at a word."""
        if not self.cores:
            return []
        text, starts, at = "".join(words), set(), 0
        for w in words:
            starts.add(at)
            at += len(w)
        out = []
        for end, (n, core, kind) in self.automaton.iter(text):
            start, stop = end - n + 1, end + 1
            if start not in starts:
                continue
            if kind is None:
                kind = self.form_after(text, stop)
                if kind is None and stop not in starts and stop < len(text):
                    core = ""  # the core is the beginning of another word
            out.append((start, stop, 1.0, core, kind, dict(self.cores[core]) if core else {}))
        return out

    def similar(self, words: list[str]) -> list[tuple]:
        """EVIDENCE of the names whose token sets the value's token set holds."""
        text, at = "".join(words), 0
        held: dict[str, str | None] = {}  # the value's tokens, also two or three as one, with the company form that follows
        for i in range(len(words)):
            for n in (1, 2, 3):
                token = "".join(words[i : i + n])
                if i + n > len(words) or len(token) > 40:
                    break
                for head, kind in self._heads(token, text, at):
                    held[head] = held.get(head) or kind
            at += len(words[i])
        near = {core for t in held for g in _grams(t) for core in self.grams.get(g, ())}
        out = []
        for core in near:
            best = (0.0, None)
            for tokens in self.tokens[core]:
                total = sum(map(len, tokens))
                score, kinds = 0.0, []
                for t in tokens:
                    s, token = max(((alike(h, t), h) for h in held), key=lambda x: (x[0], held[x[1]] is not None, x[1]))
                    score += s * len(t) / total
                    kinds.append(held[token] if s else None)
                best = max(best, (score, next((k for k in reversed(kinds) if k), None)), key=lambda x: (x[0], x[1] is not None))
            if best[0] >= LEAST_SET:
                out.append((-1, -1, best[0], core, best[1], dict(self.cores[core])))
        return out

    def _heads(self, token: str, text: str, at: int) -> Iterator[tuple[str, str | None]]:
        yield token, self.form_after(text, at + len(token))
        for form, kind in self.forms:  # a form that is glued to the core
            if len(form) > 3 and token.endswith(form) and len(token) - len(form) > 3:
                yield token[: -len(form)], kind
                break

    def evidence(self, value: str) -> list[tuple]:
        words = fold(value).split()
        if not words:
            return []
        return self.mentions(words) or self.similar(words)

    def resolve(self, value: str) -> tuple[str, str, str]:
        return decide(value, self.evidence(value))


def pick(names: dict[str, str], kind: str | None) -> tuple[str | None, bool]:
    """Name of a core by kind; whether the kind was needed but isn't known."""
    if kind is None:
        return (next(iter(names.values())), False) if len(names) == 1 else (None, True)
    return names.get(kind) or names.get(""), False


def decide(value: str, found: list[tuple]) -> tuple[str, str, str]:
    """Name or UNMATCHED, how it was found, and the core of the name, or that whose kind is open."""
    if not fold(value):
        return UNMATCHED, "empty", ""
    taken: list[tuple[int, int]] = []
    first: tuple | None = None
    for x in sorted((x for x in found if x[0] >= 0), key=lambda x: (x[0] - x[1], x[0], x[3], x[4] or "")):
        if all(x[1] <= a or x[0] >= b for a, b in taken):
            taken.append((x[0], x[1]))
            if x[3] and (first is None or x[0] < first[0]):
                first = x
    if first is not None:
        name, open_ = pick(first[5], first[4])
        return (name, "mention", first[3]) if name else (UNMATCHED, "open", first[3]) if open_ else (UNMATCHED, "other company", "")
    near = [x for x in found if x[0] < 0]
    if not near:
        return UNMATCHED, "none", ""
    top = max(x[2] for x in near)
    fits = sorted(((x[3], *pick(x[5], x[4])) for x in near if x[2] > top - 1e-9), key=lambda x: x[0])
    named = sorted({name for _, name, _ in fits if name})
    if len(named) == 1:
        return named[0], "similar", next(core for core, name, _ in fits if name)
    opened = [core for core, _, open_ in fits if open_]
    if named or len(opened) > 1:
        return UNMATCHED, "tie", ""
    return (UNMATCHED, "open", opened[0]) if opened else (UNMATCHED, "other company", "")


def _grams(word: str) -> set[str]:
    padded = f"^{word}$"
    return {padded[i : i + 2] for i in range(len(padded) - 1)}


OUT = "fund string, value string, name string, how string, core string"


def map_values(values: DataFrame, names: list[str]) -> DataFrame:
    """Names of distinct values (columns fund and value) by a list of one part; adds name, how and core."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(names)
        seen: dict[str, tuple] = {}
        for pdf in batches:
            if len(seen) > 200_000:
                seen.clear()
            found = []
            for v in pdf["value"]:
                if v not in seen:
                    seen[v] = matcher.resolve(v)
                found.append(seen[v])
            yield pdf[["fund", "value"]].assign(name=[x[0] for x in found], how=[x[1] for x in found], core=[x[2] for x in found])

    return values.mapInPandas(run, OUT)


def map_by_parts(values: DataFrame, parts: list[list[str]]) -> DataFrame:
    """The same by a list of several parts: evidence from each part, gathered by value, then decided."""

    def against(names: list[str]) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            matcher = Matcher(names)
            for pdf in batches:
                rows = [(f, v, *x) for f, v in zip(pdf["fund"], pdf["value"], strict=True) for x in matcher.mentions(fold(v).split()) + matcher.similar(fold(v).split())]
                yield pd.DataFrame(rows, columns=["fund", "value", "start", "stop", "score", "core", "kind", "names"])

        return values.mapInPandas(run, f"fund string, value string, {EVIDENCE}")

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [decide(v, [(x["start"], x["stop"], x["score"], x["core"], x["kind"], dict(x["names"])) for x in e]) for v, e in zip(pdf["value"], pdf["found"], strict=True)]
            yield pdf[["fund", "value"]].assign(name=[x[0] for x in found], how=[x[1] for x in found], core=[x[2] for x in found])

    each = reduce(DataFrame.unionByName, (against(p) for p in parts))
    item = F.struct("start", "stop", "score", "core", "kind", "names")
    none = values.select("fund", "value", F.lit(None).cast(f"struct<{EVIDENCE.replace(' int', ':int').replace(' double', ':double').replace(' string', ':string').replace(' map', ':map')}>").alias("x"))
    gathered = each.select("fund", "value", item.alias("x")).unionByName(none).groupBy("fund", "value").agg(F.collect_list("x").alias("found"))
    return gathered.mapInPandas(settle, OUT)


def map_founders(general: DataFrame, reference: DataFrame, max_names: int = MAX_NAMES) -> DataFrame:
    """The canonical founder of each distinct fund and title: fonkodu, fonunvan (as written), name, how.

    name is UNMATCHED where the founder isn't on the list. A title whose company core fits several names,
    without saying which, takes the name of that core which the other titles of the same fund give, if that
    is only one. Rows without fund or title are ignored; empty and blank titles are UNMATCHED. Repeated rows
    come out once. Null names of the list are ignored; of names that fold alike the first in order counts.
    With an empty list all titles are UNMATCHED; an empty table gives no rows.
    """
    fund = F.upper(F.btrim(F.col("fonkodu"), F.lit(" \t\r\n\u00a0")))
    pairs = general.select(fund.alias("fund"), F.col("fonunvan").alias("value")).filter("fund <> '' and value is not null").distinct()
    names = reference.select("name").filter("name is not null and trim(name) <> ''").distinct()
    few = [r[0] for r in names.limit(max_names + 1).collect()]
    if len(few) <= max_names:
        found = map_values(pairs, few)
    else:
        core = F.pandas_udf(lambda s: s.map(lambda x: "".join(core_of(x)[0])), "string")
        n = 2 * -(-names.count() // max_names)
        part = names.withColumn("part", F.pmod(F.xxhash64(core("name")), F.lit(n)))  # names of one core stay together
        found = map_by_parts(pairs, [[r[0] for r in part.filter(F.col("part") == k).select("name").collect()] for k in range(n)])
    # unmatched titles have no core and nothing to settle; each is a partition of its own
    same = Window.partitionBy("fund", "core", F.when(F.col("core") == "", F.col("value")))
    named = F.when(F.col("name") != UNMATCHED, F.col("name"))
    one = F.when((F.min(named).over(same) == F.max(named).over(same)) & (F.col("how") == "open"), F.min(named).over(same))
    settled = found.withColumn("other", one)
    return settled.select(
        F.col("fund").alias("fonkodu"), F.col("value").alias("fonunvan"), F.coalesce("other", "name").alias("name"), F.when(F.col("other").isNotNull(), F.lit("same fund")).otherwise(F.col("how")).alias("how")
    )
