"""Evaluation texts that leak into a corpus (problem 9).

Passages are windows of ``WINDOW`` words, half overlapping, of documents and of items; a
piece of 12 words lies wholly inside one of each. Their TF-IDF vectors (folded words and
pairs of neighbours, hashed; frequencies over the whole corpus) span a latent space that is
fitted once for all items by a distributed randomised SVD: each task adds its part of
Y = A'(A B) for a random B, parts are summed slot by slot in a tree, and the singular
vectors come from Y alone (Nystrom). Only features that occur in an item can bring a passage
nearer to one, so the SVD runs in their space; a passage's norm counts all features.
Passages whose latent cosine to an item's passage reaches ``LEAST_COSINE`` make the document
a candidate for that item; there is no cap on candidates.

The exact check aligns candidate texts: runs of two or more common words, linked over single
altered, inserted or missing words, are pieces if they span 12 words or more; the best chain
of pieces in the order of both texts counts (a longest common subsequence of pieces).
``may_leak`` rules pairs out before by a bound that follows from these links.

Candidates that aren't leaks may be retold in other words: ``paraphrases`` reports those
whose longest common subsequence of words and whose facts (numbers and rare words, which
stand in for answers, since items carry none) agree.

Items are a query set: they are taken in blocks of ``BLOCK_WORDS`` words, each block against
all documents.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terazi.session import cut, spread

WINDOW, STRIDE = 24, 12
#: Hashed document frequencies; hashed features of the latent space; its rank and oversampling.
DF_SIZE, FEATURES, RANK, MORE = 1 << 18, 1 << 13, 160, 16
LEAST_COSINE = 0.15
#: Bits of the map of the items' features.
WANTED = 1 << 22
#: Latent dimensions of the first look at a passage.
FIRST = 32
#: A paraphrase: least cosine, share of the item in the longest common subsequence, share of its facts.
RETOLD = (0.3, 0.5, 0.4)
#: Least share of an item's words, and words of a piece.
SHARE, PIECE = 0.4, 12
BLOCK_WORDS = 600_000
SLOTS = 16
#: Tasks whose parts are summed directly; more are summed in groups first.
DIRECT = 256

TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W_]+(?:[-'’][^\W_]+)*")
MARKS = re.compile("[̀-ͯ]+")
INNER = re.compile(r"[-'’.,]")


def tokens_of(text: str | None) -> list[str]:
    """Folded words: lower case, without accents and inner punctuation."""
    if not text:
        return []
    if not text.isascii():
        text = MARKS.sub("", unicodedata.normalize("NFKD", text.replace("ı", "i")))
    return [INNER.sub("", w) if len(w) > 1 and not w.isalnum() else w for w in TOKEN.findall(text.lower())]


class Hasher:
    """Codes of 63 bits and a low bit that marks numbers."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def codes(self, words: list[str]) -> list[int]:
        known = self.known
        if len(known) > 500_000:
            known.clear()
        out = []
        for w in words:
            c = known.get(w)
            if c is None:
                c = known[w] = (xxhash.xxh64_intdigest(w) >> 2 << 1) | w[0].isdigit()
            out.append(c)
        return out


def joined(texts: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated codes and the lengths of the texts."""
    return np.array([c for t in texts for c in t], dtype=np.uint64), np.array([len(t) for t in texts], dtype=np.int64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of concatenated texts: text, first and last word (exclusive). A short text has one."""
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    n = np.where(lengths == 0, 0, np.maximum(1, -(-(lengths - STRIDE) // STRIDE)))
    text = np.repeat(np.arange(len(lengths)), n)
    no = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    first = starts[text] + no * STRIDE
    return text, first, np.minimum(first + WINDOW, starts[text] + lengths[text])


LOW = np.uint64((1 << 40) - 1)


def features(codes: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window, feature (a hash of 40 bits) and count of each distinct word and pair of neighbours of each window, by window."""
    if not len(codes) or not len(first):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    codes = np.where(codes & np.uint64(1), np.uint64(1), codes)  # numbers are alike here
    single = _mix(codes) & LOW
    double = _mix(codes[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + codes[1:]) & LOW
    at = first[:, None] + np.arange(WINDOW)[None, :]
    here, pair = at < last[:, None], at + 1 < last[:, None]
    high = np.broadcast_to((np.arange(len(first), dtype=np.uint64) << np.uint64(40))[:, None], at.shape)
    key = np.concatenate([high[here] | single[at[here]], high[pair] | double[at[pair]]])
    key.sort()
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    count = np.diff(np.append(new, len(key)))
    key = key[new]
    return (key >> np.uint64(40)).astype(np.int64), key & LOW, count


@dataclass
class Space:
    """What every task needs: document frequencies, a map of the items' features and (later) the latent basis."""

    idf: np.ndarray  # float32 by feature modulo DF_SIZE
    wanted: np.ndarray  # bool by feature modulo WANTED
    basis: np.ndarray | None = None  # FEATURES x rank

    def vectors(self, codes: np.ndarray, lengths: np.ndarray):
        """text of each window, norm over all features, and (window, column, weight) of the wanted features, by window."""
        text, first, last = windows(lengths)
        win, feature, count = features(codes, first, last)
        norm = np.zeros(len(text))
        if not len(win):
            return text, norm, win, win, np.zeros(0, dtype=np.float32)
        weight = self.idf[(feature % np.uint64(DF_SIZE)).astype(np.int64)]
        weight = np.where(count > 1, (1 + np.log(count)).astype(np.float32) * weight, weight)
        at = np.flatnonzero(np.r_[True, win[1:] != win[:-1]])
        norm[win[at]] = np.sqrt(np.add.reduceat(weight.astype(np.float64) ** 2, at))
        keep = self.wanted[(feature % np.uint64(WANTED)).astype(np.int64)]
        column = (_mix(feature[keep]) >> np.uint64(7)) % np.uint64(FEATURES)
        return text, norm, win[keep], column.astype(np.int64), weight[keep]

    @staticmethod
    def project(count: int, win: np.ndarray, column: np.ndarray, weight: np.ndarray, basis: np.ndarray) -> np.ndarray:
        """Rows of A B for each window."""
        out = np.zeros((count, basis.shape[1]), dtype=np.float32)
        if len(win):
            cut = np.flatnonzero(np.r_[True, win[1:] != win[:-1]])
            out[win[cut]] = np.add.reduceat(basis[column] * weight[:, None], cut, axis=0)
        return out


def _summed(parts: DataFrame, kind: type, direct: int = DIRECT) -> np.ndarray:
    """Sum of the tasks' parts, slot by slot; the result has a fixed size.

    Parts stream through a task, which holds one sum per slot. With more than ``direct`` tasks the parts of groups
    of tasks are summed first, so no task reads more than a group.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for slot, data in zip(batch.column("slot").to_pylist(), batch.column("data"), strict=True):
                x = np.frombuffer(data.as_buffer(), dtype=kind)
                if slot in total:
                    total[slot] += x
                else:
                    total[slot] = x.copy()
        if total:
            yield _batch(list(total), [x.tobytes() for x in total.values()])

    if parts.rdd.getNumPartitions() > direct:
        parts = parts.withColumn("g", F.pmod(F.spark_partition_id(), F.lit(direct))).repartition(direct, "slot", "g").select("slot", "data").mapInArrow(add, PARTS)
    got = {r.slot: np.frombuffer(r.data, dtype=kind) for r in parts.repartition(SLOTS, "slot").mapInArrow(add, PARTS).collect()}
    return np.concatenate([got[k] for k in sorted(got)]) if got else np.zeros(0, dtype=kind)


def encode(documents: DataFrame) -> DataFrame:
    """doc_id and the codes of the words of each text, in order; tokenised once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "codes": [hasher.codes(tokens_of(x)) for x in pdf["text"]]})

    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return spread(texts, "doc_id").mapInPandas(run, "doc_id bigint, codes array<bigint>")


def _chunks(batches: Iterator[pa.RecordBatch], size: int = 256) -> Iterator[tuple[pa.Array | None, np.ndarray, np.ndarray]]:
    """Ids (if there), concatenated codes and lengths of some texts at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            part = batch.slice(at, size)
            codes = part.column("codes")
            yield part.column("doc_id") if "doc_id" in part.schema.names else None, codes.flatten().to_numpy(zero_copy_only=False).astype(np.uint64), np.asarray(codes.value_lengths().fill_null(0), dtype=np.int64)


PARTS = "slot int, data binary"


def _batch(slots: list[int], data: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(slots, pa.int32()), pa.array(data, pa.binary())], ["slot", "data"])


def document_frequencies(coded: DataFrame) -> tuple[np.ndarray, float]:
    """Windows that hold each hashed feature, over all texts, and the number of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DF_SIZE, dtype=np.float64), 0
        for _, codes, lengths in _chunks(batches):
            _, first, last = windows(lengths)
            _, feature, _ = features(codes, first, last)
            df += np.bincount((feature % np.uint64(DF_SIZE)).astype(np.int64), minlength=DF_SIZE)
            n += len(first)
        if n:
            yield _batch([*range(SLOTS), SLOTS], [*(x.tobytes() for x in np.split(df, SLOTS)), np.array([float(n)]).tobytes()])

    total = _summed(coded.select("codes").mapInArrow(run, PARTS), np.float64)
    return (total[:DF_SIZE], float(total[DF_SIZE])) if len(total) else (np.zeros(DF_SIZE), 0.0)


def wanted_features(coded: DataFrame) -> np.ndarray:
    """Map of the features of the items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(WANTED, dtype=bool)
        for _, codes, lengths in _chunks(batches):
            _, first, last = windows(lengths)
            seen[(features(codes, first, last)[1] % np.uint64(WANTED)).astype(np.int64)] = True
        if seen.any():
            yield _batch(list(range(SLOTS)), [x.tobytes() for x in np.split(seen, SLOTS)])

    total = _summed(coded.select("codes").mapInArrow(run, PARTS), np.bool_)
    return total if len(total) else np.zeros(WANTED, dtype=bool)


def latent_basis(coded: DataFrame, space: Space, rank: int = RANK) -> np.ndarray:
    """Right singular vectors of the TF-IDF passages, strongest first, from one pass over the texts."""
    start = np.random.Generator(np.random.Philox(7)).standard_normal((FEATURES, rank + MORE)).astype(np.float32)
    sent = coded.sparkSession.sparkContext.broadcast((space, start))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, b = sent.value
        total, some = np.zeros((FEATURES, b.shape[1]), dtype=np.float32), False
        for _, codes, lengths in _chunks(batches):
            _, norm, win, col, weight = space.vectors(codes, lengths)
            if len(win):
                y = Space.project(len(norm), win, col, weight, b)
                order = np.argsort(col, kind="stable")
                c = col[order]
                at = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
                total[c[at]] += np.add.reduceat(y[win[order]] * weight[order][:, None], at, axis=0)
                some = True
        if some:
            yield _batch(list(range(SLOTS)), [x.tobytes() for x in np.split(total, SLOTS)])

    y = _summed(coded.select("codes").mapInArrow(run, PARTS), np.float32)
    if not len(y):
        return np.zeros((FEATURES, 0), dtype=np.float32)
    y = y.reshape(start.shape).astype(np.float64)
    # A'A is about Y (B'Y)^-1 Y'; its eigenvectors are those of E = Y C^-T with B'Y = C C', a little shifted
    shift = 1e-7 * np.linalg.norm(y)
    y += shift * start
    small = start.astype(np.float64).T @ y
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    ok = values > 1e-12 * values[-1]
    left, size, _ = np.linalg.svd(y @ (vectors[:, ok] / np.sqrt(values[ok])), full_matrices=False)
    return left[:, : min(rank, int((size > 1e-9 * size[0]).sum()))].astype(np.float32)


# --- exact check -------------------------------------------------------------------------------


#: Words of the item and of the text between two runs of a piece: one altered, inserted or missing word (a hyphenated
#: one may count as two).
GAPS = ((1, 1), (0, 1), (1, 0), (0, 2), (1, 2), (2, 1))


@dataclass
class Item:
    """An item's words, and its pairs of neighbours in order of their codes with their positions."""

    words: np.ndarray
    pairs: np.ndarray
    at: np.ndarray

    @classmethod
    def of(cls, words: list[int]) -> Item:
        a = np.array(words, dtype=np.uint64)
        p = pairs_of(a)
        order = np.argsort(p, kind="stable")
        return cls(a, p[order], order)


def pairs_of(words: np.ndarray) -> np.ndarray:
    """Codes of neighbouring words."""
    return _mix(words[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + words[1:]) if len(words) > 1 else np.zeros(0, dtype=np.uint64)


def may_leak(item: Item, pairs: np.ndarray, share: float = SHARE, least: int = PIECE) -> bool:
    """Whether a text with these (sorted, distinct) pairs can carry the share of the item.

    Inside a piece at most three neighbouring pairs of the item in a row aren't pairs of the text (those around two
    altered words), and a piece may reach three words beyond its outer pairs only at an end of the item. So pieces lie
    inside stretches of common pairs that are four apart at most; if those of 12 words or more don't sum up to the share, there is
    no leak.
    """
    n = len(item.words)
    if n < least or not len(pairs):
        return False
    pos = np.minimum(np.searchsorted(pairs, item.pairs), len(pairs) - 1)
    hit = np.sort(item.at[pairs[pos] == item.pairs])
    if not len(hit):
        return False
    far = np.flatnonzero(np.diff(hit) > 4)
    lo, hi = hit[np.r_[0, far + 1]], hit[np.r_[far, len(hit) - 1]] + 2
    lo, hi = np.where(lo <= 3, 0, lo), np.where(hi >= n - 3, n, hi)
    long = hi - lo >= least
    return int((hi - lo)[long].sum()) >= share * n


def runs_of(item: Item, text: np.ndarray) -> list[tuple[int, int, int]]:
    """Maximal runs of two or more equal words: shift (text less item), first and last (exclusive) word of the item."""
    p = pairs_of(text)
    a, b = np.searchsorted(item.pairs, p, "left"), np.searchsorted(item.pairs, p, "right")
    n = b - a
    j = np.repeat(np.arange(len(p)), n)
    i = item.at[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)]
    order = np.lexsort((i, j - i))
    i, d = i[order], (j - i)[order]
    if not len(i):
        return []
    new = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (i[1:] != i[:-1] + 1)])
    return list(zip(d[new].tolist(), i[new].tolist(), (i[np.r_[new[1:] - 1, len(i) - 1]] + 2).tolist(), strict=True))


def pieces(item: Item, text: np.ndarray, least: int = PIECE) -> list[tuple[int, int, int, int]]:
    """Pieces of the item in the text: item from, to, text from, to (exclusive); spans of fewer than ``least`` words are dropped.

    Runs of two or more equal words follow each other over one of ``GAPS``; at an end of the item a single equal word beyond a
    gap counts too. A word altered next to a run of one isn't single, so of three words one may be altered.
    """
    runs = runs_of(item, text)
    by: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for k, (d, i0, i1) in enumerate(runs):
        by[d].append((i0, i1, k))
    a, n, m = item.words, len(item.words), len(text)
    start: list[tuple[int, int] | None] = [None] * len(runs)
    out = set()
    for k in sorted(range(len(runs)), key=lambda k: (runs[k][2], runs[k][1])):  # a run's forerunners end before it
        d, i0, i1 = runs[k]
        s = (i0, i0 + d)
        for di, dj in GAPS:
            y = i0 + d - dj
            if i0 - di == 1 and y >= 1 and a[0] == text[y - 1]:
                s = (0, y - 1)
                break
        s = min(s, start[k] or s)
        followed = False
        for di, dj in GAPS:
            x = i1 + di
            near = by.get(d + dj - di)
            if near:
                at = bisect_right(near, (x, n + 1, 0)) - 1
                if at >= 0 and near[at][1] >= x + 2 and near[at][1] > i1:
                    to = near[at][2]
                    followed = True
                    if start[to] is None or s < start[to]:
                        start[to] = s
        if followed:
            continue
        e = (i1, i1 + d)
        for di, dj in GAPS:
            y = i1 + d + dj
            if i1 + di == n - 1 and y < m and a[n - 1] == text[y]:
                e = (n, y + 1)
                break
        if e[0] - s[0] >= least:
            out.add((s[0], e[0], s[1], e[1]))
    return sorted(out)


def carried(item: Item, text: np.ndarray, least: int = PIECE) -> int:
    """Words of the item that the text carries: the best chain of pieces in the order of both."""
    found = sorted(pieces(item, text, least), key=lambda p: (p[1], p[3]))
    best: list[int] = []
    for k, (i0, i1, j0, _) in enumerate(found):
        top = 0
        for m in range(k):
            p = found[m]
            over = max(0, p[1] - i0)
            if p[0] <= i0 and p[2] <= j0 and p[3] - over <= j0 and i1 - i0 - over >= least:
                top = max(top, best[m] - over)
        best.append(top + i1 - i0)
    return max(best, default=0)


def leaks(item: Item, text: np.ndarray, share: float = SHARE, least: int = PIECE, pairs: np.ndarray | None = None) -> int:
    """Words carried if they reach the share, else 0."""
    if not may_leak(item, np.unique(pairs_of(text)) if pairs is None else pairs, share, least):
        return 0
    n = carried(item, text, least)
    return n if n >= share * len(item.words) else 0


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by bits of one integer per row."""
    places: dict[int, int] = defaultdict(int)
    for i, w in enumerate(a):
        places[w] |= 1 << i
    full, v = (1 << len(a)) - 1, (1 << len(a)) - 1
    for w in b:
        u = v & places.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - bin(v).count("1")


def retold(item: Item, facts: set[int], text: np.ndarray, rules: tuple[float, float, float] = RETOLD) -> bool:
    """Whether the text has the item's facts and its words in its order, in the shares of ``rules``."""
    words = text.tolist()
    if not facts or len(facts.intersection(words)) < rules[2] * len(facts):
        return False
    return common_subsequence(item.words.tolist(), words) >= rules[1] * len(item.words)


OUT = "doc_id bigint, item_id bigint, kind string, words int, item_words int, cosine double"


def find_leaks(documents: DataFrame, items: DataFrame, cosine: float = LEAST_COSINE, check: bool = True, paraphrases: bool = False, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Documents that carry passages of items: doc_id, item_id, kind (passage), words (of the item, carried), item_words, cosine.

    A document leaks an item if it carries two fifths of its words or more, in the item's order, in pieces
    of at least 12 words; a text that leaks several items has a row for each. Null, empty and blank texts
    leak nothing, items without words are ignored; items under 12 words can't leak. Repeated documents and
    items each come out; null ids stay null. An empty table gives no rows. With ``paraphrases`` also
    documents that retell an item without carrying it (kind paraphrase, words 0). With ``check`` off: the
    candidates of the latent search (kind candidate, words 0).
    """
    spark = documents.sparkSession
    query = cut(encode(items.select(F.col("item_id").alias("doc_id"), "text")).filter("size(codes) > 0"))
    wanted = wanted_features(query)
    if not wanted.any():
        return spark.createDataFrame([], OUT)
    coded = cut(encode(documents))
    df, n = document_frequencies(coded)
    space = Space(np.log((n + 1) / (df + 1) + 1).astype(np.float32), wanted)
    space.basis = latent_basis(coded.unionByName(query), space)
    out, own, size = [], [], 0
    for r in query.toLocalIterator():
        own.append((r.doc_id, list(r.codes)))
        size += len(r.codes)
        if size >= block_words:
            out.append(_block(coded, own, space, cosine, check, paraphrases))
            own, size = [], 0
    if own:
        out.append(_block(coded, own, space, cosine, check, paraphrases))
    return reduce(DataFrame.unionByName, out)


def _block(coded: DataFrame, own: list[tuple], space: Space, cosine: float, check: bool, paraphrases: bool) -> DataFrame:
    codes, lengths = joined([w for _, w in own])
    owner, norm, win, col, weight = space.vectors(codes, lengths)
    latent = (Space.project(len(norm), win, col, weight, space.basis) / np.maximum(norm, 1e-9)[:, None]).astype(np.float32)
    shared = coded.sparkSession.sparkContext.broadcast((space, latent, owner, own))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, latent, owner, own = shared.value
        items: dict[int, Item] = {}
        facts: dict[int, set[int]] = {}
        head, tail = np.ascontiguousarray(latent[:, :FIRST].T), np.ascontiguousarray(latent[:, FIRST:].T)
        most = float(np.sqrt((tail * tail).sum(axis=0)).max()) if len(tail) else 0.0
        for ids, codes, lengths in _chunks(batches):
            text, norm, win, col, weight = space.vectors(codes, lengths)
            if not len(win):
                continue
            y = Space.project(len(norm), win, col, weight, space.basis) / np.maximum(norm, 1e-9)[:, None].astype(np.float32)
            best = np.full((len(lengths), len(own)), -1.0, dtype=np.float32)
            for part in np.array_split(np.arange(len(y)), max(1, len(y) // 512)):
                c = y[part, :FIRST] @ head
                # the other dimensions add at most the product of both lengths: most passages end here
                rest = np.sqrt((y[part, FIRST:] ** 2).sum(axis=1)) * most
                live = np.flatnonzero(c.max(axis=1) + rest >= cosine)
                if not len(live):
                    continue
                c = c[live] + y[part[live], FIRST:] @ tail
                r, q = np.nonzero(c >= cosine)
                np.maximum.at(best, (text[part[live[r]]], owner[q]), c[r, q])
            ends = np.cumsum(lengths)
            rows, words_of = [], {}
            for d, q in zip(*(x.tolist() for x in np.nonzero(best >= 0)), strict=True):
                item_id, item = own[q]
                if not check:
                    rows.append((ids[d].as_py(), item_id, "candidate", 0, len(item), float(best[d, q])))
                    continue
                if d not in words_of:
                    w = codes[ends[d] - lengths[d] : ends[d]]
                    words_of[d] = w, np.unique(pairs_of(w))
                if q not in items:
                    items[q] = Item.of(item)
                n = leaks(items[q], words_of[d][0], pairs=words_of[d][1])
                if n:
                    rows.append((ids[d].as_py(), item_id, "passage", n, len(item), float(best[d, q])))
                elif paraphrases and best[d, q] >= RETOLD[0]:
                    if q not in facts:
                        facts[q] = facts_of(items[q].words, space.idf)
                    if retold(items[q], facts[q], words_of[d][0]):
                        rows.append((ids[d].as_py(), item_id, "paraphrase", 0, len(item), float(best[d, q])))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.float64()), strict=True)], ["doc_id", "item_id", "kind", "words", "item_words", "cosine"])

    return coded.mapInArrow(search, OUT)


def facts_of(words: np.ndarray, idf: np.ndarray) -> set[int]:
    """Numbers of an item and its rarer words, the upper quarter by frequency in the corpus."""
    weight = idf[((_mix(words) & LOW) % np.uint64(DF_SIZE)).astype(np.int64)]
    number = (words & np.uint64(1)).astype(bool)
    return set(words[number | (weight >= np.quantile(weight, 0.75))].tolist())
