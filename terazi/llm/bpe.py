"""Encoding of a corpus by a public byte-level BPE vocabulary (problem 8).

The encoder is a streaming transducer with bounded lookahead, through which every piece of
every text goes. It reads a piece byte by byte and keeps, for each prefix that may still end
a token, the last token of that prefix's encoding and where that token began. A vocabulary's
encoding has the prefix property: if the final encoding has a boundary at p, its tokens up
to p encode the prefix. The last token of a prefix is the longest vocabulary entry at its
end that merges to itself and that stands the merge list beside the token before it
(``pair_holds``).

Lookahead: what follows a prefix changes its encoding only through a chain of merges, each
of which takes away the left part of the one before or keeps it free, and each of a larger
rank. ``sufficient_lookahead`` finds the chain that reaches furthest, by dynamic programming
over the merge list: 864 bytes for byte_bpe_50k. So, of a prefix, only that many bytes and the
longest token can still change: the encodings of the last prefixes agree before, and these
tokens are emitted and forgotten. Memory is the window plus ``STRIDE`` bytes, however long
the piece.

Decoding is an incremental state machine over bytes.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
from collections.abc import Iterable, Iterator
from pathlib import Path

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terazi.session import spread

TOKENIZERS = "/opt/tokenizers"
#: The pattern that splits text into pieces before the merges (a fixed value of the vocabulary).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces whose encoding a worker remembers, and the characters of the longest of them.
CACHED, CACHED_CHARS = 400_000, 64
#: Bytes between two searches for stable tokens, once the window is full.
STRIDE = 1024


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file of base64 tokens and numbers."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line)}


def sufficient_lookahead(ranks: dict[bytes, int]) -> int:
    """Bytes before the end of a prefix that what follows may still encode otherwise.

    A merge of u and v at the end keeps u from a later merge with its left neighbour, or lets it take part in one;
    that moves the difference left by u, where the next merge of a larger rank, whose right part begins with u, goes
    on. A merge counts from when both parts can exist. The furthest chain is found from the largest rank down.
    """
    rules = []
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            u, v = token[:i], token[i:]
            if u in ranks and v in ranks:
                rules.append((max(rank, ranks[u], ranks[v]), u, v))
    rules.sort(key=lambda r: -r[0])
    reach: dict[bytes, int] = {}  # beginning of a right part -> furthest reach of the rules of larger rank
    top = at = 0
    while at < len(rules):
        same = at
        new = []
        while same < len(rules) and rules[same][0] == rules[at][0]:
            _, u, v = rules[same]
            new.append((v, len(u) + reach.get(u, 0)))
            same += 1
        for v, far in new:
            top = max(top, far)
            for i in range(1, len(v) + 1):
                if reach.get(v[:i], 0) < far:
                    reach[v[:i]] = far
        at = same
    return top


class Transducer:
    """Encoder and decoder of a vocabulary of ranked byte strings."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PIECES, lookahead: int | None = None) -> None:
        self.ranks = ranks
        self.tokens = {r: b for b, r in ranks.items()}
        self.longest = max(map(len, ranks))
        self.window = (sufficient_lookahead(ranks) if lookahead is None else lookahead) + 2 * self.longest
        self.widest = 0  # bytes held at most so far
        self.pattern = regex.compile(pattern)
        self.cache: dict[str, tuple[int, ...]] = {}
        self.held: dict[tuple[int, int], bool] = {}
        self.proper: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for b, r in ranks.items():
            self.automaton.add_word(b.decode("latin-1"), (len(b), r))
        self.automaton.make_automaton()

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one or two tokens' bytes by the merge list itself: the lowest rank first, the leftmost of equals."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        ranks = self.ranks
        while len(parts) > 1:
            best, at = None, 0
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def pair_holds(self, a: int, b: int) -> bool:
        """Whether the merge list leaves these two neighbours as they are."""
        got = self.held.get((a, b))
        if got is None:
            if len(self.held) > CACHED:
                self.held.clear()
            got = self.held[a, b] = self.merge(self.tokens[a] + self.tokens[b]) == [a, b]
        return got

    def is_proper(self, token: int) -> bool:
        """Whether the merge list makes this token of its own bytes."""
        got = self.proper.get(token)
        if got is None:
            got = self.proper[token] = self.merge(self.tokens[token]) == [token]
        return got

    def stream(self, piece: bytes) -> Iterator[int]:
        """Ids of a piece of any length, each as soon as it is stable."""
        base = 0  # bytes before this have been emitted
        last: list[int] = [-1]  # last[i]: last token of the prefix of base + i bytes; -1 at base
        back: list[int] = [0]
        before_base = -1  # last emitted token
        proper, held = self.proper, self.held
        full, end = self.window + STRIDE, 0
        # the automaton gives, at each byte, the entries that end there, longest first; every single byte is one
        for at, (length, token) in self.automaton.iter(piece.decode("latin-1")):
            if at < end:
                continue  # this prefix has its last token
            start = at + 1 - length - base
            if start < 0 or (start and back[start] < 0):
                continue
            left = last[start] if start else before_base
            ok = proper.get(token)
            if not (self.is_proper(token) if ok is None else ok):
                continue
            if left >= 0:
                ok = held.get((left, token))
                if not (self.pair_holds(left, token) if ok is None else ok):
                    continue
            last.append(token)
            back.append(start)
            end = at + 1
            if len(last) > full:
                self.widest = max(self.widest, len(last))
                stable = self._stable(last, back)
                if stable:
                    yield from self._walk(last, back, stable)
                    before_base = last[stable]
                    base += stable
                    last, back = [-1, *last[stable + 1 :]], [0, *(max(-1, x - stable) for x in back[stable + 1 :])]
        yield from self._walk(last, back, len(last) - 1)

    def _stable(self, last: list[int], back: list[int]) -> int:
        """The largest prefix that the chains of the last L prefixes share."""
        live = {i for i in range(max(0, len(last) - self.longest), len(last)) if last[i] >= 0}
        while len(live) > 1:
            top = max(live)
            live.discard(top)
            live.add(max(0, back[top]))
        return live.pop() if live else 0

    @staticmethod
    def _walk(last: list[int], back: list[int], at: int) -> list[int]:
        out = []
        while at > 0:
            out.append(last[at])
            at = back[at]
        return out[::-1]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text without special tokens; none for an empty or null text."""
        out: list[int] = []
        if not text:
            return out
        cache = self.cache
        known = cache.get
        for piece in self.pattern.findall(text):
            ids = known(piece)
            if ids is None:
                if len(piece) > CACHED_CHARS:
                    out.extend(self.stream(piece.encode("utf-8")))
                    continue
                ids = tuple(self.stream(piece.encode("utf-8")))
                if len(cache) >= CACHED:
                    cache.clear()
                cache[piece] = ids
            out += ids
        return out

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """Text of ids, as far as its bytes are complete after each; broken bytes become U+FFFD."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            if text := machine.decode(self.tokens[i]):
                yield text
        if text := machine.decode(b"", final=True):
            yield text


_LOADED: dict[int, Transducer] = {}


def _transducer(ranks) -> Transducer:
    """One transducer per Python worker and broadcast vocabulary."""
    if ranks.value["key"] not in _LOADED:
        _LOADED.clear()
        _LOADED[ranks.value["key"]] = Transducer(ranks.value["ranks"], lookahead=ranks.value["lookahead"])
    return _LOADED[ranks.value["key"]]


def _broadcast(df: DataFrame, folder: str, vocabulary: str):
    """The vocabulary goes to the tasks from the driver: under 1 MB, whatever the corpus."""
    ranks = read_ranks(f"{folder}/{vocabulary}.tiktoken")
    return df.sparkSession.sparkContext.broadcast({"key": hash(frozenset(ranks.items())), "ranks": ranks, "lookahead": sufficient_lookahead(ranks)})


def encode_column(documents: DataFrame, folder: str = TOKENIZERS, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """doc_id and ids (list of int) of each document, whole texts, in one pass without a shuffle.

    Empty and null texts have an empty list, never null. Every row comes out once, so repeated documents
    come out repeated; a null doc_id stays null. Odd Unicode is encoded by its bytes.
    """
    ranks = _broadcast(documents, folder, vocabulary)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = _transducer(ranks)
        for s in texts:
            yield pd.Series([t.encode(x) for x in s], dtype=object)

    return spread(documents.select("doc_id", "text"), "doc_id").select("doc_id", ids("text").alias("ids"))


def round_trip(documents: DataFrame, folder: str = TOKENIZERS, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """doc_id, same (whether decoding the ids gives the text back; null and empty texts: the empty text) and digest (MD5 of the decoded text)."""
    ranks = _broadcast(documents, folder, vocabulary)

    @F.pandas_udf("same boolean, digest string")
    def check(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        t = _transducer(ranks)
        for s in texts:
            back = ["".join(t.decode(t.encode(x))) for x in s]
            yield pd.DataFrame({"same": [a == (x or "") for a, x in zip(back, s, strict=True)], "digest": [hashlib.md5(a.encode("utf-8", "surrogatepass"), usedforsecurity=False).hexdigest() for a in back]})

    return spread(documents.select("doc_id", "text"), "doc_id").select("doc_id", check("text").alias("r")).select("doc_id", "r.same", "r.digest")
