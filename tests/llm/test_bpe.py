"""Problem 8 against the tokenizer library and by round trips."""

import os
import random

import pytest

from terazi.llm.bpe import PIECES, STRIDE, TOKENIZERS, Transducer, encode_column, read_ranks, round_trip, sufficient_lookahead

FILE = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
pytestmark = pytest.mark.skipif(not os.path.exists(FILE), reason="no vocabulary here")


@pytest.fixture(scope="module")
def pair():
    import tiktoken

    ranks = read_ranks(FILE)
    return Transducer(ranks), tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(4)
    for alphabet in ("ab", "aeiou nrt", ".,;-=_", "█▒░¶", "ıİşğ ", "\U0001f600́x", " \n\t ", "0123456789", "the of and "):
        for n in (1, 3, 60, 1500):
            yield "".join(rng.choice(alphabet) for _ in range(n))
    yield from ("", " ", "<|endoftext|>", "don't we'll I'VE", "=" * 5000, "a" * 20000, "\x00\x01", "Ünlü   satır\r\n\r\n  sonu  ")


def test_ids_equal_the_library(pair):
    mine, library = pair
    for t in texts():
        assert mine.encode(t) == library.encode_ordinary(t)
        assert "".join(mine.decode(mine.encode(t))) == t


def test_stream_equals_the_merges_within_the_window(pair):
    mine, library = pair
    rng = random.Random(8)
    for _ in range(40):
        piece = bytes(rng.choice(b"abcdet =-") for _ in range(rng.choice([1, 10, 300])))
        assert list(mine.stream(piece)) == mine.merge(piece)
    mine.widest = 0
    for word in ("the cat sat on ", "ÃÂ", "=", "- ", " _", "\u2588"):
        piece = (word * 9000).encode()
        assert list(mine.stream(piece)) == library._encode_single_piece(piece)
    assert 0 < mine.widest <= mine.window + STRIDE + 1


def test_every_piece_goes_through_the_transducer(pair, monkeypatch):
    """The only other source of ids is the memory of earlier pieces: without the stream nothing is encoded."""
    ranks = pair[0].ranks
    fresh = Transducer(ranks, lookahead=864)
    monkeypatch.setattr(Transducer, "stream", lambda self, piece: iter(()))
    assert fresh.encode("the fund kept its share") == []


def test_lookahead():
    """Of a list that builds one token from right to left, the whole token may still change; of single bytes nothing."""
    assert sufficient_lookahead({bytes([b]): b for b in range(256)}) == 0
    ranks = {bytes([b]): b for b in range(256)} | {b"yz": 256, b"xy": 257, b"wx": 258, b"vw": 259}
    assert sufficient_lookahead(ranks) == 4  # z decides about y, that about x, w and v
    mine = Transducer(ranks)
    assert [mine.encode(t) for t in ("vwxy", "vwxyz")] == [[259, 257], [ord("v"), 258, 256]]


def test_table(spark):
    data = spark.createDataFrame([(1, "Fon payı 12,5"), (2, ""), (3, None), (None, "x"), (1, "Fon payı 12,5")], "doc_id bigint, text string").selectExpr("*", "7 as ids")
    got = encode_column(data).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, len(r.ids) > 0) for r in got) == [(False, 1, True), (False, 1, True), (False, 2, False), (False, 3, False), (True, 0, True)]
    assert all(r.same for r in round_trip(data).collect())
    assert encode_column(data.limit(0)).count() == 0
