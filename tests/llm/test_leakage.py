"""Problem 9: pieces by brute force, and the recall of the latent search."""

import random

import numpy as np

from terazi.llm import leakage
from terazi.llm.leakage import PIECE, Item, common_subsequence, document_frequencies, encode, find_leaks, joined, may_leak, pairs_of, tokens_of, windows

RNG = random.Random(11)
VOCABULARY = [f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{i}x" for i in range(900)]


def passage(n, words=VOCABULARY):
    return [RNG.choice(words) for _ in range(n)]


def test_folding():
    assert tokens_of("Ağır İŞLEM, 1.234,5 so-called  ‘x’!") == ["agir", "islem", "12345", "socalled", "x"]
    assert tokens_of(None) == tokens_of("") == tokens_of(" \n.,") == []


HASH = leakage.Hasher()


def coded(words):
    return np.array(HASH.codes(words), dtype=np.uint64)


def pieces(a, b):
    return leakage.pieces(Item.of(HASH.codes(a)), coded(b))


def carried(a, b):
    return leakage.carried(Item.of(HASH.codes(a)), coded(b))


def leaks(a, b):
    return leakage.leaks(Item.of(HASH.codes(a)), coded(b))


def test_pieces_survive_single_alterations():
    a = passage(60)
    exact = passage(5) + a[10:30] + passage(7)
    assert pieces(a, exact)[0][:2] == (10, 30)
    for change in (lambda x: x[:10] + ["zz"] + x[11:], lambda x: x[:10] + x[11:], lambda x: x[:10] + ["zz"] + x[10:]):
        assert pieces(a, passage(4) + change(a[10:34]) + passage(4))[0][:2] == (10, 34)
    assert pieces(a, a[10:20] + passage(3) + a[40:50]) == []


def test_regular_alterations():
    """Every third word altered, from the start or after five words: one piece, and a leak."""
    a = [f"u{i}" for i in range(100)]
    late = [w if i <= 5 or i % 3 else "zz" for i, w in enumerate(a)]
    early = [w if i % 3 != 2 else "zz" for i, w in enumerate(a)]
    assert carried(a, late) == leaks(a, late) == 99  # the last word is altered
    assert carried(a, early) == leaks(a, early) == 100  # the last word stands alone at the end
    assert leaks(a, [w if i % 2 else "zz" for i, w in enumerate(a)]) == 0


def test_share_and_order():
    a = passage(100)
    filler = passage(20)
    assert carried(a, a[0:20] + filler + a[50:75]) == 45
    assert carried(a, a[50:75] + filler + a[0:20]) == 25
    assert leaks(a, a[0:20] + filler + a[50:75]) == 45
    assert leaks(a, a[0:39]) == 0 and leaks(a, a[0:40]) == 40
    assert leaks(a, []) == 0 and leaks([], a) == 0
    assert leaks(a[: PIECE - 1], a) == 0


def test_repetitive_item():
    """An item of one phrase, twenty times over, still leaks."""
    a = ["we", "sell", "gold", "and", "bonds"] * 20
    assert leaks(a, passage(10) + a[:60] + passage(5)) >= 40


def slow_carried(a, b, least=PIECE):
    """Pieces grown word by word from every pair of equal words, without runs or indices."""
    out = set()
    for i in range(len(a) - 1):
        for j in range(len(b) - 1):
            if a[i : i + 2] != b[j : j + 2]:
                continue
            x, y = i, j
            while True:
                while x < len(a) and y < len(b) and a[x] == b[y]:
                    x, y = x + 1, y + 1
                step = next((g for g in leakage.GAPS if a[x + g[0] : x + g[0] + 2] == b[y + g[1] : y + g[1] + 2] and len(a[x + g[0] : x + g[0] + 2]) == 2), None)
                if step is None:
                    break
                x, y = x + step[0], y + step[1]
            if x - i >= least:
                out.add((i, x, j, y))
    return max((p[1] - p[0] for p in out), default=0)


def test_bound_and_runs_against_slow_search():
    rng = random.Random(3)
    for n in range(300):
        words = [f"k{i}" for i in range(rng.choice([6, 30, 400]))]
        a = [rng.choice(words) for _ in range(rng.randint(12, 60))]
        b = list(a) if rng.random() < 0.7 else [rng.choice(words) for _ in a]
        for _ in range(rng.randint(0, len(b) // 3)):
            at = rng.randrange(len(b))
            b[at : at + rng.randint(0, 1)] = [rng.choice(words)] * rng.randint(0, 1)
        b = [rng.choice(words) for _ in range(rng.randint(0, 9))] + b
        if len(b) < 2:
            continue
        item = Item.of(HASH.codes(a))
        got, slow = leakage.carried(item, coded(b)), slow_carried(a, b)
        assert got >= slow
        if got >= 0.4 * len(a):  # the bound never rules out what the search finds
            assert may_leak(item, np.unique(pairs_of(coded(b))))


def test_common_subsequence():
    rng = random.Random(6)
    for _ in range(50):
        a, b = ([rng.randrange(9) for _ in range(rng.randint(0, 40))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            old = row[:]
            for j, y in enumerate(b):
                row[j + 1] = old[j] + 1 if x == y else max(row[j], old[j + 1])
        assert common_subsequence(a, b) == row[-1]


def test_windows_and_features():
    codes, lengths = joined([[2] * 30, [], [4, 6]])
    text, first, last = windows(lengths)
    assert text.tolist() == [0, 0, 2] and (last - first).tolist() == [24, 18, 2]
    win, code, count = leakage.features(codes, first, last)
    assert win.tolist() == [0, 0, 1, 1, 2, 2, 2] and sorted(count[:2].tolist()) == [23, 24] and len(set(code[:4].tolist())) == 2


def test_sums_in_groups_equal_direct_ones(spark):
    texts = encode(spark.createDataFrame([(i, " ".join(passage(40))) for i in range(60)], "doc_id bigint, text string").repartition(12))
    usual = document_frequencies(texts)
    old, leakage._summed.__defaults__ = leakage._summed.__defaults__, (3,)
    try:
        grouped = document_frequencies(texts)
    finally:
        leakage._summed.__defaults__ = old
    assert usual[1] == grouped[1] > 0 and np.array_equal(usual[0], grouped[0])


def test_search_finds_all_leaks(spark):
    own = [f"t{chr(97 + i % 26)}{i}q" for i in range(500)]
    items = [(i, passage(90, own)) for i in range(30)]
    docs, truth = [], set()
    for d in range(240):
        words = passage(120)
        if d % 4 == 0:
            i = RNG.randrange(30)
            a = items[i][1]
            words[40:40] = [w.upper() if RNG.random() < 0.5 else w for w in a[10:32]]
            words[90:90] = a[50:68]
            truth.add((d, i))
        if d % 4 == 1:  # too little
            words[40:40] = items[RNG.randrange(30)][1][10:30]
        docs.append((d, " ".join(words)))
    docs += [(1000, None), (1001, ""), (1002, "  \n"), (None, " ".join(items[3][1]))]
    documents = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 as item_id", "'c' as codes")
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(99, None), (98, "")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in find_leaks(documents, table).collect()}
    assert got == truth | {(None, 3)}
    blocks = find_leaks(documents, table, block_words=500).collect()  # six blocks of items
    assert {(r.doc_id, r.item_id) for r in blocks} == truth | {(None, 3)} and len(blocks) == len(truth) + 1
    # the latent search decides: with no cosine high enough nothing is checked, and it rules most pairs out
    assert find_leaks(documents, table, cosine=1.01).count() == 0
    assert find_leaks(documents, table, check=False).count() < 0.5 * len(docs) * len(items)
    assert find_leaks(documents.limit(0), table).count() == 0
    assert find_leaks(documents, table.limit(0)).count() == 0


def test_paraphrases(spark):
    """A text that retells an item, with its facts and its order but no piece of 12 words, is reported beside the leaks."""
    rng = random.Random(5)

    def passage(n, words=VOCABULARY):
        return [rng.choice(words) for _ in range(n)]

    own = [f"t{chr(97 + i % 26)}{i}q" for i in range(300)]
    items = [(i, passage(60, own) + [str(1000 + i)]) for i in range(5)]
    told = [w if i % 8 < 6 or i == 60 else f"z{chr(97 + i % 26)}q" for i, w in enumerate(items[2][1])]
    told = [x for i, w in enumerate(told) for x in ((w, "zz") if i % 8 == 7 else (w,))]  # two words altered and one inserted
    docs = [(d, " ".join(passage(100))) for d in range(60)] + [(100, " ".join(told)), (101, " ".join(items[1][1]))]
    documents = spark.createDataFrame(docs, "doc_id bigint, text string")
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id, r.kind) for r in find_leaks(documents, table, paraphrases=True).collect()}
    assert got == {(100, 2, "paraphrase"), (101, 1, "passage")}
    assert {r.doc_id for r in find_leaks(documents, table).collect()} == {101}
