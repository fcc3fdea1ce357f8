"""Problem 10: statistics and kinds of texts."""

import random

import numpy as np
import pytest

from terazi.llm.quality import LIMIT, STATISTICS, chi_square, document_quality, line_shares, statistics

PROSE = "The fund kept its share of term deposits in March, because the curve had flattened again and inflows were small. It is not clear whether the board will change the fee after the audit of the last quarter. "
TURKISH = "Fon kurulu mart ayında vadeli mevduat payını korudu, çünkü getiri eğrisi yeniden yataylaştı ve girişler sınırlı kaldı. Bu not daha önce olduğu gibi bir işaret vermiyor. "


LONG = PROSE + (
    "Members of the older plans waited for the monthly report and asked how flows are told from prices. In the same week the desk sold gold, although nobody had expected it, and the committee met twice before it could agree on a figure. "
    "When the auditors had left, a short note explained which contracts were renewed and why others had to lapse. Few savers read it to the end; those who did found that the cost of hedging had doubled since the autumn. "
)


def wrapped(text, n):
    w = text.split()
    return "\n".join(" ".join(w[i : i + n]) for i in range(0, len(w), n))


RUNNING = [PROSE, TURKISH, PROSE.upper(), PROSE.replace(".", "").replace(",", ""), wrapped(LONG, 7), wrapped(LONG.replace(".", "").replace(",", ""), 8), LONG + "\n- fees\n- inflows\n- dividends", "— Did it rise in March?\n— It did not, because inflows were small.\n— And after the audit?\n— Then the board had sold the bonds.", "Net flows of the fund stayed negative in March.", PROSE.replace(" ", "  "), wrapped("— " + LONG, 9)]
CASES = [
    ("\n".join(f"- item {i} fees" for i in range(12)), "list"),
    ("\n".join(f"{i}) coupon income {i}.5" for i in range(12)), "list"),
    ("fees:\n" + "\n".join(random.Random(i).choice(["coupon income", "late subscriptions, inflows", "the fee schedule", "gold fund A", "net dividends 12"]) + f" {chr(97 + i)}" for i in range(14)), "list"),
    ("\n".join(f"| AB{i} | 2024-01-{i + 10} | {i * 7} | 3.5 |" for i in range(9)), "table"),
    ("\n".join(f"AB{i}\t2024-01-{i + 10}\t{i * 7}\t3.5" for i in range(9)), "table"),
    ("\n".join(f"AB{i};2024-01-{i + 10};{i * 7};3,5" for i in range(9)), "table"),
    ("\n".join(f"key=AB{i}   day=2024-01-{i + 10}   size={i * 7}" for i in range(9)), "table"),
    ("\n".join(f"<tr><td>A{i}</td><td>{i}</td><td>x</td></tr>" for i in range(9)), "table"),
    ("@#~ ^&*( )_+| }{ <>? " * 20, "junk"),
    ("".join(random.Random(5).choice("lnrtpfoI1 |.,:;'~_·¬   ") for _ in range(400)), "junk"),
    ("a" * 300, "junk"),
    ("fees dividends " * 60, "junk"),
    ("Home » Login » RSS » Home » Menu » Login » Home » RSS » Menu » Home » Menu » Login » RSS » Login", "junk"),
    ("\n".join(f"{i}44777533 ERR 75d2692b at 0xaa802c 8e258fdc1f25be84bd6affe0" for i in range(6)), "junk"),
    ("xkcd vrnt pqrs bcdf ghjk lmnp qrst vwxz " * 3, "junk"),
]


def corpus(spark):
    """Prose of two languages in many variants, about four fifths of the rows; then the texts of RUNNING and CASES."""
    rng, rows = random.Random(3), []
    for i in range(400):
        base, lang = (LONG, "en") if i % 2 else (TURKISH * 4, "tr")
        words = base.split()
        size = rng.randint(8, len(words))
        at = rng.randint(0, len(words) - size)
        text = " ".join(words[at : at + size] if i % 2 else rng.sample(words[at : at + size], size))
        text = {0: text.upper(), 1: text.replace(".", "").replace(",", ""), 2: wrapped(text, rng.randint(7, 11))}.get(i % 7, text)
        rows.append((i, text + ("" if i % 7 == 1 else "."), lang))
    rows += [(1000 + i, t, None) for i, t in enumerate(RUNNING)] + [(2000 + i, t, "en") for i, (t, _) in enumerate(CASES)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string")


def test_kinds_by_distance(spark):
    out = {r.doc_id: r for r in document_quality(corpus(spark)).collect()}
    assert {RUNNING[i]: out[1000 + i].kind for i in range(len(RUNNING)) if out[1000 + i].kind} == {}
    assert [out[2000 + i].kind for i in range(len(CASES))] == [k for _, k in CASES]


def test_the_distance_decides(spark):
    """Without a limit every text with words is a case: no rule beside the distance makes one."""
    df = corpus(spark)
    usual, none = (sum(r.kind is not None for r in document_quality(df, limit).select("kind").collect()) for limit in (LIMIT, -1.0))
    assert usual < 40 and none == df.count()


def test_greater_part(spark):
    """A list that is the lesser part of a text doesn't make it a case; one that is the greater part does."""
    df = corpus(spark)
    items = [f"- coupon income of fund {i}" for i in range(40)]
    mixed = [(5000 + n, LONG + LONG[7:500] + "\n" + "\n".join(items[:n]), "en") for n in (3, 8)] + [(5040, PROSE + "\n" + "\n".join(items), "en")]
    out = {r.doc_id: r.kind for r in document_quality(df.unionByName(df.sparkSession.createDataFrame(mixed, df.schema))).collect()}
    assert out[5003] is None and out[5008] is None and out[5040] == "list"


def test_line_shares():
    assert line_shares(["a|1|2", "x"])[1] > 0.5 and line_shares(["- fees"])[0] == 1.0
    assert line_shares(["Home | Login | RSS", "Plain words here."]) == (0.0, 0.0)


def test_empty_texts():
    for t in (None, "", "  \n\t", " "):
        assert statistics(t, "TR")[1] == 0 and not any(statistics(t, None)[2:])


def test_quantile():
    assert chi_square(10, 1.959964) == pytest.approx(20.483, rel=0.01)


def test_table(spark):
    rng = random.Random(2)
    words = PROSE.split()
    docs = [(i, " ".join(rng.sample(words, len(words))) + "." if i % 2 else TURKISH * rng.randint(1, 3), "en" if i % 2 else None) for i in range(200)]
    docs += [(900, "\n".join(f"| A{i} | {i} | {i * 3},5 |" for i in range(20)), "en"), (901, None, "tr"), (902, "", None), (903, " ", "xx"), (904, "@#$ %^& " * 40, None), (904, "@#$ %^& " * 40, None), (905, PROSE * 3000, "en"), (None, "- a\n- b\n- c\n- d\n- e\n- f", "en")]
    out = document_quality(spark.createDataFrame(docs, "doc_id bigint, text string, lang string").selectExpr("*", "1 as words", "2 as kind", "3 as distance")).collect()
    assert len(out) == len(docs)
    kinds = {r.doc_id: r.kind for r in out}
    assert kinds[900] == "table" and kinds[904] == "junk" and kinds[None] == "list"
    assert all(kinds[i] is None for i in (*range(200), 901, 902, 903, 905) if i != 905)
    for r in out:
        assert set(r.contributions) == set(STATISTICS) and np.isclose(sum(r.contributions.values()), r.distance)
    assert document_quality(spark.createDataFrame([], "doc_id bigint, text string, lang string")).count() == 0
