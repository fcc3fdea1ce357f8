"""Problem 6: spellings of founders."""

import pytest

from terazi.llm import canonical
from terazi.llm.canonical import Matcher, alike, edits, fold, map_founders, repair

NAMES = ["VELMİRA PORTFÖY", "VELMİRA EMEKLİLİK VE HAYAT", "KORZUN PORTFÖY", "KORTUNA PORTFÖY", "TALVERİ PORTFÖY", "TALVERDİN PORTFÖY", "MİRKENT PORTFÖY", "MİRKENTAŞ EMEKLİLİK", "BAYKUTAN PYŞ", "LOMTARA YATIRIM PORTFÖY"]
M = Matcher(NAMES)


@pytest.mark.parametrize(
    ("title", "name"),
    [
        ("VELMİRA PORTFÖY BİRİNCİ FON", "VELMİRA PORTFÖY"),
        ("velmi̇ra emekli̇li̇k & hayat ikinci fon", "VELMİRA EMEKLİLİK VE HAYAT"),
        ("VELM İRA PORTF.YÖN. ÜÇÜNCÜ FON", "VELMİRA PORTFÖY"),
        ("VELMÄ°RA PORTFÃ\x96Y BEÅ\x9eÄ°NCÄ° FON", "VELMİRA PORTFÖY"),
        ("BİRİNCİ LİKİT FONU / MİRKENTAŞ", "MİRKENTAŞ EMEKLİLİK"),
        ("ÜÇÜNCÜ FON (MİRKENT PRTF.)", "MİRKENT PORTFÖY"),
        ("TAVLERDİN PORTFÖY ALTIN FONU", "TALVERDİN PORTFÖY"),
        ("TALVERİPORTFÖY ALTIN FONU", "TALVERİ PORTFÖY"),
        ("BEKUTAN P.Y.Ş. LİKİT FON", "BAYKUTAN PYŞ"),
        ("ALTIN FONU - LOMTARA", "LOMTARA YATIRIM PORTFÖY"),
        ("KORTENA PORTFÖY FON", "KORTUNA PORTFÖY"),
        ("ROZAKENDİ PORTFÖY KARMA FON", "UNMATCHED"),
        ("KORZUN EMEKLİLİK KARMA FON", "UNMATCHED"),
        ("", "UNMATCHED"),
        ("!!!", "UNMATCHED"),
    ],
)
def test_titles(title, name):
    assert M.resolve(title)[0] == name


def test_parts():
    assert repair("PORTFÃ\x96Y") == "PORTFÖY" and repair("PORTFÖY") == "PORTFÖY"
    assert fold("İlbersu  P.Y.Ş., (TL)") == "ilbersu p y s tl"
    assert [edits("abcd", x, 2) for x in ("abcd", "abdc", "abc", "xbcdy", "zzzz")] == [0, 1, 1, 2, 3]


def test_token_sets(monkeypatch):
    """Words of a name count by their letters, in any order; without the similarity only mentions are left."""
    m = Matcher(["GÜNEŞLİ KORU PORTFÖY", "KORU PORTFÖY"])
    assert alike("korzum", "korzun") == pytest.approx(5 / 6) and alike("korz", "xyzw") == 0
    assert m.resolve("KORU GÜNESLY PORTFÖY FON")[1] == "mention"  # the shorter name is written in full
    titles = ["TAVLERDİN PORTFÖY ALTIN FONU", "BEKUTAN P.Y.Ş. LİKİT FON", "KORTENA PORTFÖY FON", "VELMİRA PORTFÖY BİRİNCİ FON"]
    monkeypatch.setattr(canonical, "LEAST_SET", 1.01)
    assert [M.resolve(t)[0] for t in titles] == ["UNMATCHED"] * 3 + ["VELMİRA PORTFÖY"]


def test_long_list_in_parts(spark):
    """A list of several parts gives what one part gives, whatever the parts."""
    titles = ["VELMİRA PORTFÖY FON", "VELMİRA", "TAVLERDİN PORTFÖY ALTIN", "TALVERİPORTFÖY", "MİRKENTAŞ EMEKLİLİK", "KORTENA PORTFÖY FON", "ROZAKENDİ KARMA", "KORZUN EMEKLİLİK", " ", "LOMTARA YATIRIM PORTFÖY"]
    general = spark.createDataFrame([(f"F{i}", t) for i, t in enumerate(titles)], "fonkodu string, fonunvan string")
    reference = spark.createDataFrame([(n,) for n in NAMES], "name string")
    one, parts = ({(r.fonkodu, r.fonunvan, r.name, r.how) for r in map_founders(general, reference, most).collect()} for most in (100, 3))
    assert one == parts and len(one) == len(titles)


def test_table(spark):
    general = spark.createDataFrame(
        [("aa ", "VELMİRA PORTFÖY ALTIN FON"), ("AA", "VELMİRA PORTFÖY ALTIN FON"), ("AA", "ALTIN FON - VELMİRA"), ("BB", "ALTIN FON - VELMİRA"), (None, "KORZUN PORTFÖY"), ("CC", None), ("DD", " "), ("EE", "x" * 5000)],
        "fonkodu string, fonunvan string",
    ).selectExpr("*", "1 as fund", "2 as value", "'n' as name", "'c' as core")
    reference = spark.createDataFrame([(n,) for n in [*NAMES, None, ""]], "name string")
    got = {(r.fonkodu, r.fonunvan): r.name for r in map_founders(general, reference).collect()}
    assert got == {
        ("AA", "VELMİRA PORTFÖY ALTIN FON"): "VELMİRA PORTFÖY", ("AA", "ALTIN FON - VELMİRA"): "VELMİRA PORTFÖY", ("BB", "ALTIN FON - VELMİRA"): "UNMATCHED", ("DD", " "): "UNMATCHED", ("EE", "x" * 5000): "UNMATCHED",
    }
    assert {r.name for r in map_founders(general, reference.limit(0)).collect()} == {"UNMATCHED"}
    assert map_founders(general.limit(0), reference).count() == 0
