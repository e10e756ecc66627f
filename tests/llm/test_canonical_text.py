"""What looks the same has one form, what doesn't has not; pairs against brute force."""

import itertools
import unicodedata

import pytest

from tests.conftest import rows
from tremolith.llm.canonical_text import DISTINCT, SHAPES, canonical, canonical_documents, look_alike_classes, look_alike_pairs, look_alikes, mapping

SAME = [
    ("Ｋelvin ２５", "Kelvin 25"), ("ﾃﾞｰﾀ", "データ"), ("ﾃ゙", "デ"), ("café", "café"), ("саfе́", "café"), ("ё", "ë"), ("й", "й"),
    ("a​b⁠c﻿", "abc"), ("soft\xadhyphen", "softhyphen"), ("a\xa0b c　d", "a b c d"), ("well‑known", "well-known"), ("ｗｅｌｌ－", "well-"),
    ("ρаԁ", "ρad"), ("5 µs", "5 μs"), ("ⅿⅰⅼⅼ", "mill"), ("e​́", "é"), ("K", "K"), ("line\r\nend", "line\nend"), ("👍️", "👍"),
]
OTHER = [*DISTINCT, ("résumé", "resume"), ("10⁶ rows", "106 rows"), ("step ①", "step 1"), ("№ 5", "No 5"), ("to day", "today"), ("Case", "case"), ("👩‍💻", "👩💻"), ("a b", "a  b"), ("й", "и"), ("⚙️", "⚙")]


@pytest.mark.parametrize("a,b", SAME)
def test_same(a, b):
    assert canonical(a) == canonical(b)


@pytest.mark.parametrize("a,b", OTHER)
def test_other(a, b):
    assert canonical(a) != canonical(b)


def test_forms_are_fixed_points():
    for source, target in mapping().items():
        assert canonical(target) == target, source
    for text in itertools.chain(*SAME, *OTHER):
        assert canonical(canonical(text)) == canonical(text)
        assert unicodedata.is_normalized("NFC", canonical(text))


def test_pairs(spark):
    texts = ["pad", "раd", "pad", "pad​", "pads", "", " ", "\xa0", None, "​", "x y", "x\xa0y", "раd"]
    data = [(i, t) for i, t in enumerate(texts)] + [(0, "pad"), (None, "pad")]
    expected = sorted({(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if texts[i] and texts[j] and texts[i] != texts[j] and canonical(texts[i]) == canonical(texts[j]) and canonical(texts[i]).strip()})
    df = spark.createDataFrame([(*d, "z", "z") for d in data], "doc_id bigint, text string, form string, id string")
    assert rows(look_alike_pairs(df)) == sorted(expected, key=repr)
    assert rows(canonical_documents(df.select("doc_id", "text").where("doc_id in (1, 5, 8, 9)"))) == [(1, "pad"), (5, ""), (8, None), (9, "")]


def test_empty_and_very_long(spark):
    assert look_alike_pairs(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
    df = spark.createDataFrame([(1, "а" * 200_000), (2, "a" * 200_000)], "doc_id bigint, text string")
    assert rows(look_alike_pairs(df)) == [(1, 2)]


MISSED_ONCE = [
    ("5 \u2212 3", "5 - 3"), ("\u03c1ort", "port"), ("\u03c5ser", "user"), ("\u13aa\u13da", "AS"), ("\u2c9e\u2ca2", "OP"), ("\u050cateway", "Gateway"), ("\u1d04\u1d0f\ua731t", "cost"),
    ("a\u115fb", "ab"), ("a\u3164b", "ab"), ("a\uffa0b", "ab"), ("a\u2800b", "a b"), ("\u216fL", "ML"), ("a\u17b4b\u180bc", "abc"),
]


@pytest.mark.parametrize("a,b", MISSED_ONCE)
def test_shapes_fillers_and_signs_of_other_blocks(a, b):
    assert canonical(a) == canonical(b)


def test_every_generated_look_alike_is_found_inside_words():
    table = look_alikes()
    assert len(table) > sum(len(v.split()) for v in SHAPES.values())
    for source, target in table.items():
        assert canonical(f"x{source}y z{source}") == canonical(f"x{target}y z{target}")


def test_classes_count_links_without_pairs(spark):
    texts = ["pad", "раd", "pad", "pad\u200b", "pads", "", " ", None, "x y", "x\xa0y", "раd", "alone"]
    data = [(i, t) for i, t in enumerate(texts)] + [(0, "pad"), (None, "pad")]
    got = {r.doc_id: r for r in look_alike_classes(spark.createDataFrame(data, "doc_id bigint, text string")).collect()}
    assert set(got) == {i for i, t in enumerate(texts) if t and t.strip()}
    for i, r in got.items():
        others = [j for j in got if canonical(texts[j]) == canonical(texts[i]) and texts[j] != texts[i]]
        assert r.links == len(others) and r.texts == len({texts[j] for j in got if canonical(texts[j]) == canonical(texts[i])})
        assert all(got[j]["class"] == r["class"] for j in others)
