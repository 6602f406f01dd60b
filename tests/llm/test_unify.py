import unicodedata

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from colonnade.llm import unify as u

T = u.tables()


def one(*texts):
    return u.unify_array(pa.array(texts, pa.string()), T).to_pylist()


def test_forms_of_one_text():
    same = [
        ("ｆｕｌｌ－ｗｉｄｔｈ　１２", "full-width 12"), ("été", "été"), ("oﬃce ﬁt", "office fit"), ("a b c　d", "a b c d"),
        ("co­op​ ﻿x⁠", "coop x"), ("non‑stop‐x", "non-stop-x"), ("SЕLECT pаypаl", "SELECT paypal"), ("Αccοrding", "According"),
        ("зaпрос", "запрос"), ("q̣̇", "q̣̇"), ("q̣̇", "q̣̇"), ("한", "한"), ("réр", "rép"), ("a\r\nb", "a\nb"),
        ("ǆ", "dž"), ("Å", "Å"), ("t1_сode", "t1_code"),
    ]
    assert one(*[a for a, _ in same]) == [unicodedata.normalize("NFC", b) for _, b in same]


def test_what_a_reader_sees_stays():
    stay = ["m² m2 m³", "Straße STRASSE", "resume résumé", "по-русски и это", "λόγος", "中文。", "½ ① ™ ª", "a\tb\nc", "O0 l1", "х а о", "", " "]
    assert one(*stay) == stay


def test_nulls_and_nothing_visible():
    assert one(None, "", "​﻿", "x", None) == [None, "", "", "x", None]
    assert u.unify_array(pa.array([], pa.string()), T).to_pylist() == []
    assert u.unify_array(pa.array([None, None], pa.string()), T).to_pylist() == [None, None]


def test_slices_and_long_texts():
    texts = ["ａ" * 300_000, None, "b" * 2_000_000, "é" * 1000, ""]
    got = u.unify_array(pa.array(["skip", *texts], pa.string())[1:], T).to_pylist()
    assert got == ["a" * 300_000, None, "b" * 2_000_000, "é" * 1000, ""]


ALPHABET = st.characters(exclude_categories=["Cs", "Cn", "Co", "Cf", "Cc"], max_codepoint=0x2FFF)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(ALPHABET, max_size=12), max_size=6))
def test_result_is_composed_and_stable(texts):
    got = one(*texts)
    assert got == one(*got)
    latin = [t for t in texts if t.isascii()]
    assert one(*latin) == latin


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("aeéoqñụ̧̈́̈̃ ắ"), max_size=14).map("".join))
def test_marks_compose_as_the_standard_says(text):
    assert one(text) == [unicodedata.normalize("NFC", text)]
    assert one(unicodedata.normalize("NFD", text)) == one(text)


def test_pairs(spark):
    rows = [(1, "ａbc"), (2, "abc"), (3, "abc"), (4, "a​bc"), (5, ""), (6, None), (7, "​"), (8, "ABC"), (9, "⁠"), (2, "abc")]
    df = spark.createDataFrame(rows[:-1], "id bigint, text string").selectExpr("id", "text", "1 as raw", "2 as form")
    got = [tuple(r) for r in u.look_alike_pairs(spark, df, "id", "text").collect()]
    assert sorted(got) == [(1, 2), (1, 3), (1, 4), (2, 4), (3, 4), (7, 9)]
    assert u.look_alike_pairs(spark, spark.createDataFrame([], "id bigint, text string"), "id", "text").count() == 0


def test_column_keeps_its_place(spark):
    df = spark.createDataFrame([(1, "ａ", "x")], "id bigint, text string, unified string")
    assert u.unify(df, "text").collect() == [(1, "ａ", "a")]
    assert u.unify(df, "text", "text").columns == ["id", "text", "unified"]
    assert np.array_equal(T["src"], np.sort(T["src"]))


def test_further_look_alikes_and_fillers():
    """Greek and Armenian letters in Latin words, fillers that take no room, and a blank that is no blank by category."""
    pairs = {"d\u03b1ta": "data", "\u03c1age": "page", "w\u0585rd": "word", "\u0578ame": "name", "a\u115fb\u3164c\u17b4\uffa0": "abc", "a\u2800b": "a b", "\u03b1\u03b2\u03b3": "\u03b1\u03b2\u03b3"}
    assert u.unify_array(pa.array(list(pairs))).to_pylist() == list(pairs.values())
