"""Text, code and number functions against plain statements of their rules."""

import re
import unicodedata

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ribeira.functions.text import clean_code, coerce_numeric, fold_to_ascii, localized_number, normalize_text, slug


def apply(spark, function, values):
    rows = spark.createDataFrame(list(enumerate(values)), "i INT, v STRING")
    return [r["out"] for r in rows.select("i", function(F.col("v")).alias("out")).orderBy("i").collect()]


def plain_ascii(value):
    return unicodedata.normalize("NFKD", value or "").encode("ascii", "ignore").decode()


def plain_normalized(value):
    return " ".join(plain_ascii(value).lower().split())


TEXTS = [
    None, "", "  Mojuí   dos Campos ", "straße", "øre", "ﬁn…½ ㉑x", "a b c　", "̈́x", "ＡＢＣ１",
    "ﷺ", "𝐀𝟗", "x\n", " \x1c y\x1f ", "\U0001f096W𝟅ẹ", "Unidade (Código)", "___", "'quoted\\",
]


def test_normalize_text(spark):
    assert apply(spark, normalize_text, TEXTS) == [plain_normalized(t) for t in TEXTS]
    assert apply(spark, normalize_text, ["  Mojuí   dos Campos ", "straße"]) == ["mojui dos campos", "strae"]


def test_slug(spark):
    expected = [re.sub("[^a-z0-9]+", "_", plain_normalized(t)).strip("_") for t in TEXTS]
    assert apply(spark, slug, TEXTS) == expected
    assert apply(spark, slug, [" Unidade (Código) "]) == ["unidade_codigo"]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(blacklist_categories=("Cs",))), min_size=100, max_size=200))
def test_folding_any_text(spark, values):
    assert apply(spark, fold_to_ascii, values) == [plain_ascii(v) for v in values]


def test_every_character_with_an_ascii_form(spark):
    points = [chr(p) for p in range(0x80, 0x20000) if not 0xD800 <= p <= 0xDFFF and plain_ascii(chr(p))]
    assert apply(spark, fold_to_ascii, points) == [plain_ascii(p) for p in points]


@pytest.mark.parametrize(
    "value, code",
    [
        ("1500107", "1500107"), ("1500206.0", "1500206"), (" 12 ", "0000012"), ("12345678", "12345678"), ("a1", None),
        ("", None), ("-1", None), ("1.5", None), ("1500206.0 ", None), (None, None), ("12.0\n", "0000012"),
        (" 12　", "0000012"), ("0", "0000000"),
    ],
)
def test_clean_code(spark, value, code):
    assert apply(spark, clean_code, [value]) == [code]


NUMBERS = [
    "1.234,5", "-", "X", "-5", " 1 234 ", ",5", "..", "...", "", "1,2,3", "5d", "1_0", None, "1e5", "1E+3", "inf", "-inf",
    "Infinity", "nan", "NaN", "0x10", "1,", "+5", "--5", "1e", "e5", "\t5", "5\n", "1e400", "-1e400", "1e-400", "True", "1f",
]


def test_localized_number(spark):
    cleaned = pd.Series(NUMBERS, dtype="string").str.replace(r"[ .]", "", regex=True).str.replace(",", ".")
    expected = [None if pd.isna(v) else float(v) for v in pd.to_numeric(cleaned, errors="coerce")]
    assert apply(spark, localized_number, NUMBERS) == expected
    assert apply(spark, localized_number, ["1.234,5", "-", "X"]) == [1234.5, None, None]


def test_coerce_numeric(spark):
    expected = [None if pd.isna(v) else float(v) for v in pd.to_numeric(pd.Series(NUMBERS, dtype="string"), errors="coerce")]
    assert apply(spark, coerce_numeric, NUMBERS) == expected
