"""Vectors of the scalar normalisers."""

from datetime import date
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tenderwatch.functions import normalise as N


def apply(spark, fn, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(fn(F.col("v"))).collect()]


D = date(2023, 10, 15)
DATES = [
    ("2023-10-15", D), ("15/10/2023", D), ("15-10-2023", D), ("2023/10/15", D), ("2023-10-15T12:00:00Z", D),
    ("2023-10-15T23:30:00-05:00", D), ("2023-10-15 23:30:00.123", D), ("2023-10-15T12", D), (" 2023-10-15\n", D),
    ("1/2/2023", date(2023, 2, 1)), ("2023-1-2", date(2023, 1, 2)), ("29/02/2024", date(2024, 2, 29)),
    ("31/02/2023", None), ("15/10/23", None), ("2023-10-15 junk", None), ("2023-10-15T25:00", None),
    ("invalid", None), (None, None), ("", None), ("  ", None),
]
AMOUNTS = [
    ("$ 15000", "15000"), ("COP 15000", "15000"), ("15,000.50", "15000.50"), ("15.000,50", "15000.50"),
    ("15,000", "15000"), ("15,50", "15.50"), ("15,5", "15.5"), ("15,", "15"), ("1,000,000", "1000000"),
    ("1.000", "1.00"), ("-5", "-5"), (".5", "0.5"), ("5.", "5"), ("1.000.000,25", "1000000.25"),
    ("1,000,000.255", "1000000.26"), ("(1.234,5)", "1234.5"), ("1.000.000", None), ("1,000,00", None),
    ("1-2", None), ("--5", None), ("invalid", None), ("", None), (None, None), ("-", None), (".", None),
]
TEXTS = [
    ("  Texto   con  espacios  ", "TEXTO CON ESPACIOS"), ("Texto\ncon\ttabs", "TEXTO CON TABS"), ("TeXto MiXtO", "TEXTO MIXTO"),
    ("contratación directa ñ", "CONTRATACIÓN DIRECTA Ñ"), ("straße", "STRASSE"), ("a\x1cb", "A B"),
    ("\r\n\t ", None), (None, None), ("", None),
]
URLS = [
    ("{'url': 'https://x/y?z=1'}", "https://x/y?z=1"), ('{"url": "https://x/y"}', "https://x/y"),
    ("{'title': 'a', 'url': 'https://x/y'}", "https://x/y"), ("{'url': 'https://x/y', 'b': 1}", "https://x/y"),
    ("{'href': 'http://a/b'}", "http://a/b"), ("{broken http://a/b}", "http://a/b"), ("{nothing}", "{nothing}"),
    ("  https://x/y  ", "https://x/y"), ("plain text", "plain text"), ("{open", "{open"), (" ", None), ("", None), (None, None),
]


@pytest.mark.parametrize(
    "fn, vectors",
    [(N.normalise_date, DATES), (N.normalise_text, TEXTS), (N.normalise_url, URLS)],
    ids=["date", "text", "url"],
)
def test_vectors(spark, fn, vectors):
    assert apply(spark, fn, [v for v, _ in vectors]) == [e for _, e in vectors]


def test_amount_vectors(spark):
    expected = [None if e is None else Decimal(e).quantize(Decimal("0.01")) for _, e in AMOUNTS]
    assert apply(spark, N.normalise_amount, [v for v, _ in AMOUNTS]) == expected


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aBñ \t\n\r  　.", max_size=12), min_size=1, max_size=40))
def test_text_equals_split_and_join(spark, values):
    expected = [" ".join(v.split()).upper() or None for v in values]
    assert apply(spark, N.normalise_text, values) == expected


def test_is_blank(spark):
    assert apply(spark, N.is_blank, [None, "", " \t ", "x", " x "]) == [True, True, True, False, False]


def test_hash_ignores_ids_and_nulls(spark):
    def hash_of(**fields):
        return spark.range(1).select(N.row_hash({k: F.lit(v) for k, v in fields.items()})).first()[0]

    base = hash_of(supplier="NORTE SAS", total="250.75", id=7, created_at="2024-05-01")
    assert base == hash_of(total="250.75", supplier="NORTE SAS", id=8, updated_at="2024-06-01")
    assert base == hash_of(total="250.75", supplier="NORTE SAS", city=None)
    assert base != hash_of(total="250.75", supplier="SUR SAS")
    assert base != hash_of(supplier="250.75", total="NORTE SAS")
