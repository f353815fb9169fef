"""Values out of raw text: the edge rows."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from accordant.functions.agreement import values_agree
from accordant.functions.normalize import parse_number, slug, unknown_types, with_value

ROWS = [
    ("number", "thirty (30) days", "30"), ("number", "USD 19,200", "19200"), ("number", "forty-five", "45"), ("number", "one hundred hours", "100"), ("number", "none at all", None), ("number", "  ", None), ("number", None, None),
    ("money", "$1,250.50", "USD 1250.50"), ("money", "USD 1250.5", "USD 1250.50"), ("money", "US$ 1,250.50", "USD 1250.50"), ("money", "1250.50 gbp", "GBP 1250.50"), ("money", "€ 2.345", "EUR 2.34"), ("money", "free", None),
    ("duration", "twelve (12) months", "12 months"), ("duration", "10 business days", "10 business_days"), ("duration", "7", "7"), ("duration", "soon", None),
    ("date", "3 April 2026", "2026-04-03"), ("date", "April 3, 2026", "2026-04-03"), ("date", "2026-04-03", "2026-04-03"), ("date", "03/04/2026", "2026-03-04"), ("date", "13/04/2026", "2026-04-13"), ("date", "some day", None),
    ("text", "  Acme \n Straße ", "acme strasse"), ("colour", "red", None),
]


def test_canonical(spark):
    rows = spark.createDataFrame([(i, t, r) for i, (t, r, _) in enumerate(ROWS)], "i int, value_type string, value_raw string")
    got = {r.i: r.c for r in with_value(rows).select("i", F.col("value.canonical").alias("c")).collect()}
    assert [got[i] for i in range(len(ROWS))] == [c for *_, c in ROWS]
    assert [(r.value_type, r.n) for r in unknown_types(rows).collect()] == [("colour", 1)]


def test_parts(spark):
    rows = spark.createDataFrame([("date", "03/04/2026"), ("duration", "2 weeks"), ("money", "£5"), ("text", "A  B")], "value_type string, value_raw string")
    date, weeks, money, text = (r.value for r in with_value(rows).collect())
    assert date.ambiguous and date.as_date == datetime.date(2026, 3, 4)
    assert weeks.note == "14 days equivalent" and weeks.unit == "weeks"
    assert money.currency == "GBP" and money.number == Decimal("5.0000000000")
    assert text.canonical == "a b" and text.display == "A B"


@pytest.mark.parametrize(
    "kind, a, b, same",
    [
        ("money", "USD 100.00", "$100.40", True), ("money", "USD 100", "USD 105", False), ("money", "USD 100", "EUR 100", False), ("number", "1000", "1000.5", True), ("number", "1000", "1002", False),
        ("duration", "30 days", "30 days", True), ("duration", "1 month", "30 days", False), ("text", "Net  30", "net 30", True), ("date", "2026-01-01", "January 1, 2026", True), ("number", "x", "x", False),
    ],
)
def test_agreement(spark, kind, a, b, same):
    rows = with_value(with_value(spark.createDataFrame([(kind, a, b)], "t string, a string, b string"), "t", "a", "x"), "t", "b", "y")
    assert rows.select(values_agree(F.col("x"), F.col("y")).alias("same")).first().same is same


def test_number_and_slug(spark):
    row = spark.createDataFrame([("v1.2.3 and 5", " Ünï & Co. ")], "a string, b string").select(parse_number(F.col("a")).alias("n"), slug(F.col("b")).alias("s")).first()
    assert row.n == Decimal("2.3") or row.n == Decimal("1.2")
    assert row.s == "n-co"


def test_handlers_of_a_user(spark):
    from accordant.functions.normalize import HANDLERS, _struct

    own = {**HANDLERS, "percent": lambda p: F.when(p.number.isNotNull(), _struct(p, F.concat(p.shown, F.lit("%")), "percent", p.number))}
    assert with_value(spark.createDataFrame([("percent", "about 5 per cent")], "value_type string, value_raw string"), handlers=own).first().value.canonical == "5%"
