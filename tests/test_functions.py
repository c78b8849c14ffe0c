import datetime as dt

import pytest
from pyspark.sql import functions as F

from kinloom.functions import text as X


def values(spark, expr, rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, c string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("c"))).collect()]


CASES = [
    (X.squish, ["  a   b ", "", None, "\t\n"], ["a b", None, None, None]),
    (X.title_case, ["stripe   ", "engineering lead", "o'brien", "at&t", "3m", "foo-bar", None], ["Stripe", "Engineering Lead", "O'Brien", "At&T", "3M", "Foo-Bar", None]),
    (X.first_name, ["Ada  Lovelace King", "Ada", ""], ["Ada", "Ada", None]),
    (X.last_name, ["Ada  Lovelace King", "Ada", ""], ["Lovelace King", None, None]),
    (X.address, [" Jon Vega <JON@x.com> ", "a@b.c", "", None], ["jon@x.com", "a@b.c", None, None]),
    (X.domain, ["a@B.com", "nobody", None], ["b.com", None, None]),
    (X.slug, ["Acme & Co.", "_x_", "Zürich AG"], ["acme___co", "x", "zürich_ag"]),
    (lambda c: X.keywords(c, 3), ["The cat, the CAT sat on a mat or ox"], [["the", "cat", "sat"]]),
    (lambda c: X.tag("company", c), ["Acme Co", None], ["company:acme_co", None]),
]


@pytest.mark.parametrize(("expr", "given", "want"), CASES)
def test_text(spark, expr, given, want):
    assert values(spark, expr, given) == want


def test_header_date(spark):
    got = values(spark, X.header_date, ["Wed, 1 Jan 2025 10:00:00 +0200", "Wed, 1 Jan 2025 10:00:00 GMT", "1 Jan 2025 10:00:00", "soon", None])
    assert got == [dt.datetime(2025, 1, 1, 8), dt.datetime(2025, 1, 1, 10), dt.datetime(2025, 1, 1, 10), None, None]
