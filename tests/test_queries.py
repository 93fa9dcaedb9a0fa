"""Queries of the library against their SQL in DuckDB, and the text primitives against expected values."""

import glob
import math
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docfacts.functions import text as T
from docfacts.operators import fields as X
from docfacts.plans.queries import FLAGSHIP, ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
NAMES = ["kv_price", "field_building_sf", "field_commenced", "field_drive_thru", "lease_type_enum", "reconcile_noi", "money_parse", "date_parse", "rendered_lines", "anchored_window"]


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert Counter(map(plain, map(tuple, got.select(*columns).collect()))) == Counter(map(plain, want.fetchall()))


def test_every_query_is_named_once():
    assert FLAGSHIP in QUERIES and set(ORACLES) <= set(QUERIES)


def test_money_and_dates(spark):
    rows = [("$2,450,000", None), ("n/a", None), ("$1.5M", None), (None, "March 4, 2031"), (None, "3/4/31"), (None, "March 2031"), (None, "Mar 4, 2031"), (None, None)]
    got = spark.createDataFrame(rows, "m string, d string").select(T.money(F.col("m")), T.parse_date(F.col("d"))).collect()
    assert [r[0] for r in got[:3]] == [2450000, None, None]
    assert [r[1] for r in got[3:]] == ["2031-03-04", "2031-03-04", "2031-03-01", None, None]


def extracted(spark, extractor, *pages):
    df = spark.createDataFrame([(list(pages),)], "pages array<string>")
    x = extractor()
    return X.extract(X.with_lines(df), x).select(f"{x.name}.*").first()


@pytest.mark.parametrize(
    ("extractor", "page", "value", "grade"),
    [
        (X.price, "Price\n$2,450,000", 2450000, "high"),
        (X.cap_rate, "Cap Rate: 6.00%", 0.06, "high"),
        (X.noi, "NOI\n$147,000", 147000, "high"),
        (X.building_sf, "a store of 4,200 SF on the corner", 4200, "medium"),
        (X.lot_acres, "on 1.25 acres of land", 1.25, "medium"),
        (X.year_built, "Year Built 2011", 2011, "high"),
        (X.lease_type, "an absolute net lease", "absolute_net", "high"),
        (X.lease_type, "a triple net lease", "nnn", "high"),
        (X.escalation, "3% annual rent increases", 0.03, "high"),
        (X.escalation, "10% increase", 0.1, "medium"),
        (X.drive_thru, "with a drive-thru", True, "high"),
        (X.drive_thru, "nothing of the kind", False, "low"),
        (X.traffic, "18,400 VPD", 18400, "medium"),
        (X.price, "no figure at all", None, "unknown"),
    ],
)
def test_extractors(spark, extractor, page, value, grade):
    got = extracted(spark, extractor, page)
    assert got.confidence.lower() == grade
    assert got.value == (pytest.approx(value) if isinstance(value, float) else value)


def test_extractors_of_empty_documents(spark):
    for pages in ([], [""], ["\n \n"]):
        assert extracted(spark, X.noi, *pages).value is None
