"""The confirmation leg, substring joins and overrides on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from docfacts.functions.text import found_field, missing
from docfacts.operators import confirm
from docfacts.schemas import KINDS

PLACE = "struct<address:string,city:string,state:string,zip:string>"
GEO, ZIP = "address string, city string, state string, zip string, formatted string", "zip string, city string, state string"


def docs(spark, *rows):
    """rows: (cover, grade or None, (street, city, state, zip), price, square feet)."""
    df = spark.createDataFrame([(i, c, g, a, p, s) for i, (c, g, a, p, s) in enumerate(rows)], f"doc_id long, cover string, grade string, at {PLACE}, p long, s long")
    kind = KINDS["address"]
    address = F.coalesce(*[found_field(F.when(F.col("grade") == g, F.col("at")), kind, g, "verbatim", F.lit(1), F.lit("x")) for g in ("high", "medium", "low")], missing(kind, "not found"))
    amount = lambda c, n: F.coalesce(found_field(F.col(c), KINDS[n], "high", "verbatim", F.lit(1), F.lit("x")), missing(KINDS[n], "not found"))
    return df.select("doc_id", F.lit("om.pdf").alias("path"), F.array("cover").alias("pages"), address.alias("address"), amount("p", "price").alias("price"), amount("s", "buildingSf").alias("buildingSf"))


AT = ("1 Main St", "Mesa", "AZ", "85201")
LINE = "1 Main St, Mesa, AZ 85201"


def graded(spark, rows, geo, zips):
    done = confirm.confirm(docs(spark, *rows), spark.createDataFrame(geo, GEO), spark.createDataFrame(zips, ZIP)).orderBy("doc_id").collect()
    return [(r.address.confidence, r.address.review_required, [p.path for p in r.address.paths], [(c.field, c.source) for c in r.conflicts]) for r in done]


@pytest.mark.parametrize(
    ("cover", "grade", "geo", "zips", "want"),
    [
        ("in Mesa", "medium", [(LINE, "Mesa", "AZ", "1", "f")], [], ("high", False, ["geocode"], [])),
        ("in Mesa", "high", [(LINE, "Mesa City", "AZ", "1", "f")], [], ("high", False, [], [("address", "geocode")])),  # agrees, but no cover names "Mesa City"
        ("elsewhere", "medium", [(LINE, "Mesa", "AZ", "1", "f")], [], ("medium", False, [], [("address", "geocode")])),  # not named: only towards review
        ("in Mesa", "high", [(LINE, "Mesa", "CA", "1", "f")], [], ("medium", True, [], [("address", "geocode")])),
        ("in Mesa", "high", [(LINE, "Mesa", "CA", "1", "f")], [("85201", "Mesa", "AZ")], ("high", True, ["zip"], [("address", "geocode")])),  # the zip leg comes second
        ("in Mesa", "high", [], [("85201", "Mesa", "CA")], ("medium", True, [], [("address", "zip")])),
        ("in Mesa", "low", [], [("85201", "Mesa", None)], ("high", False, ["zip"], [])),
        ("in Mesa", "low", [(LINE, None, None, None, None)], [("85201", None, None)], ("low", False, [], [])),  # negative entries
        ("in Mesa", "low", [(None, "Mesa", "AZ", "1", "f")], [(None, "Mesa", "AZ")], ("low", False, [], [])),
        ("in Mesa", "medium", [(LINE, None, None, None, None), (LINE, "Mesa", "AZ", "1", "f"), (LINE, "Mesa", "AZ", "1", "f")], [], ("high", False, ["geocode"], [])),  # repeated keys
        ("in Mesa", None, [(LINE, "Mesa", "AZ", "1", "f")], [("85201", "Mesa", "AZ")], ("unknown", False, [], [])),
    ],
)
def test_grades_by_two_tables(spark, cover, grade, geo, zips, want):
    assert graded(spark, [(cover, grade, AT, None, None)], geo, zips) == [want]


def test_prices_by_square_foot_and_missing_parts(spark):
    rows = [("in Mesa", "low", AT, 100, 100), ("in Mesa", "low", AT, 1000, 100), ("x", "low", AT, 0, 5), ("x", None, AT, 100, 100), ("x", "low", (None, "Mesa", "AZ", None), None, None), (None, "low", (None, None, None, None), 1, None)]
    got = graded(spark, rows, [(LINE, None, None, None, None)], [])
    assert [g[3] for g in got] == [[("buildingSf", "price")], [], [], [], [], []]
    assert confirm.confirm(docs(spark, *rows).limit(0), spark.createDataFrame([], GEO), spark.createDataFrame([], ZIP)).count() == 0


def test_colliding_keys_are_kept_apart(spark, monkeypatch):
    monkeypatch.setattr(confirm, "key_of", lambda text: F.when(text.isNotNull(), F.lit("same")))
    rows = [("in Mesa", "medium", AT, None, None), ("in Mesa", "medium", ("2 Main St", *AT[1:]), None, None)]
    got = graded(spark, rows, [("2 Main St, Mesa, AZ 85201", "Mesa", "AZ", "1", "f"), (LINE, "Yuma", "AZ", "1", "f")], [])
    assert [(g[0], len(g[3])) for g in got] == [("medium", 1), ("high", 0)]


def test_what_was_never_asked(spark):
    d = docs(spark, ("x", "low", AT, None, None), ("x", "low", AT, None, None), ("x", "low", ("3 Oak", "Mesa", "AZ", None), None, None), ("x", None, AT, None, None))
    table = spark.createDataFrame([("3 Oak, Mesa, AZ", None, None, None, None)], GEO)
    got = confirm.unasked(d, confirm.whole_address(F.col("address.value")), table, "address").collect()
    assert [r.address for r in got] == [LINE] and len(got[0].key) == 16
    asked = confirm.cached(d, confirm.whole_address(F.col("address.value")), table, "address", "geo").orderBy("doc_id").select("geo.asked").collect()
    assert [r.asked for r in asked] == [False, False, True, False]


def test_substrings_equal_nested_loops(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abc ") for _ in range(n))
    texts = [(i // 2, word(rng.choice([0, 1, 2, 5, 30]))) for i in range(200)] + [(None, "abcabc"), (500, None), (501, "aa" * 2000)]
    needles = [(word(rng.choice([1, 2, 3, 4, 7])),) for _ in range(80)] + [("",), (None,), ("zzz",), ("a" * 50,)]
    want = {}
    for (n,) in needles:
        hits = [(o, t) for o, t in texts if n and t is not None and o is not None and n in t]
        if hits:
            want[n] = min(hits)
    got = confirm.contains_join(spark.createDataFrame(needles, "needle string"), "needle", spark.createDataFrame(texts, "ord int, text string").repartition(3), "text", "ord").collect()
    assert {r.needle: (r.ord, r.text) for r in got} == want and len(got) == len(want)
    assert confirm.contains_join(spark.createDataFrame([], "needle string"), "needle", spark.createDataFrame(texts, "ord int, text string"), "text", "ord").count() == 0


def test_issuers(spark):
    tenants = spark.createDataFrame([(1, "A Quick Mart"), (2, "quick bean"), (3, None), (4, "none"), (5, "Beans")], "id int, tenant string")
    titles = spark.createDataFrame([(3, "Quick Holdings", 30), (2, "MY QUICK", 20), (1, None, 10)], "ord int, title string, cik int")
    got = confirm.issuers_of(tenants, F.col("tenant"), [("quick", "QUICK"), ("bean", "BEAN")], titles).orderBy("id").collect()
    assert [r.issuer and r.issuer.cik for r in got] == [20, 20, None, None, None]


def test_templates_of_firms(spark):
    made = confirm.Overrides()
    field = lambda v, note: F.coalesce(found_field(v, "bigint", "high", "verbatim", F.lit(1), F.lit("s"), note), missing("bigint", "not found"))
    made.register("a")(lambda df: {"price": field(F.when(F.col("n") > 1, F.col("n") * 100), "a"), "extra": field(F.col("n"), "a")})
    made.register("b")(lambda df: {"price": field(F.raise_error(F.lit("evaluated")).cast("bigint"), "b")})
    with pytest.raises(ValueError):
        made.register("a")(lambda df: {})
    df = spark.createDataFrame([("a", 1), ("a", 2), ("c", 3), (None, 4)], "firm string, n long").withColumn("price", field(F.col("n"), "general"))
    got = made.applied(df, F.col("firm")).orderBy("n").collect()  # b's template is not evaluated for other firms
    assert [(r.price.value, r.price.notes, r.extra and r.extra.value) for r in got] == [(1, "general", 1), (200, "a", 2), (3, "general", None), (4, "general", None)]
    assert confirm.Overrides().applied(df, F.col("firm")).columns == df.columns
