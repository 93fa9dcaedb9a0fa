"""Layouts and photos on small tables: edges of rectangles, colours, caps, numbering, and rows with nulls."""

import random

import pytest
from pyspark.sql import functions as F

from docfacts.operators import layout, photos

BOX = "x0 double, y0 double, x1 double, y1 double"


def boxes(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"n int, k int, {BOX}")


def crossing(a, b):
    return not (a[2] <= b[0] or b[2] <= a[0] or a[3] <= b[1] or b[3] <= a[1])


def test_overlaps_equal_nested_loops(spark):
    rng = random.Random(0)
    one = lambda: (rng.choice([1, 1, 2]), *(float(rng.choice([0, 144, 288, -10, rng.uniform(-300, 900), 1e6])) for _ in range(4)))
    a = [(k, min(p, r), min(q, s), max(p, r), max(q, s)) for k, p, q, r, s in (one() for _ in range(120))]
    b = [*[one() for _ in range(120)], (1, 144.0, 144.0, 144.0, 200.0), (1, 144.0, 144.0, 144.0, 144.0)]  # inverted and empty ones too
    want = {(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x[0] == y[0] and crossing(x[1:], y[1:])}
    got = layout.overlaps(boxes(spark, a).repartition(3), boxes(spark, b), ["k"]).select("n", "r_n").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    none = boxes(spark, [(1, None, 0.0, 1.0, 1.0)])
    assert layout.overlaps(none, boxes(spark, b), ["k"]).count() == layout.overlaps(boxes(spark, a), boxes(spark, b).limit(0), ["k"]).count() == 0


def test_a_crowded_page_is_no_cross_product(spark):
    """Many small rectangles of one page: pairs that meet in a cell, not all pairs."""
    n = 3000
    rows = [(1, float(i % 60 * 10), float(i // 60 * 10), i % 60 * 10 + 9.0, i // 60 * 10 + 9.0) for i in range(n)]
    left, right = boxes(spark, rows), boxes(spark, rows)
    met = layout.overlaps(left, right, ["k"])
    assert met.count() == n
    cells = left.withColumn("c", F.explode(layout.cells(144.0))).groupBy("c").count()
    assert cells.agg(F.sum(F.col("count") * F.col("count"))).first()[0] < n * n / 10


def test_touching_boxes_and_covers(spark):
    places = spark.createDataFrame([(1, 1, 7, 0, 0.0, 0.0, 100.0, 50.0, 200.0, 100.0), (1, 1, 7, 1, 0.0, 50.0, 10.0, 60.0, 200.0, 100.0), (1, 1, 8, 0, 0.0, 0.0, 1.0, 1.0, 0.0, 100.0)], f"doc_id long, page int, image int, place int, {BOX}, page_width double, page_height double")
    texts = spark.createDataFrame([(1, 1, "a", 100.0, 0.0, 120.0, 10.0), (1, 1, "b", 99.0, 0.0, 120.0, 10.0), (1, 1, " \n", 0.0, 0.0, 120.0, 10.0), (1, 1, None, 0.0, 0.0, 1.0, 1.0), (1, 2, "c", 0.0, 0.0, 9.0, 9.0), (1, 1, "d", 0.0, 50.0, 3.0, 55.0)], f"doc_id long, page int, text string, {BOX}")
    got = {r.image: (r.overlap, r.cover) for r in layout.image_cover(places, texts).collect()}
    assert got == {7: (1, 0.25), 8: (0, 0.0)}


@pytest.mark.parametrize(
    ("parts", "colour", "white"),
    [([0.5], "#808080", False), ([1.0], "#ffffff", True), ([0.0, 0.0, 0.04, 0.0], "#fffff5", True), ([0.0, 0.0, 0.0, 0.5], "#808080", False), ([1.0, 0.95, 0.95], "#fff2f2", True), ([0.2, 0.4, 0.6, 0.8, 1.0], "#336699", False), ([1.0, 1.0], "#000000", True), ([], "#000000", False), (None, "#000000", False), ([2.0, -1.0, 0.0], "#ff0000", False)],
)
def test_colours_of_fills(spark, parts, colour, white):
    row = spark.createDataFrame([(parts,)], "c array<double>").select(layout.fill_colour(F.col("c")).alias("h"), layout.near_white(F.col("c")).alias("w")).first()
    assert (row.h, row.w) == (colour, white)


def test_packed_colours_and_styles(spark):
    rows = spark.createDataFrame([(0x1A2B3C, 16, None), (None, 0, "Foo-SemiBoldItalic"), (0x1FFFFFF, 2, "x"), (-1, None, "BLACKletter")], "c long, f int, n string")
    got = [(r.h, r.s.bold, r.s.italic) for r in rows.select(layout.packed_colour(F.col("c")).alias("h"), layout.style(F.col("f"), F.col("n")).alias("s")).collect()]
    assert got == [("#1a2b3c", True, False), ("#000000", True, True), ("#ffffff", False, True), ("#ffffff", True, False)]


def test_caps_in_reading_order(spark):
    pages = spark.createDataFrame([(1, 1, 100.0, 100.0), (1, 2, 100.0, 100.0)], "doc_id long, page int, page_width double, page_height double")
    spans = spark.createDataFrame([(1, 1, i, t, "F", 9.999, 0, 255, 0.0, 0.0, 1.005, 1.0) for i, t in enumerate([" ", " b ", "c", None, "d"])], f"doc_id long, page int, ord int, text string, font string, size double, flags int, colour long, {BOX}")
    places = [(0.0, 0.0, 1.0, 1.0), (2.0, 2.0, 3.0, 3.0)]
    images = spark.createDataFrame([(1, 1, 5, 9, 10, 20, places), (1, 1, 3, 8, 10, 20, places[:1]), (1, 1, 4, 8, 10, 20, places), (1, 1, 6, 7, 1, 1, [])], "doc_id long, page int, ord int, image int, width int, height int, places array<struct<x0:double,y0:double,x1:double,y1:double>>")
    fills = spark.createDataFrame([(1, 2, i, [0.5], 0.0, 0.0, 10.0, h, 100.0, 100.0) for i, h in enumerate([20.0, 19.9, 30.0, -5.0])], f"doc_id long, page int, ord int, colour array<double>, {BOX}, page_width double, page_height double")
    got = {r.page: r for r in layout.page_layouts(pages, spans, images, fills, {"spans": 2, "images": 3, "fills": 2}).collect()}
    assert [s.text for s in got[1].spans] == ["b", "c"] and got[1].truncated and got[1].spans[0].size == 10.0 and got[1].spans[0].colour == "#0000ff"
    assert [i.image for i in got[1].images] == [8, 9, 9] and not got[1].fills
    assert [f.box for f in got[2].fills] == [[0.0, 0.0, 10.0, 20.0], [0.0, 0.0, 10.0, 30.0]] and not got[2].truncated
    assert layout.page_layouts(pages.limit(0), spans, images, fills).count() == 0
    plan = layout.capped(spans.withColumn("kept", F.col("text")), 2, F.col("kept"), "spans")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan  # cut before the shuffle


IMAGES = "doc_id long, page int, ord int, image int, width int, height int, entropy double, edges double, overlap int, masked double, continuity double, smear double"


def test_photos_are_gated_and_numbered(spark):
    good = dict(width=400, height=300, entropy=3.0, edges=0.02, overlap=0, masked=0.1, continuity=0.5, smear=0.5)
    rows = [
        (1, 2, 1, 1, {}), (1, 1, 9, 1, {"width": 399}),  # its first place counts, and there it is too small
        (1, 2, 2, 2, {"overlap": 3, "masked": None}), (1, 2, 3, 3, {"masked": 0.0}), (1, 2, 4, 4, {"masked": 0.151}), (1, 3, 1, 5, {"continuity": 0.0, "smear": 0.0}), (1, 3, 2, 6, {}), (1, 61, 1, 7, {}), (1, 4, 1, 8, {"entropy": None}), (1, 4, 2, 9, {"height": 0}),
    ]
    df = spark.createDataFrame([(d, p, o, i, *[(good | x)[k] for k in good]) for d, p, o, i, x in rows], IMAGES).repartition(4)
    seen = photos.recovery(photos.first_occurrences(df))
    assert {r.image: r.method for r in seen.collect()} == {1: "skip", 2: "raw_extract", 3: "needs_overlay_pass", 4: "needs_overlay_pass", 5: "needs_overlay_pass", 6: "needs_overlay_pass", 8: "skip", 9: "skip"}
    done = photos.numbered(seen)
    assert {r.image: (r.file_name, r.score, r.reason) for r in done.collect()} == {
        2: ("exterior-01.jpg", 1.0, "ok"), 3: ("exterior-02.jpg", 1.0, "nothing masked"), 4: (None, 0.0, "too much masked"), 5: (None, 0.36, "low quality"), 6: ("exterior-03.jpg", 0.66, "ok"),
    }
    docs = spark.createDataFrame([(1, "in/a.b/om x.pdf"), (2, "plain"), (3, None)], "doc_id long, path string")
    got = {r.doc_id: r.manifest for r in photos.manifests(docs, done).collect()}
    assert got[1].asset_id == "om x" and [p.filename for p in got[1].photos] == ["exterior-01.jpg", "exterior-02.jpg", "exterior-03.jpg"] and [f.image for f in got[1].pass_failures] == [4, 5]
    assert got[2].asset_id == "plain" and got[2].photos == [] and got[3].asset_id == ""


def test_numbers_of_three_digits_are_whole(spark):
    df = spark.createDataFrame([(1, 1, i, i, 400, 300, 3.0, 0.02, 3, 0.0, 0.0, 0.0) for i in range(120)], IMAGES)
    names = {r.image: r.file_name for r in photos.numbered(photos.recovery(df)).collect()}
    assert names[8] == "exterior-09.jpg" and names[99] == "exterior-100.jpg" and names[119] == "exterior-120.jpg"


def test_entropy_and_keys(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", None), ("b", 5), ("c", None)], "g string, v int")
    got = {r.g: r.entropy for r in photos.entropy(df, ["g"], "v").collect()}
    assert got["a"] == pytest.approx(1.0) and got["b"] == pytest.approx(0.0) and set(got) == {"a", "b"}
    key = spark.range(1).select(photos.cache_key(F.lit(1.5), F.lit("x")).alias("k")).first().k
    assert key == __import__("hashlib").sha256(b"1.5:x").hexdigest()
