"""Work that grew faster than the input, or stayed with one task."""

from pyspark.sql import functions as F

from docfacts.functions import text as T
from docfacts.operators import confirm, fields, layout, party, place, record
from docfacts.plans import grid_queries, record_queries
from docfacts.plans.render import documents
from docfacts.sources import shared


def test_documents_of_a_compact_table_are_work_for_many_tasks(spark, tmp_path):
    orders = spark.range(30_000).select(F.col("id").alias("o_orderkey"), F.lit(1000.5).cast("decimal(12,2)").alias("o_totalprice"))
    orders.coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    for made in (documents, grid_queries.documents, grid_queries.words):
        assert made(spark, str(tmp_path)).rdd.getNumPartitions() > 1  # before: one, whatever the number of cores


def test_the_blocks_of_a_page_are_made_once(spark):
    df = spark.createDataFrame([("a.pdf", ["12 Oak Street, Dayton, OH 45402"])], "path string, pages array<string>")
    plan = df.select(place.elected(place.votes(F.col("path"), F.col("pages"))).alias("won"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("CalDRE") == 2  # a search and its gaps; before: 96, within every match of four kinds and again for each vote


def test_lines_of_pages_as_one_text(spark):
    pages = [None, " Price \r\n \n $2 \x0b  \x85", "\n", "a"]
    df = spark.createDataFrame([(pages,)], "pages array<string>")
    row = df.select(T.numbered_lines(F.col("pages")).alias("n"), T.page_lines(F.col("pages")).alias("l")).first()
    assert [x for x in row.n.split("\n") if not x.endswith("\f") and x] == [f"{p + 1}\f{x.line}" for p, lines in enumerate(row.l) for x in lines] == ["2\fPrice", "2\f$2", "4\fa"]


def test_a_label_ends_with_its_page(spark):
    df = spark.createDataFrame([(["x\nPrice :\n", "$5"],), (["ParKing:\n 7 \nParking: 8"],), (["price:   9", "Price\n10"],), ([None],)], "pages array<string>")
    got = df.select(T.kv_lookup(T.numbered_lines(F.col("pages")), ["Price", "Parking"]).alias("k")).collect()
    assert [r.k and tuple(r.k) for r in got] == [None, ("7", 1, "ParKing:"), ("9", 1, "price:   9"), None]


def test_windows_of_near_anchors(spark):
    df = spark.createDataFrame([(["Price Price $1,000", None, "PRICE of 2 " + "x" * 40 + " $9,999"],)], "pages array<string>")
    hit = df.select(T.regex_near(F.col("pages"), ["Price"], r"\$([0-9,]+)", 10).alias("h")).first().h
    assert (hit.value, hit.page, hit.snippet) == ("1,0", 1, "Price $1,0")


def test_brands_are_patterns_of_the_plan(spark):
    df = spark.createDataFrame([("a Quick Mart Express’s, Bean House",), ("beanhouse",), (None,)], "t string").select(party.brand_in(F.col("t"), ["Bean House", "Quick Mart", "Quick Mart Express's"]).alias("b"))
    assert [r.b for r in df.collect()] == ["Quick Mart Express's", None, None]
    assert ".pattern" not in df._jdf.queryExecution().optimizedPlan().toString()  # before: read from a table of brands, and compiled for every text


def test_a_chain_extracts_what_its_query_reads(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(record_queries, "written", lambda df, name: seen.append(df.columns) or df)
    docs = spark.createDataFrame([], "doc_id long, path string, pages array<string>, ocr_used boolean, cover_spans array<struct<text:string,size:double,page:int>>, _corrupt string, status string")
    left = record_queries.whole_chain(docs, shown=())
    assert set(record_queries.CHECKED) <= set(seen[0]) and not {"address", "trafficCount", "offeringFirm"} & {c for columns in seen for c in columns}  # before: all were written
    assert "warnings" in left.columns


def test_regular_lines_equal_searched_ones(spark):
    texts = ["a\nb c\nd", " a\nb", "a\nb ", "a\n\nb", "a \nb", "a\n\tb", "a\r\nb", "a\x85b", "a b", "\n", "", "a", " a \n b"]
    df = spark.createDataFrame([([t],) for t in texts], "pages array<string>").select(T.numbered_lines(F.col("pages")).alias("n"), T.page_lines(F.col("pages")).alias("l"))
    for row in df.collect():
        assert row.n == "".join(f"1\f{x.line}\n" for x in row.l[0]) or (row.n == "1\f\n" and not row.l[0])


def test_needles_meet_their_index_where_it_is_made(spark):
    needles = spark.createDataFrame([("ab",), ("x1",), ("zz",)], "s string")
    rows = spark.createDataFrame([(i, f"ab{i}x{i}") for i in range(40)], "ord long, t string")
    joined = lambda **how: confirm.contains_join(needles, "s", rows, "t", "ord", **how)
    for df in (joined(), joined(few=0, part_rows=7)):
        assert sorted(map(tuple, df.select("s", "ord").collect())) == [("ab", 0), ("x1", 1)]
    plan = joined(few=0, part_rows=7)._jdf.queryExecution().optimizedPlan().toString()
    assert "__part" in plan and "strategy=broadcast" in joined()._jdf.queryExecution().optimizedPlan().toString()  # before: all texts of a gram were one task's


def test_equal_boxes_are_compared_once(spark, monkeypatch):
    met, plain = [], layout.overlaps
    monkeypatch.setattr(layout, "overlaps", lambda left, right, keys: met.append(plain(left, right, keys)) or met[-1])
    texts = spark.range(30).selectExpr("1L AS doc_id", "1 AS page", "'t' AS text", "0D AS x0", "0D AS y0", "10D AS x1", "CASE WHEN id = 0 THEN 9D ELSE 10D END AS y1")
    places = spark.range(20).selectExpr("1L AS doc_id", "1 AS page", "id AS image", "0 AS place", "5D AS x0", "5D AS y0", "15D AS x1", "15D AS y1", "100D AS page_width", "100D AS page_height")
    rows = layout.image_cover(places, texts).collect()
    assert len(rows) == 20 and {(r.overlap, r.cover) for r in rows} == {(30, 0.01)}
    assert met[0].count() == 2  # before: 600 pairs


def test_a_pattern_is_searched_only_where_the_label_gave_nothing(spark, monkeypatch):
    asked = F.struct(F.raise_error(F.lit("asked")).cast("string").alias("value"), F.lit(1).alias("page"), F.lit("s").alias("snippet"))
    monkeypatch.setattr(fields, "regex_near", lambda *_: asked)
    docs = fields.with_lines(spark.createDataFrame([(["Price: $100,000\nNOI: $6,000\nkWh: 3"],)], "pages array<string>"))
    row = fields.extract(docs, fields.price(), fields.noi()).first()  # before: every pattern was searched in every document, "asked"
    assert (row.price.value, row.noi.value) == (100_000, 6_000)
    hit = docs.select(T.kv_lookup(F.col("lines"), ["-x", "kwh"]).alias("k")).first().k
    assert tuple(hit) == ("3", 1, "kWh: 3")


def test_a_status_is_told_after_the_texts_are_dealt(spark, tmp_path):
    orders = spark.range(60).select(F.col("id").alias("o_orderkey"), F.lit(1000.5).cast("decimal(12,2)").alias("o_totalprice"))
    orders.coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    docs = record_queries.batch(spark, str(tmp_path))
    for made in (record.of_status(docs), record.unextracted(docs)):
        assert made._jdf.queryExecution().optimizedPlan().toString().count("Financial Overview") == 1  # before: 3, two of them in a filter below the shuffle
    assert record.of_status(docs).count() + record.unextracted(docs).count() == 60


def test_no_page_is_searched_without_an_anchor_or_after_a_hit(spark):
    df = spark.createDataFrame([(["a Price $5", "Price $7"], "price"), (["a Price $5"], "nothing"), ([None, "x 12 AC"], "ac")], "pages array<string>, low string")
    near = lambda *more: T.regex_near(F.col("pages"), ["Price", "List Price"], r"\$([0-9]+)", 20, 1, *more)
    first = lambda *more: T.regex_first(F.col("pages"), r"([0-9]+)\s*AC\b", 1, *more)
    rows = df.select(near().alias("n"), near(F.col("low")).alias("g"), first().alias("f"), first(F.col("low"), ["ac"]).alias("h")).collect()
    assert [r.n and tuple(r.n) for r in rows] == [("5", 1, "Price $5"), ("5", 1, "Price $5"), None]
    assert [r.g and tuple(r.g) for r in rows] == [("5", 1, "Price $5"), None, None]  # before: no plain search spared a page the pattern
    assert [r.f and tuple(r.f) for r in rows] == [r.h and tuple(r.h) for r in rows] == [None, None, ("12", 2, "x 12 AC")]


def test_a_written_table_leaves_the_session_as_it_was(spark):
    before = spark.conf.get("spark.sql.codegen.hugeMethodLimit")
    with shared.compiled(spark):
        assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000  # before: projections were fused to methods that the JVM interprets
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == before
    assert sorted(r.id for r in shared.written(spark.range(3), "t").collect()) == [0, 1, 2]
