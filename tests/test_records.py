"""Places, parties, records and sources on small fixtures, and rows that used to end a job."""

from pyspark.sql import functions as F

from docfacts.functions.text import matches, money, number
from docfacts.operators import fields as X
from docfacts.operators import party, place, record
from docfacts.operators import verify as V
from docfacts.sources import tables


def pages_of(spark, *docs):
    return X.with_lines(spark.createDataFrame([(i, p, t, False) for i, (p, t) in enumerate(docs)], "doc_id long, path string, pages array<string>, ocr_used boolean"))


def test_a_null_page_hides_no_field(spark):
    rows = X.extract_fields(pages_of(spark, ("a.pdf", [None, "Price\n$2,450,000\nCap Rate: 0%\nNOI\n$120,000"]), ("b.pdf", None), ("c.pdf", []))).orderBy("doc_id").collect()
    assert rows[0].price.value == 2_450_000 and rows[0].price.source_page == 2
    assert rows[1].price.value is None and rows[2].price.method == "not_found"


def test_a_zero_cap_rate_ends_no_job(spark):
    df = X.extract_fields(pages_of(spark, ("a.pdf", ["Price\n$2,450,000\nCap Rate: 0%\nNOI\n$120,000"]), ("b.pdf", ["Price: $2,000,000\nCap Rate: 0%"])))
    df = df.withColumns({"price0": F.col("price"), "cap0": F.col("capRate"), "noi0": F.col("noi")})
    rows = V.cross_checks(V.rent_from_noi(V.verify_money(V.derive_identity(df)))).orderBy("doc_id").collect()
    assert rows[0].price.value == 2_450_000 and abs(rows[0].capRate.value - 0.04898) < 1e-5
    assert rows[1].noi.value is None or rows[1].noi.value == 0


def test_type_suffixes_are_no_numbers(spark):
    texts = ["$1,200,000D", "1500000f", "1,500.50", " 12 ", "x", "", None, "1e3", "NaN", "Infinity"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(money(F.col("t")).alias("m"), number(F.col("t")).alias("n")).collect()
    assert [r.m for r in rows] == [None, None, 1500, 12, None, None, None, 1000, None, None]
    assert [r.n for r in rows] == [None, None, 1500.5, 12.0, None, None, None, 1000.0, None, None]


def test_matches_have_offsets(spark):
    row = spark.createDataFrame([("ab1cd22e",)], "t string").select(matches(F.col("t"), r"\d+").alias("m")).first()
    assert [(m.found, m["at"]) for m in row.m] == [("1", 2), ("22", 5)]


def test_blocks_votes_and_corroboration(spark):
    contact = "Listed by\nA. Broker\n5831 Harbor Drive, Westport, CA 92649\nCRE Lic. 1"
    far = "x " * 200
    docs = pages_of(
        spark,
        ("in/Bean House - Cincinnati, OH - OM.pdf", ["Bean House\nCincinnati, OH\n" + far + contact]),
        ("y.pdf", ["A store\n" + far + "12 Oak Street, Dayton, Ohio\n" + far + contact]),
        ("z.pdf", ["nothing here"]),
        ("p.pdf", ["Salem, OR; Austin, TX; Dayton, OH; Mesa, AZ\n12 Oak Street, Mesa, AZ 85201"]),
    )
    got = place.extract_address(docs).orderBy("doc_id").collect()
    assert (got[0].address.value.city, got[0].address.value.state, got[0].address.confidence) == ("Cincinnati", "OH", "medium")
    assert got[0].address.value.zip is None  # that of the contact block does not count
    assert (got[1].address.value.city, got[1].address.value.state, got[1].address.confidence, got[1].address.notes) == ("Dayton", "OH", "medium", "city only in the body")
    assert got[2].address.method == "not_found"
    assert got[3].address.value.city == "Mesa" and got[3].address.confidence == "medium"
    spans = docs.select(place.contact_blocks(F.get("pages", F.lit(0))).alias("s")).collect()[0].s
    assert len(spans) == 1 and spans[0].begin > 0


def test_tenants_and_firms(spark):
    paths = ["OM-Quickly-Mesa-AZ.pdf", "12 Elm.pdf", "Texas - OM.pdf", "a/b/Tire Barn - Salem, OR (3).pdf", "tx.pdf", None]
    got = spark.createDataFrame([(p,) for p in paths], "p string").select(party.file_tenant(F.col("p"), ["Sun", "Sun Pharmacy"]).alias("t")).collect()
    assert [r.t for r in got] == ["Quickly", None, None, "Tire Barn", None, None]
    text = spark.createDataFrame([("the Sun Pharmacy of",), ("Sunday",), ("at SUN.",)], "t string").select(party.brand_in(F.col("t"), ["Sun", "Sun Pharmacy"]).alias("b")).collect()
    assert [r.b for r in text] == ["Sun Pharmacy", None, "Sun"]
    docs = spark.createDataFrame([(["by ACME now"],), (["", "", "", "", "acme", "x@Two.example"],), ([None],)], "pages array<string>")
    assert [r.f for r in docs.select(party.offering_firm(F.col("pages"), [("acme", "Acme Co")], {"two.example": "Two"}).alias("f")).collect()] == ["Acme Co", "Two", None]


def test_records_of_documents_without_fields(spark):
    docs = record.routed(pages_of(spark, ("a.pdf", ["Price: $1,000,000\n" + "word " * 100]), ("b.pdf", [None]), ("c.pdf", [])))
    records = record.deal_records(X.extract(docs, X.price(), X.cap_rate()))
    rows = records.orderBy("doc_id").collect()
    assert [r.status for r in rows] == ["complete", "pending_broker_review", "pending_broker_review"]
    assert rows[0].deal.cover.price == "$1,000,000" and rows[0].deal.meta.price.badge == "extracted" and rows[1].deal.cover.price is None
    assert {r.doc_id: r.reason for r in record.review_queue(records).collect()} == {1: "thin text", 2: "thin text"}
    total = record.batch_summary(records).first()
    assert (total["count"], total.complete, total.pending, total.fields_found) == (3, 1, 2, 1)
    assert record.batch_summary(records.limit(0)).first()["count"] == 0


def test_preservation_is_idempotent(spark, tmp_path):
    items = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "id long, body string")
    none = spark.createDataFrame([], "sha256 string")
    first = tables.preserved(items, "body", none, "id")
    assert sorted((r.first_id, r.size) for r in first.collect()) == [(1, 1), (3, 1)]
    assert tables.preserved(items, "body", first, "id").count() == 0
    (tmp_path / "x.json").write_text('{"k": 1, "v": "one"}')
    (tmp_path / "y.json").write_text("{broken")
    rows = tables.read_json(spark, str(tmp_path), "k int, v string").collect()
    assert sorted((r.k is None, r._corrupt is None) for r in rows) == [(False, True), (True, False)]
    table = spark.createDataFrame([(1, "x"), (1, "w"), (None, "n")], "k int, v string")
    assert {r.k: r.v for r in tables.looked_up(spark.createDataFrame([(1,), (2,)], "k int"), table, "k", ["v"]).collect()} == {1: "w", 2: None}


def test_displays_and_names(spark):
    rows = spark.createDataFrame([(0.08155, "Overview: Grill"), (0.0, "Profile-Fit"), (None, "Summary/Bar"), (0.0625, "Overview"), (0.06, "Tenant Overview"), (12.5, "Столовая"), (0.061249, "summary x"), (0.07, "12-34 !")], "c double, t string")
    got = rows.select(record.percent(F.col("c")).alias("p"), party.clean_tenant(F.col("t")).alias("t")).collect()
    assert [r.p for r in got] == [f"{c * 100:.2f}%" if c else None for c in (0.08155, 0.0, None, 0.0625, 0.06, 12.5, 0.061249, 0.07)]
    assert [r.t for r in got] == ["Overview: Grill", "Profile-Fit", "Summary/Bar", None, None, "Столовая", None, None]
    titles = spark.createDataFrame([([("Столовая", 20.0, 1), ("#1!", 30.0, 1)],), ([("123 - 4", 9.0, 1)],), (None,)], "s array<struct<text:string,size:double,page:int>>")
    assert [r.t and r.t.text for r in titles.select(party.cover_title(F.col("s")).alias("t")).collect()] == ["Столовая", None, None]


def test_ocr_grades_every_field(spark):
    text = "Price: $1,000,000\nLease Type NNN\nYear Built 1999\nwith a drive-thru\nParking: 12 spaces"
    docs = spark.createDataFrame([(1, "a.pdf", [text], True), (2, "b.pdf", [text], False)], "doc_id long, path string, pages array<string>, ocr_used boolean")
    fields = X.extract_fields(docs)
    names = [x.name for x in X.all_extractors()]
    rows = V.cap_ocr(fields, names).orderBy("doc_id").collect()
    assert all(rows[0][n].confidence != "high" for n in names) and {n for n in names if rows[1][n].confidence == "high"} >= {"price", "leaseType", "yearBuilt", "driveThru", "parkingCount"}
    assert rows[0].yearBuilt.notes == "ocr" and rows[0].driveThru.confidence == "medium"


def test_thin_unreadable_and_ocr_texts_are_routed(spark):
    docs = spark.createDataFrame([(1, "x/a.pdf", ["short"], False, None), (2, "b.pdf", ["short"], True, None), (3, "c.pdf", None, False, "%PDF"), (4, "d.pdf", ["long " * 40], False, None)], "doc_id long, path string, pages array<string>, ocr_used boolean, _corrupt string")
    routed = record.routed(docs)
    assert [r.status for r in routed.orderBy("doc_id").collect()] == ["pending_broker_review", "complete", "error", "complete"]
    rest = record.unextracted(routed).orderBy("doc_id").collect()
    assert [(r.doc_id, r.reason) for r in rest] == [(1, "thin text: 5.0 characters a page"), (3, "unreadable")]
    done = record.deal_records(X.extract(X.with_lines(routed.where("status = 'complete'")), X.price())).unionByName(record.unextracted(routed), allowMissingColumns=True)
    assert {r.doc_id: r.reason for r in record.review_queue(done).collect()} == {1: "thin text", 3: "unreadable"}
    assert {(r.pdf, r.status, r.error) for r in record.batch_results(done).collect()} == {("a.pdf", "pending_broker_review", None), ("b.pdf", "complete", None), ("c.pdf", "error", "unreadable"), ("d.pdf", "complete", None)}
    total = record.batch_summary(done).first()
    assert (total["count"], total.complete, total.pending, total.errored) == (4, 2, 1, 1)


def test_records_have_one_shape_and_are_written(spark, tmp_path):
    import json

    docs = record.routed(pages_of(spark, ("in/a.pdf", ["Price: $1,000,000\n" + "word " * 100]), ("b.pdf", [None])))
    done = record.deal_records(X.extract(docs.where("status = 'complete'"), X.price(), X.cap_rate())).unionByName(record.unextracted(docs), allowMissingColumns=True)
    bodies = {r.doc_id: (r.file, json.loads(r.body)) for r in record.as_json(done).collect()}
    deal = bodies[0][1]
    assert bodies[0][0] == "deal_data" and {"cover", "cityLine", "project", "property", "offering", "tenant", "lease", "market", "extraction_metadata", "meta", "verification"} == set(deal)
    assert deal["project"]["county"] is None and deal["property"]["apn"] is None and deal["offering"]["capRateDisplay"] is None and deal["extraction_metadata"]["source_folder"] == "in" and deal["extraction_metadata"]["primary_om_filename"] == "a.pdf"
    assert bodies[1] == ("extraction_status", {"extraction_status": "pending_broker_review", "reason": "thin text: 0.0 characters a page", "api_calls": 0})
    record.write_json(done, str(tmp_path / "each"), per_document=True)
    assert sorted(p.parent.name for p in (tmp_path / "each").rglob("part-*.txt")) == ["file=deal_data", "file=extraction_status"] and (tmp_path / "each" / "doc_id=1").is_dir()
    record.write_json(done, str(tmp_path / "lines"))
    rows = tables.read_json(spark, str(tmp_path / "lines"), "offering struct<price:long>, extraction_status string", one_per_file=False).collect()
    assert {(r.offering and r.offering.price, r.extraction_status) for r in rows} == {(1_000_000, None), (None, "pending_broker_review")}
