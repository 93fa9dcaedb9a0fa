"""Queries of layouts and photos, over elements placed by rules from orders and lineitem, and their SQL (overlaps by nested loops)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docfacts.operators import layout, photos

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


#: Each in both dialects; a third of all text boxes and places lie on the pages of one document.
TEXT_BOXES = """SELECT CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE l_orderkey END AS doc_id, l_linenumber % 2 + 1 AS page, l_partkey % 550 * 1e0 AS x0, l_suppkey % 97 * 8e0 AS y0, l_partkey % 550 + 20e0 + l_orderkey % 90 AS x1, l_suppkey % 97 * 8e0 + 8 AS y1,
  CASE WHEN l_linenumber = 4 THEN '  ' ELSE 'text' END AS text, (l_orderkey * 10 + l_linenumber) * 100000000 + l_partkey * 1000 + l_suppkey % 1000 AS ord FROM lineitem"""
PLACES = """SELECT CASE WHEN k % 3 = 0 THEN 0 ELSE k END AS doc_id, CAST(k % 2 AS INT) + 1 AS page, k AS image, CAST(place AS INT) AS place, k % 7 * 80e0 AS x0, k % 11 * 60e0 + place * 30 AS y0, k % 7 * 80e0 + 40 + k % 5 * 30 AS x1, k % 11 * 60e0 + place * 30 + 80e0 AS y1, 612e0 AS page_width, 792e0 AS page_height
FROM (SELECT o_orderkey AS k FROM orders) o, (VALUES (0), (1)) p(place)"""
FILLS = """SELECT l_orderkey - l_orderkey % 16 AS doc_id, CAST(l_orderkey % 2 AS INT) + 1 AS page, (l_orderkey * 10 + l_linenumber) * 100000000 + l_partkey * 1000 + l_suppkey % 1000 AS ord, 10e0 AS x0, 10e0 AS y0, 10e0 + l_partkey % 600 AS x1, 10e0 + l_partkey % 53 * 3 AS y1, 612e0 AS page_width, 792e0 AS page_height,
  CASE l_partkey % 8 WHEN 0 THEN NULL WHEN 1 THEN {a}(0.25e0) WHEN 2 THEN {a}(0.96e0) WHEN 3 THEN {a}(0.1e0, 0.5e0, 0.75e0) WHEN 4 THEN {a}(0.95e0, 1e0, 0.99e0) WHEN 5 THEN {a}(0e0, 0.25e0, 0.5e0, 0.125e0) WHEN 6 THEN {a}(0e0, 0e0, 0.01e0, 0e0) ELSE {a}(1e0, 0.5e0) END AS colour FROM lineitem"""
SPANS = """SELECT l_orderkey - l_orderkey % 64 AS doc_id, 1 AS page, (l_orderkey * 10 + l_linenumber) * 100000000 + l_partkey * 1000 + l_suppkey % 1000 AS ord, CASE WHEN l_linenumber % 5 = 0 THEN ' ' ELSE ' s' || CAST(l_partkey AS VARCHAR(9)) END AS text, CASE l_linenumber % 4 WHEN 0 THEN 'Arial-BoldMT' WHEN 1 THEN 'Times-Oblique' WHEN 2 THEN NULL ELSE 'Serif' END AS font,
  l_suppkey % 40 + 0.25e0 AS size, CAST(l_partkey % 32 AS INT) AS flags, l_partkey * 4099 AS colour, 1e0 * l_linenumber AS x0, 2e0 AS y0, 3e0 AS x1, 4e0 AS y1 FROM lineitem"""
IMAGES = """SELECT k - k % 96 AS doc_id, CAST(k % 3 AS INT) + 1 AS page, k AS ord, k % 40 AS image, CAST(200 + k % 9 * 100 AS INT) AS width, CAST(150 + k % 7 * 100 AS INT) AS height, k % 10 * 0.5e0 AS entropy, k % 8 * 0.01e0 AS edges, CAST(k % 6 AS INT) AS overlap,
  k % 5 * 0.04e0 AS masked, k % 11 * 0.1e0 AS continuity, k % 13 * 0.08e0 AS smear FROM (SELECT o_orderkey AS k FROM orders) o"""


def made(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    table = "lineitem" if "FROM lineitem" in sql else "orders"
    return spark.sql(sql.replace(f"FROM {table}", "FROM {t}").replace("{a}", "array"), t=spark.read.parquet(f"{sf_dir}/{table}.parquet"))


LIST = FILLS.replace("{a}(", "list_value(")


@query(f"""WITH t AS ({TEXT_BOXES}), p AS ({PLACES})
SELECT doc_id, page, image, max(n)::BIGINT AS overlap, max(share) AS cover FROM (SELECT p.doc_id, p.page, p.image, p.place, (p.x1 - p.x0) * (p.y1 - p.y0) / (page_width * page_height) AS share,
  count(t.x0) AS n FROM p LEFT JOIN (SELECT * FROM t WHERE trim(text) <> '') t ON p.doc_id = t.doc_id AND p.page = t.page AND NOT (p.x1 <= t.x0 OR t.x1 <= p.x0 OR p.y1 <= t.y0 OR t.y1 <= p.y0) GROUP BY ALL) q GROUP BY doc_id, page, image""")
def image_text_overlap(spark, sf_dir):
    """Of each image the most text boxes over one place and its share of the page; one document holds a third of all."""
    return layout.image_cover(made(spark, sf_dir, PLACES), made(spark, sf_dir, TEXT_BOXES))


COLOUR_SQL = """CASE WHEN len(colour) = 1 THEN [colour[1], colour[1], colour[1]] WHEN len(colour) = 4 THEN [(1 - colour[1]) * (1 - colour[4]), (1 - colour[2]) * (1 - colour[4]), (1 - colour[3]) * (1 - colour[4])] WHEN len(colour) >= 3 THEN colour[1:3] END"""
HEX_SQL = "coalesce('#' || array_to_string([lower(lpad(to_hex(greatest(0, least(255, round_even(v * 255, 0)::INT))), 2, '0')) for v in c], ''), '#000000')"
GATED_SQL = f"""f AS (SELECT *, {COLOUR_SQL} AS c FROM ({LIST}) x WHERE colour IS NOT NULL),
g AS (SELECT * FROM f WHERE len([v for v in coalesce(c, colour)[1:3] if v < 0.95]) > 0 AND x1 > x0 AND y1 > y0 AND (x1 - x0) * (y1 - y0) / (page_width * page_height) >= 0.02)"""


@query(f"WITH {GATED_SQL} SELECT doc_id, page, ord, {HEX_SQL} AS colour FROM g")
def fill_gates(spark, sf_dir):
    return layout.gated_fills(made(spark, sf_dir, FILLS)).select("doc_id", "page", "ord", layout.fill_colour(F.col("colour")).alias("colour"))


@query(f"""WITH {GATED_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY ord) AS rn FROM g), pf AS (SELECT doc_id, page, list({HEX_SQL} ORDER BY rn) FILTER (WHERE rn <= 3) AS fills, max(rn) > 3 AS cut FROM r GROUP BY ALL),
s AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY ord) AS rn FROM ({SPANS}) x WHERE trim(text) <> ''),
ps AS (SELECT doc_id, page, list(trim(text) || ' ' || '#' || lpad(lower(to_hex(colour & 16777215)), 6, '0') || CASE WHEN flags & 16 > 0 OR coalesce(font, '') ILIKE '%bold%' THEN ' b' ELSE '' END || CASE WHEN flags & 2 > 0 OR coalesce(font, '') ILIKE '%oblique%' THEN ' i' ELSE '' END ORDER BY rn) FILTER (WHERE rn <= 40) AS spans, max(rn) > 40 AS cut FROM s GROUP BY ALL),
i AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY ord, place) AS rn FROM (SELECT doc_id, page, image, min(ord) AS ord, unnest([0, 1]) AS place FROM ({IMAGES}) x GROUP BY doc_id, page, image) y),
pi AS (SELECT doc_id, page, list(image ORDER BY rn) FILTER (WHERE rn <= 5) AS images, max(rn) > 5 AS cut FROM i GROUP BY ALL),
p AS (SELECT DISTINCT l_orderkey - l_orderkey % 16 AS doc_id, CAST(l_orderkey % 2 AS INT) + 1 AS page FROM lineitem)
SELECT doc_id, page, coalesce(array_to_string(spans, ','), '') AS spans, coalesce(array_to_string(images, ','), '') AS images, coalesce(array_to_string(fills, ','), '') AS fills, coalesce(pf.cut, false) OR coalesce(ps.cut, false) OR coalesce(pi.cut, false) AS truncated
FROM p LEFT JOIN pf USING (doc_id, page) LEFT JOIN ps USING (doc_id, page) LEFT JOIN pi USING (doc_id, page)""")
def layout_caps(spark, sf_dir):
    """Spans, image places and fills of each page up to their caps, in reading order, and whether a cap was reached."""
    fills, spans = made(spark, sf_dir, FILLS), made(spark, sf_dir, SPANS)
    at = F.struct(*[F.lit(float(v)).alias(c) for c, v in zip(layout.BOX, (0, 0, 9, 9), strict=True)])
    images = made(spark, sf_dir, IMAGES).withColumn("places", F.array(at, at))
    pages = fills.select("doc_id", "page", "page_width", "page_height").distinct()
    done = layout.page_layouts(pages, spans, images, fills, {"spans": 40, "images": 5, "fills": 3})
    look = lambda s: F.concat(s["text"], F.lit(" "), s["colour"], F.when(s["bold"], " b").otherwise(""), F.when(s["italic"], " i").otherwise(""))
    joined = lambda name, f: F.array_join(F.transform(name, f), ",").alias(name)
    return done.select("doc_id", "page", joined("spans", look), joined("images", lambda i: i["image"].cast("string")), joined("fills", lambda f: f["colour"]), "truncated")


PHOTO_SQL = f"""i AS ({IMAGES}), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, image ORDER BY page, ord) AS rn FROM i),
m AS (SELECT * EXCLUDE (rn), width >= 400 AND height >= 300 AND width / height::DOUBLE BETWEEN 0.3 AND 4.0 AND entropy >= 3 AND edges >= 0.02 AS photo FROM o WHERE rn = 1)"""


@query(f"WITH {PHOTO_SQL} SELECT doc_id, image, page, CASE WHEN NOT photo THEN 'skip' WHEN overlap >= 3 THEN 'raw_extract' ELSE 'needs_overlay_pass' END AS method FROM m")
def photo_gates(spark, sf_dir):
    """Each image object of a document once, at its first place, and how its photo can be recovered."""
    return photos.recovery(photos.first_occurrences(made(spark, sf_dir, IMAGES))).select("doc_id", "image", "page", "method")


@query(f"""WITH {PHOTO_SQL},
q AS (SELECT *, overlap >= 3 AS raw, CASE WHEN overlap >= 3 OR masked = 0 THEN 1.0 WHEN masked > 0.15 THEN 0.0 ELSE round_even(0.4 * (1 - masked) + 0.3 * continuity + 0.3 * smear, 4) END AS score FROM m WHERE photo),
n AS (SELECT *, CASE WHEN score >= 0.55 THEN count(*) FILTER (WHERE score >= 0.55) OVER (PARTITION BY doc_id ORDER BY page, ord ROWS UNBOUNDED PRECEDING) END AS number FROM q),
l AS (SELECT doc_id, string_agg('exterior-' || CASE WHEN number < 10 THEN '0' ELSE '' END || number || '.jpg ' || CASE WHEN raw THEN 'raw_extract' ELSE 'inpainted' END || ' ' || format('{{:.4f}}', score), ',' ORDER BY page, ord) FILTER (WHERE number IS NOT NULL) AS photos,
  string_agg(image || CASE WHEN masked > 0.15 THEN ' too much masked' ELSE ' low quality' END, ',' ORDER BY page, ord) FILTER (WHERE number IS NULL) AS failures FROM n GROUP BY doc_id)
SELECT doc_id, 'om-' || doc_id AS asset_id, coalesce(photos, '') AS photos, coalesce(failures, '') AS failures FROM (SELECT DISTINCT o_orderkey - o_orderkey % 96 AS doc_id FROM orders) d LEFT JOIN l USING (doc_id)""")
def photo_manifest(spark, sf_dir):
    """The manifest of each document: its surviving photos, numbered in page order, and what the overlay pass lost."""
    images = made(spark, sf_dir, IMAGES)
    docs = images.select("doc_id").distinct().withColumn("path", F.concat(F.lit("in/om-"), F.col("doc_id").cast("string"), F.lit(".pdf")))
    m = photos.manifests(docs, photos.numbered(photos.recovery(photos.first_occurrences(images)))).select("doc_id", "manifest.*")
    photo = F.transform("photos", lambda p: F.concat_ws(" ", p["filename"], p["method"], F.format_string("%.4f", p["quality_score"])))
    return m.select("doc_id", "asset_id", F.array_join(photo, ",").alias("photos"), F.array_join(F.transform("pass_failures", lambda f: F.concat_ws(" ", f["image"].cast("string"), f["reason"])), ",").alias("failures"))


@query("""WITH c AS (SELECT l_partkey AS part, l_quantity AS q, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT part, round(-sum(n / t * log2(n / t)), 6) + 0 AS entropy FROM (SELECT *, (sum(n) OVER (PARTITION BY part))::DOUBLE AS t FROM c) x GROUP BY part""")
def histogram_entropy(spark, sf_dir):
    """The entropy of each part's histogram of quantities."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_partkey").alias("part"), F.col("l_quantity").alias("q"))
    return photos.entropy(lines, ["part"], "q").select("part", (F.round("entropy", 6) + F.lit(0.0)).alias("entropy"))


@query("SELECT o_orderkey AS k, sha256(o_custkey || ':' || o_orderpriority) AS key, substr(sha256(o_custkey || ':' || o_orderpriority), 1, 16) AS short FROM orders")
def cache_keys(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    key = photos.cache_key(F.col("o_custkey"), F.col("o_orderpriority"))
    return orders.select(F.col("o_orderkey").alias("k"), key.alias("key"), F.substring(key, 1, 16).alias("short"))
