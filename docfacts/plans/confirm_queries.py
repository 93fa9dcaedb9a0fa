"""Queries of the confirmation leg, over rendered documents and tables derived from orders, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docfacts.functions.text import found_field, kv_lookup, missing, money
from docfacts.operators import confirm
from docfacts.operators import fields as X
from docfacts.schemas import HIGH, KINDS, MEDIUM, VERBATIM

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


#: Places of the documents by key, in both dialects: some without street or zip, some named on the cover, some not.
ADDRESSED = """SELECT k AS doc_id, CASE k % 5 WHEN 0 THEN 'Salem' WHEN 1 THEN 'Austin' WHEN 2 THEN 'Dayton' WHEN 3 THEN 'Mesa' ELSE 'Portville' END AS city, CASE k % 5 WHEN 0 THEN 'OR' WHEN 1 THEN 'TX' WHEN 2 THEN 'OH' WHEN 3 THEN 'AZ' ELSE 'NY' END AS state,
  CASE WHEN k % 7 > 0 THEN CAST(k % 400 + 1 AS VARCHAR(9)) || ' Main Street' END AS street, CASE WHEN k % 3 > 0 THEN CAST(10000 + k % 400 AS VARCHAR(9)) END AS zip, k % 4 > 0 AS named, CASE k % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS grade, k % 11 = 0 AS without,
  k % 13 * 100000 AS price, k % 17 * 10 AS sf FROM (SELECT o_orderkey AS k FROM orders) o"""
#: What the address service had: other spellings, other places, no place (a negative entry), or nothing at all.
GEOCODES = """SELECT address, CASE n % 6 WHEN 0 THEN city || ' City' WHEN 1 THEN 'Elsewhere' WHEN 2 THEN CAST(NULL AS VARCHAR(9)) ELSE city END AS city, CASE n % 6 WHEN 3 THEN 'ZZ' ELSE state END AS state, CAST(n AS VARCHAR(9)) AS zip, 'at ' || address AS formatted
FROM (SELECT DISTINCT concat_ws(' ', concat_ws(', ', street, city, state), zip) AS address, city, state, CAST(split_part(street, ' ', 1) AS INT) AS n FROM (ADDRESSED) a WHERE street IS NOT NULL) b WHERE n % 10 < 9"""
ZIPS = """SELECT zip, CASE n % 4 WHEN 0 THEN CAST(NULL AS VARCHAR(9)) WHEN 1 THEN 'Mesa' ELSE 'Salem' END AS city, CASE n % 3 WHEN 0 THEN 'OR' WHEN 1 THEN 'AZ' ELSE CAST(NULL AS VARCHAR(9)) END AS state FROM (SELECT DISTINCT zip, CAST(zip AS INT) AS n FROM (ADDRESSED) a WHERE zip IS NOT NULL) b WHERE n % 8 < 7"""


def made(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql.replace("(ADDRESSED)", f"({ADDRESSED})").replace("FROM orders)", "FROM {orders})"), orders=spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey"))


def addressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path, pages, and the fields address, price, buildingSf."""
    d = made(spark, sf_dir, ADDRESSED)
    kind = KINDS["address"]
    value = F.struct(F.col("street").alias("address"), "city", "state", "zip")
    field = F.coalesce(*[found_field(F.when(~F.col("without") & (F.col("grade") == g), value), kind, g, VERBATIM, F.lit(1), F.col("city")) for g in ("high", "medium", "low")], missing(kind, "not found"))
    money_ = lambda c, name: F.coalesce(found_field(F.col(c).cast("bigint"), KINDS[name], HIGH, VERBATIM, F.lit(1), F.lit("x")), missing(KINDS[name], "not found")).alias(name)
    cover = F.concat(F.lit("For sale"), F.when(F.col("named"), F.concat(F.lit(" in "), "city")).otherwise(""))
    return d.select("doc_id", F.lit("in/om.pdf").alias("path"), F.array(cover).alias("pages"), field.alias("address"), money_("price", "price"), money_("sf", "buildingSf"))


TABLES = f"d AS ({ADDRESSED}), g AS ({GEOCODES.replace('(ADDRESSED)', 'd')}), z AS ({ZIPS.replace('(ADDRESSED)', 'd')})".replace("FROM d a", "FROM d AS a")
SAME_SQL = "(contains(regexp_replace(lower({0}), '[^a-z0-9]', '', 'g'), regexp_replace(lower({1}), '[^a-z0-9]', '', 'g')) OR contains(regexp_replace(lower({1}), '[^a-z0-9]', '', 'g'), regexp_replace(lower({0}), '[^a-z0-9]', '', 'g')))"


@query(f"""WITH {TABLES},
j AS (SELECT d.*, CASE WHEN g.city IS NOT NULL AND g.state IS NOT NULL THEN g.city END AS gc, g.state AS gs, g.zip AS gz, z.city AS zc, z.state AS zs FROM (SELECT *, CASE WHEN NOT without THEN concat_ws(' ', concat_ws(', ', street, city, state), zip) END AS line FROM d) d
  LEFT JOIN g ON d.street IS NOT NULL AND d.line = g.address LEFT JOIN z ON NOT d.without AND d.zip = z.zip),
a AS (SELECT *, coalesce({SAME_SQL.format('gc', 'city')} AND gs = state, false) AS agree, named AND coalesce(contains('omforsalein' || lower(city), regexp_replace(lower(gc), '[^a-z0-9]', '', 'g')) OR contains('ompdfforsalein' || lower(city), regexp_replace(lower(gc), '[^a-z0-9]', '', 'g')), false) AS cover FROM j),
b AS (SELECT *, CASE WHEN gc IS NULL THEN grade WHEN agree AND cover THEN 'high' WHEN NOT agree AND grade = 'high' THEN 'medium' ELSE grade END AS g1, (gc IS NOT NULL AND NOT agree AND grade = 'high') AS r1, (gc IS NOT NULL AND agree AND cover AND grade <> 'high')::INT AS p1, gc IS NOT NULL AND NOT (agree AND cover) AS k1 FROM a),
c AS (SELECT *, CASE WHEN zc IS NULL THEN 0 WHEN zs <> state THEN -1 WHEN {SAME_SQL.format('zc', 'city')} AND named THEN 1 ELSE 0 END AS leg FROM b)
SELECT doc_id, CASE WHEN without THEN 'unknown' WHEN leg = 1 THEN 'high' WHEN leg = -1 AND g1 = 'high' THEN 'medium' ELSE g1 END AS confidence, NOT without AND (r1 OR (coalesce(leg, 0) = -1 AND g1 = 'high')) AS review, CASE WHEN without THEN 0 ELSE p1 + (coalesce(leg, 0) = 1 AND g1 <> 'high')::INT END AS n_paths,
  concat_ws(';', CASE WHEN k1 THEN concat_ws(' ', 'address:geocode', city, state, gc, gs, gz) END, CASE WHEN leg = -1 THEN concat_ws(' ', 'address:zip', city, state, zc, zs, zip) END,
    CASE WHEN NOT without AND price > 0 AND sf > 0 AND NOT (price / sf::DOUBLE BETWEEN 10 AND 20000) THEN 'buildingSf:price price/sf=' || round(price / sf::DOUBLE)::BIGINT END) AS conflicts FROM c""")
def confirmed_address(spark, sf_dir):
    """The address graded by what two given tables say of it, and what they contradict."""
    done = confirm.confirm(addressed(spark, sf_dir), made(spark, sf_dir, GEOCODES), made(spark, sf_dir, ZIPS))
    a = F.col("address")
    each = F.transform("conflicts", lambda c: F.concat_ws(" ", F.concat_ws(":", c["field"], c["source"]), c["city"], c["state"], c["other_city"], c["other_state"], c["other_zip"], c["detail"]))
    return done.select("doc_id", a["confidence"].alias("confidence"), a["review_required"].alias("review"), F.size(a["paths"]).alias("n_paths"), F.array_join(each, ";").alias("conflicts"))


@query(f"WITH {TABLES} SELECT DISTINCT substr(sha256(line), 1, 16) AS key, line AS address FROM (SELECT concat_ws(' ', concat_ws(', ', street, city, state), zip) AS line FROM d WHERE street IS NOT NULL AND NOT without) x WHERE line NOT IN (SELECT address FROM g)")
def unasked_addresses(spark, sf_dir):
    """What the address table has no entry of, not even a negative one."""
    return confirm.unasked(addressed(spark, sf_dir), confirm.whole_address(F.col("address.value")), made(spark, sf_dir, GEOCODES), "address")


#: Brand and fragment of a title; the titles are names of customers and parts.
FRAGMENTS = [("quick", "CUSTOMER#00000000"), ("bean", "9"), ("tire barn", "R#"), ("dollar", "NOWHERE"), ("taco", "#0000000")]
BRAND_SQL = "CASE doc_id % 7 WHEN 0 THEN 'Quick Mart' WHEN 1 THEN 'Bean House' WHEN 2 THEN 'Tire Barn' WHEN 3 THEN 'Dollar Shed' WHEN 4 THEN 'Sun Pharmacy' WHEN 5 THEN 'Taco Hut' ELSE CAST(NULL AS VARCHAR(9)) END"


@query(f"""WITH f AS (SELECT * FROM (VALUES ('Quick Mart', 'CUSTOMER#00000000'), ('Bean House', '9'), ('Tire Barn', 'R#'), ('Dollar Shed', 'NOWHERE'), ('Taco Hut', '#0000000')) t(tenant, fragment)),
m AS (SELECT tenant, min(c_custkey) AS ord, arg_min(c_name, c_custkey) AS title FROM f JOIN customer ON contains(upper(c_name), fragment) GROUP BY tenant)
SELECT doc_id, tenant, ord, title FROM (SELECT o_orderkey AS doc_id, {BRAND_SQL.replace('doc_id', 'o_orderkey')} AS tenant FROM orders) o LEFT JOIN m USING (tenant)""")
def issuer_match(spark, sf_dir):
    """Of each tenant's brand the first issuer whose title holds its fragment, through an index of n-grams."""
    docs = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("doc_id")).withColumn("tenant", F.expr(BRAND_SQL))
    titles = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("ord"), F.col("c_name").alias("title"))
    return confirm.issuers_of(docs, F.col("tenant"), FRAGMENTS, titles).select("doc_id", "tenant", "issuer.ord", "issuer.title")


@query("""WITH s AS (SELECT DISTINCT substr(p_name, 1, 1 + p_partkey % 5) AS needle FROM part WHERE p_partkey % 20 = 0),
m AS (SELECT needle, min(s_suppkey) AS ord FROM s JOIN (SELECT s_suppkey, lower(s_name) || ' ' || s_suppkey || ' ' || coalesce(p_name, '') AS text FROM supplier LEFT JOIN part ON p_partkey = s_suppkey) t ON contains(text, needle) GROUP BY needle)
SELECT needle, ord FROM m""")
def substring_join(spark, sf_dir):
    """The first text that contains each of a table of short strings of one to five characters."""
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    needles = t("part").where("p_partkey % 20 = 0").select(F.expr("substr(p_name, 1, 1 + p_partkey % 5)").alias("needle"))
    texts = t("supplier").join(t("part"), F.col("p_partkey") == F.col("s_suppkey"), "left").select(F.col("s_suppkey").alias("ord"), F.concat_ws(" ", F.lower("s_name"), F.col("s_suppkey").cast("string"), F.coalesce("p_name", F.lit(""))).alias("text"))
    return confirm.contains_join(needles, "needle", texts, "text", "ord").select("needle", "ord")


#: Two firms' templates: one reads its price by a label of its own, one by a label that most documents lack.
TEMPLATES = confirm.Overrides()


def labelled(name: str, label: str) -> dict:
    """A template's field: the amount after a label of the firm's own."""
    hit = kv_lookup("lines", [label])
    return {name: F.coalesce(found_field(money(hit["value"]), KINDS[name], HIGH, VERBATIM, hit["page"], hit["line"], "template"), missing(KINDS[name], "not found"))}


@TEMPLATES.register("Alpha Realty")
def alpha(df: DataFrame) -> dict:
    return labelled("price", "Guide") | labelled("noi", "Yearly")


@TEMPLATES.register("Beta Net")
def beta(df: DataFrame) -> dict:
    return labelled("price", "Ask")


@query("""SELECT o_orderkey AS doc_id, firm, CASE WHEN firm = 'Alpha Realty' AND o_orderkey % 2 = 0 THEN 200000 + o_orderkey WHEN firm = 'Beta Net' AND o_orderkey % 2 = 1 THEN 300000 + o_orderkey ELSE 100000 + o_orderkey END AS price,
  CASE WHEN firm = 'Alpha Realty' AND o_orderkey % 2 = 0 OR firm = 'Beta Net' AND o_orderkey % 2 = 1 THEN 'template' END AS notes, CASE WHEN firm = 'Alpha Realty' THEN 50000 + o_orderkey END AS noi
FROM (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'Alpha Realty' WHEN 1 THEN 'Beta Net' WHEN 2 THEN 'Gamma' WHEN 3 THEN CAST(NULL AS VARCHAR) ELSE 'Alpha Realty' END AS firm FROM orders) o""")
def firm_override(spark, sf_dir):
    """Fields that a firm's own template reads, where it finds them."""
    k = F.col("doc_id")
    amount = lambda base: F.concat(F.lit("$"), F.format_number(k + base, 0))
    text = F.concat_ws("\n", F.concat(F.lit("Price: "), amount(100_000)), F.concat(F.when(k % 2 == 0, "Guide: ").otherwise("Ask: "), F.when(k % 2 == 0, amount(200_000)).otherwise(amount(300_000))), F.concat(F.lit("Yearly "), amount(50_000)))
    firm = F.when(k % 5 == 0, "Alpha Realty").when(k % 5 == 1, "Beta Net").when(k % 5 == 2, "Gamma").when(k % 5 == 4, "Alpha Realty")
    docs = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("doc_id")).withColumns({"pages": F.array(text), "firm": firm})
    done = TEMPLATES.applied(X.extract(X.with_lines(docs), X.price()), F.col("firm"))
    return done.select("doc_id", "firm", F.col("price.value").alias("price"), F.col("price.notes").alias("notes"), F.col("noi.value").alias("noi"))
