"""Queries of the extractors and of the verification chain, over rendered documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docfacts.functions.text import found, money, number, page_lines, parse_date
from docfacts.operators import fields as X
from docfacts.operators import verify as V
from docfacts.plans.render import OM_SQL, documents
from docfacts.schemas import KINDS
from docfacts.plans.sql import DATE_SQL, LINES_SQL, MONEY_SQL, PCT_SQL, date_sql, field_sql, first_sql, kv_sql, money_sql, near_sql, rate_sql

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def shown(f: Column) -> list[Column]:
    return [f["value"].alias("value"), f["confidence"].alias("confidence"), f["source_page"].alias("source_page")]


def one_field(spark: SparkSession, sf_dir: str, build) -> DataFrame:
    x = build()
    return X.extract(X.with_lines(documents(spark, sf_dir)), x).select("doc_id", *shown(F.col(x.name)))


PRICE_CTES = [
    kv_sql("price"), near_sql("price", r"\$\s?([0-9,]{4,}(?:\.[0-9]+)?)"),
    rf"top_price AS (SELECT doc_id, max(v) AS v, arg_max(page, v * 10 - page) AS page FROM (SELECT doc_id, page, {money_sql('a')} AS v FROM (SELECT doc_id, page, unnest(regexp_extract_all(t, '\$\s?([0-9,]{{5,}}(?:\.[0-9]+)?)', 1)) AS a FROM pg WHERE page <= 3) y) z WHERE v IS NOT NULL GROUP BY doc_id)",
    f"""f_price AS (SELECT doc_id, CASE WHEN a > 50000 THEN a WHEN b > 50000 THEN b WHEN c > 100000 THEN c END AS v,
      CASE WHEN a > 50000 THEN 'high' WHEN b > 50000 THEN 'medium' WHEN c > 100000 THEN 'low' ELSE 'unknown' END AS conf,
      CAST(CASE WHEN a > 50000 THEN pa WHEN b > 50000 THEN pb WHEN c > 100000 THEN pc END AS INT) AS page FROM (
      SELECT om.doc_id, {money_sql('k.value')} AS a, k.page AS pa, {money_sql('n.value')} AS b, n.page AS pb, t.v AS c, t.page AS pc
      FROM om LEFT JOIN kv_price k USING (doc_id) LEFT JOIN near_price n USING (doc_id) LEFT JOIN top_price t USING (doc_id)) q)""",
]
CAP_CTES = [
    kv_sql("capRate"), near_sql("capRate", PCT_SQL),
    field_sql("capRate", rate_sql(f"nullif(regexp_extract(kv_capRate.value, '{PCT_SQL}', 1), '')"), rate_sql("near_capRate.value"), "{v} IS NOT NULL", "near_capRate"),
]
NOI_CTES = [kv_sql("noi"), near_sql("noi", MONEY_SQL), field_sql("noi", money_sql("kv_noi.value"), money_sql("near_noi.value"), "{v} > 5000", "near_noi")]
BASE = [OM_SQL, LINES_SQL]


def with_ctes(ctes: list[str], select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


def field_oracle(name: str, ctes: list[str]) -> str:
    return with_ctes(BASE + ctes, f"SELECT doc_id, v AS value, conf AS confidence, page AS source_page FROM f_{name}")


@query(field_oracle("price", PRICE_CTES))
def kv_price(spark, sf_dir):
    return one_field(spark, sf_dir, X.price)


@query(field_oracle("capRate", CAP_CTES))
def kv_cap_rate(spark, sf_dir):
    return one_field(spark, sf_dir, X.cap_rate)


@query(field_oracle("noi", NOI_CTES))
def noi_extract(spark, sf_dir):
    return one_field(spark, sf_dir, X.noi)


SIMPLE = {
    "buildingSf": (X.building_sf, [kv_sql("buildingSf"), first_sql("buildingSf", r"([0-9,]{3,})\s*(?:SF|square\s*(?:feet|foot)|sq\.?\s?ft)\b"),
        field_sql("buildingSf", money_sql(r"nullif(regexp_extract(kv_buildingSf.value, '(?i)([0-9,]{2,})\s*(?:SF|s\.?f\.?|square)', 1), '')"), money_sql("first_buildingSf.value"), "{v} BETWEEN 200 AND 5000000", "first_buildingSf")]),
    "lotAcres": (X.lot_acres, [kv_sql("lotAcres"), first_sql("lotAcres", r"([0-9]+(?:\.[0-9]+)?)\s*(?:AC\b|acres?)\b"),
        field_sql("lotAcres", r"round_even(try_cast(nullif(regexp_extract(kv_lotAcres.value, '(?i)([0-9.]+)\s*(?:AC\b|acres?)', 1), '') AS DOUBLE), 2)", "round_even(try_cast(first_lotAcres.value AS DOUBLE), 2)", "{v} BETWEEN 0.05 AND 500", "first_lotAcres")]),
    "yearBuilt": (X.year_built, [kv_sql("yearBuilt"), near_sql("yearBuilt", "((?:19|20)[0-9]{2})"),
        field_sql("yearBuilt", "try_cast(nullif(regexp_extract(kv_yearBuilt.value, '((?:19|20)[0-9]{2})', 1), '') AS INT)", "try_cast(near_yearBuilt.value AS INT)", "{v} IS NOT NULL", "near_yearBuilt")]),
    "parkingCount": (X.parking, [kv_sql("parkingCount"), near_sql("parkingCount", r"([0-9]{1,4})\s*(?:parking\s*)?spaces"), first_sql("parkingCount", r"([0-9]{1,4})\s*parking\s*spaces"),
        "other_parkingCount AS (SELECT om.doc_id, coalesce(n.value, f.value) AS value, CASE WHEN n.value IS NOT NULL THEN n.page ELSE f.page END AS page FROM om LEFT JOIN near_parkingCount n USING (doc_id) LEFT JOIN first_parkingCount f USING (doc_id))",
        field_sql("parkingCount", "try_cast(nullif(regexp_extract(kv_parkingCount.value, '([0-9]{1,4})', 1), '') AS INT)", "try_cast(other_parkingCount.value AS INT)", "{v} IS NOT NULL", "other_parkingCount")]),
    "commenced": (lambda: X.lease_date("commenced"), [kv_sql("commenced"), near_sql("commenced", DATE_SQL), field_sql("commenced", date_sql("kv_commenced.value"), date_sql("near_commenced.value"), "{v} IS NOT NULL", "near_commenced")]),
    "expires": (lambda: X.lease_date("expires"), [kv_sql("expires"), near_sql("expires", DATE_SQL), field_sql("expires", date_sql("kv_expires.value"), date_sql("near_expires.value"), "{v} IS NOT NULL", "near_expires")]),
    "currentRent": (X.current_rent, [kv_sql("currentRent"), field_sql("currentRent", money_sql("kv_currentRent.value"), None, "{v} > 5000", "")]),
}


def _register_simple() -> None:
    for name, (build, ctes) in SIMPLE.items():
        title = "field_" + "".join("_" + c.lower() if c.isupper() else c for c in name)
        QUERIES[title] = lambda spark, sf_dir, build=build: one_field(spark, sf_dir, build)
        ORACLES[title] = field_oracle(name, ctes)


_register_simple()

ESCALATION_CTES = [
    first_sql("esc", r"([0-9]{1,2}(?:\.[0-9]{1,2})?)\s*%\s*(?:per\s+year\s+)?(?:annual(?:ly)?\s+)?(?:rent(?:al)?\s+)?(?:increase|escalat|bump)"), near_sql("escalationPct", r"[A-Za-z]*[:\s]+?([0-9]{1,2}(?:\.[0-9]{1,2})?)\s*%"),
    f"e AS (SELECT om.doc_id, {rate_sql('coalesce(f.value, n.value)', 4)} AS v, CASE WHEN f.value IS NOT NULL THEN f.page ELSE n.page END AS page FROM om LEFT JOIN first_esc f USING (doc_id) LEFT JOIN near_escalationPct n USING (doc_id))",
    "f_escalationPct AS (SELECT doc_id, v, CASE WHEN v IS NULL THEN 'unknown' WHEN v BETWEEN 0.003 AND 0.06 THEN 'high' ELSE 'medium' END AS conf, CAST(page AS INT) AS page FROM e)",
]


@query(field_oracle("escalationPct", ESCALATION_CTES))
def field_escalation(spark, sf_dir):
    return one_field(spark, sf_dir, X.escalation)


TRAFFIC_CTES = [
    first_sql("tr", r"([0-9]{1,3}(?:,[0-9]{3})+)\s*(?:\+\s*)?(?:vehicles per day|AADT|VPD|CPD|cars per day)"), near_sql("trafficCount", "([0-9]{1,3}(?:,[0-9]{3})+)"),
    f"tr AS (SELECT om.doc_id, {money_sql('f.value')} AS u, f.page AS pu, {money_sql('n.value')} AS l, n.page AS pl FROM om LEFT JOIN first_tr f USING (doc_id) LEFT JOIN near_trafficCount n USING (doc_id))",
    """f_trafficCount AS (SELECT doc_id, CASE WHEN u > 100 THEN u WHEN l > 100 THEN l END AS v,
      CASE WHEN u > 100 THEN CASE WHEN abs(u - l) <= greatest(1, 0.02 * u) THEN 'high' ELSE 'medium' END WHEN l > 100 THEN 'medium' ELSE 'unknown' END AS conf,
      CAST(CASE WHEN u > 100 THEN pu WHEN l > 100 THEN pl END AS INT) AS page FROM tr)""",
]


@query(field_oracle("trafficCount", TRAFFIC_CTES))
def field_traffic(spark, sf_dir):
    return one_field(spark, sf_dir, X.traffic)


@query(with_ctes(BASE, "SELECT doc_id, bool_or(regexp_matches(t, '(?i)drive[\\s-]?thru|drive[\\s-]?through')) AS value, CASE WHEN bool_or(regexp_matches(t, '(?i)drive[\\s-]?thru|drive[\\s-]?through')) THEN 'high' ELSE 'low' END AS confidence, CAST(min(page) FILTER (WHERE regexp_matches(t, '(?i)drive[\\s-]?thru|drive[\\s-]?through')) AS INT) AS source_page FROM pg GROUP BY doc_id"))
def field_drive_thru(spark, sf_dir):
    return one_field(spark, sf_dir, X.drive_thru)


LEASE_SQL = "CASE " + " ".join(f"WHEN regexp_matches(x, '(?i){p}') THEN '{v}'" for p, v in X.LEASE_TYPES) + " END"


@query(with_ctes([OM_SQL], f"SELECT doc_id, v AS value, CASE WHEN v IS NULL THEN 'unknown' ELSE 'high' END AS confidence FROM (SELECT doc_id, {LEASE_SQL} AS v FROM (SELECT doc_id, array_to_string(pages, chr(10)) AS x FROM om) a) b"))
def lease_type_enum(spark, sf_dir):
    return one_field(spark, sf_dir, X.lease_type).drop("source_page")


def based(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = X.with_lines(documents(spark, sf_dir))
    named = X.extract(docs, X.price(), X.cap_rate(), X.noi())
    return named.withColumns({"price0": F.col("price"), "cap0": F.col("capRate"), "noi0": F.col("noi")})


DERIVE_CTES = [
    *PRICE_CTES, *CAP_CTES, *NOI_CTES,
    "j AS (SELECT doc_id, p.v AS p, p.conf AS pc, n.v AS n, n.conf AS nc, c.v AS c, c.conf AS cc, p.conf IN ('high', 'medium') AS tp, n.conf IN ('high', 'medium') AS tn, c.conf IN ('high', 'medium') AS tc FROM f_price p JOIN f_noi n USING (doc_id) JOIN f_capRate c USING (doc_id))",
    "pr AS (SELECT *, CAST(round_even(n / nullif(c, 0), 0) AS BIGINT) AS pp, CAST(round_even(p * c, 0) AS BIGINT) AS pn, round_even(n::DOUBLE / nullif(p, 0), 5) AS pcap FROM j)",
    """d AS (SELECT *,
      coalesce(tn AND tc AND pp IS NOT NULL AND (NOT tp OR abs(p - pp) / pp::DOUBLE > 0.03), false) AS dp,
      coalesce(tp AND tc AND pn IS NOT NULL AND (NOT tn OR abs(n - pn) / pn::DOUBLE > 0.03), false) AS dn,
      coalesce(tp AND tn AND pcap IS NOT NULL AND (NOT tc OR abs(c - pcap) > 0.0006), false) AS dc FROM pr)""",
    """der AS (SELECT doc_id, p AS p0, n AS n0, c AS c0, CASE WHEN dp THEN pp ELSE p END AS price, CASE WHEN dn THEN pn ELSE n END AS noi, CASE WHEN dc THEN pcap ELSE c END AS cap,
      CASE WHEN dp THEN 'medium' ELSE pc END AS pconf, CASE WHEN dn THEN 'medium' ELSE nc END AS nconf, CASE WHEN dc THEN 'medium' ELSE cc END AS cconf FROM d)""",
]


@query(with_ctes(BASE + DERIVE_CTES, "SELECT doc_id, price, noi, cap, pconf AS price_confidence, nconf AS noi_confidence, cconf AS cap_confidence FROM der"))
def identity_derivation(spark, sf_dir):
    df = V.derive_identity(based(spark, sf_dir))
    return df.select(
        "doc_id", F.col("price.value").alias("price"), F.col("noi.value").alias("noi"), F.col("capRate.value").alias("cap"),
        F.col("price.confidence").alias("price_confidence"), F.col("noi.confidence").alias("noi_confidence"), F.col("capRate.confidence").alias("cap_confidence"),
    )


def reconcile_sql(name: str, same: str, cands: list[str]) -> list[str]:
    """CTEs up to r_name: doc_id, v, conf, n, review from at most three candidates. same: a test of {a} (head) and {b}."""
    eq = lambda a, b: f"coalesce({same.format(a=a, b=b)}, false)"
    return [
        f"c_{name} AS (SELECT doc_id, list_filter([{', '.join(cands)}], lambda x: x IS NOT NULL) AS cs FROM der LEFT JOIN first_headline h USING (doc_id) LEFT JOIN near_ask a USING (doc_id) LEFT JOIN near_rent r USING (doc_id))",
        f"""r_{name} AS (SELECT doc_id, len(cs) AS n,
          CASE WHEN len(cs) < 2 THEN cs[1] WHEN {eq('cs[1]', 'cs[2]')} OR {eq('cs[1]', 'cs[3]')} THEN cs[1] WHEN {eq('cs[2]', 'cs[3]')} THEN cs[2] ELSE cs[1] END AS v,
          CASE WHEN len(cs) = 0 THEN 'unknown' WHEN len(cs) = 1 THEN 'medium' WHEN {eq('cs[1]', 'cs[2]')} OR {eq('cs[1]', 'cs[3]')} OR {eq('cs[2]', 'cs[3]')} THEN 'high' ELSE 'low' END AS conf FROM c_{name})""",
    ]


VERIFY_CTES = [
    *DERIVE_CTES, first_sql("headline", r"cap(?:\s*rate)?\s*[:\-]?\s*([0-9]{1,2}\.[0-9]{1,3})\s*%"),
    near_sql("ask", r"\$\s?([0-9,]{5,})", ["Asking Price", "List Price", "Offering Price", "Purchase Price"], 40), near_sql("rent", r"\$\s?([0-9,]{4,})", ["Annual Rent", "Year 1", "Base Rent", "Current Rent", "Annualized Rent"], 40),
    *reconcile_sql("cap", "abs({a} - {b}) <= 0.0006", ["cap", rate_sql("h.value"), "round_even(n0::DOUBLE / nullif(p0, 0), 5)"]),
    *reconcile_sql("price", "abs({a}::DOUBLE - {b}) / greatest(1.0, abs({b}::DOUBLE)) <= 0.01", ["price", f"CASE WHEN {money_sql('a.value')} > 50000 THEN {money_sql('a.value')} END", "CAST(round_even(n0 / nullif(c0, 0), 0) AS BIGINT)"]),
    *reconcile_sql("noi", "abs({a}::DOUBLE - {b}) / greatest(1.0, abs({b}::DOUBLE)) <= 0.01", ["noi", f"CASE WHEN {money_sql('r.value')} > 5000 THEN {money_sql('r.value')} END", "CAST(round_even(p0 * c0, 0) AS BIGINT)"]),
]


def verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.verify_money(V.derive_identity(based(spark, sf_dir)))


def reconciled(spark, sf_dir, name: str) -> DataFrame:
    f = F.col(name)
    return verified(spark, sf_dir).select("doc_id", f["value"].alias("value"), f["confidence"].alias("confidence"), F.size(f["paths"]).cast("long").alias("n_paths"), f["review_required"].alias("review"))


def reconcile_oracle(name: str) -> str:
    return with_ctes(BASE + VERIFY_CTES, f"SELECT doc_id, v AS value, conf AS confidence, n AS n_paths, conf = 'low' AS review FROM r_{name}")


@query(reconcile_oracle("price"))
def reconcile_price(spark, sf_dir):
    return reconciled(spark, sf_dir, "price")


@query(reconcile_oracle("cap"))
def reconcile_cap(spark, sf_dir):
    return reconciled(spark, sf_dir, "capRate")


@query(reconcile_oracle("noi"))
def reconcile_noi(spark, sf_dir):
    return reconciled(spark, sf_dir, "noi")


GRADES_SQL = with_ctes(BASE + VERIFY_CTES, "SELECT doc_id, 'price' AS field, conf AS grade FROM r_price UNION ALL SELECT doc_id, 'noi', conf FROM r_noi UNION ALL SELECT doc_id, 'capRate', conf FROM r_cap")


def grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = F.array(*[F.struct(F.lit(n).alias("field"), F.col(n)["confidence"].alias("grade")) for n in ("price", "noi", "capRate")])
    return verified(spark, sf_dir).select("doc_id", F.explode(each).alias("g")).select("doc_id", "g.field", "g.grade")


@query(f"SELECT grade, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS share FROM ({GRADES_SQL}) g GROUP BY grade")
def grade_histogram(spark, sf_dir):
    """How the high-stakes fields of all documents grade, with shares."""
    counts = grades(spark, sf_dir).groupBy("grade").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))  # one row: the shares need no window over all rows
    return counts.join(F.broadcast(total)).select("grade", "n", F.round(100.0 * F.col("n") / F.col("total"), 4).alias("share"))


@query(f"SELECT field, count(*) FILTER (WHERE grade = 'high') AS high, count(*) FILTER (WHERE grade = 'medium') AS medium, count(*) FILTER (WHERE grade = 'low') AS low FROM ({GRADES_SQL}) g GROUP BY field")
def field_by_grade(spark, sf_dir):
    return grades(spark, sf_dir).groupBy("field").pivot("grade", ["high", "medium", "low"]).count().na.fill(0)


@query(f"SELECT doc_id, string_agg(field, ',' ORDER BY field) AS flagged, count(*) AS n_flagged FROM ({GRADES_SQL}) g WHERE grade = 'low' GROUP BY doc_id ORDER BY n_flagged DESC, doc_id LIMIT 20")
def flagged_docs_topn(spark, sf_dir):
    low = grades(spark, sf_dir).where("grade = 'low'")  # after the explode: a filter on the chain itself would be pushed down and repeat it
    each = low.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("field")), ",").alias("flagged"), F.count(F.lit(1)).alias("n_flagged"))
    return each.orderBy(F.desc("n_flagged"), "doc_id").limit(20)


FULL_CTES = [*VERIFY_CTES, *[c for n in ("buildingSf", "lotAcres", "commenced", "expires", "currentRent") for c in SIMPLE[n][1]]]
CHECKS_SQL = with_ctes(BASE + FULL_CTES, """
, z AS (SELECT p.doc_id, nullif(p.v, 0) AS price, nullif(n.v, 0) AS noi, nullif(c.v, 0) AS cap, s.v AS sf, l.v AS acres, nullif(coalesce(t.v, n.v), 0) AS rent, b.v AS b, e.v AS e
  FROM r_price p JOIN r_noi n USING (doc_id) JOIN r_cap c USING (doc_id) JOIN f_buildingSf s USING (doc_id) JOIN f_lotAcres l USING (doc_id) JOIN f_currentRent t USING (doc_id) JOIN f_commenced b USING (doc_id) JOIN f_expires e USING (doc_id))
SELECT doc_id, array_to_string(list_filter([
  CASE WHEN abs(noi::DOUBLE / price - cap) > 0.005 THEN 'CAP_RATE_INTEGRITY:warn' WHEN abs(noi::DOUBLE / price - cap) <= 0.005 THEN 'CAP_RATE_INTEGRITY:ok' END,
  CASE WHEN abs(noi - rent) / greatest(noi, rent)::DOUBLE > 0.5 THEN 'RENT_NOI_DELTA:info' END, CASE WHEN b >= e THEN 'LEASE_DATES:warn' END,
  CASE WHEN NOT (acres * 43560 / sf BETWEEN 1.2 AND 80) THEN 'LOT_RATIO_OUTLIER:warn' END, CASE WHEN NOT (price::DOUBLE / sf BETWEEN 20 AND 20000) THEN 'PRICE_PSF_OUTLIER:warn' END
], lambda x: x IS NOT NULL), ',') AS warnings FROM z""").replace("\n\n, z AS", ", z AS").replace("\n, z AS", ", z AS")


def full_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ordered chain: extract, derive, reconcile, rent fallback, OCR cap, cross-checks."""
    df = X.extract_fields(documents(spark, sf_dir))
    df = df.withColumns({"price0": F.col("price"), "cap0": F.col("capRate"), "noi0": F.col("noi")})
    df = V.rent_from_noi(V.verify_money(V.derive_identity(df)))
    df = V.cap_ocr(df, [n for n in KINDS if n in df.columns])
    return V.cross_checks(df)


@query(CHECKS_SQL)
def cross_checks(spark, sf_dir):
    return full_chain(spark, sf_dir).select("doc_id", F.array_join(F.transform("warnings", lambda w: F.concat_ws(":", w["check"], w["status"])), ",").alias("warnings"))


TEXTS = "SELECT o_orderkey AS k, '$' || CASE o_orderkey % 4 WHEN 0 THEN 'n/a' WHEN 1 THEN CAST(o_orderkey AS VARCHAR) WHEN 2 THEN CAST(o_orderkey % 1000 AS VARCHAR) || ',500' ELSE CAST(o_orderkey AS VARCHAR) || '.25' END AS t FROM orders"


@query(f"SELECT k, {money_sql('t')} AS amount, try_cast(replace(substr(t, 2), ',', '') AS DOUBLE) AS num FROM ({TEXTS}) x")
def money_parse(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"))
    key = F.col("k").cast("string")
    t = F.concat(F.lit("$"), F.when(F.col("k") % 4 == 0, "n/a").when(F.col("k") % 4 == 1, key).when(F.col("k") % 4 == 2, F.concat((F.col("k") % 1000).cast("string"), F.lit(",500"))).otherwise(F.concat(key, F.lit(".25"))))
    return orders.select("k", money(t).alias("amount"), number(F.substr(t, F.lit(2))).alias("num"))


@query("SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 2 THEN strftime(o_orderdate, '%Y-%m-01') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS iso FROM orders")
def date_parse(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("d"))
    form = F.when(F.col("k") % 3 == 0, F.date_format("d", "MMMM d, yyyy")).when(F.col("k") % 3 == 1, F.date_format("d", "M/d/yyyy")).otherwise(F.date_format("d", "MMMM yyyy"))
    return orders.select("k", parse_date(form).alias("iso"))


@query("WITH " + OM_SQL + " SELECT doc_id, CAST(sum(CAST(length(x) - length(replace(x, chr(10), '')) + 1 AS BIGINT)) AS BIGINT) AS n_lines FROM (SELECT doc_id, unnest(pages) AS x FROM om) a GROUP BY doc_id")
def rendered_lines(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return docs.select("doc_id", F.aggregate(page_lines(F.col("pages")), F.lit(0).cast("bigint"), lambda a, x: a + F.size(x)).alias("n_lines"))


@query(with_ctes(BASE + [near_sql("any", MONEY_SQL, ["NOI", "Net Operating Income"], 40)], "SELECT doc_id, value, CAST(page AS INT) AS page FROM near_any"))
def anchored_window(spark, sf_dir):
    from docfacts.functions.text import MONEY, regex_near

    hit = documents(spark, sf_dir).select("doc_id", regex_near(F.col("pages"), ["NOI", "Net Operating Income"], MONEY, 40).alias("h"))
    return hit.where("h IS NOT NULL").select("doc_id", "h.value", "h.page")


@query(with_ctes(BASE + FULL_CTES, "SELECT count(*) AS docs, sum((price IS NOT NULL)::INT + (noi IS NOT NULL)::INT)::BIGINT AS found FROM der"))
def found_counts(spark, sf_dir):
    df = V.derive_identity(based(spark, sf_dir))
    n = found(F.col("price")).cast("int") + found(F.col("noi")).cast("int")
    return df.agg(F.count(F.lit(1)).alias("docs"), F.sum(n).alias("found"))
