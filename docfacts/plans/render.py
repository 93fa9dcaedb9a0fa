"""Offering-memorandum texts rendered from orders, in Spark and in DuckDB by one SELECT.

The driver's corpus has no such documents; these exercise every label, anchor
and fallback with values that depend on the order alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docfacts.sources.shared import spread

MONTH_LIST = "January,February,March,April,May,June,July,August,September,October,November,December"


def select_pages(comma: str) -> str:
    """SELECT of doc_id, path, page1 to page3 over orders. comma: how the dialect writes a number with commas, {} for the number."""
    money = lambda x: f"'$' || {comma.format(x)}"
    pct = lambda bp: f"CAST(CAST(floor({bp} / 100.0) AS BIGINT) AS VARCHAR(9)) || '.' || lpad(CAST({bp} % 100 AS VARCHAR(9)), 2, '0') || '%'"
    s = lambda x: f"CAST({x} AS VARCHAR(20))"
    case = lambda expr, *texts: f"CASE {expr} " + " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(texts)) + " END"
    return f"""
SELECT k AS doc_id,
  brand || ' - ' || city || ', ' || st || ' - OM (' || {s('k % 3')} || ').pdf' AS path,
  concat_ws(chr(10), 'Offering Memorandum', brand,
    {case('k % 6', "'Price'", f"'Asking Price: ' || {money('p')}", f"'Offered at ' || {money('p')}", "'Price: call broker'", f"'List Price   ' || {money('p + p % 7 * 20000')}", f"'A price of ' || {money('p')}")},
    {case('k % 6', money('p'))},
    {case('k % 5', f"'Cap Rate: ' || {pct('bp')}", f"'Cap rate of ' || {pct('bp')}", f"'Going-In Cap Rate' || chr(10) || {pct('bp + 10')}", f"'CAP: ' || {pct('bp')}")},
    {s('100 + k % 900')} || ' Main Street, ' || city || ', ' || st || ' ' || zip) AS page1,
  concat_ws(chr(10), 'Financial Overview',
    {case('k % 4', f"'NOI' || chr(10) || {money('noi')}", f"'Net Operating Income of ' || {money('noi')}", f"'Current NOI: ' || {money('noi + k % 3 * 9000')}")},
    {case('k % 3', f"'Annual Rent ' || {money('noi')}", f"'Base Rent: ' || {money('noi * 2')}")},
    {case('k % 4', f"'Building Size: ' || {comma.format('2000 + k % 9000')} || ' SF'", f"'about ' || {comma.format('2000 + k % 9000')} || ' square feet'", "'Building: to be measured'")},
    {case('k % 3', f"'Lot Size' || chr(10) || {s('1 + k % 4')} || '.25 AC'", f"'on ' || {s('1 + k % 40')} || ' acres'")},
    {case('k % 4', f"'Year Built' || chr(10) || {s('1950 + k % 70')}", f"'It was Built in ' || {s('1950 + k % 70')}")},
    {case('k % 4', f"'Parking: ' || {s('10 + k % 90')} || ' spaces'", f"{s('10 + k % 90')} || ' parking spaces'", f"'Parking has ' || {s('10 + k % 90')} || ' spaces'")},
    {case('k % 5', "'with a drive-thru'", "'Drive Through lane'")},
    {case('k % 7', "'Absolute NNN lease'", "'bondable'", "'A triple net lease'", "'double net'", "'Ground lease'", "'full service'", "'gross lease of rooms'")},
    {case('k % 4', f"'Rent Commencement' || chr(10) || split_part('{MONTH_LIST}', ',', CAST(1 + k % 12 AS INT)) || ' ' || {s('1 + k % 28')} || ', ' || {s('2010 + k % 9')}", f"'Commencement: ' || {s('1 + k % 12')} || '/' || {s('1 + k % 28')} || '/' || {s('2010 + k % 9')}", f"'The Lease Commencement was on ' || {s('1 + k % 12')} || '/' || {s('1 + k % 28')} || '/1' || {s('k % 9')}")},
    {case('k % 3', f"'Expiration Date: ' || {s('1 + k % 12')} || '/' || {s('1 + k % 28')} || '/' || {s('2012 + k % 30')}", f"'Lease End' || chr(10) || split_part('{MONTH_LIST}', ',', CAST(1 + k % 12 AS INT)) || ' ' || {s('2012 + k % 30')}")},
    {case('k % 5', f"{s('1 + k % 9')} || '% annual rent increases'", f"'Rent Bumps: ' || {s('1 + k % 9')} || '.5% each'", f"'Escalations ' || {s('1 + k % 4')} || '%'")},
    {case('k % 4', f"{comma.format('10000 + k')} || ' VPD'", f"'Traffic Count ' || {comma.format('10000 + k')} || ' vehicles per day'", f"'Daily Traffic: ' || {comma.format('10000 + k')}")}) AS page2,
  concat_ws(chr(10), {case('k % 3', "'Listed by'", "'Exclusively marketed by'")}, 'Pat Doe | 202-555-0' || {s('100 + k % 100')} || ' | pat@firm' || {s('k % 5')} || '.example', '9 Dock Road, Portville, NY 14770', {case('k % 2', "'License No. 001'")}) AS page3
FROM (
  SELECT k, p, bp, CAST(floor(p * bp / 10000.0) AS BIGINT) AS noi,
    {case('k % 7', "'Quick Mart'", "'Bean House'", "'Tire Barn'", "'Dollar Shed'", "'Sun Pharmacy'", "'Taco Hut'", "'Corner Bank'")} AS brand,
    {case('k % 5', "'Salem'", "'Austin'", "'Dayton'", "'Mesa'", "'Portville'")} AS city, {case('k % 5', "'OR'", "'TX'", "'OH'", "'AZ'", "'NY'")} AS st, {s('10000 + k % 80000')} AS zip
  FROM (SELECT o_orderkey AS k, CAST(floor(o_totalprice * 10) AS BIGINT) AS p, 400 + o_orderkey % 401 AS bp FROM orders) a
) b"""


#: The oracle's view of the same documents: doc_id, path, pages.
OM_SQL = "om AS (SELECT doc_id, path, [page1, page2, page3] AS pages FROM (" + select_pages("format('{{:,}}', {})") + "))"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path, pages, ocr_used of one rendered document per order."""
    orders = spread(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice"), "o_orderkey")
    text = spark.sql(select_pages("format_number({}, 0)").replace("FROM orders)", "FROM {orders})"), orders=orders)
    return text.select("doc_id", "path", F.array("page1", "page2", "page3").alias("pages"), (F.col("doc_id") % 10 == 0).alias("ocr_used"))
