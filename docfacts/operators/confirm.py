"""The confirmation leg: addresses against given tables, issuers by what their titles hold, and overrides by firm.

Tables take the place of services. A table's row without a place is a negative
entry: the service was asked and had none. Keys that a table does not have yet
are listed by ``unasked``, to be asked and appended.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfacts.functions.text import found, norm
from docfacts.operators.photos import cache_key
from docfacts.operators.place import corroborated
from docfacts.schemas import HIGH, KINDS, MEDIUM, candidate
from docfacts.sources.tables import FEW_ROWS

#: What a square foot can cost.
PRICE_PER_FOOT = (10, 20_000)
CONFLICT = "struct<field:string,source:string,city:string,state:string,other_city:string,other_state:string,other_zip:string,detail:string>"


def key_of(text: Column) -> Column:
    """The short content-addressed key of a cache entry."""
    return F.substring(cache_key(text), 1, 16)


def whole_address(value: Column) -> Column:
    """Street, city, state and zip as one line; null without street, city or state."""
    ok = (value["address"] != "") & (value["city"] != "") & (value["state"] != "")
    return F.when(ok, F.concat_ws(" ", F.concat_ws(", ", value["address"], value["city"], value["state"]), F.nullif(value["zip"], F.lit(""))))


def keyed(table: DataFrame, text_col: str) -> DataFrame:
    """__key, __row of a cache table; of several rows with one text the one with a place counts, the first by its values."""
    rest = [c for c in table.columns if c != text_col]
    present = table.where(F.col(text_col).isNotNull())
    return present.groupBy(key_of(F.col(text_col)).alias("__key"), F.col(text_col).alias("__text")).agg(F.min_by(F.struct(*rest), F.struct(F.col(rest[0]).isNull(), *rest)).alias("__row"))


def cached(df: DataFrame, text: Column, table: DataFrame, text_col: str, name: str) -> DataFrame:
    """``df`` with struct ``name`` (asked, row): asked tells a negative entry from a missing one; row is null for both.

    Rows meet by the short key and then by the whole text, so that texts whose
    keys collide are kept apart. A text that many rows share meets one table
    row; adaptive execution splits its side of a shuffled join.
    """
    side = keyed(table, text_col)
    side = F.broadcast(side) if table.count() <= FEW_ROWS else side  # the table is of a counted size
    first = [c for c in table.columns if c != text_col][0]
    left = df.withColumn("__asked", text)
    same = (key_of(F.col("__asked")) == F.col("__key")) & (F.col("__asked") == F.col("__text"))
    row = F.when(F.col(f"__row.{first}").isNotNull(), F.col("__row"))
    return left.join(side, same, "left").select(*df.columns, F.struct(F.col("__key").isNotNull().alias("asked"), row.alias("row")).alias(name))


def unasked(df: DataFrame, text: Column, table: DataFrame, text_col: str) -> DataFrame:
    """key, ``text_col``: what ``df`` would look up and ``table`` has no entry of, once each."""
    wanted = df.select(text.alias(text_col)).where(F.col(text_col).isNotNull()).distinct()
    return wanted.join(table.select(text_col).distinct(), text_col, "left_anti").select(key_of(F.col(text_col)).alias("key"), text_col)


def same_place(a: Column, b: Column) -> Column:
    """Whether one name, in letters and digits only, holds the other."""
    x, y = norm(a), norm(b)
    return (x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x))


def confirm(df: DataFrame, geocodes: DataFrame, zips: DataFrame) -> DataFrame:
    """``df`` (path, pages, address; also price and buildingSf if it has them) with its address graded anew, and ``conflicts``.

    geocodes: address, city, state, zip, formatted. zips: zip, city, state.
    Agreement of a table with a place that the document's name or cover names
    raises the grade to high and adds a path; disagreement lowers high to medium,
    asks for a review, and is listed. Values are never overwritten. The zip leg
    sees the grade that the address leg leaves. A document without address gets
    no address conflicts.
    """
    keep = df.columns
    value = F.when(found(F.col("address")), F.col("address.value"))
    df = cached(df, whole_address(value), geocodes.select("address", "city", "state", "zip", "formatted"), "address", "__geo")
    df = cached(df, F.nullif(value["zip"], F.lit("")), zips.select("zip", "city", "state"), "zip", "__zip")
    a, v = F.col("address"), F.when(found(F.col("address")), F.col("address.value"))
    geo, zip_ = F.col("__geo.row"), F.col("__zip.row")
    sure = lambda test: F.coalesce(test, F.lit(False))
    df = df.withColumns({
        "__has": F.coalesce(geo["city"] != "", F.lit(False)) & F.coalesce(geo["state"] != "", F.lit(False)), "__agree": sure(same_place(geo["city"], v["city"]) & (geo["state"] == v["state"])),
        "__named": corroborated(F.col("path"), F.col("pages"), geo["city"]), "__own": corroborated(F.col("path"), F.col("pages"), v["city"]),
        "__zhas": F.coalesce(zip_["city"] != "", F.lit(False)), "__zoff": sure((zip_["state"] != "") & (v["state"] != "") & (zip_["state"] != v["state"])), "__zagree": sure(same_place(zip_["city"], v["city"])),
    })
    c, kind = F.col, KINDS["address"]

    def raised(field: Column, path: str, row: Column, snippet: Column, note: str) -> Column:
        place = F.struct(F.lit(None).cast("string").alias("address"), row["city"].alias("city"), row["state"].alias("state"), F.lit(None).cast("string").alias("zip"))
        added = F.struct(F.lit(path).alias("path"), place.alias("value"), F.lit(None).cast("int").alias("page"), snippet.cast("string").alias("snippet")).cast(candidate(kind))
        higher = field.withField("confidence", F.lit(HIGH)).withField("notes", F.lit(note)).withField("paths", F.concat(field["paths"], F.array(added)))
        return F.when(field["confidence"] != HIGH, higher).otherwise(field)

    def lowered(field: Column) -> Column:
        return F.when(field["confidence"] == HIGH, field.withField("confidence", F.lit(MEDIUM)).withField("review_required", F.lit(True))).otherwise(field)

    geo_ok = c("__agree") & c("__named")
    df = df.withColumn("__a1", F.when(c("__has") & geo_ok, raised(a, "geocode", geo, geo["formatted"], "geocode agrees")).when(c("__has") & ~c("__agree"), lowered(a)).otherwise(a))
    zip_ok = ~c("__zoff") & c("__zagree") & c("__own")
    df = df.withColumn("__a2", F.when(c("__zhas") & c("__zoff"), lowered(c("__a1"))).when(c("__zhas") & zip_ok, raised(c("__a1"), "zip", zip_, v["zip"], "zip agrees")).otherwise(c("__a1")))
    none = F.lit(None).cast("string")
    conflict = lambda field, source, row, zip_code, detail: F.struct(
        F.lit(field).alias("field"), F.lit(source).alias("source"), *[(v[x] if row is not None else none).alias(x) for x in ("city", "state")],
        *[(row[x] if row is not None else none).alias(f"other_{x}") for x in ("city", "state")], zip_code.alias("other_zip"), detail.alias("detail")).cast(CONFLICT)
    items = [F.when(c("__has") & ~geo_ok, conflict("address", "geocode", geo, geo["zip"], none)), F.when(c("__zhas") & c("__zoff"), conflict("address", "zip", zip_, v["zip"], none))]
    if {"price", "buildingSf"} <= set(keep):
        number = lambda n: F.when(found(c(n)), F.nullif(c(n)["value"], F.lit(0).cast(KINDS[n]))).cast("double")
        each = F.try_divide(number("price"), number("buildingSf"))
        items.append(F.when(found(a) & ~each.between(*PRICE_PER_FOOT), conflict("buildingSf", "price", None, none, F.format_string("price/sf=%.0f", each))))
    return df.select(*[c("__a2").alias("address") if x == "address" else c(f"`{x}`") for x in keep if x != "conflicts"], F.array_compact(F.array(*items)).alias("conflicts"))


def contains_join(needles: DataFrame, needle: str, haystack: DataFrame, text: str, order: str, gram: int = 3, part_rows: int = 1_000_000, few: int = FEW_ROWS) -> DataFrame:
    """needle, and the columns of the first row of ``haystack`` (by ``order``) whose ``text`` contains it; needles without one are left out.

    Texts are indexed by their character n-grams, a row a text and distinct
    gram. A needle asks by its rarest gram only, and what the index gives is
    verified. Needles shorter than ``gram`` ask an index of their own length.
    Neither side is collected or crossed: both may grow. Up to FEW_ROWS needles,
    by their count, are broadcast to where the texts are cut into grams; more
    meet the index in a shuffle, where a gram's texts are dealt to tasks of
    about ``part_rows``. An empty or null needle, or one that is nowhere, finds
    nothing.
    """
    grams = lambda c, n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substr(c, i, n)))
    asked = needles.select(F.col(needle).alias("__needle")).where(F.length("__needle") > 0).distinct().withColumn("__n", F.least(F.length("__needle"), F.lit(gram)))
    lengths = [r["__n"] for r in asked.select("__n").distinct().collect()]  # at most ``gram`` numbers
    rows = haystack.where(F.col(text).isNotNull() & F.col(order).isNotNull())
    each = F.flatten(F.array(F.array().cast("array<string>"), *[F.when(F.length(text) >= n, grams(F.col(text), F.lit(n))).otherwise(F.array()) for n in lengths]))
    index = rows.select(F.struct(*haystack.columns).alias("__row"), F.explode(each).alias("__gram"))
    own = asked.select("__needle", F.explode(grams(F.col("__needle"), F.col("__n"))).alias("__gram"))
    counts = index.groupBy("__gram").agg(F.count(F.lit(1)).alias("__count"))
    # a needle with a gram that no text has is in none
    rarest = own.join(counts, "__gram", "left").groupBy("__needle").agg(F.min(F.struct(F.coalesce("__count", F.lit(0)).alias("count"), "__gram")).alias("__r")).where("__r.count > 0")
    asking = rarest.select("__needle", F.col("__r.__gram").alias("__gram"))
    if asked.count() <= few:
        pairs = index.join(F.broadcast(asking), "__gram")
    else:
        parts = math.ceil(max(1, rows.count()) / part_rows)
        dealt = index.withColumn("__part", F.pmod(F.xxhash64("__row"), F.lit(parts)).cast("int"))
        pairs = dealt.join(asking.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))), ["__gram", "__part"])
    met = pairs.where(F.contains(F.col(f"__row.`{text}`"), F.col("__needle")))
    first = met.groupBy("__needle").agg(F.min_by("__row", F.struct(F.col(f"__row.`{order}`"), F.col("__row"))).alias("__row"))
    return first.select(F.col("__needle").alias(needle), "__row.*")


def issuers_of(df: DataFrame, tenant: Column, fragments: list[tuple[str, str]], issuers: DataFrame, title: str = "title", order: str = "ord") -> DataFrame:
    """``df`` with struct ``issuer`` (columns of ``issuers``): of the first brand that the tenant's name holds, the first title that holds its fragment.

    fragments: (brand in lower case, fragment of a title in capitals), in order;
    a list of the user's. Titles are compared in capitals. Null without brand or title.
    """
    low = F.lower(tenant)
    fragment = F.coalesce(*[F.when(F.contains(low, F.lit(b)), F.lit(f)) for b, f in fragments]) if fragments else F.lit(None).cast("string")
    named = df.withColumn("__fragment", fragment)
    spark = df.sparkSession
    needles = spark.createDataFrame([(f,) for f in sorted({f for _, f in fragments})], "__fragment string")
    found_ = contains_join(needles, "__fragment", issuers.withColumn("__title", F.upper(title)), "__title", order).drop("__title")
    matched = found_.select("__fragment", F.struct(*issuers.columns).alias("issuer"))  # a row a fragment of the list
    return named.join(F.broadcast(matched), "__fragment", "left").select(*df.columns, "issuer")


#: Builds the fields that it can find, by name.
Template = Callable[[DataFrame], dict[str, Column]]


class Overrides:
    """Templates of firms: each gives Columns for fields that it reads better than the general extractors.

    A template's columns are evaluated for the rows of its firm only, and where
    they find nothing the general field stays.
    """

    def __init__(self) -> None:
        self._by_firm: dict[str, Template] = {}

    def register(self, firm: str) -> Callable[[Template], Template]:
        def keep(template: Template) -> Template:
            if firm in self._by_firm:
                raise ValueError(f"{firm} has a template")
            self._by_firm[firm] = template
            return template

        return keep

    def applied(self, df: DataFrame, firm: Column) -> DataFrame:
        """``df`` with the fields overridden; fields that it does not have are added, null for other firms."""
        df = df.withColumn("__firm", firm)
        by_field: dict[str, list[tuple[str, Column]]] = {}
        for name, template in self._by_firm.items():
            for field, column in template(df).items():
                by_field.setdefault(field, []).append((name, column))
        own = {f: reduce(lambda case, x: case.when(F.col("__firm") == x[0], x[1]), cases[1:], F.when(F.col("__firm") == cases[0][0], cases[0][1])) for f, cases in by_field.items()}
        df = df.withColumns({f"__own_{f}": case for f, case in own.items()})
        merged = {f: F.when(found(F.col(f"__own_{f}")), F.col(f"__own_{f}")).otherwise(F.col(f)) if f in df.columns else F.col(f"__own_{f}") for f in own}
        return df.withColumns(merged).drop("__firm", *[f"__own_{f}" for f in own])
