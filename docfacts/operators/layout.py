"""Page layout from placed elements: overlaps of rectangles, gates of fills, type styles, colours, and caps in reading order.

Elements are long tables by doc_id, page and ord (their place in reading order),
with a rectangle x0, y0, x1, y1 in points.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Caps of a page, gates of fills, flags and name hints of type styles.
CAPS = {"spans": 400, "images": 40, "fills": 60}
LEAST_SHARE, NEAR_WHITE = 0.02, 0.95
BOLD_FLAG, ITALIC_FLAG = 16, 2
BOLD_NAMES = ["bold", "black", "heavy", "extrabold", "semibold", "demibold"]
ITALIC_NAMES = ["italic", "oblique"]
#: No page is larger (points); a rectangle beyond it meets others as if it ended there.
LARGEST = 14_400.0

BOX = ["x0", "y0", "x1", "y1"]


def rounded(x: Column) -> Column:
    return F.bround(x, 2)


def box() -> Column:
    """x0, y0, x1, y1 of two decimals, as an array."""
    return F.array(*[rounded(F.col(c)) for c in BOX])


def hex_of(*parts: Column) -> Column:
    return F.concat(F.lit("#"), *[F.lower(F.lpad(F.hex(p), 2, "0")) for p in parts])


def packed_colour(c: Column) -> Column:
    """#rrggbb of a packed integer; null is black."""
    return F.concat(F.lit("#"), F.lower(F.lpad(F.hex(F.coalesce(c.cast("long"), F.lit(0)).bitwiseAND(F.lit(0xFFFFFF))), 6, "0")))


def rgb(parts: Column) -> Column:
    """Red, green and blue (0 to 1) of one gray, three colour or four print components; null for any other number."""
    at = lambda i: F.get(parts, F.lit(i))
    gray, plain = F.array(at(0), at(0), at(0)), F.slice(parts, 1, 3)
    printed = F.array(*[(1 - at(i)) * (1 - at(3)) for i in range(3)])
    return F.when(F.size(parts) == 1, gray).when(F.size(parts) == 4, printed).when(F.size(parts) >= 3, plain)


def fill_colour(parts: Column) -> Column:
    """#rrggbb of a fill's components; black without them."""
    eight = lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.bround(F.coalesce(v, F.lit(0.0)) * 255, 0).cast("int")))
    c = rgb(parts)
    return F.coalesce(F.when(c.isNotNull(), hex_of(*[eight(F.get(c, F.lit(i))) for i in range(3)])), F.lit("#000000"))


def near_white(parts: Column) -> Column:
    """Whether a fill is as good as the page's own white. Two components are judged as they are."""
    c = F.coalesce(rgb(parts), parts)
    return F.coalesce((F.size(c) > 0) & F.forall(F.slice(c, 1, 3), lambda v: v >= NEAR_WHITE), F.lit(False))


def style(flags: Column, font: Column) -> Column:
    """struct(bold, italic), by flag or by the font's name."""
    low = F.lower(F.coalesce(font, F.lit("")))
    says = lambda flag, names: (F.coalesce(flags, F.lit(0)).bitwiseAND(F.lit(flag)) != 0) | F.exists(F.array(*[F.lit(n) for n in names]), lambda n: F.contains(low, n))
    return F.struct(says(BOLD_FLAG, BOLD_NAMES).alias("bold"), says(ITALIC_FLAG, ITALIC_NAMES).alias("italic"))


def gated_fills(fills: DataFrame) -> DataFrame:
    """The fills (x0..y1, colour: array of components, page_width, page_height) that make up a layout: filled, not white, large enough."""
    area = F.greatest(F.col("page_width") * F.col("page_height"), F.lit(1.0))
    fits = F.col("colour").isNotNull() & ~near_white(F.col("colour")) & (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0"))
    return fills.where(fits & ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) / area >= LEAST_SHARE))


def capped(elements: DataFrame, cap: int, kept: Column, name: str, order: list[str] | None = None) -> DataFrame:
    """doc_id, page, ``name`` (array of ``kept`` of the first ``cap`` elements) and whether there were more.

    The ranking keeps cap + 1 rows a page, so Spark cuts each task's rows to as
    many before the shuffle, however many elements a page has.
    """
    rank = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy(*(order or ["ord"])))
    first = elements.withColumn("__rank", rank).where(F.col("__rank") <= cap + 1)
    items = F.transform(F.sort_array(F.collect_list(F.when(F.col("__rank") <= cap, F.struct("__rank", kept.alias("item"))))), lambda x: x["item"])
    return first.groupBy("doc_id", "page").agg(items.alias(name), (F.max("__rank") > cap).alias(f"{name}_cut"))


def page_layouts(pages: DataFrame, spans: DataFrame, images: DataFrame, fills: DataFrame, caps: dict[str, int] | None = None) -> DataFrame:
    """doc_id, page, width, height, spans, images, fills, truncated of every page.

    pages: doc_id, page, page_width, page_height. spans: text, font, size,
    flags, colour (packed) and box; blank ones do not count. images: image,
    width, height, places (array of boxes); an image that comes again on a page
    is placed once. fills: see gated_fills.
    """
    caps = CAPS | (caps or {})
    blank = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", ""))
    look = style(F.col("flags"), F.col("font"))
    span = F.struct(blank.alias("text"), box().alias("box"), F.col("font"), rounded(F.col("size")).alias("size"), look["bold"].alias("bold"), look["italic"].alias("italic"), packed_colour(F.col("colour")).alias("colour"))
    once = images.groupBy("doc_id", "page", "image").agg(F.min_by(F.struct("ord", "width", "height", "places"), "ord").alias("i"))
    placed = once.select("doc_id", "page", "image", "i.*").select("*", F.posexplode("places").alias("place", "at"))
    image = F.struct("image", F.array(*[rounded(F.col("at")[c]) for c in BOX]).alias("box"), "width", "height")
    fill = F.struct(box().alias("box"), fill_colour(F.col("colour")).alias("colour"))
    parts = [capped(spans.where(blank != ""), caps["spans"], span, "spans"), capped(placed, caps["images"], image, "images", ["ord", "place"]), capped(gated_fills(fills), caps["fills"], fill, "fills")]
    joined = reduce(lambda a, b: a.join(b, ["doc_id", "page"], "left"), parts, pages)
    items = lambda n: F.coalesce(F.col(n), F.array())
    cut = reduce(lambda a, b: a | b, [F.coalesce(F.col(f"{n}_cut"), F.lit(False)) for n in CAPS])
    return joined.select("doc_id", "page", rounded(F.col("page_width")).alias("width"), rounded(F.col("page_height")).alias("height"), *[items(n).alias(n) for n in CAPS], cut.alias("truncated"))


def cells(size: float) -> Column:
    """array of struct(cx, cy): the cells of a grid that a rectangle may touch."""
    cell = lambda v: F.floor(F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), v)) / size).cast("int")
    span = lambda a, b: F.sequence(cell(F.least(F.col(a), F.col(b))), cell(F.greatest(F.col(a), F.col(b))))
    return F.flatten(F.transform(span("x0", "x1"), lambda i: F.transform(span("y0", "y1"), lambda j: F.struct(i.alias("cx"), j.alias("cy")))))


def overlaps(left: DataFrame, right: DataFrame, keys: list[str], size: float = 144.0) -> DataFrame:
    """The pairs of rectangles that overlap (not only touch) within equal ``keys``: columns of ``left``, of ``right`` under r_.

    Both sides go to the cells of a grid that they touch, and meet by key and
    cell; a pair counts in the one cell that holds the upper left corner of what
    they share. A crowded page is dealt out by its cells, and no pair is made of
    rectangles that have no cell in common. A rectangle with a null corner meets none.
    """
    whole = lambda df: df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in BOX])).withColumn("__cell", F.explode(cells(size)))
    other = right.withColumnsRenamed({c: f"r_{c}" for c in right.columns})
    r = whole(right).withColumnsRenamed({c: f"r_{c}" for c in right.columns}).withColumnRenamed("__cell", "__r_cell")
    c = F.col
    meet = reduce(lambda a, b: a & b, [c(k) == c(f"r_{k}") for k in keys]) & (c("__cell") == c("__r_cell"))
    apart = (c("x1") <= c("r_x0")) | (c("r_x1") <= c("x0")) | (c("y1") <= c("r_y0")) | (c("r_y1") <= c("y0"))
    held = lambda v: F.floor(F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), v)) / size)
    here = (c("__cell.cx") == held(F.greatest("x0", "r_x0"))) & (c("__cell.cy") == held(F.greatest("y0", "r_y0")))
    return whole(left).join(r, meet & ~apart & here).select(*left.columns, *other.columns)


def image_cover(places: DataFrame, texts: DataFrame) -> DataFrame:
    """doc_id, page, image, overlap (the most text boxes over one of its places), cover (its largest share of the page).

    places: doc_id, page, image, place, box, page_width, page_height. texts: doc_id, page, text, box; blank ones do not count.
    Equal boxes of a page are compared once and counted: pairs are made of different boxes only.
    """
    keys = ["doc_id", "page"]
    boxes = texts.where(F.trim(F.regexp_replace("text", r"^\s+|\s+$", "")) != "").groupBy(*keys, *BOX).agg(F.count(F.lit(1)).alias("n"))
    over = overlaps(places.select(*keys, *BOX).distinct(), boxes, keys).groupBy(*keys, *BOX).agg(F.sum("r_n").alias("n"))
    counts = places.join(over, [*keys, *BOX]).groupBy(*keys, "image", "place").agg(F.sum("n").alias("n")).groupBy(*keys, "image").agg(F.max("n").alias("overlap"))
    size = lambda a, b: F.greatest(F.col(b) - F.col(a), F.lit(0.0))
    page_area = F.col("page_width") * F.col("page_height")
    cover = F.when(page_area != 0, size("x0", "x1") * size("y0", "y1") / page_area).otherwise(0.0)
    every = places.groupBy("doc_id", "page", "image").agg(F.coalesce(F.max(cover), F.lit(0.0)).alias("cover"))
    return every.join(counts, ["doc_id", "page", "image"], "left").select("doc_id", "page", "image", F.coalesce("overlap", F.lit(0)).alias("overlap"), "cover")
