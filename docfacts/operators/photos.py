"""Photos by stored figures: first occurrences, gates, recovery, quality, numbering, manifests, and content-addressed keys.

Pixels are decoded elsewhere; the tables here hold what was measured: one row an
image object and page (doc_id, page, ord, image, width, height, entropy, edges,
overlap), and of those that went through the overlay pass masked, continuity and
smear.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Gates of photos, text boxes that tell a clean stream, pages searched, weights of the quality and its gate.
LEAST_WIDTH, LEAST_HEIGHT, LEAST_ASPECT, MOST_ASPECT = 400, 300, 0.30, 4.0
LEAST_ENTROPY, LEAST_EDGES = 3.0, 0.02
CLEAN_OVERLAP, MOST_PAGES = 3, 60
QUALITY_WEIGHTS, LEAST_QUALITY, MOST_MASKED = (0.4, 0.3, 0.3), 0.55, 0.15


def cache_key(*parts: Column) -> Column:
    """The content-addressed key of parts: their joined text's SHA-256."""
    return F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary"), 256)


def entropy(bins: DataFrame, by: list[str], bin_col: str) -> DataFrame:
    """``by``, entropy (bits) of the histogram of ``bin_col``; counts are pre-aggregated, nulls are no bin."""
    counts = bins.where(F.col(bin_col).isNotNull()).groupBy(*by, bin_col).agg(F.count(F.lit(1)).cast("double").alias("n"))
    # -sum(p log p) = log N - sum(n log n) / N
    return counts.groupBy(*by).agg((F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("entropy"))


def first_occurrences(images: DataFrame, most_pages: int = MOST_PAGES) -> DataFrame:
    """One row an image object of a document: its first on the pages searched."""
    rest = [c for c in images.columns if c not in ("doc_id", "image")]
    first = images.where(F.col("page") <= most_pages).groupBy("doc_id", "image").agg(F.min_by(F.struct(*rest), F.struct("page", "ord")).alias("f"))
    return first.select("doc_id", "image", *[F.col(f"f.`{c}`").alias(c) for c in rest])


def recovery(images: DataFrame) -> DataFrame:
    """``images`` with photo (whether it passes the gates) and method: raw_extract under text boxes, needs_overlay_pass without, else skip."""
    aspect = F.try_divide(F.col("width").cast("double"), F.col("height"))
    photo = (F.col("width") >= LEAST_WIDTH) & (F.col("height") >= LEAST_HEIGHT) & aspect.between(LEAST_ASPECT, MOST_ASPECT) & (F.col("entropy") >= LEAST_ENTROPY) & (F.col("edges") >= LEAST_EDGES)
    df = images.withColumn("photo", F.coalesce(photo, F.lit(False)))
    return df.withColumn("method", F.when(~F.col("photo"), "skip").when(F.col("overlap") >= CLEAN_OVERLAP, "raw_extract").otherwise("needs_overlay_pass"))


def quality(masked: Column, continuity: Column, smear: Column, most_masked: float = MOST_MASKED) -> Column:
    """struct(score, passed, reason) of a rebuilt image by its masked share, the continuity of edges and the penalty-free smear term."""
    a, b, c = QUALITY_WEIGHTS
    score = F.bround(a * (1 - masked) + b * continuity + c * smear, 4)
    made = lambda s, ok, why: F.struct(s.cast("double").alias("score"), ok.alias("passed"), F.lit(why).alias("reason") if isinstance(why, str) else why.alias("reason"))
    good = score >= LEAST_QUALITY
    return F.when(masked > most_masked, made(F.lit(0.0), F.lit(False), "too much masked")).when(masked == 0, made(F.lit(1.0), F.lit(True), "nothing masked")).otherwise(made(score, good, F.when(good, "ok").otherwise("low quality")))


def numbered(images: DataFrame, prefix: str = "exterior") -> DataFrame:
    """The photos of ``recovery`` with score, masked, passed, reason, and number and file_name of those that survive, in page order."""
    q = F.when(F.col("method") == "raw_extract", F.struct(F.lit(1.0).alias("score"), F.lit(True).alias("passed"), F.lit("ok").alias("reason"))).otherwise(quality(F.col("masked"), F.col("continuity"), F.col("smear")))
    df = images.where("photo").withColumn("q", q).withColumns({"score": F.col("q.score"), "passed": F.col("q.passed"), "reason": F.col("q.reason"), "masked": F.when(F.col("method") == "raw_extract", 0.0).otherwise(F.bround("masked", 4))}).drop("q")
    running = Window.partitionBy("doc_id").orderBy("page", "ord").rowsBetween(Window.unboundedPreceding, 0)
    number = F.when(F.col("passed"), F.count_if(F.col("passed")).over(running).cast("int"))
    return df.withColumn("number", number).withColumn("file_name", F.when(F.col("passed"), F.concat(F.lit(f"{prefix}-"), F.lpad(F.col("number").cast("string"), F.greatest(F.lit(2), F.length(F.col("number").cast("string"))), F.lit("0")), F.lit(".jpg"))))


def manifests(docs: DataFrame, photos: DataFrame) -> DataFrame:
    """doc_id, manifest: asset_id, source_pdf, photos in their order, and the failures of the overlay pass; also of documents without photos.

    docs: doc_id, path. photos: see numbered; a document has few, so its list is one row.
    """
    photo = F.struct(
        F.col("file_name").alias("filename"), F.when(F.col("method") == "raw_extract", "raw_extract").otherwise("inpainted").alias("method"), F.col("score").alias("quality_score"),
        F.col("masked").alias("overlay_removed_pct"), F.lit("verified").alias("verification_status"),
    )
    failure = F.struct("image", "page", F.lit("reconstruct").alias("pass"), "reason", F.col("masked").alias("overlay_removed_pct"))
    ordered = lambda test, item: F.transform(F.sort_array(F.collect_list(F.when(test, F.struct("page", "ord", item.alias("item"))))), lambda x: x["item"])
    lists = photos.groupBy("doc_id").agg(ordered(F.col("passed"), photo).alias("photos"), ordered(~F.col("passed"), failure).alias("failures"))
    stem = F.regexp_extract(F.coalesce("path", F.lit("")), r"([^/]*?)(?:\.[^./]*)?$", 1)
    met = docs.select("doc_id", "path").join(lists, "doc_id", "left")
    return met.select("doc_id", F.struct(stem.alias("asset_id"), F.col("path").alias("source_pdf"), F.coalesce("photos", F.array()).alias("photos"), F.coalesce("failures", F.array()).alias("pass_failures")).alias("manifest"))
