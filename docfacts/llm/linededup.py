"""Line dedup by site-relative frequency, in DataFrame functions only.

Per host, the share of pages that contain a line; lines whose share exceeds the
boilerplate ratio are dropped from that host's pages.

Pages with equal texts count once, and a page counts a line once. The counts are
pre-aggregated before their shuffle (hosts and lines as hot as a third of all
pages meet as one partial sum a task). Only hashes of lines are exploded and
shuffled; each page then gets its host's list of lines to drop, and the text is
rebuilt by one higher-order filter.

Defined cases: a null or blank text stays as it is; blank lines are never
counted nor dropped; lines are compared without leading and trailing ASCII
white space; a null host is a host of its own; a host of fewer than ``min_pages``
pages keeps all lines, and so does a line on fewer pages; repeated rows are
cleaned each; an empty table gives an empty table; other columns pass through
unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfacts.llm.common import stored

RATIO = 0.05
MIN_PAGES = 5


def host_of(url: Column) -> Column:
    """The host of a URL, lower-case; null if there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))


def line_key(line: Column) -> Column:
    """96 bits of a trimmed line, null for a blank one: clean and boilerplate lines of one host do not collide in practice."""
    plain = F.regexp_replace(line, r"^[\t\x0B\f\r ]+|[\t\x0B\f\r ]+$", "")
    return F.when(plain == "", F.lit(None)).otherwise(F.struct(F.xxhash64(plain).alias("a"), F.hash(plain).alias("b")))


def boilerplate(df: DataFrame, host: Column, text: Column, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """host and keys: the lines to drop, by host. A host has at most (lines a page) / ratio of them."""
    base = df.select(host.alias("host"), F.coalesce(text, F.lit("")).alias("text"))
    keys = F.array_distinct(F.filter(F.transform(F.split("text", "\n"), line_key), lambda k: k.isNotNull()))
    lines = base.select("host", F.xxhash64("text").alias("page"), F.explode(keys).alias("key"))
    n = lines.distinct().groupBy("host", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    pages = base.select(F.col("host").alias("h"), F.xxhash64("text").alias("page")).distinct().groupBy("h").agg(F.count(F.lit(1)).alias("pages"))
    often = n.join(pages, F.col("host").eqNullSafe(F.col("h"))).where(F.col("n") > ratio * F.col("pages"))
    return often.groupBy("host").agg(F.collect_list("key").alias("keys"))


def drop_lines(df: DataFrame, host: Column, text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, broadcast_lines: int = 100_000, salts: int = 32, facts: str = "line_dedup") -> DataFrame:
    """The table with its text rebuilt, and ``n_lines`` and ``n_dropped`` in a struct ``facts`` (instead of a column of that name).

    The lines to drop are broadcast where they were counted to be few;
    otherwise each host's list is repeated for ``salts`` salts, and the pages
    meet it by host and salt, so that a hot host is spread.
    """
    drop = stored(boilerplate(df, host, F.col(text_col), ratio, min_pages), "lines").select(F.col("host").alias("of"), "keys")
    few = (drop.agg(F.sum(F.size("keys"))).first()[0] or 0) <= broadcast_lines
    # the row as one column: no name of its own meets one of ours
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), host.alias("host"), F.col(text_col).alias("text"))
    if few:
        met = rows.join(F.broadcast(drop), F.col("host").eqNullSafe(F.col("of")), "left")
    else:
        spread = drop.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        met = rows.join(spread, F.col("host").eqNullSafe(F.col("of")) & (F.pmod(F.xxhash64("text"), F.lit(salts)) == F.col("salt")), "left")
    lines = F.split("text", "\n")
    kept = F.filter(lines, lambda x: ~F.coalesce(F.array_contains(F.col("keys"), line_key(x)), F.lit(False)))
    as_it_is = F.col("keys").isNull() | F.col("text").isNull()
    rebuilt = F.when(as_it_is, F.col("text")).otherwise(F.array_join(kept, "\n"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines))
    n_kept = F.when(as_it_is, n_lines).otherwise(F.size(kept))
    columns = [(rebuilt if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in df.columns if c != facts]
    return met.select(*columns, F.struct(n_lines.cast("long").alias("n_lines"), (n_lines - n_kept).cast("long").alias("n_dropped")).alias(facts))
