"""JSON scans, lookups as left joins, keyed caches with a time to live, idempotent preservation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A lookup table of at most so many rows is broadcast; beyond it the join shuffles.
FEW_ROWS = 1_000_000


def read_json(spark: SparkSession, path: str, schema: StructType | str, one_per_file: bool = True) -> DataFrame:
    """Records from JSON files under a given schema; a file that is none gives a row of nulls but its ``_corrupt``."""
    kind = schema if isinstance(schema, str) else schema.simpleString().removeprefix("struct<").removesuffix(">")
    return spark.read.schema(f"{kind}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").option("multiLine", one_per_file).option("recursiveFileLookup", True).json(path)


def read_texts(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """path and pages of the text files that a glob names; pages are parted by form feeds."""
    raw = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", True).option("wholetext", True).text(path)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.split("value", "\f").alias("pages"))


def looked_up(df: DataFrame, table: DataFrame, on: str, columns: list[str], normal=lambda c: c) -> DataFrame:
    """``df`` with columns of the first row (by those columns' order) that has its key; without one they are null. A null key finds nothing."""
    keyed = table.select(normal(F.col(on)).alias("__key"), F.struct(*columns).alias("__row")).where("__key IS NOT NULL").groupBy("__key").agg(F.min("__row").alias("__row"))
    side = F.broadcast(keyed) if keyed.count() <= FEW_ROWS else keyed
    joined = df.withColumn("__key", normal(F.col(on))).join(side, "__key", "left")
    return joined.select(*df.columns, *[F.col(f"__row.`{c}`").alias(c) for c in columns])


def fresh(cache: DataFrame, now: Column, seconds: int | None, key: str = "key", fetched: str = "fetched") -> DataFrame:
    """The newest entry of each key that is not older than ``seconds`` (None: no limit)."""
    live = cache if seconds is None else cache.where(F.unix_timestamp(now) - F.unix_timestamp(F.col(fetched)) <= seconds)
    rest = [c for c in cache.columns if c not in (key, fetched)]
    newest = live.groupBy(key).agg(F.max(F.struct(fetched, *rest)).alias("__row"))
    return newest.select(key, *[F.col(f"__row.`{c}`").alias(c) for c in (fetched, *rest)])


def preserved(items: DataFrame, content: str, kept: DataFrame, id_col: str) -> DataFrame:
    """The rows to append so that every content is kept once: sha256, size, first_id of contents that ``kept`` (sha256) has not."""
    data = F.col(content).cast("binary")
    hashed = items.where(F.col(content).isNotNull()).select(F.sha2(data, 256).alias("sha256"), F.octet_length(data).cast("long").alias("size"), F.col(id_col).alias("__id"))
    new = hashed.groupBy("sha256").agg(F.max("size").alias("size"), F.min("__id").alias("first_id"))
    return new.join(kept.select("sha256").distinct(), "sha256", "left_anti")
