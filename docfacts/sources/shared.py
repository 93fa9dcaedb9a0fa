"""Tables in the folder that driver and executors share: they cut long plans, and survive lost executors. Compact tables dealt out to all cores."""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that a cluster names in ``spark.checkpoint.dir``; a temporary one is made for local masters only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("a cluster names the folder that all its machines share in spark.checkpoint.dir")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="docfacts-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read from a Parquet table that was written now: what follows is planned and pruned by itself."""
    path = f"{shared_dir(df.sparkSession)}/docfacts-{name}-{uuid.uuid4().hex[:12]}"
    with compiled(df.sparkSession):
        df.write.option("parquet.enable.dictionary", "false").parquet(path)  # values of documents seldom repeat: dictionaries are begun, filled and given up
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def compiled(spark: SparkSession) -> Iterator[None]:
    """While it lasts, the session fuses no projections to a method that the JVM does not compile (beyond 8000 bytes it interprets it for every row)."""
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), 8000)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def spread(df: DataFrame, *keys: str, least: int = 2_000, most: int = 50_000) -> DataFrame:
    """A compact table of dear rows, dealt by ``keys`` to as many tasks as the rows keep busy.

    A scan is split by bytes: some megabytes of short rows, each of which becomes
    a document, are the work of one task. Tasks get ``most`` rows, or fewer down
    to ``least`` while there are cores to use. The rows are counted before, by the
    tables' footers.
    """
    spark, rows = df.sparkSession, df.count()
    cores = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(max(1, min(math.ceil(rows / least), cores), math.ceil(rows / most)), *keys)
