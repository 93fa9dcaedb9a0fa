"""Filter interaction audit: what each of a set of filters removes in every order, alone, after others and for nothing else.

Filters are named conditions that a document fails or not. Each task packs the
failures, the labels and the parts of its rows into bitsets, one run of bytes a
part, and for every subset of filters takes the survivors (AND-NOT) and counts
them (popcount). Tasks return 2^filters counts a part, Spark sums them, and all
orders follow from the sums: after a prefix of an order remain the survivors of
its set of filters. Texts are read once and never shuffled; a duplicate is found
by the smallest id of its digest, pre-aggregated before its shuffle, and the
join that brings it back is by id, so that a text on a third of all rows meets
in no task.

Defined cases: a null text is empty; a null or empty part is the empty part; a
row without id is nobody's smaller copy and fails no duplicate filter, and has
no labels; rows of one id and text are each other's equals, not copies; of
several label rows of an id each one counts that says so; an empty table gives
no row; other columns are ignored.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfacts.llm.common import stored

#: What separates words.
SPACE = r"[\x20\x09-\x0D]+"


def standard_filters(text: Column) -> dict[str, Column]:
    """The failure conditions of texts: few words, few different words, capitals, signs."""
    words = F.array_remove(F.split(text, SPACE), "")
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": F.size(words) < 50,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 65,
        "C": capitals * 100 > F.length(text) * 5,
        "D": F.regexp_like(text, F.lit(r"[#$%&*|]")),
    }


def failures(docs: DataFrame, labels: DataFrame, filters: dict[str, Column] | None = None, duplicates: str | None = "E", id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, fails (bit i: the i-th filter by name), good, toxic of each document.

    ``filters``: conditions over the column ``text``. ``duplicates`` names the
    filter that a document fails if a smaller id has the same text, or is None.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    tests = standard_filters(F.col("text")) if filters is None else filters
    names = sorted([*tests, *([duplicates] if duplicates else [])])
    bits = sum((F.when(test, 1 << names.index(name)).otherwise(0) for name, test in tests.items()), F.lit(0))
    facts = stored(base.select("doc_id", "part", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), bits.cast("int").alias("fails")), "filter-facts")
    said = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marks = said.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    named = facts.where("doc_id IS NOT NULL").join(marks, "doc_id", "left")
    if duplicates:
        firsts = facts.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
        copy = F.when(F.col("first").isNull(), 1 << names.index(duplicates)).otherwise(0)
        named = named.join(firsts, ["doc_id", "digest"], "left").withColumn("fails", F.col("fails") + copy)
    nameless = facts.where("doc_id IS NULL").select("part", "fails", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    return named.select("part", "fails", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")).unionByName(nameless)


def survivors(parts: np.ndarray, fails: np.ndarray, marks: list[np.ndarray], n_filters: int) -> tuple[np.ndarray, np.ndarray]:
    """The parts of a batch, and by part, mark (none, then each of ``marks``) and subset of filters how many rows survive it."""
    order = np.argsort(parts, kind="stable")
    found, starts, sizes = np.unique(parts[order], return_index=True, return_counts=True)
    room = (sizes + 7) // 8 * 8  # every part begins at a byte of its own
    begin = np.concatenate(([0], np.cumsum(room)[:-1]))
    at = np.repeat(begin - starts, sizes) + np.arange(len(order))

    def packed(flags: np.ndarray) -> np.ndarray:
        out = np.zeros(int(room.sum()), bool)
        out[at] = flags[order]
        return np.packbits(out)

    here = packed(np.ones(len(order), bool))
    wanted = [here, *[packed(m != 0) for m in marks]]
    failing = [packed((fails >> i & 1) != 0) for i in range(n_filters)]
    counts = np.zeros((len(found), len(wanted), 1 << n_filters), np.int64)
    gone = [np.zeros_like(here)] * (1 << n_filters)
    for subset in range(1 << n_filters):
        if subset:
            low = (subset & -subset).bit_length() - 1
            gone[subset] = gone[subset & (subset - 1)] | failing[low]
        for m, want in enumerate(wanted):
            left = np.bitwise_count(want & ~gone[subset]).astype(np.int64)
            counts[:, m, subset] = np.add.reduceat(left, begin // 8)
    return found, counts


def subset_counts(rows: DataFrame, n_filters: int) -> DataFrame:
    """part, and arrays kept, good, toxic: by subset of filters (its bits) how many rows survive it."""
    kind = "part string, kept array<long>, good array<long>, toxic array<long>"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                coded = batch.column(0).dictionary_encode()
                found, counts = survivors(np.asarray(coded.indices), np.asarray(batch.column(1)), [np.asarray(batch.column(i)) for i in (2, 3)], n_filters)
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(counts[:, m, :].ravel()), 1 << n_filters).cast(pa.list_(pa.int64())) for m in range(3)]
                yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(found)), *lists], ["part", "kept", "good", "toxic"])

    partial = rows.select("part", "fails", "good", "toxic").mapInArrow(count, kind)
    sums = [F.array(*[F.sum(F.get(c, F.lit(i))) for i in range(1 << n_filters)]).alias(c) for c in ("kept", "good", "toxic")]
    return partial.groupBy("part").agg(*sums)


def audit(counts: DataFrame, names: list[str]) -> DataFrame:
    """One row a part, order of the filters and step."""
    n = len(names)
    bit = {name: 1 << i for i, name in enumerate(names)}
    full = (1 << n) - 1
    steps = [{"filter_order": "".join(order), "step": i + 1, "f": names.index(name), "own": bit[name], "before": sum(bit[x] for x in order[:i])} for order in permutations(names) for i, name in enumerate(order)]
    every = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,f:int,own:int,before:int>>")
    at = lambda c, subset: F.get(F.col(c), subset)
    # over all orders, a filter meets each set of others before it |S|! * (n - 1 - |S|)! times
    shapley = {name: sum((F.lit(math.factorial(s.bit_count()) * math.factorial(n - 1 - s.bit_count())) * (at("kept", F.lit(s)) - at("kept", F.lit(s | b))) for s in range(full + 1) if not s & b), F.lit(0)) for name, b in bit.items()}
    rows = counts.withColumn("shapleys", F.array(*[shapley[name] for name in names])).withColumn("s", F.explode(every)).select("*", "s.*").drop("s")
    own, before = F.col("own"), F.col("before")
    after = before.bitwiseOR(own)
    removed = at("kept", before) - at("kept", after)
    failing = at("kept", F.lit(0)) - at("kept", own)
    return rows.select(
        "part", "filter_order", "step", at("kept", after).alias("kept"), removed.alias("removed"), (failing - removed).alias("redundant"), (at("kept", F.lit(full) - own) - at("kept", F.lit(full))).alias("unique_fails"),
        (at("good", before) - at("good", after)).alias("good_lost"), (at("toxic", before) - at("toxic", after)).alias("toxic_lost"), F.get("shapleys", F.col("f")).alias("shapley"),
    )


def filter_interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five standard filters (A to D of texts, E of copies), by source."""
    return audit(subset_counts(failures(docs, labels), 5), list("ABCDE"))
