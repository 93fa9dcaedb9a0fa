"""Vector codes: each vector is cut into equal parts, each part becomes the index of the nearest entry of its codebook.

A codebook is learnt for each part position by k-means over integers. Every
round broadcasts one kd-tree a codebook (a fixed number of entries, whatever the
rows) and searches it by branch and bound: a node is left out only if its box is
farther than the best entry found, so nodes of equal bound are visited and a tie
goes to the lower index. Tasks add up the parts of each entry as integers and
return one row an entry and component; Spark sums these, and the driver divides
``parts * entries`` sums. All rows take part in each round and in the last
assignment; nothing is sampled.

Defined cases: vectors that are null, or hold null or non-finite components, are
dropped; so are those whose length is not that of the codebooks (the length of
the first kept vector, by id, that can be cut into equal parts). Components are
held within +-2^26 after scaling, so that no sum of squares leaves 64 bits. Rows
without id are coded, but never start a codebook; repeated rows are coded each;
fewer vectors than entries give as many entries; an entry without parts stays;
an empty table gives no row; null labels are one label; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docfacts.llm.common import stored

PARTS, ENTRIES, ROUNDS = 16, 64, 2
LEAF = 4  # entries of a leaf, at most
MOST = 1 << 26
FEW_LABELS = 100_000


class Node(NamedTuple):
    """The box of its entries, and either two children or the entries (indexes and vectors)."""

    low: np.ndarray
    high: np.ndarray
    near: Node | None
    far: Node | None
    index: np.ndarray
    entries: np.ndarray


def kd_tree(book: np.ndarray, index: np.ndarray | None = None) -> Node:
    """Entries (rows of integers), split at the median of the widest component."""
    index = np.arange(len(book)) if index is None else index
    mine = book[index]
    low, high = mine.min(axis=0), mine.max(axis=0)
    if len(index) <= LEAF or (low == high).all():
        return Node(low, high, None, None, index, mine)
    order = index[np.argsort(mine[:, np.argmax(high - low)], kind="stable")]
    half = len(order) // 2
    return Node(low, high, kd_tree(book, np.sort(order[:half])), kd_tree(book, np.sort(order[half:])), index, mine)


def bound(node: Node, x: np.ndarray) -> np.ndarray:
    """The least squared distance that an entry of the node can have to each row."""
    gap = np.maximum(np.maximum(node.low - x, x - node.high), 0)
    return (gap * gap).sum(axis=1)


def nearest(tree: Node, x: np.ndarray, visits: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest entry to each row of integers; ties to the lower index. visits: [distances computed]."""
    best = np.full(len(x), np.iinfo(np.int64).max)
    index = np.zeros(len(x), np.int64)

    def visit(node: Node, rows: np.ndarray) -> None:
        if node.near is None:
            if visits is not None:
                visits[0] += len(rows) * len(node.index)
            gap = x[rows][:, None, :] - node.entries[None, :, :]
            d = (gap * gap).sum(axis=2)
            at = d.argmin(axis=1)  # the first of equals, and a leaf's entries are in order of index
            least, found = d[np.arange(len(rows)), at], node.index[at]
            wins = (least < best[rows]) | ((least == best[rows]) & (found < index[rows]))
            best[rows[wins]], index[rows[wins]] = least[wins], found[wins]
            return
        a, b = bound(node.near, x[rows]), bound(node.far, x[rows])
        for first, second, mine, others in ((node.near, node.far, a <= b, b), (node.far, node.near, a > b, a)):
            some = rows[mine]
            if len(some):
                visit(first, some)
                left = some[others[mine] <= best[some]]  # an equal bound may hide an equal entry of lower index
                if len(left):
                    visit(second, left)

    if len(x):
        visit(tree, np.arange(len(x)))
    return index, best


def quantised(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256) -> DataFrame:
    """vec_id, label and q, the vectors floor(scale * x); only those that take part."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), v.alias("v"))
    good = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    held = F.transform("v", lambda x: F.greatest(F.least(F.floor(x * F.lit(scale)), F.lit(MOST)), F.lit(-MOST)).cast("long"))
    return rows.where(good).select("vec_id", "label", held.alias("q"))


def blocks(column: pa.Array, rows: int = 4096) -> Iterator[np.ndarray]:
    """The vectors of a column, all of one length, as matrices of bounded height."""
    width = len(column[0]) if len(column) else 0
    flat = np.asarray(column.flatten()).reshape(len(column), width)
    for i in range(0, len(column), rows):
        yield flat[i : i + rows]


def first_books(vectors: DataFrame, parts: int, entries: int) -> np.ndarray | None:
    """parts x entries x width: those of the first vectors by id, at most ``entries`` rows of which come to the driver."""
    able = vectors.where(F.col("vec_id").isNotNull() & (F.size("q") >= parts) & (F.size("q") % parts == 0))
    head = able.orderBy("vec_id", "q").select(F.size("q").alias("n")).first()
    if head is None:
        return None
    rows = able.where(F.size("q") == head["n"]).orderBy("vec_id", "q").limit(entries).select("q").collect()
    first = np.array([r["q"] for r in rows], np.int64)
    return np.stack(np.split(first, parts, axis=1))


def improved(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round over all vectors."""
    parts, entries, width = books.shape
    trees = vectors.sparkSession.sparkContext.broadcast([kd_tree(b) for b in books])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for x in blocks(batch.column(0)):
                for p, tree in enumerate(trees.value):
                    part = x[:, p * width : (p + 1) * width]
                    index, _ = nearest(tree, part)
                    counts[p] += np.bincount(index, minlength=entries)
                    np.add.at(sums[p], index, part)
        p, e = np.nonzero(counts)
        columns = [np.repeat(p, width), np.repeat(e, width), np.tile(np.arange(width), len(p)), sums[p, e].ravel(), np.repeat(counts[p, e], width)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["part", "entry", "at", "total", "n"])

    sums = vectors.select("q").mapInArrow(gather, "part long, entry long, at long, total long, n long")
    out = books.copy()
    for r in sums.groupBy("part", "entry", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():  # parts * entries * width rows at most
        out[r["part"], r["entry"], r["at"]] = r["total"] // r["n"]
    trees.unpersist()
    return out


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def learn(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    books = first_books(vectors, parts, entries)
    for _ in range(rounds if books is not None else 0):
        books = improved(vectors.where(F.size("q") == books.shape[0] * books.shape[2]), books)
    return books


def assign(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (two hex digits a part), error (squared distances summed over the parts)."""
    parts, entries, width = books.shape
    trees = vectors.sparkSession.sparkContext.broadcast([kd_tree(b) for b in books])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = [], []
            for x in blocks(batch.column(2)):
                found = [nearest(tree, x[:, p * width : (p + 1) * width]) for p, tree in enumerate(trees.value)]
                text = np.stack([i for i, _ in found], axis=1).astype(np.uint8).tobytes().hex()
                codes += [text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)]
                errors.append(sum(d for _, d in found))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.string()), pa.array(np.concatenate([*errors, np.zeros(0, np.int64)]))], ["vec_id", "label", "code", "error"])

    kind = vectors.schema["label"].dataType.simpleString()
    return vectors.where(F.size("q") == parts * width).select("vec_id", "label", "q").mapInArrow(code, f"vec_id long, label {kind}, code string, error long")


def decode(codes: DataFrame, books: np.ndarray, scale: int = 256) -> DataFrame:
    """vec_id and the vector that each code stands for."""
    flat = [[(book / scale).tolist() for book in part] for part in books]
    each = F.sequence(F.lit(0), F.lit(len(books) - 1))
    entry = lambda p: F.conv(F.substring(F.col("code"), p * 2 + 1, F.lit(2)), 16, 10).cast("int")
    table = F.array(*[F.array(*[F.array(*[F.lit(float(x)) for x in e]) for e in part]) for part in flat])
    return codes.select("vec_id", F.flatten(F.transform(each, lambda p: F.get(F.get(table, p), entry(p)))).alias("vector"))


def compress(df: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, few_labels: int = FEW_LABELS, salts: int = 32) -> DataFrame:
    """vec_id, label, code, error, label_error (the error of all vectors of that label), codebooks_sha256.

    The errors of labels are pre-aggregated. They are broadcast if they are
    counted to be few; else repeated for ``salts`` salts, so that the rows of a
    hot label meet them in several tasks.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits a part: 1 to 256 entries")
    vectors = quantised(df)
    books = learn(vectors, parts, entries, rounds)
    if books is None:
        kind = vectors.schema["label"].dataType.simpleString()
        return df.sparkSession.createDataFrame([], f"vec_id long, label {kind}, code string, error long, label_error long, codebooks_sha256 string")
    coded = stored(assign(vectors, books), "codes")
    totals = stored(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors").withColumnRenamed("label", "__label")
    same = F.col("label").eqNullSafe(F.col("__label"))
    if totals.count() <= few_labels:
        met = coded.join(F.broadcast(totals), same)
    else:
        spread = totals.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        met = coded.join(spread, same & (F.pmod(F.xxhash64("vec_id", "code"), F.lit(salts)) == F.col("__salt")))
    return met.select("vec_id", "label", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
