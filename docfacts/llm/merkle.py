"""Document fingerprints: Merkle trees over sections, paragraphs and parts.

A paragraph is a line; its parts are its sentences, long ones cut after words
chosen by their hash. A section ends at a blank line or after a paragraph whose
digest begins with 0 to 31, so that an edit moves no boundary but near itself.
Each node's digest covers its children's, the leaves' the text itself with all
its white space: equal roots mean equal texts. Where roots differ, only
differing branches are followed, down to the parts that were edited.

Likeness of two trees: twice the code points in parts that both have (each as
often as both have it), over the code points of both; 1 for two empty texts.

Comparing each document with its successor takes one shuffle of the texts, by
ranges of ids: within a range rows are read in order, one at a time, and the
first rows of each range are also sent to the range before it.

Defined cases: a null text is empty; rows without id come first; rows with
the same id follow each other in the order of their texts; the only document is
its own successor; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docfacts.llm.common import tidy, with_text

SENTENCE = re.compile(r"[^.!?]*[.!?]+\s*|[^.!?]+").findall
WORD = re.compile(r"\s*\S+\s*").findall
LONG_PART = 160
FIRST = -(1 << 63)


def digest(kind: bytes, data: bytes) -> bytes:
    return blake2b(data, digest_size=16, person=kind).digest()


@dataclass(slots=True)
class Node:
    digest: bytes
    start: int
    end: int
    children: list[Node]


def parts(paragraph: str) -> list[str]:
    out = []
    for s in SENTENCE(paragraph):
        if len(s) <= LONG_PART:
            out.append(s)
            continue
        at, pos = 0, 0
        for w in WORD(s):
            pos += len(w)
            if zlib.crc32(w.strip().encode("utf-8", "surrogatepass")) % 6 == 0:
                out.append(s[at:pos])
                at = pos
        if at < len(s):
            out.append(s[at:])
    return out


def tree(text: str) -> Node:
    """The root; its children are sections, theirs paragraphs, theirs parts."""
    sections: list[Node] = []
    held: list[Node] = []
    at = 0

    def close() -> None:
        sections.append(Node(digest(b"section", b"".join(p.digest for p in held)), held[0].start, held[-1].end, list(held)))
        held.clear()

    lines = text.split("\n") if text else []
    for i, line in enumerate(lines):
        whole = line + "\n" if i < len(lines) - 1 else line
        leaves, pos = [], at
        for p in parts(whole):
            leaves.append(Node(digest(b"part", p.encode("utf-8", "surrogatepass")), pos, pos + len(p), []))
            pos += len(p)
        held.append(Node(digest(b"paragraph", b"".join(p.digest for p in leaves)), at, pos, leaves))
        at = pos
        if not line.strip() or held[-1].digest[0] < 32:
            close()
    if held:
        close()
    return Node(digest(b"root", b"".join(s.digest for s in sections)), 0, at, sections)


def leaf_sizes(root: Node) -> Counter:
    out: Counter = Counter()
    for s in root.children:
        for p in s.children:
            for leaf in p.children:
                out[leaf.digest] += leaf.end - leaf.start
    return out


def likeness(a: Node, b: Node, la: Counter | None = None, lb: Counter | None = None) -> float:
    if a.digest == b.digest:
        return 1.0
    la, lb = la or leaf_sizes(a), lb or leaf_sizes(b)
    if len(la) > len(lb):
        la, lb = lb, la
    both = sum(min(n, lb[d]) for d, n in la.items() if d in lb)
    return 2.0 * both / (a.end + b.end)


def edits(old: Node, new: Node) -> list[tuple[int, int]]:
    """Spans of the new text that lie in no branch of the old one, found by following differing branches only."""
    if old.digest == new.digest:
        return []
    old_level, new_level, spans = [old], [new], []
    for _ in range(3):
        old_level = [c for n in old_level for c in n.children]
        spare = Counter(n.digest for n in old_level)
        differing = []
        for n in (c for n in new_level for c in n.children):
            if spare[n.digest]:
                spare[n.digest] -= 1
            else:
                differing.append(n)
        matched = Counter(n.digest for n in old_level) - spare
        rest = []
        for n in old_level:  # branches that the new tree also has need no second look
            if matched[n.digest]:
                matched[n.digest] -= 1
            else:
                rest.append(n)
        old_level, new_level = rest, differing
    for n in new_level:
        if spans and spans[-1][1] == n.start:
            spans[-1] = (spans[-1][0], n.end)
        else:
            spans.append((n.start, n.end))
    return spans


NODE = "struct<digest:string,start:long,end:long"
TREES = f"doc_id long, root string, n_chars long, sections array<{NODE},paragraphs:array<{NODE},parts:array<{NODE}>>>>>>"


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The whole tree of every document."""

    def named(n: Node, names: tuple[str, ...]) -> dict:
        out = {"digest": n.digest.hex(), "start": n.start, "end": n.end}
        return out | {names[0]: [named(c, names[1:]) for c in n.children]} if names else out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                rows = batch.slice(i, 256).to_pylist()
                trees = [tree(r["text"]) for r in rows]
                leaf = [("digest", pa.string()), ("start", pa.int64()), ("end", pa.int64())]
                kind = pa.list_(pa.struct([*leaf, ("paragraphs", pa.list_(pa.struct([*leaf, ("parts", pa.list_(pa.struct(leaf)))])))]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["doc_id"] for r in rows], pa.int64()), pa.array([t.digest.hex() for t in trees]), pa.array([t.end for t in trees], pa.int64()), pa.array([[named(s, ("paragraphs", "parts")) for s in t.children] for t in trees], kind)],
                    ["doc_id", "root", "n_chars", "sections"],
                )

    return with_text(df, id_col, text_col).mapInArrow(tidy(run), TREES)


COMPARED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edit_spans array<struct<start:long,end:long>>"


def compare_with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = 4) -> DataFrame:
    """Each document against its edited text (its last 1/share replaced by the head of its successor) and against its successor."""
    spark = df.sparkSession
    docs = with_text(df, id_col, text_col).withColumn("place", F.coalesce("doc_id", F.lit(FIRST)))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = 4 * partitions
    cuts = docs.select("place").approxQuantile("place", [i / ranges for i in range(1, ranges)], 0.25 / ranges)
    edges = np.unique(np.array([min(max(c, -9.2e18), 9.2e18) for c in cuts]).astype(np.int64))

    def ranged(places: np.ndarray) -> np.ndarray:
        return np.searchsorted(edges, places, side="right")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.asarray(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(ranged(place).astype(np.int64)), batch.column(0)], ["range", "place"])

    firsts = {r["range"]: r["place"] for r in docs.select("place").mapInArrow(tidy(number), "range long, place long").groupBy("range").agg(F.min("place").alias("place")).collect()}
    full = sorted(firsts)
    before = {firsts[r]: full[i - 1] for i, r in enumerate(full)}  # also of the first: the last

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["range", "tail", "place", "doc_id", "text"]
        for batch in batches:
            place = np.asarray(batch.column(2))
            n = len(place)
            yield pa.RecordBatch.from_arrays([pa.array(ranged(place).astype(np.int64)), pa.array(np.zeros(n, np.int32)), batch.column(2), batch.column(0), batch.column(1)], names)
            tails = [i for i, p in enumerate(place.tolist()) if p in before]
            if tails:
                b = batch.take(pa.array(tails))
                yield pa.RecordBatch.from_arrays([pa.array([before[p] for p in b.column(2).to_pylist()], pa.int64()), pa.array([1] * len(tails), pa.int32()), b.column(2), b.column(0), b.column(1)], names)

    dealt = docs.mapInArrow(tidy(deal), "range long, tail int, place long, doc_id long, text string").repartition(partitions, "range").sortWithinPartitions("range", "tail", "place", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "edit_spans"]
        last, out = None, []
        for batch in batches:
            for r, tail, doc_id, text in zip(*(batch.column(c) for c in (0, 1, 3, 4)), strict=True):
                r, tail, doc_id, text = r.as_py(), tail.as_py(), doc_id.as_py(), text.as_py()
                if last and last[0] == r and last[1] and tail:
                    continue  # only the first of equal ids is the successor
                root = tree(text)
                now = (r, tail, doc_id, text, root, leaf_sizes(root))
                if last and last[0] == r:
                    _, _, old_id, old, old_root, old_leaves = last
                    m = len(old) // share
                    edited = old[: len(old) - m] + text[:m]
                    new_root = tree(edited)
                    spans = [{"start": a, "end": b} for a, b in edits(old_root, new_root)]
                    out.append((old_id, len(old), sha256(edited.encode("utf-8")).hexdigest(), old_root.digest.hex(), new_root.digest.hex(), likeness(old_root, new_root, old_leaves), likeness(old_root, root, old_leaves, now[5]), spans))
                last = now
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                out = []

    return dealt.mapInArrow(tidy(run), COMPARED)
