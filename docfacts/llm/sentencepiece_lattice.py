"""SentencePiece encoding and decoding over a relational lattice of pieces.

Texts are cut into words wherever no piece can reach across: between characters
that are neighbours in no piece, so the best paths of the words make up that of
the text, and most words are met again in other texts. A task cuts
its documents into slices of bounded size and numbers the distinct words of
each; the documents of a slice travel as packed numbers, its words as rows. Over
the distinct words of the whole table Spark explodes all substrings up to the
longest piece, joins them to the piece table by equality (a vocabulary is of
fixed size, so it is broadcast), groups the edges found by word and folds
Viterbi with a higher-order ``aggregate`` over the edges in order of their ends:
the path with the greatest sum of the scores that the model gives its pieces.
Where two paths to one place have equal sums, the one with the shorter last
piece is taken. A character that is no piece costs 10 more than the worst piece,
as unigram models have it, and becomes byte pieces. The state of the fold is a
score and a back pointer an end, in runs that hold the last ends that a piece can
reach back to; the path is read off once, from the end. The ids of a slice's words go back
to it packed, and its documents are put together there, a block of words at a time.

Shuffled are the packed slices, their distinct words (by a hash of the word;
words are compared whole) and the words' ids; the edges are not, as they stay
with the hash of their word. A word comes once a slice, so none is hot.

``rule="bpe"`` applies a BPE model's own rule instead: merge the neighbours whose
union is the best piece, leftmost first. It is the default for BPE models, for
which it gives their library's ids; ``rule="viterbi"`` takes the greatest sum of
such a model's scores (ranks) too, which is another optimum. The query uses Viterbi.

Defined cases: null or empty text has no ids and decodes to an empty text;
repeated rows are encoded each; an empty table gives an empty table; other
columns are ignored. Without byte pieces an unknown character is the unknown id. In
decoding, null ids and ids of no piece give U+2047, control ids nothing, and bytes that are no UTF-8 U+FFFD.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfacts.llm.common import release_memory, tidy, with_text
from docfacts.llm.packing import slices

MARK = "▁"
WORDS = f"{MARK}*[^{MARK}\\n]+|{MARK}+|\\n"
UNKNOWN_PENALTY = 10.0
SLICE = 16 << 20  # bytes of text, but for single longer documents
BLOCK = 64  # characters of a word that are exploded together
RUN = 128  # edges that are folded together
WIDE, LONGEST = 1 << 25, 64  # an edge in one long: (end * LONGEST + length) * WIDE + id, unknown characters WIDE / 2 + code point
RUN_IDS = 200_000  # ids that are decoded, or words that are put in place, together, but for single longer documents
CUT = 1 << 20  # characters of a text that are cut together
KINDS = 2047  # kinds of characters that cuts tell apart: those of larger vocabularies share kinds, which only leaves cuts out
FINER = 8  # partitions of words to one of the session: edges take many times the room of their words, and are sorted in memory
SLICES = "slice long, doc_ids array<long>, sizes array<int>, digests array<string>, numbers array<binary>, words binary"
BACK = "slice long, number binary, size binary, ids binary"


class Pieces(NamedTuple):
    rows: list[tuple[int, str, float]]  # id, piece, score of the ordinary pieces
    bytes: list[int]  # ids of the 256 byte pieces, or none
    unknown: int
    longest: int
    unigram: bool
    control: tuple[int, ...] = ()


def load(path: str) -> Pieces:
    """The piece table of a model file. Its pieces may have word marks only in front."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    rows = [(i, sp.id_to_piece(i), sp.get_score(i)) for i in plain]
    if any("\n" in p or MARK in p.lstrip(MARK) for _, p, _ in rows):
        raise ValueError("pieces that span words are not supported")
    of_byte = {sp.id_to_piece(i): i for i in range(sp.vocab_size()) if sp.is_byte(i)}
    control = tuple(i for i in range(sp.vocab_size()) if sp.is_control(i))
    unigram = any(score != int(score) for _, _, score in rows)  # BPE models score pieces by whole ranks
    return Pieces(rows, [of_byte[f"<0x{b:02X}>"] for b in range(256)] if of_byte else [], sp.unk_id(), max(len(p) for _, p, _ in rows), unigram, control)


def words_of(text: str) -> list[str]:
    return re.findall(WORDS, MARK + text.replace(" ", MARK)) if text else []


class Cutter:
    """Cuts texts between characters that are neighbours in no piece, so at every line's end and before every word mark that follows another character."""

    def __init__(self, pairs: list[str]):
        known = sorted({c for p in pairs for c in p})
        self.kind, self.kinds = np.zeros(0x110000, np.int32), min(len(known), KINDS) + 1
        self.kind[[ord(c) for c in known]] = np.arange(len(known)) % KINDS + 1
        self.joined = np.zeros(self.kinds**2, bool)
        for a, b in pairs:
            self.joined[self.kind[ord(a)] * self.kinds + self.kind[ord(b)]] = True

    def words(self, text: str) -> list[str]:
        if not text:
            return []
        text, ends = MARK + text.replace(" ", MARK), [0]
        for i in range(0, len(text), CUT):  # with the next character
            kind = self.kind[np.frombuffer(text[i : i + CUT + 1].encode("utf-32-le"), np.uint32)]
            ends += (np.flatnonzero(~self.joined[kind[:-1] * self.kinds + kind[1:]]) + (i + 1)).tolist()
        return [text[a:b] for a, b in zip(ends, [*ends[1:], len(text)], strict=True)]


class Numbers(dict):
    """Numbers words in the order in which they are asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


class Merger:
    """The rule of BPE models, word by word."""

    def __init__(self, pieces: Pieces):
        self.known = {p: (i, s) for i, p, s in pieces.rows}

    def merged(self, word: str) -> list[int]:
        """The final pieces by the rule of BPE models, with a heap of possible merges."""
        known = self.known
        part, after, before = list(word), list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < len(word):
                both = part[i] + part[after[i]]
                if both in known:
                    heapq.heappush(heap, (-known[both][1], i, both))

        for i in range(len(word) - 1):
            offer(i)
        while heap:
            _, i, both = heapq.heappop(heap)
            if part[i] is None or after[i] >= len(word) or part[i] + part[after[i]] != both:
                continue
            j = after[i]
            part[i], part[j], after[i] = both, None, after[j]
            if after[j] < len(word):
                before[after[j]] = i
            offer(i)
            offer(before[i])
        return [known[p][0] if p in known else -1 - ord(p) for p in part if p is not None]


def squeezed(x: np.ndarray) -> bytes:
    """Integers under 2^31, compressed byte plane by byte plane."""
    planes = np.ascontiguousarray(x.astype("<i4").view(np.uint8).reshape(-1, 4).T)
    return len(x).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def loosened(packed: bytes) -> np.ndarray:
    n = int.from_bytes(packed[:8], "little")
    planes = np.frombuffer(pa.decompress(packed[8:], 4 * n, codec="zstd", asbytes=True), np.uint8) if n else np.zeros(0, np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<i4").ravel()


def sliced(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """One row a slice of documents: ids, words and digests of each (of its text, marks as spaces), the numbers of their words in blocks of whole documents, and the distinct words in order of number."""
    names = [c.split()[0] for c in SLICES.split(", ")]
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.binary()), pa.binary()]
    pairs = sorted({p[i : i + 2] for _, p, _ in pieces.rows for i in range(len(p) - 1)})
    shared = docs.sparkSession.sparkContext.broadcast(pairs)  # a model's vocabulary is fixed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, cutter = TaskContext.get().partitionId() << 32, Cutter(shared.value)
        ids, sizes, digests, blocks, numbers, number, held, waiting = [], [], [], [], [], Numbers(), 0, 0

        def block() -> bytes:
            return squeezed(np.concatenate(numbers) if numbers else np.zeros(0, np.int32))

        def row() -> pa.RecordBatch:
            words = "\n".join("" if w == "\n" else w for w in number).encode()  # no other word holds a line's end, and none is empty
            packed = len(words).to_bytes(8, "little") + pa.compress(words, codec="zstd", asbytes=True) if number else None
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip([at, ids, sizes, digests, [*blocks, block()], packed], kinds, strict=True)], names)

        for batch in batches:
            for i, j in slices(batch.column(1)):
                for doc_id, text in zip(batch.column(0).slice(i, j - i).to_pylist(), batch.column(1).slice(i, j - i).to_pylist(), strict=True):
                    found = cutter.words(text)
                    ids.append(doc_id)
                    sizes.append(len(found))
                    digests.append(hashlib.sha256(text.replace(MARK, " ").encode()).hexdigest())
                    numbers.append(np.fromiter(map(number.__getitem__, found), np.int32, len(found)))
                    waiting += len(found)
                    if waiting >= RUN_IDS:
                        blocks.append(block())
                        numbers, waiting = [], 0
                    held += len(text) + 64
                    if held >= SLICE:
                        yield row()
                        ids, sizes, digests, blocks, numbers, number, held, waiting, at = [], [], [], [], [], Numbers(), 0, 0, at + 1
        if ids:
            yield row()

    return docs.mapInArrow(tidy(run), SLICES)


def word_rows(parts: DataFrame) -> DataFrame:
    """slice, number, word of the distinct words of each slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, packed in zip(batch.column(0).to_pylist(), batch.column(5), strict=True):
                if packed.is_valid:
                    raw = packed.as_py()
                    words = pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True).decode().split("\n")
                    for k in range(0, len(words), 50_000):
                        some = pa.array([w or "\n" for w in words[k : k + 50_000]], pa.string())
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), at)), pa.array(np.arange(k, k + len(some), dtype=np.int32)), some], ["slice", "number", "word"])

    return parts.mapInArrow(tidy(run), "slice long NOT NULL, number int NOT NULL, word string NOT NULL")


def edges(words: DataFrame, pieces: Pieces, keys: list[str]) -> DataFrame:
    """The keys of each word and its edges, in order of end and length: every substring that is a piece, and every unknown character."""
    if pieces.longest >= LONGEST or max(i for i, _, _ in pieces.rows) >= WIDE // 2:
        raise ValueError("a piece has fewer than 64 characters and an id under 2^24")
    spark, longest = words.sparkSession, pieces.longest
    known = spark.createDataFrame(pa.table({"piece": [p for _, p, _ in pieces.rows], "id": pa.array([i for i, _, _ in pieces.rows], pa.int32())}))
    n = F.col("n_chars")  # no word is empty; explode_outer keeps the optimiser from filters that would part the readers of one shuffle
    blocks = words.withColumn("n_chars", F.length("word")).withColumn("base", F.explode_outer(F.sequence(F.lit(0), n - 1, F.lit(BLOCK))))
    blocks = blocks.select(*keys, "base", "n_chars", F.substring(F.col("word"), F.col("base") + 1, F.lit(BLOCK + longest - 1)).alias("block"))
    begins = blocks.withColumn("begin", F.explode_outer(F.sequence(F.lit(1), F.least(F.lit(BLOCK), n - F.col("base")))))
    rows = begins.withColumn("size", F.explode_outer(F.sequence(F.lit(1), F.least(F.lit(longest), n - F.col("base") - F.col("begin") + 1))))
    rows = rows.select(*keys, (F.col("base") + F.col("begin") + F.col("size") - 1).alias("end"), "size", F.substring(F.col("block"), F.col("begin"), F.col("size")).alias("piece"))
    found = rows.join(F.broadcast(known), "piece", "left").where(F.col("id").isNotNull() | (F.col("size") == 1))
    code = F.coalesce(F.col("id"), F.lit(WIDE // 2) + F.ascii("piece")).cast("long")
    return found.groupBy(*keys).agg(F.sort_array(F.collect_list((F.col("end").cast("long") * LONGEST + F.col("size")) * WIDE + code)).alias("edges"))


def viterbi(edges: Column, pieces: Pieces) -> Column:
    """The ids of the best path over a word's edges; unknown characters have the id -1 - code point.

    The state is the best edge into each end with its score, the newest first. The edge of one character sorts first and opens an end.
    """
    score_of = dict((i, s) for i, _, s in pieces.rows)
    worst = min(score_of.values()) - UNKNOWN_PENALTY
    scores = F.split(F.lit(",".join(repr(score_of.get(i, worst)) for i in range(max(score_of) + 1))), ",").cast("array<double>")  # folded into one constant
    end_of = lambda at: F.shiftright(at, 31)  # noqa: E731  LONGEST * WIDE is 2^31
    size_of = lambda at: F.shiftright(at, 25).bitwiseAND(LONGEST - 1).cast("int")
    score = lambda at: F.coalesce(F.get(scores, at.bitwiseAND(WIDE - 1).cast("int")), F.lit(worst))
    rest = 1 << 30

    def step(ends: Column, at: Column) -> Column:
        with_edge = lambda total, others: F.concat(F.array(F.struct(total.alias("score"), at.alias("at"))), others)
        through = F.get(ends, size_of(at))["score"] + score(at)
        newest = F.get(ends, F.lit(0))["score"]
        return F.when(size_of(at) == 1, with_edge(newest + score(at), ends)).when(through > newest, with_edge(through, F.slice(ends, 2, rest))).otherwise(ends)

    def run(s: Column, some: Column) -> Column:
        """Goes on from the last ends; of these only the newest can still change, so it is replaced."""
        last = F.slice(F.get(s, F.lit(0)), 1, pieces.longest + 1)
        kept = F.transform(F.array(F.aggregate(some, last, step)), lambda ends: F.slice(ends, 1, F.size(ends) - F.size(last) + 1 + pieces.longest))
        return F.concat(kept, s)

    start = F.array(F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).cast("bigint").alias("at"))))
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(edges) - 1) / RUN).cast("int")), lambda i: F.slice(edges, i * RUN + 1, F.lit(RUN)))

    def back(s: Column, edge: Column) -> Column:
        at = edge["at"]
        code = at.bitwiseAND(WIDE - 1).cast("int")
        ids = F.concat(F.array(F.when(code < WIDE // 2, code).otherwise(WIDE // 2 - 1 - code)), s["ids"])
        return F.when((end_of(at) == s["end"]) & (at > 0), F.struct((s["end"] - size_of(at)).alias("end"), ids.alias("ids"))).otherwise(s)

    begin = F.struct(end_of(F.element_at(edges, -1)).alias("end"), F.array().cast("array<int>").alias("ids"))
    return F.aggregate(F.flatten(F.aggregate(runs, start, run)), begin, back, lambda s: s["ids"])


def spelled(ids: list[int], of_byte: list[int], unknown: int) -> list[int]:
    out: list[int] = []
    for x in ids:
        out.extend([x] if x >= 0 else [of_byte[b] for b in chr(-1 - x).encode()] if of_byte else [unknown])
    return out


def packed_ids(found: DataFrame, of_byte: list[int], unknown: int, most: int = 200_000) -> DataFrame:
    """The ids of words (slice, number, ids), packed by slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []

        def rows() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(kept).combine_chunks().sort_by([("slice", "ascending"), ("number", "ascending")]).combine_chunks()
            at, number, lists = np.asarray(t["slice"]), np.asarray(t["number"]), t["ids"].chunk(0)
            flat, offsets = np.asarray(lists.values), np.asarray(lists.offsets)
            if flat[offsets[0] : offsets[-1]].min() < 0:
                lists = pa.array([spelled(x, of_byte, unknown) for x in lists.to_pylist()], pa.list_(pa.int32()))
                flat, offsets = np.asarray(lists.values), np.asarray(lists.offsets)
            begin = np.flatnonzero(np.diff(at, prepend=at[0] - 1))
            for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(at)], strict=True):
                columns = [np.diff(number[a:b], prepend=0), np.diff(offsets[a : b + 1]), flat[offsets[a] : offsets[b]]]
                yield pa.RecordBatch.from_arrays([pa.array([at[a]], pa.int64()), *[pa.array([squeezed(c)], pa.binary()) for c in columns]], ["slice", "number", "size", "ids"])

        for batch in batches:
            if batch.num_rows:
                kept.append(batch)
            if sum(b.num_rows for b in kept) >= most:
                yield from rows()
                kept = []
        if kept:
            yield from rows()

    return found.select("slice", "number", "ids").mapInArrow(tidy(run), BACK)


def placed(key: tuple, docs: pa.Table, words: pa.Table) -> pa.Table:
    """The documents of a slice with the ids of their words, a chunk for each block."""
    release_memory()  # of the slice before
    number = [np.cumsum(loosened(x.as_py())) for x in words["number"]]
    size, ids = ([loosened(x.as_py()) for x in words[c]] for c in ("size", "ids"))
    every, n, flat = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (number, size, ids))
    start, length = np.zeros(len(every), np.int64), np.zeros(len(every), np.int32)
    start[every], length[every] = np.cumsum(n) - n, n
    doc_ids, digests, sizes, blocks = (docs[c][0].values for c in ("doc_ids", "digests", "sizes", "numbers"))
    done, made, i = np.cumsum(np.concatenate(([0], np.asarray(sizes).astype(np.int64)))), [], 0  # words before each document
    for k, block in enumerate(blocks):
        w = loosened(block.as_py())
        j = len(sizes) if k == len(blocks) - 1 else int(np.searchsorted(done, done[i] + len(w), side="right")) - 1
        took = length[w]
        ends = np.concatenate(([0], np.cumsum(took, dtype=np.int64)))
        got = flat[np.repeat(start[w] - ends[:-1], took) + np.arange(ends[-1])].astype(np.int32, copy=False)
        lists = pa.LargeListArray.from_arrays(pa.array(ends[done[i : j + 1] - done[i]]), pa.array(got, pa.int32())).cast(pa.list_(pa.int32()))
        made.append(pa.table({"doc_id": doc_ids[i:j], "digest": digests[i:j], "ids": lists}))
        i = j
    return pa.concat_tables(made)


def by_merges(docs: DataFrame, pieces: Pieces, cache_words: int = 200_000) -> DataFrame:
    """doc_id, digest, ids by the rule of BPE models; a task keeps so many words that it has met."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(pieces))  # a model's vocabulary is fixed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(*shared.value)
        merger, seen = Merger(pieces), {}

        def ids_of(word: str) -> list[int]:
            if word not in seen:
                if len(seen) >= cache_words:
                    seen.clear()
                seen[word] = spelled(merger.merged(word), pieces.bytes, pieces.unknown)
            return seen[word]

        for batch in batches:
            for i, j in slices(batch.column(1), 2 << 20):
                texts = batch.column(1).slice(i, j - i).to_pylist()
                ids = pa.array([[x for w in words_of(t) for x in ids_of(w)] for t in texts], pa.list_(pa.int32()))
                digests = pa.array([hashlib.sha256(t.replace(MARK, " ").encode()).hexdigest() for t in texts], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), digests, ids], ["doc_id", "digest", "ids"])

    return docs.mapInArrow(tidy(run), "doc_id long, digest string, ids array<int>")


def word_ids(words: DataFrame, pieces: Pieces) -> DataFrame:
    """word and ids of a table of distinct words by Viterbi; unknown characters have the id -1 - code point."""
    return edges(words.select("word", F.col("word").alias("__word")).select("__word", "word"), pieces, ["__word"]).select(F.col("__word").alias("word"), viterbi(F.col("edges"), pieces).alias("ids"))


def encode(df: DataFrame, pieces: Pieces, id_col: str = "doc_id", text_col: str = "text", rule: str | None = None) -> DataFrame:
    """doc_id, ids and digest of every row: the SHA-256 of its text, with spaces for word marks."""
    docs = with_text(df, id_col, text_col)
    if (rule or ("viterbi" if pieces.unigram else "bpe")) == "bpe":
        return by_merges(docs, pieces).select("doc_id", "ids", "digest")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = sliced(docs, pieces).repartition(n, "slice")
    spread = word_rows(parts).repartition(n * FINER, F.xxhash64("word")).withColumn("h", F.xxhash64("word"))
    # a word is known by its number in the last slice that has it; so every reader of the words takes all columns, of which none is null, and they share one shuffle
    distinct = spread.groupBy("h", "word").agg(F.max("slice").alias("s"), F.max_by("number", "slice").alias("m"))
    folded = edges(distinct, pieces, ["h", "s", "m"]).select(F.col("h").alias("fh"), F.col("s").alias("fs"), F.col("m").alias("fm"), viterbi(F.col("edges"), pieces).alias("ids"))
    # joined by the hash alone, by which all sides are partitioned; told apart by bounds, since equalities would become keys and shuffle again
    same = lambda a, b: (F.col(a) <= F.col(b)) & (F.col(a) >= F.col(b))
    known = distinct.join(folded.hint("merge"), (F.col("h") == F.col("fh")) & same("s", "fs") & same("m", "fm")).select(F.col("h").alias("kh"), F.col("word").alias("known"), "ids")
    found = spread.join(known.hint("merge"), (F.col("h") == F.col("kh")) & same("word", "known"))
    back = packed_ids(found, pieces.bytes, pieces.unknown)
    return parts.groupBy("slice").cogroup(back.groupBy("slice")).applyInArrow(placed, "doc_id long, digest string, ids array<int>").select("doc_id", "ids", "digest")


def decode(df: DataFrame, pieces: Pieces, ids_col: str = "ids", to: str = "text") -> DataFrame:
    """The table with the text of each row's ids as another column: pieces and bytes put together, marks back to spaces."""
    shared = df.sparkSession.sparkContext.broadcast(tuple(pieces))
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(*shared.value)
        raw = {i: p.encode() for i, p, _ in pieces.rows} | {i: bytes([b]) for b, i in enumerate(pieces.bytes)} | dict.fromkeys(pieces.control, b"")
        lost = max(raw) + 1  # stands for every id of no piece
        spelling = [raw.get(i, " ⁇ ".encode()) for i in range(lost + 1)]
        length = np.array([len(x) for x in spelling])
        start, blob = np.cumsum(length) - length, np.frombuffer(b"".join(spelling), np.uint8)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids_col))
            size = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
            done = np.concatenate(([0], np.cumsum(size)))
            i = 0
            while i < len(size):  # runs of so many ids, one row at least, are a batch each
                j = max(i + 1, int(np.searchsorted(done, done[i] + RUN_IDS, side="right")) - 1)
                ids = np.asarray(pc.fill_null(lists.slice(i, j - i).flatten(), -1)).astype(np.int64)
                ids = np.where((ids < 0) | (ids > lost), lost, ids)
                n = length[ids]
                ends = np.concatenate(([0], np.cumsum(n)))
                text = blob[np.repeat(start[ids] - ends[:-1], n) + np.arange(ends[-1])].tobytes()
                bounds = ends[done[i : j + 1] - done[i]].tolist()
                texts = [text[a:b].decode("utf-8", "replace").replace(MARK, " ").removeprefix(" ") for a, b in zip(bounds, bounds[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, pa.array(texts, pa.string())], [*batch.schema.names, to])
                i = j

    return df.mapInArrow(tidy(run), f"{columns}, `{to}` string")
