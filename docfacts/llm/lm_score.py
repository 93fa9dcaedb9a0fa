"""LM scoring: cross-entropy difference of two matched bigram models.

The background model counts all documents, the target model those marked as
target. Both have one vocabulary (every word) and every bigram of the
documents, and the same smoothing. Nothing is cut, whatever its frequency.

p(w | h) = (c(h, w) + mu p(w)) / (c(h) + mu), p(w) = (c(w) + 1) / (N + V + 1), with
c(h) the sum over the bigrams of h and V the number of distinct words; each is a
proper distribution over the vocabulary and one unknown word. A document's score is the difference per
token, target less background cross-entropy: lower is more like the target.

Only speed depends on frequency. Words with at least 1/100,000 of all tokens
and bigrams of these with at least 1/2^20 (so never more than 100,000 and 2^20)
are broadcast with their counts and scored in place, so no key that is shuffled
is hot. All other bigrams of a document go, with their number, to the bucket of
their key, where all of the same key meet: it counts them there, and their parts
of the score go back to their document. There is a bucket for each shuffle
partition, and more where these would pass a fixed size; the rows of a slice of
documents for one bucket travel packed. Words are told apart by a 64-bit hash.

Defined cases: null or empty text has no tokens and scores 0; repeated rows
count and score each; without target documents the target model is uniform;
target ids without document are ignored, and rows without id are background; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docfacts.llm.common import release_memory, stored, tidy, with_text
from docfacts.llm.jaccard import FEW_IDS, mixed
from docfacts.llm.packing import slices

WORD_SHARE = 100_000
BIGRAM_SHARE = 1 << 20
MU = 50.0
START = 1  # stands for the hash of the word before the first


@dataclass
class Models:
    """What is broadcast of both models: the frequent words and bigrams with their counts among all, and the totals."""

    words: np.ndarray  # sorted hashes; word i has code i + 1, any other word 0, the start of a text len + 1
    pairs: np.ndarray  # sorted codes h * (len + 2) + w of the frequent bigrams
    seen: np.ndarray  # 2 x pairs: log p(w | h), background and target
    word: np.ndarray  # 2 x codes: log mu p(w); code 0 is a word never seen
    history: np.ndarray  # 2 x codes: log (c(h) + mu)
    count: np.ndarray  # 2 x words: c(w)
    total: tuple[int, int]  # N + V + 1 of both


def flagged(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, target. The ids are broadcast where they were counted to be few."""
    ids = target_ids.select(F.col(target_ids.columns[0]).cast("long").alias("doc_id"), F.lit(True).alias("t")).where("doc_id IS NOT NULL").distinct()
    base = with_text(docs, id_col, text_col)
    few = ids.count() <= FEW_IDS
    marked = base.join(F.broadcast(ids) if few else ids, "doc_id", "left").select("doc_id", "text", F.coalesce("t", F.lit(False)).alias("target"))
    return marked if few else stored(marked, "marked")  # rows are numbered by their place later on, which a shuffle does not keep


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the distinct word of each token, and where each text's tokens begin."""
    split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.utf8_lower(texts)))
    bounds = np.asarray(split.offsets).astype(np.int64)
    coded = split.flatten().dictionary_encode()
    tokens, bounds = np.asarray(coded.indices), bounds - bounds[0]
    empty = pc.index(coded.dictionary, "").as_py()
    if empty >= 0:
        keep = tokens != empty
        bounds, tokens = np.concatenate(([0], np.cumsum(keep)))[bounds], tokens[keep]
    return coded.dictionary, tokens, bounds


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of distinct words, the distinct word of each token, and where each text's tokens begin."""
    from xxhash import xxh3_64_intdigest

    words, tokens, bounds = split_words(texts)
    return np.fromiter(map(xxh3_64_intdigest, words.to_pylist()), np.uint64, len(words)).view(np.int64), tokens, bounds


def word_counts(docs: DataFrame) -> DataFrame:
    """word, its tokens n and t of these in target documents, and hn and ht of them with a word after."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(batch.column(1), 32 << 20):
                words, tokens, bounds = word_hashes(batch.column(1).slice(i, j - i))
                size = np.diff(bounds)
                chosen = np.asarray(batch.column(2).slice(i, j - i)).astype(bool)
                target, last = np.repeat(chosen, size), bounds[1:][size > 0] - 1
                n, t = np.bincount(tokens, minlength=len(words)), np.bincount(tokens[target], minlength=len(words))
                hn, ht = n - np.bincount(tokens[last], minlength=len(words)), t - np.bincount(tokens[last[target[last]]], minlength=len(words))
                used = n > 0
                begun = [START, 0, 0, int((size > 0).sum()), int(((size > 0) & chosen).sum())]
                columns = [pa.array(np.append(c[used], x)) for c, x in zip((words, n, t, hn, ht), begun, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["word", "n", "t", "hn", "ht"])

    made = docs.select("doc_id", "text", "target").mapInArrow(tidy(run), "word long, n long, t long, hn long, ht long")
    return made.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("n", "t", "hn", "ht")])


def places(x: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each of x is among the sorted known ones, and whether it is."""
    at = np.minimum(np.searchsorted(known, x), max(0, len(known) - 1))
    return at, (known[at] == x if len(known) else np.zeros(len(x), bool))


def codes_of(words: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    at, hit = places(words, vocabulary)
    return np.where(hit, at + 1, 0).astype(np.int64)


def words_before(tokens: np.ndarray, bounds: np.ndarray, start: int) -> np.ndarray:
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[bounds[:-1][np.diff(bounds) > 0]] = start
    return before


def pair_counts(docs: DataFrame, vocabulary) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = vocabulary.value
        for batch in batches:
            for i, j in slices(batch.column(1), 16 << 20):
                words, tokens, bounds = word_hashes(batch.column(1).slice(i, j - i))
                code = codes_of(words, frequent)[tokens]
                before = words_before(code, bounds, len(frequent) + 1)
                target = np.repeat(np.asarray(batch.column(2).slice(i, j - i)).astype(bool), np.diff(bounds))
                known = (code > 0) & (before > 0)
                pair, where = np.unique(before[known] * (len(frequent) + 2) + code[known], return_inverse=True)
                n, t = np.bincount(where, minlength=len(pair)), np.bincount(where[target[known]], minlength=len(pair))
                yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n), pa.array(t)], ["pair", "n", "t"])

    return docs.select("doc_id", "text", "target").mapInArrow(tidy(run), "pair long, n long, t long").groupBy("pair").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))


def train(docs: DataFrame) -> Models:
    """The totals and the frequent part of both models, from a table of doc_id, text, target."""
    spark = docs.sparkSession
    counts = stored(word_counts(docs), "words")
    total = counts.agg(F.sum("n").alias("n"), F.sum("t").alias("t"), F.count_if(F.col("n") > 0).alias("v")).first()
    n, t, types = total["n"] or 0, total["t"] or 0, total["v"]
    begun = counts.where(F.col("word") == START).first()
    kept = counts.where((F.col("n") * WORD_SHARE >= n) & (F.col("word") != START)).toArrow().sort_by("word")
    words = np.asarray(kept["word"]).astype(np.int64)
    size = len(words)
    whole = (n + types + 1, t + types + 1)
    count = np.array([np.asarray(kept["n"]), np.asarray(kept["t"])]).astype(float).reshape(2, -1)
    p = np.concatenate((np.ones((2, 1)), count + 1), axis=1) / np.array(whole)[:, None]
    after = np.zeros((2, size + 2))
    for row, name in enumerate(("hn", "ht")):
        after[row, 1 : size + 1] = np.asarray(kept[name])
        after[row, size + 1] = begun[name] if begun else 0

    found = pair_counts(docs, spark.sparkContext.broadcast(words)).where(F.col("n") * BIGRAM_SHARE >= n).toArrow().sort_by("pair")
    pair = np.asarray(found["pair"]).astype(np.int64)
    two = np.array([np.asarray(found["n"]), np.asarray(found["t"])]).astype(float).reshape(2, -1)
    h, w = pair // (size + 2), pair % (size + 2)
    seen = np.log((two + MU * p[:, w]) / (after[:, h] + MU))
    return Models(words, pair, seen, np.log(MU * p), np.log(after + MU), count, whole)


PAIR, RARE_WORD, RARE_HISTORY = range(3)
BUCKET = 1 << 21  # tokens for each bucket of counts, at most: what one call holds at once
DOCS = "docs array<struct<doc_id: bigint, size: bigint, n: double, t: double>>"
PACKED = f"bucket int, kind byte, slice long, {DOCS}, keys binary, before binary, at binary, m binary, code binary"
SUMS = f"slice long, {DOCS}, at binary, n binary, t binary"
DOC = pa.struct([("doc_id", pa.int64()), ("size", pa.int64()), ("n", pa.float64()), ("t", pa.float64())])


def packed(column: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The parts of a column that begin at these places: of the bytes of its numbers first all first ones, then all second ones, compressed."""
    import zstandard

    press = zstandard.ZstdCompressor(level=1)
    octets, bounds = column.view(np.uint8).reshape(len(column), column.itemsize), [*starts, len(column)]
    return pa.array([press.compress(np.ascontiguousarray(octets[i:j].T)) for i, j in zip(bounds, bounds[1:], strict=False)], pa.binary())


def unpacked(parts: pa.ChunkedArray, kind: type) -> list[np.ndarray]:
    import zstandard

    press, size = zstandard.ZstdDecompressor(), np.dtype(kind).itemsize
    octets = [np.frombuffer(press.decompress(part), np.uint8).reshape(size, -1) for part in parts.to_pylist()]
    return [np.ascontiguousarray(x.T).view(kind).ravel() for x in octets]


def parts(docs: DataFrame, models: Models, buckets: int) -> DataFrame:
    """One row without kind for each slice of documents, with the parts of their scores that the frequent words and bigrams give, and the counts still needed, packed by bucket.

    PAIR and RARE_WORD: a bigram (before, w) that the document has m times; the key has all rows of the bigram if w is frequent,
    and else all rows of w. A pair's key has 56 bits of its hash; the code of w makes it whole. RARE_HISTORY: a word, the key, that the document has m times before another. A packed row holds
    those of one slice whose keys fall into one bucket; ``at`` is twice the document's place in its slice, plus 1 in target documents.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tuple(vars(models).values()))  # plain values: unpickling needs no import of this module
    kinds = {"bucket": pa.int32(), "kind": pa.int8(), "slice": pa.int64(), "docs": pa.list_(DOC), "keys": pa.binary(), "before": pa.binary(), "at": pa.binary(), "m": pa.binary(), "code": pa.binary()}

    def rows_of(known: dict, size: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([known[c].cast(k) if c in known else pa.nulls(size, k) for c, k in kinds.items()], list(kinds))

    def pack(kind: int, row0: int, keys, at, m, before=None, code=None) -> pa.RecordBatch:
        bucket = (keys.view(np.uint64) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((keys.view(np.uint64), bucket))
        used, starts = np.unique(bucket[order], return_index=True)
        given = {"keys": keys, "before": before, "at": at.astype(np.uint32), "m": m.astype(np.uint32), "code": None if code is None else code.astype(np.uint32)}
        known = {c: packed(x[order], starts) for c, x in given.items() if x is not None}
        return rows_of(known | {"bucket": pa.array(used), "kind": pa.array(np.full(len(used), kind)), "slice": pa.array(np.full(len(used), row0))}, len(used))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        m = Models(*shared.value)
        size, row0 = len(m.words), TaskContext.get().partitionId() << 40
        for batch in batches:
            for i, j in slices(batch.column(1)):
                words, tokens, bounds = word_hashes(batch.column(1).slice(i, j - i))
                target, length, own = np.asarray(batch.column(2).slice(i, j - i)).astype(np.int64), np.diff(bounds), len(words)
                hashes, codes = np.append(words, START), np.append(codes_of(words, m.words), size + 1)
                tokens = tokens.astype(np.int64)
                before = words_before(tokens, bounds, own)
                found, times = np.unique((np.repeat(np.arange(j - i), length) * (own + 1) + before) * max(own, 1) + tokens, return_counts=True)
                w, held = found % max(own, 1), found // max(own, 1)
                h, doc = held % (own + 1), held // (own + 1)
                cw, ch = codes[w], codes[h]
                at, hot = places(ch * (size + 2) + cw, m.pairs)
                hot &= (cw > 0) & (ch > 0)
                plain = ~hot & (ch > 0)
                n, t = (
                    np.bincount(doc[hot], times[hot] * m.seen[r][at[hot]], j - i) - np.bincount(doc[plain], times[plain] * m.history[r][ch[plain]], j - i)
                    for r in range(2)
                )
                ids = batch.column(0).slice(i, j - i).cast(pa.int64())
                listed = pa.StructArray.from_arrays([ids, pa.array(length), pa.array(n), pa.array(t)], fields=list(DOC))
                yield rows_of({"bucket": pa.array([row0 % buckets]), "slice": pa.array([row0]), "docs": pa.ListArray.from_arrays([0, j - i], listed)}, 1)

                place = 2 * doc + target[doc]
                often, seldom = ~hot & (cw > 0), ~hot & (cw == 0)
                with np.errstate(over="ignore"):
                    both = mixed(hashes[h[often]].view(np.uint64) * np.uint64(0x2545F4914F6CDD1D) + hashes[w[often]].view(np.uint64)).view(np.int64) & ~0xFF
                yield pack(PAIR, row0, both, place[often], times[often], code=cw[often])
                yield pack(RARE_WORD, row0, hashes[w[seldom]], place[seldom], times[seldom], before=hashes[h[seldom]])
                lone, where = np.unique(held[ch == 0], return_inverse=True)
                of = lone // (own + 1)
                yield pack(RARE_HISTORY, row0, hashes[lone % (own + 1)], 2 * of + target[of], np.bincount(where, times[ch == 0], len(lone)))
                row0 += j - i

    return docs.select("doc_id", "text", "target").mapInArrow(tidy(run), PACKED)


def totals(keys: np.ndarray, m: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each key's rows, the sum of m among all and among target documents, at each of its rows."""
    _, where = np.unique(keys, return_inverse=True)
    return np.bincount(where, m)[where], np.bincount(where, m * target)[where]


def score(docs: DataFrame, models: Models) -> DataFrame:
    """doc_id, n_tokens, ce_background, ce_target (nats a token) and score, their difference."""
    buckets = max(models.total[0] // BUCKET + 1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    shared = docs.sparkSession.sparkContext.broadcast((models.count, models.total))

    def of_bucket(rows: pa.Table) -> pa.Table:
        count, total = shared.value
        base = rows.filter(pc.is_null(rows["kind"])).select(["slice", "docs"])
        docs_of, sums = [], [[], []]
        for kind in (PAIR, RARE_WORD, RARE_HISTORY):
            some = rows.filter(pc.fill_null(pc.equal(rows["kind"], kind), False))
            if some.num_rows == 0:
                continue
            read = lambda name, of: np.concatenate(unpacked(some[name], of))  # noqa: B023, E731
            keys, m, ats = read("keys", np.int64), read("m", np.uint32).astype(float), unpacked(some["at"], np.uint32)
            at = np.concatenate(ats)
            target = at & 1
            docs_of.append(np.repeat(np.asarray(some["slice"]), [len(x) for x in ats]) + (at >> 1))
            if kind == RARE_HISTORY:
                scored = [-m * np.log(k + MU) for k in totals(keys, m, target)]
            else:
                if kind == PAIR:
                    code = read("code", np.uint32)
                    pairs, word = keys ^ mixed(code.astype(np.uint64)).view(np.int64), count[:, code - 1]
                else:
                    before, word = read("before", np.int64), totals(keys, m, target)
                    order = np.lexsort((before, keys))
                    w, h, pairs = keys[order], before[order], np.empty(len(keys), np.int64)
                    pairs[order] = np.cumsum(np.append(False, (w[1:] != w[:-1]) | (h[1:] != h[:-1])))
                scored = [m * np.log(k + MU * (c + 1) / n) for k, c, n in zip(totals(pairs, m, target), word, total, strict=True)]
            for side, x in zip(sums, scored, strict=True):
                side.append(x)
        made = {"slice": base["slice"], "docs": base["docs"]} | {c: pa.nulls(base.num_rows, pa.binary()) for c in ("at", "n", "t")}
        whole = pa.table(made)
        if docs_of:
            row, where = np.unique(np.concatenate(docs_of), return_inverse=True)
            known = np.unique(np.asarray(rows["slice"]))
            own = known[np.searchsorted(known, row, side="right") - 1]
            first, starts = np.unique(own, return_index=True)
            made = {"slice": pa.array(first), "docs": pa.nulls(len(first), base.schema.field("docs").type), "at": packed((row - own).astype(np.uint32), starts)}
            made |= {c: packed(np.bincount(where, np.concatenate(side)), starts) for c, side in zip("nt", sums, strict=True)}
            whole = pa.concat_tables([whole, pa.table(made, schema=whole.schema)])
        return whole

    def of_slice(rows: pa.Table) -> pa.Table:
        base = rows.filter(pc.is_valid(rows["docs"]))["docs"].combine_chunks().flatten()
        n, t = (np.array(base.field(c)) for c in "nt")
        sums = rows.filter(pc.is_valid(rows["at"]))
        for at, x, y in zip(unpacked(sums["at"], np.uint32), unpacked(sums["n"], np.float64), unpacked(sums["t"], np.float64), strict=True):
            n[at] += x  # a document occurs once in each part
            t[at] += y
        return pa.table({"doc_id": base.field("doc_id"), "n_tokens": base.field("size"), "n": n, "t": t})

    counted = parts(docs, models, buckets).groupBy("bucket").applyInArrow(of_bucket, SUMS)
    sums = counted.groupBy("slice").applyInArrow(of_slice, "doc_id long, n_tokens long, n double, t double")
    entropy = lambda c: F.when(F.col("n_tokens") > 0, -F.col(c) / F.col("n_tokens")).otherwise(0.0)
    return sums.select("doc_id", "n_tokens", entropy("n").alias("ce_background"), entropy("t").alias("ce_target"), (entropy("t") - entropy("n")).alias("score"))


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    marked = flagged(docs, target_ids, id_col, text_col)
    models = train(marked)
    release_memory()
    return score(marked, models)
