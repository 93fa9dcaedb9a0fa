"""Toxicity: a linear-chain conditional random field over the words of a document.

Training, on a bounded sample of labelled documents that tasks read (the driver
gets counts of features, a bounded number of windows, and four figures a text):
document labels become word labels: words and word beginnings that are found mostly in toxic
documents, and in more of them than chance allows, mark the tokens of the
sample's toxic documents. A two-state chain (clean, toxic) with the word
itself, its beginnings (compounds of one stem) and its two neighbours as features is fitted to windows of tokens by
gradient ascent on the conditional likelihood; the transitions follow the expected counts of neighbours. A small logistic layer, fitted on
the same sample, turns the marginals of a document into its score.

Scoring (tasks, whole texts): forward-backward over every word of a document,
vectorised over the documents of a slice. Two states need one ratio each way.
A document gets the score, the expected number of toxic words, and the offsets
(code points) of runs of words with a marginal of 0.5 or more.

Defined cases: null or empty text has no words and gets the score of a document
without toxic words; repeated rows get equal scores; without positive or without negative
labels every score is 0; null labels and ids are not learnt from; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfacts.llm.common import discard, release_memory, stored, tidy, with_text
from docfacts.llm.packing import slices

FOLDS = 5
STEMS = range(4, 11)
MARKS = " \t\r\n.,;:!?|%$&*#\"'()[]{}<>«»„“”¿¡…-_/\\=+~"
SPAN = "array<struct<start:int,end:int,marginal:double>>"
SCHEMA = f"doc_id long, score double, expected_toxic double, max_marginal double, spans {SPAN}"


def held_out(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string")) % FOLDS == 0


@dataclass
class Model:
    words: list[str]  # the feature vocabulary (words and beginnings); 0 stands for all others
    emit: np.ndarray  # weight of a feature of the word itself, of its left and of its right neighbour: 3 x (1 + words)
    bias: float
    step: np.ndarray  # log potentials of (from, to)
    layer: np.ndarray  # weights of layer_input


def word_features(words: pa.Array) -> list[pa.Array]:
    """The trimmed lower-case word, and each of its beginnings that is shorter than it."""
    plain = pc.utf8_trim(pc.utf8_lower(words), MARKS)
    size = pc.utf8_length(plain)
    none = pa.scalar(None, pa.string())
    return [pc.if_else(pc.greater(size, 0), plain, none)] + [pc.if_else(pc.greater(size, k), pc.binary_join_element_wise(pc.utf8_slice_codeunits(plain, 0, k), "*", ""), none) for k in STEMS]


def word_codes(texts: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers (0: unknown) of the distinct words, the distinct word of each word, and where each text's words begin."""
    split = pc.ascii_split_whitespace(texts)
    bounds = np.asarray(split.offsets).astype(np.int64)
    coded = split.flatten().dictionary_encode()
    number = [np.asarray(pc.fill_null(pc.add(pc.index_in(f, vocabulary, skip_nulls=True), 1), 0)).astype(np.int32) for f in word_features(coded.dictionary.cast(pa.string()))]
    return np.array(number), np.asarray(coded.indices), bounds - bounds[0]


def emissions(number: np.ndarray, tokens: np.ndarray, bounds: np.ndarray, emit: np.ndarray, bias: float) -> np.ndarray:
    score = emit[0][number].sum(axis=0)[tokens] + bias
    left, right = emit[1][number[0]][tokens], emit[2][number[0]][tokens]
    if len(tokens) > 1:
        joined = np.ones(len(tokens) - 1, bool)
        inner = bounds[(bounds > 0) & (bounds < len(tokens))]
        joined[inner - 1] = False
        score[1:] += left[:-1] * joined
        score[:-1] += right[1:] * joined
    return score


def messages(score: np.ndarray, bounds: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every word its odds, and the ratios toxic to clean of the sums ahead (with its odds) and behind. The recursion runs over positions, for all texts at once."""
    size = np.diff(bounds)
    order = np.argsort(-size, kind="stable")
    size = size[order]
    if not len(size) or not size[0]:
        return np.zeros(0), np.zeros(0), np.zeros(0)
    active = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")  # texts that reach each position
    first = np.concatenate(([0], np.cumsum(active)))
    place = np.empty(len(score), np.int64)  # from text-major to position-major
    rank = np.repeat(np.argsort(order), np.diff(bounds))
    position = np.arange(len(score)) - np.repeat(bounds[:-1], np.diff(bounds))
    place = first[position] + rank
    odds = np.empty(len(score))
    odds[place] = np.exp(np.clip(score, -40, 40))
    cc, ct, tc, tt = np.exp(step).ravel()
    ahead, back = np.empty_like(odds), np.empty_like(odds)
    state = np.full(active[0], 1.0)
    starts, counts = first.tolist(), active.tolist()
    for i, n in enumerate(counts):
        at = slice(starts[i], starts[i] + n)
        state = odds[at] if i == 0 else odds[at] * (ct + state[:n] * tt) / (cc + state[:n] * tc)
        ahead[at] = state
    state = np.ones(counts[-1])
    back[starts[-2] : starts[-1]] = state
    for i in range(len(counts) - 2, -1, -1):
        n, m = counts[i], counts[i + 1]
        seen = np.ones(n)
        ratio = odds[starts[i + 1] : starts[i + 1] + m] * state
        seen[:m] = (tc + ratio * tt) / (cc + ratio * ct)
        state = seen
        back[starts[i] : starts[i] + n] = state
    return odds[place], ahead[place], back[place]


def marginals(score: np.ndarray, bounds: np.ndarray, step: np.ndarray) -> np.ndarray:
    """P(toxic) of every word by forward-backward."""
    _, ahead, back = messages(score, bounds, step)
    both = ahead * back
    return both / (1 + both)


def expected_counts(score: np.ndarray, bounds: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(toxic) of every word, and the expected number of each (from, to) among neighbours."""
    odds, ahead, back = messages(score, bounds, step)
    both = ahead * back
    inner = np.ones(len(score), bool)
    inner[bounds[:-1][np.diff(bounds) > 0]] = False
    at = np.flatnonzero(inner)
    (cc, ct), (tc, tt) = np.exp(step)
    before, after = ahead[at - 1], odds[at] * back[at]
    pair = np.array([np.full(len(at), cc), ct * after, before * tc, before * tt * after])
    return both / (1 + both), (pair / pair.sum(axis=0)).sum(axis=1).reshape(2, 2)


def document_features(p: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected number of toxic words, the same of two readings that agree, and the greatest marginal (0 without words).

    Agreement weighs a marginal by itself: the many small ones of a long clean
    document come to little.
    """
    def over(x: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(x)))
        return np.maximum(total[bounds[1:]] - total[bounds[:-1]], 0)

    most = np.zeros(len(bounds) - 1)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        most[full] = np.maximum.reduceat(p, bounds[:-1][full])
    return over(p), over(p * p), most


def layer_input(agreed: np.ndarray, most: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Of the document score; a chance hit is likelier in a long document."""
    return np.column_stack((np.ones(len(most)), np.log(0.05 + agreed), most, most * np.log1p(np.diff(bounds))))


def lone_documents(lows: list[tuple[int, ...]], toxic: list[bool]) -> list[int]:
    """One document of each group of near copies, told by their four smallest word hashes: copies are no evidence of their own."""
    first: dict[tuple, int] = {}
    for i, low in enumerate(lows):
        j = first.setdefault(low, i)
        if toxic[i] and not toxic[j]:
            first[low] = i
    return sorted(first.values())


def smallest_hashes(texts: pa.Array) -> list[tuple[int, ...]]:
    """The four smallest hashes of each text's words."""
    split = pc.ascii_split_whitespace(texts)
    bounds = np.asarray(split.offsets).astype(np.int64)
    coded = split.flatten().dictionary_encode()
    hashes = np.fromiter((zlib.crc32(w.encode()) for w in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))[np.asarray(coded.indices)]
    bounds = bounds - bounds[0]
    return [tuple(np.unique(hashes[a:b])[:4].tolist()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def feature_counts(texts: pa.Array, toxic: np.ndarray, alone: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The features of the texts, and of each in how many texts, lone texts, and toxic lone texts it is."""
    split = pc.ascii_split_whitespace(texts)
    bounds = np.asarray(split.offsets).astype(np.int64)
    coded = split.flatten().dictionary_encode()
    features = pa.concat_arrays(word_features(coded.dictionary.cast(pa.string()))).dictionary_encode()
    codes = np.asarray(pc.fill_null(features.indices, -1)).astype(np.int64).reshape(-1, len(coded.dictionary))
    size, doc = len(features.dictionary), np.repeat(np.arange(len(texts)), np.diff(bounds))
    own = np.unique(doc * max(1, len(coded.dictionary)) + np.asarray(coded.indices))  # distinct words of each text
    doc, word = np.divmod(own, max(1, len(coded.dictionary)))
    pairs = np.unique(np.concatenate([doc * (size + 1) + row[word] + 1 for row in codes]))
    doc, code = np.divmod(pairs, size + 1)
    doc, code = doc[code > 0], code[code > 0] - 1
    return features.dictionary, np.array([np.bincount(code, minlength=size), np.bincount(code, alone[doc], size), np.bincount(code, alone[doc] & toxic[doc], size)]).astype(np.int64)


def windows(key: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the windows of the texts begin and end, and a rank for each that depends on its text's key and its place alone."""
    starts = [np.arange(a, b, width) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    n = np.array([len(x) for x in starts], np.int64)
    cuts = np.concatenate([*starts, bounds[-1:]])
    place = np.concatenate([np.arange(k) for k in n]) if len(n) else n
    with np.errstate(over="ignore"):
        rank = (np.repeat(key, n).astype(np.uint64) + place.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        rank = (rank ^ (rank >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return cuts, (rank ^ (rank >> np.uint64(32))).astype(np.int64)


def fit_chain(codes: np.ndarray, y: np.ndarray, wb: np.ndarray, size: int, rounds: int = 80) -> tuple[np.ndarray, float, np.ndarray]:
    """Emissions, bias and transitions of the chain. codes: feature numbers (kinds x tokens); wb: where the windows begin."""
    number, x = np.unique(codes, axis=1, return_inverse=True)
    x = x.ravel()
    emit, bias, step = np.zeros((3, size)), -2.0, np.zeros((2, 2))
    inner = np.ones(len(x), bool)
    inner[wb[:-1]] = False
    prev = np.flatnonzero(inner)
    state = y.astype(int)
    seen = np.zeros((2, 2))
    np.add.at(seen, (state[prev - 1], state[prev]), 1)
    rows = np.bincount(state[prev - 1], minlength=2) + 2.0
    step = np.log((seen + 1) / rows[:, None])  # to begin with: of the labelled tokens themselves
    moment = [np.zeros_like(emit), np.zeros_like(emit), 0.0, 0.0, np.zeros((2, 2)), np.zeros((2, 2))]
    lone = number[0]
    for k in range(1, rounds + 1):
        p, pairs = expected_counts(emissions(number, x, wb, emit, bias), wb, step)
        gap = y - p
        grad = np.zeros_like(emit)
        of_word = np.bincount(x, gap, number.shape[1])
        for row in number:
            grad[0] += np.bincount(row, of_word, size)
        grad[1] = np.bincount(lone, np.bincount(x[prev - 1], gap[prev], number.shape[1]), size)
        grad[2] = np.bincount(lone, np.bincount(x[prev], gap[prev - 1], number.shape[1]), size)
        grad[:, 0] = 0  # the unknown
        grad -= 0.05 * emit
        side = gap.sum()
        turn = seen - pairs - 0.05 * step
        moment[0], moment[1] = 0.9 * moment[0] + 0.1 * grad, 0.99 * moment[1] + 0.01 * grad**2
        moment[2], moment[3] = 0.9 * moment[2] + 0.1 * side, 0.99 * moment[3] + 0.01 * side**2
        moment[4], moment[5] = 0.9 * moment[4] + 0.1 * turn, 0.99 * moment[5] + 0.01 * turn**2
        a, b = 1 - 0.9**k, 1 - 0.99**k
        emit += 0.15 * (moment[0] / a) / (np.sqrt(moment[1] / b) + 1e-2)
        bias += 0.15 * (moment[2] / a) / (np.sqrt(moment[3] / b) + 1e-2)
        step += 0.05 * (moment[4] / a) / (np.sqrt(moment[5] / b) + 1e-2)
    return emit, bias, step


def fit_layer(z: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Logistic weights by Newton steps with a little shrinkage."""
    layer = np.zeros(z.shape[1])
    for _ in range(60):
        q = 1 / (1 + np.exp(-np.clip(z @ layer, -30, 30)))
        hessian = (z * (q * (1 - q))[:, None]).T @ z + 0.1 * np.eye(z.shape[1])
        change = np.linalg.solve(hessian, z.T @ (toxic - q) - 0.1 * layer)
        layer += np.clip(change, -2, 2)
        if np.abs(change).max() < 1e-6:
            break
    return layer


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most_toxic: int, most_clean: int) -> DataFrame | None:
    """key, text, y of the labelled texts to learn from, each text once (toxic if any of its rows is); None without two classes.

    The smallest hashes of the ids are taken, so the sample is the same on every
    run. Ids and keys come to the driver, at most ``most_toxic + most_clean``; texts do not.
    """
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    rank, spark = F.xxhash64("doc_id"), docs.sparkSession
    picked = [r for side, most in ((0, most_clean), (1, most_toxic)) for r in known.where(F.col("y") == side).orderBy(rank, "doc_id").limit(most).collect()]
    if len({r["y"] for r in picked}) < 2:
        return None
    few = spark.createDataFrame([(r["doc_id"], r["y"]) for r in picked], "doc_id long, y int")
    rows = stored(with_text(docs, id_col, text_col).join(F.broadcast(few), "doc_id").select("doc_id", "text", "y", F.xxhash64("text").alias("key")), "toxic-rows")
    keys = rows.groupBy("key").agg(F.max("y").alias("y"), F.min(rank).alias("rank")).orderBy("rank", "key").limit(most_toxic + most_clean).select("key", "y").collect()
    if len({r["y"] for r in keys}) < 2:
        return None
    once = spark.createDataFrame([tuple(r) for r in keys], "key long, y int")
    chosen = stored(rows.select("key", "text").join(F.broadcast(once), "key").groupBy("key", "y").agg(F.first("text").alias("text")).select("key", "text", "y"), "toxic-sample")
    discard(rows)
    return chosen


def in_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray]]:
    """key, text and label of the sample's rows, about a megabyte of text at a time."""
    for batch in batches:
        for i, j in slices(batch.column(1), 1 << 20):
            rows = batch.slice(i, j - i)
            yield np.asarray(rows.column(0)), pc.ascii_trim_whitespace(rows.column(1)), np.asarray(rows.column(2)) == 1


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_toxic: int = 1200, most_clean: int = 2400, window: int = 32, most_windows: int = 20_000) -> Model | None:
    """The model from at most ``most_toxic`` and ``most_clean`` labelled documents outside the held-out fold; None without two classes.

    Tasks read the sample's texts. To the driver come four hashes a text, the
    features of several texts, at most ``most_windows`` windows of ``window``
    words as feature numbers, and four figures a text: nothing of the length of texts.
    """
    chosen = sample(docs, labels, id_col, text_col, label_col, most_toxic, most_clean)
    if chosen is None:
        return None
    context = docs.sparkSession.sparkContext

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, texts, toxic in in_slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(toxic), pa.array(smallest_hashes(texts), pa.list_(pa.int64()))], ["key", "toxic", "low"])

    found = sorted(chosen.mapInArrow(tidy(hashed), "key long, toxic boolean, low array<long>").collect(), key=lambda r: r["key"])
    toxic = [r["toxic"] for r in found]
    alone = lone_documents([tuple(r["low"]) for r in found], toxic)
    rate = float(np.mean([toxic[i] for i in alone]))
    lone = context.broadcast(np.array(sorted(found[i]["key"] for i in alone), np.int64))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, texts, toxic in in_slices(batches):
            features, counts = feature_counts(texts, toxic, np.isin(key, lone.value))
            yield pa.RecordBatch.from_arrays([features, *[pa.array(c) for c in counts]], ["feature", "docs", "total", "bad"])

    sums = chosen.mapInArrow(tidy(counted), "feature string, docs long, total long, bad long").groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("docs", "total", "bad")])
    sums = stored(sums, "toxic-features")
    chance = float(np.log(sums.where("total > 0").count() + 1))
    bad, total = F.col("bad"), F.col("total")
    marks = F.coalesce(((bad - 0.5) / (total + 0.5) >= 0.7) & (bad * F.ln(F.try_divide(bad, total) / rate) >= chance), F.lit(False)) if rate else F.lit(False)  # mostly in toxic texts, and in too many for chance
    kept = sums.select("feature", "docs", marks.alias("mark")).where("docs >= 3 OR mark").orderBy("feature").collect()
    discard(sums)
    words = [r["feature"] for r in kept]
    shared = context.broadcast((words, np.array([False, *[r["mark"] for r in kept]])))
    half = most_windows // 2

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, marked = pa.array(shared.value[0], pa.string()), shared.value[1]
        for key, texts, toxic in in_slices(batches):
            number, tokens, bounds = word_codes(texts, vocabulary)
            target = marked[number].any(axis=0)[tokens] & np.repeat(toxic, np.diff(bounds))
            cuts, rank = windows(key, bounds, window)
            if not len(rank):
                continue
            hot = np.add.reduceat(target, cuts[:-1]) > 0
            few = np.sort(np.concatenate([at[np.argsort(rank[at], kind="stable")[:half]] for at in (np.flatnonzero(hot), np.flatnonzero(~hot))]))
            take = np.concatenate([np.arange(cuts[i], cuts[i + 1]) for i in few])
            at = np.concatenate(([0], np.cumsum(np.diff(cuts)[few]))).astype(np.int32)
            codes = pa.ListArray.from_arrays(pa.array(at * len(number)), pa.array(np.ascontiguousarray(number[:, tokens[take]].T).ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(hot[few]), pa.array(rank[few]), codes, pa.ListArray.from_arrays(pa.array(at), pa.array(target[take]))], ["hot", "rank", "codes", "target"])

    every = stored(chosen.mapInArrow(tidy(cut), "hot boolean, rank long, codes array<int>, target array<boolean>"), "toxic-windows")
    parts = [every.where(F.col("hot") == side).orderBy("rank", "codes").limit(half).select("codes", "target").toArrow() for side in (True, False)]
    taken = pa.concat_tables(parts).combine_chunks()
    discard(every)
    if not len(taken):
        return None
    target = taken["target"].chunk(0) if taken["target"].num_chunks else taken["target"]
    codes = taken["codes"].chunk(0).flatten()
    wb = np.concatenate(([0], np.cumsum(np.asarray(pc.list_value_length(target)).astype(np.int64))))
    y = np.asarray(target.flatten()).astype(float)
    codes = np.asarray(codes).reshape(len(y), -1).T
    del taken, parts
    emit, bias, step = fit_chain(codes, y, wb, len(words) + 1)
    release_memory()
    chain = context.broadcast((words, emit, bias, step))

    def layered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, emit, bias, step = chain.value
        vocabulary = pa.array(words, pa.string())
        for key, texts, toxic in in_slices(batches):
            number, tokens, bounds = word_codes(texts, vocabulary)
            p = marginals(emissions(number, tokens, bounds, emit, bias), bounds, step)
            z = layer_input(*document_features(p, bounds)[1:], bounds)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(toxic), pa.array(list(z), pa.list_(pa.float64()))], ["key", "toxic", "z"])

    rows = sorted(chosen.mapInArrow(tidy(layered), "key long, toxic boolean, z array<double>").collect(), key=lambda r: r["key"])
    layer = fit_layer(np.array([r["z"] for r in rows]), np.array([r["toxic"] for r in rows]))
    discard(chosen)
    return Model(words, emit, bias, step, layer)


def tag(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Score, expected toxic words, greatest marginal and offending spans of every document; ``keep`` passes columns through, the text among them."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(tuple(vars(model).values()) if model else None)  # plain values: unpickling needs no import of this module
    if keep:
        place = keep.index(text_col)  # the text goes to the tasks once, with its row
        base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"))
    else:
        base = with_text(docs, id_col, text_col)
    schema = SCHEMA + (f", row {base.schema['row'].dataType.simpleString()}" if keep else "")

    def spans(text: str, p: np.ndarray) -> list[dict]:
        out, last = [], -2
        hits = dict(zip(np.flatnonzero(p >= 0.5).tolist(), p[p >= 0.5].tolist(), strict=True))
        for i, m in enumerate(re.finditer(r"[^ \t\n\v\f\r]+", text)):
            if i in hits:
                if i == last + 1:
                    out[-1]["end"] = m.end()
                    out[-1]["marginal"] = max(out[-1]["marginal"], hits[i])
                else:
                    out.append({"start": m.start(), "end": m.end(), "marginal": hits[i]})
                last = i
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value) if shared.value else None
        vocabulary = pa.array(model.words if model else [], pa.string())
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))
        for batch in batches:
            every = pc.fill_null(batch.column(1).field(place), "") if keep else batch.column(1)
            for i, j in slices(every, 1 << 20):
                rows, texts = batch.slice(i, j - i), every.slice(i, j - i)
                if model is None:
                    score, expected, most, found = np.zeros(j - i), np.zeros(j - i), np.zeros(j - i), [[]] * (j - i)
                else:
                    trimmed = pc.ascii_trim_whitespace(texts)
                    number, tokens, bounds = word_codes(trimmed, vocabulary)
                    p = marginals(emissions(number, tokens, bounds, model.emit, model.bias), bounds, model.step)
                    expected, agreed, most = document_features(p, bounds)
                    score = 1 / (1 + np.exp(-np.clip(layer_input(agreed, most, bounds) @ model.layer, -30, 30)))
                    found = [spans(texts[k].as_py(), p[bounds[k] : bounds[k + 1]]) if most[k] >= 0.5 else [] for k in range(j - i)]
                columns = [rows.column(0), pa.array(score), pa.array(expected), pa.array(most), pa.array(found, kind)]
                names = ["doc_id", "score", "expected_toxic", "max_marginal", "spans"]
                if keep:
                    columns, names = [*columns, rows.column(1)], [*names, "row"]
                yield pa.RecordBatch.from_arrays(columns, names)
            del batch, every
            release_memory()

    return base.mapInArrow(tidy(run), schema)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document with ``held_out``, ``score`` and ``predicted``, learnt from the rows outside the held-out fold."""
    found = tag(docs, train(docs, labels))
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "expected_toxic", "spans")


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that score under the threshold, with the columns they came with."""
    columns = docs.columns
    kept = tag(docs, train(docs, labels), keep=tuple(columns)).where(F.col("score") < threshold)
    return kept.select([F.col(f"row.`{c}`").alias(c) for c in columns])
