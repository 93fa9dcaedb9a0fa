"""Packing: bounded-space online best fit.

Each input partition keeps a fixed number of open windows. A document is placed
whole into the open window that it fills best. When none has room and all
windows are in use, the fullest one is topped up with the head of the document
and emitted, and the rest of the document is placed in turn. At the end of the
partition the leftover windows are merged into full ones; the last, partial one
is cut into power-of-two sequences, which need no padding.

One narrow stage: no shuffle, memory bounded by the open windows and one batch.

Defined cases: a null or empty text is the closing id alone; repeated rows are
packed once each; a null id is kept; an empty table gives no piece; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import os
import re
import sys
import types
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from docfacts.llm.common import release_memory, tidy, with_text

#: Fixed values of the tokenised form.
WINDOW = 4096
END_ID = 2

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


#: The tokenizer's split pattern for ASCII and Latin-1 letters, and the characters that it covers.
PLAIN_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\[-`{-~]+"
PLAIN = r"[!-;=-~À-ÖØ-öø-ÿ]*"  # no "<", with which special tokens begin


def byte_letters() -> dict[int, str]:
    """How byte-level vocabularies write the characters up to U+00FF: printable bytes as themselves, others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in shown]
    letter = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(other)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(256)}


class WordEncoder:
    """Token ids of whole texts for byte-level BPE tokenizers with lower-casing that drop white space.

    Such a tokenizer treats the runs between ASCII white space independently, so
    each distinct run is encoded once and looked up from then on. Runs of ASCII
    and Latin-1 letters are split here and their parts go to the tokenizer's
    model; all others go through the whole tokenizer. ``cache_words`` bounds the
    memory; beyond it the cache starts anew.
    """

    def __init__(self, path: str, cache_words: int = 300_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the threads; the library's own would each hold memory
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.plain, self.split, self.letters = re.compile(PLAIN).fullmatch, re.compile(PLAIN_SPLIT).findall, byte_letters()
        self.cache_words = cache_words
        self.reset()

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        """This worker process's encoder, kept from task to task."""
        kept = sys.modules.setdefault("_docfacts_encoders", types.ModuleType("_docfacts_encoders")).__dict__
        if path not in kept:
            kept[path] = cls(path)
        return kept[path]

    def reset(self) -> None:
        self.slot: dict[str, int] = {}
        self.parts: dict[str, list[int]] = {}
        self.flat, self.ends = array("I"), array("q", [0])

    def keep(self, word: str, ids: list[int]) -> None:
        self.slot[word] = len(self.slot)
        self.flat.extend(ids)
        self.ends.append(len(self.flat))

    def learn(self, words: list[str]) -> None:
        slot, parts_of, known, tokenize = self.slot, self.split, self.parts, self.model.tokenize
        hard, flat, ends, begin = [], [], [], len(self.flat)
        for word in words:
            if word in slot:
                continue
            if word.isascii() and word.isalpha() and word.islower():
                parts = (word,)
            elif self.plain(word):
                parts = parts_of(word.lower())
            else:
                hard.append(word)
                continue
            for p in parts:
                ids = known.get(p)
                if ids is None:
                    ids = known[p] = [t.id for t in tokenize(p if p.isascii() else p.translate(self.letters))]
                flat += ids
            slot[word] = len(slot)
            ends.append(begin + len(flat))
        self.flat.extend(array("I", flat))
        self.ends.extend(array("q", ends))
        for i in range(0, len(hard), 512):
            for word, got in zip(hard[i : i + 512], self.tokenizer.encode_batch_fast(hard[i : i + 512], add_special_tokens=False), strict=True):
                self.keep(word, got.ids)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's ids begin (one entry more than texts)."""
        split = pc.ascii_split_whitespace(texts)
        bounds = np.asarray(split.offsets).astype(np.int64)
        coded = split.flatten().dictionary_encode()
        raw = coded.dictionary  # special tokens begin with "<" and keep their case
        words = pc.if_else(pc.match_substring(raw, "<"), raw, pc.ascii_lower(raw)).to_pylist()
        if max(len(self.slot), len(self.parts)) > self.cache_words:
            self.reset()
        self.learn(list(dict.fromkeys(words)))
        slots = np.fromiter(map(self.slot.__getitem__, words), np.int64, len(words))[np.asarray(coded.indices)]
        known = np.array(self.ends)
        start = known[slots]
        n = known[slots + 1] - start
        ends = np.concatenate(([0], np.cumsum(n)))
        ids = np.array(self.flat)[np.repeat(start - ends[:-1], n) + np.arange(ends[-1])]
        return ids, ends[bounds - bounds[0]]


class Packer:
    """The open windows of one partition; a piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, window: int, open_windows: int, first_id: int):
        self.window, self.most, self.next_id = window, open_windows, first_id
        self.free: list[tuple[int, int]] = []  # of the open windows, least room first
        self.held: dict[int, list[tuple]] = {}
        self.serial = 0
        self.out: list[tuple] = []
        self.out_tokens = 0

    def emit(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.out.append((doc, start, len(ids), ids.tobytes(), total, self.next_id, at))
            at += len(ids)
        self.out_tokens += at
        self.next_id += 1

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        total, start = len(ids), 0
        while total - start >= self.window:  # a whole window of its own
            self.emit([(doc, start, ids[start : start + self.window], total)])
            start += self.window
        while start < total:
            need = total - start
            i = bisect_left(self.free, (need, -1))
            if i < len(self.free):  # best fit
                room, w = self.free.pop(i)
            elif len(self.free) < self.most:
                room, w = self.window, self.serial
                self.serial += 1
                self.held[w] = []
            else:  # none fits: top up the fullest, which leaves
                room, w = self.free.pop(0)
            take = min(need, room)
            self.held[w].append((doc, start, ids[start : start + take].copy(), total))
            start += take
            if take == room:
                self.emit(self.held.pop(w))
            else:
                insort(self.free, (room - take, w))

    def finish(self) -> None:
        """Merge the leftovers: the emptiest windows top up the fullest."""
        while len(self.free) > 1:
            room, w = self.free.pop(0)
            spare, v = self.free.pop()
            doc, start, ids, total = self.held[v].pop()
            keep = max(0, len(ids) - room)
            self.held[w].append((doc, start + keep, ids[keep:], total))
            if keep:
                self.held[v].append((doc, start, ids[:keep], total))
            moved = len(ids) - keep
            if room > moved:
                insort(self.free, (room - moved, w))
            else:
                self.emit(self.held.pop(w))
            if self.held[v]:
                insort(self.free, (spare + moved, v))
            else:
                del self.held[v]
        for room, w in self.free:
            pieces, left = self.held.pop(w), self.window - room
            for bit in range(left.bit_length() - 1, -1, -1):
                if not left >> bit & 1:
                    continue
                part, want = [], 1 << bit
                while want:
                    doc, start, ids, total = pieces.pop(0)
                    part.append((doc, start, ids[:want], total))
                    if len(ids) > want:
                        pieces.insert(0, (doc, start + want, ids[want:], total))
                    want -= len(part[-1][2])
                self.emit(part)
        self.free = []


def pack(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID, open_windows: int = 32) -> DataFrame:
    """Pieces of all documents with their token ids (``ids``: little-endian unsigned 32-bit).

    ``offset`` is gapless within a ``sequence_id``; ``start`` within a document.
    A sequence id is the partition number and a count, so a task run again after
    a lost executor gives the same ids for the same input split.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = None
        packer = Packer(window, open_windows, TaskContext.get().partitionId() << 32)
        end = np.array([end_id], np.uint32)

        def flush() -> pa.RecordBatch:
            columns = list(zip(*packer.out, strict=True))
            packer.out, packer.out_tokens = [], 0
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            encoder = encoder or WordEncoder.of(tokenizer_path)
            docs = batch.column(0).to_pylist()
            for i, j in slices(batch.column(1)):
                ids, at = encoder.encode(batch.column(1).slice(i, j - i))
                for k in range(j - i):
                    packer.add(docs[i + k], np.concatenate((ids[at[k] : at[k + 1]], end)))
                    if packer.out_tokens > 1_000_000:
                        yield flush()
            release_memory()
        packer.finish()
        if packer.out:
            yield flush()

    return with_text(df, id_col, text_col).mapInArrow(tidy(run), SCHEMA)


def slices(texts: pa.Array, most_bytes: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Runs of rows of about so many bytes of text, one row at least."""
    size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64))
    i = 0
    while i < len(size):
        done = size[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(size, done + most_bytes, side="right")))
        yield i, j
        i = j
