"""Harmonic packing of token sequences.

Lengths fall into reciprocal-capacity classes: class k holds pieces of which k, and no more, fit into one sequence.
Every worker keeps one open sequence per class and closes it after exactly k pieces, so workers need nothing from
each other: no shuffle, no sort, and memory for one open sequence per class.
"""
from __future__ import annotations

import os
import sys
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import bounded_batches, worker_cache

LONGEST_KEPT = 64  # characters of a run that is remembered
if array("I").itemsize != 4 or sys.byteorder != "little":
    raise ImportError("token ids are packed as this machine's unsigned integers, which must be little-endian and of 32 bits")


class WordTokens:
    """Token ids, as packed little-endian 32-bit integers, of texts cut at plain spaces.

    The tokenizer handles each run of non-space characters by itself, so the ids of a run are looked up once. A run
    of Latin letters with ASCII punctuation after it is put together from its two parts.
    """

    def __init__(self, path: str, most: int = 200_000):
        import re

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.runs, self.parts = Remembered(most, self._run), Remembered(most, self._encode)
        self.two = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)").fullmatch

    def _encode(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _run(self, run: str) -> bytes:
        cut = self.two(run)
        if cut and "<|" not in run:
            return self.parts[cut[1].lower()] + (self.parts[cut[2]] if cut[2] else b"")
        return self._encode(run) if run else b""

    def __call__(self, text: str | None) -> bytes:
        return b"".join(map(self.runs.__getitem__, text.replace("\n", " ").split(" "))) if text else b""


class Remembered(dict):
    """Values of ``make`` for short texts, in two generations of ``most`` each: a full young one becomes the old one, and what is
    used again moves over."""

    def __init__(self, most: int, make: Callable[[str], bytes]):
        super().__init__()
        self.most, self.make, self.old = most, make, {}

    def __missing__(self, text: str) -> bytes:
        found = self.old.get(text)
        if found is None:
            found = self.make(text)
        if len(text) <= LONGEST_KEPT:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[text] = found
        return found


def cut_plan(length: int, capacity: int, slack: float) -> list[tuple[int, int]]:
    """Pieces (length, class) of a rest below ``capacity``: whole if its class wastes at most ``slack`` of a sequence,
    else the largest exact share of the next class is cut off first."""
    out = []
    while length:
        k = capacity // length
        if k * length >= capacity * (1 - slack):
            out.append((length, k))
            break
        share = capacity // (k + 1)
        out.append((share, k + 1))
        length -= share
    return out


def powers(length: int) -> list[int]:
    """The length as a sum of powers of two, largest first."""
    return [1 << b for b in range(length.bit_length() - 1, -1, -1) if length >> b & 1]


def harmonic_pack(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text", end_id: int = 1,
                  capacity: int = 2048, slack: float = 1 / 64, remembered: int = 200_000) -> DataFrame:
    """Packs all documents into sequences of at most ``capacity`` tokens.

    A document's tokens are its ids without special tokens, then ``end_id``; a null or empty text has the end id alone.
    Full sequences of a document stand by themselves; the rest is cut by ``cut_plan``. What is still open at a worker's
    end is laid end to end into sequences of full capacity and a last few whose lengths are powers of two, which need
    no padding. ``capacity`` must be a power of two. Repeated rows and repeated or null document ids are packed as
    separate documents; other columns are ignored; an empty table gives no rows. ``remembered``: distinct runs (and parts of
    runs) of up to 64 characters whose ids a worker keeps in each of two generations, about 200 bytes apiece.

    Result, a row per piece: ``doc_id, start, length, ids`` (packed little-endian 32-bit), ``doc_tokens, sequence_id,
    offset``. Sequence ids are the partition number times 2^40 plus a counter.
    """
    slim = bounded_batches(docs).select(id_column, text_column)
    schema = T.StructType([
        T.StructField("doc_id", slim.schema[id_column].dataType), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
        T.StructField("ids", T.BinaryType()), T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = worker_cache(f"tokens {remembered} {tokenizer}", lambda: WordTokens(tokenizer, remembered))
        plans = [cut_plan(n, capacity, slack) for n in range(capacity)]
        end, sequence = np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId() << 40
        bins: dict[int, list] = {}  # class -> [sequence id, tokens so far, pieces]
        id_type = None
        full = 256 * capacity * 4

        def table(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [[]] * 7
            kinds = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            id_type = batch.schema.field(0).type
            rows, held = [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                tokens = encode(text.as_py()) + end
                total = len(tokens) // 4
                at = 0
                while total - at >= capacity:
                    rows.append((doc, at, capacity, tokens[at * 4:(at + capacity) * 4], total, sequence, 0))
                    sequence += 1
                    at += capacity
                for size, k in plans[total - at]:
                    piece = (doc, at, size, tokens[at * 4:(at + size) * 4], total)
                    at += size
                    if k == 1:
                        rows.append((*piece, sequence, 0))
                        sequence += 1
                        continue
                    pieces = bins.setdefault(k, [])
                    pieces.append(piece)
                    if len(pieces) == k:
                        offset = 0
                        for p in pieces:
                            rows.append((*p, sequence, offset))
                            offset += p[2]
                        sequence += 1
                        pieces.clear()
                held += len(tokens)
                if held >= full:
                    yield table(rows)
                    rows, held = [], 0
            yield table(rows)
        rest = [p for k in sorted(bins) for p in bins[k]]
        if rest:
            left = sum(p[2] for p in rest)
            rooms = iter([capacity] * (left // capacity) + powers(left % capacity))
            room, offset, rows = next(rooms), 0, []
            for doc, start, size, ids, total in rest:
                done = 0
                while done < size:
                    if offset == room:
                        room, offset, sequence = next(rooms), 0, sequence + 1
                    part = min(size - done, room - offset)
                    rows.append((doc, start + done, part, ids[done * 4:(done + part) * 4], total, sequence, offset))
                    done += part
                    offset += part
            yield table(rows)

    return slim.mapInArrow(run, schema)
