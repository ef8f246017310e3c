"""SentencePiece encoding and decoding for merge-type vocabularies.

A text is written with U+2581 for every space and in front, and its characters are joined pair by pair: an agenda holds the
adjacent pairs whose join is a piece, and the pair of the best score, of equal ones the leftmost, is joined next. No join
can cross two characters that stand next to each other in no piece, so a text falls into units that are encoded on their
own and remembered by the worker. Units met for the first time are also encoded by the sentencepiece library, batch by
batch, and any difference stops the job. Ids are decoded by the library.
"""
from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .common import free_name, worker_cache

SPACE = "▁"
BREAK = "\n"  # in no piece but its own byte, so what follows it is encoded as if it stood alone
LONGEST_KEPT = 64  # characters of a unit that is remembered
PLACES = 1 << 32  # characters of a unit at most
UNITS_AT_ONCE = 200_000  # units of a text that are put together and decoded at once


class Vocabulary:
    """Pieces of a sentencepiece model file that merges pairs, falls back to bytes and leaves texts as they are."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        with open(path, "rb") as f:
            data = f.read()
        model = proto.ModelProto()
        model.ParseFromString(data)
        kinds = {p.type for p in model.pieces}
        rules = model.normalizer_spec
        if model.trainer_spec.model_type != proto.TrainerSpec.BPE or kinds - {1, 2, 3, 6} or 6 not in kinds:
            raise ValueError("a merge-type vocabulary with byte fallback and without own or unused symbols is needed")
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.add_dummy_prefix or model.denormalizer_spec.precompiled_charsmap:
            raise ValueError("a vocabulary that changes nothing in a text but puts a space in front is needed")
        plain = [(i, p) for i, p in enumerate(model.pieces) if p.type == 1]
        self.ids = {p.piece: i for i, p in plain}
        scores = {s: r for r, s in enumerate(sorted({p.score for _, p in plain}, reverse=True))}
        self.rank = {p.piece: scores[p.score] * PLACES for _, p in plain}
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        self.library = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.units = self._unit_pattern()
        if BREAK in self.ids:
            raise ValueError("a vocabulary without a piece for the line feed is needed")
        self.coded = {p: np.int32(i).tobytes() for p, i in self.ids.items()}
        self.lead = self.alone(SPACE) + self.alone(BREAK)
        #: A piece to decode behind, where a text is decoded in parts: the library drops a space at the very front.
        self.anchor = next(p for p in self.ids if len(p) == 1 and p.isalpha())

    def _unit_pattern(self) -> re.Pattern:
        """Runs of characters that joins cannot leave, taken from the pairs of characters inside the pieces."""
        pairs = {p[i:i + 2] for p in self.ids for i in range(len(p) - 1)}
        inside = {c for pair in pairs for c in pair} - {SPACE}
        kind = lambda c: "s" if c == SPACE else "w" if c.isalpha() else "o"
        steps = {kind(a) + kind(b) for a, b in pairs}
        group = lambda chars: "".join(map(re.escape, sorted(chars)))
        words, others = group(c for c in inside if c.isalpha()), group(c for c in inside if not c.isalpha())
        if steps & {"ws", "os"}:
            pattern = f"[{SPACE}{words}{others}]+"
        elif steps & {"wo", "ow"} or not words or not others:
            pattern = f"{SPACE}*[{words}{others}]+|{SPACE}+"
        else:
            pattern = f"{SPACE}*[{words}]+|{SPACE}*[{others}]+|{SPACE}+"
        return re.compile(pattern + "|.", re.DOTALL)

    def alone(self, symbol: str) -> bytes:
        """The id of a piece, or those of its bytes, as 32-bit integers."""
        found = self.ids.get(symbol)
        return np.array([found] if found is not None else [self.bytes[b] for b in symbol.encode()], np.int32).tobytes()

    def merge(self, unit: str) -> bytes:
        """Ids of one unit. The agenda holds rank and place of a pair as one number; a pair that is no longer what it was
        when it came on the agenda is passed over."""
        n, rank, place = len(unit), self.rank.get, PLACES - 1
        symbols, before, after = list(unit), list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [r + i for i in range(n - 1) if (r := rank(unit[i:i + 2])) is not None]
        heapq.heapify(agenda)
        while agenda:
            key = heapq.heappop(agenda)
            i = key & place
            j = after[i]
            if j >= n or not symbols[i]:
                continue
            joined = symbols[i] + symbols[j]
            if rank(joined) != key - i:
                continue
            symbols[i], symbols[j] = joined, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank(joined + symbols[k])) is not None:
                    heapq.heappush(agenda, r + i)
            h = before[i]
            if h >= 0 and (r := rank(symbols[h] + joined)) is not None:
                heapq.heappush(agenda, r + h)
        return b"".join([self.coded.get(s) or self.alone(s) for s in symbols if s])


class Memory(dict):
    """Unit -> ids. Two generations: once the young one is full it becomes the old one, and what is used again moves over."""

    def __init__(self, vocabulary: Vocabulary, most: int = 300_000):
        super().__init__()
        self.vocabulary, self.most, self.old, self.fresh = vocabulary, most, {}, []

    def __missing__(self, unit: str) -> bytes:
        found = self.old.get(unit)
        if found is None:
            found = self.vocabulary.merge(unit)
            self.fresh.append((unit, found))
        if len(unit) <= LONGEST_KEPT:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[unit] = found
        return found

    def check(self) -> None:
        """Holds the units met since the last call against the library."""
        lead, library = self.vocabulary.lead, self.vocabulary.library
        theirs = library.encode([BREAK + u.replace(SPACE, " ") for u, _ in self.fresh], num_threads=1)
        for (unit, mine), other in zip(self.fresh, theirs):
            if np.array(other, np.int32).tobytes() != lead + mine:
                raise ValueError(f"the library encodes {unit[:100]!r} otherwise than {np.frombuffer(mine, np.int32)[:20].tolist()}")
        self.fresh = []

    def parts(self, text: str) -> Iterator[np.ndarray]:
        """Ids of a text, part by part; nothing for an empty text."""
        if not text:
            return
        text = SPACE + text.replace(" ", SPACE)
        find = self.vocabulary.units
        units = iter(find.findall(text)) if len(text) <= UNITS_AT_ONCE else (m.group() for m in find.finditer(text))
        while some := b"".join(map(self.__getitem__, islice(units, UNITS_AT_ONCE))):
            yield np.frombuffer(some, np.int32)
            if len(self.fresh) > UNITS_AT_ONCE:
                self.check()

    def decode(self, parts: list[np.ndarray]) -> str:
        library, anchor = self.vocabulary.library, self.vocabulary.anchor
        first = [library.decode(p.tolist()) for p in parts[:1]]
        return "".join(first + [library.decode([self.vocabulary.ids[anchor], *p.tolist()])[len(anchor):] for p in parts[1:]])


def encode(docs: DataFrame, model_path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds the ids of each whole text and the text decoded from them; no begin or end ids.

    A null text counts as empty and has no ids. A column of ``docs`` named like a new one is replaced. Every row is encoded,
    repeated ones too. An empty table gives an empty table. ``model_path`` is read by every worker.
    """
    kept = [f for f in docs.schema.fields if f.name not in (ids, decoded)]
    schema = StructType([*kept, StructField(ids, ArrayType(IntegerType(), False), False), StructField(decoded, StringType(), False)])
    source = docs.select(*[F.col(f"`{f.name}`") for f in kept], F.coalesce(F.col(text), F.lit("")).alias(free_name(docs, "_text_to_encode")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = worker_cache(f"pieces {model_path}", lambda: Memory(Vocabulary(model_path)))
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                rows = batch.slice(at, 100)
                found, texts = [], []
                for value in rows.column(rows.num_columns - 1):
                    parts = list(memory.parts(value.as_py()))
                    found.append(np.concatenate([np.empty(0, np.int32), *parts]))
                    texts.append(memory.decode(parts))
                memory.check()
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))
                columns = [rows.column(i) for i in range(rows.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*columns, lists, pa.array(texts, pa.string())], names=[f.name for f in schema.fields])

    return source.mapInArrow(run, schema)
