"""Repeated passages by a sparse suffix array over words.

Suffixes are kept only at minimiser positions: in every run of ``passage`` words the start of the ``seed``-word run
with the smallest hash, a place that depends on the words alone, so equal passages keep equal places. The kept seeds of
all documents are sorted and each is compared with its neighbours. Around seeds that have an equal neighbour the match
is extended: every run of ``passage`` words that has the seed as its minimiser reaches some words to the left and some
to the right of it; these runs are sorted in turn and compared with their neighbours, and adjoining ones that match
grow into maximal spans. Sorting is by range of (hash, document), so a passage found in very many documents is spread
over tasks; only neighbours are ever compared.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, free_name, SPLIT, split_words, stored, window_hashes, WordIds, worker_cache

PASSAGE, SEED = 50, 34


def minimisers(seeds: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` seeds the position of its first smallest one."""
    runs = len(seeds) - width + 1
    out = np.empty(max(runs, 0), np.int64)
    for start in range(0, runs, 65536):
        view = np.lib.stride_tricks.sliding_window_view(seeds[start:start + 65536 + width - 1], width)[:65536]
        out[start:start + len(view)] = view.argmin(1) + np.arange(start, start + len(view))
    return out


def _rows(doc_type: pa.DataType, docs: list, counts: list[int], columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    ids = pa.array(docs, doc_type).take(pa.array(np.repeat(np.arange(len(docs)), counts)))
    arrays = [ids] + [pa.array(np.concatenate(parts) if parts else [], kind) if kind != pa.binary() else pa.array(parts, kind) for parts, kind in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, names=["doc_id", *columns])


def _seeds(docs: DataFrame, passage: int, seed: int) -> DataFrame:
    """``doc_id, key``: distinct seed hashes kept of each document."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("key", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = worker_cache("words", WordIds)
        for batch in batches:
            ids, counts, keys = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = split_words(text.as_py())
                if len(found) < passage:
                    continue
                all_seeds = window_hashes(words.of(found), seed)
                kept = np.unique(all_seeds[np.unique(minimisers(all_seeds, passage - seed + 1))])
                ids.append(doc), counts.append(len(kept)), keys.append(kept.view(np.int64))
            yield _rows(batch.schema.field(0).type, ids, counts, {"key": (keys, pa.int64())})

    return docs.mapInArrow(run, schema)


def _runs(docs: DataFrame, passage: int, seed: int) -> DataFrame:
    """``doc_id, key, start, more``: distinct passage-long runs whose minimiser is in ``keys``; ``more`` packs further starts."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("key", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("more", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = worker_cache("words", WordIds)
        for batch in batches:
            ids, counts, keys, starts, more = [], [], [], [], []
            for doc, text, repeated in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                hashes = words.of(split_words(text.as_py()))
                all_seeds = window_hashes(hashes, seed)
                place = minimisers(all_seeds, passage - seed + 1)
                wanted = np.flatnonzero(np.isin(all_seeds[place], repeated.values.to_numpy().view(np.uint64)))
                value = window_hashes(hashes, passage)[wanted]
                order = np.argsort(value, kind="stable")
                value, where = value[order], wanted[order].astype("<i4")
                first = np.flatnonzero(np.r_[True, value[1:] != value[:-1]]) if len(value) else np.empty(0, np.int64)
                ends = np.r_[first[1:], len(value)] if len(first) else first
                ids.append(doc), counts.append(len(first)), keys.append(value[first].view(np.int64)), starts.append(where[first])
                more += [where[a + 1:b].tobytes() if b - a > 1 else None for a, b in zip(first.tolist(), ends.tolist())]
            yield _rows(batch.schema.field(0).type, ids, counts, {"key": (keys, pa.int64()), "start": (starts, pa.int32()), "more": (more, pa.binary())})

    return docs.mapInArrow(run, schema)


def equal_neighbours(rows: DataFrame, partitions: int | None = None) -> DataFrame:
    """Sorts ``rows`` by (``key``, ``doc_id``), drops repeated pairs, and keeps those whose neighbour has the same key.

    Adds ``later``: the neighbour before has it too, so a document with a smaller id holds the same key. The first and
    last row of each sorted partition are judged afterwards against the other partitions' ends.
    """
    spread = [F.col("key"), F.col("doc_id")]
    ordered = (rows.repartitionByRange(partitions, *spread) if partitions else rows.repartitionByRange(*spread)).sortWithinPartitions("key", "doc_id")
    names = rows.columns
    schema = T.StructType(rows.schema.fields + [T.StructField(n, T.BooleanType()) for n in ("before", "after", "first", "last")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_before, start = None, False, True

        def out(table: pa.Table, before: np.ndarray, after: np.ndarray, last: bool, start: bool) -> Iterator[pa.RecordBatch]:
            n = len(before)
            first_row, last_row = np.zeros(n, bool), np.zeros(n, bool)
            first_row[0], last_row[-1] = start, last
            keep = pa.array(before | after | first_row | last_row)
            for name, values in (("before", before), ("after", after), ("first", first_row), ("last", last_row)):
                table = table.append_column(name, pa.array(values))
            yield from table.filter(keep).combine_chunks().to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table])
            key = table.column("key").to_numpy()
            same = key[1:] == key[:-1]
            doc = table.column("doc_id").combine_chunks()
            again = np.r_[False, same & pc.equal(doc[1:], doc[:-1]).to_numpy(zero_copy_only=False)]
            if again.any():  # a repeated row of one document
                table = table.filter(pa.array(~again))
                key = key[~again]
                same = key[1:] == key[:-1]
            before = np.r_[held_before, same]
            n = len(key)
            if n > 1:
                yield from out(table.slice(0, n - 1), before[:-1], same, False, start)
                start = False
            held, held_before = table.slice(n - 1), bool(before[-1])
        if held is not None:
            yield from out(held, np.array([held_before]), np.array([False]), True, start)

    seen = stored(ordered.mapInArrow(run, schema), "suffix-neighbours")
    ends = seen.where("first OR last")  # two rows a partition at most
    line = Window.orderBy("key", "doc_id")
    ends = ends.withColumn("_p", F.lag("key").over(line)).withColumn("_n", F.lead("key").over(line))
    ends = ends.withColumn("before", F.when(F.col("first"), F.coalesce(F.col("_p") == F.col("key"), F.lit(False))).otherwise(F.col("before")))
    ends = ends.withColumn("after", F.when(F.col("last"), F.coalesce(F.col("_n") == F.col("key"), F.lit(False))).otherwise(F.col("after")))
    found = seen.where("NOT first AND NOT last").unionByName(ends.drop("_p", "_n")).where("before OR after")
    return found.select(*names, F.col("before").alias("later"))


def repeated_passages(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", passage: int = PASSAGE, seed: int = SEED) -> DataFrame:
    """Spans of ``passage`` or more words that other documents hold too.

    Words are runs of characters other than ASCII white space, compared as they are. A span is a maximal union of
    overlapping or adjoining runs of ``passage`` words, each found in two documents at least. ``later`` tells whether a
    document with a smaller id holds each run (the span can go) or this is the first one (it stays); spans of the two
    kinds may overlap. Repeats inside one document do not count. Rows with equal ids are one document; rows with a null
    id or a text that is null or shorter than ``passage`` words have no spans. Other columns are ignored.

    Result, a row per span: ``doc_id, start, words, later`` (positions in words, from 0).
    """
    slim = bounded_batches(docs).select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    # written once: range partitioning samples its input before it sorts
    alike = equal_neighbours(stored(_seeds(slim, passage, seed), "suffix-seeds"))
    holders = stored(alike.groupBy("doc_id").agg(F.collect_set("key").alias("keys")), "suffix-holders")  # its size decides whether texts move
    runs = equal_neighbours(stored(_runs(slim.join(holders, "doc_id"), passage, seed), "suffix-runs"))
    starts = runs.groupBy("doc_id", "later").agg(F.collect_list("start").alias("starts"), F.collect_list("more").alias("more"))
    schema = T.StructType([T.StructField("doc_id", slim.schema["doc_id"].dataType), T.StructField("start", T.LongType()), T.StructField("words", T.LongType()), T.StructField("later", T.BooleanType())])

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, begin, length = [], [], []
            for i, (one, more) in enumerate(zip(batch.column("starts"), batch.column("more"))):
                every = np.unique(np.concatenate([one.values.to_numpy(), *(np.frombuffer(m, "<i4") for m in more.as_py())])).astype(np.int64)
                cut = np.flatnonzero(np.diff(every) > passage)
                a, b = every[np.r_[0, cut + 1]], every[np.r_[cut, len(every) - 1]] + passage
                at += [i] * len(a)
                begin.append(a), length.append(b - a)
            pick = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pick), pa.array(np.concatenate(begin) if begin else [], pa.int64()), pa.array(np.concatenate(length) if length else [], pa.int64()), batch.column("later").take(pick)], names=["doc_id", "start", "words", "later"])

    return starts.select("doc_id", "starts", "more", "later").mapInArrow(spans, schema)


def without_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans (start, words) and the white space after them."""
    bounds = [m.span() for m in SPLIT.finditer(text)]
    # where each word begins, and where the text ends
    begins, at = [], 0
    for a, b in bounds:
        if a > at or (not begins and a > 0):
            begins.append(at)
        at = b
    if at < len(text):
        begins.append(at)
    begins.append(len(text))
    out, done = [], 0
    for start, words in sorted(spans):
        a, b = begins[start], begins[min(start + words, len(begins) - 1)]
        if a > done:
            out.append(text[done:a])
        done = max(done, b)
    out.append(text[done:])
    return "".join(out)


def cut_repeats(docs: DataFrame, spans: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Documents without their later spans; a document left without words goes. All columns stay."""
    parts, owner, made = (free_name(docs, n) for n in ("_spans", "_doc", "_text_left"))
    cut = spans.where("later").groupBy(F.col("doc_id").alias(owner)).agg(F.collect_list(F.struct("start", "words")).alias(parts))
    cut = stored(cut, "suffix-cuts")  # its size decides whether texts move

    @F.pandas_udf("string")
    def rest(texts: pd.Series, parts: pd.Series) -> pd.Series:
        return pd.Series([t if p is None or t is None else without_words(t, [(s["start"], s["words"]) for s in p]) for t, p in zip(texts, parts)])

    joined = docs.join(cut, F.col(id_column) == F.col(owner), "left")
    left = joined.withColumn(made, F.when(F.col(parts).isNull(), F.col(text_column)).otherwise(rest(F.col(text_column), F.col(parts))))
    left = left.where(F.col(parts).isNull() | F.col(made).rlike(r"[^\x20\x09-\x0D]"))
    return left.select(*[F.col(made).alias(c) if c == text_column else F.col(c) for c in docs.columns])
