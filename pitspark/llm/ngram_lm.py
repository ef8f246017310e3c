"""Stupid-backoff scores of documents from n-gram counts over the whole corpus.

The count table is partitioned by n-gram hash. Documents fall into blocks by a hash of their id; a block explodes its
n-grams, counts them, and sends its distinct sorted hashes with their counts to the hash partitions, one row per block
and partition. There the counts of all blocks are summed, and each block gets its totals back in the same order: the
join of exploded n-grams with the count table, done on sorted arrays. The block then sums its documents' scores. A
word, however frequent, is one entry per block, so no key is hot. What is shuffled - texts, hashes and counts - is
compressed before, much closer than Spark's own codec does it.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, bounded_batches, split_words, text_key, window_hashes, worker_cache, WordIds

BLOCK_CHARS = 6_000_000
PART_KEYS = 3_000_000


def _squeeze(data: bytes) -> bytes:
    return pa.compress(data, codec="zstd", asbytes=True)


def _pack(values: np.ndarray) -> bytes:
    """Number of values, sizes of their byte planes, then the planes, each compressed by itself; a plane of zeros has no bytes."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    parts = [_squeeze(p.tobytes()) if p.any() else b"" for p in planes]
    return np.array([len(values), *map(len, parts)], "<u4").tobytes() + b"".join(parts)


def _unpack(data: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    n, *sizes = np.frombuffer(data, "<u4", width + 1).tolist()
    planes, at = np.zeros((width, n), np.uint8), 4 * (width + 1)
    for plane, size in zip(planes, sizes):
        if size:
            plane[:] = np.frombuffer(pa.decompress(data[at:at + size], n, codec="zstd", asbytes=True), np.uint8)
        at += size
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _pack_totals(totals: np.ndarray) -> bytes:
    """Most n-grams occur once: a bit each tells which occur more often, and only those have a number."""
    many = totals > 1
    return _pack(np.packbits(many)) + np.array([len(totals)], "<u4").tobytes() + _pack(totals[many])


def _unpack_totals(data: bytes) -> np.ndarray:
    size = 8 + int.from_bytes(data[4:8], "little")
    n = int.from_bytes(data[size:size + 4], "little")
    totals = np.ones(n, np.uint64)
    totals[np.unpackbits(_unpack(data[:size], np.uint8), count=n).astype(bool)] = _unpack(data[size + 4:], np.uint64)
    return totals


def _packed_text(text: str | None) -> bytes | None:
    raw = None if text is None else text.encode("utf-8", "surrogatepass")
    return None if raw is None else len(raw).to_bytes(8, "little") + _squeeze(raw)


def _text(data: bytes | None) -> str | None:
    size = 0 if data is None else int.from_bytes(data[:8], "little")
    return pa.decompress(data[8:], size, codec="zstd", asbytes=True).decode("utf-8", "surrogatepass") if size else None


def block_hashes(texts: pd.Series, order: int) -> tuple[list[np.ndarray], list[int]]:
    """Per order the hashes of all n-gram occurrences of a block, document after document, and words per document."""
    words = worker_cache("words", WordIds)
    ids = [words.of(split_words(t)) for t in texts]
    lengths = [len(x) for x in ids]
    flat = np.concatenate(ids or [np.empty(0, np.uint64)])
    left = np.repeat(np.cumsum(lengths, dtype=np.int64), lengths) - np.arange(len(flat))  # words up to the document's end
    hashes = [window_hashes(flat, n) for n in range(1, order + 1)]
    return [h[left[:len(h)] >= n] for n, h in enumerate(hashes, 1)], lengths


def block_grams(texts: pd.Series, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int], list[np.ndarray]]:
    """Sorted distinct n-gram hashes of a block, their counts, each occurrence's place, words per document, and the
    occurrences of every order: one long array over all documents, shorter documents adding none."""
    levels, lengths = block_hashes(texts, order)
    keys, place, counts = np.unique(np.concatenate(levels), return_inverse=True, return_counts=True)
    places = np.split(place, np.cumsum([len(x) for x in levels])[:-1])
    return keys, counts.astype(np.uint32), place, lengths, places


def _cut(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash partition of each sorted key and where partitions begin."""
    part = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    begin = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(keys) else np.empty(0, np.int64)
    return part, begin


def scored(lengths: list[int], levels: list[np.ndarray], total: float, alpha: float, least: int) -> tuple[list[float], list[list[int]]]:
    """Per document: the sum of log scores and how many words each order answered. ``levels[n]``: counts of (n+1)-grams."""
    order = len(levels)
    offsets = [np.r_[0, np.cumsum([max(0, n - k) for n in lengths])] for k in range(order)]
    sums, hits = [], []
    for d, n in enumerate(lengths):
        count = [levels[k][offsets[k][d]:offsets[k][d + 1]] for k in range(order)]
        score = np.log(count[0] / total)
        used = np.zeros(n, np.int64)
        tried = np.minimum(np.arange(n), order - 1)  # how many longer n-grams end at each word
        for k in range(1, order):
            if n > k:
                good = count[k] >= least
                value = np.log(count[k] / count[k - 1][:-1])
                score[k:] = np.where(good, value, score[k:])
                used[k:] = np.where(good, k, used[k:])
        score = score + (tried - used) * math.log(alpha)
        sums.append(float(score.sum()))
        hits.append([int((used == k).sum()) for k in range(order)])
    return sums, hits


def score(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", order: int = 3, alpha: float = 0.4, least: int = 2) -> DataFrame:
    """Scores every document by the corpus's own counts.

    Words are runs of characters other than ASCII white space, as they are. The score of a word is the relative frequency of the
    longest n-gram ending there that occurs ``least`` times or more in the corpus (an n-gram seen once is only the one
    being scored), times ``alpha`` for each longer one that failed; single words always count. Counts cover all rows.
    A null or wordless text scores 0 with no words. Rows with equal or null ids are scored one by one. Other columns
    are ignored; an empty table gives no rows. Hashes have 64 bits.

    Result: ``doc_id, n_words, log_score`` (sum of natural logs) and ``hits`` (words answered by order 1, 2, ...).
    """
    slim = bounded_batches(docs).select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    chars, words = slim.agg(F.sum(F.length("text")), F.sum(F.regexp_count("text", F.lit(WORD)))).first()
    blocks, parts = max(1, math.ceil((chars or 0) / BLOCK_CHARS)), max(1, math.ceil((words or 0) * order / PART_KEYS))

    @F.pandas_udf("binary")
    def packed(texts: pd.Series) -> pd.Series:
        return texts.map(_packed_text)

    block = F.pmod(F.xxhash64(text_key("doc_id"), F.length("text")), F.lit(blocks)).cast("int")
    dealt = slim.select("doc_id", block.alias("block"), packed("text").alias("text")).repartition("block")
    kind = docs.schema[id_column].dataType.simpleString()
    total = float(words or 1)

    def explode(block: pd.DataFrame) -> pd.DataFrame:
        levels, _ = block_hashes(block["text"].map(_text), order)
        every = np.sort(np.concatenate(levels))
        begin = np.flatnonzero(np.r_[True, every[1:] != every[:-1]]) if len(every) else np.empty(0, np.int64)
        keys, counts = every[begin], np.diff(begin, append=len(every)).astype(np.uint32)
        part, begin = _cut(keys, parts)
        rows = [(int(part[a]), _pack(np.diff(keys[a:b], prepend=np.uint64(0))), _pack(counts[a:b])) for a, b in zip(begin, np.r_[begin[1:], len(keys)])]
        out = pd.DataFrame(rows, columns=["part", "keys", "counts"])
        out.insert(0, "block", block["block"].iloc[0])
        return out

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        keys = [np.cumsum(_unpack(k, np.uint64), dtype=np.uint64) for k in rows["keys"]]
        counts = np.concatenate([_unpack(c, np.uint32) for c in rows["counts"]])
        _, place = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.bincount(place, counts).astype(np.uint64)[place]
        ends = np.cumsum([len(k) for k in keys])
        return pd.DataFrame({"block": rows["block"], "part": rows["part"], "totals": [_pack_totals(t) for t in np.split(totals, ends[:-1])]})

    def finish(block: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(block):
            return pd.DataFrame({"doc_id": [], "n_words": [], "log_score": [], "hits": []})
        keys, _, _, lengths, places = block_grams(block["text"].map(_text), order)
        answers = answers.sort_values("part")
        totals = np.concatenate([_unpack_totals(t) for t in answers["totals"]]) if len(answers) else np.empty(0)
        totals = totals.astype(np.float64)
        sums, hits = scored(lengths, [totals[p] for p in places], total, alpha, least)
        return pd.DataFrame({"doc_id": block["doc_id"], "n_words": lengths, "log_score": sums, "hits": hits})

    sent = dealt.groupBy("block").applyInPandas(explode, "block int, part int, keys binary, counts binary")
    answered = sent.groupBy("part").applyInPandas(add, "block int, part int, totals binary")
    return dealt.groupBy("block").cogroup(answered.groupBy("block")).applyInPandas(finish, f"doc_id {kind}, n_words long, log_score double, hits array<long>")
