"""Shared helpers of the text operators: tables, written intermediate results, word splitting, connected components."""
from __future__ import annotations

import re
import sys
import types
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitspark.session import scratch

WORD = r"[^\x20\x09-\x0D]+"
_MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_collectors: list[list[str]] = []


@contextmanager
def collecting() -> Iterator[list[str]]:
    """The paths that ``stored`` writes meanwhile."""
    paths: list[str] = []
    _collectors.append(paths)
    try:
        yield paths
    finally:
        _collectors.remove(paths)


def delete_paths(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def free_name(df: DataFrame, wish: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def stored(df: DataFrame, purpose: str, partition_by: list[str] | None = None) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back, so that lost executors repeat nothing before it."""
    path = scratch(df.sparkSession, purpose)
    for paths in _collectors[-1:]:
        paths.append(path)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """Rows handed to a Python worker at once: texts can be long, and the session's default of 10,000 of them fills an
    executor. A smaller setting of the session stays."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= rows:
        conf.set(key, str(rows))
    return df


def text_key(column: str) -> Column:
    """An identifier as text; a missing one counts as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def mix64(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits."""
    x = (x ^ (x >> np.uint64(30))) * _MIX2
    x = (x ^ (x >> np.uint64(27))) * _MIX1
    return x ^ (x >> np.uint64(31))


class WordIds(dict):
    """Word -> 64-bit hash as one-entry memory; forgets everything once it is large, results stay the same."""

    def __init__(self, most: int = 200_000):
        import xxhash

        super().__init__()
        self.most, self.digest = most, xxhash.xxh64_intdigest

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = self.digest(word.encode("utf-8", "surrogatepass"))
        return value

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: ASCII white space only; str.split() would also cut at other characters.
SPLIT = re.compile(r"[\x20\x09-\x0D]+")
_TO_SPACE = {c: " " for c in range(0x09, 0x0E)}
_TO_LOWER = _TO_SPACE | {c: chr(c + 32) for c in range(ord("A"), ord("Z") + 1)}


def worker_cache(name: str, make):
    """An object kept in the Python worker from task to task, so what it has learned is used again; asking for one of
    another name drops it."""
    home = sys.modules.setdefault("_text_worker_cache", types.ModuleType("_text_worker_cache"))
    if getattr(home, "name", None) != name:
        home.kept = None
        home.name, home.kept = name, make()
    return home.kept


def split_words(text: str | None, lower: bool = False) -> list[str]:
    """Maximal runs of characters other than space and U+0009 to U+000D; ``lower`` folds A-Z only."""
    if not text:
        return []
    if not lower or text.isascii():  # here the general methods do just this, and faster
        text = text.lower() if lower else text
        words = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ")
    else:
        words = text.translate(_TO_LOWER).split(" ")
    return [w for w in words if w]


def window_hashes(ids: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` consecutive values; empty when there are fewer."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = ids[:n].copy()
    # doubling: runs of 1, 2, 4, ... are put together to any length in few passes
    parts, width, start = [], 1, 0
    level = mix64(ids + _MIX1)
    left = size
    while True:
        if left & width:
            parts.append((start, level))
            start += width
            left -= width
        if not left:
            break
        level = mix64(level[:-width] * _MIX1 + level[width:] * _MIX2 + np.uint64(width)) if len(level) > width else level[:0]
        width *= 2
    out[:] = np.uint64(size)
    for offset, level in parts:
        out = mix64(out * _MIX1 + level[offset:offset + n])
    return out


def components(edges: DataFrame, purpose: str = "components") -> DataFrame:
    """``node -> label``, the smallest node reachable; a row for every node of an edge ``a, b``.

    Each round sends every node to its smallest neighbour, follows these pointers to their ends by doubling, and goes
    on with the distinct edges between different ends. At least half of the nodes with edges left vanish per round.
    Sums per node are partial first and both sides of every join are written tables, so a node with very many edges
    is split by adaptive execution.
    """
    links = stored(edges.select("a", "b").where("a <> b").distinct(), purpose)
    steps = []
    while not links.isEmpty():
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("to")), purpose)
        while True:
            on = point.select(F.col("node").alias("_n"), F.col("to").alias("_t"))
            jumped = stored(point.join(on, point["to"] == on["_n"]).select("node", F.col("_t").alias("to"), (F.col("to") != F.col("_t")).alias("moved")), purpose)
            point = jumped.select("node", "to")
            if jumped.where("moved").isEmpty():
                break
        steps.append(point)
        pa, pb = (point.select(F.col("node").alias(f"_{x}"), F.col("to").alias(f"{x}2")) for x in "ab")
        links = stored(links.join(pa, F.col("a") == F.col("_a")).join(pb, F.col("b") == F.col("_b"))
                       .select(F.col("a2").alias("a"), F.col("b2").alias("b")).where("a <> b").distinct(), purpose)
    if not steps:
        kind = edges.schema["a"].dataType
        return edges.select(F.col("a").alias("node"), F.col("b").cast(kind).alias("label")).where(F.lit(False))
    found = steps[-1].select("node", F.col("to").alias("label"))
    for step in reversed(steps[:-1]):
        later = found.select(F.col("node").alias("_n"), "label")
        found = stored(step.join(later, F.col("to") == F.col("_n"), "left").select("node", F.coalesce("label", "to").alias("label")), purpose)
    return found
