"""Near-duplicate documents: MinHash bands for candidates, odd sketches to judge them, full shingle sets to confirm.

A document's MinHash sample is folded into a parity bitmap: each (position, minimum) flips one bit. The bits in which
two bitmaps differ tell how many minima differ, precisely so where similarity is high; pairs of one band whose
estimate lies clearly under the threshold are not looked at again. The others are confirmed on their shingle sets.

Only components are asked for. A band's group is first compared with its most central member (the one that meets most
others over all bands). Groups that still span several components are cut into blocks; tasks compare the sketches of
two blocks at a time and put out the likely pairs between different components alone, each member's best one in a
first round and all that are left and not yet judged in a second. A pair is compared in the first band that it shares
only. So every likely pair is confirmed once or lies within one component already, and a group is never expanded into
rows of all its pairs.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, WordIds, components, mix64, split_words, stored, window_hashes, worker_cache

PERMUTATIONS, BANDS, BAND_ROWS, BITS = 240, 20, 6, 1024
BLOCK, VOLUME = 384, 400_000  # members, and shingles of their sets, that are compared in one task with as many others
MARGIN = 0.11  # more than four deviations of the sketch's estimate at similarity 0.85


def bands_of(percent: int) -> int:
    """Bands of ``BAND_ROWS`` minima. A pair of similarity s shares none of b with chance (1 - s^6)^b: 0.008 % at 0.85 with
    ``BANDS``; under 85 all minima make bands, which miss 0.0005 % at 0.80."""
    return BANDS if percent >= 85 else PERMUTATIONS // BAND_ROWS


def shingle_set(ids: np.ndarray, size: int) -> np.ndarray:
    """Ascending distinct shingle hashes; fewer words than ``size`` make one shingle, none make none."""
    if not len(ids):
        return np.empty(0, np.uint64)
    return np.unique(window_hashes(ids, min(size, len(ids))))


class Signer:
    """Band keys (from the first minima) and odd sketch (of all minima) of a shingle set."""

    def __init__(self, bands: int = BANDS):
        self.bands = bands
        rng = np.random.default_rng(20)
        self.factor = rng.integers(0, 1 << 31, PERMUTATIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.shift = rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32)
        self.places = mix64(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64))
        self.band_ids = np.arange(1, bands + 1, dtype=np.uint64)

    def __call__(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = None
        for start in range(0, len(shingles), 1024):
            x = (shingles[start:start + 1024] >> np.uint64(32)).astype(np.uint32)
            part = (x[:, None] * self.factor + self.shift).min(0)
            low = part if low is None else np.minimum(low, part)
        low = low.astype(np.uint64)
        keys = self.band_ids.copy()
        for column in low[:self.bands * BAND_ROWS].reshape(self.bands, BAND_ROWS).T:
            keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + column)
        bit = mix64(low ^ self.places) % np.uint64(BITS)
        parity = (np.bincount(bit.astype(np.int64), minlength=BITS) & 1).astype(np.uint8)
        return keys.view(np.int64), np.packbits(parity, bitorder="little").view(np.int64)


def _features(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """``doc_id, n, print`` (of the whole set), ``bands, sketch``."""
    import xxhash

    count = bands_of(percent)
    schema = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n", T.LongType()), T.StructField("print", T.BinaryType()),
        T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sketch", T.ArrayType(T.LongType())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, sign = worker_cache("words", WordIds), Signer(count)
        for batch in batches:
            n, prints, bands, sketches = [], [], [], []
            for text in batch.column(1):
                shingles = shingle_set(words.of(split_words(text.as_py(), lower=True)), size)
                n.append(len(shingles))
                if len(shingles):
                    keys, sketch = sign(shingles)
                    prints.append(xxhash.xxh3_128_digest(shingles.tobytes()))
                    bands.append(keys)
                    sketches.append(sketch)
                else:
                    prints.append(None), bands.append(None), sketches.append(None)
            arrays = [batch.column(0), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n", "print", "bands", "sketch"])

    return docs.mapInArrow(run, schema)


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """``rep`` (the set's fingerprint), ``shingles``."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = worker_cache("words", WordIds)
        for batch in batches:
            sets = [shingle_set(words.of(split_words(t.as_py(), lower=True)), size) for t in batch.column(0)]
            prints = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(prints, pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["rep", "shingles"])

    return docs.select("text").mapInArrow(run, "rep binary, shingles array<long>")


def estimate(a: Column, b: Column) -> Column:
    """Similarity from the bits in which two odd sketches differ; saturated sketches count as unlike."""
    apart = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x)
    share = 1 - 2 * apart / F.lit(float(BITS))
    return F.when(share > 0, 1 + F.lit(BITS / (4 * PERMUTATIONS)) * F.log(share)).otherwise(F.lit(0.0))


def block_links(block: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links ``a, b`` that join the labels of two blocks (or of one), confirmed on the full sets.

    Pairs of different labels whose estimate allows a link and that share no earlier band are taken from the most alike
    on; a pair whose labels earlier links have joined is passed over. So there are fewer links than members, and the
    labels they join are those that all linked pairs of the blocks would join."""
    first, second = block["bi"].iloc[0], block["bj"].iloc[0]
    rows, cols = block[block["block"] == first], block[block["block"] == second]

    def words(name: str) -> list[np.ndarray]:
        return [np.array(d[name].tolist(), np.int64).view(np.uint64).reshape(len(d), -1) for d in (rows, cols)]

    x, y = words("sketch")
    apart = np.zeros((len(rows), len(cols)), np.int32)
    for i in range(x.shape[1]):
        apart += np.bitwise_count(x[:, i, None] ^ y[None, :, i])
    share = 1 - 2 * apart / BITS
    value = 1 + BITS / (4 * PERMUTATIONS) * np.log(np.maximum(share, 1e-9))
    n, m = rows["n"].to_numpy(), cols["n"].to_numpy()
    fits = (value >= percent / 100 - MARGIN) & (np.minimum(n[:, None], m) * 100 >= np.maximum(n[:, None], m) * percent)
    label = {name: k for k, name in enumerate(block["label"].unique())}
    p, q = (np.array([label[v] for v in d["label"]], np.int64) for d in (rows, cols))
    fits &= p[:, None] != q[None, :]
    here = np.uint64(int(block["key"].iloc[0]) % (1 << 64))
    x, y = words("bands")
    for band in range(x.shape[1]):
        if len(x) and x[0, band] == here:  # a key holds its band's number, so all members have it at this place
            break
        fits &= x[:, band, None] != y[None, :, band]
    i, j = np.nonzero(fits)
    order = np.argsort(-value[i, j], kind="stable")
    root = np.arange(len(label))

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    links = []
    a, b, sa, sb = rows["rep"].to_numpy(), cols["rep"].to_numpy(), rows["shingles"].to_numpy(), cols["shingles"].to_numpy()
    for r, c in zip(i[order], j[order]):
        u, v = top(p[r]), top(q[c])
        if u != v:
            common = len(np.intersect1d(sa[r], sb[c], assume_unique=True))
            if common * 100 >= (n[r] + m[c] - common) * percent:
                root[u] = v
                links.append((min(a[r], b[c]), max(a[r], b[c])))
    return pd.DataFrame({"a": [u for u, _ in links], "b": [v for _, v in links]})


def _compare(percent: int):
    return lambda block: block_links(block, percent)


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", percent: int = 85, size: int = 5) -> DataFrame:
    """Links documents with ``100 * |A & B| >= percent * |A | B|`` of their distinct ``size``-word shingles.

    Words are runs of characters other than ASCII white space, A-Z folded. A text with fewer words is one shingle; a
    null or wordless text has none and links with nothing. A row without an id links with nothing; rows with equal ids are
    compared each by its own text. Other columns are ignored; an empty table gives no rows. Equal sets, told by a 128-bit
    fingerprint, are one representative while candidates are searched. ``percent`` is 80 or more, for the bands.
    A pair just at the threshold that no other document links is missed by the bands with chance 0.008 % at 85 and
    0.0005 % at 80 (``bands_of``).

    Result, a row per input row: ``doc_id, n_shingles, component_id`` (smallest id reachable), ``kept``.
    """
    if not 80 <= percent <= 100:
        raise ValueError("the bands are made for similarities of 80 to 100 percent")
    slim = bounded_batches(docs).select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    features = stored(_features(slim, size, percent), "minhash-features")
    usable = features.where("n > 0 AND doc_id IS NOT NULL")
    reps = stored(usable.groupBy(F.col("print").alias("rep")).agg(
        F.min("doc_id").alias("first_id"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "minhash-reps")
    buckets = reps.select("rep", "n", F.explode("bands").alias("key"))
    crowded = stored(buckets.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("volume")).where("members > 1"), "minhash-crowded")
    members = stored(buckets.drop("n").join(crowded, "key"), "minhash-members")
    weights = stored(members.groupBy("rep").agg(F.sum("members").alias("weight")), "minhash-weights")
    leads = members.join(weights, "rep").groupBy("key").agg(F.max(F.struct("weight", "rep"))["rep"].alias("lead"))
    leads = stored(leads, "minhash-leads")
    sketches = stored(reps.join(weights.select("rep"), "rep"), "minhash-sketches")
    # narrow tables of their own, so that their true size decides whether the texts have to move
    wanted = stored(sketches.select(F.col("first_id").alias("doc_id")).distinct(), "minhash-wanted")
    involved = stored(sketches.select("rep"), "minhash-involved")
    sets = _sets(slim.join(wanted, "doc_id"), size).join(involved, "rep", "left_semi")
    if not features.join(wanted, "doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("times")).where("times > 1").isEmpty():
        sets = sets.dropDuplicates(["rep"])  # an id with several rows gives a set for each
    sets = stored(sets, "minhash-sets")

    star = members.join(leads, "key").where("rep <> lead")
    star = star.select(F.least("lead", "rep").alias("a"), F.greatest("lead", "rep").alias("b")).distinct()
    s = {x: sketches.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")) for x in "ab"}
    likely = star.join(s["a"], "a").join(s["b"], "b")
    likely = likely.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent).where(estimate(F.col("sa"), F.col("sb")) >= percent / 100 - MARGIN)
    likely = stored(likely.select("a", "b", "na", "nb"), "minhash-likely")
    full = {x: sets.select(F.col("rep").alias(x), F.col("shingles").alias(f"h{x}")) for x in "ab"}
    common = likely.join(full["a"], "a").join(full["b"], "b").withColumn("c", F.size(F.array_intersect("ha", "hb")))
    links = stored(common.where(F.col("c") * 100 >= (F.col("na") + F.col("nb") - F.col("c")) * percent).select("a", "b"), "minhash-links")
    labels = components(links, "minhash-labels")
    # what the links to each group's lead have not joined is compared block by block
    known = members.where("members > 2").join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    known = stored(known, "minhash-known")
    mixed = stored(known.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l <> h").select("key"), "minhash-mixed")
    if not mixed.isEmpty():
        blocks = F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("volume") / VOLUME)).cast("int")
        active = known.join(mixed, "key").join(sketches.select("rep", "n", "sketch", "bands"), "rep").join(sets, "rep")
        active = active.withColumn("block", F.pmod(F.xxhash64("rep"), blocks).cast("int"))
        active = active.withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        active = active.select("key", "rep", "label", "n", "sketch", "bands", "shingles", "block", F.least("block", "_other").alias("bi"), F.greatest("block", "_other").alias("bj"))
        more = stored(active.groupBy("key", "bi", "bj").applyInPandas(_compare(percent), "a binary, b binary"), "minhash-links")
        if not more.isEmpty():
            labels = components(links.union(more), "minhash-labels")
    joined = reps.select("rep", "first_id").join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    smallest = joined.groupBy("label").agg(F.min("first_id").alias("component_id"))
    of_rep = stored(joined.join(smallest, "label").select(F.col("rep").alias("print"), "component_id"), "minhash-result")
    out = features.join(of_rep, "print", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
