"""Language identification with a blended-spectrum string kernel.

A text is the set of its 1- to 3-grams over lower-cased letters and word gaps. The kernel of two texts is the number of
shared grams over the root of the product of the set sizes. Kernel ridge regression, one against the rest, is fitted in
the space of Nystroem landmarks; as the kernel is linear in the gram sets, landmarks and coefficients fold into one
weight per gram and language, and texts are scored by products of gram-set batches with that matrix.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, stored, text_key

DIMENSIONS = 1 << 14
_SPACE = 32


class Grams:
    """Gram sets of texts as positions in a table of ``DIMENSIONS`` cells."""

    def __init__(self, orders: tuple[int, ...] = (1, 2, 3)):
        self.orders = orders
        self.letter = np.fromiter((chr(i).isalpha() for i in range(0x10000)), bool, 0x10000)

    def letters(self, text: str) -> np.ndarray:
        """Code points of the lower-cased letters, one space for each gap and at both ends; empty without letters."""
        code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        low = code < 0x10000
        keep = self.letter[np.where(low, code, 0)]
        if not low.all():
            for i in np.flatnonzero(~low):
                keep[i] = chr(code[i]).isalpha()
        if not keep.any():
            return code[:0]
        code = np.where(keep, code, _SPACE)
        first = keep.copy()
        first[1:] |= keep[:-1]  # a gap's first cell stays
        code = code[first]
        edge = np.array([_SPACE], np.uint32)
        parts = [edge] if code[0] != _SPACE else []
        parts.append(code)
        if code[-1] != _SPACE:
            parts.append(edge)
        return np.concatenate(parts)

    def cells(self, text: str | None) -> np.ndarray:
        """Ascending distinct cells."""
        code = self.letters(text) if text else np.empty(0, np.uint32)
        if not len(code):
            return np.empty(0, np.int64)
        flag = np.zeros(DIMENSIONS, bool)
        gram = code.astype(np.uint64)
        base = gram
        for n in range(1, max(self.orders) + 1):
            if n > 1:
                if len(base) < n:
                    break
                gram = gram[:-1] * np.uint64(0x1000193) + base[n - 1:]
            if n in self.orders:
                flag[((gram + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(50)] = True
        return np.flatnonzero(flag)


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # cells x languages
    orders: tuple[int, ...] = (1, 2, 3)

    def predict(self, texts: pd.Series, batch: int = 256) -> tuple[list[str], np.ndarray]:
        grams, names, scores = Grams(self.orders), [], []
        for start in range(0, len(texts), batch):
            sets = [grams.cells(t) for t in texts.iloc[start:start + batch]]
            sizes = np.array([len(s) for s in sets])
            dense = np.zeros((len(sets), DIMENSIONS), np.float32)
            for i, s in enumerate(sets):
                dense[i, s] = 1
            value = (dense @ self.weights) / np.sqrt(np.maximum(sizes, 1))[:, None] if self.languages else np.zeros((len(sets), 1))
            best = value.argmax(1)
            for i, b in enumerate(best):
                known = self.languages and sizes[i]
                names.append(self.languages[b] if known else "und")
                scores.append(float(np.clip((value[i, b] + 1) / 2, 0, 1)) if known else 0.0)
        return names, np.array(scores, np.float64)


def fit(training: DataFrame, sample: int = 4096, landmarks: int = 256, ridge: float = 0.1, orders: tuple[int, ...] = (1, 2, 3)) -> LanguageModel:
    """Fits on ``training`` (``doc_id, text, lang``; rows with a null language are ignored).

    The sample is bounded: the documents with the smallest hash of their id in each language, ``sample`` in all shared
    evenly, one per language at least. Landmarks are the first of the sample, the languages in turn. Texts without
    letters teach nothing. Only the sample's gram sets, a bit per cell, reach the driver.
    """
    rows = bounded_batches(training).where(F.col("lang").isNotNull())
    names = sorted(r[0] for r in rows.select("lang").distinct().collect())
    if not names:
        return LanguageModel([], np.zeros((DIMENSIONS, 0), np.float32), orders)
    each = max(1, sample // len(names))
    turn = Window.partitionBy("lang").orderBy(F.xxhash64(text_key("doc_id")), text_key("doc_id"))
    chosen = stored(rows.select("doc_id", "lang").withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= each), "language-sample")
    texts = rows.select("doc_id", "lang", "text").join(chosen, ["doc_id", "lang"])

    def bits(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams = Grams(orders)
        for part in parts:
            sets = [grams.cells(t) for t in part["text"]]
            flags = []
            for s in sets:
                flag = np.zeros(DIMENSIONS, bool)
                flag[s] = True
                flags.append(np.packbits(flag).tobytes() if len(s) else None)
            yield pd.DataFrame({"lang": part["lang"], "turn": part["turn"], "bits": flags})

    seen = texts.mapInPandas(bits, "lang string, turn int, bits binary").where("bits IS NOT NULL").orderBy("turn", "lang", F.md5("bits")).limit(each * len(names)).collect()
    if not seen:
        return LanguageModel([], np.zeros((DIMENSIONS, 0), np.float32), orders)
    names = sorted({r["lang"] for r in seen})
    packed = np.frombuffer(b"".join(r["bits"] for r in seen), np.uint8).reshape(len(seen), -1)

    def rows_of(a: int, b: int) -> np.ndarray:
        x = np.unpackbits(packed[a:b], axis=1).astype(np.float32)
        return x / np.sqrt(x.sum(1, keepdims=True))

    m = min(landmarks, len(seen))
    marks = rows_of(0, m)
    kernel = np.concatenate([rows_of(a, a + 512) @ marks.T for a in range(0, len(seen), 512)]).astype(np.float64)
    values, vectors = np.linalg.eigh(kernel[:m])
    good = values > 1e-6 * values[-1]
    root = vectors[:, good] / np.sqrt(values[good])  # Nystroem features: kernel to landmarks times this
    z = kernel @ root
    y = np.where(np.array([r["lang"] for r in seen])[:, None] == np.array(names)[None, :], 1.0, -1.0)
    coefficients = root @ np.linalg.solve(z.T @ z + ridge * np.eye(z.shape[1]), z.T @ y)
    return LanguageModel(names, (marks.T @ coefficients).astype(np.float32), orders)


def held_out(id_column: str = "doc_id") -> Column:
    """Documents kept for testing: checksum of the id's text, modulo 4, is 2."""
    return F.pmod(F.crc32(text_key(id_column).cast("binary")), F.lit(4)) == 2


def predict(docs: DataFrame, model: LanguageModel, text_column: str = "text", language: str = "lang_pred", score: str = "score") -> DataFrame:
    """Adds the predicted language and a score from 0 to 1 to every row.

    Texts that are null or hold no letter, and all texts if nothing was learned, get ``und`` and 0. The two new columns
    replace columns of the same name; all others stay as they are.
    """
    @F.pandas_udf("name string, score double")
    def guess(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            names, scores = model.predict(texts)
            yield pd.DataFrame({"name": names, "score": scores})

    bounded_batches(docs)
    made = "_guess_of_language"
    return docs.withColumn(made, guess(F.col(text_column))).withColumn(language, F.col(f"{made}.name")).withColumn(score, F.col(f"{made}.score")).drop(made)
