"""The corpus pipeline over ``documents``: language ID, MinHash near-dedup, suffix-array dedup, mixing, packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of ``docs``. Documents are told apart by ``doc_id``. Extra columns are carried along. Empty tables give empty tables.
"""
from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitspark.llm import language, minhash, mixing, packing, suffixes
from pitspark.llm.common import collecting, delete_paths, free_name, stored, table
from pitspark.llm.queries import tokenizer_path

UNCLAIMED = 0.5  # score of an output of 0: no language claims a text whose best output is not above it
LOST = 0.001  # share of the held-out texts of known language that may score under the margin
LEAST_KNOWN = 100  # held-out texts without which no margin is set


def claim_margin(docs: DataFrame, model: language.LanguageModel) -> float:
    """Score that a text must reach to count as claimed: the ``LOST`` quantile of the labelled documents that the
    classifier has not seen and names rightly, ``UNCLAIMED`` at least, and just that where they are few."""
    known = docs.select("doc_id", "text", "lang").where(language.held_out() & F.col("lang").isNotNull())
    right = language.predict(known, model).where("lang_pred = lang")
    n, low = right.agg(F.count(F.lit(1)), F.percentile_approx("score", LOST, 100_000)).first()
    return max(UNCLAIMED, low) if n >= LEAST_KNOWN else UNCLAIMED


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose text a learned language claims; texts that are null or without letters go, and so do those
    in a script or language that was not learned and letter junk: all outputs of the classifier lie around or under 0
    there. It is fitted on the labelled part of ``docs`` that the language query learns from, the margin is set on the
    other labelled part. Texts close to a learned language may be claimed by it."""
    model = language.fit(docs.select("doc_id", "text", "lang").where(~language.held_out()))
    margin = claim_margin(docs, model)
    named, scored = free_name(docs, "_lang_pred"), free_name(docs, "_lang_score")
    guessed = language.predict(docs, model, language=named, score=scored)
    return guessed.where((F.col(named) != "und") & (F.col(scored) > UNCLAIMED) & (F.col(scored) >= margin)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of near copies (similarity 0.8 or more on five-word shingles); rows that share
    an id are one document, of which one row stays (the smallest text). Documents without an id all stay. The bands miss a
    pair at 0.80 with chance 0.0005 %."""
    found = minhash.near_duplicates(docs, percent=80)
    owner, times = free_name(docs, "_kept"), free_name(docs, "_rows")
    kept = stored(found.where("kept AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias(owner)).agg(F.count(F.lit(1)).alias(times)), "pipeline-kept")
    rows = docs.join(kept, F.col("doc_id") == F.col(owner))
    single = rows.where(F.col(times) == 1).select(*docs.columns)
    alone = docs.where("doc_id IS NULL")
    if kept.where(F.col(times) > 1).isEmpty():
        return single.unionByName(alone)
    several = rows.where(F.col(times) > 1).groupBy("doc_id").agg(F.min(F.struct(F.col("text"), F.struct(*docs.columns).alias("row")))["row"].alias("row")).select("row.*")
    return single.unionByName(several.select(*docs.columns)).unionByName(alone)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 or more words that a document with a smaller id holds too; a document left without words goes."""
    return suffixes.cut_repeats(docs, stored(suffixes.repeated_passages(docs), "pipeline-spans"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix of sources asks for: not at all, or up to three times."""
    owner, origin, times, copy = (free_name(docs, n) for n in ("_id", "_source", "_repeats", "_copy"))
    mixed = mixing.mix(docs).groupBy(F.col("doc_id").alias(owner), F.col("source").alias(origin)).agg(F.max("repeats").alias(times))
    mixed = stored(mixed.where(F.col(times) > 0), "pipeline-mixed")  # its size decides whether texts move
    rows = docs.join(mixed, F.col("doc_id").eqNullSafe(F.col(owner)) & F.col("source").eqNullSafe(F.col(origin)))
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times).cast("int")))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # executors come here with memory full from the stages before; fewer remembered runs cost time, which there is
    pieces = packing.harmonic_pack(docs, tokenizer_path(), remembered=50_000)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


_left: list[str] = []


def tidy(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, which first deletes the tables that earlier stages wrote on the way. It does so only where ``docs`` is read
    from files and none of those tables is among them: then the earlier stage's result has been written."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        files = docs.inputFiles()
        if files and not any(path in f for f in files for path in _left):
            delete_paths(spark, _left)
            _left.clear()
        with collecting() as paths:
            out = stage(spark, docs, sf_dir)
        _left.extend(paths)
        return out

    return run_stage


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", tidy(known_language)),
    ("minhash_near_dedup", tidy(near_dedup)),
    ("suffix_array_dedup", tidy(passage_dedup)),
    ("source_mixing", tidy(source_mix)),
    ("packing", tidy(pack)),
]

#: The classifier, the confirmed similarity groups and the tokenizer have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
