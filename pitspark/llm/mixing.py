"""Mixing sources to target weights by hash-threshold histograms, DataFrame operations only.

Every source gets a word budget. A source that must shrink keeps the documents below a hash threshold; one that must
grow repeats all its documents and those below the threshold once more. The threshold comes from nested histograms:
words are summed by source and hash bucket, the bucket in which the budget ends is found, and only that bucket is
looked at again with finer buckets. No document is ever sorted.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stored, text_key

BITS = 12          # of each of the two histogram levels
HASH_DIGITS = 15   # hexadecimal, 60 bits


def budgets(sizes: DataFrame, weights: list[float], most: float) -> DataFrame:
    """Per source (``source, source_size``): its ``target`` of all words.

    Sources by code point, null last, take the weights in turn. A target stops at ``most`` times the source's size and
    the excess goes to the others by weight. All sources below their stop share one level (target = level * weight);
    in order of stop / weight, the level after the first m stops is what is left over the weights that are left, and
    the first m whose level the next stop does not undercut is the answer. One row per source passes through here.
    """
    n = len(weights)
    every = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(every) - 1) % n + 1).cast("int"))
    s = sizes.withColumn("weight", turn).withColumn("stop", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("stop") / F.col("weight"), F.col("source").asc_nulls_last())
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = s.withColumn("open", F.sum("source_size").over(whole) - F.coalesce(F.sum("stop").over(before), F.lit(0.0)))
    s = s.withColumn("share", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("level", F.when(F.col("share") > 0, F.col("open") / F.col("share")))
    # sources whose stop lies under the level of their own place are stopped; the level of the first other one holds
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("stop"), F.struct(F.col("stop") / F.col("weight"), "level"))).over(whole)["level"]
    return s.withColumn("target", F.coalesce(F.least("stop", level * F.col("weight")), F.col("stop"))).select("source", "source_size", "target")


def _bucket(level: int) -> Column:
    return F.shiftright(F.col("_h"), 4 * HASH_DIGITS - BITS * level).cast("long")


def _salted(slim: DataFrame, small: DataFrame, salts: int) -> DataFrame:
    """Joins per-source rows to documents; a source with many documents is spread over ``salts`` keys."""
    many = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    left = slim.withColumn("_salt", F.pmod(F.col("_h"), F.lit(salts)).cast("int"))
    return left.join(many.withColumnRenamed("source", "_source"), (F.col("source").eqNullSafe(F.col("_source"))) & (left["_salt"] == many["_salt"])).drop("_source", "_salt")


def _boundary(sums: DataFrame, key: str) -> DataFrame:
    """The bucket in which the budget ends: the first one whose end lies at or past it."""
    run = Window.partitionBy("source").orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = sums.withColumn("_end", F.col("_base") + F.sum("words").over(run))
    return cum.withColumn("_start", F.col("_end") - F.col("words"))


def mix(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
        weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0, salts: int = 32) -> DataFrame:
    """How often the mix takes each document.

    Sizes are word counts (null text: 0). Null is a source of its own, the last one. Rows with equal document ids share
    a hash and are taken alike; null ids count as the empty text. The documents of the hash at which the budget ends
    are taken when that brings the source nearer to its target (halfway counts). A source without words gets target 0
    and nothing is taken. Columns other than the three named ones are ignored; an empty table gives no rows.

    Result, a row per input row: ``doc_id, source, size, source_size, target, taken`` (words, repeats counted) and
    ``repeats`` (whole copies of the document in the mix).
    """
    digest = F.conv(F.substring(F.md5(text_key(id_column)), 1, HASH_DIGITS), 16, 10).cast("long")
    slim = stored(docs.select(
        F.col(id_column).alias("doc_id"), F.col(source_column).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_column), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), digest.alias("_h"),
    ), "mix-sizes")
    level1 = slim.groupBy("source", _bucket(1).alias("_b1")).agg(F.sum("size").alias("words"))
    level1 = stored(level1, "mix-level1")
    plan = budgets(level1.groupBy("source").agg(F.sum("words").alias("source_size")), list(weights), most)
    repeats = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = stored(plan.withColumn("_whole", repeats).withColumn("_rest", F.greatest(F.lit(0.0), F.col("target") - F.col("_whole") * F.col("source_size"))), "mix-plan")

    def ending(sums: DataFrame, key: str) -> DataFrame:
        """Per source the bucket ``key`` in which its rest ends and the words before it."""
        inside = _boundary(sums, key).where((F.col("_start") <= F.col("_rest")) & (F.col("_end") > F.col("_rest")))
        return inside.groupBy("source").agg(F.min(F.struct(key, "_start")).alias("_m")).select("source", F.col(f"_m.{key}").alias(key), F.col("_m._start").alias("_base"))

    def with_rest(sums: DataFrame) -> DataFrame:
        return sums.join(plan.select(F.col("source").alias("_source"), "_rest"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")

    at1 = stored(ending(with_rest(level1.withColumn("_base", F.lit(0))), "_b1"), "mix-bound1")
    first = _salted(slim.where("size > 0"), at1.withColumnRenamed("_b1", "_at"), salts).where(_bucket(1) == F.col("_at"))
    level2 = first.groupBy("source", "_base", _bucket(2).alias("_b2")).agg(F.sum("size").alias("words"))
    at2 = stored(ending(with_rest(level2), "_b2"), "mix-bound2")
    second = _salted(slim.where("size > 0"), at2.withColumnRenamed("_b2", "_at"), salts).where(_bucket(2) == F.col("_at"))
    level3 = second.groupBy("source", "_base", "_h").agg(F.sum("size").alias("words"))
    level3 = _boundary(with_rest(level3), "_h")
    # the last hash taken once more, or none of the boundary bucket: then all hashes before that bucket are
    taken = level3.groupBy("source").agg(F.max(F.when(F.col("_start") + F.col("_end") <= 2 * F.col("_rest"), F.col("_h"))).alias("_last"))
    limits = plan.alias("p").join(taken.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source")), "left").join(at2.alias("a"), F.col("p.source").eqNullSafe(F.col("a.source")), "left")
    below = F.shiftleft(F.col("a._b2"), 4 * HASH_DIGITS - 2 * BITS) - 1
    every = F.lit((1 << 62) - 1)
    limits = stored(limits.select("p.source", "p.source_size", "p.target", "p._whole",
                                  F.when(F.col("p._rest") <= 0, F.lit(-1)).otherwise(F.coalesce(F.col("t._last"), below, every)).cast("long").alias("_limit")), "mix-limits")
    out = _salted(slim, limits, salts)
    copies = F.col("_whole") + (F.col("_h") <= F.col("_limit")).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("repeats"))
