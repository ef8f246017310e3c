"""Distance joins by grid cell, interval joins by bucket, exact quantiles.

All of them are equi-joins on a cell or bucket number followed by the exact test, so the partner search is a
hash shuffle and never a cross product. Hot cells are split by AQE skew handling; callers that only need a sum
or the nearest partner first reduce the searched side to one row per position.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def cell(c: Column | str, size: float) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c / F.lit(float(size))).cast("long")


def around(cx: str, cy: str) -> Column:
    """The nine cells around a cell, as an array of structs."""
    return F.array(
        *[F.struct((F.col(cx) + dx).alias("cx"), (F.col(cy) + dy).alias("cy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]
    )


def radius_join(left: DataFrame, right: DataFrame, radius: float, on: list[str], how: str = "inner",
                left_xy=("x", "y"), right_xy=("px", "py"), distance: str = "distance") -> DataFrame:
    """Pairs within ``radius`` inside the same ``on`` group.

    Cells are two radii wide; a right (smaller side's) row is listed under the two to four that its circle meets.
    """
    lx, ly = left_xy
    rx, ry = right_xy
    size, reach = 2.0 * radius, radius * (1 + 1e-6)
    placed = left.withColumn("_cx", cell(lx, size)).withColumn("_cy", cell(ly, size))
    met = lambda c: F.sequence(cell(F.col(c) - reach, size), cell(F.col(c) + reach, size))
    spread = right.withColumn("_cx", F.explode(met(rx))).withColumn("_cy", F.explode(met(ry)))
    gap = F.sqrt(F.pow(F.col(lx) - F.col(rx), 2) + F.pow(F.col(ly) - F.col(ry), 2))
    keys = [*on, "_cx", "_cy"]
    joined = placed.alias("l").join(
        spread.hint("merge").alias("r"),  # the copies are not in the size estimate, by which a join chooses to broadcast
        [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys] + [gap <= radius],
        how,
    )
    keep = [F.col(f"l.{c}") for c in left.columns] + [F.col(f"r.{c}") for c in right.columns if c not in on]
    return joined.select(*keep, gap.alias(distance))


def nearest_within(left: DataFrame, right: DataFrame, radius: float, on: list[str], left_id: str, right_id: str,
                   left_xy=("x", "y"), right_xy=("px", "py"), distance: str = "distance") -> DataFrame:
    """Nearest right row within ``radius`` per distinct left position; ties go to the smallest ``right_id``.

    Both sides shrink to one row per position before the pair join, so stacked points cost nothing.
    Result: ``on`` + left position + the right columns + distance, one row per matched position.
    """
    lx, ly = left_xy
    rx, ry = right_xy
    spots = left.select(*on, lx, ly).distinct()
    payload = [c for c in right.columns if c not in on]
    bare = set(payload) == {rx, ry, right_id}  # nothing else to look up: the pair says all that is wanted of the site
    sites = right.where(F.col(rx).isNotNull() & F.col(ry).isNotNull()).groupBy(*on, rx, ry)
    # only the place and the number of a site go through the pair join
    if bare:
        narrow = sites.agg(F.min(right_id).alias("_id"))
    else:
        sites = sites.agg(F.min_by(F.struct(*payload), right_id).alias("_hit"))
        narrow = sites.select(*on, rx, ry, F.col(f"_hit.{right_id}").alias("_id"))
    pairs = radius_join(spots, narrow, radius, on, "inner", left_xy, right_xy, "_d")
    best = pairs.groupBy(*on, lx, ly).agg(F.min(F.struct("_d", "_id", rx, ry)).alias("_at")).withColumn("_near", F.col("_at._d"))
    if bare:
        said = {rx: rx, ry: ry, right_id: "_id"}
        return best.select(*on, lx, ly, *[F.col(f"_at.{said[c]}").alias(c) for c in payload], F.col("_near").alias(distance))
    best = best.select(*on, lx, ly, F.col(f"_at.{rx}").alias("_ax"), F.col(f"_at.{ry}").alias("_ay"), F.col("_near").alias(distance))
    found = sites.select(*on, F.col(rx).alias("_ax"), F.col(ry).alias("_ay"), "_hit")
    return best.join(found.hint("merge"), [*on, "_ax", "_ay"]).select(*on, lx, ly, *[F.col(f"_hit.{c}").alias(c) for c in payload], distance)


def interval_join(points: DataFrame, spans: DataFrame, on: list[str], at: str, low: str, high: str, width: float,
                  how: str = "inner") -> DataFrame:
    """Pairs with ``low <= at <= high`` inside the same ``on`` group, by buckets of ``width``.

    Both sides meet by sorted shuffles: spans are sized before their buckets are listed, points before they are made.
    """
    p = points.withColumn("_b", cell(at, width))
    s = spans.withColumn("_b", F.explode(F.sequence(cell(low, width), cell(high, width))))
    test = F.col(f"p.{at}").between(F.col(f"s.{low}"), F.col(f"s.{high}"))
    joined = p.alias("p").join(s.hint("merge").alias("s"), [F.col(f"p.{k}") == F.col(f"s.{k}") for k in [*on, "_b"]] + [test], how)
    return joined.select(
        *[F.col(f"p.{c}") for c in points.columns], *[F.col(f"s.{c}") for c in spans.columns if c not in on]
    )


def k_nearest(sites: DataFrame, k: int, on: list[str], xy=("x", "y"), spacing: float = 8.0, grow: float = 4.0, few: int = 64) -> DataFrame:
    """Distances to the ``k`` nearest other rows for every distinct position, exact.

    Groups of up to ``few`` positions are compared whole at once. In the others, round by round the cell size grows; a
    position is done once its k-th distance is below the distance to the border of the searched block. Stacked rows count
    as neighbours at distance 0. Only the unfinished positions take part in later rounds. The last round, whose block
    covers the group, finishes everything.
    Result: ``on`` + position + ``distances`` (ascending array with at most k entries).
    """
    x, y = xy
    spots = sites.groupBy(*on, x, y).agg(F.count(F.lit(1)).alias("_copies"))
    total = spots.groupBy(*on).agg(
        F.sum("_copies").alias("_n"), F.count(F.lit(1)).alias("_m"),
        F.greatest(F.max(x) - F.min(x), F.max(y) - F.min(y)).alias("_extent"),
    )
    spots = cut_lineage(spots.join(total, on))

    def closest(pairs: DataFrame, kept: list[str]) -> DataFrame:
        gap = F.sqrt(F.pow(F.col(x) - F.col("_sx"), 2) + F.pow(F.col(y) - F.col("_sy"), 2))
        copies = F.when(gap == 0, F.col("_sc") - 1).otherwise(F.col("_sc"))
        pairs = pairs.select(*on, x, y, *kept, gap.alias("_d"), F.least(copies, F.lit(k)).alias("_c"))
        pairs = pairs.where("_c > 0").withColumn("_c", F.explode(F.sequence(F.lit(1), F.col("_c").cast("int"))))
        rank = Window.partitionBy(*on, x, y).orderBy("_d", "_c")
        top = pairs.withColumn("_r", F.row_number().over(rank)).where(F.col("_r") <= k)
        return top.groupBy(*on, x, y, *kept).agg(F.array_sort(F.collect_list("_d")).alias("distances"))

    seen = lambda df: df.select(*on, F.col(x).alias("_sx"), F.col(y).alias("_sy"), F.col("_copies").alias("_sc"))
    small, large = spots.where(F.col("_m") <= few), spots.where(F.col("_m") > few)
    done = closest(small.select(*on, x, y).join(seen(small).hint("merge"), on), [])
    searched, waiting, size = seen(large), large.drop("_copies", "_m"), float(spacing)
    reach = waiting.agg(F.max("_extent")).first()[0]
    if reach is None and waiting.isEmpty():
        return done
    while True:
        last = reach is None or size > reach
        q = waiting.withColumn("_cx", cell(x, size)).withColumn("_cy", cell(y, size))
        q = q.withColumn("_edge", F.least(
            F.col(x) - (F.col("_cx") - 1) * size, (F.col("_cx") + 2) * size - F.col(x),
            F.col(y) - (F.col("_cy") - 1) * size, (F.col("_cy") + 2) * size - F.col(y)))
        q = q.withColumn("_near", F.explode(around("_cx", "_cy"))).select(
            *on, x, y, "_n", "_edge", F.col("_near.cx").alias("_cx"), F.col("_near.cy").alias("_cy"))
        s = searched.withColumn("_cx", cell("_sx", size)).withColumn("_cy", cell("_sy", size))
        found = closest(q.join(s, [*on, "_cx", "_cy"]), ["_n", "_edge"])
        if last:
            return done.unionByName(found.select(*on, x, y, "distances"))
        wanted = F.least(F.lit(k), F.col("_n") - 1)
        sure = (F.size("distances") >= wanted) & (F.coalesce(F.element_at("distances", -1), F.lit(0.0)) <= F.col("_edge"))
        found = cut_lineage(found.withColumn("_sure", sure))
        settled = found.where("_sure").select(*on, x, y, "distances")
        done = done.unionByName(settled)
        waiting = cut_lineage(waiting.join(settled.select(*on, x, y), [*on, x, y], "left_anti"))
        if waiting.isEmpty():
            return done
        size *= grow


def exact_quantiles(df: DataFrame, value: str, probabilities: list[float], buckets: int = 4096,
                    small: int = 100_000) -> list[float | None]:
    """Exact linearly interpolated quantiles of a column of any size; non-finite values are left out.

    Each pass counts rows in equal-width buckets (partial aggregates, at most ``buckets`` rows) and keeps only
    the bucket holding the wanted rank, until few enough values are left to sort. Only counts reach the driver.
    """
    data = df.select(F.col(value).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('infinity')")
    n, low, high = data.agg(F.count("v"), F.min("v"), F.max("v")).first()
    if not n:
        return [None] * len(probabilities)

    def order_statistic(rank: int) -> float:
        lo, hi, base, count = low, high, 0, n
        while True:
            if lo == hi:
                return lo
            inside = data.where((F.col("v") >= lo) & (F.col("v") <= hi))
            if count <= small:
                part = inside.groupBy("v").agg(F.count(F.lit(1)).alias("c")).orderBy("v").collect()
                for row in part:
                    base += row["c"]
                    if base > rank:
                        return row["v"]
            step = (hi - lo) / buckets
            b = F.least(F.floor((F.col("v") - lo) / step), F.lit(buckets - 1))
            for row in inside.groupBy(b.alias("b")).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("lo"),
                                                        F.max("v").alias("hi")).orderBy("b").collect():
                if base + row["c"] > rank:
                    lo, hi, count = row["lo"], row["hi"], row["c"]
                    break
                base += row["c"]

    known: dict[int, float] = {}

    def at(rank: int) -> float:
        if rank not in known:
            known[rank] = order_statistic(rank)
        return known[rank]

    out: list[float | None] = []
    for p in probabilities:
        position = p * (n - 1)
        below = math.floor(position)
        share = position - below
        out.append(at(below) if share == 0 else at(below) + (at(below + 1) - at(below)) * share)
    return out


def components(edges: DataFrame, a: str, b: str, label: str = "component") -> DataFrame:
    """Connected components of an undirected edge list: node -> smallest node of its component.

    Alternates two contractions: every node hands its larger neighbours to its smallest one, then every node
    hands all smaller ones to it. A chain of n edges settles in a logarithmic number of rounds. What is known of the
    nodes is as large as the links, however well it packs: it meets them by sorted shuffles, never through the driver.
    """
    node = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    alone = edges.select(F.col(a).alias("node")).union(edges.select(F.col(b))).distinct()
    links, previous = cut_lineage(node), None
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (
            both.join(low.hint("merge"), "u").where("v > u")
            .select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        )
        small_side = large.where("u > v")
        low2 = small_side.groupBy("u").agg(F.min("v").alias("m"))
        star = small_side.join(low2.hint("merge"), "u")
        hooked = star.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        links = cut_lineage(hooked.union(low2.select("u", F.col("m").alias("v"))).distinct())
        mark = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == previous:
            break
        previous = mark
    return alone.join(links.hint("merge"), alone["node"] == links["u"], "left").select(
        "node", F.coalesce("v", "node").alias(label)
    )


def nearest_distance(queries: DataFrame, sites: DataFrame, on: list[str], size: float = 1.0, grow: float = 4.0) -> DataFrame:
    """Distance from every query point (on, qx, qy) to the nearest site (on, sx, sy), at any range, exact.

    A round searches the nine cells around a point; a distance below the way to the border of that block is final.
    The others go on with wider cells until the block covers everything.
    """
    q0 = cut_lineage(queries.select(*on, "qx", "qy").distinct())
    s0 = cut_lineage(sites.select(*on, F.col("sx"), F.col("sy")).distinct())
    q0 = q0.join(s0.select(*on).distinct().hint("merge"), on, "left_semi")
    box = lambda df, x, y: df.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()
    a, b = box(q0, "qx", "qy"), box(s0, "sx", "sy")
    if a[0] is None or b[0] is None:
        return q0.withColumn("distance", F.lit(None).cast("double")).where(F.lit(False))
    reach = max(max(a[1], b[1]) - min(a[0], b[0]), max(a[3], b[3]) - min(a[2], b[2]))
    waiting, done = q0, None
    while True:
        last = size > reach
        q = waiting.withColumn("_cx", cell("qx", size)).withColumn("_cy", cell("qy", size))
        q = q.withColumn("_edge", F.least(F.col("qx") - (F.col("_cx") - 1) * size, (F.col("_cx") + 2) * size - F.col("qx"),
                                          F.col("qy") - (F.col("_cy") - 1) * size, (F.col("_cy") + 2) * size - F.col("qy")))
        q = q.withColumn("_near", F.explode(around("_cx", "_cy"))).select(*on, "qx", "qy", "_edge", F.col("_near.cx").alias("_cx"), F.col("_near.cy").alias("_cy"))
        pairs = q.join(s0.withColumn("_cx", cell("sx", size)).withColumn("_cy", cell("sy", size)).hint("merge"), [*on, "_cx", "_cy"])
        gap = F.sqrt(F.pow(F.col("qx") - F.col("sx"), 2) + F.pow(F.col("qy") - F.col("sy"), 2))
        found = pairs.groupBy(*on, "qx", "qy", "_edge").agg(F.min(gap).alias("distance"))
        settled = found if last else cut_lineage(found.where("distance <= _edge"))
        settled = settled.select(*on, "qx", "qy", "distance")
        done = settled if done is None else done.unionByName(settled)
        if last:
            return done
        waiting = cut_lineage(waiting.join(settled.select(*on, "qx", "qy").hint("merge"), [*on, "qx", "qy"], "left_anti"))
        if waiting.isEmpty():
            return done
        size *= grow
