"""Merging of neighbouring regions until their number stops falling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from slopeweave.operators.growth import SCOPE, exclude_self
from slopeweave.operators.joins import attach
from slopeweave.operators.ranking import first_k
from slopeweave.operators.regions import REGION, combine, region_attrs, region_means
from slopeweave.session import cut, cut_counting

NEIGHBOURS = 5
# A square of one level of the pyramid holds so many times as many squares of the next finer one along either side.
FAN = 8


def knn_regions(regions: DataFrame, tiles: DataFrame, k: int = NEIGHBOURS, fan: int = FAN) -> DataFrame:
    """The ``k`` regions with the nearest centres, itself included, as ``(region_id, other_id,
    px, py, qx, qy, d2)``. ``regions`` has centres and the seed columns, ``tiles`` the grid size;
    both are written tables.

    A pyramid of squares counts the centres, from one square over a tile down to single cells. Each centre goes down with the squares that may
    still hold one of its k nearest: those no further than the distance within which squares are sure to hold k. A centre stands in once however many regions share
    it, and never more than k of those are candidates; no key holds more than a square's parts.
    """
    centre = [*SCOPE, "px", "py"]
    at = regions.select(*SCOPE, "region_id", F.col("cx").alias("px"), F.col("cy").alias("py"), "seed_ncurv", "seed_id")
    candidates = cut(first_k(at, centre, [F.col("seed_ncurv"), F.col("seed_id")], k).select(*centre, "seed_ncurv", "seed_id", F.col("region_id").alias("other_id")), "candidates")
    span = tiles.agg(F.max(F.greatest("w", "h"))).first()[0] or 1
    sides = [1]
    while sides[-1] < span:
        sides.append(sides[-1] * fan)
    cells = candidates.groupBy(*centre).agg(F.count("*").alias("held"))
    # From the coarsest squares, which are whole tiles, to cells.
    left = cells.select(*centre, F.lit(0).cast("bigint").alias("bx"), F.lit(0).cast("bigint").alias("by"))
    square = lambda axis, side: F.floor(F.col(axis) / side)
    for wide, side in list(zip(sides[1:], sides))[::-1]:
        parts = (cells.groupBy(*SCOPE, square("px", side).alias("qx"), square("py", side).alias("qy")).agg(F.sum("held").alias("held"))
                 .withColumns({"bx": F.floor(F.col("qx") * side / wide), "by": F.floor(F.col("qy") * side / wide)}))
        met = left.join(parts, [*SCOPE, "bx", "by"])
        low = {a: F.col(q) * side for a, q in (("px", "qx"), ("py", "qy"))}
        near = lambda a: F.greatest(low[a] - F.col(a), F.col(a) - (low[a] + (side - 1)), F.lit(0))
        far = lambda a: F.greatest(F.abs(F.col(a) - low[a]), F.abs(F.col(a) - (low[a] + (side - 1))))
        square_sum = lambda f: f("px") * f("px") + f("py") * f("py")
        asker = Window.partitionBy(*centre)
        sure = F.sum("held").over(asker.orderBy("far", "qx", "qy"))
        left = (met.withColumns({"near": square_sum(near), "far": square_sum(far)}).withColumn("sure", sure)
                .withColumn("reach", F.min(F.when(F.col("sure") >= k, F.col("far"))).over(asker))
                .filter("reach IS NULL OR near <= reach")
                .select(*centre, F.col("qx").alias("bx"), F.col("qy").alias("by")))
    dx, dy = F.col("qx") - F.col("px"), F.col("qy") - F.col("py")
    offered = candidates.select(*SCOPE, F.col("px").cast("bigint").alias("bx"), F.col("py").cast("bigint").alias("by"), F.col("px").alias("qx"), F.col("py").alias("qy"),
                                "seed_ncurv", "seed_id", "other_id")
    pairs = first_k(left.join(offered, [*SCOPE, "bx", "by"]).withColumn("d2", dx.cast("bigint") * dx + dy.cast("bigint") * dy), centre,
                    [F.col(c) for c in ("d2", "qx", "qy", "seed_ncurv", "seed_id")], k)
    return at.select(*centre, "region_id").join(pairs.select(*centre, "d2", "qx", "qy", "other_id"), centre)


def merge_eligible(pairs: DataFrame, slope: float | str, azimuth: float | str, slope_cmp: str = "gt") -> DataFrame:
    """Pairs whose slopes differ by more than one threshold (or less, with ``slope_cmp="lt"``)
    and whose azimuths differ by less than the other. NaN azimuths never pass."""
    rise = F.abs(F.col("q_slope") - F.col("p_slope"))
    turn = F.abs(F.col("q_azimuth") - F.col("p_azimuth"))
    slope = F.col(slope) if isinstance(slope, str) else F.lit(slope)
    azimuth = F.col(azimuth) if isinstance(azimuth, str) else F.lit(azimuth)
    apart = rise > slope if slope_cmp == "gt" else rise < slope
    return pairs.filter(apart & ~F.isnan(turn) & (turn < azimuth))


def first_order() -> Column:
    """Order of the first pass: largest first, ties in the order of the seeds."""
    return F.struct(F.array(-F.col("size")).alias("sizes"), "seed_ncurv", "seed_id")


def next_order() -> Column:
    """Order of a further pass: a stable sort by size over the order of the pass before, which the regions carry as ``order``. Comparing the latest sizes,
    then those before, and so on, is the same without a sort."""
    return F.struct(F.concat(F.array(-F.col("size")), F.col("order.sizes")).alias("sizes"),
                    F.col("order.seed_ncurv").alias("seed_ncurv"), F.col("order.seed_id").alias("seed_id"))


def eligible_pairs(regions: DataFrame, tiles: DataFrame, params: DataFrame, k: int = NEIGHBOURS, slope_cmp: str = "gt") -> DataFrame:
    """Pairs ``(a, b)`` of one pass: ``a`` comes before ``b`` in the pass's order, is near it and may
    absorb it. ``order`` sorts the absorbers; regions without one are in the order of a first pass."""
    if "order" not in regions.columns:
        regions = regions.withColumn("order", first_order())
    side = regions.select(*REGION, "order", "slope", "azimuth")
    p = side.select(*REGION, F.col("order").alias("p_order"), F.col("slope").alias("p_slope"), F.col("azimuth").alias("p_azimuth"))
    q = side.select(*SCOPE, F.col("region_id").alias("other_id"), F.col("order").alias("q_order"),
                    F.col("slope").alias("q_slope"), F.col("azimuth").alias("q_azimuth"))
    limits = params.select("param_id", F.col("slope").alias("slope_limit"), F.col("azimuth").alias("azimuth_limit"))
    pairs = (exclude_self(knn_regions(regions, tiles, k), "merge").join(p, REGION).join(q, [*SCOPE, "other_id"])
             .filter("p_order < q_order").join(limits, "param_id"))
    return merge_eligible(pairs, "slope_limit", "azimuth_limit", slope_cmp).select(
        *SCOPE, F.col("region_id").alias("a"), F.col("other_id").alias("b"), F.col("p_order").alias("order"))


def resolve_pass(eligible: DataFrame) -> DataFrame:
    """Who absorbs whom when regions act in order: ``(region_id, absorber)``. ``eligible`` is a written table.

    A region is absorbed if any of its eligible absorbers is not, and then by the first such. Only the first half of this needs
    rounds: whoever has no absorber left in question stays, whoever such a region may absorb goes, and all pairs with those fall away, so a
    chain of absorbers is settled from its head, two links a round, and all chains at once. Then one aggregation finds the absorbers.
    """
    pairs = eligible.select(*SCOPE, "a", "b")
    gone = None
    while True:
        asked = pairs.select(*SCOPE, F.col("b").alias("a")).distinct()
        news = cut(pairs.join(asked, [*SCOPE, "a"], "left_anti").select(*SCOPE, "b").distinct(), "gone")
        gone = news if gone is None else gone.unionByName(news)
        pairs, seen = cut_counting(
            pairs.join(news, [*SCOPE, "b"], "left_anti").join(news.withColumnRenamed("b", "a"), [*SCOPE, "a"], "left_anti").select(*SCOPE, "a", "b"),
            "eligible", left=F.count(F.lit(1)))
        if not seen["left"]:
            break
    staying = eligible.join(gone.withColumnRenamed("b", "a"), [*SCOPE, "a"], "left_anti")
    return (staying.groupBy(*SCOPE, "b").agg(F.min(F.struct("order", "a")).alias("f"))
            .select(*SCOPE, F.col("b").alias("region_id"), F.col("f.a").alias("absorber")))


def merge_regions(regions: DataFrame, tiles: DataFrame, params: DataFrame, k: int = NEIGHBOURS, slope_cmp: str = "gt",
                  compass: bool = False) -> tuple[DataFrame, DataFrame]:
    """Repeat passes while they absorb anything. Returns the merged regions with slope and
    azimuth, and ``(region_id, face_id)`` for every region absorbed on the way.

    Regions act from the largest to the smallest; of equal ones that first which came first in the pass before, and in the first pass the one
    with the better seed.
    """
    names = None
    regions = cut(region_attrs(region_means(regions), compass).withColumn("order", first_order()), "regions")
    while True:
        eligible, seen = cut_counting(eligible_pairs(regions, tiles, params, k, slope_cmp), "eligible",
                                      some=F.count(F.lit(1)))
        if not seen["some"]:
            return regions.drop("order"), names
        absorbed = cut(resolve_pass(eligible), "absorbed")
        step = absorbed.select(*SCOPE, F.col("region_id").alias("face_id"), F.col("absorber").alias("_next"))
        news = absorbed.select(*REGION, F.col("absorber").alias("face_id"))
        if names is not None:
            old = attach(names, step, [*SCOPE, "face_id"], "left").select(
                *REGION, F.coalesce("_next", "face_id").alias("face_id"))
            news = old.unionByName(news)
        names = cut(news, "names")
        merged = region_attrs(region_means(combine(regions, absorbed)), compass)
        regions = cut(merged.join(regions.select(*REGION, "order"), REGION).withColumn("order", next_order()), "regions")
