"""Faces against ground truth, by the exact area of their overlap.

The overlap of two faces is a sum over pairs of their edges. Faces whose boxes meet are found by squares. Two faces of few edges are then compared as a whole. The edges
of larger ones are sent to the rows of a grid that they cross and joined row by row, so what is compared are the few edges of either face in one row. The grid only
deals out the work; it has no part in the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from slopeweave.functions.rings import polygon_area, ring_area
from slopeweave.session import cut, held

# Edges of a face that move together, at most; those of a larger one are dealt to rows.
FEW_EDGES = 64
# Numbers that describe an edge.
EDGE = ["ax", "ay", "bx", "by", "way"]


def _explode_range(df: DataFrame, low: Column, high: Column, name: str, run: int = 4096) -> DataFrame:
    """One row per whole number from low to high, made in two steps so that no array is long."""
    kept = df.columns
    return (df.withColumns({"_lo": low.cast("bigint"), "_hi": high.cast("bigint")}).filter("_lo <= _hi")
            .withColumn("_run", F.explode(F.expr(f"sequence(_lo, _hi, {run}L)")))
            .select(*kept, F.explode(F.sequence("_run", F.least(F.col("_run") + (run - 1), F.col("_hi")))).alias(name)))


def spans(features: DataFrame, ids: list[str], cell: float) -> DataFrame:
    """``(ids, row, x0, x1)``: half-open runs of cells with their centre inside, even-odd.

    Every ring edge is sent to the rows it crosses, and the crossings of a row are paired in
    order, so the work follows the outline and not the area.
    """
    edges = (
        features.select(*ids, F.explode("rings").alias("ring"))
        .select(*ids, F.explode(F.zip_with(
            F.slice("ring", 1, F.size("ring") - 1), F.slice("ring", 2, F.size("ring") - 1),
            lambda p, q: F.struct(p[0].alias("xa"), p[1].alias("ya"), q[0].alias("xb"), q[1].alias("yb")))).alias("e"))
        .select(*ids, "e.*").filter("ya <> yb")
    )
    low, high = F.least("ya", "yb"), F.greatest("ya", "yb")
    # rows whose centre line lies in [low, high)
    crossed = _explode_range(edges, F.ceil(low / cell - 0.5), F.ceil(high / cell - 0.5) - 1, "row")
    at = (F.col("row") + 0.5) * cell
    x = F.col("xa") + (at - F.col("ya")) / (F.col("yb") - F.col("ya")) * (F.col("xb") - F.col("xa"))
    paired = (
        crossed.select(*ids, "row", F.ceil(x / cell - 0.5).cast("bigint").alias("x"))
        .groupBy(*ids, "row").agg(F.sort_array(F.collect_list("x")).alias("xs"))
        .select(*ids, "row", F.explode(F.transform(
            F.sequence(F.lit(0), F.expr("size(xs) DIV 2 - 1").cast("int")),
            lambda i: F.struct(F.get("xs", 2 * i).alias("x0"), F.get("xs", 2 * i + 1).alias("x1")))).alias("s"))
    )
    return paired.select(*ids, "row", "s.x0", "s.x1").filter("x0 < x1")


def rasterize(features: DataFrame, ids: list[str], cell: float) -> DataFrame:
    """Cells ``(ids, cx, cy)`` with their centre inside the face."""
    return _explode_range(spans(features, ids, cell), F.col("x0"), F.col("x1") - 1, "cx").select(
        *ids, "cx", F.col("row").alias("cy"))


def _boxes(features: DataFrame, ids: list[str], prefix: str) -> DataFrame:
    """Bounds of each face."""
    corners = F.flatten("rings")
    axis = lambda i: F.transform(corners, lambda p: p[i])
    return features.select(*ids, *[f(axis(i)).alias(f"{prefix}{n}") for n, f, i in (
        ("x0", F.array_min, 0), ("x1", F.array_max, 0), ("y0", F.array_min, 1), ("y1", F.array_max, 1))])


def edges(features: DataFrame, ids: list[str], cell: float) -> DataFrame:
    """``(ids, row, xa, ya, xb, yb, way)``: the ring edges of each face in every row of height ``cell`` that they touch.

    ``way`` is 1 where a walk toward greater x enters the face at the edge, -1 where it leaves, 0 on level edges. The first ring is the outline and the others are
    holes, however they are turned.
    """
    turn = lambda ring, i: F.signum(ring_area(ring)) * F.when(i == 0, 1).otherwise(-1)
    sides = (
        features.select(*ids, F.explode(F.transform("rings", lambda r, i: F.struct(r.alias("ring"), turn(r, i).alias("turn")))).alias("r"))
        .select(*ids, "r.turn", F.explode(F.zip_with(
            F.slice("r.ring", 1, F.size("r.ring") - 1), F.slice("r.ring", 2, F.size("r.ring") - 1),
            lambda p, q: F.struct(p[0].alias("xa"), p[1].alias("ya"), q[0].alias("xb"), q[1].alias("yb")))).alias("e"))
        .select(*ids, "e.*", (-F.signum(F.col("e.yb") - F.col("e.ya")) * F.col("turn")).alias("way")))
    low, high = F.least("ya", "yb"), F.greatest("ya", "yb")
    return _explode_range(sides, F.floor(low / cell), F.floor(high / cell), "row").select(*ids, "row", "xa", "ya", "xb", "yb", "way")


def edge_count() -> Column:
    """Number of edges of a face."""
    return F.coalesce(F.aggregate("rings", F.lit(0), lambda n, ring: n + F.greatest(F.size(ring) - 1, F.lit(0))), F.lit(0))


def _few_edges(features: DataFrame, ids: list[str], name: str) -> DataFrame:
    """Faces of few edges, as ``(ids, name)``: the numbers ``EDGE`` of all edges, one edge after the other."""
    turned = F.transform("rings", lambda r, i: F.struct(r.alias("ring"), (F.signum(ring_area(r)) * F.when(i == 0, 1).otherwise(-1)).alias("turn")))
    side = lambda turn: lambda p, q: F.array(p[0], p[1], q[0], q[1], -F.signum(q[1] - p[1]) * turn)
    sides = F.transform(turned, lambda t: F.zip_with(F.slice(t.ring, 1, F.size(t.ring) - 1), F.slice(t.ring, 2, F.size(t.ring) - 1), side(t.turn)))
    return features.filter(edge_count() <= FEW_EDGES).select(*ids, F.flatten(F.flatten(sides)).alias(name))


def placed_boxes(features: DataFrame, ids: list[str], prefix: str, cell: float) -> DataFrame:
    """Bounds of each face, the level where it is at home (see ``box_pairs``) and its number of edges."""
    size = F.greatest(F.col(f"{prefix}x1") - F.col(f"{prefix}x0"), F.col(f"{prefix}y1") - F.col(f"{prefix}y0"), F.lit(cell))
    found = _boxes(features.withColumn("edges", edge_count()), [*ids, "edges"], prefix)
    return found.filter(F.col(f"{prefix}x0").isNotNull()).withColumn("home", F.ceil(F.log2(size / cell)).cast("int"))


def box_pairs(g: DataFrame, r: DataFrame, g_levels: list[int], r_levels: list[int], gold_ids: list[str], result_ids: list[str], cell: float) -> DataFrame:
    """Faces whose bounds meet, with the heights ``y0, y1`` that they share, from their placed bounds and the levels where they are at home.

    Squares of a cell's side, of twice that, and so on, are levels. A face is at home on the first level whose squares are as large as it, where
    it touches four at most. A pair is sought where the larger of the two is at home: there the smaller one is dealt to the squares it touches, too, and a
    square holds few faces that large. The pair is taken in the square with the lower left corner of what both share, which is only one.
    """
    scope = [c for c in gold_ids if c in result_ids]
    at = lambda v: F.floor(v / (F.lit(cell) * F.pow(F.lit(2.0), F.col("level"))))

    def dealt(placed: DataFrame, prefix: str) -> DataFrame:
        wide = _explode_range(placed.drop("edges"), at(F.col(f"{prefix}x0")), at(F.col(f"{prefix}x1")), "sx")
        # There are several times as many rows as the written bounds suggest, too many to send to all tasks.
        return _explode_range(wide, at(F.col(f"{prefix}y0")), at(F.col(f"{prefix}y1")), "sy").drop("home").hint("merge")

    on = lambda df, levels: df.withColumn("level", F.explode(F.array(*[F.lit(k) for k in levels]).cast("array<int>")))
    keys = [*scope, "level", "sx", "sy"]
    smaller = on(r, g_levels).filter(F.col("level") >= F.col("home"))
    met = dealt(g.withColumn("level", F.col("home")), "g").join(dealt(smaller, "r"), keys)
    if larger := [k for k in r_levels if k > min(g_levels, default=k)]:
        smaller = on(g, larger).filter(F.col("level") > F.col("home"))
        home = r.filter(F.col("home").isin(larger)).withColumn("level", F.col("home"))
        met = met.unionByName(dealt(smaller, "g").join(dealt(home, "r"), keys))
    x0, y0 = F.greatest("gx0", "rx0"), F.greatest("gy0", "ry0")
    return (met.filter((x0 <= F.least("gx1", "rx1")) & (y0 <= F.least("gy1", "ry1")) & (at(x0) == F.col("sx")) & (at(y0) == F.col("sy")))
            .select(*gold_ids, *[c for c in result_ids if c not in scope], y0.alias("y0"), F.least("gy1", "ry1").alias("y1")))


def _both_positive(first: Column, last: Column, height: Column) -> Column:
    """Integral of the positive part of what goes evenly from ``first`` to ``last`` over a height."""
    zero = F.lit(0.0)
    up, down = F.greatest(first, zero), F.greatest(last, zero)
    crossing = (first < 0) != (last < 0)
    return F.when(crossing, F.try_divide((up + down) * (up + down), F.abs(first) + F.abs(last)) * height / 2).otherwise((up + down) * height / 2)


def _touch() -> Column:
    """Whether an edge of the gold face and one of the result share a point."""
    cross = lambda o, p, q: ((F.col(f"{p}x") - F.col(f"{o}x")) * (F.col(f"{q}y") - F.col(f"{o}y"))
                             - (F.col(f"{p}y") - F.col(f"{o}y")) * (F.col(f"{q}x") - F.col(f"{o}x")))
    apart = lambda a, b, c, d: (F.greatest(a, b) < F.least(c, d)) | (F.greatest(c, d) < F.least(a, b))
    boxes = ~apart("gax", "gbx", "rax", "rbx") & ~apart("gay", "gby", "ray", "rby")
    side = lambda v: F.signum(v)
    return boxes & (side(cross("ga", "gb", "ra")) * side(cross("ga", "gb", "rb")) <= 0) & (side(cross("ra", "rb", "ga")) * side(cross("ra", "rb", "gb")) <= 0)


def overlap_pairs(gold: DataFrame, result: DataFrame, gold_ids: list[str], result_ids: list[str], cell: float,
                  touching: bool = True) -> DataFrame:
    """Shared area of every pair of faces that meet, as ``(gold_ids, result_ids, overlap)``.

    With ``touching``, faces that only share an edge or corner meet with overlap 0. Both sides
    agree on the names in both id lists, which become join keys.

    Along a level line a face is a sum of steps, up where the line enters it and down where it leaves. The length that two faces share is
    then minus the sum, over all pairs of their steps, of the product of the steps and the positive part of their distance. Over a row, that distance goes
    evenly from one value to another for a pair of edges, so its integral is exact.
    """
    scope = [c for c in gold_ids if c in result_ids]
    ids = [*gold_ids, *[c for c in result_ids if c not in scope]]
    # Each side's bounds are read several times and are few bytes; they are not needed beyond the pairs.
    with held(placed_boxes(gold, gold_ids, "g", cell), "boxes") as g, held(placed_boxes(result, result_ids, "r", cell), "boxes") as r:
        # A few dozen levels at most: each is twice the one before.
        homes = [{x["home"]: x["most"] for x in side.groupBy("home").agg(F.max("edges").alias("most")).collect()} for side in (g, r)]
        pairs = cut(box_pairs(g, r, *[sorted(h) for h in homes], gold_ids, result_ids, cell), "pairs")
    met = _met_whole(pairs, gold, result, gold_ids, result_ids, ids)
    if max([*homes[0].values(), *homes[1].values()], default=0) > FEW_EDGES:
        met = met.unionByName(_met_by_rows(pairs, gold, result, gold_ids, result_ids, ids, cell))
    x_at = lambda p, y: F.col(f"{p}ax") + F.try_divide(y - F.col(f"{p}ay"), F.col(f"{p}by") - F.col(f"{p}ay")) * (F.col(f"{p}bx") - F.col(f"{p}ax"))
    apart = lambda y: x_at("g", y) - x_at("r", y)
    crossing = (F.col("gway") != 0) & (F.col("rway") != 0) & (F.col("_high") > F.col("_low"))
    shared = F.when(crossing, -F.col("gway") * F.col("rway") * _both_positive(F.col("_first"), F.col("_last"), F.col("_high") - F.col("_low"))).otherwise(0.0)
    # Step by step, so that a distance is worked out once.
    met = met.withColumns({"_first": F.when(crossing, apart(F.col("_low"))), "_last": F.when(crossing, apart(F.col("_high")))})
    summed = met.groupBy(*ids).agg(F.sum(shared).alias("overlap"), F.max(_touch()).alias("touch"))
    # Rounding errors of the sum are far below this share of a cell.
    some = F.col("overlap") > 1e-9 * cell * cell
    kept = summed.filter(some | F.col("touch")) if touching else summed.filter(some)
    return kept.select(*ids, F.when(some, F.col("overlap")).otherwise(0.0).alias("overlap"))


_SIDES = [f"{p}{c}" for p in "gr" for c in EDGE]


def _shared_heights() -> dict[str, Column]:
    """Where the heights begin and end that two edges share."""
    return {"_low": F.greatest(F.least("gay", "gby"), F.least("ray", "rby")), "_high": F.least(F.greatest("gay", "gby"), F.greatest("ray", "rby"))}


def _met_whole(pairs: DataFrame, gold: DataFrame, result: DataFrame, gold_ids: list[str], result_ids: list[str], ids: list[str]) -> DataFrame:
    """Pairs of edges of faces of few edges, with the heights ``_low, _high`` that they share. Pairs that share none are left out."""
    # The sizes that Spark guesses for compressed rings are too low to go by: neither side is sent to the driver.
    both = (pairs.select(*ids).join(_few_edges(gold, gold_ids, "_g").hint("merge"), gold_ids)
            .join(_few_edges(result, result_ids, "_r").hint("merge"), result_ids))
    of = lambda side: [F.get(f"_{side}", F.col("_at") + k).alias(f"{side}{c}") for k, c in enumerate(EDGE)]
    # An empty array has no first edge, as the last step of a sequence up to it would be before its first.
    starts = lambda side: F.explode(F.when(F.size(f"_{side}") > 0, F.sequence(F.lit(0), F.size(f"_{side}") - 1, F.lit(len(EDGE))))).alias("_at")
    sides = both.select(*ids, "_g", "_r", starts("g")).select(*ids, "_r", *of("g"))
    return (sides.select("*", starts("r")).select(*ids, *[f"g{c}" for c in EDGE], *of("r"))
            .withColumns(_shared_heights()).filter("_low <= _high"))


def _met_by_rows(pairs: DataFrame, gold: DataFrame, result: DataFrame, gold_ids: list[str], result_ids: list[str], ids: list[str], cell: float) -> DataFrame:
    """The same, row by row of height ``cell``, of faces one of which at least has more edges. Heights are those within the row."""
    few = edge_count() <= FEW_EDGES
    named = lambda df, ids_, p: (edges(df, ids_, cell)
                                 .select(*ids_, "row", *[F.col(a + b).alias(p + b + a) for a in "xy" for b in "ab"], F.col("way").alias(p + "way")).hint("merge"))
    rows = _explode_range(pairs, F.floor(F.col("y0") / cell), F.floor(F.col("y1") / cell), "row").select(*ids, "row")
    meet = lambda g, r: rows.join(named(g, gold_ids, "g"), [*gold_ids, "row"]).join(named(r, result_ids, "r"), [*result_ids, "row"])
    met = meet(gold.filter(~few), result).unionByName(meet(gold.filter(few), result.filter(~few)))
    within = {"_low": F.greatest("_low", F.col("row") * cell), "_high": F.least("_high", (F.col("row") + 1) * cell)}
    return met.withColumns(_shared_heights()).withColumns(within).select(*ids, *_SIDES, "_low", "_high")


def best_match(pairs: DataFrame, gold_ids: list[str], result_id: str = "result_id") -> DataFrame:
    """The result face with the largest overlap for every gold face; ties go to the last."""
    return pairs.groupBy(*gold_ids).agg(
        F.max(F.struct("overlap", F.col(result_id).alias("best"))).alias("_m")).select(
        *gold_ids, F.col("_m.best").alias(result_id), F.col("_m.overlap").alias("overlap"))


def unmatched_gold(gold: DataFrame, best: DataFrame, gold_ids: list[str]) -> DataFrame:
    return gold.join(best.select(*gold_ids), gold_ids, "left_anti")


def unmatched_result(result: DataFrame, best: DataFrame, result_ids: list[str]) -> DataFrame:
    return result.join(best.select(*result_ids), result_ids, "left_anti")


def evaluate(gold: DataFrame, result: DataFrame, cell: float, scope: list[str] | None = None,
             scopes: DataFrame | None = None, touching: bool = True) -> DataFrame:
    """Distance of the result faces from the gold faces: 0 for equal sets.

    ``(sum over matched gold of the mean relative leftover + unmatched gold + unmatched result)
    / (faces of both)``, NaN without any face. ``gold`` is ``(gold_id, rings)`` and ``result``
    ``(result_id, rings)``. ``scope`` columns of the result give one score each against the
    whole gold, for every row of ``scopes``; scope columns that gold has too are matched. Areas are exact for any polygons; ``cell`` is the
    height of the rows by which the work is dealt out.
    """
    scope = scope or []
    shared = [c for c in scope if c in gold.columns]
    gold_ids, result_ids = [*shared, "gold_id"], [*scope, "result_id"]
    # Each side is read by some ten steps, so what makes the faces runs once.
    gold, result = cut(gold.select(*gold_ids, "rings"), "gold"), cut(result.select(*result_ids, "rings"), "result")
    gold_area = gold.select(*gold_ids, polygon_area(F.col("rings")).alias("gold_area"))
    result_area = result.select(*result_ids, polygon_area(F.col("rings")).alias("result_area"))
    pairs = overlap_pairs(gold, result, gold_ids, result_ids, cell, touching)
    match_ids = [*scope, "gold_id"]
    best = best_match(pairs, match_ids).join(gold_area.hint("merge"), gold_ids).join(result_area.hint("merge"), result_ids)
    # To 9 places, so that what is left of a face without itself is 0. Of a face without area nothing can be left.
    left = lambda area: F.coalesce(F.greatest(F.round(1 - F.try_divide(F.col("overlap"), F.col(area)), 9), F.lit(0.0)), F.lit(0.0))
    leftover = (left("gold_area") + left("result_area")) / 2
    # every matched result face counts once, however many gold faces it is best for
    per_face = best.groupBy(*result_ids).agg(F.count("*").alias("golds"), F.sum(leftover).alias("leftover"))
    nothing = {"n": F.lit(0).cast("bigint"), "matched_gold": F.lit(0).cast("bigint"),
               "matched_result": F.lit(0).cast("bigint"), "leftover": F.lit(0.0)}

    def tally(df: DataFrame, **counts: Column) -> DataFrame:
        return df.select(*scope, *[c.alias(name) for name, c in (nothing | counts).items()])

    one = F.lit(1).cast("bigint")
    rows = tally(result, n=one).unionByName(
        tally(per_face, matched_gold=F.col("golds"), matched_result=one, leftover=F.col("leftover")))
    if scopes is not None:
        rows = rows.unionByName(tally(scopes))
    totals = rows.groupBy(*scope).agg(*[F.coalesce(F.sum(c), v).alias(c) for c, v in nothing.items()])
    if shared:
        totals = totals.join(gold.groupBy(*shared).agg(F.count("*").alias("m")), shared, "left")
    else:
        totals = totals.withColumn("m", F.lit(gold.count()))
    m = F.coalesce("m", F.lit(0))
    faces = m + F.col("n")
    cost = F.col("leftover") + (m - F.col("matched_gold")) + (F.col("n") - F.col("matched_result"))
    return totals.select(*scope, F.when(faces > 0, F.try_divide(cost, faces.cast("double")))
                         .otherwise(F.lit(float("nan"))).alias("score"))


def score_stats(scores: DataFrame) -> DataFrame:
    """Least, greatest and mean score, and sample variance."""
    return scores.agg(F.min("score").alias("min_score"), F.max("score").alias("max_score"),
                      F.avg("score").alias("mean_score"), F.var_samp("score").alias("var_score"))


def best_candidate(scores: DataFrame, params: DataFrame) -> DataFrame:
    """The parameter set with the lowest score; the first of equals."""
    values = [c for c in params.columns if c != "param_id"]
    return (scores.join(params, "param_id")
            .agg(F.min_by(F.struct("param_id", *values, "score"), F.struct("score", "param_id")).alias("_b")).select("_b.*"))


def rank_scores(scores: DataFrame) -> DataFrame:
    """The row with the lowest score."""
    return scores.orderBy("score", "param_id").limit(1)


def collect_scores(scores: DataFrame) -> list[tuple[int, float]]:
    """Scores on the driver, one per parameter set."""
    return [(r["param_id"], r["score"]) for r in scores.orderBy("param_id").collect()]
