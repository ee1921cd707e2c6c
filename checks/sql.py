"""SQL texts of the checks: each is a final SELECT over common table expressions."""

from __future__ import annotations

import re

from checks import fixtures as fx


def _fit(k: int, reach: int) -> str:
    """Moments around each masked cell of ``roof_cells``, by listing and ranking its neighbours."""
    return f"""
        SELECT tile_id, px, py, count(*) AS n,
               avg(dx) AS ax, avg(dy) AS ay, avg(dh) AS ah,
               covar_samp(dx, dx) AS cxx, covar_samp(dx, dy) AS cxy, covar_samp(dy, dy) AS cyy,
               covar_samp(dx, dh) AS cxh, covar_samp(dy, dh) AS cyh, covar_samp(dh, dh) AS chh
        FROM (SELECT e.tile_id, e.px, e.py, CAST(e.dx AS DOUBLE) AS dx, CAST(e.dy AS DOUBLE) AS dy,
                     q.height - p.height AS dh
              FROM nbr{k} e
              JOIN roof_cells p ON p.tile_id = e.tile_id AND p.px = e.px AND p.py = e.py
              JOIN roof_cells q ON q.tile_id = e.tile_id AND q.px = e.qx AND q.py = e.qy)
        GROUP BY ALL"""


def _nbr(k: int, reach: int) -> str:
    return f"""
        SELECT tile_id, px, py, px + dx AS qx, py + dy AS qy, dx, dy, dx * dx + dy * dy AS d2,
               row_number() OVER (PARTITION BY tile_id, px, py ORDER BY dx * dx + dy * dy, dx, dy) AS rnk
        FROM (SELECT c.tile_id, c.px, c.py, s.dx, s.dy
              FROM roof_cells c JOIN roof_tiles t ON t.tile_id = c.tile_id
              JOIN (SELECT CAST(a.range AS INT) - {reach} AS dx, CAST(b.range AS INT) - {reach} AS dy
                    FROM range({2 * reach + 1}) a, range({2 * reach + 1}) b) s
                ON c.px + s.dx BETWEEN 0 AND t.w - 1 AND c.py + s.dy BETWEEN 0 AND t.h - 1
              WHERE c.in_mask AND s.dx * s.dx + s.dy * s.dy <= {reach * reach})
        QUALIFY rnk <= {k}"""


def _plane(source: str, keys: str) -> str:
    """Curvature and normal from the covariance columns of ``source``."""
    return f"""
        SELECT {keys}, CASE WHEN q > 0 THEN l3 / (3 * q) ELSE 0 END AS curv,
               CASE WHEN down THEN -vx ELSE vx END + 0.0 AS nx,
               CASE WHEN down THEN -vy ELSE vy END + 0.0 AS ny,
               CASE WHEN down THEN -vz ELSE vz END + 0.0 AS nz
        FROM (SELECT *, vz < 0 OR (vz = 0 AND vx < 0) OR (vz = 0 AND vx = 0 AND vy < 0) AS down
         FROM (SELECT *, CASE WHEN nn > 0 THEN round(CASE WHEN n1 = nn THEN x1 WHEN n2 = nn THEN x2 ELSE x3 END / sqrt(nn), 9) ELSE 0 END AS vx,
                      CASE WHEN nn > 0 THEN round(CASE WHEN n1 = nn THEN y1 WHEN n2 = nn THEN y2 ELSE y3 END / sqrt(nn), 9) ELSE 0 END AS vy,
                      CASE WHEN nn > 0 THEN round(CASE WHEN n1 = nn THEN z1 WHEN n2 = nn THEN z2 ELSE z3 END / sqrt(nn), 9) ELSE 1 END AS vz
          FROM (SELECT *, x1*x1 + y1*y1 + z1*z1 AS n1, x2*x2 + y2*y2 + z2*z2 AS n2, x3*x3 + y3*y3 + z3*z3 AS n3,
                       greatest(x1*x1 + y1*y1 + z1*z1, x2*x2 + y2*y2 + z2*z2, x3*x3 + y3*y3 + z3*z3) AS nn
           FROM (SELECT *, cxy*cyh - cxh*b AS x1, cxh*cxy - a*cyh AS y1, a*b - cxy*cxy AS z1,
                        cxy*c - cxh*cyh AS x2, cxh*cxh - a*c AS y2, a*cyh - cxy*cxh AS z2,
                        b*c - cyh*cyh AS x3, cyh*cxh - cxy*c AS y3, cxy*cyh - b*cxh AS z3
            FROM (SELECT *, cxx - l3 AS a, cyy - l3 AS b, chh - l3 AS c
             FROM (SELECT *, greatest(q + 2 * p * cos(acos(greatest(least(CASE WHEN p > 0 THEN det / (2*p*p*p) ELSE 0 END, 1.0), -1.0)) / 3
                                     + 2 * pi() / 3), 0.0) AS l3
              FROM (SELECT *, sqrt((a0*a0 + b0*b0 + c0*c0 + 2*(cxy*cxy + cxh*cxh + cyh*cyh)) / 6) AS p,
                           a0*(b0*c0 - cyh*cyh) - cxy*(cxy*c0 - cyh*cxh) + cxh*(cxy*cyh - b0*cxh) AS det
               FROM (SELECT *, cxx - q AS a0, cyy - q AS b0, chh - q AS c0
                FROM (SELECT *, (cxx + cyy + chh) / 3 AS q FROM {source}))))))))) """


def _cells(points: str, tiles: str) -> str:
    return f"""
        SELECT g.tile_id, g.px, g.py, coalesce(p.height, 0.0) AS height,
               coalesce((o.argb & 16777215) = 16716049, false) AS in_mask,
               (((r.argb >> 16) & 255) + ((r.argb >> 8) & 255) + (r.argb & 255)) / CAST(3 AS DOUBLE) AS intensity
        FROM (SELECT tile_id, w, h, CAST(px AS INT) AS px, CAST(py AS INT) AS py
              FROM (SELECT tile_id, w, h, unnest(range(w)) AS px FROM {tiles}), LATERAL (SELECT unnest(range(h)) AS py)) g
        LEFT JOIN (SELECT tile_id, px, py, max_by(height, seq) AS height FROM {points} GROUP BY ALL) p
          ON p.tile_id = g.tile_id AND p.px = g.px AND p.py = g.py
        LEFT JOIN outline o ON o.tile_id = g.tile_id AND o.px = ((2 * g.px + 1) * 30) // (2 * g.w)
          AND o.py = ((2 * g.py + 1) * 30) // (2 * g.h)
        LEFT JOIN raster r ON r.tile_id = g.tile_id AND r.px = ((2 * g.px + 1) * 30) // (2 * g.w)
          AND r.py = ((2 * g.py + 1) * 30) // (2 * g.h)"""


def _tiles(points: str) -> str:
    return f"""
        SELECT *, CAST(floor(sqrt((n + 1) * ((max_x - min_x) / (max_y - min_y))) + 0.5) AS INT) AS w,
               CAST(floor(sqrt((n + 1) / ((max_x - min_x) / (max_y - min_y))) + 0.5) AS INT) AS h
        FROM (SELECT tile_id, count(*) AS n, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y,
                     min(z) AS min_z, max(z) AS max_z FROM {points} GROUP BY tile_id)"""


def _placed(points: str, tiles: str) -> str:
    return f"""
        SELECT p.tile_id, p.seq,
               CAST(floor((w - 1) / (max_x - min_x) * (x - min_x) + 0.5) AS INT) AS px,
               CAST(h - floor((h - 1) / (max_y - min_y) * (y - min_y) + 0.5) - 1 AS INT) AS py,
               (w - 1) / (max_x - min_x) * (z - min_z) AS height,
               (w - 1) / (max_x - min_x) * 1000 * z AS scaled
        FROM {points} p JOIN {tiles} t ON t.tile_id = p.tile_id"""


# Sums of a region; dx and dy are offsets from the cell that names it.
_SUMS = {"sum_x": "c.px", "sum_y": "c.py", "sx": "dx", "sy": "dy", "sh": "height", "sxx": "dx * dx", "sxy": "dx * dy", "syy": "dy * dy",
         "sxh": "dx * height", "syh": "dy * height", "shh": "height * height"}
# The same after the origin is moved by (mx, my).
_MOVED = {"sum_x": "sum_x", "sum_y": "sum_y", "sx": "sx + n * mx", "sy": "sy + n * my", "sh": "sh", "sxx": "sxx + 2 * mx * sx + n * mx * mx",
          "sxy": "sxy + mx * sy + my * sx + n * mx * my", "syy": "syy + 2 * my * sy + n * my * my", "sxh": "sxh + mx * sh", "syh": "syh + my * sh", "shh": "shh"}
# Passes of merging in the SQL; once nothing is absorbed, a further one changes nothing.
PASSES = 5


def _merging(name: str, slope: str, azimuth: str, cmp: str = ">") -> dict[str, str]:
    """Merging as tables named ``<name>_...``, pass by pass, one region after the other: the regions in order (``at``), their attributes (``is``), pairs that may
    merge (``may``), the walk over the order (``go``), who went where (``to``). Starts from ``<name>_at0 (tile_id, region_id, n, rank, sums)``."""
    ctes = {}
    for i in range(PASSES):
        at, is_, may, go, to = (f"{name}_{part}{i}" for part in ("at", "is", "may", "go", "to"))
        cov = ", ".join(f"CASE WHEN n > 1 THEN ({s} - {a} * CAST({b} AS DOUBLE) / n) / (n - 1) ELSE 0 END AS {c}" for c, s, a, b in (
            ("cxx", "sxx", "sx", "sx"), ("cxy", "sxy", "sx", "sy"), ("cyy", "syy", "sy", "sy"), ("cxh", "sxh", "sx", "sh"), ("cyh", "syh", "sy", "sh"), ("chh", "shh", "sh", "sh")))
        keys = "tile_id, region_id, n, rank, cx, cy"
        ctes[is_] = _oriented(_plane(f"(SELECT {keys.replace('cx, cy', 'CAST(sum_x // n AS INT) AS cx, CAST(sum_y // n AS INT) AS cy')}, {cov} FROM {at})", keys))
        # Regions of a tile are bits of a number, by their rank; a tile has fewer than 62.
        ctes[may] = f"""
            SELECT tile_id, a_rank, CAST(sum(CAST(1 AS BIGINT) << CAST(b_rank AS INT)) AS BIGINT) AS bits FROM (
              SELECT p.tile_id, p.rank AS a_rank, q.rank AS b_rank, p.cx <> q.cx AND p.cy <> q.cy AND p.rank < q.rank
                     AND abs(q.slope - p.slope) {cmp} {slope} AND abs(q.azimuth - p.azimuth) < {azimuth} AND NOT isnan(p.azimuth) AND NOT isnan(q.azimuth) AS fits
              FROM {is_} p JOIN {is_} q ON q.tile_id = p.tile_id JOIN {name}_seeds s ON s.tile_id = q.tile_id AND s.region_id = q.region_id
              QUALIFY row_number() OVER (PARTITION BY p.tile_id, p.region_id
                ORDER BY (p.cx - q.cx) * (p.cx - q.cx) + (p.cy - q.cy) * (p.cy - q.cy), q.cx, q.cy, s.seed) <= 5) WHERE fits GROUP BY ALL"""
        ctes[go] = f"""
            SELECT tile_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS gone, CAST(0 AS BIGINT) AS news FROM (SELECT DISTINCT tile_id FROM {at})
            UNION ALL
            SELECT tile_id, i, gone | news, news FROM (
              SELECT g.tile_id, r.rank AS i, g.gone, CASE WHEN (g.gone >> CAST(r.rank AS INT)) & 1 = 1 THEN 0 ELSE coalesce(m.bits, 0) & ~g.gone END AS news
              FROM {go} g JOIN {at} r ON r.tile_id = g.tile_id AND r.rank = g.i + 1 LEFT JOIN {may} m ON m.tile_id = r.tile_id AND m.a_rank = r.rank)"""
        ctes[to] = f"""
            SELECT b.tile_id, b.region_id, a.region_id AS target FROM {go} g JOIN {at} a ON a.tile_id = g.tile_id AND a.rank = g.i
            JOIN {at} b ON b.tile_id = g.tile_id AND (g.news >> CAST(b.rank AS INT)) & 1 = 1"""
        ctes[f"{name}_at{i + 1}"] = f"""
            SELECT tile_id, region_id, n, row_number() OVER (PARTITION BY tile_id ORDER BY n DESC, rank) AS rank, {', '.join(_SUMS)}
            FROM (SELECT tile_id, coalesce(target, region_id) AS region_id, CAST(sum(n) AS BIGINT) AS n, min(CASE WHEN target IS NULL THEN rank END) AS rank,
                         {', '.join(f'sum({v}) AS {c}' for c, v in _MOVED.items())}
                  FROM (SELECT *, CAST((region_id & 4294967295) - (coalesce(target, region_id) & 4294967295) AS DOUBLE) AS mx,
                               CAST((region_id >> 32) - (coalesce(target, region_id) >> 32) AS DOUBLE) AS my
                        FROM {at} LEFT JOIN (SELECT tile_id, region_id, target FROM {to}) USING (tile_id, region_id)) r
                  GROUP BY tile_id, coalesce(target, region_id))"""
    last = f"{name}_at{PASSES}"
    ctes[f"{name}_done"] = ctes[f"{name}_is0"].replace(f"{name}_at0", last)
    chain = f"{name}_at0 r"
    target = "r.region_id"
    for i in range(PASSES):
        chain += f" LEFT JOIN {name}_to{i} t{i} ON t{i}.tile_id = r.tile_id AND t{i}.region_id = {target}"
        target = f"coalesce(t{i}.target, {target})"
    ctes[f"{name}_faces"] = f"SELECT r.tile_id, r.region_id, {target} AS face_id FROM {chain}"
    return ctes


def _oriented(planes: str) -> str:
    """Slope and azimuth of the normals in a table."""
    return f"""
        SELECT *, degrees(acos(least(abs(nz), 1.0))) AS slope,
               CASE WHEN nx = 0 AND ny = 0 THEN CAST('NaN' AS DOUBLE)
                    WHEN nx < 0 AND ny < 0 THEN 360 - t WHEN nx < 0 THEN 270 - t
                    WHEN ny >= 0 THEN 180 - t ELSE t END AS azimuth
        FROM (SELECT *, degrees(atan2(abs(nx), abs(ny))) AS t FROM ({planes}))"""


_FIT = "tile_id, px, py, n"
# fixed values: the last roof parameter set
GROW = dict(smoothness=0.99, curvature=0.02, color=15.0, k=8, limit=10)

CTES: dict[str, str] = {
    **fx.SQL,
    "tiles": _tiles("points"),
    "placed": _placed("points", "tiles"),
    "cells": _cells("placed", "tiles"),
    "roof_tiles": _tiles("roof_points"),
    "roof_placed": _placed("roof_points", "roof_tiles"),
    "roof_cells": _cells("roof_placed", "roof_tiles"),
    "nbr8": _nbr(8, 5),
    "nbr54": _nbr(54, 9),
    "moments8": _fit(8, 5),
    "moments54": _fit(54, 9),
    "fits8": _plane("moments8", _FIT),
    "fits54": _plane("moments54", _FIT),
    "ranges8": """
        SELECT f.tile_id, least(min(curv), CASE WHEN count(*) < max(w) * max(h) THEN 0.0 ELSE min(curv) END) AS low,
               greatest(max(curv), CASE WHEN count(*) < max(w) * max(h) THEN 0.0 ELSE max(curv) END) AS high,
               sum(curv) / (max(w) * max(h)) AS mean
        FROM fits8 f JOIN roof_tiles t ON t.tile_id = f.tile_id GROUP BY f.tile_id""",
    "grown8": """
        SELECT f.tile_id, f.px, f.py, f.nx, f.ny, f.nz, c.height, c.intensity,
               (CAST(f.py AS BIGINT) << 32) | f.px AS cell_id,
               CASE WHEN high > low THEN round((curv - low) / (high - low), 9) ELSE 0 END AS ncurv
        FROM fits8 f JOIN ranges8 r ON r.tile_id = f.tile_id
        JOIN roof_cells c ON c.tile_id = f.tile_id AND c.px = f.px AND c.py = f.py""",
    "edges8": """
        SELECT e.tile_id, p.cell_id AS u, q.cell_id AS v,
               (p.nx*q.nx + p.ny*q.ny + p.nz*q.nz)
                 / (sqrt(p.nx*p.nx + p.ny*p.ny + p.nz*p.nz) * sqrt(q.nx*q.nx + q.ny*q.ny + q.nz*q.nz)) AS cosine,
               abs(q.ncurv - p.ncurv) AS dcurv, abs(q.intensity - p.intensity) AS dcolor
        FROM nbr8 e
        JOIN grown8 p ON p.tile_id = e.tile_id AND p.px = e.px AND p.py = e.py
        JOIN grown8 q ON q.tile_id = e.tile_id AND q.px = e.qx AND q.py = e.qy
        WHERE e.px <> e.qx OR e.py <> e.qy""",
    "smooth8": f"SELECT * FROM edges8 WHERE cosine > {GROW['smoothness']}",
    "strong8": f"""
        SELECT DISTINCT tile_id, a, b FROM (
          SELECT tile_id, u AS a, v AS b FROM smooth8 WHERE dcurv < {GROW['curvature']} AND dcolor < {GROW['color']}
          UNION ALL
          SELECT tile_id, v AS a, u AS b FROM smooth8 WHERE dcurv < {GROW['curvature']} AND dcolor < {GROW['color']})""",
    "labels8": """
        SELECT tile_id, cell_id, cell_id AS root FROM grown8
        UNION
        SELECT e.tile_id, e.b, min(l.root) FROM labels8 l
        JOIN strong8 e ON e.tile_id = l.tile_id AND e.a = l.cell_id
        JOIN recurring.labels8 r ON r.tile_id = e.tile_id AND r.cell_id = e.b
        WHERE l.root < r.root GROUP BY e.tile_id, e.b""",
    "anchored8": """
        SELECT l.tile_id, l.cell_id, l.root, s.cell_id IS NOT NULL AS strong, g.ncurv, g.intensity, g.height, g.px, g.py
        FROM labels8 l JOIN grown8 g ON g.tile_id = l.tile_id AND g.cell_id = l.cell_id
        LEFT JOIN (SELECT DISTINCT tile_id, a AS cell_id FROM strong8) s
          ON s.tile_id = l.tile_id AND s.cell_id = l.cell_id""",
    "seeds8": """
        SELECT tile_id, root, min(ROW(ncurv, cell_id)) AS seed FROM anchored8 WHERE strong GROUP BY ALL""",
    "region_cells8": """
        SELECT a.tile_id, a.cell_id, a.px, a.py, a.ncurv, a.intensity, a.height, coalesce(j.root, a.root) AS region_id,
               j.root IS NULL AS anchor
        FROM anchored8 a LEFT JOIN (
          SELECT e.tile_id, e.v AS cell_id, min_by(s.root, s.seed) AS root
          FROM smooth8 e JOIN anchored8 w ON w.tile_id = e.tile_id AND w.cell_id = e.v AND NOT w.strong
          JOIN anchored8 u ON u.tile_id = e.tile_id AND u.cell_id = e.u AND u.strong
          JOIN seeds8 s ON s.tile_id = u.tile_id AND s.root = u.root
          GROUP BY ALL) j ON j.tile_id = a.tile_id AND j.cell_id = a.cell_id""",
    "regions8": """
        SELECT r.tile_id, r.region_id, count(*) AS n, sum(ncurv) AS sum_curv, sum(px) AS sum_x, sum(py) AS sum_y,
               sum(intensity) AS sum_color, min(CASE WHEN anchor THEN ROW(ncurv, cell_id) END) AS seed,
               coalesce(covar_samp(px, px), 0) AS cxx, coalesce(covar_samp(px, py), 0) AS cxy,
               coalesce(covar_samp(py, py), 0) AS cyy, coalesce(covar_samp(px, height), 0) AS cxh,
               coalesce(covar_samp(py, height), 0) AS cyh, coalesce(covar_samp(height, height), 0) AS chh
        FROM region_cells8 r GROUP BY r.tile_id, r.region_id""",
    "planes8": _plane("regions8", "tile_id, region_id, n AS size, sum_curv, sum_x, sum_y, seed"),
    "attrs8": """
        SELECT *, CAST(sum_x // size AS INT) AS cx, CAST(sum_y // size AS INT) AS cy,
               degrees(acos(least(abs(nz), 1.0))) AS slope,
               CASE WHEN nx = 0 AND ny = 0 THEN CAST('NaN' AS DOUBLE)
                    WHEN nx < 0 AND ny < 0 THEN 360 - t WHEN nx < 0 THEN 270 - t
                    WHEN ny >= 0 THEN 180 - t ELSE t END AS azimuth
        FROM (SELECT *, degrees(atan2(abs(nx), abs(ny))) AS t FROM planes8)""",
    "large8": f"SELECT * FROM attrs8 WHERE size > {GROW['limit']}",
    "near8": """
        SELECT p.tile_id, p.region_id, q.region_id AS other_id, p.cx AS px, p.cy AS py, q.cx AS qx, q.cy AS qy,
               (p.cx - q.cx) * (p.cx - q.cx) + (p.cy - q.cy) * (p.cy - q.cy) AS d2,
               p.size AS p_size, q.size AS q_size, p.seed AS p_seed, q.seed AS q_seed, p.slope AS p_slope,
               q.slope AS q_slope, p.azimuth AS p_azimuth, q.azimuth AS q_azimuth
        FROM large8 p JOIN large8 q ON p.tile_id = q.tile_id
        QUALIFY row_number() OVER (PARTITION BY p.tile_id, p.region_id
          ORDER BY (p.cx - q.cx) * (p.cx - q.cx) + (p.cy - q.cy) * (p.cy - q.cy), q.cx, q.cy, q.seed) <= 5""",
    "merge8_seeds": f"SELECT tile_id, region_id, n, seed FROM regions8 WHERE n > {GROW['limit']}",
    "merge8_at0": f"""
        SELECT c.tile_id, c.region_id, count(*) AS n, row_number() OVER (PARTITION BY c.tile_id ORDER BY count(*) DESC, any_value(s.seed)) AS rank,
               {', '.join(f'sum({v}) AS {k}' for k, v in _SUMS.items())}
        FROM (SELECT *, CAST(px - (region_id & 4294967295) AS DOUBLE) AS dx, CAST(py - (region_id >> 32) AS DOUBLE) AS dy FROM region_cells8) c
        JOIN merge8_seeds s ON s.tile_id = c.tile_id AND s.region_id = c.region_id GROUP BY c.tile_id, c.region_id""",
    **_merging("merge8", "1.0", "40.0"),
    "result_crs": """
        SELECT r.tile_id, r.face_id, m02 + 0.5 * x0 AS xa, m02 + 0.5 * x1 AS xb,
               m12 - 0.5 * y1 AS ya, m12 - 0.5 * y0 AS yb FROM result r JOIN georef g ON g.tile_id = r.tile_id""",
    "pairs": """
        SELECT g.tile_id, g.face_id AS gold_face, r.face_id AS result_face,
               greatest(least(g.x1, r.x1) - greatest(g.x0, r.x0), 0)
                 * greatest(least(g.y1, r.y1) - greatest(g.y0, r.y0), 0) AS overlap,
               (g.x1 - g.x0) * (g.y1 - g.y0) AS gold_area, (r.x1 - r.x0) * (r.y1 - r.y0) AS result_area
        FROM gold g JOIN result r ON g.tile_id = r.tile_id AND g.x0 <= r.x1 AND r.x0 <= g.x1
          AND g.y0 <= r.y1 AND r.y0 <= g.y1""",
    "best": """
        SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY tile_id, gold_face
          ORDER BY overlap DESC, result_face DESC) = 1""",
    "face_pixels": """
        SELECT tile_id, px, py, CAST(floor(height / 3) AS BIGINT) AS face_id,
               (CAST(py AS BIGINT) << 32) | px AS cell_id FROM cells""",
    "sides": """
        SELECT p.tile_id, p.cell_id AS a, q.cell_id AS b FROM face_pixels p JOIN face_pixels q
          ON q.tile_id = p.tile_id AND q.face_id = p.face_id AND abs(q.px - p.px) + abs(q.py - p.py) = 1""",
    "part_labels": """
        SELECT tile_id, cell_id, cell_id AS root FROM face_pixels
        UNION
        SELECT e.tile_id, e.b, min(l.root) FROM part_labels l JOIN sides e ON e.tile_id = l.tile_id AND e.a = l.cell_id
        JOIN recurring.part_labels r ON r.tile_id = e.tile_id AND r.cell_id = e.b
        WHERE l.root < r.root GROUP BY e.tile_id, e.b""",
}
KEYED = {"labels8": "(tile_id, cell_id, root) USING KEY (tile_id, cell_id)",
         "part_labels": "(tile_id, cell_id, root) USING KEY (tile_id, cell_id)",
         **{name: "" for name in CTES if "_go" in name}}


def _outputs(select: str) -> set[str]:
    """Names of the columns that a SELECT lists."""
    items, depth = [""], 0
    for word in re.split(r"(\s+|[(),])", select.strip()[len("SELECT"):]):
        depth += (word == "(") - (word == ")")
        if depth == 0 and word == "FROM":
            break
        if depth == 0 and word == ",":
            items.append("")
        else:
            items[-1] += word
    return {re.split(r"[\s.]", item.strip())[-1] for item in items}


def text(select: str) -> str:
    """``select`` with every table expression it needs, in order."""
    needed: set[str] = set()

    def visit(body: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"(?<!\.)\b{name}\b", body):
                needed.add(name)
                visit(CTES[name])

    visit(select)
    if not needed:
        return select
    # big tables that several others read are computed once
    parts = [f"{n}{KEYED.get(n, '')} AS {'' if n in KEYED else 'MATERIALIZED '}({CTES[n]})" for n in CTES if n in needed]
    names = [n for n in ("tile_id", "apn") if n in _outputs(select)]
    if names:
        casts = ", ".join(f"CAST({n} AS VARCHAR) AS {n}" for n in names)
        select = f"SELECT * REPLACE ({casts}) FROM ({select})"
    return f"WITH RECURSIVE {', '.join(parts)} {select}"
