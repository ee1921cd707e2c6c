"""Cells of small regions go to the face of the nearest cell of a large one."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from slopeweave.functions.cells import cell_px, cell_py
from slopeweave.operators.blocks import by_group
from slopeweave.operators.growth import SCOPE
from slopeweave.operators.joins import attach
from slopeweave.session import cut

# Rows of cells in one task.
BAND = 128
# Distances (rows times columns) held at once.
HELD = 1 << 20
SMALL, LARGE, CARRIED = 0, 1, 2
_ROWS = ["kind", "px", "py", "face_id", "below_py", "below_face"]
_SCHEMA = "param_id INT, tile_id STRING, cell_id BIGINT, face_id BIGINT"


def least_per_query(x: np.ndarray, row: np.ndarray, columns: np.ndarray, height2: np.ndarray) -> np.ndarray:
    """For each query (x, row), in order of row and x: the first column c that minimises (x - columns[c])^2 + height2[row, c].

    Along a row the answers never step back. So the middle query of a run of queries is answered from all columns that its run may have, and
    its answer bounds those of the halves on either side; all runs of all rows are halved together.
    """
    best = np.zeros(len(x), np.int64)
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1])[:len(row)])
    low, high = first, np.append(first[1:], len(row))
    least, most = np.zeros(len(first), np.int64), np.full(len(first), len(columns) - 1)
    while len(low):
        middle, count = (low + high) // 2, most - least + 1
        start = np.cumsum(count) - count
        at = np.arange(count.sum()) + np.repeat(least - start, count)
        run = np.repeat(np.arange(len(low)), count)
        d2 = (x[middle][run] - columns[at]) ** 2 + height2[row[middle][run], at]
        hit = np.flatnonzero(d2 == np.minimum.reduceat(d2, start)[run])
        found = at[hit[np.searchsorted(run[hit], np.arange(len(low)))]]
        best[middle] = found
        low, high, least, most = (np.concatenate(pair) for pair in ((low, middle + 1), (middle, high), (least, found), (found, most)))
        some = low < high
        low, high, least, most = low[some], high[some], least[some], most[some]
    return best


def _absorb_band(key: tuple, part: pa.Table) -> pa.Table:
    """Faces of the small cells of one band of rows, from the band's large cells and the next ones above and below it in each column."""
    kind, px, py, face, below_py, below_face = (part[c].to_numpy() for c in _ROWS)
    px, py = px.astype(np.int64), py.astype(np.int64)
    carried = np.flatnonzero(kind == CARRIED)
    carried = carried[np.argsort(px[carried])]
    columns = px[carried]
    # Rows are counted from the band's first one; far away stands for nothing above or below.
    own = np.flatnonzero(kind != CARRIED)
    base, far = py[own].min(), np.int64(1) << 30
    span = py[own].max() - base + 2
    above, above_face = np.where(face[carried] >= 0, py[carried] - base, -far), face[carried]
    below, below_face = np.where(below_face[carried] >= 0, below_py[carried] - base, far), below_face[carried]
    large = np.flatnonzero(kind == LARGE)
    place = np.searchsorted(columns, px[large]) * span + py[large] - base
    order = np.argsort(place)
    place, face_at = np.append(place[order], np.iinfo(np.int64).max), np.append(face[large[order]], -1)

    def next_ones(column: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
        """Row and face of the nearest large cell of the column at or above y, and of that at or below y."""
        asked = column * span + y
        last = np.searchsorted(place, asked, "right") - 1
        next_ = np.searchsorted(place, asked, "left")
        up, down = (last >= 0) & (place[last] // span == column), place[next_] // span == column
        return (np.where(up, place[last] - column * span, above[column]), np.where(up, face_at[last], above_face[column]),
                np.where(down, place[next_] - column * span, below[column]), np.where(down, face_at[next_], below_face[column]))

    small = np.flatnonzero(kind == SMALL)
    small = small[np.lexsort((px[small], py[small]))]
    result = np.empty(len(small), np.int64)
    rows, row_of = np.unique(py[small] - base, return_inverse=True)
    step = max(1, HELD // max(len(columns), 1))
    for first in range(0, len(rows), step):
        some = rows[first:first + step]
        column, y = np.tile(np.arange(len(columns)), len(some)), np.repeat(some, len(columns))
        up, _, down, _ = next_ones(column, y)
        height2 = (np.minimum(y - up, down - y) ** 2).reshape(len(some), -1)
        here = slice(*np.searchsorted(row_of, [first, first + len(some)]))
        x, row = px[small[here]], row_of[here] - first
        best = least_per_query(x, row, columns, height2)
        up, up_face, down, down_face = next_ones(best, some[row])
        result[here] = np.where(some[row] - up <= down - some[row], up_face, down_face)
    scope = [key[0].as_py(), key[1].as_py()]
    return pa.table({"param_id": pa.array([scope[0]] * len(small), pa.int32()), "tile_id": pa.array([scope[1]] * len(small), pa.string()),
                     "cell_id": py[small] << 32 | px[small], "face_id": result})


def absorb_small(small: DataFrame, large: DataFrame, band: int = BAND) -> DataFrame:
    """Face of the nearest large cell for every small cell; ties by column, then row.

    ``small`` is ``(param_id, tile_id, cell_id)``, ``large`` has ``face_id`` (0 or more) too; both are
    written tables. Cells of tiles without any large region are left out.

    An exact distance transform in two passes. Down the columns: each column of a band learns the next large cells above and below the
    band, carried over the bands between. Along the rows: a row's small cells find the column whose next large cell is
    nearest. Distances have no bound, and a task holds one band of a tile's rows.
    """
    x, y = cell_px(F.col("cell_id")).cast("int"), cell_py(F.col("cell_id")).cast("int")
    at_band = F.floor(F.col("py") / band).cast("int")
    tiles = cut(large.select(*SCOPE).distinct(), "tiles")
    todo = attach(small.select(*SCOPE, x.alias("px"), y.alias("py")), tiles, SCOPE, "left_semi").withColumn("band", at_band)
    big = large.select(*SCOPE, x.alias("px"), y.alias("py"), "face_id").withColumn("band", at_band)
    asked = cut(todo.select(*SCOPE, "band").distinct(), "asked")

    ends = big.groupBy(*SCOPE, "px", "band").agg(F.min(F.struct("py", "face_id")).alias("top"), F.max(F.struct("py", "face_id")).alias("bottom"))
    ends = cut(ends, "column-ends")
    # A tile's bands, one for each 128 rows, as one array; its columns are repeated for those with small cells.
    bands = cut(asked.groupBy(*SCOPE).agg(F.collect_list("band").alias("bands")), "bands")
    wanted = attach(ends.select(*SCOPE, "px").distinct(), bands, SCOPE).select(*SCOPE, "px", F.explode("bands").alias("band"))
    both = (ends.withColumn("asked", F.lit(False)).unionByName(wanted.withColumn("asked", F.lit(True)), allowMissingColumns=True)
            .groupBy(*SCOPE, "px", "band").agg(F.max("top").alias("top"), F.max("bottom").alias("bottom"), F.max("asked").alias("asked")))
    column = Window.partitionBy(*SCOPE, "px").orderBy("band")
    carried = both.select(
        *SCOPE, "px", "band", "asked", F.last("bottom", True).over(column.rowsBetween(Window.unboundedPreceding, -1)).alias("above"),
        F.first("top", True).over(column.rowsBetween(1, Window.unboundedFollowing)).alias("below")).filter("asked")

    none = F.lit(-1)
    def rows(df: DataFrame, kind: int, py, face, below_py=none, below_face=none) -> DataFrame:
        kinds = {"px": "int", "py": "int", "face_id": "bigint", "below_py": "int", "below_face": "bigint"}
        values = dict(zip(kinds, (F.col("px"), py, face, below_py, below_face)))
        return df.select(*SCOPE, "band", F.lit(kind).cast("tinyint").alias("kind"), *[F.coalesce(v, none).cast(kinds[n]).alias(n) for n, v in values.items()])

    met = (rows(todo, SMALL, F.col("py"), none)
           .unionByName(rows(attach(big, asked, [*SCOPE, "band"], "left_semi"), LARGE, F.col("py"), F.col("face_id")))
           .unionByName(rows(carried, CARRIED, F.col("above.py"), F.col("above.face_id"), F.col("below.py"), F.col("below.face_id"))))
    return cut(by_group(met, [*SCOPE, "band"], _absorb_band, _SCHEMA), "absorbed")


def paint(cells: DataFrame, faces: DataFrame) -> DataFrame:
    """Face colour of every cell, 0 where there is no face. ``cells`` is ``(param_id, tile_id,
    cell_id)``; ``faces`` adds ``color``.

    Both have a row for each cell, so they are merged: Spark may take generated or well compressed rows for few and would send
    them all to the driver."""
    return (cells.join(faces.select(*SCOPE, "cell_id", "color").hint("merge"), [*SCOPE, "cell_id"], "left")
            .withColumn("color", F.coalesce("color", F.lit(0))))
