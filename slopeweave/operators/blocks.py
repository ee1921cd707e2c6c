"""Square blocks of cells, and the cells around them, as bounded groups.

Neighbourhood work on a grid touches tens of cells per cell. Instead of emitting a row per
pair, every cell is sent to its own block and to the blocks near enough to see it, and one
task works on one block as arrays. A block holds at most (side + 2 * reach)^2 cells, however
large its tile is.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

SIDE = 128
ROWS_AT_ONCE = 2048
# Rows of results that a task gathers from small groups before it sends them on.
RESULTS_AT_ONCE = 1 << 14


def reach(k: int, w: int, h: int) -> int:
    """Distance within which every cell of a w x h grid has its k nearest cells: a box of k
    cells fits around any cell, and this is the box's diagonal, rounded up."""
    short, long = min(w, h), max(w, h)
    a = max(1, min(short, math.isqrt(max(k, 1) - 1) + 1))
    b = max(1, min(long, -(-k // a)))
    return math.ceil(math.sqrt((a - 1) ** 2 + (b - 1) ** 2))


def reach_column(k: Column, w: Column, h: Column) -> Column:
    """``reach`` as an expression."""
    short, long = F.least(w, h), F.greatest(w, h)
    a = F.greatest(F.lit(1), F.least(short, F.ceil(F.sqrt(k)).cast("int")))
    b = F.greatest(F.lit(1), F.least(long, F.ceil(k / a).cast("int")))
    return F.ceil(F.sqrt((a - 1) * (a - 1) + (b - 1) * (b - 1))).cast("int")


@lru_cache(maxsize=64)
def offsets(radius: int) -> np.ndarray:
    """Offsets (dx, dy) up to a radius, nearest first, ties by dx then dy."""
    span = np.arange(-radius, radius + 1)
    dx, dy = (v.ravel() for v in np.meshgrid(span, span, indexing="ij"))
    d2 = dx * dx + dy * dy
    order = np.lexsort((dy, dx, d2))
    return np.stack([dx, dy], axis=1).astype(np.int32)[order][np.sort(d2) <= radius * radius]


def with_blocks(cells: DataFrame, halo: Column, side: int = SIDE) -> DataFrame:
    """Repeat every cell for each block within ``halo`` of it, as ``bx, by``. Needs w and h."""
    def blocks(axis: str, size: str) -> Column:
        low = F.greatest(F.col(axis) - halo, F.lit(0))
        high = F.least(F.col(axis) + halo, F.col(size) - 1)
        return F.explode(F.sequence(F.floor(low / side).cast("int"), F.floor(high / side).cast("int")))

    return cells.select("*", blocks("px", "w").alias("bx")).select("*", blocks("py", "h").alias("by"))


def near_edge(halo: Column, side: int = SIDE) -> Column:
    """Whether another block may see the cell."""
    def band(axis: str) -> Column:
        at = F.pmod(F.col(axis), F.lit(side))
        return (at < halo) | (at >= side - halo)

    return band("px") | band("py")


def by_group(df: DataFrame, keys: list[str], report: Callable[[tuple, pa.Table], pa.Table], schema: str) -> DataFrame:
    """What ``report(key, rows)`` gives for each group, with the columns of ``schema`` in their order. Rows without a key are a group, too.

    The same as ``applyInArrow`` on the groups, which sends each group to Python and back as a stream of its own. Here a task's rows come in order of their groups
    and are cut there, so many small groups go through in one batch; a task holds one group and one batch.
    """
    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_cut_by_group(keys, report), schema)


def _cut_by_group(keys: list[str], report: Callable[[tuple, pa.Table], pa.Table]):
    def run(batches):
        held, key, results, size = [], None, [], 0

        def reported() -> None:
            nonlocal held, size
            results.append(report(key, pa.Table.from_batches(held)))
            size += len(results[-1])
            held = []

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(batch.schema.get_field_index(c)) for c in keys]
            first = tuple(c[0] for c in columns)
            if held and [v.as_py() for v in first] != [v.as_py() for v in key]:
                reported()
            starts = _group_starts(columns)
            for start, end in zip([0, *starts], [*starts, batch.num_rows]):
                if start:
                    reported()
                if not held:
                    key = tuple(c[start] for c in columns)
                held.append(batch.slice(start, end - start))
            if size >= RESULTS_AT_ONCE:
                yield from pa.concat_tables(results).combine_chunks().to_batches()
                results, size = [], 0
        if held:
            reported()
        if size:
            yield from pa.concat_tables(results).combine_chunks().to_batches()

    return run


def _group_starts(columns: list[pa.Array]) -> list[int]:
    """Rows, but the first, that differ from the one before in any column."""
    new = np.zeros(len(columns[0]) - 1, bool)
    for column in columns:
        code = column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new |= code[1:] != code[:-1]
    return (np.flatnonzero(new) + 1).tolist()


class Window:
    """The cells of one block and of its surroundings, addressable by grid position."""

    def __init__(self, px: np.ndarray, py: np.ndarray, pad: int):
        x, y = px - px.min() + pad, py - py.min() + pad
        self.stride = int(y.max()) + pad + 1
        self.place = x.astype(np.int64) * self.stride + y
        self.at = np.full((int(x.max()) + pad + 1) * self.stride, -1, dtype=np.int32)
        self.at[self.place] = np.arange(len(px), dtype=np.int32)

    def shifted(self, rows: np.ndarray, steps: np.ndarray) -> np.ndarray:
        """Index of the cell at each offset from each of ``rows``, or -1."""
        return self.at[self.place[rows][:, None] + (steps[:, 0] * self.stride + steps[:, 1])]


def nearest(px: np.ndarray, py: np.ndarray, rows: np.ndarray, k: int, w: int, h: int):
    """Yield (rows, offsets, used) for runs of ``rows``: ``used`` tells for each row and offset
    whether that cell is among the row's k nearest cells of the w x h grid."""
    steps = offsets(reach(k, w, h))
    near = np.abs(steps[:k]).max() if len(steps) else 0
    free = ((px[rows] >= near) & (px[rows] < w - near) & (py[rows] >= near) & (py[rows] < h - near)
            & (len(steps) >= k))
    inner, outer = rows[free], rows[~free]
    for start in range(0, len(inner), ROWS_AT_ONCE):
        some = inner[start:start + ROWS_AT_ONCE]
        yield some, steps[:k], np.ones((len(some), k), dtype=bool)
    for start in range(0, len(outer), ROWS_AT_ONCE):
        some = outer[start:start + ROWS_AT_ONCE]
        x, y = px[some][:, None] + steps[:, 0], py[some][:, None] + steps[:, 1]
        inside = (x >= 0) & (x < w) & (y >= 0) & (y < h)
        yield some, steps, inside & (np.cumsum(inside, axis=1, dtype=np.int32) <= k)


def local_components(a: np.ndarray, b: np.ndarray, count: int) -> np.ndarray:
    """Least connected index for each of ``count`` items joined by the pairs (a, b)."""
    label = np.arange(count)
    while True:
        la, lb = label[a], label[b]
        least = np.minimum(la, lb)
        hooked = label.copy()
        np.minimum.at(hooked, la, least)
        np.minimum.at(hooked, lb, least)
        while True:
            jumped = hooked[hooked]
            if np.array_equal(jumped, hooked):
                break
            hooked = jumped
        if np.array_equal(hooked, label):
            return label
        label = hooked
