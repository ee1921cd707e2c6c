"""Point clouds to elevation rasters."""

from __future__ import annotations

from pyspark.sql import DataFrame

from slopeweave.operators.grid import dem_pixels, extents, grid_size
from slopeweave.session import cut


def dem(points: DataFrame) -> DataFrame:
    """Elevation pixels ``(tile_id, px, py, argb)`` of every tile. A tile without points has none."""
    return dem_pixels(points, cut(grid_size(extents(points)), "tiles"))
