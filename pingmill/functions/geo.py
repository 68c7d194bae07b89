"""Distances and the city grid as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the data model: earth radius in km, planar scale, grid origin, cell size, rows of the grid.
EARTH_KM, PLANAR = 6372.8, 3.33
GRID_LON, GRID_LAT, CELL, GRID_ROWS = -98.0, 32.0, 0.002, 699


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(a))


def euclid(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt(F.pow(x2 - x1, 2) + F.pow(y2 - y1, 2)) / PLANAR


def grid_id(lon: Column, lat: Column) -> Column:
    return GRID_ROWS * ((lon - GRID_LON) / CELL).cast("int") + ((lat - GRID_LAT) / CELL).cast("int")


def grid_centre(grid: Column) -> tuple[Column, Column]:
    return GRID_LON + (F.floor(grid / GRID_ROWS) + 0.5) * CELL, GRID_LAT + (grid % GRID_ROWS + 0.5) * CELL


def grid_bounds(lon: Column, lat: Column, cell: float = CELL) -> dict[str, Column]:
    """Borders of a point's cell, reckoned in whole thousandths of a degree: digits after the third are cut before."""
    width = round(cell * 1000)
    low = {c: F.floor((x * 1000).cast("long") / width) * width for c, x in (("lon", lon), ("lat", lat))}
    return {f"{side}_{c}": (low[c] + more) / 1000 for c in ("lon", "lat") for side, more in (("min", 0), ("max", width))}


def neighbour_grids(grid: Column, w: int) -> Column:
    """The (2w + 1) squared cells around a cell, by column, then row."""
    steps = F.sequence(F.lit(-w), F.lit(w))
    return F.flatten(F.transform(steps, lambda c: F.transform(steps, lambda r: grid + c * GRID_ROWS + r)))


def near_grids(a: Column, b: Column, w: int) -> Column:
    """Whether ``b`` is among the ``neighbour_grids`` of ``a``: its steps by row and column, for w below half of the rows."""
    half = GRID_ROWS // 2
    row = F.pmod(b - a + half, F.lit(GRID_ROWS)) - half
    return (F.abs(row) <= w) & (F.abs(b - a - row) <= w * GRID_ROWS)


def grid_manhattan(a: Column, b: Column) -> Column:
    return F.abs(F.floor(a / GRID_ROWS) - F.floor(b / GRID_ROWS)) + F.abs(a % GRID_ROWS - b % GRID_ROWS)
