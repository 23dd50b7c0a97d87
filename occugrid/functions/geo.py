"""Grid-cell column expressions.

A *cell* is a 1 degree square. A *tile* is a block of 8 x 8 cells: one BIGINT holds the
occupancy of a whole tile, one bit per cell. The globe has 181 * 361 cells and so at most
24 * 46 = 1,104 tiles, however many observations there are.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TILE_SHIFT = 3  # 2**3 = 8 cells per tile edge
TILE_EDGE = 1 << TILE_SHIFT
TILE_CELLS = TILE_EDGE * TILE_EDGE


def is_finite(coordinate: Column) -> Column:
    """False for null, NaN and infinities."""
    return F.coalesce(F.abs(coordinate) < F.lit(float("inf")), F.lit(False))


def grid_cell(coordinate: Column) -> Column:
    """Floor toward minus infinity as BIGINT; fails on a missing or non-finite coordinate.

    Without the guard Spark turns ``floor(NaN)`` into 0 and silently invents a cell.
    """
    return F.when(is_finite(coordinate), F.floor(coordinate)).otherwise(
        F.raise_error(F.lit("coordinate is null, NaN or infinite")).cast("bigint")
    )


def region_key(grid_lat: Column, grid_lon: Column) -> Column:
    return F.concat(
        grid_lat.cast("string"), F.lit("°"), grid_lon.cast("string"), F.lit("°")
    )


def hemisphere(latitude: Column) -> Column:
    return F.when(latitude >= 0, F.lit("N")).otherwise(F.lit("S"))


def group_key(grid_lat: Column, grid_lon: Column) -> Column:
    """Integer key of a cell used as cross-validation group."""
    return grid_lat * 1000 + grid_lon


def block_key(grid_lat: Column, grid_lon: Column, block_deg: int) -> Column:
    """Integer key of the block of ``block_deg`` x ``block_deg`` cells; blocks of 1 are the cells."""
    return group_key(F.floor(grid_lat / block_deg), F.floor(grid_lon / block_deg))


def tile_index(grid: Column) -> Column:
    """Tile row or column of a cell index (arithmetic shift, so it floors negatives too)."""
    return F.shiftright(grid, TILE_SHIFT)


def cell_bit(grid_lat: Column, grid_lon: Column) -> Column:
    """Position 0..63 of a cell inside its tile."""
    inside_lat = grid_lat.bitwiseAND(TILE_EDGE - 1)
    inside_lon = grid_lon.bitwiseAND(TILE_EDGE - 1)
    return (inside_lat * TILE_EDGE + inside_lon).cast("int")


def bit_flag(position: Column) -> Column:
    """BIGINT with the single bit ``position`` (0..63) set."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), position.cast("int"))


def first_region_in_tile(tile_lat: Column, tile_lon: Column, mask: Column) -> Column:
    """Smallest region key, in string order, among the cells set in ``mask``."""
    positions = F.filter(
        F.sequence(F.lit(0), F.lit(TILE_CELLS - 1)), lambda i: F.getbit(mask, i) == 1
    )
    return F.array_min(
        F.transform(
            positions,
            lambda i: region_key(
                tile_lat * TILE_EDGE + F.shiftright(i, TILE_SHIFT),
                tile_lon * TILE_EDGE + i.bitwiseAND(TILE_EDGE - 1),
            ),
        )
    )
