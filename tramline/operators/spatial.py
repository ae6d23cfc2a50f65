"""Points laid out along a curve that keeps neighbours together, and boxes read from such a layout.

A point's cell is the number of its place on the Z-order curve through a grid of 2^BITS by 2^BITS. Files are sorted by it, so their row groups have narrow
ranges of cells; a box is a few ranges, and what lies outside these is skipped by Parquet's statistics before a row is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a cell's number for each axis, and ranges at most that a box is cut into.
BITS, RANGES = 20, 64
CELL = "_cell"
#: Bytes of a row group: smaller ones skip more.
GROUP_BYTES = 1 << 20
#: Fixed: shifts and masks that put a zero bit before each bit of a number of 32 bits.
SPREAD = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def _grid(value: Column, low: float, high: float) -> Column:
    """The column of the grid that a coordinate lies in; those beyond the world count to its edge."""
    at = F.floor((value.cast("double") - low) / (high - low) * (1 << BITS))
    return F.least(F.greatest(at, F.lit(0)), F.lit((1 << BITS) - 1)).cast("long")


def cell(longitude: Column, latitude: Column) -> Column:
    """Null where a coordinate is null or no finite number."""
    out = F.lit(0).cast("long")
    for shift, (value, low, high) in enumerate(((longitude, -180.0, 180.0), (latitude, -90.0, 90.0))):
        x = _grid(value, low, high)
        for by, mask in SPREAD:
            x = x.bitwiseOR(F.shiftleft(x, by)).bitwiseAND(F.lit(mask))
        out = out.bitwiseOR(F.shiftleft(x, shift))
    finite = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))
    return F.when(finite(longitude) & finite(latitude), out)


def write_clustered(points: DataFrame, path: str, files: int | None = None, group_bytes: int = GROUP_BYTES) -> None:
    """Points sorted along the curve, in files of ranges of cells; rows without a place come first. Points of one place that fill several files are dealt by a hash."""
    columns = points.columns
    rows = points.withColumn(CELL, cell(F.col("longitude"), F.col("latitude")))
    keys = (CELL, F.xxhash64(*columns))
    rows = rows.repartitionByRange(files, *keys) if files else rows.repartitionByRange(*keys)
    rows.sortWithinPartitions(CELL).write.option("parquet.block.size", group_bytes).mode("overwrite").parquet(path)


def ranges(west: float, south: float, east: float, north: float, most: int = RANGES) -> list[tuple[int, int]]:
    """Ranges of cells (both ends included) that hold the box: squares of the grid that it touches, cut finer while there are few, then joined."""
    size = 1 << BITS
    at = lambda v, low, high: min(max(int((v - low) / (high - low) * size), 0), size - 1)
    x0, x1, y0, y1 = at(west, -180, 180), at(east, -180, 180), at(south, -90, 90), at(north, -90, 90)
    whole: list[tuple[int, int]] = []
    open_ = [(0, 0, BITS, 0)]
    while open_ and len(open_) + len(whole) < 2 * most:
        finer = []
        for x, y, bits, z in open_:
            side = 1 << bits
            if x0 <= x and x + side - 1 <= x1 and y0 <= y and y + side - 1 <= y1 or not bits:
                whole.append((z, z + (1 << 2 * bits) - 1))
                continue
            half = side >> 1
            for k in range(4):
                a, b = x + half * (k & 1), y + half * (k >> 1)
                if a <= x1 and a + half > x0 and b <= y1 and b + half > y0:
                    finer.append((a, b, bits - 1, z + (k << 2 * (bits - 1))))
        open_ = finer
    joined: list[list[int]] = []
    for a, b in sorted(whole + [(z, z + (1 << 2 * bits) - 1) for _, _, bits, z in open_]):
        if joined and a <= joined[-1][1] + 1:
            joined[-1][1] = max(joined[-1][1], b)
        else:
            joined.append([a, b])
    while len(joined) > most:  # the narrowest gap goes
        k = min(range(1, len(joined)), key=lambda k: joined[k][0] - joined[k - 1][1])
        joined[k - 1 : k + 1] = [[joined[k - 1][0], joined[k][1]]]
    return [(a, b) for a, b in joined]


def boxed(clustered: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """The points of a layout within a box, edges included; one whose west lies east of its east crosses the 180th meridian. Coordinates decide, cells only skip."""
    sides = [(west, east)] if west <= east else [(west, 180.0), (-180.0, east)]
    lon = F.col("longitude")
    # coordinates beyond the world are still compared as they are
    across = lon.between(west, east) if west <= east else (lon >= west) | (lon <= east)
    skip = F.lit(False)
    for a, b in sorted({r for w, e in sides for r in ranges(w, south, e, north)}):
        skip = skip | F.col(CELL).between(a, b)
    return clustered.filter(skip & across & F.col("latitude").between(south, north)).drop(CELL)


def read_boxed(spark: SparkSession, path: str, west: float, south: float, east: float, north: float) -> DataFrame:
    return boxed(spark.read.parquet(path), west, south, east, north)
