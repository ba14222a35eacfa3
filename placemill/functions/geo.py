"""Boxes, distances and zoom as columns. A box is a struct of west, south, east, north in degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
EARTH_RADIUS_M = 6_371_008.8
EQUATOR_M_PER_PIXEL = 156_543.03392
VIEWPORT_PIXELS = 1000
KM_PER_DEGREE_LAT = 110.574
KM_PER_DEGREE_LNG = 111.32
SEED_RADII_KM = ((250_000, 22), (100_000, 16), (30_000, 11))
LEAST_RADIUS_KM = 7
MAX_BOX_KM = 12
REGION_MARGIN = 0.05
TRUST_BELOW = 40
CLUSTERED_BELOW = 0.55


def box(west: Column, south: Column, east: Column, north: Column) -> Column:
    return F.struct(west.cast("double").alias("west"), south.cast("double").alias("south"), east.cast("double").alias("east"), north.cast("double").alias("north"))


def box_of(west: float, south: float, east: float, north: float) -> Column:
    return box(*(F.lit(float(x)) for x in (west, south, east, north)))


def mid_lat(b: Column) -> Column:
    return (b.south + b.north) / 2


def mid_lng(b: Column) -> Column:
    return (b.west + b.east) / 2


def centre_of(b: Column) -> Column:
    return F.struct(mid_lat(b).alias("lat"), mid_lng(b).alias("lng"))


def haversine_m(lat_a: Column, lng_a: Column, lat_b: Column, lng_b: Column) -> Column:
    half = lambda x: F.pow(F.sin(F.radians(x) / 2), F.lit(2))
    h = half(lat_b - lat_a) + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * half(lng_b - lng_a)
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(h))


def width_m(b: Column, at: Column) -> Column:
    return haversine_m(at, b.west, at, b.east)


def height_m(b: Column) -> Column:
    return haversine_m(b.south, b.west, b.north, b.west)


def diagonal_m(b: Column) -> Column:
    return haversine_m(b.south, b.west, b.north, b.east)


def metres_per_pixel(lat: Column, zoom: Column) -> Column:
    return EQUATOR_M_PER_PIXEL * F.cos(F.radians(lat)) / F.pow(F.lit(2.0), zoom)


def viewport_width_m(lat: Column, zoom: Column) -> Column:
    return metres_per_pixel(lat, zoom) * VIEWPORT_PIXELS


def zoom_for_width(lat: Column, metres: Column) -> Column:
    """Zoom whose viewport is so many metres wide, to hundredths, within 1 and 21."""
    zoom = F.log2(EQUATOR_M_PER_PIXEL * F.cos(F.radians(lat)) * VIEWPORT_PIXELS / metres)
    return F.least(F.lit(21.0), F.greatest(F.lit(1.0), F.floor(zoom * 100 + 0.5) / 100))


def zoom_for_box(b: Column) -> Column:
    return zoom_for_width(mid_lat(b), F.greatest(width_m(b, mid_lat(b)), F.lit(1.0)))


def children(b: Column) -> Column:
    """Quarters: north-west, north-east, south-west, south-east."""
    lat, lng = mid_lat(b), mid_lng(b)
    return F.array(box(b.west, lat, lng, b.north), box(lng, lat, b.east, b.north), box(b.west, b.south, lng, lat), box(lng, b.south, b.east, lat))


def contains(b: Column, lat: Column, lng: Column) -> Column:
    return lat.between(b.south, b.north) & lng.between(b.west, b.east)


def intersects(a: Column, b: Column) -> Column:
    """Closed boxes: touching counts."""
    return (a.east >= b.west) & (b.east >= a.west) & (a.north >= b.south) & (b.north >= a.south)


def hull(a: Column, b: Column) -> Column:
    return box(F.least(a.west, b.west), F.least(a.south, b.south), F.greatest(a.east, b.east), F.greatest(a.north, b.north))


def in_region(b: Column, lat: Column, lng: Column, margin: float = REGION_MARGIN) -> Column:
    """Within the box and a margin; places without a position stay."""
    return lat.isNull() | lng.isNull() | (lat.between(b.south - margin, b.north + margin) & lng.between(b.west - margin, b.east + margin))


def area_km2(b: Column) -> Column:
    """Rough area, for warnings."""
    return F.abs(b.north - b.south) * KM_PER_DEGREE_LAT * F.abs(b.east - b.west) * KM_PER_DEGREE_LNG * F.cos(F.radians(mid_lat(b)))


def swept_km2(b: Column) -> Column:
    """Ground area by haversine sides."""
    return width_m(b, mid_lat(b)) * height_m(b) / 1_000_000


def radius_km(population: Column) -> Column:
    out = F.lit(LEAST_RADIUS_KM)
    for least, km in reversed(SEED_RADII_KM):
        out = F.when(population >= least, km).otherwise(out)
    return out


def box_around(lat: Column, lng: Column, population: Column) -> Column:
    """Box about a city by population."""
    d_lat = radius_km(population) / 111
    d_lng = radius_km(population) / (111 * F.cos(F.radians(lat)))
    return box(lng - d_lng, lat - d_lat, lng + d_lng, lat + d_lat)


def grid_split(b: Column, max_km: float = MAX_BOX_KM) -> Column:
    """Sub-boxes of at most ``max_km`` a side, rows from the south, columns from the west; the box itself if it is small enough."""
    cols = F.greatest(F.lit(1), F.ceil(width_m(b, mid_lat(b)) / 1000 / max_km)).cast("int")
    rows = F.greatest(F.lit(1), F.ceil(height_m(b) / 1000 / max_km)).cast("int")
    d_lng, d_lat = (b.east - b.west) / cols, (b.north - b.south) / rows
    one = lambda r, c: box(b.west + c * d_lng, b.south + r * d_lat, b.west + (c + 1) * d_lng, b.south + (r + 1) * d_lat)
    every = F.flatten(F.transform(F.sequence(F.lit(0), rows - 1), lambda r: F.transform(F.sequence(F.lit(0), cols - 1), lambda c: one(r, c))))
    return F.when((cols == 1) & (rows == 1), F.array(box(b.west, b.south, b.east, b.north))).otherwise(every)


def extent() -> list[Column]:
    """Aggregates of latitude and longitude: the box of the points that have both, null below two."""
    lat, lng = F.col("latitude"), F.col("longitude")
    both = lat.isNotNull() & lng.isNotNull()
    value = lambda f, c: f(F.when(both, c))
    return [F.when(F.count_if(both) >= 2, box(value(F.min, lng), value(F.min, lat), value(F.max, lng), value(F.max, lat))).alias("extent")]


def spread(cell: Column, extent_: Column) -> Column:
    """Share of a cell's area that the extent of its places has, at most 1."""
    cell_area = width_m(cell, mid_lat(cell)) * height_m(cell)
    area = width_m(extent_, mid_lat(cell)) * height_m(extent_)
    return F.when(extent_.isNull() | (cell_area <= 0), 0.0).otherwise(F.least(F.lit(1.0), area / cell_area))


def saturation(count: Column, spread_: Column) -> Column:
    """"sparse" below a trusted count, else "clustered" if the places huddle, else "count"; the last two are saturated."""
    return F.when(count < TRUST_BELOW, "sparse").when(spread_ < CLUSTERED_BELOW, "clustered").otherwise("count")


def map_cell(column: Column, size: Column) -> Column:
    """Grid cell by truncation toward zero, so those at 0 degrees are twice as wide."""
    return (column / size).cast("long")
