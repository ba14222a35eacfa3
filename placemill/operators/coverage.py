"""Coverage: seeds and boxes, adaptive quadtrees, passes, units of work and the boards over them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placemill.functions import geo
from placemill.storage import written

# Fixed values.
MIN_CELL_M, MAX_CELL_M, MAX_DEPTH = 700.0, 60_000.0, 9
PAGE_SIZE, RESULT_CAP = 20, 120

BOX = "west double, south double, east double, north double"


# Seeds to boxes


def merged_boxes(boxes: list[tuple[float, float, float, float]]) -> list[tuple[float, float, float, float]]:
    """Hulls of boxes that touch, until none do; a sweep by west edge makes each round near linear."""
    current = sorted(boxes)
    while True:
        out: list[tuple[float, float, float, float]] = []
        active: list[int] = []
        changed = False
        for w, s, e, n in current:
            active = [i for i in active if out[i] is not None and out[i][2] >= w]
            hit = [i for i in active if out[i][1] <= n and s <= out[i][3]]
            for i in hit:
                w, s, e, n = min(w, out[i][0]), min(s, out[i][1]), max(e, out[i][2]), max(n, out[i][3])
                out[i] = None
                changed = True
            active = [i for i in active if i not in hit]
            active.append(len(out))
            out.append((w, s, e, n))
        current = sorted(b for b in out if b is not None)
        if not changed:
            return current


def _merge_region(frame: pd.DataFrame) -> pd.DataFrame:
    hulls = merged_boxes(list(frame[["west", "south", "east", "north"]].itertuples(index=False, name=None)))
    out = pd.DataFrame(hulls, columns=["west", "south", "east", "north"])
    out.insert(0, "region", frame["region"].iloc[0])
    out.insert(1, "merged", range(len(out)))
    return out


def seed_boxes(seeds: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """``seeds(region, name, lat, lng, population, ord)`` -> coverage boxes: region, merged, part, box, seeds.

    Seeds outside their region's bound (``bounds(region, box)``) are dropped. Each becomes a box by population; boxes that touch merge;
    merged boxes are split to units of work. A region has hundreds of seeds, so merging is one task a region.
    """
    if bounds is not None:
        inside = bounds.select(F.col("region").alias("__r"), F.col("box").alias("__b"))
        seeds = seeds.join(inside, F.col("region") == F.col("__r")).filter(geo.contains(F.col("__b"), F.col("lat"), F.col("lng"))).drop("__r", "__b")
    around = seeds.select("region", geo.box_around(F.col("lat"), F.col("lng"), F.col("population")).alias("b")).select("region", "b.*")
    merged = around.groupBy("region").applyInPandas(_merge_region, f"region string, merged long, {BOX}")
    hulls = merged.select("region", "merged", F.struct("west", "south", "east", "north").alias("hull"))
    named = hulls.alias("h").join(seeds.alias("s"), (F.col("h.region") == F.col("s.region")) & geo.contains(F.col("h.hull"), F.col("s.lat"), F.col("s.lng")), "left")
    listed = named.groupBy(F.col("h.region").alias("region"), "merged", "hull").agg(F.array_sort(F.collect_list(F.struct("s.ord", "s.name"))).alias("found"))
    names = F.transform("found", lambda x: x.getField("name"))
    parts = listed.select("region", "merged", names.alias("names"), F.posexplode(geo.grid_split(F.col("hull"))).alias("part", "box"), F.size(geo.grid_split(F.col("hull"))).alias("n"))
    first = F.get("names", F.lit(0))
    label = F.when(F.col("n") == 1, F.col("names")).otherwise(F.array_compact(F.array(F.concat(first, F.lit(" +area")))))
    return parts.select("region", "merged", "part", "box", label.alias("seeds"))


def boxes_for(selections: DataFrame, geocodes: DataFrame, seeded: DataFrame) -> DataFrame:
    """``selections(region, city, query)`` -> boxes: a city its own geocoded box, a region its seeded boxes, or its geocoded one where it has no seeds."""
    found = selections.join(geocodes.select(F.col("query").alias("__q"), F.col("box").alias("geocoded")), F.col("query") == F.col("__q"), "left").drop("__q")
    grid = seeded.groupBy("region").agg(F.array_sort(F.collect_list(F.struct("merged", "part", "box"))).alias("seeded")).withColumnRenamed("region", "__r")
    both = found.join(grid, F.col("region") == F.col("__r"), "left").drop("__r")
    own = F.array_compact(F.array("geocoded"))
    boxes = F.when(F.col("city").isNotNull() & (F.col("city") != ""), own).otherwise(F.coalesce(F.transform("seeded", lambda x: x.box), own))
    return both.select("region", "city", "query", F.posexplode(boxes).alias("ord", "box"))


# Adaptive quadtree


def should_split(depth: Column, box: Column, saturated: Column, max_depth: int = MAX_DEPTH, min_cell: float = MIN_CELL_M, max_cell: float = MAX_CELL_M) -> Column:
    """In this order: not at full depth, not when small, always when large, else when saturated."""
    diagonal = geo.diagonal_m(box)
    return F.when((depth >= max_depth) | (diagonal <= min_cell), False).when(diagonal > max_cell, True).otherwise(F.coalesce(saturated, F.lit(False)))


def root_cells(spark: SparkSession, boxes: DataFrame) -> DataFrame:
    """``boxes(region, box)`` as cells of depth 0."""
    return boxes.select("region", F.lit(0).alias("depth"), F.lit("").alias("path"), "box", geo.zoom_for_box(F.col("box")).alias("zoom"))


def child_cells(cells: DataFrame) -> DataFrame:
    split = cells.select("region", (F.col("depth") + 1).alias("depth"), "path", F.posexplode(geo.children(F.col("box"))).alias("quarter", "box"))
    return split.select("region", "depth", F.concat("path", F.col("quarter").cast("string")).alias("path"), "box", geo.zoom_for_box(F.col("box")).alias("zoom"))


def cover(cells: DataFrame, search: Callable[[DataFrame], DataFrame], max_depth: int = MAX_DEPTH, min_cell: float = MIN_CELL_M, max_cell: float = MAX_CELL_M) -> DataFrame:
    """All searched cells, level by level. ``search`` adds count, saturated and failed to cells; it sees a whole level at once.

    Adds ``split`` and ``truncated`` (saturated at the end). A failed cell is searched, not split and not truncated.
    """
    out = None
    level = cells
    for _ in range(max_depth + 1):
        ok = ~F.coalesce("failed", F.lit(False))
        split = ok & should_split(F.col("depth"), F.col("box"), F.col("saturated"), max_depth, min_cell, max_cell)
        done = written(search(level).withColumn("split", split).withColumn("truncated", ok & ~F.col("split") & F.coalesce("saturated", F.lit(False))), "cells")
        out = done if out is None else out.union(done)
        again = done.filter("split")
        if again.isEmpty():
            break
        level = child_cells(again)
    return out


def coverage_result(cells: DataFrame) -> DataFrame:
    return cells.groupBy("region").agg(F.count("*").alias("searched"), F.count_if("split").alias("subdivided"), F.count_if("truncated").alias("truncated"), F.count_if(F.coalesce("failed", F.lit(False))).alias("failed"))


def cell_outcomes(pages: DataFrame, page_size: int = PAGE_SIZE, cap: int = RESULT_CAP) -> DataFrame:
    """``pages(unit, cell, offset, n)`` of captured result pages -> per cell the count and whether paging hit the cap.

    Pages after a short one do not count; a cell is saturated if all pages up to the cap are full.
    """
    w = Window.partitionBy("unit", "cell").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    short = F.coalesce(F.max((F.col("n") < page_size).cast("int")).over(w), F.lit(0))
    used = pages.filter(F.col("offset") < cap).withColumn("__after", short).filter("__after = 0")
    return used.groupBy("unit", "cell").agg(F.sum("n").alias("count"), (F.count_if(F.col("n") >= page_size) >= cap // page_size).alias("saturated"))


def best_captures(captures: DataFrame) -> DataFrame:
    """Of repeated captures of a page, a full one before a degraded one, then the latest."""
    return captures.groupBy("unit", "cell", "offset").agg(F.max_by(F.struct(*[c for c in captures.columns if c not in ("unit", "cell", "offset")]), F.struct((~F.col("degraded")).alias("full"), F.col("attempt"))).alias("p")).select("unit", "cell", "offset", "p.*")


# Passes and units


def coverage(passes: DataFrame) -> DataFrame:
    """Completed passes by region and vertical."""
    return passes.filter("completed_at is not null").groupBy("region", "vertical").agg(F.count("*").alias("passes"), F.max("completed_at").alias("last_completed"))


def latest_pass(passes: DataFrame) -> DataFrame:
    return passes.groupBy("region", "vertical").agg(F.max_by(F.struct("pass", "started_at", "completed_at", "new_places"), "pass").alias("p")).select("region", "vertical", "p.*")


def resolved_pass(passes: DataFrame, wanted: DataFrame, now: int) -> DataFrame:
    """``wanted(region, vertical)`` -> the open pass to resume, or the next number to begin."""
    last = latest_pass(passes)
    joined = wanted.join(last, ["region", "vertical"], "left")
    resumed = F.col("pass").isNotNull() & F.col("completed_at").isNull()
    return joined.select("region", "vertical", F.when(resumed, F.col("pass")).otherwise(F.coalesce("pass", F.lit(0)) + 1).alias("pass"), resumed.alias("resumed"), F.when(resumed, F.col("started_at")).otherwise(F.lit(now)).alias("started_at"))


def completed_pass(passes: DataFrame, region: str, vertical: str, number: int, at: int, new_places: int) -> DataFrame:
    hit = (F.col("region") == region) & (F.col("vertical") == vertical) & (F.col("pass") == number)
    return passes.withColumns({"completed_at": F.when(hit, F.lit(at)).otherwise(F.col("completed_at")), "new_places": F.when(hit, F.lit(new_places)).otherwise(F.col("new_places"))})


def pass_history(passes: DataFrame, region: str, vertical: str) -> DataFrame:
    return passes.filter((F.col("region") == region) & (F.col("vertical") == vertical)).orderBy(F.desc("pass"))


def unit_key(region: Column, number: Column, term: Column, box: Column) -> Column:
    return F.concat(region, F.lit("|p"), number.cast("string"), F.lit("|"), term, F.lit("|box"), box.cast("string"))


def units(terms: DataFrame, boxes: DataFrame, region: str, number: int) -> DataFrame:
    """Every term in every box, terms first. The product is the work itself, and both sides are small."""
    both = terms.select("term", F.col("ord").alias("term_ord")).crossJoin(boxes.select("box_ord", "box"))
    return both.select(unit_key(F.lit(region), F.lit(number), F.col("term"), F.col("box_ord")).alias("key"), "term", "term_ord", "box_ord", "box").orderBy("term_ord", "box_ord")


def open_units(all_units: DataFrame, done: DataFrame) -> DataFrame:
    return all_units.join(done.select("key"), "key", "left_anti")


def marked_done(done: DataFrame, finished: DataFrame, at: int) -> DataFrame:
    """Checkpoints after some units, the new ones winning."""
    fresh = finished.groupBy("key").agg(F.max("place_count").alias("place_count")).select("key", F.lit(at).cast("long").alias("completed_at"), "place_count")
    return done.join(fresh, "key", "left_anti").select("key", "completed_at", "place_count").unionByName(fresh)


def terms_done(all_units: DataFrame, done: DataFrame) -> DataFrame:
    """Length of the leading run of terms of which every box is done."""
    left = open_units(all_units, done).agg(F.min("term_ord").alias("first"))
    return left.crossJoin(all_units.agg((F.max("term_ord") + 1).alias("total"))).select(F.coalesce("first", "total").alias("terms_done"))


def queue(regions: DataFrame, passes: DataFrame, vertical: str) -> DataFrame:
    """``regions(region, ord)`` by completed passes, fewest first, then in their own order."""
    have = coverage(passes).filter(F.col("vertical") == vertical).select("region", "passes")
    return regions.join(have, "region", "left").select("region", "ord", F.coalesce("passes", F.lit(0)).alias("passes")).orderBy("passes", "ord")


def board(regions: DataFrame, verticals: DataFrame, passes: DataFrame, running: DataFrame) -> DataFrame:
    """Each vertical in each region with its passes and whether it runs now."""
    every = verticals.select("vertical").crossJoin(regions.select("region", "ord"))
    now = running.select("region", "vertical").distinct().withColumn("running", F.lit(True))
    return every.join(coverage(passes), ["region", "vertical"], "left").join(now, ["region", "vertical"], "left").select("vertical", "region", "ord", F.coalesce("passes", F.lit(0)).alias("passes"), "last_completed", F.coalesce("running", F.lit(False)).alias("running"))


def board_summary(of_board: DataFrame) -> DataFrame:
    return of_board.groupBy("vertical").agg(F.count_if(F.col("passes") > 0).alias("covered"), F.count("*").alias("total"))


def driver_sweep(next_region: Callable[[], str | None], run: Callable[[str], bool], retries: int = 1) -> Iterator[tuple[str, bool]]:
    """The scheduler's order: least covered regions first, then one more round over those that failed."""
    failed: list[str] = []
    while (region := next_region()) is not None:
        ok = run(region)
        yield region, ok
        if not ok:
            failed.append(region)
    for _ in range(retries):
        again, failed = failed, []
        for region in again:
            ok = run(region)
            yield region, ok
            if not ok:
                failed.append(region)


#: A tile is dense if it holds more points than this and than one in TILES of all, so dense tiles are at most TILES rows; and how often it is quartered.
TILE_POINTS, TILES, QUARTERINGS = 20_000, 4096, 8


@dataclass(frozen=True)
class Tiles:
    """Tiles of ``cell`` degrees; the dense ones are quartered until their parts should be small, and parts that still hold too many points, as all lie on one spot, are dealt out.

    ``dense(ty, tx, level)`` and ``hot(level, y, x, shares)`` have at most TILES rows each and are broadcast; None where no tile is dense.
    """

    cell: float
    dense: DataFrame | None = None
    hot: DataFrame | None = None

    @staticmethod
    def of(points: DataFrame, cell: float = 1.0, least: int = TILE_POINTS) -> Tiles:
        """By the counts of all ``points(lat, lng)``, an aggregate a tile that is combined before it is shuffled."""
        at = Tiles(cell)
        counts = written(points.groupBy(at._floor(F.col("lat")).alias("ty"), at._floor(F.col("lng")).alias("tx")).agg(F.count("*").alias("n")).filter("ty is not null and tx is not null"), "tiles")
        most = max(least, (counts.agg(F.sum("n")).first()[0] or 0) // TILES)
        level = F.least(F.lit(QUARTERINGS), F.ceil(F.log(4.0, F.col("n") / most))).cast("int")
        dense = written(counts.filter(F.col("n") > most).select("ty", "tx", level.alias("level")), "dense")
        if dense.isEmpty():
            return at
        placed = Tiles(cell, dense)._leveled(points.select("lat", "lng"), "lat", "lng").filter("level > 0")
        parts = placed.groupBy("level", "y", "x").agg(F.count("*").alias("n")).filter(F.col("n") > most)
        return Tiles(cell, dense, written(parts.select("level", "y", "x", F.ceil(F.col("n") / most).cast("int").alias("shares")), "hot"))

    def _floor(self, c: Column, level: Column | None = None) -> Column:
        return F.floor(c / (self.cell if level is None else F.lit(self.cell) / F.pow(F.lit(2.0), level))).cast("long")

    def _leveled(self, points: DataFrame, lat: str, lng: str) -> DataFrame:
        """``points`` with level, y and x of the part of a tile that each lies in."""
        tiled = points.withColumns({"ty": self._floor(F.col(lat)), "tx": self._floor(F.col(lng))})
        tiled = tiled.join(F.broadcast(self.dense), ["ty", "tx"], "left").withColumn("level", F.coalesce("level", F.lit(0)))
        return tiled.withColumns({"y": self._floor(F.col(lat), F.col("level")), "x": self._floor(F.col(lng), F.col("level"))}).drop("ty", "tx")

    def points(self, points: DataFrame) -> DataFrame:
        """Struct ``p`` of each point with its key level, y, x and share."""
        packed = points.select(F.struct("*").alias("p"))
        if self.dense is None:
            return packed.select("p", F.lit(0).alias("level"), self._floor(F.col("p.lat")).alias("y"), self._floor(F.col("p.lng")).alias("x"), F.lit(0).alias("share"))
        placed = self._leveled(packed, "p.lat", "p.lng").join(F.broadcast(self.hot), ["level", "y", "x"], "left")
        return placed.select("p", "level", "y", "x", F.pmod(F.monotonically_increasing_id(), F.coalesce("shares", F.lit(1))).cast("int").alias("share"))

    def boxes(self, boxes: DataFrame) -> DataFrame:
        """Struct ``b`` of each box with every key that it touches."""
        south, north, west, east = (F.col(f"b.box.{c}") for c in ("south", "north", "west", "east"))
        span = lambda low, high, alias: F.explode(F.sequence(low, high)).alias(alias)
        packed = boxes.select(F.struct("*").alias("b")).filter((south <= north) & (west <= east))
        tiled = packed.select("b", span(self._floor(south), self._floor(north), "ty")).select("b", "ty", span(self._floor(west), self._floor(east), "tx"))
        if self.dense is None:
            return tiled.select("b", F.lit(0).alias("level"), F.col("ty").alias("y"), F.col("tx").alias("x"), F.lit(0).alias("share"))
        level = F.coalesce("level", F.lit(0))
        parts = F.pow(F.lit(2.0), level).cast("long")
        within = lambda low, high, tile, alias: span(F.greatest(self._floor(low, level), F.col(tile) * parts), F.least(self._floor(high, level), (F.col(tile) + 1) * parts - 1), alias)
        met = tiled.join(F.broadcast(self.dense), ["ty", "tx"], "left").select("b", level.alias("level"), "ty", "tx")
        rows = met.select("b", "level", "tx", within(south, north, "ty", "y")).select("b", "level", "y", within(west, east, "tx", "x"))
        dealt = rows.join(F.broadcast(self.hot), ["level", "y", "x"], "left")
        return dealt.select("b", "level", "y", "x", span(F.lit(0), F.coalesce("shares", F.lit(1)) - 1, "share"))


def points_in_boxes(points: DataFrame, boxes: DataFrame, cell: float = 1.0, tiles: Tiles | None = None) -> DataFrame:
    """``points(..., lat, lng)`` with each of ``boxes(..., box)`` that holds it: a range join made an equi-join by tiles of about equal numbers of points.

    Boxes are copied to the tiles that they touch, points go to the one they lie in, so no pair is met twice; the exact test follows. Points without a position and boxes that
    are inside out are in nothing.
    """
    tiles = tiles or Tiles.of(points, cell)
    met = tiles.points(points).join(tiles.boxes(boxes), ["level", "y", "x", "share"])
    return met.filter(geo.contains(F.col("b.box"), F.col("p.lat"), F.col("p.lng"))).select("p.*", "b.*")
