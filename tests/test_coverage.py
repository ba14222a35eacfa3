import random

import pytest
from pyspark.sql import functions as F

from placemill.functions import geo
from placemill.operators import coverage as C
from placemill.operators import dedupe as D
from placemill.operators import enrich as E


def root(spark, box):
    return C.root_cells(spark, spark.range(1).select(F.lit("r").alias("region"), geo.box_of(*box).alias("box")))


def search(saturated="false", failed="false"):
    return lambda cells: cells.withColumns({"count": F.lit(1), "saturated": F.expr(saturated), "failed": F.expr(failed)})


SMALL, LARGE = (-123.2, 49.2, -123.0, 49.3), (-139.0, 48.0, -114.0, 60.0)


@pytest.mark.parametrize(
    "find,depth,want",
    [
        (search(), 9, (1, 0, 0, 0)),
        (search("depth = 0"), 9, (5, 1, 0, 0)),
        (search("true"), 2, (21, 5, 16, 0)),
        (search("true", "path = '0'"), 2, (17, 4, 12, 1)),
    ],
)
def test_quadtree_counts(spark, find, depth, want):
    r = C.coverage_result(C.cover(root(spark, SMALL), find, max_depth=depth, min_cell=1.0)).first()
    assert (r.searched, r.subdivided, r.truncated, r.failed) == want


def test_large_cells_split_unasked(spark):
    cells = C.cover(root(spark, LARGE), search(), max_depth=3)
    assert C.coverage_result(cells).first().searched == 85
    leaves = cells.filter("not split")
    area = leaves.select(F.sum((F.col("box.east") - F.col("box.west")) * (F.col("box.north") - F.col("box.south"))).alias("a")).first().a
    assert area == pytest.approx(25 * 12)


def test_small_cells_stay_whole(spark):
    r = C.coverage_result(C.cover(root(spark, (0, 0, 0.001, 0.001)), search("true"))).first()
    assert (r.searched, r.truncated) == (1, 1)


def slow_merge(boxes):
    boxes = list(boxes)
    while True:
        for i in range(len(boxes)):
            for j in range(i + 1, len(boxes)):
                a, b = boxes[i], boxes[j]
                if a[2] >= b[0] and b[2] >= a[0] and a[3] >= b[1] and b[3] >= a[1]:
                    boxes[i] = (min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]))
                    del boxes[j]
                    break
            else:
                continue
            break
        else:
            return sorted(boxes)


@pytest.mark.parametrize("seed", range(40))
def test_merged_boxes(seed):
    rnd = random.Random(seed)
    boxes = []
    for _ in range(rnd.randint(0, 40)):
        w, s = rnd.uniform(0, 20), rnd.uniform(0, 20)
        boxes.append((w, s, w + rnd.uniform(0, 3), s + rnd.uniform(0, 3)))
    assert C.merged_boxes(boxes) == slow_merge(boxes)


def test_seed_boxes(spark):
    seeds = spark.createDataFrame([("r", "Big", 49.25, -123.1, 600_000, 0), ("r", "Near", 49.28, -122.95, 40_000, 1), ("r", "Far", 55.0, -125.0, 1_000, 2), ("r", "Outside", 10.0, 10.0, 1, 3)], "region string, name string, lat double, lng double, population long, ord int")
    bounds = spark.range(1).select(F.lit("r").alias("region"), geo.box_of(-140, 48, -110, 60).alias("box"))
    found = C.seed_boxes(seeds, bounds).collect()
    assert {r.merged for r in found} == {0, 1}
    small = [r for r in found if r.seeds and r.seeds[0].startswith("Far")]
    assert len(small) == 4 and small[0].seeds == ["Far +area"]
    big = [r for r in found if r.merged != small[0].merged]
    assert all(r.seeds == ["Big +area"] for r in big) and len(big) > 10


def test_boxes_for(spark):
    box = geo.box_of(0, 0, 1, 1)
    geocodes = spark.createDataFrame([("C, R",), ("R2",)], "query string").withColumn("box", box)
    seeded = spark.createDataFrame([("R", 0, 1), ("R", 0, 0)], "region string, merged long, part int").withColumn("box", geo.box_of(2, 2, 3, 3))
    asked = spark.createDataFrame([("R", "C", "C, R"), ("R", None, "R"), ("R2", None, "R2"), ("R3", None, "none")], "region string, city string, query string")
    got = sorted((r.region, r.city or "", r.box.west) for r in C.boxes_for(asked, geocodes, seeded).collect())
    assert got == [("R", "", 2.0), ("R", "", 2.0), ("R", "C", 0.0), ("R2", "", 0.0)]


def test_points_in_boxes(spark):
    rnd = random.Random(1)
    points = [(i, rnd.uniform(-3, 3), rnd.uniform(-3, 3)) for i in range(300)] + [(999, None, 1.0)]
    boxes = [(i, *sorted((rnd.uniform(-3, 3), rnd.uniform(-3, 3))), *sorted((rnd.uniform(-3, 3), rnd.uniform(-3, 3)))) for i in range(20)]
    b = spark.createDataFrame(boxes, "b int, w double, e double, s double, n double").select("b", geo.box(F.col("w"), F.col("s"), F.col("e"), F.col("n")).alias("box"))
    got = {(r.id, r.b) for r in C.points_in_boxes(spark.createDataFrame(points, "id int, lat double, lng double"), b, 0.7).collect()}
    assert got == {(i, k) for i, y, x in points if y is not None for k, w, e, s, n in boxes if w <= x <= e and s <= y <= n}


def test_dense_tiles_are_split_and_dealt(spark):
    """A city with a third of the points, a third of them on one spot: equal to all pairs, and no key holds many points."""
    rnd = random.Random(3)
    spread = [(rnd.uniform(-5, 5), rnd.uniform(-5, 5)) for _ in range(400)]
    city = [(1.3 + rnd.gauss(0, 0.02), -2.4 + rnd.gauss(0, 0.02)) for _ in range(130)]
    points = [(i, *at) for i, at in enumerate([*spread, *city, *[(1.3, -2.4)] * 70, (-5.0, -5.0), (0.0, 0.0), (None, 1.0), (float("nan"), 1.0)])]
    boxes = [(k, w, s, w + rnd.choice([0.01, 0.5, 3]), s + rnd.choice([0.01, 0.5, 3])) for k in range(60) for w, s in [(rnd.choice([-2.45, rnd.uniform(-5, 5)]), rnd.choice([1.25, rnd.uniform(-5, 5)]))]]
    boxes += [(90, -2.4, 1.3, -2.4, 1.3), (91, 1.0, 1.0, 0.0, 2.0), (92, None, 0.0, 1.0, 1.0)]
    p = spark.createDataFrame(points, "id int, lat double, lng double").repartition(4)
    b = spark.createDataFrame(boxes, "b int, w double, s double, e double, n double").select("b", geo.box(F.col("w"), F.col("s"), F.col("e"), F.col("n")).alias("box"))
    tiles = C.Tiles.of(p, 1.0, least=12)
    assert tiles.dense is not None and tiles.hot.count() >= 1
    got = sorted((r.id, r.b) for r in C.points_in_boxes(p, b, tiles=tiles).collect())
    inside = lambda lat, lng, w, s, e, n: None not in (lat, w) and s <= lat <= n and w <= lng <= e
    assert got == sorted((i, k) for i, lat, lng in points for k, *box in boxes if inside(lat, lng, *box))
    assert sorted((r.id, r.b) for r in C.points_in_boxes(p, b, 1.0).collect()) == got
    most = tiles.points(p).filter("p.lat = p.lat").groupBy("level", "y", "x", "share").count().agg(F.max("count")).first()[0]
    assert most <= 24


def test_no_points_no_boxes(spark):
    p, b = spark.createDataFrame([], "id int, lat double, lng double"), spark.createDataFrame([], f"b int, box struct<{C.BOX.replace(' ', ':').replace(',:', ',')}>")
    assert C.points_in_boxes(p, b).count() == 0



PASSES = "region string, vertical string, pass long, started_at long, completed_at long, new_places long"


@pytest.fixture(scope="module")
def passes(spark):
    return spark.createDataFrame([("CA/BC", "glass", 1, 1, 5, 9), ("CA/BC", "glass", 2, 6, None, None), ("CA/AB", "glass", 1, 1, 7, 3), ("CA/BC", "doors", 1, 2, 4, 1)], PASSES)


def test_passes(spark, passes):
    got = {(r.region, r.vertical): (r.passes, r.last_completed) for r in C.coverage(passes).collect()}
    assert got == {("CA/BC", "glass"): (1, 5), ("CA/AB", "glass"): (1, 7), ("CA/BC", "doors"): (1, 4)}
    wanted = spark.createDataFrame([("CA/BC", "glass"), ("CA/AB", "glass"), ("US/WA", "glass")], "region string, vertical string")
    got = {r.region: (r["pass"], r.resumed, r.started_at) for r in C.resolved_pass(passes, wanted, 99).collect()}
    assert got == {"CA/BC": (2, True, 6), "CA/AB": (2, False, 99), "US/WA": (1, False, 99)}
    done = C.completed_pass(passes, "CA/BC", "glass", 2, 50, 4)
    assert {r.region: r.passes for r in C.coverage(done).filter("vertical = 'glass'").collect()} == {"CA/BC": 2, "CA/AB": 1}
    assert [r["pass"] for r in C.pass_history(passes, "CA/BC", "glass").collect()] == [2, 1]


def test_board(spark, passes):
    regions = spark.createDataFrame([("CA/BC", 0), ("CA/AB", 1), ("US/WA", 2)], "region string, ord int")
    verticals = spark.createDataFrame([("glass",), ("doors",)], "vertical string")
    board = C.board(regions, verticals, passes, passes.filter("completed_at is null"))
    assert board.count() == 6 and board.filter("running").count() == 1
    assert {r.vertical: (r.covered, r.total) for r in C.board_summary(board).collect()} == {"glass": (2, 3), "doors": (1, 3)}
    assert [r.region for r in C.queue(regions, passes, "doors").collect()] == ["CA/AB", "US/WA", "CA/BC"]


def test_units(spark):
    terms = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "term string, ord int")
    boxes = spark.createDataFrame([(0,), (1,)], "box_ord int").withColumn("box", geo.box_of(0, 0, 1, 1))
    units = C.units(terms, boxes, "CA/BC", 3)
    keys = [r.key for r in units.collect()]
    assert keys[:3] == ["CA/BC|p3|a|box0", "CA/BC|p3|a|box1", "CA/BC|p3|b|box0"]
    none = spark.createDataFrame([], "key string, completed_at long, place_count long")
    done = C.marked_done(none, spark.createDataFrame([(k, 2) for k in keys[:3] + keys[4:]], "key string, place_count long"), 7)
    assert [r.key for r in C.open_units(units, done).collect()] == ["CA/BC|p3|b|box1"]
    assert C.terms_done(units, done).first().terms_done == 1
    done = C.marked_done(done, spark.createDataFrame([(keys[3], 0), (keys[0], 5)], "key string, place_count long"), 8)
    assert C.terms_done(units, done).first().terms_done == 3
    assert {r.key: (r.completed_at, r.place_count) for r in done.collect()}[keys[0]] == (8, 5)


def test_cell_outcomes(spark):
    full = [("u", "full", 20 * k, 20) for k in range(6)]
    rows = [*full, ("u", "short", 0, 20), ("u", "short", 20, 5), ("u", "short", 40, 20), ("u", "past", 0, 20), ("u", "past", 120, 20), ("u", "none", 0, 0)]
    got = {r.cell: (r["count"], r.saturated) for r in C.cell_outcomes(spark.createDataFrame(rows, "unit string, cell string, offset int, n long")).collect()}
    assert got == {"full": (120, True), "short": (25, False), "past": (20, False), "none": (0, False)}
    tries = spark.createDataFrame([("u", "c", 0, 1, True, "x"), ("u", "c", 0, 2, False, "y"), ("u", "c", 0, 3, True, "z")], "unit string, cell string, offset int, attempt int, degraded boolean, body string")
    assert C.best_captures(tries).first().body == "y"


def test_sweep():
    todo, seen = ["a", "b", "c"], []
    ran = list(C.driver_sweep(lambda: todo.pop(0) if todo else None, lambda r: seen.append(r) or r != "b" or seen.count("b") > 1))
    assert ran == [("a", True), ("b", False), ("c", True), ("b", True)]


@pytest.mark.parametrize("seed,few_roots", [(0, 0), (1, 8), (2, 1000), (3, 1000)])
def test_dedupe_is_the_sequential_rule(spark, seed, few_roots):
    """Without chains, with them where roots are few, and with them in every round."""
    rnd = random.Random(seed)
    rows = [(i, [f"k{rnd.randint(0, 60)}" for _ in range(rnd.randint(0, 3))]) for i in rnd.sample(range(1000), 150)]
    df = spark.createDataFrame(rows, "seq long, own array<string>")
    got = {r.seq: r.kept for r in D.dedupe(df, keys=F.col("own"), few_roots=few_roots).collect()}
    assert got == D.sequential_model(rows)


def _deduped(spark, rows):
    return {r.seq: r.kept for r in D.dedupe(spark.createDataFrame(rows, "seq long, own array<string>"), keys=F.col("own")).collect()}


def test_dedupe_of_long_chains(spark, monkeypatch):
    """Rising chains, one of them with branches, loose ends and a hot key beside it, take a handful of rounds."""
    rows = [(i, [f"k{i}", f"k{i + 1}"]) for i in range(4000)]
    rows += [(10_000 + i, [f"m{i}", f"m{i + 1}", *([f"side{i}"] if i % 7 == 0 else [])]) for i in range(999)]
    rows += [(20_000 + i, [f"side{i * 7}", "hot"]) for i in range(120)]
    rows += [(30_000 + i, ["hot", f"own{i}"]) for i in range(500)]
    rounds, real = [], D._through_chains
    monkeypatch.setattr(D, "_through_chains", lambda *a: rounds.append(1) or real(*a))
    assert _deduped(spark, rows) == D.sequential_model(rows)
    assert 1 <= len(rounds) <= 4


def test_dedupe_of_a_falling_chain_and_ladders(spark):
    falling = [(i, [f"k{100 - i}", f"k{101 - i}"]) for i in range(100)]
    ladder = [(1000 + i, [f"r{i}", f"r{i + 1}", f"r{i + 2}"]) for i in range(15)]
    assert _deduped(spark, falling + ladder) == D.sequential_model(falling + ladder)


def test_dedupe_is_no_closure(spark):
    rows = [(1, ["a"]), (2, ["a", "b"]), (3, ["b"]), (4, []), (5, [])]
    got = D.dedupe(spark.createDataFrame(rows, "seq long, own array<string>"), keys=F.col("own"))
    assert {r.seq: r.kept for r in got.collect()} == {1: True, 2: False, 3: True, 4: True, 5: True}
    assert tuple(D.dedupe_stats(got).first()) == (4, 1)


def test_identity(spark):
    rows = [("7", "P", "The Café Co", 49.12345, -123.0), ("", None, "X Inc", 1.0, 2.0), (None, None, "Inc", 1.0, 2.0), (None, None, None, None, None), (None, None, "A", None, 2.5)]
    df = spark.createDataFrame(rows, "cid string, place_id string, name string, latitude double, longitude double")
    got = df.select(D.identity_keys().alias("k"), D.stored_id().alias("i")).collect()
    assert got[0].k == ["cid:7", "pid:P", "geo:cafe@49.1234,-123.0000"] and got[1].k == ["geo:x@1.0000,2.0000"]
    assert [r.i for r in got] == ["cid:7", "geo:x@1.0000,2.0000", "anon:Inc:1,2", "anon::,", "anon:A:,2.5"]


def test_domain_failures(spark):
    rows = [(1, "a.com", "unreachable"), (2, "a.com", "ok"), (3, "a.com", "unreachable"), (4, "a.com", "timeout"), (5, "b.com", "unreachable"), (6, "b.com", "unreachable"), (7, "http://www.b.com/x", "unreachable"), (8, None, "unreachable")]
    failures = E.domain_failures(spark.createDataFrame(rows, "seq long, site string, outcome string"))
    assert {r.domain: r.failures for r in failures.collect()} == {"a.com": 1, "b.com": 3}
    targets = spark.createDataFrame([("1", "a.com"), ("2", "b.com"), ("3", None)], "id string, site string")
    assert {r.id: r.skipped for r in E.split_by_domain(targets, failures).collect()} == {"1": False, "2": True, "3": False}
