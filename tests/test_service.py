import json

from placemill.functions import geo
from placemill.operators.catalog import dictionary
from placemill.operators.filters import PlaceFilter
from placemill.operators.store import PlaceStore
from placemill.plans.jobs import JobRequest
from placemill.plans.service import Service
from placemill.sources.tables import read_gazetteer, read_terms
from tests.places import body, node, stored
from tests.test_sources import CAPTURE, page


def service(spark, tmp_path):
    gaz = {"CA": {"name": "Canada", "flag": "f", "regions": [{"code": "BC", "name": "British Columbia", "cities": [{"n": "Victoria", "lat": 48.4, "lng": -123.4, "p": 9}]}]}}
    (tmp_path / "g.json").write_text(json.dumps(gaz))
    (tmp_path / "t.json").write_text(json.dumps({"glass": ["a", "b"]}))
    names = spark.createDataFrame([("Glass shop",), ("Gym",)], "name string")
    return Service(spark, PlaceStore(spark, f"file://{tmp_path}/store"), dictionary(names), read_gazetteer(spark, f"file://{tmp_path}/g.json"), read_terms(spark, f"file://{tmp_path}/t.json"), clock=lambda: 77)


def test_questions(spark, tmp_path):
    s = service(spark, tmp_path)
    rows = [dict(id=str(i), name=f"n{i}", reviews=i, latitude=1.0, longitude=1.0, email_1=f"e{i % 2}@x.com") for i in range(5)]
    s.store.upsert(stored(spark, rows).drop("first_seen", "last_seen", "email_checked_at", "email_attempts", "email_retry_at"), 1)
    got = s.query(PlaceFilter(min_reviews=2, limit=2))
    assert ([r.id for r in got["places"].collect()], got["matching"], got["total"]) == (["4", "3"], 3, 5)
    assert [r["id"] for r in s.iterate(PlaceFilter(min_reviews=3))] == ["4", "3"]
    points, more = s.map_points(PlaceFilter(), 3)
    assert points.count() == 3 and more and not s.map_points(PlaceFilter(), 5)[1]
    assert s.map_view(PlaceFilter(), 2, 0, 2, 0)[0] == "points"
    assert s.export_csv(PlaceFilter(), "All of it", str(tmp_path))[1] == 5
    assert s.export_leads(PlaceFilter(), "", str(tmp_path))[1:] == (2, 0)
    assert s.stats()["contact"].first().total == 5


def test_searches(spark, tmp_path):
    s = service(spark, tmp_path)
    assert s.categories("glas").first().name == "Glass shop" and s.cities("CA", "vic").first().city == "Victoria"
    assert [tuple(r) for r in s.countries().collect()] == [("CA", "Canada", "f", 1, 0)]
    assert [(r.vertical, r.terms) for r in s.verticals().collect()] == [("glass", 2)]
    boxes = spark.createDataFrame([("Victoria, British Columbia, Canada",)], "query string").withColumn("box", geo.box_of(-1, 0, 1, 1))
    r = s.resolve("CA", "BC", "Victoria", boxes).first()
    assert r.query.startswith("Victoria") and r.area_km2 > 20_000
    assert s.resolve("CA", "BC", None, boxes).first().box is None


def test_runs(spark, tmp_path):
    s = service(spark, tmp_path)
    df = spark.createDataFrame([page("k1", 0, node()), ("k2", 1, "q", None, body(node(name="B", feature="0x1:0x2", place_id="B")))], CAPTURE)
    job = s.start_job(df, JobRequest(("q",), ("x",)), str(tmp_path / "job.csv"))
    assert (job.state, job.rows) == ("done", 2)
    units = spark.createDataFrame([("k1",), ("k2",)], "key string")
    none = spark.createDataFrame([], "key string, completed_at long, place_count long")
    job, done = s.start_extraction(df, units, none, "e")
    assert (job.state, job.new, done.count()) == ("done", 2, 2)
    assert len(s.list_jobs()) == 2
    s.cancel(job.id)
    assert s.jobs[job.id].state == "cancelled"


def test_campaign(spark, tmp_path):
    s = service(spark, tmp_path)
    s.store.write(s.store.read())
    todo = ["a", "b"]
    assert s.run_campaign("glass", lambda: todo.pop(0) if todo else None, lambda r: True) == [("a", True), ("b", True)]
    assert s.interrupted_campaign() is None
    todo = ["a", "b"]
    swept = s.run_campaign("glass", lambda: todo.pop(0) if todo else None, lambda r: s.cancel_campaign() or True)
    assert swept == [("a", True)]
