import io
import json
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from placemill.functions import geo
from placemill.operators import catalog
from placemill.operators.filters import PlaceFilter, QuickFilter
from placemill.operators.store import PlaceStore
from placemill.plans import jobs
from placemill.schema import PLACE_COLUMNS, PLACE_SCHEMA, as_places
from placemill.sources import captures, onefile, sinks, tables
from placemill.streaming import enrichment
from tests.places import body, node, stored


def parsed(spark, *bodies):
    df = spark.createDataFrame([(i, "glass shop", b) for i, b in enumerate(bodies)], "page int, query string, body string")
    return captures.parse_pages(df, "page")


def test_guard(spark):
    rows = [(")]}'\n[1]", "[1]"), (")]}'[1]", "[1]"), (")]}'x\n[1]", "[1]"), ("[1]", None), ("", None), (")]}'\nnot json", None)]
    df = spark.createDataFrame(rows, "body string, want string")
    good, bad = captures.guarded(df)
    assert [r.want for r in good.collect()] == ["[1]"] * 3 and bad.count() == 3


def test_record(spark):
    places, pages = parsed(spark, body(node()))
    assert places.columns == ["page", "pos", *PLACE_COLUMNS]
    r = places.first()
    want = dict(
        query="glass shop", name="Acme", google_id="0x1:0xff", cid="255", place_id="P1", full_address="1 Main St, Vancouver", borough="Downtown", city="Vancouver", postal_code="V5K", state="British Columbia", country="Canada",
        latitude=49.25, longitude=-123.1, site="https://acme.com/", phone="+1 604-555-0100", category="Glass shop", type="Glass shop", subtypes="Door shop, Mirror shop", rating=4.5, reviews=1, range="$$",
        working_hours={"Monday": "9 AM-12 PM,1-5 PM", "Tuesday": "10 AM-4 PM"}, working_hours_old_format="Monday: 9 AM-12 PM,1-5 PM|Tuesday: 10 AM-4 PM", business_status="OPERATIONAL", verified=None, time_zone="America/Vancouver",
    )
    assert {k: r[k] for k in want} == want
    assert tuple(r.reviews_per_score) == (1, 0, 2, 3, 40)
    assert tuple(pages.first()) == (0, 1, False, 0)


def test_odd_records(spark):
    nobody = node(name=None, feature=None, place_id=None)
    older = node(**{"[203, 0]": None, "[34, 1]": [["Friday", 0, 0, [["8-9"]]], ["Friday", 0, 0, [["9-10"]]]], "[34, 4, 4]": "CLOSED", "[2]": None, "[18]": "Acme, 5 Side St", "[13]": ["Only"], "[175, 3]": None, "[4, 7]": "4,5"})
    bare = [None] * 11 + ["Bare"]
    places, pages = parsed(spark, body(nobody, older, bare), body(), ")]}'\n5")
    rows = {r.name: r for r in places.collect()}
    assert set(rows) == {"Acme", "Bare"}
    r = rows["Acme"]
    assert (r.business_status, r.full_address, r.subtypes, r.reviews_per_score, r.rating) == ("CLOSED", "5 Side St", None, None, 4.5)
    assert r.working_hours == {"Friday": "9-10"}
    assert rows["Bare"].cid is None and rows["Bare"].working_hours is None and rows["Bare"].category is None
    assert [tuple(p) for p in pages.collect()] == [(0, 3, False, 1)]


def test_degraded(spark):
    _, pages = parsed(spark, body(node(ratings=8), node(ratings=8)), body(node(ratings=8), node(ratings=9)), body(node(**{"[4, 7]": None})))
    assert {p.page: p.degraded for p in pages.collect()} == {0: True, 1: False, 2: False}


def test_reference_tables(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps(["Glass shop", "Café"]))
    (tmp_path / "t.json").write_text(json.dumps({"glass": ["b", "a"], "doors": ["c"]}))
    gaz = {"CA": {"name": "Canada", "flag": "x", "regions": [{"code": "BC", "name": "British Columbia", "cities": [{"n": "Victoria", "lat": 48.4, "lng": -123.4, "p": 90_000}, {"n": "Vancouver", "lat": 49.2, "lng": -123.1, "p": 600_000}]}, {"code": "NU", "name": "Nunavut", "cities": []}]}}
    (tmp_path / "g.json").write_text(json.dumps(gaz))
    (tmp_path / "l.txt").write_text("# note\r\nhttp://u:p@h:1 , http://h2\r\n\r\nbad\r\n")
    at = lambda n: f"file://{tmp_path}/{n}"
    assert [(r.ord, r.name) for r in tables.read_dictionary(spark, at("d.json")).collect()] == [(0, "Glass shop"), (1, "Café")]
    terms = tables.read_terms(spark, at("t.json"))
    assert [r.term for r in catalog.terms_of(terms, "glass").collect()] == ["b", "a"] and catalog.terms_of(terms, "none").count() == 0
    assert {r.vertical: r.terms for r in catalog.vertical_counts(terms).collect()} == {"glass": 2, "doors": 1}
    g = tables.read_gazetteer(spark, at("g.json"))
    assert [r.region for r in catalog.regions_of(g, "CA").collect()] == ["BC", "NU"] and catalog.regions_of(g, "US").count() == 0
    assert [r.region for r in catalog.all_regions(g).collect()] == ["CA/BC", "CA/NU"]
    assert [r.city for r in catalog.city_search(g, "CA", "v").collect()] == []
    assert [r.city for r in catalog.city_search(g, "CA", "Vi").collect()] == ["Victoria"]
    assert [r.city for r in catalog.city_search(g, "CA", "co").collect()] == ["Vancouver"]
    asked = spark.createDataFrame([("CA", "BC", "Victoria"), ("CA", "NU", None), ("US", "LA", "X")], "country string, region string, city string")
    assert sorted(r.query for r in catalog.geocoder_query(asked, g).collect()) == ["Nunavut, Canada", "Victoria, British Columbia, Canada", "X, LA, US"]
    assert [r.l for r in asked.select(catalog.label(F.col("city"), F.col("region")).alias("l")).collect()] == ["Victoria, BC", "NU", "X, LA"]
    assert [r.entry for r in tables.read_list(spark, at("l.txt")).collect()] == ["http://u:p@h:1", "http://h2"]


def test_geocodes(spark):
    rows = [("q", 1, "B", "city", ["1", "2", "3", "4"], 0.5), ("q", 0, "A", "city", ["5", "6", "7", "8"], None), ("r", 0, "C", "x", ["1"], 0.1)]
    got = tables.geocoded(spark.createDataFrame(rows, "query string, ord int, display_name string, type string, boundingbox array<string>, importance double"))
    best = tables.best_geocode(got).collect()
    assert len(best) == 1 and best[0].display_name == "A" and tuple(best[0].box) == (7.0, 5.0, 8.0, 6.0) and best[0].importance == 0


def test_csv(spark, tmp_path):
    rows = stored(spark, [dict(id="1", name='Joe "J", Inc', phone="+1 604", longitude=-73.98, latitude=5.0, reviews=7), dict(id="2", name="=SUM(A1)", email_1="a@b.c", verified=True)])
    path = tmp_path / "x.csv"
    assert sinks.write_csv(rows.orderBy("id"), str(path), ["name", "phone", "longitude", "latitude", "reviews", "verified", "missing"]) == 2
    assert path.read_bytes().decode() == '﻿name,phone,longitude,latitude,reviews,verified,missing\r\n"Joe ""J"", Inc",+1 604,-73.98,5,7,,\r\n\t=SUM(A1),,,,,true,\r\n'
    assert sinks.export_columns(rows)[-9:] == ["email_1", "email_2", "email_3", "facebook", "instagram", "linkedin", "twitter", "youtube", "tiktok"]
    assert sinks.export_columns(rows.filter("id = '1'")) == PLACE_COLUMNS and sinks.export_columns(rows.limit(0), extra=["x"])[-1] == "x"
    assert sinks.used_columns(rows) == ["name", "latitude", "longitude", "phone", "reviews", "verified"]
    assert list(sinks.csv_chunks(rows.limit(0), ["name"])) == ["﻿name\r\n"]


def test_csv_nested(spark):
    places, _ = parsed(spark, body(node()))
    line = places.select(sinks.csv_line(places, ["working_hours", "reviews_per_score"]).alias("x")).first().x
    assert line == '"{""Monday"":""9 AM-12 PM,1-5 PM"",""Tuesday"":""10 AM-4 PM""}","{""1"":1,""2"":0,""3"":2,""4"":3,""5"":40}"'


def test_xlsx():
    out = io.BytesIO()
    rows = [{"name": 'A & B <"x">\x00', "reviews": 5.0, "rating": 4.5}, {"name": None, "reviews": float("nan"), "rating": True}]
    assert sinks.write_xlsx(rows, ["name", "reviews", "rating"], out, "L&D") == 2
    z = zipfile.ZipFile(out)
    assert z.testzip() is None and all(i.compress_type == zipfile.ZIP_STORED for i in z.infolist()) and len(z.namelist()) == 5
    sheet = z.read("xl/worksheets/sheet1.xml").decode()
    assert "A &amp; B &lt;&quot;x&quot;&gt;<" in sheet and "<c><v>5</v></c><c><v>4.5</v></c>" in sheet and '<row r="3"><c/>' in sheet and "NaN" in sheet
    assert 'name="L&amp;D"' in z.read("xl/workbook.xml").decode()


def test_one_file_of_many_tasks(spark, tmp_path):
    path = tmp_path / "sub" / "x.csv"
    rows = spark.range(5000).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("é, "), "id").alias("name")).repartition(7)
    assert sinks.write_csv(rows.orderBy(F.col("id").cast("long")), f"file://{path}", ["id", "name"]) == 5000
    assert path.read_bytes().decode() == "\ufeffid,name\r\n" + "".join(f'{i},"é, {i}"\r\n' for i in range(5000))
    assert [p.name for p in path.parent.iterdir()] == ["x.csv"]  # no piece is left
    got = [tuple(r) for r in onefile.lines_of(spark, f"file://{path}", "\r\n").orderBy("n").collect()]
    assert len(got) == 5001 and got[5000] == (5000, '4999,"é, 4999"')
    assert sinks.write_csv(rows.limit(0), str(path), ["id"]) == 0 and path.read_bytes().decode() == "\ufeffid\r\n"
    with pytest.raises(ValueError):
        sinks.write_csv(rows, "s3a://bucket/x.csv", ["id"])


def test_lines_across_splits(spark, tmp_path):
    (tmp_path / "l.txt").write_text("".join(f"line {i}\n" for i in range(9000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        got = onefile.lines_of(spark, f"file://{tmp_path}/l.txt", "\n").orderBy("n").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.n, r.value) for r in got] == [(i, f"line {i}") for i in range(9000)]


def test_joined_crc():
    for a, b in ((b"", b""), (b"a", b""), (b"", b"xyz"), (b"first", b"second" * 1000)):
        assert onefile.joined_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_workbook_of_many_tasks(spark, tmp_path):
    path = tmp_path / "x.xlsx"
    rows = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.concat(F.lit('a & <"'), "id")).alias("name"), (F.col("id") / 2).alias("n"), "id").repartition(6).orderBy("id")
    assert sinks.write_workbook(rows, ["name", "n", "gone"], str(path), "L&D") == 3000
    z = zipfile.ZipFile(path)
    assert z.testzip() is None and all(i.compress_type == zipfile.ZIP_STORED for i in z.infolist()) and len(z.namelist()) == 5
    out = io.BytesIO()
    sinks.write_xlsx((r.asDict() for r in rows.collect()), ["name", "n", "gone"], out, "L&D")
    for name in z.namelist():
        assert z.read(name) == zipfile.ZipFile(out).read(name)
    assert sinks.write_workbook(rows.limit(0), ["name"], str(path)) == 0 and b'<row r="1">' in zipfile.ZipFile(path).read("xl/worksheets/sheet1.xml")


def test_file_names():
    assert sinks.file_name("Glass, BC!", "2024-01-01", "csv") == "glass-bc-2024-01-01.csv" and sinks.file_name("!!", "d", "xlsx", prefix="leads-", fallback="leads") == "leads-leads-d.xlsx"


def page(unit, seq, *nodes):
    return (unit, seq, "glass shop", None, body(*nodes))


CAPTURE = "unit string, seq int, query string, box struct<west:double,south:double,east:double,north:double>, body string"


def test_job(spark):
    far = node(name="Far", feature="0x1:0xfa", place_id="F", lat=10.0)
    again = node(name="Again", feature="0x1:0xff", place_id="other")
    linked = node(name="Linked", feature=None, place_id="other")
    rows = [page("u1", 0, node(), far), page("u2", 1, again, linked, node(name="Shut", feature="0x1:0x5", place_id="S", **{"[88, 0]": "CLOSED"}))]
    df = spark.createDataFrame(rows, CAPTURE).withColumn("box", geo.box_of(-124, 49, -123, 50))
    got = jobs.run_job(df, jobs.JobRequest(("glass",), ("BC",), QuickFilter(operational_only=True)))
    assert [r.name for r in got.orderBy("seq", "pos").collect()] == ["Acme", "Linked"]
    assert jobs.run_job(df, jobs.JobRequest(("glass",), ("BC",), limit=1)).count() == 1
    pages = spark.createDataFrame([("u1/0/1", "mail info@acme.com <a href='https://facebook.com/acme'>", "https://acme.com/", "ok")], enrichment.PAGES_SCHEMA)
    rich = {r.name: r for r in jobs.run_job(df, jobs.JobRequest(("glass",), ("BC",)), pages).collect()}
    assert (rich["Acme"].email_1, rich["Acme"].facebook, rich["Acme"].outcome) == ("info@acme.com", "https://facebook.com/acme", "ok") and rich["Shut"].outcome == "unreachable"
    with pytest.raises(ValueError):
        jobs.run_job(df, jobs.JobRequest(("glass",), ("BC",), QuickFilter(min_rating=5, max_rating=1)))


def test_extraction(spark, tmp_path):
    store = PlaceStore(spark, f"file://{tmp_path}/s")
    df = spark.createDataFrame([page("k1", 0, node()), page("k2", 1, node(name="Two", feature="0x1:0x2", place_id="T")), page("k9", 2)], CAPTURE)
    units = spark.createDataFrame([("k1",), ("k2",), ("k3",), ("k9",)], "key string")
    done = spark.createDataFrame([("k2", 1, 1)], "key string, completed_at long, place_count long")
    n, after = jobs.run_extraction(store, df, units, done, 50)
    assert n == 1 and {r.key: (r.completed_at, r.place_count) for r in after.collect()} == {"k1": (50, 1), "k2": (1, 1), "k9": (50, 0)}
    assert [r.name for r in store.read().collect()] == ["Acme"]
    n, _ = jobs.run_extraction(store, df, units, done.limit(0), 60)
    assert n == 1 and store.read().count() == 2
    path = tmp_path / "o.csv"
    assert jobs.export_csv(store.read(), PlaceFilter(), str(path), ["name"]) == 2


def test_export_leads(spark, tmp_path):
    rows = stored(spark, [dict(id=str(i), name=f"n{i}", email_1=f"a{i % 3}@d{i % 3}.com", reviews=i) for i in range(6)])
    dead = spark.createDataFrame([("d0.com",)], "domain string")
    assert jobs.export_leads(rows, PlaceFilter(), str(tmp_path / "l.xlsx"), dead) == (2, 1)
    assert zipfile.ZipFile(tmp_path / "l.xlsx").testzip() is None


def test_enrichment_stream(spark, tmp_path):
    store = PlaceStore(spark, f"file://{tmp_path}/s")
    fresh = stored(spark, [dict(id=str(i), name=f"n{i}", site=f"https://s{i}.com") for i in range(4)] + [dict(id="9", name="no site")])
    store.upsert(fresh.drop("first_seen", "last_seen", "email_checked_at", "email_attempts", "email_retry_at"), 10)
    pages = [("0", "x info@s0.com", "https://s0.com/", "ok"), ("1", "nothing", "https://s1.com/", "ok"), ("2", None, None, "timeout"), ("9", "a@b.com", None, "ok")]
    spark.createDataFrame(pages, enrichment.PAGES_SCHEMA).write.parquet(f"file://{tmp_path}/pages")
    seen = []
    feed = enrichment.ProgressFeed(seen.append)
    spark.streams.addListener(feed)
    q = enrichment.run(spark, store, f"file://{tmp_path}/pages", f"file://{tmp_path}/cp", lambda: 100)
    assert q.awaitTermination(120)
    rows = {r.id: r for r in store.read().collect()}
    assert len(rows) == 5
    assert (rows["0"].email_1, rows["0"].email_checked_at, rows["0"].first_seen) == ("info@s0.com", 100, 10)
    assert (rows["1"].email_1, rows["1"].email_checked_at) == (None, 100)
    assert (rows["2"].email_checked_at, rows["2"].email_attempts, rows["2"].email_retry_at) == (None, 1, 100 + 3_600_000)
    assert rows["3"].email_checked_at is None and rows["9"].email_checked_at is None
    version = store.version
    q = enrichment.run(spark, store, f"file://{tmp_path}/pages", f"file://{tmp_path}/cp", lambda: 200)
    assert q.awaitTermination(120) and store.version == version
    spark.streams.removeListener(feed)


@pytest.mark.parametrize("limit", [None, 4])
def test_no_page_of_a_batch_is_lost(spark, tmp_path, limit):
    store = PlaceStore(spark, f"file://{tmp_path}/s")
    fresh = stored(spark, [dict(id=str(i), name=f"n{i}", site=f"https://s{i}.com") for i in range(12)])
    store.upsert(fresh.drop("first_seen", "last_seen", "email_checked_at", "email_attempts", "email_retry_at"), 10)
    pages = [(str(i), f"mail info@s{i}.com" if i < 9 else None, f"https://s{i}.com/", "ok" if i < 9 else "timeout") for i in range(10)]
    spark.createDataFrame(pages, enrichment.PAGES_SCHEMA).coalesce(1).write.parquet(f"file://{tmp_path}/pages")
    assert enrichment.run(spark, store, f"file://{tmp_path}/pages", f"file://{tmp_path}/cp", lambda: 100, limit=limit).awaitTermination(300)
    rows = {int(r.id): r for r in store.read().collect()}
    assert [rows[i].email_1 for i in range(9)] == [f"info@s{i}.com" for i in range(9)]
    assert rows[9].email_attempts == 1 and rows[10].email_checked_at is None and len(rows) == 12


def _awaiting(spark, path, sites):
    store = PlaceStore(spark, path)
    fresh = stored(spark, [dict(id=str(i), name=f"n{i}", site=site) for i, site in enumerate(sites)])
    store.upsert(fresh.drop("first_seen", "last_seen", "email_checked_at", "email_attempts", "email_retry_at"), 10)
    return store


def test_three_strikes_in_the_stream(spark, tmp_path):
    """A domain that failed three times is deferred unseen in later micro-batches, until another stream begins; timeouts don't count, a success forgets."""
    store = _awaiting(spark, f"file://{tmp_path}/s", ["https://bad.com/x"] * 5 + ["https://slow.com"] * 5 + ["https://mixed.com"] * 5)
    page = lambda i, outcome: (str(i), "mail me@here.com" if outcome == "ok" else None, None, outcome)
    waves = [
        [page(i, "unreachable") for i in (0, 1, 2)] + [page(i, "timeout") for i in (5, 6, 7)] + [page(10, "unreachable"), page(11, "unreachable")],
        [page(3, "ok"), page(8, "ok"), page(12, "ok")],
        [page(13, "unreachable"), page(4, "ok")],
        [page(14, "ok")],
    ]
    for wave in waves:
        spark.createDataFrame(wave, enrichment.PAGES_SCHEMA).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/pages")
    run = lambda cp, now, files: enrichment.run(spark, store, f"file://{tmp_path}/pages", f"file://{tmp_path}/{cp}", lambda: now, files_a_batch=files).awaitTermination(300)
    assert run("cp", 100, 1)
    rows = {int(r.id): r for r in store.read().collect()}
    found = {i for i, r in rows.items() if r.email_1 == "me@here.com"}
    assert found == {8, 12, 14} and rows[3].email_attempts == rows[4].email_attempts == 1
    assert enrichment.outcome_counts(store) == {"ok": 3, "skipped": 2, "timeout": 3, "unreachable": 6}
    assert run("other", 100 + 3_600_000, None)
    again = {int(r.id): r for r in store.read().collect()}
    assert again[3].email_1 == again[4].email_1 == "me@here.com" and again[0].email_attempts == 2


def test_pages_of_places_in_backoff_wait(spark, tmp_path):
    """A page that comes too early is read by the first micro-batch that finds its place due."""
    store, now = _awaiting(spark, f"file://{tmp_path}/s", ["https://a.com", "https://b.com"]), [100]
    send = lambda *rows: spark.createDataFrame(rows, enrichment.PAGES_SCHEMA).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/pages")
    run = lambda: enrichment.run(spark, store, f"file://{tmp_path}/pages", f"file://{tmp_path}/cp", lambda: now[0]).awaitTermination(300)
    state = lambda: {r.id: (r.email_1, r.email_attempts) for r in store.read().collect()}
    send(("0", None, None, "timeout"))
    run()
    send(("0", "x info@a.com", None, "ok"))
    now[0] = 200
    run()
    assert state() == {"0": (None, 1), "1": (None, None)}
    send(("1", None, None, "timeout"))
    now[0] = 100 + 3_600_000
    run()
    assert state() == {"0": ("info@a.com", 1), "1": (None, 1)}


def test_a_micro_batch_that_is_run_again_changes_nothing(spark, tmp_path):
    store = _awaiting(spark, f"file://{tmp_path}/s", ["https://a.com", "https://b.com"])
    pages = spark.createDataFrame([("0", None, None, "unreachable"), ("1", "i@b.com", None, "ok")], enrichment.PAGES_SCHEMA)
    assert enrichment.settle_round(store, pages, 100, "cp", 0) == 2
    before = sorted(map(str, store.read().collect())), enrichment.outcome_counts(store)
    assert enrichment.settle_round(store, pages, 100 + 3_600_000, "cp", 0) == 0
    assert (sorted(map(str, store.read().collect())), enrichment.outcome_counts(store)) == before


def test_best_page(spark):
    pages = [("1", None, "u", "ok"), ("1", "short", "u", "ok"), ("1", "longer", "u", "ok"), ("1", "longest of all", "u", "timeout"), ("2", None, None, "timeout")]
    got = {r.id: r.html for r in enrichment.best_page(spark.createDataFrame(pages, enrichment.PAGES_SCHEMA)).collect()}
    assert got == {"1": "longer", "2": None}


def test_schema():
    assert len(PLACE_COLUMNS) == len(set(PLACE_COLUMNS)) == 54 == len(PLACE_SCHEMA)


def test_as_places(spark):
    df = as_places(spark.createDataFrame([("a", 1)], "name string, extra int"), enriched=True)
    assert len(df.columns) == 63 and df.first().name == "a"
