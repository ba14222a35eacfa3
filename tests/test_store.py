import pytest
from pyspark.sql import functions as F

from placemill.operators import store as S
from placemill.operators.filters import PlaceFilter, QuickFilter, cleaned_request
from tests.places import stored

ROWS = [
    dict(id="1", name="Alpha Glass", category="Glass shop", city="Burnaby", state="BC", site="https://a.com", email_1="Info@a.com", rating=4.5, reviews=10, phone="1", first_seen=1, latitude=49.1, longitude=-123.0, query="q1"),
    dict(id="2", name="Beta", category="Glass shop", city="Surrey", state="BC", site="https://b.com", email_1="", rating=None, reviews=None, phone="", first_seen=2, latitude=49.2, longitude=-123.1, query="q1", email_checked_at=5),
    dict(id="3", name="Gamma_1", category="Door shop", city="Burnaby", state="WA", site="", email_1=None, rating=0.0, reviews=0, first_seen=3, business_status="CLOSED", verified=True),
    dict(id="4", name="éclair", category=None, city="", state=None, site="https://d.com", email_1="info@A.com", rating=5.0, reviews=99, phone="4", first_seen=4, latitude=-0.5, longitude=0.5, business_status="OPERATIONAL", verified=False),
    dict(id="5", name="Epsilon", category="Door shop", city="Delta", state="BC", site="https://e.com", email_1=None, rating=3.0, reviews=10, first_seen=0, email_retry_at=100, email_attempts=1),
]


@pytest.fixture(scope="module")
def places(spark):
    return stored(spark, ROWS).cache()


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


@pytest.mark.parametrize(
    "asked,want",
    [
        (PlaceFilter(), "12345"), (PlaceFilter(category="Glass shop"), "12"), (PlaceFilter(categories=("Door shop",), category="Glass shop"), "35"), (PlaceFilter(categories=()), "12345"), (PlaceFilter(cities=("Burnaby", "Delta"), states=("BC",)), "15"),
        (PlaceFilter(query="q1"), "12"), (PlaceFilter(has_email=True), "14"), (PlaceFilter(missing_email=True), "235"), (PlaceFilter(has_phone=True), "14"), (PlaceFilter(has_website=True), "1245"), (PlaceFilter(min_rating=0), "1345"), (PlaceFilter(min_reviews=0), "1345"),
        (PlaceFilter(search="GLASS"), "1"), (PlaceFilter(search="a_1"), "3"), (PlaceFilter(search="g%s"), "1"), (PlaceFilter(state="BC", has_email=True, min_rating=4.5), "1"), (PlaceFilter(city=""), "12345"),
    ],
)
def test_filters(places, asked, want):
    assert ids(S.ids(places, asked)) == list(want)
    assert S.count_where(places, asked).first().n == len(want)


def test_filters_reach_the_scan(spark, tmp_path):
    stored(spark, ROWS).write.parquet(str(tmp_path / "p"))
    plan = PlaceFilter(state="BC", min_rating=2).where(spark.read.parquet(str(tmp_path / "p"))).select("id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "EqualTo(state,BC)" in plan and "GreaterThanOrEqual(rating,2" in plan and "phone" not in plan.split("ReadSchema")[1]


def test_order_and_pages(places):
    order = [r.id for r in S.query(places, PlaceFilter()).collect()]
    assert order == ["4", "1", "5", "3", "2"]
    assert [r.id for r in S.query(places, PlaceFilter(sort="rating", ascending=True)).collect()] == ["3", "5", "1", "4", "2"]
    assert [r.id for r in S.query(places, PlaceFilter(sort="phone; drop table", limit=2, offset=1)).collect()] == ["1", "5"]
    assert [r.id for r in S.query(places, PlaceFilter(limit=0)).collect()] == []
    with pytest.raises(ValueError):
        PlaceFilter(limit=-1).page(places)


def test_unfindable_is_only_shown(places):
    assert {r.id: r.email_1 for r in S.query(places, PlaceFilter()).collect()}["2"] == "unfindable"
    assert S.by_id(places, "2").first().email_1 == "" and S.by_id(places, "x").count() == 0
    assert ids(S.query(places, PlaceFilter(has_email=True))) == ["1", "4"]


@pytest.mark.parametrize(
    "asked,want",
    [
        (QuickFilter(), "12345"), (QuickFilter(only_with_website=True), "1245"), (QuickFilter(only_without_website=True), "3"), (QuickFilter(with_phone=True), "14"), (QuickFilter(verified=True), "3"), (QuickFilter(operational_only=True), "1245"),
        (QuickFilter(min_reviews=0), "12345"), (QuickFilter(min_reviews=1), "145"), (QuickFilter(min_rating=0), "1345"), (QuickFilter(max_rating=3), "35"),
    ],
)
def test_quick_filters(places, asked, want):
    assert ids(asked.where(places)) == list(want)


def test_conflicts_and_requests():
    assert QuickFilter().conflicts() == [] and len(QuickFilter(only_with_website=True, only_without_website=True, min_rating=4, max_rating=3).conflicts()) == 2
    assert cleaned_request([" a ", "", 5], ["x"]) == (["a", "5"], ["x"])
    for bad in (([""], ["x"]), (["a"], [])):
        with pytest.raises(ValueError):
            cleaned_request(*bad)


def test_facets(places):
    assert [(r.value, r.n) for r in S.facet(places, "category").collect()] == [("Door shop", 2), ("Glass shop", 2)]
    assert ("", 1) in [(r.value, r.n) for r in S.facet(places, "city").collect()]
    assert (("Burnaby", "BC"), 1) in [((r.city, r.state), r.n) for r in S.city_state_facet(places).collect()]
    with pytest.raises(ValueError):
        S.facet(places, "name")


def test_contact_stats(places):
    r = S.contact_stats(places, 5).first()
    assert (r.total, r.with_email, r.with_site, r.with_phone, r.checked, r.checked_since, r.with_email_since) == (5, 2, 4, 2, 1, 1, 0)
    assert tuple(S.contact_stats(places.limit(0)).first()) == (0,) * 7


def test_map(places):
    assert [r.name for r in S.geo(places, PlaceFilter()).collect()] == ["éclair", "Alpha Glass", "Beta"]
    kind, points = S.geo_view(places, PlaceFilter(), 50, 49, -122, -124)
    assert kind == "points" and points.count() == 2
    kind, cells = S.geo_view(places, PlaceFilter(), 50, -1, 1, -124, threshold=2)
    assert kind == "clusters" and sum(r["count"] for r in cells.collect()) == 3


def test_queue(places):
    assert [r.id for r in S.next_email_targets(places, 99).collect()] == []
    assert [r.id for r in S.next_email_targets(places, 100).collect()] == ["5"]
    assert S.pending_email_checks(places).first().n == 1


def test_backoff(spark, places):
    one = spark.createDataFrame([("5",)], "id string")
    state = lambda p: next((r.email_attempts, r.email_retry_at, r.email_checked_at) for r in p.filter("id = '5'").collect())
    fresh = places.withColumns({"email_attempts": F.lit(None).cast("long"), "email_retry_at": F.lit(None).cast("long")})
    first = S.mark_deferred(fresh, one, 1000)
    assert state(first) == (1, 1000 + 3_600_000, None)
    second = S.mark_deferred(first, one, 2000)
    assert state(second) == (2, 2000 + 21_600_000, None)
    assert state(S.mark_deferred(second, one, 3000)) == (3, None, 3000)
    assert state(S.mark_checked(fresh, one, 9)) == (None, None, 9)
    assert S.mark_deferred(fresh, one, 1).count() == 5


def test_routes(spark):
    df = spark.createDataFrame([("ok",), ("no_site",), ("timeout",), ("unreachable",), ("skipped",)], "outcome string")
    assert [r.route for r in S.routed(df).collect()] == ["checked"] * 2 + ["deferred"] * 3


def test_leads(spark, places):
    assert [(r.name, r.email, r.website) for r in S.leads(places).collect()] == [("éclair", "info@A.com", "https://d.com")]
    dead = spark.createDataFrame([("A.COM",)], "domain string")
    assert S.leads(places, dead_domains=dead).count() == 0


def test_store_versions(spark, tmp_path):
    s = S.PlaceStore(spark, f"file://{tmp_path}/store")
    assert s.version is None and s.read().count() == 0
    assert s.upsert(stored(spark, ROWS[:3]).drop("first_seen", "last_seen", "email_checked_at", "email_attempts", "email_retry_at"), 100) == 3
    again = stored(spark, [dict(id="3", name="Gamma again", reviews=7), dict(id="9", name="new", email_1="n@n.com"), dict(id="9", name="newer"), dict(id="1", name="Alpha")]).drop("first_seen", "last_seen", "email_checked_at", "email_attempts", "email_retry_at")
    old = s.version
    assert s.upsert(again.coalesce(1), 200) == 1 and s.version != old
    rows = {r.id: r for r in s.read().collect()}
    assert len(rows) == 4 and (rows["3"].name, rows["3"].first_seen, rows["3"].last_seen, rows["3"].reviews) == ("Gamma again", 100, 200, 7)
    assert rows["9"].name == "newer" and rows["1"].email_1 is None and rows["2"].last_seen == 100
    s.mark_checked(spark.createDataFrame([("1",), ("2",)], "id string"), 300)
    assert {r.id for r in s.read().filter("email_checked_at = 300").collect()} == {"1", "2"}
    assert s.recheck_once(400) and not s.recheck_once(500) and s.setting("email_recheck") == "400"
    assert s.read().filter("email_checked_at is not null").count() == 0
    s.set_setting("a", "1")
    s.set_setting("a", None)
    assert s.setting("a") is None
    assert s.snapshot("2024-01-01") and not s.snapshot("2024-01-01")
    for k in range(2, 5):
        assert s.snapshot(f"2024-01-0{k}", keep=2)
    assert sorted(p.name for p in (tmp_path / "store/snapshots").iterdir() if not p.name.startswith(".")) == ["2024-01-03", "2024-01-04"]
    assert s.stats()["contact"].first().total == 4


def bare(spark, rows):
    return stored(spark, rows).drop("first_seen", "last_seen", "email_checked_at", "email_attempts", "email_retry_at")


def files(tmp_path):
    return {p: p.stat().st_size for p in (tmp_path / "store").rglob("*.parquet")}


def test_writes_follow_the_batch(spark, tmp_path):
    """Few rows over all parts write few files and no part again; what is old goes."""
    s = S.PlaceStore(spark, f"file://{tmp_path}/store", buckets=8)
    assert s.upsert(bare(spark, [dict(id=str(i), name=f"n{i}") for i in range(4000)]), 1) == 4000
    before, parts = files(tmp_path), s._manifest()["parts"]
    assert s.upsert(bare(spark, [dict(id=str(i), name="again") for i in range(0, 4020, 67)]), 10) == 0
    new = {p: n for p, n in files(tmp_path).items() if p not in before}
    assert len(new) <= 2 and sum(new.values()) < sum(before.values()) / 4 and s._manifest()["parts"] == parts
    for k in range(10):
        s.mark_checked(spark.createDataFrame([(str(k),), ("7",)], "id string"), 100 + k)
    assert len(s._manifest()["deltas"]) <= S.DELTAS and s._manifest()["parts"] == parts
    rows = {r.id: r for r in s.read().collect()}
    assert len(rows) == 4000 and rows["7"].email_checked_at == 109 and rows["3"].email_checked_at == 103
    assert rows["67"].name == "again" and (rows["67"].first_seen, rows["67"].last_seen) == (1, 10) and rows["68"].name == "n68"
    assert s.upsert(bare(spark, []), 99) == 0
    assert len(files(tmp_path)) <= 8 + 2 * S.DELTAS + 2 * S.GRACE


def test_large_deltas_are_folded(spark, tmp_path):
    s = S.PlaceStore(spark, f"file://{tmp_path}/store", buckets=4)
    s.upsert(bare(spark, [dict(id=str(i), name="a") for i in range(100)]), 1)
    assert s.upsert(bare(spark, [dict(id=str(i), name="b") for i in range(90, 130)]), 2) == 30
    assert s._manifest()["deltas"] == [] and s._manifest()["rows"] == 130
    names = {r.id: r.name for r in s.read().collect()}
    assert len(names) == 130 and names["95"] == "b" and names["5"] == "a"


@pytest.mark.parametrize("seed", [1])
def test_store_against_a_dictionary(spark, tmp_path, seed):
    """Random upserts and marks, read whole and by parts after each."""
    import random

    rnd = random.Random(seed)
    s, model = S.PlaceStore(spark, f"file://{tmp_path}/store", buckets=3), {}
    for step in range(9):
        ids = rnd.sample(range(60), rnd.choice([1, 2, 30]))
        if step and rnd.random() < 0.4:
            s.mark_checked(spark.createDataFrame([(str(i),) for i in ids], "id string"), step)
            model.update({i: (model[i][0], step) for i in ids if i in model})
        else:
            new = s.upsert(bare(spark, [dict(id=str(i), name=f"n{step}") for i in ids]), step)
            assert new == sum(i not in model for i in ids)
            model.update({i: (f"n{step}", model.get(i, (0, None))[1]) for i in ids})
    assert {int(r.id): (r.name, r.email_checked_at) for r in s.read().collect()} == model
    some = spark.createDataFrame([(str(i),) for i in range(5)], "id string")
    assert sorted(int(r.id) for r in s.rows_of(some).collect()) == sorted(i for i in range(5) if i in model)


def test_new_columns_come_with_a_delta(spark, tmp_path):
    s = S.PlaceStore(spark, f"file://{tmp_path}/store", buckets=2)
    s.write(spark.createDataFrame([("1", "a"), ("2", "b")], "id string, name string"))
    s.append(spark.createDataFrame([("2", "c", 5)], "id string, name string, extra long"))
    assert {(r.id, r.name, r.extra) for r in s.read().collect()} == {("1", "a", None), ("2", "c", 5)}
    s.fold()
    assert {(r.id, r.name, r.extra) for r in s.read().collect()} == {("1", "a", None), ("2", "c", 5)}


def test_preserving_merge(places, spark):
    batch = stored(spark, [dict(id="1", name="A")]).select("id", "name", "email_1")
    keep = {r.id: r.email_1 for r in S.upserted(places, batch, 7, "preserve_enrichment").collect()}
    gone = {r.id: r.email_1 for r in S.upserted(places, batch, 7).collect()}
    assert keep["1"] == "Info@a.com" and gone["1"] is None
    with pytest.raises(ValueError):
        S.upserted(places, batch, 7, "other")
