import math

import pytest
from pyspark.sql import functions as F

from placemill.functions import geo, numbers, text, urls
from placemill.operators import catalog


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column.alias("v")).collect()]


@pytest.mark.parametrize(
    "name,want",
    [("Joe's Pizza, LLC", "joespizza"), ("The Café Co.", "cafe"), ("Theatre Inc", "theatre"), ("ÅNGSTRÖM Ltd", "angstrom"), ("Company", ""), ("日本", ""), (None, None), ("co-op", "op")],
)
def test_names(name, want):
    assert text.normalised_name(name) == want


def test_phrases():
    assert text.normalised_phrase("  Glass &  Mirror—Shop ") == "glass mirror shop"
    assert text.normalised_phrase("Crêperie") == "creperie"
    assert text.normalised_phrase(None) is None


@pytest.mark.parametrize("x,want", [(49.12345, "49.1234"), (0.00005, "0.0001"), (-0.00005, "-0.0001"), (1.0, "1.0000"), (-0.0, "0.0000"), (-123.45675, "-123.4567"), (None, None), (2.5e-5, "0.0000")])
def test_fixed(x, want):
    assert text.fixed(x) == want


@pytest.mark.parametrize(
    "x,want",
    [(5.0, "5"), (1e7, "10000000"), (0.1, "0.1"), (1e21, "1e+21"), (1.5e300, "1.5e+300"), (1e-6, "0.000001"), (1e-7, "1e-7"), (-0.0, "0"), (123456789012345680000.0, "123456789012345680000"), (-2.5, "-2.5"), (float("nan"), "NaN"), (3, "3"), (math.inf, "Infinity")],
)
def test_number_text(x, want):
    assert text.number_text(x) == want


def test_subsequence(spark):
    rows = [("cofsh", "coffeeshop", 8), ("abc", "acb", None), ("", "x", 0), ("oo", "foo", 2), ("xa", "xbxa", 4)]
    got = values(spark, rows, "q string, t string, w int", text.subsequence_span(F.col("q"), F.col("t")))
    assert got == [r[2] for r in rows]


def test_edit_distance_and_budget(spark):
    rows = [("kitten", "sitting", 3, 3), ("kitten", "sitting", 2, None), ("", "", 1, 0)]
    assert values(spark, rows, "a string, b string, m int, w int", text.edit_distance_within(F.col("a"), F.col("b"), F.col("m"))) == [r[3] for r in rows]
    assert values(spark, [(n,) for n in (3, 4, 5, 7, 8)], "n int", text.typo_budget(F.col("n"))) == [1, 1, 2, 2, 3]


def test_cells(spark):
    rows = [("plain", "plain"), ("a,b", '"a,b"'), ('say "hi"', '"say ""hi"""'), ("=1+1", "\t=1+1"), ("@x", "\t@x"), ("+1 718-555-0100", "+1 718-555-0100"), ("-73.98", "-73.98"), ("+cmd|'/C'", "\t+cmd|'/C'"), ("-a,b", '"\t-a,b"'), ("l1\nl2", '"l1\nl2"'), (None, ""), ("\tx", "\t\tx"), ("-(1)", "\t-(1)")]
    assert values(spark, rows, "a string, w string", text.csv_cell(F.col("a"))) == [r[1] for r in rows]


def test_slug(spark):
    rows = [("Glass Shops, BC!", "glass-shops-bc"), ("***", "export"), ("é", "export"), ("x" * 60, "x" * 50)]
    assert values(spark, rows, "a string, w string", text.slug(F.col("a"))) == [r[1] for r in rows]


def test_numbers(spark):
    rows = [("1,234", 1.234), ("5.0abc", 5.0), ("abc", None), ("  -3e2x", -300.0), (".5", 0.5), ("", None), ("7", 7.0), ("1,2,3", 1.2)]
    assert values(spark, rows, "a string, w double", numbers.prefix_number(F.col("a"))) == [r[1] for r in rows]


def test_variant_readers(spark):
    v = F.parse_json(F.lit('["", "x", 5, 2.5, true, [1], "3,5z", null, {"a": 1}, 1e3]'))
    one = spark.range(1).select(v.alias("v"))
    read = lambda f, n: [one.select(f(F.col("v"), f"$[{i}]").alias("x")).first().x for i in range(n)]
    assert read(numbers.pick_string, 11) == [None, "x", "5", "2.5", None, None, "3,5z", None, None, "1000", None]
    assert read(numbers.pick_number, 11) == [None, None, 5.0, 2.5, None, None, 3.5, None, None, 1000.0, None]
    assert read(numbers.pick_bool, 5) == [None, None, True, True, True]
    assert [x is not None for x in read(numbers.pick_array, 7)] == [False] * 5 + [True, False]


def test_ids(spark):
    rows = [("0x89c259a715fb5059:0xe5543b76e952fab3", "16524735134567725747"), ("0x1:0xff", "255"), ("0x1", None), ("0x1:zz", None), (None, None), ("0x1:0x", None)]
    got = values(spark, rows, "a string, w string", numbers.cid_of(F.col("a")))
    assert got == [str(int("e5543b76e952fab3", 16)), "255", None, None, None, None]


def test_domains(spark):
    rows = [("https://www.Acme.com/x?y", "acme.com"), ("acme.com", "acme.com"), ("", None), (None, None), ("http://m.acme.co.uk:8080/", "m.acme.co.uk"), ("not a url", None)]
    assert values(spark, rows, "a string, w string", urls.domain_of(F.col("a"))) == [r[1] for r in rows]


def test_site_urls(spark):
    rows = [("acme.com", "https://acme.com/"), ("http://Acme.com/a?b#c", "http://acme.com/a"), ("https://acme.com/p%3Fx=1%26y=2", "https://acme.com/p"), ("https://www.facebook.com/acme", None), ("https://netflix.com/", None), ("https://linktr.ee/x", "https://linktr.ee/x"), (None, None), ("", None)]
    assert values(spark, rows, "a string, w string", urls.site_to_url(F.col("a"))) == [r[1] for r in rows]


def test_other_urls(spark):
    rows = [("https://acme.com/", ["http://acme.com/", "https://www.acme.com/"]), ("http://www.acme.com/", ["http://acme.com/"])]
    assert values(spark, rows, "a string, w array<string>", urls.fallback_urls(F.col("a"))) == [r[1] for r in rows]
    rows = [("https://www.google.com/url?q=https%3A%2F%2Fx.com%2F&sa=U", "https://x.com/"), ("https://x.com/a", "https://x.com/a"), ("/rel", None), (None, None), ("http://google.com/url?url=http://y.com", "http://y.com"), ("https://google.com/maps", "https://google.com/maps")]
    assert values(spark, rows, "a string, w string", urls.unwrapped(F.col("a"), "google.com")) == [r[1] for r in rows]
    rows = [("http://www.X.com/Me/?a=1#b", "https://x.com/Me"), ("nonsense", "nonsense")]
    assert values(spark, rows, "a string, w string", urls.canonical(F.col("a"))) == [r[1] for r in rows]


def test_geometry(spark):
    b = geo.box_of(-123.3, 49.1, -123.0, 49.4)
    r = spark.range(1).select(geo.diagonal_m(b).alias("d"), geo.zoom_for_box(b).alias("z"), F.size(geo.grid_split(b)).alias("n"), geo.children(b).alias("c"), geo.centre_of(b).alias("m"), geo.swept_km2(b).alias("a")).first()

    def haversine(a, b_, c, d):
        h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b_) / 2) ** 2
        return 2 * 6371008.8 * math.asin(math.sqrt(h))

    assert r.d == pytest.approx(haversine(49.1, -123.3, 49.4, -123.0))
    width = haversine(49.25, -123.3, 49.25, -123.0)
    assert r.z == pytest.approx(round(math.log2(156543.03392 * math.cos(math.radians(49.25)) * 1000 / width), 2))
    assert r.n == math.ceil(width / 12000) * math.ceil(haversine(49.1, 0, 49.4, 0) / 12000)
    assert (r.c[0].west, r.c[0].south) == (-123.3, r.m.lat) and r.c[3].east == -123.0 and r.c[3].south == 49.1
    assert r.a == pytest.approx(width * haversine(49.1, 0, 49.4, 0) / 1e6)


def test_children_tile_the_box(spark):
    b = geo.box_of(0, 0, 8, 4)
    parts = spark.range(1).select(F.explode(geo.children(b)).alias("c")).select("c.*").collect()
    assert sum((p.east - p.west) * (p.north - p.south) for p in parts) == 32


def test_truncated_cells(spark):
    rows = [(-0.7, 0), (0.7, 0), (-1.2, -1), (1.2, 1)]
    assert values(spark, rows, "a double, w long", geo.map_cell(F.col("a"), F.lit(1.0))) == [r[1] for r in rows]


def test_relations(spark):
    a, touching, apart = geo.box_of(0, 0, 1, 1), geo.box_of(1, 1, 2, 2), geo.box_of(1.1, 0, 2, 1)
    r = spark.range(1).select(geo.intersects(a, touching).alias("x"), geo.intersects(a, apart).alias("y"), geo.contains(a, F.lit(1.0), F.lit(0.0)).alias("z")).first()
    assert (r.x, r.y, r.z) == (True, False, True)


NAMES = ["Restaurant", "Rest stop", "Coffee shop", "Cafe", "Internet cafe", "Gym", "Glass & Mirror Shop", "Carpenter", "Italian restaurant", "Pharmacy"]


@pytest.mark.parametrize(
    "asked,first",
    [("rest", "Restaurant"), ("cafe", "Cafe"), ("resturant", "Restaurant"), ("cofsh", "Coffee shop"), ("mirror", "Glass & Mirror Shop"), ("italian", "Italian restaurant"), ("gim", "Gym"), ("RESTAURANT", "Restaurant")],
)
def test_category_search(spark, asked, first):
    entries = catalog.dictionary(spark.createDataFrame([(n,) for n in NAMES], "name string"))
    found = catalog.search_categories(entries, asked)
    assert found.first().name == first
    scores = [r.score for r in found.collect()]
    assert scores == sorted(scores, reverse=True) and all(s > 0 for s in scores)


def test_category_search_bounds(spark):
    entries = catalog.dictionary(spark.createDataFrame([(n,) for n in NAMES], "name string"))
    assert catalog.search_categories(entries, "  ").count() == 0
    assert catalog.search_categories(entries, "zzzzqqqq").count() == 0
    assert catalog.search_categories(entries, "a", 3).count() == 3
    asked = spark.createDataFrame([("coffee SHOP",), ("coffe",)], "query string")
    assert [r.query for r in catalog.official(entries, asked).collect()] == ["coffee SHOP"]
    many = catalog.search_many(catalog.Index.of(entries), asked, 1).collect()
    assert {r.query: r.name for r in many} == {"coffee SHOP": "Coffee shop", "coffe": "Coffee shop"}


def test_index_finds_what_a_scan_finds(spark):
    """Random entries and queries over few letters, so that every kind of match and many ties occur; typos of up to three edits, queries of one letter, with spaces and of signs only."""
    import random

    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcde1") for _ in range(rnd.randint(1, 9)))
    names = sorted({" ".join(word() for _ in range(rnd.randint(1, 3))) for _ in range(60)} | {"Éclair  bar", "x", "", "!!", "a-b c"})

    def misspelled(one):
        letters = list(one)
        for _ in range(rnd.randint(0, 3)):
            at = rnd.randrange(len(letters) + 1)
            letters[at : at + rnd.randint(0, 1)] = rnd.choice(["", "z", "a", "bc"])
        return "".join(letters)

    queries = sorted({misspelled(rnd.choice(rnd.choice(names).split(" "))) for _ in range(50)} | {"".join(rnd.choice("abcde ") for _ in range(rnd.randint(1, 7))) for _ in range(40)} | {"", "??", "ECLAIR", "a b", "zzzz"})
    entries = catalog.dictionary(spark.createDataFrame([(n,) for n in names], "name string"))
    asked = spark.createDataFrame([(q,) for q in queries], "query string")
    every = asked.select("query", text.normalised_phrase_of(F.col("query")).alias("q")).join(entries, F.col("q") != "")
    scan = every.select("query", "name", text.match_score(F.col("q"), F.col("norm"), F.col("words")).alias("score")).filter("score > 0")
    got = catalog.search_many(catalog.Index.of(entries), asked, 10_000)
    want = sorted((r.query, r.name, r.score) for r in scan.collect())
    assert sorted((r.query, r.name, r.score) for r in got.collect()) == want and len(want) > 500
    one = {(r.query, r["rank"]): r.name for r in catalog.search_many(catalog.Index.of(entries), asked, 2).collect()}
    best = catalog.search_categories(entries, queries[10], 2).collect()
    assert [one.get((queries[10], k + 1)) for k in range(len(best))] == [r.name for r in best]


def test_index_of_nothing(spark):
    none = catalog.Index.of(catalog.dictionary(spark.createDataFrame([], "name string")))
    assert catalog.search_many(none, spark.createDataFrame([("abc",)], "query string")).count() == 0
    some = catalog.Index.of(catalog.dictionary(spark.createDataFrame([("abc",)], "name string")))
    assert catalog.search_many(some, spark.createDataFrame([], "query string")).count() == 0


def test_a_query_meets_few_entries(spark):
    """What is scored follows the matches and not the dictionary."""
    import hashlib

    names = [hashlib.sha256(str(i).encode()).hexdigest()[:12] for i in range(1500)]
    index = catalog.Index.of(catalog.dictionary(spark.createDataFrame([(n,) for n in names], "name string")))
    asked = [(n, f"{n[:4]}x{n[5:]}") for n in names[:5]]
    found = index.candidates(spark.createDataFrame(asked, "query string, q string")).collect()
    assert {n for n, _ in asked} == {r.name for r in found if r.query == r.name} and len(found) < 5 * 150
