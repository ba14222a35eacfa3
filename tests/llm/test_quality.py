import random
import zlib

import numpy as np
import pytest

from placemill.llm import quality
from tests.llm.helpers import documents, empty, odd

WORDS = "the of and to in is for on with that by this from are as be it at was an".split()


def corpus(n=600, seed=1):
    rnd = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = [rnd.choice(WORDS) + rnd.choice(["", "er", "ing"]) for _ in range(rnd.randint(20, 200))]
        bad = rnd.random() < 0.25
        text = " ".join(words)
        if bad:
            text = rnd.choice([text.upper() + "!!", " | ".join(words), " ".join(w + rnd.choice(["%%%", "$$$", "###"]) for w in words)])
        rows.append((i, text, f"site{i % 5}", rnd.choice(["en", "fr"])))
        if rnd.random() < 0.6:
            labels.append((i, int(not bad), 0))
    return rows, labels


def label_table(spark, labels):
    return spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    found = {r.doc_id: r for r in quality.score(documents(spark, rows), label_table(spark, labels)).collect()}
    held = [(i, q) for i, q, _ in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(found) == len(rows) and len(held) > 50
    assert np.mean([found[i].kept == bool(q) for i, q in held]) > 0.97
    kept = quality.keep_good(documents(spark, rows), label_table(spark, labels))
    assert {r.doc_id for r in kept.collect()} == {i for i, r in found.items() if r.kept} and kept.columns == documents(spark, rows).columns


def test_posteriors_brute(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice(["a", "b", None]), rnd.choice(["x", None]), rnd.gauss(1, 2)) for i in range(80)]
    got = {r.doc_id: r for r in quality.posteriors(spark.createDataFrame(rows, "doc_id long, site string, path string, logit double")).collect()}
    p = {i: 1 / (1 + np.exp(-z)) for i, _, _, z in rows}
    m = np.mean(list(p.values()))

    def strength(groups, centre):
        n = np.array([len(g) for g in groups])
        s = np.array([sum(p[i] for i in g) for g in groups])
        v = sum(p[i] * (1 - p[i]) + 1e-4 for g in groups for i in g)
        between = (n * (s / n - centre) ** 2).sum() / n.sum()
        within = v / n.sum()
        return min(max(within / max(between - within * len(n) / n.sum(), 1e-9), 1.0), quality.MAX_STRENGTH)

    def by(key):
        out = {}
        for r in rows:
            out.setdefault(key(r), []).append(r[0])
        return out

    sites, paths = by(lambda r: r[1]), by(lambda r: (r[1], r[2]))
    k = strength(list(sites.values()), m)
    site_rate = {s: sum(p[i] for i in g) / len(g) for s, g in sites.items()}
    k2 = strength(list(paths.values()), np.array([site_rate[s] for s, _ in paths]))

    def logit(x):
        return np.log(x / (1 - x))

    for i, s, t, z in rows:
        site = (sum(p[j] for j in sites[s]) + k * m) / (len(sites[s]) + k)
        assert got[i].site_posterior == pytest.approx(site)
        assert got[i].path_posterior == pytest.approx((sum(p[j] for j in paths[s, t]) + k2 * site) / (len(paths[s, t]) + k2))
        without = (sum(p[j] for j in sites[s]) - p[i] + k * m) / (len(sites[s]) - 1 + k)
        path = (sum(p[j] for j in paths[s, t]) - p[i] + k2 * without) / (len(paths[s, t]) - 1 + k2)
        assert got[i].score == pytest.approx(1 / (1 + np.exp(-(z + quality.SITE_WEIGHT * (logit(path) - logit(m))))))


def test_sparse_sites_shrink(spark):
    rows = [(i, "big", "x", 2.0) for i in range(200)] + [(1000, "tiny", "x", -3.0)] + [(2000 + i, "bad", "x", -2.0) for i in range(200)]
    got = {r.site: r for r in quality.posteriors(spark.createDataFrame(rows, "doc_id long, site string, path string, logit double")).collect()}
    assert got["bad"].site_posterior < got["tiny"].site_posterior < got["big"].site_posterior


@pytest.mark.parametrize("labels", [[], [(0, 1, 0)], [(3, None, None), (None, 1, 0)]])
def test_odd_rows_and_few_labels(spark, labels):
    df = odd(spark)
    found = quality.score(df, label_table(spark, labels)).collect()
    assert len(found) == df.count() and all(0 <= r.score <= 1 for r in found)


def test_empty_table(spark):
    assert quality.score(empty(spark), label_table(spark, [(1, 1, 0)])).count() == 0
    assert quality.keep_good(empty(spark), label_table(spark, [])).count() == 0


def test_rows_that_share_an_id_and_names(spark):
    rnd = random.Random(3)
    good = [" ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8))) for _ in range(40)).capitalize() + "." for _ in range(60)]
    bad = ["!!! $$$ ### " * 20 + str(i) for i in range(60)]
    rows = [*enumerate(good), *((100 + i, t) for i, t in enumerate(bad)), (500, good[0] + " More words."), (500, bad[0] + " x"), (None, good[1])]
    df = documents(spark, rows).selectExpr("doc_id", "text", "lang", "source", "'u' as __id", "'v' as id", "'w' as key", "'x' as whole")
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in rows if i is not None and i != 500], "doc_id long, quality int")
    have = quality.keep_good(df, labels)
    assert have.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in have.collect()) == sorted((i is None, i or 0, t) for i, t in rows if "###" not in t)
