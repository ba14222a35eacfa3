import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from placemill.llm import shingles, simhash
from placemill.llm.common import connected_components
from tests.llm.helpers import ODD_TEXTS, documents, empty, odd


def slow_fingerprint(text, words=3, seed=42):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + words]).encode(), seed) for i in range(max(1, len(w) - words + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fps, bits=2):
    """fps: list of (id, fingerprint) -> id -> smallest id reachable."""
    label = {i: i for i, _ in fps}
    changed = True
    while changed:
        changed = False
        for a, x in fps:
            for b, y in fps:
                if (x ^ y).bit_count() <= bits and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


@pytest.mark.parametrize("text", [t for t in ODD_TEXTS if t is not None])
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == slow_fingerprint(text)


def test_spark_hashes_alike(spark):
    assert spark.sql("select xxhash64('a b c') as h").first().h & (2**64 - 1) == xxhash.xxh64_intdigest(b"a b c", 42)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("bits,cell_pairs", [(2, 32), (2, 2), (1, 2), (0, 32)])
def test_links_random_clusters(spark, bits, cell_pairs):
    rnd = random.Random(bits)
    fps = set()
    for _ in range(15):
        x = rnd.getrandbits(64)
        for _ in range(12):
            fps.add(x)
            for _ in range(rnd.randint(1, 3)):
                x ^= 1 << rnd.randrange(64)
    fps = [(i, x) for i, x in enumerate(sorted(fps))]
    df = spark.createDataFrame([(i, signed(x)) for i, x in fps], "doc_id long, fp long")
    got = {r.id: r.component for r in simhash.components(df, bits, cell_pairs).collect()}
    assert got == slow_components(fps, bits)


def test_embedding_bounds_hamming(spark):
    rnd = random.Random(3)
    rows = [(signed(x), signed(x ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randint(0, 5))))) for x in (rnd.getrandbits(64) for _ in range(500))]
    df = spark.createDataFrame(rows, "x long, y long").select("x", "y", simhash._manhattan(F.col("x"), F.col("y")).alias("m"))

    def counts(v):
        return np.array([(v >> (2 * k) & 3).bit_count() for k in range(32)])

    for r in df.collect():
        x, y = r.x & (2**64 - 1), r.y & (2**64 - 1)
        assert r.m == np.abs(counts(x) - counts(y)).sum() <= (x ^ y).bit_count()


def test_documents(spark):
    rnd = random.Random(5)
    base = " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(900))
    near = base[: base.rindex(" ")] + " changed"
    rows = [(5, base), (2, near), (9, base.upper()), (7, "else entirely " * 30), (8, ""), (4, None), (4, None)]
    want = slow_components([(i, slow_fingerprint(t)) for i, t in dict(rows).items()])
    assert want[5] == want[9] == 2 and want[7] == 7 and want[8] == 4
    df = documents(spark, rows)
    assert {r.doc_id: r.component_id for r in simhash.assign(df).collect()} == want
    assert {r.doc_id for r in simhash.keep_one(df).collect()} == {2, 7, 4}


@pytest.mark.parametrize("keep", [simhash.keep_one, shingles.keep_one])
def test_rows_that_share_an_id(spark, keep):
    a, b = "alpha beta gamma delta " * 9, "one two three four five six seven " * 5
    rows = [(2, b), (5, a), (5, b), (7, a), (7, a), (9, "else"), (9, "else")]
    df = documents(spark, rows).selectExpr("doc_id", "text", "'u' as __id", "'v' as id", "'w' as key", "'x' as whole", "'y' as component")
    have = keep(df)
    assert have.columns == df.columns
    assert sorted((r.doc_id, r.text, r.id, r.key, r.whole) for r in have.collect()) == sorted((i, t, "v", "w", "x") for i, t in [(2, b), (5, a), (9, "else")])


def test_odd_rows(spark):
    df = odd(spark)
    found = simhash.assign(df).collect()
    assert len(found) == df.count() and all(len(r.fingerprint) == 16 for r in found)
    assert simhash.keep_one(df).columns == df.columns


def test_empty_table(spark):
    assert simhash.assign(empty(spark)).count() == 0


def test_components_of_long_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 4000), (4000, 5000), (7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert got == {r.node: r.component for r in connected_components(df, hub_edges=0).collect()}
    assert got == {**dict.fromkeys(range(201), 0), **dict.fromkeys(range(1000, 1300), 1000), 4000: 4000, 5000: 4000}
