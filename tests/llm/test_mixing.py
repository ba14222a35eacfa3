import random

import numpy as np
import pytest

from placemill.llm import mixing
from tests.llm.helpers import documents, empty, odd


def fill(sizes, weights=(1, 2, 3), most=3):
    """Targets by resharing until none is above its cap. ``sizes``: source -> words."""
    names = sorted((k for k in sizes if k is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {k: weights[i % len(weights)] for i, k in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[k] for k in capped)
        free = [k for k in names if k not in capped]
        share = {k: rest * w[k] / sum(w[x] for x in free) for k in free}
        above = {k for k in free if share[k] > most * sizes[k]}
        if not above:
            return share | {k: most * sizes[k] for k in capped}
        capped |= above


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    rnd = random.Random(seed)
    rows = [(i, "w " * rnd.choice([0, 1, 5, 50]), rnd.choice(["a", "B", "é", "𝒜", "￿", None]) if rnd.random() < 0.5 else "hot") for i in range(300)]
    found = mixing.mix(documents(spark, rows)).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = fill(sizes)
    assert len(found) == len(rows)
    taken = {}
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, t in taken.items():
        assert abs(t - want[s]) <= 50  # the largest document


def test_rounding_keeps_words_and_odds():
    rng = np.random.default_rng(1)
    size = np.sort(rng.integers(1, 1000, 200).astype(float))[::-1]
    p = rng.random(200)
    total = np.zeros(200)
    for _ in range(2000):
        out, left = mixing.pivot(p, size, rng.random(200))
        assert abs((out * size).sum() - (p * size).sum()) < 1e-3
        assert all(v in (0, 1) for k, v in enumerate(out) if k != left)
        total += out
    assert np.abs(total / 2000 - p).max() < 0.06


def test_tree_and_reruns(spark):
    df = documents(spark, [(i, "w " * (1 + i % 7), "a" if i % 3 else "b") for i in range(500)])
    one = {r.doc_id: r.copies for r in mixing.mix(df, fan_in=8).collect()}
    two = {r.doc_id: r.copies for r in mixing.mix(df.repartition(7), fan_in=8).collect()}
    assert one == two and len(one) == 500
    flat = mixing.mix(df, fan_in=8)
    for r in flat.groupBy("source", "target").sum("taken").collect():
        assert abs(r["sum(taken)"] - r.target) <= 7


def test_odd_rows(spark):
    df = odd(spark)
    found = mixing.mix(df).collect()
    assert len(found) == df.count() and all(0 <= r.taken <= 3 * r["size"] for r in found)
    assert {r.source for r in found} == {"s", None}
    copies = mixing.mixed(df)
    assert copies.columns == df.columns


def test_mixed_repeats_rows(spark):
    df = documents(spark, [(1, "a b c", "x"), (2, "d e f " * 30, "y"), (3, "g", "z")])
    plan = {r.doc_id: r.copies for r in mixing.mix(df).collect()}
    have = [r.doc_id for r in mixing.mixed(df).collect()]
    assert {i: have.count(i) for i in plan} == plan


@pytest.mark.parametrize("most", [0, 1000])
def test_mixed_by_shuffle_and_by_broadcast(spark, most):
    df = documents(spark, [(i, "w " * (i % 7), f"s{i % 3}") for i in range(300)] + [(None, "a b"), (5, "other words here")])
    df = df.selectExpr("doc_id", "text", "source", "'u' as __copies", "'v' as id", "'w' as copies", "'x' as whole")
    plan = {}
    for r in mixing.mix(df).collect():
        plan[r.doc_id] = max(plan.get(r.doc_id, 0), r.copies)
    have = mixing.mixed(df, most=most)
    assert have.columns == df.columns
    assert sorted((tuple(r) for r in have.collect()), key=repr) == sorted((tuple(r) for r in df.collect() for _ in range(plan[r.doc_id])), key=repr)


def test_empty_and_wordless(spark):
    assert mixing.mix(empty(spark)).count() == 0
    assert mixing.mixed(empty(spark)).count() == 0
    assert [r.taken for r in mixing.mix(documents(spark, [(1, None), (2, " \n")])).collect()] == [0, 0]
