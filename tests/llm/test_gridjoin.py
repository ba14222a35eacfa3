import random

import numpy as np
import pytest

import corpus_pipeline
from placemill.llm import gridjoin, shingles
from tests.llm.helpers import documents


def bits_of(words):
    return np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=-1).astype(int)


def test_fingerprint_is_a_majority():
    found = np.random.default_rng(0).integers(0, 1 << 63, 301, dtype=np.uint64)
    each = bits_of(np.array([gridjoin.fingerprint(found[k : k + 1]) for k in range(len(found))]))
    assert np.array_equal(bits_of(gridjoin.fingerprint(found)), 2 * each.sum(axis=0) > len(found))


@pytest.mark.parametrize(("cell_pairs", "run"), [(10_000, 10_000), (4, 10_000), (4, 8)])
def test_met_against_brute_force(cell_pairs, run, monkeypatch):
    """Every two rows that share a fine cell and most bits are a pair, or in one crowd."""
    monkeypatch.setattr(gridjoin, "RUN", run)
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, (12, 2), dtype=np.uint64)
    words = np.repeat(base, 20, axis=0)
    for w in words:
        for k in rng.integers(0, 128, rng.integers(0, 12)):
            w[k // 64] ^= np.uint64(1) << np.uint64(k % 64)
    cell = np.sort(rng.integers(0, 2, len(words)))
    x, y = words.T.copy()
    a, b, crowds = gridjoin.met(cell, x, y, cell_pairs)
    bits, of = bits_of(words), {r: k for k, c in enumerate(crowds) for r in c}
    keys = [np.array([gridjoin.counts(x) & mx, gridjoin.counts(y) & my]) for mx, my in gridjoin.MASKS]
    got = {(int(i), int(j)) for i, j in zip(a, b, strict=True)}
    wanted = {(i, j) for j in range(len(words)) for i in range(j) if cell[i] == cell[j] and (bits[i] != bits[j]).sum() <= gridjoin.MOST_BITS and any((k[:, i] == k[:, j]).all() for k in keys)}
    assert wanted and all(p in got or p[0] in of and of[p[0]] == of.get(p[1]) for p in wanted) and got <= wanted
    assert bool(crowds) == (cell_pairs == 4)


def test_sets_of_similarity_080_meet(spark):
    rng, rows, pairs = np.random.default_rng(2), [], []
    for k in range(300):
        n = int(rng.integers(50, 400))
        s = rng.integers(0, 1 << 63, n + 2 * (n // 8), dtype=np.uint64)
        one, two = s[: n + n // 8], np.concatenate((s[:n], s[n + n // 8 :]))
        assert 0.8 <= shingles.similarity(one, two) < 0.83
        rows += [(i, gridjoin.fingerprint(v).view(np.int64).tolist()) for i, v in ((2 * k, one), (2 * k + 1, two))]
        pairs.append((2 * k, 2 * k + 1))
    found = {}
    for r in gridjoin.cells(spark.createDataFrame(rows, "h long, bits array<long>"), 32).collect():
        found.setdefault(r.cell, set()).add(r.h)
    assert set(pairs) <= {tuple(sorted(c)) for c in found.values()}
    assert len(found) < 2 * len(pairs)  # few others do


def test_near_stage_links_what_the_grids_meet(spark, monkeypatch):
    """No other path finds candidates: without the grids' cells nothing links."""
    rnd = random.Random(3)
    base = [["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(80)] for _ in range(5)]
    rows = list(enumerate(" ".join(w) for b in base for w in (b, [*b[:40], "x", *b[41:]])))
    assert corpus_pipeline.near_stage(spark, documents(spark, rows), "").count() == 5
    cells = gridjoin.cells
    monkeypatch.setattr(gridjoin, "cells", lambda *a: cells(*a).filter("false"))
    assert corpus_pipeline.near_stage(spark, documents(spark, rows), "").count() == 10


def test_rows_of_a_loose_group_grow_with_its_size(spark):
    """Members of which each table brings only some together are a crowd of a row a table; a class of them has one name, and pairs are few."""
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    rows = []
    for k in range(900):  # similarity 0.5 to each other
        kept = rng.permutation(base)[:164]
        rows.append((k, gridjoin.fingerprint(np.concatenate((kept, rng.integers(0, 1 << 63, 36, dtype=np.uint64)))).view(np.int64).tolist()))
    pairs, crowd = {}, {}
    for n in (300, 900):
        found = gridjoin.cells(spark.createDataFrame(rows[:n], "h long, bits array<long>"), 32)
        pairs[n] = found.filter("members = 2 and h < p").select("h", "p").distinct().count()
        crowds = found.filter("members > 2")
        assert crowds.count() <= gridjoin.TABLES * n
        named = shingles._one_crowd(crowds)
        crowd[n] = named.count(), named.select("cell").distinct().count()
        assert crowd[n][0] == crowds.select("h").distinct().count()
    assert pairs[900] <= 3 * pairs[300]
    assert crowd[900][0] > 850 and crowd[900][1] == 1
