import random
import zlib

import numpy as np
import pytest

from placemill.llm import toxicity
from tests.llm.helpers import documents, empty, odd


def label_table(spark, labels):
    return spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def corpus(n=900, seed=4):
    rnd = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = [f"w{rnd.randint(0, 3000)}" for _ in range(rnd.randint(5, 120))]
        toxic = rnd.random() < 0.2
        if toxic:
            for _ in range(rnd.randint(1, 3)):
                words[rnd.randrange(len(words))] = rnd.choice(["idiot", "scum,", "MORON!"])
        rows.append((i, " ".join(words), "src", "en"))
        labels.append((i, 1, int(any(x.strip(",!").lower() in ("idiot", "scum", "moron") for x in words))))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    found = {r.doc_id: r for r in toxicity.score(documents(spark, rows), label_table(spark, labels)).collect()}
    assert all(found[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in found)
    held = [(i, t) for i, _, t in labels if found[i].held_out]
    assert np.mean([found[i].predicted == t for i, t in held]) > 0.97


def test_pairs_beyond_sums():
    """Two slots that are harmless alone: only their product tells."""
    rng = np.random.default_rng(0)
    rows, y = [], []
    for _ in range(4000):
        x = [k for k in (0, 1) if rng.random() < 0.5] + [2 + int(rng.integers(0, 20))]
        rows.append(np.array(sorted(x)))
        y.append(float(0 in x and 1 in x))
    y = np.array(y)
    slots = np.arange(22)
    df = np.array([sum(k in r for r in rows) for k in slots])
    pos = np.array([sum(t for r, t in zip(rows, y, strict=True) if k in r) for k in slots])
    m = toxicity.fit(rows, y, slots, df, pos, epochs=40)
    p = np.array([m.logit(r.tolist()) > 0 for r in rows])
    assert (p == (y == 1)).mean() > 0.99
    assert m.v[0] @ m.v[1] > 0.5


def test_logit_is_the_pairwise_sum():
    rng = np.random.default_rng(1)
    m = toxicity.Machine(np.arange(6), 0.3, rng.normal(size=6), rng.normal(size=(6, 8)))
    some = [0, 2, 5]
    want = 0.3 + sum(m.w[i] for i in some) + sum(m.v[i] @ m.v[j] for i in some for j in some if i < j)
    assert m.logit(some) == pytest.approx(want)


@pytest.mark.parametrize("labels", [[], [(0, 1, 1)], [(3, None, None), (None, 1, 0)]])
def test_odd_rows_and_few_labels(spark, labels):
    df = odd(spark)
    found = toxicity.score(df, label_table(spark, labels)).collect()
    assert len(found) == df.count() and all(0 <= r.score <= 1 for r in found)


def test_labels_and_source_are_no_inputs(spark):
    rows, labels = corpus(300)
    a = {r.doc_id: r.score for r in toxicity.score(documents(spark, rows), label_table(spark, labels)).collect()}
    other = [(i, t, f"other{i}", "de") for i, t, *_ in rows]
    held = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, q, t in labels]
    b = {r.doc_id: r.score for r in toxicity.score(documents(spark, other), label_table(spark, held)).collect()}
    assert a == b


def test_empty_table(spark):
    assert toxicity.score(empty(spark), label_table(spark, [(1, 1, 0)])).count() == 0
