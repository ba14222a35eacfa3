import collections
import math
import random
import re
import zlib

import numpy as np
import pytest

from placemill.llm import interpolation as lm
from tests.llm.helpers import documents, empty, odd


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), "\n"]


def fold(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 10


def brute(rows):
    words, pairs, part, part_pairs = (collections.Counter() for _ in range(4))
    for i, t in rows:
        w = tokens(t)
        two = list(zip(["\n", *w[:-1]], w, strict=True))
        if fold(i) != 0:
            words.update(w)
            pairs.update(two)
            if fold(i) != 9:
                part.update(w)
                part_pairs.update(two)
    n, v = sum(words.values()), len(words)
    one = lambda f, c: int(f(np.array([c]))[0])
    hist = collections.Counter()
    for i, t in rows:
        if fold(i) == 9:
            w = tokens(t)
            for a, b in zip(["\n", *w[:-1]], w, strict=True):
                hist[one(lm._bin, part_pairs[a, b]) << 40 | one(lm._bin, part[a]) << 20 | one(lm._bin, part[b])] += 1
    weights = lm.learn(np.array(list(hist), np.int64), np.array(list(hist.values()), float), float(sum(part.values())), float(len(part)))
    out = []
    for i, t in rows:
        w = tokens(t)
        base = sum(math.log10((words[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        score = 0.0
        for a, b in zip(["\n", *w[:-1]], w, strict=True):
            k = weights[one(lm.context_bucket, words[a])]
            score += math.log10(k[0] * pairs[a, b] / max(words[a], 1) + k[1] * words[b] / max(n, 1) + k[2] / (v + 1))
        out.append((i, fold(i) == 0, len(w), sum(words[x] > 0 for x in w), n, base, score))
    return out


def check(spark, df, rows, **options):
    key = lambda r: (r[0] is None, r[0] or 0, r[5])
    got = sorted((tuple(r) for r in lm.score(df, **options).collect()), key=key)
    want = sorted(brute(rows), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], abs=1e-6) and a[6] == pytest.approx(b[6], abs=1e-6)


@pytest.mark.parametrize("batch_tokens", [50, 2_000_000])
def test_brute_force(spark, batch_tokens):
    rnd = random.Random(3)
    vocabulary = [f"w{int(rnd.paretovariate(0.7))}" for _ in range(300)]
    rows = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, 40)))) for i in range(150)]
    check(spark, documents(spark, rows), rows, batch_tokens=batch_tokens)


def test_odd_rows(spark):
    df = odd(spark)
    check(spark, df, [(r.doc_id, r.text) for r in df.collect()])


def test_no_training_rows(spark):
    rows = [(i, "a b a") for i in range(200) if fold(i) == 0][:3]
    assert rows
    check(spark, documents(spark, rows), rows)


def test_only_deleted_fold(spark):
    rows = [(i, "a b a") for i in range(200) if fold(i) == 9][:3]
    check(spark, documents(spark, rows), rows)


def test_probabilities_sum_to_one(spark):
    rows = [(i, "a b c a b a") for i in range(100)]
    words = collections.Counter(x for i, t in rows if fold(i) for x in tokens(t))
    weights = np.array([0.5, 0.3, 0.2])
    pairs = collections.Counter((a, b) for i, t in rows if fold(i) for a, b in zip(["\n", *tokens(t)[:-1]], tokens(t), strict=True))
    n = sum(words.values())
    total = sum(weights @ [pairs["a", x] / words["a"], words[x] / n, 1 / (len(words) + 1)] for x in words) + weights[2] / (len(words) + 1)
    assert total == pytest.approx(1)


def test_em_finds_the_mixture():
    rng = np.random.default_rng(0)
    key, n = [], []
    for c12, c1, c2 in [(5, 10, 100), (0, 10, 100), (0, 10, 0)]:
        key.append(c12 << 40 | c1 << 20 | int(lm._bin(np.array([c2]))[0]))
    n = np.array([700.0, 250.0, 50.0])
    w = lm.learn(np.array(key), n, 1000.0, 50.0)[int(lm.context_bucket(np.array([10]))[0])]
    assert w.sum() == pytest.approx(1) and w[0] > w[1] > 0 and w[2] > 0



def test_packing():
    rng = np.random.default_rng(0)
    for v in (np.empty(0, np.int64), rng.integers(-5, 2**40, 1000)):
        assert (lm.unpack(lm.pack(v)) == v).all()


def test_empty_table(spark):
    assert lm.score(empty(spark)).count() == 0
