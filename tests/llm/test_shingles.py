import random
import re

import pytest

import corpus_pipeline
from placemill.llm import shingles
from placemill.llm.common import written
from tests.llm.helpers import documents, empty, odd


def slow_set(text, words=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def slow_kept(rows, least=0.8):
    label = {i: i for i, _ in rows}
    sets = [(i, slow_set(t)) for i, t in rows]
    links = [(a, b) for a, x in sets for b, y in sets if a < b and (not x and not y or len(x & y) >= least * len(x | y))]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return {i for i, x in label.items() if i == x}


def word(rnd):
    return "".join(rnd.choice("abcdefghijklmnop") for _ in range(6))


def changed(rnd, text, n):
    w = text.split()
    for at in rnd.sample(range(len(w)), n):
        w[at] = word(rnd)
    return " ".join(w)


def test_stage_drops_copies_of_similarity_080_to_090(spark):
    rnd = random.Random(1)
    rows = []
    for g in range(12):  # one changed word of 60 to 90 takes five shingles: similarity 0.83 to 0.9
        base = " ".join(word(rnd) for _ in range(60 + 2 * g))
        middle = base.split()
        middle[30] = word(rnd)
        rows += [(2 * g, base), (2 * g + 1, " ".join(middle))]
    assert slow_kept(rows) == set(range(0, 24, 2))
    got = corpus_pipeline.near_stage(spark, documents(spark, rows), "")
    assert {r.doc_id for r in got.collect()} == slow_kept(rows)


@pytest.mark.parametrize("cell_pairs", [32, 3])
def test_against_brute_force(spark, cell_pairs):
    rnd = random.Random(2)
    rows = []
    for _ in range(4):
        base = " ".join(word(rnd) for _ in range(150))
        rows += [base, *(changed(rnd, base, rnd.randint(1, 5)) for _ in range(20))]
        for _ in range(8):  # a chain, each like the one before
            base = changed(rnd, base, 2)
            rows.append(base)
    rnd.shuffle(rows)
    rows = list(enumerate([*rows, "", None, "one two", "One  TWO"]))
    got = shingles.keep_one(documents(spark, rows), cell_pairs=cell_pairs)
    assert {r.doc_id for r in got.collect()} == slow_kept(rows)


def test_changed_copies_that_do_not_link_never_meet(spark, monkeypatch):
    rnd = random.Random(3)
    base = " ".join(word(rnd) for _ in range(120))
    rows = list(enumerate([changed(rnd, base, 8) for _ in range(60)]))  # each some 0.5 like the others
    assert slow_kept(rows) == {i for i, _ in rows}
    met, known = [], shingles._known
    monkeypatch.setattr(shingles, "_known", lambda *a: met.append(known(*a).count()) or known(*a))
    assert shingles.keep_one(documents(spark, rows), cell_pairs=3).count() == 60
    assert met and not any(met)


def test_prefixes_lose_no_link(spark):
    """All pairs of sets of like size, with and without common passages: what reaches the threshold meets by its first shingles."""
    rnd = random.Random(4)
    common = [" ".join(word(rnd) for _ in range(n)) for n in (20, 60, 61)]
    rows = []
    for _ in range(60):
        at = rnd.sample(common, rnd.randint(1, 3))
        rows.append(changed(rnd, " ".join(at), rnd.randint(0, 3)))
    rows = list({" ".join(t.split()): None for t in rows})
    sets = [shingles.shingle_set(t.encode(), 5) for t in rows]
    hs = [shingles.digest(s) for s in sets]
    wanted = {frozenset((hs[i], hs[j])) for i in range(len(rows)) for j in range(i) if shingles.similarity(sets[i], sets[j]) >= 0.8}
    members = spark.createDataFrame([(h, i, len(s), h) for i, (h, s) in enumerate(zip(hs, sets, strict=True))], "h long, id long, n long, label long")
    texts = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {frozenset((r.a, r.b)) for r in shingles._known(shingles.prefixes(members, texts, 5, 0.8), 0.8).collect()}
    assert len(wanted) > 20 and wanted <= got
    links = {frozenset((r.a, r.b)) for r in shingles.verified(shingles._known(shingles.prefixes(members, texts, 5, 0.8), 0.8), texts, 5, 0.8).collect()}
    assert links == wanted


def test_sets_that_can_reach_no_other_are_not_joined(spark, monkeypatch):
    """A member with too many shingles of its own has no row in the join of shingles, nor has a shingle of one component alone."""
    rnd = random.Random(8)
    base = " ".join(word(rnd) for _ in range(120))
    rows = [changed(rnd, base, 1) for _ in range(6)] + [changed(rnd, base, 9) for _ in range(30)]
    sets = [shingles.shingle_set(t.encode(), 5) for t in rows]
    hs = [shingles.digest(s) for s in sets]
    members = spark.createDataFrame([(h, i, len(s), hs[0] if i < 6 else h) for i, (h, s) in enumerate(zip(hs, sets, strict=True))], "h long, id long, n long, label long")
    seen, write = {}, shingles.written
    monkeypatch.setattr(shingles, "written", lambda df, tag: seen.setdefault(tag, write(df, tag)))
    found = shingles.prefixes(members, spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), 5, 0.8)
    assert {r.h for r in seen["able"].collect()} == set(hs[:6]) and seen["known"].isEmpty() and found.isEmpty()


def test_few_keys_go_to_the_documents(spark, monkeypatch):
    """Only cells of several documents and their members meet the rest, so neither all cells nor all texts are shuffled for them; longer lists give the same rows."""
    rnd = random.Random(6)
    base = [" ".join(word(rnd) for _ in range(60)) for _ in range(20)]
    docs = documents(spark, list(enumerate([*base, *(changed(rnd, t, 1) for t in base[:5])])))
    signed = written(shingles.signatures(docs, 5), "signed")
    plans, write = {}, shingles.written

    def seen(df, tag):
        plans[tag] = df._jdf.queryExecution().optimizedPlan().toString()
        return write(df, tag)

    monkeypatch.setattr(shingles, "written", seen)
    found = {}
    for most in (1 << 20, 1):
        found[most] = sorted(map(tuple, shingles.components(signed, docs, 5, 0.8, most=most).collect()))
        assert all(("strategy=broadcast" in plans[tag]) == (most > 1) for tag in ("cells", "texts"))
    assert found[1] == found[1 << 20] and len({c for _, c in found[1]}) == 20


def test_repeated_ids_and_null_ids(spark):
    """Rows that share a doc_id are told apart by their texts; a row without one stays and names no component."""
    rnd = random.Random(5)
    base = " ".join(word(rnd) for _ in range(100))
    near = changed(rnd, base, 1)
    other = " ".join(word(rnd) for _ in range(100))
    rows = [(1, other), (2, base), (2, other + " more"), (3, near), (None, near), (None, base)]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in shingles.keep_one(documents(spark, rows)).collect())
    assert got == sorted([(False, 1, other), (False, 2, base), (True, 0, near), (True, 0, base)])


def test_odd_and_empty(spark):
    assert shingles.keep_one(odd(spark)).columns == odd(spark).columns
    assert shingles.keep_one(empty(spark)).count() == 0
