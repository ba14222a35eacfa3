import hashlib
import random
import zlib

import pytest

from placemill.llm import merkle
from tests.llm.helpers import documents, empty, odd


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(r, text):
    out = ""
    for v in (r.doc_id, r.source, r.lang, r.n_chars, text):
        out += "-" if v is None else f"{len(str(v).encode())}:{v}"
    return h(out)


def tree(nodes, fan):
    """Root and the siblings of each node, level by level over the whole list."""
    where, paths = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for k, at in enumerate(where):
            first = at // fan * fan
            paths[k].append((nodes[first:at], nodes[at + 1 : first + fan]))
        where = [at // fan for at in where]
        nodes = [h("".join(nodes[i : i + fan])) for i in range(0, len(nodes), fan)]
    return nodes[0], paths


def slow(rows, fan=8, every=3):
    """Rows of the manifest, by whole lists."""
    groups = {}
    for r in rows:
        groups.setdefault(r.lang, []).append((r.doc_id is not None, r.doc_id or 0, leaf_of(r, r.text), r))
    small = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: (sorted(groups[g], key=lambda x: x[:3]), *tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])], fan)) for g in langs}
    root, over = tree([trees[g][1] for g in langs], fan)
    out = []
    for g, up in zip(langs, over, strict=True):
        found, subroot, paths = trees[g]
        for (_, _, leaf, r), path in zip(found, paths, strict=True):
            node = leaf
            if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % every == 0 and r.text is not None:
                node = leaf_of(r, r.text.translate(small))
            for before, after in [*path, *up]:
                node = h("".join(before) + node + "".join(after))
            proof = h("".join("".join(before) + "".join(after) for before, after in [*path, *up]))
            out.append((r.doc_id, leaf, subroot, root, proof, node, node == root))
    return sorted(out, key=repr)


def got(docs, **how):
    return sorted((tuple(r) for r in merkle.manifest(docs, **how).collect()), key=repr)


@pytest.mark.parametrize("fan, height", [(8, 4), (2, 1), (3, 2)])
def test_against_whole_lists(spark, fan, height):
    """With small blocks the tree takes several passes, groups of one leaf and of full runs among them."""
    rnd = random.Random(fan)
    rows = []
    for lang, n in ((None, 5), ("de", 1), ("en", 70), ("é", 64), ("fr", 9), ("", 2)):
        rows += [(rnd.randrange(10**6), rnd.choice(["Abc", "abc", None, "", "ÀB c"]), rnd.choice(["s", None]), lang) for _ in range(n)]
    docs = documents(spark, rows)
    assert got(docs, fan=fan, height=height) == slow(docs.collect(), fan)


def test_a_run_of_one_is_hashed(spark):
    docs = documents(spark, [(i, f"t{i}") for i in range(9)])
    r = next(x for x in merkle.manifest(docs).collect() if x.doc_id == 8)
    first = h("".join(leaf_of(d, d.text) for d in sorted(docs.collect(), key=lambda d: d.doc_id)[:8]))
    assert r.root == h(first + h(r.leaf)) and r.proof_sha256 == h(first)


def test_lone_leaf(spark):
    r = merkle.manifest(documents(spark, [(1, "Text")])).first()
    assert r.leaf == r.subroot == r.root and r.proof_sha256 == h("")


def test_odd_and_empty(spark):
    docs = odd(spark)
    assert got(docs) == slow(docs.collect())
    assert got(docs.union(docs), fan=2, height=2) == slow(docs.union(docs).collect(), fan=2)
    assert merkle.manifest(empty(spark)).count() == 0


def test_tampering_shows(spark):
    docs = documents(spark, [(i, "Some Text") for i in range(60)])
    rows = merkle.manifest(docs).collect()
    assert {r.doc_id for r in rows if not r.verified} == {i for i in range(60) if zlib.crc32(str(i).encode()) % 3 == 0}
    same = merkle.manifest(documents(spark, [(i, "some text") for i in range(60)])).collect()
    assert all(r.verified for r in same)


def test_numbers_are_dense(spark):
    docs = documents(spark, [(i % 7, f"t{i}", "s", "en" if i % 4 else "de") for i in range(500)])
    rows = merkle.numbered(merkle.leaves(docs), "leaves").collect()
    for g in ("en", "de"):
        mine = sorted((r.pos, r["at"], r.digest) for r in rows if r.grp == g)
        assert [m[0] for m in mine] == list(range(len(mine))) and {r.total for r in rows if r.grp == g} == {len(mine)}
        assert [m[1:] for m in mine] == sorted(m[1:] for m in mine)
