import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from placemill.llm import personal, tagger
from tests.llm.helpers import ODD_TEXTS, documents, empty, odd

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def slow_base(text):
    """The plain expressions, matched one after another."""
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), list(PLAIN).index(kind), kind, m.end()))
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


@given(st.text(st.sampled_from("a@.-_%+0123456789 ()é\n"), max_size=80))
def test_base_spans(text):
    assert personal.base_spans(text) == slow_base(text)


def test_base_spans_of_pieces():
    rnd = random.Random(3)
    pieces = ["a@b.co", "@", ".", "1.2.3.4", "300.1.2.3", ".5", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+", "12", " ", "x", "-", "é", "\n", "+49 ", "0001"]
    for _ in range(3000):
        text = "".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 12)))
        assert personal.base_spans(text) == slow_base(text), text


def test_base_spans_are_linear():
    for text in ("a" * 2_000_000, "1" * 2_000_000, "1." * 1_000_000, "+1" * 500_000, "a@" * 500_000, "+1" + "-" * 1_000_000):
        personal.base_spans(text)


def test_gradient():
    rng = np.random.default_rng(0)
    net = tagger.Net.fresh(3, rng)
    for p in net.all():
        p += (rng.standard_normal(p.shape) * 0.1).astype(np.float32)
    seen, truth = rng.integers(0, tagger.N_CLASSES, (6, 4)).astype(np.uint8), rng.integers(0, tagger.TAGS, (6, 4))
    _, grads = tagger.loss(net, seen, truth)
    for p, g in zip(net.all(), grads, strict=True):
        for at in rng.integers(0, p.size, 25):
            k = np.unravel_index(at, p.shape)
            old = p[k]
            p[k] = old + 1e-2
            up, _ = tagger.loss(net, seen, truth)
            p[k] = old - 1e-2
            down, _ = tagger.loss(net, seen, truth)
            p[k] = old
            assert abs((up - down) / 2e-2 - g[k]) < 2e-3


def test_decode_against_all_paths():
    """Best of all tag sequences, for windows of several lengths, those that are not decoded among them."""
    rng = np.random.default_rng(1)
    for _ in range(12):
        net = tagger.Net.fresh(2, rng)
        net.moves[:], net.ends[:] = rng.standard_normal(net.moves.shape), rng.standard_normal(net.ends.shape)
        found = rng.standard_normal((4, tagger.TAGS, 6)).astype(np.float32) * 2
        found[:, 1:, :3] -= rng.choice([0, 30])
        lengths = np.array([4, 3, 2, 4, 3, 1])
        best, _ = tagger.decode(net, found, lengths)
        for w, n in enumerate(lengths):
            value = lambda p: sum(found[t, k, w] for t, k in enumerate(p)) + sum(net.moves[a, b] for a, b in itertools.pairwise(p)) + net.ends[0][p[0]] + net.ends[1][p[-1]]  # noqa: B023, E731
            want = max(itertools.product(range(tagger.TAGS), repeat=int(n)), key=value)
            assert abs(value(tuple(best[:n, w])) - value(want)) < 1e-4


def test_states_stop_at_a_window_end():
    rng = np.random.default_rng(2)
    net, seen = tagger.Net.fresh(4, rng), rng.integers(0, tagger.N_CLASSES, (9, 3)).astype(np.uint8)
    together = tagger.scores(net, seen, np.array([9, 5, 7]))
    for w, n in enumerate((9, 5, 7)):
        assert np.allclose(together[:n, :, w], tagger.scores(net, seen[:n, w : w + 1])[:, :, 0], atol=1e-5)


@pytest.fixture(scope="module")
def finder(spark, small):
    return personal.fitted(spark.read.parquet(f"{small}/documents.parquet"), steps=400)


def prose(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghiklmnoprstuvw") for _ in range(rnd.randint(2, 9))) for _ in range(n))


def test_finds_what_the_patterns_miss(finder):
    rnd, rng = random.Random(4), np.random.default_rng(4)
    texts, where = [], []
    while len(texts) < 200:
        kind = personal.KINDS[len(texts) % 4]
        span = personal.made_span(rng, kind)
        if not personal.base_spans(span):
            head = prose(rnd, rnd.randint(20, 400)) + " "
            texts.append(f"{head}{span} {prose(rnd, 30)}")
            where.append((kind, len(head), len(head) + len(span)))
    hit = sum(any(k == kind and x < b and a < y for k, x, y in more) for (_, more), (kind, a, b) in zip(finder.spans(texts), where, strict=True))
    assert hit >= 160


def test_leaves_clean_texts_alone(finder):
    rnd, rng = random.Random(5), np.random.default_rng(5)
    texts = [f"{prose(rnd, 60)} {personal.look_alike(rng)} {prose(rnd, 60)}" for _ in range(300)]
    assert sum(len(more) for _, more in finder.spans(texts)) <= 6


def test_windows_cover_a_text_once():
    f = personal.Finder(tagger.Net.fresh(2, np.random.default_rng(0)), window=100, margin=10)
    for length in (1, 19, 20, 21, 99, 100, 101, 180, 181, 1000):
        owned = []
        for a, b in f.windows(length):
            owned += range(a if a == 0 else a + 10, b if b == length else b - 10)
        assert owned == list(range(length))
    assert f.windows(0) == []


def test_spans_at_window_edges_are_whole(finder):
    """Wherever a span stands to the windows, it is the span that one window over the whole text gives."""
    rnd = random.Random(6)
    text, span = prose(rnd, 400), "anna.berg (at) stone (dot) com"
    whole = [f"{text[:at]} {span} {text[at:]}" for at in range(600, 900, 5)]
    one = personal.Finder(finder.net, window=1 << 14)
    assert finder.windows(len(whole[0])) != one.windows(len(whole[0]))
    same = [a == b for (_, a), (_, b) in zip(finder.spans(whole), one.spans(whole), strict=True)]
    assert sum(same) >= 0.95 * len(same)
    assert sum(any(a <= t.index(span) + 5 and b >= t.index(span) + len(span) - 3 for _, a, b in more) for t, (_, more) in zip(whole, finder.spans(whole), strict=True)) >= 0.8 * len(whole)


def test_batches_do_not_matter(finder):
    rnd = random.Random(7)
    texts = [prose(rnd, rnd.randint(0, 300)) + " mary [at] web [dot] net" for _ in range(20)]
    assert finder.spans(texts) == [finder.spans([t])[0] for t in texts]


def test_digests(spark, finder):
    rows = [(1, "write a.b@c.de or +1 (555) 123-4567 now"), (2, "from 10.0.0.1 paid 4111 1111 1111 1111"), (3, "nothing"), (4, None), (5, "write a.b@c.de or +1 (555) 123-4567 now")]
    got = {r.doc_id: r for r in personal.digests(documents(spark, rows), finder).collect()}
    for i, t in rows:
        base = slow_base(t or "")
        r = got[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in PLAIN]
        assert r.base_sha256 == hashlib.sha256(personal.joined(base).encode()).hexdigest()
        assert set(personal.joined(base).split(",")) <= set(r.spans.split(","))
    assert got[1].spans == got[5].spans and got[4].spans == ""


def test_redacted_and_find(spark, finder):
    docs = documents(spark, [(1, "mail a.b@c.de, host 10.0.0.1."), (2, None)])
    out = {r.doc_id: r.text for r in personal.redacted(docs, finder).collect()}
    assert out == {1: "mail <EMAIL>, host <IP>.", 2: ""}
    assert personal.redacted(docs, finder).columns == docs.columns
    named = docs.withColumnRenamed("sha", "a b: c").withColumnRenamed("row", "whole")
    assert personal.redacted(named, finder).filter("doc_id = 1").first()["a b: c"] == "x"
    assert {(r.kind, r.piece, r.base) for r in personal.find(docs, finder).collect()} == {("email", "a.b@c.de", True), ("ip", "10.0.0.1", True)}


def test_odd_and_empty(spark, finder):
    docs = odd(spark)
    rows = personal.digests(docs, finder).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r.doc_id is not None and r.doc_id < 100 and r.doc_id != 3:
            assert r.base_sha256 == hashlib.sha256(personal.joined(slow_base(ODD_TEXTS[r.doc_id] or "")).encode()).hexdigest()
    assert personal.digests(empty(spark)).count() == 0 and personal.redacted(empty(spark)).count() == 0


def test_training_is_repeatable(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    pool = personal.snippets(docs)
    assert pool == personal.snippets(docs.repartition(7)) and len(pool) <= 2 * personal.FIT_SNIPPETS
    one, two = (tagger.trained(personal.snippet_batches(pool, made=300), 4, 5, 1) for _ in range(2))
    assert all(np.array_equal(a, b) for a, b in zip(one.all(), two.all(), strict=True))


def test_net_runs_where_spans_may_be(finder, monkeypatch):
    """The windows left out change no span, whatever the net is, and prose is mostly left out."""
    rnd, rng = random.Random(8), np.random.default_rng(8)
    texts = ["", "at", ".at", "12.at", "1" * 3000, ":" * 900, "@." * 900, "é" * 900 + "at." + "é" * 900]
    for k in range(120):
        pieces = [rnd.choice((prose(rnd, rnd.randint(1, 120)), personal.look_alike(rng), personal.made_span(rng, personal.KINDS[k % 4]), "stat. ion", "attic.", "dot", "AT", "«at» dot")) for _ in range(rnd.randint(1, 12))]
        texts.append(rnd.choice((" ", " ", ". ", "")).join(pieces))
    greedy = tagger.Net(*(p.copy() for p in finder.net.all()))
    greedy.bias[1:] += 6  # tags long runs that cross windows
    for net in (finder.net, greedy):
        some, every = (personal.Finder(net, window=100, margin=10, lead=0.0, everywhere=e).spans(texts) for e in (False, True))
        assert some == every and any(more for _, more in some)
    lanes = []
    monkeypatch.setattr(personal, "scores", lambda net, seen, lengths: lanes.append(len(lengths)) or tagger.scores(net, seen, lengths))
    plain = [prose(rnd, 2000) for _ in range(4)]
    assert all(base == [] for base, _ in finder.spans(plain)) and sum(lanes) < sum(len(finder.windows(len(t))) for t in plain) / 2


@given(st.text(st.sampled_from("atdoATDO.@:019 _-é"), max_size=120), st.integers(0, 120), st.integers(7, 80))
def test_may_hold(text, at, length):
    piece = text[at : at + length]
    if any(personal.holds(kind, piece) for kind in personal.KINDS):
        starts, ends = personal.may_hold(tagger.classes(text))
        assert sum(starts < at + len(piece)) > sum(ends <= at) and sum(starts <= at) > sum(ends < at + len(piece))
