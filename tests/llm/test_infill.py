import hashlib
import random
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from placemill.llm import infill
from tests.llm.helpers import ODD_TEXTS, documents, empty, odd

UNITS = infill.regex.compile(infill.LINES)


def slow(doc_id, text):
    """By lists of lines."""
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{doc_id}".encode()).hexdigest()
    h = [int(h[k : k + 8], 16) for k in (0, 8, 16, 24)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return len(lines), "plain", None, None, text
    low, high = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
    p, m, s = "".join(lines[:low]), "".join(lines[low:high]), "".join(lines[high:])
    return (len(lines), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 50 else (len(lines), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@given(st.integers(0, 10**12), st.text(st.sampled_from("a<PSM>\né😀 \r"), max_size=60))
def test_cut_and_restore(doc_id, text):
    made = infill.cut(doc_id, text, UNITS, infill.Rule())
    assert made == slow(doc_id, text)
    assert infill.restore(made[4], made[1]) == text


def test_marks_across_a_cut():
    """Pieces of marks at the cuts don't make marks."""
    for doc_id in range(300):
        text = "<P\n<S\n<M\n>P>\n<"
        made = infill.cut(doc_id, text, UNITS, infill.Rule())
        assert infill.restore(made[4], made[1]) == text


def test_against_brute_force(spark):
    rnd = random.Random(5)
    rows = [(i, "".join(rnd.choice(["ab ", "\n", "\n\n", "é", "😀", "line\n", "<P>" if i % 9 == 0 else "<P"]) for _ in range(rnd.randint(0, 40)))) for i in range(200)]
    got = {r.doc_id: r for r in infill.digests(documents(spark, rows)).collect()}
    for i, t in rows:
        n, form, prefix, middle, output = slow(i, t)
        r = got[i]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, prefix, middle)
        assert r.output_sha256 == hashlib.sha256(output.encode()).hexdigest() and r.restored_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert {r.form for r in got.values()} == {"plain", "psm", "spm"}


def test_odd_and_empty(spark):
    docs = odd(spark)
    made = infill.transform(docs)
    assert made.columns == docs.columns and made.count() == docs.count()
    for r in made.filter("doc_id < 100").collect():
        text = ODD_TEXTS[r.doc_id] or ""
        assert infill.restore(r.text, slow(r.doc_id, text)[1]) == text
    assert infill.transform(empty(spark)).count() == 0 and infill.digests(empty(spark)).count() == 0
    assert infill.digests(docs).filter("doc_id is null").count() == 1
    twice = infill.digests(docs).filter("doc_id = 3").drop("doc_id").distinct()
    assert twice.count() == 1


def test_rates_and_units(spark):
    docs = documents(spark, [(i, "one two three four") for i in range(400)])
    none = infill.transform(docs, infill.Rule(rate=0))
    assert none.select("text").distinct().count() == 1
    words = docs.select("doc_id", infill.infilled(F.col("doc_id"), F.col("text"), infill.Rule(pattern=r"\S+\s*|\s+", rate=60, spm_rate=0)).alias("m")).select("m.*").collect()
    assert {r.n for r in words} == {4} and {r.form for r in words} == {"plain", "psm"}
    assert 0.5 < sum(r.form == "psm" for r in words) / 400 < 0.7


def test_very_long_text(spark):
    text = "x\n" * 1_000_000
    r = infill.digests(documents(spark, [(1, text)])).first()
    assert r.n == 1_000_000 and r.restored_sha256 == hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("form", ["psm", "spm"])
def test_both_cuts_on_one_end(form):
    made = next(m for i in range(5000) if (m := infill.cut(i, "a\nb\n", UNITS, infill.Rule()))[1] == form and m[3] == 0)
    assert infill.restore(made[4], form) == "a\nb\n"
