import hashlib
import random

import pytest

from placemill.llm import sentencepieces
from placemill.llm.queries import tokenizer_path
from tests.llm.helpers import ODD_TEXTS, documents, empty, odd

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def model():
    return sentencepieces.Agenda(tokenizer_path())


def texts():
    rnd = random.Random(7)
    made = ["".join(rnd.choice(" ▁ab<>s/0x41\n\té日�⁇.,'\"") for _ in range(rnd.randint(0, 14))) for _ in range(3000)]
    return [t for t in ODD_TEXTS if t is not None] + made + [" ", "  a  b ", "<s>", "</s>a", "<unk>", "<0x41>", "　x", "𝒜", "don't stop.Now", "f(x)=y;\r\n", "x² + 1²."]


def test_as_the_library(model):
    for t in texts():
        want = model.library.encode(t)
        assert model.encode(t) == want, t
        assert model.decode(want) == model.library.decode(want), t


def test_digests_as_the_library(model):
    some = texts()
    for n, ids, decoded, t in zip(*model.digests(some), some, strict=True):
        want = model.library.encode(t)
        assert n == len(want)
        assert ids == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert decoded == hashlib.sha256(model.library.decode(want).encode()).hexdigest()


def test_forgetting_changes_nothing(model, monkeypatch):
    some = texts()[:500]
    want = model.digests(some)
    monkeypatch.setattr(sentencepieces, "REMEMBERED", 10)
    assert [model.digests([t]) for t in some] == [([a], [b], [c]) for a, b, c in zip(*want, strict=True)]


def test_without_cuts_the_same(model):
    whole = sentencepieces.Agenda(tokenizer_path())
    whole.cut = None
    for t in texts()[14:400]:
        assert whole.encode(t) == model.encode(t)


def test_query_rows(spark, model):
    df = odd(spark)
    found = sentencepieces.digests(df, tokenizer_path()).collect()
    assert len(found) == df.count()
    by_id = {r.doc_id: r for r in found}
    assert by_id[0].n_tokens == by_id[1].n_tokens == 0 and by_id[0].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    shards = {r.doc_id: r for r in sentencepieces.encode_column(documents(spark, [(1, "Hello world"), (2, None)]), tokenizer_path()).collect()}
    assert shards[1].ids == model.library.encode("Hello world") and shards[1].decoded == "Hello world" and shards[2].ids == []


def test_empty_table(spark):
    assert sentencepieces.digests(empty(spark), tokenizer_path()).count() == 0
