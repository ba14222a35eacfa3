"""The registered queries: names, SQL, and the pipeline against its stages' brute-force versions."""

import importlib
import math
import random
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from placemill.llm import mixing, queries
from placemill.llm.common import written
from tests.llm.helpers import documents
from tests.llm.test_shingles import slow_kept

pipeline = importlib.import_module("corpus_pipeline")


def test_names():
    import __spark_entry__

    q = __spark_entry__.queries()
    assert {n.split("_")[0] for n in q if n.startswith("op") and n[2].isdigit()} == {f"op{k}" for k in range(1, 14)} and "pipeline" in q
    assert [n for n, _ in pipeline.STAGES] == ["quality", "exact_dedup", "simhash", "mixing", "sentencepiece"]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    columns = sorted(c[0] for c in want.description)
    names = [c[0] for c in want.description]
    df = queries.queries()[name](spark, small)
    plain = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    assert sorted(df.columns) == columns
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("name", ["op1_sentencepiece", "op2_simhash", "op3_media", "op4_quality", "op6_interpolation", "op7_exact_dedup", "op8_toxicity", "op10_mixing", "op11_personal", "op12_merkle", "op13_infill"])
def test_one_row_a_document(spark, small, name):
    found = queries.queries()[name](spark, small).select("doc_id").collect()
    want = spark.read.parquet(f"{small}/documents.parquet").select("doc_id").collect()
    assert sorted(r.doc_id for r in found) == sorted(r.doc_id for r in want)


def test_pipeline(spark, tmp_path):
    """Stage by stage, each on what its predecessor kept."""
    rnd = random.Random(9)
    clean = [" ".join(f"{rnd.choice('abcdef')}{rnd.randint(0, 400)}" for _ in range(rnd.randint(30, 90))) for _ in range(120)]
    bad = [t.upper().replace(" ", "!! ") for t in clean[:40]]
    clean[100] = clean[7].rpartition(" ")[0] + " zz"  # a near copy
    copies = [clean[3], clean[3].replace(" ", "\n"), clean[5]]
    rows = [(i, t, f"s{i % 4}") for i, t in enumerate([*clean, *bad, *copies])]
    docs = documents(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    labels = [(i, int(i < 120), 0) for i in range(160)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    at, kept = spark.read.parquet(f"file://{tmp_path}/documents.parquet"), {}
    for name, stage in pipeline.STAGES:
        at = written(stage(spark, at, f"file://{tmp_path}"), name)
        kept[name] = [r.doc_id for r in at.select("doc_id").collect()]
        if name != "sentencepiece":
            assert at.columns == docs.columns
    good = set(range(120)) | {160, 161, 162}
    assert set(kept["quality"]) == good
    assert sorted(kept["exact_dedup"]) == list(range(120))
    kept_by_hand = slow_kept([(r.doc_id, r.text) for r in docs.filter(F.col("doc_id") < 120).collect()], pipeline.NEAR_LEAST)
    assert set(kept["simhash"]) == kept_by_hand and len(kept["simhash"]) == len(kept_by_hand) < 120
    plan = {r.doc_id: r.copies for r in mixing.mix(docs.join(spark.createDataFrame([(i,) for i in kept["simhash"]], "doc_id long"), "doc_id", "left_semi")).collect()}
    assert sorted(kept["mixing"]) == sorted(i for i, n in plan.items() for _ in range(n))
    assert sorted(kept["sentencepiece"]) == sorted(kept["mixing"])
    run = pipeline.run(spark, f"file://{tmp_path}")
    assert sorted(map(tuple, run.collect())) == sorted(map(tuple, at.collect()))


def test_modules_stand_apart():
    root = Path(queries.__file__).resolve().parents[2]
    assert "except" not in (root / "corpus_pipeline.py").read_text()
    for f in (root / "placemill/llm").glob("*.py"):
        text = f.read_text()
        assert "ImportError" not in text and "localCheckpoint" not in text and "crossJoin" not in text
