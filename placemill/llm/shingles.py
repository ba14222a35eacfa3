"""Near-dedup by the Jaccard similarity of word shingles: documents link when it reaches a threshold.

Candidates come from SimHash over the same shingles, by counts of fingerprint segments in grids (``gridjoin.py``). Each pair is then decided on the shingles themselves, so nothing links below the threshold.

More than CELL_PAIRS documents that a table of the grids joins make no pairs there but a crowd, a row each; crowds that share a member are one. Each document of a crowd is first compared with
at most PIVOTS others: those that met most others in the crowds of its tables, where a text that the others are copies of is found if it is there. What this joins needs no further comparison. Documents of crowds
that are still apart after that meet by the overlap that a link needs, not by cell: the shingles of all such documents are put in one order, rarest first, and of two
sets that reach the threshold the larger has one of the smaller's first (1 - 2t / (1 + t)) n + 1 among its own first (1 - t) n + 1 (t the threshold, n a set's size).
Shingles of one document or one component alone come first and meet nothing, so copies of one text with many changes of their own have no place left for what all of them share, and never meet.
Where two meet, their places bound the overlap once more. No candidate that could link is left out.

Equal shingle sets are one class from the start. Cases: null and empty texts are one class; a text of fewer words than a shingle is
one shingle; a null doc_id never names a component and its row stays; an empty table gives no rows; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placemill.llm import gridjoin
from placemill.llm.common import SENT_ROWS, connected_components, one_of_each, sent, text_key, tidy, with_text, written
from placemill.llm.simhash import shingle_hashes

CELL_PAIRS = 32
PIVOTS = 4
#: A document in more pairs than this has its text sent once for each so many of them.
PAIRS_A_COPY = 64


def shingle_set(text: bytes, words: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, words, 42))


def digest(found: np.ndarray) -> int:
    return int(np.array([xxhash.xxh64_intdigest(found.tobytes())], np.uint64).view(np.int64)[0])


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, key, h, n, bits``: the text's key, the set's digest, its size, its fingerprint."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), words) for t in batch.column(2).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([digest(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([gridjoin.fingerprint(s).view(np.int64) for s in sets], pa.list_(pa.int64()))],
                names=["doc_id", "key", "h", "n", "bits"],
            )

    rows = with_text(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id").select("doc_id", text_key().alias("key"), "text")
    return rows.mapInArrow(tidy(fn), "doc_id long, key long, h long, n long, bits array<long>")


def _sizes_allow(x: Column, y: Column, least: float) -> Column:
    """A similarity is at most the smaller size over the larger; a hair is left for rounding."""
    return F.least(x, y) >= F.greatest(x, y) * (least - 1e-9)


def verified(pairs: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    """``pairs(a, a_id, b, b_id)`` of digests and doc_ids -> the pairs ``a, b`` whose similarity reaches ``least``."""
    pairs = written(pairs, "pairs")
    copies = pairs.groupBy("a", "a_id").agg(F.ceil(F.count("*") / PAIRS_A_COPY).alias("copies"))
    left = texts.join(copies, F.col("doc_id") == F.col("a_id")).select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"), F.col("text").alias("x"))
    dealt = pairs.join(copies.drop("a_id"), "a").withColumn("copy", F.pmod(F.xxhash64("b"), F.col("copies")))
    joined = dealt.join(texts.select(F.col("doc_id").alias("b_id"), F.col("text").alias("y")), "b_id").join(left, ["a", "copy"]).select("a", "b", "x", "y")

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, of_last = None, None
        for batch in batches:
            a, b, keep = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for i, (x, y) in enumerate(zip(batch.column(2).cast(pa.binary()), batch.column(3).cast(pa.binary()), strict=True)):
                if (text := x.as_py()) != last:
                    last, of_last = text, shingle_set(text, words)
                other = shingle_set(y.as_py(), words)
                # where a doc_id has several texts, only those of these digests count
                if similarity(of_last, other) >= least and digest(of_last) == a[i] and digest(other) == b[i]:
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], names=["a", "b"])

    return written(joined.mapInArrow(tidy(fn), "a long, b long").distinct(), "links")


def prefixes(members: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    """``members(h, id, n, label)`` -> ``s, h, id, n, label, place``: of each set, in the order rarest first, the shingles by which a larger or equal set has to know it,
    and those by which it has to know a smaller one, but for shingles that no member of another label has.

    A set that has more shingles to itself than a link leaves room for reaches no other and goes before any shingle is joined. Shingles of one label come first in the order, as no pair to be found shares them.
    """

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                found = shingle_set(text.as_py(), words)
                if digest(found) == h:  # where a doc_id has several texts, the one of this digest
                    yield pa.RecordBatch.from_arrays([pa.array([h]), pa.array([found.view(np.int64)], pa.list_(pa.int64()))], names=["h", "s"])

    sets = members.join(texts, F.col("id") == F.col("doc_id")).select("h", "text").mapInArrow(tidy(fn), "h long, s array<long>")
    sets = written(sets.dropDuplicates(["h"]), "sets")
    alone = sets.select("h", F.explode("s").alias("s")).groupBy("s").agg(F.count("*").alias("sets"), F.min("h").alias("h")).filter("sets = 1").groupBy("h").agg(F.count("*").alias("alone"))
    able = members.join(alone, "h", "left").withColumn("first", F.coalesce("alone", F.lit(0)) + 1).filter(_within("first", least))
    able = written(able.select("h", "label"), "able")
    each = sets.join(able, "h").select("h", "label", F.explode("s").alias("s"))
    # written apart, so that Spark can split a common shingle's rows in the join
    known = each.groupBy("s").agg(F.count("*").alias("sets"), F.min("label").alias("low"), F.max("label").alias("high"))
    known = written(known.filter("low <> high").select("s", "sets"), "known")
    own = Window.partitionBy("h")
    ranked = each.join(known, "s").select("h", "s", F.row_number().over(own.orderBy("sets", "s")).alias("at"), F.count("*").over(own).alias("shared"))
    placed = ranked.join(members, "h").withColumn("place", F.col("n") - F.col("shared") + F.col("at"))
    return written(placed.filter(_within("place", least)).select("s", "h", "id", "n", "label", "place"), "prefixes")


def _within(place: str, share: float) -> Column:
    """Whether a place is among those by which a set must be met if at least ``share`` of it has to be common."""
    return F.col(place) <= F.col("n") - F.ceil(F.col("n") * share - 1e-6) + 1


def _known(rows: DataFrame, least: float) -> DataFrame:
    """The pairs of ``prefixes`` with different labels whose sizes and places let the similarity reach ``least``; the smaller set comes as x."""
    cols = ("h", "id", "n", "label", "place")
    x = rows.filter(_within("place", 2 * least / (1 + least))).select("s", *(F.col(c).alias(f"x_{c}") for c in cols))
    y = rows.select("s", *(F.col(c).alias(f"y_{c}") for c in cols))
    met = x.join(y, "s").filter("x_label <> y_label and (x_n < y_n or x_n = y_n and x_h < y_h)").filter(_sizes_allow(F.col("x_n"), F.col("y_n"), least))
    most = 1 + F.least(F.col("x_n") - F.col("x_place"), F.col("y_n") - F.col("y_place"))
    met = met.filter(most * (1 + least) >= (F.col("x_n") + F.col("y_n")) * least - 1e-6)
    return met.select(F.col("x_h").alias("a"), F.col("x_id").alias("a_id"), F.col("y_h").alias("b"), F.col("y_id").alias("b_id")).distinct()


def _allowed(pairs: DataFrame, who: DataFrame, least: float) -> DataFrame:
    """The pairs ``a, b`` whose sizes allow a link, with the doc_ids of ``who(h, id, n)``."""
    x, y = (who.select(F.col("h").alias(a), F.col("id").alias(f"{a}_id"), F.col("n").alias(f"{a}_n")) for a in "ab")
    return pairs.join(x, "a").join(y, "b").filter(_sizes_allow(F.col("a_n"), F.col("b_n"), least)).select("a", "a_id", "b", "b_id")


def _to_pivots(crowds: DataFrame) -> DataFrame:
    """The pairs of a pivot and a document of its crowd.

    A document gathers the pivots of its tables before it meets them, so a pivot that several tables name meets it once, and it meets the PIVOTS of them that stand for most; what they leave apart meets by prefix.
    """
    own = crowds.groupBy("h", "p").agg(F.sum("members").alias("met")).groupBy("h").agg(F.slice(F.sort_array(F.collect_list(F.struct("met", "p")), False), 1, PIVOTS).alias("best"))
    return own.select(F.explode("best.p").alias("a"), F.col("h").alias("b")).filter("a <> b")


def _one_crowd(crowds: DataFrame) -> DataFrame:
    """``crowds(cell, h)`` -> ``h, cell``: crowds that share a member become one, so each document is in one. Only their names are joined, through the least name of each document."""
    spots = written(crowds.select("h", "cell").distinct().withColumn("least", F.min("cell").over(Window.partitionBy("h"))), "spots")
    names = connected_components(spots.select(F.col("cell").alias("a"), F.col("least").alias("b")).filter("a <> b").distinct())
    return spots.select("h", "least").distinct().join(names, F.col("least") == F.col("node"), "left").select("h", F.coalesce("component", "least").alias("cell"))


def components(signed: DataFrame, docs: DataFrame, words: int, least: float, cell_pairs: int = CELL_PAIRS, most: int = SENT_ROWS) -> DataFrame:
    """``signed(doc_id, h, n, bits)`` -> ``h, component``: the smallest doc_id that links lead to from a class."""
    classes = written(signed.groupBy("h", "n").agg(F.min("doc_id").alias("id"), F.first("bits").alias("bits")), "classes")
    met = written(gridjoin.cells(classes.filter("id is not null and n > 0").select("h", "bits"), cell_pairs), "met")
    crowds = met.filter("members > 2")
    crowded = not crowds.isEmpty()
    pairs = met.filter("members = 2 and h < p").select(F.col("h").alias("a"), F.col("p").alias("b"))
    pairs = written((pairs.union(_to_pivots(crowds)) if crowded else pairs).distinct(), "ends")
    # written apart, so that Spark can split the rows of one that many meet in the join
    who = written(classes.select("h", "id", "n").join(met.select("h").distinct(), "h"), "who")
    pairs = written(_allowed(pairs, sent(who, most), least), "cells")
    if crowded:
        dense = written(_one_crowd(crowds).join(sent(who, most), "h").select("h", "id", "n", "cell"), "dense")
    texts = with_text(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id")
    ids = pairs.select(F.col("a_id").alias("doc_id")).union(pairs.select(F.col("b_id").alias("doc_id")))
    ids = written((ids.union(dense.select(F.col("id").alias("doc_id"))) if crowded else ids).distinct(), "ids")
    texts = written(texts.join(sent(ids, most), "doc_id", "left_semi"), "texts")
    joined = connected_components(verified(pairs, texts, words, least))
    if crowded:
        spots = dense.join(joined, F.col("h") == F.col("node"), "left").select("h", "id", "n", F.coalesce("component", "h").alias("label"), "cell")
        spots = written(spots, "labelled")
        apart = written(spots.groupBy("cell").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("cell"), "apart")
        if not apart.isEmpty():
            rest = written(spots.join(apart, "cell").select("h", "id", "n", "label").distinct(), "rest")
            found = verified(_known(prefixes(rest, texts, words, least), least), texts, words, least)
            # earlier links come as the stars they made
            joined = connected_components(found.union(joined.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    named = classes.join(joined, F.col("h") == F.col("node"), "left").select("h", "id", F.coalesce("component", "h").alias("label"))
    names = written(named.groupBy("label").agg(F.min("id").alias("component")), "names")  # apart, so that Spark can split a large component's rows in the join
    return named.join(names, "label").select("h", "component")


def keep_one(docs: DataFrame, words: int = 5, least: float = 0.8, cell_pairs: int = CELL_PAIRS) -> DataFrame:
    """``docs`` with one row, that of the smallest doc_id, of each component; rows that share a doc_id are told apart by their texts."""
    signed = written(signatures(docs, words), "signed")
    found = signed.select(F.col("doc_id").alias("id"), "key", "h").join(components(signed, docs, words, least, cell_pairs), "h")
    return one_of_each(docs, found)
