"""SimHash near-dedup by a segment-popcount embedding.

A fingerprint has 64 bits, one by majority over the hashes of a text's word shingles. Cut into 32
segments of two bits, it becomes a lattice point of 32 bit counts, and the Manhattan distance of two
points is at most the Hamming distance of the fingerprints. So fingerprints that link lie within
Manhattan distance ``max_bits`` of each other, and of ``max_bits + GRID_EXTRA`` groups of coordinates, at least GRID_EXTRA
are equal in both. Each choice of GRID_EXTRA groups is one grid, and the counts of its groups name the cell; two
fingerprints that link share a cell of some grid. Cells are equi-joined; Manhattan distance drops most
pairs; the exact distance decides.

A cell with more than CELL_PAIRS fingerprints makes no pairs. Its members link through midpoints instead: each
emits itself and its one-bit neighbours, and two fingerprints within two bits share one of those, so a
star per midpoint holds every link in linear size. (``max_bits`` is two at most for that.)

Equal fingerprints are one class from the start, so copies cost one row however many there are.

Cases: null and empty texts have fingerprint zero and link like any other; ties (half of the hashes) give 0;
repeated rows are one class; an empty table gives no rows; a null doc_id is ignored as a component's name
unless alone; other columns are ignored by ``assign`` and kept by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placemill.llm.common import connected_components, one_of_each, text_key, tidy, with_text, written

SEGMENTS = 32
GRID_EXTRA = 4
CELL_PAIRS = 32


def shingle_hashes(text: bytes, words: int, seed: int) -> np.ndarray:
    """XXH64 of each run of ``words`` words of the lower-cased text; of all words if they are fewer."""
    parts = text.lower().split()  # both know ASCII only
    if not parts:
        return np.empty(0, np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    n = max(1, len(parts) - words + 1)
    starts = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
    stops = ends[len(ends) - n :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter([digest(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)], np.uint64, n)


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    h = shingle_hashes(text, words, seed)
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):  # big-endian bytes: the first bit is the highest
        ones += np.unpackbits(h[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """``doc_id, key, fp``: the text's key and the fingerprint as a signed long."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            fps = np.fromiter((fingerprint(t.as_py(), words, seed) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], names=["doc_id", "key", "fp"])

    rows = with_text(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id").select("doc_id", text_key().alias("key"), "text")
    return rows.mapInArrow(tidy(fn), "doc_id long, key long, fp long")


LANES = 0x5555555555555555


def _counts(fp: Column) -> Column:
    """The embedding, packed: in each lane of two bits, how many of the fingerprint's two bits are set."""
    low, high = fp.bitwiseAND(F.lit(LANES)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(LANES))
    return low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def _segment(fp: Column, group: int, groups: int) -> Column:
    """The counts of one group of coordinates."""
    first, last = group * SEGMENTS // groups, (group + 1) * SEGMENTS // groups
    return F.shiftrightunsigned(_counts(fp), 2 * first).bitwiseAND(F.lit((1 << (2 * (last - first))) - 1))


def _manhattan(x: Column, y: Column) -> Column:
    """Manhattan distance of two packed embeddings.

    Counts differ by 1 where the xor of their lanes has the low bit, by 2 where it has the high bit alone.
    """
    differ = _counts(x).bitwiseXOR(_counts(y))
    one = differ.bitwiseAND(F.lit(LANES))
    two = F.shiftrightunsigned(differ, 1).bitwiseAND(F.lit(LANES)).bitwiseAND(F.bitwise_not(one))
    return F.bit_count(one) + 2 * F.bit_count(two)


def _cells(fps: DataFrame, max_bits: int) -> DataFrame:
    groups = max_bits + GRID_EXTRA
    cells = [F.xxhash64(F.lit(k), *(_segment(F.col("fp"), g, groups) for g in chosen)) for k, chosen in enumerate(combinations(range(groups), GRID_EXTRA))]
    return fps.select("id", "fp", F.explode(F.array(*cells)).alias("cell"))


def links(classes: DataFrame, max_bits: int = 2, cell_pairs: int = CELL_PAIRS) -> DataFrame:
    """``classes(id, fp)`` with distinct fp -> edges ``a, b`` between ids whose components are those of all links."""
    if max_bits > 2:
        raise ValueError("midpoints of one-bit neighbours hold links of two bits at most")
    cells = _cells(classes, max_bits)
    counts = cells.groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1")
    shared = written(cells.join(counts, "cell"), "cells")
    some = shared.filter(F.col("n") <= cell_pairs)
    left, right = some.select("cell", F.col("id").alias("a"), F.col("fp").alias("x")), some.select("cell", F.col("id").alias("b"), F.col("fp").alias("y"))
    near = left.join(right, "cell").filter("a < b").filter(_manhattan(F.col("x"), F.col("y")) <= max_bits)
    pairs = near.filter(F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= max_bits).select("a", "b")
    dense = shared.filter(F.col("n") > cell_pairs).select("id", "fp").distinct()
    flips = [F.lit(0).cast("long")] + [F.lit(b - (1 << 64) if b >> 63 else b) for b in (1 << k for k in range(64))] * (max_bits > 0)
    if max_bits == 1:  # then only neighbours of one bit link: each pair is an edge, named by the bit that is clear
        ends = dense.select("id", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.bitwise_not(m)).alias("v")) for k, m in enumerate(flips[1:])])).alias("mid"))
    else:
        ends = dense.select("id", F.explode(F.array(*[F.col("fp").bitwiseXOR(m) for m in flips])).alias("mid"))
    least = ends.groupBy("mid").agg(F.min("id").alias("a"), F.count("*").alias("n")).filter("n > 1").select("mid", "a")
    stars = ends.join(least, "mid").select("a", F.col("id").alias("b")).filter("a < b")
    return pairs.union(stars).distinct()


def components(fps: DataFrame, max_bits: int = 2, cell_pairs: int = CELL_PAIRS) -> DataFrame:
    """``fps(doc_id, fp)`` -> the written classes ``fp, id, component``, id the smallest doc_id of the class."""
    classes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("id")), "classes")
    joined = connected_components(links(classes.filter("id is not null"), max_bits, cell_pairs))
    return classes.join(joined, F.col("id") == F.col("node"), "left").select("fp", "id", F.coalesce("component", "id").alias("component"))


def assign(docs: DataFrame, words: int = 3, max_bits: int = 2, seed: int = 42) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (hex), component_id."""
    fps = written(fingerprints(docs, words, seed), "fps")
    return fps.join(components(fps, max_bits), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, words: int = 3, max_bits: int = 2) -> DataFrame:
    """``docs`` with one row, that of the smallest doc_id, of each component; rows that share a doc_id are told apart by their texts."""
    fps = written(fingerprints(docs, words), "fps")
    return one_of_each(docs, fps.join(components(fps, max_bits), "fp").select(F.col("doc_id").alias("id"), "key", "component"))
