"""Toxicity: a factorization machine over hashed terms.

A document is the set of its lower-cased terms and their beginnings, each hashed to one of 2^HASH_BITS slots. Its log odds are a bias, a
weight for each slot and, for each pair of slots, the inner product of their factor vectors; so an insult next to a
group's name can weigh more than both do alone. Slots that say nothing about the label in the training rows
have no weights, so a long clean text gathers no noise; the others start from shrunken log odds and are fitted with the factors by
AdaGrad on the logistic loss.

The machine is fitted on at most FIT_ROWS labelled rows of the training folds (a documented bound); its slots are bounded
by SLOTS, so what is sent to the workers has a fixed size. Every row is scored.

Cases: null and empty texts get the bias alone; very long texts count each term once; null labels are no labels; with no labels, or one
class, the score is the smoothed rate; repeated rows score alike; an empty table gives no rows; other columns, labels, language and source
among them, are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placemill.llm.common import with_text, written
from placemill.llm.quality import training_rows

HASH_BITS = 20
FIT_ROWS = 20_000
SLOTS = 4096
FACTORS = 8
THRESHOLD = 0.7
#: Bytes of a term's beginnings that are terms too.
STEMS = (4, 5, 6)
REMEMBERED = 500_000
#: A slot needs a G statistic of this much and so many rows; 8, 12, 16 and 24 were compared on held-out rows.
MIN_GAIN, MIN_ROWS = 16.0, 3

#: ASCII signs part terms, as white space does.
_PARTS = bytes.maketrans(b"!\"#$%&()*+,./:;<=>?@[\\]^_`{|}~", b" " * 30)


def terms(text: str) -> set[bytes]:
    return set(text.lower().encode("utf-8", "replace").translate(_PARTS).split())


def slots_of(term: bytes) -> list[int]:
    """Slots of the term and of its beginnings, for stems that take many endings."""
    parts = [term, *(b"^" + term[:k] for k in STEMS if len(term) >= k)]
    return [zlib.crc32(p) & ((1 << HASH_BITS) - 1) for p in parts]


def slots_in(text: str) -> list[int]:
    return sorted({s for t in terms(text) for s in slots_of(t)})


class Machine:
    """Parameters of a fitted machine; ``index`` maps a slot to its row, -1 for slots without weights."""

    def __init__(self, slots: np.ndarray, bias: float, w: np.ndarray, v: np.ndarray):
        self.slots, self.bias, self.w, self.v = slots, bias, w, v
        self.rows = {int(s): i for i, s in enumerate(slots)}

    def logit(self, rows: list[int]) -> float:
        if not rows:
            return self.bias
        v = self.v[rows]
        total = v.sum(axis=0)
        return float(self.bias + self.w[rows].sum() + 0.5 * (total @ total - (v * v).sum()))


def gain(df: np.ndarray, with_label: np.ndarray, n: float, pos: float) -> np.ndarray:
    """G statistic of each slot against the label, from rows that have it and those of them with the label."""

    def part(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / np.maximum(expected, 1e-9)), 0)

    share = pos / n
    return 2 * (part(with_label, df * share) + part(df - with_label, df * (1 - share)) + part(pos - with_label, (n - df) * share) + part(n - df - pos + with_label, (n - df) * (1 - share)))


def choose(slots: np.ndarray, df: np.ndarray, with_label: np.ndarray, n: float, pos: float) -> np.ndarray:
    """Indexes of the slots that get weights, in the order of the slots; ties go to the smaller slot."""
    if not 0 < pos < n:
        return np.empty(0, np.int64)
    g = gain(df.astype(float), with_label.astype(float), n, pos)
    able = np.flatnonzero((g >= MIN_GAIN) & (df >= MIN_ROWS))
    return np.sort(able[np.lexsort((slots[able], -g[able]))][:SLOTS])


def fit(rows: list[np.ndarray], y: np.ndarray, slots: np.ndarray, df: np.ndarray, with_label: np.ndarray, epochs: int = 12, batch: int = 128, rate: float = 0.1, ridge: float = 1e-4, seed: int = 5) -> Machine:
    """``rows``: of each document, the indexes of its chosen ``slots``."""
    n, pos = len(y), float(y.sum()) if len(y) else 0.0
    bias = float(np.log((pos + 0.5) / (n - pos + 0.5)))
    if not len(slots):
        return Machine(np.empty(0, np.int64), bias, np.empty(0), np.empty((0, FACTORS)))
    # shrunken log odds to begin with, halved as terms of a document come together
    w = 0.5 * (np.log((with_label + 0.5) / (pos + 1)) - np.log((df - with_label + 0.5) / (n - pos + 1)))
    rng = np.random.default_rng(seed)
    v = rng.normal(0, 0.01, (len(slots), FACTORS))
    gw, gv, gb = np.full(len(slots), 1e-2), np.full(v.shape, 1e-2), 1e-2
    for _ in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, batch):
            some = order[at : at + batch]
            k = [len(rows[i]) for i in some]
            of, r = np.repeat(np.arange(len(some)), k), np.concatenate([rows[i] for i in some])
            vr = v[r]
            total = np.zeros((len(some), FACTORS))
            np.add.at(total, of, vr)
            square = np.bincount(of, weights=(vr * vr).sum(axis=1), minlength=len(some))
            z = bias + np.bincount(of, weights=w[r], minlength=len(some)) + 0.5 * ((total * total).sum(axis=1) - square)
            d = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[some]
            db = d.mean()
            gb += db * db
            bias -= rate * db / np.sqrt(gb)
            if not len(r):
                continue
            u, back = np.unique(r, return_inverse=True)
            dw = np.bincount(back, weights=d[of]) / len(some) + ridge * w[u]
            dv = np.zeros((len(u), FACTORS))
            np.add.at(dv, back, d[of][:, None] * (total[of] - vr) / len(some))
            dv += ridge * v[u]
            gw[u] += dw * dw
            gv[u] += dv * dv
            w[u] -= rate * dw / np.sqrt(gw[u])
            v[u] -= rate * dv / np.sqrt(gv[u])
    return Machine(slots, float(bias), w, v)


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Machine:
    """Fit on labelled rows whose crc32 of doc_id is not 1 modulo 3.

    Slots are counted where the rows are; the driver gets their counts, at most 2^HASH_BITS of them, and then of each row only the
    chosen slots, at most SLOTS.
    """

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, 1 << HASH_BITS), np.int64)
        for batch in batches:
            for text, y in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                s = slots_in(text.as_py())
                n[0, s] += 1
                n[1, s] += y
        some = np.flatnonzero(n[0])
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[0, some]), pa.array(n[1, some])], names=["slot", "df", "pos"])

    fold = F.pmod(F.crc32(F.col("__id").cast("string")), F.lit(3)) != 1
    sample = training_rows(docs, labels, "toxic", rows, fold)
    total = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("pos")).first()
    found = sample.mapInArrow(counts, "slot int, df long, pos long").groupBy("slot").agg(F.sum("df").alias("df"), F.sum("pos").alias("pos")).filter(F.col("df") >= MIN_ROWS).toArrow().sort_by("slot")
    slots, df, pos = (found.column(c).to_numpy() for c in ("slot", "df", "pos"))
    chosen = choose(slots, df, pos, float(total.n), float(total.pos))
    slots, df, pos = slots[chosen].astype(np.int64), df[chosen], pos[chosen]
    index = {int(s): i for i, s in enumerate(slots)}

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [[index[s] for s in slots_in(t) if s in index] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(x, pa.list_(pa.int16())), batch.column(2)], names=["id", "x", "y"])

    got = sample.mapInArrow(reduced, "id long, x array<smallint>, y int").toArrow().sort_by("id")
    x = got.column("x").combine_chunks()
    flat, ends = x.flatten().to_numpy().astype(np.int64), np.cumsum([0, *map(len, x)])
    return fit([flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], got.column("y").to_numpy().astype(float), slots, df, pos)


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, rows: int = FIT_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted."""
    machine = train(docs, labels, rows)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, list[int]] = {}  # rows of each term
        for batch in batches:
            out = []
            for text in batch.column(1):
                found: set[int] = set()
                for t in terms(text.as_py()):
                    r = known.get(t)
                    if r is None:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        r = known[t] = [machine.rows[s] for s in slots_of(t) if s in machine.rows]
                    if r:
                        found.update(r)
                out.append(1 / (1 + np.exp(-np.clip(machine.logit(sorted(found)), -30, 30))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["doc_id", "score"])

    scored = with_text(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id").mapInArrow(fn, "doc_id long, score double")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
