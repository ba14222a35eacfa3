"""Candidates of the near stage by SimHash: wide fingerprints, counts of two-bit segments, grids of two levels.

A fingerprint has WORDS words of 64 bits, one by majority over the hashes of a text's set of shingles; its segments of two bits make a lattice point of bit counts, as in ``simhash.py``.
Each of the TABLES tables has a coarse grid of COARSE segments, which deals a fingerprint to one cell with two of its words, and FINE_GRIDS grids of FINE of these words' segments inside. Fingerprints that share a fine cell meet;
the Manhattan distance of the counts drops most of them, the Hamming distance of the two words the rest that differ in more than MOST_BITS bits. Two levels send a fingerprint once a table where plain grids would send it once for each of the TABLES * FINE_GRIDS.

Two sets of similarity 0.8 have bits that agree with a chance of 0.848 (the angle of sets of one size). The tables' words and segments overlap, so the loss is simulated rather than computed; README has it.

Pairs that meet come as cells of two. More than ``cell_pairs`` fingerprints that lead to each other within a table make no pairs, nor do the members of a fine cell of more than RUN: they become one crowd, one row each.
A large group of which each table brings only a few of a member's others together is a crowd, too, so it costs rows in proportion to its size however loose it is.
A crowd is named by the least hash in it, so those of several tables often share a name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from placemill.llm.common import tidy

WORDS, TABLES = 16, 100
COARSE, FINE, FINE_GRIDS = 4, 12, 98
MOST_BITS = 40
#: A fine cell of more members makes no pairs; rows that are looked at together, whole coarse cells.
RUN, BLOCK = 256, 1 << 16
LANES = np.uint64(0x5555555555555555)
ONE = np.uint64(1)

_RNG = np.random.default_rng(42)
_SEEDS = _RNG.integers(1, 1 << 63, WORDS, dtype=np.uint64)
_MIX = _RNG.integers(0, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + ONE
#: Words that a table sends; the segments of its coarse grid, each a word and a shift; the masks of each fine grid.
SENT = _RNG.permutation(list(combinations(range(WORDS), 2)))[:TABLES]
DEALT = [_RNG.choice(WORDS * 32, COARSE, replace=False) for _ in range(TABLES)]


def _masks() -> np.ndarray:
    out = np.zeros((FINE_GRIDS, 2), np.uint64)
    for k in range(FINE_GRIDS):
        for s in _RNG.choice(64, FINE, replace=False):
            out[k, s // 32] |= np.uint64(3 << int(2 * (s % 32)))
    return out


MASKS = _masks()


def fingerprint(found: np.ndarray) -> np.ndarray:
    """The words of a set of hashes."""
    ones = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(found), 128):
        z = found[at : at + 128, None] ^ _SEEDS
        z ^= z >> np.uint64(30)
        z *= np.uint64(0xBF58476D1CE4E5B9)
        z ^= z >> np.uint64(27)
        z *= np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
        ones += np.unpackbits(z.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(found)).view(np.uint64)


def counts(words: np.ndarray) -> np.ndarray:
    """In each lane of two bits, how many of the word's two bits are set."""
    low, high = words & LANES, (words >> ONE) & LANES
    return (low ^ high) | ((low & high) << ONE)


def _manhattan(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distance of packed counts: they differ by 1 where the xor of their lanes has the low bit, by 2 where it has the high bit alone."""
    differ = x ^ y
    one = differ & LANES
    two = (differ >> ONE) & LANES & ~one
    return np.bitwise_count(one) + 2 * np.bitwise_count(two)


def dealt(prints: DataFrame) -> DataFrame:
    """``prints(h, bits)`` -> ``cell, h, x, y``: one row a table, of its coarse cell and its two words."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(0)
            words = np.array(batch.column(1).flatten(), np.int64).view(np.uint64).reshape(-1, WORDS)
            every = counts(words)
            for k, (segments, (i, j)) in enumerate(zip(DEALT, SENT, strict=True)):
                cell = np.full(len(words), k, np.int64)
                for s in segments:
                    cell = 4 * cell + ((every[:, s // 32] >> np.uint64(2 * (s % 32))) & np.uint64(3)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(cell), h, *(pa.array(np.ascontiguousarray(words[:, w]).view(np.int64)) for w in (i, j))], names=["cell", "h", "x", "y"])

    return prints.mapInArrow(tidy(fn), "cell long, h long, x long, y long")


def _groups(n: int, sides: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Of n rows the least row that edges lead to."""
    label = np.arange(n)
    if not sides:
        return label
    a, b = (np.concatenate(side) for side in zip(*sides, strict=True))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def met(cell: np.ndarray, x: np.ndarray, y: np.ndarray, cell_pairs: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of rows of whole coarse cells the pairs that meet in some fine grid, and the rows of each crowd, first the one that meets most others."""
    n, cx, cy = len(cell), counts(x), counts(y)
    base, pairs, size, stars = cell.astype(np.uint64) * _MIX[0], [np.empty(0, np.int64)], 0, []
    for mx, my in MASKS:
        key = base + (cx & mx) * _MIX[1] + (cy & my) * _MIX[2]
        key ^= key >> np.uint64(32)
        order = np.argsort(key)
        key = key[order]
        begins = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        runs = np.diff(np.append(begins, n))
        for at, many in zip(begins[runs > RUN], runs[runs > RUN], strict=True):
            stars.append((np.repeat(order[at], many - 1), order[at + 1 : at + many]))
        left = (np.append(begins[1:], n) - 1).repeat(runs) - np.arange(n)  # rows after this one in its run
        left[(runs > RUN).repeat(runs)] = 0
        at, far = np.flatnonzero(left), 1
        while len(at):
            i, j = order[at], order[at + far]
            near = np.flatnonzero(_manhattan(cx[i], cx[j]) + _manhattan(cy[i], cy[j]) <= MOST_BITS)
            i, j = i[near], j[near]
            near = np.bitwise_count(x[i] ^ x[j]) + np.bitwise_count(y[i] ^ y[j]) <= MOST_BITS
            pairs.append(np.minimum(i, j)[near] * n + np.maximum(i, j)[near])
            size += len(pairs[-1])
            far += 1
            at = at[left[at] >= far]
        if size > 1 << 22:
            pairs = [np.unique(np.concatenate(pairs))]
            size = 0
    a, b = np.divmod(np.unique(np.concatenate(pairs)), n)
    edges = [*stars, (a, b)]
    label = _groups(n, edges)
    crowded = np.bincount(label, minlength=n) > max(cell_pairs, 2)
    for i, _ in stars:
        crowded[label[i[0]]] = True
    dense = crowded[label]
    meets = np.bincount(np.concatenate([end for edge in edges for end in edge]), minlength=n)
    order = np.flatnonzero(dense)
    order = order[np.lexsort((-meets[order], label[order]))]
    crowds = np.split(order, np.flatnonzero(np.diff(label[order])) + 1) if len(order) else []
    return a[~dense[a]], b[~dense[a]], crowds


def cells(prints: DataFrame, cell_pairs: int) -> DataFrame:
    """``prints(h, bits)`` -> ``cell, h, p, members``: pairs that meet, as cells of two, p the other end, and crowds, p the one that meets most others; a pair or a crowd's row may come from several tables."""

    def one(rows: pa.Table) -> pa.RecordBatch:
        cell, h, x, y = (rows.column(k).to_numpy() for k in range(4))
        a, b, crowds = met(cell, x.view(np.uint64), y.view(np.uint64), cell_pairs)
        low, high = np.minimum(h[a], h[b]).view(np.uint64), np.maximum(h[a], h[b]).view(np.uint64)
        pair = (low * _MIX[3] + (high ^ (high >> np.uint64(29))) * _MIX[4]).view(np.int64)
        size = [np.full(len(c), len(c)) for c in crowds]
        found = [
            [pair, pair, *(np.repeat(h[c].min(), len(c)) for c in crowds)],
            [h[a], h[b], *(h[c] for c in crowds)],
            [h[b], h[a], *(np.repeat(h[c[0]], len(c)) for c in crowds)],
            [np.full(2 * len(a), 2), *size],
        ]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(part).astype(np.int64)) for part in found], names=["cell", "h", "p", "members"])

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            if rows >= BLOCK and batch.num_rows:
                last, own = held[-1].column(0)[-1].as_py(), batch.column(0).to_numpy()
                cut = int(np.searchsorted(own, last, "right"))
                if cut < len(own):  # the last coarse cell ends here
                    yield one(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                    held, rows, batch = [], 0, batch.slice(cut)
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
        if held:
            yield one(pa.Table.from_batches(held))

    return dealt(prints).repartition("cell").sortWithinPartitions("cell").mapInArrow(tidy(fn), "cell long, h long, p long, members long")
