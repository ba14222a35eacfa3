"""LM scoring by deleted interpolation of word bigrams.

The probability of a word after another is a mix of the bigram and unigram maximum-likelihood estimates and the uniform
one; the weights depend on how often the context was seen, in buckets of powers of two, and are learned by
expectation-maximisation on counts held out of the training documents: one training fold in nine is deleted, the others
give the estimates, and the deleted fold's tokens say how far to trust them. Scores then use the counts of all
training folds.

No table of words or bigrams is broadcast or joined row by row. Documents become batches of about BATCH_TOKENS tokens, written once.
A batch sends the sorted hashes of its distinct words and bigrams with its counts, one packed row a
bucket of the hash space; a bucket adds up what all batches send and answers each with the totals in the order of
its hashes. So a token costs a few bytes of shuffle, a word or pair that a third of the documents share costs one entry a
batch, and every step's memory is bounded by a batch or a bucket.

EM sees the deleted fold through a histogram of (pair count, context count, word count), exact up to 16 and in half octaves
beyond, whose size is bounded by the number of bins.

Cases: null text is empty and has the end token alone; a null doc_id counts as the text ''; repeated rows are documents of
their own; without training rows only the uniform estimate is left; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placemill.llm.common import with_text, written

BATCH_TOKENS = 2_000_000
FOLDS, HELD_OUT, DELETED = 10, 0, 9
END = b"\n"  # no word holds white space
#: A context bucket is pulled toward the weights of all contexts by so many tokens.
PRIOR_TOKENS = 20.0

BATCH_SCHEMA = "batch long, deleted boolean, doc_ids array<bigint>, held array<boolean>, lens array<int>, tokens binary, words binary"
SENT_SCHEMA = "kind int, bucket int, batch long, deleted boolean, hashes binary, counts binary"
REPLY_SCHEMA = "kind int, bucket int, batch long, total binary, part binary, n_distinct long, n_part_distinct long"


def pack(values: np.ndarray) -> bytes:
    """Integers as compressed byte planes."""
    return zlib.compress(np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1).T).view("<i8").ravel()


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class _Batch:
    def __init__(self, number: int, deleted: bool):
        self.number, self.deleted = number, deleted
        self.ids, self.docs, self.held, self.tokens = _Ids(), [], [], []
        self.ids[END] = 0
        self.size = 0

    def add(self, doc_id: int | None, held: bool, text: bytes) -> None:
        words = text.lower().split()  # both know ASCII only
        t = np.zeros(len(words) + 1, np.int32)
        t[:-1] = np.fromiter(map(self.ids.__getitem__, words), np.int32, len(words))
        self.docs.append(doc_id)
        self.held.append(held)
        self.tokens.append(t)
        self.size += len(t)

    def row(self) -> pa.RecordBatch:
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, self.ids), np.uint64, len(self.ids))
        cols = [[self.number], [self.deleted], [self.docs], [self.held], [[len(t) for t in self.tokens]], [pack(np.concatenate(self.tokens))], [hashes.tobytes()]]
        kinds = [pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in BATCH_SCHEMA.split(", ")])


def batches(docs: DataFrame, batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    def fn(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        open_: dict[bool, _Batch] = {}
        for batch in it:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                fold = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS
                deleted = fold == DELETED
                if deleted not in open_:
                    open_[deleted], number = _Batch(number, deleted), number + 1
                open_[deleted].add(doc_id, fold == HELD_OUT, text.as_py())
                if open_[deleted].size >= batch_tokens:
                    yield open_.pop(deleted).row()
        for b in open_.values():
            yield b.row()

    return with_text(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id").mapInArrow(fn, BATCH_SCHEMA)


class _Read:
    """A batch's arrays, and its distinct words and pairs in the order in which they are sent."""

    def __init__(self, row: dict):
        self.number, self.deleted, self.docs = row["batch"], row["deleted"], row["doc_ids"]
        self.lens, self.held = np.array(row["lens"], np.int64), np.array(row["held"], bool)
        self.tokens = unpack(row["tokens"])
        self.words = np.frombuffer(row["words"], np.uint64)
        self.train = np.repeat(~self.held, self.lens)
        starts = np.cumsum(self.lens) - self.lens
        self.context = np.empty_like(self.tokens)
        self.context[1:] = self.tokens[:-1]
        self.context[starts] = 0

    def entries(self, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash of each distinct entry, training count of each, and each token's entry."""
        if kind == 0:
            return self.words, np.bincount(self.tokens[self.train], minlength=len(self.words)), self.tokens
        pairs, at = np.unique(self.context * len(self.words) + self.tokens, return_inverse=True)
        left, right = self.words[pairs // len(self.words)], self.words[pairs % len(self.words)]
        with np.errstate(over="ignore"):
            h = (left ^ (left >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + (right ^ (right >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0x165667B19E3779F9)
            h ^= h >> np.uint64(33)
        return h, np.bincount(at[self.train], minlength=len(pairs)), at

    def order(self, hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Entries by bucket, within it by hash; and where each bucket ends. Buckets are ranges of the hash space."""
        order = np.argsort(hashes)
        edges = (np.arange(1, buckets + 1, dtype=object) * (1 << 64) // buckets - 1).astype(np.uint64)
        return order, np.searchsorted(hashes[order], edges, side="right")


def sent(written_batches: DataFrame, buckets: tuple[int, int]) -> DataFrame:
    def fn(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for row in batch.to_pylist():
                read = _Read(row)
                for kind in (0, 1):
                    hashes, counts, _ = read.entries(kind)
                    order, ends = read.order(hashes, buckets[kind])
                    hashes, counts = hashes[order], counts[order]
                    out: list[tuple] = []
                    a = 0
                    for bucket, b in enumerate(ends.tolist()):
                        if b > a:
                            out.append((kind, bucket, read.number, read.deleted, hashes[a:b].tobytes(), pack(counts[a:b])))
                        a = b
                    cols = list(zip(*out, strict=True)) if out else [[]] * 6
                    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in SENT_SCHEMA.split(", ")])

    return written_batches.mapInArrow(fn, SENT_SCHEMA)


def _totals(table: pa.Table) -> pa.Table:
    """One bucket: totals over all batches, for each batch in its own order; also the totals without the deleted fold."""
    rows = table.to_pylist()
    hashes = [np.frombuffer(r["hashes"], np.uint64) for r in rows]
    lens = [len(h) for h in hashes]
    u, at = np.unique(np.concatenate(hashes), return_inverse=True)
    counts = np.concatenate([unpack(r["counts"]) for r in rows])
    kept = np.repeat([not r["deleted"] for r in rows], lens)
    part = np.bincount(at[kept], weights=counts[kept], minlength=len(u)).astype(np.int64)
    total = part + np.bincount(at[~kept], weights=counts[~kept], minlength=len(u)).astype(np.int64)
    out, a = [], 0
    for r, n in zip(rows, lens, strict=True):
        own = at[a : a + n]
        a += n
        out.append({"kind": r["kind"], "bucket": r["bucket"], "batch": r["batch"], "total": pack(total[own]), "part": pack(part[own]) if r["deleted"] else None, "n_distinct": 0, "n_part_distinct": 0})
    out[0] |= {"n_distinct": int((total > 0).sum()), "n_part_distinct": int((part > 0).sum())}
    return pa.Table.from_pylist(out, REPLY_ARROW)


REPLY_ARROW = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("batch", pa.int64()), ("total", pa.binary()), ("part", pa.binary()), ("n_distinct", pa.int64()), ("n_part_distinct", pa.int64())])


def _counts_of(read: _Read, replies: list[dict], field: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token the training counts of pair, context and word."""
    got = []
    for kind in (0, 1):
        hashes, _, at = read.entries(kind)
        parts = [unpack(r[field]) for r in sorted((r for r in replies if r["kind"] == kind), key=lambda r: r["bucket"])]
        values = np.empty(len(hashes), np.int64)
        values[np.argsort(hashes)] = np.concatenate(parts)
        got.append((values, at))
    (words, _), (pairs, at) = got
    return pairs[at], words[read.context], words[read.tokens]


def context_bucket(c: np.ndarray) -> np.ndarray:
    """0 for unseen contexts, else one more than the power of two below the count."""
    return np.where(c > 0, np.floor(np.log2(np.maximum(c, 1))).astype(np.int64) + 1, 0)


def _bin(c: np.ndarray) -> np.ndarray:
    return np.where(c <= 16, c, 8 + np.floor(2 * np.log2(np.maximum(c, 1))).astype(np.int64) + 1)


def _unbin(b: np.ndarray) -> np.ndarray:
    return np.where(b <= 16, b, 2.0 ** ((b - 9) / 2 + 0.25))


def histogram(joined_batches: DataFrame, replies: DataFrame) -> DataFrame:
    def fn(left: pa.Table, right: pa.Table) -> pa.Table:
        read = _Read(left.to_pylist()[0])
        c12, c1, c2 = _counts_of(read, right.to_pylist(), "part")
        keys, n = np.unique((_bin(c12) << 40) | (_bin(c1) << 20) | _bin(c2), return_counts=True)
        return pa.table({"key": keys, "n": n.astype(np.int64)})

    return joined_batches.groupBy("batch").cogroup(replies.groupBy("batch")).applyInArrow(fn, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def learn(key: np.ndarray, n: np.ndarray, n_train: float, n_words: float, rounds: int = 100) -> np.ndarray:
    """Weights (bigram, unigram, uniform) of each context bucket by EM; 64 buckets."""
    start = np.array([0.4, 0.5, 0.1]) if n_train > 0 else np.array([0.0, 0.0, 1.0])
    if not len(key) or n_train <= 0:
        return np.tile(start, (64, 1))
    c12, c1, c2 = (_unbin((key >> s) & 0xFFFFF) for s in (40, 20, 0))
    p = np.stack([np.minimum(c12 / np.maximum(c1, 1), 1), np.minimum(c2 / n_train, 1), np.full(len(key), 1 / (n_words + 1))])
    bucket = context_bucket(np.round(c1).astype(np.int64))

    def em(weights: np.ndarray, of: np.ndarray, prior: np.ndarray) -> np.ndarray:
        for _ in range(rounds):
            share = weights[of].T * p
            share *= n / np.maximum(share.sum(axis=0), 1e-300)
            counts = np.stack([np.bincount(of, weights=s, minlength=len(weights)) for s in share], axis=1) + prior
            new = counts / counts.sum(axis=1, keepdims=True)
            if np.abs(new - weights).max() < 1e-7:
                break
            weights = new
        return new

    everywhere = em(start[None], np.zeros(len(key), np.int64), np.full((1, 3), 1e-3))
    return em(np.tile(everywhere, (64, 1)), bucket, PRIOR_TOKENS * everywhere)


def score(docs: DataFrame, batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    read = written(batches(docs, batch_tokens), "lm-batches")
    sizes = read.select(F.expr("aggregate(lens, 0L, (a, x) -> a + x)").alias("n"), F.when(F.col("deleted"), 0).otherwise(F.expr("aggregate(zip_with(lens, held, (x, h) -> if(h, 0, x)), 0L, (a, x) -> a + x)")).alias("part"), F.expr("aggregate(zip_with(lens, held, (x, h) -> if(h, 0, x)), 0L, (a, x) -> a + x)").alias("train")).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "part", "train"))).first()
    pair_buckets = int(max(8, min(sizes.n // 1_000_000, 256), sizes.n // 8_000_000))
    buckets = (max(4, pair_buckets // 4), pair_buckets)
    replies = written(sent(read, buckets).groupBy("kind", "bucket").applyInArrow(_totals, REPLY_SCHEMA), "lm-counts")
    n_words, n_part_words = (int(x or 0) for x in replies.filter("kind = 0").agg(F.sum("n_distinct"), F.sum("n_part_distinct")).first())
    answers = replies.select("kind", "bucket", "batch", "total", "part")
    hist = histogram(read.filter("deleted"), answers.filter("part is not null").drop("total")).toArrow()
    weights = learn(hist.column("key").to_numpy(), hist.column("n").to_numpy().astype(float), float(sizes.part), float(n_part_words))
    n_train = int(sizes.train)

    def fn(left: pa.Table, right: pa.Table) -> pa.Table:
        b = _Read(left.to_pylist()[0])
        c12, c1, c2 = _counts_of(b, right.to_pylist(), "total")
        lam = weights[context_bucket(c1)]
        p = lam[:, 0] * (c12 / np.maximum(c1, 1)) + lam[:, 1] * (c2 / max(n_train, 1)) + lam[:, 2] / (n_words + 1)
        base = np.log10((c2 + 0.1) / (n_train + 0.1 * (n_words + 1)))
        starts = np.cumsum(b.lens) - b.lens
        by_doc = lambda x: np.add.reduceat(x, starts)  # noqa: E731  every document has its end token
        return pa.table({"doc_id": pa.array(b.docs, pa.int64()), "held_out": b.held, "n_tokens": b.lens, "n_known": by_doc((c2 > 0).astype(np.int64)), "train_tokens": np.full(len(b.lens), n_train), "base_score": by_doc(base), "score": by_doc(np.log10(p))})

    return read.groupBy("batch").cogroup(answers.drop("part").groupBy("batch")).applyInArrow(fn, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
