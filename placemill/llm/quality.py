"""Quality classifier: document evidence under hierarchical empirical Bayes.

A logistic regression over the shape of a text (shares of byte classes, word lengths, repetition) gives each
document its evidence. Every document's probability then counts for its site and for the path below it:
grouped aggregates over all documents give each site a Beta posterior shrunk toward the global rate, and each path one
shrunk toward its site, with prior strengths by the method of moments. A document's final log odds are its own
evidence plus ``site_weight`` times what its path's posterior says beyond the global rate, its own
share taken out. Sparse sites and paths thus say little.

The regression is fitted on at most FIT_ROWS labelled rows of the training folds (a documented bound); everything else
counts all documents.

Cases: null text is empty; null site or path is a group of its own; a label that is null is no label; with labels of one class
or none the evidence is the global rate (one half without labels) and all is kept at the default threshold; repeated rows count
each; an empty table gives no rows; extra columns are ignored by ``score`` and kept by ``keep_good``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placemill.llm.common import text_key, tidy, with_text, without, written

FIT_ROWS = 20_000
#: Kept at this probability of good quality and above: clean documents must not be lost for a doubt.
THRESHOLD = 0.5
SITE_WEIGHT = 0.5
MAX_STRENGTH = 1000.0
CLIP = 3.0

_CLASSES = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b"\t\r\x0b\x0c", b".", b",", b"!", b"?", b"|", b"#", b"%", b"$", b"&", b"*", b"@", b"<>", b"{}[]()", b"/\\", b"=+-_", b"\"'`", b";:", b"~^"]
_CLASS_OF = np.zeros(256, np.uint8)
for _k, _c in enumerate(_CLASSES, 1):
    _CLASS_OF[list(_c)] = _k
_CLASS_OF[128:] = len(_CLASSES) + 1
_N_CLASSES = len(_CLASSES) + 2
N_SHAPE = 13


def features(text: str) -> np.ndarray:
    """Fixed-length description of a whole text; a constant first."""
    raw = text.encode("utf-8", "replace")
    hist = np.bincount(_CLASS_OF[np.frombuffer(raw, np.uint8)], minlength=_N_CLASSES)
    words, lines = text.split(), text.split("\n")
    n = max(1, len(words))
    again = sum(map(eq, words, words[1:]))  # words that follow themselves
    most = max(Counter(words).values(), default=0)
    shape = [
        1.0, np.log1p(len(words)) / 10, len(raw) / n / 10, len(set(words)) / n, len(set(lines)) / len(lines),
        sum(map(str.isupper, words)) / n, sum([len(w) == 1 for w in words]) / n, sum(map(str.isalpha, words)) / n, np.log1p(n / len(lines)) / 5, again / n, np.sqrt(again / n), most / n, (len(words) - len(set(zip(words, words[1:])))) / n,
    ]
    return np.concatenate([shape, np.sqrt(hist / max(1, len(raw)))])


class Regression:
    """Weights over standardised features, each held within CLIP deviations: what training rows never showed decides nothing alone."""

    def __init__(self, centre: np.ndarray, spread: np.ndarray, weights: np.ndarray):
        self.centre, self.spread, self.weights = centre, spread, weights

    def standard(self, x: np.ndarray) -> np.ndarray:
        used = self.spread > 1e-9
        return np.where(used, np.clip((x - self.centre) / np.where(used, self.spread, 1), -CLIP, CLIP), 0.0)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.standard(x) @ self.weights


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 40) -> Regression:
    """Logistic regression by damped Newton steps, classes weighted evenly."""
    size = x.shape[1] if x.ndim == 2 else N_SHAPE + _N_CLASSES
    one = np.eye(1, size)[0]
    if len(y) == 0 or y.min() == y.max():
        rate = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
        return Regression(0 * one, one, one * np.log(rate / (1 - rate)))
    centre, spread = x.mean(axis=0), x.std(axis=0)
    centre[0], spread[0] = 0.0, 1.0  # the constant
    model = Regression(centre, spread, np.zeros(size))
    z = model.standard(x)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z / len(y) + ridge * np.eye(len(w))
        step = np.linalg.solve(h, z.T @ (weight * (y - p)) / len(y) - ridge * w)
        w += step * min(1.0, 4.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    model.weights = w
    return model


def training_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int, fold: Column) -> DataFrame:
    """Text and label of at most ``rows`` labelled documents of the fold, the same ones on each run.

    The choice is made on labels alone and is bounded, so it is broadcast and no text moves. Where doc_ids repeat, the sample is cut once more.
    """
    chosen = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("__id"), F.col(label).cast("int").alias("y")).filter(fold)
    chosen = chosen.orderBy(F.xxhash64("__id"), "__id", "y").limit(rows)
    sample = written(with_text(docs, "doc_id").join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).select("doc_id", "text", "y"), f"sample-{label}")
    return sample if sample.count() <= rows else written(sample.orderBy(F.xxhash64("doc_id", "text"), "doc_id", "y").limit(rows), f"sample-{label}")


def _model(docs: DataFrame, labels: DataFrame, rows: int) -> Regression:
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(x, pa.list_(pa.float64())), batch.column(2)], names=["id", "x", "y"])

    fold = F.pmod(F.crc32(F.col("__id").cast("string")), F.lit(3)) != 1
    got = training_rows(docs, labels, "quality", rows, fold).mapInArrow(tidy(fn), "id long, x array<double>, y int").toArrow().sort_by("id")
    y = got.column("y").to_numpy().astype(float)
    return fit(np.array(got.column("x").to_pylist(), float), y)


def evidence(docs: DataFrame, model: Regression, *keep: str) -> DataFrame:
    """The named columns and ``logit``, each document's own log odds."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            logits = [float(np.clip(model.logit(features(t.as_py())), -12, 12)) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(logits, pa.float64())], names=[*keep, "logit"])

    kept = with_text(docs, *keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(tidy(fn), f"{schema}, logit double")


def _strength(groups: DataFrame, centre: Column) -> Column:
    """Beta prior strength by the method of moments: the spread of groups beyond what their documents' own spread explains."""
    rate = F.col("s") / F.col("n")
    between = F.sum(F.col("n") * (rate - centre) ** 2) / F.sum("n")
    within = F.sum(F.col("v")) / F.sum("n")
    noise = within * F.count("*") / F.sum("n")
    spread = F.greatest(between - noise, F.lit(1e-9))
    return F.coalesce(F.least(F.greatest(within / spread, F.lit(1.0)), F.lit(MAX_STRENGTH)), F.lit(MAX_STRENGTH))


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def posteriors(scored: DataFrame, site_weight: float = SITE_WEIGHT) -> DataFrame:
    """``scored`` (doc_id, site, path, logit) with site and path posteriors and the final score."""
    p = 1 / (1 + F.exp(-F.col("logit")))
    scored = scored.withColumn("p", p)
    # per-path sums are the only ones over documents; sites and the globe add them up
    paths = written(scored.groupBy("site", "path").agg(F.sum("p").alias("s"), F.count("*").alias("n"), F.sum(F.col("p") * (1 - F.col("p")) + F.lit(1e-4)).alias("v")), "paths")
    sites = paths.groupBy("site").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.sum("v").alias("v"))
    total = paths.agg(F.coalesce(F.sum("s") / F.sum("n"), F.lit(0.5)).alias("m")).first().m
    of_sites = sites.agg(_strength(sites, F.lit(total)).alias("k")).first().k
    sites = sites.select(F.col("site").alias("s_site"), F.col("s").alias("s_s"), F.col("n").alias("s_n"), ((F.col("s") + of_sites * total) / (F.col("n") + of_sites)).alias("site_posterior"))
    joined = written(paths.join(sites, F.col("site").eqNullSafe(F.col("s_site"))), "sites")
    of_paths = joined.agg(_strength(joined, F.col("s_s") / F.col("s_n")).alias("k")).first().k
    both = joined.select(F.col("site").alias("g_site"), F.col("path").alias("g_path"), "s", "n", "s_s", "s_n", "site_posterior")
    own = scored.join(both, F.col("site").eqNullSafe(F.col("g_site")) & F.col("path").eqNullSafe(F.col("g_path"))).drop("g_site", "g_path")
    without = (F.col("s_s") - F.col("p") + of_sites * total) / (F.col("s_n") - 1 + of_sites)
    path_without = (F.col("s") - F.col("p") + of_paths * without) / (F.col("n") - 1 + of_paths)
    path_posterior = (F.col("s") + of_paths * F.col("site_posterior")) / (F.col("n") + of_paths)
    score = 1 / (1 + F.exp(-(F.col("logit") + site_weight * (_logit(path_without) - _logit(F.lit(total))))))
    more = [c for c in scored.columns if c not in ("doc_id", "site", "path", "logit", "p")]
    return own.select("doc_id", "site", "path", F.col("p").alias("doc_score"), "site_posterior", path_posterior.alias("path_posterior"), score.alias("score"), *more)


def score(docs: DataFrame, labels: DataFrame, site: str = "source", path: str = "lang", threshold: float = THRESHOLD, rows: int = FIT_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, site, path, doc_score, site_posterior, path_posterior, score, kept."""
    return _scored(docs, labels, site, path, threshold, rows).drop("key")


def _scored(docs: DataFrame, labels: DataFrame, site: str = "source", path: str = "lang", threshold: float = THRESHOLD, rows: int = FIT_ROWS) -> DataFrame:
    model = _model(docs, labels, rows)
    named = docs.select("doc_id", F.col(site).alias("site"), F.col(path).alias("path"), text_key().alias("key"), "text")
    scored = written(evidence(named, model, "doc_id", "site", "path", "key"), "evidence")
    return posteriors(scored).withColumn("kept", F.col("score") >= threshold)


def keep_good(docs: DataFrame, labels: DataFrame, **options: object) -> DataFrame:
    """``docs`` without the rows that the classifier rejects; rows that share doc_id and text, but not the site, go only if all of them are rejected."""
    found = _scored(docs, labels, **options)
    rejected = found.groupBy(F.col("doc_id").cast("long").alias("id"), "key").agg(F.bool_or("kept").alias("any")).filter("not any").select("id", "key")
    return without(docs, written(rejected, "rejected"))
