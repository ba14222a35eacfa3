"""Mixing sources to target weights by pivotal dependent rounding.

Each source's target share of all words is divided by its size: so many copies of each of its documents
are wanted, of which the whole part is certain and the fraction is a probability. Pivotal rounding makes
the fractions whole: two documents meet, one gives all it can to the other at random, one of them leaves
with 0 or 1 and the other goes on. Leaves of the reduction tree are buckets of a source; each leaves
at most one undecided document, and these meet in ever fewer buckets until one is left a source.
What moves between two documents is words, so a source's expected words are kept to the end but for
its last undecided document.

Cases: null text is empty, size 0; null source is a source, last; a source of size 0 takes nothing; an
empty table gives no rows; repeated rows are documents of their own; other columns are ignored by
``mix`` and kept by ``mixed``. Draws are hashes of doc_ids and a seed, so reruns agree.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placemill.llm.common import SENT_ROWS, WORD, written

#: Documents that meet in one bucket of the tree.
FAN_IN = 4096
#: No source, and no document, is taken more often than this.
MOST = 3
WEIGHTS = (1, 2, 3)


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``sizes(source, size)`` -> one row a source: source, n, source_size, target.

    The water level of targets under caps in closed form: by cap per weight, a source is capped while
    its share of what the capped ones before it leave is above its cap. One row a source reaches the window.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("w", w.cast("double")).withColumn("cap", F.col("source_size") * float(most))
    whole = Window.partitionBy()
    by_cap = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    per = per.withColumn("level", (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), zero)) / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), zero)))
    per = per.withColumn("open", F.col("cap") >= F.col("w") * F.col("level")).withColumn("at", F.row_number().over(by_cap))
    level = F.min_by(F.when(F.col("open"), F.col("level")), F.when(F.col("open"), F.col("at"))).over(whole)
    return per.select("source", "n", "source_size", F.when(F.col("open"), F.col("w") * level).otherwise(F.col("cap")).alias("target"))


def pivot(p: np.ndarray, size: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, int]:
    """Pivotal rounding of ``p`` in its order: the values, all 0 or 1 but that at the returned index (-1: none).

    What two documents exchange is words, so the expected words of all stay exactly the same; the odds of
    the two directions keep each document's own expectation. A document without words is drawn on its own.
    """
    out, i, eps = p.copy(), -1, 1e-9
    for j in range(len(p)):
        q = out[j]
        if q <= eps or q >= 1 - eps:
            out[j] = round(q)
        elif size[j] == 0:
            out[j] = float(draws[j] < q)
        elif i < 0:
            i = j
        else:
            to_i = min((1 - out[i]) * size[i], q * size[j])
            to_j = min(out[i] * size[i], (1 - q) * size[j])
            moved = to_i if draws[j] * (to_i + to_j) < to_j else -to_j
            out[i] += moved / size[i]
            out[j] -= moved / size[j]
            for k in (i, j):
                if out[k] <= eps or out[k] >= 1 - eps:
                    out[k] = round(out[k])
            i = next((k for k in (i, j) if 0 < out[k] < 1), -1)
    return out, i


def _draws(rows: np.ndarray, seed: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(str(r), seed) for r in rows.tolist()], dtype=np.uint64) / 2.0**64


def _meet(seed: int, last: bool):
    def fn(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.assign(draw=_draws(batch["key"].to_numpy(), seed)).sort_values(["size", "draw", "key"], ascending=[False, True, True], kind="stable")
        p, left = pivot(batch["p"].to_numpy(float), batch["size"].to_numpy(float), batch["draw"].to_numpy())
        if left >= 0 and last:
            p[left] = float(_draws(batch["key"].to_numpy()[left : left + 1], seed + 1)[0] < p[left])
            left = -1
        open_ = np.zeros(len(p), bool)
        if left >= 0:
            open_[left] = True
        return batch.assign(p=p, open=open_).drop(columns="draw")

    return fn


def mix(docs: DataFrame, seed: int = 17, fan_in: int = FAN_IN) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, copies, taken."""
    sizes = written(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "sizes")
    targets = written(source_targets(sizes), "targets")
    wanted = F.least(F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0)), F.lit(float(MOST)))
    key = F.coalesce(F.col("doc_id"), F.lit(-1).cast("long"))
    leaves = sizes.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("wanted", wanted)
    leaves = leaves.select(
        "doc_id", "source", "size", "source_size", "target", F.floor("wanted").cast("long").alias("whole"), (F.col("wanted") - F.floor("wanted")).alias("p"), key.alias("key"),
        F.pmod(F.xxhash64(key, F.lit(seed)), F.ceil(F.col("n") / fan_in)).cast("long").alias("bucket"), F.lit(True).alias("open"),
    )
    buckets = -(-int(targets.agg(F.max("n")).first()[0] or 0) // fan_in)
    done, level = [], 0
    while True:
        last = buckets <= 1
        met = written(leaves.groupBy("source", "bucket").applyInPandas(_meet(seed + 2 * level, last), leaves.schema), "pivot")
        done.append(met.filter("not open"))
        if last:
            break
        leaves, buckets, level = met.filter("open").withColumn("bucket", F.floor(F.col("bucket") / fan_in)), -(-buckets // fan_in), level + 1
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    copies = F.col("whole") + F.round("p").cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, seed: int = 17, most: int = SENT_ROWS) -> DataFrame:
    """``docs`` with each row as often as the mix takes it; rows that share a doc_id share the count.

    A plan of at most ``most`` rows of a doc_id and a count goes to the documents; a longer one meets them by shuffle, where doc_ids spread over all tasks.
    """
    plan = written(mix(docs, seed).groupBy("doc_id").agg(F.max("copies").cast("int").alias("copies")).filter("copies > 0"), "plan")
    plan = F.broadcast(plan) if plan.count() <= most else plan.hint("merge")
    # the columns of docs travel in one struct, so no name of theirs can clash
    joined = docs.select(F.struct("*").alias("whole"), F.col("doc_id").alias("id")).join(plan, F.col("id").eqNullSafe(F.col("doc_id")))
    return joined.select("whole", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("whole.*")
