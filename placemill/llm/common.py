"""What the operators of this subpackage share: tables in and out, Arrow slices, connected components."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placemill import ship
from placemill.storage import shared_dir, written

__all__ = ["ASCII_SPACE", "SENT_ROWS", "WORD", "connected_components", "keyed", "parts", "read_table", "sent", "shared_dir", "text_key", "tidy", "with_text", "without", "written"]

#: ASCII white space as every contract here names it: ``[\x20\x09-\x0D]``; a word is a run of other characters.
ASCII_SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of row keys and numbers, some 50 bytes each, that a broadcast may carry; more meet the documents by shuffle.
SENT_ROWS = 1 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_text(docs: DataFrame, *keep: str) -> DataFrame:
    """Only the named columns and ``text`` with null as empty, so other columns can't clash."""
    ship(docs.sparkSession)
    return docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("text"))


def text_key(text: str = "text") -> Column:
    """What tells texts apart beside the doc_id."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def keyed(docs: DataFrame) -> DataFrame:
    """``whole``, all columns in one struct so that no name can clash, ``id`` and ``key``: doc_id and text_key."""
    return docs.select(F.struct("*").alias("whole"), F.col("doc_id").cast("long").alias("id"), text_key().alias("key"))


def sent(keys: DataFrame, most: int = SENT_ROWS) -> DataFrame:
    """Written rows of keys as a broadcast if they are few, so that what they are joined with is not shuffled for them; longer lists as they are."""
    return F.broadcast(keys) if keys.count() <= most else keys


def without(docs: DataFrame, dropped: DataFrame, most: int = SENT_ROWS) -> DataFrame:
    """``docs`` but for the rows that written ``dropped(id, key)`` names; null ids are equal."""
    gone = dropped.select(F.col("id").alias("d_id"), F.col("key").alias("d_key"))
    gone = F.broadcast(gone) if dropped.count() <= most else gone
    return keyed(docs).join(gone, F.col("id").eqNullSafe(F.col("d_id")) & (F.col("key") == F.col("d_key")), "left_anti").select("whole.*")


def one_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with one row, that of the smallest doc_id and then text key, of each component of ``found(id, key, component)``.

    Rows without a doc_id stay. Of rows that repeat both doc_id and text one stays.
    """
    named = found.filter("id is not null")
    sums = named.groupBy("component", "id", "key").agg(F.count("*").alias("n"))
    best = written(sums.groupBy("component").agg(F.min(F.struct("id", "key", "n")).alias("b"), F.sum("n").alias("rows")).filter("rows > 1"), "best")
    rest = named.join(best.select("component", "b"), "component").filter("not (id = b.id and key = b.key)")
    out = without(docs, written(rest.select("id", "key").distinct(), "dropped"))
    again = best.filter("b.n > 1").select("b.id", "b.key")
    if again.isEmpty():
        return out
    again = written(again, "repeated").select(F.col("id").alias("r_id"), F.col("key").alias("r_key"))
    at, match = keyed(out), (F.col("id") == F.col("r_id")) & (F.col("key") == F.col("r_key"))
    return at.join(again, match, "left_anti").select("whole.*").union(at.join(again, match, "left_semi").dropDuplicates(["id", "key"]).select("whole.*"))


def parts(batch: pa.RecordBatch, rows: int, size: int, column: int = 1) -> Iterator[pa.RecordBatch]:
    """Slices of an Arrow batch of at most ``rows`` rows whose text column has about ``size`` bytes, one row at least."""
    lens = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at = 0
    while at < batch.num_rows:
        n, total = 0, 0
        while at + n < batch.num_rows and n < rows and (n == 0 or total + lens[at + n] <= size):
            total += int(lens[at + n])
            n += 1
        yield batch.slice(at, n)
        at += n


def tidy(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same batches; Arrow's unused memory goes back after each and all that is free at the end, as workers outlive tasks."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one_by_one() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch
                del batch
                pa.default_memory_pool().release_unused()

        yield from fn(one_by_one())
        gc.collect()
        pa.default_memory_pool().release_unused()

    return wrapped


#: With more edges, a node's minimum is written before it meets the edges; a hub of fewer is no burden for one task.
HUB_EDGES = 1 << 20


def connected_components(edges: DataFrame, max_rounds: int = 60, hub_edges: int = HUB_EDGES) -> DataFrame:
    """``edges(a, b)`` of longs -> ``(node, component)``: the smallest node reachable; only nodes on edges.

    Alternates large-star and small-star (Kiveris et al. 2014), whose star forest converges in a
    logarithmic number of rounds; each round is written, so lineage stays short. The minimum at a
    node is a map-side-combined aggregate, so no node's neighbours are ever gathered in one task.
    It ends once every node points to one other and none that is pointed to points on: each star is a
    component then, and its centre, smaller than all that point to it, the least of it.
    """
    def undirected(e: DataFrame) -> DataFrame:
        return e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def star(e: DataFrame, large: bool) -> DataFrame:
        # large: each strictly larger neighbour joins the least of node and neighbours;
        # small: node and its smaller neighbours join the least of them
        both = undirected(e) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        if size > hub_edges:  # written apart, so that the join has a shuffle of its own, in which Spark can split a hub's rows
            least = written(least, "least")
        joined = both.join(least, "a")
        if large:
            out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        return out.filter("a <> b")

    def unfinished(e: DataFrame) -> DataFrame:
        ends = e.select("a", F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select(F.col("b").alias("a"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        return ends.groupBy("a").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or up > 0 and down > 0")

    current = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    size = current.count()
    for _ in range(max_rounds):
        if size == 0 or unfinished(current).isEmpty():
            break
        current = written(star(star(current, True), False).distinct(), "stars")
        size = current.count()
    else:
        raise RuntimeError(f"components have not converged in {max_rounds} rounds")
    roots = current.select(F.col("b").alias("node")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("node", F.col("node").alias("component")))
