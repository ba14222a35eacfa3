"""Exact dedup by two-pass Bloom filtering, DataFrame functions only.

Pass one folds the hashes of all texts into a blocked Bloom filter: each hash sets one of 64 bits in
one block, and a block keeps the OR of its bits and how many rows it took. The fold is a map-side
combined aggregate of a few bytes a row, so a text that a third of the rows share costs one row a task. A block whose
bits are as many as its rows holds no repeat; the numbers of the other blocks become the filter of pass two, a bit
a block, in dense segments of SEGMENT blocks. One bit a hash is best here: a repeat can't be told from a collision, and more bits collide more.

In pass two every task tests its rows against the filter, which is broadcast in pieces of PIECE segments (64 MB): a row
whose bit is clear has no copy and passes straight through; only the others shuffle. The filter takes half a bit a
row, so a piece holds a thousand million rows; more rows mean more pieces, never another plan.

Cases: null text is empty text; equal texts are those identical without ASCII white space; ties in length go to
the smallest doc_id (null first); repeated rows with one doc_id count as copies of which one is kept; an
empty table gives no rows; extra columns of the input are ignored by ``assign`` and kept by ``keep_first``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placemill.llm.common import ASCII_SPACE, with_text, written

#: Rows a block on average: two in 64 bits make about one clean block in sixty look repeated.
ROWS_PER_BLOCK = 2
#: Blocks of a segment, a power of two; and segments that one broadcast carries, 512 bytes each.
SEGMENT = 1 << 12
PIECE = 1 << 17
#: Groups whose keepers are broadcast, some 100 bytes each; beyond it they meet the suspects by shuffle.
KEEPERS = 1 << 18


def normalised(text: Column) -> Column:
    for c in ASCII_SPACE:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _sha(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


def _digests(docs: DataFrame) -> DataFrame:
    text = with_text(docs, "doc_id")
    return text.select("doc_id", F.length("text").alias("points"), _sha(F.col("text")).alias("sha"), F.monotonically_increasing_id().alias("row"))


def _block(sha: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(sha), F.lit(blocks))


def _bit(sha: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftrightunsigned(F.xxhash64(sha), 48), F.lit(64)).cast("int"))


def block_count(rows: int) -> int:
    return max(1, -(-rows // ROWS_PER_BLOCK))


def repeated_blocks(digests: DataFrame, blocks: int) -> DataFrame:
    """Pass one: the blocks in which some hash may be repeated."""
    return (
        digests.select(_block(F.col("sha"), blocks).alias("block"), _bit(F.col("sha")).alias("bit"))
        .groupBy("block")
        .agg(F.bit_or("bit").alias("bits"), F.count("*").alias("n"))
        .filter(F.bit_count("bits") < F.col("n"))
        .select("block")
    )


class Filter:
    """The filter of pass two: written ``segments(segment, words)``, a bit for each block, and what it takes to test rows."""

    def __init__(self, digests: DataFrame, piece: int = PIECE):
        self.blocks = block_count(digests.count())
        self.piece = piece
        word = repeated_blocks(digests, self.blocks).groupBy(F.shiftright("block", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("block").bitwiseAND(F.lit(63)).cast("int"))).alias("bits"))
        places = SEGMENT // 64
        one = F.map_from_entries(F.collect_list(F.struct(F.col("word").bitwiseAND(F.lit(places - 1)).cast("int").alias("at"), "bits")))
        segments = word.groupBy(F.shiftright("word", places.bit_length() - 1).alias("segment")).agg(one.alias("m"))
        dense = F.transform(F.sequence(F.lit(0), F.lit(places - 1)), lambda k: F.coalesce(F.element_at("m", k), F.lit(0).cast("long")))
        self.segments = written(segments.select("segment", dense.alias("words")), "bloom")

    def test(self, rows: DataFrame) -> DataFrame:
        """``rows(sha, ...)`` with ``hit``: whether the row may have a copy. No row moves."""
        rows = rows.withColumn("block", _block(F.col("sha"), self.blocks))
        hit = F.lit(False)
        for k, first in enumerate(range(0, -(-self.blocks // SEGMENT), self.piece)):
            some = self.segments.filter((F.col("segment") >= first) & (F.col("segment") < first + self.piece))
            rows = rows.join(F.broadcast(some.select(F.col("segment").alias(f"s{k}"), F.col("words").alias(f"w{k}"))), F.shiftright("block", SEGMENT.bit_length() - 1) == F.col(f"s{k}"), "left")
            word = F.element_at(f"w{k}", (F.shiftright("block", 6).bitwiseAND(F.lit(SEGMENT // 64 - 1)) + 1).cast("int"))
            bit = F.call_function("shiftrightunsigned", word, F.col("block").bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1).cast("long"))
            hit = hit | F.coalesce(bit == 1, F.lit(False))
        return rows.withColumn("hit", hit)


def _keepers(suspects: DataFrame) -> tuple[DataFrame, bool]:
    """Of each text: sha, group_size, keep_id, keep_row and how many rows the kept doc_id has in the group; and whether they are few."""
    by_id = suspects.groupBy("sha", "doc_id").agg(F.min(F.struct((-F.col("points")).alias("p"), "row")).alias("b"), F.count("*").alias("same"))
    best = F.min(F.struct("b.p", "doc_id", "b.row", "same")).alias("best")
    whole = by_id.groupBy("sha").agg(best, F.sum("same").alias("group_size"))
    # written apart, so that a join with it has a shuffle of its own, whose hot partitions Spark can split
    found = written(whole.select("sha", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), F.col("best.same").alias("same")), "keepers")
    return found, found.count() <= KEEPERS


def assign(docs: DataFrame, piece: int = PIECE) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    digests = written(_digests(docs), "digests")
    at = Filter(digests, piece).test(digests)
    suspects = at.filter("hit")
    keepers, few = _keepers(suspects)
    settled = suspects.join(F.broadcast(keepers) if few else keepers, "sha").select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "sha")
    return passed(at).union(settled).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def passed(at: DataFrame) -> DataFrame:
    """The rows of ``assign`` that pass straight through."""
    return at.filter("not hit").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")


def keep_first(docs: DataFrame, piece: int = PIECE, keepers_sent: bool | None = None) -> DataFrame:
    """``docs`` without all but one of each group of equal texts; rows that the filter clears never shuffle.

    Where the keepers are few, they are sent and no row shuffles at all.
    """
    digests = written(_digests(docs), "digests")
    bloom = Filter(digests, piece)
    keepers, few = _keepers(bloom.test(digests).filter("hit"))
    few = few if keepers_sent is None else keepers_sent
    again = not keepers.filter("same > 1").isEmpty()
    # the columns of docs travel in one struct, so no name of theirs can clash
    at = bloom.test(docs.select(F.struct("*").alias("whole"), F.col("doc_id").alias("id"), _sha(F.coalesce(docs["text"], F.lit(""))).alias("sha")))
    kept = keepers.select(F.col("sha").alias("k_sha"), "keep_id", "same")
    # the key holds the doc_id too, so copies of one text spread over all tasks
    match = (F.col("sha") == F.col("k_sha")) & F.col("id").eqNullSafe(F.col("keep_id"))
    if few:
        joined = at.join(F.broadcast(kept), match, "left")
        out = joined.filter("not hit or same = 1").select("whole.*")
        won = joined.filter("same > 1")
    else:
        joined = at.filter("hit").join(kept, match)
        out = at.filter("not hit").select("whole.*").union(joined.filter("same = 1").select("whole.*"))
        won = joined.filter("same > 1")
    # of rows that share text and doc_id the one with most code points stays, then the greatest text, so a rerun keeps the same
    order = F.struct(F.length("whole.text"), "whole.text", F.xxhash64(F.to_json("whole")))
    return out.union(won.groupBy("sha", "id").agg(F.max_by("whole", order).alias("whole")).select("whole.*")) if again else out


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, length(t) AS points, sha256(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS sha FROM d),
g AS (SELECT *, count(*) OVER (PARTITION BY sha) AS group_size,
      first_value(doc_id) OVER (PARTITION BY sha ORDER BY points DESC, doc_id) AS keep_id FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha AS text_sha256 FROM g
"""
