"""A Merkle manifest of a dataset: leaves by group and order, a tree a group, one tree over the groups' roots, and a proof for every leaf.

Nodes are lower-case hex sha256 digests. In a group the leaves stand in order, and every ``fan`` consecutive nodes (fewer at the end, even one)
become one, until one is left. The tree is built in aligned blocks of ``fan ** height`` nodes, which no run crosses: a block is a task's row, whatever the group, so a group
that holds most rows is many blocks. Within a block a recursive function walks in postorder: it returns a subtree's digest and, while unwinding, appends to each leaf of it the siblings of the
child that holds the leaf. The block's roots are the nodes of another such pass, distributed again, until each group has one node; these pass through it once more, as the leaves of the tree of groups.

Leaves walk twice: the first pass keeps a block's digest alone, the second, which knows what the levels above say of its block, keeps the siblings in memory until they are hashed, so
the proofs, which are many times the leaves, are never written. Numbering takes no window over a group: rows are sorted by range, numbered within each task, and a small table of counts a task says where it begins.

Cases: a null field is ``-``; an empty text is ``0:``; the null group is a group of its own and first; null doc_ids come first, and rows that repeat a doc_id follow each other by their leaves' digests (equal rows
are equal leaves in any order, each with a place and a proof of its own); a null doc_id is never tampered with; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placemill import ship
from placemill.llm.common import written

FAN = 8
#: Levels of a block: 4,096 leaves of some 150 bytes in one row.
HEIGHT = 4
#: Shape of a proof: for each level what stands before the node in its run and what stands after it, digests joined.
PATH = "array<struct<before: string, after: string>>"

Path = list[tuple[str, str]]


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def walk(nodes: list[str], at: int, level: int, fan: int, paths: list[Path] | None) -> str:
    """The digest of the subtree of ``level`` levels that begins at node ``at``; siblings go to the paths of the leaves it contains."""
    if level == 0:
        return nodes[at]
    step = fan ** (level - 1)
    starts = range(at, min(at + fan * step, len(nodes)), step)
    kids = [walk(nodes, k, level - 1, fan, paths) for k in starts]
    if paths is not None:
        for j, k in enumerate(starts):
            siblings = "".join(kids[:j]), "".join(kids[j + 1 :])
            for leaf in range(k, min(k + step, len(nodes))):
                paths[leaf].append(siblings)
    return digest("".join(kids))


def levels(total: int, fan: int, height: int) -> int:
    """How many levels a block has: all of them where its group has more than one block, else as many as lead to one node."""
    n, found = total, 0
    while n > 1 and found < height:
        n, found = -(-n // fan), found + 1
    return found


def fold(node: str, path: Path) -> str:
    """The root that a node and its siblings lead to."""
    for before, after in path:
        node = digest(before + node + after)
    return node


def field(c: Column) -> Column:
    """A value with its length in bytes."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column) -> Column:
    return F.sha2(F.concat(*(field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")), field(text)), 256)


def tampered_leaf(every: int = 3) -> Column:
    """Where the checksum of the doc_id says so, the leaf of the text with A-Z made small; else null."""
    small = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.crc32(F.col("doc_id").cast("string")) % every == 0, leaf(small))


def leaves(docs: DataFrame, every: int = 3) -> DataFrame:
    """``grp, at, digest, other``: the language, the doc_id, the leaf and the tampered leaf."""
    ship(docs.sparkSession)
    return docs.select(F.col("lang").alias("grp"), F.col("doc_id").cast("long").alias("at"), leaf(F.col("text")).alias("digest"), tampered_leaf(every).alias("other"))


def numbered(nodes: DataFrame, tag: str) -> DataFrame:
    """``nodes(grp, at, digest, ...)`` with ``pos``, from zero in each group by ``at`` and digest, and ``total``, the group's size."""
    names = nodes.columns

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, k = None, 0
        for batch in batches:
            found = []
            for g in batch.column(0).to_pylist():
                k = k + 1 if (g,) == group else 0
                group = (g,)
                found.append(k)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], names=[*names, "k"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema)
    # equal rows are told apart by where they were read, so that a range can end between them
    spread = nodes.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange("grp", "at", "digest", "tie")
    rows = spread.sortWithinPartitions("grp", "at", "digest").drop("tie").mapInArrow(fn, f"{fields}, k long").withColumn("task", F.spark_partition_id())
    rows = written(rows, tag)
    counts = rows.groupBy("grp", "task").agg(F.count("*").alias("n"))
    summed = written(
        counts.selectExpr("grp", "task", "coalesce(sum(n) over (partition by grp order by task rows between unbounded preceding and 1 preceding), 0) as before", "sum(n) over (partition by grp) as total"), f"{tag}_counts"
    )  # a row a task and group, as sorted tasks share few groups
    at = summed.select(F.col("grp").alias("c_grp"), F.col("task").alias("c_task"), "before", "total")
    joined = rows.join(at, F.col("grp").eqNullSafe(F.col("c_grp")) & (F.col("task") == F.col("c_task")))
    return joined.select(*names, (F.col("k") + F.col("before")).alias("pos"), "total")


def blocks(nodes: DataFrame, columns: list[str], size: int, tag: str) -> DataFrame:
    """A written row a block: ``grp, block, total, nodes``, the nodes in order."""
    some = nodes.select("grp", F.floor(F.col("pos") / size).alias("block"), "total", F.struct("pos", *columns).alias("node"))
    grouped = some.groupBy("grp", "block").agg(F.first("total").alias("total"), F.array_sort(F.collect_list("node")).alias("nodes"))
    return written(grouped, tag)


def roots(of: DataFrame, fan: int, height: int, tag: str) -> DataFrame:
    """The first pass: ``grp, at, digest`` of each block, at being its place in the group."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [walk(nodes, 0, levels(total, fan, height), fan, None) for total, nodes in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string())], names=["grp", "at", "digest"])

    return written(of.select("grp", "block", "total", "nodes.digest").mapInArrow(fn, "grp string, at long, digest string"), tag)


def climb(nodes: DataFrame, fan: int, height: int) -> tuple[DataFrame, DataFrame]:
    """``nodes(grp, pos, total, digest)``, no leaves of the dataset but what their blocks became -> ``grp, pos, path`` of each and ``grp, digest`` of each group.

    A pass makes one node of ``fan ** height``; a dataset of 10^12 leaves takes three.
    """
    size, passes = fan**height, []
    while True:
        single = nodes.filter("total = 1").select("grp", "digest")
        passes.append((None, single))
        if nodes.filter("total > 1").isEmpty():
            break
        grouped = blocks(nodes.filter("total > 1"), ["digest"], size, "blocks")

        def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for g, b, total, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    paths: list[Path] = [[] for _ in found]
                    root = walk(found, 0, levels(total, fan, height), fan, paths)
                    shown = [[{"before": x, "after": y} for x, y in p] for p in paths]
                    yield pa.RecordBatch.from_pylist([{"grp": g, "block": b, "total": total, "digest": root, "paths": shown}], WALKED)

        walked = written(grouped.select("grp", "block", "total", "nodes.digest").mapInArrow(fn, f"grp string, block long, total long, digest string, paths array<{PATH}>"), "walked")
        passes[-1] = (walked, single)
        nodes = walked.select("grp", F.col("block").alias("pos"), F.ceil(F.col("total") / size).alias("total"), "digest")
    tops = passes[0][1]
    for _, single in passes[1:]:
        tops = tops.union(single)
    paths = None
    for walked, single in reversed(passes):
        own = single.select("grp", F.lit(0).cast("long").alias("pos"), F.array().cast(PATH).alias("path"))
        if walked is not None:
            above = paths.select(F.col("grp").alias("u_grp"), F.col("pos").alias("u_pos"), F.col("path").alias("u_path"))
            met = walked.join(above, F.col("grp").eqNullSafe(F.col("u_grp")) & (F.col("block") == F.col("u_pos")))
            here = met.select("grp", "block", "u_path", F.posexplode("paths").alias("k", "p"))
            own = own.union(here.select("grp", (F.col("block") * size + F.col("k")).alias("pos"), F.concat("p", "u_path").alias("path")))
        paths = own
    return paths, tops


_STEPS = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
WALKED = pa.schema([("grp", pa.string()), ("block", pa.int64()), ("total", pa.int64()), ("digest", pa.string()), ("paths", pa.list_(_STEPS))])
PROVEN = [("doc_id", "long"), ("leaf", "string"), ("subroot", "string"), ("root", "string"), ("proof_sha256", "string"), ("folded_root", "string"), ("verified", "boolean")]


def manifest(docs: DataFrame, fan: int = FAN, height: int = HEIGHT, every: int = 3) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    size = fan**height
    # written before they are sorted, since sorting by range reads its input twice
    bottom = blocks(numbered(written(leaves(docs, every), "leaves"), "sorted"), ["at", "digest", "other"], size, "leaf_blocks")
    first = roots(bottom, fan, height, "block_roots")
    totals = bottom.select("grp", "block", F.ceil(F.col("total") / size).alias("total"))
    nodes = first.join(totals, first["grp"].eqNullSafe(totals["grp"]) & (first["at"] == totals["block"])).select(first["grp"], F.col("at").alias("pos"), "total", "digest")
    paths, tops = climb(written(nodes, "block_nodes"), fan, height)
    tops = written(tops, "subroots")
    # the tree of groups: one group whose nodes are the subroots, in order of their names
    named = numbered(tops.select(F.lit("").alias("grp"), F.struct(F.col("grp").isNotNull(), F.col("grp")).alias("at"), "digest"), "groups")
    ordered = written(named.select("grp", "pos", "total", "digest", F.col("at.grp").alias("name")), "ordered")
    up, top = climb(ordered.drop("name"), fan, height)
    over = ordered.select("grp", "pos", "name", F.col("digest").alias("subroot")).join(up.select("pos", F.col("path").alias("over")), "pos").join(top.select("grp", F.col("digest").alias("root")), "grp")
    over = written(over.select("name", "subroot", "over", "root"), "over")
    above = paths.join(over, paths["grp"].eqNullSafe(over["name"])).select(F.col("grp").alias("u_grp"), F.col("pos").alias("u_pos"), "subroot", F.concat("path", "over").alias("path"), "root")
    above = written(above, "above")

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, here, others, total, subroot, root, path in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own: list[Path] = [[] for _ in here]
                walk(here, 0, levels(total, fan, height), fan, own)
                rest = [(s["before"], s["after"]) for s in path]
                full = [[*p, *rest] for p in own]
                proofs = [digest("".join(x + y for x, y in p)) for p in full]
                folded = [fold(other or node, p) for node, other, p in zip(here, others, full, strict=True)]
                n = len(here)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(here), pa.array([subroot] * n), pa.array([root] * n), pa.array(proofs), pa.array(folded), pa.array([f == root for f in folded])], names=[n for n, _ in PROVEN])

    met = bottom.join(above, F.col("grp").eqNullSafe(F.col("u_grp")) & (F.col("block") == F.col("u_pos")))
    return met.select("nodes.at", "nodes.digest", "nodes.other", "total", "subroot", "root", "path").mapInArrow(fn, ", ".join(f"{n} {t}" for n, t in PROVEN))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, *, CAST(doc_id AS VARCHAR) AS i FROM documents),
h AS (SELECT r, doc_id, lang, text, coalesce(concat(strlen(i), ':', i), '-') || coalesce(concat(strlen(source), ':', source), '-') || coalesce(concat(strlen(lang), ':', lang), '-') || coalesce(concat(strlen(CAST(n_chars AS VARCHAR)), ':', n_chars), '-') AS head,
      xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, length(i) + 1), lambda k: CAST(ascii(i[k]) AS UBIGINT))),
          lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END))) AS crc FROM d),
l AS (SELECT r, doc_id, lang, sha256(head || coalesce(concat(strlen(text), ':', text), '-')) AS leaf,
      CASE WHEN crc % 3 = 0 THEN sha256(head || coalesce(concat(strlen(text), ':', translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')), '-')) END AS other FROM h),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS total FROM l),
n AS (SELECT lang AS grp, 0 AS lvl, pos, total, leaf AS digest FROM p
      UNION ALL SELECT grp, lvl + 1, pos // 8, (total + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos)) FROM n WHERE total > 1 GROUP BY grp, lvl, pos // 8, total),
s AS (SELECT grp AS lang, digest AS subroot, row_number() OVER (ORDER BY grp NULLS FIRST) - 1 AS pos, count(*) OVER () AS total FROM n WHERE total = 1),
t AS (SELECT 0 AS lvl, pos, total, subroot AS digest FROM s
      UNION ALL SELECT lvl + 1, pos // 8, (total + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos)) FROM t WHERE total > 1 GROUP BY lvl, pos // 8, total),
ns AS (SELECT grp, lvl, pos, coalesce(string_agg(digest, '') OVER (PARTITION BY grp, lvl, pos // 8 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before, coalesce(string_agg(digest, '') OVER (PARTITION BY grp, lvl, pos // 8 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after FROM n WHERE total > 1),
ts AS (SELECT lvl, pos, coalesce(string_agg(digest, '') OVER (PARTITION BY lvl, pos // 8 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before, coalesce(string_agg(digest, '') OVER (PARTITION BY lvl, pos // 8 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after FROM t WHERE total > 1),
steps AS (SELECT p.r, ns.lvl AS lvl, ns.before, ns.after FROM p JOIN ns ON p.lang IS NOT DISTINCT FROM ns.grp AND p.pos // CAST(pow(8, ns.lvl) AS BIGINT) = ns.pos
          UNION ALL SELECT p.r, 100 + ts.lvl, ts.before, ts.after FROM p JOIN s ON p.lang IS NOT DISTINCT FROM s.lang JOIN ts ON s.pos // CAST(pow(8, ts.lvl) AS BIGINT) = ts.pos),
path AS (SELECT r, row_number() OVER (PARTITION BY r ORDER BY lvl) AS k, before, after FROM steps),
f AS (SELECT r, CAST(0 AS BIGINT) AS k, coalesce(other, leaf) AS digest FROM l UNION ALL SELECT f.r, path.k, sha256(path.before || f.digest || path.after) FROM f JOIN path ON path.r = f.r AND path.k = f.k + 1),
folded AS (SELECT r, max_by(digest, k) AS folded_root FROM f GROUP BY r),
proof AS (SELECT r, sha256(string_agg(before || after, '' ORDER BY k)) AS proof_sha256 FROM path GROUP BY r),
top AS (SELECT digest AS root FROM t WHERE total = 1)
SELECT p.doc_id, p.leaf, s.subroot, top.root, coalesce(proof.proof_sha256, sha256('')) AS proof_sha256, folded.folded_root, folded.folded_root = top.root AS verified
FROM p JOIN s ON p.lang IS NOT DISTINCT FROM s.lang JOIN folded ON folded.r = p.r LEFT JOIN proof ON proof.r = p.r CROSS JOIN top
"""
