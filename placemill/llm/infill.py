"""Fill-in-middle: a text is cut into units, two of their ends split it into prefix, middle and suffix, and these change places.

Units are the matches of a pattern, lines by default. ``regex.finditer`` puts the units' ends into a compact array; two looked-up ends slice
the text, whatever its length. Where to cut, whether and in which order is drawn from the sha256 of seed and doc_id, so a rerun gives the same rows.

Forms: ``psm`` is prefix, suffix, middle; ``spm`` is suffix, prefix, middle; ``plain`` is the text itself, of which nothing is cut: an empty text, one that
holds one of the three marks (its parts could not be told apart), or one that the rate leaves out. ``restore`` gives the text back from output and form.

Cases: null text is empty text and plain; a text without any unit is plain, as nothing can be cut; where both cuts fall on one end the middle is empty; a null doc_id is
drawn like the word ``null``; repeated rows get equal outputs; an empty table gives no rows; ``transform`` keeps all columns, whatever
their names, and ``digests`` reads only doc_id and text.
"""

from __future__ import annotations

import hashlib
from array import array
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placemill import ship
from placemill.llm.common import with_text

LINES = r"[^\n]*\n|[^\n]+"
MARKS = ("<P>", "<S>", "<M>")


@dataclass(frozen=True)
class Rule:
    """How texts are cut: ``rate`` and ``spm_rate`` are percentages, of texts that are cut and of those that get the suffix first."""

    pattern: str = LINES
    seed: int = 7
    rate: int = 100
    spm_rate: int = 50


def draws(seed: int, doc_id: int | None) -> list[int]:
    """Four unsigned 32-bit numbers."""
    hexed = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(hexed[8 * k : 8 * k + 8], 16) for k in range(4)]


def ends_of(text: str, units: regex.Pattern) -> array:
    """Where each unit ends, in code points; zero first."""
    ends = array("Q", [0])
    ends.extend(m.end() for m in units.finditer(text))
    return ends


def cut(doc_id: int | None, text: str, units: regex.Pattern, rule: Rule) -> tuple[int, str, int | None, int | None, str]:
    """Number of units, form, code points of prefix and middle, output."""
    ends = ends_of(text, units)
    n = len(ends) - 1
    h1, h2, h3, h4 = draws(rule.seed, doc_id)
    if n == 0 or any(mark in text for mark in MARKS) or h3 % 100 >= rule.rate:
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = ends[low], ends[high]
    prefix, middle, suffix = f"<P>{text[:a]}", f"<M>{text[a:b]}", f"<S>{text[b:]}"
    return (n, "spm", a, b - a, suffix + prefix + middle) if h4 % 100 < rule.spm_rate else (n, "psm", a, b - a, prefix + suffix + middle)


def restore(output: str, form: str) -> str:
    """The text that an output was made of. No mark occurs in it, so the first of each in the output is its own."""
    if form == "plain":
        return output
    first, last = ("<P>", "<S>") if form == "psm" else ("<S>", "<P>")
    head, _, middle = output.removeprefix(first).partition("<M>")
    one, _, two = head.partition(last)
    return one + middle + two if form == "psm" else two + middle + one


SHAPE = T.StructType(
    [
        T.StructField("n", T.LongType()),
        T.StructField("form", T.StringType()),
        T.StructField("prefix_chars", T.LongType()),
        T.StructField("middle_chars", T.LongType()),
    ]
)
OUTPUT = T.StructType([*SHAPE.fields, T.StructField("output", T.StringType())])
DIGESTS = T.StructType([*SHAPE.fields, T.StructField("output_sha256", T.StringType()), T.StructField("restored_sha256", T.StringType())])


def _frame(rows: list[tuple], shape: T.StructType) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=shape.names)
    return out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})


def _ids(ids: pd.Series) -> list[int | None]:
    return [None if pd.isna(i) else int(i) for i in ids]


def infilled(doc_id: Column, text: Column, rule: Rule | None = None) -> Column:
    """Struct of n, form, prefix_chars, middle_chars and the output."""
    rule = rule or Rule()

    @F.pandas_udf(OUTPUT)
    def fn(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        units = regex.compile(rule.pattern)
        return _frame([cut(i, t, units, rule) for i, t in zip(_ids(ids), texts, strict=True)], OUTPUT)

    return fn(doc_id.cast("string"), F.coalesce(text, F.lit("")))


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def digested(doc_id: Column, text: Column, rule: Rule | None = None) -> Column:
    """The same with digests of the output and of the text restored from it in place of the output, so no text goes back."""
    rule = rule or Rule()

    @F.pandas_udf(DIGESTS)
    def fn(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        units, rows = regex.compile(rule.pattern), []
        for i, t in zip(_ids(ids), texts, strict=True):
            *shape, output = cut(i, t, units, rule)
            rows.append((*shape, _sha(output), _sha(restore(output, shape[1]))))
        return _frame(rows, DIGESTS)

    return fn(doc_id.cast("string"), F.coalesce(text, F.lit("")))


def transform(docs: DataFrame, rule: Rule | None = None) -> DataFrame:
    """``docs`` with its texts transformed, all columns as they were: training rows."""
    ship(docs.sparkSession)
    out = docs.select(F.struct("*").alias("whole"), infilled(docs["doc_id"], docs["text"], rule).alias("made"))
    return out.select(*(F.col("made.output").alias(c) if c == "text" else F.col("whole").getField(c).alias(c) for c in docs.columns))


def digests(docs: DataFrame, rule: Rule | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    rows = with_text(docs, "doc_id")
    return rows.select("doc_id", digested(F.col("doc_id"), F.col("text"), rule).alias("made")).select("doc_id", "made.*")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256(concat('7:', coalesce(CAST(doc_id AS VARCHAR), 'null'))) AS s FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS units FROM d),
h AS (SELECT *, len(units) AS n, CAST(concat('0x', s[1:8]) AS BIGINT) AS h1, CAST(concat('0x', s[9:16]) AS BIGINT) AS h2, CAST(concat('0x', s[25:32]) AS BIGINT) AS h4,
      t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') AS plain FROM u),
k AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high FROM h),
p AS (SELECT *, CASE WHEN plain THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
      array_to_string(units[1:low], '') AS prefix, array_to_string(units[low + 1:high], '') AS middle, array_to_string(units[high + 1:n], '') AS suffix FROM k)
SELECT doc_id, n, form, CASE WHEN NOT plain THEN length(prefix) END AS prefix_chars, CASE WHEN NOT plain THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN concat('<P>', prefix, '<S>', suffix, '<M>', middle) ELSE concat('<S>', suffix, '<P>', prefix, '<M>', middle) END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN t ELSE concat(prefix, middle, suffix) END) AS restored_sha256
FROM p
"""
