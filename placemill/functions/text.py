"""Names, dictionary matching, cells: text functions whose results other systems must agree on."""

from __future__ import annotations

import math
import re
import unicodedata
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Legal forms and the article that a name loses.
LEGAL_WORDS = "inc llc ltd corp co company the".split()
_LEGAL = re.compile(rf"\b(?:{'|'.join(LEGAL_WORDS)})\b", re.ASCII)
_MARKS = re.compile("[̀-ͯ]")


def _plain(text: str) -> str:
    return _MARKS.sub("", unicodedata.normalize("NFKD", text.lower()))


def normalised_name(name: str | None) -> str | None:
    """Case, accents, legal forms and all but letters and digits removed."""
    return None if name is None else re.sub("[^a-z0-9]", "", _LEGAL.sub("", _plain(name)))


def normalised_phrase(text: str | None) -> str | None:
    """Case and accents removed, words of letters and digits parted by single spaces."""
    return None if text is None else " ".join(re.sub("[^a-z0-9 ]", " ", _plain(text)).split())


def fixed(value: float | None, digits: int = 4) -> str | None:
    """Decimal notation of the exact binary value, halves away from zero."""
    if value is None or not math.isfinite(value):
        return None
    return str(Decimal(value if value else 0.0).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


def number_text(value: float | int | None) -> str | None:
    """Shortest decimal text; whole numbers without a point, exponents only beyond 1e21 and below 1e-6."""
    if value is None:
        return None
    if isinstance(value, int):
        return str(value)
    if math.isnan(value):
        return "NaN"
    if math.isinf(value):
        return "Infinity" if value > 0 else "-Infinity"
    if value == 0:
        return "0"
    sign, digits, exponent = Decimal(repr(value)).normalize().as_tuple()
    text, point = "".join(map(str, digits)), len(digits) + exponent
    if -6 < point <= 21:
        if point <= 0:
            body = "0." + "0" * -point + text
        elif point >= len(text):
            body = text + "0" * (point - len(text))
        else:
            body = f"{text[:point]}.{text[point:]}"
    else:
        e = point - 1
        body = text[0] + ("." + text[1:] if len(text) > 1 else "") + f"e{'+' if e > 0 else '-'}{abs(e)}"
    return "-" * sign + body


@F.pandas_udf(T.StringType())
def normalised_name_of(s: pd.Series) -> pd.Series:
    return s.map(normalised_name, na_action="ignore")


@F.pandas_udf(T.StringType())
def normalised_phrase_of(s: pd.Series) -> pd.Series:
    return s.map(normalised_phrase, na_action="ignore")


@F.pandas_udf(T.StringType())
def fixed4_of(s: pd.Series) -> pd.Series:
    return s.map(fixed, na_action="ignore").astype(object)


@F.pandas_udf(T.StringType())
def number_text_of(s: pd.Series) -> pd.Series:
    return s.map(number_text, na_action="ignore").astype(object)


def subsequence_span(query: Column, text: Column) -> Column:
    """Length of the leftmost stretch of ``text`` that holds the characters of ``query`` in order, taken greedily; null if it doesn't."""
    walk = F.aggregate(
        F.filter(F.split(query, ""), lambda c: c != ""),
        F.struct(F.lit(0).alias("at"), F.lit(0).alias("start"), F.lit(True).alias("ok")),
        lambda s, c: _step(s, c, text),
    )
    return F.when(walk.ok, F.when(walk.start == 0, 0).otherwise(walk.at - walk.start + 1))


def _step(s: Column, c: Column, text: Column) -> Column:
    found = F.call_function("locate", c, text, s.at + 1)
    return F.when(s.ok & (found > 0), F.struct(found.alias("at"), F.when(s.start == 0, found).otherwise(s.start).alias("start"), F.lit(True).alias("ok"))).otherwise(F.struct(s.at.alias("at"), s.start.alias("start"), F.lit(False).alias("ok")))


def typo_budget(length: Column) -> Column:
    return F.when(length <= 4, 1).when(length <= 7, 2).otherwise(3)


def edit_distance_within(a: Column, b: Column, most: Column) -> Column:
    """Levenshtein distance, null beyond ``most``."""
    distance = F.levenshtein(a, b)
    return F.when(distance <= most, distance)


# Points of each kind of match, and what length and distance take off them.
WHOLE, BEGINS, WORD_BEGINS, HOLDS, TYPO, SUBSEQUENCE = 1000.0, 800, 600, 400, 300, 150
A_WORD, A_LETTER, AN_EDIT, A_LETTER_OF_A_TYPO = 10, 0.5, 40, 0.1


def match_score(query: Column, norm: Column, words: Column) -> Column:
    """How well a dictionary entry answers a query, both normalised: whole, beginning, beginning of a word, part, typo, subsequence; 0 if not at all."""
    length = F.length(norm)
    brevity = F.size(words) * A_WORD + length * A_LETTER
    distance = F.array_min(F.transform(words, lambda w: F.when(F.abs(F.length(w) - F.length(query)) <= 3, edit_distance_within(query, w, typo_budget(F.length(query))))))
    span = subsequence_span(F.replace(query, F.lit(" "), F.lit("")), F.replace(norm, F.lit(" "), F.lit("")))
    return (
        F.when(query == "", 0.0)
        .when(norm == query, WHOLE)
        .when(F.startswith(norm, query), BEGINS - brevity)
        .when(F.exists(words, lambda w: F.startswith(w, query)), WORD_BEGINS - brevity)
        .when(F.contains(norm, query), HOLDS - brevity)
        .when(distance.isNotNull(), TYPO - distance * AN_EDIT - length * A_LETTER_OF_A_TYPO)
        .when((F.length(query) >= 4) & span.isNotNull(), SUBSEQUENCE - span)
        .otherwise(0.0)
        .cast("double")
    )


def slug(label: Column | str, most: int = 50, fallback: str = "export") -> Column:
    """Lower case, runs of other characters to one hyphen, hyphens at the ends dropped, then cut."""
    c = F.lit(label) if isinstance(label, str) else label
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-|-$", ""), 1, most), F.lit("")), F.lit(fallback))


def risks_formula(value: Column) -> Column:
    """A spreadsheet might run it: phone numbers and negative numbers do not count."""
    return F.rlike(value, F.lit(r"^(?:[=@\t\r]|[+\-][A-Za-z(|])"))


def csv_cell(value: Column) -> Column:
    """RFC 4180 quoting, with a tab before what a spreadsheet might run."""
    value = F.coalesce(value, F.lit(""))
    body = F.when(risks_formula(value), F.concat(F.lit("\t"), value)).otherwise(value)
    return F.when(F.rlike(body, F.lit('[",\n\r]')), F.concat(F.lit('"'), F.replace(body, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(body)


def cell_text(column: Column, kind: str) -> Column:
    """Text of a value of a Spark type: nested values as JSON with their nulls."""
    if kind == "string":
        return column
    if kind in ("double", "float"):
        return number_text_of(column.cast("double"))
    if kind == "boolean":
        return F.when(column, "true").when(~column, "false")
    if kind.startswith(("struct", "array", "map")):
        return F.to_json(column, {"ignoreNullFields": "false"})
    if kind == "variant":
        return F.to_json(column)
    return column.cast("string")
