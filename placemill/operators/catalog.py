"""Dictionary and gazetteer: fuzzy category search, city search, labels and geocoder queries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placemill.functions.text import edit_distance_within, match_score, normalised_phrase, normalised_phrase_of, typo_budget
from placemill.storage import written

CATEGORY_LIMIT, CITY_LIMIT = 12, 8
PREFIX_BONUS = 1_000_000


def dictionary(names: DataFrame) -> DataFrame:
    """``names(name)`` -> name, norm, words; normalised once and kept by the caller."""
    norm = names.select("name", normalised_phrase_of(F.col("name")).alias("norm"))
    return norm.withColumn("words", F.split("norm", " "))


def search_categories(entries: DataFrame, text: str, limit: int = CATEGORY_LIMIT) -> DataFrame:
    """Best entries for one query: name, score."""
    asked = F.lit(normalised_phrase(text) or "")
    scored = entries.select("name", match_score(asked, F.col("norm"), F.col("words")).alias("score")).filter("score > 0")
    return scored.orderBy(F.desc("score"), F.collate("name", "UNICODE"), "name").limit(limit)


def _grams(text: Column) -> Column:
    """All pieces of one to three characters."""
    of = lambda n: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substr(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(of(1), of(2), of(3)))


def _longest_grams(text: Column) -> Column:
    """Those of them that are as long as they can be: a text that holds another holds all of these."""
    most = F.least(F.length(text), F.lit(3))
    return F.filter(_grams(text), lambda g: F.length(g) == most)


def _ordered_pairs(text: Column) -> Column:
    """Each two characters of which one stands somewhere after the other."""
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    return F.array_distinct(F.flatten(F.transform(letters, lambda c, i: F.transform(F.slice(letters, i + 2, F.size(letters)), lambda d: F.concat(c, d)))))


def _steps(text: Column) -> Column:
    """Each two characters that follow each other."""
    return F.array_distinct(F.when(F.length(text) >= 2, F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substr(text, i, F.lit(2)))).otherwise(F.array().cast("array<string>")))


def _with_deletions(words: DataFrame, most: int) -> DataFrame:
    """``words(word, ...)`` with ``variant`` and ``gone``: what is left of each word without 0 to ``most`` of its characters, the fewest that give it."""
    level = words.withColumns({"variant": F.col("word"), "gone": F.lit(0)})
    out = level
    for n in range(1, most + 1):
        v = F.col("variant")
        shorter = F.transform(F.sequence(F.lit(1), F.length(v)), lambda i: F.concat(F.substr(v, F.lit(1), i - 1), F.substr(v, i + 1)))
        level = level.filter(F.length(v) > 0).withColumns({"variant": F.explode(F.array_distinct(shorter)), "gone": F.lit(n)}).distinct()
        out = out.union(level)
    return out


#: Edits that the longest query may have, which is how many deletions the index holds.
MOST_EDITS = 3


@dataclass(frozen=True)
class Index:
    """What finds a dictionary's entries without scoring them all; four written tables of postings, made once.

    An entry can only answer a query if it holds the query, has a word within the query's typos, or has its characters in order. It then shares with the query
    every short piece of it; a variant of a word and of the query from which some characters are deleted; every two characters that follow each other in the query, in order.
    Of pieces and pairs, all of which must be shared, the one with the fewest postings is looked up.
    """

    entries: DataFrame
    pieces: DataFrame
    pairs: DataFrame
    words: DataFrame
    variants: DataFrame

    @staticmethod
    def of(entries: DataFrame) -> Index:
        """From ``dictionary``."""
        held = written(entries, "entries")
        joined = F.replace("norm", F.lit(" "), F.lit(""))
        by = lambda keys: written(held.select("name", F.explode(keys).alias("key")).distinct(), "postings")
        words = written(held.select("name", F.explode("words").alias("word")).distinct(), "words")
        variants = _with_deletions(words.select("word").distinct(), MOST_EDITS)
        return Index(held, by(_grams(F.col("norm"))), by(_ordered_pairs(joined)), words, written(variants, "variants"))

    def candidates(self, asked: DataFrame) -> DataFrame:
        """``asked(query, q)`` -> the entries that may answer each: query, q, name."""
        q, plain = F.col("q"), F.replace("q", F.lit(" "), F.lit(""))
        holding = self._rarest(asked, _longest_grams(q), self.pieces)
        in_order = self._rarest(asked.filter(F.length("q") >= 4), _steps(plain), self.pairs)
        budget = typo_budget(F.length("q"))
        spelled = _with_deletions(asked.select("query", "q", q.alias("word")), MOST_EDITS).filter(F.col("gone") <= budget).drop("word")
        known = self.variants.select("variant", "word", F.col("gone").alias("lost"))
        near = spelled.join(known, "variant").filter(F.col("lost") <= budget).select("query", "q", "word").distinct()
        near = near.filter(edit_distance_within(q, F.col("word"), budget).isNotNull()).join(self.words, "word").select("query", "q", "name")
        return holding.union(in_order).union(near).distinct()

    @staticmethod
    def _rarest(asked: DataFrame, keys: Column, postings: DataFrame) -> DataFrame:
        counts = postings.groupBy("key").agg(F.count("*").alias("n"))
        each = asked.select("query", "q", F.explode(keys).alias("key")).join(counts, "key", "left")
        best = each.groupBy("query", "q").agg(F.min_by("key", F.coalesce("n", F.lit(0))).alias("key"), F.min(F.coalesce("n", F.lit(0))).alias("n")).filter("n > 0")
        return best.join(postings, "key").select("query", "q", "name")


def search_many(index: Index, asked: DataFrame, limit: int = CATEGORY_LIMIT) -> DataFrame:
    """Best entries for each of ``asked(query)``: query, name, score, rank. Only what the index finds is scored."""
    from pyspark.sql import Window

    q = asked.select("query").distinct().select("query", normalised_phrase_of(F.col("query")).alias("q")).filter("q <> ''")
    met = index.candidates(written(q, "asked")).join(index.entries, "name")
    scored = met.select("query", "name", match_score(F.col("q"), F.col("norm"), F.col("words")).alias("score")).filter("score > 0")
    w = Window.partitionBy("query").orderBy(F.desc("score"), F.collate("name", "UNICODE"), "name")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def official(entries: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked(query)`` that name an entry exactly, once normalised."""
    q = asked.select("query", normalised_phrase_of(F.col("query")).alias("norm"))
    return q.join(entries.select("norm").distinct(), "norm", "left_semi").select("query")


def city_search(gazetteer: DataFrame, country: str, text: str, limit: int = CITY_LIMIT) -> DataFrame:
    """Cities that hold the text, those that begin with it first, then by population; two characters at least."""
    q = text.strip().lower()
    name = F.lower("city")
    hits = gazetteer.filter((F.col("country") == country) & F.contains(name, F.lit(q)) & F.lit(len(q) >= 2))
    score = F.when(F.startswith(name, F.lit(q)), PREFIX_BONUS).otherwise(0) + F.col("population")
    return hits.select("country", "region", "city", score.alias("score"), "ord").orderBy(F.desc("score"), "ord").limit(limit)


def regions_of(gazetteer: DataFrame, country: str, region: str | None = None) -> DataFrame:
    """Regions of a country in file order, or the one named."""
    found = gazetteer.filter(F.col("country") == country)
    found = found if region is None else found.filter(F.col("region") == region)
    return found.groupBy("country", "country_name", "region", "region_name").agg(F.min("ord").alias("ord")).orderBy("ord")


def all_regions(gazetteer: DataFrame) -> DataFrame:
    """Every region as country/code, in file order."""
    return gazetteer.groupBy("country", "region").agg(F.min("ord").alias("ord")).select(F.concat_ws("/", "country", "region").alias("region"), "ord").orderBy("ord")


def label(city: Column, region: Column) -> Column:
    return F.concat_ws(", ", F.nullif(city, F.lit("")), region)


def geocoder_query(selections: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """``selections(country, region, city)`` with ``query``: city, region's name, country's name; codes where names are unknown."""
    names = gazetteer.groupBy("country", "region").agg(F.first("region_name").alias("__rn"))
    countries = gazetteer.groupBy("country").agg(F.first("country_name").alias("__cn"))
    known = selections.join(names, ["country", "region"], "left").join(countries, "country", "left")
    nz = lambda c: F.nullif(F.col(c), F.lit(""))
    return known.withColumn("query", F.concat_ws(", ", nz("city"), F.coalesce(nz("__rn"), nz("region")), F.coalesce(nz("__cn"), nz("country")))).drop("__rn", "__cn")


def terms_of(terms: DataFrame, vertical: str) -> DataFrame:
    """Terms of a vertical in order; none if it is unknown."""
    return terms.filter(F.col("vertical") == vertical).orderBy("ord")


def vertical_counts(terms: DataFrame) -> DataFrame:
    return terms.groupBy("vertical").agg(F.count("*").alias("terms")).orderBy("vertical")
