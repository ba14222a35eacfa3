"""Reference tables read from files: dictionary, gazetteer, verticals, geocoder results, line lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placemill.functions.geo import box

_COUNTRY = "struct<name:string,flag:string,regions:array<struct<code:string,name:string,cities:array<struct<n:string,lat:double,lng:double,p:bigint>>>>>"


def _json_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("wholetext", True).text(path)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of names, in order."""
    return _json_text(spark, path).select(F.posexplode(F.from_json("value", "array<string>")).alias("ord", "name"))


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of verticals, each an array of terms: vertical, ord, term."""
    verticals = _json_text(spark, path).select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("vertical", "terms"))
    return verticals.select("vertical", F.posexplode("terms").alias("ord", "term"))


def read_gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of countries with regions with cities, flattened; ``ord`` is the place in the file. A region without cities has one row without a city."""
    countries = _json_text(spark, path).select(F.posexplode(F.map_entries(F.from_json("value", f"map<string,{_COUNTRY}>"))).alias("c", "country"))
    regions = countries.select("c", F.col("country.key").alias("country"), F.col("country.value.name").alias("country_name"), F.col("country.value.flag").alias("flag"), F.posexplode("country.value.regions").alias("r", "region"))
    cities = regions.select("c", "r", "country", "country_name", "flag", F.col("region.code").alias("region"), F.col("region.name").alias("region_name"), F.posexplode_outer("region.cities").alias("i", "city"))
    order = F.col("c").cast("long") * (1 << 40) + F.col("r").cast("long") * (1 << 24) + F.coalesce("i", F.lit(0))
    return cities.select("country", "country_name", "flag", "region", "region_name", F.col("city.n").alias("city"), F.col("city.lat").alias("lat"), F.col("city.lng").alias("lng"), F.col("city.p").alias("population"), order.alias("ord"))


def geocoded(rows: DataFrame) -> DataFrame:
    """``rows(query, ord, display_name, type, boundingbox, importance)`` -> boxes; the bounds are south, north, west, east as text, rows without four drop out."""
    b = lambda i: F.try_element_at("boundingbox", F.lit(i + 1)).try_cast("double")
    four = rows.filter(F.size("boundingbox") == 4)
    return four.select("query", "ord", "display_name", "type", box(b(2), b(0), b(3), b(1)).alias("box"), F.coalesce("importance", F.lit(0.0)).alias("importance"))


def best_geocode(results: DataFrame) -> DataFrame:
    """The first result of each query."""
    return results.groupBy("query").agg(F.min_by(F.struct("display_name", "type", "box", "importance", "ord"), "ord").alias("r")).select("query", "r.*")


def read_list(spark: SparkSession, path: str, valid: str = r"^[A-Za-z][A-Za-z0-9+.-]*://[^\s/]+") -> DataFrame:
    """Entries of a text list, split at commas, without blanks and comments; those that match ``valid``."""
    lines = spark.read.text(path).select(F.trim(F.replace("value", F.lit("\r"), F.lit(""))).alias("line")).filter("line <> '' and not startswith(line, '#')")
    return lines.select(F.explode(F.split("line", ",")).alias("entry")).select(F.trim("entry").alias("entry")).filter(F.rlike("entry", F.lit(valid)))
