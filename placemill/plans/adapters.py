"""Places and observations derived from the star-schema tables, so that every operator has rows to run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placemill import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One place a customer."""
    key = F.col("c_custkey")
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("reviews"))
    area = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    base = table(spark, sf_dir, "customer").join(area, F.col("c_nationkey") == F.col("n_nationkey"))
    base = base.join(table(spark, sf_dir, "part").select("p_partkey", "p_name"), F.col("p_partkey") == key, "left")
    base = base.join(table(spark, sf_dir, "pages").select("page_id", "url"), F.col("page_id") == key, "left").join(orders, F.col("o_custkey") == key, "left")
    prefix = F.when(key % 8 == 0, "Info@").otherwise("info@")
    return base.select(
        F.concat(F.lit("cid:"), key.cast("string")).alias("id"),
        F.col("p_name").alias("name"),
        F.col("c_mktsegment").alias("category"),
        F.col("n_name").alias("city"),
        F.col("r_name").alias("state"),
        (F.lit(48.0) + (key * 7919 % 10000).cast("double") / F.lit(1000.0)).alias("latitude"),
        (F.lit(-124.0) + (key * 104729 % 20000).cast("double") / F.lit(1000.0)).alias("longitude"),
        F.when(key % 11 != 0, (F.lit(10) + key * 31 % 41).cast("double") / F.lit(10.0)).alias("rating"),
        "reviews",
        F.when(key % 3 == 0, F.lit(None)).when(key % 17 == 0, "").otherwise(F.concat(F.lit("+1 604-555-"), (F.lit(1000) + key % 9000).cast("string"))).alias("phone"),
        F.col("url").alias("site"),
        F.when(F.col("url").isNotNull() & (key % 4 == 0), F.concat(prefix, F.lower("n_name"), F.lit(".test"))).alias("email_1"),
        (F.lit(1704067200000) + key * 1000).alias("first_seen"),
        (F.lit(1706745600000) + key * 1000).alias("last_seen"),
        F.when(key % 5 == 0, F.lit(1706745600000) + key * 1000).alias("email_checked_at"),
        (key % 4).alias("email_attempts"),
        F.when(key % 6 == 0, F.lit(1706745600000) + key * 1000).alias("email_retry_at"),
        F.when(key % 3 == 0, "OPERATIONAL").when(key % 3 == 1, "CLOSED_TEMPORARILY").alias("business_status"),
        F.when(key % 7 == 0, True).when(key % 7 == 1, False).alias("verified"),
    )


PLACES_SQL = """places AS (
SELECT concat('cid:', CAST(c.c_custkey AS VARCHAR)) AS id, p.p_name AS name, c.c_mktsegment AS category, n.n_name AS city, r.r_name AS state,
  CAST(48 AS DOUBLE) + CAST((c.c_custkey*7919) % 10000 AS DOUBLE)/CAST(1000 AS DOUBLE) AS latitude,
  CAST(-124 AS DOUBLE) + CAST((c.c_custkey*104729) % 20000 AS DOUBLE)/CAST(1000 AS DOUBLE) AS longitude,
  CASE WHEN c.c_custkey % 11 = 0 THEN NULL ELSE CAST(10 + (c.c_custkey*31) % 41 AS DOUBLE)/CAST(10 AS DOUBLE) END AS rating,
  o.cnt AS reviews,
  CASE WHEN c.c_custkey % 3 = 0 THEN NULL WHEN c.c_custkey % 17 = 0 THEN '' ELSE concat('+1 604-555-', CAST(1000 + c.c_custkey % 9000 AS VARCHAR)) END AS phone,
  g.url AS site,
  CASE WHEN g.url IS NOT NULL AND c.c_custkey % 4 = 0 THEN concat(CASE WHEN c.c_custkey % 8 = 0 THEN 'Info@' ELSE 'info@' END, lower(n.n_name), '.test') END AS email_1,
  1704067200000 + c.c_custkey*1000 AS first_seen, 1706745600000 + c.c_custkey*1000 AS last_seen,
  CASE WHEN c.c_custkey % 5 = 0 THEN 1706745600000 + c.c_custkey*1000 END AS email_checked_at, c.c_custkey % 4 AS email_attempts,
  CASE WHEN c.c_custkey % 6 = 0 THEN 1706745600000 + c.c_custkey*1000 END AS email_retry_at,
  CASE WHEN c.c_custkey % 3 = 0 THEN 'OPERATIONAL' WHEN c.c_custkey % 3 = 1 THEN 'CLOSED_TEMPORARILY' END AS business_status,
  CASE WHEN c.c_custkey % 7 = 0 THEN TRUE WHEN c.c_custkey % 7 = 1 THEN FALSE END AS verified
FROM customer c JOIN nation n ON c.c_nationkey=n.n_nationkey JOIN region r ON n.n_regionkey=r.r_regionkey
LEFT JOIN part p ON p.p_partkey=c.c_custkey LEFT JOIN pages g ON g.page_id=c.c_custkey
LEFT JOIN (SELECT o_custkey, count(*) AS cnt FROM orders GROUP BY o_custkey) o ON o.o_custkey=c.c_custkey)"""


def place_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of places in the order of seq, linked by ids and by name with position."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), "event_type", (F.col("user_id") * 61 + F.col("event_id") % 61).alias("g"))
    seq, g = F.col("seq"), F.col("g")
    at = lambda base, sign: F.when(seq % 4 != 0, F.lit(base) + sign * g.cast("double") / F.lit(1000.0))
    return e.select(
        "seq",
        F.when(seq % 7 != 0, g.cast("string")).alias("cid"),
        F.when(seq % 3 == 0, F.concat(F.lit("P"), (g + seq % 2).cast("string"))).alias("place_id"),
        F.when(seq % 5 != 0, F.concat(F.lit("The "), F.col("event_type"), F.lit(" Co."))).alias("name"),
        at(49.0, 1).alias("latitude"),
        at(-123.0, -1).alias("longitude"),
    )


def passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as passes: customer as region, priority as vertical, order as pass; open ones are not completed."""
    o = table(spark, sf_dir, "orders")
    ms = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    return o.select(F.col("o_custkey").cast("string").alias("region"), F.col("o_orderpriority").alias("vertical"), F.col("o_orderkey").alias("pass"), ms.alias("started_at"), F.when(F.col("o_orderstatus") != "O", ms + 1000).alias("completed_at"), F.lit(0).alias("new_places"))


PASSES_SQL = """passes AS (
SELECT CAST(o_custkey AS VARCHAR) AS region, o_orderpriority AS vertical, o_orderkey AS pass, epoch_ms(o_orderdate) AS started_at,
  CASE WHEN o_orderstatus <> 'O' THEN epoch_ms(o_orderdate) + 1000 END AS completed_at FROM orders)"""


def cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as cities with customers as population."""
    n = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("population"))
    return table(spark, sf_dir, "nation").join(n, F.col("n_nationkey") == F.col("c_nationkey"), "left").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.lit("XX").alias("country"), F.lit("Exland").alias("country_name"), F.col("r_regionkey").cast("string").alias("region"), F.col("r_name").alias("region_name"), F.col("n_name").alias("city"),
        (F.lit(40.0) + F.col("n_nationkey") * F.lit(0.07)).alias("lat"), (F.lit(-100.0) + F.col("n_nationkey") * F.lit(0.09)).alias("lng"), F.coalesce("population", F.lit(0)).alias("population"), F.col("n_nationkey").cast("long").alias("ord"),
    )
