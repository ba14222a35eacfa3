"""Enrichment as a stream: captured site pages arrive as files, each micro-batch enriches the places that wait for them.

The checkpoint folder of the query makes arrivals exactly-once. What a round changes, the places' rows and what the stream remembers, comes into place in one switch of the store's manifest, so a
micro-batch that is run again after a failure finds rows and memory that belong together: places that were settled are no longer due and are not counted twice. That is why the memory lies there and
not in a stateful operator of the query, whose state would be committed apart from the rows.

Remembered are: how often each domain failed since it was last reached (after three failures its places are deferred unseen), how many outcomes of each kind there were, and pages of places that are in
backoff. These wait until a later micro-batch finds their places due, or no longer waiting. A stream with another checkpoint begins with an empty memory, so every domain has another chance.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import QueryIdleEvent, QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent, StreamingQueryListener

from placemill.operators.enrich import best_page, domain_failures, enrich, remembered, split_by_domain
from placemill.operators.store import PlaceStore, awaiting_email, due, routed, settled, upserted
from placemill.schema import ENRICHMENT_COLUMNS, as_places
from placemill.storage import written

BATCH = 300
PAGES_SCHEMA = "id string, html string, final_url string, outcome string"
COLUMNS = ("id", "html", "final_url", "outcome")


def settle_batch(places: DataFrame, site_pages: DataFrame, now: int, history: DataFrame | None = None, limit: int | None = BATCH, failures: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The store after one batch of pages, and outcomes of the places it looked at: id, site, seq (their order), outcome, route.

    Of places that are due and have a page, the ``limit`` that wait longest take part, or all; those whose domain failed too often, by ``failures`` or a ``history`` of outcomes, are deferred unseen.
    """
    work = places.filter(due(now)).join(site_pages.select("id").distinct(), "id", "left_semi")
    work = work if limit is None else work.orderBy("first_seen", "id").limit(limit)
    failures = domain_failures(history) if failures is None and history is not None else failures
    split = split_by_domain(work, failures).drop("domain") if failures is not None else work.withColumn("skipped", F.lit(False))
    # written, as rows and outcomes both come from it
    seen = written(enrich(split.filter(~F.col("skipped")).drop("skipped"), best_page(site_pages)), "seen")
    seq = F.struct("first_seen", "id").alias("seq")
    outcomes = routed(seen.select("id", "site", seq, "outcome").union(split.filter("skipped").select("id", "site", seq, F.lit("skipped"))))
    found = as_places(seen, enriched=True).columns
    batch = seen.select("id", *found) if set(found) <= set(seen.columns) else seen.select("id", *[c for c in seen.columns if c in {*found, *ENRICHMENT_COLUMNS}])
    return settled(upserted(places, batch, now).drop("is_new"), outcomes, now), outcomes


def _remembers(store: PlaceStore, memory: dict, name: str, schema: str) -> DataFrame:
    spark = store.spark
    return spark.read.schema(schema).parquet(f"{store.path}/{memory[name]}") if name in memory else spark.createDataFrame([], schema)


def settle_round(store: PlaceStore, pages: DataFrame, now: int, stream: str, batch: int, limit: int | None = None) -> int:
    """One round over the written ``pages`` of a micro-batch and those that waited; how many places were looked at.

    The first round of a micro-batch takes its pages in; what it has not looked at waits with the others, so later rounds, and a micro-batch that is run again, take in none.
    """
    memory = store.memory() if store.memory().get("stream") == stream else {"stream": stream, "batch": -1}
    failures, parked = _remembers(store, memory, "failures", "domain string, failures long"), _remembers(store, memory, "parked", PAGES_SCHEMA)
    every = written(parked if memory["batch"] >= batch else best_page(pages.select(*COLUMNS).union(parked)), "site-pages")
    places = written(store.rows_of(every), "places")
    after, outcomes = settle_batch(places, every, now, limit=limit, failures=failures)
    counts = {r.outcome: r.n for r in outcomes.groupBy("outcome").agg(F.count("*").alias("n")).collect()}  # a handful of kinds
    waiting = places.filter(awaiting_email()).join(outcomes.select("id"), "id", "left_anti").select("id")
    before = memory.get("outcomes", {})
    again = {
        "stream": stream,
        "batch": batch,
        "failures": store.put(remembered(failures, outcomes)),
        "parked": store.put(every.join(waiting, "id", "left_semi").select(*COLUMNS)),
        "outcomes": {k: counts.get(k, 0) + before.get(k, 0) for k in sorted({*counts, *before})},
    }
    store.append(after.join(outcomes.select("id"), "id", "left_semi").select(*after.columns), again)
    return sum(counts.values())


def outcome_counts(store: PlaceStore) -> dict[str, int]:
    """Outcomes of the running enrichment so far, by kind."""
    return store.memory().get("outcomes", {})


def run(spark: SparkSession, store: PlaceStore, pages_path: str, checkpoint: str, clock: Callable[[], int], limit: int | None = None, forever: bool = False, files_a_batch: int | None = None) -> StreamingQuery:
    """Start the stream over Parquet files of pages; ``forever`` keeps it open, else it ends with what is there.

    A micro-batch is settled at once, or with a ``limit`` in rounds of so many places, each round a delta of the store; ``files_a_batch`` bounds how many files one takes.
    """

    def one(batch: DataFrame, number: int) -> None:
        pages = written(batch, "arrived")
        while settle_round(store, pages, clock(), checkpoint, number, limit) and limit is not None:
            pass

    reader = spark.readStream.schema(PAGES_SCHEMA)
    reader = reader if files_a_batch is None else reader.option("maxFilesPerTrigger", files_a_batch)
    stream = reader.parquet(pages_path).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (stream.trigger(processingTime="3 seconds") if forever else stream.trigger(availableNow=True)).start()


class ProgressFeed(StreamingQueryListener):
    """Events of running queries, handed on as small dictionaries."""

    def __init__(self, send: Callable[[dict], None]):
        self.send = send

    def onQueryStarted(self, event: QueryStartedEvent) -> None:
        self.send({"event": "started", "id": str(event.id), "name": event.name})

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        p = event.progress
        self.send({"event": "progress", "id": str(p.id), "batch": p.batchId, "rows": p.numInputRows})

    def onQueryIdle(self, event: QueryIdleEvent) -> None:
        self.send({"event": "idle", "id": str(event.id)})

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:
        self.send({"event": "ended", "id": str(event.id), "error": event.exception})
