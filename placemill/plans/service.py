"""One object with what a caller of the system asks for: queries, statistics, maps, exports, searches, jobs, extractions, enrichment and campaigns."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from placemill.functions.geo import area_km2
from placemill.operators import catalog, coverage
from placemill.operators.filters import PlaceFilter
from placemill.operators.store import GEO_LIMIT, PlaceStore, count_where, geo, geo_view, query
from placemill.plans import jobs
from placemill.sources.sinks import file_name
from placemill.streaming import enrichment

PAGE_LIMIT, PAGE_DEFAULT = 500, 200
CAMPAIGN = "campaign"


def now_ms() -> int:
    return int(datetime.now(timezone.utc).timestamp() * 1000)


def today() -> str:
    return datetime.now(timezone.utc).date().isoformat()


@dataclass
class Job:
    """A run and how it goes; its id is the Spark job group by which it is cancelled."""

    id: str
    label: str
    started_at: int
    state: str = "running"
    rows: int = 0
    new: int = 0


class Service:
    def __init__(self, spark: SparkSession, store: PlaceStore, dictionary: DataFrame | None = None, gazetteer: DataFrame | None = None, terms: DataFrame | None = None, clock: Callable[[], int] = now_ms):
        self.spark, self.store, self.clock = spark, store, clock
        self.dictionary, self.gazetteer, self.terms = dictionary, gazetteer, terms
        self.jobs: dict[str, Job] = {}
        self.stream: StreamingQuery | None = None

    # Stored places

    def query(self, asked: PlaceFilter) -> dict[str, object]:
        """A page, how many match, and how many there are."""
        places = self.store.read()
        limit = min(asked.limit if asked.limit != PlaceFilter.limit else PAGE_DEFAULT, PAGE_LIMIT)
        return {"places": query(places, replace(asked, limit=limit)), "matching": count_where(places, asked).first().n, "total": places.count()}

    def matching(self, asked: PlaceFilter) -> DataFrame:
        """All matching places in order, as a table."""
        return asked.where(self.store.read()).orderBy(*asked.order())

    def iterate(self, asked: PlaceFilter) -> Iterator[dict]:
        """All matching places in order, a partition at a time."""
        for row in self.matching(asked).toLocalIterator():
            yield row.asDict(recursive=True)

    def stats(self) -> dict[str, DataFrame]:
        return self.store.stats()

    def map_points(self, asked: PlaceFilter, limit: int = GEO_LIMIT) -> tuple[DataFrame, bool]:
        """Pins, and whether there are more."""
        places = self.store.read()
        located = asked.where(places).filter("latitude is not null and longitude is not null")
        return geo(places, asked, limit), located.limit(limit + 1).count() > limit

    def map_view(self, asked: PlaceFilter, north: float, south: float, east: float, west: float) -> tuple[str, DataFrame]:
        return geo_view(self.store.read(), asked, north, south, east, west)

    def export_csv(self, asked: PlaceFilter, label: str, folder: str) -> tuple[str, int]:
        path = f"{folder}/{file_name(label, today(), 'csv')}"
        return path, jobs.export_csv(self.store.read(), asked, path)

    def export_leads(self, asked: PlaceFilter, label: str, folder: str, dead_domains: DataFrame | None = None) -> tuple[str, int, int]:
        path = f"{folder}/{file_name(label, today(), 'xlsx', prefix='leads-', fallback='leads')}"
        return path, *jobs.export_leads(self.store.read(), asked, path, dead_domains)

    # Searches

    def categories(self, text: str, limit: int = catalog.CATEGORY_LIMIT) -> DataFrame:
        return catalog.search_categories(self.dictionary, text, limit)

    def cities(self, country: str, text: str, limit: int = catalog.CITY_LIMIT) -> DataFrame:
        return catalog.city_search(self.gazetteer, country, text, limit)

    def countries(self) -> DataFrame:
        return self.gazetteer.groupBy("country", "country_name", "flag").agg(F.countDistinct("region").alias("regions"), F.min("ord").alias("ord")).orderBy("ord")

    def resolve(self, country: str, region: str, city: str | None, geocodes: DataFrame) -> DataFrame:
        """The geocoder query of a selection with its box and rough area."""
        one = self.spark.createDataFrame([(country, region, city)], "country string, region string, city string")
        asked = catalog.geocoder_query(one, self.gazetteer)
        found = geocodes.select(F.col("query").alias("__q"), "box")
        return asked.join(found, F.col("query") == F.col("__q"), "left").select("query", "box", area_km2(F.col("box")).alias("area_km2"))

    def verticals(self) -> DataFrame:
        return catalog.vertical_counts(self.terms)

    # Runs

    def _run(self, label: str, work: Callable[[Job], None]) -> Job:
        job = Job(uuid.uuid4().hex, label, self.clock())
        self.jobs[job.id] = job
        self.spark.sparkContext.setJobGroup(job.id, label, interruptOnCancel=True)
        try:
            work(job)
            job.state = "done"
        except Exception:
            if job.state != "cancelled":
                job.state = "failed"
                raise
        finally:
            self.spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return job

    def start_job(self, captures: DataFrame, request: jobs.JobRequest, path: str, site_pages: DataFrame | None = None) -> Job:
        """A one-off job to a CSV file."""

        def work(job: Job) -> None:
            job.rows = jobs.write_csv(jobs.run_job(captures, request, site_pages), path)

        return self._run(", ".join(request.queries), work)

    def start_extraction(self, captures: DataFrame, units: DataFrame, done: DataFrame, label: str) -> tuple[Job, DataFrame]:
        """Open units into the store; the checkpoints after it."""
        after: list[DataFrame] = []

        def work(job: Job) -> None:
            job.new, checkpoints = jobs.run_extraction(self.store, captures, units, done, self.clock())
            after.append(checkpoints)

        return self._run(label, work), after[0] if after else done

    def cancel(self, job_id: str) -> None:
        self.jobs[job_id].state = "cancelled"
        jobs.cancel(self.spark, job_id)

    def list_jobs(self) -> list[Job]:
        """Latest first."""
        return sorted(self.jobs.values(), key=lambda j: -j.started_at)

    # Enrichment

    def resume_enrichment(self, pages_path: str, checkpoint: str, forever: bool = True) -> StreamingQuery:
        if self.stream is None or not self.stream.isActive:
            self.stream = enrichment.run(self.spark, self.store, pages_path, checkpoint, self.clock, forever=forever)
        return self.stream

    def pause_enrichment(self) -> None:
        if self.stream is not None and self.stream.isActive:
            self.stream.stop()

    # Campaigns

    def coverage_board(self, regions: DataFrame, verticals: DataFrame, passes: DataFrame, running: DataFrame) -> tuple[DataFrame, DataFrame]:
        board = coverage.board(regions, verticals, passes, running)
        return board, coverage.board_summary(board)

    def run_campaign(self, vertical: str, next_region: Callable[[], str | None], run: Callable[[str], bool]) -> list[tuple[str, bool]]:
        """Sweep regions, least covered first, with one round of retries; the vertical is remembered until the sweep ends."""
        self.store.set_setting(CAMPAIGN, vertical)
        swept = []
        for region, ok in coverage.driver_sweep(next_region, run):
            swept.append((region, ok))
            if self.store.setting(CAMPAIGN) != vertical:
                return swept
        self.store.set_setting(CAMPAIGN, None)
        return swept

    def interrupted_campaign(self) -> str | None:
        """The vertical of a campaign that was running when the process ended."""
        return self.store.setting(CAMPAIGN)

    def cancel_campaign(self) -> None:
        self.store.set_setting(CAMPAIGN, None)
