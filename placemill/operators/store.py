"""The store of places: immutable Parquet versions behind a pointer, and the questions asked of it."""

from __future__ import annotations

import json
import uuid
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placemill.functions.geo import map_cell
from placemill.operators.dedupe import last_per_id, stored_id
from placemill.operators.filters import PlaceFilter
from placemill.schema import EMAIL_STATE, ENRICHED_SCHEMA, LEAD_COLUMNS, SOCIALS, empty, filled, with_columns_added
from placemill.storage import written

# Fixed values.
POINT_THRESHOLD = 2_000
GRID_DIVISIONS = 26
GEO_LIMIT = 50_000
QUEUE_LIMIT = 200
FIRST_RETRY_MS, SECOND_RETRY_MS = 3_600_000, 21_600_000
UNFINDABLE = "unfindable"
#: Parts of the store by hash of the id, a bounded number; and for how many writes replaced files stay for readers.
BUCKETS, GRACE = 64, 2
#: So many deltas become one; and deltas that hold this share of the rows of the parts are folded into them.
DELTAS, FOLD_SHARE = 8, 0.25

PIN = {"lat": "latitude", "lng": "longitude", "name": "name", "category": "category", "city": "city", "rating": "rating", "reviews": "reviews", "phone": "phone", "email": "email_1", "site": "site"}


def pins() -> list[Column]:
    return [F.col(c).alias(a) for a, c in PIN.items()]


def shown(places: DataFrame) -> DataFrame:
    """A checked place without an address reads as unfindable; filters run before this."""
    label = F.when(F.col("email_checked_at").isNotNull() & empty("email_1"), UNFINDABLE).otherwise(F.col("email_1"))
    return places.withColumn("email_1", label)


def query(places: DataFrame, asked: PlaceFilter) -> DataFrame:
    """One page: filter, sort, offset and limit as a top-k; labels last."""
    return shown(asked.page(places))


def ids(places: DataFrame, asked: PlaceFilter) -> DataFrame:
    return asked.where(places).select("id")


def by_id(places: DataFrame, place_id: str) -> DataFrame:
    return places.filter(F.col("id") == place_id)


def count_where(places: DataFrame, asked: PlaceFilter) -> DataFrame:
    return asked.where(places).agg(F.count("*").alias("n"))


def facet(places: DataFrame, column: str) -> DataFrame:
    """Values of category, city or state by frequency; the empty string is a value."""
    if column not in ("category", "city", "state"):
        raise ValueError(f"no facet by {column}")
    return places.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def city_state_facet(places: DataFrame) -> DataFrame:
    return places.filter(F.col("city").isNotNull()).groupBy("city", "state").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "city", "state")


def contact_stats(places: DataFrame, since: int = 0) -> DataFrame:
    """Seven counts in one pass; zero over no rows."""
    checked = F.col("email_checked_at")
    return places.agg(
        F.count("*").alias("total"),
        F.count_if(filled("email_1")).alias("with_email"),
        F.count_if(filled("site")).alias("with_site"),
        F.count_if(filled("phone")).alias("with_phone"),
        F.count_if(checked.isNotNull()).alias("checked"),
        F.count_if(checked >= since).alias("checked_since"),
        F.count_if((checked >= since) & filled("email_1")).alias("with_email_since"),
    )


def geo(places: DataFrame, asked: PlaceFilter, limit: int = GEO_LIMIT) -> DataFrame:
    """Pins of the most reviewed places."""
    located = asked.where(places).filter("latitude is not null and longitude is not null")
    return located.orderBy(F.col("reviews").desc_nulls_last(), "id").limit(limit).select(*pins())


def in_view(places: DataFrame, asked: PlaceFilter, north: float, south: float, east: float, west: float) -> DataFrame:
    return asked.where(places).filter(F.col("latitude").between(south, north) & F.col("longitude").between(west, east))


def clusters(seen: DataFrame, east: float, west: float) -> DataFrame:
    """Counts and mean positions by grid cell; the grid follows the span of longitude on both axes.

    Positions are added up as decimals, to 15 places of a degree, so a mean does not depend on the order of rows or tasks.
    """
    mean = lambda c: F.avg(F.col(c).cast("decimal(25,15)")).cast("double")
    size = max(1e-6, east - west) / GRID_DIVISIONS
    cells = seen.groupBy(map_cell(F.col("latitude"), F.lit(size)).alias("y"), map_cell(F.col("longitude"), F.lit(size)).alias("x"))
    return cells.agg(F.count("*").alias("count"), mean("latitude").alias("lat"), mean("longitude").alias("lng")).drop("y", "x")


def geo_view(places: DataFrame, asked: PlaceFilter, north: float, south: float, east: float, west: float, threshold: int | None = POINT_THRESHOLD) -> tuple[str, DataFrame]:
    """"points" with pins where the view holds few places, else "clusters". Counting stops past the threshold; without one, all are pins."""
    seen = in_view(places, asked, north, south, east, west)
    if threshold is None:
        return "points", seen.orderBy(F.col("reviews").desc_nulls_last(), "id").select(*pins())
    if seen.select(F.lit(1)).limit(threshold + 1).count() <= threshold:
        return "points", seen.orderBy(F.col("reviews").desc_nulls_last(), "id").limit(threshold).select(*pins())
    return "clusters", clusters(seen, east, west)


# The queue of places whose sites are to be read


def awaiting_email() -> Column:
    return filled("site") & empty("email_1") & F.col("email_checked_at").isNull()


def due(now: int) -> Column:
    return awaiting_email() & (F.col("email_retry_at").isNull() | (F.col("email_retry_at") <= now))


def next_email_targets(places: DataFrame, now: int, limit: int = QUEUE_LIMIT) -> DataFrame:
    """Ids of those that wait longest."""
    return places.filter(due(now)).orderBy("first_seen", "id").limit(limit).select("id")


def pending_email_checks(places: DataFrame) -> DataFrame:
    """How many wait, those in backoff too."""
    return places.filter(awaiting_email()).agg(F.count("*").alias("n"))


def settled(places: DataFrame, routes: DataFrame, at: int) -> DataFrame:
    """``places`` with the email state that ``routes(id, route)`` give: checked, deferred, or as it was."""
    # the two sides meet as structs, so no name of a column can clash
    met = places.select(F.struct("*").alias("whole")).join(routes.select(F.struct("id", "route").alias("to")).distinct(), F.col("whole.id") == F.col("to.id"), "left")
    later = deferred(at, "whole.email_attempts")

    def value(c: str) -> Column:
        old = F.col("whole").getField(c)
        if c not in EMAIL_STATE:
            return old
        changed = F.when(F.col("to.route") == "deferred", later[c]).otherwise(old.cast("long"))
        return F.when(F.col("to.route") == "checked", F.lit(at).cast("long")).otherwise(changed) if c == "email_checked_at" else changed

    return met.select(*(value(c).alias(c) for c in places.columns))


def mark_checked(places: DataFrame, these: DataFrame, at: int) -> DataFrame:
    return settled(places, these.select("id", F.lit("checked").alias("route")), at)


def deferred(at: int, attempts: str = "email_attempts") -> dict[str, Column]:
    """Email state after another failure: again in one hour, then in six, then checked. All sides read the old state."""
    tries = F.coalesce(attempts, F.lit(0)).cast("long")
    return {
        "email_attempts": tries + 1,
        "email_retry_at": F.when(tries >= 2, F.lit(None)).when(tries == 0, F.lit(at + FIRST_RETRY_MS)).otherwise(F.lit(at + SECOND_RETRY_MS)).cast("long"),
        "email_checked_at": F.when(tries >= 2, F.lit(at)).cast("long"),
    }


def mark_deferred(places: DataFrame, these: DataFrame, at: int) -> DataFrame:
    return settled(places, these.select("id", F.lit("deferred").alias("route")), at)


def routed(outcomes: DataFrame) -> DataFrame:
    """Outcomes to what becomes of the place: reached ones are checked, the others deferred."""
    return outcomes.withColumn("route", F.when(F.col("outcome").isin("ok", "no_site"), "checked").otherwise("deferred"))


# Upserts


def stored_columns(batch: DataFrame, at: int) -> DataFrame:
    """A batch of places as rows of the store."""
    batch = batch if "id" in batch.columns else batch.withColumn("id", stored_id())
    return batch.withColumns({"first_seen": F.lit(at).cast("long"), "last_seen": F.lit(at).cast("long")})


def upserted(stored: DataFrame, batch: DataFrame, at: int, merge: str = "replace", order: str | None = None) -> DataFrame:
    """The store after a batch. New ids are inserted; for known ones the record and last_seen are replaced, first_seen and email state
    stay. ``merge="preserve_enrichment"`` keeps addresses and profiles that the new record lacks. ``is_new`` tells which were inserted.
    """
    if merge not in ("replace", "preserve_enrichment"):
        raise ValueError(f"no merge called {merge}")
    old = with_columns_added(stored, EMAIL_STATE)
    new = stored_columns(last_per_id(batch if "id" in batch.columns else batch.withColumn("id", stored_id()), order), at)
    kept = ["first_seen", *EMAIL_STATE]
    columns = [c for c in old.columns if c != "id"]
    enrichment = {"email_1", "email_2", "email_3", *SOCIALS}

    def value(c: str) -> Column:
        of_old = F.col(f"o.{c}")
        if c not in new.columns:
            return of_old if c in EMAIL_STATE else F.when(F.col("n.id").isNull(), of_old)
        of_new = F.col(f"n.{c}").cast(old.schema[c].dataType)
        if c in kept:
            return F.coalesce(of_old, of_new)
        if merge == "preserve_enrichment" and c in enrichment:
            return F.when(F.col("n.id").isNull(), of_old).otherwise(F.coalesce(of_new, of_old))
        return F.when(F.col("n.id").isNotNull(), of_new).otherwise(of_old)

    joined = old.alias("o").join(new.alias("n"), F.col("o.id") == F.col("n.id"), "full_outer")
    return joined.select(F.coalesce("o.id", "n.id").alias("id"), *(value(c).alias(c) for c in columns), F.col("o.id").isNull().alias("is_new"))


def leads(places: DataFrame, asked: PlaceFilter | None = None, dead_domains: DataFrame | None = None) -> DataFrame:
    """One row an address, whatever its case, from its most reviewed place; addresses of dead domains dropped."""
    reachable = replace(asked or PlaceFilter(), has_email=True, missing_email=False).where(places)
    # the least of a struct is combined before the shuffle, so an address that very many places share is no burden
    order = F.struct(F.col("reviews").isNull(), -F.col("reviews"), "id")
    first = reachable.select(F.lower("email_1").alias("by"), F.struct("*").alias("whole"), order.alias("at")).groupBy("by").agg(F.min_by("whole", "at").alias("whole")).select("whole.*")
    if dead_domains is not None:
        first = first.withColumn("__domain", F.lower(F.get(F.split("email_1", "@"), F.lit(1)))).join(dead_domains.select(F.lower("domain").alias("__domain")), "__domain", "left_anti")
    source = {"email": "email_1", "website": "site", "address": "full_address"}
    column = lambda c: F.col(source.get(c, c)) if source.get(c, c) in first.columns else F.lit(None).cast("string")
    return first.select(*(column(c).alias(c) for c in LEAD_COLUMNS))


class PlaceStore:
    """The places table in a folder: parts by hash of the id, and deltas with the rows that later writes changed. A small manifest names the current files. One writer at a time.

    A write of some rows makes one delta, so what it writes follows the batch and not the store; readers take a row from the newest delta that has it, else from its part.
    Deltas are merged once there are DELTAS of them, and folded into the parts they touch once they hold FOLD_SHARE of the rows, so a row is rewritten a bounded number of times while the store doubles.
    Each write makes new files and then a new manifest, so readers see the old or the new state, and a failed write leaves nothing visible. Files that none of the last GRACE writes still needed are deleted.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        jvm = spark._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _numbers(self, name: str) -> list[int]:
        """Numbers of the copies of a small file, rising."""
        folder = self._path(self.path)
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n.rsplit(".", 1)[1]) for n in names if n.startswith(f"{name}.") and n.rsplit(".", 1)[1].isdigit())

    def _read_text(self, name: str) -> str | None:
        numbers = self._numbers(name)
        return self.spark.read.option("wholetext", True).text(f"{self.path}/{name}.{numbers[-1]}").first()[0] if numbers else None

    def _write_text(self, name: str, text: str) -> None:
        """A new copy with the next number, made apart and renamed into place, so readers find the old or the new one at any time.

        Another writer that took the number first makes this fail.
        """
        self._fs.mkdirs(self._path(self.path))
        numbers = self._numbers(name)
        fresh, target = self._path(f"{self.path}/_{name}-{uuid.uuid4().hex}"), self._path(f"{self.path}/{name}.{numbers[-1] + 1 if numbers else 0}")
        out = self._fs.create(fresh)
        out.write(bytearray(text.encode()))
        out.close()
        if self._fs.exists(target) or not self._fs.rename(fresh, target):
            raise OSError(f"{target} was written by another")
        for n in numbers[:-1]:  # the one before stays for readers that have just listed it
            self._fs.delete(self._path(f"{self.path}/{name}.{n}"), False)

    def _manifest(self) -> dict:
        return json.loads(self._read_text("current") or "{}")

    @property
    def version(self) -> str | None:
        return self._manifest().get("version")

    def _bucket(self, row_id: Column, buckets: int) -> Column:
        return F.pmod(F.xxhash64(row_id), F.lit(buckets)).cast("int")

    def touched(self, these: DataFrame) -> list[int]:
        """The parts that hold the ids of ``these``, at most as many as there are."""
        n = self._manifest().get("buckets", self.buckets)
        return sorted(r[0] for r in these.select(self._bucket(F.col("id"), n)).distinct().collect())

    def _schema(self, now: dict) -> T.StructType:
        own = [T.StructField("id", T.StringType())]
        state = [T.StructField(c, T.LongType()) for c in ("first_seen", "last_seen", *EMAIL_STATE)]
        return T.StructType.fromJson(now["schema"]) if now else T.StructType(own + ENRICHED_SCHEMA.fields + state)

    def _base(self, now: dict, parts: list[int] | None) -> DataFrame:
        found = [f"{self.path}/{v}/part={k}" for k, v in now.get("parts", {}).items() if parts is None or int(k) in parts]
        schema = self._schema(now)
        return self.spark.read.schema(schema).parquet(*found) if found else self.spark.createDataFrame([], schema)

    def _newest(self, now: dict, parts: list[int] | None = None) -> DataFrame | None:
        """Of each id in the deltas its last row."""
        deltas = now.get("deltas", [])
        if not deltas:
            return None
        schema = self._schema(now)
        one = [self.spark.read.schema(schema).parquet(f"{self.path}/{d['path']}") for d in deltas]
        if parts is not None:
            one = [df.filter(self._bucket(F.col("id"), now["buckets"]).isin(parts)) for df in one]
        if len(one) == 1:
            return one[0]  # ids are unique within a delta
        rows = reduce(DataFrame.union, (df.select(F.col("id").alias("of"), F.struct("*").alias("whole"), F.lit(n).alias("n")) for n, df in enumerate(one)))
        return rows.groupBy("of").agg(F.max_by("whole", "n").alias("whole")).select("whole.*")

    def read(self, parts: list[int] | None = None) -> DataFrame:
        """The places, or those of some parts."""
        now = self._manifest()
        base, newest = self._base(now, parts), self._newest(now, parts)
        if newest is not None:
            gone = newest.select(F.col("id").alias("newer"))
            base = base.join(gone, F.col("id") == F.col("newer"), "left_anti").union(newest)
        return with_columns_added(base, EMAIL_STATE)

    def _files(self, now: dict) -> set[str]:
        return {f"{v}/part={k}" for k, v in now.get("parts", {}).items()} | {d["path"] for d in now.get("deltas", [])} | {p for p in now.get("memory", {}).values() if isinstance(p, str) and p.startswith("v-")}

    def _switch(self, now: dict, new: dict) -> None:
        """The new manifest in place; what neither it nor the last GRACE writes need is deleted."""
        dead = [sorted(self._files(now) - self._files(new)), *now.get("dead", [])]
        self._write_text("current", json.dumps(new | {"dead": dead[:GRACE]}))
        for path in (p for gone in dead[GRACE:] for p in gone):
            target = self._path(f"{self.path}/{path}")
            self._fs.delete(target, True)
            if "/part=" in path and not any(s.getPath().getName().startswith("part=") for s in self._fs.listStatus(target.getParent())):
                self._fs.delete(target.getParent(), True)

    def _written(self, rows: DataFrame, *partition: str) -> tuple[str, int]:
        """A new folder of rows and how many they are, by the footers of its files."""
        version = f"v-{uuid.uuid4().hex}"
        (rows.hint("rebalance", *partition).write.partitionBy(*partition) if partition else rows.hint("rebalance").write).parquet(f"{self.path}/{version}")
        return version, self.spark.read.schema(rows.schema).parquet(f"{self.path}/{version}").count()

    def write(self, places: DataFrame) -> str:
        """All places, as parts without deltas."""
        now = self._manifest()
        version, rows = self._written(places.withColumn("part", self._bucket(F.col("id"), self.buckets)), "part")
        new = {"version": version, "buckets": self.buckets, "schema": json.loads(places.schema.json()), "parts": self._parts_of(version), "deltas": [], "rows": rows, "memory": now.get("memory", {})}
        self._switch(now, new)
        return version

    def _parts_of(self, version: str) -> dict[str, str]:
        names = (s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.path}/{version}")))
        return {n.removeprefix("part="): version for n in names if n.startswith("part=")}

    def append(self, rows: DataFrame, memory: dict | None = None) -> int:
        """A delta of whole rows, one an id, that replace those of their ids or are new; how many. ``memory`` comes into place in the same step."""
        now = self._manifest()
        if not now:
            self.write(rows)
            if memory is not None:
                now = self._manifest()
                self._switch(now, now | {"memory": memory})
            return self._manifest()["rows"]
        # columns that the store does not have yet are added to its schema
        columns = {f.name: f for f in [*rows.schema.fields, *self._schema(now).fields]}
        columns = {c: columns[c] for c in dict.fromkeys([*(f.name for f in self._schema(now).fields), *columns])}
        shape = T.StructType([*columns.values()])
        version, n = self._written(rows.select(*((F.col(c) if c in rows.columns else F.lit(None)).cast(f.dataType).alias(c) for c, f in columns.items())))
        new = now if memory is None else now | {"memory": memory}
        if n:
            self._switch(now, new | {"version": version, "schema": json.loads(shape.json()), "deltas": [*now.get("deltas", []), {"path": version, "rows": n}]})
            self.tidy()
        else:
            self._fs.delete(self._path(f"{self.path}/{version}"), True)
            if new != now:
                self._switch(now, new)
        return n

    def memory(self) -> dict:
        """What a running enrichment has put beside the rows: tables by name, and plain values."""
        return self._manifest().get("memory", {})

    def put(self, table: DataFrame) -> str:
        """A table to be named by a memory."""
        return self._written(table)[0]

    def tidy(self) -> None:
        """Merge or fold the deltas, if they are many or large."""
        now = self._manifest()
        deltas = now.get("deltas", [])
        if sum(d["rows"] for d in deltas) > FOLD_SHARE * now["rows"]:
            self.fold()
        elif len(deltas) >= DELTAS:
            version, n = self._written(self._newest(now))
            self._switch(now, now | {"version": version, "deltas": [{"path": version, "rows": n}]})

    def fold(self) -> None:
        """The deltas become part of the parts they touch; other parts stay as they are."""
        now = self._manifest()
        if not now.get("deltas"):
            return
        parts = self.touched(self._newest(now))
        places = self.read(parts)
        version, _ = self._written(places.withColumn("part", self._bucket(F.col("id"), now["buckets"])), "part")
        new = now | {"version": version, "schema": json.loads(places.schema.json()), "parts": now["parts"] | self._parts_of(version), "deltas": []}
        self._switch(now, new | {"rows": self._base(new, None).count()})

    def rows_of(self, these: DataFrame) -> DataFrame:
        """The stored rows of some ids, from the parts that hold them."""
        return self.read(self.touched(these)).join(these.select(F.col("id").alias("asked")).distinct(), F.col("id") == F.col("asked"), "left_semi")

    def upsert(self, batch: DataFrame, at: int, merge: str = "replace", order: str | None = None) -> int:
        """All or nothing; how many places were new, counted while the delta is written."""
        batch = written(last_per_id(batch if "id" in batch.columns else batch.withColumn("id", stored_id()), order), "batch")
        if batch.isEmpty():
            return 0
        seen = Observation(f"upsert-{uuid.uuid4().hex}")
        self.append(upserted(self.rows_of(batch), batch, at, merge).observe(seen, F.count_if("is_new").alias("n")).drop("is_new"))
        return int(seen.get["n"] or 0)

    def mark_checked(self, these: DataFrame, at: int) -> None:
        self.append(mark_checked(self.rows_of(these), these, at))

    def mark_deferred(self, these: DataFrame, at: int) -> None:
        self.append(mark_deferred(self.rows_of(these), these, at))

    # Settings are a small file of names and values

    def settings(self) -> dict[str, str]:
        return json.loads(self._read_text("settings.json") or "{}")

    def setting(self, name: str) -> str | None:
        return self.settings().get(name)

    def set_setting(self, name: str, value: str | None) -> None:
        """Null deletes."""
        have = self.settings()
        have.pop(name, None)
        if value is not None:
            have[name] = value
        self._write_text("settings.json", json.dumps(have))

    def recheck_once(self, now: int, setting: str = "email_recheck") -> bool:
        """Once: places that were checked without an address wait again; since when is kept for contact_stats."""
        if self.setting(setting):
            return False
        again = F.col("email_checked_at").isNotNull() & empty("email_1")
        self.write(self.read().withColumn("email_checked_at", F.when(~again, F.col("email_checked_at"))))
        self.set_setting(setting, str(now))
        return True

    def stats(self, setting: str = "email_recheck") -> dict[str, DataFrame]:
        places = self.read()
        return {"contact": contact_stats(places, int(self.setting(setting) or 0)), **{c: facet(places, c) for c in ("category", "city", "state")}, "city_state": city_state_facet(places)}

    # Snapshots

    def snapshots(self) -> list[str]:
        """Days that have a copy, oldest first."""
        folder = self._path(f"{self.path}/snapshots")
        return sorted(f.getPath().getName() for f in self._fs.listStatus(folder)) if self._fs.exists(folder) else []

    def snapshot(self, day: str, keep: int = 7) -> bool:
        """A copy of the current version, one a day; only the newest ``keep`` stay. False if the day has one."""
        target = f"{self.path}/snapshots/{day}"
        if self.version is None or self._fs.exists(self._path(f"{target}/_SUCCESS")):
            return False
        self.read().write.mode("overwrite").parquet(target)
        names = self.snapshots()
        for name in names[: max(0, len(names) - keep)]:
            self._fs.delete(self._path(f"{self.path}/snapshots/{name}"), True)
        return True
