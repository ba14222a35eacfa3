"""Filters: what a caller asks for, compiled to one conjunction that reaches the scan."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placemill.schema import SORTABLE, empty, filled


@dataclass(frozen=True)
class PlaceFilter:
    """A query over stored places. A list wins over its single value; an empty list, value or search is no filter."""

    categories: tuple[str, ...] = ()
    cities: tuple[str, ...] = ()
    states: tuple[str, ...] = ()
    category: str | None = None
    city: str | None = None
    state: str | None = None
    query: str | None = None
    has_email: bool = False
    missing_email: bool = False
    has_phone: bool = False
    has_website: bool = False
    min_rating: float | None = None
    min_reviews: float | None = None
    search: str | None = None
    sort: str = "reviews"
    ascending: bool = False
    limit: int = 1000
    offset: int = 0

    def conditions(self) -> list[Column]:
        out: list[Column] = []
        for column, many, one in (("category", self.categories, self.category), ("city", self.cities, self.city), ("state", self.states, self.state)):
            values = list(many) or ([one] if one else [])
            if values:
                out.append(F.col(column).isin(values))
        if self.query:
            out.append(F.col("query") == self.query)
        for asked, condition in ((self.has_email, filled("email_1")), (self.missing_email, empty("email_1")), (self.has_phone, filled("phone")), (self.has_website, filled("site"))):
            if asked:
                out.append(condition)
        if self.min_rating is not None:
            out.append(F.col("rating") >= self.min_rating)
        if self.min_reviews is not None:
            out.append(F.col("reviews") >= self.min_reviews)
        if self.search:  # percent sign and underscore stand for anything; letters beyond ASCII fold too
            out.append(F.col("name").ilike(f"%{self.search}%"))
        return out

    def where(self, places: DataFrame) -> DataFrame:
        conditions = self.conditions()
        return places.filter(reduce(and_, conditions)) if conditions else places

    def order(self) -> list[Column]:
        """Nulls last either way, id last of all so that pages don't overlap."""
        c = F.col(self.sort if self.sort in SORTABLE else "reviews")
        return [c.asc_nulls_last() if self.ascending else c.desc_nulls_last(), F.col("id")]

    def page(self, places: DataFrame) -> DataFrame:
        if int(self.limit) < 0 or int(self.offset) < 0:
            raise ValueError("limit and offset are whole numbers from 0")
        out = self.where(places).orderBy(*self.order())
        return (out.offset(int(self.offset)) if self.offset else out).limit(int(self.limit))


@dataclass(frozen=True)
class QuickFilter:
    """Filters on fresh records, before they are stored. Unlike PlaceFilter, unknown reviews count as none."""

    only_with_website: bool = False
    only_without_website: bool = False
    with_phone: bool = False
    verified: bool = False
    operational_only: bool = False
    min_reviews: float | None = None
    min_rating: float | None = None
    max_rating: float | None = None
    extra: tuple[Column, ...] = field(default=())

    def conditions(self) -> list[Column]:
        status = F.col("business_status")
        asked = (
            (self.only_with_website, filled("site")),
            (self.only_without_website, empty("site")),
            (self.with_phone, filled("phone")),
            (self.verified, F.col("verified").eqNullSafe(True)),
            (self.operational_only, status.isNull() | (status == "OPERATIONAL")),
        )
        out = [c for on, c in asked if on]
        if self.min_reviews is not None:
            out.append(F.coalesce("reviews", F.lit(0)) >= self.min_reviews)
        if self.min_rating is not None:
            out.append(F.col("rating") >= self.min_rating)
        if self.max_rating is not None:
            out.append(F.col("rating") <= self.max_rating)
        return [*out, *self.extra]

    def where(self, places: DataFrame) -> DataFrame:
        conditions = self.conditions()
        return places.filter(reduce(and_, conditions)) if conditions else places

    def conflicts(self) -> list[str]:
        """What can't hold together."""
        both = self.only_with_website and self.only_without_website
        crossed = self.min_rating is not None and self.max_rating is not None and self.min_rating > self.max_rating
        return [message for found, message in zip((both, crossed), CONFLICTS, strict=True) if found]


CONFLICTS = ("with and without website exclude each other", "the least rating is above the highest")


def conflicts_of() -> Column:
    """The same for a table of requests whose columns are named like the fields of QuickFilter; nulls ask nothing."""
    both = F.col("only_with_website") & F.col("only_without_website")
    crossed = F.col("min_rating") > F.col("max_rating")
    return F.array_compact(F.array(*(F.when(found, F.lit(message)) for found, message in zip((both, crossed), CONFLICTS, strict=True))))


def cleaned_request(queries: list[object], locations: list[object]) -> tuple[list[str], list[object]]:
    """Queries as trimmed text without blanks; at least one of each is needed."""
    texts = [t for t in (str(q).strip() for q in queries) if t]
    if not texts or not locations:
        raise ValueError("a job needs a query and a location")
    return texts, list(locations)
