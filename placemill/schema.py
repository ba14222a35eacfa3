"""The place record: columns, types and export order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_HOURS = T.MapType(T.StringType(), T.StringType())
_SLOT = T.StructType([T.StructField("hour", T.LongType()), T.StructField("percentage", T.LongType())])

#: Columns that are not plain strings.
_TYPES: dict[str, T.DataType] = {
    "area_service": T.BooleanType(),
    "latitude": T.DoubleType(),
    "longitude": T.DoubleType(),
    "popular_times": T.MapType(T.StringType(), T.ArrayType(_SLOT)),
    "posts": T.VariantType(),
    "reviews_tags": T.ArrayType(T.StringType()),
    "rating": T.DoubleType(),
    "reviews": T.LongType(),
    "photos_count": T.LongType(),
    "working_hours": _HOURS,
    "other_hours": T.ArrayType(T.MapType(T.StringType(), _HOURS)),
    "about": T.MapType(T.StringType(), T.MapType(T.StringType(), T.BooleanType())),
    "reviews_per_score": T.StructType([T.StructField(str(k), T.LongType()) for k in range(1, 6)]),
    "reservation_links": T.ArrayType(T.StringType()),
    "order_links": T.ArrayType(T.StringType()),
    "verified": T.BooleanType(),
}

# The export order, which consumers of exports rely on.
PLACE_COLUMNS = (
    "query name place_id google_id full_address borough street postal_code area_service country_code country city us_state state plus_code latitude longitude time_zone popular_times "
    "site phone type logo description located_in located_google_id category subtypes posts reviews_tags rating reviews photos_count cid reviews_link reviews_id photo street_view "
    "working_hours_old_format working_hours other_hours business_status about range reviews_per_score reservation_links booking_appointment_link menu_link order_links owner_id verified "
    "owner_title owner_link location_link"
).split()
SOCIALS = "facebook instagram linkedin twitter youtube tiktok".split()
ENRICHMENT_COLUMNS = ["email_1", "email_2", "email_3", *SOCIALS]
LEAD_COLUMNS = "name category city state phone email website address rating reviews".split()
SORTABLE = "reviews rating name city state category first_seen last_seen".split()

#: Columns that belong to the store and not to the observation.
STORE_COLUMNS = {"id": "string", "first_seen": "long", "last_seen": "long"}
EMAIL_STATE = {"email_checked_at": "long", "email_attempts": "long", "email_retry_at": "long"}

PLACE_SCHEMA = T.StructType([T.StructField(c, _TYPES.get(c, T.StringType())) for c in PLACE_COLUMNS])
ENRICHED_SCHEMA = T.StructType(PLACE_SCHEMA.fields + [T.StructField(c, T.StringType()) for c in ENRICHMENT_COLUMNS])


def typed_null(column: str) -> Column:
    return F.lit(None).cast(_TYPES.get(column, T.StringType()))


def as_places(df: DataFrame, enriched: bool = False) -> DataFrame:
    """Every column of the schema, in its order; what ``df`` lacks is null, what it has beyond stays behind."""
    schema = ENRICHED_SCHEMA if enriched else PLACE_SCHEMA
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema))


def with_columns_added(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Schema evolution: missing columns are added as nulls."""
    return df.withColumns({c: F.lit(None).cast(kind) for c, kind in columns.items() if c not in df.columns})


def filled(column: Column | str) -> Column:
    """Neither null nor empty."""
    c = F.col(column) if isinstance(column, str) else column
    return c.isNotNull() & (c != "")


def empty(column: Column | str) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return c.isNull() | (c == "")
