"""Where the stored articles are: the day of each and the version that is in force.

The tables of a store are laid out by day, but what arrives names articles by id. The index says for an id which day
its article was entered and which version came last. It is dealt into buckets by id, and a batch reads the
buckets of its own ids only, not the ids of all days.

Taking in a batch appends rows; a bucket that has grown to `CROWDED` pieces is written anew with one row
for each article. The number of buckets is kept in their names, so it may differ between stores.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.sources import schemas

BUCKETS = 16
CROWDED = 8


def bucket_name(id_col: Column, buckets: int) -> Column:
    number = F.pmod(F.xxhash64(id_col), F.lit(buckets)).cast("string")
    return F.concat(F.lit(f"{buckets}-"), number)


def bucket_count(names) -> int | None:
    """How many buckets an index with these bucket names was dealt into; None if there is none."""
    return next((int(name.partition("-")[0]) for name in names), None)


def version_digest() -> Column:
    """Orders versions of an article that arrived at the same time, the same way at every retry."""
    return F.xxhash64(*[field.split()[0] for field in schemas.ENTRIES.split(", ")])


def index_rows(entries: DataFrame, buckets: int) -> DataFrame:
    """Rows for articles with their ``day`` and, if known, ``arrived_at`` and ``digest``."""
    absent = {c: F.lit(None).cast(t) for c, t in (("arrived_at", "timestamp"), ("digest", "bigint")) if c not in entries.columns}
    return entries.withColumns(absent).select(
        "id",
        F.col("date_entered").alias("entered"),
        F.col("day").alias("entered_day"),
        "arrived_at",
        "digest",
        bucket_name(F.col("id"), buckets).alias("day"),
    )


def newest_rows(index: DataFrame) -> DataFrame:
    """One row for each article: its day, which never changes, and the last version."""
    last = F.max(F.struct("arrived_at", "digest")).alias("last")
    place = F.min(F.struct("entered", "entered_day")).alias("place")
    return index.groupBy("id", "day").agg(place, last).select(
        "id", "place.entered", "place.entered_day", "last.arrived_at", "last.digest", "day"
    )


def crowded(names: list[str]) -> set[str]:
    """Buckets, named once for each of their pieces, that have many."""
    return {name for name, pieces in Counter(names).items() if pieces >= CROWDED}
