"""Reading the article tables, and the additive migration of the tracking table."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from feedloom.functions.tags import no_tags
from feedloom.sources import schemas


@dataclass(frozen=True)
class Tables:
    """One snapshot of everything a run reads."""

    entries: DataFrame
    user_entries: DataFrame
    feeds: DataFrame
    tags: DataFrame
    translations: DataFrame
    # failed tries, None where nobody keeps them
    attempts: DataFrame | None = None
    # all tag ids in use, where ``tags`` is only a part of the table
    tag_ids: DataFrame | None = None

    def items(self):
        named = [(field.name, getattr(self, field.name)) for field in fields(self)]
        return [(name, df) for name, df in named if name != "tag_ids" and df is not None]

    def with_arrivals(self, arrived: DataFrame, subscribed: DataFrame | None) -> Tables:
        """The tables after new versions of articles and new subscriptions came in."""
        kept = self.entries.join(arrived.select("id"), "id", "left_anti")
        entries = kept.unionByName(arrived.select(*kept.columns))
        user_entries = self.user_entries
        if subscribed is not None:
            new = subscribed.join(user_entries.select("int_id"), "int_id", "left_anti")
            user_entries = user_entries.unionByName(new.select(*user_entries.columns))
        return replace(self, entries=entries, user_entries=user_entries)


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], schemas.ALL[name])


def read_parquet(spark: SparkSession, name: str, path: str) -> DataFrame:
    """Parquet table with its declared schema, no inference."""
    return spark.read.schema(schemas.ALL[name]).parquet(path)


def read_or_create(spark: SparkSession, name: str, path: str) -> DataFrame:
    """The table at ``path``, or an empty one with its schema if there is none."""
    try:
        return read_parquet(spark, name, path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty(spark, name)


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    *,
    split_column: str,
    lower: int,
    upper: int,
    partitions: int,
    **options: str,
) -> DataFrame:
    """The table in a relational database, read in parallel key ranges.

    Needs the database's driver on the class path. Filters on the result are
    pushed to the database by Spark.
    """
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, **options)
        .option("partitionColumn", split_column)
        .option("lowerBound", lower)
        .option("upperBound", upper)
        .option("numPartitions", partitions)
        .load()
    )


def migrate_translations(translations: DataFrame, user_entries: DataFrame) -> DataFrame:
    """Bring an older tracking table to the current columns.

    A missing ``generated_tags`` becomes the empty list. A missing or null
    ``user_entry_id`` is filled from the subscription with the same article
    and owner; of several the smallest id.
    """
    if "generated_tags" not in translations.columns:
        translations = translations.withColumn("generated_tags", no_tags())
    if "user_entry_id" not in translations.columns:
        translations = translations.withColumn("user_entry_id", F.lit(None).cast("bigint"))
    first = user_entries.groupBy(
        F.col("ref_id").alias("entry_id"), F.col("owner_uid")
    ).agg(F.min("int_id").alias("first_int_id"))
    return translations.join(first, ["entry_id", "owner_uid"], "left").select(
        *[
            F.coalesce(F.col(c), F.col("first_int_id")).alias(c) if c == "user_entry_id" else F.col(c)
            for c in translations.columns
        ]
    )
