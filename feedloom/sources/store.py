"""Versioned tables of articles, rewritten by day and switched by one commit.

Parquet cannot be overwritten while it is read, and a run changes several
tables that only make sense together. So a run writes new versions of the days
it touched, next to the old ones, and then appends one commit that says which
version of which day of every table is in force. A run that stops earlier
leaves the old state in force and is simply repeated.

All tables are laid out by the day their article was entered, so a run reads
the days of its lookback only, however long the history is. The day of an
article never changes: a new version keeps the date the first one was entered.
One run at a time may write.

Versions are numbered without gaps and each has a commit file of its own under
its number, so the last one is found by asking for names, not by reading a log.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from feedloom.operators.inference import TextBackend
from feedloom.operators.merge import enforce_references
from feedloom.operators.tagging import TagBackend
from feedloom.options import EnrichOptions
from feedloom.plans.run import Backlog, RunResult, enrich
from feedloom.sources import schemas
from feedloom.sources.index import (
    BUCKETS,
    bucket_count,
    bucket_name,
    crowded,
    index_rows,
    newest_rows,
    version_digest,
)
from feedloom.sources.staging import child_names, exists, recorded_stages, remove, stage
from feedloom.sources.tables import Tables, migrate_translations

COMMITS = (
    "version BIGINT, batch_id BIGINT, committed_at STRING, last_tag_id BIGINT, "
    "parts ARRAY<STRUCT<name: STRING, day: STRING, version: BIGINT>>"
)
DAILY = ("entries", "user_entries", "tags", "translations", "attempts")
UNKNOWN_DAY = "unknown"
UNDATED = "all"


def day_of(entered: Column) -> Column:
    return F.coalesce(F.date_format(entered, "yyyy-MM-dd"), F.lit(UNKNOWN_DAY)).alias("day")


def with_days(tables: Tables) -> Tables:
    """The tables with the day of their article."""
    days = tables.entries.select(F.col("id").alias("entry_id"), day_of(F.col("date_entered")))
    by_subscription = tables.user_entries.select("int_id", F.col("ref_id").alias("entry_id")).join(
        days, "entry_id", "left"
    )

    def known(df: DataFrame) -> DataFrame:
        return df.withColumn("day", F.coalesce("day", F.lit(UNKNOWN_DAY)))

    return Tables(
        entries=tables.entries.withColumn("day", day_of(F.col("date_entered"))),
        user_entries=known(
            tables.user_entries.join(
                days.withColumnRenamed("entry_id", "ref_id"), "ref_id", "left"
            )
        ),
        feeds=tables.feeds,
        tags=known(
            tables.tags.join(
                by_subscription.select(F.col("int_id").alias("post_int_id"), "day"),
                "post_int_id",
                "left",
            )
        ),
        translations=known(tables.translations.join(days, "entry_id", "left")),
        attempts=None
        if tables.attempts is None
        else known(tables.attempts.join(days, "entry_id", "left")),
    )


class TableStore:
    """The tables under one root folder, as of the last commit."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        """``buckets`` of the index by article id, about one for a million articles, if it has none yet."""
        self.spark = spark
        self.root = root.rstrip("/")
        self.buckets = buckets
        self._seen = -1  # the highest version known to be committed
        self._read: tuple | None = None  # the last commit file read, which never changes, and its version

    @classmethod
    def create(
        cls, spark: SparkSession, root: str, tables: Tables, buckets: int = BUCKETS
    ) -> TableStore:
        """A new store holding ``tables``; an older tracking table is migrated."""
        store = cls(spark, root, buckets)
        tracking = migrate_translations(tables.translations, tables.user_entries)
        dated = with_days(replace(tables, translations=tracking))
        index = index_rows(dated.entries, buckets)
        store.commit({**dict(dated.items()), "index": index}, replaced=None)
        return store

    def last_commit(self):
        """The commit in force, or None."""
        step = 1
        while self._committed(self._seen + step):
            self._seen += step
            step *= 2
        while step > 1:
            step //= 2
            if self._committed(self._seen + step):
                self._seen += step
        if self._seen < 0:
            return None
        if self._read is None or self._read[0] != self._seen:
            commit = self.spark.read.schema(COMMITS).json(self._commit_path(self._seen)).first()
            self._read = (self._seen, commit)
        return self._read[1]

    def _commit_path(self, version: int) -> str:
        return f"{self.root}/_commits/{version}"

    def _committed(self, version: int) -> bool:
        # written last, once the commit is complete
        return exists(self.spark, f"{self._commit_path(version)}/_SUCCESS")

    def read(self, name: str, days=None, commit=None) -> DataFrame:
        """A table with its ``day`` column; ``days`` is a test for the days wanted."""
        commit = commit or self.last_commit()
        parts = [p for p in commit.parts if p.name == name] if commit else []
        wanted = [p for p in parts if days is None or days(p.day)]
        schema = f"{schemas.ALL[name]}, day STRING"
        if not wanted:
            return self.spark.createDataFrame([], schema)
        folder = f"{self.root}/{name}"
        return (
            self.spark.read.schema(f"{schema}, v BIGINT")
            .option("basePath", folder)
            .parquet(*[f"{folder}/v={p.version}/day={p.day}" for p in wanted])
            .drop("v")
        )

    def tables(self, days=None) -> Tables:
        """A snapshot, cut down to some days."""
        commit = self.last_commit()
        return Tables(
            **{name: self.read(name, days, commit) for name in DAILY},
            feeds=self.read("feeds", commit=commit).drop("day"),
            tag_ids=self.spark.createDataFrame([(commit.last_tag_id,)], "id long"),
        )

    def commit(
        self,
        updates: dict[str, DataFrame],
        replaced: set[str] | None,
        batch_id: int | None = None,
        errors: DataFrame | None = None,
    ) -> int:
        """Write the given rows and put them in force.

        Of every table in ``updates`` the days in ``replaced`` are superseded;
        ``None`` stands for all of them. ``errors`` join those of earlier runs.
        """
        last = self.last_commit()
        version = last.version + 1 if last else 0
        batch = batch_id if batch_id is not None else (last.batch_id if last else None)
        parts = [
            p
            for p in (last.parts if last else [])
            if p.name not in updates or not (replaced is None or p.day in replaced)
        ]
        for name, rows in updates.items():
            parts.extend(self._write(name, rows, version))
        # always written, as a run that died may have left its errors under this version
        failed = errors if errors is not None else self.spark.createDataFrame([], schemas.ERRORS)
        failed.write.mode("overwrite").parquet(f"{self.root}/errors/version={version}")
        tag_id = last.last_tag_id if last else 0
        if any(name == "tags" and v == version for name, _, v in parts):
            tags = self.spark.read.schema(schemas.TAGS).parquet(f"{self.root}/tags/v={version}")
            tag_id = max(tag_id, tags.agg(F.max("id")).first()[0] or 0)
        row = (version, batch, datetime.now().isoformat(), tag_id, parts)
        log = self.spark.createDataFrame([row], COMMITS).coalesce(1)
        log.write.mode("overwrite").json(self._commit_path(version))
        return version

    def _write(self, name: str, rows: DataFrame, version: int) -> list[tuple[str, str, int]]:
        if "day" not in rows.columns:
            rows = rows.withColumn("day", F.lit(UNDATED))
        columns = self.spark.createDataFrame([], schemas.ALL[name]).columns
        path = f"{self.root}/{name}/v={version}"
        # rebalancing splits a day that holds much of the data and joins small ones
        balanced = rows.select(*columns, "day").hint("rebalance", "day")
        balanced.write.mode("overwrite").partitionBy("day").parquet(path)
        folders = [n for n in child_names(self.spark, path) if n.startswith("day=")]
        return [(name, n.removeprefix("day="), version) for n in folders]

    def errors(self) -> DataFrame:
        """Failures of all committed runs."""
        commit = self.last_commit()
        schema = f"{schemas.ERRORS}, version BIGINT"
        try:
            log = self.spark.read.schema(schema).parquet(f"{self.root}/errors")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)
        return log.where(F.col("version") <= commit.version)


def lookback_days(options: EnrichOptions):
    """Test for the days a run has to read."""
    first = (options.run_ts - timedelta(hours=options.lookback_hours)).date().isoformat()
    return lambda day: day != UNKNOWN_DAY and day >= first


@dataclass(frozen=True)
class Arrivals:
    """What arrived, laid out by day, and what that adds to the index."""

    articles: DataFrame
    subscriptions: DataFrame
    index: DataFrame
    rewritten: set[str]  # buckets of the index that this replaces


def settle_days(store: TableStore, arrived: DataFrame, subscribed: DataFrame) -> Arrivals:
    """Arrivals with the day of their article, without versions older than the stored one.

    A known article keeps the date it was entered. Only the buckets of the index that the
    arrivals fall into are read. Articles without ``arrived_at`` are newer than any other,
    a version that arrives again is left out.
    """
    commit = store.last_commit()
    names = [p.day for p in commit.parts if p.name == "index"] if commit else []
    buckets = bucket_count(names) or store.buckets
    asked = arrived.select("id").union(subscribed.select("ref_id")).distinct()
    asked = stage(asked.withColumn("day", bucket_name(F.col("id"), buckets)), "asked")
    touched = {row.day for row in asked.select("day").distinct().collect()}
    if names:
        index = store.read("index", touched.__contains__)
    else:  # a store from before there was an index
        index = index_rows(store.read("entries"), buckets)
    stored = newest_rows(index.join(asked.select("id"), "id", "left_semi"))
    known = stage(
        stored.select(
            "id",
            F.col("entered").alias("_entered"),
            F.col("entered_day").alias("_day"),
            F.struct("arrived_at", "digest").alias("_last"),
        ),
        "known",
    )
    articles = arrived
    if "arrived_at" in articles.columns:
        articles = articles.withColumn("digest", version_digest())
    articles = articles.join(known, "id", "left")
    if "arrived_at" in articles.columns:
        version = F.struct("arrived_at", "digest")
        newer = F.col("arrived_at").isNull() | (version > F.col("_last"))
        articles = articles.where(F.col("_last").isNull() | newer)
    entered = F.when(F.col("_day").isNotNull(), F.col("_entered")).otherwise(F.col("date_entered"))
    articles = (
        articles.withColumn("date_entered", entered)
        .withColumn("day", F.coalesce("_day", day_of(F.col("date_entered"))))
        .drop("_entered", "_day", "_last")
    )
    days = known.select("id", F.col("_day").alias("day")).union(articles.select("id", "day"))
    days = days.distinct().withColumnRenamed("id", "ref_id")
    subscriptions = subscribed.join(days, "ref_id", "left").withColumn(
        "day", F.coalesce("day", F.lit(UNKNOWN_DAY))
    )
    fresh = index_rows(articles, buckets)
    if not names:
        index = index_rows(store.read("entries"), buckets)
        return Arrivals(articles, subscriptions, newest_rows(index.unionByName(fresh)), set())
    full = crowded([name for name in names if name in touched])
    if full:
        fresh = newest_rows(index.where(F.col("day").isin(*full)).unionByName(fresh))
    return Arrivals(articles, subscriptions, fresh, full)


def run_on_store(
    store: TableStore,
    options: EnrichOptions,
    translator: TextBackend | DataFrame,
    tagger: TagBackend | None = None,
    fulltext: DataFrame | None = None,
    *,
    arrived: DataFrame | None = None,
    subscribed: DataFrame | None = None,
    batch_id: int | None = None,
    backlog: Backlog | None = None,
) -> RunResult:
    """One run over the stored tables, with its results committed.

    ``arrived`` are new or changed articles, one row each, and ``subscribed``
    new subscriptions to take in first; they become visible in the same commit.
    With a column ``arrived_at``, a version older than the stored one is left out.
    What was staged is removed then, but for the outcome. Nothing is written in
    a dry run. Days and tables in which nothing changes are left as they are. ``backlog``
    is what was planned before and is still to be done.
    """
    if arrived is None and subscribed is not None:
        arrived = store.spark.createDataFrame([], schemas.ENTRIES)
    if subscribed is None and arrived is not None:
        subscribed = store.spark.createDataFrame([], schemas.USER_ENTRIES)
    with recorded_stages() as made:
        in_lookback = lookback_days(options)
        new_days: set[str] = set()
        taken = None
        if arrived is not None:
            taken = settle_days(store, arrived, subscribed)
            both = taken.articles.select("day").union(taken.subscriptions.select("day"))
            new_days = {row.day for row in both.distinct().collect()}
        tables = store.tables(lambda day: in_lookback(day) or day in new_days)
        if taken is not None:
            tables = tables.with_arrivals(taken.articles, taken.subscriptions)
        result = enrich(tables, options, translator, tagger, fulltext, backlog)
        if options.dry_run:
            return result
        touched = sorted(new_days | {row.day for row in result.changes})
        tagged = any(row.tagged for row in result.changes)
        failed = any(row.failed for row in result.changes)
        commit = store.last_commit()
        noted = any(p.name == "attempts" and p.day in touched for p in commit.parts) if commit else False
        same = {"tags": not tagged, "user_entries": not tagged and taken is None, "attempts": not failed and not noted}
        after = dict(result.tables.items())
        changing = [name for name in DAILY if touched and not same.get(name)]
        updates = {name: after[name].where(F.col("day").isin(*touched)) for name in changing}
        replaced = set(touched)
        if taken is not None:
            updates["index"] = taken.index
            replaced |= taken.rewritten
        store.commit(updates, replaced, batch_id, errors=result.errors)
    folders = {path.rpartition("/")[0]: path.endswith("/outcome") for path in made}
    for folder, is_outcome in folders.items():
        if not is_outcome:
            remove(store.spark, folder)
    kept = replace(result, staged=tuple(f for f, is_outcome in folders.items() if is_outcome))
    vars(kept)["changes"] = result.changes  # counted once
    return kept


def clean_references(store: TableStore) -> int:
    """Maintenance: drop tracking rows whose article or subscription is gone."""
    tables = store.tables()
    kept = enforce_references(
        tables.translations, tables.entries, tables.user_entries, tables.feeds
    )
    return store.commit({"translations": kept}, replaced=None)

