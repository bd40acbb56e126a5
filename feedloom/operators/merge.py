"""Merging the outcome of a run into the tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.tags import (
    clean_tags,
    format_tag_cache,
    merge_tags,
    no_tags,
    unique_tags,
    without_tags,
)
from feedloom.operators.ordering import with_positions
from feedloom.options import STORED_ERROR_CHARS

# Owners and feeds are few and hold many rows each; a row meets one of so many copies.
SALTS = 32


def count_attempts(
    attempts: DataFrame, tried: DataFrame, run_ts: datetime, retry_minutes: int | None
) -> DataFrame:
    """The ledger of failed tries after a run.

    ``tried`` has ``entry_id, owner_uid, failed`` for every article the run tried to translate.
    One that was translated leaves the ledger; one that failed waits twice as long as before.
    """
    key = ["entry_id", "owner_uid"]
    kept = attempts.join(tried.select(*key), key, "left_anti")
    known = attempts.select(*key, F.col("attempts").alias("_before"))
    failed = tried.where("failed").join(known, key, "left")
    before = F.coalesce("_before", F.lit(0))
    wait = F.lit(retry_minutes).cast("bigint") * F.pow(F.lit(2), F.least(before, F.lit(30))).cast("bigint")
    next_try = F.timestamp_micros(F.unix_micros(F.lit(run_ts).cast("timestamp")) + wait * 60_000_000)
    new = failed.withColumn("attempts", before + 1).withColumn("next_try", next_try)
    return kept.unionByName(new.select(*attempts.columns))


def overwrite_articles(entries: DataFrame, changes: DataFrame) -> DataFrame:
    """Articles with the title and content of ``changes(entry_id, title, content)``."""
    new = changes.select(
        F.col("entry_id").alias("id"),
        F.col("title").alias("_title"),
        F.col("content").alias("_content"),
        F.lit(True).alias("_changed"),
    )
    return entries.join(new, "id", "left").select(
        *[
            F.when(F.col("_changed"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
            if c in ("title", "content")
            else F.col(c)
            for c in entries.columns
        ]
    )


def upsert_translations(translations: DataFrame, saved: DataFrame, run_ts: datetime) -> DataFrame:
    """Tracking rows of ``saved`` replace or join those with the same article."""
    kept = translations.join(saved.select("entry_id"), "entry_id", "left_anti")
    rows = _saved_rows(translations.columns, saved, run_ts)
    return kept.select(*translations.columns).unionByName(rows)


def _saved_rows(columns: list[str], saved: DataFrame, run_ts: datetime) -> DataFrame:
    now = F.lit(run_ts).cast("timestamp")
    stamps = {
        "translated_at": now,
        "updated_at": now,
        "reapplied_at": F.lit(None).cast("timestamp"),
        "last_error": F.lit(None).cast("string"),
    }
    return saved.select(*[stamps.get(c, F.col(c)).alias(c) for c in columns])


def apply_changes(
    translations: DataFrame, changes: DataFrame, saved: DataFrame, run_ts: datetime
) -> DataFrame:
    """The tracking table after a run: changes of every kind in one join.

    ``changes`` has ``entry_id, kind, new_tags, persist, message``, one row per
    article; ``kind`` is ``save``, ``reapply``, ``tags`` or ``error``. Rows to
    save give way to those of ``saved``, whose texts take no part in the join.
    """
    now = F.lit(run_ts).cast("timestamp")
    kind = F.col("kind")
    new_tags = (kind == "tags") | ((kind == "reapply") & F.col("persist"))
    message = F.when(kind == "error", F.left("message", F.lit(STORED_ERROR_CHARS)))
    values = {
        "reapplied_at": F.when(kind == "reapply", now).otherwise(F.col("reapplied_at")),
        "updated_at": F.when(kind.isNotNull(), now).otherwise(F.col("updated_at")),
        "last_error": F.when(kind.isNotNull(), message).otherwise(F.col("last_error")),
        "generated_tags": F.when(new_tags, F.col("new_tags")).otherwise(F.col("generated_tags")),
    }
    kept = translations.join(changes, "entry_id", "left").where(kind.isNull() | (kind != "save"))
    updated = kept.select(*[values.get(c, F.col(c)).alias(c) for c in translations.columns])
    return updated.unionByName(_saved_rows(translations.columns, saved, run_ts))


def _update(table: DataFrame, changes: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Rows of ``table`` whose article is in ``changes`` get the given values."""
    marked = changes.withColumn("_hit", F.lit(True))
    joined = table.join(marked, "entry_id", "left")
    return joined.select(
        *[
            F.when(F.col("_hit"), values[c]).otherwise(F.col(c)).alias(c)
            if c in values
            else F.col(c)
            for c in table.columns
        ]
    )


def stamp_reapplied(translations: DataFrame, changes: DataFrame, run_ts: datetime) -> DataFrame:
    """Note a replay; ``changes`` has ``entry_id, new_tags, persist``."""
    now = F.lit(run_ts).cast("timestamp")
    tags = F.when(F.col("persist"), F.col("new_tags")).otherwise(F.col("generated_tags"))
    return _update(
        translations,
        changes,
        {
            "reapplied_at": now,
            "updated_at": now,
            "last_error": F.lit(None).cast("string"),
            "generated_tags": tags,
        },
    )


def store_generated_tags(translations: DataFrame, changes: DataFrame, run_ts: datetime) -> DataFrame:
    """Keep newly generated tags of untouched articles; ``changes`` has ``entry_id, new_tags``."""
    return _update(
        translations,
        changes,
        {
            "generated_tags": F.col("new_tags"),
            "updated_at": F.lit(run_ts).cast("timestamp"),
            "last_error": F.lit(None).cast("string"),
        },
    )


def stamp_errors(translations: DataFrame, failures: DataFrame, run_ts: datetime) -> DataFrame:
    """Note the message of failed articles that have a tracking row."""
    return _update(
        translations,
        failures.select("entry_id", "message"),
        {
            "last_error": F.left("message", F.lit(STORED_ERROR_CHARS)),
            "updated_at": F.lit(run_ts).cast("timestamp"),
        },
    )


def merge_subscription_tags(tags: DataFrame, generated: DataFrame) -> DataFrame:
    """Tags to add per subscription and the list it then has.

    ``generated`` has ``owner_uid, user_entry_id, generated`` and any columns
    new tag rows are to carry. The list starts from the tags table in id order; subscriptions whose generated tags do not
    survive cleaning are left out.
    """
    new = (
        generated.withColumnRenamed("user_entry_id", "post_int_id")
        .withColumn("new_tags", unique_tags(clean_tags(F.col("generated"))))
        .drop("generated")
        .where(F.size("new_tags") > 0)
    )
    keys = ["owner_uid", "post_int_id"]
    present = (
        tags.join(new.select(*keys), keys, "left_semi")
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("id", "tag_name"))).alias("rows"))
        .select(*keys, F.transform("rows", lambda row: row["tag_name"]).alias("stored"))
    )
    existing = F.coalesce(merge_tags(F.col("stored"), no_tags()), no_tags())
    return (
        new.join(present, keys, "left")
        .withColumn("existing", existing)
        .withColumn("missing", without_tags(F.col("new_tags"), F.col("existing")))
        .withColumn("merged", merge_tags(F.col("existing"), F.col("new_tags")))
        .drop("new_tags", "stored", "existing")
    )


def new_tag_rows(tags: DataFrame, merged: DataFrame, tag_ids: DataFrame | None = None) -> DataFrame:
    """Rows to append to the tags table, with ids after those in use.

    ``tag_ids`` lists the ids in use where ``tags`` is only a part.
    """
    rows = merged.select("*", F.posexplode("missing").alias("nth", "tag_name"))
    numbered = with_positions(
        rows.drop("missing", "merged"), [F.col("post_int_id"), F.col("owner_uid"), F.col("nth")]
    )
    used = tags if tag_ids is None else tag_ids
    last = F.coalesce(used.agg(F.max("id")).scalar(), F.lit(0))
    return numbered.withColumn("id", last + F.col("position") + 1).select(*tags.columns)


def rewrite_tag_cache(user_entries: DataFrame, merged: DataFrame) -> DataFrame:
    """Subscriptions with the tag cache of ``merged``; others as they are."""
    caches = merged.select(
        F.col("post_int_id").alias("int_id"),
        "owner_uid",
        format_tag_cache(F.col("merged")).alias("_cache"),
    )
    return user_entries.join(caches, ["int_id", "owner_uid"], "left").select(
        *[
            F.coalesce("_cache", c).alias(c) if c == "tag_cache" else F.col(c)
            for c in user_entries.columns
        ]
    )


def enforce_references(
    translations: DataFrame, entries: DataFrame, user_entries: DataFrame, feeds: DataFrame
) -> DataFrame:
    """Tracking rows whose article, owner and subscription exist.

    ``feed_id`` becomes null when the feed is gone. Owners are known by their
    subscriptions only. A row that names no subscription breaks no rule.
    """
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    owners = user_entries.select("owner_uid").distinct().select("owner_uid", salts)
    subscriptions = user_entries.select(F.col("int_id").alias("user_entry_id"))
    named = translations.where(F.col("user_entry_id").isNotNull())
    unnamed = translations.where(F.col("user_entry_id").isNull())
    known_feeds = feeds.select(F.col("id").alias("_feed"), F.lit(True).alias("_known")).distinct()
    known_feeds = known_feeds.select("_feed", "_known", salts)
    kept = (
        named.join(subscriptions, "user_entry_id", "left_semi")
        .unionByName(unnamed)
        .join(entries.select(F.col("id").alias("entry_id")), "entry_id", "left_semi")
        .withColumn("_salt", F.pmod(F.xxhash64("entry_id"), F.lit(SALTS)).cast("int"))
        .join(owners, ["owner_uid", "_salt"], "left_semi")
        .withColumn("_feed", F.col("feed_id"))
        .join(known_feeds, ["_feed", "_salt"], "left")
    )
    return kept.select(
        *[
            F.when(F.col("_known"), F.col(c)).alias(c) if c == "feed_id" else F.col(c)
            for c in translations.columns
        ]
    )
