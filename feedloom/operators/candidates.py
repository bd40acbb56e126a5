"""Which articles a run looks at, newest first, up to the quota."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.tags import parse_tag_cache
from feedloom.options import EnrichOptions
from feedloom.sources.staging import stage
from feedloom.sources.tables import Tables

# Feed lists up to this length are literals of a filter and bound the size of a
# broadcast; longer ones are tables to join with.
LISTED_FEEDS = 1_000


def newest_first() -> list[Column]:
    return [F.col("date_entered").desc(), F.col("entry_id").desc()]


def recent(entries: DataFrame, options: EnrichOptions) -> DataFrame:
    """Articles entered within the lookback, of the configured languages if any."""
    oldest = options.run_ts - timedelta(hours=options.lookback_hours)
    kept = entries.where(F.col("date_entered") >= F.lit(oldest))
    if options.source_langs:
        kept = kept.where(F.col("lang").isin(*options.source_langs))
    return kept


def in_listed_feeds(df: DataFrame, feed_col: str, options: EnrichOptions) -> DataFrame:
    """The owner's rows in the listed feeds."""
    own = df.where(F.col("owner_uid") == options.owner_uid)
    if len(options.feed_ids) <= LISTED_FEEDS:
        return own.where(F.col(feed_col).isin(*options.feed_ids))
    listed = df.sparkSession.createDataFrame([(i,) for i in options.feed_ids], f"{feed_col} int")
    return own.join(listed, feed_col, "left_semi")


def owner_counts(user_entries: DataFrame) -> DataFrame:
    """Number of distinct owners of every subscribed article."""
    return user_entries.groupBy("ref_id").agg(F.count_distinct("owner_uid").alias("owner_count"))


def subscriptions_per_article(
    user_entries: DataFrame, articles: DataFrame, options: EnrichOptions
) -> DataFrame:
    """Owner count and the owner's chosen subscription of every article in ``articles``.

    The subscription is the one with the smallest id among the owner's in the
    listed feeds; that filter reaches the scan. All owners of the articles so
    found are counted, on two narrow columns and combined map-side, so an
    article with very many subscribers does not fill a task.
    """
    chosen = (
        in_listed_feeds(user_entries, "feed_id", options)
        .join(articles.select(F.col("id").alias("ref_id")), "ref_id", "left_semi")
        .groupBy("ref_id")
        .agg(F.min(F.struct("int_id", "owner_uid", "feed_id", "tag_cache")).alias("chosen"))
        .select("ref_id", "chosen.*")
    )
    owned = user_entries.select("ref_id", "owner_uid").join(
        chosen.select("ref_id"), "ref_id", "left_semi"
    )
    return chosen.join(owner_counts(owned), "ref_id")


def feed_titles(feeds: DataFrame, options: EnrichOptions) -> DataFrame:
    """Titles of the owner's listed feeds; no larger than the list itself."""
    titles = (
        in_listed_feeds(feeds, "id", options)
        .groupBy(F.col("id").alias("feed_id"))
        .agg(F.min("title").alias("feed_title"))
    )
    return F.broadcast(titles) if len(options.feed_ids) <= LISTED_FEEDS else titles


def select_candidates(tables: Tables, options: EnrichOptions) -> DataFrame:
    """One row per recent article the owner is subscribed to, with its tracking row.

    ``translation`` is null for an article never translated. Its
    ``user_entry_id`` is the current subscription's, not the stored one.
    """
    articles = recent(tables.entries, options)
    subscribed = subscriptions_per_article(tables.user_entries, articles, options)
    tracked = tables.translations.select(
        F.col("entry_id").alias("tracked_id"), F.struct("*").alias("tracked")
    )
    joined = (
        articles.join(subscribed, articles["id"] == subscribed["ref_id"])
        .join(feed_titles(tables.feeds, options), "feed_id", "left")
        .join(tracked, articles["id"] == tracked["tracked_id"], "left")
    )
    record = F.when(
        F.col("tracked_id").isNotNull(), F.col("tracked").withField("user_entry_id", F.col("int_id"))
    )
    return joined.select(
        articles["id"].alias("entry_id"),
        "owner_uid",
        F.col("int_id").alias("user_entry_id"),
        "feed_id",
        F.coalesce("feed_title", F.lit("")).alias("feed_title"),
        F.coalesce("link", F.lit("")).alias("link"),
        articles["title"],
        articles["content"],
        parse_tag_cache(F.coalesce("tag_cache", F.lit(""))).alias("current_tags"),
        articles["lang"].alias("source_lang"),
        articles["date_entered"],
        "owner_count",
        record.alias("translation"),
    )


def page(candidates: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """One page of the newest-first list."""
    return candidates.orderBy(*newest_first()).offset(offset).limit(limit)


# A part of the queue with at most so many rows is sorted, a larger one counted by a finer key.
SORTED_ROWS = 50_000

_NEVER = -(2**63)


def _queue_keys() -> list[Column]:
    """Ever finer keys of the queue's order; within one value of a key the next one has few."""
    micros = F.coalesce(F.unix_micros("date_entered"), F.lit(_NEVER))
    times = [F.floor(micros / unit) for unit in (3_600_000_000, 1_000_000)]
    return [*times, micros, *[F.shiftright("entry_id", bits) for bits in (48, 32, 16, 0)]]


def last_of_quota(queue: DataFrame, quota: int) -> tuple[int, int, int] | None:
    """Attempts, time and id of the ``quota``-th row of a queue; None if there are fewer.

    The queue goes by attempts, then newest first. Counts by hour tell in which hour the row
    lies, however large the quota, and only that hour is sorted. An hour with too many
    rows is counted by second first, and so on down to ranges of ids. A count has at
    most as many rows as the lookback has hours, an hour seconds or a range 65,536 parts.
    """
    left, part, keys = quota, queue.select("attempts", "entry_id", "date_entered"), _queue_keys()
    by_attempts = [F.col("attempts")]
    for key in keys:
        counts = part.groupBy(*by_attempts, key.alias("key")).agg(F.count("*").alias("n")).collect()
        for row in sorted(counts, key=lambda r: (r.asDict().get("attempts", 0), -r["key"])):
            if left <= row["n"]:
                break
            left -= row["n"]
        else:
            return None
        part = part.where(key == row["key"])
        if by_attempts:
            part, by_attempts = part.where(F.col("attempts") == row["attempts"]), []
        if row["n"] <= SORTED_ROWS:
            break
    micros = F.coalesce(F.unix_micros("date_entered"), F.lit(_NEVER)).alias("micros")
    ordered = part.select("attempts", micros, "entry_id").orderBy(F.desc("micros"), F.desc("entry_id"))
    return tuple(ordered.limit(left).offset(left - 1).first())


def within_quota(planned: DataFrame, quota: int | None, staged: bool = False) -> DataFrame:
    """Rows down to the ``quota``-th row to translate, by failed attempts if known, then newest first.

    Rows to skip or reapply that lie before that row are included; with fewer
    rows to translate everything is. ``staged``: ``planned`` is a staged table, cheap to read twice.
    """
    if quota is None:
        return planned
    attempts = F.coalesce("attempts", F.lit(0)) if "attempts" in planned.columns else F.lit(0)
    queue = planned.where(F.col("action") == "translate")
    queue = queue.select(attempts.alias("attempts"), "entry_id", "date_entered")
    last = last_of_quota(queue if staged else stage(queue, "queue"), quota)
    if last is None:
        return planned
    tries, time, entry_id = last
    micros = F.coalesce(F.unix_micros("date_entered"), F.lit(_NEVER))
    before = (micros > time) | ((micros == time) & (F.col("entry_id") >= entry_id))
    return planned.where((attempts < tries) | ((attempts == tries) & before))
