"""One enrichment run: select, plan, translate, tag, merge, count."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from feedloom.functions.tags import no_tags, show_tags
from feedloom.functions.text import preview
from feedloom.operators import merge
from feedloom.operators.candidates import newest_first, select_candidates, within_quota
from feedloom.operators.fulltext import use_fulltext
from feedloom.operators.inference import TextBackend
from feedloom.operators.planning import plan_entries
from feedloom.operators.segments import with_html_preview, with_runs, with_segments
from feedloom.operators.tagging import (
    TagBackend,
    generate_tags,
    may_request_tags,
    plan_tags,
    settle_tag_plan,
    with_tagging_excerpt,
)
from feedloom.options import CONTENT_PREVIEW_CHARS, TITLE_PREVIEW_CHARS, EnrichOptions
from feedloom.plans.convenience import translate_parsed
from feedloom.sources.staging import remove, stage
from feedloom.sources.tables import Tables

OUTCOME = [
    "entry_id",
    "owner_uid",
    "user_entry_id",
    "feed_id",
    "feed_title",
    "source_lang",
    "date_entered",
    "action",
    "reason",
    "source_title",
    "source_content",
    "source_hash",
    "new_title",
    "new_content",
    "current_tags",
    "saved_tags",
    "tag_plan",
    "error",
    "tag_error",
]


@dataclass(frozen=True)
class Backlog:
    """What several runs over the same tables have to do, planned once for all of them."""

    planned: DataFrame
    settled: DataFrame | None = None  # entry_id of what earlier runs have done


@dataclass(frozen=True)
class RunResult:
    """What a run did: the written ``outcome`` and what follows from it."""

    outcome: DataFrame
    before: Tables
    options: EnrichOptions
    staged: tuple[str, ...] = ()  # folders that are still needed

    def forget(self) -> None:
        """Remove what the outcome is read from, when nothing will read it any more."""
        for path in self.staged:
            remove(self.before.feeds.sparkSession, path)

    @cached_property
    def tables(self) -> Tables:
        """The tables after the run; a dry run leaves them as they were."""
        if self.options.dry_run:
            return self.before
        tagged = any(row.tagged for row in self.changes)
        return merged_tables(self.before, self.outcome, self.options, tagged)

    @cached_property
    def changes(self) -> list[Row]:
        """The days with something to write, with counts of rows that bring tags, were tried and failed."""
        kind, error = _change_kind(), F.col("error")
        counts = self.outcome.groupBy(_day()).agg(
            F.count_if(kind.isNotNull()).alias("changed"),
            F.count_if(F.size(_synced_tags()) > 0).alias("tagged"),
            F.count_if((F.col("action") == "translate") & error.isNotNull()).alias("failed"),
            F.count_if(F.col("action") == "translate").alias("tried"),
        )
        # no more days than the lookback and the arrivals have
        return [row for row in counts.collect() if row.changed or row.tagged]

    @property
    def errors(self) -> DataFrame:
        return error_rows(self.outcome, self.options)

    @property
    def stats(self) -> DataFrame:
        return run_stats(self.outcome, self.options)

    def progress(self) -> tuple[int, int]:
        """How many articles were translated, and how many tried that had never failed before."""
        tried = self.outcome.where(F.col("action") == "translate")
        tried = with_attempts(tried.select("entry_id", "owner_uid", "action", "error"), self.before.attempts)
        row = tried.agg(F.count_if(F.col("error").isNull()), F.count_if(F.col("attempts") == 0)).first()
        return row[0], row[1]

    @property
    def translated(self) -> int:
        return sum(row.tried - row.failed for row in self.changes)

    def left_nothing(self) -> bool:
        """Whether one more run over the tables as they are now would change nothing.

        So it is if the quota was not used up and nothing failed; with tagging a run may
        have tags to ask for again.
        """
        options = self.options
        tried = sum(row.tried for row in self.changes)
        within = options.quota is None or tried < options.quota
        return within and not options.tagging and not any(row.failed for row in self.changes)

    @property
    def previews(self) -> DataFrame:
        return previews(self.outcome)


def enrich(
    tables: Tables,
    options: EnrichOptions,
    translator: TextBackend | DataFrame,
    tagger: TagBackend | None = None,
    fulltext: DataFrame | None = None,
    backlog: Backlog | None = None,
) -> RunResult:
    """Run once over a snapshot of the tables.

    ``translator`` is a callable asked once per chunk, or a glossary table to
    join with. Nothing is written to the tables; see ``feedloom.sources.store``.
    ``backlog`` is what ``plan_backlog`` found before, less what was done since.
    """
    outcome = stage(handle(tables, options, translator, tagger, fulltext, backlog), "outcome")
    return RunResult(outcome, tables, options)


def plan_run(tables: Tables, options: EnrichOptions) -> DataFrame:
    """What is to be done with each candidate."""
    return plan_tags(plan_entries(select_candidates(tables, options), options), options)


def plan_backlog(tables: Tables, options: EnrichOptions) -> Backlog | None:
    """All there is to do, for runs of any quota; None with tagging, where a run decides what the next one asks."""
    if options.tagging:
        return None
    planned = plan_run(tables, options)
    return Backlog(stage(planned.where(F.col("action") != "skip"), "backlog"))


def handle(tables, options, translator, tagger=None, fulltext=None, backlog=None) -> DataFrame:
    """One row per handled article with everything the merges need."""
    planned = plan_run(tables, options) if backlog is None else backlog.planned
    if tables.attempts is not None and options.retry_minutes is not None:
        waiting = tables.attempts.where(F.col("next_try") > F.lit(options.run_ts))
        waiting = waiting.select("entry_id", "owner_uid", F.lit("translate").alias("action"))
        planned = planned.join(waiting, ["entry_id", "owner_uid", "action"], "left_anti")
    if options.quota is not None:
        # the cut needs keys only; texts are read again for the rows it leaves
        keys = planned.select("entry_id", "owner_uid", "date_entered", "action")
        if backlog is not None and backlog.settled is not None:
            keys = keys.join(backlog.settled, "entry_id", "left_anti")
        keys = stage(with_attempts(keys, tables.attempts), "plan")
        kept = within_quota(keys, options.quota, staged=True).select("entry_id")
        planned = planned.join(kept, "entry_id", "left_semi")
    handled = stage(planned, "handled")

    queue = handled.where(F.col("action") == "translate")
    if fulltext is not None:
        queue = use_fulltext(queue, fulltext)
    translated = translate_queue(queue, options, translator)
    untouched = handled.where(F.col("action") != "translate")

    if options.tagging and tagger is not None:
        translated = stage(translated, "translated")
        tags = generate_tags(
            tag_requests(translated, untouched, options), newest_first(), tagger, options
        )
        tags = tags.withColumnRenamed("error", "tag_error")
    else:
        tags = handled.select("entry_id").where(F.lit(False))
        tags = tags.withColumns(
            {"generated": no_tags(), "tag_error": F.lit(None).cast("string")}
        )
    return _settle_translated(translated, tags).unionByName(_settle_untouched(untouched, tags))


def with_attempts(planned: DataFrame, attempts: DataFrame | None) -> DataFrame:
    """Planned rows with the number of failed ``attempts`` to translate them."""
    if attempts is None:
        return planned.withColumn("attempts", F.lit(0))
    known = attempts.select("entry_id", "owner_uid", "attempts")
    count = F.when(F.col("action") == "translate", F.col("attempts"))
    joined = planned.join(known, ["entry_id", "owner_uid"], "left")
    return joined.withColumn("attempts", F.coalesce(count, F.lit(0)))


def translate_queue(
    queue: DataFrame, options: EnrichOptions, translator: TextBackend | DataFrame
) -> DataFrame:
    """Queue with ``new_title``, ``new_content`` and ``error``."""
    parsed = with_segments(with_runs(queue, "source_content"))
    if options.tagging:
        parsed = with_tagging_excerpt(parsed)
    return translate_parsed(
        parsed.drop("runs"), "source_title", newest_first(), translator, options
    ).withColumnRenamed("new_html", "new_content")


def tag_requests(translated: DataFrame, untouched: DataFrame, options: EnrichOptions) -> DataFrame:
    """Requests of translated articles, asked in batches, and of others, asked alone."""
    fresh = translated.where(F.col("error").isNull() & may_request_tags(options)).select(
        "entry_id",
        "date_entered",
        F.lit(True).alias("batched"),
        F.col("source_title").alias("title"),
        "excerpt",
        F.col("current_tags").alias("existing_tags"),
    )
    stored = untouched.where(F.col("tag_plan.action") == "generate").select(
        "entry_id",
        "date_entered",
        F.lit(False).alias("batched"),
        F.col("translation.source_title").alias("title"),
        F.col("translation.source_content").alias("content"),
        F.col("current_tags").alias("existing_tags"),
    )
    stored = with_tagging_excerpt(with_runs(stored, "content")).drop("runs", "content")
    return fresh.unionByName(stored)


def _settle_translated(translated: DataFrame, tags: DataFrame) -> DataFrame:
    generated = F.coalesce("generated", no_tags())
    got_tags = F.size(generated) > 0
    plan = F.struct(
        F.when(got_tags, F.lit("generate")).otherwise(F.lit("skip")).alias("action"),
        generated.alias("tags"),
        F.lit("").alias("reason"),
        F.lit(True).alias("persist"),
    )
    return (
        translated.join(tags, "entry_id", "left")
        .withColumn("tag_plan", plan)
        .withColumn("saved_tags", no_tags())
        .select(*OUTCOME)
    )


def _settle_untouched(untouched: DataFrame, tags: DataFrame) -> DataFrame:
    """Skipped and reapplied rows; for these a tag failure fails the row."""
    stored = F.col("translation")
    reapply = F.col("action") == "reapply"

    def shown(column: str):
        return F.when(reapply, stored[f"translated_{column}"]).otherwise(F.col(column))

    return (
        untouched.join(tags, "entry_id", "left")
        .withColumn("tag_plan", settle_tag_plan())
        .withColumn("saved_tags", F.coalesce(stored["generated_tags"], no_tags()))
        .withColumn("new_title", shown("title"))
        .withColumn("new_content", shown("content"))
        .withColumn("error", F.col("tag_error"))
        .withColumn("tag_error", F.lit(None).cast("string"))
        .select(*OUTCOME)
    )


def _day() -> Column:
    """Tables laid out by day want the day of their article in new rows, too."""
    return F.coalesce(F.date_format("date_entered", "yyyy-MM-dd"), F.lit("unknown")).alias("day")


def _synced_tags() -> Column:
    """The generated tags that a handled row brings to its subscription."""
    action, plan = F.col("action"), F.col("tag_plan")
    tag_action = plan["action"]
    synced = F.col("error").isNull() & (action.isin("translate", "reapply") | (tag_action != "skip"))
    # a replay without a tag plan of its own brings back the stored tags
    replayed = (action == "reapply") & (tag_action == "skip")
    tags = F.when(replayed, F.col("saved_tags")).otherwise(plan["tags"])
    return F.when(synced, tags).otherwise(no_tags())


def _change_kind() -> Column:
    """What a handled row does to the tracking table, null for nothing."""
    action = F.col("action")
    return (
        F.when(F.col("error").isNotNull(), "error")
        .when(action == "translate", "save")
        .when(action == "reapply", "reapply")
        .when((action == "skip") & F.col("tag_plan.persist"), "tags")
    )


def merged_tables(
    tables: Tables, outcome: DataFrame, options: EnrichOptions, tagged: bool = True
) -> Tables:
    """The tables after the run. Failed rows leave theirs alone but for the error.

    ``tagged`` says whether any row brings tags to its subscription.
    """
    done = outcome.where(F.col("error").isNull())
    action, plan = F.col("action"), F.col("tag_plan")
    day = _day()

    rewritten = done.where(action.isin("translate", "reapply")).select(
        "entry_id", F.col("new_title").alias("title"), F.col("new_content").alias("content")
    )
    user_entries, tags = tables.user_entries, tables.tags
    if tagged:
        synced = (
            outcome.withColumn("generated", _synced_tags())
            .where(F.size("generated") > 0)
            .select("owner_uid", "user_entry_id", "generated", day)
        )
        merged = merge.merge_subscription_tags(tags, synced)
        user_entries = merge.rewrite_tag_cache(user_entries, merged)
        tags = tags.unionByName(merge.new_tag_rows(tags, merged, tables.tag_ids))

    saved = done.where(action == "translate").select(
        "entry_id",
        "owner_uid",
        "user_entry_id",
        "feed_id",
        "source_lang",
        F.lit(options.target_language).alias("target_language"),
        "source_hash",
        "source_title",
        "source_content",
        F.col("new_title").alias("translated_title"),
        F.col("new_content").alias("translated_content"),
        plan["tags"].alias("generated_tags"),
        day,
    )
    changes = outcome.select(
        "entry_id",
        _change_kind().alias("kind"),
        plan["tags"].alias("new_tags"),
        plan["persist"].alias("persist"),
        F.col("error").alias("message"),
    ).where(F.col("kind").isNotNull())
    translations = merge.apply_changes(tables.translations, changes, saved, options.run_ts)
    attempts = tables.attempts
    if attempts is not None:
        tried = outcome.where(action == "translate").select(
            "entry_id", "owner_uid", F.col("error").isNotNull().alias("failed"), day
        )
        attempts = merge.count_attempts(attempts, tried, options.run_ts, options.retry_minutes)
    return Tables(
        entries=merge.overwrite_articles(tables.entries, rewritten),
        user_entries=user_entries,
        feeds=tables.feeds,
        tags=tags,
        translations=translations,
        attempts=attempts,
    )


def error_rows(outcome: DataFrame, options: EnrichOptions) -> DataFrame:
    """Failures of this run, also of articles without a tracking row."""

    def rows(column: str, stage_name: str) -> DataFrame:
        return outcome.where(F.col(column).isNotNull()).select(
            "entry_id",
            "owner_uid",
            "user_entry_id",
            F.lit(stage_name).alias("stage"),
            F.col(column).alias("message"),
            F.lit(options.run_ts).cast("timestamp").alias("failed_at"),
        )

    return rows("error", "article").unionByName(rows("tag_error", "tags"))


def run_stats(outcome: DataFrame, options: EnrichOptions) -> DataFrame:
    """One row of counts."""
    ok = F.col("error").isNull()
    action = F.col("action")
    tagged = ok & (F.col("tag_plan.action") != "skip") & ~F.lit(options.dry_run)
    return outcome.agg(
        F.count_if(ok & (action == "translate")).alias("translated"),
        F.count_if(ok & (action == "reapply")).alias("reapplied"),
        F.count_if(ok & (action == "skip")).alias("skipped"),
        F.count_if(~ok).alias("failed"),
        F.count_if(tagged).alias("tagged"),
    )


def previews(outcome: DataFrame) -> DataFrame:
    """What a dry run shows: titles, contents and tags before and after."""
    label = (
        F.when(F.col("action") == "translate", "write translation")
        .when(F.col("action") == "reapply", "reapply cached translation")
        .otherwise(F.concat(F.lit("skip ("), "reason", F.lit(")")))
    )
    shown = outcome.where(
        F.col("error").isNull()
        & ((F.col("action") != "skip") | (F.col("reason") == "already-translated"))
    )
    shown = with_html_preview(shown, "source_text", "source_content", CONTENT_PREVIEW_CHARS)
    shown = with_html_preview(shown, "new_text", "new_content", CONTENT_PREVIEW_CHARS)
    feed = F.when(F.col("feed_title") == "", F.col("feed_id").cast("string"))
    return shown.select(
        "entry_id",
        F.coalesce(feed, "feed_title").alias("feed_title"),
        label.alias("action"),
        F.col("tag_plan.action").alias("tag_action"),
        preview(F.col("source_title"), TITLE_PREVIEW_CHARS).alias("source_title"),
        preview(F.col("new_title"), TITLE_PREVIEW_CHARS).alias("translated_title"),
        F.col("source_text").alias("source_content"),
        F.col("new_text").alias("translated_content"),
        show_tags(F.col("current_tags")).alias("current_tags"),
        show_tags(F.col("tag_plan.tags")).alias("generated_tags"),
    )
