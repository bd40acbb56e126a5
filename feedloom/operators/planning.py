"""Change detection: skip, reapply or translate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.functions.text import source_hash
from feedloom.options import EnrichOptions


def plan_entries(candidates: DataFrame, options: EnrichOptions) -> DataFrame:
    """Candidates with ``action``, ``reason`` and the source to work from.

    The source is the stored snapshot whenever the article still shows what
    that snapshot produced, else the article as it is.
    """
    stored = F.col("translation")
    tracked = stored["entry_id"].isNotNull()
    shows_translation = (
        tracked
        & F.col("title").eqNullSafe(stored["translated_title"])
        & F.col("content").eqNullSafe(stored["translated_content"])
    )
    shows_source = tracked & (F.col("current_hash") == stored["source_hash"])
    same_target = tracked & (stored["target_language"] == options.target_language)
    shared = F.lit(options.require_single_owner) & (F.col("owner_count") > 1)

    verdict = (
        F.when(shared, _verdict("skip", "shared-between-multiple-owners"))
        .when(~tracked, _verdict("translate", "no-tracking-record"))
        .when(shows_translation & same_target, _verdict("skip", "already-translated", stored=True))
        .when(
            shows_source & same_target,
            _verdict("reapply", "same-source-hash-found-in-db", stored=True),
        )
        .when(
            shows_translation,
            _verdict("translate", "target-language-changed-reuse-stored-source", stored=True),
        )
        .otherwise(_verdict("translate", "source-changed-or-manually-edited"))
    )
    use_stored = F.col("verdict.use_stored")

    def source(column: str, current: str):
        return F.when(use_stored, stored[column]).otherwise(F.col(current)).alias(column)

    return (
        candidates.withColumn("current_hash", source_hash(F.col("title"), F.col("content")))
        .withColumn("verdict", verdict)
        .select(
            *candidates.columns,
            "verdict.action",
            "verdict.reason",
            source("source_title", "title"),
            source("source_content", "content"),
            source("source_hash", "current_hash"),
        )
    )


def _verdict(action: str, reason: str, stored: bool = False):
    return F.struct(
        F.lit(action).alias("action"),
        F.lit(reason).alias("reason"),
        F.lit(stored).alias("use_stored"),
    )


def plan_summary(planned: DataFrame) -> DataFrame:
    """Rows per action and reason."""
    return planned.groupBy("action", "reason").agg(F.count("*").alias("rows"))
