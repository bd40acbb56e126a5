"""Sources, candidate selection and change detection."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.sql import CANDIDATES, NOW, PLANNED, joined
from catalog.views import RUN_TS, duckdb_hash, feed_tables, load
from feedloom import EnrichOptions
from feedloom.functions.text import source_hash
from feedloom.operators import candidates, planning
from feedloom.sources.tables import migrate_translations

OPTIONS = EnrichOptions(run_ts=RUN_TS, feed_ids=(60, 61, 62, 63), quota=None)


def tags_text(column: str):
    return F.array_join(F.coalesce(F.col(column), F.array().cast("array<string>")), "|")


def bigint(name: str):
    return F.col(name).cast("bigint").alias(name)


@query(
    "source_tables",
    """
select 'entries' as name, count(*) as row_count, sum(id)::bigint as key_sum from entries
union all select 'user_entries', count(*), sum(int_id)::bigint from user_entries
union all select 'feeds', count(*), sum(id)::bigint from feeds
union all select 'tags', count(*), sum(id)::bigint from tags
union all select 'translations', count(*), sum(entry_id)::bigint from translations""",
)
def source_tables(spark, sf_dir):
    keys = {"user_entries": "int_id", "translations": "entry_id"}
    parts = [
        table.agg(
            F.lit(name).alias("name"),
            F.count("*").alias("row_count"),
            F.sum(F.col(keys.get(name, "id")).cast("bigint")).alias("key_sum"),
        )
        for name, table in feed_tables(spark, sf_dir).items()
    ]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union


@query(
    "tracking_migration",
    """
select t.entry_id,
       coalesce(case when t.target_language <> 'ja' then t.user_entry_id end,
                (select min(u.int_id) from user_entries u
                 where u.ref_id = t.entry_id and u.owner_uid = t.owner_uid)) as user_entry_id,
       0::bigint as tag_count, t.source_hash
from translations t""",
)
def tracking_migration(spark, sf_dir):
    older = load(spark, sf_dir, "translations").drop("generated_tags")
    known = F.when(F.col("target_language") != "ja", F.col("user_entry_id"))
    migrated = migrate_translations(
        older.withColumn("user_entry_id", known), load(spark, sf_dir, "user_entries")
    )
    return migrated.select(
        "entry_id",
        "user_entry_id",
        F.size("generated_tags").cast("bigint").alias("tag_count"),
        "source_hash",
    )


CANDIDATE_COLUMNS = f"""
select entry_id, owner_uid::bigint as owner_uid, user_entry_id, feed_id::bigint as feed_id, feed_title,
       link, title, content, {joined('current_tags')} as current_tags, source_lang, date_entered,
       owner_count, tracked, case when tracked then user_entry_id end as tracked_user_entry_id,
       t_language as tracked_language, t_hash as tracked_hash, {joined('t_tags')} as tracked_tags
from tagged_candidates"""


def flat_candidates(rows):
    tracked = F.col("translation.entry_id").isNotNull()
    return rows.select(
        "entry_id",
        bigint("owner_uid"),
        "user_entry_id",
        bigint("feed_id"),
        "feed_title",
        "link",
        "title",
        "content",
        tags_text("current_tags").alias("current_tags"),
        "source_lang",
        "date_entered",
        "owner_count",
        tracked.alias("tracked"),
        F.col("translation.user_entry_id").alias("tracked_user_entry_id"),
        F.col("translation.target_language").alias("tracked_language"),
        F.col("translation.source_hash").alias("tracked_hash"),
        tags_text("translation.generated_tags").alias("tracked_tags"),
    )


@query("candidates", CANDIDATE_COLUMNS, CANDIDATES)
def select_candidates(spark, sf_dir):
    return flat_candidates(candidates.select_candidates(feed_tables(spark, sf_dir), OPTIONS))


@query(
    "candidates_by_language",
    f"{CANDIDATE_COLUMNS} where source_lang in ('en', 'fr')",
    CANDIDATES,
)
def candidates_by_language(spark, sf_dir):
    options = replace(OPTIONS, source_langs=("EN", " fr "))
    return flat_candidates(candidates.select_candidates(feed_tables(spark, sf_dir), options))


@query(
    "owner_counts",
    "select ref_id, count(distinct owner_uid) as owner_count from user_entries group by ref_id",
)
def owner_counts(spark, sf_dir):
    return candidates.owner_counts(load(spark, sf_dir, "user_entries"))


@query(
    "candidate_page",
    """
select entry_id, date_entered, title from candidates
order by date_entered desc, entry_id desc limit 25 offset 50""",
    CANDIDATES,
)
def candidate_page(spark, sf_dir):
    rows = candidates.select_candidates(feed_tables(spark, sf_dir), OPTIONS)
    return candidates.page(rows, limit=25, offset=50).select("entry_id", "date_entered", "title")


QUOTA_PREFIX = """
select entry_id, action, reason from (
  select *, sum((action = 'translate')::int) over (order by date_entered desc, entry_id desc
            rows unbounded preceding) - (action = 'translate')::int as queued_before
  from planned)
where queued_before < {quota} and (action = 'translate' or queued_before < {quota})"""


def _within(quota):
    def build(spark, sf_dir):
        planned = planning.plan_entries(
            candidates.select_candidates(feed_tables(spark, sf_dir), OPTIONS), OPTIONS
        )
        return candidates.within_quota(planned, quota).select("entry_id", "action", "reason")

    return build


query("quota_prefix", QUOTA_PREFIX.format(quota=40), PLANNED)(_within(40))
query("quota_beyond_supply", QUOTA_PREFIX.format(quota=10**9), PLANNED)(_within(10**9))


@query(
    "source_hash",
    f"select doc_id, {duckdb_hash('source', 'text')} as hash from documents",
)
def hashes(spark, sf_dir):
    documents = load(spark, sf_dir, "documents")
    return documents.select("doc_id", source_hash(F.col("source"), F.col("text")).alias("hash"))


@query(
    "plan",
    "select entry_id, action, reason, source_title, source_content, source_hash from planned",
    PLANNED,
)
def plan(spark, sf_dir):
    rows = candidates.select_candidates(feed_tables(spark, sf_dir), OPTIONS)
    return planning.plan_entries(rows, OPTIONS).select(
        "entry_id", "action", "reason", "source_title", "source_content", "source_hash"
    )


@query(
    "plan_shared_allowed",
    "select entry_id, action, reason, source_hash from planned",
    PLANNED.replace("owner_count > 1 then 1", "false then 1"),
)
def plan_shared_allowed(spark, sf_dir):
    options = replace(OPTIONS, require_single_owner=False)
    rows = candidates.select_candidates(feed_tables(spark, sf_dir), options)
    return planning.plan_entries(rows, options).select("entry_id", "action", "reason", "source_hash")


@query(
    "plan_summary",
    'select action, reason, count(*) as "rows" from planned group by action, reason',
    PLANNED,
)
def plan_summary(spark, sf_dir):
    rows = candidates.select_candidates(feed_tables(spark, sf_dir), OPTIONS)
    return planning.plan_summary(planning.plan_entries(rows, OPTIONS))


@query(
    "recent_entries",
    f"select id, date_entered, lang from entries where date_entered >= {NOW} - interval 48 hour",
)
def recent_entries(spark, sf_dir):
    return candidates.recent(load(spark, sf_dir, "entries"), OPTIONS).select(
        "id", "date_entered", "lang"
    )
