"""Merging changes into the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import sql as S
from catalog.registry import query
from catalog.selection import OPTIONS, bigint, tags_text
from catalog.sql import CANDIDATES, NOW, PLANNED
from catalog.views import RUN_TS, feed_tables, load
from feedloom.operators import merge
from feedloom.operators.candidates import select_candidates
from feedloom.operators.planning import plan_entries
from feedloom.sources.staging import checkpoint_root
from feedloom.sources.tables import read_or_create

TRACKING = [
    "entry_id",
    "owner_uid",
    "user_entry_id",
    "feed_id",
    "source_lang",
    "target_language",
    "source_hash",
    "source_title",
    "source_content",
    "translated_title",
    "translated_content",
    "generated_tags",
    "translated_at",
    "reapplied_at",
    "updated_at",
    "last_error",
]


def flat_tracking(rows):
    return rows.select(
        *[
            tags_text(c).alias(c)
            if c == "generated_tags"
            else bigint(c)
            if c in ("owner_uid", "feed_id")
            else F.col(c)
            for c in TRACKING
        ]
    )


def tracking_sql(table: str) -> str:
    columns = ", ".join(
        f"{S.joined(c)} as {c}"
        if c == "generated_tags"
        else f"{c}::bigint as {c}"
        if c in ("owner_uid", "feed_id")
        else c
        for c in TRACKING
    )
    return f"select {columns} from {table}"


def planned(spark, sf_dir):
    return plan_entries(select_candidates(feed_tables(spark, sf_dir), OPTIONS), OPTIONS)


@query(
    "article_overwrite",
    """
select e.id, coalesce(t.translated_title, e.title) as title,
       coalesce(t.translated_content, e.content) as content, e.link, e.lang, e.date_entered
from entries e left join translations t on t.entry_id = e.id""",
)
def article_overwrite(spark, sf_dir):
    changes = load(spark, sf_dir, "translations").select(
        "entry_id",
        F.col("translated_title").alias("title"),
        F.col("translated_content").alias("content"),
    )
    return merge.overwrite_articles(load(spark, sf_dir, "entries"), changes)


SAVED = f"""{PLANNED},
saved as (
  select entry_id, owner_uid, user_entry_id, feed_id, source_lang, 'zh-CN' as target_language,
         source_hash, source_title, source_content, concat('T(', source_title, ')') as translated_title,
         source_content as translated_content, [source_lang, 'AI'] as generated_tags,
         {NOW} as translated_at, null::timestamp as reapplied_at, {NOW} as updated_at,
         null::varchar as last_error
  from planned where action = 'translate')"""


def saved(spark, sf_dir):
    return (
        planned(spark, sf_dir)
        .where("action = 'translate'")
        .withColumns(
            {
                "target_language": F.lit("zh-CN"),
                "translated_title": F.concat(F.lit("T("), "source_title", F.lit(")")),
                "translated_content": F.col("source_content"),
                "generated_tags": F.array("source_lang", F.lit("AI")),
            }
        )
    )


@query(
    "tracking_upsert",
    f"{tracking_sql('translations')} where entry_id not in (select entry_id from saved) "
    f"union all {tracking_sql('saved')}",
    SAVED,
)
def tracking_upsert(spark, sf_dir):
    target = load(spark, sf_dir, "translations")
    return flat_tracking(merge.upsert_translations(target, saved(spark, sf_dir), RUN_TS))


@query("tracking_create", tracking_sql("saved"), SAVED)
def tracking_create(spark, sf_dir):
    missing = f"{checkpoint_root(spark)}/feedloom/no-such-table"
    created = read_or_create(spark, "translations", missing)
    return flat_tracking(merge.upsert_translations(created, saved(spark, sf_dir), RUN_TS))


@query(
    "replay_stamp",
    f"""
select t.entry_id, t.translated_at, case when p.entry_id is null then t.reapplied_at else {NOW} end as reapplied_at,
       case when p.entry_id is null then t.updated_at else {NOW} end as updated_at,
       case when p.entry_id is null then t.last_error end as last_error,
       case when p.entry_id % 3 = 0 then {S.joined('p.current_tags')} else {S.joined('t.generated_tags')} end as generated_tags
from translations t left join planned p on p.entry_id = t.entry_id and p.action = 'reapply'""",
    PLANNED,
)
def replay_stamp(spark, sf_dir):
    changes = (
        planned(spark, sf_dir)
        .where("action = 'reapply'")
        .select(
            "entry_id",
            F.col("current_tags").alias("new_tags"),
            (F.col("entry_id") % 3 == 0).alias("persist"),
        )
    )
    done = merge.stamp_reapplied(load(spark, sf_dir, "translations"), changes, RUN_TS)
    return flat_tracking(done).select(
        "entry_id", "translated_at", "reapplied_at", "updated_at", "last_error", "generated_tags"
    )


@query(
    "error_stamp",
    f"""
select t.entry_id, case when p.entry_id is null then t.updated_at else {NOW} end as updated_at,
       case when p.entry_id is null then t.last_error else left(p.source_content, 5000) end as last_error
from translations t left join planned p on p.entry_id = t.entry_id and p.action = 'translate'""",
    PLANNED,
)
def error_stamp(spark, sf_dir):
    failures = (
        planned(spark, sf_dir)
        .where("action = 'translate'")
        .select("entry_id", F.col("source_content").alias("message"))
    )
    done = merge.stamp_errors(load(spark, sf_dir, "translations"), failures, RUN_TS)
    return done.select("entry_id", "updated_at", "last_error")


# New tags of every candidate: some repeat, some vanish in cleaning.
NEW_TAGS = f"""{CANDIDATES},
proposed as (
  select entry_id, owner_uid, user_entry_id, case entry_id % 3
    when 0 then ['New; ' || source_lang, upper(source_lang), ' AI '] when 1 then ['#', ' , '] else ['ai', 'Topic1'] end as generated
  from candidates),
cleaned_new as (select *, {S.clean_tags('generated')} as new_cleaned from proposed),
unique_new as (select *, {S.unique('new_cleaned')} as new_tags from cleaned_new where len(new_cleaned) > 0),
stored as (
  select owner_uid, post_int_id, list(tag_name order by id) as names from tags group by owner_uid, post_int_id),
stored_clean as (
  select u.*, {S.clean_tags('coalesce(s.names, [])')} as old_cleaned
  from unique_new u left join stored s on s.post_int_id = u.user_entry_id and s.owner_uid = u.owner_uid),
stored_unique as (select *, {S.unique('old_cleaned')} as existing from stored_clean),
merged_tags as (select *, {S.lacking('new_tags', 'existing')} as missing from stored_unique),
new_rows as (
  select owner_uid, user_entry_id, unnest(list_transform(missing, lambda x, i: {{'tag': x, 'nth': i}})) as item
  from merged_tags)"""


def proposed(spark, sf_dir):
    rows = select_candidates(feed_tables(spark, sf_dir), OPTIONS)
    new = F.array(F.concat(F.lit("New; "), "source_lang"), F.upper("source_lang"), F.lit(" AI "))
    kind = F.col("entry_id") % 3
    generated = (
        F.when(kind == 0, new)
        .when(kind == 1, F.array(F.lit("#"), F.lit(" , ")))
        .otherwise(F.array(F.lit("ai"), F.lit("Topic1")))
    )
    return rows.select("owner_uid", "user_entry_id", generated.alias("generated"))


@query(
    "tag_append",
    """
select id, tag_name, owner_uid::bigint as owner_uid, post_int_id from tags
union all
select (select max(id) from tags) + row_number() over (order by user_entry_id, owner_uid, item.nth),
       item.tag, owner_uid, user_entry_id
from new_rows""",
    NEW_TAGS,
)
def tag_append(spark, sf_dir):
    tags = load(spark, sf_dir, "tags")
    merged = merge.merge_subscription_tags(tags, proposed(spark, sf_dir))
    return tags.unionByName(merge.new_tag_rows(tags, merged)).select(
        "id", "tag_name", bigint("owner_uid"), "post_int_id"
    )


@query(
    "tag_cache_rewrite",
    f"""
select u.int_id, u.owner_uid::bigint as owner_uid,
       case when m.user_entry_id is null then u.tag_cache else {S.joined('list_concat(m.existing, m.missing)', ',')} end as tag_cache
from user_entries u
left join merged_tags m on m.user_entry_id = u.int_id and m.owner_uid = u.owner_uid""",
    NEW_TAGS,
)
def tag_cache_rewrite(spark, sf_dir):
    merged = merge.merge_subscription_tags(load(spark, sf_dir, "tags"), proposed(spark, sf_dir))
    done = merge.rewrite_tag_cache(load(spark, sf_dir, "user_entries"), merged)
    return done.select("int_id", bigint("owner_uid"), "tag_cache")


@query(
    "tag_sync_persist",
    f"""
select t.entry_id, case when p.entry_id is null then {S.joined('t.generated_tags')} else {S.joined("['kept', p.source_lang]")} end as generated_tags,
       case when p.entry_id is null then t.updated_at else {NOW} end as updated_at,
       case when p.entry_id is null then t.last_error end as last_error
from translations t left join planned p on p.entry_id = t.entry_id and p.action = 'skip'""",
    PLANNED,
)
def tag_sync_persist(spark, sf_dir):
    changes = (
        planned(spark, sf_dir)
        .where("action = 'skip'")
        .select("entry_id", F.array(F.lit("kept"), F.col("source_lang")).alias("new_tags"))
    )
    done = merge.store_generated_tags(load(spark, sf_dir, "translations"), changes, RUN_TS)
    return flat_tracking(done).select("entry_id", "generated_tags", "updated_at", "last_error")


# Deleted: articles that lost their link, subscriptions with a tag cache of
# one language, and the feeds the view leaves out. Rows that name no
# subscription, every fifth here, break no rule.
@query(
    "reference_cleanup",
    """
select t.entry_id, case when t.entry_id % 5 <> 0 then t.user_entry_id end as user_entry_id, f.id::bigint as feed_id
from translations t
join entries e on e.id = t.entry_id and e.link is not null
left join (select int_id from user_entries where not coalesce(starts_with(tag_cache, 'fr'), false)) u on u.int_id = t.user_entry_id
left join feeds f on f.id = t.feed_id
where (t.entry_id % 5 = 0 or t.user_entry_id is null or u.int_id is not null)
  and t.owner_uid in (select owner_uid from user_entries where not coalesce(starts_with(tag_cache, 'fr'), false))""",
)
def reference_cleanup(spark, sf_dir):
    tables = feed_tables(spark, sf_dir)
    kept = merge.enforce_references(
        tables.translations.withColumn(
            "user_entry_id", F.when(F.col("entry_id") % 5 != 0, F.col("user_entry_id"))
        ),
        tables.entries.where("link is not null"),
        tables.user_entries.where("not coalesce(startswith(tag_cache, 'fr'), false)"),
        tables.feeds,
    )
    return kept.select("entry_id", "user_entry_id", bigint("feed_id"))
