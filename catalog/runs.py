"""Whole runs: tables afterwards, statistics, previews, failures."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from catalog import sql as S
from catalog.backends import title_words
from catalog.merging import flat_tracking, tracking_sql
from catalog.registry import query
from catalog.selection import bigint, tags_text
from catalog.sql import NOW
from catalog.tagging import TAG_PLAN, TAGGING
from catalog.texts import picky_backend, rewritten_sql
from catalog.views import feed_tables, load
from feedloom.functions.shipping import ship_by_value
from feedloom.operators.inference import GlossaryBackend
from feedloom.plans.run import enrich

ship_by_value(__name__)


def full_run(spark, sf_dir, translator=None, **changes):
    return enrich(
        feed_tables(spark, sf_dir),
        replace(TAGGING, **changes),
        translator or GlossaryBackend(),
        tagger=title_words,
        fulltext=load(spark, sf_dir, "fulltext"),
    )


def last_words(title: str) -> str:
    return f"list_concat(string_split({title}, ' ')[-2:], ['ai', 'AI'])"


# What a run comes to: sources, tag plans, translations, generated tags. A run
# with the picky backend fails the articles with a text it rejects.
RUN = f"""{TAG_PLAN.replace('@max_tags', '4')},
swapped as (
  select p.* replace (coalesce(f.content, p.source_content) as source_content),
         f.content is not null and f.content <> p.source_content as was_swapped
  from tag_planned p
  left join fulltext f on f.url = {S.strip('p.link')} and p.link <> '' and p.action = 'translate'
    and f.error is null and regexp_matches(f.content, '[^{S.SPACE}]')),
hashed as (
  select * replace (case when was_swapped then sha256(encode(source_title) || '\\x00'::blob || encode(source_content))
                         else source_hash end as source_hash)
  from swapped),
queue as (select * from hashed where action = 'translate'),
{rewritten_sql('queue', 'entry_id', 'source_content').strip()},
rejected as (
  select q.entry_id, @rejects and (contains(q.source_title, 'hath') or coalesce(bool_or(contains(s.core, 'hath')), false)) as failed
  from queue q left join segmented s using (entry_id) group by q.entry_id, q.source_title),
asked as (
  select h.entry_id, 4 - len(current_tags) as slots, current_tags,
         {S.clean_tags(last_words("case when action = 'translate' then source_title else t_source_title end"))} as cleaned
  from hashed h left join rejected r using (entry_id)
  where len(current_tags) < 4 and not coalesce(r.failed, false)
    and ((action = 'translate' and owner_count = 1) or (action <> 'translate' and verdict like 'generate%'))),
answered as (
  select entry_id, {S.lacking(f"({S.unique('cleaned')})[1:slots]", 'current_tags')} as generated from asked),
outcome as (
  select h.*, coalesce(r.failed, false) as failed, coalesce(a.generated, []) as generated,
    case when action = 'translate' then concat('T(', source_title, ')')
         when action = 'reapply' then t_title else title end as new_title,
    case when action = 'translate' then w.html when action = 'reapply' then t_content else content end as new_content,
    case when action = 'translate' then case when len(coalesce(a.generated, [])) > 0 then 'generate' else 'skip' end
         when verdict like 'generate%' and len(coalesce(a.generated, [])) = 0 then 'skip'
         else split_part(verdict, ':', 1) end as tag_action
  from hashed h
  left join rejected r using (entry_id)
  left join answered a using (entry_id)
  left join rewritten w using (entry_id)),
tagged_outcome as (
  select *, case when tag_action = 'skip' then [] when tag_action = 'apply' then t_tags else generated end as plan_tags
  from outcome)"""

PLAIN = RUN.replace("@rejects", "false")

# The same for the tags and caches of subscriptions.
SYNCED = f"""
synced as (
  select owner_uid, user_entry_id, case when action = 'reapply' and tag_action = 'skip' then t_tags else plan_tags end as generated
  from tagged_outcome where not failed and (action <> 'skip' or tag_action <> 'skip')),
cleaned_new as (select *, {S.clean_tags('generated')} as new_cleaned from synced),
unique_new as (select *, {S.unique('new_cleaned')} as new_tags from cleaned_new where len(new_cleaned) > 0),
stored as (
  select owner_uid, post_int_id, list(tag_name order by id) as names from tags group by owner_uid, post_int_id),
stored_clean as (
  select u.*, {S.clean_tags('coalesce(s.names, [])')} as old_cleaned
  from unique_new u left join stored s on s.post_int_id = u.user_entry_id and s.owner_uid = u.owner_uid),
stored_unique as (select *, {S.unique('old_cleaned')} as existing from stored_clean),
merged_tags as (select *, {S.lacking('new_tags', 'existing')} as missing from stored_unique)"""


@query(
    "run_outcome",
    f"""
select entry_id, action, reason, source_hash, new_title, new_content, tag_action, {S.joined('plan_tags')} as tags
from tagged_outcome""",
    PLAIN,
)
def run_outcome(spark, sf_dir):
    return full_run(spark, sf_dir).outcome.select(
        "entry_id",
        "action",
        "reason",
        "source_hash",
        "new_title",
        "new_content",
        F.col("tag_plan.action").alias("tag_action"),
        tags_text("tag_plan.tags").alias("tags"),
    )


@query(
    "run_articles",
    """
select e.id, case when o.entry_id is null then e.title else o.new_title end as title,
       case when o.entry_id is null then e.content else o.new_content end as content
from entries e left join tagged_outcome o on o.entry_id = e.id and o.action <> 'skip' and not o.failed""",
    PLAIN,
)
def run_articles(spark, sf_dir):
    return full_run(spark, sf_dir).tables.entries.select("id", "title", "content")


@query(
    "run_tracking",
    f"{tracking_sql('after')}",
    f"""{PLAIN},
after as (
  select t.* replace (
    case when o.action = 'reapply' then {NOW} else t.reapplied_at end as reapplied_at,
    case when o.action = 'reapply' or (o.action = 'skip' and o.tag_action = 'generate') then {NOW} else t.updated_at end as updated_at,
    case when o.action = 'reapply' or (o.action = 'skip' and o.tag_action = 'generate') then null else t.last_error end as last_error,
    case when o.action <> 'translate' and o.tag_action = 'generate' then o.plan_tags else t.generated_tags end as generated_tags)
  from translations t left join tagged_outcome o using (entry_id)
  where coalesce(o.action, '') <> 'translate'
  union all by name
  select entry_id, owner_uid, user_entry_id, feed_id, source_lang, 'zh-CN' as target_language, source_hash,
         source_title, source_content, new_title as translated_title, new_content as translated_content,
         generated as generated_tags, {NOW} as translated_at, null as reapplied_at, {NOW} as updated_at, null as last_error
  from tagged_outcome where action = 'translate')""",
)
def run_tracking(spark, sf_dir):
    return flat_tracking(full_run(spark, sf_dir).tables.translations)


@query(
    "run_subscriptions",
    f"""
select u.int_id, u.owner_uid::bigint as owner_uid,
       case when m.user_entry_id is null then u.tag_cache else {S.joined('list_concat(m.existing, m.missing)', ',')} end as tag_cache
from user_entries u left join merged_tags m on m.user_entry_id = u.int_id and m.owner_uid = u.owner_uid""",
    f"{PLAIN},{SYNCED}",
)
def run_subscriptions(spark, sf_dir):
    done = full_run(spark, sf_dir).tables.user_entries
    return done.select("int_id", bigint("owner_uid"), "tag_cache")


@query(
    "run_tags",
    """
select tag_name, owner_uid::bigint as owner_uid, post_int_id from tags
union all select unnest(missing), owner_uid, user_entry_id from merged_tags""",
    f"{PLAIN},{SYNCED}",
)
def run_tags(spark, sf_dir):
    return full_run(spark, sf_dir).tables.tags.select("tag_name", bigint("owner_uid"), "post_int_id")


STATS = """
select count(*) filter (where not failed and action = 'translate') as translated,
       count(*) filter (where not failed and action = 'reapply') as reapplied,
       count(*) filter (where not failed and action = 'skip') as skipped,
       count(*) filter (where failed) as failed,
       count(*) filter (where not failed and tag_action <> 'skip') as tagged
from tagged_outcome"""


@query("run_stats", STATS, PLAIN)
def run_stats(spark, sf_dir):
    return full_run(spark, sf_dir).stats


@query("run_stats_with_failures", STATS, RUN.replace("@rejects", "true"))
def run_stats_with_failures(spark, sf_dir):
    return full_run(spark, sf_dir, translator=picky_backend).stats


@query(
    "run_errors",
    f"""
select entry_id, owner_uid::bigint as owner_uid, user_entry_id, 'article' as stage, 'rejected text' as message,
       {NOW} as failed_at
from tagged_outcome where failed""",
    RUN.replace("@rejects", "true"),
)
def run_errors(spark, sf_dir):
    errors = full_run(spark, sf_dir, translator=picky_backend).errors
    return errors.withColumn("owner_uid", F.col("owner_uid").cast("bigint"))


PREVIEW = f"""{PLAIN},
shown as (
  select * from tagged_outcome where action <> 'skip' or reason = 'already-translated'),
source_text as (
  select entry_id, string_agg({S.strip('text')}, chr(10) order by place) as text
  from ({S.runs('shown', 'entry_id', 'source_content')}) group by entry_id),
new_text as (
  select entry_id, string_agg({S.strip('text')}, chr(10) order by place) as text
  from ({S.runs('shown', 'entry_id', 'new_content')}) group by entry_id),
cut as (
  select s.*, {S.excerpt('a.text', 280)} as source_cut, {S.excerpt('b.text', 280)} as new_cut
  from shown s left join source_text a using (entry_id) left join new_text b using (entry_id))"""


@query(
    "dry_run_preview",
    f"""
select entry_id, case when feed_title = '' then feed_id::varchar else feed_title end as feed_title,
       case action when 'translate' then 'write translation' when 'reapply' then 'reapply cached translation'
            else concat('skip (', reason, ')') end as action,
       tag_action, {S.preview('source_title', 160)} as source_title, {S.preview('new_title', 160)} as translated_title,
       {S.preview('source_cut', 280)} as source_content, {S.preview('new_cut', 280)} as translated_content,
       case when len(current_tags) = 0 then '<none>' else array_to_string(current_tags, ', ') end as current_tags,
       case when len(plan_tags) = 0 then '<none>' else array_to_string(plan_tags, ', ') end as generated_tags
from cut""",
    PREVIEW,
)
def dry_run_preview(spark, sf_dir):
    return full_run(spark, sf_dir, dry_run=True).previews


@query("run_stats_dry", STATS.replace("tag_action <> 'skip')", "false)"), PLAIN)
def run_stats_dry(spark, sf_dir):
    return full_run(spark, sf_dir, dry_run=True).stats
