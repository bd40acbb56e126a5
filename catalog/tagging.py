"""Tag lists, tag plans and requests."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.selection import OPTIONS, tags_text
from catalog.sql import CANDIDATES, PLANNED, clean_tags, excerpt, joined, lacking, strip, unique
from catalog.sql import runs as runs_sql
from catalog.views import feed_tables, load
from feedloom.functions import tags as T
from feedloom.functions.shipping import ship_by_value
from feedloom.operators.candidates import newest_first, select_candidates
from feedloom.operators.ordering import with_positions
from feedloom.operators.planning import plan_entries
from feedloom.operators.segments import with_runs
from feedloom.operators.tagging import (
    may_request_tags,
    plan_tags,
    with_payload,
    with_tagging_excerpt,
)

ship_by_value(__name__)

TAGGING = replace(OPTIONS, tagging=True, max_tags=4, tag_language="en")

# Every document as separated, padded, repeated tags, cut in two ways.
WORDS = """
words as (
  select doc_id, concat(replace(text, '.', ',, #'), ',', lang) as raw,
         concat('"', source, '", ', upper(lang), ';', replace(text, ',', ' ; ')) as other
  from documents)"""


def words(spark, sf_dir):
    return load(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(F.replace("text", F.lit("."), F.lit(",, #")), F.lit(","), "lang").alias("raw"),
        F.concat(
            F.lit('"'),
            "source",
            F.lit('", '),
            F.upper("lang"),
            F.lit(";"),
            F.replace("text", F.lit(","), F.lit(" ; ")),
        ).alias("other"),
    )


@query(
    "tag_cache_parse",
    f"select doc_id, {joined(unique('cleaned'))} as tags, len({unique('cleaned')}) as tag_count "
    "from cleaned",
    f"{WORDS}, cleaned as (select doc_id, {clean_tags('[raw]')} as cleaned from words)",
)
def tag_cache_parse(spark, sf_dir):
    parsed = words(spark, sf_dir).withColumn("parsed", T.parse_tag_cache(F.col("raw")))
    return parsed.select(
        "doc_id",
        tags_text("parsed").alias("tags"),
        F.size("parsed").cast("bigint").alias("tag_count"),
    )


@query(
    "tag_clean",
    f"select doc_id, {joined(clean_tags('[raw, other]'))} as tags from words",
    WORDS,
)
def tag_clean(spark, sf_dir):
    cleaned = T.clean_tags(F.array("raw", "other"))
    return words(spark, sf_dir).select("doc_id", F.array_join(cleaned, "|").alias("tags"))


MERGED = f"""{WORDS},
both_lists as (select doc_id, {clean_tags('[other, raw]')} as cleaned from words),
merged as (select doc_id, {unique('cleaned')} as tags from both_lists)"""


@query(
    "tag_merge",
    f"select doc_id, {joined('tags')} as tags, {joined('tags[1:5]')} as first_five from merged",
    MERGED,
)
def tag_merge(spark, sf_dir):
    left, right = F.array("other"), F.array("raw")
    return words(spark, sf_dir).select(
        "doc_id",
        F.array_join(T.merge_tags(left, right), "|").alias("tags"),
        F.array_join(T.merge_tags(left, right, F.lit(5)), "|").alias("first_five"),
    )


@query(
    "tag_cache_format",
    f"select doc_id, {joined('tags', ',')} as tag_cache from merged",
    MERGED,
)
def tag_cache_format(spark, sf_dir):
    return words(spark, sf_dir).select(
        "doc_id", T.format_tag_cache(F.array("other", "raw")).alias("tag_cache")
    )


STORED = """
stored as (
  select doc_id, case doc_id % 8
    when 0 then to_json([lang, ' #Ai ', source, upper(lang)])::varchar
    when 1 then concat(lang, ';', source, ',,', upper(lang))
    when 2 then concat('{"tags": ["', lang, '"]}')
    when 3 then concat('["', lang, '", ', cast(doc_id as varchar), ', true, null, false]')
    when 4 then cast(doc_id as varchar)
    when 5 then null
    when 6 then concat('["', lang, '", ')
    else to_json(text)::varchar end as value
  from documents)"""


@query(
    "stored_tags_decode",
    f"""
select doc_id, {joined(unique('cleaned'))} as tags from (
  select doc_id, {clean_tags('items')} as cleaned from (
    select doc_id, case when value is null then []
      when not json_valid(value) then [value]
      when json_type(value) = 'ARRAY' then list_transform(json_extract(value, '$[*]'),
        lambda v: case json_type(v) when 'BOOLEAN' then concat(upper(left(v::varchar, 1)), substr(v::varchar, 2))
                  when 'NULL' then 'None' else v->>'$' end)
      else [] end as items
    from stored))""",
    STORED,
)
def stored_tags_decode(spark, sf_dir):
    number = F.col("doc_id").cast("string")
    quoted = F.concat(F.lit('["'), "lang", F.lit('", '))
    text_json = F.to_variant_object(F.array("text"))
    kind = F.col("doc_id") % 8
    value = (
        F.when(
            kind == 0, F.to_json(F.array("lang", F.lit(" #Ai "), "source", F.upper("lang")))
        )
        .when(kind == 1, F.concat("lang", F.lit(";"), "source", F.lit(",,"), F.upper("lang")))
        .when(kind == 2, F.concat(F.lit('{"tags": ["'), "lang", F.lit('"]}')))
        .when(kind == 3, F.concat(quoted, number, F.lit(", true, null, false]")))
        .when(kind == 4, number)
        .when(kind == 5, F.lit(None))
        .when(kind == 6, quoted)
        .otherwise(F.to_json(F.try_variant_get(text_json, "$[0]", "variant")))
    )
    return (
        load(spark, sf_dir, "documents")
        .select("doc_id", value.alias("value"))
        .select("doc_id", F.array_join(T.decode_stored_tags(F.col("value")), "|").alias("tags"))
    )


@query(
    "generated_tags_normalize",
    f"""
select doc_id, {joined(lacking('fitting', 'present'))} as tags from (
  select doc_id, tags[1:slots] as fitting, present from (
    select doc_id, {unique('cleaned')} as tags, 1 + doc_id % 5 as slots, present
    from (select doc_id, {clean_tags('[raw]')} as cleaned,
                 [upper(string_split(raw, ' ')[1]), lang] as present
          from words join documents using (doc_id))))""",
    WORDS,
)
def generated_tags_normalize(spark, sf_dir):
    present = F.array(F.upper(F.split("raw", " ")[0]), F.col("lang"))
    slots = (F.lit(1) + F.col("doc_id") % 5).cast("int")
    rows = words(spark, sf_dir).join(load(spark, sf_dir, "documents"), "doc_id")
    normal = T.normalize_generated(F.array("raw"), present, slots)
    return rows.select("doc_id", F.array_join(normal, "|").alias("tags"))


@query(
    "tag_request_gate",
    "select entry_id, owner_count <= 1 and len(current_tags) < 4 as may_request from tagged_candidates",
    CANDIDATES,
)
def tag_request_gate(spark, sf_dir):
    rows = select_candidates(feed_tables(spark, sf_dir), TAGGING)
    return rows.select("entry_id", may_request_tags(TAGGING).alias("may_request"))


TAG_PLAN = f"""{PLANNED},
tag_planned as (
  select *, case when rule = 1 then 'skip:shared-entry' when not tracked then 'skip:no-tracking-record'
    when len(t_tags) > 0 then case
      when len({lacking('t_tags', 'current_tags')}) > 0 then 'apply:restore-saved-ai-tags'
      else 'skip:saved-ai-tags-already-present' end
    when len(current_tags) >= @max_tags then 'skip:existing-tags-sufficient'
    else 'generate:generated-ai-tags' end as verdict
  from planned)"""


@query(
    "tag_plan",
    f"""
select entry_id, action, split_part(verdict, ':', 1) as tag_action, split_part(verdict, ':', 2) as tag_reason,
       case when verdict like 'apply%' then {joined('t_tags')} else '' end as tags,
       verdict like 'generate%' as persist
from tag_planned where action <> 'translate'""",
    TAG_PLAN.replace("@max_tags", "3"),
)
def tag_plan(spark, sf_dir):
    options = replace(TAGGING, max_tags=3)
    rows = plan_entries(select_candidates(feed_tables(spark, sf_dir), options), options)
    return plan_tags(rows.where("action != 'translate'"), options).select(
        "entry_id",
        "action",
        F.col("tag_plan.action").alias("tag_action"),
        F.col("tag_plan.reason").alias("tag_reason"),
        tags_text("tag_plan.tags").alias("tags"),
        F.col("tag_plan.persist").alias("persist"),
    )


# Requests of all candidates, newest first, on their current text.
REQUESTS = f"""{CANDIDATES},
page_runs as ({runs_sql('candidates', 'entry_id', 'content')}),
readable as (
  select entry_id, string_agg({strip('text')}, chr(10) order by place) as readable
  from page_runs group by entry_id),
requests as (
  select c.entry_id, c.title, c.current_tags, @max_tags - len(c.current_tags) as slots,
         {excerpt('readable', 4000)} as content_excerpt,
         row_number() over (order by date_entered desc, c.entry_id desc) - 1 as request_index
  from tagged_candidates c join readable using (entry_id)
  where len(c.current_tags) < @max_tags),
payloads as (
  select *, length(to_json({{'request_id': request_index::varchar, 'title': title,
      'content_excerpt': content_excerpt, 'existing_tags': current_tags, 'max_new_tags': slots,
      'tag_language': 'en'}})::varchar) + 11 + greatest(len(current_tags) - 1, 0) as payload_size
  from requests)"""


def requests_of_candidates(spark, sf_dir, options):
    rows = select_candidates(feed_tables(spark, sf_dir), options)
    return (
        with_tagging_excerpt(with_runs(rows, "content"))
        .select(
            "entry_id",
            "date_entered",
            F.lit(True).alias("batched"),
            "title",
            "excerpt",
            F.col("current_tags").alias("existing_tags"),
        )
    )



@query(
    "tag_request_payload",
    """
select entry_id, request_index, slots, content_excerpt, payload_size from payloads""",
    REQUESTS.replace("@max_tags", "4"),
)
def tag_request_payload(spark, sf_dir):
    rows = requests_of_candidates(spark, sf_dir, TAGGING).where(F.size("existing_tags") < 4)
    numbered = with_positions(rows, newest_first(), "request_index")
    prepared = with_payload(numbered, F.col("request_index").cast("string"), TAGGING)
    return prepared.select(
        "entry_id",
        "request_index",
        F.col("slots").cast("bigint").alias("slots"),
        F.col("excerpt").alias("content_excerpt"),
        F.col("payload_size").cast("bigint").alias("payload_size"),
    )
