"""Backend replies, bisecting, fallbacks, full text and tag generation."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import sql as S
from catalog.registry import query
from catalog.selection import OPTIONS
from catalog.tagging import REQUESTS, TAGGING, requests_of_candidates
from catalog.texts import packing_sql
from catalog.sql import PLANNED
from catalog.views import duckdb_hash, feed_tables, load
from feedloom.functions.shipping import ship_by_value
from feedloom.operators.candidates import newest_first, select_candidates
from feedloom.operators.fulltext import use_fulltext
from feedloom.operators.inference import ReplyFormatError
from feedloom.operators.packing import pack
from feedloom.operators.planning import plan_entries
from feedloom.operators.replies import with_string_array, with_tag_results
from feedloom.operators.tagging import generate_tags, prepare_requests

ship_by_value(__name__)

# Replies made from every document, in each form a model may answer in. The
# fields of the format strings are the document's id, its double and the
# double's successor, and its language.
ARRAY_REPLIES = [
    '["t{id}", "{lang}"]',
    '```json\n["a{id}"]\n```',
    '{{"translations": ["x", "y{id}"]}}',
    '{{"translations": null}}',
    '[1, "a"]',
    '["a", null]',
    "not json {id}",
    "[]",
    '  ["a{id}"]\n ',
    '{{"other": ["a"]}}',
    '```\n{{"translations": []}}\n  ```',
    '```["a"]',
]
TAG_REPLIES = [
    '{{"results": [{{"request_id": "{b}", "tags": ["B", "{lang}"]}}, {{"request_id": "{a}", "tags": ["A"]}}]}}',
    '{{"tags": [["AI"], ["{lang}", "C"]]}}',
    '[["AI"]]',
    '{{"results": [{{"request_id": "{a}", "tags": ["A"]}}]}}',
    '[{{"request_id": "{a}", "tags": []}}, {{"request_id": {a}, "tags": []}}]',
    '[{{"id": "{a}", "tags": []}}, {{"id": {b}, "tags": ["q"]}}, {{"id": "z{id}", "tags": []}}]',
    '[{{"id": {b}, "tags": ["b"]}}, {{"id": {a}, "tags": ["a", "{lang}"]}}]',
    '[{{"request_id": true, "tags": []}}, {{"request_id": {a}, "tags": []}}]',
    '[{{"request_id": null, "id": {a}, "tags": []}}, {{"request_id": {b}, "tags": []}}]',
    '[{{"request_id": {a}, "tags": [1]}}, {{"request_id": {b}, "tags": []}}]',
    '[["a"], {{"request_id": {a}, "tags": []}}]',
    '"hello {id}"',
    '[["a"], ["b"]',
    '[{{"request_id": {a}.5, "tags": []}}, {{"request_id": {b}, "tags": []}}]',
    '{{"items": []}}',
    '```json\n{{"tags": [[], ["{lang}"]], "items": 3}}\n```',
    '{{"tags": null, "results": [["a"], ["b"]]}}',
]


def _reply_sql(replies) -> str:
    def one(i, reply):
        text = reply.replace("{{", "{").replace("}}", "}").replace("'", "''")
        text = text.replace("\n", "' || chr(10) || '")
        for field, value in (("{id}", "doc_id"), ("{a}", "2 * doc_id"), ("{b}", "2 * doc_id + 1")):
            text = text.replace(field, f"' || ({value})::varchar || '")
        text = text.replace("{lang}", "' || lang || '")
        return f"when {i} then '{text}'"

    cases = " ".join(one(i, reply) for i, reply in enumerate(replies))
    return f"case doc_id % {len(replies)} {cases} end"


def _reply_column(replies):
    parts = [
        reply.replace("{{", "\1").replace("}}", "\2").replace("{id}", "%1$s").replace("{a}", "%2$s")
        .replace("{b}", "%3$s").replace("{lang}", "%4$s").replace("\1", "{").replace("\2", "}")
        for reply in replies
    ]
    kind = F.col("doc_id") % len(replies)
    chosen = F.element_at(F.array(*[F.lit(p) for p in parts]), (kind + 1).cast("int"))
    # format_string wants a constant format, so the fields are replaced one by one
    for field, value in (
        ("%1$s", F.col("doc_id")),
        ("%2$s", 2 * F.col("doc_id")),
        ("%3$s", 2 * F.col("doc_id") + 1),
        ("%4$s", F.col("lang")),
    ):
        chosen = F.replace(chosen, F.lit(field), value.cast("string"))
    return chosen


CLEANED = r"""
fenced as (select *, regexp_replace(reply, '^\s+|\s+$', '', 'g') as stripped from responses),
bodies as (
  select *, case when not starts_with(stripped, '```') then stripped else
    regexp_replace(regexp_replace(regexp_replace(stripped, '\A```[^\n]*\n?', ''),
                   '(\A|\n)\s*```\s*\z', ''), '^\s+|\s+$', '', 'g') end as body
  from fenced)"""

# whether a JSON value is an array of strings only
STRINGS = (
    "(json_type({v}) = 'ARRAY' and len(list_filter(json_extract({v}, '$[*]'), "
    "lambda x: json_type(x) <> 'VARCHAR')) = 0)"
)
TEXTS = "list_transform(json_extract({v}, '$[*]'), lambda x: x->>'$')"


@query(
    "reply_arrays",
    f"""
select doc_id, case when {STRINGS.format(v='inner_value')} then {S.joined(TEXTS.format(v='inner_value'))} end as items,
       case when value is null then 'malformed-json'
            when not coalesce({STRINGS.format(v='inner_value')}, false) then 'not-a-string-array' end as reply_error
from unwrapped""",
    f"""
responses as (select doc_id, {_reply_sql(ARRAY_REPLIES)} as reply from documents),{CLEANED},
parsed as (select *, case when json_valid(body) then body::json end as value from bodies),
unwrapped as (
  select *, case when json_type(value) = 'OBJECT' and json_exists(value, '$.translations')
                 then value->'$.translations' else value end as inner_value from parsed)""",
)
def reply_arrays(spark, sf_dir):
    replies = load(spark, sf_dir, "documents").select(
        "doc_id", _reply_column(ARRAY_REPLIES).alias("reply")
    )
    return with_string_array(replies, "reply").select(
        "doc_id", F.array_join("items", "|").alias("items"), "reply_error"
    )


TAG_READ = f"""
responses as (select doc_id, {_reply_sql(TAG_REPLIES)} as reply,
                     [(2 * doc_id)::varchar, (2 * doc_id + 1)::varchar] as ids from documents),{CLEANED},
parsed as (select *, case when json_valid(body) then body::json end as value from bodies),
unwrapped as (
  select *, case when json_type(value) <> 'OBJECT' then value
                 when json_exists(value, '$.tags') then value->'$.tags'
                 when json_exists(value, '$.results') then value->'$.results'
                 when json_exists(value, '$.items') then value->'$.items' else value end as inner_value
  from parsed),
numbered as (
  select doc_id, unnest(list_transform(json_extract(inner_value, '$[*]'),
         lambda x, i: {{'v': x, 'place': i}})) as item
  from unwrapped where json_type(inner_value) = 'ARRAY'),
given as (
  select doc_id, item.place as place, item.v as v,
         case when json_exists(item.v, '$.request_id') then item.v->'$.request_id'
              else item.v->'$.id' end as given_id, item.v->'$.tags' as tags
  from numbered),
keyed as (
  select *, case when json_type(given_id) in ('VARCHAR', 'UBIGINT', 'BIGINT') then given_id->>'$'
                 when json_type(given_id) = 'BOOLEAN'
                 then upper(left(given_id::varchar, 1)) || substr(given_id::varchar, 2) end as key
  from given),
item_errors as (
  select *, case when key is null then 'missing-request-id'
                 when not coalesce({STRINGS.format(v='tags')}, false) then 'tags-not-strings'
                 when row_number() over (partition by doc_id, key order by place) > 1
                 then 'duplicate-request-id' end as item_error
  from keyed),
summary as (
  select doc_id, count(*) as item_count, bool_and({STRINGS.format(v='v')}) as is_matrix,
         bool_and(json_type(v) = 'OBJECT') as all_objects,
         (array_agg(item_error order by place) filter (where item_error is not null))[1] as first_error,
         list(key order by place) as keys
  from item_errors group by doc_id),
errors as (
  select u.doc_id, u.ids, coalesce(is_matrix, true) as is_matrix,
    case when value is null then 'malformed-json'
      when json_type(inner_value) <> 'ARRAY' then 'not-an-array'
      when coalesce(is_matrix, true) then
        case when coalesce(item_count, 0) <> 2 then 'count-mismatch' end
      when not all_objects then 'not-tag-results'
      when first_error is not null then first_error
      when not list_has_all(keys, ids) then 'missing-result'
      when not list_has_all(ids, keys) then 'unexpected-result' end as reply_error
  from unwrapped u left join summary s using (doc_id)),
results as (
  select e.doc_id, string_agg(
      case when is_matrix then {S.joined(TEXTS.format(v='v'), ',')}
           else {S.joined(TEXTS.format(v='tags'), ',')} end,
      '|' order by case when is_matrix then place else list_position(ids, key) end) as results
  from errors e join keyed k using (doc_id) where reply_error is null group by e.doc_id)"""


@query(
    "reply_tags",
    "select doc_id, results, reply_error from errors left join results using (doc_id)",
    TAG_READ,
)
def reply_tags(spark, sf_dir):
    first = 2 * F.col("doc_id")
    replies = load(spark, sf_dir, "documents").select(
        "doc_id",
        _reply_column(TAG_REPLIES).alias("reply"),
        F.array(first.cast("string"), (first + 1).cast("string")).alias("ids"),
    )
    lists = F.transform("results", lambda tags: F.array_join(tags, ","))
    return with_tag_results(replies, "reply", "ids").select(
        "doc_id", F.array_join(lists, "|").alias("results"), "reply_error"
    )


REQUEST_SQL = REQUESTS.replace("@max_tags", "4")


@query(
    "pack_requests",
    "select entry_id, position, chunk_id from packed",
    f"{REQUEST_SQL},{packing_sql('payloads', 'request_index', 'payload_size', 'entry_id')}",
)
def pack_requests(spark, sf_dir):
    requests = requests_of_candidates(spark, sf_dir, TAGGING)
    prepared = prepare_requests(requests, newest_first(), TAGGING)
    sizes = prepared.select("entry_id", "request_index", "payload_size")
    packed = pack(
        sizes, [F.col("request_index")], "payload_size", max_items=40, max_size=8000
    )
    return packed.select("entry_id", "position", "chunk_id")


def title_words(requests):
    return [
        {"request_id": r["request_id"], "tags": r["title"].split(" ")[-2:] + ["ai", "AI"]}
        for r in reversed(requests)
    ]


GENERATED = f"""
tagged_requests as (
  select entry_id, slots, current_tags, {S.clean_tags("list_concat(string_split(title, ' ')[-2:], ['ai', 'AI'])")} as cleaned
  from requests),
generated as (
  select entry_id, {S.lacking(f"({S.unique('cleaned')})[1:slots]", 'current_tags')} as tags
  from tagged_requests)"""


@query(
    "tag_generation",
    f"""
select entry_id, coalesce({S.joined('g.tags')}, '') as generated
from tagged_candidates left join generated g using (entry_id)""",
    f"{REQUEST_SQL},{GENERATED}",
)
def tag_generation(spark, sf_dir):
    requests = requests_of_candidates(spark, sf_dir, TAGGING)
    done = generate_tags(requests, newest_first(), title_words, TAGGING)
    return done.select("entry_id", F.array_join("generated", "|").alias("generated"))


def few_at_a_time(requests):
    """Answers up to three requests, and never one whose title has an x."""
    if len(requests) > 3:
        return [[]]  # wrong count
    if any("x" in r["title"] for r in requests):
        raise ReplyFormatError("unusable title")
    return title_words(requests)


@query(
    "tag_bisecting",
    f"""
select entry_id, slots is not null and contains(c.title, 'x') as failed,
       case when slots is null or not contains(c.title, 'x') then coalesce({S.joined('g.tags')}, '') end as generated
from tagged_candidates c left join requests using (entry_id) left join generated g using (entry_id)""",
    f"{REQUEST_SQL},{GENERATED}",
)
def tag_bisecting(spark, sf_dir):
    requests = requests_of_candidates(spark, sf_dir, TAGGING)
    done = generate_tags(requests, newest_first(), few_at_a_time, TAGGING)
    return done.select(
        "entry_id",
        F.col("error").isNotNull().alias("failed"),
        F.array_join("generated", "|").alias("generated"),
    )


def broken_together(requests):
    """Fails in a way that is not a format error unless asked for one article."""
    if len(requests) > 1:
        raise ConnectionError("cannot take that many")
    return title_words(requests)


@query(
    "tag_fallback",
    f"""
select entry_id, coalesce({S.joined('g.tags')}, '') as generated
from tagged_candidates left join generated g using (entry_id)""",
    f"{REQUEST_SQL},{GENERATED}",
)
def tag_fallback(spark, sf_dir):
    requests = requests_of_candidates(spark, sf_dir, TAGGING)
    done = generate_tags(requests, newest_first(), broken_together, TAGGING)
    return done.select("entry_id", F.array_join("generated", "|").alias("generated"))


FULLTEXT = f"""{PLANNED},
fetched as (
  select p.*, f.content as fetched from planned p
  left join fulltext f on f.url = {S.strip('p.link')} and p.link <> '' and p.action = 'translate'
    and f.error is null and regexp_matches(f.content, '[^{S.SPACE}]'))"""


@query(
    "fulltext_swap",
    f"""
select entry_id, action, coalesce(fetched, source_content) as source_content,
       case when fetched is not null and fetched <> source_content
            then {duckdb_hash('source_title', 'fetched')} else source_hash end as source_hash
from fetched""",
    FULLTEXT,
)
def fulltext_swap(spark, sf_dir):
    planned = plan_entries(select_candidates(feed_tables(spark, sf_dir), OPTIONS), OPTIONS)
    swapped = use_fulltext(planned, load(spark, sf_dir, "fulltext"))
    return swapped.select("entry_id", "action", "source_content", "source_hash")
