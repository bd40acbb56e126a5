"""Building blocks of the checking SQL, in DuckDB's dialect."""

from __future__ import annotations

from catalog.views import RUN_TS, duckdb_hash

# The same character sets the engine uses, in RE2 spelling.
SPACE = (
    r"\t-\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
TRIMMED = r"[ \t\r\n#''\"`.,;:\[\](){}]+"
TRANSLATABLE = r"[0-9A-Za-z\x{c0}-\x{24f}\x{400}-\x{4ff}\x{370}-\x{3ff}]"
NOW = f"timestamp '{RUN_TS:%Y-%m-%d %H:%M:%S}'"


def strip(text: str) -> str:
    return f"regexp_replace({text}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def collapse(text: str) -> str:
    return f"regexp_replace({text}, '[{SPACE}]+', ' ', 'g')"


def escape(text: str) -> str:
    return f"replace(replace(replace({text}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def clean_tags(tags: str) -> str:
    parts = (
        f"flatten(list_transform({tags}, "
        "lambda t: string_split_regex(coalesce(t, ''), '[,;\\n]+')))"
    )
    trimmed = (
        f"list_transform({parts}, lambda p: "
        f"regexp_replace({collapse('p')}, '^{TRIMMED}|{TRIMMED}$', '', 'g'))"
    )
    return f"list_filter({trimmed}, lambda p: p <> '')"


def unique(tags: str) -> str:
    """First of every spelling; ``tags`` should be a column, it is used twice."""
    return (
        f"list_filter({tags}, lambda x, i: "
        f"list_position(list_transform({tags}, lambda y: lower(y)), lower(x)) = i)"
    )


def lacking(tags: str, present: str) -> str:
    return (
        f"list_filter({tags}, lambda x: "
        f"not list_contains(list_transform({present}, lambda y: lower(y)), lower(x)))"
    )


def joined(tags: str, separator: str = "|") -> str:
    return f"coalesce(array_to_string({tags}, '{separator}'), '')"


def excerpt(text: str, max_chars: int) -> str:
    head = f"left({text}, {max_chars})"
    back = strip(f"regexp_replace({head}, '(?s) [^ ]*$', '')")
    return (
        f"case when length({text}) <= {max_chars} then {text} "
        f"when {back} <> '' then {back} else {strip(head)} end"
    )


def preview(text: str, max_chars: int) -> str:
    line = strip(collapse(text))
    cut = f"regexp_replace(left({line}, {max_chars - 3}), '[{SPACE}]+$', '')"
    return (
        f"case when {line} = '' then '<empty>' when length({line}) <= {max_chars} then {line} "
        f"else concat({cut}, '...') end"
    )


MARKUP = (
    "(?s)<script[^>]*>.*?(?:</script>|\\z)|<style[^>]*>.*?(?:</style>|\\z)|<!--.*?-->|<[^>]*>"
)


def runs(table: str, key: str, html: str, carry: str = "") -> str:
    """Non-blank text runs outside script and style: key, place, text."""
    text = "piece.raw"
    for entity, character in (
        ("&lt;", "<"),
        ("&gt;", ">"),
        ("&quot;", '"'),
        ("&copy;", "©"),
        ("&middot;", "·"),
        ("&amp;", "&"),
    ):
        text = f"replace({text}, '{entity}', '{character}')"
    # a reference may lack its semicolon at the very end of a text
    text = f"regexp_replace({text}, '&amp$', '&')"
    pieces = (
        f"unnest(list_transform(string_split(regexp_replace({html}, '{MARKUP}', chr(1), 'g'), chr(1)), "
        "lambda x, i: {'raw': x, 'place': i})) as piece"
    )
    return (
        f"select {key}, {carry} piece.place as place, {text} as text "
        f"from (select {key}, {carry} {pieces} from {table}) "
        f"where regexp_matches(piece.raw, '[^{SPACE}]')"
    )


def segments(table: str, key: str, html: str, carry: str = "") -> str:
    """Translatable runs numbered from 0 with their core and whitespace."""
    return (
        f"select {key}, {carry} row_number() over (partition by {key} order by place) - 1 as seq, place, "
        f"regexp_extract(text, '^[{SPACE}]*') as prefix, {strip('text')} as core, "
        f"regexp_extract(text, '[{SPACE}]*$') as suffix "
        f"from ({runs(table, key, html, carry)}) where regexp_matches(text, '{TRANSLATABLE}')"
    )


# One row per candidate article, the tracking row's columns with the prefix t_.
CANDIDATES = f"""
owned as (
  select *, row_number() over (partition by ref_id order by int_id) as nth
  from user_entries where owner_uid = 1 and feed_id in (60, 61, 62, 63)),
owner_counts as (
  select ref_id, count(distinct owner_uid) as owner_count from user_entries group by ref_id),
candidates as (
  select e.id as entry_id, u.owner_uid, u.int_id as user_entry_id, u.feed_id,
         coalesce(f.title, '') as feed_title, coalesce(e.link, '') as link, e.title, e.content,
         string_split(coalesce(u.tag_cache, ''), chr(0)) as raw_tags,
         e.lang as source_lang, e.date_entered, c.owner_count,
         t.entry_id is not null as tracked, t.target_language as t_language,
         t.source_hash as t_hash, t.source_title as t_source_title,
         t.source_content as t_source_content, t.translated_title as t_title,
         t.translated_content as t_content, t.generated_tags as t_tags
  from entries e
  join owned u on u.ref_id = e.id and u.nth = 1
  join owner_counts c on c.ref_id = e.id
  left join feeds f on f.id = u.feed_id and f.owner_uid = u.owner_uid
  left join translations t on t.entry_id = e.id
  where e.date_entered >= {NOW} - interval 48 hour),
cleaned as (select *, {clean_tags('raw_tags')} as tags_cleaned from candidates),
tagged_candidates as (select *, {unique('tags_cleaned')} as current_tags from cleaned)"""

# The planning rules over them.
PLANNED = f"""{CANDIDATES},
judged as (
  select *, {duckdb_hash('title', 'content')} as current_hash,
         tracked and title = t_title and content = t_content as shows_translation,
         coalesce(t_language = 'zh-CN', false) as same_target
  from tagged_candidates),
ruled as (
  select *, case when owner_count > 1 then 1 when not tracked then 2
                 when shows_translation and same_target then 3
                 when current_hash = t_hash and same_target then 4
                 when shows_translation then 5 else 6 end as rule
  from judged),
planned as (
  select *, case when rule in (1, 3) then 'skip' when rule = 4 then 'reapply' else 'translate' end
              as action,
         ['shared-between-multiple-owners', 'no-tracking-record', 'already-translated',
          'same-source-hash-found-in-db', 'target-language-changed-reuse-stored-source',
          'source-changed-or-manually-edited'][rule] as reason,
         case when rule in (3, 4, 5) then t_source_title else title end as source_title,
         case when rule in (3, 4, 5) then t_source_content else content end as source_content,
         case when rule in (3, 4, 5) then t_hash else current_hash end as source_hash
  from ruled)"""
