"""HTML segmentation, packing and batch translation."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from catalog import sql as S
from catalog.registry import query
from catalog.selection import OPTIONS
from catalog.views import ESCAPED, load
from feedloom.functions.shipping import ship_by_value
from feedloom.functions.text import escape_markup, preview, strip
from feedloom.operators.candidates import newest_first
from feedloom.operators.inference import (
    GlossaryBackend,
    Remembered,
    translate_by_glossary,
    translate_texts,
)
from feedloom.operators.packing import pack
from feedloom.operators.segments import (
    explode_segments,
    gather_translations,
    glued_segments,
    is_translatable,
    rebuilt_html,
    split_whitespace,
    texts_to_translate,
    with_excerpt,
    with_html_preview,
    with_runs,
    with_segments,
)
from feedloom.plans.convenience import translate_html, translate_title_and_html
from feedloom.sources.staging import checkpoint_root, stage

ship_by_value(__name__)


def pages(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", "html")


def bigint(name: str):
    return F.col(name).cast("bigint").alias(name)


@query(
    "html_runs",
    f"""
select page_id, row_number() over (partition by page_id order by place) - 1 as nth, text
from ({S.runs('pages', 'page_id', 'html')})""",
)
def html_runs(spark, sf_dir):
    shown = F.filter("runs", lambda run: run["readable"] & run["text"].rlike(r"\S"))
    return (
        with_runs(pages(spark, sf_dir), "html")
        .select("page_id", F.posexplode(shown).alias("nth", "run"))
        .select("page_id", bigint("nth"), "run.text")
    )


def _segments_query(name, table, key, html):
    select = f"select {key}, seq, prefix, core, suffix from ({S.segments(table, key, html)})"

    @query(name, select)
    def build(spark, sf_dir):
        rows = load(spark, sf_dir, table).select(key, html)
        found = explode_segments(with_segments(with_runs(rows, html)), key)
        return found.withColumn("seq", F.col("seq").cast("bigint"))


_segments_query("page_segments", "pages", "page_id", "html")
_segments_query("entry_segments", "entries", "id", "content")


# Pages glued into a few very long documents.
@query(
    "long_document_segments",
    f"select part, seq, prefix, core, suffix from ({S.segments('glued', 'part', 'html')})",
    "glued as (select page_id % 4 as part, string_agg(html, '' order by page_id) as html"
    " from pages group by 1)",
)
def long_document_segments(spark, sf_dir):
    rows = load(spark, sf_dir, "pages").select((F.col("page_id") % 4).alias("part"), "page_id", "html")
    return glued_segments(rows, "part", "page_id", "html")


@query(
    "whitespace_split",
    f"""
select doc_id, regexp_extract(padded, '^[{S.SPACE}]*') as prefix, {S.strip('padded')} as core,
       regexp_extract(padded, '[{S.SPACE}]*$') as suffix
from (select doc_id, concat(repeat(' ', (doc_id % 3)::int), chr(160), chr(9), text, chr(10), chr(8195)) as padded
      from documents)""",
)
def whitespace_split(spark, sf_dir):
    padded = F.concat(
        F.repeat(F.lit(" "), (F.col("doc_id") % 3).cast("int")),
        F.lit(chr(160) + "\t"),
        "text",
        F.lit("\n" + chr(8195)),
    )
    return (
        load(spark, sf_dir, "documents")
        .select("doc_id", padded.alias("padded"))
        .select("doc_id", *split_whitespace(F.col("padded")))
    )


# Every word on its own, some reduced to their punctuation or to another script.
@query(
    "translatable_words",
    f"""
select doc_id, count(*) as words, count(*) filter (where regexp_matches(word, '{S.TRANSLATABLE}')) as translatable
from (select doc_id, case when length(word) % 3 = 0 then regexp_replace(word, '[^.,;#*%$&]', '', 'g')
                          when length(word) % 7 = 0 then concat(chr(20013), chr(25991)) else word end as word
      from (select doc_id, unnest(string_split(text, ' ')) as word from documents))
group by doc_id""",
)
def translatable_words(spark, sf_dir):
    word = F.col("word")
    changed = (
        F.when(F.length(word) % 3 == 0, F.regexp_replace(word, "[^.,;#*%$&]", ""))
        .when(F.length(word) % 7 == 0, F.lit(chr(20013) + chr(25991)))
        .otherwise(word)
    )
    words = load(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", " ")).alias("word"))
    return (
        words.select("doc_id", changed.alias("word"))
        .groupBy("doc_id")
        .agg(
            F.count("*").alias("words"),
            F.count_if(is_translatable(F.col("word"))).alias("translatable"),
        )
    )


# All texts of all articles: titles, then segments.
PAYLOAD = f"""
cores as ({S.segments('entries', 'id', 'content', 'date_entered,')}),
payload as (
  select id as entry_id, date_entered, -1 as seq, title as text from entries
  where regexp_matches(title, '[^{S.SPACE}]')
  union all select id, date_entered, seq, core from cores)"""


def payload(spark, sf_dir):
    entries = load(spark, sf_dir, "entries").withColumnRenamed("id", "entry_id")
    parsed = with_segments(with_runs(entries, "content"))
    parsed = stage(parsed.select("entry_id", "date_entered", "title", "segments"), "segments")
    return texts_to_translate(parsed, "entry_id", "date_entered", title="title")


@query("translation_payload", "select entry_id, seq, text from payload", PAYLOAD)
def translation_payload(spark, sf_dir):
    return payload(spark, sf_dir).select("entry_id", bigint("seq"), "text")


def packing_sql(
    table: str, order: str, size: str, keys: str, items: int = 40, chars: int = 8000
) -> str:
    """Greedy packing: where a chunk from each item would end, walked from the first."""
    return f"""
numbered as (
  select {keys}, {size} as size, row_number() over (order by {order}) - 1 as position from {table}),
summed as (select *, sum(size) over (order by position)::bigint as upto from numbered),
ends as materialized (
  select a.position, least(coalesce(min(b.position), a.position + {items}),
           (select count(*) from summed)) as follow
  from summed a left join summed b
    on b.position > a.position and b.position <= a.position + {items}
    and b.upto > a.upto - a.size + {chars}
  group by a.position),
walk as (
  select 0::bigint as start union all
  select e.follow from walk w join ends e on e.position = w.start),
packed as (
  select n.*, max(w.start) over (order by n.position) as chunk_id
  from numbered n left join walk w on n.position = w.start)"""


PACKED_TEXTS = f"{PAYLOAD},{packing_sql('payload', 'date_entered desc, entry_id desc, seq', 'length(text)', 'entry_id, seq, text')}"


@query("pack_texts", "select entry_id, seq, position, chunk_id from packed", PACKED_TEXTS)
def pack_texts(spark, sf_dir):
    sizes = payload(spark, sf_dir).withColumn("size", F.length("text")).drop("text")
    packed = pack(sizes, [*newest_first(), F.col("seq")], "size", max_items=40, max_size=8000)
    return packed.select("entry_id", bigint("seq"), "position", "chunk_id")


SMALL_CHUNKS = f"{PAYLOAD},{packing_sql('payload', 'date_entered desc, entry_id desc, seq', 'length(text)', 'entry_id, seq, text', 13, 900)}"


# Blocks far smaller than the input, so that chunks cross many of them.
@query("pack_many_blocks", "select entry_id, seq, position, chunk_id from packed", SMALL_CHUNKS)
def pack_many_blocks(spark, sf_dir):
    sizes = payload(spark, sf_dir).withColumn("size", F.length("text")).drop("text")
    order = [*newest_first(), F.col("seq")]
    packed = pack(
        sizes, order, "size", max_items=13, max_size=900, block_items=64, group_blocks=8
    )
    return packed.select("entry_id", bigint("seq"), "position", "chunk_id")


@query(
    "batch_translate",
    "select entry_id, seq, position, concat('T(', text, ')') as translated from packed",
    PACKED_TEXTS,
)
def batch_translate(spark, sf_dir):
    order = [*newest_first(), F.col("seq")]
    done = translate_texts(payload(spark, sf_dir), order, GlossaryBackend(), OPTIONS)
    return done.select("entry_id", bigint("seq"), "position", "translated")


def refusing_backend(texts):
    raise ValueError("asked again")


# The answers of a first run are kept, so a second one gets them without asking.
@query(
    "batch_translate_again",
    "select entry_id, seq, position, concat('T(', text, ')') as translated from packed",
    PACKED_TEXTS,
)
def batch_translate_again(spark, sf_dir):
    order = [*newest_first(), F.col("seq")]
    path = f"{checkpoint_root(spark)}/feedloom/{uuid.uuid4().hex}/answers"
    texts = payload(spark, sf_dir)
    for backend in (GlossaryBackend(), refusing_backend):
        done = translate_texts(texts, order, Remembered(backend, path, "T"), OPTIONS)
    return done.select("entry_id", bigint("seq"), "position", "translated")


@query(
    "batch_translate_distinct",
    "select entry_id, seq, concat('T(', text, ')') as translated from payload",
    PAYLOAD,
)
def batch_translate_distinct(spark, sf_dir):
    order = [*newest_first(), F.col("seq")]
    options = replace(OPTIONS, distinct_texts=True)
    done = translate_texts(payload(spark, sf_dir), order, GlossaryBackend(), options)
    return done.select("entry_id", bigint("seq"), "translated")


@query(
    "glossary_translate",
    """
select p.entry_id, p.seq, coalesce(g.target, concat('T(', p.text, ')')) as translated
from payload p left join glossary g on g.core = p.text""",
    PAYLOAD,
)
def glossary_translate(spark, sf_dir):
    done = translate_by_glossary(payload(spark, sf_dir), load(spark, sf_dir, "glossary"))
    return done.select("entry_id", bigint("seq"), "translated")


# A text the backend rejects, together with whatever shares its chunk.
REJECTED = "hath"


def picky_backend(texts):
    if any("hath" in text for text in texts):
        raise ValueError("rejected text")
    return [f"T({text})" for text in texts]


def careless_backend(texts):
    return [None if REJECTED in text else f"T({text})" for text in texts]


FALLBACK = (
    f"""
select entry_id, count(*) as texts, bool_or(contains(text, '{REJECTED}')) as failed,
       case when not bool_or(contains(text, '{REJECTED}'))
            then string_agg(concat('T(', text, ')'), '|' order by seq) end as translated
from payload group by entry_id""",
    PAYLOAD,
)


@query("translate_fallback", *FALLBACK)
def translate_fallback(spark, sf_dir):
    return fallback(spark, sf_dir, picky_backend, OPTIONS)


# An article must not fail for a text that only another one has.
@query("distinct_fallback", *FALLBACK)
def distinct_fallback(spark, sf_dir):
    return fallback(spark, sf_dir, picky_backend, replace(OPTIONS, distinct_texts=True))


# An answer with something other than texts fails like a refused call.
@query("backend_bad_items", *FALLBACK)
def backend_bad_items(spark, sf_dir):
    return fallback(spark, sf_dir, careless_backend, OPTIONS)


def fallback(spark, sf_dir, backend, options):
    order = [*newest_first(), F.col("seq")]
    texts = payload(spark, sf_dir)
    done = translate_texts(texts, order, backend, options)
    per_article = texts.groupBy("entry_id").agg(F.count("*").alias("texts"))
    gathered = gather_translations(done, "entry_id")
    line = F.array_join(
        F.concat(F.filter(F.array("new_title"), lambda t: t.isNotNull()), "new_cores"), "|"
    )
    return (
        per_article.join(gathered, "entry_id")
        .select(
            "entry_id",
            "texts",
            F.col("error").isNotNull().alias("failed"),
            F.when(F.col("error").isNull(), line).alias("translated"),
        )
    )


@query("html_identity", "select page_id, html from pages")
def html_identity(spark, sf_dir):
    parsed = with_segments(with_runs(pages(spark, sf_dir), "html").drop("html"))
    same = parsed.withColumn("new_cores", F.transform("segments", lambda s: strip(s["text"])))
    return same.select("page_id", rebuilt_html().alias("html"))


def rewritten_sql(table: str, key: str, html: str) -> str:
    """Html with every core put into T(...): texts and markup taken apart and rejoined."""
    return f"""
segmented as ({S.segments(table, key, html)}),
markups as (
  select {key}, unnest(list_transform(regexp_extract_all({html}, '{S.MARKUP}'),
         lambda x, i: {{'markup': x, 'place': i}})) as piece from {table}),
texts as (
  select {key}, unnest(list_transform(string_split(regexp_replace({html}, '{S.MARKUP}', chr(1), 'g'), chr(1)),
         lambda x, i: {{'raw': x, 'place': i}})) as piece from {table}),
rewritten as (
  select t.{key}, string_agg(concat(
           case when s.seq is null then t.piece.raw
                else concat(s.prefix, {S.escape("concat('T(', s.core, ')')")}, s.suffix) end,
           m.piece.markup), '' order by t.piece.place) as html
  from texts t
  left join segmented s on s.{key} = t.{key} and s.place = t.piece.place
  left join markups m on m.{key} = t.{key} and m.piece.place = t.piece.place
  group by t.{key})"""


@query(
    "html_translate",
    "select page_id, html from rewritten",
    rewritten_sql("pages", "page_id", "html"),
)
def html_translate(spark, sf_dir):
    done = translate_html(pages(spark, sf_dir), "page_id", "html", GlossaryBackend(), OPTIONS)
    return done.select("page_id", F.col("new_html").alias("html"))


@query(
    "article_translate",
    """
select e.id, concat('T(', e.title, ')') as title, r.html as content
from entries e join rewritten r using (id)""",
    rewritten_sql("entries", "id", "content"),
)
def article_translate(spark, sf_dir):
    rows = load(spark, sf_dir, "entries").select("id", "title", "content")
    done = translate_title_and_html(rows, "id", "title", "content", GlossaryBackend(), OPTIONS)
    return done.select("id", F.col("new_title").alias("title"), F.col("new_html").alias("content"))


READABLE = f"""
readable as (
  select page_id, string_agg({S.strip('text')}, chr(10) order by place) as text
  from ({S.runs('pages', 'page_id', 'html')}) group by page_id)"""


@query(
    "html_excerpt",
    f"""
select page_id, {S.excerpt('text', 4000)} as excerpt, {S.excerpt('text', 280)} as short_excerpt
from readable""",
    READABLE,
)
def html_excerpt(spark, sf_dir):
    rows = with_runs(pages(spark, sf_dir), "html")
    cut = with_excerpt(with_excerpt(rows, "excerpt", 4000), "short_excerpt", 280)
    return cut.select("page_id", "excerpt", "short_excerpt")


@query(
    "text_preview",
    f"select doc_id, {S.preview('text', 160)} as preview from documents",
)
def text_preview(spark, sf_dir):
    return load(spark, sf_dir, "documents").select(
        "doc_id", preview(F.col("text"), 160).alias("preview")
    )


@query(
    "html_preview",
    f"select page_id, {S.preview('cut', 280)} as preview "
    f"from (select page_id, {S.excerpt('text', 280)} as cut from readable)",
    READABLE,
)
def html_preview(spark, sf_dir):
    return with_html_preview(pages(spark, sf_dir), "preview", "html", 280).select("page_id", "preview")


@query("markup_escape", f"select doc_id, {ESCAPED} as escaped from documents")
def markup_escape(spark, sf_dir):
    return load(spark, sf_dir, "documents").select(
        "doc_id", escape_markup(F.col("text")).alias("escaped")
    )
