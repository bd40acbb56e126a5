"""Feed tables derived from the test tables, in SQL that Spark and DuckDB share.

``documents`` plays the articles: its text, escaped and cut into paragraphs, is
the upstream content, a marked copy of it the saved translation. Which state an
article is in follows from its id. The few expressions the two engines spell
differently are the ``{...}`` fields.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.sources.tables import Tables

RUN_TS = datetime(2026, 3, 28)

ESCAPED = "replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"

VIEWS = {
    "src": f"""
select doc_id as id,
       concat('Title ', cast(doc_id as varchar(20)), ' ', substr(text, 1, 20)) as st,
       concat('<p>', replace({ESCAPED}, chr(10), concat('</p>', chr(10), '<p>')), '</p>') as sc,
       concat('T:', substr(text, 1, 20)) as tt,
       concat('<p>T:', {ESCAPED}, '</p>') as tc,
       lang, text,
       timestamp '2026-03-28 00:00:00' - interval '1' hour * (doc_id % 97) as date_entered
from documents""",
    "entries": """
select id,
       case when id % 8 in (1, 3) then tt else st end as title,
       case when id % 8 in (1, 3) then tc else sc end as content,
       case when id % 9 = 0 then null
            else concat('https://example.com/a/', cast(id as varchar(20))) end as link,
       case when id % 13 = 0 then null else lang end as lang,
       date_entered
from src""",
    "user_entries": """
select id * 10 as int_id, id as ref_id, 1 as owner_uid, cast(60 + id % 7 as int) as feed_id,
       case when id % 4 = 0 then null
            else concat(lang, ', src', cast(id % 3 as varchar(3)), ',, ', upper(lang), ' ;#Ai')
            end as tag_cache
from src
union all
select id * 10 + 1, id, 2, cast(60 + id % 7 as int), null from src where id % 5 = 0
union all
select id * 10 + 2, id, 1, cast(60 + (id + 1) % 7 as int), 'dup' from src where id % 11 = 0""",
    "feeds": """
select distinct cast(60 + doc_id % 7 as int) as id, 1 as owner_uid,
       concat('Feed ', cast(60 + doc_id % 7 as varchar(8))) as title
from documents where doc_id % 7 < 5""",
    "tags": """
select id * 100 + 1 as id, upper(lang) as tag_name, 1 as owner_uid, id * 10 as post_int_id
from src where id % 3 = 0
union all
select id * 100 + 2, concat(' topic', cast(id % 10 as varchar(3)), ' '), 1, id * 10
from src where id % 6 = 0
union all
select id * 100 + 3, lang, 2, id * 10 + 1 from src where id % 10 = 0""",
    "tracked": """
select id as entry_id, 1 as owner_uid, id * 10 as user_entry_id, cast(60 + id % 7 as int) as feed_id,
       lang as source_lang,
       case when id % 8 = 3 then 'ja' else 'zh-CN' end as target_language,
       case when id % 8 = 4 then concat(st, ' old') else st end as source_title,
       sc as source_content, tt as translated_title, tc as translated_content,
       case when id % 16 < 8 then {no_tags} else split(concat(lang, ',Saved'), ',') end as generated_tags,
       date_entered as translated_at,
       case when id % 32 = 2 then date_entered end as reapplied_at,
       date_entered as updated_at,
       case when id % 24 = 1 then 'earlier failure' end as last_error
from src where id % 8 in (1, 2, 3, 4)""",
    "fulltext": """
select link as url,
       case when id % 3 = 0 then concat('<div>', sc, '<p>more ', cast(id as varchar(20)), '</p></div>')
            when id % 3 = 1 then '  ' end as content,
       case when id % 6 = 5 then 'timeout' end as error
from (select id, sc, concat('https://example.com/a/', cast(id as varchar(20))) as link from src) linked
where id % 4 <> 0""",
    "glossary": """
select text as core, concat('G:', substr(text, 1, 10)) as target
from (select distinct tt as text from src where id % 2 = 0
      union select distinct st from src where id % 6 = 1) known""",
}

ENGINE_FIELDS = {
    "spark": {"no_tags": "cast(array() as array<string>)"},
    "duckdb": {"no_tags": "cast([] as varchar[])"},
}

# The stored hash is the one column no common spelling exists for.
DUCKDB_HASH = "sha256(encode({t}) || '\\x00'::blob || encode({c}))"


def duckdb_hash(title: str, content: str) -> str:
    return DUCKDB_HASH.format(t=title, c=content)


def with_views(select: str, ctes: str = "") -> str:
    """DuckDB SQL over the feed tables, with their definitions in front.

    ``translations`` is ``tracked`` with its hash.
    """
    views = {name: body.format(**ENGINE_FIELDS["duckdb"]) for name, body in VIEWS.items()}
    views["translations"] = (
        f"select *, {duckdb_hash('source_title', 'source_content')} as source_hash from tracked"
    )
    parts = [f"{name} as ({body})" for name, body in views.items()]
    if ctes:
        parts.append(ctes.strip())
    return "with recursive " + ",\n".join(parts) + "\n" + select.strip()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table or a view over one, as a DataFrame."""
    from feedloom.functions.text import source_hash

    if name == "translations":
        tracked = load(spark, sf_dir, "tracked")
        hashed = source_hash(F.col("source_title"), F.col("source_content"))
        return tracked.withColumn("source_hash", hashed)
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    body = VIEWS[name].format(**ENGINE_FIELDS["spark"])
    source = VIEWS["src"].replace("from documents", "from {documents}")
    body = body.replace("from documents", "from {documents}")
    if name == "src":
        return spark.sql(body, documents=documents)
    return spark.sql(f"with src as ({source}) {body}", documents=documents)


def feed_tables(spark: SparkSession, sf_dir: str) -> Tables:
    return Tables(
        **{
            name: load(spark, sf_dir, name)
            for name in ("entries", "user_entries", "feeds", "tags", "translations")
        }
    )
