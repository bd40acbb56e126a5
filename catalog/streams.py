"""The loop: articles arriving in batches, runs over a store."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.selection import OPTIONS, bigint
from catalog.sql import CANDIDATES
from catalog.texts import rewritten_sql
from catalog.views import RUN_TS, feed_tables, load
from feedloom.functions.shipping import ship_by_value
from feedloom.operators.inference import GlossaryBackend
from feedloom.sources.staging import checkpoint_root
from feedloom.sources.store import TableStore, run_on_store
from feedloom.sources.tables import Tables, empty
from feedloom.streaming.loop import start

ship_by_value(__name__)


def scratch(spark) -> str:
    return f"{checkpoint_root(spark)}/feedloom/{uuid.uuid4().hex}"

def all_arrivals(spark, sf_dir):
    """All articles and subscriptions, in three parts."""
    entries = load(spark, sf_dir, "entries").withColumn("arrived_at", F.lit(RUN_TS))
    subscriptions = load(spark, sf_dir, "user_entries")
    arrivals = entries.unionByName(subscriptions, allowMissingColumns=True)
    return arrivals.withColumn("part", F.coalesce("id", "ref_id") % 3)

def replay(spark, sf_dir, options=OPTIONS, arrivals=None, parts=3, backend=None) -> TableStore:
    """What arrives in some parts at an empty store, each worked off before the next."""
    arrivals = all_arrivals(spark, sf_dir) if arrivals is None else arrivals
    root = scratch(spark)
    nothing = {name: empty(spark, name) for name in ("entries", "user_entries", "tags", "translations")}
    tables = Tables(**nothing, feeds=load(spark, sf_dir, "feeds"))
    store = TableStore.create(spark, f"{root}/store", tables)
    for batch in range(parts):
        part = arrivals.where(F.col("part") == batch).drop("part")
        part.write.mode("append").parquet(f"{root}/arrivals")
        stream = start(
            store,
            f"{root}/arrivals",
            f"{root}/stream",
            lambda _: options,
            backend or GlossaryBackend(),
        )
        stream.awaitTermination()
    return store

ALL_TRANSLATED = (
    """
select e.id, case when r.entry_id is null then e.title else concat('T(', e.title, ')') end as title,
       coalesce(r.html, e.content) as content
from entries e left join rewritten r on r.entry_id = e.id""",
    f"""{CANDIDATES},
queue as (select * from candidates where owner_count = 1),
{rewritten_sql('queue', 'entry_id', 'content').strip()}""",
)


@query("stream_replay", *ALL_TRANSLATED)
def stream_replay(spark, sf_dir):
    return replay(spark, sf_dir).read("entries").select("id", "title", "content")


# A quota below what arrives: the backlog is worked off all the same.
@query("stream_quota_backlog", *ALL_TRANSLATED)
def stream_quota_backlog(spark, sf_dir):
    few = replace(OPTIONS, quota=150)
    return replay(spark, sf_dir, few).read("entries").select("id", "title", "content")

# The newest articles fail, more of them than a quota takes: they move behind the others.
REJECTED_HOURS = 12


def head_rejecting_backend(texts):
    for text in texts:
        words = text.split()
        if words[0] == "Title" and int(words[1]) % 97 < REJECTED_HOURS:
            raise ValueError("rejected title")
    return [f"T({text})" for text in texts]


@query(
    "stream_failing_head",
    f"""
select e.id, case when r.entry_id is null or rejected then e.title else concat('T(', e.title, ')') end as title,
       case when rejected then e.content else coalesce(r.html, e.content) end as content
from (select *, title like 'Title %' and id % 97 < {REJECTED_HOURS} as rejected from entries) e
left join rewritten r on r.entry_id = e.id""",
    ALL_TRANSLATED[1],
)
def stream_failing_head(spark, sf_dir):
    few = replace(OPTIONS, quota=50)
    arrivals = all_arrivals(spark, sf_dir).withColumn("part", F.lit(0))
    store = replay(spark, sf_dir, few, arrivals, parts=1, backend=head_rejecting_backend)
    return store.read("entries").select("id", "title", "content")


# What is left in the ledger: the articles that were never translated, tried more than once.
@query(
    "stream_attempts",
    f"""
select entry_id, owner_uid::bigint as owner_uid, true as again from queue
where title like 'Title %' and entry_id % 97 < {REJECTED_HOURS}""",
    ALL_TRANSLATED[1],
)
def stream_attempts(spark, sf_dir):
    arrivals = all_arrivals(spark, sf_dir).withColumn("part", F.lit(0))
    few = replace(OPTIONS, quota=150)
    store = replay(spark, sf_dir, few, arrivals, parts=1, backend=head_rejecting_backend)
    return store.read("attempts").select(
        "entry_id", bigint("owner_uid"), (F.col("attempts") > 1).alias("again")
    )


# Half of the articles arrive with an older version before the newest one, half with it after.
@query("stream_out_of_order", *ALL_TRANSLATED)
def stream_out_of_order(spark, sf_dir):
    arrivals = all_arrivals(spark, sf_dir)
    article = F.col("id").isNotNull()
    newest = arrivals.withColumn("part", F.when(article, F.col("id") % 2).otherwise(0).cast("bigint"))
    older = arrivals.where(article).withColumns(
        {
            "title": F.concat(F.lit("Old "), "title"),
            "content": F.lit("<p>old</p>"),
            "arrived_at": F.col("arrived_at") - F.expr("interval 1 hour"),
            "part": 1 - F.col("id") % 2,
        }
    )
    store = replay(spark, sf_dir, arrivals=newest.unionByName(older), parts=2)
    return store.read("entries").select("id", "title", "content")


@query(
    "store_run_tracking",
    """
select entry_id, user_entry_id, feed_id::bigint as feed_id, translated_title from (
  select entry_id, user_entry_id, feed_id, translated_title from translations
  where entry_id not in (select entry_id from queue)
  union all
  select entry_id, user_entry_id, feed_id,
         concat('T(', case when t_title = title and t_content = content then t_source_title else title end, ')')
  from queue)""",
    f"""{CANDIDATES},
queue as (
  select * from candidates where owner_count = 1 and (not tracked
    or not (t_language = 'zh-CN' and ((title = t_title and content = t_content)
      or sha256(encode(title) || '\\x00'::blob || encode(content)) = t_hash))))""",
)
def store_run_tracking(spark, sf_dir):
    store = TableStore.create(spark, f"{scratch(spark)}/store", feed_tables(spark, sf_dir))
    for _ in range(2):  # the second run finds nothing left to translate
        run_on_store(store, OPTIONS, GlossaryBackend())
    return store.read("translations").select(
        "entry_id", "user_entry_id", bigint("feed_id"), "translated_title"
    )
