import json
import random
import time
from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from feedloom import EnrichOptions
from feedloom.functions.shipping import ship_by_value
from feedloom.operators import candidates
from feedloom.operators.candidates import select_candidates, within_quota
from feedloom.operators.inference import GlossaryBackend, ReplyFormatError
from feedloom.operators.planning import plan_entries
from feedloom.operators.replies import with_string_array, with_tag_results
from feedloom.operators.tagging import generate_tags
from feedloom.plans import run
from feedloom.plans.run import enrich
from feedloom.sources import schemas
from feedloom.operators.inference import translate_texts
from feedloom.operators.merge import enforce_references
from feedloom.sources import index
from feedloom.sources.index import bucket_name, newest_rows
from feedloom.sources.store import TableStore, clean_references, run_on_store, settle_days
from feedloom.sources.tables import Tables, empty, migrate_translations, read_or_create
from feedloom.streaming import loop
from feedloom.streaming.loop import ARRIVALS, start, take_in, work_off

ship_by_value(__name__)

NOW = datetime(2026, 3, 28)
OPTIONS = EnrichOptions(run_ts=NOW, feed_ids=(7,), quota=None)


def make_tables(spark, articles, tracked=(), tags=()):
    """Articles as (id, title, content, tag_cache), tracking rows as
    (id, target, source_title, source_content, title, content, tags)."""
    entries = [
        (i, t, c, None, "en", NOW - timedelta(hours=i)) for i, t, c, _ in articles
    ]
    subscriptions = [(i * 10, i, 1, 7, cache) for i, _, _, cache in articles]
    tracking = [
        (i, 1, i * 10, 7, "en", target, "", st, sc, tt, tc, list(tg), NOW, None, NOW, None)
        for i, target, st, sc, tt, tc, tg in tracked
    ]
    translations = spark.createDataFrame(tracking, schemas.TRANSLATIONS)
    from feedloom.functions.text import source_hash

    hashed = source_hash(F.col("source_title"), F.col("source_content"))
    return Tables(
        entries=spark.createDataFrame(entries, schemas.ENTRIES),
        user_entries=spark.createDataFrame(subscriptions, schemas.USER_ENTRIES),
        feeds=spark.createDataFrame([(7, 1, "Feed")], schemas.FEEDS),
        tags=spark.createDataFrame(list(tags), schemas.TAGS),
        translations=translations.withColumn("source_hash", hashed),
    )


TRACKED = (1, "zh-CN", "Ferry", "<p>Late again</p>", "渡轮", "<p>又晚点</p>", ())


@pytest.mark.parametrize(
    ("title", "content", "target", "expected"),
    [
        ("渡轮", "<p>又晚点</p>", "zh-CN", ("skip", "already-translated", "Ferry")),
        ("Ferry", "<p>Late again</p>", "zh-CN", ("reapply", "same-source-hash-found-in-db", "Ferry")),
        (
            "渡轮",
            "<p>又晚点</p>",
            "ja",
            ("translate", "target-language-changed-reuse-stored-source", "Ferry"),
        ),
        ("New", "<p>x</p>", "zh-CN", ("translate", "source-changed-or-manually-edited", "New")),
    ],
)
def test_plan(spark, title, content, target, expected):
    options = replace(OPTIONS, target_language=target, tag_language=None)
    tables = make_tables(spark, [(1, title, content, None)], [TRACKED])
    row = plan_entries(select_candidates(tables, options), options).first()
    assert (row.action, row.reason, row.source_title) == expected


def test_quota_takes_in_what_lies_before(spark):
    tables = make_tables(
        spark,
        [(1, "渡轮", "<p>又晚点</p>", None)] + [(i, "t", "c", None) for i in range(2, 7)],
        [TRACKED],
    )
    planned = plan_entries(select_candidates(tables, OPTIONS), OPTIONS)
    assert {r.entry_id for r in within_quota(planned, 2).collect()} == {1, 2, 3}
    assert within_quota(planned, 99).count() == 6


def test_string_array_replies(spark):
    replies = ['```json\n["a"]\n```', '{"translations": ["b"]}', '["a", null]', "[1]", "nope", "[]"]
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, reply string")
    got = with_string_array(rows, "reply").orderBy("i").collect()
    assert [r["items"] for r in got] == [["a"], ["b"], None, None, None, []]
    assert [r.reply_error for r in got] == [
        None, None, "not-a-string-array", "not-a-string-array", "malformed-json", None,
    ]


def test_tag_replies(spark):
    results = '{"results": [{"request_id": "b", "tags": ["Tides", "Lighthouses"]}, {"request_id": "a", "tags": ["Rope"]}]}'
    matrix = '{"tags": [["Rope"], ["Tides", "Lighthouses"]]}'
    rows = spark.createDataFrame(
        [(0, results, ["a", "b"]), (1, matrix, ["a", "b"]), (2, results, None), (3, matrix, ["a"])],
        "i int, reply string, ids array<string>",
    )
    got = with_tag_results(rows, "reply", "ids").orderBy("i").collect()
    both = [["Rope"], ["Tides", "Lighthouses"]]
    assert [r.results for r in got] == [both, both, both, None]
    assert got[3].reply_error == "count-mismatch"


def test_a_chunk_of_wrong_format_is_halved(spark, tmp_path):
    log = str(tmp_path / "calls")
    requests = spark.createDataFrame(
        [(i, NOW - timedelta(hours=i), True, f"t{i}", "text", []) for i in (1, 2)],
        "entry_id long, date_entered timestamp, batched boolean, title string, excerpt string, "
        "existing_tags array<string>",
    )

    def backend(asked):
        with open(log, "a") as out:
            out.write(json.dumps([r["request_id"] for r in asked]) + "\n")
        if len(asked) > 1:
            raise ReplyFormatError("incomplete")
        return [[r["title"], "Rope"] for r in asked]

    order = [F.col("date_entered").desc(), F.col("entry_id").desc()]
    done = generate_tags(requests, order, backend, replace(OPTIONS, tagging=True))
    assert {r.entry_id: r.generated for r in done.collect()} == {1: ["t1", "Rope"], 2: ["t2", "Rope"]}
    with open(log) as calls:
        assert sorted(map(json.loads, calls)) == [["0"], ["0", "1"], ["1"]]


def test_failures_stay_with_their_article(spark):
    tables = make_tables(
        spark,
        [(1, "bad now", "<p>x</p>", None), (2, "good", "<p>y</p>", None), (3, "bad", "z", None)],
        [TRACKED],
    )

    def backend(texts):
        if any("bad" in text for text in texts):
            raise ValueError("e" * 6000)
        return [text.upper() for text in texts]

    result = enrich(tables, OPTIONS, backend)
    assert result.stats.first().asDict() == {
        "translated": 1, "reapplied": 0, "skipped": 0, "failed": 2, "tagged": 0,
    }
    titles = {r.id: r.title for r in result.tables.entries.collect()}
    assert titles == {1: "bad now", 2: "GOOD", 3: "bad"}
    tracking = {r.entry_id: r for r in result.tables.translations.collect()}
    assert set(tracking) == {1, 2}
    assert tracking[1].last_error == "e" * 5000 and tracking[1].translated_title == "渡轮"
    assert {r.entry_id for r in result.errors.collect()} == {1, 3}


def test_a_tag_failure_leaves_the_translation(spark):
    tables = make_tables(spark, [(1, "t", "<p>x</p>", None)])

    def tagger(requests):
        raise ValueError("no tags today")

    result = enrich(tables, replace(OPTIONS, tagging=True), GlossaryBackend(), tagger)
    row = result.tables.translations.first()
    assert (row.translated_title, row.generated_tags) == ("T(t)", [])
    assert [(r.stage, r.message) for r in result.errors.collect()] == [("tags", "no tags today")]
    assert result.stats.first().failed == 0


def test_a_replay_brings_back_stored_tags(spark):
    stored = (*TRACKED[:6], ["Saved", "ai"])
    tables = make_tables(
        spark, [(1, "Ferry", "<p>Late again</p>", "old")], [stored], [(5, " AI ", 1, 10)]
    )
    result = enrich(tables, OPTIONS, GlossaryBackend())
    after = result.tables
    assert after.entries.first().title == "渡轮"
    assert [(r.id, r.tag_name) for r in after.tags.orderBy("id").collect()] == [(5, " AI "), (6, "Saved")]
    # the cache is rebuilt from the tags table, so a tag only it had is gone
    assert after.user_entries.first().tag_cache == "AI,Saved"
    tracking = after.translations.first()
    assert tracking.reapplied_at == NOW and tracking.generated_tags == ["Saved", "ai"]


def test_a_dry_run_changes_nothing(spark):
    tables = make_tables(spark, [(1, "t", "<p>x</p>", "a"), (2, "u", "", None)])
    result = enrich(tables, replace(OPTIONS, dry_run=True), GlossaryBackend())
    assert result.tables is tables
    previews = {r.entry_id: r for r in result.previews.collect()}
    assert previews[1].translated_title == "T(t)" and previews[1].generated_tags == "<none>"
    assert previews[2].source_content == "<empty>"
    assert result.stats.first().translated == 2


def test_fulltext_is_used_when_there_is_some(spark):
    tables = make_tables(spark, [(i, f"t{i}", f"<p>feed {i}</p>", None) for i in (1, 2, 3)])
    link = F.concat(F.lit(" http://a/"), "id")
    tables = replace(tables, entries=tables.entries.withColumn("link", link))
    fulltext = spark.createDataFrame(
        [("http://a/1", "<p>full</p>", None), ("http://a/2", None, "timeout"), ("http://a/3", " ", None)],
        schemas.FULLTEXT,
    )
    result = enrich(tables, OPTIONS, GlossaryBackend(), fulltext=fulltext)
    contents = {r.id: r.content for r in result.tables.entries.collect()}
    assert contents == {1: "<p>T(full)</p>", 2: "<p>T(feed 2)</p>", 3: "<p>T(feed 3)</p>"}


def test_migration_takes_the_smallest_subscription(spark):
    tables = make_tables(spark, [(1, "a", "b", None)], [TRACKED])
    more = spark.createDataFrame([(4, 1, 1, 7, None), (2, 1, 2, 7, None)], schemas.USER_ENTRIES)
    older = tables.translations.drop("generated_tags", "user_entry_id")
    row = migrate_translations(older, tables.user_entries.unionByName(more)).first()
    assert (row.user_entry_id, row.generated_tags) == (4, [])


def test_missing_table_is_created_empty(spark, tmp_path):
    created = read_or_create(spark, "translations", str(tmp_path / "none"))
    assert created.count() == 0 and "generated_tags" in created.columns


def test_store_switches_all_tables_in_one_commit(spark, tmp_path):
    tables = make_tables(spark, [(1, "a", "<p>b</p>", "x"), (60, "old", "<p>c</p>", None)])
    store = TableStore.create(spark, str(tmp_path / "store"), tables)
    assert store.last_commit().version == 0
    run_on_store(store, OPTIONS, GlossaryBackend())
    titles = {r.id: r.title for r in store.read("entries").collect()}
    assert titles == {1: "T(a)", 60: "old"}  # beyond the lookback, in another day
    old_day = [p for p in store.last_commit().parts if p.name == "entries" and p.version == 0]
    assert len(old_day) == 1
    # rows written by a run that did not come to its commit are not seen
    store._write("entries", store.read("entries").where("id = 1"), 99)
    assert store.read("entries").count() == 2
    again = run_on_store(store, OPTIONS, GlossaryBackend())
    assert again.stats.first().translated == 0


def test_stream_and_repeated_batch(spark, tmp_path):
    nothing = {n: empty(spark, n) for n in ("entries", "user_entries", "tags", "translations", "feeds")}
    store = TableStore.create(spark, str(tmp_path / "store"), Tables(**nothing))
    versions = [
        (1, "first", "<p>a</p>", None, "en", NOW, NOW, 10, None, 1, 7, "x"),
        (1, "second", "<p>b</p>", None, "en", NOW, NOW + timedelta(hours=1), 10, 1, 1, 7, "x"),
    ]
    arrivals = spark.createDataFrame(versions, ARRIVALS)
    arrivals.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = start(
        store, str(tmp_path / "in"), str(tmp_path / "cp"), lambda _: OPTIONS, GlossaryBackend()
    )
    stream.awaitTermination()
    assert [r.title for r in store.read("entries").collect()] == ["T(second)"]
    before = store.last_commit().version
    assert take_in(store, arrivals, 0, OPTIONS, GlossaryBackend()) is False
    assert store.last_commit().version == before


def test_cleaning_drops_rows_of_gone_articles(spark, tmp_path):
    gone = (2, *TRACKED[1:])
    tables = make_tables(spark, [(1, "a", "<p>b</p>", None)], [TRACKED, gone])
    store = TableStore.create(spark, str(tmp_path / "store"), tables)
    assert store.read("translations").count() == 2
    clean_references(store)
    kept = store.read("translations").collect()
    assert [(r.entry_id, r.feed_id) for r in kept] == [(1, 7)]
    assert store.read("entries").count() == 1


def test_equal_texts_fail_alone(spark):
    texts = spark.createDataFrame(
        [(1, 0, "Read more"), (1, 1, "bad"), (2, 0, "Read more"), (2, 1, "fine")],
        "entry_id long, seq int, text string",
    )

    def backend(chunk):
        if "bad" in chunk:
            raise ValueError("refused")
        return [text.upper() for text in chunk]

    order = [F.col("entry_id"), F.col("seq")]
    done = translate_texts(texts, order, backend, replace(OPTIONS, distinct_texts=True))
    got = {(r.entry_id, r.seq): (r.translated, r.error) for r in done.collect()}
    assert got == {
        (1, 0): ("READ MORE", None),
        (1, 1): (None, "refused"),
        (2, 0): ("READ MORE", None),
        (2, 1): ("FINE", None),
    }


@pytest.mark.parametrize("answer", [[None], [7], "abc".encode(), {"a": "b"}, 5, None])
def test_what_is_not_a_list_of_texts_is_an_error(spark, answer):
    texts = spark.createDataFrame([(1, 0, "a")], "entry_id long, seq int, text string")
    order = [F.col("entry_id"), F.col("seq")]
    row = translate_texts(texts, order, lambda chunk: answer, OPTIONS).first()
    assert row.translated is None and row.error


def test_a_row_without_subscription_stays(spark):
    tracking = spark.createDataFrame(
        [(1, 9, None, 60), (2, 9, 500, 60), (3, 9, 501, None), (4, 8, None, 60), (7, 9, None, 60)],
        "entry_id long, owner_uid int, user_entry_id int, feed_id int",
    )
    entries = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "id long")
    subscriptions = spark.createDataFrame([(501, 9), (502, 9)], "int_id int, owner_uid int")
    feeds = spark.createDataFrame([(60,)], "id int")
    kept = enforce_references(tracking, entries, subscriptions, feeds)
    assert {(r.entry_id, r.feed_id) for r in kept.collect()} == {(1, 60), (3, None)}


def test_a_quota_is_worked_off_without_arrivals(spark, tmp_path):
    nothing = {n: empty(spark, n) for n in ("entries", "user_entries", "tags", "translations", "feeds")}
    store = TableStore.create(spark, str(tmp_path / "store"), Tables(**nothing))
    articles = [(i, "t", f"<p>{i}</p>", None, "en", NOW, NOW, i, i, 1, 7, None) for i in range(1, 6)]
    spark.createDataFrame(articles, ARRIVALS).write.parquet(str(tmp_path / "in"))
    few = replace(OPTIONS, quota=2)
    start(
        store, str(tmp_path / "in"), str(tmp_path / "cp"), lambda _: few, GlossaryBackend()
    ).awaitTermination()
    assert {r.title for r in store.read("entries").collect()} == {"T(t)"}
    with pytest.raises(ValueError):
        take_in(store, store.read("entries"), 9, replace(few, dry_run=True), GlossaryBackend())


def test_a_clock_gives_passes_without_arrivals(spark, tmp_path):
    nothing = {n: empty(spark, n) for n in ("entries", "user_entries", "tags", "translations", "feeds")}
    store = TableStore.create(spark, str(tmp_path / "store"), Tables(**nothing))
    articles = [(i, "t", f"<p>{i}</p>", None, "en", NOW, NOW, i, i, 1, 7, None) for i in range(1, 4)]
    spark.createDataFrame(articles, ARRIVALS).coalesce(1).write.parquet(str(tmp_path / "in"))
    few = replace(OPTIONS, quota=2)
    stream = start(
        store, str(tmp_path / "in"), str(tmp_path / "cp"), lambda _: few, GlossaryBackend(), every="1 seconds"
    )
    for _ in range(90):
        if {r.title for r in store.read("entries").collect()} == {"T(t)"}:
            break
        time.sleep(1)
    stream.stop()
    assert {r.title for r in store.read("entries").collect()} == {"T(t)"}


def test_errors_of_a_dead_run_do_not_count(spark, tmp_path):
    store = TableStore.create(spark, str(tmp_path / "store"), make_tables(spark, [(1, "a", "b", None)]))
    dead = spark.createDataFrame([], schemas.ERRORS)
    row = [tuple(None for _ in dead.columns)]
    spark.createDataFrame(row, dead.schema).write.parquet(str(tmp_path / "store" / "errors" / "version=1"))
    assert clean_references(store) == 1
    assert store.errors().count() == 0


def test_a_known_article_keeps_its_day(spark, tmp_path):
    tables = make_tables(spark, [(1, "a", "<p>b</p>", None)])
    store = TableStore.create(spark, str(tmp_path / "store"), tables)
    moved = spark.createDataFrame(
        [(1, "c", "<p>d</p>", None, "en", NOW - timedelta(days=9))], schemas.ENTRIES
    )
    run_on_store(store, OPTIONS, GlossaryBackend(), arrived=moved)
    assert [(r.title, r.day) for r in store.read("entries").collect()] == [("T(c)", "2026-03-27")]


def arriving(spark, path, rows, at=NOW):
    """Articles 'name id' with one subscription each, written as a file of arrivals."""
    made = [(i, name, f"<p>{i}</p>", None, "en", NOW - timedelta(minutes=i), at, i, i, 1, 7, None) for i, name in rows]
    spark.createDataFrame(made, ARRIVALS).coalesce(1).write.mode("append").parquet(path)


def empty_store(spark, path, buckets=4):
    nothing = {n: empty(spark, n) for n in ("entries", "user_entries", "tags", "translations", "feeds")}
    return TableStore.create(spark, path, Tables(**nothing), buckets)


def rejecting(texts):
    if any("bad" in text for text in texts):
        raise ValueError("no")
    return [f"T({text})" for text in texts]


def test_failing_articles_move_behind_the_others(spark, tmp_path):
    store = empty_store(spark, str(tmp_path / "store"))
    arriving(spark, str(tmp_path / "in"), [(1, "bad"), (2, "bad"), (3, "c"), (4, "d"), (5, "e")])
    few = replace(OPTIONS, quota=2)
    start(
        store, str(tmp_path / "in"), str(tmp_path / "cp"), lambda _: few, rejecting
    ).awaitTermination()
    titles = {r.id: r.title for r in store.read("entries").collect()}
    assert titles == {1: "bad", 2: "bad", 3: "T(c)", 4: "T(d)", 5: "T(e)"}
    assert {(r.entry_id, r.owner_uid) for r in store.read("attempts").collect()} == {(1, 1), (2, 1)}
    # what is accepted later leaves the ledger
    run_on_store(store, few, GlossaryBackend())
    assert store.read("attempts").count() == 0
    assert store.read("entries").where("title = 'T(bad)'").count() == 2


def test_passes_over_a_backlog_grow_with_its_logarithm(spark, tmp_path, monkeypatch):
    passes = []

    def counted(*args, **named):
        passes.append(args[1].quota)
        return run_on_store(*args, **named)

    monkeypatch.setattr(loop, "run_on_store", counted)
    store = empty_store(spark, str(tmp_path / "store"))
    arriving(spark, str(tmp_path / "in"), [(i, "bad" if i < 4 else "t") for i in range(1, 6)])
    few = replace(OPTIONS, quota=1)
    start(store, str(tmp_path / "in"), str(tmp_path / "cp"), lambda _: few, rejecting).awaitTermination()
    assert passes == [1, 1, 2, 4, 8]
    assert store.read("entries").where("title = 'T(t)'").count() == 2
    # more articles fail than a quota takes, and all of them were tried again
    attempts = {r.entry_id: r.attempts for r in store.read("attempts").collect()}
    assert set(attempts) == {1, 2, 3} and min(attempts.values()) > 1


def test_a_backlog_is_planned_once_and_ends_when_its_quota_is_not_used_up(spark, tmp_path, monkeypatch):
    passes, plans = [], []

    def counted(*args, **named):
        passes.append(args[1].quota)
        return run_on_store(*args, **named)

    def planned(*args):
        plans.append(args)
        return select_candidates(*args)

    monkeypatch.setattr(loop, "run_on_store", counted)
    monkeypatch.setattr(run, "select_candidates", planned)
    store = empty_store(spark, str(tmp_path / "store"))
    arriving(spark, str(tmp_path / "in"), [(i, "t") for i in range(1, 6)])
    few = replace(OPTIONS, quota=1)
    start(
        store, str(tmp_path / "in"), str(tmp_path / "cp"), lambda _: few, GlossaryBackend()
    ).awaitTermination()
    titles = {r.id: r.title for r in store.read("entries").collect()}
    assert titles == {i: "T(t)" for i in range(1, 6)}
    assert store.read("translations").count() == 5
    assert passes == [1, 1, 2, 4]  # the last one had one article
    assert len(plans) == 2  # for what arrived, and for the backlog


def test_a_backlog_replays_what_is_stored(spark, tmp_path):
    articles = [(i, f"a{i}", f"<p>{i}</p>", None) for i in range(2, 7)]
    tracked = (*TRACKED[:6], ("ferry",))
    tables = make_tables(spark, [(1, "Ferry", "<p>Late again</p>", None), *articles], [tracked])
    store = TableStore.create(spark, str(tmp_path / "store"), tables)
    work_off(store, 0, replace(OPTIONS, quota=1), GlossaryBackend())
    titles = {r.id: r.title for r in store.read("entries").collect()}
    assert titles == {1: "渡轮"} | {i: f"T(a{i})" for i in range(2, 7)}
    assert [(r.tag_name, r.post_int_id) for r in store.read("tags").collect()] == [("ferry", 10)]
    assert {r.int_id: r.tag_cache for r in store.read("user_entries").collect()}[10] == "ferry"
    assert store.read("translations").where("entry_id = 1 and reapplied_at is not null").count() == 1
    assert run_on_store(store, OPTIONS, GlossaryBackend()).stats.first().skipped == 6


def test_a_run_rewrites_only_what_it_changes(spark, tmp_path):
    articles = [(1, "a", "<p>b</p>", "x"), (30, "渡轮", "<p>又晚点</p>", "y")]
    tables = make_tables(spark, articles, [(30, *TRACKED[1:])], tags=[(5, "x", 1, 10)])
    store = TableStore.create(spark, str(tmp_path / "store"), tables)
    run_on_store(store, OPTIONS, GlossaryBackend())
    parts = {(p.name, p.day): p.version for p in store.last_commit().parts}
    new, old = [(NOW - timedelta(hours=i)).date().isoformat() for i in (1, 30)]
    assert parts["entries", new] == 1 and parts["translations", new] == 1
    # the other day has only an article that shows its translation, and no row brings tags
    assert parts["entries", old] == 0 and parts["translations", old] == 0
    assert parts["tags", new] == 0 and parts["user_entries", new] == 0
    assert {r.title for r in store.read("entries").collect()} == {"T(a)", "渡轮"}


def test_failed_articles_wait(spark, tmp_path):
    store = empty_store(spark, str(tmp_path / "store"))
    arriving(spark, str(tmp_path / "in"), [(1, "bad"), (2, "b")])
    patient = replace(OPTIONS, retry_minutes=10)
    take_in(store, spark.read.schema(ARRIVALS).parquet(str(tmp_path / "in")), 0, patient, rejecting)

    def failed_after(minutes):
        later = replace(patient, run_ts=NOW + timedelta(minutes=minutes))
        return run_on_store(store, later, rejecting).stats.first().failed

    # 10 minutes after the first failure, 20 after the second
    assert [failed_after(m) for m in (5, 11, 29)] == [0, 1, 0]
    assert [r.attempts for r in store.read("attempts").collect()] == [2]


def test_a_backlog_is_worked_off_after_a_crash(spark, tmp_path):
    store = empty_store(spark, str(tmp_path / "store"))
    arriving(spark, str(tmp_path / "in"), [(i, "t") for i in range(1, 6)])
    few = replace(OPTIONS, quota=2)
    arrivals = spark.read.schema(ARRIVALS).parquet(str(tmp_path / "in"))
    assert take_in(store, arrivals, 0, few, GlossaryBackend())  # committed, and the driver dies
    assert store.read("entries").where("title = 'T(t)'").count() == 2
    start(
        store, str(tmp_path / "in"), str(tmp_path / "cp"), lambda _: few, GlossaryBackend()
    ).awaitTermination()
    assert store.read("entries").where("title = 'T(t)'").count() == 5


def test_older_versions_that_arrive_later_are_left_out(spark, tmp_path):
    store = empty_store(spark, str(tmp_path / "store"))
    for batch, (name, minutes) in enumerate([("new", 5), ("old", 1), ("newest", 9)]):
        arriving(spark, str(tmp_path / f"in{batch}"), [(1, name), (2, name)], NOW + timedelta(minutes=minutes))
        arrivals = spark.read.schema(ARRIVALS).parquet(str(tmp_path / f"in{batch}"))
        assert take_in(store, arrivals, batch, OPTIONS, GlossaryBackend())
        titles = {r.title for r in store.read("entries").collect()}
        assert titles == {"T(newest)" if batch > 1 else "T(new)"}


def test_the_index_is_read_by_bucket_and_kept_small(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "CROWDED", 3)
    store = empty_store(spark, str(tmp_path / "store"), buckets=5)
    none = spark.createDataFrame([], schemas.USER_ENTRIES)
    for batch in range(5):
        rows = [(i, "t", "c", None, "en", NOW + timedelta(days=batch), NOW + timedelta(minutes=batch)) for i in (1, 10 + batch)]
        taken = settle_days(store, spark.createDataFrame(rows, f"{schemas.ENTRIES}, arrived_at TIMESTAMP"), none)
        store.commit({"index": taken.index}, taken.rewritten)
    pieces = [p.day for p in store.last_commit().parts if p.name == "index"]
    mine = spark.range(1, 2).select(bucket_name(F.col("id"), 5)).first()[0]
    assert 1 <= pieces.count(mine) <= 3
    of_mine = store.read("index", {mine}.__contains__)
    assert all(f"day={mine}" in name for name in of_mine.inputFiles())
    kept = newest_rows(of_mine).where("id = 1").first()
    assert (kept.arrived_at, kept.entered) == (NOW + timedelta(minutes=4), NOW)
    assert newest_rows(store.read("index")).count() == 6


def test_stores_without_an_index_get_one(spark, tmp_path):
    store = empty_store(spark, str(tmp_path / "store"))
    store.commit({"entries": make_tables(spark, [(1, "a", "<p>b</p>", None)]).entries.withColumn("day", F.lit("2026-03-27"))}, replaced=None)
    moved = spark.createDataFrame([(1, "c", "<p>d</p>", None, "en", NOW - timedelta(days=9))], schemas.ENTRIES)
    run_on_store(store, OPTIONS, GlossaryBackend(), arrived=moved)
    assert [(r.title, r.day) for r in store.read("entries").collect()] == [("c", "2026-03-27")]
    assert newest_rows(store.read("index")).count() == 1


@pytest.mark.parametrize("sorted_rows", [50_000, 3, 1])
def test_the_last_of_a_quota(spark, monkeypatch, sorted_rows):
    monkeypatch.setattr(candidates, "SORTED_ROWS", sorted_rows)
    rng = random.Random(sorted_rows)
    rows = [
        (i * 40_000, NOW - timedelta(seconds=rng.choice([0, 0, 1, 4000, 4001, 9000])) if i % 9 else None, rng.choice(["translate", "skip"]), rng.choice([0, 0, 0, 1, 2]))
        for i in range(60)
    ]
    planned = spark.createDataFrame(rows, "entry_id long, date_entered timestamp, action string, attempts int")

    def place(r):
        return (r[3], r[1] is None, -(r[1].timestamp() if r[1] else 0), -r[0])

    queue = sorted((r for r in rows if r[2] == "translate"), key=place)
    for quota in (2, len(queue), len(queue) + 1):
        found = {r.entry_id for r in within_quota(planned, quota).collect()}
        want = {r[0] for r in rows if quota > len(queue) or place(r) <= place(queue[quota - 1])}
        assert found == want
