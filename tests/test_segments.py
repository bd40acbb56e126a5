import time
import uuid
from dataclasses import replace
from datetime import datetime

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from feedloom import EnrichOptions
from feedloom.functions import markup
from feedloom.functions.markup import glued_runs, text_runs
from feedloom.operators.segments import (
    explode_segments,
    glued_segments,
    rebuilt_html,
    texts_to_translate,
    with_excerpt,
    with_runs,
    with_segments,
)
from feedloom.functions.shipping import ship_by_value
from feedloom.functions.text import strip
from feedloom.operators.inference import COUNT_ERROR, Remembered, translate_texts
from feedloom.plans.convenience import translate_title_and_html

ship_by_value(__name__)

OPTIONS = EnrichOptions(run_ts=datetime(2026, 3, 28), feed_ids=(1,))
SAMPLE = "<li>Harbour <em>lights</em></li><pre>ls -l</pre><td>Nets drying</td>"


def segments(spark, html):
    rows = spark.createDataFrame([(1, html)], "id long, html string")
    found = explode_segments(with_segments(with_runs(rows, "html")), "id").orderBy("seq").collect()
    return [row.core for row in found]


@pytest.mark.parametrize(
    ("html", "cores"),
    [
        (SAMPLE, ["Harbour", "lights", "Nets drying"]),
        ("", []),
        ("  \n ", []),
        ("plain a &amp; b", ["plain a & b"]),
        ("<pre><b>kept</b></pre>", ["kept"]),
        ("<code>no</code><svg>no</svg><MATH>no</MATH><textarea>no</textarea>", []),
        ("<noscript>no</noscript><style>no</style><script>no</script>yes", ["yes"]),
        ("<!DOCTYPE html><!-- no --><p>中文 &#20013; </p><p>Ж</p>", ["Ж"]),
        ("a<br>b<br/>c</x>d", ["a", "b", "c", "d"]),
        ("<pre/>after", ["after"]),
        ("<p>one<p>two", ["one", "two"]),
    ],
)
def test_segments(spark, html, cores):
    assert segments(spark, html) == cores


@pytest.mark.parametrize(
    "html", [SAMPLE, "x &copy; y", "<p", "a & b &am", "<!-- open", "<a href='>'>t</a>", "\r\n<b>z"]
)
def test_runs_make_up_the_html(html):
    assert "".join(run["lead"] + run["markup"] for run in text_runs(html)) == html


def test_identity_keeps_every_byte_of_real_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    parsed = with_segments(with_runs(pages, "html"))
    same = parsed.withColumn(
        "new_cores", F.transform("segments", lambda s: strip(s["text"]))
    )
    assert same.where(rebuilt_html() != F.col("html")).count() == 0


def test_ruby_and_template_text_is_not_readable(spark):
    html = "<ruby>a<rt>b</rt></ruby><template><p>c</p></template><p>d</p>"
    rows = spark.createDataFrame([(html,)], "html string")
    assert with_excerpt(with_runs(rows, "html"), "e", 99).first()["e"] == "a\nd"


def test_excerpt(spark):
    rows = spark.createDataFrame(
        [("<h2>Slow <i>ferries</i></h2><h3>Twice</h3>",)], "html string"
    )
    assert with_excerpt(with_runs(rows, "html"), "e", 13).first()["e"] == "Slow\nferries"


def test_payload_starts_with_the_title_unless_blank(spark):
    rows = spark.createDataFrame(
        [(1, "Quay four", SAMPLE), (2, "   ", "<p>Tide</p>"), (3, " t ", "")],
        "id long, title string, html string",
    )
    parsed = with_segments(with_runs(rows, "html"))
    texts = texts_to_translate(parsed, "id", title="title").orderBy("id", "seq").collect()
    assert [(r.id, r.text) for r in texts] == [
        (1, "Quay four"),
        (1, "Harbour"),
        (1, "lights"),
        (1, "Nets drying"),
        (2, "Tide"),
        (3, " t "),
    ]


def test_translation_goes_back_between_the_tags(spark):
    words = {"Quay four": "四号码头", "Harbour": "港口", "lights": "灯火", "Nets drying": "晾网"}
    rows = spark.createDataFrame(
        [(1, "Quay four", SAMPLE), (2, "   ", "<p>a &copy; b</p>")],
        "id long, title string, html string",
    )

    def backend(texts):
        return [words.get(text, "<" + text + ">") for text in texts]

    done = translate_title_and_html(rows, "id", "title", "html", backend, OPTIONS)
    got = {r.id: (r.new_title, r.new_html, r.error) for r in done.collect()}
    assert got[1] == (
        "四号码头",
        "<li>港口 <em>灯火</em></li><pre>ls -l</pre><td>晾网</td>",
        None,
    )
    assert got[2] == ("   ", "<p>&lt;a © b&gt;</p>", None)


def test_all_texts_go_in_one_call_and_a_wrong_count_is_an_error(spark):
    rows = spark.createDataFrame(
        [(1, "a", "<p>b</p>"), (2, "c", "<p>d</p>")], "id long, title string, html string"
    )

    def counting(texts):
        return [f"{text}:{len(texts)}" for text in texts]

    done = translate_title_and_html(rows, "id", "title", "html", counting, OPTIONS)
    assert sorted((r.new_title, r.new_html) for r in done.collect()) == [
        ("a:4", "<p>b:4</p>"),
        ("c:4", "<p>d:4</p>"),
    ]

    def short(texts):
        return texts[1:]

    failed = translate_title_and_html(rows, "id", "title", "html", short, OPTIONS)
    assert {r.error for r in failed.collect()} == {
        COUNT_ERROR
    }


def test_long_pages_are_read_in_linear_time():
    n = 200_000
    started = time.perf_counter()
    runs = text_runs("<p>a" * n + "<script>x</script>" + "<i>b</i>" * n + "</q>" * n)
    assert time.perf_counter() - started < 60  # minutes if each run or end tag looked through what is open
    assert len(runs) == 2 * n + 2
    assert [r["readable"] for r in runs[n - 1 : n + 2]] == [True, False, True]
    assert {r["parent"] for r in runs[n + 1 : -1]} == {"i"}


def test_nested_unreadable_elements_are_counted():
    html = "<template>a<template>b</template>c<rt>d</template>e</rt>f"
    assert [(r["text"], r["readable"]) for r in text_runs(html)[:-1]] == [
        ("a", False), ("b", False), ("c", False), ("d", False), ("e", True), ("f", True)
    ]


def test_what_was_answered_is_not_asked_again(spark, tmp_path):
    rows = [(i, 0, f"t{i % 7}", i) for i in range(30)]
    texts = spark.createDataFrame(rows, "entry_id long, seq int, text string, place int")
    few = replace(OPTIONS, max_texts=3)
    calls = tmp_path / "calls"
    calls.mkdir()

    def counting(some):
        (calls / uuid.uuid4().hex).write_text(",".join(some))
        if "t5" in some:
            raise ValueError("no")
        return [f"T({t})" for t in some]

    def run(name, backend=counting):
        kept = Remembered(backend, str(tmp_path / "answers"), name)
        found = translate_texts(texts, [F.col("place")], kept, few).collect()
        return {(r.entry_id, r.translated or r.error) for r in found}, len(list(calls.iterdir()))

    want = {(i, "no" if i % 7 == 5 else f"T(t{i % 7})") for i in range(30)}
    first, asked = run("a")
    assert first == want
    again, after = run("a")
    assert again == want
    # only what failed: three chunks of three with t5, then their articles alone, equal ones once
    failing = [c.read_text() for c in calls.iterdir() if "t5" in c.read_text()]
    assert after - asked == len(set(failing))
    assert run("b")[0] == want
    assert run("b")[1] - after > after - asked


def test_pieces_of_html_give_the_runs_of_the_whole():
    parts = ["<p>a &am", "p; b</p><scr", "ipt>if (a<b", ") x</script><!-- <p>", "c</p> --><code>d", "</code>e<", "br>f &lt", " g"]
    whole = [(r["text"], r["parent"]) for r in text_runs("".join(parts))[:-1]]
    assert list(glued_runs(parts)) == whole and len(whole) == 5


def test_documents_of_many_rows(spark):
    rows = [(i, i % 3 if i < 30 else None, None if i == 7 else f"<p>{i} a</p>text {i} <pre>" if i % 5 == 2 else f"go on {i}</pre>&amp") for i in range(33)]
    df = spark.createDataFrame(rows, "id long, part long, html string")
    got = {(r.part, r.seq): (r.prefix, r.core, r.suffix) for r in glued_segments(df, "part", "id", "html").collect()}
    glued = [(part, "".join(h for _, p, h in rows if p == part and h)) for part in (0, 1, 2, None)]
    whole = with_segments(with_runs(spark.createDataFrame(glued, "part long, html string"), "html"))
    want = {(r.part, r.seq): (r.prefix, r.core, r.suffix) for r in explode_segments(whole, "part").collect()}
    assert got == want


def test_runs_are_made_of_a_few_pages_at_a_time(monkeypatch):
    monkeypatch.setattr(markup, "SLICE_CHARS", 100)
    html = [None, "<p>a</p>" * 40, "", *["<b>c</b>"] * 99]
    made = list(markup._text_runs(iter([pa.array(html), pa.array([], pa.string())])))
    assert max(len(part) for part in made) <= 14
    assert [runs for part in made for runs in part.to_pylist()] == [text_runs(h or "") for h in html]
