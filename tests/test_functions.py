import hashlib

import pytest
from pyspark.sql import functions as F

from feedloom import EnrichOptions
from feedloom.functions import tags as T
from feedloom.functions import text as X


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def strings(*items):
    return F.array(*[F.lit(i) for i in items]).cast("array<string>")


def test_tag_cache_is_split_cleaned_and_made_unique(spark):
    parsed = value(spark, T.parse_tag_cache(F.lit("rope, harbour,, ROPE , tides")))
    assert parsed == ["rope", "harbour", "tides"]
    assert value(spark, T.parse_tag_cache(F.lit(None).cast("string"))) == []
    assert value(spark, T.parse_tag_cache(F.lit(" #a  b.;\n(c)"))) == ["a b", "c"]


def test_merge_keeps_first_spelling_and_limit(spark):
    merged = T.merge_tags(
        strings("rope", "harbour"), strings("Harbour", "tides", "sail"), F.lit(3)
    )
    assert value(spark, merged) == ["rope", "harbour", "tides"]


def test_case_folding_joins_sharp_s_and_sigmas(spark):
    assert value(spark, T.merge_tags(strings("Straße", "ΣΑΣ"), strings("STRASSE", "σας"))) == [
        "Straße",
        "ΣΑΣ",
    ]


def test_format(spark):
    assert value(spark, T.format_tag_cache(strings("rope", "harbour", "tides"))) == (
        "rope,harbour,tides"
    )


@pytest.mark.parametrize(
    ("existing", "slots", "generated", "expected"),
    [
        (["Harbour"], 2, ["Rope", "Tides", "Harbour"], ["Rope", "Tides"]),
        ([], 1, ["Sails", "Rope"], ["Sails"]),
        (["Rope"], 2, ["rope", "b", "c"], ["b"]),
    ],
)
def test_a_repeated_tag_uses_up_a_slot(spark, existing, slots, generated, expected):
    column = T.normalize_generated(strings(*generated), strings(*existing), F.lit(slots))
    assert value(spark, column) == expected


@pytest.mark.parametrize(
    ("stored", "expected"),
    [
        (None, []),
        ('["a", "A", 1, true, null]', ["a", "1", "True", "None"]),
        ('{"a": 1}', []),
        ("17", []),
        ("a; b", ["a", "b"]),
        ('["a"', ['["a'.strip('["')]),
    ],
)
def test_stored_tags(spark, stored, expected):
    assert value(spark, T.decode_stored_tags(F.lit(stored).cast("string"))) == expected


def test_source_hash_is_that_of_the_joined_bytes(spark):
    title, content = "Ünï😀", "<p>中</p>"
    expected = hashlib.sha256(title.encode() + b"\0" + content.encode()).hexdigest()
    assert value(spark, X.source_hash(F.lit(title), F.lit(content))) == expected


def test_whitespace_is_the_unicode_kind(spark):
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    assert sorted(X.SPACE_CHARS) == spaces
    for space in spaces:
        assert value(spark, X.strip(F.lit(f"{space}a b{space}"))) == "a b"
        assert value(spark, X.is_blank(F.lit(space)))
        assert value(spark, X.collapse(F.lit(f"a{space}{space}b"))) == "a b"


@pytest.mark.parametrize(
    ("text", "limit", "expected"),
    [
        ("short", 10, "short"),
        ("Hello\nworld\nAgain", 12, "Hello\nworld"),
        ("one two three", 9, "one two"),
        ("onetwothree", 4, "onet"),
    ],
)
def test_excerpt_goes_back_to_the_last_blank(spark, text, limit, expected):
    assert value(spark, X.excerpt(F.lit(text), limit)) == expected


def test_preview(spark):
    assert value(spark, X.preview(F.lit(" \n "), 10)) == "<empty>"
    assert value(spark, X.preview(F.lit("a  b"), 10)) == "a b"
    assert value(spark, X.preview(F.lit("abcdef ghijk"), 10)) == "abcdef..."


def test_options_are_checked():
    from datetime import datetime

    now = datetime(2026, 3, 28)
    with pytest.raises(ValueError):
        EnrichOptions(run_ts=now, feed_ids=())
    with pytest.raises(ValueError):
        EnrichOptions(run_ts=now, feed_ids=(1,), max_chars=99)
    options = EnrichOptions(run_ts=now, feed_ids=(1,), source_langs=(" EN", ""))
    assert options.source_langs == ("en",)
    assert options.tag_language == "zh-CN"


def test_long_tag_lists_are_compared_without_their_product(spark):
    n = 40_000
    tags = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("Tag "), i.cast("string")))
    present = F.transform(F.sequence(F.lit(n), F.lit(3), F.lit(-1)), lambda i: F.concat(F.lit("tAG "), i.cast("string")))
    assert value(spark, T.without_tags(tags, present)) == ["Tag 1", "Tag 2"]
    assert value(spark, F.size(T.merge_tags(tags, present))) == n
    assert value(spark, T.without_tags(strings("b", "a", "C"), strings("c", "c", "x", "B"))) == ["a"]
    assert value(spark, T.without_tags(strings("b", "a"), T.no_tags())) == ["b", "a"]
