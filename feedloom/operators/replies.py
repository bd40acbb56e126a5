"""Reading backend replies: strict JSON string arrays and tag results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.text import SPACE, strip

# Error codes of a reply; all but the first say that its format was wrong.
MALFORMED = "malformed-json"
NOT_STRINGS = "not-a-string-array"
NOT_ARRAY = "not-an-array"
NOT_RESULTS = "not-tag-results"
WRONG_COUNT = "count-mismatch"
NO_ID = "missing-request-id"
TAGS_NOT_STRINGS = "tags-not-strings"
DUPLICATE_ID = "duplicate-request-id"
MISSING_RESULT = "missing-result"
UNEXPECTED_RESULT = "unexpected-result"


def reply_body(content: Column) -> Column:
    """Reply without a surrounding code fence."""
    body = strip(content)
    opened = F.regexp_replace(body, r"\A```[^\r\n]*(\r\n|\r|\n)?", "")
    closed = F.regexp_replace(opened, rf"(\A|\r\n|\r|\n)[{SPACE}]*```[{SPACE}]*\z", "")
    return F.when(body.startswith("```"), strip(closed)).otherwise(body)


def _is_object(value: Column) -> Column:
    return F.schema_of_variant(value).startswith("OBJECT")


def _strings(value: Column) -> Column:
    """The array of strings a variant holds, null if it is anything else."""
    items = F.try_variant_get(value, "$", "array<string>")
    # null items pass as strings in the schema, so they are looked for as well
    typed = F.schema_of_variant(value).isin("ARRAY<STRING>", "ARRAY<VOID>")
    return F.when(typed & F.forall(items, lambda item: item.isNotNull()), items)


def with_string_array(df: DataFrame, reply: str, name: str = "items") -> DataFrame:
    """Adds ``items`` and ``reply_error`` for a reply that should be a string array."""
    value = F.try_parse_json(reply_body(F.col(reply)))
    inner = F.when(
        _is_object(F.col("_value")),
        F.coalesce(F.try_variant_get("_value", "$.translations", "variant"), F.col("_value")),
    ).otherwise(F.col("_value"))
    return (
        df.withColumn("_value", value)
        .withColumn("_inner", inner)
        .withColumn(name, _strings(F.col("_inner")))
        .withColumn(
            "reply_error",
            F.when(F.col("_value").isNull(), MALFORMED).when(F.col(name).isNull(), NOT_STRINGS),
        )
        .drop("_value", "_inner")
    )


def with_tag_results(df: DataFrame, reply: str, request_ids: str | None = None) -> DataFrame:
    """Adds ``results``, one tag list per request, and ``reply_error``.

    Results come by position or keyed by request id. ``request_ids`` names an
    array column with the ids in order; without it keyed results are ordered
    by id as text. A reply is one bounded chunk, so arrays do here.
    """
    ids = F.col(request_ids) if request_ids else F.lit(None).cast("array<string>")
    value = F.col("_value")
    unwrapped = F.coalesce(
        *[F.try_variant_get(value, f"$.{key}", "variant") for key in ("tags", "results", "items")],
        value,
    )
    read = F.transform("_items", _read_result)
    seen_before = F.transform(
        "_read",
        lambda item, i: F.array_contains(
            F.transform(F.slice("_read", F.lit(1), i), lambda other: other["key"]), item["key"]
        ),
    )
    item_errors = F.zip_with(
        "_read",
        seen_before,
        lambda item, seen: F.when(item["key"].isNull(), NO_ID)
        .when(item["tags"].isNull(), TAGS_NOT_STRINGS)
        .when(seen, DUPLICATE_ID),
    )
    is_matrix = F.forall("_read", lambda item: item["row"].isNotNull())
    all_objects = F.forall("_read", lambda item: item["is_object"])
    keys = F.transform("_read", lambda item: item["key"])
    error = (
        F.when(value.isNull(), MALFORMED)
        .when(F.col("_items").isNull(), NOT_ARRAY)
        .when(
            F.col("_is_matrix"),
            F.when(ids.isNotNull() & (F.size(ids) != F.size("_items")), WRONG_COUNT),
        )
        .when(~all_objects, NOT_RESULTS)
        .otherwise(
            F.coalesce(
                F.get(F.filter(item_errors, lambda code: code.isNotNull()), F.lit(0)),
                F.when(F.exists(ids, lambda i: ~F.array_contains("_keys", i)), MISSING_RESULT),
                F.when(F.exists("_keys", lambda k: ~F.array_contains(ids, k)), UNEXPECTED_RESULT),
            )
        )
    )
    by_key = F.transform(
        F.coalesce(ids, F.array_sort("_keys")),
        lambda i: F.get(
            F.transform("_read", lambda item: item["tags"]),
            (F.array_position("_keys", i) - 1).cast("int"),
        ),
    )
    results = F.when(
        F.col("_is_matrix"), F.transform("_read", lambda item: item["row"])
    ).otherwise(by_key)
    return (
        df.withColumn("_value", F.try_parse_json(reply_body(F.col(reply))))
        .withColumn("_items", F.when(_is_object(value), unwrapped).otherwise(value))
        .withColumn("_items", F.try_variant_get("_items", "$", "array<variant>"))
        .withColumn("_read", read)
        .withColumn("_is_matrix", is_matrix)
        .withColumn("_keys", keys)
        .withColumn("reply_error", error)
        .withColumn("results", F.when(F.col("reply_error").isNull(), results))
        .drop("_value", "_items", "_read", "_is_matrix", "_keys")
    )


def _read_result(item: Column) -> Column:
    given = F.coalesce(
        F.try_variant_get(item, "$.request_id", "variant"), F.try_variant_get(item, "$.id", "variant")
    )
    kind = F.schema_of_variant(given)
    text = F.try_variant_get(given, "$", "string")
    key = (
        F.when((kind == "STRING") | (kind == "BIGINT") | kind.rlike(r"^DECIMAL\(\d+,0\)$"), text)
        # a truth value counts as an integer, spelled as Python spells it
        .when(kind == "BOOLEAN", F.initcap(text))
    )
    return F.struct(
        _is_object(item).alias("is_object"),
        key.alias("key"),
        _strings(F.try_variant_get(item, "$.tags", "variant")).alias("tags"),
        _strings(item).alias("row"),
    )
