"""Tag lists as ``array<string>`` columns: parse, clean, union, format."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.functions.text import collapse, fold

# What separates tags, and what is trimmed off both ends of one.
SEPARATORS = r"[,;\n]+"
TRIMMED = " \t\r\n#'\"`.,;:[](){}"


def no_tags() -> Column:
    return F.array().cast("array<string>")


def clean_tags(raw: Column) -> Column:
    """Flat list of trimmed, non-empty tags, in order, repeats kept."""
    parts = F.flatten(F.transform(raw, lambda tag: F.split(F.coalesce(tag, F.lit("")), SEPARATORS)))
    trimmed = F.transform(parts, lambda part: F.btrim(collapse(part), F.lit(TRIMMED)))
    return F.filter(trimmed, lambda tag: tag != "")


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def unique_tags(cleaned: Column) -> Column:
    """First spelling of every tag, compared without regard to case.

    Sorting by key and place puts every first spelling behind a change of key,
    so long lists do not cost their square.
    """
    by_key = F.array_sort(
        F.transform(
            cleaned,
            lambda tag, i: F.struct(fold(tag).alias("key"), i.alias("place"), tag.alias("tag")),
        )
    )

    def first_spellings(items: Column) -> Column:
        firsts = F.filter(
            items, lambda item, i: ~item["key"].eqNullSafe(F.get(items, i - 1)["key"])
        )
        in_order = F.array_sort(F.transform(firsts, lambda item: F.struct(item["place"], item["tag"])))
        return F.transform(in_order, lambda item: item["tag"])

    return _bind(by_key, first_spellings)


def merge_tags(existing: Column, generated: Column, limit: Column | None = None) -> Column:
    """Ordered union of two tag lists; ``limit`` keeps the first so many."""
    merged = unique_tags(clean_tags(F.concat(existing, generated)))
    return merged if limit is None else F.slice(merged, F.lit(1), limit)


def parse_tag_cache(raw: Column) -> Column:
    """Tag list held in a comma-separated text; null is the empty list."""
    return unique_tags(clean_tags(F.array(raw)))


def format_tag_cache(tags: Column) -> Column:
    return F.array_join(unique_tags(clean_tags(tags)), ",")


def without_tags(tags: Column, present: Column) -> Column:
    """Tags not in ``present``, compared without regard to case; ``tags`` must be unique.

    Both lists are sorted together, those present before an equal tag, so that long
    lists do not cost their product.
    """

    def keyed(some: Column, place: Callable[[Column], Column]) -> Column:
        return F.transform(
            some,
            lambda tag, i: F.struct(
                fold(tag).alias("key"), place(i).cast("int").alias("place"), tag.alias("tag")
            ),
        )

    def lacking(items: Column) -> Column:
        alone = F.filter(
            items,
            lambda item, i: (item["place"] >= 0)
            & ~item["key"].eqNullSafe(F.get(items, i - 1)["key"]),
        )
        in_order = F.array_sort(F.transform(alone, lambda item: F.struct(item["place"], item["tag"])))
        return F.transform(in_order, lambda item: item["tag"])

    both = F.concat(keyed(present, lambda i: F.lit(-1)), keyed(tags, lambda i: i))
    return _bind(F.array_sort(both), lacking)


def adds_tags(existing: Column, extra: Column) -> Column:
    """Whether the union with ``extra`` is longer than ``existing`` alone."""
    return F.size(merge_tags(existing, extra)) > F.size(existing)


def normalize_generated(generated: Column, existing: Column, slots: Column) -> Column:
    """Generated tags that fit the free slots and are new.

    Slots are counted before tags already present are dropped, so a repeat
    uses one up.
    """
    return without_tags(merge_tags(no_tags(), generated, slots), existing)


def decode_stored_tags(stored: Column) -> Column:
    """Tag list from a text column that holds a JSON array or a tag cache.

    A JSON value that is no array gives no tags; text that is not JSON is read
    as a tag cache. Nested items keep their JSON text.
    """
    value = F.try_parse_json(stored)
    items = F.try_variant_get(value, "$", "array<variant>")
    as_text = F.transform(items, _item_text)
    return (
        F.when(stored.isNull(), no_tags())
        .when(value.isNull(), parse_tag_cache(stored))
        .when(items.isNotNull(), unique_tags(clean_tags(as_text)))
        .otherwise(no_tags())
    )


def _item_text(item: Column) -> Column:
    kind = F.schema_of_variant(item)
    text = F.try_variant_get(item, "$", "string")
    return (
        F.when(F.is_variant_null(item), F.lit("None"))
        .when(kind == "BOOLEAN", F.initcap(text))
        .otherwise(text)
    )


def show_tags(tags: Column) -> Column:
    """Tags for a preview line."""
    return F.when(F.size(tags) == 0, F.lit("<none>")).otherwise(F.array_join(tags, ", "))
