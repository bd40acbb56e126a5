"""Translating any table with an html column, without the rest of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.functions.text import is_blank
from feedloom.operators.inference import TextBackend, translate_by_glossary, translate_texts
from feedloom.operators.segments import (
    counts_match,
    gather_translations,
    rebuilt_html,
    texts_to_translate,
    with_runs,
    with_segments,
)
from feedloom.options import EnrichOptions
from feedloom.sources.staging import stage

SEGMENT_COUNT_ERROR = "translations do not match the segments one to one"


def translate_title_and_html(
    df: DataFrame,
    key: str,
    title: str,
    html: str,
    translator: TextBackend | DataFrame,
    options: EnrichOptions,
) -> DataFrame:
    """``df`` with ``new_title``, ``new_html`` and ``error``, in key order of texts."""
    parsed = with_segments(with_runs(df, html)).drop("runs").withColumn("entry_id", F.col(key))
    return translate_parsed(parsed, title, [F.col("entry_id")], translator, options).drop("entry_id")


def translate_html(
    df: DataFrame, key: str, html: str, translator: TextBackend | DataFrame, options: EnrichOptions
) -> DataFrame:
    """``df`` with ``new_html`` and ``error``, for tables without titles."""
    untitled = df.withColumn("_untitled", F.lit(""))
    done = translate_title_and_html(untitled, key, "_untitled", html, translator, options)
    return done.drop("_untitled", "new_title")


def translate_parsed(
    parsed: DataFrame, title: str, order: list, translator: TextBackend | DataFrame, options: EnrichOptions
) -> DataFrame:
    """Translate rows whose html is already cut into ``segments`` and ``tail``.

    ``order`` gives the order of articles in the stream of texts.
    """
    parsed = stage(parsed, "segments")
    carried = [c for c in ("entry_id", "date_entered") if c in parsed.columns]
    texts = texts_to_translate(parsed, *carried, title=title)
    if callable(translator):
        translations = translate_texts(texts, [*order, F.col("seq")], translator, options)
    else:
        translations = translate_by_glossary(texts, translator).withColumns(
            {"error": F.lit(None).cast("string"), "position": F.lit(None).cast("bigint")}
        )
    gathered = gather_translations(translations, "entry_id")
    joined = parsed.join(gathered, "entry_id", "left").withColumn(
        "new_cores", F.coalesce("new_cores", F.array().cast("array<string>"))
    )
    titled = ~is_blank(F.col(title))
    return joined.select(
        *[c for c in parsed.columns if c not in ("segments", "tail")],
        F.when(titled, F.col("new_title")).otherwise(F.col(title)).alias("new_title"),
        rebuilt_html().alias("new_html"),
        F.coalesce("error", F.when(~counts_match(), F.lit(SEGMENT_COUNT_ERROR))).alias("error"),
    )
