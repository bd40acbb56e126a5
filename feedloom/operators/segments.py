"""HTML bodies as rows of translatable text, and back."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from feedloom.functions.markup import glued_runs, runs_of
from feedloom.functions.shipping import ship_by_value
from feedloom.functions.text import (
    escape_markup,
    excerpt,
    is_blank,
    lstrip,
    preview,
    rstrip,
    strip,
)

ship_by_value(__name__)

# Segments of a glued document that are handed on at a time.
GLUED_ROWS = 512

# Text directly inside these elements is never translated.
PROTECTED = ("script", "style", "noscript", "code", "pre", "textarea", "svg", "math")

# A text needs a digit or a Latin, Greek or Cyrillic letter.
TRANSLATABLE = r"[0-9A-Za-z\x{c0}-\x{24f}\x{400}-\x{4ff}\x{370}-\x{3ff}]"

TITLE_SEQ = -1


def is_translatable(text: Column) -> Column:
    return text.rlike(TRANSLATABLE)


def split_whitespace(raw: Column) -> list[Column]:
    """Leading whitespace, core and trailing whitespace."""
    return [
        F.left(raw, F.length(raw) - F.length(lstrip(raw))).alias("prefix"),
        strip(raw).alias("core"),
        F.substr(raw, F.length(rstrip(raw)) + 1).alias("suffix"),
    ]


def with_runs(df: DataFrame, html: str) -> DataFrame:
    """``df`` with the text runs of column ``html`` as array ``runs``."""
    return df.withColumn("runs", runs_of(F.col(html)))


def _is_segment(run: Column) -> Column:
    # a translatable text is not blank, so that needs no test of its own
    protected = F.coalesce(run["parent"], F.lit("")).isin(*PROTECTED)
    return ~protected & F.coalesce(is_translatable(run["text"]), F.lit(False))


def with_segments(with_runs_df: DataFrame) -> DataFrame:
    """Adds ``segments``, the runs to translate, and ``tail``.

    ``lead`` of a segment is everything since the segment before it, so that
    the leads and markups of all segments and the tail make up the html.
    """
    def joined(first: Column, count: Column) -> Column:
        """Leads and markups of ``count`` runs from index ``first`` on."""
        some = F.slice(F.col("runs"), first + 1, count)
        return F.array_join(F.transform(some, lambda r: F.concat(r["lead"], r["markup"])), "")

    # where the segments are is found once; each then reads the runs since the one before it, so
    # the work grows with the number of runs
    places = F.filter(
        F.sequence(F.lit(0), F.size("runs") - 1), lambda i: _is_segment(F.get("runs", i))
    )
    before = F.concat(F.array(F.lit(-1)), F.col("_places"))

    def segment(place: Column) -> Column:
        at, last = place["at"], place["last"]
        run = F.get("runs", at)
        lead = F.concat(joined(last + 1, at - last - 1), run["lead"])
        return F.struct(lead.alias("lead"), run["markup"].alias("markup"), run["text"].alias("text"))

    pairs = F.zip_with(
        "_places",
        F.slice(before, F.lit(1), F.size("_places")),
        lambda at, last: F.struct(at.alias("at"), last.alias("last")),
    )
    rest = F.coalesce(F.try_element_at("_places", F.lit(-1)), F.lit(-1)) + 1
    return with_runs_df.withColumn("_places", places).select(
        *with_runs_df.columns,
        F.transform(pairs, segment).alias("segments"),
        joined(rest, F.size("runs") - rest).alias("tail"),
    )


def explode_segments(df: DataFrame, *keys: str) -> DataFrame:
    """One row per segment: keys, ``seq`` from 0, prefix, core, suffix."""
    texts = F.transform("segments", lambda s: s["text"])
    rows = df.select(*keys, F.posexplode(texts).alias("seq", "text"))
    return rows.select(*keys, "seq", *split_whitespace(F.col("text")))


def glued_segments(df: DataFrame, part: str, order: str, html: str) -> DataFrame:
    """The segments of documents glued from many rows: ``part``, ``seq``, prefix, core, suffix.

    The html of a document is that of its rows in ``order``, nulls left out. What a row
    leaves open decides how the next one reads, so a document is read by one task, but a row at
    a time: neither its html nor its runs are ever held as a whole. Rows of one place go by their html.
    """
    kept = df.where(F.col(html).isNotNull()).select(part, order, html)
    translatable = re.compile(re.sub(r"\\x\{(\w+)\}", lambda m: f"\\u{m[1]:0>4}", TRANSLATABLE))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (
            (batch.column(part)[i], batch.column(html)[i].as_py())
            for batch in batches
            for i in range(batch.num_rows)
        )
        for _, group in groupby(rows, lambda row: row[0].as_py()):
            key, first = next(group)
            found = (
                text
                for text, parent in glued_runs(chain([first], (piece for _, piece in group)))
                if parent not in PROTECTED and translatable.search(text)
            )
            seq = 0
            while texts := list(islice(found, GLUED_ROWS)):
                numbers = pa.array(range(seq, seq + len(texts)), pa.int64())
                columns = [pa.repeat(key, len(texts)), numbers, pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [part, "seq", "text"])
                seq += len(texts)

    schema = StructType([kept.schema[part]]).add("seq", "long").add("text", "string")
    found = kept.repartition(part).sortWithinPartitions(part, order, html).mapInArrow(read, schema)
    return found.select(part, "seq", *split_whitespace(F.col("text")))


def texts_to_translate(df: DataFrame, *keys: str, title: str) -> DataFrame:
    """The payload of every article: its raw title unless blank, then the cores."""
    body = F.transform(
        "segments", lambda s, i: F.struct(i.alias("seq"), strip(s["text"]).alias("text"))
    )
    head = F.when(
        ~is_blank(F.col(title)),
        F.array(F.struct(F.lit(TITLE_SEQ).alias("seq"), F.col(title).alias("text"))),
    ).otherwise(F.array().cast("array<struct<seq:int,text:string>>"))
    return df.select(*keys, F.inline(F.concat(head, body)))


def gather_translations(translated: DataFrame, key: str) -> DataFrame:
    """Per article: ``new_title``, ``new_cores`` in order, and its first ``error``."""
    rows = F.array_sort(F.collect_list(F.struct("seq", "translated")))
    failed = F.when(F.col("error").isNotNull(), F.struct("position", "error"))
    gathered = translated.groupBy(key).agg(rows.alias("_rows"), F.min(failed).alias("_failed"))
    title = F.filter("_rows", lambda r: r["seq"] == TITLE_SEQ)
    cores = F.filter("_rows", lambda r: r["seq"] != TITLE_SEQ)
    return gathered.select(
        key,
        F.get(title, F.lit(0))["translated"].alias("new_title"),
        F.transform(cores, lambda r: r["translated"]).alias("new_cores"),
        F.col("_failed.error").alias("error"),
    )


def counts_match() -> Column:
    """Whether every segment has exactly one translation."""
    return F.size("segments") == F.coalesce(F.size("new_cores"), F.lit(0))


def rebuilt_html() -> Column:
    """Html with the segments replaced by ``new_cores``; the rest byte for byte.

    A translation equal to its text keeps the original markup, entities
    included.
    """

    def piece(segment: Column, new: Column) -> Column:
        prefix, core, suffix = split_whitespace(segment["text"])
        changed = F.concat(prefix, escape_markup(new), suffix)
        return F.concat(
            segment["lead"], F.when(new == core, segment["markup"]).otherwise(changed)
        )

    pieces = F.zip_with("segments", "new_cores", piece)
    return F.concat(F.coalesce(F.array_join(pieces, ""), F.lit("")), F.col("tail"))


def readable_text() -> Column:
    """Text of the runs, stripped, blank ones left out, one per line."""
    texts = F.transform(F.filter("runs", lambda run: run["readable"]), lambda run: strip(run["text"]))
    return F.array_join(F.filter(texts, lambda text: text != ""), "\n")


def with_excerpt(df: DataFrame, name: str, max_chars: int) -> DataFrame:
    """Adds the plain text of ``runs``, cut to ``max_chars``."""
    # a column of its own, or the text would be built once per use
    return (
        df.withColumn("_readable", readable_text())
        .withColumn(name, excerpt(F.col("_readable"), max_chars))
        .drop("_readable")
    )


def with_html_preview(df: DataFrame, name: str, html: str, max_chars: int) -> DataFrame:
    """Adds a one-line preview of an html column."""
    cut = with_excerpt(df.withColumn("runs", runs_of(F.col(html))), "_excerpt", max_chars)
    return cut.withColumn(name, preview(F.col("_excerpt"), max_chars)).drop("_excerpt", "runs")
