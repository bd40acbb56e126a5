"""Batch translation: pack, call a backend once per chunk, check, scatter."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from feedloom.functions.shipping import ship_by_value
from feedloom.operators.packing import pack
from feedloom.operators.replies import with_string_array
from feedloom.options import EnrichOptions
from feedloom.sources.staging import stage
from feedloom.sources.tables import read_or_create

ship_by_value(__name__)

# A backend gets the texts of one chunk and returns as many, or the reply text
# of a model that is yet to be parsed.
TextBackend = Callable[[list[str]], "list[str] | str"]

ANSWER_NAMES = ("output", "reply", "call_error", "format_error")
ANSWER_TYPES = (pa.list_(pa.string()), pa.string(), pa.string(), pa.bool_())

# Chunks whose texts and answers a task holds as objects at a time.
CALLED_ROWS = 64

COUNT_ERROR = "the backend answered with another number of texts than it was asked for"


class ReplyFormatError(RuntimeError):
    """Raised by a backend whose reply was readable but not as agreed."""


class GlossaryBackend:
    """Deterministic stand-in: glossary lookup, else ``T(text)``.

    The dictionary goes along with every task; a large glossary is a table, see
    ``translate_by_glossary``.
    """

    def __init__(self, glossary: dict[str, str] | None = None):
        self.glossary = glossary or {}

    def __call__(self, texts: list[str]) -> list[str]:
        return [self.glossary.get(text, f"T({text})") for text in texts]


@dataclass(frozen=True)
class Remembered:
    """A backend whose answers are kept, so that a later run does not pay for them again.

    ``path`` is a folder all executors share; every run adds what it asked. ``name`` tells
    apart what answers differently: model, prompt, language. Failed calls are asked again, and so
    are lists of a wrong length. A reply in text is kept as it is, whether it can be
    parsed or not. Chunks with equal texts are asked once within a run, too; a lost task asks again
    what it had not yet handed in.
    """

    backend: Callable
    path: str
    name: str


def translate_by_glossary(texts: DataFrame, glossary: DataFrame) -> DataFrame:
    """Relational backend: a join with a table ``glossary(core, target)``."""
    wanted = glossary.select(F.col("core").alias("text"), "target").join(
        texts.select("text"), "text", "left_semi"
    )
    found = wanted.groupBy("text").agg(F.min("target").alias("target"))
    return texts.join(found, "text", "left").withColumn(
        "translated", F.coalesce("target", F.concat(F.lit("T("), "text", F.lit(")")))
    ).drop("target")


def _call_partitions(chunks: DataFrame) -> int:
    # a fixed number of partitions: chunks are small, and merging them into few
    # partitions would make the calls run one after another
    return max(
        chunks.sparkSession.sparkContext.defaultParallelism,
        int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")),
    )


def call_per_chunk(
    chunks: DataFrame, inputs: str, backend: Callable, decode: bool, dealt: bool = False
) -> DataFrame:
    """Call the backend once for every row of ``chunks`` and keep what it said.

    Adds ``output`` (a list it returned), ``reply`` (a text it returned, or
    JSON of what it returned if ``decode``), ``call_error`` and
    ``format_error``; ``inputs`` is dropped. The result is written before
    anything reads it, so that branching off it does not call again. ``dealt``
    says that the chunks are in the partitions they are to be called in.
    """
    if isinstance(backend, Remembered):
        return _call_for_new(chunks, inputs, backend, decode)
    kept = [name for name in chunks.columns if name != inputs]
    schema = StructType([chunks.schema[name] for name in kept])
    schema = schema.add("output", ArrayType(StringType())).add("reply", "string")
    schema = schema.add("call_error", "string").add("format_error", "boolean")

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a batch may hold ten thousand chunks
        parts = (batch.slice(at, CALLED_ROWS) for batch in batches for at in range(0, batch.num_rows, CALLED_ROWS))
        for batch in parts:
            said = [_ask_once(backend, texts, decode) for texts in batch.column(inputs).to_pylist()]
            answers = [
                pa.array(column, kind)
                for column, kind in zip(zip(*said), ANSWER_TYPES)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(name) for name in kept] + answers, [*kept, *ANSWER_NAMES]
            )

    placed = chunks if dealt else chunks.repartition(_call_partitions(chunks), "chunk_key")
    return stage(placed.mapInArrow(call, schema), "replies")


def _call_for_new(chunks: DataFrame, inputs: str, backend: Remembered, decode: bool) -> DataFrame:
    """Like ``call_per_chunk``, but asks only what no earlier run has an answer to."""
    question = F.to_json(F.struct(F.lit(backend.name).alias("name"), F.lit(decode).alias("json"), inputs))
    asked = stage(chunks.withColumn("asked", F.sha2(question, 256)), "asked")
    wanted = asked.select("asked").distinct()
    ledger = read_or_create(chunks.sparkSession, "answers", backend.path)
    known = stage(ledger.join(wanted, "asked", "left_semi").dropDuplicates(["asked"]), "known")
    new = asked.dropDuplicates(["asked"]).join(known.select("asked"), "asked", "left_anti")
    new = new.select("asked", F.col("asked").alias("chunk_key"), F.size(inputs).alias("n"), inputs)
    said = call_per_chunk(new, inputs, backend.backend, decode)
    whole = F.col("call_error").isNull() & ~F.col("format_error")
    whole &= F.coalesce(F.size("output") == F.col("n"), F.col("reply").isNotNull())
    said.where(whole).select(*ledger.columns).write.mode("append").parquet(backend.path)
    no_error = {"call_error": F.lit(None).cast("string"), "format_error": F.lit(False)}
    answers = said.drop("chunk_key", "n").unionByName(known.withColumns(no_error))
    return asked.drop(inputs).join(answers, "asked").drop("asked")


def _ask_once(backend: Callable, inputs: list[str], decode: bool) -> tuple:
    try:
        answer = backend([json.loads(text) for text in inputs] if decode else inputs)
        if isinstance(answer, str):
            return None, answer, None, False
        if decode:
            return None, json.dumps(answer, ensure_ascii=False), None, False
        if not isinstance(answer, (list, tuple)) or not all(isinstance(t, str) for t in answer):
            raise ReplyFormatError("the backend answered with something other than a list of texts")
        return list(answer), None, None, False
    except Exception as failure:  # one bad chunk must not end the job
        message = str(failure) or type(failure).__name__
        return None, None, message, isinstance(failure, ReplyFormatError)


def chunk_texts(
    texts: DataFrame, order: list[Column], options: EnrichOptions, stream: str | None = None
) -> DataFrame:
    """Texts packed into chunks: ``chunk_key``, item keys and texts in order.

    ``texts`` has ``entry_id, seq, text`` and the columns of ``order``. Only
    lengths go through the packing.
    """
    sizes = texts.withColumn("size", F.length("text")).drop("text")
    packed = _packed(sizes, order, options, stream).select("entry_id", "seq", "position", "chunk_id")
    return _gathered(texts.select("entry_id", "seq", "text").join(packed, ["entry_id", "seq"]))


def _packed(sizes, order, options, stream=None) -> DataFrame:
    return pack(
        sizes,
        order,
        "size",
        max_items=options.max_texts,
        max_size=options.max_chars,
        stream=stream,
    ).drop("size")


def _gathered(items: DataFrame) -> DataFrame:
    """The chunks of ``items``, dealt out for the calls as they are gathered."""
    item = F.struct("position", "entry_id", "seq", "text")
    keys = F.transform("items", lambda i: i.dropFields("text"))
    return (
        items.repartition(_call_partitions(items), "chunk_id")
        .groupBy("chunk_id")
        .agg(F.array_sort(F.collect_list(item)).alias("items"))
        .select(
            F.col("chunk_id").cast("string").alias("chunk_key"),
            keys.alias("items"),
            F.transform("items", lambda i: i["text"]).alias("inputs"),
        )
    )


def run_chunks(chunks: DataFrame, backend: TextBackend, dealt: bool = False) -> DataFrame:
    """One row per text: ``entry_id, seq, position, translated, error``.

    A chunk whose call failed or whose count is wrong fails as a whole.
    """
    called = call_per_chunk(chunks, "inputs", backend, decode=False, dealt=dealt)
    answered = with_string_array(called, "reply", "parsed").withColumn(
        "answer", F.coalesce("output", "parsed")
    )
    error = F.coalesce(
        F.col("call_error"),
        F.when(F.col("output").isNull(), F.col("reply_error")),
        F.when(F.size("answer") != F.size("items"), F.lit(COUNT_ERROR)),
    )
    checked = answered.select("items", "answer", error.alias("error"))
    return checked.select("error", "answer", F.posexplode("items").alias("at", "item")).select(
        "item.entry_id",
        "item.seq",
        "item.position",
        F.when(F.col("error").isNull(), F.get("answer", F.col("at"))).alias("translated"),
        "error",
    )


def translate_texts(
    texts: DataFrame, order: list[Column], backend: TextBackend, options: EnrichOptions
) -> DataFrame:
    """Translate all texts in one stream; articles hit by a failure go alone.

    Articles with a text in a failed chunk are packed again, each by itself,
    and called once more; what fails then stays failed with its message.
    """
    if options.distinct_texts:
        return _translate_distinct(texts, order, backend, options)
    together = run_chunks(chunk_texts(texts, order, options), backend, dealt=True)
    failed = together.where(F.col("error").isNotNull()).select("entry_id").distinct()
    if failed.isEmpty():
        return together
    again = texts.join(failed, "entry_id", "left_semi")
    alone = run_chunks(chunk_texts(again, [F.col("seq")], options, stream="entry_id"), backend, dealt=True)
    return together.join(failed, "entry_id", "left_anti").unionByName(alone)


def _translate_distinct(texts, order, backend, options):
    """Equal texts are sent once, at the place of the first; failed ones once more, each alone.

    Texts are told apart by their SHA-256, so that they move with their chunk only.
    """
    keyed = texts.withColumn("_same", F.unhex(F.sha2("text", 256)))
    places = stage(keyed.withColumn("size", F.length("text")).drop("text"), "places")
    same_text = Window.partitionBy("_same").orderBy(*order)
    first = places.withColumn("_nth", F.row_number().over(same_text)).where("_nth = 1").drop("_nth")
    key = ["entry_id", "seq", "_same"]
    packed = stage(_packed(first, order, options).select(*key, "position", "chunk_id"), "packed")
    # a row may come twice
    sent = keyed.select(*key, "text").join(packed, key).dropDuplicates([*key, "position", "chunk_id"])
    together = run_chunks(_gathered(sent), backend, dealt=True)
    failed = together.where(F.col("error").isNotNull()).select("position")
    answers = together
    if not failed.isEmpty():
        # a text must not fail for another one in its chunk, whichever article that is from
        again = keyed.select(*key, "text").join(packed.join(failed, "position"), key)
        again = again.dropDuplicates([*key, "position"]).select(
            F.concat_ws("-", "entry_id", "seq").alias("chunk_key"),
            F.array(F.struct("position", "entry_id", "seq")).alias("items"),
            F.array("text").alias("inputs"),
        )
        alone = run_chunks(again, backend)
        answers = together.where(F.col("error").isNull()).unionByName(alone)
    by_text = packed.select("position", "_same").join(answers.drop("entry_id", "seq"), "position")
    return (
        places.select("entry_id", "seq", "_same")
        .join(by_text, "_same")
        .select("entry_id", "seq", "position", "translated", "error")
    )
