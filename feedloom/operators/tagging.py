"""Topic tags: who gets new ones, from which request, with which result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.tags import adds_tags, no_tags, normalize_generated
from feedloom.operators.inference import call_per_chunk
from feedloom.operators.ordering import with_positions
from feedloom.operators.packing import pack
from feedloom.operators.replies import MALFORMED, with_tag_results
from feedloom.operators.segments import with_excerpt
from feedloom.options import TAGGING_EXCERPT_CHARS, EnrichOptions
from feedloom.sources.staging import stage

# A backend gets the requests of one chunk and returns one tag list for each,
# or the reply text of a model that is yet to be parsed.
TagBackend = Callable[[list[dict]], "list | dict | str"]


def may_request_tags(options: EnrichOptions) -> Column:
    """Whether an article to translate also gets a tag request."""
    shared = (F.col("owner_count") > 1) & F.lit(options.require_single_owner)
    return F.lit(options.tagging) & ~shared & (F.size("current_tags") < options.max_tags)


def _tag_plan(action: str, reason: str, tags: Column | None = None) -> Column:
    return F.struct(
        F.lit(action).alias("action"),
        (no_tags() if tags is None else tags).alias("tags"),
        F.lit(reason).alias("reason"),
        F.lit(action == "generate").alias("persist"),
    )


def plan_tags(planned: DataFrame, options: EnrichOptions) -> DataFrame:
    """Adds ``tag_plan`` to rows that are skipped or reapplied.

    ``generate`` is only an intention here: its tags are filled in by
    ``settle_tag_plan`` once a backend was asked.
    """
    saved = F.col("translation.generated_tags")
    plan = (
        F.when(~F.lit(options.tagging), _tag_plan("skip", "ai-tagging-disabled"))
        .when(
            F.col("reason") == "shared-between-multiple-owners", _tag_plan("skip", "shared-entry")
        )
        .when(F.col("translation.entry_id").isNull(), _tag_plan("skip", "no-tracking-record"))
        .when(
            F.size(saved) > 0,
            F.when(
                adds_tags(F.col("current_tags"), saved),
                _tag_plan("apply", "restore-saved-ai-tags", saved),
            ).otherwise(_tag_plan("skip", "saved-ai-tags-already-present")),
        )
        .when(
            F.size("current_tags") >= options.max_tags,
            _tag_plan("skip", "existing-tags-sufficient"),
        )
        .otherwise(_tag_plan("generate", "generated-ai-tags"))
    )
    return planned.withColumn("tag_plan", plan)


def settle_tag_plan(generated: str = "generated") -> Column:
    """The tag plan after generation: without new tags it turns into a skip."""
    plan = F.col("tag_plan")
    tags = F.coalesce(F.col(generated), no_tags())
    return (
        F.when(plan["action"] != "generate", plan)
        .when(F.size(tags) == 0, _tag_plan("skip", "no-new-ai-tags"))
        .otherwise(plan.withField("tags", tags))
    )


def with_tagging_excerpt(df: DataFrame) -> DataFrame:
    """Adds the ``excerpt`` of the text in ``runs`` that a request carries."""
    return with_excerpt(df, "excerpt", TAGGING_EXCERPT_CHARS)


def with_payload(requests: DataFrame, request_id: Column, options: EnrichOptions) -> DataFrame:
    """Adds the JSON ``payload`` of a request and ``payload_size``.

    Rows without a free slot are left out. The size counts the blanks the
    usual JSON layout has after commas and colons.
    """
    slots = F.lit(options.max_tags) - F.size("existing_tags")
    payload = F.struct(
        request_id.alias("request_id"),
        F.col("title"),
        F.col("excerpt").alias("content_excerpt"),
        F.col("existing_tags"),
        F.col("slots").alias("max_new_tags"),
        F.lit(options.tag_language).alias("tag_language"),
    )
    # 6 colons and 5 commas in the object, the rest inside the tag list
    blanks = F.lit(11) + F.greatest(F.size("existing_tags") - 1, F.lit(0))
    return (
        requests.withColumn("slots", slots)
        .where(F.col("slots") > 0)
        .withColumn("request_id", request_id)
        .withColumn("payload", F.to_json(payload))
        .withColumn("payload_size", F.length("payload") + blanks)
    )


def prepare_requests(requests: DataFrame, order: list[Column], options: EnrichOptions) -> DataFrame:
    """Requests with id and payload.

    ``requests`` has ``entry_id, date_entered, batched, title, excerpt,
    existing_tags``, and ``order`` uses the first two. Batched ones are numbered in order; the others
    are asked one by one and each has number 0.
    """
    open_ones = requests.where(F.size("existing_tags") < options.max_tags)
    keys = open_ones.where("batched").select("entry_id", "date_entered")
    numbers = with_positions(keys, order, "request_index").select("entry_id", "request_index")
    batched = open_ones.where("batched").join(numbers, "entry_id")
    single = open_ones.where("not batched").withColumn("request_index", F.lit(0).cast("bigint"))
    numbered = batched.unionByName(single)
    return with_payload(numbered, F.col("request_index").cast("string"), options)


def chunk_requests(prepared: DataFrame, options: EnrichOptions) -> DataFrame:
    """Chunks of requests: ``chunk_key`` and ``requests`` in order."""
    sizes = prepared.where("batched").select(
        "entry_id", "payload_size", F.col("request_index").alias("position")
    )
    packed = pack(
        sizes,
        [],
        "payload_size",
        max_items=options.max_texts,
        max_size=options.max_chars,
        numbered=True,
    ).select("entry_id", F.concat(F.lit("q"), "chunk_id").alias("packed_key"))
    request = F.struct("request_index", "request_id", "entry_id", "payload")
    key = F.when(F.col("batched"), F.col("packed_key")).otherwise(F.concat(F.lit("s"), "entry_id"))
    return (
        prepared.join(packed, "entry_id", "left")
        .groupBy(key.alias("chunk_key"))
        .agg(F.array_sort(F.collect_list(request)).alias("requests"))
    )


def _ask(chunks: DataFrame, backend: TagBackend) -> DataFrame:
    """Call the backend and read its replies; ``retry`` marks format errors."""
    asked = chunks.select(
        "*",
        F.transform("requests", lambda r: r["payload"]).alias("inputs"),
        F.transform("requests", lambda r: r["request_id"]).alias("ids"),
    )
    called = call_per_chunk(asked, "inputs", backend, decode=True)
    read = with_tag_results(called, "reply", "ids")
    wrong_format = F.col("format_error") | (
        F.col("call_error").isNull() & (F.col("reply_error") != MALFORMED)
    )
    return read.select(
        "chunk_key",
        "requests",
        "results",
        F.coalesce("call_error", "reply_error").alias("error"),
        F.coalesce(wrong_format, F.lit(False)).alias("retry"),
    )


def _halves(chunks: DataFrame) -> DataFrame:
    middle = F.floor(F.size("requests") / 2).cast("int")
    left = F.struct(
        F.concat("chunk_key", F.lit("0")).alias("chunk_key"),
        F.slice("requests", F.lit(1), middle).alias("requests"),
    )
    right = F.struct(
        F.concat("chunk_key", F.lit("1")).alias("chunk_key"),
        F.slice("requests", middle + 1, F.size("requests") - middle).alias("requests"),
    )
    return chunks.select(F.inline(F.array(left, right)))


def ask_with_bisecting(chunks: DataFrame, backend: TagBackend) -> DataFrame:
    """Results per request: ``entry_id, request_index, tags, error``.

    A chunk whose reply has a wrong format is halved and asked again, down to
    single requests; other errors fail their chunk. Each round works on the
    failed remainder only, and there are at most as many as a chunk can be
    halved.
    """
    settled = None
    pending = chunks.select("chunk_key", "requests")
    while True:
        asked = _ask(pending, backend)
        again = F.col("retry") & (F.size("requests") > 1)
        done = asked.where(~again)
        settled = done if settled is None else settled.unionByName(done)
        pending = _halves(asked.where(again))
        if pending.isEmpty():
            break
    return settled.select(
        "results", "error", F.posexplode("requests")
    ).select(
        "col.entry_id",
        "col.request_index",
        F.when(F.col("error").isNull(), F.get("results", F.col("pos"))).alias("tags"),
        "error",
    )


def generate_tags(
    requests: DataFrame, order: list[Column], backend: TagBackend, options: EnrichOptions
) -> DataFrame:
    """New tags per request: ``entry_id, generated, error``.

    Requests without a free slot get the empty list. A batched request that
    failed with its chunk is asked once more by itself.
    """
    prepared = stage(prepare_requests(requests, order, options), "tag_requests")
    answers = ask_with_bisecting(chunk_requests(prepared, options), backend)
    failed = (
        answers.where(F.col("error").isNotNull())
        .join(prepared.where("batched").select("entry_id"), "entry_id", "left_semi")
        .select("entry_id")
    )
    if not failed.isEmpty():
        alone = prepared.join(failed, "entry_id", "left_semi").drop("request_index")
        alone = alone.drop("slots", "request_id", "payload", "payload_size").withColumn(
            "batched", F.lit(False)
        )
        alone = alone.withColumn("request_index", F.lit(0).cast("bigint"))
        retried = ask_with_bisecting(
            chunk_requests(with_payload(alone, F.lit("0"), options), options), backend
        )
        answers = answers.join(failed, "entry_id", "left_anti").unionByName(retried)
    normal = normalize_generated(F.col("tags"), F.col("existing_tags"), F.col("slots"))
    generated = prepared.select("entry_id", "existing_tags", "slots").join(answers, "entry_id")
    return requests.select("entry_id").join(
        generated.select("entry_id", normal.alias("generated"), "error"), "entry_id", "left"
    ).select(
        "entry_id",
        F.when(F.col("error").isNull(), F.coalesce("generated", no_tags())).alias("generated"),
        "error",
    )
