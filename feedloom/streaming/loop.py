"""Running over what arrives, as a structured stream of article versions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from feedloom.operators.inference import TextBackend
from feedloom.operators.tagging import TagBackend
from feedloom.options import EnrichOptions
from feedloom.plans.run import plan_backlog
from feedloom.sources import schemas
from feedloom.sources.index import version_digest
from feedloom.sources.staging import recorded_stages, remove, stage
from feedloom.sources.store import TableStore, lookback_days, run_on_store

# A row with an ``id`` is a version of an article, one with an ``int_id`` a
# subscription to the article ``ref_id``, by default to that of its own row. An
# article with many subscribers has as many rows. Subscriptions come with their
# article or after it.
ARRIVALS = f"{schemas.ENTRIES}, arrived_at TIMESTAMP, {schemas.USER_ENTRIES}"


def columns_of(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


def newest_versions(arrivals: DataFrame) -> DataFrame:
    """The latest version of every article in a batch, the same one at every retry."""
    columns = columns_of(schemas.ENTRIES)
    rank = F.struct("arrived_at", version_digest())
    versions = arrivals.where(F.col("id").isNotNull())
    return versions.groupBy("id").agg(
        F.max_by(F.struct(*columns, "arrived_at"), rank).alias("newest")
    ).select("newest.*")


def new_subscriptions(arrivals: DataFrame) -> DataFrame:
    """One row for every subscription in a batch, the same one at every retry."""
    others = [c for c in columns_of(schemas.USER_ENTRIES) if c != "int_id"]
    rows = arrivals.where(F.col("int_id").isNotNull()).withColumn("ref_id", F.coalesce("ref_id", "id"))
    return rows.groupBy("int_id").agg(F.max(F.struct(*others)).alias("_row")).select("int_id", "_row.*")


def take_in(
    store: TableStore,
    arrivals: DataFrame,
    batch_id: int,
    options: EnrichOptions,
    translator: TextBackend | DataFrame,
    tagger: TagBackend | None = None,
    fulltext: DataFrame | None = None,
) -> bool:
    """Merge one batch and run; a batch already committed is left alone.

    A dry run would use up the arrivals without storing them and is refused.
    """
    if options.dry_run:
        raise ValueError("a stream cannot run dry")
    last = store.last_commit()
    if last is not None and last.batch_id is not None and batch_id <= last.batch_id:
        return False
    run_on_store(
        store,
        options,
        translator,
        tagger,
        fulltext,
        arrived=newest_versions(arrivals),
        subscribed=new_subscriptions(arrivals),
        batch_id=batch_id,
    ).forget()
    return True


def work_off(
    store: TableStore,
    batch_id: int,
    options: EnrichOptions,
    translator: TextBackend | DataFrame,
    tagger: TagBackend | None = None,
    fulltext: DataFrame | None = None,
) -> None:
    """Passes over what the quota left, as nothing is to be waited for.

    The first takes a quota, each other twice as many articles as the one before, so that the
    backlog is read and its days are rewritten a number of times that grows with its logarithm.
    Failed articles queue behind all others, so a pass that translates nothing and
    tries nothing but what failed before is the last one. It takes as many articles as all
    passes over this batch before it together, so each that failed in one of them is tried twice.
    If nothing failed, the pass that does not use up its quota is the last.

    Nothing arrives meanwhile, so what there is to do is found once, and the passes take it from there.
    """
    with recorded_stages() as made:
        backlog = plan_backlog(store.tables(lookback_days(options)), options)
        for doubled in count():
            taking = replace(options, quota=options.quota << doubled)
            result = run_on_store(
                store, taking, translator, tagger, fulltext, batch_id=batch_id, backlog=backlog
            )
            last = result.left_nothing() or not (result.translated or any(result.progress()))
            if not last and backlog is not None:
                done = result.outcome.where(F.col("error").isNull()).select("entry_id")
                settled = done if backlog.settled is None else backlog.settled.unionByName(done)
                backlog = replace(backlog, settled=stage(settled, "settled"))
            result.forget()
            if last:
                break
    for path in made:
        remove(store.spark, path.rpartition("/")[0])


def start(
    store: TableStore,
    arrivals_path: str,
    checkpoint: str,
    options_for: Callable[[int], EnrichOptions],
    translator: TextBackend | DataFrame,
    tagger: TagBackend | None = None,
    fulltext: DataFrame | None = None,
    *,
    every: str | None = None,
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """Start the stream; ``every`` is the pause between batches, like '300 seconds'.

    A clock runs beside the files, so that each interval has its pass even when
    nothing arrived and a quota's backlog is worked off. Without ``every``
    everything present is worked off in as many passes as the quota needs, and
    the stream ends. A version of an article that arrives after a newer one, by
    ``arrived_at``, is left out.
    ``options_for`` gives the options of a batch, its clock above all.
    """
    reader = store.spark.readStream.schema(ARRIVALS)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def handle(batch: DataFrame, batch_id: int) -> None:
        options = options_for(batch_id)
        take_in(store, batch, batch_id, options, translator, tagger, fulltext)
        # also after a batch that was committed before: a run may have died in its backlog
        if not every and options.quota is not None:
            work_off(store, batch_id, options, translator, tagger, fulltext)

    arrivals = reader.parquet(arrivals_path)
    if every:
        ticks = store.spark.readStream.format("rate").load()
        nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in arrivals.schema]
        arrivals = arrivals.unionByName(ticks.select(*nothing))
    writer = (
        arrivals.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
    )
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.trigger(**trigger).start()
