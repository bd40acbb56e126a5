"""Greedy, in-order packing of sized items into bounded chunks.

A chunk takes items in order until it holds ``max_items`` or the next item
would take it over ``max_size``; an oversized item gets a chunk of its own.
Where one chunk ends decides where the next begins, yet no task has to see the
whole stream: items are cut into blocks of consecutive positions, and since a
chunk holds at most ``max_items`` items, a block can be entered at only that
many offsets. Every block works out, in parallel, at which offset of its
successor it would be left for each of them; following those short tables from
block to block gives the true entries, and the blocks then mark their chunks
in parallel. The result is that of one pass over the stream.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from feedloom.functions.shipping import ship_by_value
from feedloom.operators.ordering import with_positions
from feedloom.sources.staging import stage

ship_by_value(__name__)

BLOCK_ITEMS = 1 << 16
GROUP_BLOCKS = 1 << 12


def pack(
    df: DataFrame,
    order: list[Column],
    size: str,
    *,
    max_items: int,
    max_size: int,
    stream: str | None = None,
    numbered: bool = False,
    block_items: int = BLOCK_ITEMS,
    group_blocks: int = GROUP_BLOCKS,
) -> DataFrame:
    """``df`` with ``position`` and ``chunk_id``, the position its chunk starts at.

    ``df`` should be narrow: keys and the size, not the texts. With ``stream``
    every value of that column is packed by itself; positions stay global.
    ``numbered`` says that ``df`` has its ``position`` already.
    """
    block_items = max(block_items, max_items)  # a block holds at least one full chunk
    keys = [F.col(stream)] if stream else []
    placed = df if numbered else with_positions(df, [*keys, *order])
    if stream:
        last = (F.max("position") - F.min("position")).alias("_last")
        starts = placed.groupBy(stream).agg(F.min("position").alias("_start"), last)
        placed = placed.join(starts, stream)
    else:
        placed = placed.withColumn("_start", F.lit(0).cast("bigint"))
    local = F.col("position") - F.col("_start")
    sized = (
        placed.withColumn("_local", local)
        .withColumn("_block", F.floor(local / block_items))
        .withColumn("_size", F.col(size).cast("bigint"))
    )
    schema, short = df.drop("position").schema, None
    if stream:
        # streams that fit a block need no blocks of their own: a group takes all that start in one
        short = _mark_streams(sized.where(F.col("_last") < block_items), schema, max_items, max_size, block_items)
        sized = sized.where(F.col("_last") >= block_items)
    # the first items of a block are also shown to the block before it
    shared = (F.col("_block") > 0) & (F.col("_local") % block_items < max_items)
    shown = F.when(shared, F.array("_block", F.col("_block") - 1)).otherwise(F.array("_block"))
    views = sized.withColumn("_view", F.explode(shown)).drop("_block")

    longest = sized.agg(F.max("_local")).first()[0]
    if stream and longest is None:
        return short
    entries = None
    if longest is not None and longest >= block_items:
        narrow = views.select("_start", "_view", "_local", "_size")
        entries = _block_entries(narrow, max_items, max_size, block_items, group_blocks)
    marked = _mark_chunks(views, entries, schema, max_items, max_size, block_items)
    return short.unionByName(marked) if stream else marked


def next_starts(sizes: np.ndarray, max_items: int, max_size: int) -> np.ndarray:
    """For a chunk starting at each item, the index after its last item."""
    total = np.concatenate(([0], np.cumsum(sizes)))
    at = np.arange(len(sizes))
    fits = np.searchsorted(total, total[:-1] + max_size, side="right") - 1
    return np.minimum(np.maximum(fits, at + 1), np.minimum(at + max_items, len(sizes)))


def exit_offsets(follow: np.ndarray, items: int, max_items: int) -> np.ndarray:
    """Offset into the following block for a chunk start at each leading item."""
    where = np.arange(min(max_items, items))
    while True:
        inside = where < items
        if not inside.any():
            return where - items
        where = np.where(inside, follow[np.minimum(where, items - 1)], where)


def _block_entries(narrow, max_items, max_size, block_items, group_blocks):
    """Entry offset of every block but the first of its stream."""
    schema = "_start long, _view long, _exits array<int>"

    def exits(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_local")
        items = int((rows["_local"] // block_items == key[1]).sum())
        out = []
        if items < len(rows):  # the last block of a stream leads nowhere
            follow = next_starts(rows["_size"].to_numpy(), max_items, max_size)
            out.append(exit_offsets(follow, items, max_items).tolist())
        out = pd.Series(out, dtype=object)
        return pd.DataFrame({"_exits": out}).assign(_start=key[0], _view=key[1])

    tables = stage(narrow.groupBy("_start", "_view").applyInPandas(exits, schema), "block_exits")

    # blocks are followed in groups: first each group as a whole, for every
    # offset it may be entered at, then inside the groups from the true entry
    grouped = tables.withColumn("_group", F.floor(F.col("_view") / group_blocks))

    def through(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        steps = rows.sort_values("_view")["_exits"].tolist()
        at = np.arange(len(steps[0]))
        for step in steps:
            at = np.asarray(step)[at]
        return pd.DataFrame({"_start": [key[0]], "_group": [key[1]], "_exits": [at.tolist()]})

    def group_entries(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_group")
        at, entered = 0, []
        for step in rows["_exits"]:
            entered.append(at)
            at = int(step[at])
        return pd.DataFrame({"_start": key[0], "_group": rows["_group"], "_entry": entered})

    groups = grouped.groupBy("_start", "_group").applyInPandas(
        through, "_start long, _group long, _exits array<int>"
    )
    entered = groups.groupBy("_start").applyInPandas(
        group_entries, "_start long, _group long, _entry int"
    )

    def entries(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_view")
        at, out = int(rows["_entry"].iloc[0]), []
        for step in rows["_exits"]:
            at = int(step[at])
            out.append(at)
        return pd.DataFrame({"_start": key[0], "_view": rows["_view"] + 1, "_entry": out})

    return (
        grouped.join(entered, ["_start", "_group"])
        .groupBy("_start", "_group")
        .applyInPandas(entries, "_start long, _view long, _entry int")
    )


def _mark_streams(sized, schema, max_items, max_size, block_items):
    """The items of streams of at most a block with their chunk, many streams at a time."""
    columns = [*schema.names, "position"]

    def mark(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_start", "_local"])
        opens = np.flatnonzero(rows["_local"].to_numpy() == 0)
        ends = np.repeat([*opens[1:], len(rows)], np.diff([*opens, len(rows)]))
        follow = np.minimum(next_starts(rows["_size"].to_numpy(), max_items, max_size), ends).tolist()
        at, starts = 0, []
        while at < len(follow):
            starts.append(at)
            at = follow[at]
        chunk = np.repeat(rows["position"].to_numpy()[starts], np.diff([*starts, at]))
        return rows[columns].assign(chunk_id=chunk)

    grouped = sized.groupBy(F.floor(F.col("_start") / block_items).alias("_view"))
    return grouped.applyInPandas(mark, _marked(schema))


def _marked(schema: StructType) -> StructType:
    return StructType([*schema.fields]).add("position", "long").add("chunk_id", "long")


def _mark_chunks(views, entries, schema, max_items, max_size, block_items):
    """The items with their chunk, each from the block its chunk starts in."""
    columns = [*schema.names, "position"]

    def mark(key, rows: pd.DataFrame, at: int) -> pd.DataFrame:
        rows = rows.sort_values("_local")
        items = int((rows["_local"] // block_items == key[1]).sum())
        follow = next_starts(rows["_size"].to_numpy(), max_items, max_size)
        first, starts = at, []
        while at < items:
            starts.append(at)
            at = int(follow[at])
        positions = rows["position"].to_numpy()
        chunk = np.repeat(positions[starts], np.diff([*starts, at])) if starts else positions[:0]
        return rows.iloc[first:at][columns].assign(chunk_id=chunk)

    def mark_first(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return mark(key, rows, 0)

    def mark_entered(key: tuple, rows: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        return mark(key, rows, int(entry["_entry"].iloc[0]) if len(entry) else 0)

    marked = _marked(schema)
    grouped = views.groupBy("_start", "_view")
    if entries is None:
        return grouped.applyInPandas(mark_first, marked)
    return grouped.cogroup(entries.groupBy("_start", "_view")).applyInPandas(mark_entered, marked)
