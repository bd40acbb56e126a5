import itertools
import random

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from feedloom.operators import packing
from feedloom.operators.ordering import with_positions
from feedloom.operators.packing import exit_offsets, next_starts, pack


def one_pass(sizes, max_items, max_size):
    """Chunk start of every item, by packing one after another."""
    starts, start, size = [], 0, 0
    for i, item in enumerate(sizes):
        if i > start and (i - start >= max_items or size + item > max_size):
            start, size = i, 0
        starts.append(start)
        size += item
    return starts


@given(
    st.lists(st.integers(0, 30), min_size=1, max_size=60), st.integers(1, 6), st.integers(5, 40)
)
def test_next_starts_follow_the_packing(sizes, max_items, max_size):
    follow = next_starts(np.asarray(sizes), max_items, max_size)
    at, starts = 0, []
    while at < len(sizes):
        starts += [at] * (follow[at] - at)
        at = int(follow[at])
    assert starts == one_pass(sizes, max_items, max_size)


@given(st.lists(st.integers(0, 30), min_size=20, max_size=60), st.integers(1, 6))
def test_exit_offsets_follow_every_entry(sizes, max_items):
    items = len(sizes) - max_items
    follow = next_starts(np.asarray(sizes), max_items, 40)
    for entry, offset in enumerate(exit_offsets(follow, items, max_items)):
        at = entry
        while at < items:
            at = int(follow[at])
        assert at - items == offset


@pytest.mark.parametrize(
    ("count", "max_items", "max_size", "block", "group"),
    [(60, 3, 10, 4, 2), (500, 5, 30, 7, 3), (300, 4, 20, 1 << 16, 1 << 12)],
)
def test_pack_equals_one_pass(spark, count, max_items, max_size, block, group):
    rng = random.Random(count)
    sizes = [rng.choice([0, 1, 3, 8, 12, 25, 300]) for _ in range(count)]
    rows = spark.createDataFrame(list(enumerate(sizes)), "i long, s long")
    packed = pack(
        rows,
        [F.col("i")],
        "s",
        max_items=max_items,
        max_size=max_size,
        block_items=block,
        group_blocks=group,
    )
    got = packed.orderBy("i").collect()
    assert [r.position for r in got] == list(range(count))
    assert [r.chunk_id for r in got] == one_pass(sizes, max_items, max_size)


def test_streams_are_packed_by_themselves(spark):
    rng = random.Random(3)
    # one stream holds most of the items
    rows = [(i, rng.choice([0, 0, 0, 1, 2]), rng.choice([0, 1, 3, 8, 12])) for i in range(200)]
    packed = pack(
        spark.createDataFrame(rows, "i long, k long, s long"),
        [F.col("i")],
        "s",
        max_items=4,
        max_size=20,
        stream="k",
        block_items=8,
        group_blocks=2,
    )
    got = packed.orderBy("position").collect()
    assert len(got) == 200
    for _, part in itertools.groupby(got, key=lambda r: r.k):
        part = list(part)
        base = part[0].position
        assert [r.chunk_id - base for r in part] == one_pass([r.s for r in part], 4, 20)


def test_short_streams_share_groups(spark, monkeypatch):
    def refused(*_):
        raise AssertionError("a group for each stream")

    monkeypatch.setattr(packing, "_mark_chunks", refused)
    rng = random.Random(4)
    rows = [(i, rng.randrange(60), rng.choice([0, 1, 3, 8, 25])) for i in range(900)]
    df = spark.createDataFrame(rows, "i long, k long, s long")
    packed = pack(df, [F.col("i")], "s", max_items=4, max_size=20, stream="k", block_items=100)
    got = packed.orderBy("position").collect()
    assert len(got) == 900
    for _, part in itertools.groupby(got, key=lambda r: r.k):
        part = list(part)
        base = part[0].position
        assert [r.chunk_id - base for r in part] == one_pass([r.s for r in part], 4, 20)


def test_empty_input_packs_to_nothing(spark):
    rows = spark.createDataFrame([], "i long, s long")
    assert pack(rows, [F.col("i")], "s", max_items=4, max_size=20).count() == 0


def test_positions_are_dense_and_ordered(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    got = with_positions(rows, [F.col("k").desc()]).collect()
    assert all(r.position == 999 - r.k for r in got) and len(got) == 1000
