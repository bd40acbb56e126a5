"""Benchmark decontamination with suffix arrays over the training texts.

Every chunk of documents is a shard. Its suffixes that begin with as many benchmark words as a window
has are sorted by their leading words: a suffix array in which every test suffix is binary-searched.
A window is `window` consecutive words of an item, or all of a shorter item. Windows found at
neighbouring places grow to the longest verbatim matches, which are returned with their places.

Words are maximal runs of digits, letters and bytes above 127, A-Z lower-cased, compared by 64-bit
hashes. Only benchmark items are broadcast: in blocks of at most `block_bytes` of text, each block a
pass over the documents. Nothing else leaves a document's own row. Windows that many items share are
joined to matches place by place, so beside the matches themselves a task holds about `INSTANCES` of them.

Defined results: null and empty texts have no words and no matches. Items without an id or words have
no windows. Rows that share an item id count as one item with the windows of all. Rows that share a
document id are judged one by one. Without items nothing is contaminated.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.textarrays import Texts, byte_table, mix, runs, texts

WINDOW = 10
BLOCK_BYTES = 16 << 20
SHARD_BYTES = 2 << 20
GATE_BITS = 20
LEAD = 3
INSTANCES = 1 << 20  # windows of items that are joined to matches at a time

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
IN_WORD = byte_table(b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256)))

MATCH = "array<struct<start: int, length: int, item: long>>"
_MATCH_TYPE = pa.struct([("start", pa.int32()), ("length", pa.int32()), ("item", pa.int64())])


def words(part: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and the first word of each text."""
    folded = Texts(part.first, _FOLD[part.data], part.offsets)
    starts, ends, first = folded.spans(IN_WORD)
    return folded.span_hashes(starts, ends), first


@dataclass
class TestWindows:
    """The distinct windows of a block of items, with the items and places of each."""

    vocabulary: np.ndarray  # sorted word hashes; a word's number is its place, from 1
    gate: np.ndarray  # which low bits of word hashes occur
    keys: np.ndarray  # distinct windows as strings of big-endian word numbers, sorted
    beyond: np.ndarray  # the last string that begins with each window
    sizes: np.ndarray  # words of each
    firsts: np.ndarray  # where each window's instances begin
    items: np.ndarray  # of each instance
    places: np.ndarray
    leads: dict[int, np.ndarray]  # window size -> sorted hashes of its leading words
    window: int


def index_items(ids: list[int], bodies: list[str], window: int = WINDOW) -> TestWindows:
    hashes, firsts = [np.empty(0, np.uint64)], [0]
    for part in texts(pa.array(bodies, pa.string())):
        own, first = words(part)
        hashes.append(own)
        firsts += (first[1:] + firsts[-1] - first[0]).tolist()
    flat = np.concatenate(hashes)
    vocabulary, numbers = np.unique(flat, return_inverse=True)
    numbers = (numbers + 1).astype(np.uint32)
    gate = np.zeros(1 << GATE_BITS, bool)
    gate[(vocabulary & np.uint64((1 << GATE_BITS) - 1)).astype(np.int64)] = True
    counts = np.diff(firsts)
    size = np.minimum(counts, window)
    n = np.where(counts > 0, counts - size + 1, 0)
    owner = np.repeat(np.arange(len(ids)), n)
    place = runs(n)
    grid = _grid(numbers, np.asarray(firsts[:-1], np.int64)[owner] + place, size[owner], window)
    keys, which = np.unique(_strings(grid), return_inverse=True)
    order = np.argsort(which, kind="stable")
    begins = np.searchsorted(which[order], np.arange(len(keys)))
    sizes = size[owner][order][begins] if len(keys) else np.empty(0, np.int64)
    own = grid[order][begins]
    beyond = _strings(np.where(np.arange(window) < sizes[:, None], own, 0xFFFFFFFF))
    leads = {}
    for length in np.unique(sizes).tolist():
        rows = own[sizes == length]
        leads[length] = np.unique(_lead_hash([rows[:, k] for k in range(min(LEAD, length))]))
    return TestWindows(vocabulary, gate, keys, beyond, sizes, begins, np.asarray(ids, np.int64)[owner][order], place[order], leads, window)


def _grid(numbers: np.ndarray, starts: np.ndarray, sizes: np.ndarray, window: int) -> np.ndarray:
    """The word numbers of each run, filled up with zeros."""
    if not len(starts):
        return np.zeros((0, window), np.uint32)
    at = starts[:, None] + np.arange(window)
    inside = np.arange(window) < np.asarray(sizes)[:, None]
    return np.where(inside, numbers[np.minimum(at, len(numbers) - 1)], 0).astype(np.uint32)


def _strings(grid: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(grid.astype(">u4")).view(f"S{4 * grid.shape[1]}").ravel()


def _lead_hash(columns: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(columns[0]), np.uint64)
    for column in columns:
        out = mix(out + column.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return out


def shard_matches(part: Texts, tests: TestWindows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of words of each text; its maximal matches as rows (text, start, length, item), sorted."""
    hashes, first = words(part)
    counts = np.diff(first)
    nothing = np.empty((0, 4), np.int64)
    if not len(tests.keys) or not len(hashes):
        return counts, nothing
    open_ = np.flatnonzero(tests.gate[(hashes & np.uint64((1 << GATE_BITS) - 1)).astype(np.int64)])
    place = np.searchsorted(tests.vocabulary, hashes[open_])
    place[place == len(tests.vocabulary)] = 0
    numbers = np.zeros(len(hashes), np.uint32)
    same = tests.vocabulary[place] == hashes[open_]
    numbers[open_[same]] = place[same] + 1
    known = np.concatenate([[0], np.cumsum(numbers > 0)])
    left = np.repeat(first[1:], counts) - np.arange(len(hashes))  # words to the end of the text
    starts = []
    for length, leads in tests.leads.items():
        reach = len(hashes) - length + 1
        if reach <= 0:
            continue
        at = np.flatnonzero((known[length:] - known[:-length] == length) & (left[:reach] >= length))
        lead = _lead_hash([numbers[at + k] for k in range(min(LEAD, length))]) if len(at) else np.empty(0, np.uint64)
        starts.append(at[leads[np.minimum(np.searchsorted(leads, lead), len(leads) - 1)] == lead])
    suffixes = np.unique(np.concatenate(starts)) if starts else np.empty(0, np.int64)
    if not len(suffixes):
        return counts, nothing
    keys = _strings(_grid(numbers, suffixes, left[suffixes], tests.window))
    order = np.argsort(keys, kind="stable")
    array, keys = suffixes[order], keys[order]
    low = np.searchsorted(keys, tests.keys, "left")
    high = np.searchsorted(keys, tests.beyond, "right")
    found = np.flatnonzero(high > low)
    if not len(found):
        return counts, nothing
    times = (high - low)[found]
    window = np.repeat(found, times)
    at = array[low[window] + runs(times)]
    by = np.argsort(at, kind="stable")
    window, at = window[by], at[by]
    instances = np.diff(np.append(tests.firsts, len(tests.items)))[window]
    # a match ends where no window starts at the next word, so places may be parted there
    gaps = np.append(0, np.flatnonzero(np.diff(at) > 1) + 1)
    so_far = np.append(0, np.cumsum(instances))
    parts, begin = [], 0
    for end in [*gaps[1:].tolist(), len(at)]:
        if end == len(at) or so_far[end] - so_far[begin] >= INSTANCES:
            parts.append(_maximal(tests, window[begin:end], at[begin:end], instances[begin:end]))
            begin = end
    rows = np.concatenate(parts)
    text = np.searchsorted(first, rows[:, 0], "right") - 1
    out = np.column_stack([text, rows[:, 0] - first[text], rows[:, 1], rows[:, 2]])
    return counts, out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def _maximal(tests: TestWindows, window: np.ndarray, at: np.ndarray, instances: np.ndarray) -> np.ndarray:
    """Maximal matches as rows (start, length, item) from windows found at words, with their numbers of instances."""
    instance = np.repeat(tests.firsts[window], instances) + runs(instances)
    at, size = np.repeat(at, instances), np.repeat(tests.sizes[window], instances)
    item, shift = tests.items[instance], at - tests.places[instance]
    by = np.lexsort((size, at, shift, item))
    item, shift, at, size = item[by], shift[by], at[by], size[by]
    same = (np.diff(item) == 0) & (np.diff(shift) == 0) & (np.diff(size) == 0)
    own = np.ones(len(at), bool)
    own[1:] = ~(same & (np.diff(at) == 0))  # items that are repeated rows
    item, shift, at, size = item[own], shift[own], at[own], size[own]
    same = (np.diff(item) == 0) & (np.diff(shift) == 0) & (np.diff(size) == 0)
    fresh = np.ones(len(at), bool)
    fresh[1:] = ~(same & (np.diff(at) == 1))
    heads = np.flatnonzero(fresh)
    lengths = np.diff(np.append(heads, len(at))) - 1 + size[heads]
    return np.column_stack([at[heads], lengths, item[heads]])


def _matches_column(text: Column, shared) -> Column:
    """A struct of n_words and matches for a text column."""

    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tests = shared.value
        for column in batches:
            n_words, per_text, rows = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty((0, 4), np.int64)]
            for part in texts(column, SHARD_BYTES):
                counts, found = shard_matches(part, tests)
                n_words.append(counts)
                per_text.append(np.bincount(found[:, 0], minlength=len(part)))
                rows.append(found)
            flat = np.concatenate(rows)
            inner = pa.StructArray.from_arrays([pa.array(flat[:, 1], pa.int32()), pa.array(flat[:, 2], pa.int32()), pa.array(flat[:, 3])], fields=list(_MATCH_TYPE))
            offsets = np.concatenate([[0], np.cumsum(np.concatenate(per_text))]).astype(np.int32)
            yield pa.StructArray.from_arrays([pa.array(np.concatenate(n_words)), pa.ListArray.from_arrays(pa.array(offsets), inner)], ["n_words", "matches"])

    find.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(find, f"struct<n_words: long, matches: {MATCH}>")(text)


def benchmark_matches(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
    with_row: bool = False,
) -> DataFrame:
    """`id, n_words, matches` for every row; matches have start, length (in words) and item.

    `with_row` adds `row`, a struct of all columns of `docs`.
    A match is a maximal run of document words every window of which stands in the item the same way.
    """
    spark = docs.sparkSession
    known = items.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("body")).filter("item is not null and body is not null")
    volume = known.agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0))).first()[0]
    blocks = max(1, -(-volume // block_bytes))
    carried = [F.struct(*docs.columns).alias("row")] if with_row else []
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *carried)
    keyed = own if blocks == 1 else own.withColumn("mark", F.xxhash64("text"))
    passes = []
    for k in range(blocks):
        rows = sorted(known.filter(F.pmod(F.xxhash64("item", "body"), F.lit(blocks)) == k).collect())
        shared = spark.sparkContext.broadcast(index_items([r["item"] for r in rows], [r["body"] for r in rows], window))
        keep = (["id"] if blocks == 1 else ["id", "mark"]) + (["row"] if with_row and k == 0 else [])
        passes.append(keyed.select(*keep, _matches_column(F.col("text"), shared).alias("found")).select(*keep, "found.*"))
    if blocks == 1:
        return passes[0]
    rest = passes[1].filter("size(matches) > 0")
    for more in passes[2:]:
        rest = rest.unionAll(more.filter("size(matches) > 0"))
    # rows with the same id and text have the same matches
    rest = rest.dropDuplicates().groupBy(F.col("id").alias("rid"), F.col("mark").alias("rmark")).agg(F.array_distinct(F.flatten(F.collect_list("matches"))).alias("more"))
    joined = passes[0].join(rest, F.col("id").eqNullSafe(F.col("rid")) & F.col("mark").eqNullSafe(F.col("rmark")), "left")
    every = F.array_sort(F.concat("matches", F.coalesce("more", F.array().cast(MATCH))))
    return joined.select("id", *(["row"] if with_row else []), "n_words", every.alias("matches"))


def hit_words(matches: str) -> Column:
    """How many words the matches cover together; matches are sorted by start."""
    return F.expr(
        f"""aggregate({matches}, named_struct('n', 0L, 'reach', 0L), (s, m) -> named_struct(
            'n', s.n + greatest(0L, m.start + m.length - greatest(s.reach, bigint(m.start))),
            'reach', greatest(s.reach, bigint(m.start + m.length)))).n"""
    )
