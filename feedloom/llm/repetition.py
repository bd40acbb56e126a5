"""Quality rules on repetition inside a text, by suffix arrays over its words.

Every text gets a suffix array of its words with the longest common prefixes (LCP) of neighbours. A
maximal range of ranks whose inner LCPs are all at least `l`, one of them equal to it, is an LCP
interval: a substring of `l` words that stands in as many places as the range has ranks. It cannot be
prolonged to the right; if the words before its places differ it cannot be prolonged to the left
either and is a maximal repeated substring. The spans of all of `least_words` words or more are united. A
text passes if their share of its words is at most `most_covered_percent` and no maximal repeat has more than
`longest` words.

What cannot be prolonged only on the right lies inside a maximal repeat, place by place, so the union is
that of the deepest interval of every suffix; enclosing intervals add nothing, and texts such as one word a
million times stay linear. Intervals of three words give the words in repeated three-word windows.

Words are compared as bytes, never by hash. Texts are worked off in chunks of about a megabyte and are
never cut: a text of n words takes about 4 n log2(longest repeat) + 60 n bytes in its task. Nothing is shuffled.

Defined results: a null or empty text, or one without words, has zero counts and fails the base rules
for want of words, as does every short text. Repeated rows get equal results; no rows give no rows. Other
columns play no part, whatever their names. Overlapping places of a repeat count as places.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.textarrays import NOT_SPACE, Texts, byte_table, texts

WINDOW = 3

# The symbols that are counted.
SYMBOLS = byte_table(b"#*$%&|<>")

FOUND = {
    "n_words": "long",
    "word_chars": "long",
    "n_symbols": "long",
    "n_dup_lines": "long",
    "n_repeat_words": "long",
    "n_covered": "long",
    "n_maximal": "long",
    "longest_words": "int",
    "longest_places": "array<int>",
    "spans": "array<struct<start: int, stop: int>>",
}


@dataclass(frozen=True)
class RepetitionRules:
    """Limits of the verdict.

    `least_words`: a shorter repeat is ordinary language. `most_covered_percent`: of the words, in repeats.
    `longest`: words of the longest repeat that is allowed.
    """

    least_words: int = 8
    most_covered_percent: int = 30
    longest: int = 100
    least_text: int = 50
    most_repeat_percent: int = 50


def suffix_array(codes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of their suffixes, and the LCP of each with the one before it.

    A suffix ends with its text. `owner` ascends; texts are ordered by it. Prefix doubling: only places
    that share their rank are sorted again, and the ranks of each round give the LCPs.
    """
    n = len(codes)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    last = np.append(np.flatnonzero(np.diff(owner)), n - 1)
    stop = np.repeat(last + 1, np.diff(np.concatenate([[0], last + 1])))  # where the text of a place ends
    key = owner * (int(codes.max()) + 1) + codes
    order = np.argsort(key, kind="stable")
    fresh = np.ones(n, bool)
    fresh[1:] = key[order][1:] != key[order][:-1]
    rank = np.empty(n, np.int32)
    rank[order] = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]  # the first position among equals
    levels, width = [rank.copy()], 1
    while True:
        shared = ~fresh
        shared[:-1] |= ~fresh[1:]
        at = np.flatnonzero(shared)  # positions whose place is not alone with its rank
        if not len(at):
            break
        places = order[at]
        ahead = places + width
        beyond = np.where(ahead < stop[places], rank[np.minimum(ahead, n - 1)].astype(np.int64) + 1, 0)
        key = rank[places].astype(np.int64) * (n + 1) + beyond
        by = np.argsort(key, kind="stable")
        order[at] = places[by]
        key = key[by]
        first = np.ones(len(at), bool)
        first[1:] = key[1:] != key[:-1]
        fresh[at] = first
        rank[places[by]] = at[np.flatnonzero(first)[np.cumsum(first) - 1]]
        levels.append(rank.copy())
        width *= 2
    common = np.zeros(n, np.int64)
    a, b = order[1:], order[:-1]
    depth = np.zeros(n - 1, np.int64)
    for level in range(len(levels) - 2, -1, -1):  # in the last one no two ranks are equal
        known, x, y = levels[level], a + depth, b + depth
        inside = np.flatnonzero((x < stop[a]) & (y < stop[b]))
        equal = inside[known[x[inside]] == known[y[inside]]]
        # places with equal ranks agree in 2**level words, unless both texts end before, which one text cannot twice
        depth[equal] += 1 << level
    common[1:] = depth
    return order, common


def maximal_repeats(order: np.ndarray, common: np.ndarray, before: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(words, first rank, last rank) of every maximal repeated substring of at least `least` words.

    `before` has a code for the word before each place, one that differs from all for none.
    """
    if len(order) < 2:
        return
    differs = np.zeros(len(order), np.int64)
    np.cumsum(before[order[1:]] != before[order[:-1]], out=differs[1:])
    long = common >= least
    for lo, hi in zip(*_ranges(long), strict=True):  # LCPs of the ranks lo .. hi - 1 reach `least`
        stack: list[tuple[int, int]] = []
        for rank, depth in zip(range(lo, hi + 1), [*common[lo:hi].tolist(), 0], strict=True):
            left = rank - 1
            while stack and stack[-1][0] > depth:
                words, left = stack.pop()
                if differs[rank - 1] > differs[left]:
                    yield words, left, rank - 1
            if depth and (not stack or stack[-1][0] < depth):
                stack.append((depth, left))


def _ranges(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true."""
    edge = np.diff(np.concatenate([[0], flags.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _covered(order: np.ndarray, depth: np.ndarray, least: int) -> np.ndarray:
    """Which words lie in a repeat of at least `least` words; `depth` is that of each rank's deepest interval."""
    n = len(order)
    edges = np.zeros(n + 1, np.int64)
    own = depth >= least
    edges[:n][order[own]] = 1  # a place has one rank
    np.subtract.at(edges, order[own] + depth[own], 1)
    return np.cumsum(edges)[:n] > 0


def _chunk(part: Texts, least: int) -> list[tuple]:
    """The columns of FOUND for the texts of a chunk."""
    n = len(part)
    starts, ends, first = part.spans(NOT_SPACE)
    owner = np.repeat(np.arange(n), np.diff(first))
    raws = [part.raw(i) for i in range(n)]
    known: dict[bytes, int] = {}
    codes = np.fromiter((known.setdefault(w, len(known)) for raw in raws for w in raw.split()), np.int64, len(owner))
    order, common = suffix_array(codes, owner)
    depth = np.maximum(common, np.append(common[1:], 0)) if len(common) else common
    windows, covered = _covered(order, depth, WINDOW), _covered(order, depth, least)
    before = np.empty(len(codes), np.int64)
    before[1:] = codes[:-1]
    heads = first[:-1][np.diff(first) > 0]
    before[heads] = -1
    # every text has a run of ranks of its own, as texts are ordered first
    n_maximal, longest, places = [0] * n, [0] * n, [[] for _ in range(n)]
    best: list[tuple[int, int] | None] = [None] * n
    for words, lo, hi in maximal_repeats(order, common, before, least):
        text = int(owner[order[lo]])
        n_maximal[text] += 1
        if words > longest[text]:
            longest[text], best[text] = words, (lo, hi)
    for text, found in enumerate(best):
        if found is not None:
            places[text] = np.sort(order[found[0] : found[1] + 1] - first[text]).tolist()
    inside = NOT_SPACE[part.data] & ((part.data & 0xC0) != 0x80)

    def totals(flags: np.ndarray, bounds: np.ndarray) -> list[int]:
        sums = np.concatenate([[0], np.cumsum(flags)])
        return np.diff(sums[bounds]).tolist()

    spans = [[{"start": int(a), "stop": int(b)} for a, b in zip(*_ranges(covered[first[i] : first[i + 1]]), strict=True)] for i in range(n)]
    return [
        np.diff(first).tolist(),
        totals(inside, part.offsets),
        totals(SYMBOLS[part.data], part.offsets),
        [_dup_lines(raw) for raw in raws],
        totals(windows, first),
        totals(covered, first),
        n_maximal,
        longest,
        places,
        spans,
    ]


def _dup_lines(raw: bytes) -> int:
    lines = [line for line in raw.split(b"\n") if line.strip()] if b"\n" in raw else []
    return len(lines) - len(set(lines))


def repetition_column(text: Column, least_words: int = RepetitionRules.least_words) -> Column:
    """What a text repeats, as a struct of FOUND.

    `n_maximal` maximal repeats of at least `least_words` words, `longest_words` of the longest one, the first
    words of its places, and the united spans of all, as word numbers from 0.
    """

    def compute(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kinds = [pa.int64()] * 7 + [pa.int32(), pa.list_(pa.int32()), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))]
        for column in batches:
            parts = [_chunk(part, least_words) for part in texts(column)]
            columns = [[v for part in parts for v in part[i]] for i in range(len(kinds))]
            yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], list(FOUND))

    compute.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    fields = ", ".join(f"{name}: {kind}" for name, kind in FOUND.items())
    return F.arrow_udf(compute, f"struct<{fields}>")(text)


def judge_repetition(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: RepetitionRules = RepetitionRules()) -> DataFrame:
    """`id`, the columns of FOUND, `base_failed` and `kept` for every row."""
    found = docs.select(F.col(id_col).alias("id"), repetition_column(F.col(text_col), rules.least_words).alias("found")).select("id", "found.*")
    repeats = F.col("n_repeat_words") * 100 > F.col("n_words") * rules.most_repeat_percent
    passes = (F.col("n_covered") * 100 <= F.col("n_words") * rules.most_covered_percent) & (F.col("longest_words") <= rules.longest)
    judged = found.withColumn("base_failed", (F.col("n_words") < rules.least_text) | repeats)
    return judged.withColumn("kept", ~F.col("base_failed") & passes)
