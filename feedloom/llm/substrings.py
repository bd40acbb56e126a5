"""Exact substring deduplication with prefix-partitioned suffix trees.

A window is `WINDOW` consecutive words of a text. A word goes if a window that covers it also starts
in a row with a smaller id.

Carrying every suffix to the group of its prefix would copy each text fifty times, so the tree is a
sparse one. Of the suffixes that start in the first 43 words of a window, the one whose first eight
words have the smallest hash is the window's anchor. Equal windows have equal anchors, so the suffix
trees need only the suffixes that start at anchors, about one word in twenty; each carries the words
before it that its windows reach back to. The prefix by which suffixes are dealt out is the anchor's
eight words. Prefixes that occur in one row only are left out before any suffix is built; the others
are put together to groups of about `group_rows` suffixes. In a group the suffixes are sorted, which
with the common prefixes of neighbours is the suffix tree in array form; the internal nodes at the
depth that a window needs after its anchor, together with equal words before it, are the repeats.

A prefix that more than `hot_rows` rows share is lengthened to the whole window instead: a node is
then one key, whose smallest id is aggregated map-side and joined back, which adaptive execution can
split: by the SHA-256 of its words. Rows that repeat a whole text are set aside first and never reach
a tree, by the SHA-256 of their words, too. In the trees words are compared as bytes; hashes only deal suffixes out.

Defined results: a null text has no words. Texts of fewer than 50 words lose nothing. Rows without an
id neither lose words nor take them from others. Rows that share an id do not take words from each
other; each loses what smaller ids have. No rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.components import write_scratch
from feedloom.llm.textarrays import NOT_SPACE, run_hashes, texts

WINDOW = 50
PREFIX = 8
SPAN = WINDOW - PREFIX + 1  # starts that an anchor may have in its window


def anchors(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows, the anchor of each, and the hash of the first words at every place."""
    leads = run_hashes(hashes, PREFIX)
    left = np.repeat(first[1:], np.diff(first)) - np.arange(len(hashes))
    starts = np.flatnonzero(left >= WINDOW)
    if not len(starts):
        return starts, starts, leads
    least, at = leads, np.arange(len(leads), dtype=np.int32)
    width = 1
    while width < SPAN:
        step = min(width, SPAN - width)
        a, b = least[:-step], least[step:]
        take = b < a  # the first of equals stays
        least, at = np.where(take, b, a), np.where(take, at[step:], at[:-step])
        width += step
    return starts, at[starts].astype(np.int64), leads


def _profile(text: Column) -> Column:
    """Of a text column: n_words, digest of the words joined by single spaces, prefixes of all anchors."""

    def compute(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            n_words, digests, prefixes, sizes = [], [], [np.empty(0, np.int64)], []
            for part in texts(column):
                starts, ends, first = part.spans(NOT_SPACE)
                for i in range(len(part)):
                    digests.append(hashlib.sha256(b" ".join(part.raw(i).split())).digest())
                n_words += np.diff(first).tolist()
                begins, at, leads = anchors(part.span_hashes(starts, ends), first)
                owner = np.searchsorted(first, begins, "right") - 1
                change = np.ones(len(at), bool)
                change[1:] = (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])
                pairs = np.unique(np.column_stack([owner[change], leads[at[change]].view(np.int64)]), axis=0) if len(at) else np.empty((0, 2), np.int64)
                prefixes.append(pairs[:, 1])
                sizes += np.bincount(pairs[:, 0], minlength=len(part)).tolist()
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32) if sizes else np.zeros(1, np.int32)
            yield pa.StructArray.from_arrays(
                [pa.array(n_words, pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(prefixes)))],
                ["n_words", "digest", "prefixes"],
            )

    compute.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(compute, "struct<n_words: long, digest: binary, prefixes: array<long>>")(text)


SUFFIX = "prefix long, hot boolean, id long, part long, begins array<int>, back int, ahead int, before binary, after binary"


def _suffixes(batches):
    """Suffixes at the anchors that a row shares with others, once for each distinct surrounding.

    `begins`: where the suffix starts; its windows begin `back` down to `back - ahead` words before.
    `before` has the words before it, `after` its own words, with the spaces between them.
    """
    for batch in batches:
        ids, parts = batch.column("id").to_pylist(), batch.column("part").to_pylist()
        out: list[tuple] = []
        for part in texts(batch.column("text")):
            starts, ends, first = part.spans(NOT_SPACE)
            hashes = part.span_hashes(starts, ends)
            begins, at, leads = anchors(hashes, first)
            if not len(at):
                continue
            owner = np.searchsorted(first, begins, "right") - 1
            change = np.ones(len(at), bool)
            change[1:] = (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])
            head = np.flatnonzero(change)
            tail = np.append(head[1:], len(at)) - 1
            marks = leads[at[head]].view(np.int64)
            for i in range(len(part)):
                row = part.first + i
                lo, hi = np.searchsorted(owner[head], [i, i + 1])
                if lo == hi:
                    continue
                own = marks[lo:hi]
                cold, hot = (np.asarray(batch.column(c)[row].as_py() or [], np.int64) for c in ("cold", "hot"))
                is_hot = np.isin(own, hot)
                seen: dict[tuple, list[int]] = {}
                for k in (np.flatnonzero(is_hot | np.isin(own, cold)) + lo).tolist():
                    q, s, e = int(at[head[k]]), int(begins[head[k]]), int(begins[tail[k]])
                    before, after = part.data[starts[s] : starts[q]].tobytes(), part.data[starts[q] : ends[e + WINDOW - 1]].tobytes()
                    seen.setdefault((int(marks[k]), bool(is_hot[k - lo]), q - s, e - s, before, after), []).append(q - int(first[i]))
                out += [(m, h, ids[row], parts[row], places, back, ahead, before, after) for (m, h, back, ahead, before, after), places in seen.items()]
        columns = list(zip(*out, strict=True)) if out else [[] for _ in range(9)]
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [f.split()[0] for f in SUFFIX.split(", ")])


def _coded(column: pa.Array, width: int, known: dict[bytes, int], nearest_first: bool = False) -> np.ndarray:
    """Codes of the words of binary values, a row for each, filled up with zeros; equal words have one code."""
    values = column.to_pylist()
    out = np.zeros((len(values), width), np.uint32)
    for i, v in enumerate(values):
        words = v.split()
        row = [known.setdefault(w, len(known) + 1) for w in (reversed(words) if nearest_first else words)]
        out[i, : len(row)] = row
    return out


def _contexts(before: np.ndarray) -> np.ndarray:
    """Numbers for the first 0, 1, .. words before each anchor, a column for each; equal words have one number."""
    out = np.zeros((len(before), SPAN), np.int64)
    for a in range(1, SPAN):
        pairs = out[:, a - 1] * (1 << 32) + before[:, a - 1]
        out[:, a] = np.unique(pairs, return_inverse=True)[1]
    return out


def repeats(prefix: np.ndarray, ids: np.ndarray, back: np.ndarray, ahead: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """flag[i, a]: the window that begins a words before suffix i is in a row with a smaller id."""
    n = len(ids)
    flags = np.zeros((n, SPAN), bool)
    if n < 2:
        return flags
    keys = np.concatenate([(prefix.view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").view(np.uint8).reshape(n, 8), after.astype(">u4").view(np.uint8).reshape(n, -1)], axis=1)
    order = np.argsort(np.ascontiguousarray(keys).view(f"S{keys.shape[1]}").ravel(), kind="stable")
    prefix, ids, back, ahead, before, after = (v[order] for v in (prefix, ids, back, ahead, before, after))
    same = after[1:] == after[:-1]
    common = np.where(same.all(axis=1), WINDOW, same.argmin(axis=1))  # the longest common prefix of neighbours
    common[prefix[1:] != prefix[:-1]] = -1
    context = _contexts(before)
    for a in range(SPAN):
        rows = np.flatnonzero((a <= back) & (a >= back - ahead))
        if len(rows) < 2:
            continue
        node = np.concatenate([[0], np.cumsum(common < WINDOW - a)])[rows]
        own, key = ids[rows], context[rows, a]
        by = np.lexsort((own, key, node))
        fresh = np.ones(len(by), bool)
        fresh[1:] = (node[by][1:] != node[by][:-1]) | (key[by][1:] != key[by][:-1])
        heads = np.flatnonzero(fresh)
        least = np.repeat(own[by][heads], np.diff(np.append(heads, len(by))))
        flags[order[rows[by]], a] = own[by] > least
    return flags


RANGE = "id long, part long, start int, stop int"


def _ranges(ids, parts, begins, flags) -> pa.Table:
    """Word ranges of the flagged windows, at every place of each suffix."""
    out: list[tuple] = []
    for i in np.flatnonzero(flags.any(axis=1)).tolist():
        own = np.flatnonzero(flags[i])
        cuts = np.flatnonzero(np.diff(own) > 1)
        spans = list(zip(own[np.append(0, cuts + 1)].tolist(), own[np.append(cuts, len(own) - 1)].tolist(), strict=True))
        out += [(ids[i], parts[i], q - high, q - low + WINDOW) for q in begins[i] for low, high in spans]
    columns = list(zip(*out, strict=True)) if out else [[] for _ in range(4)]
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["id", "part", "start", "stop"])


def _tree_group(table: pa.Table) -> pa.Table:
    table = table.combine_chunks()
    whole = lambda c: table[c].to_numpy()
    known: dict[bytes, int] = {}
    before, after = _coded(table["before"], SPAN, known, nearest_first=True), _coded(table["after"], WINDOW, known)
    flags = repeats(whole("prefix"), whole("id"), whole("back"), whole("ahead"), before, after)
    return _ranges(whole("id").tolist(), whole("part").tolist(), table["begins"].to_pylist(), flags)


def _whole_windows(batches):
    """The windows of hot suffixes, each with the digest of its words."""
    for batch in batches:
        rows, keys, shifts = [], [], []
        columns = (batch.column(c).to_pylist() for c in ("back", "ahead", "before", "after"))
        for i, (back, ahead, before, after) in enumerate(zip(*columns, strict=True)):
            words = before.split() + after.split()
            for a in range(back - ahead, back + 1):
                rows.append(i)
                shifts.append(a)
                keys.append(hashlib.sha256(b" ".join(words[back - a : back - a + WINDOW])).digest())
        taken = [batch.column(c).take(pa.array(rows, pa.int32())) for c in ("prefix", "id", "part", "begins")]
        yield pa.RecordBatch.from_arrays([*taken, pa.array(shifts, pa.int32()), pa.array(keys, pa.binary())], ["prefix", "id", "part", "begins", "shift", "key"])


def _removals(docs: DataFrame, base: DataFrame, group_rows: int, hot_rows: int) -> DataFrame:
    """`id, part, spans` for the rows that share windows with smaller ids; `docs` has id, part and text."""
    shared = base.select("id", "part", F.explode("prefixes").alias("prefix"))
    held = shared.groupBy("prefix").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.lit(1)).alias("n")).filter("low < high").select("prefix", (F.col("n") > hot_rows).alias("hot"), "n")
    mine = shared.join(held, "prefix")
    wanted, _ = write_scratch(
        mine.groupBy("id", "part").agg(
            F.collect_list(F.when(~F.col("hot"), F.col("prefix"))).alias("cold"), F.collect_list(F.when(F.col("hot"), F.col("prefix"))).alias("hot"), F.count(F.lit(1)).alias("n")
        ),
        "wanted",
    )
    volume = wanted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.size("hot")), F.lit(0))).first()
    groups = max(1, -(-volume[0] // group_rows))
    suffixes = docs.join(wanted, ["id", "part"]).select("id", "part", "text", "cold", "hot").mapInArrow(_suffixes, SUFFIX)
    ranges = suffixes.filter(~F.col("hot")).withColumn("group", F.pmod(F.xxhash64("prefix"), F.lit(groups))).groupBy("group").applyInArrow(_tree_group, RANGE)
    if volume[1]:
        hot = suffixes.filter("hot").mapInArrow(_whole_windows, "prefix long, id long, part long, begins array<int>, shift int, key binary")
        least = hot.groupBy("prefix", "key").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most").drop("most")
        found = hot.join(least, ["prefix", "key"]).filter("id > least").select("id", "part", F.explode("begins").alias("q"), "shift")
        ranges = ranges.unionAll(found.select("id", "part", (F.col("q") - F.col("shift")).alias("start"), (F.col("q") - F.col("shift") + WINDOW).alias("stop")))
    return ranges.groupBy("id", "part").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))


CUT = "id long, part long, n_removed long, kept_digest binary, kept string"


def _cutter(with_text: bool):
    def cut(batches):
        for batch in batches:
            ids, parts, spans = (batch.column(c).to_pylist() for c in ("id", "part", "spans"))
            out: list[tuple] = []
            for chunk in texts(batch.column("text")):
                for i in range(len(chunk)):
                    row = chunk.first + i
                    words = chunk.raw(i).split()
                    gone = np.zeros(len(words) + 1, np.int64)
                    for span in spans[row]:
                        gone[span["start"]] += 1
                        gone[span["stop"]] -= 1
                    stays = np.cumsum(gone)[:-1] == 0
                    kept = b" ".join([w for w, s in zip(words, stays.tolist(), strict=True) if s])
                    out.append((ids[row], parts[row], int(len(words) - stays.sum()), hashlib.sha256(kept).digest(), kept.decode("utf-8", "replace") if with_text else None))
            columns = list(zip(*out, strict=True)) if out else [[] for _ in range(5)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()), strict=True)], ["id", "part", "n_removed", "kept_digest", "kept"])

    return cut


def substring_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, group_rows: int = 30_000, hot_rows: int = 200_000
) -> DataFrame:
    """`id, n_words, n_removed, kept_sha256` for every row, ids as longs.

    With `with_text` also `kept`: the words left, joined by single spaces, where words went; null for
    rows that keep all their words; and `part`, the XXH64 of the text, which tells rows with one id apart.
    """
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("part"))
    profile = own.select("id", "part", _profile(F.col("text")).alias("p")).select("id", "part", "p.*")
    base, _ = write_scratch(profile, "profile")
    # read back as a table, so that both sides of the join on a digest are dealt out and can be split
    whole, _ = write_scratch(base.filter("n_words >= 50 and id is not null").groupBy("digest").agg(F.min("id").alias("original")), "wholes")
    marked = base.join(whole, "digest", "left")
    originals = base.filter("n_words >= 50").join(whole.withColumn("id", F.col("original")), ["digest", "id"]).dropDuplicates(["id", "part"])
    cut, _ = write_scratch(
        own.join(_removals(own, originals, group_rows, hot_rows), ["id", "part"]).select("id", "part", "spans", "text").mapInArrow(_cutter(with_text), CUT).dropDuplicates(["id", "part"]), "cut"
    )
    copy = F.coalesce(F.col("id") > F.col("original"), F.lit(False))
    empty = hashlib.sha256(b"").digest()
    found = marked.select("id", "part", "n_words", "digest", copy.alias("copy")).join(cut, ["id", "part"], "left")
    columns = [
        "id",
        "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.lower(F.hex(F.when(F.col("copy"), F.lit(empty)).otherwise(F.coalesce("kept_digest", "digest")))).alias("kept_sha256"),
    ]
    return found.select(*columns, *([F.when(F.col("copy"), F.lit("")).otherwise(F.col("kept")).alias("kept"), F.col("part")] if with_text else []))
