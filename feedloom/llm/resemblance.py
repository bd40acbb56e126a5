"""Links between texts whose sets of word shingles have a Jaccard similarity of 0.8 or more.

Three differing bits of a SimHash are far fewer than most texts of that similarity have, so a stage
that promises 0.8 needs these links beside those of the trie. Texts with equal shingle sets are one
node. A node has `BANDS` keys, each a hash of `ROWS` minima of its set under fixed scramblings of the
64-bit shingle hashes; nodes that share a key are candidates. Two sets of similarity s share no key
with a probability of (1 - s ** ROWS) ** BANDS: 1.3e-7 at 0.8, less above. Candidates become links
only by the exact similarity of their whole sets.

No group is expanded into all its pairs. First every node of a key is compared with one node of it,
and what links falls into components. Then only nodes of one key that lie in different components
are compared, inside tasks: one pass over the sketches tells which nodes have any pair to be judged
under the key, the first that the two share; a second brings the whole sets of only these together.
Keys with much to compare are dealt out in chunks, each pair of chunks to a task of its own, and what
leaves a task is a spanning forest of its links. Sets are compared if their sizes and their sketches
(two bits of each minimum) allow 0.8: a pair at 0.8 differs in 24 of 240 bits on average, and one
beyond `SKETCH_BITS` is passed over, which is five standard deviations away. What comes back spans the
same components as all links.

Defined results: words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased; a text of fewer words than a
shingle has all of them as its only shingle; a null text or one without a word has no set and no link.
Rows without an id link nothing. Rows that share an id count as one row each and as one node of the
components. Shingles are equal if their 64-bit hashes are. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.components import components, scratch_tables, write_scratch
from feedloom.llm.textarrays import NOT_SPACE, Texts, mix, texts

BANDS, ROWS = 30, 4
SKETCH_LONGS = 4
SKETCH_BITS = 52
#: Bytes of text hashed at once, but never less than one text.
CHUNK = 1 << 18
#: Nodes compared with one node go in portions of this many, each to a task of its own.
PORTION = 256
#: Rows of sketches and hashes of sets that a chunk holds, and pairs that are compared at once.
CHUNK_ROWS, CHUNK_HASHES, PAIRS_AT_ONCE = 1 << 13, 1 << 20, 1 << 16

_draw = np.random.default_rng(20260110)
_FLIP = _draw.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
_TIMES = _draw.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _draw.integers(0, 2**63, (BANDS, 1), dtype=np.uint64)
_ROW = _draw.integers(0, 2**63, (1, ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE = _draw.integers(0, 2**63, 256, dtype=np.uint64)
_STEP = np.uint64(0xD1342543DE82EF95)
_NEAR = np.multiply.accumulate(np.full(4096, 0x9E3779B97F4A7C15, np.uint64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

SKETCH = f"node binary, size int, keys array<bigint>, {', '.join(f's{i} bigint' for i in range(SKETCH_LONGS))}"


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each word; needs no table as long as the text."""
    if not len(starts):
        return np.empty(0, np.uint64)
    length = ends - starts
    begin = np.cumsum(length) - length
    at = np.arange(int(length.sum())) - np.repeat(begin, length)
    far = np.multiply.accumulate(np.full(int(length.max()) // len(_NEAR) + 1, _STEP, np.uint64))
    weighted = _BYTE[data[at + np.repeat(starts, length)]] * _NEAR[at % len(_NEAR)] * far[at // len(_NEAR)]
    return mix(np.add.reduceat(weighted, begin) + length.astype(np.uint64))


def _runs(words: np.ndarray, length: int) -> np.ndarray:
    """A hash of every run of `length` consecutive words."""
    n = len(words) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.full(n, length, np.uint64)
    for k in range(length):
        total = mix(total + words[k : k + n]) * _STEP
    return mix(total)


def shingle_sets(part: Texts, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, ascending, one text after another, and where each text begins."""
    lowered = Texts(part.first, _LOWER[part.data], part.offsets)
    starts, ends, first = lowered.spans(NOT_SPACE)
    words = _word_hashes(lowered.data, starts, ends)
    n = np.diff(first)
    owner = np.repeat(np.arange(len(part)), n)
    hashes = _runs(words, shingle)
    whole = owner[: len(hashes)] == owner[shingle - 1 :] if len(hashes) else np.empty(0, bool)
    hashes, owner = hashes[whole], owner[: len(hashes)][whole]
    short = np.flatnonzero((n > 0) & (n < shingle))
    if len(short):
        alone = np.array([_runs(words[first[i] : first[i + 1]], int(n[i]))[0] for i in short], np.uint64)
        hashes, owner = np.concatenate([hashes, alone]), np.concatenate([owner, short])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(len(part) + 1))


def _digests(hashes: np.ndarray, begin: np.ndarray, some: np.ndarray) -> list[bytes]:
    """Sixteen bytes for each of some sets, none of them empty; equal sets have equal ones."""
    if not len(some):
        return []
    sums = [np.add.reduceat(mix(hashes ^ np.uint64(c)), begin[some]) for c in (0x5BD1E995, 0x27D4EB2F)]
    raw = np.column_stack([mix(sums[0] + np.diff(begin)[some].astype(np.uint64)), sums[1]]).astype("<u8").tobytes()
    return [raw[at : at + 16] for at in range(0, len(raw), 16)]


def _sketches(part: Texts, shingle: int) -> pa.StructArray:
    hashes, begin = shingle_sets(part, shingle)
    size = np.diff(begin)
    some = np.flatnonzero(size)
    at = begin[some]
    least = np.empty((BANDS * ROWS, len(some)), np.uint64)
    for k in range(BANDS * ROWS if len(some) else 0):
        least[k] = np.minimum.reduceat((hashes ^ _FLIP[k]) * _TIMES[k], at)
    keys = mix((mix(least).reshape(BANDS, ROWS, len(some)) * _ROW).sum(axis=1, dtype=np.uint64) + _BAND)
    bits = np.stack([(mix(least) >> np.uint64(j)) & np.uint64(1) for j in (20, 40)]).reshape(2 * BANDS * ROWS, len(some)).astype(np.uint8)
    padded = np.zeros((64 * SKETCH_LONGS, len(some)), np.uint8)
    padded[: len(bits)] = bits
    sketch = np.ascontiguousarray(np.packbits(padded.T, axis=1, bitorder="little")).view(np.uint64)
    nodes = pa.array(_digests(hashes, begin, some), pa.binary())
    place = np.full(len(part), -1)
    place[some] = np.arange(len(some))
    taken = pa.array(place, mask=place < 0)
    offsets = pa.array(np.arange(len(some) + 1) * BANDS, pa.int32())
    fields = [nodes, pa.array(size[some], pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(keys.T.ravel().view(np.int64)))]
    fields += [pa.array(np.ascontiguousarray(sketch[:, i]).view(np.int64)) for i in range(SKETCH_LONGS)]
    names = ["node", "size", "keys", *(f"s{i}" for i in range(SKETCH_LONGS))]
    return pa.StructArray.from_arrays([f.take(taken) for f in fields], names)


def sketches(rows: DataFrame, shingle: int = 5) -> DataFrame:
    """`id, node, size, keys, s0..` for rows `id, text`; rows whose text has no shingle go. Small batches leave, texts stay behind."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id")
            for part in texts(batch.column("text"), CHUNK):
                found = _sketches(part, shingle)
                kept = found.field("node").is_valid()
                columns = [ids.slice(part.first, len(part)), *found.flatten()]
                yield pa.RecordBatch.from_arrays(columns, ["id", *(f.name for f in found.type)]).filter(kept)

    return rows.select("id", "text").mapInArrow(compute, f"id {rows.schema['id'].dataType.simpleString()}, {SKETCH}")


def _set_batches(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """`node, hashes` for rows `node, text` whose text has the set the node stands for."""
    for batch in batches:
        wanted = batch.column("node")
        for part in texts(batch.column("text"), CHUNK):
            hashes, begin = shingle_sets(part, shingle)
            some = np.flatnonzero(np.diff(begin))
            own = dict(zip(some.tolist(), _digests(hashes, begin, some), strict=True))
            nodes = wanted.slice(part.first, len(part))
            sets = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(hashes.view(np.int64)))
            same = pa.array([own.get(i) == n for i, n in enumerate(nodes.to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([nodes, sets], ["node", "hashes"]).filter(same)


def similar_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """Links `a, b` of ids that span the same components as all pairs of at least that similarity.

    `similarity` is 0.8 at least, which is what the number of keys is made for.
    """
    if not 0.8 <= similarity <= 1:
        raise ValueError("the similarity is 0.8 to 1")
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id is not null")
    with scratch_tables(docs.sparkSession) as write:
        return write_scratch(_links(named, shingle, similarity, write), "links")[0]


def _links(named: DataFrame, shingle: int, similarity: float, write: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    marked = write(sketches(named, shingle), "sketches")
    sketch = [f"s{i}" for i in range(SKETCH_LONGS)]
    classes = marked.groupBy("node").agg(F.min("id").alias("least"), *(F.first(c).alias(c) for c in ("size", "keys", *sketch)))
    nodes = write(classes, "nodes")
    same = marked.join(nodes.select("node", "least"), "node").filter("id <> least").select(F.col("id").alias("a"), F.col("least").alias("b"))

    dealt = nodes.select("node", "size", F.explode("keys").alias("key"))
    centres = dealt.groupBy("key").agg(F.min(F.struct("node", "size")).alias("centre"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = write(dealt.join(centres.select("key", "centre"), "key"), "members")
    fits = F.least("left_size", "right_size") >= F.lit(similarity) * F.greatest("left_size", "right_size")
    stars = members.filter(F.col("node") != F.col("centre.node")).select(
        F.col("centre.node").alias("left"), F.col("node").alias("right"), F.col("centre.size").alias("left_size"), F.col("size").alias("right_size")
    )
    alike = write(_alike(stars.filter(fits).select("left", "right").distinct(), nodes.select("node", *sketch), sketch), "pairs")
    sets = write(_sets(named, nodes, members, shingle), "sets")
    found = write(_verified(alike, sets, similarity), "stars")

    reached = components(found.select(F.col("left").alias("a"), F.col("right").alias("b")))
    placed = write(
        members.join(reached, "node", "left").select("key", "node", "size", F.col("centre.node").alias("centre"), F.coalesce("component", "node").alias("component")),
        "placed",
    )
    torn = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("key")
    rest = placed.join(torn, "key", "left_semi").filter("node <> centre").select("key", "node", "size", "component")
    rest = write(rest.join(nodes.select("node", "keys", *sketch), "node"), "rest")
    open_ = write(_open(rest, similarity), "open")
    more = write(_across(open_, sets, similarity), "more")
    ids = nodes.select("node", "least")
    linked = (
        found.unionByName(more)
        .join(ids.select(F.col("node").alias("left"), F.col("least").alias("a")), "left")
        .join(ids.select(F.col("node").alias("right"), F.col("least").alias("b")), "right")
    )
    return same.unionByName(linked.select("a", "b"))


def _dealt(rows: DataFrame, weight: Column, limit: int) -> DataFrame:
    """The rows with `bin, k, l, own`: the rows of a key lie in chunks of about `limit`, each pair of chunks in a group `bin, k, l`.

    Keys that fill no chunk share their bins.
    """
    volume = rows.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    sized = rows.groupBy("key").agg(F.ceil(F.sum(weight) / limit).alias("chunks"))
    return (
        rows.join(sized, "key")
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .withColumn("bin", F.pmod(F.xxhash64("key"), F.lit(max(1, -(-volume // limit)))))
        .select(*rows.columns, "bin", F.least("own", "other").alias("k"), F.greatest("own", "other").alias("l"), "own")
    )


def _sides(keys: np.ndarray, own: np.ndarray, k: int, l: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each key of a group the rows of its one chunk and those of the other, which may be the same."""
    order = np.argsort(keys, kind="stable")
    heads = np.flatnonzero(np.append(True, keys[order][1:] != keys[order][:-1])) if len(keys) else np.empty(0, np.int64)
    for rows in np.split(order, heads[1:]):
        left, right = rows[own[rows] == k], rows[own[rows] == l]
        if len(left) and len(right):
            yield left, right


def _sketched(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the rows of a group the sketches, the sizes and the components as numbers."""
    sketch = np.column_stack([table[f"s{i}"].to_numpy().view(np.uint64) for i in range(SKETCH_LONGS)])
    component = table["component"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    return sketch, table["size"].to_numpy(), component


def _may(sketch: np.ndarray, size: np.ndarray, x: np.ndarray, y: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sizes and sketches of the rows x, y allow the similarity."""
    fits = np.minimum(size[x], size[y]) >= similarity * np.maximum(size[x], size[y])
    return fits & (np.bitwise_count(sketch[x] ^ sketch[y]).sum(axis=-1, dtype=np.int64) <= SKETCH_BITS)


def _open(rest: DataFrame, similarity: float) -> DataFrame:
    """The rows that have a pair to be judged under their key: one of another component that comes near enough.

    A pair is judged under the first key that both have.
    """
    columns = ["key", "node", "size", "component", *(f"s{i}" for i in range(SKETCH_LONGS))]

    def judge(group: tuple, table: pa.Table) -> pa.Table:
        _, k, l = (v.as_py() for v in group)
        table = table.combine_chunks()
        sketch, size, component = _sketched(table)
        keys, own = table["key"].to_numpy(), table["own"].to_numpy()
        bands = table["keys"].combine_chunks().flatten().to_numpy().reshape(len(keys), -1)
        wanted = np.zeros(len(keys), bool)
        for left, right in _sides(keys, own, k, l):
            step = max(1, PAIRS_AT_ONCE // len(right))
            for at in range(0, len(left), step):
                x, y = np.repeat(left[at : at + step], len(right)), np.tile(right, len(left[at : at + step]))
                near = component[x] != component[y]
                x, y = x[near], y[near]
                near = _may(sketch, size, x, y, similarity)
                x, y = x[near], y[near]
                both = bands[x] == bands[y]
                first = bands[x, both.argmax(axis=1)]
                here = (first == keys[x]) | ~both.any(axis=1)
                wanted[x[here]] = wanted[y[here]] = True
        return table.select(columns).filter(pa.array(wanted))

    found = _dealt(rest, F.lit(1), CHUNK_ROWS).groupBy("bin", "k", "l").applyInArrow(judge, rest.select(*columns).schema)
    return found.dropDuplicates(["key", "node"])


def _across(rows: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links `left, right` that, beside the components, span the same as all pairs of one key."""

    def judge(group: tuple, table: pa.Table) -> pa.Table:
        _, k, l = (v.as_py() for v in group)
        table = table.combine_chunks()
        sketch, size, component = _sketched(table)
        lists = table["hashes"].combine_chunks()
        flat, offsets = lists.flatten().to_numpy(), np.append(0, np.cumsum(size))
        out: list[tuple[int, int]] = []
        for left, right in _sides(table["key"].to_numpy(), table["own"].to_numpy(), k, l):
            out += _forest(flat, offsets, sketch, size, component, left, right, similarity)
        pairs = np.array(out, np.int64).reshape(-1, 2)
        nodes = table["node"].combine_chunks()
        return pa.table({"left": nodes.take(pa.array(pairs[:, 0])), "right": nodes.take(pa.array(pairs[:, 1]))})

    dealt = _dealt(rows, F.col("size"), CHUNK_HASHES).join(sets, "node")
    return dealt.groupBy("bin", "k", "l").applyInArrow(judge, "left binary, right binary").distinct()


def _forest(
    flat: np.ndarray, offsets: np.ndarray, sketch: np.ndarray, size: np.ndarray, component: np.ndarray, left: np.ndarray, right: np.ndarray, similarity: float
) -> list[tuple[int, int]]:
    """Links between the rows left and right that join different components; row i has the set flat[offsets[i]:offsets[i + 1]]."""
    rows = np.union1d(left, right)
    numbers = np.unique(np.concatenate([flat[offsets[i] : offsets[i + 1]] for i in rows.tolist()]), return_inverse=True)[1]
    begin = np.cumsum(size[rows]) - size[rows]
    sets = [numbers[b : b + n] for b, n in zip(begin.tolist(), size[rows].tolist(), strict=True)]
    label = component[rows].copy()  # grows together as links are found
    left, right = np.searchsorted(rows, left), np.searchsorted(rows, right)
    held = np.zeros(int(numbers.max()) + 1, bool)
    out = []
    for x in left.tolist():
        y = right[label[right] != label[x]]
        y = y[_may(sketch, size, np.full(len(y), rows[x]), rows[y], similarity)]
        if not len(y):
            continue
        held[sets[x]] = True
        theirs = size[rows[y]]
        shared = np.add.reduceat(held[np.concatenate([sets[i] for i in y.tolist()])], np.cumsum(theirs) - theirs, dtype=np.int64)
        held[sets[x]] = False
        y = y[shared / (len(sets[x]) + theirs - shared) >= similarity]
        others, one = np.unique(label[y], return_index=True)
        out += [(int(rows[x]), i) for i in rows[y[one]].tolist()]
        if len(others):
            label[np.isin(label, others)] = label[x]
    return out


def _close(sketch: list[str]) -> Column:
    differing = (F.bit_count(F.col(f"left_{c}").bitwiseXOR(F.col(f"right_{c}"))) for c in sketch)
    return sum(differing, start=F.lit(0)) <= SKETCH_BITS


def _alike(pairs: DataFrame, nodes: DataFrame, sketch: list[str]) -> DataFrame:
    """The pairs `left, right` whose sketches allow the similarity."""
    for side in ("left", "right"):
        pairs = pairs.join(nodes.select(F.col("node").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in sketch)), side)
    return pairs.filter(_close(sketch)).select("left", "right")


def _sets(named: DataFrame, nodes: DataFrame, members: DataFrame, shingle: int) -> DataFrame:
    """`node, hashes`: the shingle set of each candidate; of rows that share an id, from one that has it."""
    wanted = nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", F.col("least").alias("id"))

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _set_batches(batches, shingle)

    found = named.join(wanted, "id").select("node", "text").mapInArrow(compute, "node binary, hashes array<bigint>")
    return found.dropDuplicates(["node"])


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Of node pairs `left, right` those whose sets are similar enough; a node of many pairs meets them in portions."""
    portions = pairs.groupBy("left").agg(F.ceil(F.count(F.lit(1)) / PORTION).alias("portions"))
    lefts = portions.join(sets.select(F.col("node").alias("left"), F.col("hashes").alias("left_set")), "left")
    lefts = lefts.select("left", "left_set", F.explode(F.sequence(F.lit(0), F.col("portions") - 1)).alias("portion"))
    dealt = pairs.join(portions, "left").select("left", "right", F.pmod(F.xxhash64("right"), F.col("portions")).alias("portion"))
    both = dealt.join(sets.select(F.col("node").alias("right"), F.col("hashes").alias("right_set")), "right").join(lefts, ["left", "portion"])
    shared = F.size(F.array_intersect("left_set", "right_set"))
    judged = both.select("left", "right", (shared / (F.size("left_set") + F.size("right_set") - shared)).alias("similarity"))
    return judged.filter(F.col("similarity") >= similarity).select("left", "right")
