"""SimHash fingerprints and near-duplicates by a binary trie self-join.

A fingerprint has 64 bits: a bit is 1 if it is set in over half of the XXH64 hashes (seed 42) of the
text's word shingles. Distinct fingerprints stand in a binary trie; node pairs are traversed
together, their differing bits add up, and a pair ends as soon as its error budget is exceeded.

Of at most three differing bits, one half of the fingerprint holds at most one. So the trie is built
twice, the second time with the halves exchanged, and the budget of the first 32 levels is one bit
instead of three: no pair is lost and few survive the upper levels. The tries are dealt out by
prefix: a fingerprint stays at home under its prefix and visits each prefix one bit below its own.
A prefix with many fingerprints is dealt out in chunks, each pair of chunks to a task of its own.
What leaves a task is a spanning forest of its links, never all pairs of a group.

Defined results: a null or empty text has no shingle and the fingerprint zero, which links like any
other. Rows without an id get a fingerprint and no component, and link nothing. Rows that share an id
count as one document each and as one node. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.components import components, write_scratch
from feedloom.llm.forests import roots
from feedloom.llm.textarrays import texts

SEED = 42
HALF = 32
HASHES_AT_ONCE = 1 << 15
LEAF_PAIRS = 24
PAIRS_AT_ONCE = 1 << 20

_hash = partial(xxhash.xxh64_intdigest, seed=SEED)


def fingerprint(raw: bytes, shingle: int = 3) -> int:
    """Of one text as UTF-8; unsigned."""
    words = raw.lower().split()
    if not words:
        return 0
    body = b" ".join(words)
    if len(words) < shingle:
        hashes = [_hash(body)]
        total, counts = 1, _bit_counts(hashes)
    else:
        ends = list(accumulate(len(w) + 1 for w in words))
        starts = [0, *ends[:-1]]
        total, counts = len(words) - shingle + 1, np.zeros(64, np.int64)
        for at in range(0, total, HASHES_AT_ONCE):
            to = min(total, at + HASHES_AT_ONCE)
            counts += _bit_counts([_hash(body[s : e - 1]) for s, e in zip(starts[at:to], ends[at + shingle - 1 : to + shingle - 1], strict=True)])
    return int(np.packbits(2 * counts > total, bitorder="little").view(np.uint64)[0])


def _bit_counts(hashes: list[int]) -> np.ndarray:
    octets = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
    return np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint_column(text: Column, shingle: int = 3) -> Column:
    """The fingerprint of a text column as a signed long."""

    def compute(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            found = [fingerprint(part.raw(i), shingle) for part in texts(column) for i in range(len(part))]
            yield pa.array(np.array(found, np.uint64).view(np.int64), pa.int64())

    compute.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(compute, "long")(text)


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, errors: int = 3, home_rows: int = 2048, chunk_rows: int = 8192
) -> DataFrame:
    """`id, fingerprint (long), component` for every row; a component is named by its smallest id."""
    marked, _ = write_scratch(docs.select(F.col(id_col).alias("id"), fingerprint_column(F.col(text_col), shingle).alias("fingerprint")), "fingerprints")
    classes = marked.filter("id is not null").groupBy("fingerprint").agg(F.min("id").alias("least"))
    links = near_fingerprints(classes.select("fingerprint"), errors, home_rows, chunk_rows)
    named = links.join(classes.select(F.col("fingerprint").alias("x"), F.col("least").alias("a")), "x").join(
        classes.select(F.col("fingerprint").alias("y"), F.col("least").alias("b")), "y"
    )
    found = components(named.select("a", "b"))
    grouped = classes.join(found, F.col("least") == F.col("node"), "left").select("fingerprint", F.coalesce("component", "least").alias("component"))
    return (
        marked.join(grouped, "fingerprint", "left")
        .select("id", "fingerprint", F.when(F.col("id").isNotNull(), F.col("component")).alias("component"))
    )


def near_fingerprints(fingerprints: DataFrame, errors: int = 3, home_rows: int = 2048, chunk_rows: int = 8192) -> DataFrame:
    """Links `x, y` that span the same components as all pairs at `errors` or fewer differing bits.

    `fingerprints` holds distinct longs. `errors` is 3 at most.
    """
    if not 0 <= errors <= 3:
        raise ValueError("the error budget is 0 to 3 bits")
    known, _ = write_scratch(fingerprints.select("fingerprint"), "distinct")
    bits = min(24, max(4, (known.count() // home_rows).bit_length()))
    turned = known.select(F.explode(F.array(*(F.struct(F.lit(t).alias("turn"), _turned(F.col("fingerprint"), t).alias("x")) for t in (0, 1)))).alias("r")).select("r.*")
    prefix = F.shiftrightunsigned("x", 64 - bits)
    lower = [F.when(prefix.bitwiseAND(F.lit(1 << j)) != 0, prefix.bitwiseXOR(F.lit(1 << j))) for j in range(bits)]
    dealt = turned.select("turn", "x", F.posexplode(F.array_compact(F.array(prefix, *lower))).alias("place", "prefix"))
    homes = dealt.filter("place = 0").groupBy("turn", "prefix").agg(F.count(F.lit(1)).alias("n"))
    chunked = (
        dealt.join(homes, ["turn", "prefix"])
        .withColumn("chunks", F.ceil(F.col("n") / chunk_rows))
        .withColumn("own", F.pmod(F.xxhash64("x"), F.col("chunks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("turn", "prefix", F.least("own", "other").alias("k"), F.greatest("own", "other").alias("l"), "own", (F.col("place") == 0).alias("home"), "x")
    )

    def join_group(key: tuple, table: pa.Table) -> pa.Table:
        return _join_group(key, table, errors)

    found = chunked.groupBy("turn", "prefix", "k", "l").applyInArrow(join_group, "turn int, x long, y long")
    return found.select(_turned(F.col("x"), F.col("turn")).alias("x"), _turned(F.col("y"), F.col("turn")).alias("y")).distinct()


def _turned(x: Column, turn) -> Column:
    exchanged = F.shiftleft(x, HALF).bitwiseOR(F.shiftrightunsigned(x, HALF))
    if isinstance(turn, int):
        return exchanged if turn else x
    return F.when(turn == 1, exchanged).otherwise(x)


def _join_group(key: tuple, table: pa.Table, errors: int) -> pa.Table:
    turn, _, k, l = (v.as_py() for v in key)
    x = table["x"].to_numpy().view(np.uint64)
    own, home = table["own"].to_numpy(), table["home"].to_numpy()
    sides = {(c, h): np.flatnonzero((own == c) & (home == h)) for c in {k, l} for h in (True, False)}
    jobs = [(sides[k, True], sides[l, True])] + [(sides[k, True], sides[l, False])] + ([(sides[l, True], sides[k, False])] if k != l else [])
    root = np.arange(len(x))
    for left, right in jobs:
        for a, b in trie_pairs(x[left], x[right], errors, left is right):
            root = roots(len(x), left[a], right[b], root)
    moved = np.flatnonzero(root != np.arange(len(x)))
    signed = x.view(np.int64)
    return pa.table({"turn": pa.array(np.full(len(moved), turn), pa.int32()), "x": signed[moved], "y": signed[root[moved]]})


def trie_pairs(left: np.ndarray, right: np.ndarray, errors: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs at `errors` or fewer differing bits of which the first half holds one at most.

    A trie node is a range of the sorted values; both tries are descended level by level, node pairs
    with few leaves are compared outright, and wide frontiers are worked off piece by piece. With
    `same`, left and right are one set, and each pair comes once.
    """
    if not len(left) or not len(right):
        return
    left_order, right_order = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
    ls, rs = left[left_order], right[right_order]
    ones: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def split(depth: int, lo: np.ndarray, hi: np.ndarray, side: int) -> np.ndarray:
        if depth not in ones:
            bit = np.uint64(63 - depth)
            ones[depth] = tuple(np.concatenate([[0], np.cumsum((v >> bit) & np.uint64(1))]).astype(np.int64) for v in (ls, rs))
        up = ones[depth][side]
        return hi - (up[hi] - up[lo])

    first = np.array([[0, len(ls), 0, len(rs), 0]], np.int64)
    stack = [(0, first)]
    while stack:
        depth, front = stack.pop()
        if len(front) > PAIRS_AT_ONCE:
            stack += [(depth, front[: len(front) // 2]), (depth, front[len(front) // 2 :])]
            continue
        alo, ahi, blo, bhi, err = front.T
        small = (ahi - alo) * (bhi - blo) <= LEAF_PAIRS if depth < 64 else np.ones(len(front), bool)
        if small.any():
            sizes = (bhi - blo)[small]
            count = (ahi - alo)[small] * sizes
            for at, to in _pieces(count):
                owner = np.repeat(np.arange(at, to), count[at:to])
                inner = np.arange(len(owner)) - np.repeat(np.cumsum(count[at:to]) - count[at:to], count[at:to])
                a = alo[small][owner] + inner // sizes[owner]
                b = blo[small][owner] + inner % sizes[owner]
                near = np.bitwise_count(ls[a] ^ rs[b]) <= errors
                if same:
                    near &= a < b
                if near.any():
                    yield left_order[a[near]], right_order[b[near]]
        front = front[~small]
        if not len(front):
            continue
        alo, ahi, blo, bhi, err = front.T
        amid, bmid = split(depth, alo, ahi, 0), split(depth, blo, bhi, 1)
        budget = min(errors, 1) if depth < HALF else errors
        ways = []
        for (a0, a1), (b0, b1), more in (
            ((alo, amid), (blo, bmid), 0), ((amid, ahi), (bmid, bhi), 0), ((alo, amid), (bmid, bhi), 1), ((amid, ahi), (blo, bmid), 1),
        ):
            live = (a1 > a0) & (b1 > b0) & (err + more <= budget)
            if same:
                live &= a0 <= b0
            ways.append(np.column_stack([a0, a1, b0, b1, err + more])[live])
        stack.append((depth + 1, np.concatenate(ways)))


def _pieces(counts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive counts that add up to a bounded number, one count at least."""
    sums = np.cumsum(counts)
    at = 0
    while at < len(counts):
        before = sums[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sums, before + PAIRS_AT_ONCE, "right")))
        yield at, to
        at = to
