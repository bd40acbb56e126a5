"""A Merkle manifest of a table, by time-forward processing.

Rows are leaves; those of a source are ordered by id, and runs of three digests are hashed to their parent until
one is left, the subroot. Subroots, ordered by source, give the root in the same way.

A tree is a circuit whose nodes are labelled so that a parent comes after its children. Time-forward
processing takes the nodes in the order of their labels off a priority queue: the messages with the
smallest label are the child digests of one node; its own digest goes back into the queue under the label of
its parent. The queue is external: what one task holds is a block of `3 ** height` consecutive digests of
a tree, with a heap of its own; a block leaves one message, and the messages of all blocks are a table in
the shared folder that is dealt out again by (tree, block) for the next `height` levels. A reversed
sweep goes through the same tables from the root down: the queue is ordered by falling label, and a message is the
proof of a node, that is the siblings at every level above it. A node hands its proof on, with the siblings
of each child in front, until the proofs reach the leaves.

A task never holds more than one block, and a table of n leaves takes log(n) / log(3 ** height) rounds up
and as many down. Positions come from a range sort over a total order, so that no source can be hot.

Defined results: any column may be null, rows without an id come first in their source, and rows that
share an id are ordered by digest. Equal rows are leaves of their own. A source of one row has that leaf as its subroot,
a table of one source its subroot as the root. No rows give no rows. Further columns play no part.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.components import write_scratch

ARITY = 3
HEIGHT = 5

_ROW_BITS = 33  # monotonically_increasing_id() keeps the partition number above these
_NO_PROOF = "cast(array() as array<struct<left: string, right: string>>)"


def digest_of(*columns: Column) -> Column:
    """Hex SHA-256 of values one after another: `-` for null, else UTF-8 byte count, `:` and the value."""
    texts = [c.cast("string") for c in columns]
    fields = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*fields).cast("binary"), 256)


def proof_digest(proof: Column) -> Column:
    """Hex SHA-256 of the siblings of a proof, level by level."""
    siblings = F.transform(proof, lambda s: F.concat(s["left"], s["right"]))
    return F.sha2(F.array_join(siblings, "").cast("binary"), 256)


def refold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf gives with the siblings of a proof."""
    up = lambda digest, s: F.sha2(F.concat(s["left"], digest, s["right"]).cast("binary"), 256)
    return F.aggregate(proof, leaf, up)


def merkle_proofs(leaves: DataFrame, id_col: str, source_col: str, leaf_col: str, height: int = HEIGHT) -> DataFrame:
    """`leaves` with `proof`, its siblings from the leaf's level up to the root, `subroot` and `root`.

    `leaf_col` has the hex digests; the other columns are passed on and should be narrow. Columns of `leaves` may have
    any names but `proof`, `subroot` and `root`.
    """
    key = F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("n"))  # null first, then bytewise
    own = leaves.select(key.alias("tree"), F.col(leaf_col).alias("digest"), F.struct(F.col(id_col).alias("id"), leaf_col).alias("place"), F.struct(*leaves.columns).alias("row"))
    # the row number makes the order total: equal rows may be many
    written, _ = write_scratch(own.withColumn("number", F.monotonically_increasing_id()), "leaves")
    nodes = _positions(written, ["tree", "place", "number"]).select("tree", "index", "size", "digest", "row")
    rounds, subroots = _forward(nodes, height)
    tops = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("source"), "digest")
    top_nodes = _positions(tops, ["tree", "source"]).select("tree", "index", "size", "digest", "source")
    top_rounds, root = _forward(top_nodes, height)
    start = root.select("tree", F.expr(_NO_PROOF).alias("proof"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    above = _backward(top_rounds, start, height).select(F.col("source").alias("tree"), "proof", F.col("digest").alias("subroot"), "root")
    return _backward(rounds, write_scratch(above, "above")[0], height).select("row.*", "proof", "subroot", "root")


def _positions(rows: DataFrame, order: list[str]) -> DataFrame:
    """`rows` with `index`, the place in their tree, and `size`, that tree's number of rows; the order must be total.

    Rows are numbered by range; of every tree only one count for each partition it lies in is brought together.
    """
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered, _ = write_scratch(ordered.withColumn("at", F.monotonically_increasing_id()), "ordered")
    numbered = numbered.withColumn("part", F.shiftright("at", _ROW_BITS))
    counts = numbered.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    tree = Window.partitionBy("tree")
    earlier = F.coalesce(F.sum("n").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("tree", "part", (earlier - F.col("first")).alias("shift"), F.sum("n").over(tree).alias("size"))
    return numbered.join(offsets, ["tree", "part"]).withColumn("index", F.col("at") + F.col("shift"))


def levels_of(size: int) -> int:
    """Levels above `size` nodes until one is left."""
    levels = 0
    while size > 1:
        size = -(-size // ARITY)
        levels += 1
    return levels


def sweep_up(digests: list[tuple[int, str]], levels: int) -> tuple[str, list[tuple[int, int, list[tuple[int, str]]]]]:
    """The digest `levels` above some nodes, (index, digest) each, and all runs as (level, parent, children).

    The heap is the part of the queue that one block needs.
    """
    queue = [(0, index, digest) for index, digest in sorted(digests)]  # sorted is a heap
    made = []
    while queue[0][0] < levels:
        level, index, digest = heapq.heappop(queue)
        parent = index // ARITY
        children = [(index, digest)]
        while queue and queue[0][0] == level and queue[0][1] // ARITY == parent:
            children.append(heapq.heappop(queue)[1:])
        made.append((level + 1, parent, children))
        heapq.heappush(queue, (level + 1, parent, sha256("".join(d for _, d in children).encode()).hexdigest()))
    return queue[0][2], made


def sweep_down(made: list[tuple[int, int, list[tuple[int, str]]]], proof: list[tuple[str, str]]) -> dict[int, list[tuple[str, str]]]:
    """The proofs of the nodes that a block began with, by index; `proof` is that of its topmost node."""
    runs = {(level, parent): children for level, parent, children in made}
    top = made[-1]
    queue = [(-top[0], -top[1], proof)]
    found = {}
    while queue:
        level, parent, above = heapq.heappop(queue)
        children = runs[-level, -parent]
        for k, (index, _) in enumerate(children):
            left, right = ("".join(d for _, d in part) for part in (children[:k], children[k + 1 :]))
            below = [(left, right), *above]
            if level == -1:
                found[index] = below
            else:
                heapq.heappush(queue, (level + 1, -index, below))
    return found


def _levels(size: int, height: int) -> int:
    return levels_of(size) if size <= ARITY**height else height


def _forward(nodes: DataFrame, height: int) -> tuple[list[DataFrame], DataFrame]:
    """The nodes at the start of every round, dealt into blocks, and `tree, digest` of the roots."""
    span = ARITY**height
    block = F.expr(f"`index` div {span}").alias("block")

    def up(table: pa.Table) -> pa.Table:
        size = table["size"][0].as_py()
        digest, _ = sweep_up(list(zip(table["index"].to_pylist(), table["digest"].to_pylist(), strict=True)), _levels(size, height))
        columns = [table["tree"][:1].combine_chunks(), table["block"][:1].combine_chunks(), pa.array([-(-size // span)]), pa.array([digest]), pa.array([size <= span])]
        return pa.table([c.cast(t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()), strict=True)], ["tree", "index", "size", "digest", "done"])

    now, _ = write_scratch(nodes.select("*", block), "nodes")
    rounds, ends = [now], []
    largest = now.agg(F.max("size")).first()[0] or 0
    while True:
        narrow = now.select("tree", "index", "size", "digest", "block")
        made, _ = write_scratch(narrow.groupBy("tree", "block").applyInArrow(up, "tree string, index long, size long, digest string, done boolean"), "messages")
        ends.append(made.filter("done").select("tree", "digest"))
        if largest <= span:
            break
        largest = -(-largest // span)
        now = made.filter("not done").select("tree", "index", "size", "digest", block)
        rounds.append(now)
    roots = ends[0]
    for end in ends[1:]:
        roots = roots.unionAll(end)
    return rounds, roots


def _hand_down(names: list[str], height: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """For a block of nodes and the message for its topmost one: the nodes, each with its proof."""

    def down(table: pa.Table, message: pa.Table) -> pa.Table:
        table = table.sort_by("index")
        size, index = table["size"][0].as_py(), table["index"].to_pylist()
        own = [(s["left"], s["right"]) for s in message["proof"][0].as_py()]
        _, made = sweep_up(list(zip(index, table["digest"].to_pylist(), strict=True)), _levels(size, height))
        found = sweep_down(made, own) if made else {index[0]: own}
        pairs = [pair for i in index for pair in found[i]]
        ends = np.cumsum([0, *(len(found[i]) for i in index)])
        sides = [pa.array([pair[k] for pair in pairs], pa.string()) for k in (0, 1)]
        proofs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(sides, ["left", "right"]))
        columns = {name: table[name] for name in names if name in table.column_names} | {"proof": proofs}
        columns |= {name: pa.array([message[name][0].as_py()] * len(index), pa.string()) for name in ("subroot", "root")}
        return pa.table(columns).select(names)

    return down


def _backward(rounds: list[DataFrame], above: DataFrame, height: int) -> DataFrame:
    """The nodes of the first round with their proofs; `above` has those of the roots, by tree."""
    span = ARITY**height
    messages = None
    for nodes in reversed(rounds):
        ended = nodes.filter(F.col("size") <= span).select(F.col("tree").alias("ended")).distinct()
        here = ended.join(above, F.col("ended") == F.col("tree")).drop("ended").withColumn("block", F.lit(0).cast("long"))
        messages = here if messages is None else here.unionByName(messages)
        columns = [c for c in nodes.columns if c != "block"]
        empty = nodes.select(*columns, F.expr(_NO_PROOF).alias("proof"), *[F.lit(None).cast("string").alias(n) for n in ("subroot", "root")])
        found = nodes.groupBy("tree", "block").cogroup(messages.groupBy("tree", "block")).applyInArrow(_hand_down(empty.columns, height), empty.schema)
        if nodes is rounds[0]:
            return found
        done, _ = write_scratch(found.select("tree", F.col("index").alias("block"), "proof", "subroot", "root"), "proofs")
        messages = done
    raise AssertionError("there is always a first round")
