"""How far the sources of a language differ in their words, by a quadtree over the group-term count matrix.

The matrix has a row for each (lang, source) group and a column for each kept term of the lang; a cell
is priced at `p = 1 + floor(10**9 * (count + 5) / (N + 5 V))`. Two groups differ by the sum of |p - p'| over
all V columns, a group and its lang by term.

Most cells are zero, and all zero cells of a row have one price. So the matrix is cut into tiles of
about `ROWS` groups and `COLUMNS` terms, dealt out by hash; in a task, the rows of a tile are a K-squared
tree, which marks at every level which quadrants hold anything, down to leaves of `LEAF` by `LEAF` cells.
Two trees, of the groups on either side, are traversed jointly over equal column ranges: where both
quadrants are empty, all their pairs of rows differ by (columns) * |p0 - p0'|, counted at once at that level;
where one holds something both are descended; leaves are compared cell by cell. Frequent terms and large groups come first in a tile,
so that empty quadrants are large.

Counting aggregates inside a task before anything is shuffled. Tiles bound what a task holds, whatever the number of groups or
terms; the pairs of groups of a lang are the result that is asked for. Arithmetic is in whole numbers, prices in decimals.

Defined results: null texts, langs and sources count as ''. A lang without kept terms gives pairs of
value 0. A group alone in its lang has no pairs. Equal values are ranked by the bytes of the item.
Repeated rows count each. No rows give no rows. Further columns play no part.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.components import write_scratch

K = 2
LEAF = 8
ROWS = 64
COLUMNS = 1024
SCALE = 10**9
SMOOTHING = 5

PIECE = 1 << 20
HELD = 300_000  # distinct (group, term) entries after which a task hands its counts on

_TERM_BYTES = [b if chr(b).isalpha() or b > 0x7F else 0x20 for b in range(256)]
_TO_TERMS = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in _TERM_BYTES)

COUNTS = "lang string, source string, term string, n long, df long"


def terms_of(text: str) -> Iterator[list[bytes]]:
    """The terms of a whole text, some at a time: letters and all beyond ASCII, A-Z lower-cased."""
    data = text.encode().translate(_TO_TERMS)
    at = 0
    while at < len(data):
        to = data.find(b" ", at + PIECE)
        to = len(data) if to < 0 else to
        yield data[at:to].split()
        at = to


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the terms of each group and the number of texts with them; a null term stands for the group."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (counts, texts) in held.items():
            names = [None, *(t.decode() for t in counts)]
            columns = [[lang] * len(names), [source] * len(names), names, [0, *counts.values()], [0, *(texts[t] for t in counts)]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], [f.split()[0] for f in COUNTS.split(", ")])
        held.clear()

    for batch in batches:
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
            counts, texts = held.setdefault((lang, source), (Counter(), Counter()))
            own: set[bytes] = set()
            for terms in terms_of(text):
                counts.update(terms)
                own.update(terms)
            texts.update(own)
        if sum(len(counts) for counts, _ in held.values()) > HELD:
            yield from out()
    yield from out()


def price(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10**9 * (count + 5) / (total + 5 * kept)), exactly; null if nothing is kept."""
    above = (count + SMOOTHING).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    below = (total + SMOOTHING * kept).cast("decimal(20,0)")
    return F.when(kept > 0, 1 + F.call_function("div", above, below))


class Tree:
    """Which quadrants of some rows hold anything, level by level, and the dense cells of the leaves."""

    def __init__(self, zero: np.ndarray, side: int, rows: np.ndarray, columns: np.ndarray, prices: np.ndarray, n_columns: int):
        self.zero, self.n_rows = zero, len(zero)
        tall, wide = -(-len(zero) // LEAF) * LEAF, -(-n_columns // LEAF) * LEAF
        cells = np.zeros((tall, wide), np.int64)
        cells[: len(zero), :n_columns] = zero[:, None]
        cells[rows, columns] = prices
        self.leaves = cells.reshape(tall // LEAF, LEAF, wide // LEAF, LEAF).transpose(0, 2, 1, 3)
        n = side // LEAF
        marks = np.zeros((n, n), bool)
        marks[rows // LEAF, columns // LEAF] = True
        self.levels = [marks]
        while n > 1:
            n //= K
            marks = marks.reshape(n, K, n, K).any(axis=(1, 3))
            self.levels.append(marks)
        self.levels.reverse()


def joint(a: Tree, b: Tree, side: int, n_columns: int, same: bool) -> np.ndarray:
    """Sums of |p - p'| over the columns, for each row of a and each of b; of one tree only the part above the diagonal."""
    deepest = len(a.levels) - 1
    apart = np.abs(a.zero[:, None] - b.zero[None, :])
    total = np.zeros((a.n_rows, b.n_rows), np.int64)
    i = j = c = np.zeros(1, np.int64)
    for level in range(deepest + 1):
        width = side // K**level
        real = (i * width < a.n_rows) & (j * width < b.n_rows) & (c * width < n_columns)
        if same:
            real &= i <= j
        i, j, c = i[real], j[real], c[real]
        holds = a.levels[level][i, c] | b.levels[level][j, c]
        empty = ~holds
        if empty.any():  # priced at once: so many columns for all rows of the two quadrants
            n = K**level
            columns = np.zeros((n, n), np.int64)
            np.add.at(columns, (i[empty], j[empty]), np.minimum(n_columns - c[empty] * width, width))
            rows_a, rows_b = np.arange(a.n_rows) // width, np.arange(b.n_rows) // width
            total += columns[rows_a[:, None], rows_b[None, :]] * apart
        i, j, c = i[holds], j[holds], c[holds]
        if level < deepest:
            di, dj, dc = (g.ravel() for g in np.meshgrid(*[np.arange(K)] * 3, indexing="ij"))
            i, j, c = ((x[:, None] * K + d[None, :]).ravel() for x, d in ((i, di), (j, dj), (c, dc)))
    if len(i):
        sums = np.zeros((a.leaves.shape[0], b.leaves.shape[0], LEAF, LEAF), np.int64)
        for at in range(0, len(i), 4096):
            own = slice(at, at + 4096)
            x, y = a.leaves[i[own], c[own]], b.leaves[j[own], c[own]]
            np.add.at(sums, (i[own], j[own]), np.abs(x[:, :, None, :] - y[:, None, :, :]).sum(axis=3))
        total += sums.transpose(0, 2, 1, 3).reshape(sums.shape[0] * LEAF, -1)[: a.n_rows, : b.n_rows]
    return total


def _tile(cells: pa.Table, groups: pa.Table) -> pa.Table:
    """`lang, s, t, value` for the pairs of groups of one tile, over its columns."""
    lang, a, b, width = (groups[c][0].as_py() for c in ("lang", "a", "b", "width"))
    sides = {}
    by_size = sorted(zip(groups["block"].to_pylist(), groups["total"].to_pylist(), groups["source"].to_pylist(), groups["zero"].to_pylist(), strict=True), key=lambda g: (-g[1], g[2]))
    for block in {a, b}:
        own = [g for g in by_size if g[0] == block]
        sides[block] = ({g[2]: k for k, g in enumerate(own)}, np.array([g[3] or 0 for g in own], np.int64))
    terms, counts = cells["term"].to_pylist(), cells["n_lang"].to_pylist()
    known = {t: k for k, (_, t) in enumerate(sorted({(-n, t) for t, n in zip(terms, counts, strict=True)}))}
    column = np.fromiter((known[t] for t in terms), np.int64, len(terms))
    blocks, prices, sources = cells["block"].to_numpy(), cells["p"].to_numpy(), cells["source"].to_pylist()
    side = LEAF
    while side < max(width, *(len(zero) for _, zero in sides.values())):
        side *= K
    trees = {}
    for block, (rows, zero) in sides.items():
        own = np.flatnonzero(blocks == block)
        at = np.fromiter((rows[sources[k]] for k in own), np.int64, len(own))
        trees[block] = Tree(zero, side, at, column[own], prices[own], width)
    total = joint(trees[a], trees[b], side, width, a == b)
    left, right = (np.array(list(sides[block][0]), object) for block in (a, b))
    i, j = np.triu_indices(len(left), 1) if a == b else (g.ravel() for g in np.indices(total.shape))
    return pa.table([pa.array([lang] * len(i), pa.string()), pa.array(left[i] if len(i) else [], pa.string()), pa.array(right[j] if len(j) else [], pa.string()), pa.array(total[i, j], pa.int64())], ["lang", "s", "t", "value"])


def source_divergence(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    least_docs: int = 30,
    top_terms: int = 50,
    rows: int = ROWS,
    columns: int = COLUMNS,
) -> DataFrame:
    """`lang, source, part, item, value, rank`: the other sources of a lang by distance (part `pair`, all of
    them), and the `top_terms` terms that a source has most in excess of its lang (part `term`).

    Terms in fewer than `least_docs` texts of their lang are not kept. `rows` and `columns` bound the tiles.
    """
    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    counted = plain.mapInArrow(_count, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    counts, _ = write_scratch(counted, "counts")
    found = counts.filter("term is not null")
    kept, _ = write_scratch(found.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("df").alias("df")).filter(F.col("df") >= least_docs).drop("df"), "kept")
    vocabulary = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("n_lang").alias("total_lang"))
    cells = found.drop("df").join(kept, ["lang", "term"])
    groups = counts.filter("term is null").select("lang", "source")
    langs = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("n_groups")).join(vocabulary, "lang", "left").na.fill(0, ["kept", "total_lang"])
    langs = langs.select("*", F.greatest(F.ceil(F.col("n_groups") / rows), F.lit(1)).alias("n_blocks"), F.greatest(F.ceil(F.col("kept") / columns), F.lit(1)).alias("n_tiles"))
    # read back, its size is known: the few langs that there are go to the terms, not all terms of a lang to one task
    langs, _ = write_scratch(langs, "langs")
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sized = groups.join(totals, ["lang", "source"], "left").na.fill(0, ["total"]).join(langs, "lang")
    block = F.expr("pmod(xxhash64(source), n_blocks)").alias("block")
    sized, _ = write_scratch(sized.select("*", block, price(F.lit(0), F.col("total"), F.col("kept")).alias("zero")), "groups")
    tile = F.expr("pmod(xxhash64(term, 1), n_tiles)").alias("tile")
    prices = [price(F.col("n"), F.col("total"), F.col("kept")).alias("p"), price(F.col("n_lang"), F.col("total_lang"), F.col("kept")).alias("q")]
    priced, _ = write_scratch(cells.join(sized, ["lang", "source"]).select("lang", "source", "term", "n_lang", "block", "n_blocks", tile, *prices), "priced")

    def both(blocks: DataFrame) -> DataFrame:
        """Once for each other block of groups, as blocks a <= b."""
        other = blocks.withColumn("other", F.explode(F.expr("sequence(0L, n_blocks - 1)"))).drop("n_blocks")
        return other.withColumns({"a": F.least("block", "other"), "b": F.greatest("block", "other")}).drop("other")

    widths = kept.join(langs, "lang").select("lang", tile).groupBy("lang", "tile").agg(F.count(F.lit(1)).alias("width"))
    columns_of = sized.select("lang", "source", "block", "n_blocks", "total", "zero", F.explode(F.expr("sequence(0L, n_tiles - 1)")).alias("tile"))
    columns_of = both(columns_of.join(widths, ["lang", "tile"], "left").na.fill(0, ["width"]))
    keys = ["lang", "a", "b", "tile"]
    parts = both(priced.drop("q")).groupBy(*keys).cogroup(columns_of.groupBy(*keys)).applyInArrow(_tile, "lang string, s string, t string, value long")
    pairs = parts.groupBy("lang", "s", "t").agg(F.sum("value").alias("value"))
    ends = F.explode(F.array(F.struct(F.col("s").alias("source"), F.col("t").alias("item")), F.struct(F.col("t").alias("source"), F.col("s").alias("item"))))
    pair_part = pairs.select("lang", ends.alias("e"), "value").select("lang", "e.source", F.lit("pair").alias("part"), "e.item", "value")
    excess = priced.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    return pair_part.select("*", rank).unionByName(excess.select("*", rank).filter(F.col("rank") <= top_terms))
