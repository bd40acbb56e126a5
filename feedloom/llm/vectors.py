"""Near-duplicate embeddings by int8 tile products with rigorous error bounds.

Vectors are scaled to length one and rounded to int8 with a scale of their own; the length of the
rounding error is kept for each vector. For unit vectors u = s q + r and u' = s' q' + r' the cosine
differs from s s' (q . q') by at most |r| (1 + |r'|) + |r'|, so a pair whose int8 product lies further
below the threshold is no link. Only the other pairs are computed again in double precision.

Distinct vectors are dealt into blocks and every two blocks meet in one task: comparing all pairs is
the method, so the work grows with the square of the number of distinct vectors, in parallel tasks of
fixed size. Copies of a vector are compared once. A task returns how many vectors each of its vectors
links to, and a spanning forest of the links, never the links themselves.

Defined results: a vector that is null, empty, zero or has null or non-finite components links with
nothing and is a component of its own. Vectors of different length do not link. Rows that share an id
are vectors of their own. Rows without an id keep a null id and component, count as linked vectors, and others
reach each other through them. No rows give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.components import components, write_scratch
from feedloom.llm.forests import roots

BLOCK = 4096  # vectors of up to DIMS dimensions that one side of a task has; of longer ones fewer
DIMS = 1024
TILE = 256
EXACT_PAIRS = 1 << 14
EXACT_DIMS = 1024  # so many products of int8 values add up exactly in single precision


def vector_links(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, block: int = BLOCK) -> DataFrame:
    """`id, n_links, component` for every row."""
    base = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    usable = (
        (F.size("v") > 0)
        & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists("v", lambda x: x != 0)
    )
    base = base.withColumn("usable", F.coalesce(usable, F.lit(False)))
    keyed = base.select(
        "id", F.when(F.col("usable"), F.xxhash64("v")).alias("h1"), F.when(F.col("usable"), F.xxhash64(F.lit("second"), "v")).alias("h2"), "v"
    )
    grouped = keyed.filter("h1 is not null").groupBy("h1", "h2").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
    # distinct vectors are the nodes: in the order of their ids, those without one last
    classes, _ = write_scratch(grouped.withColumn("class", F.struct(F.col("least").isNull().alias("none"), "least", "h1", "h2")), "classes")
    one = keyed.filter("h1 is not null").join(classes, ["h1", "h2"]).filter("id <=> least")
    distinct, _ = write_scratch(one.dropDuplicates(["h1", "h2"]).select("h1", "h2", "class", "n", "v"), "vectors")
    links, _ = write_scratch(_block_pairs(distinct, threshold, block), "links")
    found = components(links.filter("b is not null").select("a", "b"))
    counted = links.filter("b is null").groupBy("h1", "h2").agg(F.sum("links").alias("links"))
    of_class = (
        classes.join(counted, ["h1", "h2"], "left")
        .join(found, F.col("class") == F.col("node"), "left")
        .select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("class_links"), F.coalesce("component", "class")["least"].alias("class_component"))
    )
    alone = keyed.filter("h1 is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    linked = keyed.filter("h1 is not null").select("id", "h1", "h2").join(of_class, ["h1", "h2"])
    named = F.when(F.col("id").isNotNull(), F.col("class_component")).alias("component")
    return linked.select("id", F.col("class_links").alias("n_links"), named).unionByName(alone)


def _block_pairs(distinct: DataFrame, threshold: float, block: int) -> DataFrame:
    """Rows with links: a vector's number of linked vectors of other classes; rows with b: edges."""
    size = distinct.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    blocks = max(1, -(-size[0] // max(1, block * DIMS // max(DIMS, size[1]))))
    own = F.pmod(F.col("h1"), F.lit(blocks))
    dealt = (
        distinct.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        .select(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "h1", "h2", "class", "n", "v")
    )

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        return _compare(key, table, threshold)

    node = distinct.schema["class"].dataType.simpleString()
    return dealt.groupBy("i", "j").applyInArrow(compare, f"h1 long, h2 long, links long, a {node}, b {node}")


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Int8 rows of unit vectors, their scales, and upper bounds of the lengths of their errors."""
    scale = np.abs(unit).max(axis=1) / 127
    whole = np.rint(unit / scale[:, None]).astype(np.int8)
    error = np.linalg.norm(unit - scale[:, None] * whole, axis=1) * (1 + 1e-9) + 1e-12
    return whole, scale, error


def close_pairs(u: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float, same: bool):
    """Index pairs (into u) of rows of `left` and `right` with a cosine of at least `threshold`."""
    whole, scale, error = quantise(u)
    floats = whole.astype(np.float32)
    right = right[np.argsort(scale[right], kind="stable")]
    step = EXACT_DIMS
    slabs = [slice(d, d + step) for d in range(0, u.shape[1], step)]
    for at in range(0, len(left), TILE):
        a = left[at : at + TILE]
        for to in range(0, len(right), BLOCK):
            b = right[to : to + BLOCK]
            product = floats[a][:, slabs[0]] @ floats[b][:, slabs[0]].T
            for slab in slabs[1:]:
                product = product.astype(np.float64) + floats[a][:, slab] @ floats[b][:, slab].T
            # a row's least product that could still reach the threshold with any of these columns
            widest, largest = error[b].max(), scale[b].max()
            slack = error[a] * (1 + widest) + widest
            low = np.maximum(threshold - slack, 0) / (scale[a] * largest)
            low = np.where(threshold - slack > 0, low * (1 - 1e-6) - 1e-3, -np.inf)
            i, j = np.nonzero(product >= low[:, None].astype(product.dtype))
            x, y = a[i], b[j]
            bound = error[x] * (1 + error[y]) + error[y]
            possible = scale[x] * scale[y] * product[i, j].astype(np.float64) + bound >= threshold - 1e-9
            if same:
                possible &= x < y
            x, y = x[possible], y[possible]
            for k in range(0, len(x), EXACT_PAIRS):
                p, q = x[k : k + EXACT_PAIRS], y[k : k + EXACT_PAIRS]
                yes = np.einsum("ij,ij->i", u[p], u[q]) >= threshold
                yield p[yes], q[yes]


def _compare(key: tuple, table: pa.Table, threshold: float) -> pa.Table:
    i, j = (v.as_py() for v in key)
    column = table["v"].combine_chunks()
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(lengths) - lengths
    own, n = table["own"].to_numpy(), table["n"].to_numpy()
    counts = np.zeros(len(table), np.int64)
    root = np.arange(len(table))
    for dims in np.unique(lengths).tolist():
        of = np.flatnonzero(lengths == dims)
        v = flat[starts[of][:, None] + np.arange(dims)]
        v = v / np.abs(v).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
        u = v / np.linalg.norm(v, axis=1, keepdims=True)
        left, right = np.flatnonzero(own[of] == i), np.flatnonzero(own[of] == j)
        for p, q in close_pairs(u, left, right, threshold, i == j):
            p, q = of[p], of[q]
            np.add.at(counts, p, n[q])
            np.add.at(counts, q, n[p])
            root = roots(len(table), p, q, root)
    some, moved = np.flatnonzero(counts), np.flatnonzero(root != np.arange(len(table)))
    h1, h2 = (table[c].combine_chunks() for c in ("h1", "h2"))
    nodes = table["class"].combine_chunks()
    no_ends, no_links = pa.nulls(len(some), nodes.type), pa.nulls(len(moved), pa.int64())
    return pa.concat_tables(
        [
            pa.table({"h1": h1.take(pa.array(some)), "h2": h2.take(pa.array(some)), "links": pa.array(counts[some]), "a": no_ends, "b": no_ends}),
            pa.table({"h1": no_links, "h2": no_links, "links": no_links, "a": nodes.take(pa.array(moved)), "b": nodes.take(pa.array(root[moved]))}),
        ]
    )
