"""Packing into optimal length buckets.

Every row of a batch is padded to the length of its bucket. The global histogram of lengths gives,
by dynamic programming, the bucket boundaries with the least padding; inside a bucket, rows form
batches of `token_budget` padded tokens. A histogram has one row per length class, not per document:
lengths up to 1,024 are exact, longer ones are rounded up to one part in 512, so that about 10,000
classes reach the driver however long texts get.

Batches are formed within groups of at most some `group_rows` documents that the hash of the id and a row number deal
out, so no bucket has to be numbered in one task; each group leaves one batch that may be short.

Defined results: a null or empty text has length 0 and lies in the first bucket. A row longer than the
budget is a batch of its own. Rows that share an id, or have none, are packed one by one: every row is
dealt out by its id and a number of its own. No rows give no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EXACT_LENGTHS = 1024
PARTS = 512


def word_count(text: Column) -> Column:
    """White-space separated words."""
    plain = F.trim(F.translate(text, "\t\n\x0b\x0c\r", "     "))
    return F.when(F.coalesce(F.length(plain), F.lit(0)) == 0, 0).otherwise(F.size(F.split(plain, " +"))).cast("long")


def length_class(length: Column) -> Column:
    """The length, rounded up where it exceeds EXACT_LENGTHS."""
    step = F.pow(F.lit(2.0), F.floor(F.log2(length - 1)) - F.lit(PARTS.bit_length() - 1))
    return F.when(length <= EXACT_LENGTHS, length).otherwise((F.ceil(length / step) * step).cast("long"))


def best_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> tuple[list[int], int]:
    """Upper bounds of at most `buckets` buckets with the least padding, and that padding.

    `lengths` ascend; cost(i, j) of one bucket over classes i..j-1 is lengths[j-1] * rows - tokens.
    """
    n = len(lengths)
    rows = np.concatenate([[0], np.cumsum(counts)]).astype(np.float64)
    tokens = np.concatenate([[0], np.cumsum(lengths * counts)]).astype(np.float64)
    best = np.full(n + 1, np.inf)
    best[0] = 0.0
    cuts = []
    for _ in range(min(buckets, n)):
        after, cut = best.copy(), np.arange(n + 1)
        for j in range(1, n + 1):
            cost = best[:j] + lengths[j - 1] * (rows[j] - rows[:j]) - (tokens[j] - tokens[:j])
            i = int(cost.argmin())
            if cost[i] < after[j]:
                after[j], cut[j] = cost[i], i
        best = after
        cuts.append(cut)
    bounds, at = [], n
    for cut in reversed(cuts):
        if cut[at] < at:
            bounds.append(int(lengths[at - 1]))
            at = int(cut[at])
    return bounds[::-1], int(best[n])


def pack(
    docs: DataFrame, id_col: str = "doc_id", length: Column | None = None, text_col: str = "text", buckets: int = 16, token_budget: int = 65_536, group_rows: int = 20_000
) -> DataFrame:
    """`id, n_tokens, bucket, bucket_length, batch, slot` for every row.

    `length` is the token count, by default the number of words. `bucket` counts from 0,
    `bucket_length` is what its rows are padded to, `batch` names a batch over all buckets, `slot` is
    the place in it.
    """
    length = word_count(F.col(text_col)) if length is None else length
    from feedloom.llm.components import write_scratch

    row = F.monotonically_increasing_id()  # written, so it stays the same
    sized, _ = write_scratch(docs.select(F.col(id_col).alias("id"), F.coalesce(length, F.lit(0)).cast("long").alias("n_tokens"), row.alias("row")), "lengths")
    sized = sized.withColumn("class", length_class(F.col("n_tokens")))
    histogram = sized.groupBy("class").agg(F.count(F.lit(1)).alias("n")).orderBy("class").collect()
    sizes, counts = np.array([r["class"] for r in histogram], np.int64), np.array([r["n"] for r in histogram], np.int64)
    bounds, _ = best_bounds(sizes, counts, buckets) if len(sizes) else ([0], 0)
    held = [int(counts[(sizes <= b) & (sizes > a)].sum()) for a, b in zip([-1, *bounds[:-1]], bounds, strict=True)]
    groups = [max(1, -(-n // group_rows)) for n in held]
    bucket = F.lit(len(bounds) - 1)
    for k in reversed(range(len(bounds) - 1)):
        bucket = F.when(F.col("class") <= bounds[k], k).otherwise(bucket)
    at = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("bucket") + 1)
    placed = (
        sized.withColumn("bucket", bucket)
        .withColumn("bucket_length", at(bounds).cast("long"))
        .withColumn("group", F.pmod(F.xxhash64(F.col("id").cast("string"), F.col("row"), F.lit("pack")), at(groups).cast("long")))
    )
    each = F.greatest(F.lit(1), F.floor(F.lit(token_budget) / F.greatest("bucket_length", F.lit(1)))).cast("long")
    order = Window.partitionBy("bucket", "group").orderBy("n_tokens", "id", "row")
    numbered = placed.withColumn("place", F.row_number().over(order).cast("long") - 1)
    return numbered.select(
        "id",
        "n_tokens",
        "bucket",
        "bucket_length",
        F.concat_ws("-", "bucket", "group", F.floor(F.col("place") / each)).alias("batch"),
        (F.col("place") % each).alias("slot"),
    )
