"""Dense positions over a total order, without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.sources.staging import stage

# monotonically_increasing_id() keeps the partition number above this bit.
_ROW_BITS = 33


def with_positions(
    df: DataFrame, order: list[Column], name: str = "position", staged: bool = False
) -> DataFrame:
    """``df`` with its 0-based position in ``order``, which must be total.

    ``df`` should be narrow: keys and what is needed with the position. ``staged``
    says that it is read from a staged table and cheap to read twice.

    Rows are range-partitioned and sorted, then written once so that both
    readings below see the same partitions. Row counts per partition give the
    offset of each; that table has one row per partition.
    """
    # range bounds come from a sample, for which all of the input would be
    # computed once more; being narrow, it is written instead
    unordered = df if staged else stage(df, "unordered")
    # the order is total, so no range can be hot
    ordered = unordered.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = stage(ordered.withColumn("_row", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_row", _ROW_BITS)
    counts = numbered.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset")
    )
    in_part = F.col("_row").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        numbered.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + in_part)
        .drop("_part", "_offset", "_row")
    )
