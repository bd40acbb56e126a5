"""Bounded samples of labelled rows to fit classifiers on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: More labels than this are refused: models hold a row of weights for each.
MAX_LABELS = 1000


def label_counts(labelled: DataFrame, label: str) -> dict:
    """How many rows each label has; at most MAX_LABELS labels."""
    return {r["label"]: r["n"] for r in _counted(labelled.select(F.col(label).alias("label")), F.lit(1))}


def _counted(known: DataFrame, name: Column) -> list:
    counted = known.filter("label is not null").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(name).alias("ids"))
    rows = counted.orderBy("label").limit(MAX_LABELS + 1).collect()
    if len(rows) > MAX_LABELS:
        raise ValueError(f"over {MAX_LABELS} labels")
    return rows


def sample_ids(labelled: DataFrame, id_col: str, label: str, per_label: int) -> DataFrame:
    """At most `per_label` ids of each label: those whose hash comes first.

    Columns `id` and `label`, one row per id; an id of several labels goes with the smallest. One pass
    counts the ids of a label, one cuts a fraction out of the hash range, so that few rows are left to
    rank; rows that share an id are one before they are shuffled.
    """
    known = labelled.select(F.col(id_col).alias("id"), F.col(label).alias("label")).filter("id is not null and label is not null")
    share = {r["label"]: min(1.0, (1.4 * per_label + 200) / max(1, r["ids"])) for r in _counted(known, F.col("id"))}
    if not share:
        return known.filter("false")
    last = {value: min(2**63 - 1, int(-(2**63) + part * 2.0**64)) for value, part in share.items()}
    bound = F.create_map(*(x for value, end in last.items() for x in (F.lit(value), F.lit(end).cast("long"))))[F.col("label")]
    draw = F.xxhash64(F.col("id").cast("string"), F.lit("fit"))
    own = known.withColumn("draw", draw).filter(F.col("draw") <= bound).groupBy("id").agg(F.min("label").alias("label"), F.first("draw").alias("draw"))
    ranked = own.withColumn("place", F.row_number().over(Window.partitionBy("label").orderBy("draw", "id")))
    found = ranked.filter(F.col("place") <= per_label).select("id", "label").collect()
    return known.sparkSession.createDataFrame([tuple(r) for r in found], known.schema)


def one_row_each(rows: DataFrame, drawn: DataFrame, value: str, partitions: int = 32) -> DataFrame:
    """`id, label` and the column `value` of one row of each drawn id: that whose value's hash comes first.

    Null values go only where an id has no other. However many rows share an id, one a task is shuffled.
    """
    keys = ["id", "label"] if "label" in rows.columns else ["id"]
    own = rows.join(F.broadcast(drawn), keys).groupBy("id", "label").agg(F.min_by(value, F.xxhash64(value)).alias(value))
    return own.repartition(partitions, "id")
