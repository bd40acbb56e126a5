"""Connected components by alternating large and small stars, all in tables.

Every round rewrites the edges towards the smallest neighbour known and writes them to the shared
folder, so lineage stays short and nothing is collected. Hot nodes are aggregated map-side; the join
that hands a minimum back to its edges can be split by adaptive execution.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.sources.staging import checkpoint_root


#: Makes Spark drop the shuffle files of a query when it ends, not when the driver collects its garbage.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_scratch(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write a table under the shared checkpoint folder; the table read back, and its path."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/llm/{uuid.uuid4().hex}/{name}"
    before = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEAN) if before is None else spark.conf.set(CLEAN, before)
    return spark.read.schema(df.schema).parquet(path), path


def remove_scratch(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scratch_tables(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Gives a function that writes a table and reads it back; the tables are removed when the block ends."""
    paths: list[str] = []

    def write(df: DataFrame, name: str) -> DataFrame:
        table, path = write_scratch(df, name)
        paths.append(path)
        return table

    try:
        yield write
    finally:
        for path in paths:
            remove_scratch(spark, path)


def components(edges: DataFrame) -> DataFrame:
    """`node, component` for every node of the edges `a, b`; a component is named by its smallest node.

    Loops, repeated and null edges change nothing. No edges give an empty table.
    """
    spark = edges.sparkSession
    pairs = edges.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    now, path = write_scratch(pairs, "edges")
    state = _digest(now)
    while state[0]:
        after, after_path = write_scratch(_small_star(_large_star(now)), "edges")
        after_state = _digest(after)
        remove_scratch(spark, path)
        now, path, done = after, after_path, after_state == state
        state = after_state
        if done:
            break
    roots = now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(roots)


def _digest(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("hi", "lo")), F.lit(0))).first()
    return row[0], row[1]


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of a node are tied to the smallest of it and its neighbours."""
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of these."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = edges.join(least, "hi").filter("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.unionAll(least.select("hi", F.col("m").alias("lo"))).distinct()
