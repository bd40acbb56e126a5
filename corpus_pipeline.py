"""A training corpus out of `documents`, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as parquet and read
again as the next one's `docs`. All but the last return the columns of `docs`, so a stage sees all that
its predecessor kept. Extra columns pass through. Rows without an id are never near-duplicates or
trimmed; they stay unless their language is rejected or a benchmark passage is in them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm.components import components, remove_scratch, write_scratch
from feedloom.llm.decontaminate import benchmark_matches
from feedloom.llm.language import UNDETERMINED, fit_language
from feedloom.llm.packing import pack
from feedloom.llm.resemblance import similar_links
from feedloom.llm.simhash import simhash_groups
from feedloom.llm.substrings import substring_dedup

#: A prediction less certain than this counts as no language; see the README for what that costs.
LEAST_CERTAINTY = 0.5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language is told with some certainty; fitted on their own labels.

    Where no document with a text is labelled, no language can be told and all documents stay.
    """
    if docs.filter("lang is not null and text is not null").isEmpty():
        return docs
    found = fit_language(docs).predict(F.col("text"))
    names = docs.columns
    judged = docs.select(F.struct(*names).alias("row"), found.alias("found"))
    return judged.filter((F.col("found.label") != UNDETERMINED) & (F.col("found.score") >= LEAST_CERTAINTY)).select("row.*")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays: of those with the smallest id, that of the smallest text hash.

    Rows link if their fingerprints differ in three bits or fewer, or if the Jaccard similarity of their sets of
    five-word shingles is 0.8 or more; a group is what links connect.
    """
    place = F.struct(F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("hash"))
    placed = docs.select(F.when(F.col("doc_id").isNotNull(), place).alias("place"), F.col("text").alias("text"))
    near = simhash_groups(placed, id_col="place").filter("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b"))
    found = components(near.unionByName(similar_links(placed, id_col="place")))
    gone = found.filter("node <> component").select("node.*")
    # one shuffle, of rows without an id by their number; rows with one id and text are one node, of which the first row stays
    number = F.monotonically_increasing_id()
    part = F.when(F.col("doc_id").isNotNull(), F.xxhash64("text")).otherwise(number)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), part.alias("part"), number.alias("number"))
    first = rows.groupBy("id", "part").agg(F.min_by("row", "number").alias("row"))
    return first.join(gone, (F.col("id") == F.col("doc_id")) & (F.col("part") == F.col("hash")), "left_anti").select("row.*")


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words that a smaller id has go; what is left is joined by single spaces.

    Documents that lose every word go. The others keep their columns; `n_chars` follows the text.
    """
    cut = substring_dedup(docs, with_text=True).filter("n_removed > 0").select("id", "part", "kept", (F.col("n_words") == F.col("n_removed")).alias("empty"))
    cut = cut.dropDuplicates(["id", "part"])
    same = (docs["doc_id"] == cut["id"]) & (F.xxhash64(docs["text"]) == cut["part"])
    joined = docs.join(cut, same, "left").filter(~F.coalesce(cut["empty"], F.lit(False)))
    new = {"text": F.coalesce(cut["kept"], docs["text"])}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(cut["kept"].isNotNull(), F.length(cut["kept"]).cast(docs.schema["n_chars"].dataType)).otherwise(docs["n_chars"])
    return joined.select(*[new.get(c, docs[c]).alias(c) for c in docs.columns])


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold ten consecutive words of a benchmark item, or all of a shorter one, go."""
    found = benchmark_matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), with_row=True)
    return found.filter("size(matches) = 0").select("row.*")


def batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document lies: bucket, batch and slot."""
    return pack(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language", known_language),
    ("near_duplicates", one_of_each),
    ("repeated_passages", without_repeats),
    ("decontamination", without_benchmarks),
    ("packing", batches),
]

#: Models, fingerprints and the packing of lengths have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, read = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs, path = write_scratch(stage(spark, docs, sf_dir), name)
        if read:
            remove_scratch(spark, read)
        read = path
    return STAGES[-1][1](spark, docs, sf_dir)
