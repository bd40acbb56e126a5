"""Full article text, fetched elsewhere, in place of the feed's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.functions.text import is_blank, source_hash, strip


def use_fulltext(planned: DataFrame, fulltext: DataFrame) -> DataFrame:
    """Swap the source content of rows to translate for the fetched content.

    ``fulltext`` has ``url, content, error``. Rows with an error or blank
    content count as not fetched, and such articles keep the feed's text.
    """
    wanted = (F.col("action") == "translate") & ~is_blank(F.col("link"))
    links = planned.where(wanted).select(strip(F.col("link")).alias("url"))
    # the table may hold far more than the queue asks for; only wanted bodies are grouped
    usable = fulltext.where(F.col("error").isNull() & ~is_blank(F.col("content"))).join(
        links, "url", "left_semi"
    )
    fetched = usable.groupBy("url").agg(F.min("content").alias("fetched"))
    # rows without a link get a key of their own, or they would all meet in one task
    key = F.when(wanted, strip(F.col("link"))).otherwise(F.concat(F.lit("\0"), "entry_id"))
    joined = planned.withColumn("url", key).join(fetched, "url", "left")
    content = F.coalesce("fetched", "source_content")
    swapped = F.col("fetched").isNotNull() & (F.col("fetched") != F.col("source_content"))
    rehashed = F.when(swapped, source_hash(F.col("source_title"), F.col("fetched")))
    return joined.select(
        *[
            content.alias(c)
            if c == "source_content"
            else F.coalesce(rehashed, F.col(c)).alias(c)
            if c == "source_hash"
            else F.col(c)
            for c in planned.columns
        ]
    )
