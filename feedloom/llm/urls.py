"""URL filtering by listed rules and mined association rules, in DataFrame functions alone.

Spark's FP-growth mines the combinations of URL tokens that labelled pages have in common. Of its
rules those that lead to the label `block` stay, pruned by support and confidence and rid of rules
that a shorter one with as much confidence makes needless. They match by an inverted index: a rule is
filed under its rarest token, a URL looks its tokens up and is then checked for the rest.

Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased. Path: then up to `?`,
`#` or the end. A listed rule fits its host and all subdomains if the path starts with its own; the
longest wins, of equally long ones that with the longer host.

Defined results: a null URL, or one without `://`, has an empty host and path and no tokens, so no
rule fits and the verdict is allow. Repeated rows are judged alike. Without labels no rule is mined.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.components import write_scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK = "=block"
#: Rules up to this number are sent to all executors; more are joined by shuffles.
MOST_BROADCAST = 10_000


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def listed_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """A struct of rule and verdict of the longest listed rule that fits, else null."""
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for own, start, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]))):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(own + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def url_tokens(url: Column) -> Column:
    """Distinct tokens: scheme, labels of the host, words of path and query. Numbers count as one token."""
    scheme = F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^(.*?)://", 1), F.lit("")), UPPER, LOWER)
    query = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*(?:\?([^#]*))?", 1), F.lit(""))

    def words(text: Column, mark: str, pattern: str) -> Column:
        plain = F.filter(F.split(F.translate(text, UPPER, LOWER), pattern), lambda w: w != "")
        return F.transform(plain, lambda w: F.concat(F.lit(mark), F.when(w.rlike("^[0-9]+$"), F.lit("0")).otherwise(w)))

    parts = [words(scheme, "s:", "[^a-z0-9]+"), words(host_of(url), "h:", r"[.:@-]+"), words(path_of(url), "p:", r"[/._-]+"), words(query, "q:", "[&=;]+")]
    return F.when(url.contains("://"), F.array_distinct(F.concat(*parts))).otherwise(F.array().cast("array<string>"))


def mine_rules(
    pages: DataFrame, labels: DataFrame, page_col: str = "page_id", url_col: str = "url", label_id_col: str = "doc_id", bad: str = "quality = 0 or toxic = 1",
    support: float = 0.005, confidence: float = 0.6, longest: int = 5,
) -> DataFrame:
    """`rule (array of tokens), index (its rarest token), confidence, support`, from labelled pages.

    `bad` is an expression over `labels`; pages for which it is true are labelled block. Every
    labelled page counts; how many rules there are is bounded by the support. A rule has at most
    `longest` tokens. Tokens that occur in just the same labelled pages make the same rules; the
    first by name stands for them, so that shared parameters do not multiply the combinations.
    """
    known = labels.select(F.col(label_id_col).alias("label_id"), F.expr(bad).alias("bad")).filter("label_id is not null and bad is not null")
    known = known.groupBy("label_id").agg(F.max("bad").alias("bad"))
    labelled = pages.select(F.col(page_col).alias("page"), F.col(url_col).alias("url")).join(known, F.col("page") == F.col("label_id"))
    listed, _ = write_scratch(labelled.select(F.monotonically_increasing_id().alias("basket"), "bad", url_tokens(F.col("url")).alias("tokens")), "baskets")
    least = support * listed.filter("bad or size(tokens) > 0").count()
    every = listed.select("basket", "bad", F.explode("tokens").alias("token")).groupBy("token")
    # equal counts and equal sums of two hashes: the same baskets
    seen = every.agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("n_bad"), *(F.bit_xor(F.xxhash64("basket", F.lit(k))).alias(f"print{k}") for k in (0, 1)))
    frequent = seen.filter(F.col("n_bad") >= least).groupBy("n", "print0", "print1").agg(F.min("token").alias("token"))
    kept = listed.select("basket", F.explode("tokens").alias("token")).join(frequent.select("token", "n"), "token")
    items = kept.groupBy("basket").agg(F.collect_list("token").alias("items"))
    marked = listed.filter("bad or size(tokens) > 0").join(items, "basket", "left")
    baskets = marked.select(F.array_compact(F.concat(F.coalesce("items", F.array().cast("array<string>")), F.array(F.when(F.col("bad"), BLOCK)))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets)
    mined = model.freqItemsets.filter(F.size("items") <= F.when(F.array_contains("items", BLOCK), longest + 1).otherwise(longest))
    sets, _ = write_scratch(mined.select(F.array_sort(F.array_remove("items", BLOCK)).alias("rule"), F.array_contains("items", BLOCK).alias("bad"), "freq"), "itemsets")
    n = baskets.count()
    counted = sets.filter("size(rule) > 0").groupBy("rule").agg(F.max(F.when(F.col("bad"), F.col("freq"))).alias("hit"), F.max(F.when(~F.col("bad"), F.col("freq"))).alias("all"))
    rules = counted.select("rule", (F.col("hit") / F.col("all")).alias("confidence"), (F.col("hit") / F.lit(max(n, 1))).alias("support")).filter(F.col("confidence") >= confidence)
    parts = rules.select(F.col("rule").alias("whole"), F.col("confidence").alias("own"), F.explode(_proper_subsets(F.col("rule"))).alias("rule"))
    needless = parts.join(rules.select("rule", "confidence"), "rule").filter("confidence >= own").select(F.col("whole").alias("rule")).distinct()
    needed = rules.join(needless, "rule", "left_anti")
    rarest = F.array_min(F.collect_list(F.struct("n", "token")))["token"]
    filed = needed.withColumn("token", F.explode("rule")).join(frequent.select("token", "n"), "token").groupBy("rule", "confidence", "support").agg(rarest.alias("index"))
    return filed.select("rule", "index", "confidence", "support")


def _proper_subsets(rule: Column) -> Column:
    """All subsets of a short sorted array but the empty one and itself, sorted."""
    grown = F.aggregate(rule, F.array(F.array().cast("array<string>")), lambda sets, t: F.concat(sets, F.transform(sets, lambda s: F.array_append(s, t))))
    return F.filter(grown, lambda s: (F.size(s) > 0) & (F.size(s) < F.size(rule)))


def judge_urls(pages: DataFrame, mined: DataFrame, listed: list[tuple[str, str, str]], page_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """`page, host, path, rule, verdict, confidence` for every row.

    `confidence`: of the best mined rule that matches, else null; it decides where no listed rule fits.
    """
    own = pages.select(F.col(page_col).alias("page"), F.col(url_col).alias("url"))
    tokens = own.filter("url is not null").select("url").distinct().withColumn("tokens", url_tokens(F.col("url")))
    mined, _ = write_scratch(mined, "rules")
    few = F.broadcast if mined.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else lambda rules: rules
    matched = (
        tokens.withColumn("index", F.explode("tokens"))
        .join(few(mined), "index")
        .filter(F.size(F.array_intersect("tokens", "rule")) == F.size("rule"))
        .groupBy("url")
        .agg(F.max("confidence").alias("confidence"))
    )
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    placed = own.join(matched, "url", "left").select("page", host.alias("host"), path.alias("path"), "confidence")
    rule = placed.withColumn("listed", listed_rule(F.col("host"), F.col("path"), listed))
    mined_verdict = F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")
    return rule.select("page", "host", "path", F.col("listed.rule").alias("rule"), F.coalesce("listed.verdict", mined_verdict).alias("verdict"), "confidence")
