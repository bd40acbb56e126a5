"""The operators' queries over the test tables, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm.components import write_scratch
from feedloom.llm.decontaminate import benchmark_matches, hit_words
from feedloom.llm.divergence import source_divergence
from feedloom.llm.language import fit_language
from feedloom.llm.merkle import digest_of, merkle_proofs, proof_digest, refold
from feedloom.llm.packing import pack
from feedloom.llm.quality import feature_column, fit_quality
from feedloom.llm.repetition import judge_repetition
from feedloom.llm.simhash import simhash_groups
from feedloom.llm.substrings import substring_dedup
from feedloom.llm.tokens import read_pieces, token_counts
from feedloom.llm.toxicity import fit_toxicity
from feedloom.llm.urls import judge_urls, mine_rules
from feedloom.llm.vectors import vector_links

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# The listed URL rules of the contract.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: str, n: int) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % n


def held_out(id_col: str, n: int, part: int) -> Column:
    """Whether a row's fold is `part`. A row without an id has no fold: false, though it trains nothing."""
    return F.coalesce(fold(id_col, n) == part, F.lit(False)).alias("held_out")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    featured, _ = write_scratch(docs.select("doc_id", feature_column(F.col("text")).alias("features")), "features")
    model = fit_quality(featured, labels.filter(fold("doc_id", 3) != 1))
    scored = featured.select("doc_id", held_out("doc_id", 3, 1), model.score(F.col("features")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op2_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector_links(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_language(docs.filter(fold("doc_id", 5) != 0))
    found = docs.select("doc_id", held_out("doc_id", 5, 0), model.predict(F.col("text")).alias("p"))
    return found.select("doc_id", "held_out", F.col("p.label").alias("lang_pred"), F.col("p.score").alias("score"))


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    mined = mine_rules(pages, table(spark, sf_dir, "labels"))
    return judge_urls(pages, mined, URL_RULES).withColumnRenamed("page", "page_id")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_toxicity(docs, labels.filter(fold("doc_id", 4) != 2))
    scored = docs.select("doc_id", held_out("doc_id", 4, 2), model.score(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", token_counts(spark, F.col("text"), read_pieces(VOCABULARY)).alias("n_tokens"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = benchmark_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.transform(F.array_distinct("matches.item"), lambda i: i.cast("string")))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        hit_words("matches").alias("n_hit"),
        F.size(F.array_distinct("matches.item")).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("matches") > 0).alias("contaminated"),
    )


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_groups(table(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return found.select(F.col("id").alias("doc_id"), digits.alias("fingerprint"), F.col("component").alias("component_id"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


def op12_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge_repetition(table(spark, sf_dir, "documents"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_covered"]
    return found.select(F.col("id").alias("doc_id"), *names)


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")

    def digest(text: Column) -> Column:
        return digest_of(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)

    text = F.col("text")
    tampered = (fold("doc_id", 2) == 0) & text.contains("\n")
    leaves = docs.select("doc_id", "source", digest(text).alias("leaf"), F.when(tampered, digest(F.replace(text, F.lit("\n"), F.lit("")))).alias("other"))
    found = merkle_proofs(leaves, "doc_id", "source", "leaf")
    found = found.withColumn("folded_root", refold(F.coalesce("other", "leaf"), F.col("proof")))
    return found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_quality, op2_vectors, op3_language, op4_urls, op5_toxicity, op6_packing, op7_tokens, op8_decontamination, op9_substrings, op10_simhash, op11_divergence, op12_repetition, op13_manifest, pipeline)
}

ORACLES: dict[str, str] = {
    "op2_vectors": """
        with recursive v as (
            select vec_id, cast(embedding as double[]) as e from embeddings
            where embedding is not null and len(embedding) > 0
              and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
              and len(list_filter(embedding, lambda x: x <> 0)) > 0
        ),
        links as (
            select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e)
            where list_cosine_similarity(a.e, b.e) >= 0.95
        ),
        reach as (
            select vec_id as a, vec_id as b from embeddings
            union
            select reach.a, links.b from reach join links on reach.b = links.a
        ),
        named as (select a, min(b) as c from reach group by a),
        counted as (select a, count(*) as n from links group by a)
        select vec_id, cast(coalesce(n, 0) as bigint) as n_links, c as component_id, vec_id = c as kept
        from embeddings join named on named.a = vec_id left join counted on counted.a = vec_id
    """,
    "op8_decontamination": r"""
        with words as (
            select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
        ),
        items as (
            select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
        ),
        sizes as (select *, least(len(w), 10) as n from items where len(w) > 0),
        windows as (
            select distinct item_id, n, array_to_string(w[i : i + n - 1], ' ') as k
            from (select *, unnest(range(1, len(w) - n + 2)) as i from sizes)
        ),
        places as (
            select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') as k
            from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from words, (select distinct n from sizes))
        ),
        found as (select doc_id, i, n, item_id from places join windows using (n, k)),
        hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from found) group by doc_id),
        named as (
            select doc_id, count(*) as n_items, string_agg(name, ',' order by name) as names
            from (select distinct doc_id, cast(item_id as varchar) as name from found) group by doc_id
        )
        select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
            cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(names, '')) as items_sha256,
            coalesce(n_hit, 0) > 0 as contaminated
        from words left join hit using (doc_id) left join named using (doc_id)
    """,
    "op9_substrings": r"""
        with words as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
        windows as (
            select doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) as k
            from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from words where len(w) >= 50)
        ),
        least_ids as (select k, min(doc_id) as least_id from windows group by k),
        gone as (
            select distinct doc_id, p from (
                select doc_id, unnest(range(i, i + 50)) as p from windows join least_ids using (k) where doc_id > least_id)
        ),
        places as (select doc_id, w[p] as word, p from (select doc_id, w, unnest(range(1, len(w) + 1)) as p from words)),
        left_over as (
            select doc_id, count(*) as n, string_agg(word, ' ' order by p) as t
            from places anti join gone using (doc_id, p) group by doc_id
        )
        select doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed,
            sha256(coalesce(t, '')) as kept_sha256
        from words left join left_over using (doc_id)
    """,
    "op11_divergence": r"""
        with texts as (select coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text, row_number() over () as pos from documents),
        terms as (
            select lang, source, pos, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from texts
        ),
        kept as (select lang, term, count(*) as n from terms group by lang, term having count(distinct pos) >= 30),
        sizes as (select lang, count(*) as v, sum(n)::bigint as total from kept group by lang),
        groups as (select distinct lang, source from texts),
        cells as (select lang, source, term, count(*) as n from terms semi join kept using (lang, term) group by lang, source, term),
        totals as (select lang, source, sum(n)::bigint as total from cells group by lang, source),
        priced as (
            select g.lang, g.source, k.term, coalesce(c.n, 0) as n,
                (1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)) // (coalesce(t.total, 0) + 5 * s.v))::bigint as p,
                (1 + (1000000000::hugeint * (k.n + 5)) // (s.total + 5 * s.v))::bigint as q
            from groups g join kept k on k.lang = g.lang join sizes s on s.lang = g.lang
            left join totals t on t.lang = g.lang and t.source = g.source
            left join cells c on c.lang = g.lang and c.source = g.source and c.term = k.term
        ),
        apart as (
            select a.lang, a.source, b.source as item, sum(abs(a.p - b.p))::bigint as value
            from priced a join priced b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
        ),
        pairs as (
            select a.lang, a.source, b.source as item, coalesce(value, 0) as value
            from groups a join groups b on a.lang = b.lang and a.source <> b.source
            left join apart x on x.lang = a.lang and x.source = a.source and x.item = b.source
        ),
        ranked as (
            select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item) as rank from pairs
            union all
            select * from (
                select lang, source, 'term', term, p - q, row_number() over (partition by lang, source order by p - q desc, term) as rank
                from priced where n > 0 and p > q
            ) where rank <= 50
        )
        select lang, source, part, item, value, rank::int as rank from ranked
    """,
    "op12_repetition": r"""
        with words as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
        windows as (
            select doc_id, n, i, md5(array_to_string(w[i : i + n - 1], ' ')) as k
            from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from words, (select unnest([3, 8]) as n))
        ),
        twice as (select doc_id, n, k from windows group by doc_id, n, k having count(*) > 1),
        covered as (
            select doc_id, n, count(distinct p) as c
            from (select doc_id, n, unnest(range(i, i + n)) as p from windows semi join twice using (doc_id, n, k)) group by doc_id, n
        ),
        long as (
            select distinct doc_id from (
                select doc_id, md5(array_to_string(w[i : i + 100], ' ')) as k
                from (select doc_id, w, unnest(range(1, len(w) - 99)) as i from words semi join (from covered where n = 8 and c > 100) using (doc_id))
            ) group by doc_id, k having count(*) > 1
        ),
        lines as (
            select doc_id, count(*) - count(distinct line) as n
            from (select doc_id, unnest(string_split(text, chr(10))) as line from words)
            where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id
        ),
        base as (
            select doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
                length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, coalesce(l.n, 0)::bigint as n_dup_lines,
                coalesce(c3.c, 0)::bigint as n_repeat_words, coalesce(c8.c, 0)::bigint as n_covered, doc_id in (from long) as too_long
            from words left join lines l using (doc_id)
            left join (select * from covered where n = 3) c3 using (doc_id)
            left join (select * from covered where n = 8) c8 using (doc_id)
        ),
        judged as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from base)
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
            not base_failed and 100 * n_covered <= 30 * n_words and not too_long as kept, n_covered
        from judged
    """,
    "op13_manifest": r"""
        with recursive fields as (
            select doc_id, source, lang, n_chars, text,
                list_reduce(list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint), lambda crc, c:
                    list_reduce(range(8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(crc, c)), 4294967295::bigint) as inverse
            from documents
        ),
        rows as (
            select *, concat_ws('', case when doc_id is null then '-' else strlen(doc_id::varchar) || ':' || doc_id end,
                case when source is null then '-' else strlen(source) || ':' || source end,
                case when lang is null then '-' else strlen(lang) || ':' || lang end,
                case when n_chars is null then '-' else strlen(n_chars::varchar) || ':' || n_chars end) as head,
                case when inverse % 2 = 1 then replace(text, chr(10), '') else text end as other
            from fields
        ),
        leaves as (
            select doc_id, source, sha256(head || case when text is null then '-' else strlen(text) || ':' || text end) as leaf,
                sha256(head || case when other is null then '-' else strlen(other) || ':' || other end) as shown
            from rows
        ),
        placed as (
            select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by source) as n from leaves
        ),
        tree as (
            select source, 0 as level, pos, n, leaf as digest from placed
            union all
            select source, level + 1, pos // 3, (max(n) + 2) // 3, sha256(string_agg(digest, '' order by pos)) from tree where n > 1 group by source, level, pos // 3
        ),
        subroots as (select source, level as height, digest as subroot, row_number() over (order by source nulls first) - 1 as place, count(*) over () as n from tree where n = 1),
        top as (
            select 0 as level, place as pos, n, subroot as digest from subroots
            union all
            select level + 1, pos // 3, (max(n) + 2) // 3, sha256(string_agg(digest, '' order by pos)) from top where n > 1 group by level, pos // 3
        ),
        nodes as (
            select source, level, pos, digest from tree where n > 1
        ),
        steps as (
            select p.doc_id, p.pos as leaf_at, p.source, t.level as step,
                coalesce(string_agg(t.digest, '' order by t.pos) filter (t.pos < p.pos // (3 ** t.level)::bigint), '') as l,
                coalesce(string_agg(t.digest, '' order by t.pos) filter (t.pos > p.pos // (3 ** t.level)::bigint), '') as r
            from placed p join nodes t on t.source is not distinct from p.source and t.pos // 3 = p.pos // (3 ** (t.level + 1))::bigint
            group by all
            union all
            select p.doc_id, p.pos, p.source, s.height + t.level,
                coalesce(string_agg(t.digest, '' order by t.pos) filter (t.pos < s.place // (3 ** t.level)::bigint), ''),
                coalesce(string_agg(t.digest, '' order by t.pos) filter (t.pos > s.place // (3 ** t.level)::bigint), '')
            from placed p join subroots s on s.source is not distinct from p.source
            join top t on t.n > 1 and t.pos // 3 = s.place // (3 ** (t.level + 1))::bigint
            group by all
        ),
        proofs as (select source, leaf_at, sha256(string_agg(l || r, '' order by step)) as proof from steps group by source, leaf_at),
        folded as (
            select source, pos, 0 as step, shown as digest from placed
            union all
            select f.source, f.pos, f.step + 1, sha256(s.l || f.digest || s.r)
            from folded f join steps s on s.source is not distinct from f.source and s.leaf_at = f.pos and s.step = f.step
        ),
        ends as (select source, pos, arg_max(digest, step) as folded_root from folded group by source, pos)
        select p.doc_id, p.leaf, s.subroot, t.digest as root, coalesce(proof, sha256('')) as proof_sha256, folded_root, folded_root = t.digest as verified
        from placed p join subroots s on s.source is not distinct from p.source cross join (select digest from top where n = 1) t
        left join proofs x on x.source is not distinct from p.source and x.leaf_at = p.pos
        join ends e on e.source is not distinct from p.source and e.pos = p.pos
    """,
}
