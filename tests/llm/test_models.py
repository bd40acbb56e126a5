"""Classifiers, URL rules, token counts, packing and the pipeline: held-out accuracy, brute force, edge cases."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from feedloom.llm import wordgrams

from feedloom.llm.language import calibrate, fit_language, softmax
from feedloom.llm.packing import best_bounds, pack
from feedloom.llm.quality import FEATURES, feature_column, fit_quality
from feedloom.llm.queries import QUERIES, URL_RULES
from feedloom.llm.samples import one_row_each, sample_ids
from feedloom.llm.textarrays import mix
from feedloom.llm.tokens import build, token_counts
from feedloom.llm.toxicity import fit_toxicity
from feedloom.llm.urls import judge_urls, mine_rules

SMALL = "/root/testdata/sf0.01"
ODD_TEXTS = [None, "", " \n\t", "12 34 !!", "one", "x" * 300_000, "ab " * 50_000, "\x00\ufffd 𝒳 é"]


def odd_docs(spark):
    rows = [(i, t, 1) for i, t in enumerate(ODD_TEXTS)] + [(None, "text", 1), (1, "", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, label int").withColumn("id", F.lit("x")).withColumn("score", F.lit(2))


@pytest.mark.parametrize("name, label, least", [("op1_quality", "quality", 0.95), ("op5_toxicity", "toxic", 0.85)])
def test_held_out_accuracy(spark, name, label, least):
    found = QUERIES[name](spark, SMALL).filter("held_out").join(spark.read.parquet(f"{SMALL}/labels.parquet"), "doc_id")
    row = found.agg(F.avg((F.col("predicted") == F.col(label)).cast("int")).alias("right"), F.min("score"), F.max("score")).first()
    assert row[0] >= least and 0 <= row[1] <= row[2] <= 1


def test_held_out_languages(spark):
    found = QUERIES["op3_language"](spark, SMALL).filter("held_out").join(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert found.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] >= 0.98


def test_languages_of_odd_texts(spark):
    train = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([("the house", "en"), ("das haus", "de"), ("no label", None), (None, "en")] * 20)], "doc_id long, text string, lang string")
    odd = odd_docs(spark)
    found = [r["p"] for r in odd.select("*", fit_language(train).predict(F.col("text")).alias("p")).collect()]
    assert [f["label"] == "und" for f in found[:4]] == [True] * 4 and all(f["label"] in ("en", "de") for f in found[4:8])
    blank = fit_language(train.filter("false")).predict(F.col("text"))
    assert {r["p"]["label"] for r in odd.select(blank.alias("p")).collect()} == {"und"}


def test_temperature_lessens_the_loss():
    rng = np.random.default_rng(4)
    truth = rng.integers(0, 3, 500)
    logits = 6 * (rng.normal(size=(500, 3)) + np.eye(3)[truth])
    loss = lambda t: -np.log(softmax(logits / t)[np.arange(500), truth] + 1e-12).mean()
    best = calibrate(logits, truth)
    assert best > 1 and loss(best) < loss(1.0) and loss(best) <= min(loss(best * 1.2), loss(best / 1.2)) + 1e-3


def test_scores_of_odd_texts_and_missing_labels(spark):
    odd = odd_docs(spark)
    labels = spark.createDataFrame([(i, i % 2 if i < 6 else None) for i in range(8)], "doc_id long, quality int").withColumn("toxic", F.col("quality"))
    featured = odd.select("doc_id", feature_column(F.col("text")).alias("features"))
    assert all(len(r["features"]) == len(FEATURES) and np.isfinite(r["features"]).all() for r in featured.collect())
    for some in (labels, labels.filter("quality = 1"), labels.filter("false")):
        good = fit_quality(featured, some).score(F.col("features"))
        toxic = fit_toxicity(odd, some).score(F.col("text"))
        for rows in (featured.select(good.alias("s")).collect(), odd.select(toxic.alias("s")).collect()):
            assert len(rows) == 10 and all(0 <= r["s"] <= 1 for r in rows)
    assert odd.filter("false").select(fit_toxicity(odd, labels).score(F.col("text"))).count() == 0


def test_quality_counts_every_row_and_pair(spark):
    rng = np.random.default_rng(8)
    y = (rng.random(9000) < 0.35).astype(int)
    x = np.zeros((len(y), len(FEATURES)))
    x[:, :3] = rng.normal(size=(len(y), 3)) + y[:, None] * [0.8, -0.5, 0.0]
    # far fewer than all rows would hardly show the last feature
    x[:, 3] = (y == 1) & (rng.random(len(y)) < 0.002)
    docs = spark.createDataFrame([(i, r) for i, r in enumerate(x.tolist())], "doc_id long, features array<double>")
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "doc_id long, quality int")
    model = fit_quality(docs, labels)
    spread = np.where(x.std(axis=0) < 1e-9, 1.0, x.std(axis=0))
    z = (x - x.mean(axis=0)) / spread
    w = model.weights * spread
    lose = 1 / (1 + np.exp((z[y == 1] @ w)[:, None] - (z[y == 0] @ w)[None, :]))
    slope = 1e-3 * w - (lose.mean(axis=1) @ z[y == 1] / (y == 1).sum() - lose.mean(axis=0) @ z[y == 0] / (y == 0).sum())
    assert np.abs(slope).max() < 1e-4
    strength = np.sort(sum(model.weights[i] * x[:, i] for i in range(4)))
    zeros = int((y == 0).sum())
    assert strength[zeros - 1] <= model.threshold <= strength[zeros]
    assert abs(model.threshold - (strength[zeros - 1] + strength[zeros]) / 2) < 1e-9


def test_unseen_misspellings_are_toxic(spark):
    rng = random.Random(2)
    plain = lambda: " ".join("".join(rng.choice("bcdfgh") + rng.choice("aeiou") for _ in range(3)) for _ in range(30))
    rows = [(i, plain() + (" nastyword " if i % 3 == 0 else " nicething ") + plain(), int(i % 3 == 0)) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = fit_toxicity(docs, docs)
    tests = spark.createDataFrame([(1, plain() + " nastywordd"), (0, plain() + " nicethings"), (1, "nnastyword " + plain())], "y int, text string")
    assert all((r["s"] >= 0.3) == bool(r["y"]) for r in tests.select("y", model.score(F.col("text")).alias("s")).collect())


def slow_verdict(url, mined):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fit)[2] if fit else None, max(fit)[3] if fit else mined


def test_url_rules(spark):
    urls = [
        None, "", "no scheme", "http://", "HTTPS://WWW.Example.COM/en/1", "http://example.com/en/", "http://a.example.com/en/x?y=/fr/", "http://x.net/fr/9#a", "http://xnet/fr/",
        "http://net/es/", "http://net/es", "ftp://com", "ftp://com/", "http://É.COM/a", "a://b://c.com/d", "http://x.org?u=/y", "http://x.net#/fr/", "http://x.net/fr/\n/z",
    ]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(3, urls[4])], "page_id long, url string").withColumn("host", F.lit(1)).withColumn("rule", F.lit(2))
    none = spark.createDataFrame([], "rule array<string>, index string, confidence double, support double")
    found = {(r["page"], r["host"], r["path"], r["rule"], r["verdict"]) for r in judge_urls(pages, none, URL_RULES).collect()}
    assert found == {(i, *slow_verdict(u, "allow")) for i, u in list(enumerate(urls)) + [(3, urls[4])]}
    assert judge_urls(pages.filter("false"), none, URL_RULES).count() == 0


def test_mined_rules_equal_counted_ones(spark):
    rng = random.Random(1)
    rows = []
    for i in range(300):
        host, word = rng.choice(["aa", "bb", "cc"]), rng.choice(["win", "read"])
        rows.append((i, f"http://{host}.org/{word}/{i}", int(not (host == "aa" and word == "win")), 0))
    pages = spark.createDataFrame([(i, u) for i, u, *_ in rows] + [(900, None)], "page_id long, url string")
    labels = spark.createDataFrame([(i, q, t) for i, _, q, t in rows] + [(None, 1, 1), (5000, 0, 0), (900, None, None)], "doc_id long, quality int, toxic int")
    mined = mine_rules(pages, labels, confidence=0.9)
    assert [tuple(r["rule"]) for r in mined.collect()] == [("h:aa", "p:win")]
    found = {r["page"]: r["verdict"] for r in judge_urls(pages, mined, []).collect()}
    assert found == {i: "block" if q == 0 else "allow" for i, _, q, _ in rows} | {900: "allow"}
    assert mine_rules(pages, labels.filter("false")).count() == 0


def slow_count(word, pieces):
    n = at = 0
    while at < len(word):
        at += max([k for k in range(1, len(word) - at + 1) if word[at : at + k] in pieces] or [1])
        n += 1
    return n


def test_token_counts(spark):
    rng = random.Random(8)
    pieces = {bytes([c]) for c in b"abc"} | {bytes(rng.choices(b"abc ", k=rng.randrange(1, 6))) for _ in range(60)}
    texts = [None, "", " \n", "abcabc d éa", "a" * 9000] + ["".join(rng.choices("abcd \n", k=60)) for _ in range(80)]
    docs = spark.createDataFrame([(t, 1) for t in texts], "text string, n_tokens int")
    found = [r["n"] for r in docs.select(token_counts(spark, F.col("text"), sorted(pieces)).alias("n")).collect()]
    assert found == [sum(slow_count(b" " + w, pieces) for w in (t or "").encode().split()) for t in texts]
    assert build([]).count(b"xyz") == 3


def test_bounds_have_the_least_padding():
    rng = random.Random(6)
    for _ in range(60):
        n, k = rng.randrange(1, 9), rng.randrange(1, 5)
        lengths, counts = np.array(sorted(rng.sample(range(60), n))), np.array([rng.randrange(1, 9) for _ in range(n)])

        def padding(cuts, lengths=lengths, counts=counts, n=n):
            edges = [0, *cuts, n]
            return sum(((lengths[b - 1] - lengths[a:b]) * counts[a:b]).sum() for a, b in itertools.pairwise(edges))

        best = min(padding(cuts) for m in range(min(k, n)) for cuts in itertools.combinations(range(1, n), m))
        bounds, cost = best_bounds(lengths, counts, k)
        assert cost == best and bounds[-1] == lengths[-1] and len(bounds) <= k


def test_batches_keep_the_budget(spark):
    rng = random.Random(4)
    rows = [(i, " ".join("w" for _ in range(rng.choice([0, 1, 5, 30, 31, 200, 5000])))) for i in range(400)] + [(None, "a b"), (7, None), (7, "a\tb\n c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("batch", F.lit(1)).withColumn("class", F.lit(1))
    found = pack(docs, buckets=4, token_budget=640, group_rows=50).collect()
    assert sorted(((r["id"], r["n_tokens"]) for r in found), key=repr) == sorted(((i, len((t or "").split())) for i, t in rows), key=repr)
    groups = {}
    for r in found:
        assert r["n_tokens"] <= r["bucket_length"]
        groups.setdefault(r["batch"], []).append(r)
    for own in groups.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        assert len({r["bucket_length"] for r in own}) == 1 and (len(own) == 1 or len(own) * own[0]["bucket_length"] <= 640)
    assert pack(docs.filter("false")).count() == 0


def test_rows_without_id_are_dealt_out(spark):
    docs = spark.range(600).selectExpr("cast(null as long) as doc_id", "'a b' as text")
    found = pack(docs, token_budget=1 << 20, group_rows=50).collect()
    assert len(found) == 600 and len({r["batch"] for r in found}) > 6


def test_pipeline_against_brute_force(spark):
    import sys

    import corpus_pipeline
    from test_pairs import jaccard, reach, slow_fingerprint, slow_shingles
    from test_passages import slow_hits, words_of

    sys.setrecursionlimit(10_000)
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("id", F.lit("extra")).withColumn("kept", F.lit(None).cast("string"))
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)
    known = stages["language"](spark, docs, sf_dir)
    assert known.columns == docs.columns and known.count() >= 0.97 * docs.count()
    rows = {r["doc_id"]: r["text"] for r in known.collect()}
    prints = {i: slow_fingerprint(t) for i, t in rows.items()}
    sets = {i: slow_shingles(t) for i, t in rows.items()}
    near = [(a, b) for a in rows for b in rows if a < b and ((prints[a] ^ prints[b]).bit_count() <= 3 or jaccard(sets[a], sets[b]) >= 0.8)]
    root = reach(rows, near)
    single = {i: t for i, t in rows.items() if root[i] == i}
    left = stages["near_duplicates"](spark, known, sf_dir)
    assert {r["doc_id"]: r["text"] for r in left.collect()} == single
    seen, cut = {}, {}
    for i in sorted(single):
        w = words_of(single[i])
        keys = [tuple(w[k : k + 50]) for k in range(len(w) - 49)]
        gone = [False] * len(w)
        for k, key in enumerate(keys):
            if seen.get(key, i) < i:
                gone[k : k + 50] = [True] * 50
        for key in keys:
            seen.setdefault(key, i)
        if not w or not all(gone):
            cut[i] = b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode() if any(gone) else single[i]
    trimmed = stages["repeated_passages"](spark, left, sf_dir)
    assert trimmed.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in trimmed.collect()} == cut
    assert all(r["n_chars"] == len(r["text"]) for r in trimmed.collect() if r["text"] != single[r["doc_id"]])
    clean = {i for i, _, n, _ in slow_hits(list(cut.items()), items) if n == 0}
    assert {r["doc_id"] for r in stages["decontamination"](spark, trimmed, sf_dir).collect()} == clean
    packed = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in packed} == {i: len(cut[i].split()) for i in clean}


def test_rows_of_one_id_are_dealt_out(spark):
    docs = spark.range(900).selectExpr("case when id < 600 then 7 else id end as doc_id", "'a b' as text")
    found = pack(docs, token_budget=1 << 20, group_rows=50).collect()
    sizes = {}
    for r in found:
        sizes[r["batch"]] = sizes.get(r["batch"], 0) + 1
    assert len(found) == 900 and max(sizes.values()) < 120


def test_samples_bound_rows(spark):
    rows = [(i, i % 2) for i in range(300)] + [(7, 1)] * 500 + [(8, 0), (8, 1), (None, 1), (9, None)]
    labelled = spark.createDataFrame(rows, "doc_id long, label int").withColumn("draw", F.lit(1))
    drawn = sample_ids(labelled, "doc_id", "label", 40)
    found = [tuple(r) for r in drawn.collect()]
    assert len(found) == len({i for i, _ in found}) and {y: sum(1 for _, z in found if z == y) for y in (0, 1)} == {0: 40, 1: 40}
    assert all((i, y) in rows for i, y in found)
    everything = sample_ids(labelled, "doc_id", "label", 5000)
    assert {tuple(r) for r in everything.collect()} == {(i, 0 if i == 8 else i % 2) for i in range(300)}
    texts = labelled.select(F.col("doc_id").alias("id"), F.concat(F.lit("t"), F.monotonically_increasing_id().cast("string")).alias("text"))
    assert one_row_each(texts, everything, "text").count() == 300
    assert sample_ids(labelled.filter("false"), "doc_id", "label", 5).count() == 0


def slow_buckets(word, sizes, buckets, keep, whole):
    """The n-grams of a word one by one, hashed as the table hashes them."""
    plain = "".join(c for c in word.decode("utf-8", "replace").lower() if (c.isalpha() if keep == "letters" else c.isalnum()))
    if not plain:
        return []
    framed, found, top = f"<{plain}>", [], 1 << 64
    for n in sizes:
        for k in range(len(framed) - n + 1):
            value = 0
            for c in framed[k : k + n]:
                value = (value * 0x100000001B3 + ord(c)) % top
            found.append(int(mix(np.array([(value + n) % top], np.uint64))[0]) % buckets)
    if whole:
        parts = np.array([(ord(c) + 0x9E37 * k) % top for k, c in enumerate(framed)], np.uint64)
        found.append(int(mix(mix(parts).sum(dtype=np.uint64, keepdims=True))[0]) % buckets)
    return sorted(found)


@pytest.mark.parametrize("size", [3, 50, 1 << 18])
def test_grams_in_slices(monkeypatch, size):
    monkeypatch.setattr(wordgrams, "SLICE", size)
    rng = random.Random(size)
    words = ["".join(rng.choices("abXé1-_𝒳ß", k=rng.randrange(0, 14))).encode() for _ in range(60)]
    weights = np.random.default_rng(1).normal(size=(997, 2))
    for keep, whole in (("letters", False), ("letters and digits", True)):
        found, counts = wordgrams.gram_buckets(words, (1, 2, 4), 997, keep, whole)
        want = [slow_buckets(w, (1, 2, 4), 997, keep, whole) for w in words]
        assert [sorted(own.tolist()) for own in np.split(found, np.cumsum(counts)[:-1])] == want
        sums = wordgrams.linear_words(weights, (1, 2, 4), keep, whole).compute(words)
        assert np.allclose(sums, [[*weights[w].sum(axis=0), len(w)] for w in want])
        text = pa.array([b" ".join(words).decode()])
        for limit in (10, 1 << 20):
            monkeypatch.setattr(wordgrams, "LONG_TEXT", limit)
            ((own, times),) = wordgrams.GramCounter((1, 2, 4), 997, keep, whole).counts(text)
            flat = np.bincount([b for w in want for b in w], minlength=997)
            assert (own == np.flatnonzero(flat)).all() and (times == flat[own]).all()


def test_a_word_of_millions_of_letters_takes_little_memory():
    import tracemalloc

    column = pa.array(["x" * 4_000_000])
    tracemalloc.start()
    ((own, times),) = wordgrams.GramCounter((1, 2, 3), 1 << 14).counts(column)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert times.sum() == 3 * 4_000_002 - 3 and peak < 120_000_000


@pytest.mark.parametrize("name, table", [("op1_quality", "quality"), ("op3_language", None), ("op5_toxicity", "toxic")])
def test_rows_without_id_are_not_held_out(spark, tmp_path, name, table):
    rows = [(i if i % 9 else None, f"{'good words here' if i % 2 else 'bad stuff there'} {i}", "en" if i % 2 else "de") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("held_out", F.lit("x")).withColumn("label", F.lit(3))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = docs.selectExpr("doc_id", "cast(lang = 'en' as int) as quality", "cast(lang = 'de' as int) as toxic")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    found = QUERIES[name](spark, str(tmp_path)).collect()
    assert len(found) == 60 and all(r["held_out"] in (True, False) for r in found)
    assert all(r["held_out"] is False for r in found if r["doc_id"] is None)
    docs.filter("false").write.parquet(f"{tmp_path}/none/documents.parquet")
    labels.write.parquet(f"{tmp_path}/none/labels.parquet")
    assert QUERIES[name](spark, f"{tmp_path}/none").count() == 0


def slow_rules(baskets, support, confidence, longest):
    """Every rule that reaches both bounds and that no shorter one makes needless, by counting subsets."""
    tokens = sorted({t for items, _ in baskets for t in items})
    pages = {t: frozenset(i for i, (items, _) in enumerate(baskets) if t in items) for t in tokens}
    first = {}
    for t in tokens:
        first.setdefault(pages[t], t)
    found = {}
    for n in range(1, longest + 1):
        for rule in itertools.combinations(sorted(first.values()), n):
            own = frozenset.intersection(*(pages[t] for t in rule))
            hit = sum(baskets[i][1] for i in own)
            if hit and hit >= support * len(baskets) and hit / len(own) >= confidence:
                found[rule] = hit / len(own)
    return {r: c for r, c in found.items() if not any(set(p) < set(r) and d >= c for p, d in found.items())}


def test_shared_parameters_do_not_multiply_the_rules(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        hot = i % 20 == 0
        query = "&".join(f"p{j}" for j in range(14)) + ("&odd" if rng.random() < 0.5 else "") if hot else ""
        rows.append((i, f"http://{'aa' if hot else rng.choice('bc')}.org/{rng.choice(['x', 'y'])}?{query}", int(not hot or rng.random() < 0.3)))
    pages = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int")
    mined = {tuple(r["rule"]): r["confidence"] for r in mine_rules(pages, labels, support=0.005, confidence=0.5).collect()}
    baskets = []
    for _, url, good in rows:
        host, rest = url[7:].split("/", 1)
        path, query = rest.split("?")
        baskets.append(({"s:http", f"p:{path}", *(f"h:{h}" for h in host.split(".")), *(f"q:{q}" for q in query.split("&") if q)}, 1 - good))
    want = slow_rules(baskets, 0.005, 0.5, 5)
    assert mined.keys() == want.keys() and all(abs(mined[r] - c) < 1e-9 for r, c in want.items())
