"""Repeated passages and benchmark matches against brute force, and their edge cases."""

import hashlib
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from feedloom.llm import decontaminate
from feedloom.llm.decontaminate import benchmark_matches, hit_words
from feedloom.llm.substrings import substring_dedup


def words_of(text):
    return (text or "").encode().split()


def slow_removal(rows, window=50):
    least = {}
    for i, text in rows:
        w = words_of(text)
        if i is not None:
            for k in range(len(w) - window + 1):
                key = tuple(w[k : k + window])
                least[key] = min(least.get(key, i), i)
    out = []
    for i, text in rows:
        w = words_of(text)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if i is not None and least[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def passages(seed):
    rng = random.Random(seed)
    some = lambda n, k=400: " ".join(f"w{rng.randrange(k)}" for _ in range(n))
    shared = [some(n) for n in (50, 49, 73, 160)]
    rows = [(i, some(rng.randrange(5, 90)) + "\n" + rng.choice(shared) + " " + some(rng.randrange(0, 60)) + "\t" + rng.choice(shared)) for i in rng.sample(range(900), 40)]
    rows += [(1000, rows[3][1]), (1001, rows[3][1].replace("\n", "  ")), (1002, "a " * 300), (1003, "a " * 120), (1004, "b " + "a " * 60), (1005, "x y " * 90)]
    rows += [(1006, "y x " * 60), (1007, None), (1008, ""), (1009, " \n"), (None, rows[5][1]), (rows[0][0], rows[0][1]), (rows[0][0], rows[1][1]), (1010, some(49, 3)), (1011, some(400, 2)), (1012, some(400, 2))]
    return rows


@pytest.mark.parametrize("seed, group_rows, hot_rows", [(1, 30_000, 200_000), (2, 10, 200_000), (3, 10, 1), (4, 30_000, 4)])
def test_removed_passages(spark, seed, group_rows, hot_rows):
    rows = passages(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit(1)).withColumn("id", F.lit(2)).repartition(5)
    found = substring_dedup(docs, group_rows=group_rows, hot_rows=hot_rows).collect()
    assert sorted(((r["id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found), key=repr) == slow_removal(rows)


def test_removal_gives_texts_and_takes_empty_tables(spark):
    rows = [(1, " ".join(map(str, range(60)))), (2, "start  here " + " ".join(map(str, range(60))) + "\nend"), (3, "short"), (4, " ".join(map(str, range(60))))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["id"]: (r["n_removed"], r["kept"]) for r in substring_dedup(docs, with_text=True).collect()}
    assert found == {1: (0, None), 2: (60, "start here end"), 3: (0, None), 4: (60, "")}
    assert substring_dedup(docs.filter("false")).count() == 0


def slow_hits(docs, items, window=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for item, text in items:
        w = split(text)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if w and item is not None else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(item)
    out = []
    for i, text in docs:
        w, hit, names = split(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    names |= own
        out.append((i, len(w), len(hit), sorted(names)))
    return sorted(out, key=repr)


def suspects(seed):
    rng = random.Random(seed)
    some = lambda n: " ".join(rng.choice(["Alpha", "beta", "γάμμα", "d3lta", "eps", "zeta", "ETA", "theta"]) for _ in range(n))
    items = [(i, some(rng.choice([3, 7, 10, 11, 25, 40]))) for i in range(25)]
    items += [(30, items[0][1]), (3, "another text of item three"), (31, ""), (32, None), (None, some(12)), (33, "single"), (34, "!?")]
    docs = [(i, some(rng.randrange(80)) + rng.choice([" -- ", "... "]) + rng.choice(items)[1].__str__() + "; " + some(rng.randrange(9))) for i in range(60)]
    return docs + [(70, None), (71, ""), (72, "single"), (73, items[4][1].upper()), (5, docs[0][1]), (None, docs[1][1]), (74, "x " * 5000 + "Single")], items


@pytest.mark.parametrize("seed, block_bytes", [(1, 16 << 20), (2, 300), (3, 16 << 20)])
def test_benchmark_matches(spark, seed, block_bytes):
    docs, items = suspects(seed)
    found = benchmark_matches(
        spark.createDataFrame(docs, "doc_id long, text string").withColumn("matches", F.lit(1)).repartition(4),
        spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(9)),
        block_bytes=block_bytes,
    )
    got = found.select("id", "n_words", hit_words("matches").alias("n"), F.array_sort(F.array_distinct("matches.item")).alias("items")).collect()
    assert sorted(((r["id"], r["n_words"], r["n"], r["items"]) for r in got), key=repr) == slow_hits(docs, items)


def test_longest_matches_have_their_places(spark):
    item = " ".join(f"q{i}" for i in range(30))
    text = "before it " + " ".join(f"q{i}" for i in range(4, 26)) + " after"
    found = benchmark_matches(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")).first()
    assert [tuple(m) for m in found["matches"]] == [(2, 22, 7)]
    none = benchmark_matches(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")).first()
    assert (none["n_words"], none["matches"]) == (25, [])


def test_short_items_beside_many_words(spark):
    base = "one two three four five six seven eight nine"
    items = [(i, f"{base} v{i}") for i in range(700)] + [(900, "short item"), (901, "v5 v6 v7")]
    docs = [(j, f"{base} v{j}") for j in range(0, 700, 3)] + [(800, f"v5 v6 v7 {base} v9 short item"), (801, f"{base} v9x")]
    found = benchmark_matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = found.select("id", "n_words", hit_words("matches").alias("n"), F.array_sort(F.array_distinct("matches.item")).alias("items")).collect()
    assert sorted(((r["id"], r["n_words"], r["n"], r["items"]) for r in got), key=repr) == slow_hits(docs, items)


@pytest.mark.parametrize("hot_rows", [200_000, 1])
def test_words_with_like_hashes_are_told_apart(spark, hot_rows):
    # pairs of words whose hashes agree in their upper half
    rows = []
    for k, pair in enumerate([("id143777", "id219466"), ("id5235", "id258152")]):
        around = [f"p{k}w{i}" for i in range(60)]
        rows += [(10 * k + j, " ".join([*around[:30], word, *around[30:59]])) for j, word in enumerate(pair)]
        rows += [(10 * k + 5, rows[-1][1] + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = substring_dedup(docs, hot_rows=hot_rows).collect()
    assert sorted(((r["id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found), key=repr) == slow_removal(rows)
    assert sorted((r["id"], r["n_removed"]) for r in found) == [(0, 0), (1, 0), (5, 60), (10, 0), (11, 0), (15, 60)]


def test_windows_that_many_items_share(spark, monkeypatch):
    prompt = " ".join(f"p{i}" for i in range(30))
    items = [(i, f"{prompt} item{i} {'x ' * (i % 3)}end") for i in range(2000)]
    docs = [(i, f"text {i} {prompt} item{i % 7} and {prompt[:60]} {prompt} item{i + 5}") for i in range(30)]
    found = benchmark_matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = found.select("id", "n_words", hit_words("matches").alias("n"), F.array_sort(F.array_distinct("matches.item")).alias("items")).collect()
    assert sorted(((r["id"], r["n_words"], r["n"], r["items"]) for r in got), key=repr) == slow_hits(docs, items)
    tests = decontaminate.index_items([i for i, _ in items[:50]], [t for _, t in items[:50]])
    part = next(decontaminate.texts(pa.array([t for _, t in docs])))
    _, whole = decontaminate.shard_matches(part, tests)
    monkeypatch.setattr(decontaminate, "INSTANCES", 1)
    _, parted = decontaminate.shard_matches(part, tests)
    assert len(whole) > 30 * 50 and (whole == parted).all()
