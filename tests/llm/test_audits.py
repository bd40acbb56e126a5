"""Divergence of sources, repetition rules and the Merkle manifest against brute force, and their edge cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedloom.llm.divergence import Tree, joint, source_divergence, terms_of
from feedloom.llm.merkle import digest_of, levels_of, merkle_proofs, proof_digest, refold
from feedloom.llm.repetition import RepetitionRules, judge_repetition, maximal_repeats, suffix_array

TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    upper, lower = (bytes(range(a, a + 26)) for a in (0x41, 0x61))
    return [t.translate(bytes.maketrans(upper, lower)) for t in TERM.findall((text or "").encode())]


def slow_divergence(rows, least=30, top=50):
    docs = [(lang or "", source or "", Counter(terms(text))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df, total, by_source = Counter(), Counter(), defaultdict(Counter)
        for _, source, counts in own:
            df.update(counts.keys())
            total.update(counts)
            by_source[source].update(counts)
        kept = sorted(t for t in df if df[t] >= least)

        def prices(counts):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 5) // (n + 5 * len(kept)) for t in kept}

        p, q = {s: prices(c) for s, c in by_source.items()}, prices(total)
        for s in p:
            apart = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in p if o != s]
            more = [(q[t] - p[s][t], t) for t in kept if by_source[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(apart)), ("term", sorted(more)[:top])):
                out += [(lang, s, part, item.decode(), -value, rank) for rank, (value, item) in enumerate(found, 1)]
    return sorted(out)


def spoken(seed, n_docs=160, n_sources=13):
    rng = random.Random(seed)
    words = ["Éa", "b", "C", "d'e", "日本", "x1y"] + [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(40)]
    rows = []
    for k in range(n_docs):
        lang, source = rng.choice(["en", "en", "de", None]), rng.choice([None, "", *(f"s{rng.randrange(n_sources)}" for _ in range(4))])
        some = words[: rng.randrange(3, len(words))]
        rows.append((" ".join(rng.choice(some) for _ in range(rng.randrange(0, 60))), lang, source))
    return rows + [(None, "en", "s1"), ("", "xx", "only"), ("1 2 3", "yy", "a"), ("4", "yy", "b"), rows[0], rows[0]]


@pytest.mark.parametrize("seed, least, rows, columns", [(1, 30, 64, 1024), (2, 4, 3, 5), (3, 1, 2, 1024), (4, 10, 64, 7)])
def test_divergence(spark, seed, least, rows, columns):
    texts = spoken(seed)
    docs = spark.createDataFrame(texts, "text string, lang string, source string").withColumn("block", F.lit(1)).withColumn("n", F.lit("n")).withColumn("term", F.lit("t")).repartition(5)
    found = source_divergence(docs, least_docs=least, top_terms=7, rows=rows, columns=columns).collect()
    assert sorted(tuple(r) for r in found) == slow_divergence(texts, least, 7)


def test_divergence_of_few_rows(spark):
    empty = spark.createDataFrame([], "text string, lang string, source string")
    assert source_divergence(empty).collect() == []
    alone = spark.createDataFrame([("a b", None, None)], empty.schema)
    assert source_divergence(alone).collect() == []
    assert [tuple(r) for r in source_divergence(alone, least_docs=1).collect()] == []
    twins = spark.createDataFrame([("a b", "l", None), ("a b b", "l", "z")] * 2, empty.schema)
    assert sorted(tuple(r) for r in source_divergence(twins, least_docs=1).collect()) == slow_divergence([("a b", "l", None), ("a b b", "l", "z")] * 2, 1)


def test_terms_of_long_texts():
    text = "Ab1é_" * 700_000 + "z"
    found = [t for some in terms_of(text) for t in some]
    assert found == terms(text)


@pytest.mark.parametrize("seed", range(6))
def test_joint_traversal(seed):
    rng = np.random.default_rng(seed)
    side, n_a, n_b, width = 32, int(rng.integers(1, 30)), int(rng.integers(1, 30)), int(rng.integers(0, 33))
    dense, trees = [], []
    for n in (n_a, n_b):
        zero = rng.integers(1, 50, n)
        cells = np.repeat(zero[:, None], width, axis=1)
        rows, columns = np.nonzero(rng.random((n, width)) < 0.05)
        cells[rows, columns] = rng.integers(50, 99, len(rows))
        dense.append(cells)
        trees.append(Tree(zero, side, rows, columns, cells[rows, columns], width))
    want = np.abs(dense[0][:, None, :] - dense[1][None, :, :]).sum(axis=2)
    assert (joint(*trees, side, width, False) == want).all()
    own = np.abs(dense[0][:, None, :] - dense[0][None, :, :]).sum(axis=2)
    above = np.triu_indices(n_a, 1)
    assert (joint(trees[0], trees[0], side, width, True)[above] == own[above]).all()


def slow_repeats(words, least):
    """Maximal repeated substrings as {(words, ...): places}, and the words they cover."""
    places = defaultdict(list)
    for i in range(len(words)):
        for j in range(i + least, len(words) + 1):
            places[tuple(words[i:j])].append(i)
    found, covered = {}, set()
    for part, at in places.items():
        if len(at) < 2:
            continue
        covered.update(k for i in at for k in range(i, i + len(part)))
        left = {words[i - 1] if i else None for i in at}
        right = {words[i + len(part)] if i + len(part) < len(words) else None for i in at}
        if len(left) > 1 and len(right) > 1:
            found[part] = at
    return found, covered


def slow_repetition(text, rules):
    words = (text or "").encode().split()
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    again = {k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(i, i + 3)}
    lines = [line for line in re.split("\n", text or "") if re.search(r"[^\x20\x09-\x0D]", line)]
    found, covered = slow_repeats(words, rules.least_words)
    longest = max(map(len, found), default=0)
    failed = len(words) < rules.least_text or 100 * len(again) > rules.most_repeat_percent * len(words)
    kept = not failed and 100 * len(covered) <= rules.most_covered_percent * len(words) and longest <= rules.longest
    chars = sum(len(w.decode()) for w in words)
    return (len(words), chars, sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(again), len(covered), len(found), longest, failed, kept)


def repetitive(seed):
    rng = random.Random(seed)
    some = lambda n, k: " ".join(rng.choice("abcdefghijklmnopqrstuvwxyzäé#")[: rng.randrange(1, 3)] + str(rng.randrange(k)) for _ in range(n))
    shared = [some(n, 5) for n in (4, 7, 11)]
    rows = [rng.choice("\n \t").join(rng.choice([some(rng.randrange(1, 30), 2), *shared]) for _ in range(rng.randrange(1, 9))) for _ in range(25)]
    return rows + [None, "", " \n\n ", "a " * 60, "a b " * 40, "a b\na b\n a b\na b", "x\x0by z \x1c", "#$%&|<>* " * 3, rows[0], "a " * 59 + "b", " ".join(map(str, range(60)))]


@pytest.mark.parametrize("seed", range(3))
def test_repetition(spark, seed):
    texts = repetitive(seed)
    rules = RepetitionRules(least_words=4, most_covered_percent=40, longest=9, least_text=20)
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").withColumn("id", F.lit(1)).withColumn("kept", F.lit("x")).repartition(3)
    found = {r["id"]: r for r in judge_repetition(docs, rules=rules).collect()}
    for k, text in enumerate(texts):
        r = found[k]
        got = tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "n_maximal", "longest_words", "base_failed", "kept"))
        assert got == slow_repetition(text, rules), text
        words = (text or "").encode().split()
        repeats, covered = slow_repeats(words, rules.least_words)
        assert {w for s in r["spans"] for w in range(s["start"], s["stop"])} == covered
        if r["longest_words"]:
            part = tuple(words[r["longest_places"][0] :][: r["longest_words"]])
            assert repeats[part] == r["longest_places"]


def test_repetition_of_no_rows(spark):
    assert judge_repetition(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_suffix_array_of_long_texts():
    codes = np.concatenate([np.zeros(150_000, np.int64), np.arange(3), np.zeros(1000, np.int64)])
    owner = np.concatenate([np.zeros(150_000, np.int64), np.ones(1003, np.int64)])
    order, common = suffix_array(codes, owner)
    assert common[:150_000].tolist() == list(range(150_000))
    assert order[:150_000].tolist() == list(range(149_999, -1, -1))
    before = np.concatenate([[-1], codes[:-1]])
    assert sum(1 for _ in maximal_repeats(order[:150_000], common[:150_000], before, 8)) == 150_000 - 8


def slow_digest(*values):
    return hashlib.sha256("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values).encode()).hexdigest()


def slow_proofs(digests):
    proofs, at, now = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(now) > 1:
        for k, place in enumerate(at):
            run = range(place // 3 * 3, min(len(now), place // 3 * 3 + 3))
            proofs[k].append(("".join(now[i] for i in run if i < place), "".join(now[i] for i in run if i > place)))
        now = [hashlib.sha256("".join(now[i : i + 3]).encode()).hexdigest() for i in range(0, len(now), 3)]
        at = [place // 3 for place in at]
    return now[0], proofs


def slow_manifest(rows):
    """(id, digest): (proof, subroot, root) with repeated rows in a list."""
    by_source = defaultdict(list)
    for i, source, text in rows:
        by_source[source].append((i, slow_digest(i, source, text)))
    trees = {}
    for source, leaves in by_source.items():
        leaves.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[source] = (leaves, *slow_proofs([d for _, d in leaves]))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    root, tops = slow_proofs([trees[s][1] for s in order])
    found = defaultdict(list)
    for source, top in zip(order, tops, strict=True):
        leaves, subroot, proofs = trees[source]
        for leaf, proof in zip(leaves, proofs, strict=True):
            found[leaf].append((proof + top, subroot, root))
    return {k: sorted(v) for k, v in found.items()}


@pytest.mark.parametrize("n, n_sources, height", [(1, 1, 5), (3, 3, 5), (40, 1, 1), (90, 14, 1), (200, 4, 2), (150, 30, 5)])
def test_manifest(spark, n, n_sources, height):
    rng = random.Random(n)
    rows = [(k if k % 17 else None, rng.choice([None, "", *(f"é{s}" for s in range(n_sources))]) if n > 5 else f"{k}", rng.choice([None, "", "a\nb", "ä", f"t{k}"])) for k in range(n)]
    rows += rows[:2] if n > 5 else []
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(4)
    leaves = docs.select("doc_id", "source", digest_of(F.col("doc_id"), F.col("source"), F.col("text")).alias("leaf"), F.lit(1).alias("size"), F.lit("x").alias("tree"), F.lit(2).alias("index"))
    found = merkle_proofs(leaves, "doc_id", "source", "leaf", height)
    got = defaultdict(list)
    for r in found.select("*", proof_digest(F.col("proof")).alias("digest"), refold(F.col("leaf"), F.col("proof")).alias("again"), refold(F.lit("00"), F.col("proof")).alias("other")).collect():
        got[r["doc_id"], r["leaf"]].append(([tuple(s) for s in r["proof"]], r["subroot"], r["root"]))
        assert r["digest"] == hashlib.sha256("".join(a + b for a, b in r["proof"]).encode()).hexdigest()
        assert r["again"] == r["root"] != r["other"]
        assert (r["size"], r["tree"], r["index"]) == (1, "x", 2)
    assert {k: sorted(v) for k, v in got.items()} == slow_manifest(rows)


def test_manifest_of_no_rows(spark):
    leaves = spark.createDataFrame([], "doc_id long, source string, leaf string")
    assert merkle_proofs(leaves, "doc_id", "source", "leaf").collect() == []
    assert [levels_of(n) for n in (1, 2, 3, 4, 9, 10, 27, 28)] == [0, 1, 1, 2, 2, 3, 3, 4]
