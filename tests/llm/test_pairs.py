"""Near-duplicates, components and vectors against brute force, and their edge cases."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from feedloom.llm import components as component_tables
from feedloom.llm import resemblance
from feedloom.llm.components import components
from feedloom.llm.resemblance import similar_links
from feedloom.llm.simhash import fingerprint, near_fingerprints, simhash_groups
from feedloom.llm.vectors import close_pairs, quantise, vector_links


def reach(nodes, links):
    """Smallest node reachable from each."""
    root = {n: n for n in nodes}

    def up(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = up(a), up(b)
        root[max(a, b)] = min(a, b)
    return {n: up(n) for n in nodes}


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(7, 7), (200, 201), (201, 200)]
    links += [(300 + rng.randrange(60), 300 + rng.randrange(60)) for _ in range(35)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = reach({n for x in links for n in x}, links)
    assert all(found.get(n, n) == c for n, c in want.items())
    hubs = [(0, i) for i in range(1, 200)] + [(i, 500) for i in range(150, 300)] + [(1000 + i, 900) for i in range(180)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(hubs, "a long, b long")).collect()}
    assert found == reach({n for x in hubs for n in x}, hubs)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def slow_shingles(text, n=5):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def slow_fingerprint(text):
    words = [w for w in (text or "").encode().lower().replace(b"\t", b" ").replace(b"\n", b" ").split(b" ") if w]
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    for text in ["", " \n", "One", "one two", "A b c", "the cat the cat the cat the cat", "É é Straße x", "w " * 70_000]:
        assert fingerprint(text.encode()) == slow_fingerprint(text)


@pytest.mark.parametrize("home_rows, chunk_rows", [(2048, 8192), (20, 7)])
def test_trie_join_finds_every_component(spark, home_rows, chunk_rows):
    rng = random.Random(5)
    known = [rng.getrandbits(64) for _ in range(60)]
    for x in known[:40]:
        for _ in range(4):
            y = x
            for _ in range(rng.randrange(1, 5)):
                y ^= 1 << rng.randrange(64)
            known.append(y)
    known = sorted(set(known))
    signed = [x - (1 << 64) if x >> 63 else x for x in known]
    links = near_fingerprints(spark.createDataFrame([(x,) for x in signed], "fingerprint long"), 3, home_rows, chunk_rows)
    found = reach(signed, [(r["x"], r["y"]) for r in links.collect()])
    want = reach(signed, [(signed[i], signed[j]) for i in range(len(known)) for j in range(i) if (known[i] ^ known[j]).bit_count() <= 3])
    assert found == want


def test_simhash_rows_nulls_and_clashing_columns(spark):
    text = " ".join(f"word{i}" for i in range(400))
    rows = [(5, text, 1), (3, text + " more", 1), (9, None, 1), (8, "", 1), (None, text, 1), (5, text, 1), (7, "quite another text altogether", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint long").withColumn("component", F.lit("x"))
    found = sorted(((r["id"], r["fingerprint"], r["component"]) for r in simhash_groups(docs).collect()), key=repr)
    assert len(found) == 7
    by_id = {i: c for i, _, c in found}
    near = (slow_fingerprint(text) ^ slow_fingerprint(text + " more")).bit_count() <= 3
    assert by_id == {5: 3 if near else 5, 3: 3, 9: 8, 8: 8, None: None, 7: 7}
    assert simhash_groups(docs.filter("false")).count() == 0


def test_quantisation_bounds_hold():
    rng = np.random.default_rng(2)
    u = rng.normal(size=(300, 48))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    q, s, e = quantise(u)
    rough = (s[:, None] * q) @ (s[:, None] * q).T
    assert (np.abs(u @ u.T - rough) <= e[:, None] * (1 + e) + e).all()


@pytest.mark.parametrize("dims", [3, 64, 1500])
def test_close_pairs_equal_brute_force(dims):
    rng = np.random.default_rng(dims)
    u = np.repeat(rng.normal(size=(60, dims)), 5, axis=0) + rng.normal(size=(300, dims)) * 0.2
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    rows = np.arange(300)
    found = {(min(a, b), max(a, b)) for p, q in close_pairs(u, rows, rows, 0.95, True) for a, b in zip(p.tolist(), q.tolist(), strict=True)}
    exact = u @ u.T
    assert found == {(i, j) for i in range(300) for j in range(i + 1, 300) if exact[i, j] >= 0.95}


@pytest.mark.parametrize("block", [4096, 16])
def test_vector_links(spark, block):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(20, 16))
    vectors = [(base[i % 20] + rng.normal(size=16) * 0.12).tolist() for i in range(90)]
    vectors += [vectors[0], vectors[0], [0.0] * 16, [float("nan")] * 16, [1.0, None] * 8, None, [], [float("inf")] + [0.0] * 15, [1e38] * 16, [1e-38] * 16, [1.0, 2.0]]
    rows = [(i, v, i) for i, v in enumerate(vectors)]
    found = {r["id"]: (r["n_links"], r["component"]) for r in vector_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int"), block=block).collect()}

    def usable(v):
        return v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    unit = {i: np.array(v) / max(map(abs, v)) for i, v, _ in rows if usable(v)}
    unit = {i: v / np.linalg.norm(v) for i, v in unit.items()}
    links = [(i, j) for i in unit for j in unit if i < j and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.95]
    root = reach(range(len(rows)), links)
    assert found == {i: (sum(i in x for x in links), root[i]) for i in range(len(rows))}
    assert vector_links(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("block", [4096, 4])
def test_vector_links_without_and_with_shared_ids(spark, block):
    def at(*degrees):
        return [[float(np.cos(np.radians(d))), float(np.sin(np.radians(d)))] for d in degrees]

    # 18 degrees link, 19 do not; ids beyond 2**53 differ by one
    big = 2**60
    angles = [(5, 0), (big + 1, 30), (None, 15), (big, 90), (big + 2, 100), (None, 180), (None, 185), (7, 240), (7, 300), (9, 310), (8, 250), (None, 240), (None, None)]
    rows = [(i, at(d)[0] if d is not None else None) for i, d in angles]
    found = vector_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), block=block).collect()

    def link(a, b):
        return a != b and None not in (angles[a][1], angles[b][1]) and abs(angles[a][1] - angles[b][1]) < 18.2

    n = range(len(rows))
    root = reach(n, [(a, b) for a in n for b in n if link(a, b)])
    want = []
    for k, (i, _) in enumerate(angles):
        ids = [angles[j][0] for j in n if root[j] == root[k] and angles[j][0] is not None]
        want.append((i, sum(link(k, j) for j in n), min(ids) if i is not None else None))
    assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)


def similar_rows(seed=3):
    """Families of texts whose copies lose, gain or change words, some close to 0.8, beside odd rows."""
    rng = random.Random(seed)
    rows = []
    for family in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([6, 30, 90, 300]))]
        rows.append(" ".join(base))
        for _ in range(6):
            words = list(base)
            for _ in range(rng.randrange(1 + len(base) // 12)):
                at = rng.randrange(len(words))
                words[at : at + 1] = rng.choice([[], [f"new{rng.randrange(9)}"], [words[at], words[at]]])
            rows.append(" ".join(words))
    rows += ["One two", "one  TWO", "one two three four five", "", None, " \n", "a b a b a b a b a b", "word " * 40_000, "word " * 50_000]
    return [(i, t) for i, t in enumerate(rows)]


def test_similar_links_span_all_pairs_at_the_threshold(spark):
    rows = similar_rows()
    sets = {i: slow_shingles(t) for i, t in rows}
    want = reach(sets, [(a, b) for a in sets for b in sets if a < b and jaccard(sets[a], sets[b]) >= 0.8])
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, node int, size int").repartition(3)
    found = [tuple(r) for r in similar_links(docs).collect()]
    assert reach(sets, found) == want
    assert any(want[i] != i and sets[i] != sets[want[i]] for i in want)


def test_similar_links_compare_across_components(spark):
    """Many texts alike, of which strays resemble only some: no link between components is lost."""
    base = [f"b{i}" for i in range(100)]
    rows = [(i, " ".join(base[i : i + 60])) for i in range(0, 40, 4)]
    rows += [(100 + i, " ".join([f"x{i}-{k}" for k in range(30)] + base[40:70])) for i in range(20)]
    sets = {i: slow_shingles(t) for i, t in rows}
    want = reach(sets, [(a, b) for a in sets for b in sets if a < b and jaccard(sets[a], sets[b]) >= 0.8])
    found = [tuple(r) for r in similar_links(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert reach(sets, found) == want
    assert all(want[i] == i for i in sets if i >= 100)


@pytest.mark.parametrize("rows_at_once, hashes_at_once", [(1 << 13, 1 << 20), (30, 2000)])
def test_texts_alike_are_not_expanded_into_pairs(spark, monkeypatch, rows_at_once, hashes_at_once):
    """Texts too unlike to link but near enough to be judged: no table has a row for each pair of them."""
    monkeypatch.setattr(resemblance, "CHUNK_ROWS", rows_at_once, raising=False)
    monkeypatch.setattr(resemblance, "CHUNK_HASHES", hashes_at_once, raising=False)
    counts, plain = {}, component_tables.write_scratch

    def counted(df, name):
        table, path = plain(df, name)
        counts[name] = max(counts.get(name, 0), table.count())
        return table, path

    monkeypatch.setattr(component_tables, "write_scratch", counted)
    monkeypatch.setattr(resemblance, "write_scratch", counted)
    rng = random.Random(8)
    rows = []
    for i in range(160):
        words = [f"w{k}" for k in range(100)]
        for at in rng.sample(range(100), 2):
            words[at] = f"x{i}-{at}"
        rows.append((i, " ".join(words)))
    sets = {i: slow_shingles(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and jaccard(sets[a], sets[b]) >= 0.8]
    found = [tuple(r) for r in similar_links(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert reach(sets, found) == reach(sets, links) and links
    assert max(counts.values()) <= 30 * len(rows) < 160 * 159 // 4, counts


def test_similar_links_of_odd_rows(spark):
    same = "some words that are long enough to make a few shingles of five"
    rows = [(None, same), (1, same), (1, same + " x"), (2, same), (2, "quite another text of seven words"), (3, None), (4, None), (5, "")]
    found = reach({1, 2, 3, 4, 5}, [tuple(r) for r in similar_links(spark.createDataFrame(rows, "doc_id long, text string")).collect()])
    assert found == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert similar_links(empty).collect() == []
    with pytest.raises(ValueError):
        similar_links(empty, similarity=0.5)
