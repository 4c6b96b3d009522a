"""SimHash, near copies and substring deduplication against brute force."""

import hashlib
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from ripplescope.llm import components, near_copies, simhash, substring

from .helpers import awkward, empty, got, lower, random_text, table, words


def brute_fingerprint(text):
    w = words(lower(text))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(n, linked):
    parent = [*range(n)]

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            if root(i) != root(j) and linked(j, i):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(n)]


def test_simhash_against_brute_force(spark):
    rows = awkward()
    prints = [brute_fingerprint(t) for _, t in rows]
    root = groups(len(rows), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 2)
    least = {r: min((i for (i, _), q in zip(rows, root) if q == r and i is not None), default=None) for r in root}
    want = sorted(((i, f"{p:016x}", least[r]) for (i, _), p, r in zip(rows, prints, root)), key=lambda r: tuple((v is None, str(v)) for v in r))
    assert got(simhash.simhash_components(table(spark, rows)), "doc_id", "fingerprint", "component_id") == want
    assert simhash.simhash_components(empty(spark)).count() == 0


@pytest.mark.parametrize("cap", [4, 2048])
def test_links_with_large_shards(spark, cap):
    """Clusters, chains and lone fingerprints; a small cap sends shards through the balls."""
    rnd, values = random.Random(5), set()
    for _ in range(6):
        x = rnd.getrandbits(64)
        for _ in range(40):
            values.add(x)
            x ^= sum(1 << b for b in rnd.sample(range(64), rnd.choice((1, 2, 2, 3))))
    values |= {rnd.getrandbits(64) for _ in range(50)} | {0, 1, (1 << 64) - 1}
    values = sorted(values)
    root = groups(len(values), lambda i, j: (values[i] ^ values[j]).bit_count() <= 2)
    marks = spark.createDataFrame([(simhash._signed(v),) for v in values], "fp long")
    found = dict(got(components.connected_components(simhash.near_links(marks, 2, cap)), "node", "root"))
    classes, brute = {}, {}
    for v, r in zip(values, root):
        classes.setdefault(found.get(simhash._signed(v), simhash._signed(v)), set()).add(v)
        brute.setdefault(r, set()).add(v)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, brute.values()))


def test_block_tables_meet_every_pair():
    for n, radius in ((10, 2), (1 << 30, 2), (1 << 38, 2), (1000, 3)):
        masks = simhash.block_tables(n, radius)
        rnd = random.Random(n)
        for _ in range(200):
            d = sum(1 << b for b in rnd.sample(range(64), radius))
            assert any(not d & m for m in masks)


def test_tree_follows_all_edges_in_the_radius():
    rnd, tree = random.Random(1), simhash.BKTree()
    values = [rnd.getrandbits(12) for _ in range(300)]
    for v in values:
        tree.add(v)
    for q in range(0, 4096, 97):
        assert sorted(tree.within(q, 2)) == [i for i, v in enumerate(values) if (v ^ q).bit_count() <= 2]


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(5, 5), (200, 201), (201, 200)]
    found = dict(got(components.connected_components(spark.createDataFrame(edges, "u long, v long")), "node", "root"))
    assert found == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 130)}, 201: 200}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_shingles(text, k=5):
    w = words(lower(text))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def near(a, b):
    return a == b if not a or not b else len(a & b) / len(a | b) >= 0.8


@pytest.mark.parametrize("cap", [8, 1024])
def test_near_copies_against_brute_force(spark, monkeypatch, cap):
    monkeypatch.setattr(near_copies, "SHARD_CAP", cap)
    monkeypatch.setattr(near_copies, "GROUP", 4)
    monkeypatch.setattr(near_copies, "MEMBERS", 2)
    rnd = random.Random(9)
    rows = awkward()
    origin = random_text(rnd, 150).split()
    for i in range(40):
        copy = origin[:]
        for _ in range(i % 8):
            copy[rnd.randrange(len(copy))] = f"z{rnd.randrange(999)}"
        rows.append((100 + i, " ".join(copy)))
    rows += [(200 + i, random_text(rnd, 60) + " " + " ".join(origin[:30])) for i in range(20)]
    sets = [brute_shingles(t) for _, t in rows]
    root = groups(len(rows), lambda i, j: near(sets[i], sets[j]))
    kept = near_copies.drop_near_copies(table(spark, rows).coalesce(1))
    assert kept.columns == table(spark, rows).columns
    assert got(kept, "doc_id") == sorted([(i,) for k, (i, _) in enumerate(rows) if root[k] == k], key=lambda r: (r[0] is None, str(r[0])))
    assert near_copies.drop_near_copies(empty(spark)).count() == 0


def test_small_groups_of_a_hot_shard_are_joined(spark, monkeypatch):
    """Many texts share a passage that holds their smallest shingles; pairs and small families among them are still found."""
    monkeypatch.setattr(near_copies, "SHARD_CAP", 8)
    rnd = random.Random(4)
    passage, rows = random_text(rnd, 105), []
    for i in range(120):
        own = random_text(rnd, 15, 5000).split()
        rows.append((len(rows), " ".join(own) + " " + passage))
        for _ in range(12 if i < 4 else i % 3):
            copy = own[:]
            copy[rnd.randrange(15)] = f"z{rnd.randrange(999)}"
            rows.append((len(rows), " ".join(copy) + " " + passage))
    sets = [brute_shingles(t) for _, t in rows]
    root = groups(len(rows), lambda i, j: near(sets[i], sets[j]))
    kept = near_copies.drop_near_copies(table(spark, rows).coalesce(1))
    assert got(kept, "doc_id") == sorted([(i,) for i, _ in rows if root[i] == i], key=lambda r: str(r[0]))


def brute_removed(rows, window):
    seen: dict = {}
    split = [words(t) for _, t in rows]
    for w in split:
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            seen[key] = seen.get(key, 0) + 1
    out = []
    for (i, _), w in zip(rows, split):
        gone = {k for s in range(len(w) - window + 1) if seen[tuple(w[s : s + window])] > 1 for k in range(s, s + window)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


def test_substring_against_brute_force(spark):
    rnd, rows = random.Random(4), awkward()
    passages = [random_text(rnd, n, 4000) for n in (34, 35, 36, 60, 200)]
    for i in range(60):  # passages, cut at their ends, in many contexts
        p = rnd.choice(passages).split()
        a, b = rnd.randrange(4), rnd.randrange(4)
        rows.append((300 + i, random_text(rnd, rnd.randrange(40), 4000) + " " + " ".join(p[a : len(p) - b]) + " " + random_text(rnd, rnd.randrange(40), 4000)))
    rows.append((400, "same " * 100))
    kept = substring.remove_repeats(table(spark, rows)).withColumn("sha", F.sha2("kept_text", 256))
    assert got(kept, "doc_id", "n_words", "n_removed", "sha") == brute_removed(rows, 35)
    spans = {r.doc_id: r for r in kept.where("doc_id is not null").collect()}
    assert all(sum(b - a for a, b in r.spans) == r.n_removed for r in spans.values())
    assert substring.remove_repeats(empty(spark)).count() == 0


def test_substring_other_windows(spark):
    rnd = random.Random(6)
    rows = [(i, random_text(rnd, 60, 3)) for i in range(15)]
    kept = substring.remove_repeats(table(spark, rows), window=8, anchor=3).withColumn("sha", F.sha2("kept_text", 256))
    assert got(kept, "doc_id", "n_words", "n_removed", "sha") == brute_removed(rows, 8)
