"""Fill-in-the-middle, sketches and ranked search against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from ripplescope.llm import middles, ranked, sketches

from .helpers import awkward, empty, got, lower, table

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]", re.S)
MARKED = [(20, "a <P> b"), (21, "<S>"), (22, "x<M>"), (23, "<P"), (24, "a<"), (25, ">S>"), (26, "漢字漢字 ünïcödé 𝒳𝒴 end"), (27, "éé12\x00\n\n  zz"), (28, "ab́c﻿" * 40), (29, "<S<P<M" * 30)]


def brute_middle(doc_id, text, salt="1:", plain=10, spm=20):
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"{salt}{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 100 - plain:
        return doc_id, n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < spm else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return doc_id, n, form, len(p), len(m), out


def mixed_texts(seed, n):
    rnd = random.Random(seed)
    return [(i, "".join(rnd.choice("aZ \n0é漢𝒳<>PSM") for _ in range(rnd.randrange(60)))) for i in range(100, 100 + n)]


def test_middles_equal_brute_force_and_go_back(spark):
    rows = [*awkward(), *MARKED, *mixed_texts(1, 300)]
    for options in ({}, {"salt": "x", "plain_percent": 0, "spm_percent": 50}):
        made = middles.fill_in_middle(table(spark, rows), **options)
        want = [brute_middle(i, t, *options.values()) for i, t in rows]
        assert got(made, "doc_id", "n", "form", "prefix_chars", "middle_chars", "output") == sorted(want, key=lambda r: tuple((v is None, str(v)) for v in r))
        assert {"plain", "psm", "spm"} == {r[2] for r in want}
        assert got(made.select("doc_id", middles.restored().alias("text")), "doc_id", "text") == sorted(((i, t or "") for i, t in rows), key=lambda r: tuple((v is None, str(v)) for v in r))
    assert middles.fill_in_middle(empty(spark)).count() == 0


def test_runs_are_searched_across_slices(spark, monkeypatch):
    rows = mixed_texts(2, 200)
    monkeypatch.setattr(middles, "_SLICE_BYTES", 50)
    made = middles.fill_in_middle(table(spark, rows).coalesce(1))
    assert got(made, "doc_id", "n", "form", "output") == sorted(((w[0], w[1], w[2], w[5]) for w in (brute_middle(*r) for r in rows)), key=lambda r: tuple((v is None, str(v)) for v in r))


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def item_table(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "item_id long, text string, doc_id int, score int, rank int").coalesce(2)


def brute_ranks(items, docs, top, once=True):
    held = [(i, Counter(TERM.findall(lower(t)))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        wanted, scored = Counter(TERM.findall(lower(text))), []
        for i, c in held:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // n_terms
            score = sum((1 if once else k) * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t, k in wanted.items() if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r, None if gone else i, -s) for r, (s, gone, i) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("top, once, entries, block", [(50, True, 1_000_000, 16_384), (3, False, 100, 4)])
def test_ranks_equal_brute_force(spark, monkeypatch, top, once, entries, block):
    monkeypatch.setattr(ranked, "BLOCK_DOCS", block)
    rnd = random.Random(3)
    docs = [*awkward(), *MARKED, *((i, " ".join(f"W{rnd.randrange(30)}" for _ in range(rnd.randrange(1, 40)))) for i in range(100, 160)), *((200 + i, "w1 w2, w3-w3") for i in range(6))]
    items = [(1, "W1 w2 w3 w3"), (2, None), (3, ""), (4, "nowhere"), (5, "ünï 漢字 ONE two words"), (5, "w7 w7 w8"), (5, "w7 w7 w8"), (None, "x w4"), (6, " ".join(t or "" for _, t in docs[:3]))]
    made = ranked.rank_documents(item_table(spark, items), table(spark, docs), top, once, entries)
    assert got(made, "item_id", "rank", "doc_id", "score") == brute_ranks(items, docs, top, once)


def test_ranks_of_nothing(spark):
    some, items = table(spark, awkward()), item_table(spark, [(1, "one")])
    for left, right in ((items.where("false"), some), (items, empty(spark)), (items, some.where("text is null")), (item_table(spark, [(1, "zzz")]), some)):
        assert ranked.rank_documents(left, right).count() == 0


def mixed(x):
    x ^= x >> 32
    x = x * 0xD6E8FEB86659FD93 % (1 << 64)
    return x ^ (x >> 32)


def brute_sketch(text):
    """The bound and the hashes of one text, window by window."""
    points = [mixed(c + 0x9E3779B97F4A7C15) for c in [0x110000] * 7 + [ord(c) for c in text]]
    factors = [1]
    for level in range(3):
        factor = pow(0xA0761D6478BD642F, 2**level, 1 << 64)
        factors = [f * factor % (1 << 64) for f in factors] + factors
    hashes = sorted({mixed(sum(f * x for f, x in zip(factors, points[i:])) % (1 << 64)) >> 16 for i in range(len(text))})
    below = [h for h in hashes if h < 2**48 // 32]
    if len(below) >= 64:
        return 2**48 // 32, below
    return (2**48, hashes) if len(hashes) <= 64 else (hashes[63] + 1, hashes[:64])


def plain(sketch):
    return sketch[0], sketch[1].tolist()


def brute_edits(rows):
    """rows in their order in the files."""
    order = sorted(((i is None, -(i or 0), at) for at, (i, _) in enumerate(rows)))
    listed = [(rows[at][0], rows[at][1] or "") for *_, at in order]
    out = []
    for (i, a), (_, b) in zip(listed, listed[1:] + listed[:1]):
        k = len(a) // 3
        x, y, z = (sketches.encoded((s[0], np.array(s[1], np.uint64))) for s in map(brute_sketch, (a, a[: len(a) - k] + b[:k], b)))
        out.append((i, len(a), hashlib.sha256((a[: len(a) - k] + b[:k]).encode()).hexdigest(), x, y, sketches.likeness(sketches.decoded(x), sketches.decoded(y)), sketches.likeness(sketches.decoded(x), sketches.decoded(z))))
    return sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


def test_sketches_equal_brute_force(monkeypatch):
    texts = ["", "a", "ab" * 5000, "x" * 50, *(t or "" for _, t in awkward() if len(t or "") < 10_000), *(t for _, t in mixed_texts(4, 40))]
    want = [brute_sketch(t) for t in texts]
    assert [plain(s) for s in sketches.sketches(texts)] == want
    monkeypatch.setattr(sketches, "_PIECE", 37)
    assert [plain(s) for s in sketches.sketches(texts)] == want
    assert [plain(sketches.decoded(sketches.encoded((b, np.array(h, np.uint64))))) for b, h in want] == want


def test_merged_sketches_are_those_of_both_texts():
    rnd = random.Random(5)
    for n in (10, 60, 200, 5000):
        a, b = ("".join(rnd.choices("abcdefg ", k=n * k)) for k in (1, 9))
        one, two = (sketches.sketches([t])[0] for t in (a, b))
        points = [h for t in (a, b) for h in sketches._window_hashes(np.array([0x110000] * 7 + [ord(c) for c in t]))]
        assert plain(sketches.merge(one, two)) == plain(sketches._kept(np.array(points)))


def test_estimates_are_near_the_truth():
    rnd = random.Random(6)
    whole = "".join(rnd.choices("abcdefghij ", k=400_000))
    part = whole[100_000:140_000]
    mixed_up = part[:20_000] + "".join(rnd.choices("abcdefghij ", k=20_000))
    a, b, c, empty_one = sketches.sketches([part, whole, mixed_up, ""])
    assert sketches.containment(a, b) > 0.99 and abs(sketches.containment(c, b) - 0.5) < 0.06 and abs(sketches.likeness(a, b) - 0.1) < 0.02
    assert abs(sketches.likeness(a, c) - 1 / 3) < 0.05 and sketches.likeness(empty_one, empty_one) == 1.0 and sketches.likeness(a, empty_one) == 0.0


@pytest.mark.parametrize("range_bytes, chunk", [(8 << 20, 1 << 20), (700, 300)])
def test_edited_documents_equal_brute_force(spark, tmp_path, monkeypatch, range_bytes, chunk):
    monkeypatch.setattr(sketches, "RANGE_BYTES", range_bytes)
    monkeypatch.setattr(sketches, "_CHUNK_BYTES", chunk)
    rows = [(i, t[:3000] if t else t) for i, t in awkward()] + mixed_texts(7, 30) + [(9, "tied first"), (9, "tied second"), (-(2**63), "least"), (2**63 - 1, "greatest")]
    table(spark, rows).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    made = sketches.op11_sketches(spark, str(tmp_path))
    assert got(made, "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next") == brute_edits(rows)


def test_a_single_document_is_its_own_next(spark):
    row = sketches.edited_fingerprints(table(spark, [(1, "abcdef")])).first()
    assert row.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and row.near_next == 1.0
    assert sketches.edited_fingerprints(empty(spark)).count() == 0 and sketches.fingerprints(empty(spark)).count() == 0
    assert got(sketches.fingerprints(table(spark, [(1, "abc"), (2, "abc"), (3, None)])), "doc_id", "n_chars")[2] == (3, 0)
