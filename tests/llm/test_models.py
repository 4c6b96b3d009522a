"""Language-model scores, URL filters, neighbours, packing and the pipeline."""

import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from ripplescope.llm import maxent, neighbours, packing, urls
from ripplescope.llm.common import row_keyed

from .helpers import awkward, empty, got, lower, random_text, table, words


def key(r):
    return tuple((v is None, str(v)) for v in r)


def test_lm_base_against_brute_force(spark):
    rows = awkward()
    tokens = [[*words(lower(t)), "\n"] for _, t in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    counts: dict = {}
    for ts, h in zip(tokens, held):
        for t in () if h else ts:
            counts[t] = counts.get(t, 0) + 1
    n, v = sum(counts.values()), len(counts)
    want = sorted(((i, h, len(ts), sum(t in counts for t in ts), n, round(sum(math.log10((counts.get(t, 0) + 1) / (n + v + 1)) for t in ts), 6)) for (i, _), ts, h in zip(rows, tokens, held)), key=key)
    found = maxent.lm_scores(table(spark, rows), steps=3)
    assert got(found.withColumn("base", F.round("base_score", 6)), "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base") == want
    assert found.where("score is null or score > 0 or isnan(score)").count() == 0
    assert maxent.lm_scores(empty(spark), steps=2).count() == 0


def test_lm_beats_its_base_on_held_out_texts(spark):
    rnd = random.Random(8)
    rows = []
    for i in range(300):  # two tongues, told apart by endings and word pairs
        a, b = rnd.choice((("ung", "eit"), ("tion", "able")))
        rows.append((i, " ".join(f"{rnd.choice('bdfgk')}{rnd.choice('aeiou')}{a if k % 2 else b}" for k in range(40))))
    r = maxent.lm_scores(table(spark, rows)).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > 0.95 * r[1]


def test_path_probabilities_sum_to_one_and_learn_word_pairs(spark):
    mass = np.random.default_rng(1).random(maxent.CLASSES << maxent.PATH)
    model = maxent.PathModel(mass, 14)
    model.weights = np.random.default_rng(2).standard_normal(1 << 14).astype(np.float32)
    leaves = np.arange(5 << maxent.PATH, 6 << maxent.PATH, dtype=np.int32)
    features = [np.full(len(leaves), h, np.uint32) for h in (77, 78, 79)]
    nodes, taken, cells = model.cells(leaves, features)
    z = model.logits(nodes, cells)
    assert abs(np.exp(-np.logaddexp(0, np.where(taken > 0, -z, z)).sum(axis=0)).sum() - 1) < 1e-5
    rnd = random.Random(5)
    follows = {f"a{k}b": f"c{k}b" for k in range(40)}  # one class, so pairs are told by the words only
    rows = [(i, " ".join(w for _ in range(30) for w in rnd.choice(list(follows.items())))) for i in range(200)]
    plain = maxent.lm_scores(table(spark, rows), path_steps=0).where("held_out").agg(F.sum("score")).first()[0]
    assert maxent.lm_scores(table(spark, rows), path_steps=4).where("held_out").agg(F.sum("score")).first()[0] > 0.85 * plain


def test_scores_do_not_depend_on_chunks_or_splits(spark, monkeypatch, tmp_path):
    rnd = random.Random(6)
    rows = [(i, random_text(rnd, rnd.randrange(80))) for i in range(120)]
    table(spark, rows).repartition(3).write.parquet(str(tmp_path / "docs"))
    stored = spark.read.parquet(str(tmp_path / "docs"))
    columns = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens")
    whole = got(maxent.lm_scores(stored, steps=2), *columns)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        assert got(maxent.lm_scores(stored, steps=2), *columns) == whole
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(whole) == 120


def test_row_keys_stay_equal_when_splits_change(spark, tmp_path):
    table(spark, [(i, random_text(random.Random(i), 30)) for i in range(200)]).repartition(4).write.parquet(str(tmp_path / "docs"))
    stored = spark.read.parquet(str(tmp_path / "docs"))
    before = got(row_keyed(stored.select("doc_id")), "__row", "doc_id")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        assert got(row_keyed(stored.select("doc_id", "text").where("doc_id >= 0")), "__row", "doc_id") == before
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert len({r[0] for r in before}) == 200
    joined = row_keyed(stored.join(stored.select("doc_id").distinct(), "doc_id"))
    assert joined.select("__row").distinct().count() == 200


def test_class_probabilities_sum_to_one_and_training_climbs(spark):
    rng = np.random.default_rng(0)
    cells = rng.integers(0, maxent.CLASSES**4, 3000)
    found, n = np.unique(np.concatenate((cells, cells[:500])), return_counts=True)
    model = maxent.train(spark.createDataFrame([(int(c), int(k)) for c, k in zip(found, n)], "cell long, n long"), steps=5)
    assert model.likelihood == sorted(model.likelihood)
    table_ = 10 ** model.table().reshape(-1, maxent.CLASSES)
    assert np.allclose(table_.sum(axis=1), 1)
    h = maxent.histories(np.array([1, 2, 3, 4], np.uint8), np.array([0, 2]))
    assert h.tolist() == [1, 2 | 1 << 5, 3, 4 | 3 << 5]


URLS = ["https://A.Example.com/en/1", "http://www.example.com/en/x?q#f", "http://x.www.example.com/en/", "https://h.net/es/1", "https://h.net/de/1", "https://notexample.com/en/", "https://net/fr/", "https://h.net", "ftp://h.org/#a", "x://y?z/en", "no scheme", "", None, "a://b://c/d", "https://fakenet/es/1"]


def test_rules_and_parts(spark):
    pages = spark.createDataFrame([*enumerate(URLS), (None, URLS[0]), (0, URLS[0])], "page_id long, url string").withColumn("score", F.lit(None)).withColumn("host", F.lit("z"))
    model = urls.UrlModel(["a.com", "b.net"], ["/x", "/es/"], [False, True])
    out = urls.judge_urls(pages, model)
    assert out.count() == len(URLS) + 2

    def brute(u):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (lower(m[1]), m[2]) if m else ("", "")
        fit = [(len(h + p), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fit)[1:] if fit else (None, None)))

    for r in out.where("page_id is not null").collect():
        host, path, rule, verdict = brute(URLS[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or ("block" if r.score >= 0.5 else "allow"))
    assert urls.judge_urls(pages.where("false"), model).count() == 0


def test_url_model_on_held_out_urls():
    rnd = random.Random(3)

    def make(bad):
        return ("".join(rnd.choice("abcdefgh") for _ in range(6)) + (".casino-win.net" if bad else ".school.org"), f"/{'play' if bad else 'read'}/{rnd.randrange(999)}")

    data = [(*make(b), b) for b in (rnd.random() < 0.4 for _ in range(600))]
    model = urls.UrlModel(*zip(*data[:400]))
    h, p, y = zip(*data[400:])
    assert ((model.score(h, p) > 0.5) == np.array(y)).mean() > 0.98
    assert 0 < urls.UrlModel([], [], []).score(["a"], ["/"])[0] < 0.5


def vectors(n=3000, dims=24, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims)) * rng.uniform(0.2, 3, size=(n, 1))
    x[5:40] = x[4]  # ties
    return x


def test_neighbours_recall_and_exact_scores(spark):
    x = vectors()
    rows = [(i, v) for i, v in enumerate(x.tolist())] + [(9001, None), (9002, [0.0] * 24), (9003, [float("nan")] * 24), (9004, [None] * 24), (9005, [float("inf")] + [1.0] * 23), (None, [1.0] * 24)]
    table_ = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1))
    out = neighbours.nearest(table_, table_.where("vec_id % 50 = 0"), 20).collect()
    by: dict = {}
    for r in sorted(out, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append(r)
    hits = 0
    for q, found in by.items():
        exact = x @ x[q]
        assert [r.rank for r in found] == [*range(1, 21)] and all(abs(r.score - exact[r.vec_id]) < 1e-9 and r.vec_id != q for r in found)
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        order = [i for i in np.lexsort((np.arange(len(x)), -exact)) if i != q][:20]
        hits += len({*order} & {r.vec_id for r in found})
    assert len(by) == 60 and hits / (60 * 20) >= 0.9


def test_neighbours_of_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (2, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert got(neighbours.nearest(few, few.where("vec_id = 0"), 20), "query_id", "rank", "vec_id", "score") == [(0, 1, 1, 1.0), (0, 2, 2, 0.5), (0, 3, 2, 0.5)]
    assert neighbours.nearest(few.where("false"), few, 3).count() == 0
    mixed = few.union(spark.createDataFrame([(7, [2.0]), (8, [1.0])], few.schema))
    assert got(neighbours.nearest(mixed, mixed.where("vec_id in (0, 7, 9)"), 1), "query_id", "rank", "vec_id", "score") == [(0, 1, 1, 1.0), (7, 1, 8, 2.0)]
    twins = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.9, 0.1]), (0, [0.9, 0.1]), (1, [0.5, 0.5])], "vec_id long, embedding array<double>")
    found = got(neighbours.nearest(twins, twins.where("vec_id = 0"), 20), "query_id", "rank", "vec_id", "score")
    assert [r[:3] for r in found if r[3] == 0.5] and len(found) == 9 and [r[2] for r in found].count(0) == 6


def test_neighbours_over_several_shards_reach_the_recall(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(neighbours, "SHARD_ROWS", 700)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 16)
    x = vectors(2500)
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "v"))
    stored = spark.read.parquet(str(tmp_path / "v"))
    hits, by = 0, {}
    for r in neighbours.nearest(stored, stored.where("vec_id % 50 = 0"), 20).collect():
        by.setdefault(r.query_id, set()).add(r.vec_id)
    for q, found in by.items():
        exact = x @ x[q]
        hits += len(found & {*[i for i in np.lexsort((np.arange(len(x)), -exact)) if i != q][:20]})
    assert len(by) == 50 and all(len(v) == 20 for v in by.values()) and hits / 1000 >= 0.9


def test_forest_gives_the_longest_prefixes():
    x = vectors(500)
    forest = neighbours.PrefixForest(np.arange(500), x, float(np.linalg.norm(x, axis=1).max()), trees=4, bits=12)
    strings = forest._strings(np.column_stack((x[:1], np.zeros(1))))
    for rows, wanted in ((next(forest.candidates(x[:1], w)), w) for w in (1, 50, 400, 10**6)):
        stored = [s[np.argsort(o)] for s, o in zip(forest.strings, forest.order)]
        shared = lambda d: sum(int(((s >> np.uint64(12 - d)) == (q >> np.uint64(12 - d))).sum()) for s, q in zip(stored, (s[0] for s in strings)))  # noqa: B023, E731
        depth = max((d for d in range(13) if shared(d) >= min(wanted, 2000)), default=0)
        inside = np.zeros(500, bool)
        for s, q in zip(stored, (s[0] for s in strings)):
            inside |= (s >> np.uint64(12 - depth)) == (q >> np.uint64(12 - depth))
        assert set(rows) <= set(np.flatnonzero(inside))


TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  a  b ", "x \n y\n\n z", "it's  they're I'll", "<|endoftext|> a <|endoftext|>b", "a  b　c", "a \x1cb", "ß́ é 12 3.5", "​ x", "ab'sc d'", "漢字 かな"]


def test_encoder_equals_the_tokenizer():
    encoder = packing.Encoder(TOKENIZER, cache=64)
    rnd = random.Random(0)
    texts = ODD + ["".join(rnd.choice(" \n\tabZ.,'é漢1<|>") for _ in range(60)) for _ in range(300)]
    for at in range(0, len(texts), 50):
        part = texts[at : at + 50]
        for text, ids in zip(part, encoder.encode(part)):
            assert np.frombuffer(ids, "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_packing_round_trip(spark):
    rows = [*awkward(), *enumerate(ODD, 800)]
    pieces = packing.pack_documents(table(spark, rows), TOKENIZER, capacity=256).collect()
    encoder = packing.Encoder(TOKENIZER)
    want = sorted((i is None, str(i), ids + b"\x01\0\0\0") for (i, _), ids in zip(rows, encoder.encode([t or "" for _, t in rows])))
    docs: dict = {}
    for p in sorted(pieces, key=lambda p: p.start):
        docs.setdefault(p.doc_id, []).append(p)
    unique = {i for i, _ in rows if [j for j, _ in rows].count(i) == 1}
    joined = {i: b"".join(bytes(p.ids) for p in docs[i]) for i in unique}
    assert all((False, str(i), ids) in want for i, ids in joined.items()) and sum(p.length for p in pieces) == sum(len(w[2]) // 4 for w in want)
    sequences: dict = {}
    for p in pieces:
        assert p.length == len(p.ids) // 4 > 0
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for s in sequences.values():
        end = 0
        for offset, length in sorted(s):
            assert offset == end
            end += length
        assert end <= 256 and (end == 256 or end & (end - 1) == 0)
    digest = packing.digest(spark.createDataFrame(pieces[:1])).first()
    assert digest.ids_crc32 == zlib.crc32(bytes(pieces[0].ids))
    assert packing.pack_documents(empty(spark), TOKENIZER).count() == 0


def test_classes_hold_a_fixed_number():
    packer, out = packing.HarmonicPacker(16, 4), []
    for i, n in enumerate([9, 6, 6, 5, 5, 5, 3, 3, 33, 1, 2]):
        out += packer.add(i, bytes(4 * n))
    out += packer.end()
    per: dict = {}
    for doc, start, ids, tokens, sequence, offset in out:
        per.setdefault(sequence, []).append((offset, len(ids) // 4))
    totals = [sum(n for _, n in v) for v in per.values()]
    assert sum(totals) == 78 and all(t == 16 or t & (t - 1) == 0 for t in totals) and totals.count(16) == 4


def test_pipeline_stages(spark, tmp_path):
    rnd = random.Random(5)
    question = "Maria bought 12 apples and 7 pears at the market in March and gave half of them to her neighbour"
    texts = {i: random_text(rnd, 60, 3000) for i in range(60)}
    for i in range(0, 40, 2):
        texts[i] += " you idiot"
    texts[41] = texts[43].replace(texts[43].split()[30], "changed")
    texts[45] = "start " + question.replace("12", "15") + " end"
    texts[47] += " mail bob.7@corp.example.com"
    rows = [(i, t, "en", "s", len(t)) for i, t in texts.items()] + [(90, None, None, None, None), (91, "", None, None, None), (None, random_text(rnd, 30), None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i < 40 and i % 2 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, question)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_copies", "decontaminate", "pii", "packing"] and corpus_pipeline.ORACLE_SQL is None
    kept, counts = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.materialize(stage(spark, kept, str(tmp_path)), name)
        assert kept.columns == docs.columns
        counts[name] = {r.doc_id for r in kept.collect()}
    everything = {i for i, *_ in rows}
    assert counts["toxicity"] == everything - {*range(0, 40, 2)}
    gone = counts["toxicity"] - counts["near_copies"]
    assert len(gone & {41, 43}) == 1 and len(gone & {90, 91}) == 1 and len(gone) == 2
    assert counts["near_copies"] - counts["decontaminate"] == {45} and counts["pii"] == counts["decontaminate"]
    assert "corp" not in kept.where("doc_id = 47").first().text
    pieces = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == counts["pii"]
