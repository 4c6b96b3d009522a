"""Near copies by SimHash and BK-trees at a similarity of word shingles.

The 64-bit operator of simhash.py links fingerprints that differ in a few bits. A Jaccard similarity of 0.8 moves a seventh
of the bits, so here fingerprints are WIDTH bits, trees are searched at a radius that such a pair stays within (2.5 standard
deviations above its mean), and each hit is confirmed on the shingle sets themselves. Shards are texts that share a pair of
smallest shingles under two of the orders: a pair at similarity 0.8 meets in one of TABLES shards with probability 0.99996,
whatever the size of the corpus.

A shard keeps one list of BK-trees per group found so far and stops at the first confirmed hit in each, so a shard full of
copies costs few distances for each. A shard of more than SHARD_CAP texts is dealt into several; groups of at least GROUP
texts in them send MEMBERS members each to a next round, where they meet those of the other parts. That joins most of a large
group cheaply, but not all links of the shard. So the texts of such shards then meet anew by prefix filter: with shingles
ordered from rare to common, two texts at the similarity share one of their first shingles, without exception. Only shingles
whose texts are not yet one component are searched, and if more than SHARD_CAP texts have one, as all pairs of its parts. No
task holds more than SHARD_CAP texts or so at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import arrow_batches
from .common import materialize, release, row_keyed, text_bytes
from .components import connected_components
from .simhash import BKTree

WIDTH = 256
TABLES = 10
SHARD_CAP = 1_024
GROUP, MEMBERS = 64, 16
BATCH_ROWS = 512
_ODD = np.random.default_rng(20).integers(1, 1 << 63, WIDTH // 64 + 2 * TABLES, dtype=np.uint64) | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles, A-Z lower-cased; a shorter text is one shingle, an empty one none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(size, len(words))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())
    return np.unique(np.fromiter((digest(joined[a:b]) for a, b in spans), np.uint64, len(words) - k + 1))


def sketch(shingles: np.ndarray) -> tuple[bytes, list[int]]:
    """A text's wide fingerprint and its shard keys."""
    if not len(shingles):
        return bytes(WIDTH // 8), []
    ones, least = np.zeros(WIDTH, np.int64), np.full(2 * TABLES, np.uint64((1 << 64) - 1))
    for at in range(0, len(shingles), 4096):
        mixed = _mixed(shingles[at : at + 4096, None] * _ODD)
        bits = np.unpackbits(np.ascontiguousarray(mixed[:, : WIDTH // 64]).view(np.uint8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
        least = np.minimum(least, mixed[:, WIDTH // 64 :].min(axis=0))
    table = np.arange(TABLES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    keys = _mixed((least[0::2] ^ table) * np.uint64(0xC2B2AE3D27D4EB4F) + least[1::2])
    return np.packbits(2 * ones > len(shingles)).tobytes(), keys.view(np.int64).tolist()


def radius_of(similarity: float) -> int:
    """Bits in which nearly all pairs of the similarity differ at most."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.ceil(WIDTH * share + 2.5 * math.sqrt(WIDTH * share * (1 - share)))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def shard_groups(marks: list[int], sets: list[np.ndarray], similarity: float, radius: int) -> list[list[int]]:
    """Groups of places that links of at least the similarity form, each by ascending place."""
    groups: list[tuple[list[int], list[tuple[BKTree, list[int]]]]] = []

    def hit(tree: BKTree, places: list[int], i: int) -> bool:
        todo = [0]
        while todo:
            at = todo.pop()
            d = (marks[i] ^ tree.values[at]).bit_count()
            if d <= radius and jaccard(sets[i], sets[places[at]]) >= similarity:
                return True
            todo += [child for edge, child in tree.children[at].items() if d - radius <= edge <= d + radius]
        return False

    for i in range(len(marks)):
        mine = [g for g in groups if any(hit(tree, places, i) for tree, places in g[1])]
        if not mine:
            tree = BKTree()
            tree.add(marks[i])
            groups.append(([i], [(tree, [i])]))
            continue
        mine.sort(key=lambda g: -len(g[0]))
        first = mine[0]
        for other in mine[1:]:
            first[0].extend(other[0])
            first[1].extend(other[1])
            groups.remove(other)
        first[0].append(i)
        tree, places = first[1][0]
        tree.add(marks[i])
        places.append(i)
    return [sorted(g[0]) for g in groups]


def _sketches(keyed: DataFrame, size: int) -> DataFrame:
    """(__row, text) to (__row, mark, keys, shingles): shingles as sorted unsigned 32-bit values."""
    types = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [shingle_set(t.as_py(), size) for t in part.column(1)]
                marks = [sketch(s) for s in sets]
                short = [np.unique((s >> np.uint64(32)).astype(np.uint32)).tobytes() for s in sets]
                columns = [part.column(0), [m[0] for m in marks], [m[1] for m in marks], short]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["__row", "mark", "keys", "shingles"])
        release()

    return keyed.select("__row", text_bytes()).mapInArrow(run, "__row long, mark binary, keys array<long>, shingles binary")


def _search(dealt: DataFrame, similarity: float) -> DataFrame:
    """(shard, part, node, mark, shingles) to links (u, v; shard null) and, where part is not null, members for the next round."""
    schema = pa.schema([("shard", pa.int64()), ("u", pa.int64()), ("v", pa.int64()), ("mark", pa.binary()), ("shingles", pa.binary())])
    radius = radius_of(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []

        def out() -> Iterator[pa.RecordBatch]:
            if len(held) < 2:
                return
            sets = [np.frombuffer(x[3], np.uint32) for x in held]
            rows = []
            for group in shard_groups([int.from_bytes(x[2], "big") for x in held], sets, similarity, radius):
                head = held[group[0]][1]
                rows += [(None, held[i][1], head, None, None) for i in group[1:]]
                if last[1] is not None and len(group) >= GROUP:
                    step = len(group) / MEMBERS
                    rows += [(last[0], held[i][1], None, held[i][2], held[i][3]) for i in (group[int(k * step)] for k in range(MEMBERS))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            for shard, part, node, mark, shingles in zip(*[c.to_pylist() for c in batch.columns]):
                if (shard, part) != last:
                    yield from out()
                    last, held = (shard, part), []
                held.append((shard, node, mark, shingles))
        yield from out()
        release()

    grouped = dealt.select("shard", "part", "node", "mark", "shingles").repartition("shard", "part").sortWithinPartitions("shard", "part", "node")
    return grouped.mapInArrow(run, "shard long, u long, v long, mark binary, shingles binary")


def _listed(texts: DataFrame) -> DataFrame:
    """(node, shingles) to (node, size, s): one row per shingle."""
    types = [pa.int64(), pa.int32(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                sets = [np.frombuffer(x.as_py(), np.int32) for x in part.column(1)]
                sizes = np.array([len(x) for x in sets], np.int32)
                columns = [np.repeat(part.column(0).to_numpy(), sizes), np.repeat(sizes, sizes), np.concatenate(sets)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["node", "size", "s"])

    return texts.select("node", "shingles").mapInArrow(run, "node long, size int, s int")


def _prefix_shards(texts: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """(node, mark, shingles) to such rows with shard and a null part: any two at the similarity that are not of one root meet.

    A text's first size - ceil(similarity * size) + 1 shingles, rare ones first, have one in common with those of any such
    other. Shingles of one text only come first in that order and are counted, not joined.
    """
    listed = _listed(texts)
    often = listed.groupBy("s").agg(F.count("*").alias("n")).where("n > 1")
    own = Window.partitionBy("node")
    ranked = listed.join(often, "s").withColumns({"r": F.row_number().over(own.orderBy("n", "s")), "shared": F.count("*").over(own)})
    first = ranked.where(F.col("r") <= F.col("shared") - F.ceil(F.col("size") * similarity - 1e-6) + 1).select("s", "node")
    first = materialize(first.join(roots, "node", "left").select("s", "node", F.coalesce("root", "node").alias("root")), "prefixes")
    marks = [F.bit_xor(F.xxhash64(F.lit(k), "node")).alias(f"h{k}") for k in (1, 2)]
    shards = first.groupBy("s").agg(F.count("*").alias("n"), F.min("root").alias("a"), F.max("root").alias("b"), *marks).where("a < b")
    # shingles of the same texts are one shard
    shards = shards.groupBy("n", "h1", "h2").agg(F.min("s").alias("s")).select("s", F.when(F.col("n") > SHARD_CAP, F.ceil(F.col("n") / (SHARD_CAP // 2))).otherwise(1).cast("long").alias("parts"))
    dealt = first.join(shards, "s").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("parts")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).where("parts = 1 or other <> mine")
    shard = F.xxhash64("s", F.least("mine", "other"), F.greatest("mine", "other"))
    return dealt.select(shard.alias("shard"), F.lit(None).cast("long").alias("part"), "node").join(texts, "node")


def near_copy_roots(keyed: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(__row, text) to (__row, root) for the rows that are not the first of their group: root is the first."""
    with arrow_batches(keyed.sparkSession, BATCH_ROWS):
        rows = materialize(_sketches(keyed, shingle), "sketches")
    # texts of one fingerprint and equal shingles are one node, whatever their number
    kinds = rows.groupBy("mark", F.xxhash64("shingles").alias("same")).agg(F.min("__row").alias("node"))
    nodes = materialize(kinds, "nodes")
    copies = rows.select("__row", "mark", F.xxhash64("shingles").alias("same")).join(nodes, ["mark", "same"]).where("__row <> node").select(F.col("__row").alias("u"), F.col("node").alias("v"))
    own = nodes.select(F.col("node").alias("__row"))
    placed = rows.join(own, "__row", "left_semi").select(F.explode("keys").alias("shard"), F.col("__row").alias("node"))
    placed = materialize(placed, "placed")
    shared = placed.groupBy("shard").agg(F.count("*").alias("n")).where("n > 1")
    met = placed.join(shared, "shard").join(rows.select(F.col("__row").alias("node"), "mark", "shingles"), "node")
    links = copies
    while True:
        part = F.when(F.col("n") > SHARD_CAP, F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / (SHARD_CAP // 2)).cast("long")))
        with arrow_batches(keyed.sparkSession, BATCH_ROWS):
            found = materialize(_search(met.withColumn("part", part), similarity), "near-copies")
        links = links.unionByName(found.where("shard is null").select("u", "v"))
        more = found.where("shard is not null").select("shard", F.col("u").alias("node"), "mark", "shingles")
        counted = more.groupBy("shard").agg(F.count("*").alias("n"))
        if not more.head(1):
            break
        met = more.join(counted, "shard")
    hot = placed.join(shared.where(F.col("n") > SHARD_CAP), "shard", "left_semi").select("node").distinct()
    texts = materialize(hot.join(rows.select(F.col("__row").alias("node"), "mark", "shingles"), "node"), "hot-texts")
    if texts.head(1):
        roots = connected_components(links)
        links = roots.select(F.col("node").alias("u"), F.col("root").alias("v"))
        with arrow_batches(keyed.sparkSession, BATCH_ROWS):
            links = links.unionByName(materialize(_search(_prefix_shards(texts, roots, similarity), similarity), "near-copies").select("u", "v"))
    return connected_components(links).select(F.col("node").alias("__row"), "root")


def drop_near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs, all columns, with the first document of each group of near copies only.

    Groups are what links of at least the similarity form. Null and empty texts are copies of one another; repeated rows are
    copies; null ids and other columns play no part; an empty table stays empty.
    """
    keyed = row_keyed(docs)
    gone = near_copy_roots(keyed.select("__row", "text"), shingle, similarity).select("__row")
    return keyed.join(gone, "__row", "left_anti").drop("__row")
