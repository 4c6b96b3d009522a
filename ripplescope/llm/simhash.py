"""SimHash near-duplicates by sharded BK-trees.

Fingerprints are 64 bits. Two of them within a Hamming radius r agree on at least m of any r + m blocks of bits, so every
choice of m blocks is a table of shards in which linked fingerprints meet. Each shard of distinct fingerprints is one
BK-tree (children keyed by their integer distance to the parent); a search follows only edges within the radius of the
query's distance. m grows with the number of fingerprints so that shards stay small. A shard that is still large (one group
of near copies, or a common prefix) is dealt anew by the centres of Hamming balls: fingerprints within the radius share a
centre, and a ball of radius 1 holds 65 fingerprints at most, so no shard is unbounded and none is searched by all pairs.
A tree gives one edge to a group's representative for each member, not all pairs; components join the shards' groups.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, materialize, row_keyed, text_bytes
from .components import connected_components

SEED = 42
SHARD_CAP = 2048
_CHUNK = 1 << 15


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Signed 64-bit SimHash of a text's word shingles, repeats included; A-Z lower-cased; no words: 0."""
    words = text.lower().split()  # bytes: splits at \x20 and \x09-\x0D, lowers A-Z only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    a, b = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    digest, ones = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, len(a), _CHUNK):
        hashed = b"".join([digest(joined[i:j], SEED) for i, j in zip(a[at : at + _CHUNK], b[at : at + _CHUNK])])
        bits = np.unpackbits(np.frombuffer(hashed, np.uint8)).reshape(-1, 64)
        whole = len(bits) // 255 * 255
        if whole:
            ones += np.add.reduce(bits[:whole].reshape(-1, 255, 64), axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        ones += bits[whole:].sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(a)).view(">i8")[0])


def fingerprint_rows(keyed: DataFrame, shingle: int) -> DataFrame:
    """(row, doc_id, text bytes) to (__row, doc_id, fp)."""
    schema = pa.schema([("__row", pa.int64()), ("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = pa.array([fingerprint(x.as_py(), shingle) for x in batch.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), marks], schema=schema)

    return keyed.select("__row", F.col("doc_id").cast("long").alias("doc_id"), text_bytes()).mapInArrow(run, "__row long, doc_id long, fp long")


class BKTree:
    """Children keyed by integer Hamming distance to the parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def within(self, value: int, radius: int) -> list[int]:
        """Indexes of the stored values within the radius; only edges within the radius of the distance are followed."""
        found, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            d = ((value ^ self.values[at]) & 0xFFFFFFFFFFFFFFFF).bit_count()
            if d <= radius:
                found.append(at)
            todo += [child for edge, child in self.children[at].items() if d - radius <= edge <= d + radius]
        return found

    def add(self, value: int) -> int:
        new, at = len(self.values), 0
        self.values.append(value)
        self.children.append({})
        while new:
            d = ((value ^ self.values[at]) & 0xFFFFFFFFFFFFFFFF).bit_count()
            at, last = self.children[at].setdefault(d, new), at
            if at == new:
                break
        return new


def shard_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """(member, representative) for each group of distinct values that links within the radius form."""
    tree, parent = BKTree(), []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for value in values:
        near = tree.within(value, radius)
        me = tree.add(value)
        parent.append(me)
        for other in near:
            a, b = root(other), root(me)
            if a != b:
                parent[max(a, b)] = min(a, b)
    return [(values[i], values[r]) for i in range(len(values)) if (r := root(i)) != i]


def _search_shards(sharded: DataFrame, radius: int) -> DataFrame:
    """(shard, fp) to the shards' (u, v) links; the rows of one shard lie together in a partition."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []

        def out(links: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], schema=schema)

        for batch in batches:
            shard, value = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            links: list[tuple[int, int]] = []
            cuts = np.flatnonzero(np.diff(shard)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(shard)]):
                if a == b:
                    continue
                if shard[a] != last:
                    if len(held) > 1:
                        links += shard_links(held, radius)
                    last, held = shard[a], []
                held += value[a:b].tolist()
            if links:
                yield out(links)
        if len(held) > 1 and (links := shard_links(held, radius)):
            yield out(links)

    return sharded.repartition("shard").sortWithinPartitions("shard", "fp").mapInArrow(run, "u long, v long")


def block_tables(n: int, radius: int, width: int = 64) -> list[list[int]]:
    """Bit masks of the shard tables: the fewest equal blocks for which n even fingerprints give shards of a few dozen."""
    for m in range(1, 5):
        cuts = [width * i // (radius + m) for i in range(radius + m + 1)]
        if m == 4 or n >> (width * m // (radius + m)) < 32:
            break
    blocks = [sum(1 << i for i in range(a, b)) for a, b in zip(cuts, cuts[1:])]
    return [sum(x) for x in itertools.combinations(blocks, m)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_links(marks: DataFrame, radius: int = 2, shard_cap: int = SHARD_CAP) -> DataFrame:
    """Distinct fingerprints (fp) to links (u, v) whose components are those of all pairs within the radius."""
    n = marks.count()
    masks = block_tables(n, radius)
    tables = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)])
    dealt = marks.select("fp", F.explode(tables).alias("x")).select(F.xxhash64("x.t", "x.key").alias("shard"), "fp")
    sizes = dealt.groupBy("shard").agg(F.count("*").alias("n"))
    large = materialize(sizes.where(F.col("n") > shard_cap).select("shard"), "large-shards")
    if not large.head(1):
        return _search_shards(dealt, radius)
    reach = (radius + 1) // 2
    flips = [_signed(sum(1 << b for b in bits)) for k in range(reach + 1) for bits in itertools.combinations(range(64), k)]
    hot = dealt.join(large, "shard", "left_semi").select("fp").distinct()
    balls = hot.select("fp", F.explode(F.array(*[F.lit(x) for x in flips])).alias("flip")).select(F.xxhash64(F.lit(-1), F.col("fp").bitwiseXOR(F.col("flip"))).alias("shard"), "fp")
    return _search_shards(dealt.join(large, "shard", "left_anti"), radius).unionByName(_search_shards(balls, radius))


def components(rows: DataFrame, radius: int = 2) -> DataFrame:
    """Rows with (doc_id, fp) gain component_id: the smallest doc_id reachable over links, itself included."""
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    roots = connected_components(near_links(nodes.select("fp"), radius))
    placed = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = placed.join(named, "root").select("fp", "component_id", "root")
    return rows.join(classes, "fp")


def simhash_components(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Null and empty texts have fingerprint 0 and link like any other; a null doc_id stays null, is never a component_id
    unless all ids of the component are null; repeated rows give repeated rows; extra columns are not read; an empty
    table gives an empty result.
    """
    rows = materialize(fingerprint_rows(row_keyed(docs.select("doc_id", "text")), shingle), "simhash")
    return components(rows, radius).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    return simhash_components(documents(spark, sf_dir).select("doc_id", "text"))
