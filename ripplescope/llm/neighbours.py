"""Approximate nearest neighbours by a hash-prefix forest (LSH Forest, Bawa et al., 2005), for the largest inner product.

Vectors are lengthened to one norm (v, sqrt(M^2 - |v|^2), with M the largest norm), so the largest inner product is the
smallest angle. Each of TREES trees gives every vector a string of BITS sign bits of random projections; a shard of bounded
size keeps the strings of each tree in a sorted array. A query descends each tree to the longest prefixes that stored
strings share with its own, found on both sides of its place in the array, and all trees ascend together, one bit at a
time, until they have given VISITS times as many rows as the shard has, repeats included; of the last bit only as many trees
ascend as are needed. The union of what the trees gave is scored exactly in double precision. A shard's forest is built once
and the queries, QUERY_BLOCK at a time, stream past it; all shards meet all queries and return their k best, so no vector is
out of reach.

VISITS was set by recall against brute force on vectors without any structure, the hardest case, where the 20 nearest are
hardly nearer than others: fewer visits serve where vectors cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, release, row_keyed

TREES = 64
BITS = 24
VISITS = 1.2
SHARD_ROWS = 16_384
QUERY_BLOCK = 512


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) as doubles, without null, zero and empty vectors and those that hold null or non-finite components."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0))


class PrefixForest:
    """Sorted arrays of bit strings, one per tree."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, norm: float, trees: int = TREES, bits: int = BITS, seed: int = 7) -> None:
        self.ids, self.vectors, self.bits = ids, vectors, bits
        self.planes = np.random.default_rng(seed).standard_normal((trees, vectors.shape[1] + 1, bits))
        rest = np.sqrt(np.maximum(0.0, norm**2 - np.einsum("ij,ij->i", vectors, vectors)))
        self.order, self.strings = [], []
        for strings in self._strings(np.column_stack((vectors, rest))):
            order = np.argsort(strings, kind="stable")
            self.order.append(order)
            self.strings.append(strings[order])

    def _strings(self, lengthened: np.ndarray) -> list[np.ndarray]:
        weight = np.uint64(1) << np.arange(self.bits - 1, -1, -1, dtype=np.uint64)
        return [((lengthened @ plane) > 0).astype(np.uint64) @ weight for plane in self.planes]

    def candidates(self, queries: np.ndarray, wanted: int) -> Iterator[np.ndarray]:
        """For each query the rows of all trees whose strings share the longest prefix that `wanted` rows in all share; repeats count."""
        strings = self._strings(np.column_stack((queries, np.zeros(len(queries)))))
        total = np.zeros((self.bits + 1, len(queries)), np.int64)
        low, high = [], []
        for own, stored in zip(strings, self.strings):
            a = np.empty((self.bits + 1, len(queries)), np.int64)
            b = np.empty_like(a)
            for depth in range(self.bits + 1):  # the range that shares `depth` leading bits
                rest = np.uint64((1 << (self.bits - depth)) - 1)
                a[depth] = np.searchsorted(stored, own & ~rest, "left")
                b[depth] = np.searchsorted(stored, own | rest, "right")
            low.append(a)
            high.append(b)
            total += b - a
        wanted = min(wanted, len(self.ids) * len(self.planes))
        depth = np.clip((total >= wanted).sum(axis=0), 1, self.bits)  # the first depth that gives too few; totals fall with depth
        low, high, each = np.stack(low), np.stack(high), np.arange(len(queries))
        deep, shallow = high[:, depth, each] - low[:, depth, each], high[:, depth - 1, each] - low[:, depth - 1, each]
        ascend = np.cumsum(shallow - deep, axis=0) - (shallow - deep) < wanted - deep.sum(axis=0)
        depth = np.where(ascend, depth - 1, depth)
        trees = np.arange(len(self.order))
        for q in range(len(queries)):
            found = np.zeros(len(self.ids), bool)
            for order, a, b in zip(self.order, low[trees, depth[:, q], q].tolist(), high[trees, depth[:, q], q].tolist()):
                found[order[a:b]] = True
            yield np.flatnonzero(found)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, visits: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, scores) of each query's k best candidates, without one row that equals the query in id and vector."""
        # so many visits that one tree at least gives k rows besides the query's own
        wanted = max(int(np.ceil(visits * len(self.ids))), len(self.planes) * (k + 1))
        for query_id, query, rows in zip(query_ids.tolist(), queries, self.candidates(queries, wanted)):
            own = np.flatnonzero(self.ids[rows] == query_id)
            own = own[(self.vectors[rows[own]] == query).all(axis=1)]
            rows = np.delete(rows, own[:1])
            score = np.einsum("ij,j->i", self.vectors[rows], query)
            ids = self.ids[rows]
            if len(ids) > k:
                edge = np.partition(score, len(score) - k)[len(score) - k]
                keep = score >= edge
                ids, score = ids[keep], score[keep]
            best = np.lexsort((ids, -score))[:k]
            yield ids[best], score[best]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, trees: int = TREES, bits: int = BITS, visits: float = VISITS) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest by inner product, ties to the smaller vec_id.

    Vectors that are null, zero or hold null or non-finite components take no part, nor do null vec_ids; a query meets the
    vectors of its own length only. Each row is a candidate and each row of queries a query, whatever ids repeat: a query's own
    row, one of equal vec_id and vector, is left out, its twins are not. Fewer candidates than k give fewer rows; an empty table
    gives none; extra columns are not read.
    """
    schema = pa.schema([("q", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
    stored = usable(vectors)
    square = F.max(F.expr("aggregate(embedding, 0D, (a, x) -> a + x * x)")).alias("square")
    sizes = {r.dims: (r.n, r.square) for r in stored.groupBy(F.size("embedding").alias("dims")).agg(F.count("*").alias("n"), square).collect()}
    if not sizes:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims = F.size("embedding")
    shards = F.lit(1).cast("long")
    for d, (n, _) in sizes.items() if len(sizes) < 2 else ((d, x) for d, x in sizes.items() if x[0] > SHARD_ROWS):
        shards = F.when(dims == d, F.lit(-(-n // SHARD_ROWS)).cast("long")).otherwise(shards)
    left = stored.select(dims.alias("dims"), F.pmod(F.xxhash64("vec_id"), shards).alias("shard"), F.lit(None).cast("long").alias("q"), "vec_id", "embedding")
    asked = row_keyed(usable(queries), "q")
    right = asked.select(dims.alias("dims"), F.explode(F.sequence(F.lit(0).cast("long"), shards - 1)).alias("shard"), "q", "vec_id", "embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by shard, a shard's vectors (q null) before the queries."""
        key, held, forest = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            d, shard, ids = (batch.column(i).to_numpy() for i in (0, 1, 3))
            asks = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(d) != 0) | (np.diff(shard) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if (d[a], shard[a]) != key:
                    key, held, forest = (d[a], shard[a]), [], None
                rows = batch.column(4).slice(a, b - a).flatten().to_numpy(zero_copy_only=False).reshape(b - a, -1)
                if not asks[a]:
                    held.append((ids[a:b], rows))
                    continue
                if forest is None and held:
                    forest = PrefixForest(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), float(np.sqrt(sizes[int(d[a])][1])), trees, bits)
                    held = []
                if forest is None:  # no vector of this length lies in the shard
                    continue
                asking = batch.column(2).slice(a, b - a).to_numpy(zero_copy_only=False).astype(np.int64)
                for at in range(0, b - a, QUERY_BLOCK):
                    part = slice(at, min(at + QUERY_BLOCK, b - a))
                    found = list(forest.search(ids[a:b][part], rows[part], k, visits))
                    n = [len(f[0]) for f in found]
                    columns = [np.repeat(asking[part], n), np.repeat(ids[a:b][part], n), np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)
        release()

    dealt = left.unionByName(right).repartition("dims", "shard").sortWithinPartitions("dims", "shard", F.asc_nulls_first("q"))
    best = dealt.mapInArrow(run, "q long, query_id long, vec_id long, score double")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op5_neighbours(spark, sf_dir: str) -> DataFrame:
    vectors = documents(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))
