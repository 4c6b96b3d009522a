"""Ranked lexical search as a blocked sparse matrix product: items by terms, times terms by documents.

The documents are read once per block of items and written as blocks of a term-major sparse matrix over the items' terms (which
documents hold a term, and how often). Document frequencies are sums over these blocks. For the product, the impacts of a block's
entries are computed at once as 64-bit integers; an item's row is the merge of the rows of its terms (Gustavson), added up in one
array over the block's documents; and only an item's best documents leave a block, a task, and at last the final ranking.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, materialize, release, row_keyed, text_bytes

TOP = 50
#: Entries (item, term) of a block of items, which the driver and each task hold as a whole; one item's terms always fit.
ITEM_ENTRIES = 1_000_000
#: A block of documents ends at so many documents or occurrences of items' terms.
BLOCK_DOCS, BLOCK_OCCURRENCES = 16_384, 2_000_000

#: Bytes of terms are digits, letters and all beyond ASCII; others separate them. Only A-Z change case.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


@dataclass
class ItemBlock:
    """Some items as a sparse matrix: item i has the terms columns[first[i]:first[i + 1]], each so many times."""

    keys: list[int]
    ids: list[int | None]
    vocabulary: dict[bytes, int]
    first: np.ndarray
    columns: np.ndarray
    times: np.ndarray

    @classmethod
    def of(cls, rows: pa.Table, once: bool) -> ItemBlock:
        words = rows["words"].combine_chunks()
        words = words if isinstance(words, pa.Array) else pa.concat_arrays(words.chunks)
        held = words.flatten().to_pylist()
        vocabulary = {w: i for i, w in enumerate(sorted(set(held)))}
        first = np.concatenate([[0], np.cumsum([len(x) for x in words.to_pylist()], dtype=np.int64)])
        times = np.ones(len(held), np.int64) if once else np.array([n for x in rows["times"].to_pylist() for n in x], np.int64)
        return cls(rows["item"].to_pylist(), rows["item_id"].to_pylist(), vocabulary, first, np.fromiter(map(vocabulary.__getitem__, held), np.int64, len(held)), times)


def _item_terms(items: DataFrame) -> DataFrame:
    """(item, item_id, words, times): the different terms of each item; items without any have no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, item_id, text in zip(*[c.to_pylist() for c in batch.columns]):
                words, times = np.unique(np.array(terms(text), object), return_counts=True)
                if len(words):
                    rows.append((item, item_id, list(words), times.tolist()))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["item", "item_id", "words", "times"])

    keyed = row_keyed(items.select(F.col("item_id").cast("long").alias("item_id"), "text"), "item")
    return keyed.select("item", "item_id", text_bytes()).mapInArrow(run, "item long, item_id long, words array<binary>, times array<long>")


def _item_blocks(held: DataFrame, entries: int) -> Iterator[pa.Table]:
    """held in blocks of at most so many entries (or one item), one at a time."""
    size = F.size("words").cast("long")
    total, largest = held.agg(F.sum(size), F.max(size)).first()
    blocks = math.ceil((total or 0) / entries)
    while blocks:
        block = F.pmod(F.xxhash64("item"), F.lit(blocks))
        if blocks == 1 or held.groupBy(block).agg(F.sum(size).alias("n")).agg(F.max("n")).first()[0] <= max(entries, largest):
            break
        blocks *= 2
    for i in range(blocks):
        yield held.where(block == i).toArrow()


_BLOCK = [("ids", pa.binary()), ("known", pa.binary()), ("lengths", pa.binary()), ("terms", pa.binary()), ("starts", pa.binary()), ("docs", pa.binary()), ("times", pa.binary())]
_BLOCK_DDL = "n_docs long, n_terms long, " + ", ".join(f"{name} binary" for name, _ in _BLOCK)


def _document_blocks(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Documents with at least one term, as blocks: ids and lengths of its documents, and the entries of each term that it holds."""
    names = ["n_docs", "n_terms", *[name for name, _ in _BLOCK]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        lengths: list[int] = []
        found: list[np.ndarray] = []
        size = 0

        def block() -> pa.RecordBatch:
            nonlocal size
            at = np.repeat(np.arange(len(found)), [len(x) for x in found])
            cells, times = np.unique(np.concatenate(found).astype(np.int64) * len(found) + at, return_counts=True)
            term, doc = np.divmod(cells, len(found))
            held, starts = np.unique(term, return_index=True)
            known = np.array([i is not None for i in ids], np.bool_)
            parts = [
                np.array([i or 0 for i in ids], np.int64), known, np.array(lengths, np.int64), held.astype(np.int32), np.append(starts, len(term)).astype(np.int32), doc.astype(np.int32),
                times.astype(np.int32),
            ]
            counts = [pa.array([len(ids)], pa.int64()), pa.array([sum(lengths)], pa.int64())]
            ids.clear(), lengths.clear(), found.clear()
            size = 0
            return pa.RecordBatch.from_arrays([*counts, *[pa.array([x.tobytes()], pa.binary()) for x in parts]], names=names)

        for batch in batches:
            for doc_id, text in zip(*[c.to_pylist() for c in batch.columns]):
                words = terms(text)
                if not words:
                    continue
                numbers = np.fromiter(map(vocabulary.get, words, repeat(-1)), np.int32, len(words))
                ids.append(doc_id)
                lengths.append(len(words))
                found.append(numbers[numbers >= 0])
                size += len(found[-1])
                if len(ids) >= BLOCK_DOCS or size >= BLOCK_OCCURRENCES:
                    yield block()
        if ids:
            yield block()
        release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes()).mapInArrow(run, _BLOCK_DDL)


def _frequencies(blocks: DataFrame, width: int) -> np.ndarray:
    """In how many documents each term occurs: sums by task, then over tasks; the driver gets one number per term of the items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.int64)
        for batch in batches:
            for held, starts in zip(*[c.to_pylist() for c in batch.columns]):
                total[np.frombuffer(held, np.int32)] += np.diff(np.frombuffer(starts, np.int32))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["term", "n"])

    sums = blocks.select("terms", "starts").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(width, np.int64)
    out[sums["term"].to_numpy()] = sums["n"].to_numpy()
    return out


def _best(score: np.ndarray, ids: np.ndarray, known: np.ndarray, top: int) -> np.ndarray:
    """The places of the top entries: highest scores first, equal ones by ascending id, null ids last."""
    some = np.arange(len(score))
    if len(score) > top:
        some = np.flatnonzero(score >= np.partition(score, -top)[-top])
    return some[np.lexsort((ids[some], ~known[some], -score[some]))[:top]]


def _product(blocks: DataFrame, items: ItemBlock, weights: np.ndarray, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """(item, item_id, doc_id, score): each task's best documents of each item."""
    first, columns, times, keys, item_ids = items.first, items.columns, items.times, items.keys, items.ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple | None] = [None] * len(keys)
        place = np.full(len(weights), -1, np.int64)
        for batch in batches:
            for row in batch.select([name for name, _ in _BLOCK]).to_pylist():
                ids, known, lengths = (np.frombuffer(row[c], k) for c, k in (("ids", np.int64), ("known", np.bool_), ("lengths", np.int64)))
                held, starts, docs, tf = (np.frombuffer(row[c], np.int32) for c in ("terms", "starts", "docs", "times"))
                tf = tf.astype(np.int64)
                m = 100 - 50 + (50 * lengths * n_docs) // n_terms
                impacts = np.repeat(weights[held], np.diff(starts)) * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[docs]))
                place[:] = -1
                place[held] = np.arange(len(held))
                scores = np.zeros(len(ids), np.int64)
                for i in range(len(keys)):
                    wanted = slice(first[i], first[i + 1])
                    scores[:] = 0
                    for at, n in zip(place[columns[wanted]].tolist(), times[wanted].tolist()):
                        if at >= 0:  # a document stands in a term's row once
                            part = slice(starts[at], starts[at + 1])
                            scores[docs[part]] += n * impacts[part]
                    least = 1 if best[i] is None or len(best[i][0]) < top else best[i][0][-1]
                    some = np.flatnonzero(scores >= least)
                    if not len(some):
                        continue
                    got = (scores[some], ids[some], known[some])
                    got = got if best[i] is None else tuple(map(np.concatenate, zip(best[i], got)))
                    chosen = _best(*got, top)
                    best[i] = tuple(x[chosen] for x in got)
        for i, x in enumerate(best):
            if x is not None:
                n = len(x[0])
                parts = [pa.repeat(pa.scalar(keys[i], pa.int64()), n), pa.repeat(pa.scalar(item_ids[i], pa.int64()), n), pa.array(x[1], pa.int64(), mask=~x[2]), pa.array(x[0], pa.int64())]
                yield pa.RecordBatch.from_arrays(parts, names=["item", "item_id", "doc_id", "score"])
        release()

    return blocks.mapInArrow(run, "item long, item_id long, doc_id long, score long")


def rank_documents(items: DataFrame, docs: DataFrame, top: int = TOP, once: bool = True, entries: int = ITEM_ENTRIES) -> DataFrame:
    """items(item_id, text), docs(doc_id, text) to (item_id, rank, doc_id, score): the top documents of each row of items.

    A term's weight is floor(1000 ln((2 N + 2) / (2 df + 1))); its impact in a document grows with its occurrences and falls with
    the document's length against the mean. once: a term counts once for an item, else as often as the item holds it. Only scores
    above 0 are returned; equal scores go by ascending doc_id, null ids last. Null and empty texts have no terms: such items have
    no rows, such documents count nowhere. Repeated rows are items and documents of their own; extra columns are not read; an
    empty table on either side gives no rows.

    Each block of items reads the documents once; a block's items and one number per term are all that the driver holds.
    """
    spark = docs.sparkSession
    held = materialize(_item_terms(items), "items")
    found: list[DataFrame] = []
    for rows in _item_blocks(held, entries):
        block = ItemBlock.of(rows, once)
        matrix = materialize(_document_blocks(docs, block.vocabulary), "matrix")
        n_docs, n_terms = matrix.agg(F.sum("n_docs"), F.sum("n_terms")).first()
        if n_docs:
            df = _frequencies(matrix, len(block.vocabulary))
            weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
            found.append(materialize(_product(matrix, block, weights, n_docs, n_terms, top), "best"))
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("item_id", "rank", "doc_id", "score")


def op13_ranked(spark, sf_dir: str) -> DataFrame:
    return rank_documents(documents(spark, sf_dir, "benchmark"), documents(spark, sf_dir))


ORACLE = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
l AS (SELECT r, doc_id, CAST(len(words) AS BIGINT) AS n FROM d WHERE len(words) > 0),
a AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM l),
t AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(words) AS term FROM d) GROUP BY r, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM t GROUP BY term), a),
s AS (SELECT i.item_id, t.r, l.doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score
    FROM i JOIN t ON t.term = i.term JOIN w ON w.term = i.term JOIN l ON l.r = t.r, a GROUP BY i.item_id, t.r, l.doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 50"""
