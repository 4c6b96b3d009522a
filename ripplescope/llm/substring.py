"""Substring deduplication by seed and extend.

Seeds: of the ANCHOR-word hashes inside each WINDOW-word window the smallest is the window's anchor (winnowing, Schleimer et
al., 2003), so equal windows have equal anchors at equal places and a passage of WINDOW words cannot repeat without a shared
anchor. Windows with the same anchor are neighbours; the words they span are the anchor's block.

Extend: occurrences of an anchor seen more than once are extended both ways to their whole blocks. Equal blocks repeat
entirely. Where an anchor has several different blocks, which is where a repeat begins or ends, one occurrence of each is
extended word by word: its windows are compared through hashes of their words. Overlapping repeated windows of a document
merge into maximal repeats. No pair of occurrences is ever formed, so a passage that a third of the documents share costs one
row per occurrence, and a counted group is combined before it is shuffled.

Words are hashed to 64 bits; an anchor, a block and a window use different polynomials over them, so a window is identified
by 128 bits (anchor and window, or anchor and block).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, materialize, row_keyed, text_bytes

WINDOW = 35
ANCHOR = 12
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)  # odd, so each has an inverse
_VOCABULARY = 400_000
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


_word_hashes = _WordHashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    if len(_word_hashes) > _VOCABULARY:
        _word_hashes.clear()
    return np.fromiter(map(_word_hashes.__getitem__, words), np.uint64, len(words))


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64, n + 1 of each at least."""
    if base not in _powers or len(_powers[base][0]) <= n:
        inverse = pow(base, -1, 1 << 64)
        factors = np.array([[base], [inverse]], np.uint64).repeat(max(4096, 2 * n), axis=1)
        factors[:, 0] = 1
        _powers[base] = tuple(np.cumprod(factors, axis=1, dtype=np.uint64))
    return _powers[base]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class _Prefix:
    """Polynomial hashes of any runs of words."""

    def __init__(self, hashes: np.ndarray, base: int) -> None:
        power, self.inverse = _power(base, len(hashes))
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * power[: len(hashes)], dtype=np.uint64)))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.inverse[start])


def _smallest(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each run of width hashes the place of its smallest, the last of equal ones."""

    def better(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(hashes[b] <= hashes[a], b, a)

    best, have = np.arange(len(hashes)), 1
    while have < width:
        step = min(have, width - have)
        best = better(best[: len(best) - step], best[step:])
        have += step
    return best


def blocks(hashes: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """anchor hash, block hash, first window, number of windows, anchor's place in the block; for each anchor of a document."""
    n = len(hashes)
    at = np.arange(n - anchor + 1)
    grams = _Prefix(hashes, _BASES[0]).of(at, at + anchor)
    place = _smallest(grams, window - anchor + 1)
    first = np.concatenate(([0], np.flatnonzero(np.diff(place)) + 1))
    count = np.diff(np.concatenate((first, [len(place)])))
    offset = place[first] - first
    whole = _Prefix(hashes, _BASES[1]).of(first, first + count + window - 1)
    whole = _mixed(whole ^ (offset.astype(np.uint64) << np.uint64(32)) ^ count.astype(np.uint64))
    return grams[place[first]].view(np.int64), whole.view(np.int64), first, count, offset


def _seeds(keyed: DataFrame, window: int, anchor: int) -> DataFrame:
    """(__row, text) to (anchor, block, __row, first, n, off), one row per anchor occurrence."""
    types = [("anchor", pa.int64()), ("block", pa.int64()), ("__row", pa.int64()), ("first", pa.int32()), ("n", pa.int32()), ("off", pa.int32())]
    schema = pa.schema(types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, found, rows = batch.slice(at, 512), [], []
                for row, text in zip(part.column(0).to_pylist(), part.column(1)):
                    words = text.as_py().split()
                    if len(words) >= window:
                        found.append(blocks(word_hashes(words), window, anchor))
                        rows.append(np.full(len(found[-1][0]), row))
                if found:
                    a, b, first, n, off = (np.concatenate(x) for x in zip(*found))
                    columns = [a, b, np.concatenate(rows), first.astype(np.int32), n.astype(np.int32), off.astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(columns, types)], schema=schema)

    return keyed.select("__row", text_bytes()).mapInArrow(run, "anchor long, block long, __row long, first int, n int, off int")


def _windows(texts: DataFrame, window: int) -> DataFrame:
    """(text, wanted: array of block occurrences) to (anchor, block, i, place, words), one row per window."""
    types = [("anchor", pa.int64()), ("block", pa.int64()), ("i", pa.int32()), ("place", pa.int32()), ("words", pa.int64())]
    schema = pa.schema(types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, wanted in zip(batch.column(0), batch.column(1)):
                hashes, of = word_hashes(text.as_py().split()), wanted.values
                a, b, first, n, off = (of.field(x).to_numpy(zero_copy_only=False) for x in ("anchor", "block", "first", "n", "off"))
                i = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                start = np.repeat(first, n) + i
                words = _Prefix(hashes, _BASES[2]).of(start, start + window).view(np.int64)
                columns = [np.repeat(a, n), np.repeat(b, n), i.astype(np.int32), (np.repeat(off, n) - i).astype(np.int32), words]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(columns, types)], schema=schema)

    return texts.select("text", "wanted").mapInArrow(run, "anchor long, block long, i int, place int, words long")


def repeated_windows(keyed: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(__row, text) to (__row, first, mask): bit i of mask is set if the window of words that starts at first + i repeats."""
    seeds = materialize(_seeds(keyed, window, anchor), "seeds")
    repeated = materialize(seeds.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1").select("anchor"), "anchors")
    seen = materialize(seeds.join(repeated, "anchor", "left_semi"), "occurrences")
    kinds = materialize(seen.groupBy("anchor", "block").agg(F.count("*").alias("k"), F.min(F.struct("__row", "first", "n", "off")).alias("one")), "blocks")
    # written, so that both sides of the join come from a shuffle and a hot anchor's blocks can be split over tasks
    several = materialize(kinds.groupBy("anchor").agg(F.count("*").alias("d")).where("d > 1").select("anchor"), "several")
    wanted = kinds.join(several, "anchor", "left_semi").select("one.__row", F.struct("anchor", "block", "one.first", "one.n", "one.off").alias("x"))
    wanted = wanted.groupBy("__row").agg(F.collect_list("x").alias("wanted"))
    windows = materialize(_windows(keyed.select("__row", text_bytes()).join(wanted, "__row"), window), "windows")
    shared = windows.groupBy("anchor", "place", "words").agg(F.count("*").alias("k")).where("k > 1").drop("k")
    partly = windows.join(shared, ["anchor", "place", "words"], "left_semi").groupBy("anchor", "block").agg(F.sum(F.expr("shiftleft(1L, i)")).alias("part"))
    partly = materialize(partly, "partly")
    whole = kinds.where("k > 1").select("anchor", "block", F.expr("shiftleft(1L, one.n) - 1").alias("part"))
    masks = partly.join(whole, ["anchor", "block"], "left_anti").unionByName(whole)
    return seen.join(masks, ["anchor", "block"]).select("__row", "first", F.col("part").alias("mask"))


def repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Rows as given with (__row, doc_id, text bytes, hits): hits lists the repeated windows of a row's text, or is null."""
    if not anchor <= window <= anchor + 62:
        raise ValueError("a window holds its anchor and at most 63 windows share one")
    keyed = row_keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    found = repeated_windows(keyed, window, anchor).groupBy("__row").agg(F.collect_list(F.struct("first", "mask")).alias("hits"))
    return keyed.select("__row", "doc_id", text_bytes()).join(found, "__row", "left")


def _covered(n: int, firsts: np.ndarray, masks: np.ndarray, window: int) -> np.ndarray:
    starts = np.concatenate([first + np.flatnonzero((int(mask) >> np.arange(63)) & 1) for first, mask in zip(firsts, masks)])
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return np.cumsum(edge[:-1]) > 0


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, spans (maximal repeats as [start, end) in words), kept_text.

    A word goes if a window of `window` words that covers it also starts elsewhere in the input, the same document included;
    kept words are joined by one space. Null and empty texts have no words; texts shorter than a window lose nothing; repeated
    rows are each other's repeats; a null doc_id stays null; extra columns are not read; an empty table gives no rows.
    """
    types = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("kept_text", pa.string())]
    schema = pa.schema(types)

    def one(doc_id: int | None, text: bytes, hits: pa.Scalar) -> tuple:
        words = text.split()
        if not hits.is_valid:
            return doc_id, len(words), 0, [], b" ".join(words).decode()
        of = hits.values
        gone = _covered(len(words), of.field("first").to_numpy(), of.field("mask").to_numpy(), window)
        edges = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8))).reshape(-1, 2)
        kept = [words[i] for i in np.flatnonzero(~gone).tolist()]
        return doc_id, len(words), int(gone.sum()), edges.tolist(), b" ".join(kept).decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = [one(i, t.as_py(), h) for i, t, h in zip(part.column(0).to_pylist(), part.column(1), part.column(2))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), types)], schema=schema)

    return repeats(docs, window, anchor).select("doc_id", "text", "hits").mapInArrow(run, "doc_id long, n_words long, n_removed long, spans array<array<long>>, kept_text string")


def op7_substring(spark, sf_dir: str) -> DataFrame:
    kept = remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT rid, i, md5(array_to_string(list_slice(ws, i, i + 34), ' ')) AS h
      FROM (SELECT rid, ws, unnest(range(1, len(ws) - 33)) AS i FROM d WHERE len(ws) >= 35)),
r AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
g AS (SELECT DISTINCT rid, i + k AS pos FROM (SELECT rid, i FROM w JOIN r USING (h)), (SELECT unnest(range(0, 35)) AS k)),
p AS (SELECT rid, doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM d),
k AS (SELECT p.rid, string_agg(word, ' ' ORDER BY p.pos) AS kept, count(*) AS n FROM p LEFT JOIN g ON p.rid = g.rid AND p.pos = g.pos WHERE g.rid IS NULL GROUP BY p.rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (rid)
"""
