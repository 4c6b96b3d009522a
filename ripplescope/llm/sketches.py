"""Fingerprints of documents as threshold-scaled sketches: every shingle hash below a fixed fraction is retained.

A shingle is a window of eight code points; windows that begin before the text are filled with a mark, so a text of n code points
has n of them. Retained hashes are the same whatever else a text holds, so the sketch of two texts together is the merge of their
sketches, and the share of a short text's hashes that a long one holds estimates containment. Texts with few hashes below the
fraction keep their smallest ones, with the bound below which nothing is missing; two sketches are compared below the smaller bound.
"""

from __future__ import annotations

import hashlib
import math
from base64 import b64decode, b64encode
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from .common import documents, release, row_keyed, text_bytes

WIDTH = 8
#: Hashes have 48 bits; one of FRACTION is retained, and the LEAST smallest in any case.
ALL = 1 << 48
FRACTION = 32
LEAST = 64
BELOW = ALL // FRACTION
_PIECE = 1 << 18
_MARK = 0x110000  # no code point
_CHUNK_BYTES = 1 << 20
#: Text of a range of documents that one task handles.
RANGE_BYTES = 8 << 20

Sketch = tuple[int, np.ndarray]  # the bound, and all different hashes below it in ascending order
_NONE = np.zeros(0, np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _window_hashes(points: np.ndarray) -> np.ndarray:
    """48-bit hashes of all windows of WIDTH code points, built from windows of half the width."""
    h, width = _mixed(points.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), 1
    factor = 0xA0761D6478BD642F
    while width < WIDTH:
        h = h[:-width] * np.uint64(factor) + h[width:]
        factor, width = factor * factor % (1 << 64), 2 * width
    return _mixed(h) >> np.uint64(16)


def _kept(hashes: np.ndarray) -> Sketch:
    few = np.unique(hashes[hashes < BELOW])
    if len(few) >= LEAST:
        return BELOW, few
    every = np.unique(hashes)
    return (ALL, every) if len(every) <= LEAST else (int(every[LEAST - 1]) + 1, every[:LEAST])


def merge(a: Sketch, b: Sketch) -> Sketch:
    """The sketch of both texts' shingles together."""
    bound = min(a[0], b[0])
    every = np.union1d(a[1], b[1])
    every = every[every < bound]
    below = int(np.searchsorted(every, BELOW))
    if below >= LEAST:
        return BELOW, every[:below]
    return (bound, every) if len(every) <= LEAST else (int(every[LEAST - 1]) + 1, every[:LEAST])


def sketches(texts: list[str]) -> list[Sketch]:
    """Short texts are hashed together, long ones piece by piece."""
    out: list[Sketch | None] = [None] * len(texts)
    held: list[tuple[int, np.ndarray]] = []
    size = 0

    def hashed() -> None:
        hashes = _window_hashes(np.concatenate([x for _, x in held]))
        at = 0
        for i, x in held:
            got = _kept(hashes[at : at + len(x) - WIDTH + 1])
            out[i] = got if out[i] is None else merge(out[i], got)
            at += len(x)
        held.clear()

    mark = np.full(WIDTH - 1, _MARK, np.uint32)
    for i, text in enumerate(texts):
        if not text:
            out[i] = (ALL, _NONE)
            continue
        points = np.concatenate([mark, np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)])
        for at in range(0, len(text), _PIECE):
            held.append((i, points[at : at + _PIECE + WIDTH - 1]))
            size += len(held[-1][1])
            if size >= _PIECE:
                hashed()
                size = 0
    if held:
        hashed()
    return out


def encoded(sketch: Sketch) -> str:
    """The bound in hexadecimal, a colon, and the hashes in base64 of six bytes each."""
    return f"{sketch[0]:x}:{b64encode(sketch[1].astype('>u8').view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()}"


def decoded(fingerprint: str) -> Sketch:
    bound, _, body = fingerprint.partition(":")
    six = np.frombuffer(b64decode(body), np.uint8).reshape(-1, 6)
    eight = np.zeros((len(six), 8), np.uint8)
    eight[:, 2:] = six
    return int(bound, 16), eight.view(">u8").ravel().astype(np.uint64)


def _shares(a: Sketch, b: Sketch) -> tuple[int, int, int]:
    """Of the hashes below the smaller bound: how many are in a, in b, in both."""
    bound = min(a[0], b[0])
    x, y = (s[1][: np.searchsorted(s[1], bound)] for s in (a, b))
    return len(x), len(y), len(np.intersect1d(x, y, assume_unique=True))


def likeness(a: Sketch, b: Sketch) -> float:
    """Estimated Jaccard similarity of the shingles; two texts without any are alike."""
    x, y, both = _shares(a, b)
    return both / (x + y - both) if x + y else 1.0


def containment(a: Sketch, b: Sketch) -> float:
    """Estimated share of a's shingles that b holds; 1 if a has none, 0 if none of a's few hashes lies below b's bound."""
    x, _, both = _shares(a, b)
    return both / x if x else float(not len(a[1]))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint. Null texts count as empty; equal texts have equal fingerprints; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                ids, texts = batch.slice(at, 256).columns
                texts = [x.decode("utf-8", "surrogateescape") for x in texts.to_pylist()]
                columns = [ids, pa.array([len(x) for x in texts], pa.int64()), pa.array([encoded(x) for x in sketches(texts)], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_chars", "fingerprint"])
        release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes()).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def _keys(gone: np.ndarray, down: np.ndarray, row: np.ndarray) -> np.ndarray:
    """One byte string per row that sorts like (gone, down, row)."""
    out = np.zeros((len(gone), 17), np.uint8)
    out[:, 0] = gone
    for at, x in ((1, down), (9, row)):
        out[:, at : at + 8] = (x.astype(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").view(np.uint8).reshape(-1, 8)
    return out.view("S17").ravel()


def _in_ranges(keyed: DataFrame) -> DataFrame:
    """keyed with (range, halo): rows dealt to ranges of about RANGE_BYTES of text by descending doc_id, null ids last.

    Each range also gets the first row of the one after it (the last range: of the first) as its halo. Ranges begin at rows that
    a sort of the keys alone has found; the driver holds one key per range.
    """
    order = ["gone", "down", "row"]
    size = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    dealt = keyed.select(*order).repartitionByRange(math.ceil(size / RANGE_BYTES) or 1, *order)
    firsts = sorted(dealt.groupBy(F.spark_partition_id()).agg(F.min(F.struct(*order)).alias("x")).select("x.*").toArrow().to_pylist(), key=lambda r: tuple(r.values()))
    starts = _keys(*[np.array([r[c] for r in firsts], np.int64) for c in order])
    n = max(1, len(firsts))

    @arrow_udf("long")
    def place(gone: pa.Array, down: pa.Array, row: pa.Array) -> pa.Array:
        keys = _keys(*[x.cast(pa.int64()).to_numpy(zero_copy_only=False) for x in (gone, down, row)])
        at = np.searchsorted(starts, keys, side="right") - 1
        return pa.array(2 * at + (starts[at] == keys), pa.int64())

    mine, before = F.floor(F.col("place") / 2).cast("long"), F.pmod(F.floor(F.col("place") / 2).cast("long") - 1, F.lit(n))
    here = F.struct(mine.alias("range"), F.lit(False).alias("halo"))
    both = F.when(F.col("place") % 2 == 1, F.array(here, F.struct(before.alias("range"), F.lit(True).alias("halo")))).otherwise(F.array(here))
    return keyed.withColumn("place", place(*order)).select("*", F.explode(both).alias("x")).select("x.*", *order, "doc_id", "text")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Each document against an edited copy of itself and against the next document by descending doc_id.

    The edited text has its last third (rounded down) replaced by as many code points of the start of the next document's text, or
    by all of it; the last document's next is the first. Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next (likeness) and contained_edited, contained_next (the share of its own shingles that the other holds).

    Null texts count as empty; null doc_ids come last; repeated doc_ids go by their place in the files, each row for itself; extra
    columns are not read; an empty table gives no rows and a single document is its own next. Texts are shuffled once.
    """
    down, known = F.bitwise_not(F.coalesce(F.col("doc_id"), F.lit(0))).alias("down"), F.col("doc_id").isNull().cast("int").alias("gone")
    keyed = row_keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "row").select(known, down, "row", "doc_id", text_bytes())
    fields = [
        ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()),
        ("near_next", pa.float64()), ("contained_edited", pa.float64()), ("contained_next", pa.float64()),
    ]

    def described(ids: list, texts: list[str]) -> pa.RecordBatch:
        """A row for each text but the last, which is the last but one's next."""
        edits = [a[: len(a) - len(a) // 3] + b[: len(a) // 3] for a, b in zip(texts, texts[1:])]
        made = sketches(texts + edits)
        own, changed = made[: len(texts)], made[len(texts) :]
        shown = [encoded(x) for x in own[:-1]]
        columns = [
            ids, [len(x) for x in texts[:-1]], [hashlib.sha256(x.encode("utf-8", "surrogateescape")).hexdigest() for x in edits], shown, [encoded(x) for x in changed],
            [likeness(x, y) for x, y in zip(own, changed)], [likeness(x, y) for x, y in zip(own, own[1:])],
            [containment(x, y) for x, y in zip(own, changed)], [containment(x, y) for x, y in zip(own, own[1:])],
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[str] = []
        size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                halo, doc_id, text = (c.to_pylist() for c in batch.slice(at, 256).columns)
                for over, i, x in zip(halo, doc_id, text):
                    texts.append(x.decode("utf-8", "surrogateescape"))
                    size += len(x)
                    if over or size >= _CHUNK_BYTES:
                        if len(texts) > 1:
                            yield described(ids, texts)
                        ids, texts, size = ([], [], 0) if over else ([], texts[-1:], 0)
                    if not over:
                        ids.append(i)
        release()

    placed = _in_ranges(keyed).repartition("range").sortWithinPartitions("range", "halo", "gone", "down", "row")
    kinds = {pa.int64(): "long", pa.string(): "string", pa.float64(): "double"}
    return placed.select("halo", "doc_id", "text").mapInArrow(run, ", ".join(f"{n} {kinds[k]}" for n, k in fields))


def op11_sketches(spark, sf_dir: str) -> DataFrame:
    return edited_fingerprints(documents(spark, sf_dir))
