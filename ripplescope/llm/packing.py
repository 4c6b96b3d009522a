"""Harmonic packing of tokenised documents into fixed-length sequences.

Each partition packs alone. A document's whole multiples of the capacity are sequences of their own; its remainder falls
into the reciprocal-capacity class k with capacity / (k + 1) < length <= capacity / k, and a bin of class k closes with
exactly k remainders. Remainders below capacity / CLASSES are the last class: a stream that may be cut anywhere and fills
what the closed bins leave open. When the stream runs dry, the youngest closed bins are dissolved into it. What is left at
the end of a partition is cut into sequences whose lengths are powers of two, so no sequence needs padding.
"""

from __future__ import annotations

import os
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, release

CAPACITY = 2048
CLASSES = 16
END_ID = 1
CACHE = 1_000_000
TOGETHER = 256
_SLICE_BYTES = 4 << 20
_ROUND = 8192
_FLUSH_BYTES = 4 << 20


class _Recent:
    """A map that keeps the entries used of late: two generations of at most `cap` each."""

    def __init__(self, cap: int) -> None:
        self.cap, self.new, self.old = cap, {}, {}

    def missing(self, keys: set) -> set:
        """Keys without an entry; entries of the others are in `new`."""
        if len(self.new) + len(keys) > self.cap:
            self.new, self.old = {}, self.new
        absent, old = keys.difference(self.new), self.old
        if not old:
            return absent
        known = absent.intersection(old)
        self.new.update(zip(known, map(old.__getitem__, known)))
        return absent.difference(known)


#: Marks that are a piece of their own when they follow letters and end a part.
_MARKS = frozenset(".,;:!?")
_RUN = 100


class Encoder:
    """Token ids by a tokenizers file, as little-endian unsigned 32-bit bytes.

    The byte-level pattern starts a new piece at a space that a non-space follows, so a text is cut there and each different
    part is encoded once, in runs of many parts whose ids are dealt to them by their lengths in bytes. Letters and one mark
    after them are two pieces, so such a part is put together from both.
    """

    def __init__(self, path: str, cache: int = CACHE) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.parts, self.leading = _Recent(cache), _Recent(cache // 8)
        special = {i: x.content for i, x in self.tokenizer.get_added_tokens_decoder().items()}
        self.added = re.compile("|".join(map(re.escape, special.values())) or "(?!)")
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        # in a byte-level vocabulary each character of an entry stands for one byte; added tokens stand for themselves
        self.bytes_of = np.array([len(special[i].encode()) if i in special else len(self.tokenizer.id_to_token(i)) for i in range(size)], np.int64)
        self.marks = {x: self._alone([x])[0] for x in _MARKS}
        # ASCII letters after a space are one piece, so runs of such parts can do without the pattern; the vocabulary spells a
        # space U+0120. One tokenizer serves both: its vocabulary takes most of a worker's memory
        self.pattern, self.at_spaces = self.tokenizer.pre_tokenizer, CharDelimiterSplit(" ")

    def _alone(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _in_runs(self, parts: list[str], letters: bool) -> dict[str, bytes]:
        groups = [parts[i : i + _RUN] for i in range(0, len(parts), _RUN)]
        joined = [" " + " ".join(g) for g in groups]
        if letters:
            joined = [x.replace(" ", " \u0120")[1:] for x in joined]
            self.tokenizer.pre_tokenizer = self.at_spaces
        out: dict[str, bytes] = {}
        try:
            runs = self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)
        finally:
            self.tokenizer.pre_tokenizer = self.pattern
        for group, run in zip(groups, runs):
            ids = np.array(run.ids, "<u4")
            lengths = np.fromiter(map(len, map(str.encode, group)), np.int64, len(group)) + 1
            cuts = (4 * np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum(lengths)) + 4).tolist()
            raw = ids.tobytes()
            out.update(zip(group, [raw[a:b] for a, b in zip([0, *cuts], cuts)]))
        return out

    def _learn(self, parts: set[str], special: bool) -> dict[str, bytes]:
        """Ids of parts, each with the space before it."""
        fresh = self.parts.missing(parts)
        marked = [x for x in fresh if x[-1:] in _MARKS and x[:-1].isalpha()]
        fresh.difference_update(marked)
        alone = [x for x in fresh if self.added.search(x)] if special else []
        fresh.difference_update(alone)
        known = self.parts.new
        fresh.update({x[:-1] for x in marked if x[:-1] not in known})
        letters = [x for x in fresh if x.isascii() and x.isalpha()]
        known.update(self._in_runs(letters, True))
        known.update(self._in_runs(list(fresh.difference(letters)), False))
        known.update(zip(alone, self._alone([" " + x for x in alone])))
        known.update([(x, known[x[:-1]] + self.marks[x[-1]]) for x in marked])
        return known

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [re.split(r" (?=\S)", x) if re.search(r" \s", x) else x.split(" ") for x in texts]
        first = [parts.pop(0) for parts in cut]
        of = self._learn(set().union(*cut), any(self.added.search(x) for x in texts)).__getitem__
        unknown = list(self.leading.missing(set(first)))
        leading = self.leading.new
        leading.update(zip(unknown, self._alone(unknown)))
        return [leading[x] + b"".join(map(of, parts)) for x, parts in zip(first, cut)]


class HarmonicPacker:
    """add() and end() return pieces (doc, start, ids, doc_tokens, sequence, offset)."""

    def __init__(self, capacity: int = CAPACITY, classes: int = CLASSES, first_sequence: int = 0) -> None:
        self.capacity, self.classes, self.sequence = capacity, classes, first_sequence
        self.open: dict[int, list] = {}
        self.gapped: deque[list] = deque()
        self.stream: deque[tuple] = deque()
        self.streamed = self.pending = 0
        self.out: list[tuple] = []

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, tokens in pieces:
            self.out.append((doc, start, ids, tokens, self.sequence, offset))
            offset += len(ids) // 4
        self.sequence += 1

    def _flow(self, pieces: list[tuple]) -> None:
        self.stream.extend(pieces)
        self.streamed += sum(len(x[2]) // 4 for x in pieces)

    def _take(self, length: int) -> list[tuple]:
        """Exactly length tokens from the stream; the last piece is cut."""
        self.streamed -= length
        got = []
        while length:
            doc, start, ids, tokens = self.stream.popleft()
            n = len(ids) // 4
            if n > length:
                self.stream.appendleft((doc, start + length, ids[4 * length :], tokens))
                ids = ids[: 4 * length]
            got.append((doc, start, ids, tokens))
            length -= min(n, length)
        return got

    def _gap(self, pieces: list[tuple]) -> int:
        return self.capacity - sum(len(x[2]) // 4 for x in pieces)

    def _fill(self) -> None:
        while self.gapped and (gap := self._gap(self.gapped[0])) <= self.streamed:
            bin_ = self.gapped.popleft()
            self.pending -= len(bin_)
            self._emit([*bin_, *self._take(gap)])
        while self.streamed >= 8 * self.capacity:
            self._emit(self._take(self.capacity))

    def _settle(self) -> None:
        self._fill()
        while self.gapped:
            bin_ = self.gapped.pop()
            self.pending -= len(bin_)
            self._flow(bin_)
            self._fill()

    def _drain(self) -> list[tuple]:
        out, self.out = self.out, []
        return out

    def add(self, doc, ids: bytes) -> list[tuple]:
        size, tokens = 4 * self.capacity, len(ids) // 4
        whole = len(ids) // size * size
        for at in range(0, whole, size):
            self._emit([(doc, at // 4, ids[at : at + size], tokens)])
        if whole < len(ids):
            piece = (doc, whole // 4, ids[whole:], tokens)
            k = size // len(piece[2])
            if k >= self.classes:
                self._flow([piece])
            else:
                bin_ = self.open.setdefault(k, [])
                bin_.append(piece)
                if len(bin_) == k:
                    self.gapped.append(self.open.pop(k))
                    self.pending += k
            self._fill()
            if self.pending > _ROUND:
                self._settle()
        return self._drain()

    def end(self) -> list[tuple]:
        self._settle()
        for k in sorted(self.open):
            self._flow(self.open.pop(k))
        while self.streamed >= self.capacity:
            self._emit(self._take(self.capacity))
        while self.streamed:
            self._emit(self._take(1 << (self.streamed.bit_length() - 1)))
        return self._drain()


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, classes: int = CLASSES, end_id: int = END_ID, cache: int = CACHE, together: int = TOGETHER) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    cache: parts of texts whose ids a worker keeps, about 200 bytes each in four generations. together: documents whose parts are
    looked up at once, fewer if their texts are long. Both change speed and memory only.

    Each document's ids are its text's, then end_id; null and empty texts give end_id alone. A null doc_id stays null and
    repeated rows are packed each by itself; extra columns are not read; an empty table gives no rows. sequence_id is unique over
    partitions: the partition in the high bits. Nothing is shuffled.
    """
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
    schema = pa.schema(fields)
    end = end_id.to_bytes(4, "little")

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path, cache)
        packer = HarmonicPacker(capacity, classes, TaskContext.get().partitionId() << 36)
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for part in _slices(batch, together):
                for doc, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist())):
                    rows += (got := packer.add(doc, ids + end))
                    held += sum(len(x[2]) for x in got)
                    if held > _FLUSH_BYTES:
                        yield batch_of(rows)
                        rows, held = [], 0
        rows += packer.end()
        if rows:
            yield batch_of(rows)
        release()

    ddl = "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, offset long"
    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(run, ddl)
    return pieces.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("length"), "ids", "doc_tokens", "sequence_id", "offset")


def _slices(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most so many rows and _SLICE_BYTES of text, or one row."""
    ends = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        n = min(rows, max(1, int(np.searchsorted(ends, done + _SLICE_BYTES, side="right")) - at))
        yield batch.slice(at, n)
        at += n


_encoders: dict[tuple[str, int], Encoder] = {}


def _encoder(path: str, cache: int) -> Encoder:
    """One per worker process: its cache serves the tasks that follow."""
    if (path, cache) not in _encoders:
        _encoders.clear()
        _encoders[path, cache] = Encoder(path, cache)
    return _encoders[path, cache]


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest(pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), together=1024))
