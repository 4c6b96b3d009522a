"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax.

A word is reached in three steps, log P(w | h) = log P(class | h) + log P(path | class, h) + log P(w | class, path).

* Class. Words fall into CLASSES classes by ending, script and punctuation. A softmax over them has the classes of the three
  words before as features: single ones (two of them skipping words), pairs and all three, hashed into 2**FEATURE_BITS rows.
  The likelihood's gradient needs the corpus only through how often each class follows each history, a table of CLASSES**4
  cells that one pass over all training texts sums up; its histories are dealt to shards, each step sums the shards' gradients.
* Path. PATH bits of a word's hash lead through a binary tree of classes inside its class. Each node is a softmax of two with
  the words before as features: the last one, the last but one (a skip), and both, hashed with the node into 2**bits weights.
  bits grows with the training tokens, up to MOST_BITS. Each step sums the gradients of all training tokens: tasks hand pieces
  of the weight vector to a shuffle that adds them up, and a task reads so many tokens that its gradient is small beside them.
* Word. Inside a path's end, words are drawn by their training counts less DISCOUNT. The mass so taken belongs to the class's
  unseen words, which are one event per class.

Texts are cut into words once, in chunks of bounded size that keep their different words' hashes and the places of these.
Counts of words cover the whole training set, whatever its vocabulary: chunks ask for the counts of their different words, a
sum and a join by word answer, and each chunk is scored with its own answers. Words are known by 59 bits of hash and their
class; n_known, V and base_score are exact unless two words share both. Nothing that grows with the vocabulary is broadcast or
collected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import arrow_batches
from .common import crc32_remainder, documents, materialize, release, row_keyed, text_bytes

CLASSES = 32
FEATURE_BITS = 13
STEPS = 16
SHARDS = 4
DISCOUNT = 0.75
#: Tokens of a chunk, but for a longer text, which is a chunk of its own.
CHUNK_TOKENS = 1 << 20
BATCH_ROWS = 512
PATH = 6
#: Weights of the paths: 2**bits, a weight for each 2**8 tokens or so.
LEAST_BITS, MOST_BITS, TOKENS_BITS = 14, 22, 8
PATH_STEPS = 2
PATH_RATE, PATH_PENALTY = 0.5, 2.0
_PIECE = 1 << 14
_BLOCK = 1 << 16
#: The end of a text: its hash, and its class, which also stands for what comes before a text.
END_HASH, END = xxhash.xxh64_intdigest(b"\n"), 0
END_CODE = END_HASH & ~31 | END


_MARKS = b".,;:!?\"')]*$%#&"
_NUMBER = re.compile(rb"[0-9.,:/-]+")
_STOP = re.compile(rb"[.!?]")


def word_class(word: bytes) -> int:
    """1 to CLASSES - 1."""
    bare = word.rstrip(_MARKS)
    if not bare:
        return 1
    foreign = not bare.isascii()
    if bare[0] < 58 and _NUMBER.fullmatch(bare):
        return 2
    if len(bare) < len(word):
        tail = word[len(bare) :]
        if _STOP.search(tail):
            return 3 + foreign
        return (5 if tail in (b",", b";", b":") else 7) + foreign
    return 9 + xxhash.xxh32_intdigest(bare[-2:], foreign) % (CLASSES - 9)


class _Places(dict):
    """word to its number in a chunk."""

    def __missing__(self, word: bytes) -> int:
        self[word] = place = len(self)
        return place


def code_of(word: bytes) -> int:
    """59 bits of hash, 5 of class."""
    return xxhash.xxh64_intdigest(word) & ~31 | word_class(word)


def _packed(places: np.ndarray) -> bytes:
    return pa.Codec("zstd", compression_level=1).compress(places.tobytes(), asbytes=True)


def _unpacked(places: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.Codec("zstd").decompress(places, 4 * n, asbytes=True), "<u4")


_CHUNK = pa.schema([("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int64())), ("tokens", pa.int64()), ("learned", pa.int64()), ("places", pa.binary()), ("codes", pa.binary()), ("counts", pa.binary())])
_CHUNK_DDL = "doc_ids array<long>, held array<boolean>, lengths array<long>, tokens long, learned long, places binary, codes binary, counts binary"


def _chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, text) to one row per chunk of texts; places are packed unsigned 32-bit numbers of the codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, places, ids, held, size = _Places(), [], [], [], 0
        known[b"\n"] = 0

        def out() -> pa.RecordBatch:
            codes = np.fromiter(map(code_of, known), np.uint64, len(known))
            codes[0] = END_CODE
            lengths = [len(x) for x in places]
            joined = np.concatenate(places)
            training = joined[np.repeat(~np.array(held, bool), lengths)]
            counts = np.bincount(training, minlength=len(codes)).astype("<u4")
            row = [ids, held, lengths, len(joined), len(training), _packed(joined), codes.tobytes(), counts.tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _CHUNK)], schema=_CHUNK)

        for batch in batches:
            for doc_id, held_out, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                words = text.as_py().lower().split()
                if places and size + len(words) >= CHUNK_TOKENS:
                    yield out()
                    known, places, ids, held, size = _Places(), [], [], [], 0
                    known[b"\n"] = 0
                at = np.zeros(len(words) + 1, "<u4")
                at[:-1] = np.fromiter(map(known.__getitem__, words), np.uint32, len(words))
                places.append(at)
                ids.append(doc_id)
                held.append(held_out)
                size += len(at)
        if places:
            yield out()
        del known, places
        release()

    return docs.select("doc_id", "held_out", text_bytes()).mapInArrow(run, _CHUNK_DDL)


class _Chunk:
    """What a row of _chunks holds, as arrays over its tokens."""

    def __init__(self, lengths: list[int], held: list[bool], tokens: int, places: bytes, codes: bytes) -> None:
        self.lengths = np.array(lengths, np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.place = _unpacked(places, tokens)
        self.codes = np.frombuffer(codes, np.uint64)
        self.training = np.repeat(~np.array(held, bool), self.lengths)

    def histories(self) -> np.ndarray:
        """For each token (c3, c2, c1, c0) as one number: its class and those of the three tokens before."""
        return histories((self.codes & np.uint64(31)).astype(np.uint8)[self.place], self.starts)

    def before(self, k: int) -> np.ndarray:
        """The places' shift by k tokens; 0, the end, before a text's start."""
        back = np.zeros_like(self.place)
        back[k:] = self.place[:-k]
        for j in range(k):
            at = self.starts + j
            back[at[at < len(back)]] = 0
        return back


def histories(classes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each token of concatenated texts (c3, c2, c1, c0) as one number; what lies before a text's start counts as END."""
    out = classes.astype(np.int32)
    for k in (1, 2, 3):
        back = np.zeros(len(classes), np.int32)
        back[k:] = classes[:-k]
        for j in range(k):
            at = starts + j
            back[at[at < len(back)]] = END
        out |= back << (5 * k)
    return out


def feature_rows(history: np.ndarray) -> np.ndarray:
    """Weight rows of histories: (n, 7)."""
    c1, c2, c3 = history & 31, (history >> 5) & 31, (history >> 10) & 31
    kinds = [c1, c2, c3, c1 | c2 << 5, c1 | c3 << 5, c2 | c3 << 5, history]
    mixed = [(x.astype(np.uint64) ^ np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9) for k, x in enumerate(kinds)]
    return np.stack([((m ^ (m >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) >> np.uint64(64 - FEATURE_BITS)).astype(np.int64) for m in mixed], axis=1)


def class_log_probabilities(weights: np.ndarray, bias: np.ndarray, history: np.ndarray) -> np.ndarray:
    """Natural logarithms, (n, CLASSES)."""
    logits = weights[feature_rows(history)].sum(axis=1) + bias
    logits -= logits.max(axis=1, keepdims=True)
    return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))


@dataclass
class ClassModel:
    weights: np.ndarray
    bias: np.ndarray
    likelihood: list[float]

    def table(self) -> np.ndarray:
        """log10 P(class | history) by the number of histories()."""
        history = np.arange(CLASSES**3)
        return (class_log_probabilities(self.weights, self.bias, history) / np.log(10)).astype(np.float64).ravel()


def _cells(chunks: DataFrame) -> DataFrame:
    """Chunks to (cell, n): counts of the training texts' histories with their class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES**4, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                chunk = _Chunk(row["lengths"], row["held"], row["tokens"], row["places"], row["codes"])
                total += np.bincount(chunk.histories()[chunk.training], minlength=len(total))
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total[cell])], names=["cell", "n"])
        release()

    counted = chunks.where("learned > 0").select("lengths", "held", "tokens", "places", "codes").mapInArrow(run, "cell long, n long")
    return counted.groupBy("cell").agg(F.sum("n").alias("n"))


def train(cells: DataFrame, steps: int = STEPS, shards: int = SHARDS) -> ClassModel:
    """Gradient steps, each the sum of the shards' gradients, scaled per weight by what the model expects of it."""
    shard = F.pmod(F.xxhash64(F.shiftright("cell", 5)), F.lit(shards)).cast("int")
    dealt = materialize(cells.groupBy(shard.alias("shard")).agg(F.collect_list(F.struct("cell", "n")).alias("x")), "histories")
    rows = 1 << FEATURE_BITS
    total = np.zeros(CLASSES)
    for r in cells.groupBy(F.col("cell").bitwiseAND(CLASSES - 1).alias("c")).agg(F.sum("n").alias("n")).collect():
        total[r.c] = r.n
    bias = np.log((total + 0.1) / (total.sum() + 0.1 * CLASSES))
    dealt = dealt.select("x").repartition(shards)

    def summed(step_weights: np.ndarray | None) -> tuple[np.ndarray, float]:
        """Over all shards: what the corpus has of each weight's feature and class or, given weights, what they expect of it."""

        def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out, likelihood, met = np.zeros((rows, CLASSES)), 0.0, False
            for batch in batches:
                for x in batch.column(0):
                    met = True
                    cell, n = (x.values.field(i).to_numpy() for i in (0, 1))
                    history, place = np.unique(cell >> 5, return_inverse=True)
                    value = np.zeros((len(history), CLASSES))
                    value[place, cell & (CLASSES - 1)] = n
                    if step_weights is not None:
                        log_p = class_log_probabilities(step_weights, bias, history)
                        likelihood += float((value * log_p).sum())
                        value = np.exp(log_p) * value.sum(axis=1, keepdims=True)
                    for column in feature_rows(history).T:
                        np.add.at(out, column, value)
            if met:
                yield pa.RecordBatch.from_arrays([pa.array([out.astype(np.float32).tobytes()]), pa.array([likelihood])], names=["sums", "likelihood"])

        total, likelihood = np.zeros((rows, CLASSES)), 0.0
        for r in dealt.mapInArrow(one, "sums binary, likelihood double").collect():
            total += np.frombuffer(r.sums, np.float32).reshape(rows, CLASSES)
            likelihood += r.likelihood
        return total, likelihood

    observed, _ = summed(None)
    weights, seen = np.zeros((rows, CLASSES)), []
    for _ in range(steps):
        # weights travel with the step's closure and sums come back: both have the size that the parameters fix
        expected, likelihood = summed(weights)
        seen.append(likelihood)
        weights = weights + np.clip((observed - expected) / (expected + 1.0), -2.0, 2.0) / 4
    return ClassModel(weights, bias, seen)


def _mixed32(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return x ^ (x >> np.uint32(13))


#: For each node of each class's tree, by class << PATH | 1 << depth | the bits so far, what is mixed into feature hashes.
_NODES = _mixed32(np.arange(1, (CLASSES << PATH) + 1, dtype=np.uint32) * np.uint32(0x9E3779B1))


def path_of(codes: np.ndarray) -> np.ndarray:
    """class << PATH | path of codes."""
    return ((codes & np.uint64(31)) << np.uint64(PATH) | (codes >> np.uint64(5)) & np.uint64((1 << PATH) - 1)).astype(np.int32)


class PathModel:
    """Softmaxes of two along the trees inside the classes."""

    def __init__(self, mass: np.ndarray, bits: int) -> None:
        self.bits, self.weights = bits, np.zeros(1 << bits, np.float32)
        # without weights a node goes by the counts below it
        below = np.zeros((CLASSES, 2 << PATH))
        below[:, 1 << PATH :] = mass.reshape(CLASSES, -1)
        for node in range((1 << PATH) - 1, 0, -1):
            below[:, node] = below[:, 2 * node] + below[:, 2 * node + 1]
        self.bias = np.zeros((CLASSES, 1 << PATH), np.float32)
        self.bias[:, 1:] = np.log((below[:, 3::2] + 0.5) / (below[:, 2::2] + 0.5))
        self.bias = self.bias.ravel()

    def cells(self, paths: np.ndarray, features: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of n tokens: nodes and the bits taken there, (PATH, n), and the cells of the weights there, (features, PATH, n)."""
        depth = np.arange(PATH, dtype=np.int32)[:, None]
        bits = paths & ((1 << PATH) - 1)
        nodes = (paths >> PATH << PATH) | 1 << depth | bits >> (PATH - depth)
        taken = (bits >> (PATH - 1 - depth) & 1).astype(np.float32)
        mixed = _NODES[nodes]
        shift = np.uint32(32 - self.bits)
        return nodes, taken, np.stack([((f ^ mixed) * np.uint32(0x85EBCA6B) >> shift).astype(np.intp) for f in features])

    def logits(self, nodes: np.ndarray, cells: np.ndarray) -> np.ndarray:
        out = self.bias[nodes]
        for c in cells:
            out += self.weights[c]
        return out


def _blocks(chunk: _Chunk, wanted: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """The tokens where `wanted` holds, some at a time: their numbers, paths and feature hashes."""
    paths = path_of(chunk.codes)
    short = (chunk.codes >> np.uint64(32)).astype(np.uint32) ^ chunk.codes.astype(np.uint32)
    last, other = _mixed32(short), _mixed32(short * np.uint32(0xC2B2AE35) + np.uint32(7))
    back = [chunk.before(1), chunk.before(2)]
    at = np.flatnonzero(wanted)
    for k in range(0, len(at), _BLOCK):
        i = at[k : k + _BLOCK]
        a, b = last[back[0][i]], other[back[1][i]]
        yield i, paths[chunk.place[i]], [a, b, _mixed32(a * np.uint32(3) + b)]


def _scatter(total: np.ndarray, cells: np.ndarray, values: np.ndarray) -> None:
    if 4 * cells.size >= len(total):
        total += np.bincount(cells.ravel(), np.broadcast_to(values, cells.shape).ravel(), len(total))
    else:
        np.add.at(total, cells.ravel(), np.broadcast_to(values, cells.shape).ravel().astype(total.dtype))


def train_paths(chunks: DataFrame, model: PathModel, tokens: int, steps: int = PATH_STEPS) -> list[float]:
    """Gradient steps over all training tokens, each weight's scaled by its curvature at the start; the likelihoods met."""
    size = 1 << model.bits
    tasks = max(1, tokens // (16 * size))
    dealt = chunks.where("learned > 0").select("lengths", "held", "tokens", "places", "codes").coalesce(tasks)

    def gradient(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            slope, bend, likelihood = np.zeros(size), np.zeros(size if first else 0), 0.0
            for batch in batches:
                for row in batch.to_pylist():
                    chunk = _Chunk(row["lengths"], row["held"], row["tokens"], row["places"], row["codes"])
                    for _, paths, features in _blocks(chunk, chunk.training & (chunk.place > 0)):
                        nodes, taken, cells = model.cells(paths, features)
                        z = model.logits(nodes, cells)
                        p = 1 / (1 + np.exp(-z))
                        likelihood -= float(np.logaddexp(0, np.where(taken > 0, -z, z)).sum(dtype=np.float64))
                        _scatter(slope, cells, taken - p)
                        if first:
                            _scatter(bend, cells, p * (1 - p))
            for at in range(0, size, _PIECE):
                part = slice(at, at + _PIECE)
                row = [at, slope[part].astype("<f4").tobytes(), bend[part].astype("<f4").tobytes() if first else None, likelihood if not at else 0.0]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names=names)
            release()

        return run

    names, types = ["at", "slope", "bend", "likelihood"], [pa.int64(), pa.binary(), pa.binary(), pa.float64()]
    ddl = "at long, slope binary, bend binary, likelihood double"

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for at, slope, bend, likelihood in zip(*[c.to_pylist() for c in batch.columns]):
                mine = sums.setdefault(at, [0.0, None, 0.0])
                mine[0] = mine[0] + np.frombuffer(slope, "<f4")
                if bend is not None:
                    mine[1] = np.frombuffer(bend, "<f4") + (0.0 if mine[1] is None else mine[1])
                mine[2] += likelihood
        for at, (slope, bend, likelihood) in sums.items():
            row = [at, slope.astype("<f4").tobytes(), None if bend is None else bend.astype("<f4").tobytes(), likelihood]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names=names)

    seen, curvature = [], np.zeros(size, np.float32)
    for step in range(steps if tokens else 0):
        # the weights travel with the step's closure: 2**MOST_BITS of four bytes at most
        slope, likelihood = np.zeros(size, np.float32), 0.0
        for r in dealt.mapInArrow(gradient(step == 0), ddl).repartition("at").mapInArrow(summed, ddl).collect():
            part = slice(r.at, r.at + _PIECE)
            slope[part] = np.frombuffer(r.slope, "<f4")
            if r.bend is not None:
                curvature[part] = np.frombuffer(r.bend, "<f4")
            likelihood += r.likelihood
        seen.append(likelihood)
        model.weights = model.weights + np.clip(PATH_RATE * slope / (curvature + PATH_PENALTY), -2, 2).astype(np.float32)
    return seen


def _requests(chunks: DataFrame) -> DataFrame:
    """Chunks with their number to (chunk, place, code, n): their different words, and how often each is in training there."""
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, codes, counts in zip(*[c.to_pylist() for c in batch.columns]):
                code, n = np.frombuffer(codes, np.int64), np.frombuffer(counts, "<u4")
                for at in range(0, len(code), 1 << 16):
                    part = slice(at, at + (1 << 16))
                    columns = [np.full(len(code[part]), number), np.arange(at, at + len(code[part])), code[part], n[part]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["chunk", "place", "code", "n"])
        release()

    return chunks.select("chunk", "codes", "counts").mapInArrow(run, "chunk long, place int, code long, n long")


def lm_scores(docs: DataFrame, modulus: int = 7, held_out: int = 2, steps: int = STEPS, path_steps: int = PATH_STEPS) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities).

    Texts are learned from unless crc32(doc_id) % modulus is held_out; null and empty texts are one end token; a null doc_id
    stays null and counts as empty text in the remainder; repeated rows count and are scored each; extra columns are not read;
    an empty table gives no rows. Without any training text, words of each class are one unseen event.
    """
    held = F.coalesce(crc32_remainder("doc_id", modulus) == held_out, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text"))
    spark = docs.sparkSession
    with arrow_batches(spark, BATCH_ROWS):
        chunks = row_keyed(materialize(_chunks(rows), "chunks"), "chunk")
    with arrow_batches(spark, 1):
        model = train(materialize(_cells(chunks), "cells"), steps)
        asked = _requests(chunks)
        counts = materialize(asked.groupBy("code").agg(F.sum("n").alias("c")).where("c > 0"), "counts")
        leaf = F.col("code").bitwiseAND(31) * (1 << PATH) + F.shiftright("code", 5).bitwiseAND((1 << PATH) - 1)
        n_of, v_of = np.zeros(CLASSES << PATH), np.zeros(CLASSES << PATH)
        for r in counts.groupBy(leaf.alias("leaf")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():
            n_of[r.leaf], v_of[r.leaf] = r.n, r.v
        tokens = int(n_of.sum())
        paths = PathModel(n_of - DISCOUNT * v_of, min(MOST_BITS, max(LEAST_BITS, tokens.bit_length() - TOKENS_BITS)))
        train_paths(chunks, paths, tokens, path_steps)
        answers = materialize(asked.select("chunk", "place", "code").join(counts, "code").select("chunk", "place", "c"), "answers")
    score = _scorer(model.table(), paths, n_of, v_of)
    ddl = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    held_chunks = chunks.select("chunk", "doc_ids", "held", "lengths", "tokens", "places", "codes")
    scored = held_chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score, ddl)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


def _scorer(table: np.ndarray, paths: PathModel, n_of: np.ndarray, v_of: np.ndarray):
    base = np.log10(n_of.sum() + v_of.sum() + 1)
    n_class, v_class = n_of.reshape(CLASSES, -1).sum(axis=1), v_of.reshape(CLASSES, -1).sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        unseen = np.where(n_class > 0, DISCOUNT * v_class / n_class, 1.0)
        unseen_log, seen_log = np.log10(unseen), np.log10(1 - unseen)
        mass_log = np.log10(n_of - DISCOUNT * v_of)

    def score(chunk_rows: pa.Table, answers: pa.Table) -> pa.Table:
        row = chunk_rows.slice(0, 1).to_pylist()[0]
        chunk = _Chunk(row["lengths"], row["held"], row["tokens"], row["places"], row["codes"])
        count = np.zeros(len(chunk.codes))
        count[answers.column("place").to_numpy()] = answers.column("c").to_numpy()
        known, of, leaf = count > 0, (chunk.codes & np.uint64(31)).astype(np.int64), path_of(chunk.codes)
        within = unseen_log[of]
        within[known] = (seen_log[of] + np.log10(np.maximum(count - DISCOUNT, 1e-9)) - mass_log[leaf])[known]
        within[of == END] = 0.0
        token = table[chunk.histories()] + within[chunk.place]
        known_token = known[chunk.place]
        for at, own, features in _blocks(chunk, known_token & (chunk.place > 0)):
            nodes, taken, cells = paths.cells(own, features)
            z = paths.logits(nodes, cells)
            token[at] -= np.logaddexp(0, np.where(taken > 0, -z, z)).sum(axis=0, dtype=np.float64) / np.log(10)
        total = lambda x: np.add.reduceat(x, chunk.starts)
        columns = [row["doc_ids"], row["held"], row["lengths"], total(known_token.astype(np.int64)), total((np.log10(count + 1) - base)[chunk.place]), total(token)]
        release()
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()))], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return score


def op2_maxent(spark, sf_dir: str) -> DataFrame:
    return lm_scores(documents(spark, sf_dir).select("doc_id", "text"))
