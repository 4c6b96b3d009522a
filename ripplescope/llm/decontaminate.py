"""Benchmark decontamination by template canonicalisation.

A text becomes a template: numbers, units after numbers and names inside sentences turn into typed placeholders, other words
into their lower case without punctuation. Windows of WINDOW template words are hashed and joined with those of the
benchmark, so a question with other numbers or names still meets its origin. Matches of one alignment are then checked for
consistent slots: what the benchmark holds in a slot and what the document holds there must map one to one over all matched
words; windows with a changed slot that contradicts another are left out, the others of the alignment stay. An item counts as found if SHARE of its windows, or a run of RUN words, matches. Windows of few other words than
placeholders would match nearly anything, so they are looked up by their words instead and match if all are equal. What stands
before an item in a document may make its first word a name or unit, so an item's first window also matches as a text's start.

The benchmark goes to the workers in blocks of at most BLOCK_WORDS words, each block against all documents; each different
word of the documents is judged once per worker and kept in a bounded cache.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import arrow_batches
from .common import documents, materialize, release, text_bytes
from .substring import _BASES, _mixed, _power, _Prefix

WINDOW = 8
SHARE = 0.5
RUN = 13
#: A window of the benchmark with fewer words that are no placeholders matches by its words, not by its template.
LITERALS = 4
BLOCK_WORDS = 2_000_000
BATCH_ROWS = 1_024
_VOCABULARY = 150_000

UNITS = frozenset(
    """mm cm m km inch inches foot feet ft yard yards mile miles mg g kg gram grams kilogram kilograms ton tons ml l liter liters litre
    litres gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years
    dollar dollars cent cents euro euros pound pounds percent degrees mph kmh kph hz khz mhz kb mb gb tb v w kw a""".split()
)
NUMBER_WORDS = frozenset("one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million".split())
#: Names that count at the start of a sentence too.
NAMES = frozenset(
    """James John Robert Michael William David Richard Joseph Thomas Charles Mary Patricia Jennifer Linda Elizabeth Barbara Susan
    Jessica Sarah Karen Tom Tim Jim Bob Bill Mike Dave Steve Sam Max Ben Dan Joe Jack Jane Anna Anne Emma Olivia Sophia Mia Lucy
    Lisa Amy Kate Alice Maria Carlos Juan Luis Ana Pierre Jean Marie Claire Hans Peter Klaus Greta Ali Omar Wei Li Natalia Weng""".split()
)
_NUM, _UNIT, _CAP, _END, _NAMED = 1, 2, 4, 8, 16
_FLAGS = 31
_TYPE = {_NUM: 1 << 40, _UNIT: 2 << 40, _CAP: 3 << 40}


_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_OUTER = re.compile(r"^[\W_]+|[\W_]+$")
_NUMBER = re.compile(r"\d+(?:[.,:/]\d+)*(?:st|nd|rd|th)?")
_STOP = re.compile("[.!?]")
_LISTED = {**dict.fromkeys(NUMBER_WORDS, _NUM), **{x: _UNIT for x in UNITS}}


def _core(word: bytes) -> str:
    """The word without what is no letter or digit at its ends."""
    core = word.decode("utf-8", "replace").strip(_MARKS)
    return core if core and core[0].isalnum() and core[-1].isalnum() else _OUTER.sub("", core)


def _judge(word: bytes) -> int:
    """Hash of the lower-case word without punctuation at its ends, with flags in the low bits; 0 for punctuation alone."""
    text = word.decode("utf-8", "replace")
    letters = text.isalpha()
    core = text if letters else _core(word)
    if not core:
        return 0
    lower = core.lower()
    flags = _LISTED.get(lower, 0)
    if lower != core:
        flags |= _CAP * (core[0].isupper() and not core[1:].isupper()) | _NAMED * (core in NAMES)
    if not letters:
        if core[0].isdecimal() and _NUMBER.fullmatch(lower):
            flags |= _NUM
        if _STOP.search(text, text.rfind(core) + len(core)):
            flags |= _END
    return xxhash.xxh64_intdigest(lower) & ~_FLAGS | flags


class _Codes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = code = _judge(word)
        return code


_codes = _Codes()


def template(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Template codes, codes of the words, whether a word is a placeholder only by what is before it, each word's slot type (0: none), the words.

    Words of punctuation alone are left out.
    """
    words = text.split()
    if len(_codes) > _VOCABULARY:
        _codes.clear()
    raw = np.fromiter(map(_codes.__getitem__, words), np.uint64, len(words))
    if len(raw) and not raw.all():
        keep = raw != 0
        raw, words = raw[keep], [words[i] for i in np.flatnonzero(keep).tolist()]
    flags = (raw & np.uint64(_FLAGS)).astype(np.uint8)
    before = np.concatenate(([_END], flags[:-1])) if len(flags) else flags
    number = (flags & _NUM) > 0
    unit = ((flags & _UNIT) > 0) & ((before & _NUM) > 0) & ~number
    name = ~number & ~unit & ((((flags & _CAP) > 0) & ((before & _END) == 0)) | ((flags & _NAMED) > 0))
    slot = np.select([number, unit, name], [_NUM, _UNIT, _CAP], 0).astype(np.uint8)
    plain = raw & ~np.uint64(_FLAGS)
    code = plain.copy()
    for kind, value in _TYPE.items():
        code[slot == kind] = value
    return code, plain, unit | name & ((flags & _NAMED) == 0), slot, words


def _windows(code: np.ndarray, width: int) -> np.ndarray:
    at = np.arange(len(code) - width + 1)
    return _Prefix(code, _BASES[0]).of(at, at + width)


def _windows_from(code: np.ndarray, plain: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the windows at some places, each with its first word as it is."""
    prefix = _Prefix(code, _BASES[0])
    power, _ = _power(_BASES[0], len(code))
    return _mixed((prefix.sums[at + width] - prefix.sums[at] + (plain[at] - code[at]) * power[at]) * prefix.inverse[at])


class Templates:
    """The windows of a block of benchmark items."""

    def __init__(self, items: list[tuple[object, str]], window: int, share: float, run: int) -> None:
        self.window, self.share, self.run = window, share, run
        self.items = []
        # by (width, whether by words): (hash, item, place in the item)
        hashes: dict[tuple[int, bool], list[tuple[int, int, int]]] = defaultdict(list)
        for item_id, text in items:
            code, plain, _, slot, words = template((text or "").encode())
            n = len(code)
            if not n:
                continue
            width = min(window, n)
            literal = np.convolve(slot == 0, np.ones(width, int), "valid")
            typed = literal >= min(LITERALS, width)
            index = len(self.items)
            self.items.append((item_id, slot, [_core(w).lower() for w in words], typed, n, width))
            hashed = np.where(typed, _windows(code, width), _windows(plain, width))
            for j, (h, t) in enumerate(zip(hashed.tolist(), typed.tolist())):
                hashes[width, not t].append((h, index, j))
        self.by_hash = {}
        for key, found in hashes.items():
            self.by_hash[key] = table = defaultdict(list)
            for h, index, j in found:
                table[h].append((index, j))
        self.filters = {key: self._filter([h for h, _, _ in found]) for key, found in hashes.items()}
        self.firsts = {width: self._filter(firsts) for (width, by_words), found in hashes.items() if not by_words and (firsts := [h for h, _, j in found if j == 0])}

    def _filter(self, hashes: list[int]) -> tuple[np.ndarray, int]:
        """A bit table that drops nearly all windows of documents at the cost of one lookup."""
        bits = max(16, int(16 * max(1, len(hashes))).bit_length())
        table = np.zeros(1 << bits, bool)
        table[np.array(hashes, np.uint64) >> np.uint64(64 - bits)] = True
        return table, 64 - bits

    def search(self, text: bytes) -> list[tuple]:
        """(item_id, matched share of the item's windows, longest run of words, exact, first word, last word + 1)."""
        code, plain, open_, slot, words = template(text)
        runs: dict[tuple[int, int], set[int]] = defaultdict(set)
        for (width, by_words), (table, shift) in self.filters.items():
            if len(code) < width:
                continue
            hashed = _windows(plain if by_words else code, width)
            for i in np.flatnonzero(table[hashed >> np.uint64(shift)]).tolist():
                for index, j in self.by_hash[width, by_words].get(int(hashed[i]), ()):
                    runs[index, i - j].add(j)
        opened = np.flatnonzero(open_)
        for width, (table, shift) in self.firsts.items() if len(opened) else ():
            at = opened[opened <= len(code) - width]
            hashed = _windows_from(code, plain, at, width)
            for k in np.flatnonzero(table[hashed >> np.uint64(shift)]).tolist():
                for index, j in self.by_hash[width, False].get(int(hashed[k]), ()):
                    if j == 0:
                        runs[index, int(at[k])].add(0)
        found: dict[int, list] = defaultdict(list)
        for (index, shift_), places in runs.items():
            _, theirs, values, _, _, width = self.items[index]
            covered = sorted({p for j in places for p in range(j, j + width)})
            pairs = {p: (int(theirs[p]), values[p], _core(words[p + shift_]).lower()) for p in covered if theirs[p]}
            there: dict[tuple, set[str]] = defaultdict(set)
            here: dict[tuple, set[str]] = defaultdict(set)
            for kind, a, b in pairs.values():
                there[kind, a].add(b)
                here[kind, b].add(a)
            against = {p for p, (kind, a, b) in pairs.items() if a != b and (len(there[kind, a]) > 1 or len(here[kind, b]) > 1)}
            if against:
                places = [j for j in places if against.isdisjoint(range(j, j + width))]
                covered = sorted({p for j in places for p in range(j, j + width)})
            if places:
                found[index].append((shift_, places, covered, not against and all(a == b for _, a, b in pairs.values())))
        out = []
        for index, alignments in found.items():
            item_id, _, _, typed, n, width = self.items[index]
            matched = {j for _, places, _, _ in alignments for j in places}
            # other numbers and names leave only the windows that match by template
            share = max(len(matched) / len(typed), sum(typed[j] for j in matched) / max(1, typed.sum()))
            longest = 0
            for _, _, covered, _ in alignments:
                cuts = np.flatnonzero(np.diff(covered) > 1)
                longest = max(longest, int(np.diff(np.concatenate(([-1], cuts, [len(covered) - 1]))).max()))
            if share >= self.share or longest >= self.run:
                first = min(shift_ + covered[0] for shift_, _, covered, _ in alignments)
                last = max(shift_ + covered[-1] + 1 for shift_, _, covered, _ in alignments)
                out.append((item_id, share, longest, all(x[3] for x in alignments), first, last))
        return out


def blocks(benchmark: DataFrame, window: int, share: float, run: int) -> Iterator[Templates]:
    """The benchmark in blocks of at most BLOCK_WORDS words or so."""
    rows = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.size(F.split("text", r"[\x20\x09-\x0D]+")))).first()[0] or 0
    count = max(1, -(-size // BLOCK_WORDS))
    for k in range(count):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k).orderBy("item_id", "text").collect()
        yield Templates([(r[0], r[1]) for r in part], window, share, run)


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE, run: int = RUN) -> DataFrame:
    """One row per document and benchmark item found in it: doc_id, item_id, share, run, exact, first_word, end_word.

    exact is false if a slot holds another value than the benchmark's. Null and empty texts on either side match nothing; an
    item shorter than the window must match whole; null ids stay null; repeated rows are reported each; extra columns are not
    read; an empty table on either side gives no rows.
    """
    names = ["doc_id", "item_id", "share", "run", "exact", "first_word", "end_word"]
    types = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes())

    def searching(templates: Templates):
        def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [(i, *x) for i, t in zip(batch.column(0).to_pylist(), batch.column(1)) for x in templates.search(t.as_py())]
                columns = zip(*found) if found else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)
            _codes.clear()
            release()

        return run_

    ddl = "doc_id long, item_id long, share double, run long, exact boolean, first_word long, end_word long"
    found = [rows.mapInArrow(searching(t), ddl) for t in blocks(benchmark, window, share, run)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE, run: int = RUN) -> DataFrame:
    """docs, all columns, without the documents that hold a benchmark item."""

    def clean(templates: Templates):
        @F.pandas_udf("boolean")
        def judge(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                yield pd.Series([not templates.search((t or "").encode()) for t in texts], dtype=bool)
            _codes.clear()
            release()

        return judge

    for templates in blocks(benchmark, window, share, run):
        with arrow_batches(docs.sparkSession, BATCH_ROWS):
            docs = materialize(docs.where(clean(templates)(F.col("text").cast("string"))), "clean")
    return docs


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir).select("doc_id", "text"), documents(spark, sf_dir, "benchmark"))
