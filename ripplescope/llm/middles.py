"""Fill-in-the-middle: documents are cut in three and put together again so that the middle comes last.

Cuts are counted in units: a run of ASCII letters is one, every other code point is one. A text is stored as its maximal runs of
one character class (letters, or other code points of one, two, three or four bytes) with the units before each run. All code
points of a run have the same width, so a cut is a binary search for its run and one product: nothing is tokenised.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, release, text_bytes

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 documents so many stay plain, and of 100 others so many have their suffix first.
PLAIN_PERCENT, SPM_PERCENT = 10, 20
SALT = "1:"
_SLICE_BYTES = 4 << 20

_LETTERS = 0
#: The class of a code point by its first byte; a class other than letters is the width in bytes.
_CLASS = np.ones(256, np.uint8)
_CLASS[0xC0:0xE0], _CLASS[0xE0:0xF0], _CLASS[0xF0:] = 2, 3, 4
_CLASS[[c for c in range(128) if chr(c).isalpha()]] = _LETTERS
_WIDTH = np.maximum(np.arange(5), 1)


@dataclass
class Runs:
    """The class runs of texts that stand one after another in one buffer."""

    first: np.ndarray  # of each text: its first run; one more at the end
    kind: np.ndarray
    at: np.ndarray  # bytes before each run, and at the end
    chars: np.ndarray  # code points before each run, and at the end
    units: np.ndarray  # units before each run, and at the end

    @classmethod
    def of(cls, data: np.ndarray, bounds: np.ndarray) -> Runs:
        """data: bytes of all texts; bounds: where each text starts, and the end."""
        lead = (data & 0xC0) != 0x80
        starts = bounds[:-1][bounds[:-1] < bounds[1:]]
        lead[starts] = True  # also where a text is not valid UTF-8
        at = np.flatnonzero(lead)
        kind = _CLASS[data[at]]
        new = np.ones(len(at), bool)
        new[1:] = kind[1:] != kind[:-1]
        new[np.searchsorted(at, starts)] = True
        chars = np.flatnonzero(new)
        kind = kind[chars]
        length = np.diff(chars, append=len(at))
        units = np.concatenate([[0], np.cumsum(np.where(kind == _LETTERS, 1, length))])
        at, chars = np.append(at[chars], len(data)), np.append(chars, len(at))
        return cls(np.searchsorted(at[:-1], bounds), kind, at, chars, units)

    def counts(self) -> np.ndarray:
        return np.diff(self.units[self.first])

    def cut(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and code points before the end of so many units of each text, counted from the buffer's start."""
        wanted = self.units[self.first[:-1]] + units
        # a cut at a text's end is the start of the next text's first run, or the buffer's end
        run = np.searchsorted(self.units, wanted, side="right") - 1
        into = wanted - self.units[run]
        kind = np.append(self.kind, 1)[run]
        return self.at[run] + into * _WIDTH[kind], self.chars[run] + into


def _fill(texts: pa.Array, draws: list[np.ndarray], plain_percent: int, spm_percent: int) -> list[pa.Array]:
    data = texts.buffers()[2]
    bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    bounds -= bounds[0]
    runs = Runs.of(body, bounds)
    n = runs.counts()
    one, two = draws[0] % (n + 1), draws[1] % (n + 1)
    low, low_chars = runs.cut(np.minimum(one, two))
    high, high_chars = runs.cut(np.maximum(one, two))
    first_chars = runs.chars[runs.first[:-1]]
    raw = body.tobytes()
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    plain, spm = draws[2] % 100 >= 100 - plain_percent, draws[3] % 100 < spm_percent
    forms, out = [], []
    for a, b, c, d, is_plain, is_spm in zip(bounds.tolist(), low.tolist(), high.tolist(), bounds[1:].tolist(), plain.tolist(), spm.tolist()):
        text = raw[a:d]
        if is_plain or not text or p in text or s in text or m in text:
            forms.append("plain")
            out.append(text)
        else:
            forms.append("spm" if is_spm else "psm")
            head = (s, raw[c:d], p, raw[a:b]) if is_spm else (p, raw[a:b], s, raw[c:d])
            out.append(b"".join((*head, m, raw[b:c])))
    stays = np.array([f == "plain" for f in forms], bool)
    return [
        pa.array(n, pa.int64()), pa.array(forms, pa.string()), pa.array(low_chars - first_chars, pa.int64(), mask=stays), pa.array(high_chars - low_chars, pa.int64(), mask=stays),
        pa.array(out, pa.binary()),
    ]


def fill_in_middle(docs: DataFrame, salt: str = SALT, plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars, output: the text as it is trained on.

    Cuts and form are drawn from the sha256 of salt and doc_id, so they do not depend on the order or number of rows; rows that
    share a doc_id and a text get the same output. Null and empty texts, and texts that hold one of the three marks, stay plain;
    prefix_chars and middle_chars are null there. A null doc_id draws as empty text. Extra columns are not read, an empty table
    gives no rows, and nothing is shuffled. `restored` gives the text back.
    """
    drawn = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    draws = [F.conv(F.substring(drawn, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i}") for i in range(4)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(np.diff(np.frombuffer(batch.column(1).buffers()[1], np.int32)[batch.column(1).offset :][: batch.num_rows + 1].astype(np.int64)))
            at = 0
            while at < batch.num_rows:
                done = ends[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(ends, done + _SLICE_BYTES, side="right")))
                part = batch.slice(at, to - at)
                columns = _fill(part.column(1), [part.column(2 + i).to_numpy() for i in range(4)], plain_percent, spm_percent)
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
                at = to
        release()

    ddl = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary"
    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes(), *draws).mapInArrow(run, ddl)
    return made.withColumn("output", F.col("output").cast("string"))


def restored(form: str = "form", output: str = "output") -> Column:
    """The text of which fill_in_middle made an output. A text with a mark stays plain, so each mark occurs once in the others."""
    first = lambda of, mark: F.substring_index(of, mark, 1)
    after = lambda of, mark: F.substring_index(of, mark, -1)
    head, middle = first(F.col(output), MIDDLE), after(F.col(output), MIDDLE)
    psm = F.concat(after(first(head, SUFFIX), PREFIX), middle, after(head, SUFFIX))
    spm = F.concat(after(head, PREFIX), middle, after(first(head, PREFIX), SUFFIX))
    return F.when(F.col(form) == "plain", F.col(output)).when(F.col(form) == "psm", psm).otherwise(spm)


def op12_middle(spark, sf_dir: str) -> DataFrame:
    hashed = lambda text: F.sha2(text.cast("binary"), 256)
    made = fill_in_middle(documents(spark, sf_dir))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", hashed(F.col("output")).alias("output_sha256"), hashed(restored()).alias("restored_sha256"))


ORACLE = """WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
k AS (SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units FROM t),
d AS (SELECT *, CAST(len(units) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM k),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:n], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
    sha256(text) AS restored_sha256 FROM p"""
