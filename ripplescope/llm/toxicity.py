"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Each text becomes some rates: lexicon words in plain and in disguised spelling, their nearness to second-person words,
capitals, punctuation, disguised words in general, and words of a learned lexicon. That one holds beginnings of words that
toxic training rows use far more often than others, with their log odds: insults of languages and spellings that the fixed
list lacks. Its counts are summed over the training rows of all executors; a training row's own features come from a lexicon
that its fold did not take part in. Each different word is judged once per worker and kept in a bounded cache; a text is then
a few counts over small codes. Feature rows of labelled texts, TRAINING_ROWS at most, go to the driver, which grows histogram
trees for the logistic loss; scores that four folds give to rows they were not trained on fix the calibration. Texts never
leave the executors.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import arrow_batches
from .common import crc32_remainder, documents, materialize, release, text_bytes

THRESHOLD = 0.7
#: Labelled rows used for training, those with the smallest hashes of doc_id.
TRAINING_ROWS = 20_000
BATCH_ROWS = 1_024
#: The learned lexicon: lengths of the beginnings, folds, entries at most, least log odds, least uses in toxic rows and their least share.
BEGINNINGS = range(3, 9)
FOLDS = 3
LEXICON_ROWS = 20_000
LEAST_ODDS = 3.0
LEAST_ROWS, LEAST_SHARE = 6, 0.003

#: Insults of four languages, in their base spelling.
LEXICON = frozenset(
    """idiot idiots idiotic moron morons moronic stupid stupidity dumb dumbass fool imbecile cretin clown loser losers scum scumbag
    trash garbage worthless pathetic disgusting filthy filth vermin pig swine rat bastard bitch whore slut asshole jerk freak
    creep degenerate retard retarded shit bullshit crap fuck fucking fucker hate kill
    dumm dummkopf blöd blödmann trottel depp arschloch scheisse scheiße abschaum versager wichser hurensohn ekelhaft dreckig
    imbécile crétin connard connasse salaud salope merde putain ordure dégoûtant minable débile abruti pute
    idiota estúpido estúpida imbécil tonto cabrón pendejo mierda puta basura asqueroso inútil gilipollas patético""".split()
)
SECOND_PERSON = frozenset("you your yours yourself youre u ur du dich dir dein deine deinen ihr euch tu te toi ton ta tes vous votre vos usted ustedes tú tu ti tus vosotros".split())
NEAR = 5
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i", "€": "e"})
_PLAIN, _DISGUISED, _PERSON, _CAPS, _MIXED, _SINGLE = 1, 2, 4, 8, 16, 32
#: Above those bits a code has the learned strength of its word, 0 to 15.
_STRENGTH = 6
_VOCABULARY = 150_000
FEATURES = ("log_words", "plain", "disguised", "any_lexicon", "near_person", "person", "caps_words", "mixed_words", "capitals", "exclaim", "question", "punctuation", "run_of_marks", "digits", "spelled_out", "learned", "any_learned", "strongest")


_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_OUTER = re.compile(r"^[\W_]+|[\W_]+$")
_REPEATED = re.compile(r"(.)\1{2,}")


def _core(text: str) -> str:
    """The word without what is no letter or digit at its ends."""
    core = text.strip(_MARKS)
    return core if core and core[0].isalnum() and core[-1].isalnum() else _OUTER.sub("", core)


def beginnings(word: bytes) -> list[str]:
    lower = _core(word.decode("utf-8", "replace")).lower()
    return [lower[:k] for k in BEGINNINGS if k <= len(lower)]


def _judge(word: bytes) -> int:
    text = word.decode("utf-8", "replace")
    core = _core(text)
    lower = core.lower()
    code = (lower in LEXICON) * _PLAIN | (lower in SECOND_PERSON) * _PERSON
    code |= (len(core) > 1 and core.isupper()) * _CAPS | (len(core) == 1 and core.isalpha()) * _SINGLE
    if core and not code & _PLAIN and not core.isalpha() and any(map(str.isalpha, text)):
        trimmed = re.sub(r"^[\"'(\[{<]+|[\"')\]}>.,;:?]+$", "", text.lower())
        forms = {re.sub(r"[\W_]", "", x.translate(_LEET)) for x in (lower, trimmed)}
        starred = "*" in trimmed.strip("*") and len(trimmed) > 3
        hit = bool(forms & LEXICON) or starred and any(re.fullmatch(re.escape(trimmed).replace(r"\*", "."), x) for x in LEXICON)
        code |= hit * _DISGUISED | _MIXED * bool(re.search(r"[A-Za-z][0-9@$*!|][A-Za-z]", core))
    elif core and core.isalpha() and not code & _PLAIN and _REPEATED.search(lower):
        code |= (_REPEATED.sub(r"\1", lower) in LEXICON) * _DISGUISED
    return code


class Codes(dict):
    """Codes of words: what is known of their spelling, and their strength by a learned lexicon (beginning to 1 to 15)."""

    def __init__(self, learned: dict[str, int], most: int = _VOCABULARY) -> None:
        self.learned, self.most = learned, most

    def __missing__(self, word: bytes) -> int:
        strength = max((self.learned.get(x, 0) for x in beginnings(word)), default=0) if self.learned else 0
        self[word] = code = _judge(word) | strength << _STRENGTH
        return code


def features(text: bytes, codes: Codes) -> np.ndarray:
    """The rates named in FEATURES; all 0 for a text without words."""
    out = np.zeros(len(FEATURES), np.float32)
    words = text.split()
    if not words:
        return out
    if len(codes) > codes.most:
        codes.clear()
    code = np.fromiter(map(codes.__getitem__, words), np.uint16, len(words))
    strength = code >> _STRENGTH
    learned = int((strength > 0).sum())
    n, raw = len(words), np.frombuffer(text, np.uint8)
    lexical, person = (code & (_PLAIN | _DISGUISED)) > 0, (code & _PERSON) > 0
    near = 0
    if lexical.any() and person.any():
        at = np.flatnonzero(person)
        which = np.flatnonzero(lexical)
        place = np.searchsorted(at, which)
        gap = np.minimum(np.abs(at[np.minimum(place, len(at) - 1)] - which), np.abs(at[np.maximum(place - 1, 0)] - which))
        near = int((gap <= NEAR).sum())
    spelled = 0
    single = (code & _SINGLE) > 0
    if single.sum() >= 3:
        edges = np.flatnonzero(np.diff(np.concatenate(([False], single, [False])).astype(np.int8))).reshape(-1, 2)
        for a, b in edges[edges[:, 1] - edges[:, 0] >= 3].tolist():
            joined = re.sub(r"[\W_]", "", b"".join(words[a:b]).decode("utf-8", "replace").lower())
            spelled += joined in LEXICON
    letters = ((raw >= 65) & (raw <= 90)), ((raw >= 97) & (raw <= 122))
    upper, lower = int(letters[0].sum()), int(letters[1].sum())
    marks = text.count(b"!"), text.count(b"?")
    plain, disguised = int(((code & _PLAIN) > 0).sum()), int(((code & _DISGUISED) > 0).sum())
    out[:] = (
        np.log1p(n), 1000 * plain / n, 1000 * disguised / n, min(8, plain + disguised + spelled), 1000 * near / n, 1000 * int(person.sum()) / n,
        int(((code & _CAPS) > 0).sum()) / n, int(((code & _MIXED) > 0).sum()) / n, upper / max(1, upper + lower), 100 * marks[0] / n, 100 * marks[1] / n,
        100 * (text.count(b".") + text.count(b",") + text.count(b";") + text.count(b":")) / n, 100 * (text.count(b"!!") + text.count(b"??")) / n,
        100 * int(((raw >= 48) & (raw <= 57)).sum()) / max(1, len(raw)), 1000 * spelled / n,
        1000 * learned / n, min(8, learned), int(strength.max()),
    )
    return out


def training_rows(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(h, doc_id, label, fold, text) of the labelled documents that are not held out; h orders them."""
    known = labels.where("toxic is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") > 0).cast("int").alias("label"))
    h = F.xxhash64("doc_id")
    chosen = known.where(crc32_remainder("doc_id", 3) != 1).select("*", h.alias("h")).orderBy("h", "doc_id", "label").limit(most)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes())
    # `most` rows of three numbers at most are broadcast
    joined = rows.join(F.broadcast(chosen), "doc_id")
    return materialize(joined.select("h", "doc_id", "label", F.pmod(h, F.lit(FOLDS)).cast("int").alias("fold"), "text"), "training")


def _counted(training: DataFrame) -> DataFrame:
    """(key, c0, ...): in how many pairs of a text and one of its different words it begins the word, by fold and label.

    The empty key counts the texts.
    """
    word = F.explode(F.array_distinct(F.split(F.lower(F.col("text").cast("string")), r"[\x20\x09-\x0D]+"))).alias("word")
    place = (2 * F.col("fold") + F.col("label")).alias("place")
    by_place = [F.count(F.when(F.col("place") == i, 1)).alias(f"c{i}") for i in range(2 * FOLDS)]
    words = training.select(place, word).groupBy("word").agg(*by_place)
    core = F.regexp_replace("word", r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    starts = F.transform(F.sequence(F.lit(BEGINNINGS.start), F.least(F.length("core"), F.lit(BEGINNINGS.stop - 1))), lambda k: F.substring(F.col("core"), F.lit(1), k))
    long = words.withColumn("core", core).where(F.length("core") >= BEGINNINGS.start)
    keys = long.select(F.explode(starts).alias("key"), *[f"c{i}" for i in range(2 * FOLDS)]).groupBy("key").agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(2 * FOLDS)])
    return keys.unionByName(training.select(F.lit("").alias("key"), place).groupBy("key").agg(*by_place))


def learned_lexicons(training: DataFrame) -> list[dict[str, int]]:
    """FOLDS lexicons, each without what its fold has, and one of all rows: beginnings to strengths, twice their log odds."""
    counted = materialize(_counted(training), "beginnings")
    total = counted.where("key = ''").toArrow()
    if not len(total):
        return [{} for _ in range(FOLDS + 1)]
    rows_of = np.array([total.column(f"c{i}")[0].as_py() for i in range(2 * FOLDS)], float)
    clean, toxic = (sum(F.col(f"c{2 * k + label}") for k in range(FOLDS)) for label in (0, 1))
    odds = F.log((toxic + 0.5) / (rows_of[1::2].sum() + 1)) - F.log((clean + 0.5) / (rows_of[0::2].sum() + 1))
    # a fold left out may raise a beginning's odds a little
    wanted = counted.where("key <> ''").where((toxic >= LEAST_ROWS) & (odds >= LEAST_ODDS - 1)).withColumn("weight", odds * toxic)
    got = wanted.orderBy(F.desc("weight"), "key").limit(LEXICON_ROWS).toArrow()
    keys = got.column("key").to_pylist()
    counts = np.stack([got.column(f"c{i}").to_numpy() for i in range(2 * FOLDS)]).astype(float)

    def lexicon(folds: list[int]) -> dict[str, int]:
        n, t = (sum(counts[2 * k + label] for k in folds) for label in (0, 1))
        n_all, t_all = (sum(rows_of[2 * k + label] for k in folds) for label in (0, 1))
        weight = np.log((t + 0.5) / (t_all + 1)) - np.log((n + 0.5) / (n_all + 1))
        strong = (weight >= LEAST_ODDS) & (t >= max(LEAST_ROWS, LEAST_SHARE * t_all))
        found = {keys[i]: min(15, int(2 * weight[i])) for i in np.flatnonzero(strong).tolist()}
        # a beginning adds nothing to a shorter one that is as strong
        return {x: v for x, v in found.items() if all(found.get(x[:k], 0) < v for k in range(1, len(x)))}

    return [*[lexicon([j for j in range(FOLDS) if j != k]) for k in range(FOLDS)], lexicon(list(range(FOLDS)))]


def training_features(training: DataFrame, lexicons: list[dict[str, int]]) -> DataFrame:
    """(h, doc_id, label, features), each row by the lexicon that its fold did not take part in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = [Codes(x, _VOCABULARY // 4) for x in lexicons]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = np.concatenate([features(t.as_py(), codes[k]) for k, t in zip(part.column(3).to_pylist(), part.column(4))])
                values = pa.FixedSizeListArray.from_arrays(pa.array(rows, pa.float32()), len(FEATURES)).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(3)], values], names=["h", "doc_id", "label", "features"])
        del codes
        release()

    return training.select("h", "doc_id", "label", "fold", "text").mapInArrow(run, "h long, doc_id long, label int, features array<float>")


class Trees:
    """Gradient-boosted trees of fixed depth for the logistic loss, split on feature histograms."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, penalty: float = 1.0, least: int = 6) -> None:
        self.rounds, self.depth, self.rate, self.bins, self.penalty, self.least = rounds, depth, rate, bins, penalty, least
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.prior = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        share = (y.sum() + 1) / (len(y) + 2)
        self.prior = float(np.log(share / (1 - share)))
        self.trees = []
        if not 0 < y.sum() < len(y):
            return self
        edges = [np.unique(np.quantile(f, np.linspace(0, 1, self.bins + 1)[1:-1], method="lower")) for f in x.T]
        # a feature that is mostly 0 still gets bins for its other values
        edges = [np.unique(np.concatenate((e, np.quantile(f[f > e[0]], np.linspace(0, 1, 9)[:-1], method="lower")))) if (f > e[0]).any() else e for e, f in zip(edges, x.T)]
        binned = np.stack([np.searchsorted(e, f, side="left") for e, f in zip(edges, x.T)])  # bin b: e[b-1] < f <= e[b]
        width = max(len(e) for e in edges) + 1
        raw = np.full(len(y), self.prior)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-raw))
            g, h = p - y, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            feature, cut = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, np.inf)
            for level in range(self.depth):
                n = 2**level
                gain, choice, at = np.zeros(n), np.zeros(n, np.int64), np.full(n, -1)
                for k, b in enumerate(binned):
                    key = node * width + b
                    gs = np.bincount(key, g, n * width).reshape(n, width).cumsum(1)
                    hs = np.bincount(key, h, n * width).reshape(n, width).cumsum(1)
                    count = np.bincount(key, minlength=n * width).reshape(n, width).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    score = gs**2 / (hs + self.penalty) + (gt - gs) ** 2 / (ht - hs + self.penalty) - gt**2 / (ht + self.penalty)
                    score[(count < self.least) | (count[:, -1:] - count < self.least)] = 0
                    best = score.argmax(1)
                    better = score[np.arange(n), best] > gain + 1e-9
                    gain[better], choice[better], at[better] = score[np.arange(n), best][better], k, best[better]
                first = n - 1
                for i in range(n):
                    if at[i] >= 0:
                        feature[first + i], cut[first + i] = choice[i], edges[choice[i]][at[i]]
                node = 2 * node + (x[np.arange(len(y)), feature[first + node]] > cut[first + node])
            leaves = 2**self.depth
            value = -self.rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + self.penalty)
            self.trees.append((feature, cut, value))
            raw += value[node]
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.prior), np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = 2**level - 1 + node
                node = 2 * node + (x[rows, feature[at]] > cut[at])
            out += value[node]
        return out


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing least-squares fit (pool adjacent violators); equal scores are pooled first."""
    at, inverse, count = np.unique(score, return_inverse=True, return_counts=True)
    mean = np.bincount(inverse, y) / count
    blocks: list[list[float]] = []
    for s, m, w in zip(at.tolist(), mean.tolist(), count.tolist()):
        blocks.append([m, w, s, s])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m2, w2, _, high = blocks.pop()
            m1, w1, low, _ = blocks.pop()
            blocks.append([(m1 * w1 + m2 * w2) / (w1 + w2), w1 + w2, low, high])
    knots = [(x, b[0]) for b in blocks for x in dict.fromkeys((b[2], b[3]))]
    return np.array([k[0] for k in knots]), np.array([k[1] for k in knots])


class Model:
    def __init__(self, x: np.ndarray, y: np.ndarray, folds: int = 4) -> None:
        self.trees = Trees().fit(x, y)
        held = np.empty(len(y))
        for k in range(folds):
            test = np.arange(len(y)) % folds == k
            held[test] = Trees().fit(x[~test], y[~test]).raw(x[test])
        self.knots = isotonic(held, y) if len(y) else (np.array([self.trees.prior]), np.array([0.5]))

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.trees.raw(x), *self.knots), 0.0, 1.0)


def train(docs: DataFrame, labels: DataFrame, most: int = TRAINING_ROWS) -> tuple[Model, dict[str, int]]:
    """The model and its lexicon, from labelled documents that are not held out. Without such rows every score is 0.5."""
    with arrow_batches(docs.sparkSession, BATCH_ROWS):
        training = training_rows(docs, labels, most)
        lexicons = learned_lexicons(training)
        got = training_features(training, lexicons).orderBy("h", "doc_id", "label", "features").limit(most).select("features", "label").toArrow()
    x = got.column("features").combine_chunks().values.to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES)) if len(got) else np.zeros((0, len(FEATURES)), np.float32)
    return Model(x, got.column("label").to_numpy().astype(float)), lexicons[FOLDS]


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, most: int = TRAINING_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (score >= threshold).

    Null and empty texts have all-zero features and are scored like others; a null doc_id stays null and has no label; null
    labels are left out, repeated ones count each; extra columns are not read; an empty table gives no rows.
    """
    model, lexicon = train(docs, labels, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(lexicon)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                score = model.score(np.stack([features(x.as_py(), codes) for x in part.column(2)]))
                columns = [part.column(0), part.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "predicted"])
        codes.clear()
        release()

    held_out = (crc32_remainder("doc_id", 3) == 1).alias("held_out")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out, text_bytes())
    with arrow_batches(docs.sparkSession, BATCH_ROWS):
        return materialize(rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int"), "toxicity")


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, most: int = TRAINING_ROWS) -> DataFrame:
    """docs, all columns, without the documents whose score reaches the threshold."""
    model, lexicon = train(docs, labels, most)

    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codes = Codes(lexicon)
        for texts in batches:
            x = np.stack([features((t or "").encode(), codes) for t in texts]) if len(texts) else np.zeros((0, len(FEATURES)), np.float32)
            yield pd.Series(model.score(x) < threshold)
        codes.clear()
        release()

    with arrow_batches(docs.sparkSession, BATCH_ROWS):
        return materialize(docs.where(clean(F.col("text").cast("string"))), "not-toxic")


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity_scores(documents(spark, sf_dir).select("doc_id", "text"), documents(spark, sf_dir, "labels"))
