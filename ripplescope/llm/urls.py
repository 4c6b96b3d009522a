"""URL filters: host and path rules, and logistic regression on hashed character n-grams for the urls that no rule fits.

The regression learns from a small labelled table of urls, LABELLED_URLS at most. Character 3- to 5-grams of the host (with
its ends marked) and of the path are hashed into 2**BITS weights; a url's score is the mean weight of its n-grams through the
logistic function. Hashes are rolling polynomials over a whole batch's characters, so no n-gram is ever a Python
object.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents

BITS = 16
GRAMS = (3, 4, 5)
#: Rows of the labelled table that are used, those with the smallest hashes of host and path.
LABELLED_URLS = 20_000

#: (host, path, verdict): a rule fits its host and all subdomains of it, for paths that start with its path.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
_ASCII_UPPER, _ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """host (A-Z lower-cased) and path; both empty for null and for urls without ://."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(text, pattern, 1), _ASCII_UPPER, _ASCII_LOWER), F.regexp_extract(text, pattern, 2)


def match_rules(urls: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """urls(host, path, ...) with rule and rule_verdict: the longest rule that fits, else null."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, decision in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, decision).otherwise(verdict)
    return urls.select("*", rule.alias("rule"), verdict.alias("rule_verdict"))


def gram_indexes(hosts: Sequence[str], paths: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram of a batch, and the row it belongs to. Characters are code points; no n-gram spans host and path."""
    texts = [x for h, p in zip(hosts, paths) for x in (f"^{h}$", f"/{p}" if p else "")]
    raw = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    part = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    indexes, rows = [], []
    for n in GRAMS:
        if len(raw) < n:
            continue
        code = np.zeros(len(raw) - n + 1, np.uint64)
        for k in range(n):
            code = code * np.uint64(0x100000001B3) + raw[k : k + len(code)] + np.uint64(1)
        code = (code ^ (code >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        inside = part[: len(code)] == part[n - 1 :]
        indexes.append((code >> np.uint64(64 - BITS)).astype(np.int64)[inside])
        rows.append(part[: len(code)][inside] // 2)
    return (np.concatenate(indexes), np.concatenate(rows)) if indexes else (np.zeros(0, np.int64), np.zeros(0, np.int64))


class UrlModel:
    """Logistic regression; full-batch gradient steps with AdaGrad. Without both labels its score is the constant prior."""

    def __init__(self, hosts: Sequence[str], paths: Sequence[str], blocked: Sequence[bool], steps: int = 150, rate: float = 0.5, decay: float = 1e-5) -> None:
        y = np.asarray(blocked, float)
        self.weights = np.zeros(1 << BITS)
        self.bias = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))) if len(y) else -1.0
        if not 0 < y.sum() < len(y):
            return
        index, row = gram_indexes(hosts, paths)
        each = np.bincount(row, minlength=len(y))
        used, index = np.unique(index, return_inverse=True)
        value = 1 / np.sqrt(each[row])
        w, seen, bias, bias_seen = np.zeros(len(used)), np.full(len(used), 1e-8), self.bias, 1e-8
        for _ in range(steps):
            p = 1 / (1 + np.exp(-(np.bincount(row, value * w[index], len(y)) + bias)))
            off = (p - y) / len(y)
            g = np.bincount(index, value * off[row], len(used)) + decay * w
            seen += g * g
            w -= rate * g / np.sqrt(seen)
            bias_seen += off.sum() ** 2
            bias -= rate * off.sum() / np.sqrt(bias_seen)
        self.weights[used], self.bias = w, float(bias)

    def score(self, hosts: Sequence[str], paths: Sequence[str]) -> np.ndarray:
        """Probability of block."""
        index, row = gram_indexes(hosts, paths)
        each = np.maximum(1, np.bincount(row, minlength=len(hosts)))
        raw = np.bincount(row, self.weights[index], len(hosts)) / np.sqrt(each) + self.bias
        return 1 / (1 + np.exp(-raw))


def train(labelled: DataFrame, most: int = LABELLED_URLS) -> UrlModel:
    """Fit on (host, path, verdict), each different url once."""
    rows = labelled.where("verdict is not null").select("host", "path", "verdict").distinct()
    got = rows.orderBy(F.xxhash64("host", "path"), "host", "path", "verdict").limit(most).collect()
    return UrlModel([r[0] for r in got], [r[1] for r in got], [r[2] == "block" for r in got])


def judge_urls(pages: DataFrame, model: UrlModel, rules: Sequence[tuple[str, str, str]] = RULES, threshold: float = 0.5) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, score (the model's probability of block).

    A url that is null or has no :// has empty host and path, fits no rule and is judged by the model; a null page_id stays
    null; repeated rows are judged each; extra columns are not read; an empty table gives no rows.
    """
    host, path = url_parts(F.col("url"))
    matched = match_rules(pages.select("page_id", host.alias("host"), path.alias("path")), rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(batch.column("host").to_pylist(), batch.column("path").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*batch.schema.names, "score"])

    scored = matched.mapInArrow(run, T.StructType([*matched.schema.fields, T.StructField("score", T.DoubleType())]))
    verdict = F.coalesce("rule_verdict", F.when(F.col("score") >= threshold, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def rule_labels(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """A labelled table from the urls that a rule decides."""
    host, path = url_parts(F.col("url"))
    return match_rules(pages.select(host.alias("host"), path.alias("path")), rules).select("host", "path", F.col("rule_verdict").alias("verdict"))


def op3_urls(spark, sf_dir: str) -> DataFrame:
    pages = documents(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, train(rule_labels(pages)))
