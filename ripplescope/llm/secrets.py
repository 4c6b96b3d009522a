"""Secret scans by multipart credential linking, in DataFrame functions only.

Base kinds (assign, access, hex) stand for themselves. Weak kinds are parts of a credential that mean nothing alone: an
account or client identifier (id), a random-looking string (key) and a service address (endpoint). All parts of a text are
placed on one axis of code points and joined by interval, each with the parts that start within SCOPE code points: an id is
reported beside a secret, a key beside an identifier, an endpoint beside both. Weak spans that overlap a base span go, and of
weak spans that overlap the later one, so no characters stand for two parts.

Spark has no function for the places of all matches, but the matches and the text between them alternate: their lengths,
summed in order by a window over the document's matches, give the places. Only lengths are shuffled, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, row_keyed

SCOPE = 256
#: kind, pattern, group whose length counts (0: the match), its least length; in the order in which equal starts are listed.
BASE_KINDS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"(?<![0-9a-f])[0-9a-f]{24,}", 0, 24),
)
WEAK_KINDS = (
    ("id", r"""(?i:access_?key_?id|client_?id|user_?name|user|login|account)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@+-]+)""", 1, 3),
    ("key", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}", 0, 16),
    ("endpoint", r"""[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\x00-\x20"'<>]+|(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]{1,5})?(?![0-9.])""", 0, 7),
)
KINDS = (*BASE_KINDS, *WEAK_KINDS)
_BASE = len(BASE_KINDS)
#: A cheap test that every match passes.
_HINT = {"id": r"(?i:access|client|user|login|account)", "endpoint": r"://|[0-9]\.[0-9]"}


def _parts(text: Column, kind: int) -> Column:
    """An array of (kind, i, gap before the match, the match's length, whether it counts)."""
    name, pattern, group, least = KINDS[kind]
    re = F.lit(pattern)
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    whole = F.regexp_extract_all(text, re, F.lit(0))
    counted = whole if not group else F.regexp_extract_all(text, re, F.lit(group))

    def one(x: Column, i: Column) -> Column:
        ok = F.length(x["counted"]) >= least
        if name == "key":  # letters and digits, both
            ok = ok & x["whole"].rlike("[0-9]") & x["whole"].rlike("[A-Za-z]")
        return F.struct(F.lit(kind).alias("kind"), i.alias("i"), x["gap"].alias("gap"), F.length(x["whole"]).alias("len"), ok.alias("ok"))

    zipped = F.slice(F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), counted.alias("counted")), F.lit(1), F.size(whole))
    none = F.array().cast("array<struct<kind:int,i:int,gap:int,len:int,ok:boolean>>")
    return F.when(text.rlike(_HINT.get(name, pattern)), F.transform(zipped, one)).otherwise(none)


def placed_parts(docs: DataFrame) -> DataFrame:
    """(__row, doc_id, kind, start, end) for every part, base or weak, and one row with nulls for each document."""
    keyed = row_keyed(docs.select(F.col("doc_id").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    nothing = F.array(F.struct(F.lit(None).cast("int").alias("kind"), F.lit(0).alias("i"), F.lit(0).alias("gap"), F.lit(0).alias("len"), F.lit(True).alias("ok")))
    every = keyed.select("__row", "doc_id", F.explode(F.concat(nothing, *[_parts(F.col("text"), k) for k in range(len(KINDS))])).alias("x"))
    before = Window.partitionBy("__row", "x.kind").orderBy("x.i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("x.gap").cast("long") + F.col("x.len")).over(before)
    placed = every.repartition("__row").withColumn("end", end)
    start = F.when(F.col("x.kind").isNotNull(), F.col("end") - F.col("x.len"))
    return placed.where("x.ok").select("__row", "doc_id", "x.kind", start.alias("start"), "end")


def linked_parts(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """placed_parts without the weak parts that overlap base spans or earlier weak parts, or lack complementary parts.

    Parts are near if their starts are at most scope code points apart.
    """
    base, start = F.col("kind") < _BASE, F.col("start")
    order = Window.partitionBy("__row").orderBy("start", "kind", "end")
    earlier = F.max(F.when(base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    # the same from the other end: a frame that runs on to the last row would be read anew for each row
    back = Window.partitionBy("__row").orderBy(F.desc("start"), F.desc("kind"), F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    later = F.min(F.when(base, start)).over(back)
    overlaps = (F.coalesce(earlier, F.lit(-1)) > start) | (F.coalesce(later, F.col("end")) < F.col("end"))
    free = parts.withColumn("hit", ~base & overlaps).where("not coalesce(hit, false)").drop("hit")
    # the same characters are one part: a weak part that starts inside another, or with a longer one, goes
    outer = Window.partitionBy("__row").orderBy("start", F.desc("end"), "kind").rowsBetween(Window.unboundedPreceding, -1)
    inside = ~base & (F.coalesce(F.max(F.when(~base, F.col("end"))).over(outer), F.lit(-1)) > start)
    free = free.withColumn("inside", inside).where("not coalesce(inside, false)")
    near = Window.partitionBy("__row").orderBy("start").rangeBetween(-scope, scope)
    names = [k[0] for k in KINDS]
    of = lambda *kinds: F.col("kind").isin([names.index(x) for x in kinds])
    beside = lambda *kinds: F.coalesce(F.max(of(*kinds)).over(near), F.lit(False))
    marked = free.select("*", beside("access", "id").alias("has_id"), beside("assign", "hex", "key").alias("has_secret"))
    linked = F.when(of("id"), F.col("has_secret")).when(of("key"), F.col("has_id")).when(of("endpoint"), F.col("has_id") & F.col("has_secret"))
    return marked.withColumn("keep", F.col("kind").isNull() | base | linked)


def secret_spans(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row per document: doc_id, spans (array of kind, start, end in code points, end exclusive; by start, then kind).

    Null and empty texts have no spans; a null doc_id stays null; repeated rows are reported each; extra columns are not
    read; an empty table gives no rows.
    """
    linked = linked_parts(placed_parts(docs), scope)
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    found = F.collect_list(F.when(F.col("keep") & F.col("kind").isNotNull(), F.struct("start", "kind", "end")))
    rows = linked.groupBy("__row").agg(F.first("doc_id").alias("doc_id"), F.array_sort(found).alias("x"))
    spans = F.transform("x", lambda s: F.struct(F.element_at(names, s["kind"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return rows.select("doc_id", spans.alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_secrets(spark, sf_dir: str) -> DataFrame:
    found = secret_spans(documents(spark, sf_dir).select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"].isin([k[0] for k in BASE_KINDS]))
    count = lambda name: F.size(F.filter("spans", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")
    return found.select("doc_id", *[count(k[0]) for k in BASE_KINDS], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
