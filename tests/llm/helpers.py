"""Small documents with every awkward case, and word helpers written anew for brute force."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Names that operators use in results or inside.
EXTRA = "fingerprint string, spans string, score double, text_len int, hits int, chunk long, shard int, label int, start long"


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def random_text(rnd, n, vocabulary=200):
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(n))


def awkward(seed=1):
    """(doc_id, text) with nulls, empty, blank, very long, repeated and tied texts."""
    rnd = random.Random(seed)
    base = random_text(rnd, 120)
    near = base.split()
    near[60] = "other"
    long = random_text(rnd, 30_000, 5000)
    return [
        (1, base), (2, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, " \t\n"), (7, long), (None, random_text(rnd, 50)), (None, None),
        (8, "one"), (9, "Two words"), (10, "ünï çödé 漢字 " + base[:100]), (11, base + "\n" + base), (12, "x " * 80), (13, "one"),
    ]


def table(spark, rows):
    """documents of the rows, with clashing extra columns."""
    return spark.createDataFrame([(i, t, "en", None, None) + (None,) * 9 for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, " + EXTRA).coalesce(3)


def empty(spark):
    return table(spark, [])


def got(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=lambda r: tuple((v is None, str(v)) for v in r))
