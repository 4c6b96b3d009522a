"""Secrets, surrogates, toxicity, decontamination."""

import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from ripplescope.llm import decontaminate, pii, secrets, toxicity

from .helpers import awkward, empty, got, random_text, table

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found)]


SECRET_TEXTS = [
    "secret: token: abcdefgh then token=abcdefgh", "API_KEY = 'xyz123/+' apikey:short", "AKIA" + "A" * 16 + " AKIAAKIA AKIA" + "1" * 15, "é𝒳漢 Passwd=ünsafe secret=" + "0123456789abcdef" * 2,
    "f" * 24 + "g" + "e" * 23, "token=token=token=abcdef", 'password"  :  "a.b-c_d=', "x" * 5000 + " secret=abcdef " * 40, "PASSWORD:abcdefſ",
]


def test_base_spans(spark):
    rows = [*awkward(), *enumerate(SECRET_TEXTS, 500)]
    found = secrets.secret_spans(table(spark, rows)).collect()
    assert len(found) == len(rows)
    want = {i: base_spans(t) for i, t in rows if i is not None}
    for r in found:
        if r.doc_id is not None:
            assert [f"{s.kind}:{s.start}:{s.end}" for s in r.spans if s.kind in ("assign", "access", "hex")] == want[r.doc_id]
    assert secrets.secret_spans(empty(spark)).count() == 0


def test_weak_parts_need_their_complement(spark):
    key, far = "Zm9vYmFyYmF6cXV4MTIz", "." * 300
    texts = [f"user = bob {key} at db.example", f"user = bob {far} {key}", key, f"10.0.0.1 {key} login=amy", "10.0.0.1 login=amy", "token=abcdef123456 https://h/x", "user: bob token=abcdef123456"]
    kinds = {r.doc_id: [s.kind for s in r.spans] for r in secrets.secret_spans(table(spark, [*enumerate(texts)])).collect()}
    assert kinds == {0: ["id", "key"], 1: [], 2: [], 3: ["endpoint", "key", "id"], 4: [], 5: ["assign"], 6: ["id", "assign"]}


def test_query_digests(spark, tmp_path):
    table(spark, [(1, SECRET_TEXTS[0]), (2, None)]).select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r for r in secrets.op1_secrets(spark, str(tmp_path)).collect()}
    spans = ",".join(base_spans(SECRET_TEXTS[0]))
    assert rows[1].base_sha256 == hashlib.sha256(spans.encode()).hexdigest() and rows[1].spans == spans and (rows[1].n_assign, rows[1].n_hex) == (1, 0)
    assert rows[2].base_sha256 == hashlib.sha256(b"").hexdigest() and rows[2].spans == ""


def test_characters_of_one_weak_part_do_not_complement_themselves(spark):
    texts = ["login=Zm9vYmFyYmF6cXV4MTIz", "login=Zm9vYmFyYmF6cXV4MTIz and Ym9vYmFyYmF6cXV4MTI5", "user=ann https://x.org/Ym9vYmFyYmF6cXV4MTI5"]
    spans = [[(s.kind, s.start, s.end) for s in r.spans] for r in secrets.secret_spans(table(spark, [*enumerate(texts)])).orderBy("doc_id").collect()]
    assert spans == [[], [("id", 0, 26), ("key", 31, 51)], []]


def luhn(number):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(number))) % 10 == 0


def test_surrogates_keep_type_format_and_identity(spark):
    rows = [
        *awkward(), (600, "Ann.9@Mail.example.com, ann.9@mail.example.com and bea@mail.example.com"), (601, "+1 (017) 555-7713 +1 017-555-7713 +1 (017) 555-7714"), (602, "4111 1111 1111 1111 4111111111111111 9807915762804490"),
        (603, "97.51.17.173 and 97.51.17.174, not 1.2.3 nor 1.2.3.4.5 nor 300.1.1.1"), (604, "ssn 123-45-6789 iban DE89 3704 0044 0532 0130 00"), (605, "Mrs Anna Smith, Mr Jones, Frau Weber, Господин Иванов"),
    ]
    out = {r.doc_id: r.text for r in pii.replace_pii(table(spark, rows), "k").where("doc_id is not null").collect()}
    plain = {i: t for i, t in awkward() if i is not None}
    assert {i: out[i] for i in plain} == plain
    mails = re.findall(r"\S+@[\w.]+", out[600])
    assert mails[0] == mails[1] != mails[2] and all(m.endswith(".com") for m in mails) and mails[0].split("@")[1] == mails[2].split("@")[1] and "mail" not in out[600] and "ann" not in out[600].lower().split("and")[0]
    phones = re.findall(r"\+1 \(?\d{3}\)?[ -]\d{3}-\d{4}", out[601])
    digits = [re.sub(r"\D", "", p) for p in phones]
    assert len(phones) == 3 and digits[0] == digits[1] != digits[2] and "7713" not in out[601]
    cards = re.findall(r"(?:\d{4} ){3}\d{4}|\d{16}", out[602])
    assert cards[0].replace(" ", "") == cards[1] and luhn(cards[1]) and cards[1] != "4111111111111111" and len(cards) == 3
    ips = re.findall(r"\d+\.\d+\.\d+\.\d+", out[603])
    assert ips[0] != ips[1] and all(0 <= int(o) < 256 for ip in ips[:2] for o in ip.split(".")) and "not 1.2.3 nor 1.2.3.4.5 nor 300.1.1.1" in out[603]
    assert re.fullmatch(r"ssn \d{3}-\d{2}-\d{4} iban DE\d\d( \d{4}){4} \d\d", out[604]) and "6789" not in out[604]
    assert re.match(r"Mrs [A-Z][a-z]+a [A-Z]\w+-[A-Z]\w+, Mr [A-Z]", out[605]) and re.search("Господин [А-Я]", out[605]) and "Smith" not in out[605]
    assert pii.replace_pii(empty(spark), "k").count() == 0


def test_permutation_is_a_bijection(spark):
    for n in (1, 2, 3, 5):
        d = spark.range(10**n if n < 4 else 20_000).select(F.lpad(F.col("id").cast("string"), n, "0").alias("d"))
        x = d.select(pii.permuted_digits(F.col("d"), F.lit("k")).alias("e"))
        assert x.distinct().count() == d.count() and x.where(F.length("e") != n).count() == 0


def test_a_person_keeps_the_family_name_whatever_the_title(spark):
    rows = [(1, "Mr Jones / Mr. Jones / Mr John Jones / Dr Jones / Mrs JONES / Mr John Smith"), (2, "Mrs Joan Smith"), (3, "fe80::1 2001:db8:0:0:0:0:0:1 but a::b at 12:30:45")]
    out = {r.doc_id: r.text for r in pii.replace_pii(table(spark, rows), "k").collect()}
    plain, dotted, john, doctor, caps, smith = out[1].split(" / ")
    family = plain.split(" ")[1]
    assert dotted == f"Mr. {family}" and doctor == f"Dr {family}" and caps == f"Mrs {family.upper()}" and john.split(" ")[2] == family != "Jones"
    assert smith.split(" ")[1] == john.split(" ")[1] and smith.split(" ")[2] == out[2].split(" ")[2] != family and out[2].split(" ")[1].endswith("a")
    short, long, rest = re.fullmatch(r"([0-9a-f]{4}::[0-9a-f]) ([0-9a-f]{4}:[0-9a-f]{3}(?::[0-9a-f]){6}) (.*)", out[3]).groups()
    assert short != "fe80::1" and rest == "but a::b at 12:30:45"


def test_entities_that_clash_are_keyed_anew_each_by_itself(spark, monkeypatch):
    real = pii._email
    rows = [(i, f"to u{i}@x.com and u{i + 1}@x.com") for i in range(20)] + [(30, "+1 415-555-1234"), (31, None)]
    before = {r.doc_id: r.text for r in pii.replace_pii(table(spark, rows), "k").collect()}
    # in the first round all but one share a surrogate, in the second two are others' own addresses
    monkeypatch.setattr(pii, "_email", lambda m, k: F.when(k.endswith("/0") & (m != "u3@x.com"), F.lit("a@b.c")).when(k.endswith("/1") & m.isin("u5@x.com", "u6@x.com"), F.lit("u7@x.com")).otherwise(real(m, k)))
    after = {r.doc_id: r.text for r in pii.replace_pii(table(spark, rows), "k").collect()}
    kept = {x: set() for x in range(21)}
    for i in range(20):
        for x, mail in zip((i, i + 1), re.findall(r"\S+@\S+", after[i])):
            kept[x].add(mail)
    assert all(len(v) == 1 for v in kept.values()) and len(set().union(*kept.values())) == 21
    assert not set().union(*kept.values()) & {f"u{i}@x.com" for i in range(21)}
    assert after[30] == before[30] and after[31] is None and kept[3] == set(re.findall(r"\S+@\S+", before[2])[1:])


def labelled(n=400):
    import random

    rnd = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        words = random_text(rnd, 40).split()
        if bad:
            words[rnd.randrange(40)] = rnd.choice(["idiot", "MORON!!", "1d10t", "w0rthless", "st*pid"])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad != (rnd.random() < 0.03))))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = labelled()
    labels += [(None, 1, 1), (3, None, None), (99999, 1, 1)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = {r.doc_id: r for r in toxicity.toxicity_scores(table(spark, rows), marks).collect()}
    held = [r for r in found.values() if r.held_out]
    assert len(found) == 400 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found.values())
    assert sum(r.predicted == (r.doc_id % 5 == 0) for r in held) / len(held) > 0.97
    kept = toxicity.reject_toxic(table(spark, rows), marks)
    assert {r.doc_id for r in kept.collect()} == {i for i, r in found.items() if not r.predicted} and kept.columns == table(spark, rows).columns


def test_toxicity_learns_beginnings_of_words_that_no_list_holds(spark):
    rnd = random.Random(11)
    rows, labels = [], []
    for i in range(900):
        bad = i % 6 == 0
        words_ = [f"{rnd.choice('bdgklm')}{rnd.choice('aeiou')}{rnd.choice('nrst')}{rnd.randrange(300)}" for _ in range(40)]
        if bad:
            for _ in range(3):
                words_[rnd.randrange(40)] = rnd.choice(["Réeux", "achlich"]) + rnd.choice(["ment", "er,", "an", "isch."]) + "x" * rnd.randrange(3)
        rows.append((i, " ".join(words_)))
        labels.append((i, 1, int(bad)))
    found = toxicity.toxicity_scores(table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    held = [r for r in found if r.held_out]
    assert len(found) == 900 and len(held) > 200
    assert sum(r.predicted for r in held if r.doc_id % 6 == 0) / sum(r.doc_id % 6 == 0 for r in held) > 0.95
    assert not sum(r.predicted for r in held if r.doc_id % 6)


def test_toxicity_of_awkward_inputs(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    scored = toxicity.toxicity_scores(table(spark, awkward()), none)
    assert {(r.score, r.predicted) for r in scored.collect()} == {(0.5, 0)} and scored.count() == len(awkward())
    assert toxicity.toxicity_scores(empty(spark), none).count() == 0
    assert toxicity.reject_toxic(table(spark, awkward()), none).count() == len(awkward())


def test_trees_and_isotonic_fit():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    trees = toxicity.Trees().fit(x, y)
    assert ((trees.raw(x) > 0) == y).mean() > 0.95
    at, value = toxicity.isotonic(np.array([1, 2, 2, 3, 4.0]), np.array([0, 1, 0, 0, 1.0]))
    assert value.tolist() == sorted(value) and np.interp([2, 3], at, value).tolist() == [1 / 3, 1 / 3]


ITEMS = [(1, "Natalia sold 48 clips to Weng in April and then half of them in May, how many did Natalia sell in 3 days?"), (2, "short question here"), (3, None), (4, ""), (None, "the quick brown fox jumps over the lazy dog near the old river bank today")]


def test_reparameterised_questions_are_found(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    q = "Anna sold 50 clips to Bob in April and then half of them in May, how many did Anna sell in 7 days?"
    rows = [*awkward(), (700, "intro words. " + q + " outro"), (701, q.replace("did Anna", "did Bob")), (702, ITEMS[0][1]), (703, "a short, question *here*!"), (704, "The QUICK brown*** fox jumps*** over the lazy dog near the OLD river"), (705, "the quick brown fox jumps away")]
    found = got(decontaminate.contaminated(table(spark, rows), bench), "doc_id", "item_id", "exact")
    assert found == [(700, 1, False), (702, 1, True), (703, 2, True), (704, None, True)]
    kept = decontaminate.drop_contaminated(table(spark, rows), bench)
    assert kept.count() == len(rows) - 4 and kept.columns == table(spark, rows).columns
    assert decontaminate.contaminated(empty(spark), bench).count() == 0
    assert decontaminate.contaminated(table(spark, rows), bench.where("false")).count() == 0


def test_benchmark_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 10)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert got(decontaminate.contaminated(table(spark, [(1, ITEMS[0][1]), (2, "a short question here")]), bench), "doc_id", "item_id") == [(1, 1), (2, 2)]


def found_in(item, texts):
    """Numbers of the texts in which the item is found."""
    judge = decontaminate.Templates([(1, item)], decontaminate.WINDOW, decontaminate.SHARE, decontaminate.RUN)
    return [k for k, t in enumerate(texts) if judge.search(t.encode())]


def test_items_of_placeholders_are_found_verbatim():
    sums = "12 + 7 = 19, 30 - 4 = 26, 5 * 8 = 40, 81 / 9 = 9"
    assert found_in(sums, ["so " + sums + " holds", "12 7 19 31 4 27 6 8 48 80 10 8"]) == [0]
    title = "The Great Lakes Of North America And Their Fish"
    assert found_in(title, ["we read The Great Lakes Of North America And Their Fish again", "we read The Small Hills Of South Africa And Their Birds again"]) == [0]
    assert found_in("Alice, Bob, Carlos", ["then Alice, Bob, Carlos left", "then Anna, Tom, Jim left"]) == [0]


def test_first_word_of_an_item_inside_a_document():
    item = "What is the capital of France today?"
    assert found_in(item, ["Question: " + item, "Heading\n\n" + item, "they asked us " + item, item, "they asked us Who is the capital of France today?"]) == [0, 1, 2, 3]
    assert found_in("Minutes of the meeting held today", ["Exhibit 3 Minutes of the meeting held today"]) == [0]


def test_a_contradicting_slot_rejects_its_windows_only():
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(50)]
    words[10] = words[40] = "17"
    changed = [*words[:40], "23", *words[41:]]
    swapped = [*words[:10], "23", *words[11:40], "29", *words[41:]]
    assert found_in(" ".join(words), [" ".join(words), " ".join(changed), " ".join(swapped)]) == [0, 1, 2]
    merged = ["so", "41", *words[1:10], "41", *words[11:40], "41"]
    assert found_in(" ".join(["so", "3", *words[1:10], "5", *words[11:40], "7"]), [" ".join(merged)]) == [0]
    # all windows hold a contradiction
    assert found_in("he has 3 apples and she has 3 pears left now", ["he has 4 apples and she has 5 pears left now"]) == []


def test_cards_of_fifteen_and_fourteen_digits_in_groups(spark):
    rows = [(1, "amex 3782 822463 10005, 3782-822463-10005 and diners 3056 930902 5904"), (2, "378282246310005")]
    out = {r.doc_id: r.text for r in pii.replace_pii(table(spark, rows), "k").collect()}
    m = re.fullmatch(r"amex (\d{4} \d{6} \d{5}), (\d{4}-\d{6}-\d{5}) and diners (\d{4} \d{6} \d{4})", out[1])
    amex, same, diners = (re.sub(r"\D", "", x) for x in m.groups())
    assert amex == same == out[2] != "378282246310005" and diners != "30569309025904" and luhn(amex) and luhn(diners)


def brute_found(item, text, window=8, share=0.5, run=13, literals=4):
    """Whether an item of lower-case words and numbers is found in such a text."""
    a, b = item.split(), text.split()
    width = min(window, len(a))
    if not width:
        return False
    number = [x.isdigit() for x in a]
    typed = [sum(not n for n in number[j : j + width]) >= min(literals, width) for j in range(len(a) - width + 1)]
    kind = lambda ws: ["#" if w.isdigit() else w for w in ws]
    alignments: dict = {}
    for i in range(len(b) - width + 1):
        for j, t in enumerate(typed):
            x, y = a[j : j + width], b[i : i + width]
            if (kind(x) == kind(y)) if t else x == y:
                alignments.setdefault(i - j, set()).add(j)
    matched, longest = set(), 0
    for shift, places in alignments.items():
        slots = {p: (a[p], b[p + shift]) for j in places for p in range(j, j + width) if number[p]}
        bad = {p for p, (x, y) in slots.items() if x != y and (len({v for u, v in slots.values() if u == x}) > 1 or len({u for u, v in slots.values() if v == y}) > 1)}
        kept = {j for j in places if not bad & {*range(j, j + width)}}
        matched |= kept
        covered = {p for j in kept for p in range(j, j + width)}
        for p in covered:
            n = 0
            while p + n in covered:
                n += 1
            longest = max(longest, n)
    some = [j for j, t in enumerate(typed) if t]
    return len(matched) / len(typed) >= share or len(matched & {*some}) / max(1, len(some)) >= share or longest >= run


def test_contamination_against_brute_force(spark):
    rnd = random.Random(12)
    word = lambda: rnd.choice(["alpha", "beta", "gamma", "delta", "seven", "omega", "kappa"][:6]) + rnd.choice("xyz")
    items = [" ".join(word() if rnd.random() < 0.75 else str(rnd.randrange(20)) for _ in range(rnd.choice([3, 8, 9, 14, 30, 60]))) for _ in range(14)]
    items += ["", "1 2 3 4 5 6 7 8 9 10 11 12 13 14", items[0]]
    texts = []
    for _ in range(160):
        words_ = rnd.choice(items).split()
        a, b = sorted((rnd.randrange(len(words_) + 1), rnd.randrange(len(words_) + 1)))
        words_ = words_[a:b] if rnd.random() < 0.5 else words_
        again = {str(k): str(rnd.randrange(20)) for k in range(20)} if rnd.random() < 0.5 else {}
        words_ = [again.get(w, w) if rnd.random() < 0.95 else word() for w in words_]
        texts.append(" ".join([*[word() for _ in range(rnd.randrange(12))], *words_, *[word() for _ in range(rnd.randrange(12))]]))
    benchmark = spark.createDataFrame([*enumerate(items), (99, None)], "item_id long, text string")
    rows = [*enumerate(texts), (None, items[2]), (900, None), (901, "")]
    want = sorted(((i, k) for i, t in rows if t for k, item in enumerate(items) if brute_found(item, t)), key=lambda r: (r[0] is None, str(r[0]), r[1]))
    found = sorted(((r.doc_id, r.item_id) for r in decontaminate.contaminated(table(spark, rows), benchmark).collect()), key=lambda r: (r[0] is None, str(r[0]), r[1]))
    assert found == want and 40 < len(want) < 1500
    kept = decontaminate.drop_contaminated(table(spark, rows), benchmark)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, t in rows if i not in {k for k, _ in want}) and kept.columns == table(spark, rows).columns
