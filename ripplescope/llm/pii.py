"""PII surrogates, in DataFrame functions only.

Detected entities get keyed replacements of their own type and format. Numbers (phones, cards, social security numbers, bank
accounts, addresses of the Internet Protocol) go through a keyed Feistel permutation of their digits or octets; separators,
country codes and a valid Luhn digit stay as they are. E-mail addresses and names after a title become pronounceable words of
a keyed hash, in the entity's script, given names with an ending of the title's gender. An entity is keyed by its normal form
(digits; lower case), so mentions written differently corefer. The family name after a title and each given name before it are
entities of their own, so a person keeps the family name with another title or without the given name.

Distinctness is checked over the whole corpus: all different entities, once each, are grouped by surrogate. Of those that share
one all but the first are keyed anew, each by itself, and so is an entity whose surrogate is its own or another entity's value,
until none is left. Only entities are shuffled for this. Texts are rewritten in place; only if some entity was keyed anew do the
few texts that hold such ones get its number by a join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, materialize, row_keyed

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Title, gender. Fixed values.
TITLES = {
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа"),
    "m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин"),
    "n": ("Dr", "Prof"),
}
_ALL_TITLES = sorted((t for ts in TITLES.values() for t in ts), key=len, reverse=True)
#: type, pattern; the first that matches at a place wins. No entity starts or ends inside a longer run of its characters.
ENTITIES = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    ("ipv6", r"(?<![0-9A-Za-z:.])(?=[A-Fa-f:]*[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])"),
    ("ip", rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("card", r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5})(?![0-9])"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("phone", r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-]?[0-9]{4}(?![0-9])|(?<![0-9A-Za-z])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){3,5}(?![0-9])"),
    ("name", rf"(?<!\p{{L}})(?:{'|'.join(_ALL_TITLES)})\.? \p{{Lu}}[\p{{L}}'-]+(?: \p{{Lu}}[\p{{L}}'-]+)*"),
)
_ANY = "|".join(f"(?:{p})" for _, p in ENTITIES)
#: Every entity has one of these.
_HINT = rf"@|[0-9A-Fa-f]:(?:[0-9A-Fa-f]|:[0-9A-Fa-f])|[0-9](?:[0-9 .-]|\) ?){{5}}|(?:{'|'.join(_ALL_TITLES)})\.? \p{{Lu}}"
_HEX = "0123456789abcdef"
_CONSONANTS = {"latin": "bdfgklmnprstvzhj", "cyrillic": "бвгдзклмнпрстфхж"}
_VOWELS = {"latin": "aeiouaeiouaeioua", "cyrillic": "аеиоуаеиоуаеиоуа"}
#: Ends of given names by script and gender.
_ENDS = {("latin", "f"): "a", ("latin", "m"): "o", ("latin", "n"): "i", ("cyrillic", "f"): "а", ("cyrillic", "m"): "н", ("cyrillic", "n"): "и"}
#: Rounds of keying anew before the call fails: each leaves only surrogates that met another again.
MAX_ROUNDS = 32


def entity_type(match: Column) -> Column:
    kind = F.lit("name")
    for name, pattern in reversed(ENTITIES[:-1]):
        kind = F.when(match.rlike(f"^(?:{pattern})$"), name).otherwise(kind)
    return kind


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _title(match: Column) -> Column:
    return F.regexp_extract(match, rf"^({'|'.join(_ALL_TITLES)})\.? ", 1)


def normal_form(kind: Column, match: Column) -> Column:
    """What makes two mentions the same entity of a type."""
    numbers = F.when(kind == "phone", F.concat(F.regexp_extract(match, r"^\+[0-9]{1,3}(?=[ .(-])", 0), F.lit("/"), _digits(F.regexp_replace(match, r"^\+[0-9]{1,3}(?=[ .(-])", ""))))
    plain = F.when(kind == "ip", match).when(kind == "iban", F.regexp_replace(match, " ", "")).when(kind.isin("card", "ssn"), _digits(match))
    return F.coalesce(numbers, plain, F.lower(match))


def _hash(key: Column, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("\u0001", key, *parts), 256)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once and written once in the plan."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _permuted(left: Column, right: Column, left_size: Column, right_size: Column, key: Column) -> Column:
    """(left, right) after six rounds of a Feistel permutation of [0, left_size) x [0, right_size)."""
    draw = lambda x, r: F.conv(F.substring(_hash(key, r.cast("string"), x.cast("string")), 1, 15), 16, 10).cast("long")

    def step(s: Column, r: Column) -> Column:
        new_left = F.pmod(s["left"] + F.pmod(draw(s["right"], r), left_size), left_size)
        new_right = F.pmod(s["right"] + F.pmod(draw(s["left"], r), right_size), right_size)
        return F.when(r % 2 == 1, F.struct(new_left.alias("left"), s["right"].alias("right"))).otherwise(F.struct(s["left"].alias("left"), new_right.alias("right")))

    start = F.struct(left.cast("long").alias("left"), right.cast("long").alias("right"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(6)), start, step)


def permuted_digits(digits: Column, key: Column) -> Column:
    """Up to 36 digits; a number that is too long for one permutation has its two parts permuted each, keyed by length."""

    def one(d: Column) -> Column:
        n, half = F.length(d), F.floor(F.length(d) / 2).cast("int")
        power = lambda k: F.rpad(F.lit("1"), k + 1, F.lit("0")).cast("long")
        moved = _permuted(F.coalesce(d.substr(F.lit(1), half).try_cast("long"), F.lit(0)), d.substr(half + 1, n - half), power(half), power(n - half), F.concat(key, n.cast("string")))
        join = lambda s: F.concat(F.when(half > 0, F.lpad(s["left"].cast("string"), half, F.lit("0"))).otherwise(""), F.lpad(s["right"].cast("string"), n - half, F.lit("0")))
        return _let(moved, join)

    parts = F.filter(F.transform(F.sequence(F.lit(0), F.lit(1)), lambda i: digits.substr(i * 18 + 1, F.lit(18))), lambda d: d != "")
    return F.array_join(F.transform(parts, one), "")


def _luhn_rest(digits: Column, check_place: int) -> Column:
    """Luhn sum modulo 10 of digits whose last one stands check_place places before the number's end."""
    chars = F.reverse(F.filter(F.split(digits, ""), lambda c: c != ""))
    doubled = lambda c, i: F.when((i + check_place) % 2 == 1, F.when(c >= 5, 2 * c - 9).otherwise(2 * c)).otherwise(c)
    return F.aggregate(F.transform(chars, lambda c, i: doubled(c.cast("int"), i)), F.lit(0), lambda a, x: a + x) % 10


def _into_format(match: Column, characters: Column, kind: str = "[0-9]") -> Column:
    """The match with its characters of a kind replaced in order."""
    return _let(F.split(match, kind, -1), lambda gaps: F.array_join(F.transform(gaps, lambda gap, i: F.when(i < F.size(gaps) - 1, F.concat(gap, characters.substr(i + 1, F.lit(1)))).otherwise(gap)), ""))


def _word(hashed: Column, syllables: int, first: int, script: str = "latin") -> Column:
    letter = lambda at, to: F.translate(hashed.substr(at, F.lit(1)), _HEX, to)
    pair = lambda i: F.concat(letter(2 * i + first, _CONSONANTS[script]), letter(2 * i + first + 1, _VOWELS[script]))
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(syllables - 1)), pair), "")


def _cased(word: Column, like: Column) -> Column:
    return F.when((F.upper(like) == like) & (F.length(like) > 1), F.upper(word)).otherwise(F.initcap(word))


def _family(match: Column, key: Column) -> Column:
    def of(h: Column) -> Column:
        spelled = lambda script: F.concat(_word(h, 3, 2, script), F.lit("-"), _word(h, 4, 20, script))
        whole = F.when(match.rlike(r"\p{IsCyrillic}"), spelled("cyrillic")).otherwise(spelled("latin"))
        return _let(whole, lambda w: F.when((F.upper(match) == match) & (F.length(match) > 1), F.upper(w)).otherwise(F.array_join(F.transform(F.split(w, "-"), F.initcap), "-")))

    return _let(_hash(key, F.lower(match)), of)


def _given(match: Column, gender: Column, key: Column) -> Column:
    def of(h: Column) -> Column:
        def spelled(script: str) -> Column:
            end = F.when(gender == "f", _ENDS[script, "f"]).when(gender == "m", _ENDS[script, "m"]).otherwise(_ENDS[script, "n"])
            return F.concat(_word(h, 3, 2, script), F.translate(h.substr(F.lit(30), F.lit(1)), _HEX, _CONSONANTS[script]), end)

        return _let(F.when(match.rlike(r"\p{IsCyrillic}"), spelled("cyrillic")).otherwise(spelled("latin")), lambda w: _cased(w, match))

    return _let(_hash(key, gender, F.lower(match)), of)


def _email(match: Column, key: Column) -> Column:
    def of(x: Column) -> Column:
        number = lambda h: F.when(x["local"].rlike("[0-9]"), F.concat(F.lit("."), F.lpad(F.pmod(F.conv(h.substr(F.lit(40), F.lit(12)), 16, 10).cast("long"), F.lit(1000)).cast("string"), 3, "0"))).otherwise("")
        mine = _let(_hash(key, x["whole"]), lambda h: F.concat(_word(h, 10, 1), number(h)))
        return F.concat(mine, F.lit("@"), _let(_hash(key, F.lit("domain"), x["domain"]), lambda h: _word(h, 5, 1)), F.regexp_extract(x["domain"], r"(\.[^.]*)$", 1))

    lower = F.lower(match)
    return _let(F.struct(lower.alias("whole"), F.regexp_extract(lower, "^([^@]*)@", 1).alias("local"), F.regexp_extract(lower, "@(.*)$", 1).alias("domain")), of)


def _phone(match: Column, key: Column) -> Column:
    def of(x: Column) -> Column:
        return F.concat(x["prefix"], _let(permuted_digits(_digits(x["body"]), F.concat(key, x["prefix"])), lambda d: _into_format(x["body"], d)))

    prefix = F.regexp_extract(match, r"^\+[0-9]{1,3}(?=[ .(-])", 0)
    return _let(F.struct(prefix.alias("prefix"), match.substr(F.length(prefix) + 1, F.length(match)).alias("body")), of)


def _address(match: Column, key: Column) -> Column:
    mixed = _let(F.transform(F.split(match, r"\."), lambda x: x.cast("long")), lambda o: _permuted(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), F.concat(key, F.lit("ip"))))
    return _let(mixed, lambda s: F.concat_ws(".", *[x.cast("long").cast("string") for x in (F.floor(s["left"] / 256), s["left"] % 256, F.floor(s["right"] / 256), s["right"] % 256)]))


def _card(match: Column, key: Column) -> Column:
    def of(number: Column) -> Column:
        checked = _let(permuted_digits(number.substr(F.lit(1), F.length(number) - 1), F.concat(key, F.lit("luhn"))), lambda d: F.concat(d, ((10 - _luhn_rest(d, 1)) % 10).cast("string")))
        moved = F.when(_luhn_rest(number, 0) == 0, checked).otherwise(permuted_digits(number, F.concat(key, F.lit("card"))))
        return _let(moved, lambda d: _into_format(match, d))

    return _let(_digits(match), of)


def _account(match: Column, key: Column) -> Column:
    moved = _let(_digits(match), lambda d: permuted_digits(d, F.concat(key, F.regexp_replace(match, "[0-9 ]", ""))))
    return _let(moved, lambda d: F.concat(match.substr(1, 2), _into_format(match.substr(F.lit(3), F.length(match)), d)))


def surrogate(kind: Column, match: Column, key: Column) -> Column:
    """The replacement of a match; key: the secret and the tweak. Names are of kinds family, given-f, given-m and given-n."""
    numbers = F.when(kind == "phone", _phone(match, key)).when(kind == "ip", _address(match, key)).when(kind == "card", _card(match, key)).when(kind == "iban", _account(match, key))
    numbers = numbers.when(kind == "ssn", _let(permuted_digits(_digits(match), F.concat(key, F.lit("ssn"))), lambda d: _into_format(match, d)))
    numbers = numbers.when(kind == "ipv6", _let(_hash(key, F.lower(match)), lambda h: _into_format(match, h, "[0-9A-Fa-f]")))
    return numbers.when(kind == "email", _email(match, key)).when(kind == "family", _family(match, key)).otherwise(_given(match, kind.substr(7, 1), key))


def _mentions(match: Column) -> Column:
    """Of a match the array of its entities (kind, text): itself, or the names after a title."""

    def of(kind: Column) -> Column:
        bare = _title(match)
        gender = F.when(bare.isin(*TITLES["f"]), "f").when(bare.isin(*TITLES["m"]), "m").otherwise("n")
        words = F.slice(F.split(match, " "), F.lit(2), F.size(F.split(match, " ")) - 1)
        named = _let(words, lambda ws: F.transform(ws, lambda w, i: F.struct(F.when(i == F.size(ws) - 1, "family").otherwise(F.concat(F.lit("given-"), gender)).alias("kind"), w.alias("text"))))
        return F.when(kind == "name", named).otherwise(F.array(F.struct(kind.alias("kind"), match.alias("text"))))

    return _let(entity_type(match), of)


def _matches(text: Column) -> Column:
    return F.when(text.rlike(_HINT), F.regexp_extract_all(text, F.lit(_ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def entities(docs: DataFrame) -> DataFrame:
    """The different entities of all texts: kind, normal, sample (a mention)."""
    found = docs.select(F.explode(_matches(F.col("text").cast("string"))).alias("match")).groupBy("match").count()
    typed = found.select(F.explode(_mentions(F.col("match"))).alias("x")).select("x.kind", F.col("x.text").alias("match"))
    return typed.select("kind", normal_form(F.col("kind"), F.col("match")).alias("normal"), "match").groupBy("kind", "normal").agg(F.min("match").alias("sample"))


def _tweaked(secret: str, tweak: Column) -> Column:
    return F.concat(F.lit(f"{secret}/"), tweak.cast("string"))


def _clashes(drawn: DataFrame) -> DataFrame:
    """(kind, normal) of (kind, normal, drawn) whose surrogate is taken by a smaller one, or is an entity's own value."""
    first = drawn.groupBy("kind", "drawn").agg(F.min("normal").alias("first"), F.count("*").alias("n")).where("n > 1")
    taken = drawn.join(first, ["kind", "drawn"]).where("normal <> first").select("kind", "normal")
    real = drawn.join(drawn.select("kind", F.col("normal").alias("drawn")), ["kind", "drawn"], "left_semi").select("kind", "normal")
    return taken.unionByName(real).distinct()


def keyed_entities(known: DataFrame, secret: str) -> DataFrame:
    """entities() with tweak, the number that keys each so that no two of a kind share a surrogate and none gets a real value."""
    spark = known.sparkSession
    spread = known.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "kind", "normal")
    draw = normal_form(F.col("kind"), surrogate(F.col("kind"), F.col("sample"), _tweaked(secret, F.col("tweak"))))
    drawn = materialize(spread.withColumn("tweak", F.lit(0)).withColumn("drawn", draw), "surrogates")
    for _ in range(MAX_ROUNDS):
        again = materialize(_clashes(drawn), "clashes")
        if not again.head(1):
            return drawn.drop("drawn")
        moved = drawn.join(again, ["kind", "normal"]).withColumn("tweak", F.col("tweak") + 1).withColumn("drawn", draw)
        drawn = materialize(drawn.join(again, ["kind", "normal"], "left_anti").unionByName(moved), "surrogates")
    raise ValueError("more entities than the surrogates of their kind can keep apart")


def replace_pii(docs: DataFrame, secret: str) -> DataFrame:
    """docs, all columns, with every detected entity of text replaced; repeated rows and equal entities get equal replacements.

    secret keys the replacements and is the caller's to keep. A null text stays null, an empty one empty; other columns, null
    or not, are kept as they are; an empty table stays empty.
    """
    text = F.col("text").cast("string")
    keyed = keyed_entities(materialize(entities(docs), "entities"), secret)
    anew = materialize(keyed.where("tweak > 0").select("kind", "normal", "tweak"), "keyed-anew")
    if not anew.head(1):
        return docs.withColumn("text", _replaced(text, lambda kind, match: F.lit(f"{secret}/0")))
    rows = row_keyed(docs, "__row")
    mentions = rows.select("__row", F.explode(F.transform(_matches(text), _mentions)).alias("xs")).select("__row", F.explode("xs").alias("x"))
    held = mentions.select("__row", "x.kind", normal_form(F.col("x.kind"), F.col("x.text")).alias("normal")).distinct().join(anew, ["kind", "normal"])
    name = F.concat_ws("\u0001", "kind", "normal")
    tweaks = held.groupBy("__row").agg(F.map_from_entries(F.collect_list(F.struct(name, "tweak"))).alias("__tweaks"))

    def key_of(kind: Column, match: Column) -> Column:
        mine = F.col("__tweaks")[F.concat_ws("\u0001", kind, normal_form(kind, match))]
        return _tweaked(secret, F.coalesce(mine, F.lit(0)))

    return rows.join(tweaks, "__row", "left").withColumn("text", _replaced(text, key_of)).drop("__row", "__tweaks")


def _replaced(text: Column, key_of: Callable[[Column, Column], Column]) -> Column:
    def one(match: Column) -> Column:
        def of(xs: Column) -> Column:
            new = F.transform(xs, lambda x: surrogate(x["kind"], x["text"], key_of(x["kind"], x["text"])))
            named = xs[0]["kind"].isin("family", "given-f", "given-m", "given-n")
            return F.concat(F.when(named, F.regexp_extract(match, r"^\S+ ", 0)).otherwise(""), F.array_join(new, " "))

        return _let(_mentions(match), of)

    def rebuilt(x: Column) -> Column:
        new = F.transform(x["matches"], one)
        return _let(new, lambda s: F.array_join(F.transform(x["gaps"], lambda g, i: F.concat(g, F.coalesce(F.get(s, i), F.lit("")))), ""))

    parts = F.struct(F.regexp_extract_all(text, F.lit(_ANY), F.lit(0)).alias("matches"), F.split(text, _ANY, -1).alias("gaps"))
    return F.when(text.rlike(_HINT), _let(parts, rebuilt)).otherwise(text)


#: What the registered query and the pipeline use in place of a secret.
QUERY_SECRET = "not a secret: for the registered queries only"


def op10_pii(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    counted = F.size(_matches(F.col("text"))).cast("long").alias("n_entities")
    return replace_pii(docs.select("doc_id", counted, "text"), QUERY_SECRET).select("doc_id", "n_entities", "text")
