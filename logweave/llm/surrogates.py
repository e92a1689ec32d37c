"""Surrogate generation for personal data.

Detected entities are replaced by keyed surrogates of the same type and format:

* numbers (cards, phones, social security numbers, addresses of machines) by a keyed
  four-round Feistel permutation of their digits or octets. It is a bijection, so unlike
  numbers stay unlike by construction; separators, length, a phone's country digits and a
  card's check-digit property stay. One number gets one surrogate in every notation.
* e-mail addresses and titled person names by keyed syllables and names. A name keeps its
  title, hence gender, its script and its number of words; a later mention by title and
  surname alone gets the surname of the full mention, since surnames are mapped on their own.
  Their distinct values are gathered over the whole table and checked for collisions; a
  value that shares its surrogate with another, or meets a real value, is lengthened until
  none does. Of persons of one surname whose first names draw the same surrogate, all but
  one get a second, checked part behind a hyphen.

Native: DataFrame functions only. Equal entities have equal surrogates everywhere in the table
(and in every table under the same key). Texts without a sign of an entity run no costly
pattern and stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm.common import cut_lineage, documents, spread

KINDS = ("email", "card", "ssn", "phone", "ip", "name")
#: Titles with the gender of their bearer (fixed values).
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mademoiselle", "Señora", "Sra", "Señorita", "Госпожа", "Г-жа")
MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Г-н")
#: Surrogate first names by gender and script (fixed values).
FIRST = {
    ("f", "latin"): ("Alba", "Clara", "Dora", "Edith", "Flora", "Greta", "Helena", "Irma", "Julia", "Lena", "Marta", "Nora", "Olga", "Paula", "Rosa", "Vera"),
    ("m", "latin"): ("Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Leon", "Martin", "Oscar", "Paul", "Robert", "Simon", "Victor"),
    ("f", "cyrillic"): ("Анна", "Вера", "Дарья", "Елена", "Жанна", "Зоя", "Инна", "Клара", "Лидия", "Мария", "Нина", "Ольга", "Полина", "Раиса", "Софья", "Юлия"),
    ("m", "cyrillic"): ("Антон", "Борис", "Виктор", "Глеб", "Давид", "Егор", "Захар", "Иван", "Кирилл", "Лев", "Максим", "Никита", "Олег", "Павел", "Роман", "Юрий"),
}
#: Syllables of surrogate surnames and mail names (fixed values).
SYLLABLES = {
    "latin": ("ba", "be", "da", "do", "fa", "fi", "ga", "ha", "ka", "ko", "la", "le", "ma", "mo", "na", "ne", "pa", "pe", "ra", "ro", "sa", "se", "ta", "ti", "va", "ve", "wa", "wi", "za", "zo", "lu", "ru"),
    "cyrillic": ("ба", "бе", "ва", "ве", "га", "да", "до", "за", "зо", "ка", "ко", "ла", "ле", "ма", "мо", "на", "не", "па", "пе", "ра", "ро", "са", "се", "та", "ти", "фа", "фо", "ха", "ча", "ша", "лу", "ру"),
}
EMAIL = r"[\p{L}\p{N}._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
CARD = r"\b[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}\b"
SSN = r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"
PHONE = r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}\b|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}\b"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
IP = rf"\b{_OCTET}(?:\.{_OCTET}){{3}}\b"
_TITLE = "(?:" + "|".join(sorted(FEMALE + MALE + ("Dr", "Prof"), key=lambda x: (-len(x), x))) + r")\.?"
NAME = rf"\b{_TITLE} \p{{Lu}}[\p{{L}}'-]+(?: \p{{Lu}}[\p{{L}}'-]+)?"
ANY = "|".join(f"(?:{p})" for p in (EMAIL, IP, CARD, SSN, PHONE, NAME))


def _number(key: str, salt: str, x):
    """48 keyed bits as a long."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(key + salt), x.cast("string"))), 1, 12), 16, 10).cast("long")


def _let(value, body):
    return F.transform(F.array(value), body)[0]


def _power(n):
    return F.get(F.array(*[F.lit(10 ** i) for i in range(12)]), n)


def _feistel(key: str, a, b, size_a, size_b):
    """Keyed bijection of (a mod size_a, b mod size_b)."""
    state = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    for r in range(4):
        if r % 2:
            step = lambda s, r=r: F.struct(s["a"].alias("a"), ((s["b"] + _number(key, f"/{r}/", s["a"])) % size_b).alias("b"))
        else:
            step = lambda s, r=r: F.struct(((s["a"] + _number(key, f"/{r}/", s["b"])) % size_a).alias("a"), s["b"].alias("b"))
        state = _let(state, step)
    return state


def _digits(key: str, d):
    """Permuted digits of a string of 2 to 20 digits."""
    half = F.floor(F.length(d) / 2).cast("int")
    rest = F.length(d) - half
    out = _feistel(key, F.substring(d, F.lit(1), half), F.substring(d, half + 1, rest), _power(half), _power(rest))
    return _let(out, lambda s: F.concat(F.lpad(s["a"].cast("string"), half, "0"), F.lpad(s["b"].cast("string"), rest, "0")))


def _luhn(d):
    """Check digit for a string of 15 digits."""
    at = lambda i: F.substring(d, i, F.lit(1)).cast("int")
    total = F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda s, i: s + F.when(i % 2 == 1, at(i) * 2 - F.when(at(i) > 4, 9).otherwise(0)).otherwise(at(i)))
    return F.pmod(-total, F.lit(10))


def _into_format(entity, digits):
    """``digits`` in the places of the entity's digits."""
    shape = F.regexp_replace(entity, "[0-9]", "\u0000")
    parts = F.split(shape, "\u0000")
    return F.array_join(F.zip_with(parts, F.split(digits, ""), lambda p, c: F.concat(F.coalesce(p, F.lit("")), F.coalesce(c, F.lit("")))), "")


def _syllables(key: str, script: str, value, n: int):
    """``n`` keyed syllables."""
    table = F.array(*map(F.lit, SYLLABLES[script]))
    h = F.md5(F.concat(F.lit(key + "/syllables/"), value))
    return F.concat(*[F.get(table, F.conv(F.substring(h, 2 * i + 1, 2), 16, 10).cast("int") % 32) for i in range(n)])


def _kind(e):
    return (F.when(F.contains(e, F.lit("@")), "email").when(e.rlike(rf"^{IP}\z"), "ip").when(e.rlike(rf"^{CARD}\z"), "card")
            .when(e.rlike(rf"^{SSN}\z"), "ssn").when(e.rlike(r"^[+(]"), "phone").otherwise("name"))


def _words(e):
    """What is mapped on its own in an entity: an address, a first name, a surname, and the
    two names together."""
    parts = F.split(e, " ")
    return (F.when(_kind(e) == "email", F.array(F.lower(e)))
            .when((_kind(e) == "name") & (F.size(parts) == 3), F.array(parts[1], F.get(parts, F.lit(2)), F.concat_ws(" ", parts[1], F.get(parts, F.lit(2)))))
            .when(_kind(e) == "name", F.slice(parts, 2, 1)).otherwise(F.array().cast("array<string>")))


def _first_pick(key: str, first):
    """Place of a first name's surrogate in its list of 16."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(key + "/first/"), first)), 1, 6), 16, 10).cast("int") % 16


def _word_surrogate(key: str, word, tries):
    """Surrogate of an address or surname; each further try has two more syllables."""
    cyrillic = word.rlike(r"^\p{IsCyrillic}")
    out = None
    for t in range(4):
        made = (F.when(F.contains(word, F.lit("@")), F.concat(_syllables(key, "latin", word, 5 + 3 * t), F.lit("@mail.example.org")))
                .when(cyrillic, F.initcap(_syllables(key, "cyrillic", word, 3 + 3 * t))).otherwise(F.initcap(_syllables(key, "latin", word, 3 + 3 * t))))
        out = made if out is None else F.when(tries >= t, made).otherwise(out)
    return out


def _replace(key: str, e, tries):
    """Surrogate of an entity; ``tries(word)`` says how often a word's surrogate was taken."""
    digits = F.regexp_replace(e, "[^0-9]", "")
    card = _let(digits, lambda d: _let(_digits(key + "/card", F.substring(d, 1, 15)), lambda f: F.concat(
        f, ((_luhn(f) + F.substring(d, 16, 1).cast("int") - _luhn(F.substring(d, 1, 15)) + 10) % 10).cast("string"))))
    phone = _let(digits, lambda d: _let(F.greatest(F.lit(1), F.length(d) - 10), lambda k: F.concat(
        F.substring(d, F.lit(1), k), _digits(key + "/phone", F.substring(d, k + 1, F.length(d) - k)))))
    octet = lambda i: F.split(e, r"\.")[i].cast("int")
    ip = _let(_feistel(key + "/ip", octet(0) * 256 + octet(1), octet(2) * 256 + octet(3), F.lit(65536), F.lit(65536)), lambda s: F.concat_ws(
        ".", F.floor(s["a"] / 256), s["a"] % 256, F.floor(s["b"] / 256), s["b"] % 256))
    parts = F.split(e, " ")
    title = F.regexp_replace(parts[0], r"\.$", "")
    def first(w):
        pick = _first_pick(key, w)
        female = title.isin(*FEMALE) | (~title.isin(*MALE) & (F.conv(F.substring(F.md5(F.concat(F.lit(key + "/sex/"), w)), 1, 2), 16, 10).cast("int") % 2 == 0))
        name = lambda g, s: F.get(F.array(*map(F.lit, FIRST[g, s])), pick)
        return F.when(w.rlike(r"^\p{IsCyrillic}"), F.when(female, name("f", "cyrillic")).otherwise(name("m", "cyrillic"))).otherwise(F.when(female, name("f", "latin")).otherwise(name("m", "latin")))
    surname = lambda w: _word_surrogate(key, w, tries(w))
    person = F.when(F.size(parts) == 3, F.concat_ws(" ", parts[0], F.when(
        tries(F.concat_ws(" ", parts[1], parts[2])) > 0, F.concat_ws("-", first(parts[1]), surname(parts[1]))).otherwise(first(parts[1])), surname(parts[2]))).otherwise(F.concat_ws(" ", parts[0], surname(F.get(parts, F.lit(1)))))
    kind = _kind(e)
    return (F.when(kind == "email", _let(F.lower(e), lambda w: _word_surrogate(key, w, tries(w)))).when(kind == "ip", ip).when(kind == "card", _into_format(e, card))
            .when(kind == "ssn", _into_format(e, _digits(key + "/ssn", digits))).when(kind == "phone", _into_format(e, phone)).otherwise(person))


def _suspect(t):
    """Whether a text can hold an entity at all."""
    titles = F.contains(t, F.lit("Mr"))
    for x in ("Ms", "Miss ", "Frau ", "Herr ", "Madame ", "Mme", "Mademoiselle ", "Monsieur ", "Señor", "Sr", "Dr", "Prof", "Госпо", "Г-"):
        titles = titles | F.contains(t, F.lit(x))
    return F.contains(t, F.lit("@")) | t.rlike(r"[0-9][0-9 ().-]{5}") | titles


def taken_words(docs: DataFrame, *, text: str, key: str) -> DataFrame:
    """(word, tries) of the addresses and names whose first surrogate is not theirs alone;
    of full names, those whose first name needs its second part.

    Of several words with one surrogate the first by code point keeps it; the others, and
    words whose surrogate is itself a word of the table, get the next try. Tries have unlike
    lengths, so later ones cannot meet earlier ones.
    """
    t = F.col(text)
    found = docs.where(t.isNotNull() & _suspect(t)).select(F.explode(F.regexp_extract_all(t, F.lit(ANY), F.lit(0))).alias("e"))
    word = found.where(_kind(F.col("e")).isin("email", "name")).select(F.explode(_words(F.col("e"))).alias("word")).distinct()
    word = cut_lineage(word)
    name = F.split("word", " ")
    full = word.where(F.contains(F.col("word"), F.lit(" "))).select("word", name[1].alias("last"), name[0].rlike(r"^\p{IsCyrillic}").alias("script"), _first_pick(key, name[0]).alias("pick"))
    shared = full.groupBy("last", "script", "pick").agg(F.min("word").alias("owner"))
    full = full.join(shared, ["last", "script", "pick"]).where("word <> owner").select("word", F.lit(1).alias("tries"))
    word = word.where(~F.contains(F.col("word"), F.lit(" ")))
    real = word.select(F.col("word").alias("s"))
    open_, out = word.withColumn("tries", F.lit(0)), None
    for t in range(3):
        made = open_.withColumn("s", _word_surrogate(key, F.col("word"), F.col("tries")))
        owner = made.groupBy("s").agg(F.min("word").alias("owner"), F.count("*").alias("n")).where("n > 1")
        met = made.join(owner, "s", "left").join(real.withColumn("hit", F.lit(True)), "s", "left")
        open_ = cut_lineage(met.where(F.col("hit").isNotNull() | (F.col("owner") != F.col("word"))).select("word", (F.col("tries") + 1).alias("tries")))
        out = open_ if out is None else out.union(open_)
        if open_.isEmpty():
            break
    return cut_lineage(out.union(full).groupBy("word").agg(F.max("tries").alias("tries")))


def pseudonymise(docs: DataFrame, *, text: str = "text", key: str = "corpus", as_col: str | None = None) -> DataFrame:
    """All columns of ``docs`` with surrogates in ``text`` (or in a new column ``as_col``, which
    replaces one of that name), and ``entities``, the list of (kind, entity, surrogate).

    A null text stays null with an empty list; a text without entities stays as it is. Whole
    texts are searched; matches are leftmost and do not overlap; repeated rows change alike.
    """
    key = key + "/"
    words = taken_words(docs.select(text), text=text, key=key)
    t = F.col(text)
    docs = docs.drop("entities", "__e", "__tries")
    found = docs.withColumn("__e", F.when(t.isNotNull() & _suspect(t), F.regexp_extract_all(t, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>")))
    if words.isEmpty():
        tries = lambda w: F.lit(0)
    else:
        # texts with such a word get a map of their tries; joined by size: no hint
        at = found.where(F.size("__e") > 0).select(F.sha2(t, 256).alias("h"), F.explode(F.flatten(F.transform("__e", _words))).alias("word")).join(words, "word")
        at = cut_lineage(at.groupBy("h").agg(F.map_from_entries(F.collect_set(F.struct("word", "tries"))).alias("__tries")))
        found = found.withColumn("__h", F.when(F.size("__e") > 0, F.sha2(t, 256))).join(at.withColumnRenamed("h", "__h"), "__h", "left").drop("__h")
        tries = lambda w: F.coalesce(F.try_element_at(F.col("__tries"), w), F.lit(0))
    found = found.withColumn("entities", F.transform("__e", lambda e: F.struct(_kind(e).alias("kind"), e.alias("entity"), _replace(key, e, tries).alias("surrogate"))))
    made = F.when(F.size("__e") == 0, t).otherwise(F.array_join(F.zip_with(F.split(t, ANY), F.transform("entities", lambda x: x["surrogate"]), lambda p, s: F.concat(p, F.coalesce(s, F.lit("")))), ""))
    return found.withColumn(as_col or text, made).drop("__e", "__tries")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: every document with its personal data replaced."""
    out = pseudonymise(spread(documents(spark, sf_dir).select("doc_id", "text")))
    count = lambda k: F.size(F.filter("entities", lambda x: x["kind"] == k)).cast("long").alias("n_" + k)
    return out.select("doc_id", *map(count, KINDS), "text")
