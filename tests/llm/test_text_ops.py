"""Language id, quality, secrets, toxicity, PII: odd tables and brute force."""
import hashlib
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from logweave.llm import langid, quality, secrets, surrogates, toxicity

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def test_forward_sums_all_segmentations():
    p = langid._pieces(PIECES)
    rng = np.random.default_rng(0)
    prob = np.where(p.final, rng.random(len(p.final)), 0)
    prob /= prob.sum()
    scaled = (prob * langid._SCALE ** p.depth.astype(float))[:, None]

    def brute(codes):
        if not codes:
            return 1.0
        total, at = 0.0, 0
        for m, k in enumerate(codes, 1):
            at = p.step[at, k]
            if not at:
                break
            total += prob[at] * brute(codes[m:])
        return total

    for word in ("house", "straße", "日本", "a", "thththth"):
        (_, codes), = p.encode([word]).values()
        assert np.isclose(p.forward(codes, scaled)[0][0, 0], np.log(brute(codes[0].tolist())))


def test_langid_long_runs_teach():
    """One round over runs of 3 to 150 letters equals unscaled forward and backward sums."""
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdeinorst"), n)) for n in (3, 31, 32, 33, 64, 100, 150)]
    n_of = np.arange(1, len(words) + 1, dtype=float)
    pieces = langid._pieces(PIECES)
    got = np.exp(pieces.em(words, n_of, 1))
    known = pieces.final.nonzero()[0]
    q = np.where(pieces.final, 1.0 / len(known), 0.0) * langid._SCALE ** pieces.depth.astype(float)
    expect = np.zeros(len(q))
    for at, codes in pieces.encode(words).values():
        for row, c in zip(at, codes):
            arcs = [(i, i + m, int(k[0])) for i, m, _, k in pieces.arcs(c[None, :])]
            a, b = np.zeros(len(c) + 1, np.longdouble), np.zeros(len(c) + 1, np.longdouble)
            a[0] = b[-1] = 1
            for i, j, k in sorted(arcs):
                a[j] += a[i] * q[k]
            for i, j, k in sorted(arcs, reverse=True):
                b[i] += b[j] * q[k]
            for i, j, k in arcs:
                expect[k] += float(a[i] * q[k] * b[j] / a[-1] * n_of[row])
    want = np.where(pieces.final, expect + 0.01, 0.0)
    assert np.allclose(got, np.maximum(want / want.sum(), 1e-300), rtol=1e-5)


def test_langid_odd_rows(spark, odd, none, sf):
    model = langid.learn(odd, PIECES)
    rows = langid.predict(odd, model, PIECES, keep=("doc_id", "lang")).collect()
    assert len(rows) == odd.count()
    got = {r.doc_id: r for r in rows}
    assert got[2].lang_pred == got[3].lang_pred == "und" and got[5].lang_pred == "de" and got[0].lang_pred == "en"
    assert langid.learn(none, PIECES) == [] and langid.predict(odd, [], PIECES).where("lang_pred <> 'und'").count() == 0
    assert langid.predict(none, model, PIECES).count() == 0


def test_langid_held_out_accuracy(spark, sf):
    lang = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    held = langid.query(spark, sf).where("held_out").join(lang, "doc_id")
    assert held.where("lang = lang_pred").count() >= 0.95 * held.count()


def _repeat(words):
    grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    many = {g for g in grams if grams.count(g) > 1}
    return len({i + k for i, g in enumerate(grams) if g in many for k in range(5)})


def test_quality_counts(spark, odd, none):
    text = "a b c d e f\nx y a b c d e g.\n\na b c d e f\n#! <b> | é"
    more = spark.createDataFrame([(100, text, "en", "a", 1, 1, "x", 0.1, 1)], odd.schema)
    table = odd.union(more)
    texts = [r.text or "" for r in table.collect()]
    for t, r in zip(texts, quality.clean_lines(table).collect()):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert r.n_words == len(w) and r.word_chars == sum(map(len, w)) and r.n_symbols == sum(t.count(c) for c in "#*$%&|<>")
        assert r.n_dup_lines == len(lines) - len(set(lines)) and r.n_repeat_words == _repeat(w)
        assert r.base_failed == (len(w) < 10 or 100 * _repeat(w) > 20 * len(w)) and not (r.base_failed and r.kept)
    assert quality.clean_lines(none).count() == 0
    menu = spark.createDataFrame([("Home | News | About | Login\nThis is a fine sentence of text.",)], "text string")
    assert quality.clean_lines(menu).first().clean_text == "This is a fine sentence of text."


def test_secrets_brute_force(spark, odd, none):
    key = "AKIA" + "Q7Z2" * 5
    texts = ["x token=abcdefé Password : 'ab' secret=api_key: abcdefgh", key + " " + "0af3" * 8, "plain words only here",
             "see Zq8xK2vB7nM4wR9tY6uP3sD1 now", "AKIA12 " + "e" * 23, None, ""]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, secrets int")
    table = secrets.train(docs.union(odd.select("doc_id", "text", F.lit(1))))
    rows = secrets.scan(docs, table).orderBy("doc_id").collect()
    for t, r in zip(texts, rows):
        t = t or ""
        want = sorted([(m.start(), 0, m.end()) for m in re.finditer(secrets.ASSIGN, t) if len(m[2]) >= 6]
                      + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
                      + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24])
        assert [(s.start, s.kind, s.end) for s in r.secrets if s.kind < 3] == want
    assert [s.kind for s in rows[3].secrets] == [3] and not rows[2].secrets and not rows[5].secrets and not rows[6].secrets
    assert secrets.scan(none, secrets.train(none)).count() == 0


def test_secret_models_count_every_document(spark):
    """Keys do not choose what is learned, and 16 to 19 random characters are scored."""
    rng = np.random.default_rng(6)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    rows = [(i, " ".join("".join(rng.choice(letters[i % 20:], 8)) for _ in range(5)) + f" token={rng.bytes(9).hex()}") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = secrets.train(docs)
    assert table == secrets.train(docs.withColumn("doc_id", F.col("doc_id") + 10**6))
    short = spark.createDataFrame([("see Zq8xK2vB7nM4wR9t now or wordsofplainletter",)], "text string")
    assert [(s.kind, s.start, s.end) for s in secrets.scan(short, table).first().secrets] == [(3, 4, 20)]


def test_secret_query_hash(spark):
    r = secrets.query(spark, "/root/testdata/sf0.01").where("n_assign + n_access + n_hex > 0").first()
    base = ",".join(s for s in r.spans.split(",") if not s.startswith("markov"))
    assert hashlib.sha256(base.encode()).hexdigest() == r.base_sha256


def test_toxicity(spark, odd, none):
    rng = np.random.default_rng(1)
    plain = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choice(plain, 40)) + (" you idiot" if i % 4 == 0 else ""), "en", int(i % 4 == 0)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    net = toxicity.learn(docs.where("doc_id < 300"), docs.where("doc_id < 300"))
    held = toxicity.score(docs.where("doc_id >= 300"), net)
    assert held.where((F.col("score") >= 0.5) == (F.col("toxic") == 1)).count() >= 97
    out = toxicity.score(odd, net)
    assert out.columns == [c for c in odd.columns if c != "score"] + ["score"] and out.where("score between 0 and 1").count() == odd.count()
    assert toxicity.learn(odd, docs.limit(0)) is None and toxicity.score(odd, None).where("score <> 0").count() == 0
    assert toxicity.score(none, net).count() == 0


def test_toxicity_calibrates_on_all_labels(spark):
    """A language with a handful of rows in the training sample has a threshold of its own."""
    rng = np.random.default_rng(2)
    rows = []
    for i in range(1600):
        lang = "xx" if i % 20 < 2 else "en"
        words = [f"{lang}{w}" for w in rng.integers(0, 200, 30)]
        rows.append((i, " ".join([*words, "you", "idiot"] if i % 2 else words), lang, i % 2))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    net = toxicity.learn(docs, docs, per_class=100)
    assert net.threshold[0] != net.threshold[1]
    out = toxicity.score(docs, net)
    assert out.where((F.col("score") >= 0.5) == (F.col("toxic") == 1)).count() >= 1568


def test_toxicity_learns_from_whole_texts(spark):
    """Insults that stand behind the 3000th word teach and calibrate too."""
    rng = np.random.default_rng(4)
    rows = [(i, " ".join([*(f"w{w}" for w in rng.integers(0, 300, 3100)), *(("you", "idiot") if i % 2 else ())]), "en", i % 2) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    out = toxicity.score(docs, toxicity.learn(docs, docs))
    assert out.where((F.col("score") >= 0.5) == (F.col("toxic") == 1)).count() >= 117


def _luhn(d):
    return sum(int(c) if i % 2 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(d)) % 10


def test_surrogates(spark, odd, none):
    texts = ["Mail bob.x@mail2.example.com or BOB.X@mail2.example.com, call +1 (017) 555-7713 or +10175557713.",
             "Mr. John Smith met Mrs Anna Smith and Dr Smith. Госпожа Анна Петрова.", "4111 1111 1111 1111 or 4111111111111111 ip 10.0.0.1 ssn 123-45-6789",
             None, "", "clean text 12 and 4.0."]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, entities int")
    got = {r.doc_id: r for r in surrogates.pseudonymise(docs).collect()}
    mail = [e.surrogate for e in got[0].entities]
    assert mail[0] == mail[1] and re.sub(r"\D", "", mail[2]) == re.sub(r"\D", "", mail[3]) and re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", mail[2])
    names = [e.surrogate for e in got[1].entities]
    assert names[0].split()[-1] == names[1].split()[-1] == names[2].split()[-1] and names[0].split()[1] in surrogates.FIRST["m", "latin"]
    assert names[1].split()[1] in surrogates.FIRST["f", "latin"] and names[3].split()[1] in surrogates.FIRST["f", "cyrillic"]
    cards = [e.surrogate for e in got[2].entities]
    assert cards[0].replace(" ", "") == cards[1] and _luhn(cards[1]) == 0
    assert got[3].text is None and got[4].text == "" and got[5].text == texts[5]
    assert not any(s in (got[i].text or "") for i in range(3) for s in ("bob", "555-7713", "Smith", "4111", "10.0.0.1", "123-45"))
    assert surrogates.pseudonymise(none).count() == 0 and surrogates.pseudonymise(odd).count() == odd.count()


def test_numbers_stay_distinct(spark):
    docs = spark.range(3000).select(F.concat(F.lit("+1 (555) 010-"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("text"))
    docs = docs.union(spark.range(3000).select(F.concat(F.lit("m"), F.col("id").cast("string"), F.lit("@x.example.com"))))
    out = surrogates.pseudonymise(docs)
    assert out.select("text").distinct().count() == 6000


@pytest.mark.parametrize("columns", [["doc_id", "text"]])
def test_collisions_are_resolved(spark, monkeypatch, columns):
    """With a table of one syllable all first tries meet; lengthening cannot help there, so two."""
    monkeypatch.setitem(surrogates.SYLLABLES, "latin", ("ba", "ko") * 16)
    docs = spark.range(12).select(F.concat(F.lit("p"), F.col("id").cast("string"), F.lit("@x.example.com")).alias("text"))
    assert surrogates.pseudonymise(docs).select("text").distinct().count() == 12


def test_surrogates_keep_persons_of_one_surname_apart(spark):
    firsts = [a + b for a in ("An", "Be", "Ca", "Do", "El") for b in ("na", "lla", "ra", "ris", "min", "to", "sa", "ko")]
    docs = spark.createDataFrame([(i, f"Mr {f} Miller met Mr {f} Miller and Mr Miller.") for i, f in enumerate(firsts)], "doc_id long, text string")
    rows = [[e.surrogate for e in r.entities] for r in surrogates.pseudonymise(docs).collect()]
    assert len({r[0] for r in rows}) == len(firsts) > 16
    assert all(r[0] == r[1] and r[0].split()[-1] == r[2].split()[-1] for r in rows)
    assert all(r[0].split()[1].split("-")[0] in surrogates.FIRST["m", "latin"] for r in rows)


def test_toxicity_network_is_not_trained_on_the_driver(spark, monkeypatch):
    def driver(*a, **k):
        raise AssertionError("trained on the driver")

    monkeypatch.setattr(toxicity, "fit", driver)
    docs = spark.createDataFrame([(i, ("vile bad " if i % 2 else "kind good ") + f"word{i % 7}", "en") for i in range(60)], "doc_id long, text string, lang string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    net, seen = toxicity.train(docs, marks)
    assert net is not None and 0 < seen.count() <= 60
    net, seen = toxicity.train(docs.where("doc_id > 100"), marks)
    assert net is None and seen.count() == 0
