"""Hard negatives and phrase collocations against brute force."""
import collections
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from logweave.llm import collocations, negatives


# hard negatives

SCHEMA = "vec_id long, embedding array<double>, label int, score long, anchor string, q int"


def _table(spark, rows):
    return spark.createDataFrame([(i, v, y, 1, "x", 2) for i, v, y in rows], SCHEMA)


def _mined(rows, every, positives=5, keep=10, low=30, high=90):
    """Brute force over all pairs, in Python integers."""
    q = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows
         if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for k, (a, va, ya) in enumerate(q):
        if a % every:
            continue
        s = [(-min(max(sum(x * y for x, y in zip(va, v)), -2 ** 63), 2 ** 63 - 1), i, y) for j, (i, v, y) in enumerate(q) if j != k]
        for sp, p, _ in sorted(x for x in s if x[2] == ya)[:positives]:
            found = sorted(x for x in s if x[2] != ya and low * -sp <= 100 * -x[0] <= high * -sp)[:keep]
            out += [(a, p, r, n, -sp, -sn) for r, (sn, n, _) in enumerate(found, 1)]
    return collections.Counter(out)


def _rows(df):
    return collections.Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("block", [20, 1000])
def test_negatives_brute_force(spark, block):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 0.5, 1.0]) for _ in range(6)], rng.choice([0, 0, 0, 1, 2])) for i in range(150)]
    df = _table(spark, rows)
    got = negatives.mine(df, "vec_id % 10 = 0", block=block)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = _mined(rows, 10)
    assert want and _rows(got) == want
    assert _rows(negatives.mine(df, F.col("vec_id") % 10 == 0, positives=1, negatives=2, low=50, high=100, block=block)) == _mined(rows, 10, 1, 2, 50, 100)


def test_negatives_odd_rows(spark):
    """Nulls, non-finite and huge components, empty and unlike vectors, ties, repeated rows and ids, a common vector."""
    same = [0.5, 0.25]
    rows = [(0, [1.0, 0.5], 1), (10, [1.0, 0.5], 1), (10, [1.0, 0.5], 1), (10, [0.5, 0.5], 2), (None, same, 1), (11, None, 1), (12, same, None), (13, [1.0, None], 1),
            (14, [float("nan"), 1.0], 1), (15, [float("inf"), 1.0], 2), (16, [], 1), (20, [], 2), (17, [1.0], 2), (18, [1.0, 0.5, 9.0], 1), (19, [0.0, 0.0], 2), (-10, [1.0, 1.0], 2),
            (21, [1e15, 1.0], 1), (30, [1e15, 1e15], 2), (22, [1e30, -1e30], 1)] + [(100 + i, same, i % 3) for i in range(40)]
    rows[-1] = (140, [-1.0, -1.0], 1)
    # components beyond 64 bits are held to them
    cut = [(i, v and [x if x is None or abs(x) < 2 ** 55 or not math.isfinite(x) else math.copysign(2 ** 55 * (1 - 1e-16), x) for x in v], y) for i, v, y in rows if i != 22]
    df = _table(spark, [r for r in rows if r[0] != 22])
    assert _rows(negatives.mine(df, "vec_id % 10 = 0", block=7)) == _mined(cut, 10)
    assert negatives.mine(_table(spark, rows), "vec_id % 10 = 0").count() > 0
    none = df.limit(0)
    assert negatives.mine(none, "vec_id % 10 = 0").count() == 0
    assert negatives.mine(df, "vec_id = 5").count() == 0


def test_negatives_text_labels_and_hot_label(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4).round(3).tolist(), 0 if i % 3 else 1) for i in range(90)]
    df = _table(spark, rows)
    named = df.withColumn("label", F.concat(F.lit("l"), F.col("label").cast("string")))
    assert _rows(negatives.mine(named, "vec_id % 10 = 0", block=16)) == _rows(negatives.mine(df, "vec_id % 10 = 0")) == _mined(rows, 10)


def test_first_keeps_ties_to_the_left():
    s = np.array([[5, 7, 7, 7, 1], [1, 1, 1, 1, 1]])
    ok = np.array([[True, True, False, True, True], [False, True, True, True, False]])
    assert negatives._first(s, ok, 2).tolist() == [[False, True, False, True, False], [False, True, True, False, False]]
    assert negatives.window_of(7, 30, 90) == (3, 6) and negatives.window_of(0, 30, 90) == (0, 0) and negatives.window_of(-7, 30, 90) == (-2, -7)


# collocations

def _phrases(rows, least=10, covered=50, top=2000):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        found = []
        for p, a in c.items():
            if len(p) == 1 or a < least:
                continue
            if len(p) == 2 and any(100 * c[q] >= covered * a for q in c if len(q) == 3 and c[q] >= least and (q[:2] == p or q[1:] == p)):
                continue
            score, _, l, r = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)]
    return collections.Counter(out)


def _docs(spark, rows):
    return spark.createDataFrame([(i, lang, text, 1, "n") for i, (lang, text) in enumerate(rows)], "doc_id long, lang string, text string, a int, n string")


@pytest.mark.parametrize("shards", [1, 4, 30])
def test_collocations_brute_force(spark, shards):
    rng = random.Random(7)
    some = ["of", "the", "New", "york", "é", "San", "x1", "l'a"]
    rows = []
    for i in range(120):
        words = [rng.choice(some) for _ in range(rng.randrange(0, 30))]
        rows.append((rng.choice(["en", "EN", None, "und"]), "".join(w + rng.choice([" ", " ", " ", "\t ", ", ", ".", "\n", " "]) for w in words)))
    rows += [("hot", "New York city is New York city, a a a a a a")] * 40 + [("hot", None), ("hot", ""), (None, " .,\n")]
    want = _phrases(rows)
    assert want and _rows(collocations.collocations(_docs(spark, rows), shards=shards).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")) == want
    assert _rows(collocations.collocations(_docs(spark, rows), shards=shards, least=25, covered=90, top=3)) == _phrases(rows, 25, 90, 3)


def test_collocations_ties_rare_and_empty(spark, none):
    """Many phrases of one score and count at the cut; a language below the support; no rows."""
    rows = [("en", f"{a}{b} z{b}{a}") for a, b in itertools.product("abcdef", "uvwxyz") for _ in range(10)] + [("rare", "one two")] * 9
    want = _phrases(rows, top=20)
    assert _rows(collocations.collocations(_docs(spark, rows), top=20)) == want and len(want) == 20
    assert collocations.collocations(none).count() == 0
    with pytest.raises(ValueError):
        collocations.collocations(none, shards=0)


def test_collocations_odd_and_long_texts(spark, odd):
    rows = [(r.lang, r.text) for r in odd.collect()]
    assert _rows(collocations.collocations(odd)) == _phrases(rows)
    long = [("en", " ".join(f"w{i * i % 97}" for i in range(250_000)) + " " + "y" * 100_000), ("en", "w1 w4")]
    assert _rows(collocations.collocations(_docs(spark, long), top=50)) == _phrases(long, top=50)
