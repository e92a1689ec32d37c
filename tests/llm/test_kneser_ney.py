"""Bigram model against a plain dictionary version."""
import collections
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from logweave.llm import hashstore, kneser_ney, words

SPLIT = re.compile(r"[\x20\x09-\x0D]+")


def _tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in SPLIT.split(low) if w] + ["</s>"]


def _discounts(times):
    t = [times.get(k, 0) for k in (1, 2, 3, 4)]
    if not all(t):
        return [0.5, 1.0, 1.5]
    y = t[0] / (t[0] + 2 * t[1])
    d = [1 - 2 * y * t[1] / t[0], 2 - 3 * y * t[2] / t[1], 3 - 4 * y * t[3] / t[2]]
    return d if 0 < d[0] <= 1 and 0 < d[1] <= 2 and 0 < d[2] <= 3 else [0.5, 1.0, 1.5]


def _brute(train, texts):
    count, pairs, ctx = collections.Counter(), collections.Counter(), collections.Counter()
    for t in train:
        w = _tokens(t)
        count.update(w)
        for a, b in zip(["<s>", *w], w):
            pairs[a, b] += 1
            ctx[a] += 1
    left = collections.Counter(b for _, b in pairs)
    after = collections.defaultdict(list)
    for (a, _), n in pairs.items():
        after[a].append(n)
    d = _discounts(collections.Counter(pairs.values()))
    e = _discounts(collections.Counter(left.values()))
    N, V, K = sum(count.values()), len(count), len(pairs)
    spare = sum(e[min(n, 3) - 1] for n in left.values())

    def p1(w):
        if not K:
            return 1 / (V + 1)
        n = left[w]
        return ((n - e[min(n, 3) - 1] if n else 0) + spare / (V + 1)) / K

    def p2(a, w):
        if not ctx[a]:
            return p1(w)
        n = pairs[a, w]
        return ((n - d[min(n, 3) - 1] if n else 0) + sum(d[min(k, 3) - 1] for k in after[a]) * p1(w)) / ctx[a]

    out = []
    for t in texts:
        w = _tokens(t)
        out.append((len(w), sum(count[x] > 0 for x in w), sum(math.log10((count[x] + 1) / (N + V + 1)) for x in w), sum(math.log10(p2(a, b)) for a, b in zip(["<s>", *w], w))))
    return N, V, out, p2, count


def _same(got, want):
    assert got["n_tokens"] == want[0] and got["n_known"] == want[1]
    assert got["base_score"] == pytest.approx(want[2], rel=1e-9, abs=1e-9) and got["score"] == pytest.approx(want[3], rel=1e-9, abs=1e-9)


def test_words():
    import pyarrow as pa

    texts = ["The the THE", None, "", " a\tb\x0bc \n", "é É x" + "y" * 5000, "É"]
    data, bounds = words.text_bytes(pa.array(texts))
    assert len(bounds) == 7 and bounds[1] == bounds[2] == bounds[3]
    start, end = words.spans(data, bounds, kneser_ney._WORD)
    found = [data[a:b].tobytes().decode() for a, b in zip(start, end)]
    assert found == [w for t in texts for w in (t or "").split()]
    h = words.hashes(data, start, end)
    assert h[0] == h[1] == h[2] and h[6] != h[7] and h[7] == h[-1] and len(set(h.tolist())) == 7
    # no word joins two texts, and a slice of a column hashes alike
    data, bounds = words.text_bytes(pa.array(["ab", "cd"]))
    assert len(words.spans(data, bounds, kneser_ney._WORD)[0]) == 2
    data, bounds = words.text_bytes(pa.array(texts).slice(3))
    assert np.array_equal(words.hashes(data, *words.spans(data, bounds, kneser_ney._WORD)), h[3:])


def test_store(tmp_path):
    keys = np.array([3, 9, 11], np.uint64)
    hashstore.write(str(tmp_path), "k", 0, keys)
    assert hashstore.find(hashstore.read(str(tmp_path), "k", 0), np.array([1, 9, 12], np.uint64)).tolist() == [-1, 1, -1]
    assert len(hashstore.read(str(tmp_path), "k", 1)) == 0
    assert np.array_equal(hashstore.unplanes(hashstore.planes(keys), "u8"), keys)
    k, v = hashstore.add_up([keys, keys[1:]], [np.array([1, 2, 3]), np.array([10, 20])])
    assert k.tolist() == [3, 9, 11] and v.tolist() == [1, 12, 23]


@pytest.mark.parametrize("hot", [False, True])
def test_scores(spark, sf, hot):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    if hot:     # one context before a third of all tokens, each time with another word
        more = spark.range(60).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(400)), lambda i: F.concat(F.lit("of w"), (i * 61 + F.col("id") % 7).cast("string")))).alias("text"))
        docs = docs.select("doc_id", "text").where("doc_id < 60").unionByName(more).repartition(4)
    rows = docs.select("doc_id", "text").collect()
    train = [r.text for r in rows if zlib.crc32(str(r.doc_id).encode()) % 7 != 2]
    N, V, want, p2, count = _brute(train, [r.text for r in rows])
    part = docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2)
    model = kneser_ney.train(part)
    assert (model.tokens, model.types) == (N, V)
    assert bool(len(model.hot)) or not hot
    got = collections.Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 5), round(r.score, 5)) for r in kneser_ney.score(docs, model, keep=["doc_id"]).collect())
    assert got == collections.Counter((r.doc_id, *w[:2], round(w[2], 5), round(w[3], 5)) for r, w in zip(rows, want))
    some = max(count, key=count.get)
    assert sum(p2(some, w) for w in count) + p2(some, "never seen") == pytest.approx(1)


def test_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 7 == 2 for r in rows}
    N, _, want, *_ = _brute([r.text for r in rows if not held[r.doc_id]], [r.text for r in rows])
    want = {r.doc_id: w for r, w in zip(rows, want)}
    got = kneser_ney.query(spark, sf).collect()
    assert len(got) == len(rows) and {r.train_tokens for r in got} == {N}
    for r in got:
        assert r.held_out == held[r.doc_id]
        _same(r, want[r.doc_id])


def test_odd_rows(spark, odd, none):
    model = kneser_ney.train(odd)
    rows = odd.collect()
    N, V, want, *_ = _brute([r.text for r in rows], [r.text for r in rows])
    assert (model.tokens, model.types) == (N, V)
    got = kneser_ney.score(odd, model, keep=["doc_id", "n", "sig"]).collect()
    assert sorted(round(r["score"], 6) for r in got) == sorted(round(w[3], 6) for w in want)
    assert {r["n"] for r in got} == {9}
    # nothing learned: every word has probability 1, none is known
    bare = kneser_ney.train(none)
    assert (bare.tokens, bare.types) == (0, 0)
    assert {(r["n_known"], r["score"], r["base_score"]) for r in kneser_ney.score(odd, bare, keep=["doc_id"]).collect()} == {(0, 0.0, 0.0)}
    assert kneser_ney.score(none, model, keep=["doc_id"]).count() == 0


def test_long_text(spark):
    """A text of over a megabyte, and a word of 100 000 characters."""
    text = " ".join(f"w{i * i % 9973}" for i in range(200_000)) + " " + "x" * 100_000
    docs = spark.createDataFrame([(1, text), (2, "w1 w4 unseen")], "doc_id long, text string")
    model = kneser_ney.train(docs.where("doc_id = 1"))
    _, _, want, *_ = _brute([text], [text, "w1 w4 unseen"])
    for r, w in zip(sorted(kneser_ney.score(docs, model, keep=["doc_id"]).collect()), want):
        _same(r, w)
