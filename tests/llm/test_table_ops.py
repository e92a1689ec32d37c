"""Near duplicates, mixing, fingerprints, perspectives, packing and the pipeline."""
import collections
import os
import sys
import uuid
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from logweave.llm import fingerprint, mixing, ngram_join, packing, perspectives

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
TOKENS = public_tokenizers.path("word_bpe_49k.json")


def _components(texts):
    sets = [frozenset(map(int, ngram_join.shingle_set(t))) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def test_shingles():
    words = "A b c D e f".split()
    assert len(ngram_join.shingle_set("A b\tc D\x0be f")) == 2
    assert set(ngram_join.shingle_set("a B C d e")) < set(ngram_join.shingle_set(" ".join(words)))
    assert len(ngram_join.shingle_set("one two")) == 1 and len(ngram_join.shingle_set(" \n")) == 0 and len(ngram_join.shingle_set(None)) == 0
    assert ngram_join.shingle_set("É")[0] != ngram_join.shingle_set("é")[0]     # only A-Z are lower-cased


def test_join_hot_clusters(spark):
    """Copies of copies, edited at random: hot tokens, several pivots, links far from them."""
    rng, texts = np.random.default_rng(5), []
    for family in range(3):
        base = [f"w{family}x{i}" for i in range(60)]
        for _ in range(60):
            t = list(base)
            for at in rng.choice(60, rng.integers(0, 5), replace=False):
                t[at] = f"e{rng.integers(0, 6)}" if rng.random() < 0.7 else f"r{rng.integers(0, 10**6)}"
            if rng.random() < 0.3:
                t = t[rng.integers(0, 8):]
            texts.append(" ".join(t))
            if rng.random() < 0.4:       # a chain: the next copies start from this one
                base = t + base[len(t):]
    want = _components(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert len(set(want)) > 5
    for dense in (2, 5):
        assert [r.component_id for r in ngram_join.join_components(docs, dense=dense).orderBy("doc_id").collect()] == want


@pytest.mark.parametrize("dense", [1, 40])
def test_join_brute_force(spark, dense):
    rng = np.random.default_rng(2)
    passage = [f"p{i}" for i in range(40)]
    texts = []
    for c in range(6):
        base = [f"w{x}" for x in rng.integers(0, 500, 60)]
        for k in range(9):
            t = list(base)
            for _ in range(int(rng.integers(0, 4))):
                t[int(rng.integers(0, len(t)))] = f"e{rng.integers(0, 9)}"
            texts.append(" ".join(t[: 60 - k % 3] + (passage if c < 3 else [])))
    texts += ["one two", "one TWO", None, "", " "]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n int")
    got = {r.doc_id: r for r in ngram_join.join_components(docs, dense=dense).collect()}
    assert [got[i].component_id for i in range(len(texts))] == _components(texts)


def test_join_odd_rows(odd, none):
    rows = ngram_join.join_components(odd).collect()
    assert len(rows) == odd.count()
    assert {r.component_id for r in rows if r.doc_id in (0, 1)} == {0} and {r.n_shingles for r in rows if r.doc_id in (2, 3)} == {0}
    assert ngram_join.join_components(none).count() == 0


def test_targets(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 100), ("c", 50), (None, 40)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    want, full, open_ = {}, {}, {"a": 5.0, "b": 2.0, "c": 1.0, None: 5.0}
    limit, left = {"a": 20.0, "b": 200.0, "c": 100.0, None: 80.0}, 300.0
    while True:
        level = left / sum(open_.values())
        over = [s for s in open_ if open_[s] * level > limit[s]]
        if not over:
            break
        for s in over:
            full[s] = limit[s]
            left -= limit[s]
            del open_[s]
    want = full | {s: w * level for s, w in open_.items()}
    assert all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_mix_meets_targets(spark, odd, none, sf):
    out = mixing.query(spark, sf)
    rows = out.join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source"), "doc_id").groupBy("source").agg(
        F.first("target").alias("t"), F.sum("taken").alias("k"), F.max(F.col("taken") - 2 * F.col("size")).alias("over"))
    assert all(abs(r.k - r.t) <= 0.05 * r.t and r.over <= 0 for r in rows.collect())
    got = mixing.mix(odd)
    assert got.count() == odd.count() and got.where("copies < 0 or copies > 2").count() == 0 and "lang" in got.columns
    assert mixing.mix(none).count() == 0


def test_mix_settles_with_all_documents_it_takes(spark):
    """One long document rounds up; 2000 short ones make good for it, no fewer."""
    docs = spark.range(5001).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 0, F.repeat(F.lit("w "), 50_000)).otherwise(F.repeat(F.lit("w "), 10)).alias("text"), F.lit("a").alias("source"))
    out = mixing.mix(docs, share=1.3)
    r = out.agg(F.first("target").alias("t"), F.sum(F.col("copies") * F.col("size")).alias("k"), F.min("copies").alias("lo"), F.max("copies").alias("hi"), F.count("*").alias("n")).first()
    assert abs(r.k - r.t) < 10 and r.n == 5001 and 0 <= r.lo and r.hi <= 2


def test_fingerprints_shift_and_batch():
    rng = np.random.default_rng(3)
    text = "".join(rng.choice(list("abcdefgh ijk"), 4000))
    alone = fingerprint.fingerprints([text])[0]
    assert fingerprint.fingerprints(["xx", text, "", text])[1] == alone and fingerprint.fingerprints(["", "a"])[0] == "-"
    moved = fingerprint.fingerprints(["prefix of other length " + text])[0]
    assert fingerprint.likeness(alone, moved) > 0.8
    assert fingerprint.likeness(alone, fingerprint.fingerprints(["".join(rng.choice(list("abcdefgh ijk"), 4000))])[0]) < 0.1
    assert fingerprint.fingerprints(["a" * 50])[0] != fingerprint.fingerprints(["a" * 51])[0]


def test_edits_brute_force(spark, odd):
    """Next rows and edits over several partitions, with repeated and null ids and a long text."""
    import hashlib

    rng = np.random.default_rng(5)
    rows = [(int(i), "".join(rng.choice(list("abcé  \n"), int(rng.integers(0, 60))))) for i in rng.permutation(300)]
    rows += [(7, "same"), (7, "same"), (None, "n"), (None, None), (301, ""), (302, "x y " * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = fingerprint.compare_edits(docs).collect()
    h = {r.t: r.h for r in spark.createDataFrame([(t or "",) for _, t in rows], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), h[r[1]], r[1]))
    want = []
    for (i, t), (_, o) in zip(order, order[1:] + order[:1]):
        z = t[:len(t) - len(t) // 3] + o[:len(t) // 3]
        f, g, n = fingerprint.fingerprints([t, z, o])
        want.append((i, len(t), hashlib.sha256(z.encode()).hexdigest(), f, g, fingerprint.likeness(f, g), fingerprint.likeness(f, n)))
    assert collections.Counter(map(tuple, got)) == collections.Counter(want)
    one = docs.where("doc_id = 301")
    assert [tuple(r)[:2] for r in fingerprint.compare_edits(one).collect()] == [(301, 0)]


def test_phrase_names_are_local():
    rng = np.random.default_rng(4)
    s = rng.integers(0, 50, 3000).astype(np.uint64)
    with np.errstate(over="ignore"):
        a, _ = fingerprint._level(s, np.array([0]))
        b, _ = fingerprint._level(np.concatenate([np.array([7, 9, 11], np.uint64), s]), np.array([0]))
    assert len(set(a.tolist()) & set(b.tolist())) >= len(set(a.tolist())) - 4


def test_edits(spark, odd, none, sf):
    got = {r.doc_id: r for r in fingerprint.query(spark, sf).collect()}
    docs = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()), reverse=True)
    import hashlib

    for (i, t), (_, o) in zip(docs, docs[1:] + docs[:1]):
        edited = t[:len(t) - len(t) // 3] + o[:len(t) // 3]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    assert np.mean([r.near_edited > r.near_next for r in got.values()]) > 0.95
    assert fingerprint.compare_edits(odd).count() == odd.count() and fingerprint.compare_edits(none).count() == 0


def test_perspectives(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 300, "ann", "bye"), (1, 300, "ann", "bye"), (2, None, None, "x"), (None, 1, "ann", "y")]
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, start int")
    seg = perspectives.rotate(turns)
    whole = {(r.conv_id, r.perspective): r for r in perspectives.assemble(seg).collect()}
    assert set(whole) == {(1, "ann"), (1, "bob"), (2, "unknown"), (None, "ann")}
    ann = whole[1, "ann"]
    assert ann.dialogue == "<|system|>\ns<|end|>\n<|assistant|>\nhi<|end|>\n<|user bob|>\n<|end|>\n" + "<|assistant|>\nbye<|end|>\n" * 2
    assert [ann.dialogue[m.start:m.end] for m in ann.masks] == ["hi<|end|>", "bye<|end|>", "bye<|end|>"]
    assert perspectives.rotate(turns.limit(0)).count() == 0


def test_hilbert_steps_by_one():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3), -1).reshape(-1, 3)
    key = packing.hilbert(cells, 3)
    walk = cells[np.argsort(key)]
    assert sorted(key) == list(range(512)) and (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_pack_round_trip(spark, odd, none):
    from tokenizers import Tokenizer

    enc = Tokenizer.from_file(TOKENS)
    pieces = packing.pack(odd, TOKENS, length=64)
    rows = pieces.collect()
    by, seqs = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
        seqs[r.sequence_id].append(r)
        by[r.doc_id] += r.length
    for v in seqs.values():
        v.sort(key=lambda r: r.offset)
        assert [r.offset for r in v] == np.cumsum([0, *[r.length for r in v[:-1]]]).tolist()
        n = sum(r.length for r in v)
        assert n <= 64 and n & (n - 1) == 0
    for r in odd.collect():
        want = len(enc.encode(r.text or "", add_special_tokens=False).ids) + 1
        assert by[r.doc_id] == want * (2 if r.doc_id == 5 else 1)
    joined = {r.sequence_id: r.input_ids for r in packing.sequences(pieces).collect()}
    assert sum(map(len, joined.values())) == sum(by.values())
    assert packing.pack(none, TOKENS).count() == 0


def test_token_parts_equal_whole_texts():
    tokens = packing._tokens(TOKENS)
    texts = ["It's  <|endoftext|> áb\tX\x1cy\nz   ΣΣ 中文 100%", "", "  "]
    for t, ids in zip(texts, tokens.ids(texts, 2)):
        assert np.frombuffer(ids, tokens.kind).tolist() == tokens.encoder.encode(t, add_special_tokens=False).ids + [2]


def test_pipeline_stages(spark, sf, odd):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    clean = P.drop_toxic(spark, docs, sf)
    marks = spark.read.parquet(f"{sf}/labels.parquet")
    assert clean.columns == list(P.COLUMNS) and clean.count() >= 0.8 * docs.count()
    assert clean.join(marks.where("toxic = 0"), "doc_id").count() >= 0.98 * docs.join(marks.where("toxic = 0"), "doc_id").count()
    one = P.one_of_each(spark, docs, sf)
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    assert sorted(r.doc_id for r in one.collect()) == sorted({c for c in _components(texts)})
    kept = P.one_of_each(spark, odd, sf)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 0), (False, 2), (False, 3), (False, 4), (False, 5), (False, 7), (True, 0)]
    mixed = P.mix_sources(spark, odd, sf)
    assert mixed.columns == list(P.COLUMNS) and P.hide_private(spark, odd, sf).count() == odd.count()
    assert P.pack(spark, mixed, sf).agg(F.sum("length")).first()[0] > 0


def test_one_of_each_keeps_unlike_rows_of_one_id(spark, sf, none):
    import corpus_pipeline as P

    a = " ".join(f"a{i}" for i in range(40))
    rows = [(1, a), (1, " ".join(f"b{i}" for i in range(40))), (2, ""), (2, "one two three"), (3, a + " more"), (3, a + " more"), (4, a), (None, a), (5, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id or 0, r.text) for r in P.one_of_each(spark, docs, sf).collect()), key=str)
    assert got == sorted([(1, a), (1, rows[1][1]), (2, ""), (2, "one two three"), (0, a), (5, None)], key=str)
    for stage in (P.drop_toxic, P.one_of_each, P.hide_private, P.mix_sources, P.pack):
        assert stage(spark, none, sf).count() == 0


def test_few_parts_are_encoded_together():
    """An encoding is some hundred times its part: a slice's new parts never go in one call."""
    tokens = packing._Tokens(TOKENS)
    real, sizes = tokens.encoder, []

    class Encoder:
        def encode_batch_fast(self, parts, **kw):
            sizes.append(len(parts))
            return real.encode_batch_fast(parts, **kw)

    tokens.encoder = Encoder()
    text = " ".join(f"w{i}x" for i in range(25_000))
    (ids,) = tokens.ids([text], 2)
    assert np.frombuffer(ids, tokens.kind).tolist() == real.encode(text, add_special_tokens=False).ids + [2]
    assert max(sizes) <= packing._LEARN and len(sizes) > 2


def _jobs(spark, act) -> int:
    """Jobs that ``act`` starts."""
    sc, group = spark.sparkContext, uuid.uuid4().hex
    sc.setJobGroup(group, group)
    try:
        act()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    return len(sc.statusTracker().getJobIdsForGroup(group))


def test_lineage_cut_is_one_job(spark, odd):
    from logweave.session import cut_lineage

    got = []
    assert _jobs(spark, lambda: got.append(cut_lineage(odd))) == 1
    assert [(f.name, f.dataType, f.nullable) for f in got[0].schema] == [(f.name, f.dataType, True) for f in odd.schema]
    assert sorted(map(repr, got[0].collect())) == sorted(map(repr, odd.collect()))
    assert cut_lineage(odd.limit(0)).count() == 0


def test_counting_dealt_tasks_starts_no_job(spark):
    from logweave.llm.common import spread, spread_over

    few, many = spark.range(0, 10, 1, 1), spark.range(0, 10, 1, 64)
    want = spark.sparkContext.defaultParallelism
    got = []
    assert _jobs(spark, lambda: got.extend([spread_over(few), spread_over(many)])) == 0
    assert [n for _, n in got] == [want, max(want, 64)]
    assert got[0][0].rdd.getNumPartitions() == spread(few).rdd.getNumPartitions() == want


def test_pairs_without_labels_join_nothing(spark):
    from logweave.llm import ngram_join

    pairs = spark.createDataFrame([(1, 2), (3, 3), (None, 4)], "u long, v long")
    none = spark.createDataFrame([], "node long, root long")
    got = ngram_join._apart(pairs, None, "u", "v")
    assert got.collect() == ngram_join._apart(pairs, none, "u", "v").collect() == [(1, 2)]
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
