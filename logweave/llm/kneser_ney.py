"""Interpolated modified Kneser-Ney bigram model, counted in Spark and mapped by workers.

Training is two shuffles of pre-counted arrays. The first counts words: every task sorts the
64-bit word hashes of some two million tokens, and sends (hash, count) to the hash's part; the
sorted hashes of all parts are the vocabulary, a word's *slot* its place in it. The second
counts pairs: a pair's key is its context's place within a part and the word's slot, 24 and 40
bits, so two pairs never share a key; parts are those of the context, and a context with more
than a part's share of all tokens (a word that a third of the corpus repeats) is dealt over
several parts of its own by the next word. From the stored pairs each part sends on how many
different contexts a word has and how many words follow a context once, twice and more often.

All tables are sorted arrays in the shared folder (``hashstore``). Scoring is one map: a worker
looks up the distinct words and pairs of its texts in memory-mapped parts. The model holds
every pair of the training texts, without pruning; nothing of it passes the driver but one row
per part with its size, totals and largest words.

    p(w | v) = max(c(vw) - D(c(vw)), 0) / c(v) + g(v) p(w)
    p(w)     = max(k(w) - E(k(w)), 0) / K + g / (V + 1)

k(w): different contexts of w; K: their sum; g: the mass taken by discounts D, E (for counts
1, 2 and 3 or more, from how many pairs or words occur 1 to 4 times); V: distinct words. An
unseen context leaves p(w), an unseen word 1 / (V + 1) of the lowest level's mass.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm import hashstore as H
from logweave.llm.common import cut_lineage, documents, id_bucket, spread
from logweave.llm.words import byte_class, hashes, mix, slices, spans, text_bytes

_WORD = ~byte_class((9, 13), (32, 32))
BEGIN, END = mix(np.array([2, 1], np.uint64))
_TOKENS = 2_000_000     # counted together by a task
_BYTES = 8_000_000      # of text looked at together (a longer text alone)
_SLOT = np.uint64(40)
_LOW = np.uint64((1 << 40) - 1)
_HALF = np.uint64(32)
_LOW32 = np.uint64((1 << 32) - 1)
_HEAVY = 64             # largest words that a part names


def _sequence(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of some texts, each between BEGIN and END, and their tokens with END."""
    start, end = spans(data, bounds, _WORD)
    n = np.diff(np.searchsorted(start, bounds)) + 1
    last = np.cumsum(n + 1) - 1
    seq = np.empty(int((n + 1).sum()), np.uint64)
    inner = np.ones(len(seq), bool)
    inner[last] = inner[last - n] = False
    seq[inner] = hashes(data, start, end)
    seq[last], seq[last - n] = END, BEGIN
    return seq, n


def _flushes(batches):
    held, size = [], 0
    for b in batches:
        data, bounds = text_bytes(b.column(0))
        for a, e in slices(bounds, _BYTES):
            held.append(_sequence(data[bounds[a]:bounds[e]], bounds[a:e + 1] - bounds[a])[0])
            size += len(held[-1])
            if size >= _TOKENS:
                yield np.concatenate(held)
                held, size = [], 0
    if held:
        yield np.concatenate(held)


_BLOBS = "part int, kind int, keys binary, sums binary"


def _blob(part: int, kind: int, keys: np.ndarray, sums: np.ndarray):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([kind], pa.int32()), pa.array([H.planes(keys)], pa.binary()),
                                       pa.array([H.planes(sums.astype(np.uint32))], pa.binary())], ["part", "kind", "keys", "sums"])


def _groups(batches):
    """(part, [(kind, keys, sums)]) of rows sorted by part."""
    part, got = None, []
    for b in batches:
        for p, kind, keys, sums in zip(*(b.column(i).to_pylist() for i in range(4))):
            if p != part and got:
                yield part, got
                got = []
            part = p
            got.append((kind, keys, sums))
    if got:
        yield part, got


def _dealt(df: DataFrame, parts: int) -> DataFrame:
    return df.repartition(parts, "part").sortWithinPartitions("part")


def _count_words(parts: int):
    def run(batches):
        for seq in _flushes(batches):
            keys, n = np.unique(seq, return_counts=True)
            for p, a, e in H.runs(H.part_of(keys, parts)):
                yield _blob(p, 0, keys[a:e], n[a:e])
    return run


def _store_words(root: str):
    def run(batches):
        import pyarrow as pa

        for part, got in _groups(batches):
            keys, n = H.add_up([H.unplanes(k, "u8") for _, k, _ in got], [H.unplanes(s, "u4").astype(np.int64) for *_, s in got])
            H.write(root, "word", part, keys)
            H.write(root, "count", part, n)
            top = np.argsort(-n, kind="stable")[:_HEAVY]
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([int(n.sum())], pa.int64()),
                                              pa.array([top.tolist()], pa.list_(pa.int64())), pa.array([n[top].tolist()], pa.list_(pa.int64()))],
                                             ["part", "size", "total", "top", "times"])
    return run


@dataclass
class Model:
    """Where the arrays lie, and the numbers that hold for all of them."""

    root: str
    parts: int
    first: np.ndarray                       # slot of each part's first word
    hot: np.ndarray                         # slots of the contexts that have parts of their own
    hot_part: np.ndarray                    # the first of these parts
    hot_parts: np.ndarray                   # how many
    tokens: int = 0                         # N, with END and without BEGIN
    types: int = 0                          # V, likewise
    pairs: int = 0                          # K
    word_numbers: list = field(default_factory=lambda: [0, 0, 0])   # words with 1, 2, 3 or more contexts
    pair_discount: list = field(default_factory=lambda: [0.5, 1.0, 1.5])
    word_discount: list = field(default_factory=lambda: [0.5, 1.0, 1.5])

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slots of ascending hashes, -1 for unseen words."""
        out = np.full(len(keys), -1, np.int64)
        for p, a, e in H.runs(H.part_of(keys, self.parts)):
            at = H.find(H.read(self.root, "word", p), keys[a:e])
            out[a:e] = np.where(at >= 0, at + self.first[p], -1)
        return out

    def values(self, name: str, slots: np.ndarray) -> np.ndarray:
        """Entries of a word array; 0 for slot -1. Slots ascend but for the -1."""
        out = np.zeros(len(slots), np.int64)
        seen = np.flatnonzero(slots >= 0)
        part = np.searchsorted(self.first, slots[seen], "right") - 1
        for p, a, e in H.runs(part):
            out[seen[a:e]] = H.read(self.root, name, p)[slots[seen[a:e]] - self.first[p]]
        return out

    def pair_keys(self, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Part and key of pairs of slots."""
        part = np.searchsorted(self.first, v, "right") - 1
        key = ((v - self.first[part]).astype(np.uint64) << _SLOT) | w.astype(np.uint64)
        at = H.find(self.hot, v)
        own = at >= 0
        part[own] = self.hot_part[at[own]] + w[own] % self.hot_parts[at[own]]
        return part, key


def _pairs(words: np.ndarray, inv: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours within a text as places in ``words``, in one number; where they are."""
    at = np.searchsorted(words, BEGIN)
    inside = inv[1:] != at
    return (inv[:-1].astype(np.uint64) << _HALF | inv[1:].astype(np.uint64))[inside], inside


def _count_pairs(model: Model):
    def run(batches):
        for seq in _flushes(batches):
            words, inv = np.unique(seq, return_inverse=True)
            slot = model.slots(words)
            pair, n = np.unique(_pairs(words, inv)[0], return_counts=True)
            part, key = model.pair_keys(slot[(pair >> _HALF).astype(np.int64)], slot[(pair & _LOW32).astype(np.int64)])
            order = np.argsort(part, kind="stable")
            for p, a, e in H.runs(part[order]):
                yield _blob(p, 0, key[order[a:e]], n[order[a:e]])
    return run


def _times(n: np.ndarray) -> np.ndarray:
    """How many values are 1, 2, 3, 4."""
    return np.bincount(np.minimum(n, 5), minlength=6)[1:5]


def _store_pairs(model: Model):
    """Writes a part's pairs; sends on, by part of the vocabulary, (place, number): of kind 0
    the contexts of a word, of kinds 1 to 3 the words that follow a context once, twice, more
    often, and of kind 4 how many pairs occur 1 to 4 times."""
    def run(batches):
        for part, got in _groups(batches):
            keys, n = H.add_up([H.unplanes(k, "u8") for _, k, _ in got], [H.unplanes(s, "u4").astype(np.int64) for *_, s in got])
            H.write(model.root, "pair", part, keys)
            H.write(model.root, "times", part, n.astype(np.min_scalar_type(int(n.max()))))
            home = part
            if part >= model.parts:
                at = int(np.searchsorted(model.hot_part, part, "right")) - 1
                home = int(np.searchsorted(model.first, model.hot[at], "right")) - 1
            place = (keys >> _SLOT).astype(np.uint32)
            start = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
            for kind in (1, 2, 3):
                many = np.add.reduceat((n == kind) if kind < 3 else (n >= 3), start, dtype=np.int64)
                some = many > 0
                if some.any():
                    yield _blob(home, kind, place[start[some]], many[some])
            word, left = np.unique((keys & _LOW).astype(np.int64), return_counts=True)
            for p, a, e in H.runs(np.searchsorted(model.first, word, "right") - 1):
                yield _blob(p, 0, (word[a:e] - model.first[p]).astype(np.uint32), left[a:e])
            yield _blob(home, 4, np.arange(4, dtype=np.uint32), _times(n))
    return run


def _store_shares(model: Model):
    def run(batches):
        import pyarrow as pa

        for part, got in _groups(batches):
            size = len(H.read(model.root, "word", part))
            sums = np.zeros((4, size), np.int64)
            times = np.zeros(4, np.int64)
            for kind, keys, values in got:
                at, v = H.unplanes(keys, "u4"), H.unplanes(values, "u4")
                if kind == 4:
                    times[at] += v
                else:
                    sums[kind, at] += v
            for name, v in zip(("left", "once", "twice", "more"), sums):
                H.write(model.root, name, part, v.astype(np.min_scalar_type(int(v.max(initial=0)))))
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([int(sums[0].sum())], pa.int64()), pa.array([times.tolist()], pa.list_(pa.int64())),
                                              pa.array([_times(sums[0]).tolist()], pa.list_(pa.int64()))], ["part", "pairs", "pair_times", "word_times"])
    return run


def discounts(times) -> list[float]:
    """D1, D2, D3+ from how many things occur 1, 2, 3, 4 times; 0.5, 1, 1.5 where one of these
    numbers is 0 or a discount falls outside 0 to its count."""
    t1, t2, t3, t4 = (int(t) for t in times)
    if not (t1 and t2 and t3 and t4):
        return [0.5, 1.0, 1.5]
    y = t1 / (t1 + 2 * t2)
    d = [1 - 2 * y * t2 / t1, 2 - 3 * y * t3 / t2, 3 - 4 * y * t4 / t3]
    return d if all(0 < x <= k for k, x in enumerate(d, 1)) else [0.5, 1.0, 1.5]


def train(docs: DataFrame, *, text: str = "text") -> Model:
    """The model of all texts of ``docs`` (a null text is empty: BEGIN, END). Repeated rows
    count as often as they occur; no rows give a model that knows no word."""
    spark = docs.sparkSession
    texts = spread(docs.select(F.col(text)))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * texts.rdd.getNumPartitions())
    root = H.folder(spark)
    words = _dealt(texts.mapInArrow(_count_words(parts), _BLOBS), parts)
    found = cut_lineage(words.mapInArrow(_store_words(root), "part int, size bigint, total bigint, top array<bigint>, times array<bigint>"))
    found = found.orderBy("part").collect()             # a row per part
    size = np.zeros(parts + 1, np.int64)
    for r in found:
        size[r.part + 1] = r.size
    if size.max() >= 1 << 24:
        raise ValueError("a part of the vocabulary holds over 2^24 words: read the input in more partitions")
    first = np.cumsum(size)[:-1]
    total = sum(r.total for r in found)
    big = sorted((int(first[r.part] + i), n) for r in found for i, n in zip(r.top, r.times) if n * parts > total)
    many = np.array([-(-n * parts // total) + 1 for _, n in big], np.int64)
    model = Model(root, parts, first, np.array([s for s, _ in big], np.int64), parts + np.cumsum(many) - many, many)
    if not found:
        return model
    pairs = _dealt(texts.mapInArrow(_count_pairs(model), _BLOBS), parts + int(many.sum()))
    shares = _dealt(pairs.mapInArrow(_store_pairs(model), _BLOBS), parts)
    shares = cut_lineage(shares.mapInArrow(_store_shares(model), "part int, pairs bigint, pair_times array<bigint>, word_times array<bigint>")).collect()
    begin = np.array([BEGIN])
    model.tokens = int(total - model.values("count", model.slots(begin))[0])
    model.types = int(size.sum()) - 1
    model.pairs = sum(r.pairs for r in shares)
    model.pair_discount = discounts(np.sum([r.pair_times for r in shares], axis=0))
    times = np.sum([r.word_times for r in shares], axis=0)
    model.word_discount = discounts(times)
    model.word_numbers = [int(times[0]), int(times[1]), model.types - int(times[0] + times[1])]
    return model


def _less(n: np.ndarray, d: list[float]) -> np.ndarray:
    return np.maximum(n - np.array([0.0, *d])[np.minimum(n, 3)], 0)


def _log_probabilities(model: Model, words: np.ndarray, inv: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log10 p of each word but the BEGINs given the one before; of each in the add-one
    unigram model; whether it was seen."""
    slot = model.slots(words)
    count = model.values("count", slot)
    left, *after = (model.values(name, slot) for name in ("left", "once", "twice", "more"))
    d, e = model.pair_discount, model.word_discount
    word_mass = np.ones(len(words)) / (model.types + 1)
    if model.pairs:
        taken = sum(x * n for x, n in zip(e, model.word_numbers))
        word_mass = (_less(left, e) + taken / (model.types + 1)) / model.pairs
    pair, inside = _pairs(words, inv)
    pair, of = np.unique(pair, return_inverse=True)
    a, b = (pair >> _HALF).astype(np.int64), (pair & _LOW32).astype(np.int64)
    times = np.zeros(len(pair), np.int64)
    known = np.flatnonzero((slot[a] >= 0) & (slot[b] >= 0))
    part, key = model.pair_keys(slot[a[known]], slot[b[known]])
    order = np.argsort(part, kind="stable")
    for p, x, y in H.runs(part[order]):
        at = known[order[x:y]]
        place = H.find(H.read(model.root, "pair", p), key[order[x:y]])
        hit = place >= 0
        times[at[hit]] = H.read(model.root, "times", p)[place[hit]]
    p = word_mass[b]
    seen = count[a] > 0
    spare = sum(x * n for x, n in zip(d, after))[a]
    p = np.where(seen, (_less(times, d) + spare * p) / np.maximum(count[a], 1), p)
    token = inv[1:][inside]
    base = np.log10((count + 1) / (model.tokens + model.types + 1))
    return np.log10(p)[of], base[token], (count > 0)[token]


def _score(model: Model):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            data, bounds = text_bytes(b.column(b.num_columns - 1))
            for a, e in slices(bounds, _BYTES):
                seq, n = _sequence(data[bounds[a]:bounds[e]], bounds[a:e + 1] - bounds[a])
                words, inv = np.unique(seq, return_inverse=True)
                p, base, seen = _log_probabilities(model, words, inv)
                at = np.cumsum(n) - n
                total = np.add.reduceat(p, at)
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(i).slice(a, e - a) for i in range(b.num_columns - 1)), pa.array(n, pa.int64()), pa.array(np.add.reduceat(seen, at, dtype=np.int64)),
                     pa.array(np.add.reduceat(base, at)), pa.array(total), pa.array(10.0 ** np.minimum(-total / n, 300))],
                    [*b.schema.names[:-1], "n_tokens", "n_known", "base_score", "score", "perplexity"])
    return run


def score(docs: DataFrame, model: Model, *, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns, n_tokens (words and the end), n_known (seen in training), base_score
    (add-one unigrams) and score (this model), both sums of log10 p, and perplexity. Null
    and empty texts are the end alone; texts are scored whole, each row for itself."""
    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep)
    return spread(docs.select(*keep, F.col(text))).mapInArrow(
        _score(model), schema + ", n_tokens bigint, n_known bigint, base_score double, score double, perplexity double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: scores of all documents by a model of those with crc32(doc_id) mod 7 other than 2."""
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce(id_bucket("doc_id", 7) == 2, F.lit(False)).alias("held_out"), "text")
    model = train(docs.where("not held_out"))
    out = score(docs, model, keep=["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")
