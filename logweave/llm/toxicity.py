"""Toxicity by a convolutional text classifier, trained in numpy.

Words are hashed to buckets; each frequent bucket has an embedding. Filters of widths 1, 2
and 3 slide over the whole text, a text's feature is each filter's maximum, and a logistic
layer gives the logit. The threshold is calibrated for every language on all labelled
documents the network did not train on; the language is guessed from the words themselves, so
label, language, source and id of a scored row are never looked at. Scores are shifted so that
each language's threshold lies at 0.5.

Scale: a bounded sample of labelled rows is read for training (whole texts of ``per_class``
documents a class) and one task learns from it; logits are one map over the table
that keeps the model (a few MB, fixed by ``vocabulary``) in a broadcast. Thresholds come from
a histogram of these logits, counted in Spark: its size is fixed by the bins and languages.
"""

from __future__ import annotations

import dataclasses
import pickle
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm.common import cut_lineage, documents, id_bucket, labels, spread

WIDTHS = (1, 2, 3)
LOGIT, GUESS = "__logit", "__guess"
_BINS = 64                # of the histogram, per unit of the logit
_ENOUGH = 10              # documents of either class for a threshold of one's own
BUCKETS = 1 << 20
_CACHE = 400_000
_EDGE = ".,;:!?\"'()[]{}<>*$%&#|-_«»“”‘’…"


def buckets(words: list[str], cache: dict[str, int]) -> np.ndarray:
    """Hash bucket of every word without its edge punctuation."""
    import xxhash

    if len(cache) > _CACHE:
        cache.clear()
    for w in set(words).difference(cache):
        cache[w] = xxhash.xxh32_intdigest(w.lower().strip(_EDGE).encode("utf-8", "surrogatepass")) % BUCKETS
    return np.fromiter(map(cache.__getitem__, words), np.int32, len(words))


@dataclasses.dataclass
class Network:
    """``slot[bucket]``: row of ``embed`` (0: rare). ``filters``: per width [place, dim, filter]."""

    slot: np.ndarray
    embed: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    lang: np.ndarray          # [slot, language] log probability of a word
    threshold: np.ndarray     # per language, in logits

    def tables(self) -> list[list[np.ndarray]]:
        """Per width and place: the filter outputs of every slot alone."""
        return [[(self.embed @ f[k]).astype(np.float32) for k in range(len(f))] for f in self.filters]

    def features(self, ids: np.ndarray, tables, where: bool = False):
        """Maximum of every filter over the text; with ``where`` also its place."""
        ids = np.concatenate([ids, np.zeros(max(0, WIDTHS[-1] - len(ids)), ids.dtype)])
        best, at = [], []
        for f, table in zip(self.filters, tables):
            n = len(ids) - len(f) + 1
            z = table[0][ids[:n]]
            for k in range(1, len(f)):
                z = z + table[k][ids[k:k + n]]
            if where:
                p = z.argmax(0)
                at.append(p)
                best.append(z[p, np.arange(z.shape[1])])
            else:
                best.append(z.max(0))
        return np.concatenate([np.maximum(b + c, 0) for b, c in zip(best, self.bias)]), at

    def language(self, ids: np.ndarray) -> int:
        return int(self.lang[ids].sum(0).argmax()) if len(ids) else 0

    def logit(self, ids: np.ndarray, tables) -> float:
        return float(self.features(ids, tables)[0] @ self.out + self.out_bias)


def fit(ids: list[np.ndarray], toxic: np.ndarray, lang: np.ndarray, *, vocabulary: int = 40_000,
        dim: int = 12, filters: int = 12, epochs: int = 6, seed: int = 7) -> Network | None:
    """Trains on documents of hashed words; thresholds are 0. None when one of the classes is
    missing."""
    if len(set(toxic.tolist())) < 2:
        return None
    rng = np.random.default_rng(seed)
    n = len(ids)
    uniq = [np.unique(x) for x in ids]
    train = np.arange(n)
    df = np.bincount(np.concatenate([uniq[i] for i in train]), minlength=BUCKETS)
    common = np.flatnonzero(df >= 3)
    common = common[np.argsort(-df[common], kind="stable")][:vocabulary]
    slot = np.zeros(BUCKETS, np.int32)
    slot[common] = np.arange(1, len(common) + 1)
    size = len(common) + 1
    docs = [slot[x] for x in ids]
    # embeddings start with the word's shrunken log odds in the first place
    one = np.zeros(size)
    for i in train:
        one[np.unique(docs[i])] += toxic[i]
    one[0] = 0.0
    all_ = np.concatenate([[0], df[common]]).astype(float)
    n1 = float(toxic[train].sum())
    n0 = len(train) - n1
    a, b = one + 0.5, all_ - one + 0.5
    odds = np.log(a / (n1 + 1)) - np.log(b / (n0 + 1))
    embed = rng.normal(0, 0.05, (size, dim))
    embed[:, 0] = np.clip(odds / np.sqrt(1 / a + 1 / b) / 4, -2, 2)
    embed[0] = 0
    net_filters, bias = [], []
    for w in WIDTHS:
        f = rng.normal(0, 0.1, (w, dim, filters))
        f[:, 0, : filters // 2] += 1.0 / w
        net_filters.append(f)
        bias.append(np.full(filters, -0.1))
    langs = int(lang.max()) + 1 if len(lang) and lang.max() >= 0 else 1
    words = np.full((size, langs), 0.5)
    for i in train:
        if lang[i] >= 0:
            words[:, lang[i]] += np.bincount(docs[i], minlength=size)
    words[0] = 1.0
    log = np.log(words / words.sum(0))
    log[0] = 0.0
    net = Network(slot, embed, net_filters, bias, np.full(filters * len(WIDTHS), 0.2), -1.0, log.astype(np.float32), np.zeros(langs))
    sums = {k: np.full_like(v, 1e-2) for k, v in (("e", embed), ("o", net.out), *((("f", i), f) for i, f in enumerate(net_filters)), *((("b", i), c) for i, c in enumerate(bias)))}
    sum_ob, rate = 1e-2, 0.1

    def adagrad(value, total, grad, rows=slice(None)):
        total[rows] += grad * grad
        value[rows] -= rate * grad / np.sqrt(total[rows])

    for _ in range(epochs):
        order = rng.permutation(train)
        for start in range(0, len(order), 32):
            batch = order[start:start + 32]
            tables = net.tables()
            go, gob = np.zeros_like(net.out), 0.0
            gf = [np.zeros_like(f) for f in net.filters]
            gb = [np.zeros_like(c) for c in net.bias]
            touched, grads = [], []
            for i in batch:
                x = docs[i] if len(docs[i]) >= WIDTHS[-1] else np.concatenate([docs[i], np.zeros(WIDTHS[-1] - len(docs[i]), np.int32)])
                feat, at = net.features(x, tables, where=True)
                p = 1.0 / (1.0 + np.exp(-np.clip(feat @ net.out + net.out_bias, -30, 30)))
                d = (p - toxic[i]) / len(batch)
                go += d * feat
                gob += d
                back = d * net.out * (feat > 0)
                for j, (f, pos) in enumerate(zip(net.filters, at)):
                    g = back[j * filters:(j + 1) * filters]
                    gb[j] += g
                    for k in range(len(f)):
                        rows = x[pos + k]
                        gf[j][k] += (net.embed[rows] * g[:, None]).T
                        touched.append(rows)
                        grads.append((f[k] * g).T)
            adagrad(net.out, sums["o"], go)
            sum_ob += gob * gob
            net.out_bias -= rate * gob / sum_ob ** 0.5
            for j in range(len(WIDTHS)):
                adagrad(net.filters[j], sums["f", j], gf[j])
                adagrad(net.bias[j], sums["b", j], gb[j])
            rows, back = np.unique(np.concatenate(touched), return_inverse=True)
            g = np.zeros((len(rows), dim))
            np.add.at(g, back, np.concatenate(grads))
            g[rows == 0] = 0
            adagrad(net.embed, sums["e"], g, rows)
    return net


def _cut(bins: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> float:
    """The threshold of the best F1 of weighted counts per bin, in the middle of its gap."""
    order = np.argsort(-bins)
    z, y = bins[order], toxic[order]
    hit = np.cumsum(y)
    f1 = 2 * hit / (np.cumsum(y + clean[order]) + y.sum() + 1e-12)
    best = int(f1.argmax())
    return float((z[best] + z[best + 1] + 1) / 2 if best + 1 < len(z) else z[best] - 0.5 * _BINS) / _BINS


def _marks(marks: DataFrame, key: str, mark: str) -> DataFrame:
    """(k, y) of the labelled keys; a key marked both ways is toxic."""
    marks = marks.select(F.col(key).alias("k"), F.col(mark).cast("int").alias("y")).where("k is not null and y in (0, 1)")
    return marks.groupBy("k").agg(F.max("y").alias("y"))


def train(docs: DataFrame, marks: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", mark: str = "toxic",
          per_class: int = 2500) -> tuple[Network | None, DataFrame | None]:
    """Network without thresholds, and the keys ``k`` that it saw, from the labelled rows of
    ``marks`` (key, mark 0 or 1), joined to ``docs``.

    The sample holds an expected ``per_class`` documents of each class, drawn by a hash of
    the key, of which all words teach. Where it leaves too few labelled
    rows of a class and language outside (a fifth of those sampled; 20 or half of them, if
    half is enough for a threshold), the missing ones are held back from training, unless
    even then too few toxic ones are outside for any threshold. None without both classes.
    """
    marks = _marks(marks, key, mark)
    sizes = {r.y: r.n for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None, None
    part = {y: min(1.0, per_class / sizes[y]) for y in (0, 1)}
    share = F.when(F.col("y") == 1, part[1]).otherwise(part[0])
    drawn = marks.where(F.pmod(F.xxhash64("k", F.lit(5)), F.lit(1 << 20)) < share * (1 << 20))
    docs = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l"))
    rows = docs.join(F.broadcast(drawn), "k").select("k", "y", "l", F.coalesce("t", F.lit("")).alias("t"))  # 2 x per_class rows
    kind = docs.schema["k"].dataType.simpleString()

    def hashed(batches):
        import pyarrow as pa

        cache: dict[str, int] = {}
        for b in batches:
            got = [buckets(t.split(), cache).tobytes() for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(got, pa.binary())], ["k", "y", "l", "h"])

    def taught(batches):
        import pyarrow as pa

        rows = [r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(4)))]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(_teach(rows, part))], pa.binary())], ["net"])

    # the sample is bounded; one task learns from it, so that the driver holds the network alone
    one = rows.mapInArrow(hashed, f"k {kind}, y int, l string, h binary").repartition(1).mapInArrow(taught, "net binary")
    got = one.first()
    net, keys = pickle.loads(got.net) if got else (None, [])
    return net, docs.sparkSession.createDataFrame([(k,) for k in keys], f"k {kind}")


def _teach(rows: list[tuple], part: dict[int, float]) -> tuple[Network | None, list]:
    """Network and the keys it saw from the drawn rows (key, label, language, hashed words);
    ``part``: the share of a label's keys that was drawn."""
    got = sorted(rows, key=lambda r: (str(r[0]), r[3]))
    # shuffled by a fixed order so that the rows held back are a fair draw
    got = [got[i] for i in np.random.default_rng(3).permutation(len(got))]
    cells: dict[tuple, dict] = {}
    for k, y, lang, _ in got:
        cells.setdefault((y, lang), {})[k] = None
    held, fresh = set(), 0.0
    for (y, _), keys in cells.items():
        outside = len(keys) * (1 / part[y] - 1)
        want = max(len(keys) / 5, min(len(keys) / 2, 20) if len(keys) >= 2 * _ENOUGH else 0)
        back = int(max(0, want - outside))
        held.update(list(keys)[:back])
        fresh += y * (back + outside)
    if fresh >= _ENOUGH and len({y for k, y, *_ in got if k not in held}) == 2:
        got = [r for r in got if r[0] not in held]
    names = sorted({r[2] for r in got if r[2] is not None})
    net = fit([np.frombuffer(r[3], np.int32) for r in got], np.array([r[1] for r in got]), np.array([names.index(r[2]) if r[2] is not None else -1 for r in got]))
    return net, list({r[0]: None for r in got})


def calibrate(rows: DataFrame, marks: DataFrame, net: Network | None, seen: DataFrame | None, *, key: str = "doc_id", mark: str = "toxic") -> Network | None:
    """``net`` with each language's threshold, from the logits of all labelled rows.

    Rows that the network trained on do not count unless there are too few others. Counts per
    (language, bin, label) are weighted to the labels of the language.
    """
    if net is None:
        return None
    got = rows.select(F.col(key).alias("k"), LOGIT, GUESS).join(_marks(marks, key, mark), "k").join(F.broadcast(seen.withColumn("seen", F.lit(True))), "k", "left")
    at = F.floor(F.least(F.greatest(LOGIT, F.lit(-32.0)), F.lit(32.0)) * _BINS).cast("int")
    table = got.groupBy(F.col(GUESS).alias("g"), at.alias("bin"), "y", F.col("seen").isNull().alias("fresh")).agg(F.count("*").alias("n")).collect()
    langs, low = len(net.threshold), -32 * _BINS
    counts = np.zeros((langs, 2, 2, 64 * _BINS + 1))  # language, not trained on, label, bin
    for r in table:
        counts[r.g, int(r.fresh), r.y, r.bin - low] += r.n
    both, fresh = counts.sum(1), counts[:, 1]
    if fresh[:, 1].sum() < _ENOUGH or not fresh[:, 0].any():
        fresh = both
    n = fresh.sum(2)
    weighted = fresh * (both.sum(2) / np.maximum(n, 1))[..., None]

    def cut(c):
        used = np.flatnonzero(c.any(0))
        return _cut(used + low, c[1, used], c[0, used]) if len(used) else 0.0

    overall = cut(weighted.sum(0))
    own = [cut(weighted[g]) if n[g].min() >= _ENOUGH else overall for g in range(langs)]
    return dataclasses.replace(net, threshold=np.array(own))


def learn(docs: DataFrame, marks: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", mark: str = "toxic", **sample) -> Network | None:
    """Network with thresholds from the labelled rows; reads the table twice."""
    net, seen = train(docs, marks, key=key, text=text, lang=lang, mark=mark, **sample)
    return net and calibrate(logits(docs.select(key, text), net, text=text).drop(text), marks, net, seen, key=key, mark=mark)


_WORKER: dict[str, tuple] = {}


def logits(docs: DataFrame, net: Network, *, text: str = "text") -> DataFrame:
    """All columns of ``docs``, the logit of every row's whole text and its guessed language.
    Null and empty texts count as texts without words."""
    docs = docs.drop(LOGIT, GUESS)
    shared, model_id, at = docs.sparkSession.sparkContext.broadcast(net), uuid.uuid4().hex, docs.columns.index(text)
    names = [*docs.columns, LOGIT, GUESS]

    def run(batches):
        import pyarrow as pa

        if model_id not in _WORKER:
            _WORKER.clear()
            _WORKER[model_id] = (shared.value, shared.value.tables(), {})
        net, tables, cache = _WORKER[model_id]
        for b in batches:
            out, guess = [], []
            for t in b.column(at).to_pylist():
                ids = net.slot[buckets((t or "").split(), cache)]
                out.append(net.logit(ids, tables))
                guess.append(net.language(ids))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64()), pa.array(guess, pa.int32())], names)

    return docs.mapInArrow(run, docs.withColumns({LOGIT: F.lit(0.0), GUESS: F.lit(0)}).schema)


def shift(rows: DataFrame, net: Network, as_col: str = "score") -> DataFrame:
    """``rows`` of ``logits`` with the score (0 to 1, the language's threshold at 0.5) instead."""
    z = F.col(LOGIT) - F.get(F.array(*[F.lit(float(x)) for x in net.threshold]), F.col(GUESS))
    z = F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0))
    return rows.withColumn(as_col, 1.0 / (1.0 + F.exp(-z))).drop(LOGIT, GUESS)


def score(docs: DataFrame, net: Network | None, *, text: str = "text", as_col: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score of every row's whole text; a column of that name
    is replaced. Without a network every score is 0."""
    docs = docs.drop(as_col)
    return docs.withColumn(as_col, F.lit(0.0)) if net is None else shift(logits(docs, net, text=text), net, as_col)


def classify(docs: DataFrame, rows: DataFrame, marks: DataFrame, *, text: str = "text", as_col: str = "score", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` (columns of ``rows``, doc_id among them) and the score of each row, by a network
    learned from ``docs`` and ``marks``. The texts of ``rows`` are scored once: the logits are
    written, calibrate the thresholds and are shifted by them."""
    net, seen = train(docs, marks, text=text)
    if net is None:
        return rows.select(*keep, F.lit(0.0).alias(as_col))
    out = cut_lineage(logits(rows, net, text=text).select(*keep, LOGIT, GUESS))
    return shift(out, calibrate(out, marks, net, seen), as_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: toxicity of every document; labels of documents with crc32(id) mod 5 = 0 are held out."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    rows = spread(docs.select("doc_id", F.coalesce(id_bucket("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "text"))
    out = classify(docs, rows, labels(spark, sf_dir).where(id_bucket("doc_id", 5) != 0), keep=("doc_id", "held_out"))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
