"""Language identification by segmentation-marginalised unigrams.

A fixed public vocabulary (the pieces of a sentencepiece file, lower case) gives the
alphabet of pieces. Each language has one probability per piece, learned by EM on a bounded
sample of labelled documents. A word's probability in a language is the sum over *all* its
segmentations into pieces (forward algorithm), a text's is the product over its words, and
the answer is the language with the highest posterior.

Scale: learning reads a sample whose expected size is ``docs_per_lang`` documents a
language; one task per language runs EM on that sample's word counts. Prediction is one map
over the table: each task computes the forward sums once per distinct word (vectorised in
numpy over all words of one length) and looks them up per occurrence.
"""

from __future__ import annotations

import functools
import re
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm.common import spread

_LETTERS = re.compile(r"[^\W\d_]+")
_BLOCKS = 32          # classes for characters outside the vocabulary's alphabet
_CACHE = 4_000_000    # scores a worker keeps (words times languages); then it starts afresh
_DOUBT = 0.1          # share of a word taken from all languages: quoted words weigh less
_SCALE = 16.0         # per-character factor that keeps the forward sums near 1


class Pieces:
    """The vocabulary as a dense trie: ``step[node, code]`` is the next node or 0."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        vocab = (sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not sp.is_control(i) and not sp.is_byte(i))
        vocab = sorted({p for p in vocab if p == p.lower() and (b := p.removeprefix("▁")) and b.isalpha()})
        alphabet = sorted({c for p in vocab if len(p.removeprefix("▁")) > 1 for c in p} | {"▁"})
        self.code = {c: i for i, c in enumerate(alphabet)}
        self.width = len(alphabet) + _BLOCKS
        nodes: list[dict[int, int]] = [{}]
        final = [False]
        single = [(k,) for k in range(self.width)]
        for codes in single + [tuple(self.code[c] for c in p) for p in vocab if all(c in self.code for c in p)]:
            at = 0
            for k in codes:
                if k not in nodes[at]:
                    nodes[at][k] = len(nodes)
                    nodes.append({})
                    final.append(False)
                at = nodes[at][k]
            final[at] = True
        self.final = np.array(final)
        self.step = np.zeros((len(nodes), self.width), np.int32)
        for i, kids in enumerate(nodes):
            for k, j in kids.items():
                self.step[i, k] = j
        self.depth = np.zeros(len(nodes), np.int32)
        for i, kids in enumerate(nodes):
            for j in kids.values():
                self.depth[j] = self.depth[i] + 1
        self.longest = int(self.depth.max())

    def encode(self, words: list[str]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Words by length: (their positions in the list, codes with the word mark first)."""
        n0 = len(self.code)
        by: dict[int, tuple[list, list]] = {}
        get, mark = self.code.get, self.code["▁"]
        for i, w in enumerate(words):
            row = [mark]
            for c in w:
                k = get(c)
                row.append(n0 + (ord(c) >> 7) % _BLOCKS if k is None else k)
            at = by.setdefault(len(row), ([], []))
            at[0].append(i)
            at[1].append(row)
        return {n: (np.array(a), np.array(b, np.int32)) for n, (a, b) in by.items()}

    def arcs(self, codes: np.ndarray):
        """Yields (start, length, rows, nodes) of every piece that occurs in the words."""
        n = codes.shape[1]
        for i in range(n):
            rows, at = np.arange(len(codes)), np.zeros(len(codes), np.int32)
            for m in range(1, min(self.longest, n - i) + 1):
                at = self.step[at, codes[rows, i + m - 1]]
                live = at > 0
                if not live.all():
                    rows, at = rows[live], at[live]
                if not len(rows):
                    break
                whole = self.final[at]
                if whole.any():
                    yield i, m, (rows if whole.all() else rows[whole]), (at if whole.all() else at[whole])

    def forward(self, codes: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict]:
        """(log-likelihood [word, language], alpha [position, word, language], divisors).

        ``p`` holds the piece probabilities times ``_SCALE`` per character; alpha is
        divided at every 32nd position (``divisors`` by position), so a word of any length
        stays in range.
        """
        n, langs = codes.shape[1], p.shape[1]
        alpha = np.zeros((n + 1, len(codes), langs))
        alpha[0] = 1.0
        log = np.full((len(codes), langs), -n * np.log(_SCALE))
        done, by = 0, {}
        for i, m, rows, at in self.arcs(codes):
            if i != done:
                done = i
                if i % 32 == 0:
                    by[i] = top = np.maximum(alpha[i], 1e-290)
                    log += np.log(top)
                    alpha[i:i + self.longest + 1] /= top
            alpha[i + m, rows] += alpha[i, rows] * p[at]
        return log + np.log(np.maximum(alpha[n], 1e-300)), alpha, by

    def em(self, words: list[str], counts: np.ndarray, rounds: int) -> np.ndarray:
        """Log probability per node for one language."""
        known = self.final.nonzero()[0]
        size = len(self.final)
        scale = _SCALE ** self.depth.astype(float)
        p = np.where(self.final, 1.0 / len(known), 0.0)
        groups = [(counts[at], codes) for at, codes in self.encode(words).values()]
        for _ in range(rounds):
            expect = np.zeros(size)
            for n_of, codes in groups:
                q = (p * scale)[:, None]
                _, alpha, by = self.forward(codes, q)
                n = codes.shape[1]
                beta = np.zeros((n + 1, len(codes)))
                beta[n] = 1.0
                # beta takes the divisors of alpha that lie between its two ends
                arcs = []
                for i, m, rows, at in self.arcs(codes):
                    w = q[at, 0]
                    for s in range(i // 32 * 32 + 32, i + m + 1, 32):
                        if s in by:
                            w = w / by[s][rows, 0]
                    arcs.append((i, m, rows, at, w))
                for i, m, rows, _, w in reversed(arcs):
                    beta[i, rows] += w * beta[i + m, rows]
                z = np.maximum(alpha[n, :, 0], 1e-300)
                for i, m, rows, at, w in arcs:
                    got = alpha[i, rows, 0] * w * beta[i + m, rows] / z[rows] * n_of[rows]
                    expect += np.bincount(at, got, size)
            p = np.where(self.final, expect + 0.01, 0.0)
            p /= p.sum()
        return np.log(np.maximum(p, 1e-300))


@functools.lru_cache(maxsize=2)
def _pieces(path: str) -> Pieces:
    return Pieces(path)


def _words(text: str) -> list[str]:
    return _LETTERS.findall(text.lower())


def _is_letters(word: str) -> str:
    """The letters of a word (number signs such as a half count as none)."""
    return word if word.isalpha() else "".join(c for c in word if c.isalpha())


class _Scores:
    """A worker's scores of the space-separated tokens it has met, kept between tasks.

    A token's score is the sum over its letter runs, so a lookup needs no regex.
    """

    def __init__(self, path: str, model: list[tuple[str, float, bytes]]):
        self.pieces = _pieces(path)
        self.p = np.exp(np.stack([np.frombuffer(m[2], np.float32) for m in model], 1).astype(float))
        self.p *= (_SCALE ** self.pieces.depth.astype(float))[:, None]
        self.limit = max(20_000, _CACHE // len(model))
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.table = np.zeros((1024, self.p.shape[1]))
        self.used = 0

    def rows(self, tokens: list[str]) -> np.ndarray:
        """Table row of every token; -1 for one without a letter."""
        if len(self.known) > self.limit:
            self.clear()
        new = list(set(tokens).difference(self.known))
        if new:
            runs = [[b for r in _words(t) if (b := _is_letters(r))] for t in new]
            words = list({r for x in runs for r in x})
            at_word = {w: i for i, w in enumerate(words)}
            got = np.zeros((len(words), self.p.shape[1]))
            for at, codes in self.pieces.encode(words).values():
                for a in range(0, len(at), 20_000):
                    got[at[a:a + 20_000]] = self.pieces.forward(codes[a:a + 20_000], self.p)[0]
            peak = got.max(1, keepdims=True, initial=-np.inf)
            share = np.exp(got - peak)
            got = peak + np.log((1 - _DOUBT) * share + _DOUBT * share.mean(1, keepdims=True))
            flat = np.fromiter((at_word[r] for x in runs for r in x), np.int64)
            of = np.repeat(np.arange(len(new)), [len(x) for x in runs])
            more = np.stack([np.bincount(of, got[flat, g], len(new)) for g in range(got.shape[1])], 1)
            end = self.used + len(new)
            while end > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[self.used:end] = more
            self.known.update((t, self.used + i if x else -1) for i, (t, x) in enumerate(zip(new, runs)))
            self.used = end
        return np.fromiter(map(self.known.__getitem__, tokens), np.int64, len(tokens))


_WORKER: dict[str, _Scores] = {}


def _scores(path: str, model_id: str, shared) -> _Scores:
    if model_id not in _WORKER:
        _WORKER.clear()
        _WORKER[model_id] = _Scores(path, shared.value)
    return _WORKER[model_id]


def learn(docs: DataFrame, path: str, *, text: str = "text", lang: str = "lang", key: str = "doc_id",
          docs_per_lang: int = 1000, rounds: int = 4) -> list[tuple[str, float, bytes]]:
    """One (language, log prior, piece log probabilities) per language of ``docs``.

    ``docs_per_lang`` is the expected sample per language, drawn by a hash of the key (all
    documents where a language has fewer); the whole texts of the sampled documents teach.
    Rows with null text or language teach nothing.
    """
    import pandas as pd

    docs = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).where("t is not null and l is not null")
    sizes = {r.l: r.n for r in docs.groupBy("l").agg(F.count("*").alias("n")).collect()}  # one row per language
    if not sizes:
        return []
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, docs_per_lang / n))])
    taken = docs.where(F.pmod(F.xxhash64("k", F.lit(17)), F.lit(1 << 20)) < share[F.col("l")] * F.lit(1 << 20))

    def count(batches):
        import pyarrow as pa

        for b in batches:
            seen: dict[tuple[str, str], int] = {}
            for t, g in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for w in _words(t):
                    seen[g, w] = seen.get((g, w), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["l", "w", "n"])

    def train(key, pdf):
        got: dict[str, int] = {}
        for w, n in zip(pdf.w, pdf.n):
            if w := _is_letters(w):
                got[w] = got.get(w, 0) + n
        p = _pieces(path).em(list(got), np.array(list(got.values()), float), rounds)
        return pd.DataFrame({"l": [key[0]], "p": [p.astype(np.float32).tobytes()]})

    words = taken.select("t", "l").mapInArrow(count, "l string, w string, n long").groupBy("l", "w").agg(F.sum("n").alias("n"))
    rows = words.groupBy("l").applyInPandas(train, "l string, p binary").collect()  # one row per language
    total = sum(sizes.values())
    return sorted((r.l, float(np.log(sizes[r.l] / total)), bytes(r.p)) for r in rows)


def predict(docs: DataFrame, model: list[tuple[str, float, bytes]], path: str, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``lang_pred`` and ``score`` (posterior of that language) per row.

    A null text, a text without a letter and every text under an empty model give ``und``
    with score 0. Equal texts get equal answers; ties go to the first language by name.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # one vector over the vocabulary per language
    model_id = uuid.uuid4().hex
    fields = [docs.schema[c] for c in keep]
    n_keep = len(keep)

    def run(batches):
        import pyarrow as pa

        model = shared.value
        names = [m[0] for m in model]
        prior = np.array([m[1] for m in model])
        scores = _scores(path, model_id, shared) if model else None

        for b in batches:
            texts = b.column(n_keep).to_pylist()
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            a = 0
            while model and a < len(texts):
                e, size = a, 0
                while e < len(texts) and (e == a or size < 4_000_000):  # characters at a time
                    size += len(texts[e] or "")
                    e += 1
                words = [t.split() if t else [] for t in texts[a:e]]
                rows = scores.rows([w for ws in words for w in ws])
                table = scores.table
                of = np.repeat(np.arange(a, e), [len(ws) for ws in words])
                of, rows = of[rows >= 0], rows[rows >= 0]
                has = np.bincount(of - a, minlength=e - a)
                sums = np.stack([np.bincount(of - a, table[rows, g], e - a) for g in range(len(names))], 1) + prior
                best = sums.argmax(1)
                post = 1.0 / np.exp(sums - sums.max(1, keepdims=True)).sum(1)
                for i in np.flatnonzero(has):
                    lang[a + i], score[a + i] = names[best[i]], post[i]
                a = e
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(n_keep)), pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*keep, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", lang_pred string, score double"
    return docs.select(*keep, text).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: language of every document; documents with crc32(id) mod 4 = 2 are held out."""
    import public_tokenizers

    from logweave.llm.common import documents, id_bucket

    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    held = F.coalesce(id_bucket("doc_id", 4) == 2, F.lit(False))
    model = learn(docs.where(id_bucket("doc_id", 4) != 2), path)
    out = predict(spread(docs.select("doc_id", "text", held.alias("held_out"))), model, path, keep=("doc_id", "held_out"))
    return out.select("doc_id", "held_out", "lang_pred", "score")
