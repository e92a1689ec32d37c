"""Phrase collocations by SON partitioning.

Texts are dealt by hash into ``shards`` slices of the corpus. Within a language, a slice with
the share s of all words is mined completely, level by level, at the local support
``ceil(least * s)``: words, then pairs of locally frequent words, then triples of locally
frequent pairs. A phrase with ``least`` occurrences in all reaches the local support in at
least one slice, so the union of the locally frequent phrases holds every answer. All
occurrences of the union are then counted over the whole corpus, and scores come from these
exact counts alone.

A slice is no task: each is counted by all of them. Tasks sort the phrase hashes of some
megabytes of text and send (hash, count) to the hash's part; a part sums, cuts at the local
supports and writes its sorted hashes with one bit per slice to the shared folder
(``hashstore``), where the next level's tasks map them. More slices mean lower supports: from
``least`` slices on a support is 1 and nothing is pruned, so the default is few and large.

Words and phrases are compared by 64-bit hashes that include the language; the text of the
words that end up in the answer is read in a last pass. Counts are 64-bit, products decimal
with 38 digits.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweave.llm import hashstore as H
from logweave.llm.common import cut_lineage, documents, spread
from logweave.llm.words import byte_class, hashes, mix, slices, spans, text_bytes

_ENDS = byte_class((10, 13), *((ord(c), ord(c)) for c in ".,;:!?"))
_WORD = ~(_ENDS | byte_class((9, 9), (32, 32)))
_BYTES = 10_000_000     # of text looked at together (a longer text alone)
_TWO, _THREE = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
_BLOBS = "part int, shard int, support bigint, keys binary, sums binary"


def _blobs(parts: int, shard: int, support: int, keys: np.ndarray):
    """Rows (part, shard, support, distinct keys, counts) of some phrase occurrences."""
    import pyarrow as pa

    keys, n = np.unique(keys, return_counts=True)
    for p, a, e in H.runs(H.part_of(keys, parts)):
        yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([shard], pa.int32()), pa.array([support], pa.int64()), pa.array([H.planes(keys[a:e])], pa.binary()),
                                          pa.array([H.planes(n[a:e].astype(np.uint32))], pa.binary())], ["part", "shard", "support", "keys", "sums"])


def _groups(batches):
    """(part, {(shard, support): ([keys], [sums])}) of rows sorted by part."""
    part, got = None, {}
    for b in batches:
        for p, shard, support, keys, sums in zip(*(b.column(i).to_pylist() for i in range(5))):
            if p != part and got:
                yield part, got
                got = {}
            part = p
            k, v = got.setdefault((shard, support), ([], []))
            k.append(H.unplanes(keys, "u8"))
            v.append(H.unplanes(sums, "u4").astype(np.int64))
    if got:
        yield part, got


def _written(part: int, size: int):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([size], pa.int64())], ["part", "size"])


def _store_words(root: str, shards: int):
    """All words with their count in each slice."""
    def run(batches):
        for part, got in _groups(batches):
            mine = {s: H.add_up(k, v) for (s, _), (k, v) in got.items()}
            keys = np.unique(np.concatenate([k for k, _ in mine.values()]))
            n = np.zeros((len(keys), shards), np.int64)
            for s, (k, v) in mine.items():
                n[np.searchsorted(keys, k), s] = v
            H.write(root, "word", part, keys)
            H.write(root, "count", part, n)
            yield _written(part, len(keys))
    return run


def _store_phrases(root: str, name: str):
    """The phrases that reach the support of a slice, with a bit for each such slice."""
    def run(batches):
        for part, got in _groups(batches):
            found = []
            for (s, support), (k, v) in got.items():
                keys, n = H.add_up(k, v)
                found.append((keys[n >= support], 1 << s))
            keys = np.unique(np.concatenate([k for k, _ in found]))
            bits = np.zeros(len(keys), np.int64)
            for k, bit in found:
                bits[np.searchsorted(keys, k)] |= bit
            H.write(root, name, part, keys)
            H.write(root, f"{name}-in", part, bits)
            yield _written(part, len(keys))
    return run


class _Shard:
    """Places of the corpus-wide tables, as a task needs them."""

    def __init__(self, root: str, parts: int, shards: int, least: int):
        self.root, self.parts, self.shards, self.least = root, parts, shards, least

    def get(self, name: str, value: str, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of some ascending keys are there, and the entries of those."""
        there, out = np.zeros(len(keys), bool), []
        for p, a, e in H.runs(H.part_of(keys, self.parts)):
            at = H.find(H.read(self.root, name, p), keys[a:e])
            there[a:e] = at >= 0
            if there[a:e].any():
                out.append(H.read(self.root, value, p)[at[at >= 0]])
        return there, np.concatenate(out) if out else np.zeros(0, np.int64)


class _Texts:
    """Some texts as word keys (the language is part of a key)."""

    def __init__(self, lang: list[str], shard: np.ndarray, data: np.ndarray, bounds: np.ndarray):
        import xxhash

        self.data, self.lang, self.shard = data, lang, shard
        self.start, self.end = spans(data, bounds, _WORD)
        self.text = np.searchsorted(bounds[1:], self.start, "right")
        names = {x: xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass"), 1) for x in set(lang)}
        self.code = mix(np.array([names[x] for x in lang], np.uint64))
        self.key = mix(hashes(data, self.start, self.end) ^ self.code[self.text])
        piece = np.searchsorted(np.flatnonzero(_ENDS[data]), self.start)
        # a word and the next one in one piece of one text
        self.joined = (piece[1:] == piece[:-1]) & (self.text[1:] == self.text[:-1])

    def supports(self, of: _Shard) -> np.ndarray:
        """The local support of each text's language in each slice (text x slice)."""
        codes, back = np.unique(self.code, return_inverse=True)
        n = np.zeros((len(codes), of.shards), object)
        there, counts = of.get("word", "count", codes)
        n[there] = counts
        total = np.maximum(n.sum(axis=1, keepdims=True), 1)
        return np.maximum(-(-of.least * n // total), 1).astype(np.int64)[back]

    def pairs(self, at: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix(self.key[at] * _TWO + self.key[at + 1])

    def triples(self, at: np.ndarray, pair: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix(pair * _THREE + self.key[at + 2])

    def counts(self, of: _Shard) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct word keys, the place of each word among them, and their counts by slice."""
        words, inv = np.unique(self.key, return_inverse=True)
        n = np.zeros((len(words), of.shards), np.int64)
        there, found = of.get("word", "count", words)
        n[there] = found
        return words, inv, n


def _texts(batches):
    for b in batches:
        data, bounds = text_bytes(b.column(2))
        lang, shard = b.column(0).to_pylist(), np.asarray(b.column(1))
        for a, e in slices(bounds, _BYTES):
            yield _Texts(lang[a:e], shard[a:e], data[bounds[a]:bounds[e]], bounds[a:e + 1] - bounds[a])


def _count_words(of: _Shard):
    def run(batches):
        for t in _texts(batches):
            # a language's own code stands for all its words
            keys = np.concatenate([t.key, t.code[t.text]])
            shard = np.tile(t.shard[t.text], 2)
            for s in np.unique(shard):
                yield from _blobs(of.parts, int(s), 0, keys[shard == s])
    return run


def _by_support(of: _Shard, t: _Texts, at: np.ndarray, keys: np.ndarray, support: np.ndarray):
    """Blobs of phrase occurrences that start at words ``at``."""
    group = t.shard[t.text[at]] + of.shards * support[at]
    for g in np.unique(group):
        yield from _blobs(of.parts, int(g % of.shards), int(g // of.shards), keys[group == g])


def _frequent(of: _Shard, t: _Texts) -> tuple[np.ndarray, np.ndarray]:
    """Per word: whether it is frequent in its own slice, and that slice's support."""
    _, inv, n = t.counts(of)
    shard = t.shard[t.text]
    support = t.supports(of)[t.text, shard]
    return n[inv, shard] >= support, support


def _count_pairs(of: _Shard):
    def run(batches):
        for t in _texts(batches):
            if not len(t.key):
                continue
            ok, support = _frequent(of, t)
            at = np.flatnonzero(t.joined & ok[1:] & ok[:-1])
            yield from _by_support(of, t, at, t.pairs(at), support)
    return run


def _count_triples(of: _Shard):
    def run(batches):
        for t in _texts(batches):
            if not len(t.key):
                continue
            ok, support = _frequent(of, t)
            at = np.flatnonzero(t.joined & ok[1:] & ok[:-1])
            key = t.pairs(at)
            some, inv = np.unique(key, return_inverse=True)
            there, bits = of.get("pair", "pair-in", some)
            mask = np.zeros(len(some), np.int64)
            mask[there] = bits
            ok = (mask[inv] >> t.shard[t.text[at]]) & 1 == 1
            at, key = at[ok], key[ok]
            follows = np.flatnonzero(at[1:] == at[:-1] + 1)      # a frequent pair and the next one
            at = at[follows]
            yield from _by_support(of, t, at, t.triples(at, key[follows]), support)
    return run


def _count_all(of: _Shard):
    """(lang, a, b, c, f): occurrences of every candidate; words with null b, pairs with null c,
    a language's words with null a."""
    def run(batches):
        import pyarrow as pa

        def rows(t, at, n, width):
            """Phrases of ``width`` words, the first of each at word ``at``."""
            cols = [pa.array(t.key[at + i].view(np.int64)) if i < width else pa.nulls(len(at), pa.int64()) for i in range(3)]
            return pa.RecordBatch.from_arrays([pa.array([t.lang[i] for i in t.text[at]], pa.string()), *cols, pa.array(n, pa.int64())], ["lang", "a", "b", "c", "f"])

        def distinct(t, at, key, name):
            """Mask of the occurrences that are candidates, their distinct rows, and their counts."""
            some, first, inv, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
            there, _ = of.get(name, f"{name}-in", some)
            return there[inv], at[first[there]], n[there]

        for t in _texts(batches):
            if not len(t.key):
                continue
            yield rows(t, *_language_words(t), 0)
            words, inv, n = t.counts(of)
            first = np.zeros(len(words), np.int64)
            first[inv[::-1]] = np.arange(len(inv))[::-1]
            ok = (n >= t.supports(of)[t.text[first]]).any(axis=1)
            yield rows(t, first[ok], np.bincount(inv, minlength=len(words))[ok], 1)
            at = np.flatnonzero(t.joined & ok[inv][1:] & ok[inv][:-1])
            key = t.pairs(at)
            ok, where, n = distinct(t, at, key, "pair")
            yield rows(t, where, n, 2)
            at, key = at[ok], key[ok]
            follows = np.flatnonzero(at[1:] == at[:-1] + 1)
            at = at[follows]
            _, where, n = distinct(t, at, t.triples(at, key[follows]), "triple")
            yield rows(t, where, n, 3)
    return run


def _language_words(t: _Texts) -> tuple[np.ndarray, np.ndarray]:
    _, first, n = np.unique(t.code[t.text], return_index=True, return_counts=True)
    return first, n


def _store_keys(root: str):
    def run(batches):
        for part, got in _groups(batches):
            keys = np.unique(np.concatenate([k for ks, _ in got.values() for k in ks]))
            H.write(root, "wanted", part, keys)
            yield _written(part, len(keys))
    return run


def _as_blobs(parts: int):
    def run(batches):
        for b in batches:
            yield from _blobs(parts, 0, 0, np.asarray(b.column(0)).view(np.uint64))
    return run


def _spell(of: _Shard):
    """(a, word) of the wanted words, once per some texts."""
    def run(batches):
        import pyarrow as pa

        for t in _texts(batches):
            words, first = np.unique(t.key, return_index=True)
            there, _ = of.get("wanted", "wanted", words)
            first = first[there]
            yield pa.RecordBatch.from_arrays([pa.array(words[there].view(np.int64)), pa.array(
                [t.data[a:e].tobytes().lower().decode("utf-8", "replace") for a, e in zip(t.start[first], t.end[first])], pa.string())], ["a", "word"])
    return run


def _with(df: DataFrame, freq: DataFrame, keys: list[str], name: str) -> DataFrame:
    """f of the phrase made of ``keys`` as column ``name``."""
    some = freq.where(" and ".join(f"{c} is {'not ' if i < len(keys) else ''}null" for i, c in enumerate("abc")))
    some = some.select(F.col("lang").alias("__l"), *(F.col(c).alias(f"__{c}") for c in "abc"[:len(keys)]), F.col("f").alias(name))
    on = F.col("lang") == F.col("__l")
    for c, k in zip("abc", keys):
        on &= F.col(f"__{c}") == F.col(k)
    return df.join(some, on).drop("__l", "__a", "__b", "__c")


def collocations(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", least: int = 10, covered: int = 50, top: int = 2000, shards: int = 4) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of 2 to 3 words a language.

    Words are runs without space and tab, and phrases stay within pieces between line ends and
    ``. , ; : ! ?``. ``a`` counts a phrase (``least`` at least), ``l`` and ``r`` its two parts
    at the lowest-scoring cut, ``n`` the language's words; score is floor(10^6 a a / (l r)). A
    pair is dropped when a frequent triple around it has ``covered`` percent of its count.
    Ties go by count, then by phrase in byte order. A null language is ``und``; null and empty
    texts hold nothing, repeated rows count as often as they occur; no words, no rows.
    """
    if not 1 <= shards <= 62:
        raise ValueError("shards must be 1 to 62")
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.pmod(F.xxhash64(F.col(key), F.col(text)), F.lit(shards)).cast("int").alias("shard"), F.col(text).alias("t"))
    rows = spread(rows.where("t is not null"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * rows.rdd.getNumPartitions())
    of = _Shard(H.folder(spark), parts, shards, least)

    def level(count, store) -> None:
        dealt = rows.mapInArrow(count, _BLOBS).repartition(parts, "part").sortWithinPartitions("part")
        cut_lineage(dealt.mapInArrow(store, "part int, size bigint"))

    level(_count_words(of), _store_words(of.root, shards))
    level(_count_pairs(of), _store_phrases(of.root, "pair"))
    level(_count_triples(of), _store_phrases(of.root, "triple"))
    freq = rows.mapInArrow(_count_all(of), "lang string, a bigint, b bigint, c bigint, f bigint").groupBy("lang", "a", "b", "c").agg(F.sum("f").alias("f"))
    freq = cut_lineage(freq.where((F.col("f") >= least) | F.col("a").isNull()))

    def cut(df, k):
        df = df.withColumn("score", F.expr("(cast(1000000 as decimal(7,0)) * cast(f as decimal(15,0)) * cast(f as decimal(15,0))) div (cast(l as decimal(15,0)) * cast(r as decimal(15,0)))"))
        return df.select("lang", "a", "b", "c", "f", F.struct("score", F.lit(k).alias("k"), "l", "r").alias("cut"))

    two = freq.where("b is not null and c is null")
    three = freq.where("c is not null")
    inner = three.select("lang", "a", "b", "f").union(three.select("lang", "b", "c", "f")).groupBy("lang", "a", "b").agg(F.max("f").alias("longer"))
    alone = two.join(inner, ["lang", "a", "b"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("f"))).select("lang", "a", "b", "c", "f")
    cuts = cut(_with(_with(alone, freq, ["a"], "l"), freq, ["b"], "r"), 1)
    one, other = cut(_with(_with(three, freq, ["a"], "l"), freq, ["b", "c"], "r"), 1), cut(_with(_with(three, freq, ["a", "b"], "l"), freq, ["c"], "r"), 2)
    cuts = cuts.union(one.union(other).groupBy("lang", "a", "b", "c", "f").agg(F.min("cut").alias("cut")))
    by = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("f"))
    best = cuts.withColumn("place", F.rank().over(by)).where(F.col("place") <= top).drop("place")
    best = cut_lineage(best.join(freq.where("a is null").select("lang", F.col("f").alias("n")), "lang"))

    # the words of what may be among the first
    wanted = best.select(F.explode(F.array("a", "b", "c")).alias("a")).where("a is not null").distinct().mapInArrow(_as_blobs(parts), _BLOBS)
    cut_lineage(wanted.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_store_keys(of.root), "part int, size bigint"))
    spelt = rows.mapInArrow(_spell(of), "a bigint, word string").groupBy("a").agg(F.min("word").alias("word"))
    spelt = cut_lineage(spelt)
    for c in "abc":
        best = best.join(spelt.select(F.col("a").alias(f"__{c}"), F.col("word").alias(f"w{c}")), F.col(c) == F.col(f"__{c}"), "left").drop(f"__{c}")
    out = best.select("lang", F.concat_ws(" ", "wa", "wb", "wc").alias("phrase"), F.col("f").alias("a"), "cut.l", "cut.r", "n", "cut.score")
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long"))
    return out.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: the best 2000 phrases of each language of ``documents``."""
    return collocations(documents(spark, sf_dir).select("doc_id", "text", "lang"))


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
words AS (SELECT lang, unnest(w) AS p FROM w),
two AS (SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: [w[i], w[i + 1]])) AS p FROM w WHERE len(w) > 1),
three AS (SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: [w[i], w[i + 1], w[i + 2]])) AS p FROM w WHERE len(w) > 2),
f1 AS (SELECT lang, p, count(*) AS f FROM words GROUP BY ALL HAVING count(*) >= 10),
f2 AS (SELECT lang, p, count(*) AS f FROM two GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, p, count(*) AS f FROM three GROUP BY ALL HAVING count(*) >= 10),
total AS (SELECT lang, count(*) AS n FROM words GROUP BY ALL),
longer AS (SELECT lang, p, max(f) AS f FROM (SELECT lang, p[1:2] AS p, f FROM f3 UNION ALL SELECT lang, p[2:3] AS p, f FROM f3) GROUP BY ALL),
cuts AS (
  SELECT c.lang, c.p, c.f AS a, x.f AS l, y.f AS r, 1 AS k
  FROM f2 c JOIN f1 x ON x.lang = c.lang AND x.p = c.p[1] JOIN f1 y ON y.lang = c.lang AND y.p = c.p[2]
  LEFT JOIN longer o ON o.lang = c.lang AND o.p = c.p WHERE o.f IS NULL OR 100 * o.f < 50 * c.f
  UNION ALL
  SELECT c.lang, c.p, c.f, x.f, y.f, 1 FROM f3 c JOIN f1 x ON x.lang = c.lang AND x.p = c.p[1] JOIN f2 y ON y.lang = c.lang AND y.p = c.p[2:3]
  UNION ALL
  SELECT c.lang, c.p, c.f, x.f, y.f, 2 FROM f3 c JOIN f2 x ON x.lang = c.lang AND x.p = c.p[1:2] JOIN f1 y ON y.lang = c.lang AND y.p = c.p[3]),
scored AS (SELECT *, CAST((1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS BIGINT) AS score FROM cuts),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
ranked AS (SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, score FROM lowest)
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS BIGINT) AS rank, phrase, a, l, r, n, score
FROM ranked JOIN total USING (lang)
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""
