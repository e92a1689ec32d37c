"""Hard-negative mining by a secondary sort of scored pairs.

Every anchor is scored against every row in blocks. Two passes keep what leaves a block
small: the first sends each block's best same-label rows of an anchor, of which the globally
best are its positives; a positive with score ``s`` opens the window ``[low s, high s]``, and
the second pass sends each block's first rows of other labels inside the anchor's windows (a
row that is not among the first of its block is not among the first of all). The pairs that
are left carry the composite key (anchor, descending score, positives first, id); they are
dealt by anchor and sorted inside their partitions by that key (``repartition`` with
``sortWithinPartitions``, Spark's secondary sort). One iterator reads each partition in
order: a positive opens its window, a negative is emitted to every open window it lies in,
and a window closes when it is full or the scores have fallen below it. A window's scores lie
at or below its positive's, so no anchor is ever held: the state is a handful of windows.

Scale: a block is a hashed share of the rows (``block`` of them at most on average), read
into a worker once; the anchors pass it as a stream, sent to each block. Scores are exact:
floats up to 2^53, 64-bit integers up to 2^63, Python integers beyond (held to 64 bits).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweave.llm.common import cut_lineage, spread

_CELLS = 4_000_000      # scores a worker holds at a time
_LEAST = np.iinfo(np.int64).min
_MOST = np.iinfo(np.int64).max


def _integers(scale: int):
    """(id, a, label, vector) -> the same with the vector as little-endian integers; rows with
    a null or non-finite component go."""
    def run(batches):
        import pyarrow as pa

        for b in batches:
            vec = b.column(3)
            flat = vec.flatten()
            x = np.asarray(flat.cast(pa.float64()).fill_null(np.nan))
            ends = np.cumsum([0, *np.asarray(vec.value_lengths().fill_null(0))])
            bad = np.flatnonzero(~np.isfinite(x))
            keep = np.ones(len(vec), bool)
            keep[np.searchsorted(ends, bad, "right") - 1] = False
            with np.errstate(over="ignore", invalid="ignore"):
                q = np.floor(scale * x)
            q = np.where(q >= 2.0 ** 63, _MOST, np.where(q <= -2.0 ** 63, _LEAST, np.where(np.abs(q) < 2.0 ** 63, q, 0).astype(np.int64)))
            rows = np.flatnonzero(keep)
            vectors = []
            for i in rows:
                v = q[ends[i]:ends[i + 1]]
                vectors.append(v.astype("<i2").tobytes() if not len(v) or (v.max() < 1 << 15 and v.min() >= -(1 << 15)) else b"L" + v.astype("<i8").tobytes())
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(take) for c in range(3)), pa.array(vectors, pa.binary())], ["id", "a", "label", "q"])
    return run


def _matrix(raw: list[bytes]) -> np.ndarray:
    """Vectors as rows; shorter ones count zeros behind their last component."""
    rows = [np.frombuffer(x, "<i2") if len(x) % 2 == 0 else np.frombuffer(x, "<i8", offset=1) for x in raw]
    wide = max(map(len, rows), default=0)
    wide_kind = np.int64 if any(r.dtype.itemsize == 8 for r in rows) else np.int16
    out = np.zeros((len(rows), wide), wide_kind)
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return out


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products, held to 64 bits."""
    w = min(a.shape[1], b.shape[1])
    a, b = a[:, :w], b[:, :w]
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = w * max(abs(int(a.max())), abs(int(a.min()))) * max(abs(int(b.max())), abs(int(b.min())))
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 1 << 63:
        return a.astype(np.int64) @ b.astype(np.int64).T
    return np.array([[min(max(int(v), _LEAST), _MOST) for v in r] for r in a.astype(object) @ b.astype(object).T], np.int64)


def _first(s: np.ndarray, ok: np.ndarray, k: int) -> np.ndarray:
    """Mask of each line's ``k`` highest allowed scores; ties to the left."""
    if s.shape[1] <= k:
        return ok
    v = np.where(ok, s, _LEAST)
    at = np.partition(v, -k, axis=1)[:, -k][:, None]
    above = ok & (s > at)
    tie = ok & (s == at)
    room = k - above.sum(axis=1, keepdims=True)
    return above | (tie & (np.cumsum(tie, axis=1) <= room))


def _blocks(choose):
    """A partition's blocks, rows (kind 0, by id) before anchors (kind 1): yields the (anchor,
    score, id) that ``choose(scores, same label, not itself, batch of anchors)`` picks."""
    def run(batches):
        import pyarrow as pa

        block, held, ready = None, [], None
        for b in batches:
            g, kind = np.asarray(b.column(0)), np.asarray(b.column(1))
            edges = np.flatnonzero((g[1:] != g[:-1]) | (kind[1:] != kind[:-1])) + 1
            for lo, hi in zip([0, *edges], [*edges, len(g)]):
                if lo == hi:
                    continue
                part = b.slice(lo, hi - lo)
                if g[lo] != block:
                    block, held, ready = g[lo], [], None
                if kind[lo] == 0:
                    held.append((np.asarray(part.column(2)), np.asarray(part.column(3)), np.asarray(part.column(4)), _matrix(part.column(5).to_pylist())))
                    continue
                if not held:
                    continue
                if ready is None:
                    wide = max(m.shape[1] for *_, m in held)
                    ready = (*(np.concatenate([h[i] for h in held]) for i in range(3)),
                             np.concatenate([np.pad(m, ((0, 0), (0, wide - m.shape[1]))) for *_, m in held]))
                row, ids, label, matrix = ready
                step = max(1, _CELLS // len(row))
                for a in range(0, hi - lo, step):
                    some = part.slice(a, step)
                    mine, of = np.asarray(some.column(2)), np.asarray(some.column(4))
                    s = _scores(_matrix(some.column(5).to_pylist()), matrix)
                    pick = choose(s, of[:, None] == label[None, :], mine[:, None] != row[None, :], some)
                    i, j = np.nonzero(pick)
                    yield pa.RecordBatch.from_arrays([pa.array(mine[i]), pa.array(s[i, j]), pa.array(ids[j])], ["anchor", "score", "id"])
    return run


def _positives(k: int):
    return lambda s, same, other, some: _first(s, same & other, k)


def _in_windows(k: int):
    def choose(s, same, other, some):
        lo, hi = some.column(6).to_pylist(), some.column(7).to_pylist()
        pick = np.zeros(s.shape, bool)
        for w in range(max(map(len, lo), default=0)):
            a = np.array([x[w] if w < len(x) else 1 for x in lo], np.int64)[:, None]
            b = np.array([x[w] if w < len(x) else 0 for x in hi], np.int64)[:, None]
            pick |= _first(s, ~same & (s >= a) & (s <= b), k)
        return pick
    return choose


def window_of(score: int, low: int, high: int) -> tuple[int, int]:
    """Scores x with low * score <= 100 * x <= high * score."""
    return -((-low * score) // 100), high * score // 100


def _emit(k: int, low: int, high: int):
    """Reads (anchor, score, kind, id) in key order; ``anchor`` is a row, ``name`` its id."""
    def run(batches):
        import pyarrow as pa

        anchor, windows = None, []
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            for a, name, s, kind, i in zip(*(b.column(c).to_pylist() for c in ("anchor", "name", "score", "kind", "id"))):
                if a != anchor:
                    anchor, windows = a, []
                if kind == 0:
                    windows.append([i, s, *window_of(s, low, high), 0])
                    continue
                shut = False
                for w in windows:
                    if w[2] <= s <= w[3]:
                        w[4] += 1
                        for c, v in zip(out, (name, w[0], w[4], i, w[1], s)):
                            c.append(v)
                    shut |= w[4] == k or s < w[2]
                if shut:
                    windows = [w for w in windows if w[4] < k and s >= w[2]]
            names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "rank" else pa.int64()) for c, n in zip(out, names)], names)
    return run


def mine(rows: DataFrame, anchors, *, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256,
         positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, block: int = 65_536) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchors`` is a condition on ``rows``. Scores are inner products of ``floor(scale * x)``;
    the ``positives`` best other rows of the anchor's label are its positives, and of the rows
    of other labels with ``low * p <= 100 * n <= high * p`` the first ``negatives`` by score
    follow each. Equal scores go by key. Rows with a null key, label or vector or a null or
    non-finite component take no part. Rows of one key are rows of their own, repeated ones
    too; an anchor is only never its own positive. Vectors of unlike length are filled up with
    zeros. A positive with a negative score has an empty window. No rows, no result.
    """
    spark = rows.sparkSession
    whole = dict(rows.dtypes)[label] in ("tinyint", "smallint", "int", "bigint")
    code = F.col(label).cast("long") if whole else F.xxhash64(F.col(label))
    rows = rows.withColumn("__a", F.coalesce(F.expr(anchors) if isinstance(anchors, str) else anchors, F.lit(False)))
    rows = rows.where(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull())
    made = spread(rows.select(F.col(key).cast("long").alias("id"), F.col("__a").alias("a"), code.alias("label"), F.col(vector).alias("v")))
    made = made.mapInArrow(_integers(scale), "id bigint, a boolean, label bigint, q binary")
    made = cut_lineage(made.withColumn("row", F.monotonically_increasing_id()))
    total = made.count()
    groups = max(spark.sparkContext.defaultParallelism, math.ceil(total / block))

    none = F.array().cast("array<bigint>")
    every = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g")
    base = made.select(F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int").alias("g"), F.lit(0).alias("kind"), "row", "id", "label", "q", none.alias("lo"), none.alias("hi"))
    asks = made.where("a").select("row", "id", "label", "q")

    def scored(anchor: DataFrame, choose) -> DataFrame:
        both = base.unionByName(anchor.select(every, F.lit(1).alias("kind"), "row", "id", "label", "q", "lo", "hi"))
        both = both.repartition(groups, "g").sortWithinPartitions("g", "kind", "id")
        return both.mapInArrow(_blocks(choose), "anchor bigint, score bigint, id bigint")

    best = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
    found = scored(asks.select("*", none.alias("lo"), none.alias("hi")), _positives(positives))
    found = cut_lineage(found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= positives).drop("r"))
    # exact in 38 digits: 64-bit scores times percentages may pass 64 bits
    wide = F.col("score").cast("decimal(38,0)")
    bounds = found.where("score >= 0").select("anchor", F.ceil(low * wide / 100).cast("long").alias("lo"), F.floor(high * wide / 100).cast("long").alias("hi"))
    bounds = bounds.groupBy(F.col("anchor").alias("row")).agg(F.collect_list(F.struct("lo", "hi")).alias("w"))      # at most ``positives``
    opened = asks.join(bounds, "row").select("row", "id", "label", "q", F.col("w.lo").alias("lo"), F.col("w.hi").alias("hi"))
    pairs = found.withColumn("kind", F.lit(0)).unionByName(scored(opened, _in_windows(negatives)).withColumn("kind", F.lit(1)))
    pairs = pairs.join(asks.select(F.col("row").alias("anchor"), F.col("id").alias("name")), "anchor")
    # the secondary sort: dealt by anchor, sorted by (anchor, descending score, positives first, id)
    pairs = pairs.repartition(groups, "anchor").sortWithinPartitions("anchor", F.desc("score"), "kind", "id")
    return pairs.select("anchor", "name", "score", "kind", "id").mapInArrow(
        _emit(negatives, low, high), "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: hard negatives of every hundredth row of ``embeddings``."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(rows, "vec_id % 100 = 0")


SQL = """
WITH q AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor, a.label = b.label AS same, b.vec_id AS id,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda x: x[1] * x[2])) AS BIGINT) AS score
  FROM q a JOIN q b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor, id, score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5)
SELECT p.anchor AS anchor_id, p.id AS positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank,
       s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same
  AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY s.score DESC, s.id) <= 10
"""
