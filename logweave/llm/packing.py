"""Packing along a space-filling curve.

Documents are tokenised whole; the counts of their hashed token ids are projected to three
dimensions, quantised, and the cell's position on a Hilbert curve is the document's key. The
table is range-sorted by key, every document gets its place in the one stream of tokens, and
the stream is cut every ``length`` tokens: neighbours on the curve share sequences. What is
left at the end becomes sequences of powers of two, so no sequence needs padding.

Scale: token ids are written once (two bytes each) and shuffled once. The global places come
from a range partitioning of (key, size) rows: a running sum inside each partition plus the
total of the partitions before it, one row per partition. A cell that holds a third of all
documents is split by the range partitioner, since ties are ordered by content and row.
"""

from __future__ import annotations

import functools
import os
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweave.llm.common import cut_lineage, documents, spread
from logweave.llm.hashstore import find
from logweave.llm.words import byte_class, hashes, slices, spans, text_bytes

_HASHED, _DIMS, _BITS = 1024, 3, 10
_CACHE = 3_000_000      # parts a worker keeps
_LEARN = 10_000         # parts encoded together: an encoding is some 100 times its part
_BYTES = 1_000_000      # of text tokenised together (a longer text alone)
_PART = ~byte_class((10, 10), (32, 32))
_ALNUM = byte_class((48, 57), (65, 90), (97, 122))
_SIGNS = byte_class((33, 38), (40, 47), (58, 64), (91, 96), (123, 126))     # ASCII signs but the apostrophe


class _Tokens:
    """Ids of texts, by the ids of their parts.

    The tokenizer never joins across a space or a line feed, so a text's ids are those of
    its parts in order. One that also splits words from ASCII signs (by its pre-tokenizer's
    pattern) has its parts cut there, apostrophes aside, and one that lower-cases has them
    compared without case: far fewer distinct parts. Each is encoded once while it stays in
    the cache, sorted hashes with the places of the ids in one array.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        size = self.encoder.get_vocab_size()
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.size = size
        self.fold = "Lowercase()" in str(self.encoder.normalizer)
        signs = r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" in str(self.encoder.pre_tokenizer).replace("\\\\", "\\")
        self.between = (_ALNUM, _SIGNS) if signs else None
        self.added = [t.content.encode() for t in self.encoder.get_added_tokens_decoder().values()]
        self._clear()
        rng = np.random.default_rng(11)
        at, sign = rng.integers(0, _HASHED, size), rng.choice([-1.0, 1.0], size)
        self.project = (sign[:, None] * rng.normal(size=(_HASHED, _DIMS))[at]).astype(np.float32)

    def _clear(self):
        self.keys, self.at, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, self.kind)

    def _learn(self, keys: np.ndarray, parts: list[str]) -> None:
        flat, n = [self.flat], []
        for a in range(0, len(parts), _LEARN):
            ids = [e.ids for e in self.encoder.encode_batch_fast(parts[a:a + _LEARN], add_special_tokens=False)]
            n.append(np.fromiter(map(len, ids), np.int64, len(ids)))
            flat.append(np.fromiter((i for x in ids for i in x), self.kind, int(n[-1].sum())))
        n = np.concatenate(n)
        at = len(self.flat) + np.cumsum(n) - n
        self.flat = np.concatenate(flat)
        keys, at, n = np.concatenate([self.keys, keys]), np.concatenate([self.at, at]), np.concatenate([self.n, n])
        order = np.argsort(keys)
        self.keys, self.at, self.n = keys[order], at[order], n[order]

    def ids(self, texts: list[str], end: int) -> list[bytes]:
        """Each text's ids with ``end`` behind them, as bytes of ``kind``."""
        import pyarrow as pa

        ids, n = self.ids_of(*text_bytes(pa.array(texts, pa.string())), end)
        return [x.tobytes() for x in np.split(ids, np.cumsum(n)[:-1])]

    def _with_added(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Numbers of the texts in which an added token's text occurs."""
        raw, places = data.tobytes(), []
        for t in self.added:
            at = raw.find(t)
            while at >= 0:
                places.append(at)
                at = raw.find(t, at + 1)
        return np.unique(np.searchsorted(bounds[1:], places, "right"))

    def ids_of(self, data: np.ndarray, bounds: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some texts, each with ``end`` behind it, and how many each has."""
        start, stop = spans(data, bounds, _PART, self.between)
        keys = hashes(data, start, stop, self.fold)
        odd = self._with_added(data, bounds)
        if len(odd):
            # texts that spell an added token keep their signs joined and their case
            a, e = spans(data, bounds, _PART)
            rest = ~np.isin(np.searchsorted(bounds[1:], start, "right"), odd)
            here = np.isin(np.searchsorted(bounds[1:], a, "right"), odd)
            start, stop = np.concatenate([start[rest], a[here]]), np.concatenate([stop[rest], e[here]])
            keys = np.concatenate([keys[rest], hashes(data, a[here], e[here], False)])
            order = np.argsort(start)
            start, stop, keys = start[order], stop[order], keys[order]
        keys, first, inv = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.keys) > _CACHE:
            self._clear()
        new = np.flatnonzero(find(self.keys, keys) < 0)
        if len(new):
            self._learn(keys[new], [data[a:e].tobytes().decode("utf-8", "replace") for a, e in zip(start[first[new]], stop[first[new]])])
        place = find(self.keys, keys)
        n, at = self.n[place][inv], self.at[place][inv]
        text = np.searchsorted(bounds[1:], start, "right")
        total = int(n.sum())
        ahead = np.cumsum(n) - n
        out = np.full(total + len(bounds) - 1, end, self.kind)
        step = np.arange(total)
        out[step + np.repeat(text, n)] = self.flat[step + np.repeat(at - ahead, n)]
        return out, np.bincount(text, n, len(bounds) - 1).astype(np.int64) + 1

    def vectors(self, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Per text the unit-variance projection of the square roots of its id counts."""
        pair, count = np.unique(np.repeat(np.arange(len(n), dtype=np.uint64), n) * np.uint64(self.size) + ids, return_counts=True)
        text, seen = pair // np.uint64(self.size), (pair % np.uint64(self.size)).astype(np.int64)
        first = np.searchsorted(text, np.arange(len(n), dtype=np.uint64))
        return np.add.reduceat(np.sqrt(count)[:, None] * self.project[seen], first, axis=0) / np.sqrt(n)[:, None]


@functools.lru_cache(maxsize=1)
def _tokens(path: str) -> _Tokens:
    return _Tokens(path)


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of each row of integer coordinates (Skilling's method)."""
    x = cells.T.astype(np.int64).copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[dims - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _curve(vectors: np.ndarray) -> np.ndarray:
    """Keys of projected vectors: coordinates through a logistic curve to the grid."""
    grid = 1.0 / (1.0 + np.exp(-1.6 * np.clip(vectors, -20, 20)))
    return hilbert(np.minimum((grid * (1 << _BITS)).astype(np.int64), (1 << _BITS) - 1), _BITS)


def _encode(path: str, end: int):
    def run(batches):
        import pyarrow as pa

        tokens = _tokens(path)
        for b in batches:
            data, bounds = text_bytes(b.column(1))
            for a, e in slices(bounds, _BYTES):
                ids, n = tokens.ids_of(data[bounds[a]:bounds[e]], bounds[a:e + 1] - bounds[a], end)
                ends = np.concatenate([[0], np.cumsum(n) * tokens.kind.itemsize])
                raw = pa.Array.from_buffers(pa.large_binary(), e - a, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(ids)])
                tie = [zlib.crc32(x.as_buffer()) for x in raw]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, e - a), pa.array(n), pa.array(_curve(tokens.vectors(ids, n)), pa.int64()),
                                                  pa.array(tie, pa.int64()), raw.cast(pa.binary())], ["id", "n", "curve", "tie", "ids"])
    return run


def _cut(path: str, length: int, total: int, with_ids: bool, name: str):
    """(id, n, at, ids) -> pieces."""
    whole = total // length * length
    tail, left = [], total - whole
    while left:
        tail.append(1 << (left.bit_length() - 1))
        left -= tail[-1]
    starts = whole + np.cumsum([0, *tail[:-1]]) if tail else np.zeros(0, np.int64)

    def place(at):
        """(sequence, its start, its end) of a position."""
        if at < whole:
            return at // length, at // length * length, (at // length + 1) * length
        k = int(np.searchsorted(starts, at, "right")) - 1
        return whole // length + k, int(starts[k]), int(starts[k]) + tail[k]

    def run(batches):
        import pyarrow as pa

        kind = _tokens(path).kind
        for b in batches:
            rows, out, pieces = [], [[] for _ in range(6)], []
            for i, (n, at, raw) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3))):
                ids = np.frombuffer(raw.as_buffer(), kind).astype("<u4")
                done = 0
                while done < n:
                    seq, a, e = place(at + done)
                    m = min(n - done, e - at - done)
                    part = ids[done:done + m]
                    rows.append(i)
                    for c, v in zip(out, (done, m, zlib.crc32(part.tobytes()), n, seq, at + done - a)):
                        c.append(v)
                    if with_ids:
                        pieces.append(part.astype(np.int64))
                    done += m
            cols = [b.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, pa.int64()) for c in out)]
            names = [name, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                cols.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, pieces)]), pa.int32()), pa.array(np.concatenate(pieces) if pieces else np.zeros(0, np.int64))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)
    return run


def pack(docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text", length: int = 4096, end: int = 2, with_ids: bool = True) -> DataFrame:
    """Pieces (key, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]).

    Every row of ``docs`` is a document of its own, repeated rows included; a null or empty
    text is the end sign alone. Each id lies in one piece; sequences are gapless from 0 and
    ``length`` or a smaller power of two long. The order depends on content, key and, for
    equal rows, nothing that shows. An empty table gives no piece.
    """
    kind = docs.schema[key].dataType.simpleString()
    made = docs.select(F.col(key).alias("id"), F.col(text).alias("t")).mapInArrow(_encode(path, end), f"id {kind}, n bigint, curve bigint, tie bigint, ids binary")
    made = cut_lineage(made.withColumn("row", F.monotonically_increasing_id()))
    order = [F.col("curve"), F.col("tie"), F.col("id").asc_nulls_first(), F.col("row")]
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), made.rdd.getNumPartitions())
    light = cut_lineage(made.select("row", "id", "curve", "tie", "n").repartitionByRange(parts, *order).withColumn("p", F.spark_partition_id()))
    sums = light.groupBy("p").agg(F.sum("n").alias("m"))
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)      # one row per partition
    sums = cut_lineage(sums.withColumn("base", F.coalesce(F.sum("m").over(before), F.lit(0))))
    total = sums.agg(F.sum("m")).first()[0] or 0
    inside = Window.partitionBy("p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    at = light.withColumn("ahead", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(sums, "p").select("row", (F.col("base") + F.col("ahead")).alias("at"))
    schema = f"`{key}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + (", ids array<bigint>" if with_ids else "")
    return made.select("row", "id", "n", "ids").join(at, "row").select("id", "n", "at", "ids").mapInArrow(_cut(path, length, total, with_ids, key), schema)


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, input_ids) from the pieces with their ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))      # at most ``length`` pieces
    return pieces.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("input_ids"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: pieces of all documents."""
    import public_tokenizers

    return pack(spread(documents(spark, sf_dir).select("doc_id", "text")), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)
