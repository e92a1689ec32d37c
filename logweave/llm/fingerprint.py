"""Document fingerprints by locally consistent parsing.

A text is parsed into phrases level by level. On each level, runs of one symbol are named
first; deterministic coin tossing then shrinks the labels of neighbours until their local
maxima lie a few symbols apart, and the symbols from one maximum to the next become a phrase
whose name is a hash of its content. Where a phrase ends depends only on a bounded
neighbourhood, so equal substrings get equal names inside, whatever their offset. The
fingerprint keeps the smallest names of two levels; likeness compares these samples.

Scale: texts are shuffled once, into ranges of ids, and sorted inside their partition; one
iterator parses them in blocks with the next row at hand. What is missing then is the row
after each partition's last: the partitions' first and last texts, one row per partition,
are compared in a second step. Results are written once, texts are not.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweave.llm.common import cut_lineage, documents

_K = np.uint64(0x9E3779B97F4A7C15)
LOW, HIGH = 1, 3          # levels whose names are sampled
LOW_SIZE, HIGH_SIZE = 16, 48
ENOUGH = 6                # high-level names that make a likeness by that level


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _K
    return x ^ (x >> np.uint64(29))


def _labels(s: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Coin tossing: labels below 6 or so, unlike between neighbours of one text.

    Each round replaces a label by twice the lowest bit in which it differs from its left
    neighbour, plus that bit; a text's first symbol takes bit 0. Neighbours stay unlike.
    """
    def toss(x, one):
        left = np.empty_like(x)
        left[1:] = x[:-1]
        left[:1] = ~x[:1]
        left[first] = x[first] ^ one
        d = x ^ left
        at = np.bitwise_count((d & (~d + one)) - one)
        return (at << 1) | ((x >> at.astype(x.dtype)) & one).astype(np.uint8)

    x = toss(s, np.uint64(1))
    for _ in range(2):
        x = toss(x, np.uint8(1))
    return x


def _level(s: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the next level and the starts of the texts in them (texts are not empty)."""
    n = len(s)
    # runs of one symbol
    new = np.empty(n, bool)
    new[:1] = True
    np.not_equal(s[1:], s[:-1], out=new[1:])
    new[start] = True
    at = np.flatnonzero(new)
    if len(at) < n:
        run = np.diff(np.append(at, n)).astype(np.uint64)
        s = s[at]
        s = np.where(run > 1, _mix(s + run * _K), s)
        start = np.searchsorted(at, start)
        n = len(s)
    lab = _labels(s, start)
    # phrases start at local maxima of the labels, and at the start of a text
    cut = np.zeros(n, bool)
    if n > 2:
        cut[1:-1] = (lab[1:-1] > lab[:-2]) & (lab[1:-1] >= lab[2:])
    cut[start] = True
    after = start[1:]
    cut[after - 1] &= np.isin(after - 1, start)     # a text's last symbol starts no phrase
    at = np.flatnonzero(cut)
    size = np.diff(np.append(at, n))
    place = (np.arange(n) - np.repeat(at, size)).astype(np.uint64)
    name = _mix(np.add.reduceat(_mix(s + (place + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)), at))
    return name, np.searchsorted(at, start)


def _sample(names: np.ndarray, k: int) -> str:
    """The k smallest distinct names (upper 32 bits) as hexadecimal digits."""
    x = np.sort((names >> np.uint64(32)).astype(np.uint32))
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x[new][:k].astype(">u4").tobytes().hex()


def fingerprints(texts: list[str]) -> list[str]:
    """``low-high``: the smallest 32-bit names of both levels, 8 hex digits each, ascending."""
    out = [""] * len(texts)
    full = [i for i, t in enumerate(texts) if t]
    if not full:
        return ["-"] * len(texts)
    codes = [np.frombuffer(texts[i].encode("utf-32-le", "surrogatepass"), np.uint32) for i in full]
    start = np.cumsum([0] + [len(c) for c in codes[:-1]])
    s = np.concatenate(codes).astype(np.uint64)
    kept = {}
    with np.errstate(over="ignore"):
        for level in range(1, HIGH + 1):
            s, start = _level(s, start)
            if level in (LOW, HIGH):
                ends = np.append(start[1:], len(s))
                k = LOW_SIZE if level == LOW else HIGH_SIZE
                kept[level] = [_sample(s[a:b], k) for a, b in zip(start, ends)]
    for i, a, b in zip(full, kept[LOW], kept[HIGH]):
        out[i] = f"{a}-{b}"
    return [x or "-" for x in out]


def likeness(a: str, b: str) -> float:
    """Estimated Jaccard of the phrase sets, from the high level when both have ``ENOUGH``
    names there, else from the low one; 1 for equal fingerprints."""
    if a == b:
        return 1.0
    (la, ha), (lb, hb) = (x.split("-") for x in (a, b))
    high = len(ha) >= 8 * ENOUGH and len(hb) >= 8 * ENOUGH
    k = HIGH_SIZE if high else LOW_SIZE
    x, y = ({s[i:i + 8] for i in range(0, len(s), 8)} for s in ((ha, hb) if high else (la, lb)))
    both = sorted(x | y)[:k]
    return sum(v in x and v in y for v in both) / len(both) if both else 0.0


def _edit(text: str, other: str) -> str:
    third = len(text) // 3
    return text[:len(text) - third] + other[:third]


def _compared(ids, own: list[str], other: list[str]):
    """Batches of results for texts and the texts after them."""
    import hashlib

    import pyarrow as pa

    a = 0
    while a < len(own):
        e, size = a, 0
        while e < len(own) and (e == a or size < 400_000):    # characters at a time
            size += 2 * len(own[e]) + len(other[e])
            e += 1
        x, y = own[a:e], other[a:e]
        edited = [_edit(t, o) for t, o in zip(x, y)]
        # within a sorted block the next row's fingerprint is mostly at hand
        seen = dict.fromkeys(x + y + edited)
        seen = dict(zip(seen, fingerprints(list(seen))))
        cols: list[list] = [[] for _ in range(8)]
        for t, o, z in zip(x, y, edited):
            f, g = seen[t], seen[z]
            names = [bytes.fromhex(h) for p in (f, g) for h in p.split("-")]
            for c, v in zip(cols, (len(t), hashlib.sha256(z.encode("utf-8", "surrogatepass")).digest(), *names, likeness(f, g), likeness(f, seen[o]))):
                c.append(v)
        empty = [pa.nulls(e - a, k) for k in (pa.int32(), pa.string(), pa.string())]
        yield pa.RecordBatch.from_arrays([ids.slice(a, e - a), *(pa.array(c, k) for c, k in zip(cols, _kinds())), *empty], _NAMES)
        a = e


# hashes as bytes: half of what their digits take where results are written
_RESULTS = "n_chars bigint, sha binary, low binary, high binary, edited_low binary, edited_high binary, near_edited double, near_next double"
_NAMES = ["doc_id", *(c.split()[0] for c in _RESULTS.split(", ")), "part", "head", "last"]


def _kinds():
    import pyarrow as pa

    return [{"bigint": pa.int64(), "binary": pa.binary(), "double": pa.float64()}[c.split()[1]] for c in _RESULTS.split(", ")]


def _shown(df: DataFrame) -> DataFrame:
    """The results with their hashes as digits."""
    digits = lambda c: F.lower(F.hex(c))
    return df.select("doc_id", "n_chars", digits("sha").alias("edited_sha256"), F.concat(digits("low"), F.lit("-"), digits("high")).alias("fingerprint"),
                     F.concat(digits("edited_low"), F.lit("-"), digits("edited_high")).alias("edited_fingerprint"), "near_edited", "near_next")


def _along(batches):
    """Rows (id, t) of a sorted partition: results of all but its last one, and a row with the
    partition's number, its first text, and its last id and text."""
    import pyarrow as pa
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    head, held = None, None         # the row before: its id (an array of one) and text
    for b in batches:
        if not b.num_rows:
            continue
        ids, ts = b.column(0), b.column(1).to_pylist()
        if held is None:
            head = ts[0]
            own, of = ts[:-1], ids.slice(0, len(ts) - 1)
        else:
            own, of = [held[1], *ts[:-1]], pa.concat_arrays([held[0], ids.slice(0, len(ts) - 1)])
            ts = [held[1], *ts]
        yield from _compared(of, own, ts[1:])
        held = (ids.slice(len(ids) - 1), ts[-1])
    if held is not None:
        yield pa.RecordBatch.from_arrays([held[0], *(pa.nulls(1, k) for k in _kinds()), pa.array([part], pa.int32()), pa.array([head]), pa.array([held[1]])], _NAMES)


def _ends(batches):
    """(id, t, o): the partitions' last rows, with the next partition's first text."""
    for b in batches:
        for r in _compared(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()):
            yield r.select(_NAMES[:9])


def compare_edits(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: fingerprint of the text, of the text whose last third is replaced by the start
    of the next row's, and both likenesses. The next row is that of the next smaller key (rows
    of one key go by their texts' hashes and texts, null keys come last), after the last the
    first; a repeated key is a row of its own. Null texts are empty; empty texts have
    fingerprint ``-`` and are like each other only. Texts are parsed whole.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    # the bounds come from keys and hashes; texts take part in the order inside a partition only
    order = [F.desc_nulls_last("id"), F.col("h")]
    dealt = rows.withColumn("h", F.xxhash64("t")).repartitionByRange(parts, *order).sortWithinPartitions(*order, "t")
    made = cut_lineage(dealt.select("id", "t").mapInArrow(_along, f"doc_id {kind}, {_RESULTS}, part int, head string, last string"))
    ends = made.where("part is not null").select(F.col("doc_id").alias("id"), F.col("last").alias("t"), "part", "head")
    around = Window.orderBy("part")     # one row per partition
    first = F.first("head").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ends = ends.withColumn("o", F.coalesce(F.lead("head").over(around), first)).select("id", "t", "o")
    ends = ends.mapInArrow(_ends, f"doc_id {kind}, {_RESULTS}")
    return _shown(made.where("part is null").select(ends.columns).union(ends))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: fingerprints of every document and of its edited text."""
    return compare_edits(documents(spark, sf_dir).select("doc_id", "text"))
