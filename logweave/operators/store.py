"""A registry of any size as sorted arrays in the shared folder, which workers map and search.

A line can hold a template's literals in order only if it holds the one under which the template
is listed, its *lead*: the literal that fewest templates have, short ones being found inside longer
words. Literals and tokens hold no white space, so a lead occurs in a line when it occurs in one of
its tokens. Leads go by the hash of their *piece* (their end, of the greatest length of ``LENGTHS``
that they have); a token's windows of these lengths are hashed and looked up at once, a token once
as long as a worker remembers it. Whatever is found is searched in order in the line, so the
hashes decide what is looked at and never what matches.

Templates are shuffled once, to the part that their piece's hash names; a task sorts and writes one
file a part, of which kinds (templates with the same literals) are the entries. No pair of a line
and a template is ever shuffled, written or sent: a worker holds the hashes' bitmap, what it
remembers of tokens and kinds (bounded), and maps the rest.

Mapping needs ``spark.checkpoint.dir`` on a path that all executors mount; :func:`write` gives None
for any other scheme.
"""

from __future__ import annotations

import json
import math
import mmap
import os
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.functions.similarity import literal_similarity_py
from logweave.session import checkpoint_dir

#: Lengths of the windows by which leads are found; beyond the sixteenth only long tokens have them.
LENGTHS = (*range(1, 17), 24, 32, 64)
#: Literals in a part, and literals whose count the driver may be sent.
PART, COUNTED = 2_000_000, 2_000_000
#: What a worker remembers: tokens, and literals of kinds.
TOKENS, HELD = 200_000, 1_000_000

_MASK = (1 << 64) - 1
_STEP, _MIX, _LEN = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9


def piece(lead: str) -> int:
    """Hash of a lead's piece."""
    n = max(x for x in LENGTHS if x <= len(lead))
    h = 0
    for c in lead[len(lead) - n:]:
        h = (h * _STEP + ord(c)) & _MASK
    h = ((h ^ (n * _LEN & _MASK)) * _MIX) & _MASK
    return ((h ^ (h >> 29)) * _STEP) & _MASK


def windows(texts: list[str]):
    """(hashes, number of the text each is from) of all windows of each length, as in ``piece``."""
    some = list(range(len(texts)))
    h, built = None, 0
    for n in LENGTHS:
        if n == 1 or n > 16:        # from here on only texts that have such a window
            some = [i for i in some if len(texts[i]) >= n]
            if not some:
                return
            code = np.frombuffer("\n".join(texts[i] for i in some).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            size = np.array([len(texts[i]) + 1 for i in some], np.int64)
            whose, h, built = np.repeat(np.array(some, np.int64), size), np.zeros(len(code) + 1, np.uint64), 0
        while built < n:
            h = h[:len(code) - built] * np.uint64(_STEP) + code[built:]
            built += 1
        if not len(h):
            return
        x = (h ^ np.uint64(n * _LEN & _MASK)) * np.uint64(_MIX)
        yield (x ^ (x >> np.uint64(29))) * np.uint64(_STEP), whose[:len(h)]


def part_of(hashes, parts: int):
    return (hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)


# ---------------------------------------------------------------------------
# Writing
# ---------------------------------------------------------------------------

def _leads(counts, literals: int, least: int, parts: int):
    """Arrow map: each template's piece and part."""
    def run(batches):
        keys, held = counts.value
        for b in batches:
            flat = b.column("hashes").flatten().to_numpy().view(np.uint64)
            size = b.column("lens").flatten().to_numpy().astype(np.float64)
            seen = np.full(len(flat), least / 2)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, flat), len(keys) - 1)
                seen = np.where(keys[at] == flat, held[at], seen)
            # what short literals meet inside other words, guessed; of equals the longer one
            guess = seen + 6.0 * literals * 12.0 ** -np.minimum(size, 40) - 1e-3 * np.minimum(size, 64)
            first = b.column("hashes").offsets.to_numpy().astype(np.int64)
            first = first - first[0]
            least_of = np.minimum.reduceat(guess, first[:-1]) if b.num_rows else guess
            lits, leads = b.column("lits").to_pylist(), []
            for i, text in enumerate(lits):
                leads.append(piece(text.split(" ")[int(np.argmax(guess[first[i]:first[i + 1]] == least_of[i]))]))
            h = np.array(leads, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(part_of(h, parts).astype(np.int32)), pa.array(h.view(np.int64)), b.column("lits"), b.column("n"), b.column("seq"), b.column("cluster_id")],
                                             names=["part", "piece", "lits", "n", "seq", "cluster_id"])
    return run


def _save(root: str, part: int, arrays: dict[str, np.ndarray]) -> None:
    """One file: a line that says where each array lies, and the arrays."""
    os.makedirs(root, exist_ok=True)
    where, at = {}, 0
    for k, x in arrays.items():
        where[k] = (x.dtype.str, len(x), at)
        at += -(-x.nbytes // 8) * 8
    head = json.dumps(where).encode()
    head += b" " * (-(len(head) + 1) % 8) + b"\n"
    own = f"{root}/{part}.{uuid.uuid4().hex}"
    with open(own, "wb") as f:
        f.write(head)
        for x in arrays.values():
            f.write(np.ascontiguousarray(x).tobytes() + b"\0" * (-x.nbytes % 8))
    os.replace(own, f"{root}/{part}.bin")       # a repeated attempt leaves the same file


def _text(x: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a large_string array."""
    at = np.frombuffer(x.buffers()[1], np.int64)[x.offset:x.offset + len(x) + 1]
    data = np.frombuffer(x.buffers()[2], np.uint8) if x.buffers()[2] is not None else np.zeros(0, np.uint8)
    return at - at[0], data[at[0]:at[-1]]


def _parts(root: str):
    """Arrow map over sorted rows: writes the file of each part."""
    def write_part(part: int, t: pa.Table):
        lits, ids = (pc.cast(t.column(c), pa.large_string()).combine_chunks() for c in ("lits", "cluster_id"))
        lits, ids = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (lits, ids))
        h = t.column("piece").to_numpy().view(np.uint64)
        new = np.ones(len(h), bool)
        new[1:] = pc.not_equal(lits[1:], lits[:-1]).to_numpy(zero_copy_only=False) | (h[1:] != h[:-1])
        at = np.flatnonzero(new)                # a kind's first row has its least seq, of these the least id
        kind = h[at]
        lead = np.ones(len(kind), bool)
        lead[1:] = kind[1:] != kind[:-1]
        lead = np.flatnonzero(lead)
        own = ids.take(pa.array(at))
        (toff, txt), (ioff, itxt) = _text(lits.take(pa.array(at))), _text(pc.fill_null(own, ""))
        _save(root, part, {"piece": kind[lead], "start": np.append(lead, len(kind)), "m": np.diff(np.append(at, len(h))), "n": t.column("n").to_numpy()[at].astype(np.int64), "seq": t.column("seq").to_numpy()[at],
                           "toff": toff, "ioff": ioff, "none": pc.is_null(own).to_numpy(zero_copy_only=False).astype(np.uint8), "txt": txt, "itxt": itxt})
        return part, len(lead), len(kind)

    def run(batches):
        rest, out = [], []
        for b in batches:
            part = b.column("part").to_numpy()
            cut = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1), b.num_rows]
            for a, e in zip(cut, cut[1:]):
                if e == a:
                    continue
                if rest and rest[0].column("part")[0].as_py() != int(part[a]):
                    out.append(write_part(rest[0].column("part")[0].as_py(), pa.Table.from_batches(rest)))
                    rest = []
                rest.append(b.slice(a, e - a))
        if rest:
            out.append(write_part(rest[0].column("part")[0].as_py(), pa.Table.from_batches(rest)))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(3)], names=["part", "leads", "kinds"])
    return run


def write(t: DataFrame, literals: int) -> str | None:
    """The folder of a store of the templates ``t`` (cluster_id, literal_tokens, n, seq) with
    ``literals`` literals in all; None where no folder can be mapped."""
    spark = t.sparkSession
    root = checkpoint_dir(spark)
    root = root.removeprefix("file://").removeprefix("file:")
    if "://" in root:
        return None
    root, parts = os.path.join(root, "registry", uuid.uuid4().hex), max(8, -(-literals // PART))
    # at most COUNTED literals can have this count
    least = max(2, -(-literals // COUNTED))
    held = t.select(F.explode(F.array_distinct("literal_tokens")).alias("tok")).groupBy(F.xxhash64("tok").alias("h")).agg(F.count(F.lit(1)).alias("held"))
    counts = held.where(F.col("held") >= least).toArrow()
    keys, held = (counts.column(c).to_numpy() for c in ("h", "held"))
    keys = keys.view(np.uint64)
    order = np.argsort(keys)
    shared = spark.sparkContext.broadcast((keys[order], held[order].astype(np.float64)))
    rows = t.select("cluster_id", F.array_join("literal_tokens", " ").alias("lits"), F.transform("literal_tokens", lambda x: F.xxhash64(x)).alias("hashes"),
                    F.transform("literal_tokens", F.length).alias("lens"), F.size("literal_tokens").alias("n"), "seq")
    rows = rows.mapInArrow(_leads(shared, literals, least, parts), "part int, piece long, lits string, n int, seq long, cluster_id string")
    rows = rows.repartition(parts, "part").sortWithinPartitions("part", "piece", "lits", "seq", "cluster_id")
    done = rows.mapInArrow(_parts(root), "part long, leads long, kinds long").collect()
    os.makedirs(root, exist_ok=True)
    _save(root, -1, {"parts": np.array([parts, sum(r.leads for r in done)], np.int64)})
    return root


# ---------------------------------------------------------------------------
# Searching
# ---------------------------------------------------------------------------

def _map(root: str, part: int) -> dict[str, np.ndarray] | None:
    path = f"{root}/{part}.bin"
    if not os.path.exists(path):
        return None
    with open(path, "rb") as f:
        where = json.loads(f.readline())
        head, whole = f.tell(), mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    return {k: np.frombuffer(whole, np.dtype(kind), n, head + at) for k, (kind, n, at) in where.items()}


class Store:
    """What a worker knows of a store."""

    def __init__(self, root: str):
        parts, leads = map(int, _map(root, -1)["parts"])
        self.parts = [_map(root, p) for p in range(parts)]
        # 16 bits a lead
        self.shift = np.uint64(64 - min(28, max(10, math.ceil(math.log2(16 * leads + 1)))))
        self.bits = np.zeros((1 << (64 - int(self.shift))) // 8, np.uint8)
        self.base = [0]
        for p in self.parts:
            if p is not None:
                at = p["piece"] >> self.shift
                np.bitwise_or.at(self.bits, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
            self.base.append(self.base[-1] + (0 if p is None else len(p["piece"])))
        self.under: dict[str, tuple] = {}
        self.kinds_of: dict[int, list] = {}
        self.held = 0

    def learn(self, lines: list[str]) -> None:
        """The leads within the tokens of the lines."""
        toks = {t for x in lines for t in x.split()}
        if len(self.under) > TOKENS:
            self.under.clear()
        new = [t for t in toks if t not in self.under]
        got: list = [()] * len(new)
        at, whose = [], []
        for h, own in windows(new):
            place = h >> self.shift
            hit = np.flatnonzero(self.bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & np.uint8(1))
            h, own = h[hit], own[hit]
            part = part_of(h, len(self.parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            ends = np.searchsorted(part[order], np.arange(len(self.parts) + 1))
            for p, (a, e) in enumerate(zip(ends, ends[1:])):
                if a == e or self.parts[p] is None:
                    continue
                some, keys = order[a:e], self.parts[p]["piece"]
                i = np.minimum(np.searchsorted(keys, h[some]), len(keys) - 1)
                ok = np.flatnonzero(keys[i] == h[some])
                at.append(i[ok] + self.base[p])
                whose.append(own[some[ok]])
        if any(map(len, at)):
            at, whose = np.concatenate(at), np.concatenate(whose)
            order = np.argsort(whose, kind="stable")
            at, whose = at[order].tolist(), whose[order]
            cut = np.flatnonzero(np.diff(whose)) + 1
            for a, e in zip([0, *cut.tolist()], [*cut.tolist(), len(at)]):
                got[int(whose[a])] = tuple(at[a:e])
        self.under.update(zip(new, got))

    def kinds(self, lead: int) -> list:
        """(literals, templates, seq, id) of the kinds under a lead."""
        found = self.kinds_of.get(lead)
        if found is not None:
            return found
        p = int(np.searchsorted(self.base, lead, "right")) - 1
        x, i = self.parts[p], lead - self.base[p]
        a, e = int(x["start"][i]), int(x["start"][i + 1])
        toff, ioff = x["toff"][a:e + 1].tolist(), x["ioff"][a:e + 1].tolist()
        txt, ids = x["txt"][toff[0]:toff[-1]].tobytes(), x["itxt"][ioff[0]:ioff[-1]].tobytes()
        found = [(txt[s - toff[0]:t - toff[0]].decode("utf-8", "surrogatepass").split(" "), m, seq, None if none else ids[b - ioff[0]:c - ioff[0]].decode("utf-8", "surrogatepass"))
                 for s, t, m, seq, none, b, c in zip(toff, toff[1:], x["m"][a:e].tolist(), x["seq"][a:e].tolist(), x["none"][a:e].tolist(), ioff, ioff[1:])]
        size = sum(len(k[0]) for k in found)
        if self.held + size > HELD:
            self.kinds_of.clear()
            self.held = 0
        self.kinds_of[lead] = found
        self.held += size
        return found

    def _near(self, toks) -> set:
        leads: set = set()
        for t in toks:
            leads.update(self.under[t])
        return leads

    def loose(self, line: str):
        """(number of templates whose literals occur in order, id of the first of them)."""
        find, count, top, tid = line.find, 0, None, None
        for lead in self._near(line.split()):
            for lits, m, seq, cid in self.kinds(lead):
                at = 0
                for x in lits:
                    at = find(x, at)
                    if at < 0:
                        break
                    at += len(x)
                else:
                    count += m
                    own = (-len(lits), seq, cid is not None, cid or "")
                    if top is None or own < top:
                        top, tid = own, cid
        return count, tid

    def best(self, line: str, threshold: float):
        """(score, literal count, seq, id) of the best template that reaches the threshold."""
        toks = set(line.split())
        find, some = line.find, []
        for lead in self._near(toks):
            for lits, _, seq, cid in self.kinds(lead):
                n = len(lits)
                need = max(math.ceil(threshold * n - 1e-9), 0)      # 1e-9: the score is a quotient
                if need == n:
                    if not toks.issuperset(lits):
                        continue
                    held = n
                else:
                    held = sum(x in toks for x in lits)
                    if held < need:
                        continue
                at = 0
                for x in lits:
                    at = find(x, at)
                    if at < 0:
                        break
                    at += len(x)
                else:
                    some.append(((-n, seq, cid is not None, cid or ""), held / n, lits, cid))
        some.sort(key=lambda c: c[0])
        top, out = -1.0, None
        for (n, seq, *_), most, lits, cid in some:
            if most <= top:         # ties go to the more specific one
                continue
            score = literal_similarity_py(lits, line)
            if score > top:
                top, out = score, (score, -n, seq, cid)
        return out if out is not None and top >= threshold else None


_OPEN: dict[str, Store] = {}


def _each(root: str, lines: pd.Series, what) -> list:
    """``what(store, line)`` of each line, once a distinct line of the batch; None for null."""
    if root not in _OPEN:
        if len(_OPEN) >= 2:
            _OPEN.clear()
        _OPEN[root] = Store(root)
    store = _OPEN[root]
    found = dict.fromkeys(x for x in lines if isinstance(x, str))
    every = list(found)
    for a in range(0, len(every), 4096):
        store.learn(every[a:a + 4096])
        for x in every[a:a + 4096]:
            found[x] = what(store, x)
    return [found[x] if isinstance(x, str) else None for x in lines]


def loose_udf(root: str):
    @F.pandas_udf("n int, id string")
    def run(line: pd.Series) -> pd.DataFrame:
        rows = [r or (0, None) for r in _each(root, line, Store.loose)]
        return pd.DataFrame({"n": np.array([r[0] for r in rows], np.int32), "id": pd.Series([r[1] for r in rows], dtype=object)})
    return run


def best_udf(root: str, threshold: float):
    @F.pandas_udf("score double, n int, seq long, id string")
    def run(line: pd.Series) -> pd.DataFrame:
        rows = [r or (None, None, None, None) for r in _each(root, line, lambda s, x: s.best(x, threshold))]
        return pd.DataFrame({"score": pd.Series([r[0] for r in rows], dtype="float64"), "n": pd.array([r[1] for r in rows], dtype="Int32"),
                             "seq": pd.array([r[2] for r in rows], dtype="Int64"), "id": pd.Series([r[3] for r in rows], dtype=object)})
    return run
