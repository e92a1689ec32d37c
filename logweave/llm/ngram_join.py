"""Grouped prefix join: documents whose word 5-gram sets have a Jaccard of 0.8 or more.

1. Every text becomes its set of 64-bit shingle hashes; equal sets fall into one *class*.
2. A class keeps the lowest ``L = n - ceil(t n) + c`` hashes as its prefix (``c`` a tenth of
   n). Two linked sets share at least ``c`` of the smaller one's prefix tokens, inside both
   prefixes. Classes with one prefix and one size collapse into a *group*.
3. Group pairs are filtered: of its prefix a group probes only with the rarest
   ``L - c + 1`` tokens (counted over all prefixes), so a group that has few tokens in
   common with anyone makes no pair at all; sizes must allow the similarity.
4. Surviving group pairs are expanded to their members and verified on the whole sets.

Hot tokens (more than ``dense`` groups hold one: a passage in many documents, a cluster of
thousands of near copies) take part in step 3 by a longer prefix: groups whose common tokens
may all be hot are expanded at once and their members' *whole* sets counted, of which a set
probes with its rarest fifth. That leaves hot tokens only to sets that hold four fifths of
common tokens. There two rounds link each holder with a pivot of the token. Holders still in
different components are not paired under the hot token but under what sets them apart from
its pivot: with ``d`` the size of a set's symmetric difference from the pivot's and
``k = (1 - t) / (1 + t)``, two sets are linked when ``d(u, v) <= k (n_u + n_v)``. If v is not
linked with the pivot, a linked u shares at least ``(d_u + d_v - k (n_u + n_v)) / 2 > 0`` tokens
of the differences with it, so the differences take the prefix and position filters in turn.
Only the components matter to the answer, so no link between different components is lost.

Two unlike sequences would be taken for equal only if their 64-bit hashes met; sets are
compared by 128 bits.

Scale: no table holds texts, and whole sets are written only for classes that a candidate
pair or a hot token names. Classes get their numbers from sorted signatures in the shared
folder (``hashstore``); the prefixes are hashed again in a second map, which sends (token,
class) pairs sorted and byte by byte, some five bytes each, and only tokens of two classes or
more come back. The wanted sets lie in one file per map task, and pairs are verified by
mapping the two places: pairs are shuffled as numbers, sets never.
"""

from __future__ import annotations

import functools
import math
import os
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweave.llm import hashstore as H
from logweave.llm.common import cut_lineage, documents, spread_over
from logweave.llm.words import byte_class, hashes, mix, slices, spans, text_bytes

_WORD = ~byte_class((9, 13), (32, 32))
_BYTES = 6_000_000      # of text looked at together (a longer text alone)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_PART = 40              # a class's number: its part, then its place there in 40 bits


def shingle_sets(data: np.ndarray, bounds: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its word k-grams (A-Z lower-cased); of the
    whole sequence when it has fewer words; empty without words."""
    start, end = spans(data, bounds, _WORD)
    words = np.diff(np.searchsorted(start, bounds))
    n = np.where(words > 0, np.maximum(words - k + 1, 1), 0)
    ends = np.cumsum(n)
    if not len(start):
        return [np.zeros(0, np.uint64)] * len(n)
    h = hashes(data, start, end)
    at = np.repeat(np.cumsum(words) - words - ends + n, n) + np.arange(ends[-1])
    take = np.repeat(np.minimum(words, k), n)
    short = take.min() < k
    with np.errstate(over="ignore"):
        g = take.astype(np.uint64)
        for i in range(k):
            step = (g ^ (g >> np.uint64(29))) * _MIX + h[np.minimum(at + i, len(h) - 1)]
            g = np.where(i < take, step, g) if short else step
        g = (g ^ (g >> np.uint64(32))) * _MIX
        g ^= g >> np.uint64(29)
    return [np.unique(x) for x in np.split(g, ends[:-1])]


def shingle_set(text: str | None, k: int = 5) -> np.ndarray:
    import pyarrow as pa

    return shingle_sets(*text_bytes(pa.array([text], pa.string())), k)[0]


def spare(n: int) -> int:
    """c: prefix tokens that linked sets share at least (n: the smaller set's size)."""
    return max(1, n // 10)


def prefix_length(n: int, percent: int) -> int:
    return n - math.ceil(percent * n / 100) + spare(n)


def _prefix(g: np.ndarray, percent: int) -> np.ndarray:
    return g[:prefix_length(len(g), percent)] if len(g) else g


def _sliced(batches):
    """(rows of some texts, their sets); the text is the last column."""
    for b in batches:
        data, bounds = text_bytes(b.column(b.num_columns - 1))
        for a, e in slices(bounds, _BYTES):
            yield b.slice(a, e - a), shingle_sets(data[bounds[a]:bounds[e]], bounds[a:e + 1] - bounds[a])


def _describe(percent: int):
    """(id, text key, text) -> the set's size and signature, the prefix's signature."""
    def run(batches):
        import pyarrow as pa
        import xxhash

        for b, sets in _sliced(batches):
            sig = [xxhash.xxh3_128_digest(g.tobytes()) for g in sets]
            pk = [xxhash.xxh3_128_digest(_prefix(g, percent).tobytes()) for g in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(g) for g in sets], pa.int64()), pa.array(sig, pa.binary()), pa.array(pk, pa.binary())],
                                             ["id", "text_key", "n", "sig", "pk"])
    return run


def _halves(sig: list[bytes]) -> np.ndarray:
    """Signatures as rows of two numbers."""
    return np.frombuffer(b"".join(sig), ">u8").astype(np.uint64).reshape(-1, 2)


def _part_column(parts: int):
    """The part of a signature, by its first 32 bits, as ``hashstore.part_of`` has it."""
    upper = F.conv(F.hex(F.substring("sig", 1, 4)), 16, 10).cast("long")
    return F.shiftright(upper * parts, 32).cast("int")


def _number(root: str):
    """Rows (part, sig, n, pk, rep) sorted by them: writes the part's signatures, and its
    classes' representatives, and gives each class its number."""
    def run(batches):
        import pyarrow as pa

        part, sig, rep, out = None, [], [], []

        def done():
            both = _halves(sig)
            H.write(root, "sig", part, both[:, 0].copy())
            H.write(root, "rest", part, both[:, 1].copy())
            H.write(root, "rep", part, np.array([-1 if r is None else r for r in rep], np.int64))
            H.write(root, "void", part, np.array([r is None for r in rep]))

        for b in batches:
            nodes = []
            for p, s, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(4).to_pylist()):
                if p != part and sig:
                    done()
                    sig, rep = [], []
                part = p
                nodes.append((p << _PART) | len(sig))
                sig.append(s)
                rep.append(r)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), *(b.column(i) for i in (1, 2, 3, 4))], ["node", "sig", "n", "pk", "rep"])
        if sig:
            done()
    return run


def _nodes(root: str, parts: int, sets: list[np.ndarray]) -> np.ndarray:
    """The classes' numbers of some sets, -1 for empty ones."""
    import xxhash

    out = np.full(len(sets), -1, np.int64)
    full = [i for i, g in enumerate(sets) if len(g)]
    if not full:
        return out
    sig = _halves([xxhash.xxh3_128_digest(sets[i].tobytes()) for i in full])
    order = np.lexsort((sig[:, 1], sig[:, 0]))
    place = np.array(full)[order]
    sig = sig[order]
    for p, a, e in H.runs(H.part_of(sig[:, 0], parts)):
        keys, rest = H.read(root, "sig", p), H.read(root, "rest", p)
        at = np.searchsorted(keys, sig[a:e, 0])
        for j in np.flatnonzero(rest[at] != sig[a:e, 1]):      # two sets that share 64 bits
            while rest[at[j]] != sig[a + j, 1]:
                at[j] += 1
        out[place[a:e]] = (p << _PART) | at
    return out


def _send_prefixes(root: str, parts: int, percent: int):
    def run(batches):
        import pyarrow as pa

        for _, sets in _sliced(batches):
            node = _nodes(root, parts, sets)
            own, first = np.unique(node, return_index=True)    # a class once
            first = first[own >= 0]
            if not len(first):
                continue
            heads = [_prefix(sets[i], percent) for i in first]
            tok = mix(np.concatenate(heads))
            holder = np.repeat(node[first], [len(h) for h in heads])
            order = np.argsort(tok)
            tok, holder = tok[order], holder[order]
            for p, a, e in H.runs(H.part_of(tok, parts)):
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([H.planes(tok[a:e])], pa.binary()), pa.array([H.planes(holder[a:e])], pa.binary())], ["part", "tok", "node"])
    return run


def _shared(batches):
    """(tok, node) of the tokens that two classes or more hold."""
    import pyarrow as pa

    def kept(toks, nodes):
        tok, node = np.concatenate(toks), np.concatenate(nodes)
        order = np.lexsort((node, tok))
        tok, node = tok[order], node[order]
        new = np.ones(len(tok), bool)
        new[1:] = (tok[1:] != tok[:-1]) | (node[1:] != node[:-1])
        tok, node = tok[new], node[new]
        many = np.zeros(len(tok), bool)
        same = tok[1:] == tok[:-1]
        many[1:] |= same
        many[:-1] |= same
        return pa.RecordBatch.from_arrays([pa.array(tok[many].view(np.int64)), pa.array(node[many])], ["tok", "node"])

    part, toks, nodes = None, [], []
    for b in batches:
        for p, t, v in zip(*(b.column(i).to_pylist() for i in range(3))):
            if p != part and toks:
                yield kept(toks, nodes)
                toks, nodes = [], []
            part = p
            toks.append(H.unplanes(t, "u8"))
            nodes.append(H.unplanes(v, "i8"))
    if toks:
        yield kept(toks, nodes)


def _store_wanted(root: str):
    """Nodes, sorted, of a part each: the places that are wanted."""
    def run(batches):
        import pyarrow as pa

        part, held = None, []
        for b in batches:
            for p, a, e in H.runs(np.asarray(b.column(0)) >> _PART):
                if p != part and held:
                    H.write(root, "want", part, np.concatenate(held))
                    held = []
                part = p
                held.append(np.asarray(b.column(0))[a:e])
            yield pa.RecordBatch.from_arrays([b.column(0)], ["node"])
        if held:
            H.write(root, "want", part, np.concatenate(held))
    return run


def _write_sets(root: str, parts: int):
    """Appends the wanted classes' sets to the task's file, each from its representative's
    text: (node, file, at)."""
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        file, done, nodes, at = TaskContext.get().partitionId(), 0, [], []
        os.makedirs(root, exist_ok=True)
        own = f"{_file(root, file)}.{uuid.uuid4().hex}"
        with open(own, "wb") as out:
            for b, sets in _sliced(batches):
                for v, i, g in zip(_nodes(root, parts, sets).tolist(), b.column(0).to_pylist(), sets):
                    if v < 0:
                        continue
                    p, place = v >> _PART, v & ((1 << _PART) - 1)
                    if H.find(H.read(root, "want", p), np.array([v]))[0] < 0:
                        continue
                    if (i is None) == bool(H.read(root, "void", p)[place]) and (i is None or i == H.read(root, "rep", p)[place]):
                        out.write(g.tobytes())
                        nodes.append(v)
                        at.append(done)
                        done += len(g)
        os.replace(own, _file(root, file))
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([file] * len(nodes), pa.int32()), pa.array(at, pa.int64())], ["node", "file", "at"])
    return run


def _file(root: str, file: int) -> str:
    return os.path.join(root, f"sets-{file}")


@functools.lru_cache(maxsize=4096)
def _mapped(root: str, file: int) -> np.ndarray:
    return np.memmap(_file(root, file), np.uint64, "r")


def _read_set(root: str, file: int, at: int, n: int) -> np.ndarray:
    return _mapped(root, file)[at:at + n]


def _explode_sets(root: str):
    """(node, n, file, at) -> one row per hash of the set."""
    def run(batches):
        import pyarrow as pa

        for b in batches:
            size = np.asarray(b.column(1))
            for a in range(0, len(size), 256):
                n = size[a:a + 256]
                toks = [_read_set(root, f, x, m) for f, x, m in zip(b.column(2).slice(a, 256).to_pylist(), b.column(3).slice(a, 256).to_pylist(), n.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(b.column(0))[a:a + 256], n)), pa.array(np.repeat(n, n)),
                                                  pa.array(np.concatenate(toks).view(np.int64))], ["node", "n", "tok"])
    return run


def _linked(root: str, percent: int):
    """(u, v, place of u's set, place of v's) -> the linked (u, v)."""
    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = list(zip(*(b.column(i).to_pylist() for i in range(8))))
            ok = []
            for u, v, fu, au, nu, fv, av, nv in rows:
                x, y = _read_set(root, fu, au, nu), _read_set(root, fv, av, nv)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                if 100 * both >= percent * (len(x) + len(y) - both):
                    ok.append((u, v))
            yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in ok], pa.int64()), pa.array([v for _, v in ok], pa.int64())], ["a", "b"])
    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge (a, b); root: the component's smallest node.

    Large-star / small-star rounds; each is written to the shared folder.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e, before = cut_lineage(e), None
    while True:
        state = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if (state.n, state.x) == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select("b", "b").distinct())
        before = (state.n, state.x)
        both = e.union(e.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(least)
        e = cut_lineage(small.distinct())


def join_components(docs: DataFrame, *, key: str = "doc_id", text: str = "text", percent: int = 80, dense: int = 40) -> DataFrame:
    """One row per row of ``docs``: key, n_shingles, component_id (the smallest key reachable
    by links), class_id (the smallest key with an equal set; the own key when it is empty),
    group_id (a number of the component, which two components never share even where their
    rows share keys; null for empty sets) and text_key (xxhash64 of the text).

    Null and word-less texts have no shingles and link with nothing. Rows with a null key
    join their text's class; repeated rows give repeated results.
    """
    spark = docs.sparkSession
    docs, dealt = spread_over(docs.select(F.col(key).alias("id"), F.xxhash64(F.col(text)).alias("text_key"), F.col(text).alias("t")))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * dealt)
    root = H.folder(spark)
    rows = cut_lineage(docs.mapInArrow(_describe(percent), "id bigint, text_key bigint, n bigint, sig binary, pk binary"))
    sets = rows.where("n > 0").groupBy("sig").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("pk").alias("pk"))
    sets = sets.select(_part_column(parts).alias("part"), "sig", "n", "pk", "rep").repartitionById(parts, "part").sortWithinPartitions("part", "sig")
    nodes = cut_lineage(sets.mapInArrow(_number(root), "node bigint, sig binary, n bigint, pk binary, rep bigint"))
    group = nodes.groupBy("n", "pk").agg(F.min("node").alias("g"), F.count("*").alias("members"))
    member = cut_lineage(nodes.join(group, ["n", "pk"]).select("node", "n", "g", "members"))

    texts = docs.select("id", "t")
    sent = texts.mapInArrow(_send_prefixes(root, parts, percent), "part int, tok binary, node binary").repartitionById(parts, "part").sortWithinPartitions("part")
    token = sent.mapInArrow(_shared, "tok bigint, node bigint").join(member.where("node = g").select("node", "n"), "node").withColumnRenamed("node", "g")
    token = cut_lineage(token)
    linkable = F.ceil(percent * F.col("n") / 100)       # the smallest partner a set may have
    spare_of = lambda n: F.greatest(F.lit(1), F.floor(n / 10)).cast("long")  # noqa: E731  spare()
    token = _lists(token, "g", spare_of(F.col("n")), spare_of(linkable))
    probe, base = token.where("probes"), token
    fits = ((100 * F.col("nx") >= percent * F.col("ny")) & ((F.col("nx") < F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("x") < F.col("y")))))
    rare = cut_lineage(_meet(probe.where(F.col("df") <= dense), base, "g").where(fits).select("x", "y").distinct())

    # groups whose common tokens may all be hot: their members' whole sets, rarest tokens first
    crowded = member.where("members > 1")
    hot = token.where(F.col("df") > dense).groupBy("g", "n").agg(F.count("*").alias("hot")).where(F.col("hot") >= spare_of(linkable))
    hot = cut_lineage(member.join(hot.select("g"), "g", "left_semi").select("node", "n"))

    # the whole sets of the classes that a pair, a group or a hot token names
    paired = rare.select(F.col("x").alias("g")).union(rare.select("y")).distinct()
    wanted = member.join(paired, "g", "left_semi").select("node").union(crowded.select("node")).union(hot.select("node")).distinct()
    wanted = wanted.repartitionById(parts, F.shiftright("node", _PART).cast("int")).sortWithinPartitions("node")
    cut_lineage(wanted.mapInArrow(_store_wanted(root), "node bigint"))
    lies = texts.mapInArrow(_write_sets(root, parts), "node bigint, file int, at bigint").dropDuplicates(["node"])
    lies = cut_lineage(lies.join(member.select("node", "n"), "node"))

    def place(col: str) -> DataFrame:
        return lies.select(F.col("node").alias(col), F.col("file").alias(f"f{col}"), F.col("at").alias(f"a{col}"), F.col("n").alias(f"n{col}"))

    def verify(pairs: DataFrame) -> DataFrame:
        both = pairs.join(place("u"), "u").join(place("v"), "v").select("u", "v", "fu", "au", "nu", "fv", "av", "nv")
        return both.mapInArrow(_linked(root, percent), "a bigint, b bigint")

    whole = hot.join(lies.select("node", "file", "at"), "node").select("node", "n", "file", "at").mapInArrow(_explode_sets(root), "node bigint, n bigint, tok bigint")
    whole = _lists(whole, "node", linkable, linkable)
    whole = whole.unionByName(crowded.select("node", "n", F.xxhash64("g", F.lit("group")).alias("tok"), F.lit(dense + 1).cast("long").alias("df"), F.lit(True).alias("probes")))
    # a token's first pivot is the holder with the most hot tokens: of a cluster, its least edited copy
    held_hot = F.sum((F.col("df") > dense).cast("int")).over(Window.partitionBy("node"))
    whole = cut_lineage(whole.withColumn("hot", held_hot))

    links = label = None        # none yet
    crowd = whole.where(F.col("df") > dense)
    busy = not crowd.isEmpty()
    for turn in range(2 if busy else 0):
        order = F.struct((-F.col("hot") if turn == 0 else F.lit(0)).alias("rank"), F.xxhash64("node", F.lit(turn)).alias("h"), "node", "n")
        pivot = crowd.groupBy("tok").agg(F.min(order).alias("p")).select("tok", F.col("p.node").alias("v"), F.col("p.n").alias("nv"))
        star = crowd.where("probes").join(pivot, "tok").where("node <> v").where((100 * F.col("n") >= percent * F.col("nv")) & (100 * F.col("nv") >= percent * F.col("n")))
        pairs = star.select(F.least("node", "v").alias("u"), F.greatest("node", "v").alias("v")).distinct()
        found = verify(_apart(pairs, label, "u", "v"))
        links = cut_lineage(links.union(found) if links is not None else found)
        label = components(links)

    # what is still apart: all pairs under rare tokens, under hot ones only across components
    of = member.select("g", "node")
    pairs = (rare.join(of.select(F.col("g").alias("x"), F.col("node").alias("u")), "x")
             .join(of.select(F.col("g").alias("y"), F.col("node").alias("v")), "y").select("u", "v"))
    few = whole.where(F.col("df") <= dense)
    pairs = pairs.union(_meet(few.where("probes"), few, "node").where(fits).select("x", "y"))
    if busy:
        direct, met = _beside_pivots(crowd, label, place, root, percent)
        pairs, links = pairs.union(met), links.union(direct)
    found = verify(_apart(pairs.distinct(), label, "u", "v"))
    links = cut_lineage(links.union(found) if links is not None else found)
    label = components(links)

    named = nodes.select("node", "sig", "rep").join(label, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest_id = named.groupBy("root").agg(F.min("rep").alias("component"))
    named = named.join(smallest_id, "root").select("sig", "rep", "component", "root")
    out = rows.where("n > 0").join(named, "sig").select("id", "n", "component", "rep", "root", "text_key")
    return out.union(rows.where("n = 0").select("id", "n", "id", "id", F.lit(None).cast("long"), "text_key")).select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("rep").alias("class_id"),
        F.col("root").alias("group_id"), "text_key")


def _named(df: DataFrame, label: DataFrame, col: str, out: str) -> DataFrame:
    got = label.select(F.col("node").alias(col), F.col("root").alias(out))
    return df.join(got, col, "left").withColumn(out, F.coalesce(out, col))


def _apart(pairs: DataFrame, label: DataFrame | None, a: str, b: str) -> DataFrame:
    """Pairs whose ends are in different components; without labels each is its own."""
    if label is None:
        return pairs.where(F.col(a) != F.col(b)).select(a, b)
    return _named(_named(pairs, label, a, "ra"), label, b, "rb").where("ra <> rb").select(a, b)


def _lists(token: DataFrame, owner: str, need, partner) -> DataFrame:
    """(tok, owner, n) -> tokens that two or more owners hold, with ``df`` and ``probes``.

    An owner is linked only if it shares ``need`` of its tokens with a larger set, so its
    ``need - 1`` most frequent ones may go unprobed; one that holds fewer than ``partner``
    common tokens can be in no pair and is left out.
    """
    shared = token.groupBy("tok").agg(F.count("*").alias("df")).where("df > 1")
    token = token.join(shared, "tok").withColumns({
        "held": F.count("*").over(Window.partitionBy(owner)),
        "rank": F.row_number().over(Window.partitionBy(owner).orderBy("df", "tok")),
    })
    token = token.where(F.col("held") >= partner).withColumn("probes", F.col("rank") <= F.col("held") - need + 1)
    return cut_lineage(token.select(owner, "n", "tok", "df", "probes"))


def _meet(probe: DataFrame, base: DataFrame, owner: str) -> DataFrame:
    """(x, nx, y, ny) of the owners that meet under a token."""
    return (probe.select("tok", F.col(owner).alias("x"), F.col("n").alias("nx"))
            .join(base.select("tok", F.col(owner).alias("y"), F.col("n").alias("ny")), "tok"))


def _differences(root: str):
    """(node, n, p, np, root, place of node's set, place of p's) -> one row per token of their
    symmetric difference."""
    def run(batches):
        import pyarrow as pa

        for b in batches:
            for a in range(0, b.num_rows, 256):
                some = b.slice(a, 256)
                toks = [np.setxor1d(_read_set(root, fu, au, nu), _read_set(root, fv, av, nv), assume_unique=True)
                        for nu, nv, fu, au, fv, av in zip(*(some.column(i).to_pylist() for i in (1, 3, 5, 6, 7, 8)))]
                d = np.array([len(t) for t in toks], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(some.column(i)), d)) for i in range(5)] + [
                    pa.array(np.repeat(d, d)), pa.array(np.concatenate(toks).view(np.int64))], ["node", "n", "p", "np", "root", "d", "tok"])
    return run


def _beside_pivots(crowd: DataFrame, label: DataFrame, place, root: str, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links of holders of hot tokens with the tokens' pivots, and the pairs of holders in
    different components that may be linked (module docstring)."""
    held = _named(crowd, label, "node", "root")
    order = F.struct((-F.col("hot")).alias("rank"), F.xxhash64("node", F.lit(0)).alias("h"), "node", "n")
    hub = held.groupBy("tok").agg(F.min(order).alias("p"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("probes").alias("probed"))
    hub = hub.where("lo <> hi and probed").select("tok", F.col("p.node").alias("p"), F.col("p.n").alias("np"))
    spoke = held.join(hub, "tok").where("node <> p").select("node", "n", "p", "np", "root").distinct()
    spoke = spoke.join(place("node").drop("nnode"), "node").join(place("p").drop("np"), "p").select("node", "n", "p", "np", "root", "fnode", "anode", "fp", "ap")
    # dealt out evenly: a pivot may have very many holders around it
    spoke = spoke.repartition(int(crowd.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    apart = spoke.mapInArrow(_differences(root), "node bigint, n bigint, p bigint, np bigint, root bigint, d bigint, tok bigint")
    apart = cut_lineage(apart)
    more, less = 100 + percent, 100 - percent
    near = more * F.col("d") <= less * (F.col("n") + F.col("np"))
    direct = apart.where(near).select(F.greatest("node", "p").alias("a"), F.least("node", "p").alias("b")).distinct()

    mine, under = Window.partitionBy("p", "node"), Window.partitionBy("p", "tok")
    shared = apart.withColumns({"df": F.count("*").over(under), "lo": F.min("root").over(under), "hi": F.max("root").over(under)}).where("df > 1")
    lists = shared.withColumns({
        "h": F.count("*").over(mine), "rank": F.row_number().over(mine.orderBy("df", "tok")), "far": ~near})
    # what a set has alone counts against every partner, the largest of which is n / t
    lists = lists.where(percent * (F.col("d") - F.col("h")) <= less * F.col("n"))
    need = F.greatest(F.lit(1), F.ceil((percent * F.col("d") - less * F.col("n")) / percent))
    lists = lists.withColumn("probes", F.col("far") & (F.col("rank") <= F.col("h") - need + 1))
    # only tokens of different components make pairs
    lists = cut_lineage(lists.where("lo <> hi").select("p", "tok", "node", "n", "d", "h", "rank", "probes", "root"))
    v, u = lists.where("probes").alias("v"), lists.alias("u")
    c = F.col
    # tokens both can still share from here on, itself included; smaller of the two
    left = F.least(c("u.h") - c("u.rank"), c("v.h") - c("v.rank")) + 1
    meet = ((c("u.p") == c("v.p")) & (c("u.tok") == c("v.tok")) & (c("u.root") != c("v.root"))
            & (100 * c("u.n") >= percent * c("v.n")) & (100 * c("v.n") >= percent * c("u.n"))
            & (more * (c("u.d") + c("v.d")) - less * (c("u.n") + c("v.n")) <= 2 * more * left))
    pairs = v.join(u, meet).select(F.least("u.node", "v.node").alias("u"), F.greatest("u.node", "v.node").alias("v"))
    return direct, pairs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: near-duplicate component of every document."""
    return join_components(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_shingles", "component_id", "class_id")
