"""Candidates and best near match of a line within a registry (J2, F1, W2), one pass a line.

The registry is counted, dealt by hash into shards of at most ``SHARD`` templates, and each
shard is broadcast to the workers, where it is indexed once:

* near match at a threshold s: at most ``floor((1 - s) n)`` of a template's n literals may be
  missing among the line's tokens, so one of its ``floor((1 - s) n) + 1`` rarest literals is a
  token of every line that can reach s. Templates are listed under these; a line looks its
  tokens up, and only templates with enough of their literals among them are searched in order
  and scored.
* candidates without a threshold: a template is listed under its rarest literal, and an
  Aho-Corasick automaton over those finds the ones that occur in the line in one pass.

Both are exact: what they leave out cannot match.

A registry of more than ``SHARD`` templates or ``LITERALS`` literals is written as sorted arrays
that the workers map (``store``): lines are searched where they are, nothing is shuffled but the
templates. Where the shared folder cannot be mapped, and for all ids of a line's candidates, the
same rule runs as joins (:func:`_best_joined`, :func:`_candidates_joined`): templates under their
rarest literals meet the tokens of the distinct lines.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.functions.similarity import literal_similarity, literal_similarity_py
from logweave.functions.tokens import tokens
from logweave.operators import store
from logweave.operators.compile import loose_match_expr
from logweave.session import cut_lineage

SHARD = 200_000
LITERALS = 1_000_000
_BUILT: dict = {}


def in_order(lits: list[str], line: str) -> bool:
    """All literals occur in the line, each behind the end of the one before (P5)."""
    at = 0
    for x in lits:
        at = line.find(x, at)
        if at < 0:
            return False
        at += len(x)
    return bool(lits)


class _Index:
    """Templates (id, literals, literal count, seq), most specific first."""

    def __init__(self, rows, threshold: float):
        self.rows = sorted(rows, key=lambda r: (-r[2], r[3], r[0]))
        self.threshold = threshold
        held = Counter(x for r in self.rows for x in set(r[1]))
        self.under, self.need = defaultdict(list), []
        for k, (_, lits, *_) in enumerate(self.rows):
            # literals that must be tokens of the line; 1e-9: the score is a quotient
            need = max(math.ceil(threshold * len(lits) - 1e-9), 0)
            self.need.append(need)
            rare = sorted(lits, key=lambda x: (held[x], x))
            for x in set(rare[:len(lits) - need + 1] if need else rare[:1]):
                self.under[x].append(k)
        self.find = None
        if threshold <= 0:
            import ahocorasick

            self.find = ahocorasick.Automaton()
            for x in self.under:
                self.find.add_word(x, x)
            if self.under:
                self.find.make_automaton()

    def candidates(self, line: str) -> list[int]:
        """Templates whose literals occur in order and whose score may reach the threshold."""
        if not self.under:
            return []
        if self.find is not None:
            places = {k for x in {x for _, x in self.find.iter(line)} for k in self.under[x]}
        else:
            toks = set(line.split())
            places = {k for x in toks if x in self.under for k in self.under[x]}
            places = [k for k in places if sum(x in toks for x in self.rows[k][1]) >= self.need[k]]
        return sorted(k for k in places if in_order(self.rows[k][1], line))

    def best(self, line: str):
        """(score, literal count, seq, id) of the best template that reaches the threshold."""
        top, at = -1.0, None
        for k in self.candidates(line):
            score = literal_similarity_py(self.rows[k][1], line)
            if score > top:
                top, at = score, k
                if score >= 1.0:        # ties go to the more specific one
                    break
        if at is None or top < self.threshold:
            return None
        cid, _, n, seq = self.rows[at]
        return top, n, seq, cid


def _index(shared, threshold: float) -> _Index:
    name, rows = shared.value
    key = (name, threshold)
    if key not in _BUILT:
        if len(_BUILT) >= 8:
            _BUILT.clear()
        _BUILT[key] = _Index(rows, threshold)
    return _BUILT[key]


def _registry(compiled: DataFrame) -> DataFrame:
    """The registry's templates with literals."""
    return compiled.where(F.col("literal_count") > 0).select(
        "cluster_id", "literal_tokens", F.col("literal_count").cast("int").alias("n"), F.coalesce(F.col("registry_seq").cast("long"), F.lit(0)).alias("seq"))


def _shards(compiled: DataFrame, size: int):
    """Broadcasts (name, rows) of the registry's templates with literals, at most about ``size``
    each. The name tells a worker which index it has built."""
    t = _registry(compiled)
    shards = max(1, -(-t.count() // size))
    for i in range(shards):
        some = t if shards == 1 else t.where(F.pmod(F.xxhash64("cluster_id"), F.lit(shards)) == i)
        yield t.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, [(r.cluster_id, list(r.literal_tokens), r.n, r.seq) for r in some.toLocalIterator()]))


_BEST = "score double, n int, seq long, id string"


def _best_udf(shared, threshold: float):
    @F.pandas_udf(_BEST)
    def run(line: pd.Series) -> pd.DataFrame:
        index = _index(shared, threshold)
        rows = [index.best(x) if isinstance(x, str) else None for x in line]
        rows = [r or (None, None, None, None) for r in rows]
        return pd.DataFrame({"score": pd.Series([r[0] for r in rows], dtype="float64"), "n": pd.array([r[1] for r in rows], dtype="Int32"),
                             "seq": pd.array([r[2] for r in rows], dtype="Int64"), "id": pd.Series([r[3] for r in rows], dtype=object)})
    return run


def _ids_udf(shared):
    @F.pandas_udf("array<struct<nlc:int,seq:long,id:string>>")
    def run(line: pd.Series) -> pd.Series:
        index = _index(shared, 0.0)
        out = []
        for x in line:
            rows = [index.rows[k] for k in index.candidates(x)] if isinstance(x, str) else []
            out.append([{"nlc": -n, "seq": seq, "id": cid} for cid, _, n, seq in rows])
        return pd.Series(out, dtype=object)
    return run


def _better(a: Column, b: Column) -> Column:
    """The better of two matches: score, literal count, then the earlier, then the smaller id."""
    first = F.struct(a["score"], a["n"], -a["seq"]) > F.struct(b["score"], b["n"], -b["seq"])
    even = (a["score"] == b["score"]) & (a["n"] == b["n"]) & (a["seq"] == b["seq"])
    return F.when(b["score"].isNull(), a).when(a["score"].isNull(), b).when(first | (even & (a["id"] <= b["id"])), a).otherwise(b)


def _best_joined(lines: DataFrame, compiled: DataFrame, line: Column, threshold: float) -> DataFrame:
    """``best_near`` for a registry of any size. Of templates with the same literals the earliest
    with the smallest id wins every line, so one stands for all; each distinct line is looked
    up once."""
    first = F.min(F.struct("seq", "cluster_id")).alias("f")
    n = F.size("literal_tokens")
    # 1e-9: the score is a quotient
    need = F.greatest(F.ceil(F.lit(threshold) * n - F.lit(1e-9)).cast("int"), F.lit(1))
    kinds = _registry(compiled).groupBy("literal_tokens").agg(first).select("literal_tokens", "f", n.alias("n"), need.alias("need"))
    kinds = cut_lineage(kinds.withColumn("c", F.monotonically_increasing_id()))
    held = kinds.select(F.explode(F.array_distinct("literal_tokens")).alias("tok")).groupBy("tok").agg(F.count(F.lit(1)).alias("held"))
    rare = F.array_sort(F.collect_list(F.struct("held", "tok")))        # a template's literals
    under = kinds.select("c", "n", "need", F.explode("literal_tokens").alias("tok")).join(held, "tok").groupBy("c", "n", "need").agg(rare.alias("rare"))
    under = under.select("c", F.explode(F.array_distinct(F.slice("rare", 1, F.col("n") - F.col("need") + 1)["tok"])).alias("tok"))
    texts = cut_lineage(lines.select(line.alias("__t")).where("__t is not null").distinct().withColumn("k", F.monotonically_increasing_id()))
    pairs = texts.select("k", F.explode(F.array_distinct(tokens(F.col("__t")))).alias("tok")).join(under, "tok").select("k", "c").distinct()
    full = pairs.join(kinds, "c").join(texts, "k").where(loose_match_expr("literal_tokens", "__t"))
    scored = full.withColumn("__s", literal_similarity(F.col("literal_tokens"), F.col("__t"))).where(F.col("__s") >= threshold)
    best = scored.groupBy("__t").agg(F.min(F.struct((-F.col("__s")).alias("s"), (-F.col("n")).alias("n"), "f.seq", "f.cluster_id")).alias("b"))
    best = cut_lineage(best.select("__t", F.col("b.cluster_id").alias("near_cluster_id"), (-F.col("b.s")).alias("similarity")))
    if best.count() <= SHARD:
        best = F.broadcast(best)
    return lines.withColumn("__near", line).join(best, F.col("__near") == F.col("__t"), "left").drop("__near", "__t")


def best_near(lines: DataFrame, compiled: DataFrame, line: Column, threshold: float, shard: int = SHARD) -> DataFrame:
    """Adds ``near_cluster_id`` and ``similarity`` of the best template; null below the threshold."""
    if threshold > 0:
        size = _registry(compiled).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("literals")).first()
        if size.n > shard or size.literals > LITERALS:
            root = store.write(_registry(compiled), size.literals)
            if root is None:
                return _best_joined(lines, compiled, line, threshold)
            out = lines.withColumn("__best", store.best_udf(root, threshold)(line))
            return out.withColumn("near_cluster_id", F.col("__best.id")).withColumn("similarity", F.col("__best.score")).drop("__best")
    out, names = lines, []
    for i, shared in enumerate(_shards(compiled, shard)):
        names.append(f"__near{i}")
        out = out.withColumn(names[-1], _best_udf(shared, threshold)(line))
    best = F.col(names[0])
    for i, n in enumerate(names[1:]):
        out = out.withColumn(f"__best{i}", _better(best, F.col(n)))
        best = F.col(f"__best{i}")
    ok = best["score"].isNotNull()
    out = out.withColumn("near_cluster_id", F.when(ok, best["id"])).withColumn("similarity", F.when(ok, best["score"]))
    return out.drop(*names, *(f"__best{i}" for i in range(len(names) - 1)))


#: Lengths of the pieces by which literals and tokens meet: a literal goes by its first piece
#: of the greatest length that it has, so a token of n characters has at most n of each.
_PIECES = (1, 2, 3, 4, 8)
_CHUNK = 256


def _holders(lits: DataFrame, vocab: DataFrame) -> DataFrame:
    """(lit, tok): the tokens that contain a literal."""
    by = [F.when(F.length("lit") >= n, F.substring("lit", 1, n)) for n in reversed(_PIECES)]
    lits = lits.select("lit", F.coalesce(*by).alias("piece"))
    # long tokens in chunks that overlap by what a piece may cross
    at = F.sequence(F.lit(0), F.floor((F.length("tok") - 1) / _CHUNK))
    parts = vocab.select("tok", F.explode(F.transform(at, lambda i: F.substr(F.col("tok"), (i * _CHUNK + 1).cast("int"), F.lit(_CHUNK + max(_PIECES) - 1)))).alias("part"))

    def cut(n: int) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.length("part") - (n - 1)), lambda i: F.substr(F.col("part"), i, F.lit(n)))
        return F.when(F.length("part") >= n, every).otherwise(F.array().cast("array<string>"))

    cuts = map(cut, _PIECES)
    pieces = parts.select("tok", F.explode(F.array_distinct(F.concat(*cuts))).alias("piece"))
    return pieces.join(lits, "piece").where(F.contains("tok", "lit")).select("lit", "tok").distinct()


def _candidates_joined(lines: DataFrame, compiled: DataFrame, line: Column, ids: bool) -> DataFrame:
    """``candidate_ids`` for a registry of any size. Literals and tokens hold no white space, so
    a literal occurs in a line when it occurs in one of its tokens. Templates with the same
    literals are one kind; of a kind's three rarest literals the one that fewest lines contain
    leads the lines to it, and only these pairs are searched in order. Each distinct line is
    looked up once."""
    t = _registry(compiled)
    first = F.min(F.struct("seq", "cluster_id")).alias("f")
    kinds = t.groupBy("literal_tokens").agg(first, F.count(F.lit(1)).alias("m")).withColumn("n", F.size("literal_tokens"))
    kinds = cut_lineage(kinds.withColumn("c", F.monotonically_increasing_id()))
    texts = cut_lineage(lines.select(line.alias("__t")).where("__t is not null").distinct().withColumn("k", F.monotonically_increasing_id()))
    toks = texts.select("k", F.explode(F.array_distinct(tokens(F.col("__t")))).alias("tok"))
    vocab = cut_lineage(toks.groupBy("tok").agg(F.count(F.lit(1)).alias("lines")))
    of = kinds.select("c", F.explode(F.array_distinct("literal_tokens")).alias("lit"))
    held = of.groupBy("lit").agg(F.count(F.lit(1)).alias("held"))
    rare = F.slice(F.array_sort(F.collect_list(F.struct("held", (-F.length("lit")).alias("len"), "lit"))), 1, 3)     # a template's literals
    some = cut_lineage(of.join(held, "lit").groupBy("c").agg(rare.alias("r")).select("c", F.explode(F.col("r")["lit"]).alias("lit")))
    inside = cut_lineage(_holders(some.select("lit").distinct(), vocab))
    reach = inside.join(vocab, "tok").groupBy("lit").agg(F.sum("lines").alias("reach"))
    under = some.join(reach, "lit", "left").groupBy("c").agg(F.min(F.struct(F.coalesce("reach", F.lit(0)).alias("reach"), "lit")).alias("b"))
    # a literal that no line contains: its kinds have no candidates
    under = cut_lineage(under.where("b.reach > 0").select("c", F.col("b.lit").alias("lit")))
    leads = toks.join(inside.join(under.select("lit").distinct(), "lit", "left_semi"), "tok").select("k", "lit").distinct()
    pairs = leads.join(under, "lit").select("k", "c").join(kinds.select("c", "n", "m", "f", "literal_tokens"), "c")
    alone = pairs.where("n = 1").drop("literal_tokens")
    full = pairs.where("n > 1").join(texts, "k").where(loose_match_expr("literal_tokens", "__t")).select(alone.columns)
    found = alone.unionByName(full)
    if ids:
        # written in a line's own row: as many as it has candidates
        who = t.join(kinds.select("c", "literal_tokens"), "literal_tokens").select("c", "seq", "cluster_id")
        hits = found.select("k", "c", "n").join(who, "c").groupBy("k").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("nlc"), "seq", "cluster_id"))).alias("__ids"))
        hits = hits.select("k", F.col("__ids")["cluster_id"].alias("loose_ids"))
    else:
        hits = found.groupBy("k").agg(F.sum("m").cast("int").alias("n_loose"), F.min(F.struct((-F.col("n")).alias("nlc"), "f.seq", "f.cluster_id")).alias("__first"))
        hits = hits.select("k", "n_loose", F.col("__first.cluster_id").alias("first_loose"))
    out = lines.withColumn("__line", line).join(texts.join(hits, "k").drop("k"), F.col("__line") == F.col("__t"), "left").drop("__line", "__t")
    if ids:
        return out.withColumn("loose_ids", F.coalesce("loose_ids", F.array().cast("array<string>")))
    return out.withColumn("n_loose", F.coalesce("n_loose", F.lit(0)))


def candidate_ids(lines: DataFrame, compiled: DataFrame, line: Column, shard: int = SHARD, ids: bool = True) -> DataFrame:
    """Adds ``loose_ids``: the templates whose literals occur in order, most specific first;
    without ``ids`` their number ``n_loose`` and the first of them, ``first_loose``. A registry
    of more than ``shard`` templates or ``LITERALS`` literals is mapped, or met by joins."""
    size = _registry(compiled).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("literals")).first()
    if size.n > shard or size.literals > LITERALS:
        root = None if ids else store.write(_registry(compiled), size.literals)
        if root is None:
            return _candidates_joined(lines, compiled, line, ids)
        out = lines.withColumn("__loose", store.loose_udf(root)(line))
        return out.withColumn("n_loose", F.col("__loose.n")).withColumn("first_loose", F.col("__loose.id")).drop("__loose")
    out, names = lines, []
    for i, shared in enumerate(_shards(compiled, shard)):
        names.append(f"__loose{i}")
        out = out.withColumn(names[-1], _ids_udf(shared)(line))
    every = F.array_sort(F.concat(*map(F.col, names))) if len(names) > 1 else F.col(names[0])
    out = out.withColumn("loose_ids", F.transform(every, lambda c: c["id"])).drop(*names)
    if ids:
        return out
    return out.withColumn("n_loose", F.size("loose_ids")).withColumn("first_loose", F.get(F.col("loose_ids"), 0)).drop("loose_ids")
