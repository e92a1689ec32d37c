"""Secret scans: three fixed patterns, and character Markov models for the rest.

The models are bigram chains over letters, digits and one class of other signs: one of random
strings (values that the fixed patterns find), one of ordinary identifiers (words outside
those values); both count every document. A run of at least 16 token characters whose mean
log-likelihood ratio per transition exceeds ``per_char`` (below 20 characters: whose sum
exceeds that of 20 at ``per_char``) is reported as kind ``markov`` unless it overlaps a span of
a fixed pattern.

All of it is built-in functions: training counts equal words, then aggregates to at most
64 x 64 cells per model, and the table of ratios travels inside the expression as one string of 4096 signs.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm.common import documents, spread

#: Fixed patterns, in the order in which ties of one start are listed.
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LONG = r"[A-Za-z0-9+/_=-]{16,}"
WORD = r"[A-Za-z0-9_-]{6,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
_SURE = 20            # characters from which the mean ratio alone decides
_SIZE = 64            # states: the alphabet, other signs (63) and an unused one
_STEP, _ZERO = 0.125, 78  # a ratio r is the sign with code 78 + r / 0.125, kept in 33..126
_SPANS = "array<struct<kind:int,start:int,end:int>>"


def _spans(text, pattern: str, kind: int, value: int = 0, at_least: int = 0):
    """Leftmost non-overlapping matches as (kind, start, end) in code points; a match whose
    group ``value`` is shorter than ``at_least`` is dropped."""
    parts, whole = F.split(text, pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value)) if value else whole
    found = F.arrays_zip(F.slice(parts, 1, F.size(whole)).alias("p"), whole.alias("w"), values.alias("v"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("out"))

    def step(a, x):
        s = a["at"] + F.length(x["p"])
        e = s + F.length(x["w"])
        new = F.when(F.length(x["v"]) >= at_least, F.array(F.struct(F.lit(kind).alias("kind"), s.alias("start"), e.alias("end")))).otherwise(F.array().cast(_SPANS))
        return F.struct(e.alias("at"), F.concat(a["out"], new).alias("out"))

    return F.aggregate(found, start, step, lambda a: a["out"])


def _base(text):
    """Spans of the fixed patterns; texts that cannot hold one run no costly pattern."""
    none = F.array().cast(_SPANS)
    low = F.lower(text)
    keyed = F.contains(low, F.lit("passw")) | F.contains(low, F.lit("secret")) | F.contains(low, F.lit("token")) | F.contains(low, F.lit("api"))
    return F.concat(
        F.when(keyed, _spans(text, ASSIGN, 0, 2, 6)).otherwise(none),
        F.when(F.contains(text, F.lit("AKIA")), _spans(text, ACCESS, 1)).otherwise(none),
        F.when(text.rlike(HEX), _spans(text, HEX, 2)).otherwise(none))


def _state(c):
    """0..62 of a character."""
    at = F.instr(F.lit(ALPHABET), c)
    return F.when(at == 0, F.lit(62)).otherwise(at - 1)


def train(docs: DataFrame, *, text: str = "text") -> str:
    """The table of log-likelihood ratios, one sign per transition.

    Learned from the values of the fixed patterns and the identifiers of all documents. The
    random model is half uniform; the ordinary one falls back to its single characters.
    Without documents every ratio is 0.
    """
    spans = docs.select(F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("s", _base(F.col("t")))
    values = F.transform("s", lambda x: F.expr("t").substr(x["start"] + 1, x["end"] - x["start"]))
    values = F.transform(values, lambda v: F.regexp_extract(v, r"([A-Za-z0-9+/_.=-]+)$", 1))
    words = (spans.where(F.size("s") > 0).select(F.lit(1).alias("random"), F.explode(values).alias("w"))
             .union(spans.select(F.lit(0), F.explode(F.regexp_extract_all("t", F.lit(WORD), F.lit(0))))))
    words = words.where("length(w) > 1 and (random = 1 or length(w) < 20)").groupBy("random", "w").agg(F.count("*").alias("m"))
    words = words.where((F.col("random") == 1) | ~F.col("w").rlike(r"^[0-9a-f]{24,}$|^AKIA"))
    pairs = F.transform(F.sequence(F.lit(1), F.length("w") - 1), lambda i: _state(F.substring("w", i, F.lit(1))) * _SIZE + _state(F.substring("w", i + 1, F.lit(1))))
    cells = words.select("random", "m", F.explode(pairs).alias("cell")).groupBy("random", "cell").agg(F.sum("m").alias("n"))
    got = {(r.random, r.cell): r.n for r in cells.collect()}  # at most 2 x 4096 rows
    row = [[sum(got.get((m, a * _SIZE + b), 0) for b in range(_SIZE)) for a in range(_SIZE)] for m in (0, 1)]
    seen = [sum(got.get((0, a * _SIZE + b), 0) for a in range(_SIZE)) for b in range(_SIZE)]
    usual = [(n + 0.5) / (sum(seen) + 0.5 * _SIZE) for n in seen]
    out = []
    for a in range(_SIZE):
        for b in range(_SIZE):
            plain = (got.get((0, a * _SIZE + b), 0) + 8 * usual[b]) / (row[0][a] + 8)
            random = 0.5 * (got.get((1, a * _SIZE + b), 0) + 1) / (row[1][a] + _SIZE) + 0.5 / _SIZE
            out.append(chr(min(126, max(33, round(_ZERO + math.log(random / plain) / _STEP)))))
    return "".join(out)


def ratio(token, table: str):
    """Mean log-likelihood ratio per transition of a token of two characters or more."""
    steps = F.sequence(F.lit(1), F.length(token) - 1)
    cell = lambda i: _state(F.substring(token, i, F.lit(1))) * _SIZE + _state(F.substring(token, i + 1, F.lit(1)))
    total = F.aggregate(steps, F.lit(0), lambda s, i: s + F.ascii(F.substring(F.lit(table), cell(i) + 1, F.lit(1))) - _ZERO)
    return total * F.lit(_STEP) / (F.length(token) - 1)


def scan(docs: DataFrame, table: str, *, text: str = "text", per_char: float = 0.5) -> DataFrame:
    """All columns of ``docs`` (a clashing one is replaced) and ``secrets``, the spans
    (kind, start, end) by start and kind, ``end`` exclusive, in code points.

    A null or empty text has none. Patterns are applied to the whole text; equal texts have
    equal spans.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    docs = docs.withColumn("__t", t).withColumn("__b", _base(F.col("__t")))
    cand = F.when(F.col("__t").rlike(LONG), _spans(F.col("__t"), LONG, 3)).otherwise(F.array().cast(_SPANS))
    docs = docs.withColumn("__c", cand)
    free = lambda x: ~F.exists("__b", lambda b: (b["start"] < x["end"]) & (b["end"] > x["start"]))
    word = lambda x: F.col("__t").substr(x["start"] + 1, x["end"] - x["start"])
    least = lambda n: F.lit(per_char) * F.greatest(F.lit(1.0), (_SURE - 1) / (n - 1))
    more = F.filter("__c", lambda x: free(x) & (ratio(word(x), table) > least(x["end"] - x["start"])))
    order = F.array_sort(F.transform(F.concat(F.col("__b"), more), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))))
    return docs.withColumn("secrets", F.transform(order, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))).drop("__t", "__b", "__c")


def _joined(spans):
    name = lambda k: F.get(F.array(*map(F.lit, KINDS)), k)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x["kind"]), x["start"], x["end"])), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: secrets of every document."""
    docs = spread(documents(spark, sf_dir).select("doc_id", "text"))
    out = scan(docs, train(docs))
    of = lambda k: F.size(F.filter("secrets", lambda x: x["kind"] == k)).cast("long")
    base = F.filter("secrets", lambda x: x["kind"] < 3)
    return out.select("doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"),
                      F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("secrets")).alias("spans"), of(3).alias("n_markov"))
