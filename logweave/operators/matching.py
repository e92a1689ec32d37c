"""Fast-path matching of raw lines to compiled templates.

Strict match (J1/W1). A line matches a template when it has no leading whitespace (a
single trailing newline is tolerated), the same number of whitespace tokens, and equal
tokens at every literal position; wildcard positions take any token. This is exactly the
anchored ``^lit\\s+(\\S+)\\s+lit$`` test, without regex. Plan: compiled templates are
grouped per (token count, first token) into arrays sorted most-specific first
(``literal_count`` desc, ``registry_seq`` asc); templates starting with a wildcard form a
second lookup per token count. Both small tables are broadcast-joined on unique keys, so
every line gets at most one row from each, the join never multiplies rows, a line only
meets templates that can match its length and first token, and the "best template" is
``filter(candidates, matches)[0]`` — no per-line shuffle, window or aggregate. The template table is bounded by the number of approved templates;
its size is counted before broadcasting, and beyond ``max_broadcast_templates`` the same
join runs as a shuffle join (AQE splits skewed token-count partitions).

Near match (J2/F1/W2). Lines with no strict match are tested against every template
that has literals: all literals must occur in order as substrings, and the best token-level
``SequenceMatcher`` score wins; NEAR when >= threshold. The registry's index and the one pass a
line are in ``near``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.functions.tokens import bare, tokens
from logweave.operators.near import LITERALS, SHARD, best_near, candidate_ids

DEFAULT_NEAR_THRESHOLD = 0.85
MAX_BROADCAST_TEMPLATES = 200_000

def _priority_sorted(cands: Column) -> Column:
    return F.array_sort(cands, lambda a, b: F.when(a["literal_count"] != b["literal_count"],
                                                   b["literal_count"] - a["literal_count"])
                        .otherwise(F.when(a["registry_seq"] < b["registry_seq"], -1)
                                   .when(a["registry_seq"] > b["registry_seq"], 1).otherwise(0)))


def templates_by_token_count(compiled: DataFrame) -> DataFrame:
    """One lookup row per (token count, first token) with its templates, most specific
    first. Templates whose first token is a wildcard sit under the key '<*>'."""
    first_wild = F.get(F.col("tpl_tokens"), 0).rlike(r"^<[^>]*>$")
    some = F.exists("tpl_tokens", lambda t: t.startswith("<"))
    c = compiled.select(
        "n_tokens",
        F.when(F.size("tpl_tokens") == 0, F.lit("")).when(first_wild, F.lit("<*>"))
        .otherwise(F.get(F.col("tpl_tokens"), 0)).alias("first"),
        # shuffled as texts, of which the arrays below are several times the size
        F.struct(F.col("literal_count").cast("int").alias("literal_count"), "registry_seq", "cluster_id",
                 F.array_join("tpl_tokens", " ").alias("text"), F.when(some, F.col("label_paths")).alias("label_paths")).alias("t"))
    g = c.groupBy("n_tokens", "first").agg(F.collect_list("t").alias("cands"))

    def cut(t: Column) -> Column:
        toks = F.array_remove(F.split(t["text"], " "), "")
        lits = F.when(t["label_paths"].isNull(), toks).otherwise(F.transform(toks, lambda x: F.when(~x.rlike(r"^<[^>]*>$"), x)))
        return F.struct(t["literal_count"].alias("literal_count"), t["registry_seq"].alias("registry_seq"), t["cluster_id"].alias("cluster_id"), lits.alias("lits"),
                        F.coalesce(t["label_paths"], F.transform(toks, lambda x: F.lit(None).cast("string"))).alias("label_paths"))

    return g.select(F.col("n_tokens").alias("__n"), F.col("first").alias("__f"),
                    _priority_sorted(F.transform("cands", cut)).alias("__cands"))


def _dedupe_last(entries: Column) -> Column:
    """Keep the last entry of each key (duplicate labels: last slot wins)."""
    return F.filter(entries, lambda e, i: ~F.exists(
        F.slice(entries, i + 2, F.greatest(F.size(entries) - i - 1, F.lit(1))),
        lambda x: x["k"] == e["k"]) | (i + 1 == F.size(entries)))


def strict_match(lines: DataFrame, compiled: DataFrame, line_col: str = "line",
                 max_broadcast_templates: int = MAX_BROADCAST_TEMPLATES) -> DataFrame:
    """J1 + W1: adds ``exact_cluster_id``, ``exact_literal_count``, ``matched_fields``."""
    line = F.col(line_col)
    # one line feed at the end is no part of the line
    ws_ok = bare(line) | (line.endswith("\n") & bare(F.substr(line, F.lit(1), F.length(line) - 1)))
    x = lines.withColumn("__toks", tokens(line)).withColumn("__ws_ok", ws_ok)
    x = x.withColumn("__n", F.size("__toks"))
    lookup = templates_by_token_count(compiled)
    # explicit size checks, one a lookup: templates that start with a wildcard are few
    first_wild = F.get(F.col("tpl_tokens"), 0).rlike(r"^<[^>]*>$")
    sizes = compiled.agg(F.count(F.lit(1)).alias("n"), F.count_if(first_wild).alias("wild"), F.coalesce(F.sum("literal_count"), F.lit(0)).alias("literals")).first()
    # two lookups per line, each on a unique key (no row multiplication): templates whose
    # first token equals the line's first token, and templates starting with a wildcard
    x = x.withColumn("__f", F.coalesce(F.get(F.col("__toks"), 0), F.lit("")))
    lit_first = lookup.where(F.col("__f") != "<*>").withColumnRenamed("__cands", "__c1")
    wild_first = lookup.where(F.col("__f") == "<*>").select("__n", F.col("__cands").alias("__c2"))
    if sizes.n <= max_broadcast_templates and sizes.literals <= LITERALS:
        lit_first = F.broadcast(lit_first)
    else:
        x = x.drop("__toks")        # cut anew behind the shuffle, which carries the lines alone
    if sizes.wild <= max_broadcast_templates:
        wild_first = F.broadcast(wild_first)
    j = x.join(lit_first, ["__n", "__f"], "left").join(wild_first, "__n", "left")
    if "__toks" not in j.columns:
        j = j.withColumn("__toks", tokens(line))
    both = F.concat(F.coalesce(F.col("__c1"), F.array()), F.coalesce(F.col("__c2"), F.array()))
    hit = F.filter(_priority_sorted(both), lambda c: F.forall(
        F.zip_with(c["lits"], F.col("__toks"), lambda a, b: a.isNull() | (a == b)), lambda ok: ok))
    j = j.withColumn("__best", F.when(F.col("__ws_ok"), F.get(hit, 0)))
    entries = F.filter(F.zip_with(F.col("__best.label_paths"), F.col("__toks"),
                                  lambda p, v: F.struct(p.alias("k"), v.alias("v"))),
                       lambda e: e["k"].isNotNull() & (e["k"] != ""))
    fields = F.when(F.col("__best").isNotNull(), F.map_from_entries(_dedupe_last(entries)))
    return (j.withColumn("exact_cluster_id", F.col("__best.cluster_id"))
            .withColumn("exact_literal_count", F.col("__best.literal_count"))
            .withColumn("matched_fields", fields)
            .drop("__toks", "__ws_ok", "__n", "__f", "__c1", "__c2", "__best"))


def loose_candidates(lines: DataFrame, compiled: DataFrame, line_col: str = "line", shard: int = SHARD,
                     ids: bool = True) -> DataFrame:
    """J2 / P5 candidate test: adds ``loose_ids``, the templates (with literals) whose
    literals all occur in the line in order, most specific first; without ``ids`` their number
    ``n_loose`` and the first of them, ``first_loose``."""
    return candidate_ids(lines, compiled, F.col(line_col), shard, ids)


def near_match(lines: DataFrame, compiled: DataFrame, line_col: str = "line",
               threshold: float = DEFAULT_NEAR_THRESHOLD, only_when: Column | None = None, shard: int = SHARD) -> DataFrame:
    """J2 + F1 + W2: adds ``near_cluster_id`` and ``similarity`` (NULL below threshold); the
    best score wins, then the more specific, the earlier and the smaller id. Lines that
    ``only_when`` leaves out are not looked at."""
    line = F.col(line_col) if only_when is None else F.when(only_when, F.col(line_col))
    return best_near(lines, compiled, line, threshold, shard)


def fast_path(lines: DataFrame, compiled: DataFrame, line_col: str = "line",
              threshold: float = DEFAULT_NEAR_THRESHOLD) -> DataFrame:
    """U1 dispatch: exactly one row per line with ``match_kind`` EXACT / NEAR / NONE."""
    s = strict_match(lines, compiled, line_col)
    n = near_match(s, compiled, line_col, threshold, only_when=F.col("exact_cluster_id").isNull())
    kind = (F.when(F.col("exact_cluster_id").isNotNull(), "EXACT")
            .when(F.col("near_cluster_id").isNotNull(), "NEAR").otherwise("NONE"))
    return (n.withColumn("match_kind", kind)
            .withColumn("cluster_id", F.coalesce("exact_cluster_id", "near_cluster_id")))
