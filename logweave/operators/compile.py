"""P4 compile_templates, P5 loose_pattern, L8 matchable_templates.

A compiled template keeps arrays, not regex objects:
``tpl_tokens`` (all tokens), ``is_wild`` (token is a whole ``<...>``), ``label_paths``
(field path of each wildcard; '*', 'unknown' and '' give '' = no field), ``literal_tokens``
(literals in order) and ``literal_count``. ``registry_seq`` orders templates with the same
literal count (registry insertion order in the reference).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.functions.tokens import WILDCARD_TOKEN_RE, tokens

NO_FIELD_LABELS = ("*", "unknown", "")
_INNER_RE = r"^<([^>]*)>$"


def compile_templates(templates: DataFrame, text_col: str = "labeled_template",
                      id_col: str = "cluster_id", seq_col: str = "registry_seq") -> DataFrame:
    """One compiled row per template."""
    c = templates.select(F.col(id_col).alias("cluster_id"), F.col(seq_col).cast("bigint").alias("registry_seq"),
                         F.col(text_col).alias("labeled_template"), tokens(F.col(text_col)).alias("tpl_tokens"))

    def path_of(t):
        inner = F.regexp_extract(t, _INNER_RE, 1)
        return F.when(t.rlike(WILDCARD_TOKEN_RE),
                      F.when(inner.isin(*NO_FIELD_LABELS), F.lit("")).otherwise(inner))

    # most templates of prose have no wildcard: their tokens need no regex
    some = F.col("labeled_template").contains("<")
    return (c.withColumn("is_wild", F.when(some, F.transform("tpl_tokens", lambda t: t.rlike(WILDCARD_TOKEN_RE))).otherwise(F.transform("tpl_tokens", lambda t: F.lit(False))))
            .withColumn("label_paths", F.when(some, F.transform("tpl_tokens", path_of)).otherwise(F.transform("tpl_tokens", lambda t: F.lit(None).cast("string"))))
            .withColumn("literal_tokens", F.when(some, F.filter("tpl_tokens", lambda t: ~t.rlike(WILDCARD_TOKEN_RE))).otherwise(F.col("tpl_tokens")))
            .withColumn("n_tokens", F.size("tpl_tokens"))
            .withColumn("literal_count", F.size("literal_tokens")))


def loose_match_expr(literals_sql: str, line_sql: str) -> Column:
    """P5: all literals occur in the line in order, as substrings, each after the end of
    the previous one. Leftmost search per literal is exact for fixed strings. An empty
    literal list never matches."""
    return F.expr(
        f"size({literals_sql}) > 0 AND aggregate({literals_sql}, 1, (lw_pos, lw_lit) -> "
        f"CASE WHEN lw_pos > 0 AND locate(lw_lit, {line_sql}, lw_pos) > 0 "
        f"THEN locate(lw_lit, {line_sql}, lw_pos) + length(lw_lit) ELSE 0 END) > 0")


def matchable_templates(templates: DataFrame, fallback_to_pattern: bool = False) -> DataFrame:
    """ACTIVE, reviewed templates with a labeled template, compiled on that label.
    ``fallback_to_pattern=True`` is the keep/reset form (L2): label else pattern, and the
    pattern (the reset text) after a reset, whose label describes the old text. An ACTIVE
    template whose merge or split was refused is not matchable."""
    text = F.nullif(F.col("labeled_template"), F.lit(""))
    if fallback_to_pattern:
        pattern = F.nullif(F.col("pattern"), F.lit(""))
        text = F.when(F.col("decision") == "reset", F.coalesce(pattern, text)).otherwise(F.coalesce(text, pattern))
    t = (templates.where((F.col("status") == "ACTIVE") & F.col("decision").isin("keep", "reset"))
         .withColumn("__text", text).where(F.col("__text").isNotNull()))
    if "registry_seq" not in t.columns:
        # registry order = registration order (creation time)
        t = t.withColumn("registry_seq", F.unix_micros(F.col("created_at").cast("timestamp")))
    return compile_templates(t, "__text")
