"""J4 normalize / P17 full_event: first matching rule for a text, then the OCSF event.

The rule set is configuration (bounded by the rule file), so labelling is a single
projection: ``coalesce(when(text rlike '(?i)p1', label1), when(... p2 ...), ...)``.
Coalesce evaluates its children in order and stops at the first non-null, so the cost per
row is "regexes until the first hit", like the reference's loop; the patterns are
literals, compiled once per task. A regex of the default rules runs only where the words it
cannot do without occur (plain searches in the lower-cased text). No join, no shuffle.

``label_distinct`` is the form for template tables (label each distinct template once).
"""

from __future__ import annotations

import functools
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.sources.rules import DEFAULT_RULES, RULE_WORDS, rules_as_list

LABEL_FIELDS = ("rule_order", "class_uid", "class_name", "activity_id", "activity_name",
                "severity_id", "category_uid", "category_name", "matched_rule")


def _label_struct(order: int, r) -> Column:
    return F.struct(
        F.lit(order).cast("int").alias("rule_order"),
        F.lit(r.class_uid).cast("int").alias("class_uid"),
        F.lit(r.class_name).alias("class_name"),
        F.lit(r.activity_id).cast("int").alias("activity_id"),
        F.lit(r.activity_name).alias("activity_name"),
        F.lit(r.severity_id).cast("int").alias("severity_id"),
        F.lit(r.category_uid).cast("int").alias("category_uid"),
        F.lit(r.category_name).alias("category_name"),
        F.lit(r.pattern).alias("matched_rule"),
    )


def label_column(text: Column, rules=DEFAULT_RULES) -> Column:
    """Struct of the first rule whose regex is found (case-insensitive) in ``text``; else null."""
    rs = rules_as_list(rules)
    if not rs:
        return F.lit(None).cast(
            "struct<rule_order:int,class_uid:int,class_name:string,activity_id:int,"
            "activity_name:string,severity_id:int,category_uid:int,category_name:string,"
            "matched_rule:string>")

    def found(x: Column, r) -> Column:
        # (?i) folds ASCII letters only, which ``lower`` folds too
        hit = x["t"].rlike("(?i)" + r.pattern)
        words = RULE_WORDS.get(r.pattern)
        if not words:
            return hit
        return functools.reduce(or_, (functools.reduce(and_, (x["low"].contains(w) for w in ws)) for ws in words)) & hit

    def first(x: Column) -> Column:
        branches = [F.when(found(x, r), _label_struct(i + 1, r)) for i, r in enumerate(rs)]
        return F.coalesce(*branches) if len(branches) > 1 else branches[0]

    return F.get(F.transform(F.array(F.struct(text.alias("t"), F.lower(text).alias("low"))), first), 0)


def normalize(df: DataFrame, text_col: str = "template", rules=DEFAULT_RULES,
              out_col: str = "ocsf") -> DataFrame:
    """Adds ``ocsf`` (label struct or null) for the text in ``text_col``."""
    return df.withColumn(out_col, label_column(F.col(text_col), rules))


def label_distinct(df: DataFrame, text_col: str = "template", rules=DEFAULT_RULES) -> DataFrame:
    """Label each distinct text once: returns (text, ocsf). Join back on the text."""
    return normalize(df.select(text_col).distinct(), text_col, rules)


def full_event(df: DataFrame, line_col: str = "line", text_col: str = "template",
               rules=DEFAULT_RULES, out_col: str = "ocsf_event", **kw) -> DataFrame:
    """Rule label of ``text_col`` then the OCSF event of ``line_col``; no rule = null."""
    from logweave.functions.events import ocsf_event

    lab = label_column(F.col(text_col), rules)
    return df.withColumn("__lab", lab).withColumn(
        out_col, F.when(F.col("__lab").isNotNull(),
                        ocsf_event(F.col(line_col), F.col("__lab"), **kw))).drop("__lab")


def sql_label_case(text_sql: str, rules=DEFAULT_RULES, field: str = "rule_order") -> str:
    """DuckDB CASE giving one label field of the first matching rule (NULL if none)."""
    rs = rules_as_list(rules)
    parts = []
    for i, r in enumerate(rs):
        val = {"rule_order": i + 1, "class_uid": r.class_uid, "class_name": r.class_name,
               "activity_id": r.activity_id, "activity_name": r.activity_name,
               "severity_id": r.severity_id, "category_uid": r.category_uid,
               "category_name": r.category_name, "matched_rule": r.pattern}[field]
        lit = "'" + val.replace("'", "''") + "'" if isinstance(val, str) else str(val)
        pat = "'" + r.pattern.replace("'", "''") + "'"
        parts.append(f"WHEN regexp_matches({text_sql}, {pat}, 'i') THEN {lit}")
    return "CASE " + " ".join(parts) + " END"
