"""Registered queries: one Spark job per operator family plus its DuckDB oracle SQL.

Each Spark job reads the driver's tables (through the stand-in log renderings of
``logweave.sources.tables``) and runs the library operator over *all* rows. The oracle
SQL recomputes the same result independently in DuckDB; computed columns carry the same
aliases on both sides. Queries that are not SQL-expressible (order-dependent folds,
difflib similarity, sampling by design) register no oracle and are covered by tests
against brute force on small fixtures.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweave.functions import masks as M
from logweave.operators import normalize as N
from logweave.operators import reports as R
from logweave.plans.coverage import class_coverage_job, labelled_lines
from logweave.session import cut_lineage, tune
from logweave.sources.tables import (DOCUMENT_LINES_SQL, EVENT_LINES_SQL, document_lines,
                                     event_log_lines)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            tune(spark)
            return fn(spark, sf_dir)
        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run
    return deco


# ---------------------------------------------------------------------------
# Masks (M1-M21) with extraction
# ---------------------------------------------------------------------------

def _mask_query(lines: DataFrame) -> DataFrame:
    m = M.mask_lines(lines)
    return m.select("line_id", "processed", M.render_extractions(F.col("extractions")).alias("extractions"))


def _mask_sql(src: str) -> str:
    chain = M.sql_mask_chain(src, "line_id")
    return f"SELECT line_id, processed, {M.sql_render_extractions()} AS extractions FROM ({chain})"


@register("mask_event_lines", _mask_sql(EVENT_LINES_SQL))
def mask_event_lines(spark, sf_dir):
    return _mask_query(event_log_lines(spark, sf_dir))


@register("mask_document_lines", _mask_sql(DOCUMENT_LINES_SQL))
def mask_document_lines(spark, sf_dir):
    return _mask_query(document_lines(spark, sf_dir))


# ---------------------------------------------------------------------------
# Rule labelling (J4) and coverage (A6 + A9) — the flagship
# ---------------------------------------------------------------------------

def _masked_sql(src: str) -> str:
    return M.sql_mask_chain(src, "line_id", with_extractions=False)


def _label_sql(src: str) -> str:
    t = "processed"
    return (f"SELECT line_id, CAST({N.sql_label_case(t, field='rule_order')} AS BIGINT) AS rule_order, "
            f"CAST({N.sql_label_case(t, field='class_uid')} AS BIGINT) AS class_uid, "
            f"{N.sql_label_case(t, field='class_name')} AS class_name, "
            f"{N.sql_label_case(t, field='activity_name')} AS activity_name, "
            f"CAST({N.sql_label_case(t, field='severity_id')} AS BIGINT) AS severity_id "
            f"FROM ({_masked_sql(src)})")


def _label_query(lines: DataFrame) -> DataFrame:
    lab = labelled_lines(lines)
    return lab.select("line_id", F.col("ocsf.rule_order").cast("bigint").alias("rule_order"),
                      F.col("ocsf.class_uid").cast("bigint").alias("class_uid"),
                      F.col("ocsf.class_name").alias("class_name"),
                      F.col("ocsf.activity_name").alias("activity_name"),
                      F.col("ocsf.severity_id").cast("bigint").alias("severity_id"))


@register("label_event_lines", _label_sql(EVENT_LINES_SQL))
def label_event_lines(spark, sf_dir):
    return _label_query(event_log_lines(spark, sf_dir))


@register("label_document_lines", _label_sql(DOCUMENT_LINES_SQL))
def label_document_lines(spark, sf_dir):
    return _label_query(document_lines(spark, sf_dir))


def _coverage_sql(src: str) -> str:
    lab = _label_sql(src)
    return ("SELECT ocsf_class, activity, rule_order, lines, "
            "CAST(floor(lines * 100.0 / sum(lines) OVER ()) AS BIGINT) AS pct FROM ("
            " SELECT coalesce(class_name, '<unmatched>') AS ocsf_class,"
            " CASE WHEN class_name IS NULL THEN '' ELSE activity_name END AS activity,"
            f" rule_order, count(*) AS lines FROM ({lab}) GROUP BY ALL)")


@register("ocsf_class_coverage", _coverage_sql(EVENT_LINES_SQL))
def ocsf_class_coverage(spark, sf_dir):
    return class_coverage_job(event_log_lines(spark, sf_dir))


@register("ocsf_class_coverage_documents", _coverage_sql(DOCUMENT_LINES_SQL))
def ocsf_class_coverage_documents(spark, sf_dir):
    return class_coverage_job(document_lines(spark, sf_dir))


# ---------------------------------------------------------------------------
# OCSF events (P10-P17): rule label on the masked line, event from the raw line
# ---------------------------------------------------------------------------

def _events_query(lines: DataFrame) -> DataFrame:
    from logweave.functions.events import event_uid, flat_event_columns, ocsf_event

    # every line is kept (event NULL when no rule matches): a filter on the label would be
    # pushed below the projection and evaluate the whole mask + rule chain twice
    lab = labelled_lines(lines)
    ts = F.col("arrival_ts") if "arrival_ts" in lines.columns else None
    ev = lab.withColumn("ocsf_event", F.when(F.col("ocsf").isNotNull(), ocsf_event(
        F.col("line"), F.col("ocsf"), ts, event_uid(F.col("line_id")))))
    return ev.select("line_id", *flat_event_columns("ocsf_event"))


def _events_sql(src: str) -> str:
    from logweave.functions.events import sql_flat_event

    masked = M.sql_mask_chain(src, "line_id, line", with_extractions=False)
    lab = (f"SELECT line_id, line, {N.sql_label_case('processed', field='class_uid')} AS l_cls, "
           f"{N.sql_label_case('processed', field='severity_id')} AS l_sev, "
           f"{N.sql_label_case('processed', field='activity_id')} AS l_act, "
           f"{N.sql_label_case('processed', field='class_name')} AS l_cname, "
           f"{N.sql_label_case('processed', field='activity_name')} AS l_aname FROM ({masked})")
    from logweave.functions.events import FLAT_EVENT_NAMES

    flat = sql_flat_event("line", "l_cls", "l_sev", "l_act", "l_cname", "l_aname")
    outer = ", ".join(f"CASE WHEN l_cls IS NOT NULL THEN {c} END AS {c}" for c in FLAT_EVENT_NAMES)
    return f"SELECT line_id, {outer} FROM (SELECT line_id, l_cls, {flat} FROM ({lab}))"


@register("ocsf_events", _events_sql(EVENT_LINES_SQL))
def ocsf_events(spark, sf_dir):
    return _events_query(event_log_lines(spark, sf_dir))


@register("ocsf_events_documents", _events_sql(DOCUMENT_LINES_SQL))
def ocsf_events_documents(spark, sf_dir):
    return _events_query(document_lines(spark, sf_dir))


# ---------------------------------------------------------------------------
# Mining family. sim_th = 0 puts every line of a mining key into one cluster, which
# makes the whole chain (A2 templates, W3 change types, W4 versions, A4-A11 reports)
# SQL-expressible; the default threshold (0.4) has no SQL form (ordered fold).
# Outputs name clusters by their mining key, which both sides can compute.
# ---------------------------------------------------------------------------

def _ingest_key_groups(spark, sf_dir):
    from logweave.plans.ingest import ingest

    out = ingest(event_log_lines(spark, sf_dir), sim_th=0.0, with_extractions=False)
    keys = out.cluster_templates.select("cluster_id", "key")
    return out, out.results.join(keys, "cluster_id", "left")


def _kg_sql(src: str = EVENT_LINES_SQL) -> str:
    """DuckDB: per-line results for key-group clustering (sim_th = 0)."""
    masked = M.sql_mask_chain(src, "line_id, line", with_extractions=False)
    lab = N.sql_label_case("template", field="rule_order")
    lab_cls = N.sql_label_case("template", field="class_name")
    return f"""WITH m AS ({masked}),
t AS (SELECT line_id, processed, regexp_split_to_array(regexp_replace(processed, '^\\s+|\\s+$', '', 'g'), '\\s+') AS toks FROM m),
k AS (SELECT *, CAST(len(toks) AS VARCHAR) || '|' || CASE WHEN regexp_matches(toks[1], '\\d') THEN '<*>' ELSE toks[1] END AS key FROM t),
d AS (SELECT key, processed, min(line_id) AS first_line_id, any_value(toks) AS toks FROM k GROUP BY key, processed),
p AS (SELECT key, first_line_id, unnest(toks) AS tok, unnest(range(1, len(toks) + 1)) AS pos FROM d),
f AS (SELECT key, pos, arg_min(tok, first_line_id) AS t0 FROM p GROUP BY key, pos),
c0 AS (SELECT key, min(first_line_id) AS c0 FROM d GROUP BY key),
cp AS (SELECT p.key, p.pos, min(p.first_line_id) AS change_line FROM p JOIN f ON p.key = f.key AND p.pos = f.pos
       WHERE f.t0 <> '<*>' AND p.tok <> f.t0 GROUP BY p.key, p.pos),
vl AS (SELECT key, c0 AS trig FROM c0 UNION SELECT key, change_line FROM cp),
v AS (SELECT vl.key, vl.trig, string_agg(CASE WHEN cp.change_line IS NOT NULL AND cp.change_line <= vl.trig THEN '<*>' ELSE f.t0 END, ' ' ORDER BY f.pos) AS template
      FROM vl JOIN f ON f.key = vl.key LEFT JOIN cp ON cp.key = f.key AND cp.pos = f.pos GROUP BY vl.key, vl.trig),
r0 AS (SELECT k.line_id, k.key,
        CASE WHEN k.line_id = c0.c0 THEN 'CREATE'
             WHEN k.line_id = d.first_line_id AND EXISTS (SELECT 1 FROM cp WHERE cp.key = k.key AND cp.change_line = k.line_id) THEN 'UPDATE'
             ELSE 'NONE' END AS change_type,
        (SELECT arg_max(v.template, v.trig) FROM v WHERE v.key = k.key AND v.trig <= k.line_id) AS template
      FROM k JOIN d ON d.key = k.key AND d.processed = k.processed JOIN c0 ON c0.key = k.key),
r AS (SELECT *, {lab} AS rule_order, {lab_cls} AS class_name FROM r0),
vers AS (SELECT key, CAST(row_number() OVER (PARTITION BY key ORDER BY trig) AS BIGINT) AS version, template, trig AS trigger_line_id FROM v)
"""


@register("key_group_templates", _kg_sql() + """SELECT v.key, arg_max(v.template, v.trig) AS template,
  (SELECT count(*) FROM k WHERE k.key = v.key) AS lines FROM v GROUP BY v.key""")
def key_group_templates(spark, sf_dir):
    """A1 at sim_th=0 + A2: final template per mining key, with its line count."""
    out, res = _ingest_key_groups(spark, sf_dir)
    counts = res.groupBy("key").agg(F.count(F.lit(1)).alias("lines"))
    return out.cluster_templates.select("key", "template").join(counts, "key")


@register("key_group_change_types", _kg_sql() + "SELECT line_id, key, change_type, template FROM r0")
def key_group_change_types(spark, sf_dir):
    """Change type and the template as of each line."""
    _, res = _ingest_key_groups(spark, sf_dir)
    return res.select("line_id", "key", "change_type", "template")


@register("key_group_versions", _kg_sql() + "SELECT key, version, template, trigger_line_id FROM vers")
def key_group_versions(spark, sf_dir):
    """Numbered template versions with the line that triggered each."""
    out, _ = _ingest_key_groups(spark, sf_dir)
    keys = out.cluster_templates.select("cluster_id", "key")
    return (out.versions.join(keys, "cluster_id")
            .select("key", F.col("version").cast("bigint").alias("version"), "template", "trigger_line_id"))


@register("upload_report_events", _kg_sql() + """SELECT count(*) AS total_logs, count(DISTINCT key) AS unique_templates,
  round_even((1.0 - count(DISTINCT key) / greatest(count(*), 1)) * 100.0, 1) AS compression_pct,
  count(*) FILTER (WHERE rule_order IS NOT NULL) AS ocsf_matched,
  count(*) FILTER (WHERE rule_order IS NULL) AS ocsf_unmatched FROM r""")
def upload_report_events(spark, sf_dir):
    """A4 on ingest results (labels on the mined template)."""
    _, res = _ingest_key_groups(spark, sf_dir)
    return R.upload_report(res)


@register("change_type_breakdown_events", _kg_sql() + "SELECT change_type, count(*) AS lines FROM r GROUP BY change_type")
def change_type_breakdown_events(spark, sf_dir):
    """A5."""
    _, res = _ingest_key_groups(spark, sf_dir)
    return R.change_type_breakdown(res)


@register("class_breakdown_events", _kg_sql() + "SELECT class_name AS ocsf_class, count(*) AS lines FROM r WHERE class_name IS NOT NULL GROUP BY 1")
def class_breakdown_events(spark, sf_dir):
    """A6 on mined templates."""
    _, res = _ingest_key_groups(spark, sf_dir)
    return R.class_breakdown(res)


@register("unmatched_templates_events", _kg_sql() + """SELECT key, count(*) AS count, min(line_id) AS first_line_id,
  arg_min(coalesce(template, ''), line_id) AS template FROM r WHERE rule_order IS NULL
  GROUP BY key ORDER BY count DESC, first_line_id LIMIT 5""")
def unmatched_templates_events(spark, sf_dir):
    """Top 5 unlabelled clusters."""
    out, res = _ingest_key_groups(spark, sf_dir)
    top = R.unmatched_templates(res)
    keys = out.cluster_templates.select("cluster_id", "key")
    return top.join(keys, "cluster_id").select("key", "count", "first_line_id", "template")


@register("pipeline_counters_events", _kg_sql() + """SELECT counter, value FROM (
  SELECT 'logs_ingested' AS counter, count(*) AS value FROM r UNION ALL
  SELECT 'templates_created', count(*) FILTER (WHERE change_type = 'CREATE') FROM r UNION ALL
  SELECT 'templates_updated', count(*) FILTER (WHERE change_type = 'UPDATE') FROM r UNION ALL
  SELECT 'templates_merged', 0 UNION ALL SELECT 'templates_split', 0 UNION ALL
  SELECT 'llm_calls', 0 UNION ALL SELECT 'llm_errors', 0 UNION ALL SELECT 'llm_fallback_keep', 0 UNION ALL
  SELECT 'queue_drops', 0 UNION ALL
  SELECT 'ocsf_matched', count(*) FILTER (WHERE rule_order IS NOT NULL) FROM r UNION ALL
  SELECT 'ocsf_unmatched', count(*) FILTER (WHERE rule_order IS NULL) FROM r UNION ALL
  SELECT 'fast_path_hits', 0 UNION ALL SELECT 'near_match_queued', 0)""")
def pipeline_counters_events(spark, sf_dir):
    """A10 counters (long form)."""
    _, res = _ingest_key_groups(spark, sf_dir)
    return R.pipeline_counters(res)


@register("cluster_sizes_events", _kg_sql() + "SELECT key, count(*) AS n FROM r GROUP BY key")
def cluster_sizes_events(spark, sf_dir):
    """Lines per cluster."""
    out, res = _ingest_key_groups(spark, sf_dir)
    return R.cluster_sizes(res).join(out.cluster_templates.select("cluster_id", "key"), "cluster_id").select("key", "n")


@register("coverage_events", _kg_sql() + """SELECT count(*) FILTER (WHERE rule_order IS NOT NULL) AS matched, count(*) AS total,
  count(*) FILTER (WHERE rule_order IS NULL) AS unmatched,
  CAST(floor(count(*) FILTER (WHERE rule_order IS NOT NULL) * 100 / count(*)) AS BIGINT) AS coverage_pct FROM r""")
def coverage_events(spark, sf_dir):
    """A9 on mined templates."""
    _, res = _ingest_key_groups(spark, sf_dir)
    return R.coverage(res)


# The default threshold in SQL: the sequential fold as a recursion over the lines of all keys,
# with each key's templates and ids as lists.
_MINE_SQL = r"""WITH RECURSIVE m AS ({masked}),
k AS (SELECT line_id, processed, regexp_split_to_array(regexp_replace(processed, '^\s+|\s+$', '', 'g'), '\s+') AS toks FROM m),
kk AS (SELECT *, CAST(len(toks) AS VARCHAR) || '|' || CASE WHEN regexp_matches(toks[1], '\d') THEN '<*>' ELSE toks[1] END AS key FROM k),
d AS (SELECT key, processed AS text, any_value(toks) AS toks, min(line_id) AS line_id, count(*) AS n FROM kk GROUP BY key, processed),
o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY line_id, text) AS rn FROM d),
f AS (
  SELECT key, rn, [toks] AS tpl, [md5(line_id || '|' || text)] AS ids, 1 AS pick, n FROM o WHERE rn = 1
  UNION ALL
  SELECT key, rn,
    CASE WHEN pick > 0 THEN list_transform(tpl, lambda t, i: CASE WHEN i = pick THEN list_transform(t, lambda x, p: CASE WHEN x = toks[p] THEN x ELSE '<*>' END) ELSE t END)
         ELSE list_append(tpl, toks) END,
    CASE WHEN pick > 0 THEN ids ELSE list_append(ids, md5(line_id || '|' || text)) END,
    CASE WHEN pick > 0 THEN pick ELSE len(ids) + 1 END, n
  FROM (SELECT *, CASE WHEN (list_max(score) // (len(toks) + 1)) >= 0.4 * len(toks) THEN list_position(score, list_max(score)) ELSE 0 END AS pick
    FROM (SELECT f.key, o.rn, f.tpl, f.ids, o.toks, o.line_id, o.text, o.n,
        list_transform(f.tpl, lambda t: len(list_filter(list_zip(t, o.toks), lambda z: z[1] <> '<*>' AND z[1] = z[2])) * (len(t) + 1)
                                        + len(list_filter(t, lambda x: x = '<*>'))) AS score
      FROM f JOIN o ON o.key = f.key AND o.rn = f.rn + 1))),
last AS (SELECT key, max_by(tpl, rn) AS tpl, max_by(ids, rn) AS ids FROM f GROUP BY key),
sizes AS (SELECT key, pick, sum(n) AS lines FROM f GROUP BY key, pick)
SELECT ids[pick] AS cluster_id, key, array_to_string(tpl[pick], ' ') AS template, CAST(lines AS BIGINT) AS lines
FROM sizes JOIN last USING (key)"""


def _mine_sql(src: str) -> str:
    return _MINE_SQL.format(masked=_masked_sql(src))


@register("mine_event_templates", _mine_sql(EVENT_LINES_SQL))
def mine_event_templates(spark, sf_dir):
    """A1 (sim_th 0.4) on all event lines: final template and line count per cluster."""
    from logweave.plans.ingest import ingest

    out = ingest(event_log_lines(spark, sf_dir), with_extractions=False)
    # lines per cluster from the pre-aggregated distinct counts (no per-line join-back)
    return out.cluster_templates.join(out.cluster_lines, "cluster_id").select("cluster_id", "key", "template", "lines")


@register("mine_document_templates", _mine_sql(DOCUMENT_LINES_SQL))
def mine_document_templates(spark, sf_dir):
    """A1 on every line of every document (prose: nearly one key per line)."""
    from logweave.plans.ingest import ingest

    out = ingest(document_lines(spark, sf_dir), with_extractions=False)
    # lines per cluster from the pre-aggregated distinct counts (no per-line join-back)
    return out.cluster_templates.join(out.cluster_lines, "cluster_id").select("cluster_id", "key", "template", "lines")


# ---------------------------------------------------------------------------
# Fast path on raw lines (J1/W1 strict, J2/F1/W2 near). Templates are derived by Spark
# from the data: the position-wise template of each mining key of the masked lines,
# ordered by first appearance.
# ---------------------------------------------------------------------------

def _key_templates(spark, sf_dir):
    from logweave.functions.tokens import tokens
    from logweave.operators.compile import compile_templates
    from logweave.operators.mining import mining_key, template_of_cluster

    lines = event_log_lines(spark, sf_dir)
    # masked once: the templates and their first lines read the written texts
    keyed = cut_lineage(M.mask_only(lines).select("line_id", "processed", mining_key(tokens(F.col("processed"))).alias("key")))
    tpl = template_of_cluster(keyed, "key", "processed")
    seq = keyed.groupBy(F.col("key").alias("cluster_id")).agg(F.min("line_id").alias("registry_seq"))
    # derived once and written to the checkpoint folder: both passes (strict, near) and
    # the size check read the small template table instead of re-deriving it
    compiled = cut_lineage(compile_templates(tpl.join(seq, "cluster_id"), "template"))
    return lines, compiled


def _render_map(c):
    return F.array_join(F.array_sort(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")


_KEY_TPL_SQL = """WITH m AS ({masked}),
k AS (SELECT line_id, processed, regexp_split_to_array(regexp_replace(processed, '^\\s+|\\s+$', '', 'g'), '\\s+') AS toks FROM m),
kk AS (SELECT *, CAST(len(toks) AS VARCHAR) || '|' || CASE WHEN regexp_matches(toks[1], '\\d') THEN '<*>' ELSE toks[1] END AS key FROM k),
p AS (SELECT key, unnest(toks) AS tok, unnest(range(1, len(toks) + 1)) AS pos FROM kk),
f AS (SELECT key, pos, CASE WHEN min(tok) = max(tok) THEN min(tok) ELSE '<*>' END AS tok FROM p GROUP BY key, pos),
tp AS (SELECT key, list(tok ORDER BY pos) AS ttoks FROM f GROUP BY key),
ct AS (SELECT tp.key, ttoks, len(ttoks) AS n,
          len(list_filter(ttoks, lambda x: NOT regexp_matches(x, '^<[^>]*>$'))) AS literal_count,
          (SELECT min(line_id) FROM kk WHERE kk.key = tp.key) AS seq FROM tp),
ln AS (SELECT line_id, line, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS s FROM ({src})),
lt AS (SELECT line_id, line, (line = s OR line = s || chr(10)) AS ws_ok,
          regexp_split_to_array(s, '\\s+') AS ltoks FROM ln),
cand AS (SELECT lt.line_id, lt.ltoks, ct.key, ct.ttoks, ct.literal_count,
          row_number() OVER (PARTITION BY lt.line_id ORDER BY ct.literal_count DESC, ct.seq) AS rn
        FROM lt JOIN ct ON len(lt.ltoks) = ct.n
        WHERE lt.ws_ok AND list_bool_and(list_transform(list_zip(ct.ttoks, lt.ltoks),
              lambda x: regexp_matches(x[1], '^<[^>]*>$') OR x[1] = x[2]))),
best AS (SELECT * FROM cand WHERE rn = 1),
ent AS (SELECT line_id, unnest(ttoks) AS tt, unnest(ltoks) AS v, unnest(range(1, len(ttoks) + 1)) AS i FROM best),
ent2 AS (SELECT line_id, regexp_extract(tt, '^<([^>]*)>$', 1) AS k, v, i FROM ent WHERE regexp_matches(tt, '^<[^>]*>$')),
fld AS (SELECT line_id, k, arg_max(v, i) AS v FROM ent2 WHERE k NOT IN ('*', 'unknown', '') GROUP BY line_id, k),
fl AS (SELECT line_id, string_agg(k || '=' || v, ';' ORDER BY k) AS fields FROM fld GROUP BY line_id)
SELECT best.line_id, best.key, CAST(best.literal_count AS INTEGER) AS literal_count, coalesce(fl.fields, '') AS fields
FROM best LEFT JOIN fl ON fl.line_id = best.line_id"""


@register("strict_match_event_lines", _KEY_TPL_SQL.format(
    masked=M.sql_mask_chain(EVENT_LINES_SQL, "line_id", with_extractions=False), src=EVENT_LINES_SQL))
def strict_match_event_lines(spark, sf_dir):
    """J1 + W1: raw lines matched to the most specific template (literal count, then
    first appearance); fields named by the placeholder labels."""
    from logweave.operators.matching import strict_match

    lines, compiled = _key_templates(spark, sf_dir)
    m = strict_match(lines, compiled).where(F.col("exact_cluster_id").isNotNull())
    return m.select("line_id", F.col("exact_cluster_id").alias("key"),
                    F.col("exact_literal_count").alias("literal_count"),
                    F.coalesce(_render_map(F.col("matched_fields")), F.lit("")).alias("fields"))


# Every other template is approved: its lines take the fast path, the others are mined.
_REGISTRY_SQL = _KEY_TPL_SQL.replace("WHERE lt.ws_ok AND", "WHERE ct.seq % 2 = 0 AND lt.ws_ok AND").format(
    masked=M.sql_mask_chain(EVENT_LINES_SQL, "line_id", with_extractions=False), src=EVENT_LINES_SQL)


def _registry_ingest_sql() -> str:
    rest = f"SELECT * FROM ({EVENT_LINES_SQL}) WHERE line_id NOT IN (SELECT line_id FROM ({_REGISTRY_SQL}))"
    return _kg_sql(rest) + f"""SELECT line_id, key, true AS fast_path, 'NONE' AS change_type, '' AS template, fields FROM ({_REGISTRY_SQL})
UNION ALL SELECT line_id, key, false, change_type, template, '' FROM r0"""


def _registry_result(results):
    from logweave.functions.tokens import tokens
    from logweave.operators.mining import mining_key

    key = F.when(F.col("fast_path"), F.col("cluster_id")).otherwise(mining_key(tokens(F.col("processed"))))
    return results.select("line_id", key.alias("key"), "fast_path", "change_type", F.when(F.col("fast_path"), "").otherwise(F.col("template")).alias("template"),
                          F.coalesce(_render_map(F.col("matched_fields")), F.lit("")).alias("fields"))


@register("ingest_registry_events", _registry_ingest_sql())
def ingest_registry_events(spark, sf_dir):
    """J5 + U1: ingest with an approved registry; exact lines carry their template's fields,
    the others are mined (threshold 0)."""
    from logweave.plans.ingest import ingest

    lines, compiled = _key_templates(spark, sf_dir)
    out = ingest(lines, compiled=compiled.where("registry_seq % 2 = 0"), sim_th=0.0, near_threshold=1.1)
    return _registry_result(out.results)


@register("near_match_event_lines")
def near_match_event_lines(spark, sf_dir):
    """U1 dispatch (J1 strict, then J2 loose + F1 similarity >= 0.85) of every raw line:
    per match kind and template, the number of lines and the mean similarity."""
    from logweave.operators.matching import fast_path

    lines, compiled = _key_templates(spark, sf_dir)
    r = fast_path(lines, compiled)
    return r.groupBy("match_kind", "cluster_id").agg(F.count(F.lit(1)).alias("lines"),
                                                    F.avg("similarity").alias("mean_similarity"))


# ---------------------------------------------------------------------------
# Sampling (W6 reservoir, A11 counts)
# ---------------------------------------------------------------------------

@register("reservoir_sample_events", """WITH m AS ({masked}),
k AS (SELECT line_id, line, regexp_split_to_array(regexp_replace(processed, '^\\s+|\\s+$', '', 'g'), '\\s+') AS toks FROM m),
kk AS (SELECT line_id, line, CAST(len(toks) AS VARCHAR) || '|' || CASE WHEN regexp_matches(toks[1], '\\d') THEN '<*>' ELSE toks[1] END AS key FROM k),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY md5('logweave:' || CAST(line_id AS VARCHAR)), line_id) AS rn FROM kk)
SELECT key, CAST(row_number() OVER (PARTITION BY key ORDER BY line_id) AS INTEGER) AS slot, line_id, line FROM r WHERE rn <= 200""".format(
    masked=M.sql_mask_chain(EVENT_LINES_SQL, "line_id, line", with_extractions=False)))
def reservoir_sample_events(spark, sf_dir):
    """200 lines per mining key, uniform, deterministic, in arrival order."""
    from logweave.functions.tokens import tokens
    from logweave.operators.mining import mining_key
    from logweave.operators.sampling import reservoir_sample

    keyed = M.mask_only(event_log_lines(spark, sf_dir)).withColumn("key", mining_key(tokens(F.col("processed"))))
    s = reservoir_sample(keyed.select("line_id", "line", "key"), 200, cluster_col="key")
    return s.select("key", "slot", "line_id", "line")


# ---------------------------------------------------------------------------
# Template life cycle (U2, L1-L5, W9), review inputs (J13, P3, W5), parsed records
# (L14/P18/P22), views (P23) and state.
#
# Stand-in input: a template table whose ids are the mining keys of the masked event
# lines (template = position-wise template of the key, created at its first line), and a
# stand-in reviewer that gives, by rank of the key, keep / merge into the previous
# template / split in two / reset to a generalised pattern. Both only shape input rows;
# every step after them is the library's operator.
# ---------------------------------------------------------------------------

_GEN = "<[^>]*>"  # a placeholder token, generalised to <*> by the stand-in reviewer


def _kg_template_table(spark, sf_dir):
    from logweave.functions.tokens import tokens
    from logweave.operators.mining import mining_key, template_of_cluster

    lines = event_log_lines(spark, sf_dir)
    # masked once: the templates, their first lines and whatever follows read the written lines
    keyed = cut_lineage(M.mask_only(lines).withColumn("key", mining_key(tokens(F.col("processed")))))
    tpl = template_of_cluster(keyed, "key", "processed")
    first = keyed.groupBy(F.col("key").alias("cluster_id")).agg(
        F.min_by("arrival_ts", "line_id").cast("timestamp").alias("created_at"))
    t = tpl.join(first, "cluster_id").select(
        "cluster_id", F.col("template").alias("pattern"), F.lit("ACTIVE").alias("status"),
        F.lit(None).cast("string").alias("merge_target_id"), F.lit(0).cast("int").alias("confirmation_count"),
        "created_at", F.lit(None).cast("string").alias("labeled_template"),
        F.lit(None).cast("string").alias("decision"), F.lit(None).cast("string").alias("reasoning"))
    return lines, keyed, cut_lineage(t)


def _standin_decisions(templates):
    from pyspark.sql import Window

    from logweave.functions.tokens import unknown_label

    # the template table is small (one row per template): ranking it in one window is fine
    r = templates.select("cluster_id", "pattern", (F.row_number().over(Window.orderBy("cluster_id")) - 1).alias("r"))
    p = r.select(F.col("r").alias("pr"), F.col("cluster_id").alias("prev_id"), F.col("pattern").alias("prev_pattern"))
    x = r.join(p, F.col("pr") == F.col("r") - 1, "left")
    k = F.col("r") % 4
    gen = F.regexp_replace("pattern", _GEN, "<*>")
    return x.select(
        F.lit("b1").alias("batch_id"), "cluster_id",
        F.when(k == 0, "keep").when(k == 1, "merge").when(k == 2, "split").otherwise("reset").alias("decision"),
        F.when(k == 1, F.col("prev_id")).alias("merge_into_cluster_id"),
        F.when(k == 1, F.regexp_replace("prev_pattern", _GEN, "<*>")).alias("merged_template"),
        F.when(k == 2, F.array(F.col("pattern"), gen)).alias("sub_templates"),
        F.when(k == 3, gen).alias("reset_template"),
        F.when(k == 0, unknown_label(F.col("pattern"))).alias("labeled_template"),
        F.concat(F.lit("stand-in "), k.cast("string")).alias("reasoning"))


_TPL_OUT = ["cluster_id", "pattern", "status", "merge_target_id", "confirmation_count", "labeled_template",
            "decision", "reasoning"]


def _applied_sql() -> str:
    masked = M.sql_mask_chain(EVENT_LINES_SQL, "line_id", with_extractions=False)
    return f"""WITH m AS ({masked}),
k AS (SELECT line_id, regexp_split_to_array(regexp_replace(processed, '^\\s+|\\s+$', '', 'g'), '\\s+') AS toks FROM m),
kk AS (SELECT *, CAST(len(toks) AS VARCHAR) || '|' || CASE WHEN regexp_matches(toks[1], '\\d') THEN '<*>' ELSE toks[1] END AS key FROM k),
p AS (SELECT key, unnest(toks) AS tok, unnest(range(1, len(toks) + 1)) AS pos FROM kk),
f AS (SELECT key, pos, CASE WHEN min(tok) = max(tok) THEN min(tok) ELSE '<*>' END AS tok FROM p GROUP BY key, pos),
tp AS (SELECT key AS cluster_id, string_agg(tok, ' ' ORDER BY pos) AS pattern FROM f GROUP BY key),
t AS (SELECT cluster_id, pattern, row_number() OVER (ORDER BY cluster_id) - 1 AS r FROM tp),
d AS (SELECT t.cluster_id, t.pattern, t.r % 4 AS k, pv.cluster_id AS prev_id, pv.pattern AS prev_pattern FROM t LEFT JOIN t pv ON pv.r = t.r - 1),
dec AS (SELECT cluster_id, pattern, k,
          CASE k WHEN 0 THEN 'keep' WHEN 1 THEN 'merge' WHEN 2 THEN 'split' ELSE 'reset' END AS decision,
          CASE WHEN k = 1 THEN prev_id END AS merge_into,
          CASE WHEN k = 1 THEN regexp_replace(prev_pattern, '{_GEN}', '<*>', 'g') END AS merged_template,
          CASE WHEN k = 3 THEN regexp_replace(pattern, '{_GEN}', '<*>', 'g') END AS reset_template,
          CASE WHEN k = 0 THEN replace(pattern, '<*>', '<unknown>') END AS label,
          'stand-in ' || CAST(k AS VARCHAR) AS reasoning FROM d),
mi AS (SELECT merge_into AS cluster_id, arg_max(merged_template, cluster_id) AS merged FROM dec
       WHERE k = 1 AND merged_template IS NOT NULL GROUP BY merge_into),
kept AS (SELECT dec.cluster_id,
           CASE WHEN k = 3 THEN reset_template WHEN mi.merged IS NOT NULL THEN mi.merged ELSE pattern END AS pattern,
           CASE WHEN k = 1 THEN 'PENDING_MERGE' ELSE 'ACTIVE' END AS status,
           CASE WHEN k = 1 THEN merge_into END AS merge_target_id, 0 AS confirmation_count,
           label AS labeled_template, decision, reasoning
         FROM dec LEFT JOIN mi ON mi.cluster_id = dec.cluster_id WHERE k <> 2),
kids AS (SELECT 'split_' || cluster_id || '_0' AS cluster_id, pattern FROM dec WHERE k = 2 UNION ALL
         SELECT 'split_' || cluster_id || '_1', regexp_replace(pattern, '{_GEN}', '<*>', 'g') FROM dec WHERE k = 2),
applied AS (SELECT * FROM kept UNION ALL
            SELECT cluster_id, pattern, 'ACTIVE', NULL, 0, NULL, NULL, NULL FROM kids)
"""


@register("lifecycle_apply_decisions", _applied_sql() + "SELECT * FROM applied")
def lifecycle_apply_decisions(spark, sf_dir):
    """L1-L5 + U2: keep / merge / split / reset decisions applied to the template table."""
    from logweave.operators.lifecycle import apply_decisions

    _, _, t = _kg_template_table(spark, sf_dir)
    out = apply_decisions(t, _standin_decisions(t))["templates"]
    return out.select(*_TPL_OUT).withColumn("confirmation_count", F.col("confirmation_count").cast("int"))


@register("lifecycle_confirm_merges", _applied_sql() + """,
hits AS (SELECT key AS merge_target_id, count(*) AS h FROM kk GROUP BY key),
fl AS (SELECT line_id, key FROM kk),
firsts AS (SELECT key, min(line_id) AS first_line FROM kk GROUP BY key),
none_hits AS (SELECT kk.key AS merge_target_id, count(*) AS h FROM kk JOIN firsts ON firsts.key = kk.key
              WHERE kk.line_id <> firsts.first_line GROUP BY kk.key)
SELECT a.cluster_id, a.pattern, a.status, a.merge_target_id,
       CAST(CASE WHEN a.status = 'PENDING_MERGE' THEN a.confirmation_count + coalesce(n.h, 0) ELSE a.confirmation_count END AS INTEGER) AS confirmation_count,
       a.labeled_template, a.decision, a.reasoning
FROM applied a LEFT JOIN none_hits n ON n.merge_target_id = a.merge_target_id
WHERE NOT (a.status = 'PENDING_MERGE' AND a.confirmation_count + coalesce(n.h, 0) >= 100)""")
def lifecycle_confirm_merges(spark, sf_dir):
    """Each later line of a merge target confirms the templates pending into it; a
    pending template reaching the threshold is deleted. The threshold is the
    default 100; lines are the key-group clustering's results."""
    from logweave.operators.lifecycle import apply_decisions, confirm_merges

    lines, keyed, t = _kg_template_table(spark, sf_dir)
    applied = apply_decisions(t, _standin_decisions(t))["templates"]
    firsts = keyed.groupBy("key").agg(F.min("line_id").alias("__first"))
    results = (keyed.join(firsts, "key")
               .select(F.col("key").alias("cluster_id"), "line_id",
                       F.when(F.col("line_id") == F.col("__first"), "CREATE").otherwise("NONE").alias("change_type"),
                       F.lit(False).alias("fast_path"), F.lit(False).alias("near_match")))
    return confirm_merges(applied, results, threshold=100).select(*_TPL_OUT)


@register("review_items_events", _applied_sql() + """,
smp AS (SELECT key, line, row_number() OVER (PARTITION BY key ORDER BY md5('logweave:' || CAST(line_id AS VARCHAR)), line_id) AS rn,
               line_id FROM (SELECT kk.key, m2.line, kk.line_id FROM kk JOIN ({EVENT_LINES_SQL}) m2 ON m2.line_id = kk.line_id)),
s3 AS (SELECT key, line, row_number() OVER (PARTITION BY key ORDER BY line_id) AS slot FROM smp WHERE rn <= 200)
SELECT tp.cluster_id, tp.pattern AS template,
       len(list_filter(string_split_regex(tp.pattern, '\\s+'), lambda x: x = '<*>')) / greatest(len(string_split_regex(tp.pattern, '\\s+')), 1) AS wildcard_ratio,
       (SELECT string_agg(line, ' || ' ORDER BY slot) FROM s3 WHERE s3.key = tp.cluster_id AND slot <= 3) AS samples
FROM tp""".replace("{EVENT_LINES_SQL}", EVENT_LINES_SQL))
def review_items_events(spark, sf_dir):
    """J13 + P3 + W5/W6: every template touched by a CREATE, once, with its wildcard ratio
    and the first three of its 200 reservoir samples."""
    from logweave.operators.review import review_new_or_changed
    from logweave.operators.sampling import reservoir_sample

    lines, keyed, t = _kg_template_table(spark, sf_dir)
    firsts = keyed.groupBy("key").agg(F.min("line_id").alias("__first"))
    results = keyed.join(firsts, "key").select(
        F.col("key").alias("cluster_id"), F.when(F.col("line_id") == F.col("__first"), "CREATE").otherwise("NONE").alias("change_type"))
    samples = reservoir_sample(keyed.select("line_id", "line", F.col("key").alias("cluster_id")), 200)
    items = review_new_or_changed(results, t, samples)
    return items.select("cluster_id", "template", "wildcard_ratio",
                        F.array_join("samples", " || ").alias("samples"))


@register("templates_view_events", _kg_sql() + """SELECT key AS cluster_id, arg_max(template, trig) AS pattern,
  CAST(count(*) AS BIGINT) AS versions, 'ACTIVE' AS status FROM v GROUP BY key""")
def templates_view_events(spark, sf_dir):
    """P23 (+ U2 from CREATE lines, W4): ACTIVE templates with their number of versions."""
    from logweave.operators.lifecycle import add_templates, empty_templates, new_templates_from_results
    from logweave.operators.parse import templates_view

    out, res = _ingest_key_groups(spark, sf_dir)
    keys = out.cluster_templates.select("cluster_id", "key")
    t = add_templates(empty_templates(spark), new_templates_from_results(out.results))
    latest = out.cluster_templates.select("cluster_id", F.col("template").alias("__latest"))
    t = t.join(latest, "cluster_id").withColumn("pattern", F.col("__latest")).drop("__latest")
    v = templates_view(t, out.versions)
    return v.join(keys, "cluster_id").select(F.col("key").alias("cluster_id"), "pattern", "versions", "status")


@register("state_roundtrip_templates", _applied_sql() + "SELECT * FROM applied")
def state_roundtrip_templates(spark, sf_dir):
    """S5 then S4: the applied template table written as a snapshot and read back."""
    import tempfile

    from logweave.operators.lifecycle import apply_decisions
    from logweave.session import checkpoint_dir
    from logweave.sources.state import load_state, save_state, state_exists

    _, _, t = _kg_template_table(spark, sf_dir)
    applied = apply_decisions(t, _standin_decisions(t))["templates"]
    root = checkpoint_dir(spark).rstrip("/") + "/state-" + next(tempfile._get_candidate_names())
    assert not state_exists(spark, root)
    assert save_state(spark, root, {"templates": applied})
    back = load_state(spark, root)["templates"]
    return back.select(*_TPL_OUT)


def _parse_sql() -> str:
    from logweave.functions.events import sql_flat_event

    lab = ", ".join(f"{N.sql_label_case('template', field=f)} AS {a}" for f, a in
                    [("class_uid", "l_cls"), ("severity_id", "l_sev"), ("activity_id", "l_act"),
                     ("class_name", "l_cname"), ("activity_name", "l_aname")])
    flat = sql_flat_event("line", "l_cls", "l_sev", "l_act", "l_cname", "l_aname")
    return _applied_sql() + f""",
pl AS (SELECT cluster_id, coalesce(nullif(labeled_template, ''), pattern) AS template FROM applied
       WHERE status = 'ACTIVE' AND decision IS NOT NULL),
ln AS (SELECT kk.line_id, kk.key AS cluster_id, e.line FROM kk JOIN ({EVENT_LINES_SQL}) e ON e.line_id = kk.line_id),
x AS (SELECT ln.line_id, ln.cluster_id, ln.line, pl.template, {lab} FROM ln JOIN pl ON pl.cluster_id = ln.cluster_id),
ev AS (SELECT x.*, {flat} FROM x)
SELECT line_id, cluster_id, template,
  CASE WHEN l_cls IS NOT NULL THEN l_cname ELSE 'Unknown' END AS ocsf_class,
  CASE WHEN l_cls IS NOT NULL THEN l_aname ELSE 'Unknown' END AS activity,
  CASE WHEN l_cls IS NOT NULL THEN severity ELSE 'Informational' END AS severity,
  coalesce(status, '') AS status, coalesce(user_name, '') AS username, coalesce(src_ip, '') AS src_ip,
  coalesce(dst_ip, '') AS dst_ip, coalesce(http_method, '') AS http_method, coalesce(url_path, '') AS http_path,
  coalesce(CAST(http_code AS VARCHAR), '') AS http_status, coalesce(db_name, '') AS db_name,
  coalesce(nullif(regexp_extract(line, '(?i)\\bservice\\s+(\\w+)', 1), ''), app_name, '') AS service
FROM ev"""


@register("parse_events_events", _parse_sql())
def parse_events_events(spark, sf_dir):
    """L14 + P18/P19: parsed records for every line of the reviewed, ACTIVE templates
    (label else pattern), event fields from the rule label of the template."""
    from logweave.operators.lifecycle import apply_decisions
    from logweave.operators.parse import parse_events

    lines, keyed, t = _kg_template_table(spark, sf_dir)
    applied = apply_decisions(t, _standin_decisions(t))["templates"]
    src = keyed.select("line_id", "line", "arrival_ts", F.col("key").alias("cluster_id"))
    p = parse_events(src, applied)
    return p.select("line_id", "cluster_id", "template", "ocsf_class", "activity", "severity", "status", "username",
                    "src_ip", "dst_ip", "http_method", "http_path", "http_status", "db_name", "service")


_DEC_OUT = ["batch_id", "cluster_id", "decision", "merge_into_cluster_id", "labeled_template", "reasoning"]


def _replies(t):
    """Stand-in reviewer replies: the stand-in decisions as JSON text, every other chunk
    wrapped in a code fence; resets are left out of the reply (to be completed)."""
    d = _standin_decisions(t).where(~(F.col("decision") == "reset"))
    body = d.groupBy("batch_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct(
        "cluster_id", "decision", "merge_into_cluster_id", "merged_template", "sub_templates", "reset_template",
        "labeled_template", "reasoning"))).alias("templates"))).alias("response"))
    return body.select("batch_id", F.concat(F.lit("```json\n"), F.col("response"), F.lit("\n```")).alias("response"))


@register("decisions_from_replies", _applied_sql() + """SELECT 'b1' AS batch_id, cluster_id,
  CASE WHEN k = 3 THEN 'keep' ELSE decision END AS decision,
  CASE WHEN k = 3 THEN NULL ELSE merge_into END AS merge_into_cluster_id,
  replace(pattern, '<*>', '<unknown>') AS labeled_template,
  CASE WHEN k = 3 THEN 'not_returned_by_llm' ELSE reasoning END AS reasoning FROM dec""")
def decisions_from_replies(spark, sf_dir):
    """S7 + J10 (+P6-P8): reviewer replies (fenced JSON) parsed into decisions, completed
    for templates the reply left out, labels validated against each template."""
    from logweave.operators.lifecycle import complete_decisions, read_decisions

    _, _, t = _kg_template_table(spark, sf_dir)
    requests = t.select(F.lit("b1").alias("batch_id"), "cluster_id", F.col("pattern").alias("template"))
    got = read_decisions(_replies(t))
    return complete_decisions(requests, got).select(*_DEC_OUT)


@register("decisions_after_responses", _applied_sql() + """SELECT 'b1' AS batch_id, cluster_id,
  'keep' AS decision,
  CASE WHEN k = 1 THEN 'reviewed' ELSE merge_into END AS merge_into_cluster_id,
  CASE WHEN k = 0 THEN replace(pattern, '<*>', '<unknown>') END AS labeled_template,
  CASE k WHEN 0 THEN reasoning WHEN 1 THEN 'user_rejected' WHEN 2 THEN 'edited to keep' ELSE 'web_timeout' END AS reasoning
FROM dec""")
def decisions_after_responses(spark, sf_dir):
    """J12 + L13: merge decisions get a field edit (new target), then the stand-in
    responses: keep accepted, merge rejected, split edited to keep, reset unanswered
    (times out)."""
    from logweave.operators.lifecycle import override_decisions, response_override

    _, _, t = _kg_template_table(spark, sf_dir)
    d = _standin_decisions(t)
    upd = d.where(F.col("decision") == "merge").select("batch_id", "cluster_id",
                                                      F.lit("reviewed").alias("merge_into_cluster_id"))
    d2 = override_decisions(d, upd)
    dec = F.col("decision")
    resp = d.where(dec != "reset").select(
        "batch_id", "cluster_id",
        F.when(dec == "keep", "accept").when(dec == "merge", "reject").otherwise("edit").alias("action"),
        F.when(dec == "split", F.lit("keep")).alias("edited_decision"),
        F.when(dec == "split", F.lit("edited to keep")).alias("edited_reasoning"),
        F.lit(5).alias("responded_after_s"))
    return response_override(d2, resp).select(*_DEC_OUT)


# ---------------------------------------------------------------------------
# Structured Streaming (R1-R3, R6): the event rows read as a file stream, run with an
# availableNow trigger into the checkpoint folder, and read back.
# ---------------------------------------------------------------------------

@register("stream_metrics_events", """SELECT strftime(time_bucket(INTERVAL 60 SECOND, ts), '%Y-%m-%d %H:%M:%S') AS window_start,
  count(*) AS logs_ingested FROM events GROUP BY 1""")
def stream_metrics_events(spark, sf_dir):
    """Lines per 60 s event-time window, streaming with a watermark."""
    from logweave.streaming.ingest import event_line_stream, run_foreach_batch, stream_dir, stream_metrics

    base = stream_dir(spark, "metrics")
    m = stream_metrics(event_line_stream(spark, sf_dir))
    # update mode: every micro-batch emits the windows it changed, so the newest value of a
    # window is final even for the last window, which append mode would hold back until the
    # watermark passes it
    run_foreach_batch(m.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "logs_ingested"),
                      f"{base}/out", f"{base}/ckpt", "update")
    r = spark.read.parquet(f"{base}/out")
    return r.groupBy("window_start").agg(F.max_by("logs_ingested", "batch_id").alias("logs_ingested"))


STREAM_PARTS = 4


def _as_stream(spark, lines, id_col="line_id", parts=STREAM_PARTS):
    """``lines`` as a file stream: equal ranges of the id, written one after the other, one a
    micro-batch."""
    from logweave.streaming.ingest import stream_dir

    base = stream_dir(spark, "lines")
    lines = cut_lineage(lines)
    part = F.floor((F.col(id_col) - F.col("__lo")) * parts / (F.col("__hi") - F.col("__lo") + 1))
    ends = lines.agg(F.min(id_col).alias("__lo"), F.max(id_col).alias("__hi"))
    dealt = cut_lineage(lines.crossJoin(F.broadcast(ends)).withColumn("__part", part.cast("int")).drop("__lo", "__hi"))   # one row of bounds
    for i in range(parts):
        dealt.where(F.col("__part") == i).drop("__part").coalesce(1).write.parquet(f"{base}/part{i}")
    return spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(base)


def _event_stream_lines(spark, sf_dir):
    return event_log_lines(spark, sf_dir).withColumn("arrival_ts", F.col("arrival_ts").cast("timestamp"))


@register("stream_mine_events", _mine_sql(EVENT_LINES_SQL))
def stream_mine_events(spark, sf_dir):
    """R2: the first half of the event lines mined as a batch, the second half by a stateful
    stream (four micro-batches) that starts from the batch's clusters; template and lines of
    every cluster, the templates from the stream's state."""
    from logweave.functions.masks import mask_only
    from logweave.operators.mining import change_points, mine_templates
    from logweave.streaming.ingest import run_to_completion, stream_dir
    from logweave.streaming.stateful import cluster_table, clusters_in_state, mine_stream

    masked = cut_lineage(mask_only(event_log_lines(spark, sf_dir)).select("line_id", "line", "processed"))
    half = masked.agg(F.floor((F.min("line_id") + F.max("line_id")) / 2).alias("h")).first().h
    first = cut_lineage(mine_templates(masked.where(F.col("line_id") <= half)))
    clusters = cut_lineage(cluster_table(first, change_points(first)[1]))
    base = stream_dir(spark, "mine")
    src = _as_stream(spark, masked.where(F.col("line_id") > half))
    run_to_completion(mine_stream(src, clusters=clusters), f"{base}/out", f"{base}/ckpt")
    lines = (first.select("cluster_id", F.col("n").alias("lines")).unionByName(spark.read.parquet(f"{base}/out").select("cluster_id", F.lit(1).cast("long").alias("lines")))
             .groupBy("cluster_id").agg(F.sum("lines").alias("lines")))
    return clusters_in_state(spark, f"{base}/ckpt").select("cluster_id", "key", "template").join(lines, "cluster_id")


@register("stream_ingest_events", _registry_ingest_sql())
def stream_ingest_events(spark, sf_dir):
    """R1 + R8: four micro-batches of event lines against the template snapshot behind the
    state pointer; the rest mined from the clusters of the micro-batches before."""
    from logweave.operators.lifecycle import TEMPLATE_COLS
    from logweave.sources.state import save_state
    from logweave.streaming.ingest import stream_dir, stream_ingest

    _, compiled = _key_templates(spark, sf_dir)
    none = F.lit(None).cast("string")
    approved = compiled.where("registry_seq % 2 = 0").select(
        "cluster_id", F.col("labeled_template").alias("pattern"), F.lit("ACTIVE").alias("status"), none.alias("merge_target_id"), F.lit(0).alias("confirmation_count"),
        F.timestamp_seconds("registry_seq").alias("created_at"), "labeled_template", F.lit("keep").alias("decision"), none.alias("reasoning"))
    base = stream_dir(spark, "ingest")
    save_state(spark, f"{base}/state", {"templates": approved.select(*TEMPLATE_COLS)})
    src = _as_stream(spark, _event_stream_lines(spark, sf_dir))
    stream_ingest(src, f"{base}/out", f"{base}/ckpt", state_root=f"{base}/state", sim_th=0.0, near_threshold=1.1).awaitTermination()
    return _registry_result(spark.read.parquet(f"{base}/out"))


def _counters_sql() -> str:
    lines = {"logs_ingested": "true", "templates_created": "change_type = 'CREATE'", "templates_updated": "change_type = 'UPDATE'",
             "ocsf_matched": "rule_order IS NOT NULL", "ocsf_unmatched": "rule_order IS NULL"}
    per = " UNION ALL ".join(f"SELECT d, '{c}' AS counter, count(*) FILTER (WHERE {w}) AS v FROM x GROUP BY d" for c, w in lines.items())
    names = ", ".join(f"'{c}'" for c in R.COUNTERS)
    return _kg_sql() + f""", x AS (SELECT r.*, date_trunc('day', e.ts) AS d FROM r JOIN events e ON e.event_id = r.line_id),
spine AS (SELECT unnest(range(min(d), max(d) + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS d FROM x),
every AS (SELECT d, unnest([{names}]) AS counter FROM spine),
per AS ({per})
SELECT strftime(every.d, '%Y-%m-%d') AS interval_start, every.counter,
  CAST(sum(coalesce(v, 0)) OVER (PARTITION BY every.counter ORDER BY every.d) AS BIGINT) AS value
FROM every LEFT JOIN per ON per.d = every.d AND per.counter = every.counter"""


@register("stream_counters_events", _counters_sql())
def stream_counters_events(spark, sf_dir):
    """Running values of all counters at the end of every day, from the counters that four
    micro-batches of the streaming ingest left (threshold 0)."""
    from logweave.operators.reports import counter_snapshots
    from logweave.streaming.ingest import stream_dir, stream_ingest

    base = stream_dir(spark, "counters")
    src = _as_stream(spark, _event_stream_lines(spark, sf_dir))
    stream_ingest(src, f"{base}/out", f"{base}/ckpt", sim_th=0.0, interval="1 day").awaitTermination()
    snaps = counter_snapshots(spark.read.parquet(f"{base}/out-counters"), "1 day")
    return snaps.select(F.date_format("interval_start", "yyyy-MM-dd").alias("interval_start"), "counter", "value")


@register("stream_confirm_merges_events", _kg_sql() + f""", keys AS (
  SELECT key, row_number() OVER (ORDER BY min(line_id)) AS rk FROM r0 GROUP BY key),
span AS (SELECT min(line_id) AS lo, max(line_id) AS hi FROM r0),
h AS (SELECT r0.key, r0.line_id, keys.rk, row_number() OVER (PARTITION BY r0.key ORDER BY floor((r0.line_id - lo) * {STREAM_PARTS} / (hi - lo + 1)), e.ts, r0.line_id) AS rn
  FROM r0 JOIN keys ON keys.key = r0.key JOIN events e ON e.event_id = r0.line_id, span
  WHERE change_type = 'NONE' AND e.ts > TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(keys.rk AS INTEGER)))
SELECT 'dup_' || key AS cluster_id, key AS merge_target_id, CAST(40 AS INTEGER) AS confirmations, line_id AS confirmed_by FROM h WHERE rn = 40 - rk % 5""")
def stream_confirm_merges_events(spark, sf_dir):
    """A merge pending into every mining key, staged a day after the one before; deletions
    over four micro-batches of mined lines, with the line that confirmed each."""
    from logweave.streaming.ingest import run_to_completion, stream_dir
    from logweave.streaming.stateful import confirm_stream

    _, res = _ingest_key_groups(spark, sf_dir)
    res = cut_lineage(res.select("line_id", F.col("arrival_ts").cast("timestamp").alias("arrival_ts"), F.col("key").alias("cluster_id"), "change_type", "fast_path", "near_match"))
    rank = F.row_number().over(Window.orderBy("first"))    # one row per mining key
    pending = res.groupBy("cluster_id").agg(F.min("line_id").alias("first")).withColumn("rk", rank).select(
        F.concat(F.lit("dup_"), "cluster_id").alias("cluster_id"), F.col("cluster_id").alias("merge_target_id"), (F.col("rk") % 5).alias("confirmation_count"),
        F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(rk)").alias("staged_at"))
    base = stream_dir(spark, "confirm")
    run_to_completion(confirm_stream(_as_stream(spark, res), cut_lineage(pending), 40), f"{base}/out", f"{base}/ckpt")
    return spark.read.parquet(f"{base}/out")


@register("stream_reservoir_events", """WITH m AS ({masked}),
k AS (SELECT line_id, line, regexp_split_to_array(regexp_replace(processed, '^\\s+|\\s+$', '', 'g'), '\\s+') AS toks FROM m),
kk AS (SELECT line_id, line, CAST(len(toks) AS VARCHAR) || '|' || CASE WHEN regexp_matches(toks[1], '\\d') THEN '<*>' ELSE toks[1] END AS key FROM k),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY md5('logweave:' || CAST(line_id AS VARCHAR)), line_id) AS rn,
        count(*) OVER (PARTITION BY key) AS n FROM kk)
SELECT key AS cluster_id, line_id, line, n FROM r WHERE rn <= 200""".format(
    masked=M.sql_mask_chain(EVENT_LINES_SQL, "line_id, line", with_extractions=False)))
def stream_reservoir_events(spark, sf_dir):
    """Keyed-state reservoir per mining key, fed by the line stream; the last
    micro-batch's sample per key (equal to the batch sampler's)."""
    from logweave.functions.masks import mask_only
    from logweave.functions.tokens import tokens
    from logweave.operators.mining import mining_key
    from logweave.streaming.ingest import event_line_stream, run_foreach_batch, stream_dir, stream_reservoir

    base = stream_dir(spark, "reservoir")
    keyed = mask_only(event_line_stream(spark, sf_dir)).select(
        "line_id", "line", mining_key(tokens(F.col("processed"))).alias("cluster_id"))
    run_foreach_batch(stream_reservoir(keyed, 200), f"{base}/out", f"{base}/ckpt")
    r = spark.read.parquet(f"{base}/out")
    last = r.groupBy("cluster_id").agg(F.max("batch_id").alias("batch_id"))
    return r.join(last, ["cluster_id", "batch_id"]).select("cluster_id", "line_id", "line", "n")


# ---------------------------------------------------------------------------
# Review side without an SQL form (difflib scores, hash-bucketed request groups, mining)
# ---------------------------------------------------------------------------

@register("candidate_templates_events")
def candidate_templates_events(spark, sf_dir):
    """J3 + F2 + T2: for each mined template (threshold 0.4), the up-to-5 key-group
    templates with a character similarity ratio above 0.5."""
    from logweave.operators.review import candidate_templates
    from logweave.plans.ingest import ingest

    _, _, t = _kg_template_table(spark, sf_dir)
    mined = ingest(event_log_lines(spark, sf_dir), with_extractions=False).cluster_templates
    new = mined.select("cluster_id", F.col("template").alias("pattern"))
    return candidate_templates(new, t)


@register("review_requests_events")
def review_requests_events(spark, sf_dir):
    """P24 + W8 + J7, P26, J8 + P28: review request texts (groups of 3 templates), the
    over-general ones, and classification requests for reviewed templates with no cached
    classification."""
    from logweave.operators.lifecycle import apply_decisions
    from logweave.operators.review import (classify_requests, degraded_review_requests, label_review_requests,
                                           review_all_active, unclassified_templates)
    from logweave.operators.sampling import reservoir_sample

    _, keyed, t = _kg_template_table(spark, sf_dir)
    samples = reservoir_sample(keyed.select("line_id", "line", F.col("key").alias("cluster_id")), 200)
    items = review_all_active(t, samples)
    prior = _standin_decisions(t).select("cluster_id", "decision", F.col("labeled_template").alias("template"), "reasoning")
    a = label_review_requests(items, prior).select(F.lit("label").alias("kind"), F.col("batch_id").alias("id"), "request")
    b = degraded_review_requests(items).select(F.lit("degraded").alias("kind"), F.col("cluster_id").alias("id"), "request")
    applied = apply_decisions(t, _standin_decisions(t))["templates"]
    cls = spark.createDataFrame([], "template string, classification string")
    c = classify_requests(unclassified_templates(applied, cls), samples).select(
        F.lit("classify").alias("kind"), F.col("cluster_id").alias("id"), "request")
    return a.unionByName(b).unionByName(c)


@register("near_match_queue_events")
def near_match_queue_events(spark, sf_dir):
    """U1 -> L9 -> J9 -> P27 -> J11 -> L10: near matches (threshold 0.5) queued, given
    context (template and samples) and request texts, completed with the default decision and
    resolved; the lines sent back are mined from the known templates (threshold 0.4), their new
    templates registered and the lines sampled. Lines per dispatch kind; per candidate template,
    the items, the lines sent back to mining and what became of them."""
    from logweave.operators.lifecycle import (add_templates, complete_near_match_decisions, near_match_enqueue,
                                              near_match_resolve, new_templates_from_results)
    from logweave.operators.matching import fast_path
    from logweave.operators.review import near_match_context, near_match_review_requests
    from logweave.operators.sampling import reservoir_sample
    from logweave.plans.ingest import ingest

    lines, compiled = _key_templates(spark, sf_dir)
    _, keyed, t = _kg_template_table(spark, sf_dir)
    # matched once: the queue, its requests, the resolution and the counts read the result
    r = cut_lineage(fast_path(lines, compiled, threshold=0.5).select("line_id", "line", "arrival_ts", "cluster_id", "similarity", "match_kind"))
    res = r.select("line_id", "line", "arrival_ts", "cluster_id", "similarity",
                   (F.col("match_kind") == "NEAR").alias("near_match"))
    items = near_match_enqueue(res)
    samples = reservoir_sample(keyed.select("line_id", "line", F.col("key").alias("cluster_id")), 200)
    ctx = near_match_context(items, t, samples)
    req = near_match_review_requests(ctx).dropDuplicates(["item_id"])
    empty = spark.createDataFrame([], "item_id string, decision string, corrected_template string, reasoning string")
    out = near_match_resolve(items, complete_near_match_decisions(items, empty), t)
    # as the reference: a line sent back meets no registry, is mined, registered and sampled
    again = ingest(out["remine_lines"], seeds=t.select("cluster_id", F.col("pattern").alias("template")), with_extractions=False, mask_once=True).results
    again = cut_lineage(again.select("line_id", "arrival_ts", "line", "candidate_cluster_id", "cluster_id", "template", "change_type"))
    known = add_templates(out["templates"], new_templates_from_results(again)).where(F.col("status") == "ACTIVE")
    candidate = F.col("candidate_cluster_id")
    exact = r.where(F.col("match_kind") == "EXACT").select("line_id", "line", "cluster_id")
    sampled = reservoir_sample(exact.withColumn("candidate_cluster_id", F.lit(None).cast("string")).unionByName(again.select("line_id", "line", "cluster_id", candidate)), 200)
    sampled = sampled.where(candidate.isNotNull()).groupBy(candidate).agg(F.count(F.lit(1)).alias("sampled"))
    change = F.col("change_type")
    mined = again.join(known.select("cluster_id", F.lit(True).alias("known")), "cluster_id", "left").groupBy(candidate).agg(
        F.count_if(change == "CREATE").alias("created"), F.count_if(change == "UPDATE").alias("updated"),
        F.count_if(change == "NONE").alias("unchanged"), F.count_distinct(F.when(F.col("known"), F.col("cluster_id"))).alias("templates"))
    queued = out["items"].join(req, "item_id", "left").groupBy(candidate).agg(
        F.count(F.lit(1)).alias("items"), F.count_if(F.col("status") == "rejected").alias("sent_to_mining"), F.count(F.col("request")).alias("requests"))
    near = queued.join(mined, "candidate_cluster_id", "left").join(sampled, "candidate_cluster_id", "left").fillna(0, ["created", "updated", "unchanged", "templates", "sampled"])
    # the candidates' counters are attached to the rows of the NEAR lines
    kinds = r.groupBy("match_kind", F.when(F.col("match_kind") == "NEAR", F.col("cluster_id")).alias("candidate_cluster_id")).agg(F.count(F.lit(1)).alias("lines"))
    return kinds.join(near.withColumn("match_kind", F.lit("NEAR")), ["match_kind", "candidate_cluster_id"], "left")


@register("approve_and_remine_events")
def approve_and_remine_events(spark, sf_dir):
    """E2 + L11 + L12 + A12: ingest (threshold 0.4), review every new template with the
    default reviewer, approve, then re-mine all samples of the ACTIVE templates with the
    approved templates as seeds; re-mine counts per change type."""
    from logweave.operators.lifecycle import add_templates, empty_templates, new_templates_from_results
    from logweave.operators.reports import remine_stats
    from logweave.operators.sampling import reservoir_sample
    from logweave.plans.ingest import ingest
    from logweave.plans.review_cycle import approve, review_batch

    lines = event_log_lines(spark, sf_dir)
    out = ingest(lines, with_extractions=False, mask_once=True)
    # each stage's output is a table of its own (results, samples, templates): writing them
    # to the checkpoint folder keeps later plans small and survives executor loss
    res = cut_lineage(out.results)
    t = cut_lineage(add_templates(empty_templates(spark), new_templates_from_results(res)))
    samples = cut_lineage(reservoir_sample(res.select("line_id", "line", "cluster_id"), 200))
    requests, _ = review_batch(res, t, samples)
    appr = approve(res, t, requests, samples=samples)
    active = cut_lineage(appr["templates"]).where(F.col("status") == "ACTIVE")
    again = samples.join(active.select("cluster_id"), "cluster_id", "left_semi").select("line_id", "line")
    seeds = active.select("cluster_id", F.col("pattern").alias("template"))
    re_out = ingest(again, seeds=seeds, with_extractions=False)
    return remine_stats(re_out.results)


@register("near_match_document_lines")
def near_match_document_lines(spark, sf_dir):
    """U1 dispatch of every raw document line against the position-wise templates of all its
    mining keys: per match kind the line count and mean similarity."""
    from logweave.operators.matching import fast_path

    lines, compiled = _doc_templates(spark, sf_dir)
    r = fast_path(lines, compiled)
    return r.groupBy("match_kind").agg(F.count(F.lit(1)).alias("lines"), F.avg("similarity").alias("mean_similarity"))


def _doc_templates(spark, sf_dir):
    """Position-wise templates of all document mining keys, registry order = first line of the
    key (derived by Spark from the table)."""
    from logweave.functions.tokens import tokens
    from logweave.operators.compile import compile_templates
    from logweave.operators.mining import mining_key, template_of_cluster

    lines = document_lines(spark, sf_dir)
    # masked once: the templates and their first lines read the written texts
    keyed = cut_lineage(M.mask_only(lines).select("line_id", "processed", mining_key(tokens(F.col("processed"))).alias("key")))
    tpl = template_of_cluster(keyed, "key", "processed", least="line_id", written=True)
    # the texts are written; what is compiled from them is larger and made where it is read
    return lines, compile_templates(tpl.withColumnRenamed("line_id", "registry_seq"), "template")


_LOOSE_SQL = """WITH m AS ({masked}),
k AS (SELECT line_id, processed, regexp_split_to_array(regexp_replace(processed, '^\\s+|\\s+$', '', 'g'), '\\s+') AS toks FROM m),
kk AS (SELECT *, CAST(len(toks) AS VARCHAR) || '|' || CASE WHEN regexp_matches(toks[1], '\\d') THEN '<*>' ELSE toks[1] END AS key FROM k),
mk AS (SELECT key, min(line_id) AS seq FROM kk GROUP BY key),
p AS (SELECT kk.key, unnest(toks) AS tok, unnest(range(1, len(toks) + 1)) AS pos FROM kk JOIN mk ON mk.key = kk.key),
f AS (SELECT key, pos, CASE WHEN min(tok) = max(tok) THEN min(tok) ELSE '<*>' END AS tok FROM p GROUP BY key, pos),
tl AS (SELECT f.key, list(f.tok ORDER BY f.pos) FILTER (WHERE NOT regexp_matches(f.tok, '^<[^>]*>$')) AS lits FROM f GROUP BY f.key),
tp AS (SELECT tl.key, tl.lits, list_sort(tl.lits, 'DESC')[1] AS one, tl.lits[-1] AS last, len(tl.lits) AS lc, mk.seq FROM tl JOIN mk ON mk.key = tl.key WHERE len(tl.lits) > 0),
ln AS ({src}),
pr AS (SELECT ln.line_id, tp.key, tp.lc, tp.seq FROM ln, tp
       WHERE contains(ln.line, tp.last) AND contains(ln.line, tp.one) AND list_reduce(tp.lits, lambda acc, x: CASE WHEN acc > 0 AND instr(substr(ln.line, acc), x) > 0
                          THEN acc + instr(substr(ln.line, acc), x) - 1 + length(x) ELSE 0 END, 1) > 0)
SELECT ln.line_id, CAST(count(pr.key) AS INTEGER) AS n_loose, arg_min(pr.key, [-pr.lc, pr.seq]) AS first_loose
FROM ln LEFT JOIN pr ON pr.line_id = ln.line_id GROUP BY ln.line_id"""


@register("loose_match_document_lines", _LOOSE_SQL.format(
    masked=M.sql_mask_chain(DOCUMENT_LINES_SQL, "line_id", with_extractions=False), src=DOCUMENT_LINES_SQL))
def loose_match_document_lines(spark, sf_dir):
    """For every raw document line, the number of templates whose literals occur
    in it in order (as substrings) and the most specific of them."""
    from logweave.operators.matching import loose_candidates

    lines, compiled = _doc_templates(spark, sf_dir)
    return loose_candidates(lines, compiled, ids=False).select("line_id", "n_loose", "first_loose")


@register("classify_requests_events", _applied_sql() + """,
smp AS (SELECT key, line, line_id, row_number() OVER (PARTITION BY key ORDER BY md5('logweave:' || CAST(line_id AS VARCHAR)), line_id) AS rn
        FROM (SELECT kk.key, e.line, kk.line_id FROM kk JOIN ({EVENT_LINES_SQL}) e ON e.line_id = kk.line_id)),
s3 AS (SELECT key, line, row_number() OVER (PARTITION BY key ORDER BY line_id) AS slot FROM smp WHERE rn <= 200),
blk AS (SELECT key, string_agg('    sample: ' || substr(line, 1, 120), chr(10) ORDER BY slot) AS block FROM s3 WHERE slot <= 3 GROUP BY key),
un AS (SELECT cluster_id, coalesce(nullif(labeled_template, ''), pattern) AS template FROM applied
       WHERE status = 'ACTIVE' AND decision IS NOT NULL)
SELECT un.cluster_id, un.template,
  concat_ws(chr(10), 'Classify this log template into an OCSF class; give fields and a regex.',
            'template: ' || un.template, coalesce(blk.block, '')) AS request
FROM un LEFT JOIN blk ON blk.key = un.cluster_id""".replace("{EVENT_LINES_SQL}", EVENT_LINES_SQL))
def classify_requests_events(spark, sf_dir):
    """J8 + P28 (+W5/W6): classification requests for every reviewed ACTIVE template with no
    cached classification: the template (label else pattern) and its first three reservoir
    samples cut to 120 characters."""
    from logweave.operators.lifecycle import apply_decisions
    from logweave.operators.review import classify_requests, unclassified_templates
    from logweave.operators.sampling import reservoir_sample

    _, keyed, t = _kg_template_table(spark, sf_dir)
    applied = apply_decisions(t, _standin_decisions(t))["templates"]
    samples = reservoir_sample(keyed.select("line_id", "line", F.col("key").alias("cluster_id")), 200)
    cls = spark.createDataFrame([], "template string, classification string")
    return classify_requests(unclassified_templates(applied, cls), samples).select("cluster_id", "template", "request")


@register("status_counts_after_rollback", _applied_sql() + """,
rb AS (SELECT cluster_id, CASE WHEN status = 'PENDING_MERGE' THEN 'ACTIVE' ELSE status END AS status, decision FROM applied),
remaining AS (SELECT * FROM rb WHERE decision IS NULL OR decision <> 'reset'),
st AS (SELECT * FROM (VALUES ('ACTIVE'), ('PENDING_MERGE'), ('MERGED'), ('NEAR_MATCH_REVIEW')) v(status))
SELECT st.status, CAST(count(remaining.cluster_id) AS BIGINT) AS templates FROM st
LEFT JOIN remaining ON remaining.status = st.status GROUP BY st.status""")
def status_counts_after_rollback(spark, sf_dir):
    """L6 + L7 + A8: every pending merge rolled back, the reset templates deleted, then
    templates per status with zeros included."""
    from logweave.operators.lifecycle import apply_decisions, delete_templates, rollback_merge
    from logweave.operators.reports import status_counts

    _, _, t = _kg_template_table(spark, sf_dir)
    applied = apply_decisions(t, _standin_decisions(t))["templates"]
    rolled = rollback_merge(applied, applied.where(F.col("status") == "PENDING_MERGE").select("cluster_id"))
    kept = delete_templates(rolled, rolled.where(F.col("decision") == "reset").select("cluster_id"))
    return status_counts(kept)


def _parsed(spark, sf_dir):
    from logweave.operators.lifecycle import apply_decisions
    from logweave.operators.parse import parse_events

    _, keyed, t = _kg_template_table(spark, sf_dir)
    applied = apply_decisions(t, _standin_decisions(t))["templates"]
    src = keyed.select("line_id", "line", "arrival_ts", F.col("key").alias("cluster_id"))
    return parse_events(src, applied)


@register("parsed_page_events", "SELECT line_id, cluster_id, ocsf_class, username FROM (SELECT * FROM (" + _parse_sql()
          + ") ORDER BY line_id DESC LIMIT 100 OFFSET 200)")
def parsed_page_events(spark, sf_dir):
    """T4: the third newest-first page of 100 parsed records (ascending inside the page)."""
    from logweave.operators.reports import page

    return page(_parsed(spark, sf_dir), n=100, offset=200).select("line_id", "cluster_id", "ocsf_class", "username")


@register("events_tail_view", """SELECT line_id, ocsf_class AS class_name, activity AS activity_name, severity, status,
  CASE WHEN username <> '' THEN username END AS user_name, CASE WHEN src_ip <> '' THEN src_ip END AS src_ip,
  CASE WHEN http_method <> '' THEN http_method END AS http_method,
  CASE WHEN http_method <> '' THEN http_path END AS http_path,
  CASE WHEN http_status <> '' THEN http_status END AS http_code
FROM (SELECT * FROM (""" + _parse_sql() + ") ORDER BY line_id DESC LIMIT 30)")
def events_tail_view(spark, sf_dir):
    """T5 + P22: the last 30 parsed records as panel events (nested parts only when their
    key field is set), flattened."""
    from logweave.operators.parse import events_view
    from logweave.operators.reports import tail

    v = events_view(tail(_parsed(spark, sf_dir), 30))
    return v.select("line_id", "class_name", "activity_name", "severity", "status",
                    F.col("user.name").alias("user_name"), F.col("src_endpoint.ip").alias("src_ip"),
                    F.col("http_request.http_method").alias("http_method"),
                    F.col("http_request.url.path").alias("http_path"), F.col("http_response.code").alias("http_code"))


@register("list_clusters_events", _kg_sql() + """SELECT key AS cluster_id, arg_max(template, trig) AS template,
  CAST(len(string_split(arg_max(template, trig), ' ')) AS INTEGER) AS token_count FROM v GROUP BY key""")
def list_clusters_events(spark, sf_dir):
    """A3: cluster, latest template and its token count (mining at threshold 0)."""
    from logweave.operators.mining import list_clusters

    out, _ = _ingest_key_groups(spark, sf_dir)
    return list_clusters(out.cluster_templates.select(F.col("key").alias("cluster_id"), "template"))


@register("batch_summary_events", _applied_sql() + """SELECT 'b1' AS batch_id, CAST(count(*) AS BIGINT) AS count,
  string_agg(cluster_id || ':' || decision, ',' ORDER BY cluster_id || ':' || decision) AS decisions, false AS approved FROM dec""")
def batch_summary_events(spark, sf_dir):
    """Per review batch the decision count, the decisions and the approved flag."""
    from logweave.operators.reports import batch_summary

    _, _, t = _kg_template_table(spark, sf_dir)
    return batch_summary(_standin_decisions(t)).select("batch_id", "count", "decisions", "approved")


@register("split_samples_events", _applied_sql() + """,
smp AS (SELECT key, line_id, row_number() OVER (PARTITION BY key ORDER BY md5('logweave:' || CAST(line_id AS VARCHAR)), line_id) AS rn FROM kk),
s3 AS (SELECT key, line_id, row_number() OVER (PARTITION BY key ORDER BY line_id) AS slot FROM smp WHERE rn <= 200)
SELECT 'split_' || s3.key || '_' || CAST((s3.slot - 1) % 2 AS VARCHAR) AS cluster_id, CAST(count(*) AS BIGINT) AS samples,
  min(s3.line_id) AS first_line_id
FROM s3 JOIN dec ON dec.cluster_id = s3.key WHERE dec.k = 2 GROUP BY 1""")
def split_samples_events(spark, sf_dir):
    """L4 + W7: the samples of a split template dealt round-robin to its sub-templates."""
    from logweave.operators.lifecycle import apply_decisions
    from logweave.operators.sampling import reservoir_sample, split_round_robin

    _, keyed, t = _kg_template_table(spark, sf_dir)
    kids = apply_decisions(t, _standin_decisions(t))["split_children"]
    n_subs = kids.groupBy("original_id").agg(F.count(F.lit(1)).alias("__n"))
    samples = reservoir_sample(keyed.select("line_id", "line", F.col("key").alias("cluster_id")), 200)
    s = samples.join(n_subs, samples.cluster_id == n_subs.original_id)
    dealt = split_round_robin(s, F.col("__n"))
    j = dealt.join(kids.select("original_id", "sub_index", F.col("cluster_id").alias("child_id")),
                   ["original_id", "sub_index"])
    return j.groupBy(F.col("child_id").alias("cluster_id")).agg(F.count(F.lit(1)).alias("samples"),
                                                               F.min("line_id").alias("first_line_id"))
