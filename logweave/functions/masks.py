"""Value masking: replace variable values in a log line by typed placeholders.

Masks run in order and each one sees the text left by the previous one, so the order
below is part of the semantics (e.g. the path mask runs before the URL mask, which turns
``http://h/a/b`` into ``http:/<PATH>``). Patterns are Java regex (Spark); they use only
ASCII classes, so Spark, DuckDB (RE2) and Python ``re`` agree on ASCII input.

Two forms:
* :func:`mask_only` — one projection of 21 chained ``regexp_replace`` (cheap form).
* :func:`mask_lines` — also returns ``extractions``: for each key, the values each mask
  removed, taken from the text the mask saw, concatenated in mask order.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Mask:
    name: str
    pattern: str          # Java regex used by Spark
    placeholder: str      # replacement text
    key: str              # extraction key
    group: int = 0        # group holding the extracted value (0 = whole match)
    sql_pattern: str | None = None      # RE2 form when Java's needs lookahead
    sql_replacement: str | None = None  # RE2 replacement paired with sql_pattern
    needs: tuple[str, ...] = ()  # texts that every match contains
    hint: str | None = None      # regex found in every match, cheap to search


# ---------------------------------------------------------------------------
# FIXED VALUES — the mask list must equal the reference's masks (patterns,
# placeholders, keys, capture groups) and keep their order.
# ---------------------------------------------------------------------------
MASKS: tuple[Mask, ...] = (
    Mask("M1", r"\b(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}\s+\d{4}",
         "<TIMESTAMP>", "TIMESTAMP", needs=(":",), hint=r":\d\d:"),
    Mask("M2", r"\[\w{3}\s+\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}\s+\d{4}\]",
         "[<TIMESTAMP>]", "TIMESTAMP", needs=("[", ":"), hint=r":\d\d:"),
    Mask("M3", r"\b\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})?\b",
         "<DATETIME>", "TIMESTAMP", needs=("-", ":"), hint=r":\d\d:"),
    Mask("M4", r"\b\d{4}\.\d{2}\.\d{2}\s+\d{2}:\d{2}:\d{2}(?:\.\d+)?\b",
         "<DATETIME>", "TIMESTAMP", needs=(".", ":"), hint=r":\d\d:"),
    Mask("M5", r"\b\d{2}:\d{2}:\d{2}(?:\.\d+)?\b",
         "<TIME>", "TIMESTAMP", needs=(":",), hint=r":\d\d:"),
    Mask("M6", r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b",
         "<IPV6>", "IP", needs=(":",), hint=r":[0-9a-fA-F]{1,4}:"),
    Mask("M7", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",
         "<IP>", "IP", needs=(".",), hint=r"\.\d{1,3}\."),
    Mask("M8", r"\b(?:[0-9a-fA-F]{2}[:\-]){5}[0-9a-fA-F]{2}\b",
         "<MAC>", "MAC", hint=r"[:\-][0-9a-fA-F]{2}[:\-]"),
    Mask("M9", r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b",
         "<UUID>", "ID", needs=("-",), hint=r"-[0-9a-fA-F]{4}-"),
    Mask("M10", r"\b[0-9a-fA-F]{16,}\b",
         "<HEX>", "ID", hint=r"[0-9a-fA-F]{16}"),
    Mask("M11", r"\bport[= ](\d{1,5})\b",
         "port <PORT>", "PORT", needs=("port",)),
    Mask("M12", r"\bfor\s+([a-zA-Z][a-zA-Z0-9_.\-]{1,32})\s+(?=from|at|on|\()",
         "for <USERNAME> ", "USERNAME", 1,
         sql_pattern=r"\bfor\s+([a-zA-Z][a-zA-Z0-9_.\-]{1,32})\s+(from|at|on|\()",
         sql_replacement=r"for <USERNAME> \2", needs=("for",), hint=r"for\s"),
    Mask("M13", r"\buser[= ]([a-zA-Z][a-zA-Z0-9_.\-]{1,32})\b",
         "user <USERNAME>", "USERNAME", 1, needs=("user",), hint=r"user[= ]"),
    Mask("M14", r"\bpassword=\S+",
         "password <PASSWORD>", "PASSWORD", needs=("password=",)),
    Mask("M15", r"\bpid[= ](\d+)\b",
         "pid <PID>", "PID", needs=("pid",), hint=r"pid[= ]"),
    Mask("M16", r"\b0x[0-9a-fA-F]{4,}\b",
         "<ADDR>", "ADDR", needs=("0x",)),
    Mask("M17", r"(?:/[\w.\-]+){2,}",
         "<PATH>", "PATH", needs=("/",)),
    Mask("M18", r"https?://\S+",
         "<URL>", "URL", needs=("http", "://")),
    Mask("M19", r"\b[\w.+-]+@[\w-]+\.[a-zA-Z]{2,}\b",
         "<EMAIL>", "EMAIL", needs=("@",)),
    Mask("M20", r"\b\d{7,}\b",
         "<NUM>", "NUM", hint=r"\d{7}"),
    Mask("M21", r"\b\d+(?:\.\d+)?(?:ms|us|ns|s|KB|MB|GB|TB|B)\b",
         "<SIZE>", "SIZE", hint=r"\d(?:ms|us|ns|s|[KMGT]?B)"),
)

# Extraction keys in the order they first occur in MASKS.
EXTRACTION_KEYS: tuple[str, ...] = tuple(dict.fromkeys(m.key for m in MASKS))

MASKS_BY_NAME = {m.name: m for m in MASKS}


def _java_replacement(text: str) -> str:
    # Java's Matcher treats '$' and '\' specially in replacements.
    return text.replace("\\", "\\\\").replace("$", "\\$")


def _may_match(text: Column, mask: Mask) -> Column | None:
    """False only where the mask finds nothing: plain searches instead of the regex, which
    most lines then never run."""
    tests = [text.contains(x) for x in mask.needs] + ([text.rlike(mask.hint)] if mask.hint else [])
    return functools.reduce(lambda a, b: a & b, tests) if tests else None


def _once(text: Column, fn) -> Column:
    """``fn`` of a text that the expression names once, however often ``fn`` uses it: the
    chain of masks stays one expression that grows with the number of masks."""
    return F.get(F.transform(F.array(text), fn), 0)


def apply_mask(text: Column, mask: Mask) -> Column:
    def put(x: Column) -> Column:
        return F.regexp_replace(x, F.lit(mask.pattern), F.lit(_java_replacement(mask.placeholder)))

    if not (mask.needs or mask.hint):
        return put(text)
    return _once(text, lambda x: F.when(_may_match(x, mask), put(x)).otherwise(x))


def extract_mask(text: Column, mask: Mask) -> Column:
    """All values the mask removes from ``text`` (group ``mask.group`` of each match)."""
    def take(x: Column) -> Column:
        return F.regexp_extract_all(x, F.lit(mask.pattern), F.lit(mask.group))

    if not (mask.needs or mask.hint):
        return take(text)
    return _once(text, lambda x: F.when(_may_match(x, mask) | x.isNull(), take(x)).otherwise(F.array().cast("array<string>")))


def mask_column(line: Column, masks=MASKS) -> Column:
    """Masked text as one nested expression (no extraction)."""
    out = line
    for m in masks:
        out = apply_mask(out, m)
    return out


def mask_only(df: DataFrame, line_col: str = "line", out_col: str = "processed", masks=MASKS,
              only_when: Column | None = None) -> DataFrame:
    """Cheap form: adds ``processed`` only. Null input gives null. Rows where ``only_when``
    is false are not masked (NULL), e.g. lines already matched by the fast path."""
    m = mask_column(F.col(line_col), masks)
    return df.withColumn(out_col, m if only_when is None else F.when(only_when, m))


def mask_lines(df: DataFrame, line_col: str = "line", masks=MASKS,
               processed_col: str = "processed", extractions_col: str = "extractions",
               only_when: Column | None = None) -> DataFrame:
    """Adds ``processed`` and ``extractions MAP<STRING, ARRAY<STRING>>``.

    Stage i extracts from the text of stage i-1, then replaces. Keys with no values are
    dropped; a null line gives a null ``processed`` and an empty map. Rows where
    ``only_when`` is false skip every mask (NULL results).
    """
    stage_cols = []
    cur = F.col(line_col) if only_when is None else F.when(only_when, F.col(line_col))
    tmp_names = []
    out = df
    per_key: dict[str, list[Column]] = {k: [] for k in EXTRACTION_KEYS}
    for i, m in enumerate(masks):
        xname = f"__x{i}"
        tname = f"__t{i}"
        out = out.withColumn(xname, extract_mask(cur, m)).withColumn(tname, apply_mask(cur, m))
        per_key[m.key].append(F.col(xname))
        tmp_names += [xname, tname]
        cur = F.col(tname)
        stage_cols.append(tname)
    keys = [k for k in EXTRACTION_KEYS if per_key[k]]
    values = [F.concat(*per_key[k]) if len(per_key[k]) > 1 else per_key[k][0] for k in keys]
    full = F.map_from_arrays(F.array(*[F.lit(k) for k in keys]), F.array(*values))
    emptymap = F.create_map().cast("map<string,array<string>>")
    extractions = F.when(F.col(line_col).isNull(), emptymap).otherwise(
        F.map_filter(full, lambda k, v: F.size(v) > 0))
    if only_when is not None:
        extractions = F.when(only_when, extractions)
    return (out.withColumn(processed_col, cur)
            .withColumn(extractions_col, extractions)
            .drop(*tmp_names))


def render_extractions(col: Column) -> Column:
    """Flat text form ``KEY=v1,v2;KEY2=...`` in fixed key order (for reports and checks)."""
    parts = [F.when(F.size(F.coalesce(col[k], F.array().cast("array<string>"))) > 0,
                    F.concat(F.lit(k + "="), F.array_join(col[k], ",")))
             for k in EXTRACTION_KEYS]
    return F.concat_ws(";", *parts)


# ---------------------------------------------------------------------------
# Same masks as DuckDB SQL (used by the oracle queries and the tests)
# ---------------------------------------------------------------------------

def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_mask_chain(source_sql: str, id_cols: str, line_col: str = "line", masks=MASKS,
                   with_extractions: bool = True) -> str:
    """A DuckDB query over ``source_sql`` adding ``processed`` (+ extraction lists x_<KEY>)."""
    ctes = [f"s0 AS (SELECT {id_cols}, {line_col} AS t0 FROM ({source_sql}))"]
    xs: dict[str, list[str]] = {k: [] for k in EXTRACTION_KEYS}
    for i, m in enumerate(masks, start=1):
        pat = m.sql_pattern or m.pattern
        rep = m.sql_replacement or m.placeholder
        prev = f"t{i - 1}"
        sel = ["*", f"regexp_replace({prev}, {_sql_str(pat)}, {_sql_str(rep)}, 'g') AS t{i}"]
        if with_extractions:
            sel.append(f"regexp_extract_all({prev}, {_sql_str(pat)}, {m.group}) AS x{i}")
            xs[m.key].append(f"x{i}")
        ctes.append(f"s{i} AS (SELECT {', '.join(sel)} FROM s{i - 1})")
    n = len(masks)
    cols = [id_cols, f"t{n} AS processed"]
    if with_extractions:
        for k, lst in xs.items():
            if lst:
                expr = lst[0] if len(lst) == 1 else "list_concat(" + ", ".join(lst) + ")"
                cols.append(f"{expr} AS x_{k}")
    return "WITH " + ",\n".join(ctes) + f"\nSELECT {', '.join(cols)} FROM s{n}"


def sql_render_extractions(prefix: str = "x_") -> str:
    parts = [f"CASE WHEN len({prefix}{k}) > 0 THEN '{k}=' || array_to_string({prefix}{k}, ',') END"
             for k in EXTRACTION_KEYS]
    return "concat_ws(';', " + ", ".join(parts) + ")"
