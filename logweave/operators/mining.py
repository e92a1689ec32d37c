"""Template mining (A1 mine_templates, A2 template_of_cluster, A3 list_clusters,
W3 change_type, W4 version_history).

Algorithm (from the Drain paper: He et al., ICWS 2017, fixed-depth tree): lines are
grouped by token count and first token (``<*>`` when it contains a digit); inside a group
each line, in arrival order, joins the cluster whose template has the highest share of
equal positions (template wildcards never count as equal; ties go to more wildcards, then
the older cluster) when that share is >= ``sim_th``, else it starts a new cluster. Joining
a cluster turns every differing position of its template into ``<*>``.

Spark plan
----------
1. ``groupBy(text)`` -> distinct masked lines with their first ``line_id`` and line count
   (partial aggregation: a line repeated in a third of the input is combined map-side);
   written once to the checkpoint folder.
2. A key with a single distinct line (and no seed) is its own cluster and never reaches
   Python. Keys of up to ``group_lines`` distinct lines are hash-bucketed and folded, many
   keys to a call.
3. A larger key is folded to a fixed point over its *changes*, and the result is the
   sequential fold's, line for line. Only a line that creates a cluster or turns a position
   into a wildcard can influence a later one. So a round folds the changes known so far, in
   order, into a history of template versions; then every chunk of the key's lines is
   compared, in parallel, with the versions as of each line's arrival. Lines that would
   change something although the fold did not see them are added (the earliest ``step`` of a
   key) and those that changed nothing are left out of the next fold. When no such line
   exists, all decisions agree with the history they rest on, which makes them those of the
   sequential fold: by induction, no line can be the first to differ. Everything before a
   key's earliest addition is final and not compared again. One call holds a chunk of lines,
   or a key's changes, never a key's lines.
4. Change types and versions come from the cluster assignment with native aggregates
   (:func:`change_points`), not from the fold: per (cluster, position) the first line
   whose token differs from the cluster's first line is where that position became
   ``<*>``. The template is the position-wise generalisation of the lines seen so far,
   which is what the fold computes, and repeats of a line can never change it.

A cluster's id is the md5 of its creating line's id and text, so it depends on nothing
else: not on the run, the partitioning or ``group_lines``. Seeds keep their ids.

Deliberate differences from the reference's outside library (documented in README):
no child limit per tree node, groups keyed purely from the line, repeats share their
first occurrence's cluster.
"""

from __future__ import annotations

import bisect
import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.functions.tokens import WILDCARD, tokens
from logweave.session import cut_lineage

DEFAULT_SIM_TH = 0.4
#: Clusters whose ids are broadcast.
FEW_CLUSTERS = 1_000_000
DEFAULT_GROUP_LINES = 20_000
DEFAULT_STEP = 5_000
_ONE_CALL = 100_000     # template tokens compared with a line in one numpy call


def mining_key(toks: Column) -> Column:
    """(token count, first token or '<*>' when it has a digit) as one string."""
    first = F.get(toks, 0)
    first = F.when(first.rlike(r"\d"), F.lit(WILDCARD)).otherwise(F.coalesce(first, F.lit("")))
    return F.concat(F.size(toks).cast("string"), F.lit("|"), first)


def cluster_name(line_id, text) -> str:
    """Id of the cluster that a line creates."""
    return hashlib.md5(f"{line_id}|{text or ''}".encode("utf-8", "surrogatepass")).hexdigest()


# ---------------------------------------------------------------------------
# the ordered fold (runs inside applyInPandas, one key at a time)
# ---------------------------------------------------------------------------

class Templates:
    """Templates of one key as token ids, a row per position; -1 is a wildcard."""

    def __init__(self, width: int):
        self.width, self.size = width, 0
        self.vocab: dict[str, int] = {}
        self.words: list[str] = []
        self.rows = np.empty((width, 16), np.int32)
        self.wild = np.empty(16, np.int32)

    def ids(self, toks: list[str]) -> np.ndarray:
        out = np.empty(self.width, np.int32)
        for i, t in enumerate(toks):
            k = self.vocab.get(t)
            if k is None:
                k = self.vocab[t] = len(self.words)
                self.words.append(t)
            out[i] = k
        return out

    def put(self, at: int, ids: np.ndarray) -> None:
        """Sets template ``at``, a new one if it is the next."""
        if at == len(self.wild):
            self.rows = np.concatenate([self.rows, np.empty_like(self.rows)], axis=1)
            self.wild = np.concatenate([self.wild, np.empty_like(self.wild)])
        self.rows[:, at] = ids
        self.wild[at] = (ids < 0).sum()
        self.size = max(self.size, at + 1)

    def read(self, toks: list[str]) -> np.ndarray:
        """Ids of a template's tokens."""
        ids = self.ids(toks)
        ids[[t == WILDCARD for t in toks]] = -1
        return ids

    def best(self, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per line of ids the best template (highest share of equal positions, then more
        wildcards, then the older one) and its equal positions."""
        k, n = self.size, self.width
        at, top = np.empty(len(lines), np.int64), np.empty(len(lines), np.int64)
        if len(lines) == 1 and k * n <= _ONE_CALL:
            # few numbers: numpy's calls would cost more than its work
            equal = (self.rows[:, :k] == lines[0][:, None]).sum(axis=0, dtype=np.int32)
            at[0] = (equal * np.int32(n + 1) + self.wild[:k]).argmax()
            top[0] = equal[at[0]]
            return at, top
        step = max(1, 2_000_000 // max(k, 1))
        for a in range(0, len(lines), step):
            some = lines[a:a + step]
            equal = np.zeros((len(some), k), np.int32)
            for p in range(n):
                equal += some[:, p, None] == self.rows[p, None, :k]
            rank = equal * np.int32(n + 1) + self.wild[:k]
            at[a:a + step] = rank.argmax(axis=1)
            top[a:a + step] = equal[np.arange(len(some)), at[a:a + step]]
        return at, top

    def add(self, toks: list[str], sim_th: float) -> tuple[int, str]:
        """Folds one line: its cluster, and CREATE / UPDATE / NONE."""
        ids = self.ids(toks)
        if self.size:
            at, top = self.best(ids[None, :])
            at = int(at[0])
            if self.width == 0 or top[0] / self.width >= sim_th:
                new = np.where(self.rows[:, at] == ids, ids, -1)
                if (new == self.rows[:, at]).all():
                    return at, "NONE"
                self.put(at, new)
                return at, "UPDATE"
        ids[[t == WILDCARD for t in toks]] = -1
        self.put(self.size, ids)
        return self.size - 1, "CREATE"

    def text(self, at: int) -> str:
        return " ".join(WILDCARD if i < 0 else self.words[i] for i in self.rows[:, at])


def fold_group(token_lists, sim_th: float, seed_templates=()):
    """Assign each token list (already in arrival order) to a cluster.

    Returns (assignment ordinals, final templates as token lists). ``seed_templates`` are
    pre-existing clusters (ordinals 0..k-1), e.g. merge / reset decisions.
    """
    ords, _, _, finals = fold_with_kinds(token_lists, sim_th, seed_templates)
    return np.array(ords, np.int64), [t.split(" ") if t else [] for t in finals]


def fold_with_kinds(token_lists, sim_th: float, templates=()):
    """The fold, starting from ``templates``: per line (ordinal, CREATE/UPDATE/NONE, template
    after the line), and the final templates. All token lists have one length."""
    token_lists, templates = list(token_lists), list(templates)
    state = Templates(len((token_lists or templates or [[]])[0]))
    for i, t in enumerate(templates):
        state.put(i, state.read(t))
    ords, kinds, after = [], [], []
    for toks in token_lists:
        at, kind = state.add(toks, sim_th)
        ords.append(at)
        kinds.append(kind)
        after.append(state.text(at))
    return ords, kinds, after, [state.text(i) for i in range(state.size)]


def _split(text) -> list[str]:
    """Tokens as the column function ``tokens`` cuts them."""
    return text.split() if text else []


# Rows of a key (-1 where a number is missing: pandas reads longs with nulls as floats). SEED and LINE go in; a change (CREATE / UPDATE) of the history is a LINE that
# also names its cluster and the template after it.
_ROWS = "key string, at long, text string, kind string, ordinal long, cluster_id string, template string"
_ASSIGNED = "text string, key string, first_line_id long, cluster_id string, n long"


def _frame(kinds: str, *columns) -> pd.DataFrame:
    """A frame of the schema ``kinds`` from its columns as lists."""
    names = [c.split() for c in kinds.split(", ")]
    return pd.DataFrame({n: pd.Series(list(c), dtype="int64" if k == "long" else object) for (n, k), c in zip(names, columns)})


def _runs(pdf: pd.DataFrame, by: list[str]):
    """Row ranges with equal ``by``, of a frame sorted by them."""
    if len(pdf):
        new = (pdf[by] != pdf[by].shift()).any(axis=1).to_numpy()
        at = np.flatnonzero(new)
        yield from zip(at.tolist(), [*at[1:].tolist(), len(pdf)])


def _in_order(pdf: pd.DataFrame) -> pd.DataFrame:
    """Seeds by ordinal, then lines by arrival (one id: by text)."""
    return (pdf.assign(__s=(pdf["kind"] != "SEED"), __o=pdf["ordinal"].where(pdf["kind"] == "SEED", 0), __t=pdf["text"].fillna(""))
            .sort_values(["key", "__s", "__o", "at", "__t"], kind="stable"))


def _fold_keys(sim_th: float):
    """Folds every key of a bucket whole: the cluster of each line."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = _in_order(pdf)
        keys, at, texts, kinds = (pdf[c].tolist() for c in ("key", "at", "text", "kind"))
        names, n = pdf["cluster_id"].tolist(), pdf["n"].tolist()
        rows, found = [], []
        for a, e in _runs(pdf, ["key"]):
            state, ids = None, []
            for i in range(a, e):
                toks = _split(texts[i])
                state = state or Templates(len(toks))
                if kinds[i] == "SEED":
                    state.put(state.size, state.read(toks))
                    ids.append(names[i])
                    continue
                o, kind = state.add(toks, sim_th)
                if kind == "CREATE":
                    ids.append(cluster_name(at[i], texts[i]))
                rows.append(i)
                found.append(ids[o])
        return _frame(_ASSIGNED, *([c[i] for i in rows] for c in (texts, keys, at)), found, [n[i] for i in rows])
    return run


def _fold_changes(sim_th: float):
    """Folds a key's known and possible changes: seeds and actual changes stay."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = _in_order(pdf)
        keys, at, texts, kinds, names = (pdf[c].tolist() for c in ("key", "at", "text", "kind", "cluster_id"))
        out, state, ids = [], None, []
        for i in range(len(keys)):
            toks = _split(texts[i])
            state = state or Templates(len(toks))
            if kinds[i] == "SEED":
                state.put(state.size, state.read(toks))
                ids.append(names[i])
                out.append((keys[i], at[i], texts[i], "SEED", len(ids) - 1, names[i], texts[i]))
                continue
            o, kind = state.add(toks, sim_th)
            if kind == "CREATE":
                ids.append(cluster_name(at[i], texts[i]))
            if kind != "NONE":
                out.append((keys[i], at[i], texts[i], kind, o, ids[o], state.text(o)))
        return _frame(_ROWS, *zip(*out)) if out else _frame(_ROWS, *[[]] * 7)
    return run


def _against_history(sim_th: float, step: int | None):
    """A chunk of a key's lines against the key's history, each as of its arrival. With
    ``step`` the first lines that would change something and are no changes of the history;
    without, every line with its cluster."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = _in_order(pdf)
        key, kinds = pdf["key"].iloc[0], pdf["kind"].to_numpy()
        past, now = pdf[kinds != "LINE"], pdf[kinds == "LINE"]
        state, names, changes, made = None, {}, [], {}
        for at, text, kind, o, name, tpl in zip(*(past[c].tolist() for c in ("at", "text", "kind", "ordinal", "cluster_id", "template"))):
            toks = _split(tpl)
            state = state or Templates(len(toks))
            names[o] = name
            if kind == "SEED":
                state.put(o, state.read(toks))
            else:
                changes.append((at, text or "", o, state.read(toks)))
                made[text or ""] = name
        order = [c[:2] for c in changes]
        rows = [(a, t) for a, t in zip(now["at"].tolist(), now["text"].tolist()) if step is None or (t or "") not in made]
        found: list = []
        i, done = 0, 0
        while i < len(rows) and (step is None or len(found) < step):
            upto = bisect.bisect_left(order, (rows[i][0], rows[i][1] or ""))
            for *_, o, ids in changes[done:upto]:
                state.put(o, ids)
            done = upto
            j = len(rows) if upto == len(order) else bisect.bisect_right(rows, order[upto], key=lambda r: (r[0], r[1] or ""))
            j = max(min(j, i + 4096), i + 1)
            if state.size:
                ids = np.stack([state.ids(_split(t)) for _, t in rows[i:j]])
                best, top = state.best(ids)
                joins = (top >= sim_th * state.width) if state.width == 0 else (top / state.width >= sim_th)
                same = joins & (top == state.width - state.wild[best])
            else:
                best, same = np.zeros(j - i, np.int64), np.zeros(j - i, bool)
            for (at, text), o, ok in zip(rows[i:j], best.tolist(), same.tolist()):
                if step is None:
                    found.append((at, text, made.get(text or "") or names[o]))
                elif not ok:
                    found.append((at, text))
            i = j
        if step is None:
            return _frame(_ASSIGNED.removesuffix(", n long"), [t for _, t, _ in found], [key] * len(found), [a for a, *_ in found], [c for *_, c in found])
        found, m = found[:step], min(len(found), step)
        return _frame(_ROWS, [key] * m, [a for a, _ in found], [t for _, t in found], ["LINE"] * m, [-1] * m, [None] * m, [None] * m)
    return run


def _seed_rows(seeds: DataFrame) -> DataFrame:
    """Seeds as rows of their key, in the order they were created (``created``, else id)."""
    first = F.col("created") if "created" in seeds.columns else F.lit(None).cast("long")
    rows = seeds.select(mining_key(tokens(F.col("template"))).alias("key"), "template", F.col("cluster_id").cast("string").alias("cluster_id"), first.alias("c"))
    # seeds of a key: its clusters so far
    order = F.row_number().over(Window.partitionBy("key").orderBy(F.col("c").asc_nulls_first(), "cluster_id")) - 1
    return rows.select("key", F.lit(-1).cast("long").alias("at"), F.col("template").alias("text"), F.lit("SEED").alias("kind"),
                       order.cast("long").alias("ordinal"), "cluster_id", "template")


def _as_lines(d: DataFrame, *more: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return d.select("key", F.col("first_line_id").alias("at"), "text", F.lit("LINE").alias("kind"), F.lit(-1).cast("long").alias("ordinal"),
                    none.alias("cluster_id"), none.alias("template"), *more)


def _large_keys(d: DataFrame, sizes: DataFrame, seeds: DataFrame | None, sim_th: float, group_lines: int, step: int) -> DataFrame:
    """(text, key, first_line_id, cluster_id) of the lines of some large keys (module
    docstring, 3.). ``sizes``: their keys and numbers of distinct lines."""
    chunks = F.ceil(F.col("key_lines") / F.lit(group_lines)).cast("int")
    lines = d.join(sizes.withColumn("chunks", chunks), "key")
    lines = cut_lineage(lines.withColumn("chunk", F.pmod(F.xxhash64("text"), F.col("chunks")).cast("int")).select("key", "chunk", "text", "first_line_id"))
    everywhere = sizes.select("key", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"))
    earliest = Window.partitionBy("key").orderBy("at", "text")

    def first(rows: DataFrame) -> DataFrame:
        return rows.withColumn("r", F.row_number().over(earliest)).where(F.col("r") <= step).drop("r")

    def compare(some: DataFrame, history: DataFrame, limit: int | None) -> DataFrame:
        both = _as_lines(some, "chunk").unionByName(history.join(everywhere, "key"))
        schema = _ROWS if limit else _ASSIGNED.removesuffix(", n long")
        return both.groupBy("key", "chunk").applyInPandas(_against_history(sim_th, limit), schema)

    more = first(_as_lines(lines))
    if seeds is not None:
        more = more.unionByName(seeds.join(sizes.select("key"), "key", "left_semi"))
    history, active = None, lines
    while True:
        rows = more if history is None else more.unionByName(history)
        history = cut_lineage(rows.groupBy("key").applyInPandas(_fold_changes(sim_th), _ROWS))
        more = cut_lineage(first(compare(active, history, step)))
        since = more.groupBy("key").agg(F.min("at").alias("since"))
        if since.isEmpty():
            return compare(lines, history, None)
        active = lines.join(since, "key").where(F.col("first_line_id") >= F.col("since")).drop("since")


def mine_templates(lines: DataFrame, text_col: str = "processed", id_col: str = "line_id",
                   sim_th: float = DEFAULT_SIM_TH, seeds: DataFrame | None = None,
                   group_lines: int = DEFAULT_GROUP_LINES, step: int = DEFAULT_STEP,
                   bucket_rows: int = 20_000) -> DataFrame:
    """A1: cluster assignment per *distinct* text.

    Returns ``(text, key, first_line_id, cluster_id, n)`` (n = lines with this text); join
    back on ``text`` for per-line results (:func:`assign_lines`). ``seeds(cluster_id,
    template[, created])`` are existing clusters that lines may join; they keep their ids and
    come before all lines, ordered by ``created`` (the id of the creating line): mining a
    second batch from the templates of the first gives what one run over both gives.

    ``group_lines`` (distinct lines of a key folded in one call, or compared in one) and
    ``step`` (changes added to a key in a round) only deal out the work: the result is that
    of one sequential fold whatever they are.
    """
    # no null filter here: it would be pushed below the projection that computes the text
    # (the mask chain) and evaluate it twice; a null text folds as an empty line instead
    d = lines.groupBy(F.col(text_col).alias("text")).agg(F.min(id_col).alias("first_line_id"),
                                                         F.count(F.lit(1)).alias("n"))
    d = d.withColumn("toks", F.coalesce(tokens(F.col("text")), F.array().cast("array<string>")))
    # the distinct lines feed the key counts and the folds: written once to the checkpoint
    # folder so the input (and its mask chain) is evaluated exactly once
    d = cut_lineage(d.select(mining_key(F.col("toks")).alias("key"), "text", F.col("first_line_id").cast("long").alias("first_line_id"), "n"))
    sizes = d.groupBy("key").agg(F.count(F.lit(1)).alias("key_lines"))
    d = d.join(sizes, "key")
    start = None
    single = F.col("key_lines") == 1
    if seeds is not None:
        start = cut_lineage(_seed_rows(seeds))
        d = d.join(start.select("key", F.lit(True).alias("has_seed")).distinct(), "key", "left")
        single = single & F.col("has_seed").isNull()
    # a key with one distinct line and no seed is its own cluster: no Python needed
    named = F.md5(F.concat(F.col("first_line_id").cast("string"), F.lit("|"), F.coalesce("text", F.lit(""))))
    singles = d.where(single).select("text", "key", "first_line_id", named.alias("cluster_id"), "n")
    # one applyInPandas call materialises its whole bucket: size buckets from the number of
    # distinct lines, so a call never holds more than about `bucket_rows` lines. A bucket is a
    # task: by their bytes alone AQE would put them together, as many as one task to a core or fewer
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    buckets = max(parts, -(-d.count() // bucket_rows))
    small = d.where(~single & (F.col("key_lines") <= group_lines))
    rows = _as_lines(small, "n")
    if start is not None:
        # seeds of keys without lines start nothing
        rows = rows.unionByName(start.join(small.select("key").distinct(), "key", "left_semi").withColumn("n", F.lit(0).cast("long")))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")).repartitionById(buckets, "bucket")
    folded = rows.groupBy("bucket").applyInPandas(_fold_keys(sim_th), _ASSIGNED)
    out = folded.unionByName(singles)
    large = cut_lineage(sizes.where(F.col("key_lines") > group_lines))
    if large.isEmpty():
        return out
    lines_of = d.join(large.select("key"), "key", "left_semi")
    found = _large_keys(lines_of.select("key", "text", "first_line_id"), large, start, sim_th, group_lines, step)
    n = lines_of.select(F.col("text").alias("__t"), "n")
    return out.unionByName(found.join(n, found["text"].eqNullSafe(n["__t"])).select("text", "key", "first_line_id", "cluster_id", "n"))


# ---------------------------------------------------------------------------
# A2 / A3: templates of given clusters
# ---------------------------------------------------------------------------

def template_of_cluster(df: DataFrame, cluster_col: str = "cluster_id", text_col: str = "processed",
                        least: str | None = None, written: bool = False) -> DataFrame:
    """A2: position-wise template per cluster: the token when all rows agree, else '<*>'.
    A cluster of one text is that text. Every row of another is compared with one of its
    cluster's longest rows and gives no more than the positions where they differ: what is
    grouped grows with these clusters and their token counts, not with the tokens of all lines.
    Shuffles carry texts, cut where they are compared. ``df`` is read twice. ``least``: a column
    of which the result keeps the cluster's least value. ``written``: the result reads tables."""
    kept = [least] if least else []
    rows = df.select(F.col(cluster_col).alias("cluster_id"), F.col(text_col).alias("text"), *kept)
    longest = F.max_by("text", F.size(tokens(F.col("text"))))
    texts = F.when(F.col("text").isNotNull(), F.xxhash64("text"))
    # written, so that its size decides how the lines meet it
    one = cut_lineage(rows.groupBy("cluster_id").agg(longest.alias("text"), F.coalesce(F.min(texts) < F.max(texts), F.lit(False)).alias("varies"), *[F.min(c).alias(c) for c in kept]))
    same = one.where(~F.col("varies")).select("cluster_id", *kept, tokens(F.col("text")).alias("t0")).where(F.size("t0") > 0)
    many = one.where("varies")
    size = one.agg(F.count(F.lit(1)).alias("n"), F.count_if("varies").alias("vary")).first()
    rows = rows.select("cluster_id", "text")
    if size.vary < size.n and size.vary <= FEW_CLUSTERS:
        # lines of other clusters stay out of the shuffle
        ids = F.broadcast(many.select(F.xxhash64("cluster_id").alias("__h")).distinct())
        rows = rows.join(ids, F.xxhash64("cluster_id") == F.col("__h"), "left_semi")
    far = many.select(F.col("cluster_id").alias("__c"), F.col("text").alias("__one"), *kept)
    both = rows.join(far, F.col("cluster_id").eqNullSafe(F.col("__c"))).select("cluster_id", *kept, tokens(F.col("text")).alias("toks"), tokens(F.col("__one")).alias("t0"))
    differs = F.filter(F.sequence(F.lit(0), F.size("toks") - 1), lambda i: F.get(F.col("toks"), i) != F.get(F.col("t0"), i))
    unlike = both.where(F.size("toks") > 0).select("cluster_id", *kept, "t0", F.explode(differs).alias("pos"))
    unlike = unlike.select("cluster_id", *kept, "pos", F.get(F.col("t0"), F.col("pos")).alias("tok")).distinct()
    # both dealt by cluster: a position's and a cluster's rows are grouped where they lie
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = many.select("cluster_id", *kept, "text").repartition(n, "cluster_id").select("cluster_id", *kept, F.posexplode(tokens(F.col("text"))).alias("pos", "tok"))
    g = x.unionByName(unlike.repartition(n, "cluster_id")).groupBy("cluster_id", *kept, "pos").agg(F.min("tok").alias("lo"), F.count(F.lit(1)).alias("unlike"))
    g = g.select("cluster_id", *kept, "pos", F.when(F.col("unlike") == 1, F.col("lo")).otherwise(F.lit(WILDCARD)).alias("tok"))
    t = g.groupBy("cluster_id", *kept).agg(F.array_sort(F.collect_list(F.struct("pos", "tok"))).alias("pt"))
    t = t.select("cluster_id", *kept, F.array_join(F.transform("pt", lambda p: p["tok"]), " ").alias("template"))
    if written:
        t = cut_lineage(t)      # the clusters of one text are in a table already
    t = t.unionByName(same.select("cluster_id", *kept, F.array_join("t0", " ").alias("template")))
    return t.withColumn("token_count", F.size(tokens(F.col("template"))))


def list_clusters(templates: DataFrame) -> DataFrame:
    """A3: cluster, template, token count."""
    return templates.select("cluster_id", "template", F.size(tokens(F.col("template"))).alias("token_count"))


# ---------------------------------------------------------------------------
# Change types and version history from a cluster assignment
# ---------------------------------------------------------------------------

def change_points(assigned: DataFrame, seeds: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """W3 + W4 for distinct lines ``(text, cluster_id, first_line_id)`` in arrival order.

    Returns ``(line_changes, versions)``:
    * ``line_changes(text, cluster_id, first_line_id, change_type)`` — CREATE for a
      cluster's first line, UPDATE where the template gains a wildcard, else NONE.
    * ``versions(cluster_id, version, template, trigger_line_id)`` — one row per CREATE /
      UPDATE; version numbers start at 1.

    Seeds ``(cluster_id, template)`` are existing templates (virtual line id -1): they
    start the history without a CREATE.
    """
    d = assigned.select("cluster_id", "first_line_id", tokens(F.col("text")).alias("toks"), "text",
                        F.lit(False).alias("is_seed"))
    if seeds is not None:
        d = d.unionByName(seeds.select("cluster_id", F.lit(-1).cast("bigint").alias("first_line_id"),
                                       tokens(F.col("template")).alias("toks"), F.col("template").alias("text"),
                                       F.lit(True).alias("is_seed"))
                          .join(assigned.select("cluster_id").distinct(), "cluster_id", "left_semi"))
    first = d.groupBy("cluster_id").agg(F.min_by("toks", "first_line_id").alias("t0"),
                                        F.min("first_line_id").alias("c0"),
                                        F.max(F.col("is_seed").cast("int")).alias("seeded"))
    j = d.join(first, "cluster_id")
    diff_pos = F.filter(F.sequence(F.lit(0), F.greatest(F.size("toks") - 1, F.lit(0))),
                        lambda i: (F.size("toks") > i) & (F.get(F.col("t0"), i) != F.lit(WILDCARD))
                        & (F.get(F.col("toks"), i) != F.get(F.col("t0"), i)))
    diffs = j.select("cluster_id", "first_line_id", F.explode(diff_pos).alias("pos"))
    cp = diffs.groupBy("cluster_id", "pos").agg(F.min("first_line_id").alias("change_line"))
    # per cluster: positions that became wildcards, bounded by the token count
    cp_arr = cp.groupBy("cluster_id").agg(F.collect_list(F.struct("pos", "change_line")).alias("cps"))
    updates = cp.select("cluster_id", F.col("change_line").alias("trigger_line_id")).distinct()
    creates = first.where(F.col("seeded") == 0).select("cluster_id", F.col("c0").alias("trigger_line_id"))
    seeded0 = first.where(F.col("seeded") == 1).select("cluster_id", F.col("c0").alias("trigger_line_id"))
    vlines = creates.unionByName(updates).unionByName(seeded0).distinct()
    v = (vlines.join(first.select("cluster_id", "t0"), "cluster_id")
         .join(cp_arr, "cluster_id", "left"))
    tpl = F.array_join(F.transform("t0", lambda tok, i: F.when(F.exists(
        F.coalesce(F.col("cps"), F.array()), lambda c: (c["pos"] == i) & (c["change_line"] <= F.col("trigger_line_id"))),
        F.lit(WILDCARD)).otherwise(tok)), " ")
    from pyspark.sql import Window
    # versions per cluster are bounded by token count + 1, so this window is small
    w = Window.partitionBy("cluster_id").orderBy("trigger_line_id")
    # seed rows (line id -1) only anchor the template; numbering counts this run's changes
    versions = (v.select("cluster_id", "trigger_line_id", tpl.alias("template"))
                .where(F.col("trigger_line_id") >= 0)
                .withColumn("version", F.row_number().over(w)))
    kind = (F.when((F.col("first_line_id") == F.col("c0")) & (F.col("seeded") == 0), F.lit("CREATE"))
            .when(F.col("u").isNotNull(), F.lit("UPDATE")).otherwise(F.lit("NONE")))
    lc = (assigned.select("text", "cluster_id", "first_line_id")
          .join(first.select("cluster_id", "c0", "seeded"), "cluster_id")
          .join(updates.select("cluster_id", F.col("trigger_line_id").alias("first_line_id"), F.lit(1).alias("u")),
                ["cluster_id", "first_line_id"], "left")
          .select("text", "cluster_id", "first_line_id", kind.alias("change_type")))
    return lc, versions.select("cluster_id", "version", "template", "trigger_line_id")


def assign_lines(lines: DataFrame, line_changes: DataFrame, versions: DataFrame,
                 text_col: str = "processed", id_col: str = "line_id") -> DataFrame:
    """Per-line mining result: cluster, change type (only a text's first line can CREATE /
    UPDATE; repeats are NONE) and the template as of that line (latest version whose
    trigger line is not after it). Versions per cluster are bounded by the token count,
    so each line carries a small array; joins are on the text and the cluster id."""
    vs = versions.groupBy("cluster_id").agg(
        F.array_sort(F.collect_list(F.struct("trigger_line_id", "template"))).alias("vers"))
    j = (lines.join(line_changes.withColumnRenamed("text", text_col), text_col, "left")
         .join(vs, "cluster_id", "left"))
    asof = F.filter("vers", lambda v: v["trigger_line_id"] <= F.col(id_col))
    return (j.withColumn("change_type", F.when(F.col(id_col) == F.col("first_line_id"), F.col("change_type"))
                         .otherwise(F.lit("NONE")))
            .withColumn("template", F.get(asof, F.size(asof) - 1)["template"])
            .drop("vers", "first_line_id"))
