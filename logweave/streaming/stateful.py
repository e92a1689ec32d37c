"""Keyed state that starts from tables and is read back as tables.

R2 ``mine_stream``      a mining key's clusters in map state; ``clusters`` (the table a batch run
                        leaves, ``cluster_table``) is the initial state, so a stream goes on
                        where a batch stopped, with the same ids.
R4 ``confirm_stream``   the merges pending into a target in map state; every mined line of the
                        target after the staging time confirms them, the threshold's line emits
                        the deletion and ends the entry.
``clusters_in_state``   the mining state of a checkpoint as a table (state data source).

State lives in RocksDB with the query's checkpoint; an entry is written only when it changed.
One call holds one key's rows of one micro-batch (bounded by the trigger) and its entries.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from logweave.functions.tokens import tokens
from logweave.operators.mining import DEFAULT_SIM_TH, Templates, _split, cluster_name, mining_key
from logweave.streaming.ingest import use_rocksdb

CLUSTERS = "cluster_id string, template string, created long"
_ENTRY = "cluster_id string, template string, created long"
_MINED = "line_id long, key string, cluster_id string, change_type string, template string, line string"
_HITS = "cluster_id string, merge_target_id string, confirmations int, confirmed_by long"


def _text(x):
    return x if isinstance(x, str) else None     # pandas reads a missing text as a float


class _Miner(StatefulProcessor):
    """The ordered fold of one mining key; entries by the order of creation."""

    def __init__(self, sim_th: float):
        self.sim_th = sim_th

    def init(self, handle) -> None:
        self.clusters = handle.getMapState("clusters", "ordinal long", _ENTRY)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        rows = initialState.sort_values(["created", "cluster_id"], kind="stable")
        for o, r in enumerate(zip(rows["cluster_id"], rows["template"], rows["created"])):
            self.clusters.updateValue((o,), (str(r[0]), str(r[1]), int(r[2])))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True).sort_values("line_id", kind="stable")
        state, names = None, {}
        for (o,), entry in self.clusters.iterator():
            toks = _split(entry[1])
            state = state or Templates(len(toks))
            state.put(int(o), state.read(toks))
            names[int(o)] = (entry[0], entry[2])
        changed, seen, out = set(), {}, []
        now: dict = {}      # texts of the templates as they are
        for line_id, text, line in zip(new["line_id"].tolist(), map(_text, new["processed"]), map(_text, new["line"])):
            if text in seen:                     # a repeat stays with its first occurrence
                at, kind = seen[text], "NONE"
            else:
                toks = _split(text)
                state = state or Templates(len(toks))
                at, kind = state.add(toks, self.sim_th)
                seen[text] = at
            if kind == "CREATE":
                names[at] = (cluster_name(line_id, text), line_id)
            if kind != "NONE":
                changed.add(at)
            if kind != "NONE" or at not in now:
                now[at] = state.text(at)
            out.append((line_id, key[0], names[at][0], kind, now[at], line))
        for at in sorted(changed):
            self.clusters.updateValue((at,), (names[at][0], state.text(at), int(names[at][1])))
        yield pd.DataFrame({c.split()[0]: pd.Series([r[i] for r in out], dtype="int64" if i == 0 else object) for i, c in enumerate(_MINED.split(", "))})

    def close(self) -> None:
        pass


def cluster_table(mined: DataFrame, versions: DataFrame) -> DataFrame:
    """(cluster_id, template, created) of a mining run: each cluster's last template and the
    line that created it. Seeds for the next batch (``mine_templates``) or stream."""
    created = mined.groupBy("cluster_id").agg(F.min("first_line_id").alias("created"))
    return versions.groupBy("cluster_id").agg(F.max_by("template", "version").alias("template")).join(created, "cluster_id").select("cluster_id", "template", "created")


def _key_of(text):
    return mining_key(F.coalesce(tokens(text), F.array().cast("array<string>")))


def mine_stream(masked: DataFrame, sim_th: float = DEFAULT_SIM_TH, clusters: DataFrame | None = None) -> DataFrame:
    """R2: stateful mining of a stream of masked lines (line_id, line, processed), starting
    from ``clusters`` when the query first runs. Repeats within a micro-batch share their
    first occurrence's cluster; a null line folds as an empty one."""
    use_rocksdb(masked.sparkSession)
    keyed = masked.select("line_id", "processed", "line", _key_of(F.col("processed")).alias("key"))
    first = None
    if clusters is not None:
        first = clusters.select(_key_of(F.col("template")).alias("key"), "cluster_id", "template", F.col("created").cast("long").alias("created")).groupBy("key")
    return keyed.groupBy("key").transformWithStateInPandas(_Miner(sim_th), _MINED, "append", "None", initialState=first)


def clusters_in_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(cluster_id, template, created, key) as the state of a ``mine_stream`` query holds them
    after its last micro-batch."""
    s = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "clusters").option("flattenCollectionTypes", "true").load()
    return s.select("user_map_value.cluster_id", "user_map_value.template", "user_map_value.created", "key.key")


class _Confirmations(StatefulProcessor):
    """Merges pending into one target: hits so far and the staging time, by template."""

    def __init__(self, threshold: int):
        self.threshold = threshold

    def init(self, handle) -> None:
        self.pending = handle.getMapState("pending", "cluster_id string", "count int, staged_at long")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        for c, n, at in zip(initialState["cluster_id"], initialState["confirmation_count"], initialState["staged_at"]):
            self.pending.updateValue((str(c),), (int(n), int(at)))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        waiting = {k[0]: (int(v[0]), int(v[1])) for k, v in self.pending.iterator()}
        gone = []
        if waiting:
            hits = pd.concat([p[["line_id", "at"]] for p in rows], ignore_index=True).sort_values(["at", "line_id"], kind="stable")
            for c, (n, staged) in sorted(waiting.items()):
                ids = hits["line_id"][hits["at"] > staged].tolist()
                if n + len(ids) >= self.threshold and ids:
                    gone.append((c, key[0], self.threshold, ids[max(self.threshold - n, 1) - 1]))
                    self.pending.removeKey((c,))
                elif ids:
                    self.pending.updateValue((c,), (n + len(ids), staged))
        yield pd.DataFrame({"cluster_id": pd.Series([g[0] for g in gone], dtype=object), "merge_target_id": pd.Series([g[1] for g in gone], dtype=object),
                            "confirmations": pd.Series([g[2] for g in gone], dtype="int32"), "confirmed_by": pd.Series([g[3] for g in gone], dtype="int64")})

    def close(self) -> None:
        pass


def confirm_stream(results: DataFrame, pending: DataFrame, threshold: int = 100) -> DataFrame:
    """Deletions (cluster_id, merge_target_id, confirmations, confirmed_by) of templates
    whose merge ``threshold`` mined NONE lines of the target have confirmed.

    ``results``: a stream of line_id, arrival_ts, cluster_id, change_type, fast_path,
    near_match. ``pending``: cluster_id, merge_target_id, confirmation_count, staged_at of the
    PENDING_MERGE templates when the query first runs. Lines up to the staging time and lines
    of the fast path confirm nothing. Only the targets' lines are shuffled."""
    use_rocksdb(results.sparkSession)
    fast = F.coalesce(F.col("fast_path"), F.lit(False)) | F.coalesce(F.col("near_match"), F.lit(False))
    targets = pending.select(F.col("merge_target_id").alias("__t")).distinct()
    hits = results.where((F.col("change_type") == "NONE") & ~fast).join(targets, F.col("cluster_id") == F.col("__t"), "left_semi")
    hits = hits.select("line_id", F.col("cluster_id").alias("target"), F.unix_micros(F.col("arrival_ts").cast("timestamp")).alias("at"))
    start = pending.select(F.col("merge_target_id").alias("target"), "cluster_id", F.col("confirmation_count").cast("int").alias("confirmation_count"),
                           F.coalesce(F.unix_micros(F.col("staged_at").cast("timestamp")), F.lit(-1 << 62)).alias("staged_at"))
    return hits.groupBy("target").transformWithStateInPandas(_Confirmations(threshold), _HITS, "append", "None", initialState=start.groupBy("target"))
