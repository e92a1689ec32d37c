"""Per-cluster samples (W5 first_samples, W6 reservoir_sample, W7 split_round_robin,
W8 request_chunks).

The reference keeps a uniform reservoir (Algorithm R) of at most k lines per cluster,
fed in arrival order. Here the same distribution comes from a bottom-k sample: each line
gets a pseudo-random rank ``md5(seed || line_id)`` and a cluster keeps its k smallest
ranks. It is deterministic (replays and retries give the same sample), mergeable across
partitions, and a cluster with k lines or fewer keeps all of them. Spark plans
``row_number() <= k`` with a map-side ``WindowGroupLimit``, so each map task forwards at
most k rows per cluster and a hot cluster never reaches one task whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_K = 200
DEFAULT_SEED = "logweave"


def sample_rank(line_id: Column, seed: str = DEFAULT_SEED) -> Column:
    return F.md5(F.concat(F.lit(seed + ":"), line_id.cast("string")))


def reservoir_sample(df: DataFrame, k: int = DEFAULT_K, cluster_col: str = "cluster_id",
                     id_col: str = "line_id", seed: str = DEFAULT_SEED) -> DataFrame:
    """At most k rows per cluster, uniform without replacement; adds ``slot`` (1..k in
    arrival order)."""
    r = df.withColumn("__rank", sample_rank(F.col(id_col), seed))
    w = Window.partitionBy(cluster_col).orderBy("__rank", id_col)
    kept = r.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= k)
    # at most k rows per cluster remain: ordering them by arrival is a bounded window
    w2 = Window.partitionBy(cluster_col).orderBy(id_col)
    return kept.withColumn("slot", F.row_number().over(w2)).drop("__rank", "__rn")


def sample_counts(df: DataFrame, cluster_col: str = "cluster_id") -> DataFrame:
    """Reservoir counts: lines seen per cluster."""
    return df.groupBy(cluster_col).agg(F.count(F.lit(1)).alias("n"))


def first_samples(samples: DataFrame, k: int = 3) -> DataFrame:
    """First k samples (by slot) of every cluster."""
    return samples.where(F.col("slot") <= k)


def samples_array(samples: DataFrame, k: int = 3, cluster_col: str = "cluster_id",
                  line_col: str = "line") -> DataFrame:
    """First k sample lines per cluster as an ordered array (k is small and fixed)."""
    return (first_samples(samples, k).groupBy(cluster_col)
            .agg(F.array_sort(F.collect_list(F.struct("slot", line_col))).alias("__s"))
            .select(cluster_col, F.transform("__s", lambda s: s[line_col]).alias("samples")))


def split_round_robin(samples: DataFrame, n_subs: Column | int) -> DataFrame:
    """Sample j (0-based, arrival order) goes to sub-template j mod n."""
    n = F.lit(n_subs) if isinstance(n_subs, int) else n_subs
    return samples.withColumn("sub_index", F.pmod(F.col("slot") - 1, n).cast("int"))


def request_chunks(items: DataFrame, size: int = 3, order_col: str = "cluster_id",
                   buckets: int = 64) -> DataFrame:
    """Groups of ``size`` items for review. Items are spread over ``buckets`` by hash
    and numbered inside their bucket, so no single task numbers everything."""
    b = F.pmod(F.xxhash64(F.col(order_col)), F.lit(buckets)).alias("bucket")
    w = Window.partitionBy("bucket").orderBy(order_col)
    x = items.select("*", b).withColumn("__rn", F.row_number().over(w))
    return (x.withColumn("chunk_id", F.concat_ws("-", F.col("bucket").cast("string"),
                                                 F.floor((F.col("__rn") - 1) / size).cast("string")))
            .drop("__rn"))
