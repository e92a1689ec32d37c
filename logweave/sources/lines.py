"""S1 read_log_lines: text files -> log_lines(line_id, arrival_ts, source, line).

Arrival order matters (mining, versions, first-seen reports), and a DataFrame has no
order, so every line gets a ``line_id`` that is unique and increases with the position in
the input: ``file_index * 2^40 + split_start_byte + row_in_split``. A row takes at least
one byte (its newline), so ``row_in_split < split length`` and ids never collide across
splits. Split starts come from a small per-split aggregate (one row per file split),
not from a window over all rows, so no single task sees all lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FILE_SHIFT = 1 << 40


def non_blank(col):
    """True when the line has a non-whitespace character (blank lines are dropped)."""
    return col.rlike(r"\S")


def read_log_lines(spark: SparkSession, paths, source: str | None = None,
                   limit: int | None = None) -> DataFrame:
    """Read text files as log lines. ``limit`` keeps the first n lines in arrival order
    (the reference caps uploads at 200 000; no cap by default)."""
    raw = spark.read.text(paths)
    # the listing writes local files as file:///x, the scan metadata as file:/x
    files = sorted(f.replace("file:///", "file:/", 1) if f.startswith("file:///") else f for f in raw.inputFiles())
    file_idx = spark.createDataFrame(list(enumerate(files)),
                                     T.StructType([T.StructField("file_index", T.LongType()),
                                                   T.StructField("file_path", T.StringType())]))
    df = raw.select(
        F.col("value").alias("line"),
        F.regexp_replace(F.col("_metadata.file_path"), "^file:///", "file:/").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.col("_metadata.file_modification_time").alias("arrival_ts"),
        F.monotonically_increasing_id().alias("mid"),
    )
    split_first = df.groupBy("file_path", "block_start").agg(F.min("mid").alias("first_mid"))
    # file_idx has one row per input file (bounded by the listing) -> broadcast
    out = (df.join(split_first, ["file_path", "block_start"])
           .join(F.broadcast(file_idx), "file_path")
           .select((F.col("file_index") * F.lit(FILE_SHIFT) + F.col("block_start")
                    + (F.col("mid") - F.col("first_mid"))).alias("line_id"),
                   "arrival_ts",
                   (F.lit(source) if source is not None else F.col("file_path")).cast("string").alias("source"),
                   "line")
           .where(non_blank(F.col("line"))))
    if limit is not None:
        out = out.orderBy("line_id").limit(limit)
    from logweave.sources.tables import ensure_parallelism
    return ensure_parallelism(out, "line_id")


def lines_from_strings(spark: SparkSession, lines, source: str = "inline",
                       start_ts: str = "2024-01-01 00:00:00") -> DataFrame:
    """Small in-memory log_lines table (tests and examples): line_id = list position."""
    rows = [(i, line) for i, line in enumerate(lines)]
    df = spark.createDataFrame(rows, "line_id bigint, line string")
    return df.select("line_id",
                     (F.to_timestamp(F.lit(start_ts)) + F.make_interval(secs=F.col("line_id").cast("int"))).alias("arrival_ts"),
                     F.lit(source).alias("source"), "line")
