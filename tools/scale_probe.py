"""Scaling probe: the flagship and the mining job on the event lines replicated N times
(line ids kept unique: id * N + copy). Prints lines/s per job for N = 1 and N = $REPL.
Usage: REPL=10 python tools/scale_probe.py [sf_dir]"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from logweave.plans.coverage import class_coverage_job  # noqa: E402
from logweave.plans.ingest import ingest  # noqa: E402
from logweave.session import get_session  # noqa: E402
from logweave.sources.tables import event_log_lines  # noqa: E402


def replicated(spark, sf_dir, n):
    base = event_log_lines(spark, sf_dir)
    if n == 1:
        return base
    x = base.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("__k"))
    x = x.withColumn("line_id", F.col("line_id") * n + F.col("__k")).drop("__k")
    return x.repartition(spark.sparkContext.defaultParallelism * 2, "line_id")


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    n = int(os.environ.get("REPL", "10"))
    spark = get_session("local[8]", shuffle_partitions=16)
    class_coverage_job(event_log_lines(spark, sf_dir)).write.format("noop").mode("overwrite").save()
    out = {}
    for k in (1, n):
        lines = replicated(spark, sf_dir, k)
        cnt = lines.count()
        t0 = time.time()
        class_coverage_job(lines).write.format("noop").mode("overwrite").save()
        t1 = time.time()
        ig = ingest(lines, with_extractions=False)
        ig.cluster_templates.join(ig.cluster_lines, "cluster_id").write.format("noop").mode("overwrite").save()
        t2 = time.time()
        out[f"x{k}"] = {"lines": cnt, "coverage_lines_per_sec": round(cnt / (t1 - t0)),
                        "mining_lines_per_sec": round(cnt / (t2 - t1)),
                        "templates": ig.cluster_templates.count()}
    print(json.dumps(out))


if __name__ == "__main__":
    main()
