"""Log lines derived from the driver's test tables (stand-in input only).

The test tables hold no logs, so two renderings give rows in the ``log_lines`` schema
``(line_id BIGINT, arrival_ts TIMESTAMP, source STRING, line STRING)``:

* :func:`event_log_lines` — one line per ``events`` row, 35 line shapes of our own
  (logins, network, web, mail, storage), which between them fire every mask, every rule that
  can win and every event field. The same SQL text runs in Spark and DuckDB, so the
  oracle queries read identical input.
* :func:`document_lines` — ``documents.text`` split on newline, blank lines dropped;
  whole texts, every line. ``line_id = doc_id * 2^24 + position``.

These functions only shape input; no operator of the library runs here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINE_ID_DOC_SHIFT = 1 << 24

# Rendering of one events row as a log line (identical strings in Spark SQL and DuckDB).
EVENT_LINE_SQL = """case cast(event_id % 35 as int)
 when 0 then 'sshd['||(100+event_id%30000)||']: disconnect of user u'||user_id||' by gateway 172.16.'||(user_id%4)||'.'||(user_id%250)
 when 1 then '2024-03-01T10:'||(10+event_id%50)||':'||(10+user_id%50)||'Z unauthorized visit of u'||user_id||' at console '||(event_id%9)
 when 2 then 'switch learned 00:1a:2b:3c:4d:'||(10+event_id%90)||' on uplink '||(user_id%48)
 when 3 then 'request 7f3c9a10-5d2e-4b61-8333-'||(100000000000+event_id)||' finished in '||(event_id%900)||' steps'
 when 4 then 'proxy method=POST target https://shop.example.org/item/'||event_id||' branch '||(user_id%7)
 when 5 then 'mail to user'||user_id||'@example.org queued behind '||(event_id%40)||' others'
 when 6 then 'database pool opened connection to replica '||(user_id%3)||' on port '||(5000+user_id%9)
 when 7 then 'a daemon service '||event_type||(case when user_id%2=0 then ' started' else ' stopped' end)||' by operator'
 when 8 then 'rejected password=k'||event_id||' typed at terminal '||(user_id%20)
 when 9 then 'rotated /srv/data/'||user_id||'/part.log holding '||(event_id%512)||' rows'
 when 10 then 'firewall noted new connection from 198.51.100.'||(user_id%250)||' toward 10.9.0.'||(event_id%250)
 when 11 then 'backup of volume '||(user_id%16)||' wrote '||(event_id*64)||' blocks'
 when 12 then 'sshd accepted key '||(event_id%70)||' of holder u'||user_id
 when 13 then 'sshd failed key '||(event_id%70)||' check of holder u'||user_id
 when 14 then 'cache method=GET page '||(event_id%300)||' warm'
 when 15 then 'query on shelf '||(user_id%30)||' took '||(event_id%50)||' ticks'
 when 16 then 'database session '||(event_id%200)||' released by replica '||(user_id%3)
 when 17 then 'badge reader says user u'||user_id||' authenticated'
 when 18 then 'spawned helper '||(event_id%60)||' for queue '||(user_id%5)
 when 19 then 'upstream said status=5'||(10+event_id%10)||' after '||(user_id%8)||' hops'
 when 20 then 'CRITICAL fan '||(user_id%12)||' slowed to '||(event_id%3000)||' turns'
 when 21 then 'Mon Jan '||(10+event_id%20)||' 08:15:'||(10+user_id%50)||' 2024 door '||(event_id%50)||' opened'
 when 22 then '[Abc Xyz '||(10+event_id%20)||' 09:30:'||(10+user_id%50)||' 2024] relay '||(user_id%9)||' armed'
 when 23 then '2024.05.'||(10+event_id%20)||' 11:22:'||(10+user_id%50)||' probe '||(event_id%40)||' awake'
 when 24 then 'clock read 12:'||(10+event_id%50)||':'||(10+user_id%50)||' on tower '||(user_id%6)
 when 25 then 'neighbor fe80:0:0:0:202:b3ff:fe1e:'||(1000+event_id%9000)||' joined ring '||(user_id%4)
 when 26 then 'authentication failed for holder'||user_id||' from 192.0.2.'||(event_id%250)||' to 198.51.100.'||(user_id%250)||' port '||(2000+event_id%500)
 when 27 then '10.1.2.'||(event_id%250)||' asked 10.9.8.'||(user_id%250)||' "GET /shelf/'||(event_id%90)||' HTTP/1.1" 200 '||(500+event_id%4000)
 when 28 then 'a query took table='||event_type||' database=shop'||(user_id%5)||' user=clerk'||user_id||' host=db'||(user_id%3)||'.local rows='||(event_id%700)||' duration='||(event_id%90)||'ms'
 when 29 then 'worker pid='||(100+event_id%9000)||' nested deep'
 when 30 then 'fault at 0x00'||(1000+event_id%9000)||' of build 00112233445566778899 in ring '||(user_id%9)
 when 31 then 'fetch http://shop.example.org?item='||event_id||' came late'
 when 32 then 'ticket '||(10000000+event_id)||' printed at desk '||(user_id%12)
 when 33 then 'client called DELETE /api/{id} for basket '||(event_id%30)
 else 'login success for guest'||user_id||' at kiosk '||(event_id%9) end"""

# DuckDB views over the same inputs (the oracle registers the raw tables as views).
EVENT_LINES_SQL = (f"SELECT event_id AS line_id, ts AS arrival_ts, event_type AS source, "
                   f"{EVENT_LINE_SQL} AS line FROM events")

DOCUMENT_LINES_SQL = (
    "SELECT doc_id * 16777216 + pos AS line_id, doc_id, pos, source, line FROM ("
    " SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,"
    " unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents)"
    " WHERE regexp_matches(line, '\\S')")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_parallelism(df: DataFrame, *keys) -> DataFrame:
    """Deal a scan evenly over at least four tasks a core.

    The work per line (masks, rules, event extraction) is CPU-bound and a scan's tasks are as
    uneven as the files' row groups: a file of one group is one task that has rows and many
    that have none. Hash partitioning keeps the layout deterministic for task retries; ``keys``
    tell all unlike rows apart, so rows that share an id are dealt out too.
    """
    n = max(df.rdd.getNumPartitions(), 4 * df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


def event_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = ensure_parallelism(table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type"),
                            "event_id", "ts", "user_id", "event_type")
    return ev.select(
        F.col("event_id").alias("line_id"),
        F.col("ts").alias("arrival_ts"),
        F.col("event_type").alias("source"),
        F.expr(EVENT_LINE_SQL).alias("line"),
    )


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ensure_parallelism(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "doc_id", F.xxhash64("text"))
    x = docs.select("doc_id", "source", F.posexplode(F.split(F.col("text"), "\n", -1)).alias("pos", "line"))
    return (x.where(F.col("line").rlike(r"\S"))
            .select((F.col("doc_id") * F.lit(LINE_ID_DOC_SHIFT) + F.col("pos")).alias("line_id"),
                    "doc_id", F.col("pos").cast("bigint").alias("pos"), "source", "line"))
