import re

from pyspark.sql import functions as F

from logweave.functions.masks import MASKS, mask_lines, render_extractions
from logweave.sources.lines import lines_from_strings
from logweave.sources.tables import document_lines, event_log_lines


def _mask(spark, lines):
    df = mask_lines(lines_from_strings(spark, lines)).orderBy("line_id")
    return [(r.processed, dict(r.extractions) if r.extractions is not None else None) for r in df.collect()]


def test_reference_unit_cases(spark):
    out = _mask(spark, [
        "Connection from 192.168.1.10 accepted",
        "[Sun Dec 04 04:47:44 2005] request received",
        "2024-01-15T10:30:00Z user logged in",
        "SSH connection on port 22 accepted",
        "Reading config from /etc/nginx/nginx.conf failed",
        "Request ID 550e8400-e29b-41d4-a716-446655440000 received",
        "pid 1234 started",
        "done",
        "Accepted password for alice from 192.168.1.10",
        "authentication failed for user root attempt=3",
        "password=secretvalue123",
    ])
    assert "<IP>" in out[0][0] and "192.168.1.10" in out[0][1]["IP"]
    assert "[<TIMESTAMP>]" in out[1][0] and "Sun Dec 04" not in out[1][0]
    assert "<DATETIME>" in out[2][0] and "2024-01-15" not in out[2][0]
    assert "port <PORT>" in out[3][0] and "port 22" not in out[3][0]
    assert "<PATH>" in out[4][0]
    assert "<UUID>" in out[5][0]
    assert "pid <PID>" in out[6][0]
    assert out[7][0] == "done"
    assert out[8][0] == "Accepted password for <USERNAME> from <IP>"
    assert out[8][1]["USERNAME"] == ["alice"]
    assert "user <USERNAME>" in out[9][0] and out[9][1]["USERNAME"] == ["root"]
    assert out[10][0] == "password <PASSWORD>"


def test_null_and_empty(spark):
    df = spark.createDataFrame([(0, None), (1, "")], "line_id bigint, line string")
    rows = {r.line_id: r for r in mask_lines(df).collect()}
    assert rows[0].processed is None and dict(rows[0].extractions) == {}
    assert rows[1].processed == "" and dict(rows[1].extractions) == {}


def test_mask_side_effects(spark):
    out = _mask(spark, ["see http://h/a/b now", "mac 00:11:22:33:44:55 up"])
    assert out[0][0] == "see http:/<PATH> now"          # path mask runs before URL mask
    assert out[1][0] == "mac <TIME>:<TIME> up"           # time mask runs before MAC mask


def _py_mask(line):
    """Brute force: the masks applied one by one with Python re."""
    ex = {}
    text = line
    for m in MASKS:
        pat = re.compile(m.pattern)

        def rep(mt, m=m):
            ex.setdefault(m.key, []).append(mt.group(m.group))
            return m.placeholder
        text = pat.sub(rep, text)
    return text, ex


def test_spark_equals_python_re_on_fixture_lines(spark, sf):
    for df in (event_log_lines(spark, sf), document_lines(spark, sf)):
        rows = mask_lines(df).select("line", "processed", "extractions").collect()
        assert rows
        for r in rows:  # non-ASCII lines included: no mask differs on the fixture texts
            text, ex = _py_mask(r.line)
            assert r.processed == text, r.line
            assert {k: list(v) for k, v in r.extractions.items()} == ex, r.line


def test_render_extractions(spark):
    df = mask_lines(lines_from_strings(spark, ["Accepted password for alice from 10.0.0.1 port 22"]))
    s = df.select(render_extractions(F.col("extractions")).alias("x")).first().x
    assert s == "IP=10.0.0.1;PORT=port 22;USERNAME=alice"
