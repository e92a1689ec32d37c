import difflib

import pytest
from pyspark.sql import functions as F

from logweave.functions.similarity import char_similarity_py, literal_similarity_py
from logweave.functions.tokens import apply_label, valid_label, wildcard_ratio
from logweave.operators.compile import compile_templates
from logweave.operators.matching import fast_path
from logweave.sources.lines import lines_from_strings

SSH_T = "Accepted <auth_protocol> for <user.name> from <src_endpoint.ip> port <dst_endpoint.port> ssh2"
SSH_LOG = "Accepted password for alice from 192.168.1.10 port 22 ssh2"


def _match(spark, templates, lines, threshold=0.85):
    tpl = spark.createDataFrame([(cid, t, i) for i, (cid, t) in enumerate(templates)],
                                "cluster_id string, labeled_template string, registry_seq long")
    r = fast_path(lines_from_strings(spark, lines), compile_templates(tpl), threshold=threshold)
    return {x.line_id: x for x in r.collect()}


def test_compile(spark):
    tpl = spark.createDataFrame([("1", SSH_T, 0), ("x", "<user.name> <src_endpoint.ip>", 1)],
                                "cluster_id string, labeled_template string, registry_seq long")
    c = {r.cluster_id: r for r in compile_templates(tpl).collect()}
    assert c["1"].literal_count == 5 and c["1"].literal_tokens == ["Accepted", "for", "from", "port", "ssh2"]
    assert [p for p in c["1"].label_paths if p] == ["auth_protocol", "user.name", "src_endpoint.ip", "dst_endpoint.port"]
    assert c["x"].literal_count == 0


def test_exact_near_none(spark):
    r = _match(spark, [("1", SSH_T)], [
        SSH_LOG,
        "Accepted password for alice from 192.168.1.10 on port 22 ssh2",
        "ERROR kernel: segfault at 0x00 ip 0x0",
        "Accepted password for alice from 10.0.0.1 port 22",
        "for alice port 22",
    ])
    assert r[0].match_kind == "EXACT" and r[0].cluster_id == "1"
    assert dict(r[0].matched_fields) == {"auth_protocol": "password", "user.name": "alice",
                                         "src_endpoint.ip": "192.168.1.10", "dst_endpoint.port": "22"}
    assert r[1].match_kind == "NEAR" and r[1].similarity == 1.0
    assert [r[i].match_kind for i in (2, 3, 4)] == ["NONE", "NONE", "NONE"]


def test_most_specific_wins_and_near_ranking(spark):
    r = _match(spark, [("gen", "Accepted <user.name>"), ("spec", SSH_T)], [SSH_LOG])
    assert r[0].cluster_id == "spec"
    r = _match(spark, [("a", "Accepted <auth_protocol> for <user.name> ssh2"), ("b", SSH_T)],
               ["Accepted password for alice from 10.0.0.1 on port 22 ssh2"], threshold=0.0)
    assert r[0].match_kind == "NEAR" and r[0].cluster_id == "b"


def test_duplicate_labels_last_wins(spark):
    r = _match(spark, [("d", "<user.name> logged in as <user.name>")], ["alice logged in as bob"])
    assert r[0].match_kind == "EXACT" and dict(r[0].matched_fields) == {"user.name": "bob"}


def test_no_literal_template_never_near(spark):
    r = _match(spark, [("x", "<user.name> <src_endpoint.ip>")], ["anything at all here"], threshold=0.0)
    assert r[0].match_kind == "NONE"


@pytest.mark.parametrize("lits,line,want", [
    (["Accepted", "for", "from", "port", "ssh2"], SSH_LOG, 1.0),
    (["xyz", "abc", "def"], "something completely different", 0.0),
    (["Accepted", "for", "xyz", "abc"], "Accepted something for alice", 0.5),
    ([], SSH_LOG, 0.0),
])
def test_literal_similarity(lits, line, want):
    assert literal_similarity_py(lits, line) == want


def test_char_similarity_matches_difflib():
    a, b = "Accepted <*> for <*>", "Accepted <*> from <*>"
    assert char_similarity_py(a, b) == difflib.SequenceMatcher(None, a, b).ratio()


@pytest.mark.parametrize("orig,lab,ok", [
    ("Accepted <*> for <*> from <*> port <*> ssh2",
     "Accepted <auth_protocol> for <user.name> from <src_endpoint.ip> port <dst_endpoint.port> ssh2", True),
    ("connect from <*> port <*>", "connect from <ip>", False),
    ("Accepted <*> for <*>", "Rejected <auth_method> for <user>", False),
    ("user <*> logged in", "user BOGUS logged in", False),
])
def test_valid_label(spark, orig, lab, ok):
    df = spark.createDataFrame([(orig, lab)], "o string, l string")
    row = df.select(valid_label(F.col("o"), F.col("l")).alias("v"), apply_label(F.col("o"), F.col("l")).alias("a")).first()
    assert row.v is ok
    assert row.a == (lab if ok else orig.replace("<*>", "<unknown>"))


def test_wildcard_ratio(spark):
    df = spark.createDataFrame([("a <*> <*> b",), ("",)], "t string")
    assert [r.w for r in df.select(wildcard_ratio(F.col("t")).alias("w")).collect()] == [0.5, 0.0]
