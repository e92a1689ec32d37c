"""Steps that decide how queries grow: each gives the plain form's rows."""

import random
import re

from pyspark.sql import functions as F

from logweave.functions import masks as M
from logweave.sources.rules import DEFAULT_RULES, RULE_WORDS


def _pieces(seed, n, parts):
    rng = random.Random(seed)
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(n)] + ["", None]


def test_guarded_masks_equal_the_plain_chain(spark):
    parts = ["Mon Jan 10 08:15:42 2024", "[Abc Xyz 1 09:30:11 2024]", "2024-03-01T10:11:12.5Z", "2024.05.10  11:22:33", "12:13:14", "a:b:c:d:e:f:a:b", "fe80:0:0:0:202:b3ff:fe1e:1",
             "10.1.2.3", "00:1a:2b:3c-4d:90", "7f3c9a10-5d2e-4b61-8333-100000000000", "00112233445566778899", "port=22", "port 8080", "for bob from", "for a.b  at", "user=ann", "user x1",
             "password=k1", "pid=7", "pid 9", "0x00ff1", "/a/b.c", "http://h.x/y", "https://z", "a.b@c.de", "1234567", "15ms", "3.5KB", "7B", " ", " ", " ", ":", "/", "-", "é", "\t", "x"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(_pieces(1, 3000, parts))], "line_id long, line string")
    plain, found = F.col("line"), []
    for m in M.MASKS:
        assert m.needs or m.hint
        found.append(F.coalesce(F.size(F.regexp_extract_all(plain, F.lit(m.pattern), F.lit(0))) > 0, F.lit(False)))
        plain = F.regexp_replace(plain, F.lit(m.pattern), F.lit(M._java_replacement(m.placeholder)))
    x = M.mask_lines(M.mask_only(df, out_col="only")).withColumn("plain", plain)
    assert x.where(~F.col("only").eqNullSafe(F.col("plain")) | ~F.col("processed").eqNullSafe(F.col("plain"))).count() == 0
    assert all(x.select(*[F.max(f.cast("int")) for f in found]).first())     # every mask was met
    old = tuple(M.Mask(m.name, m.pattern, m.placeholder, m.key, m.group) for m in M.MASKS)
    a = M.mask_lines(df).select("line_id", M.render_extractions(F.col("extractions")).alias("x"))
    b = M.mask_lines(df, masks=old).select("line_id", M.render_extractions(F.col("extractions")).alias("x"))
    assert a.exceptAll(b).count() == 0


def test_rule_words_leave_out_no_match(spark):
    from logweave.operators.normalize import label_column

    assert set(RULE_WORDS) == {r.pattern for r in DEFAULT_RULES}
    parts = ["/api/", "/V2/", "login", "POST /v1/", "DELETE /api/", "sshd", "ssh ", "accepted ", "password for", "Failed ", "disconnect", "connection closed by ", "port", '"GET /', "method=post", "GET ",
             "HTTP/1.1\" 404", "status=500", " 503 error", "db ", "database ", "Connection ", "connecting to ", "opened", "released", "executing ", "query ", "took", "SELECT a FROM", "insert into", "update x set",
             "auth ", "authentication failed", "authentication succeeded", "failure", "success", "login success", "user u authenticated", "service ", "started", "stopping", "systemd ", "established", "new ",
             "connect from", "spawned", "child process", "pid=4", "pid 8", "ERROR", "Fatal", "İ", "ſ", " ", " "]
    df = spark.createDataFrame([(x,) for x in _pieces(2, 4000, parts)], "t string")
    want = F.coalesce(*[F.when(F.col("t").rlike("(?i)" + r.pattern), F.lit(i + 1)) for i, r in enumerate(DEFAULT_RULES)])
    x = df.select(label_column(F.col("t"))["rule_order"].alias("got"), want.alias("want"))
    assert x.where(~F.col("got").eqNullSafe(F.col("want"))).count() == 0
    assert x.select("want").distinct().count() > 15


def test_one_row_group_is_dealt_evenly(spark, tmp_path):
    from logweave.sources.tables import document_lines, event_log_lines

    ev = spark.range(4000).select(F.lit(None).cast("long").alias("event_id"), F.col("id").alias("ts_id"), (F.col("id") % 50).alias("user_id"), F.lit("a").alias("event_type"))
    ev = ev.select("event_id", F.timestamp_seconds("ts_id").alias("ts"), "user_id", "event_type")
    ev.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    spark.range(400).select((F.col("id") * 0).alias("doc_id"), F.lit("s").alias("source"), F.concat(F.lit("a\nb"), "id").alias("text")).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    for lines in (event_log_lines(spark, str(tmp_path)), document_lines(spark, str(tmp_path))):
        sizes = [r["count"] for r in lines.groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) < 0.3 * sum(sizes)


def test_joined_near_match_equals_the_index(spark, monkeypatch):
    from logweave.operators import near
    from logweave.operators.compile import compile_templates
    from logweave.operators.matching import near_match, strict_match

    rng = random.Random(3)
    words = ["a", "bb", "ccc", "d", "ee", "f1", "gg", "<*>", "<ip>", "é"]
    tpl = [(str(i % 70), " ".join(rng.choice(words) for _ in range(rng.randint(0, 9))), i % 11) for i in range(120)] + [("x", "a bb <*> ccc", 1), ("y", "a bb <ip> ccc", 0)]
    comp = compile_templates(spark.createDataFrame(tpl, "cluster_id string, labeled_template string, registry_seq long"))
    lines = [" ".join(rng.choice(words) + rng.choice(["", "", "x"]) for _ in range(rng.randint(0, 12))) for _ in range(200)] + [None, "", "a bb q ccc", "a bb q ccc"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "line_id long, line string")
    for s in (0.85, 0.5):
        want = near_match(df, comp, threshold=s).collect()
        got = near_match(df, comp, threshold=s, shard=3).collect()
        with monkeypatch.context() as m:
            m.setattr(near, "_shards", None)                # nothing is broadcast
            assert len(near_match(df, comp, threshold=s, shard=3).collect()) == len(lines)
        assert {(r.line_id, r.near_cluster_id, r.similarity) for r in got} == {(r.line_id, r.near_cluster_id, r.similarity) for r in want}
        assert sum(r.similarity is not None for r in want) > 20
    a = strict_match(df, comp).select("line_id", "exact_literal_count").collect()
    b = strict_match(df, comp, max_broadcast_templates=0).select("line_id", "exact_literal_count").collect()
    assert sorted(a, key=str) == sorted(b, key=str)


def test_micro_batch_is_dealt_out(spark, tmp_path, monkeypatch):
    from logweave.plans import ingest as plan
    from logweave.streaming.ingest import LINE_SCHEMA, stream_ingest

    rows = spark.range(600).select(F.col("id").alias("line_id"), F.timestamp_seconds("id").alias("arrival_ts"), F.lit("s").alias("source"), F.concat(F.lit("job "), F.col("id") % 3, F.lit(" done")).alias("line"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    sizes, real = [], plan.ingest
    monkeypatch.setattr(plan, "ingest", lambda batch, **kw: (sizes.extend(r["count"] for r in batch.groupBy(F.spark_partition_id()).count().collect()), real(batch, **kw))[1])
    stream_ingest(spark.readStream.schema(LINE_SCHEMA).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/ckpt").awaitTermination()
    assert sum(sizes) == 600 and max(sizes) < 300
    assert spark.read.parquet(f"{tmp_path}/out").count() == 600


def test_template_is_hashed_down_to_unlike_tokens_first(spark):
    from logweave.operators.mining import template_of_cluster

    df = spark.createDataFrame([("k", f"a {i} c") for i in range(50)] + [("k", "a 1 c"), ("l", "x"), ("m", "")], "cluster_id string, processed string")
    t = template_of_cluster(df)
    assert {(r.cluster_id, r.template, r.token_count) for r in t.collect()} == {("k", "a <*> c", 3), ("l", "x", 1)}
    plan = t._jdf.queryExecution().sparkPlan().toString()
    assert re.search(r"HashAggregate\(keys=\[[^\]]*pos#\d+, tok#\d+\], functions=\[\]", plan)


def test_tokens_and_bare_ends_equal_python(spark):
    from logweave.functions.tokens import bare, tokens

    rng = random.Random(5)
    odd = [*"\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0       　", "​", "\x00", "\x7f", "é", "😀"]
    texts = ["".join(rng.choice(odd if rng.random() < 0.4 else [" ", "a", "x~", "\n"]) for _ in range(rng.randint(0, 7))) for _ in range(3000)] + [None, "", " ", "a b", "\n"]
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    got = df.select("t", tokens(F.col("t")).alias("k"), bare(F.col("t")).alias("b"))
    for r in got.collect():
        assert r.k == (None if r.t is None else r.t.split()) and r.b == (None if r.t is None else r.t == r.t.strip())
    # printable ASCII is cut without a regex over the white space of all scripts
    assert "rlike" in got._jdf.queryExecution().optimizedPlan().toString().lower()


def test_templates_group_differences_not_tokens(spark):
    """200 equal rows of 30 tokens: what is grouped are the 30 positions, one time."""
    from logweave.operators.mining import template_of_cluster

    rows = [("k", " ".join(["a"] * 29 + [str(i % 2)])) for i in range(200)] + [("k", "a b"), (None, "x y"), (None, "x z"), ("e", ""), ("n", None)]
    t = template_of_cluster(spark.createDataFrame(rows, "cluster_id string, processed string"))
    assert {(r.cluster_id, r.template) for r in t.collect()} == {("k", " ".join(["a", "<*>", *["a"] * 27, "<*>"])), (None, "x <*>")}
    plan = t._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and plan.count("explode(") == 2


def _writes(monkeypatch, module):
    """Counts the tables that ``module`` writes."""
    seen, real = [], module.cut_lineage
    monkeypatch.setattr(module, "cut_lineage", lambda df: (seen.append(df.columns), real(df))[1])
    return seen


def test_event_lines_are_masked_once(spark, tmp_path, monkeypatch):
    from logweave.plans import catalog

    ev = spark.range(300).select(F.col("id").alias("event_id"), F.timestamp_seconds("id").alias("ts"), (F.col("id") % 50).alias("user_id"), F.lit("a").alias("event_type"))
    ev.write.parquet(f"{tmp_path}/events.parquet")
    seen = _writes(monkeypatch, catalog)
    _, keyed, t = catalog._kg_template_table(spark, str(tmp_path))
    assert any("processed" in c and "key" in c for c in seen)
    for df in (keyed, t):
        assert "regexp_replace" not in df._jdf.queryExecution().optimizedPlan().toString()
    seen.clear()
    catalog._key_templates(spark, str(tmp_path))
    assert any("processed" in c and "key" in c for c in seen)


def test_joined_candidates_equal_trying_every_template(spark, monkeypatch):
    from logweave.operators import near
    from logweave.operators.compile import compile_templates
    from logweave.operators.matching import loose_candidates

    rng = random.Random(7)
    words = ["a", "bb", "abc", "bcdefgh", "bcdefghij", "é", "éa", "<*>", "<ip>", "x" * 300 + "abc", "zabc"]
    tpl = [(str(i), " ".join(rng.choice(words) for _ in range(rng.randint(0, 4))), i % 11) for i in range(90)] + [("x", "x" * 260, 1), ("y", "abc", 0), ("y", "abc", 0)]
    comp = compile_templates(spark.createDataFrame(tpl, "cluster_id string, labeled_template string, registry_seq long"))
    lines = [rng.choice([" ", "\t", " "]).join(rng.choice(words) + rng.choice(["", "", "qabcdefghijk"]) for _ in range(rng.randint(0, 7))) for _ in range(150)] + [None, "", "abc", "abc", "xx" * 150]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "line_id long, line string")
    rows = comp.where("literal_count > 0").select("cluster_id", "literal_tokens", "literal_count", "registry_seq").collect()
    rows.sort(key=lambda r: (-r.literal_count, r.registry_seq, r.cluster_id))
    want = {i: [r.cluster_id for r in rows if x is not None and near.in_order(r.literal_tokens, x)] for i, x in enumerate(lines)}
    assert {r.line_id: r.loose_ids for r in loose_candidates(df, comp).collect()} == want
    with monkeypatch.context() as m:
        m.setattr(near, "_shards", None)                    # nothing is broadcast
        assert {r.line_id: r.loose_ids for r in loose_candidates(df, comp, shard=3).collect()} == want
        got = loose_candidates(df, comp, shard=3, ids=False).collect()
    assert {r.line_id: (r.n_loose, r.first_loose) for r in got} == {i: (len(x), x[0] if x else None) for i, x in want.items()}
    assert len(got) == len(lines) and sum(map(len, want.values())) > 500


def test_folds_of_small_keys_are_dealt_out(spark):
    from logweave.operators.mining import mine_templates

    lines = spark.range(4000).select(F.col("id").alias("line_id"), F.concat_ws(" ", F.concat(F.lit("k"), F.char((F.col("id") % 40) + 97)), F.col("id").cast("string"), F.lit("é x")).alias("processed"))
    out = mine_templates(lines, bucket_rows=100)
    rows = out.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in rows) == 4000
    assert len(rows) >= 15 and max(r["count"] for r in rows) <= 1000


def test_one_line_is_compared_in_one_call_as_in_many():
    import numpy as np

    from logweave.operators import mining

    rng, state = np.random.default_rng(4), mining.Templates(6)
    for i in range(300):
        state.put(i, rng.integers(-1, 4, 6).astype(np.int32))
    lines = rng.integers(0, 5, (200, 6)).astype(np.int32)
    at, top = state.best(lines)
    for line, a, t in zip(lines, at, top):
        a1, t1 = state.best(line[None, :])
        assert (a1[0], t1[0]) == (a, t)


def test_texts_with_blanks_alone_need_no_regex_to_be_cut(spark):
    from logweave.functions import tokens as T

    rows = [(c, f"a{chr(c)}b{chr(c)}") for c in [*range(1, 0xD800), *range(0xE000, 0x10000), 0x10000, 0x1F600, 0x10FFFF]]
    got = spark.createDataFrame(rows, "c int, t string").select("c", "t", T.tokens(F.col("t")).alias("x"), T.bare(F.col("t")).alias("bare"), F.col("t").rlike(T.ODD).alias("odd")).collect()
    assert [r.c for r in got if r.x != r.t.split() or r.bare != (r.t == r.t.strip())] == []
    assert not [r.c for r in got if r.odd and r.c > 0xA0 and not chr(r.c).isspace()]


def test_lines_masked_once_give_the_same_results(spark, sf):
    from logweave.plans.ingest import ingest
    from logweave.sources.tables import event_log_lines

    lines = event_log_lines(spark, sf)
    once, twice = (ingest(lines, with_extractions=False, mask_once=m).results.drop("extractions", "matched_fields") for m in (True, False))
    assert once.exceptAll(twice).count() == twice.exceptAll(once).count() == 0
    assert "regexp_replace" not in once._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" in twice._jdf.queryExecution().optimizedPlan().toString()


def test_lines_of_a_large_registry_are_searched_where_they_are(spark, monkeypatch):
    """No pair of a line and a template is shuffled: the registry is mapped."""
    import difflib

    from logweave.operators import near, store
    from logweave.operators.compile import compile_templates
    from logweave.operators.matching import loose_candidates, near_match

    rng = random.Random(17)
    long = "https://a.example.org/shelf/" + "q" * 40
    words = ["a", "bb", "abc", "bcdefgh", "é", "😀x", "<*>", "<ip>", "x" * 90 + "end", long + "/1", long + "/2", "z" * 17, "ab\u200bc"]
    tpl = [(str(i), " ".join(rng.choice(words) for _ in range(rng.randint(0, 8))), i % 7 or None) for i in range(200)] + [("d", "a bb", 3), ("c", "a bb", 3), ("e", "a bb", 9)]
    comp = compile_templates(spark.createDataFrame(tpl, "cluster_id string, labeled_template string, registry_seq long"))
    lines = [rng.choice([" ", "\t", "\xa0", "  "]).join(rng.choice(["", "", "y", "zz"]) + rng.choice(words) + rng.choice(["", "", "q"]) for _ in range(rng.randint(0, 10))) for _ in range(250)] + [None, "", "a bb", "a bb"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "line_id long, line string")
    rows = [(r.cluster_id, r.literal_tokens, r.registry_seq or 0) for r in comp.where("literal_count > 0").collect()]
    rows.sort(key=lambda r: (-len(r[1]), r[2], r[0]))
    holds = {i: [r for r in rows if x is not None and near.in_order(r[1], x)] for i, x in enumerate(lines)}
    monkeypatch.setattr(store, "PART", 50)
    got = loose_candidates(df, comp, shard=3, ids=False)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    assert {r.line_id: (r.n_loose, r.first_loose) for r in got.collect()} == {i: (len(x), x[0][0] if x else None) for i, x in holds.items()}
    assert sum(map(len, holds.values())) > 500
    # what a worker remembers may be dropped and learnt anew
    one = store.Store(store.write(near._registry(comp), 500))
    monkeypatch.setattr(store, "TOKENS", 5)
    monkeypatch.setattr(store, "HELD", 20)
    for i, x in enumerate(lines):
        if x is not None:
            one.learn([x])
            assert one.loose(x) == (len(holds[i]), holds[i][0][0] if holds[i] else None)
    for th in (0.85, 0.4):
        want = {}
        for i, some in holds.items():
            best = (None, None)
            for cid, lits, _ in some:
                blocks = difflib.SequenceMatcher(None, lits, lines[i].split(), autojunk=False).get_matching_blocks()
                score = sum(b.size for b in blocks) / len(lits)
                if score >= th and (best[1] is None or score > best[1]):
                    best = (cid, score)
            want[i] = best
        got = near_match(df, comp, threshold=th, shard=3)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Exchange" not in plan
        assert {r.line_id: (r.near_cluster_id, r.similarity) for r in got.collect()} == want
        assert sum(x[0] is not None for x in want.values()) > 20


def test_registry_without_a_mapped_folder_is_joined(spark, monkeypatch):
    from logweave.operators import store
    from logweave.operators.compile import compile_templates
    from logweave.operators.matching import loose_candidates

    comp = compile_templates(spark.createDataFrame([("1", "a <*> b", 1), ("2", "b", 2)], "cluster_id string, labeled_template string, registry_seq long"))
    df = spark.createDataFrame([(1, "xa yb"), (2, "b"), (3, "c")], "line_id long, line string")
    monkeypatch.setattr(store, "checkpoint_dir", lambda s: "s3a://bucket/x")
    assert sorted((r.line_id, r.n_loose, r.first_loose) for r in loose_candidates(df, comp, shard=1, ids=False).collect()) == [(1, 2, "1"), (2, 1, "2"), (3, 0, None)]


def test_pieces_of_leads_are_windows_of_their_tokens():
    from logweave.operators import store

    rng = random.Random(9)
    toks = ["".join(rng.choice("abé😀") for _ in range(rng.randint(1, 80))) for _ in range(60)]
    seen = {}
    for h, own in store.windows(toks):
        for x, i in zip(h.tolist(), own.tolist()):
            seen.setdefault(i, set()).add(x)
    for i, t in enumerate(toks):
        for _ in range(20):
            a = rng.randrange(len(t))
            assert store.piece(t[a:rng.randint(a + 1, len(t))]) in seen[i]


def test_clusters_of_one_text_are_not_grouped_by_position(spark, tmp_path):
    """Their text is the template: their tokens are neither exploded nor shuffled."""
    from logweave.operators import mining

    rows = [(f"k{i}", " ".join(f"w{i}_{j}" for j in range(50)), i) for i in range(40)] + [("two", "a b  c", 7), ("two", "a x c", 5), ("two", "a b", None), ("z", None, 1), ("e", " ", 2), ("n", "p q", None)]
    df = spark.createDataFrame(rows, "cluster_id string, processed string, line_id long")
    t = mining.template_of_cluster(df, least="line_id", written=True)
    want = {(f"k{i}", rows[i][1], 50, i) for i in range(40)} | {("two", "a <*> c", 3, 5), ("n", "p q", 2, None)}
    assert {(r.cluster_id, r.template, r.token_count, r.line_id) for r in t.collect()} == want
    plain = mining.template_of_cluster(df)
    assert {(r.cluster_id, r.template, r.token_count) for r in plain.collect()} == {x[:3] for x in want}
    # the rows that are exploded come from the cluster that varies
    plan = plain._jdf.queryExecution().optimizedPlan().toString()
    assert all("varies" in part for part in plan.split("Generate ")[1:])


def test_strict_lookup_shuffles_texts(spark):
    """What meets by token count and first token is the templates' texts; arrays are made behind."""
    from logweave.operators.compile import compile_templates
    from logweave.operators.matching import strict_match, templates_by_token_count

    comp = compile_templates(spark.createDataFrame([("1", "a <x> b", 1), ("2", "a c b", 2), ("3", "<*> c <y>", 3), ("4", "a <x> <x>", 0), ("5", "", 9), ("6", "a <x", 1)], "cluster_id string, labeled_template string, registry_seq long"))
    plan = templates_by_token_count(comp)._jdf.queryExecution().optimizedPlan().toString()
    assert "lits" not in plan.split("Aggregate", 1)[1].split("\n", 1)[1]       # below the grouping
    df = spark.createDataFrame([(1, "a q b"), (2, "a c b"), (3, "z c w"), (4, "a q r"), (5, ""), (6, "a <x"), (7, None), (8, " a c b"), (9, "a  <x>\tb")], "line_id long, line string")
    want = {1: ("1", {"x": "q"}), 2: ("2", {}), 3: ("3", {"y": "w"}), 4: ("4", {"x": "r"}), 5: ("5", {}), 6: ("6", {}), 7: (None, None), 8: (None, None), 9: ("1", {"x": "<x>"})}
    for most in (200_000, 0):
        assert {r.line_id: (r.exact_cluster_id, r.matched_fields) for r in strict_match(df, comp, max_broadcast_templates=most).collect()} == want
