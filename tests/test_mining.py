from pyspark.sql import functions as F

from logweave.functions.masks import mask_only
from logweave.operators.mining import change_points, cluster_name, fold_group, mine_templates, template_of_cluster
from logweave.plans.ingest import ingest
from logweave.sources.lines import lines_from_strings
from logweave.sources.tables import event_log_lines

EXPECTED_EVENT_TEMPLATES = {
    "<*> disconnect of user <USERNAME> by gateway <IP>",
    "<DATETIME> probe <*> awake",
    "<DATETIME> unauthorized visit of <*> at console <*>",
    "<IP> asked <IP> \"GET <PATH> HTTP/1.1\" 200 <*>",
    "<TIMESTAMP> door <*> opened",
    "CRITICAL fan <*> slowed to <*> turns",
    "[<TIMESTAMP>] relay <*> armed",
    "a daemon service <*> <*> by operator",
    "a query took <*> <*> user <USERNAME> <*> <*> duration=<SIZE>",
    "authentication failed for <USERNAME> from <IP> to <IP> port <PORT>",
    "backup of volume <*> wrote <*> blocks",
    "badge reader says user <USERNAME> authenticated",
    "cache method=GET page <*> warm",
    "client called DELETE /api/{id} for basket <*>",
    "clock read <TIME> on tower <*>",
    "database pool opened connection to replica <*> on port <PORT>",
    "database session <*> released by replica <*>",
    "fault at <ADDR> of build <HEX> in ring <*>",
    "fetch <URL> came late",
    "firewall noted new connection from <IP> toward <IP>",
    "login success for <USERNAME> at kiosk <*>",
    "mail to <EMAIL> queued behind <*> others",
    "neighbor <IPV6> joined ring <*>",
    "proxy method=POST target https:/<PATH> branch <*>",
    "query on shelf <*> took <*> ticks",
    "rejected password <PASSWORD> typed at terminal <*>",
    "request <UUID> finished in <*> steps",
    "rotated <PATH> holding <*> rows",
    "spawned helper <*> for queue <*>",
    "sshd accepted key <*> of holder <*>",
    "sshd failed key <*> check of holder <*>",
    "switch learned <MAC> on uplink <*>",
    "ticket <NUM> printed at desk <*>",
    "upstream said <*> after <*> hops",
    "worker pid <PID> nested deep",
}


def brute_force_fold(texts, sim_th=0.4):
    """Sequential fold over every line in order (repeats included): the reference model."""
    groups = {}
    out = []
    for t in texts:
        toks = t.split()
        first = toks[0] if toks else ""
        key = (len(toks), "<*>" if any(c.isdigit() for c in first) else first)
        clusters = groups.setdefault(key, [])
        best, best_sim, best_par = None, -1.0, -1
        for c in clusters:
            sim = sum(1 for a, b in zip(c["tpl"], toks) if a != "<*>" and a == b) / max(len(toks), 1)
            par = sum(1 for a in c["tpl"] if a == "<*>")
            if sim > best_sim or (sim == best_sim and par > best_par):
                best, best_sim, best_par = c, sim, par
        if best is not None and (best_sim >= sim_th or not toks):
            new = [a if a == b else "<*>" for a, b in zip(best["tpl"], toks)]
            kind = "UPDATE" if new != best["tpl"] else "NONE"
            best["tpl"] = new
        else:
            best = {"tpl": list(toks), "id": (key, len(clusters))}
            clusters.append(best)
            kind = "CREATE"
        out.append((best["id"], kind))
    finals = {" ".join(c["tpl"]) for cs in groups.values() for c in cs}
    return out, finals


def test_fold_group_basic():
    ords, finals = fold_group([["a", "b", "c"], ["a", "x", "c"], ["q", "r", "s"]], 0.4)
    assert list(ords) == [0, 0, 1] and finals[0] == ["a", "<*>", "c"]


def test_event_templates_equal_expected_and_brute_force(spark, sf):
    lines = mask_only(event_log_lines(spark, sf))
    for gl in (20000, 7):  # single fold, and the hot-key split path
        out = ingest(event_log_lines(spark, sf), with_extractions=False, group_lines=gl)
        got = {r.template for r in out.cluster_templates.collect()}
        assert got == EXPECTED_EVENT_TEMPLATES, gl
    rows = lines.orderBy("line_id").select("line_id", "processed").collect()
    bf, finals = brute_force_fold([r.processed for r in rows])
    assert finals == EXPECTED_EVENT_TEMPLATES
    res = {r.line_id: r for r in ingest(event_log_lines(spark, sf), with_extractions=False).results.collect()}
    # same partition of lines into clusters and the same change types
    ids = {}
    for r, (cid, kind) in zip(rows, bf):
        ids.setdefault(cid, set()).add(res[r.line_id].cluster_id)
        assert res[r.line_id].change_type == kind, r.processed
    assert all(len(v) == 1 for v in ids.values())


def test_every_line_fits_its_template(spark, sf):
    out = ingest(event_log_lines(spark, sf), with_extractions=False)
    for r in out.results.select("processed", "template").collect():
        a, b = r.processed.split(), r.template.split()
        assert len(a) == len(b) and all(y == "<*>" or x == y for x, y in zip(a, b))


def test_partition_count_independent(spark, sf):
    base = mine_templates(mask_only(event_log_lines(spark, sf))).select("text", "cluster_id")
    again = mine_templates(mask_only(event_log_lines(spark, sf).repartition(7))).select("text", "cluster_id")
    assert sorted(base.collect()) == sorted(again.collect())


def test_seeds_keep_their_ids(spark):
    lines = lines_from_strings(spark, ["user alice logged in", "user bob logged in"])
    seeds = spark.createDataFrame([("s1", "user <*> logged in")], "cluster_id string, template string")
    m = mine_templates(lines.withColumnRenamed("line", "processed"), seeds=seeds)
    assert {r.cluster_id for r in m.collect()} == {"s1"}
    lc, vers = change_points(m, seeds)
    assert {r.change_type for r in lc.collect()} == {"NONE"}
    assert vers.count() == 0


def test_template_of_cluster(spark):
    df = spark.createDataFrame([("c", "a b c"), ("c", "a x c"), ("d", "z")], "cluster_id string, processed string")
    got = {r.cluster_id: r.template for r in template_of_cluster(df).collect()}
    assert got == {"c": "a <*> c", "d": "z"}


def _shapes(n, shapes, width, seed):
    """Distinct lines of one key: shapes of fixed words, some of which a line replaces."""
    import random

    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "bcdfghklmnprst" for b in ("a", "e", "i", "o", "u", "ar", "en", "is")]
    kinds = [[rng.choice(words) for _ in range(width)] for _ in range(shapes)]
    out, i = {}, 0
    while len(out) < n:
        # later lines use more of the shapes, so clusters are created all along
        kind = rng.choice(kinds[:3 + len(out) * shapes // n])
        toks = [w if rng.random() < 0.72 else rng.choice(words) + (str(i) if rng.random() < 0.5 else "") for w in kind]
        out[" ".join(["evt", *toks])] = None
        i += 1
    return list(out)


def _names(texts):
    """Cluster id per line by the sequential fold."""
    bf, _ = brute_force_fold(texts)
    made = {}
    for i, (t, (c, _)) in enumerate(zip(texts, bf)):
        made.setdefault(c, cluster_name(i, t))
    return {t: made[c] for t, (c, _) in zip(texts, bf)}


def _numbered(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "line_id long, processed string").repartition(5)


def test_large_key_equals_the_sequential_fold(spark):
    texts = _shapes(1500, 60, 7, 1)
    want = _names(texts)
    assert len(set(want.values())) > 100
    for group_lines, step in ((5000, 5000), (200, 1000), (90, 250)):
        got = {r.text: r.cluster_id for r in mine_templates(_numbered(spark, texts), group_lines=group_lines, step=step).collect()}
        assert got == want, (group_lines, step)
    m = mine_templates(_numbered(spark, texts), group_lines=90, step=300)
    lc, _ = change_points(m)
    kinds = {r.text: r.change_type for r in lc.collect()}
    assert kinds == {t: k for t, (_, k) in zip(texts, brute_force_fold(texts)[0])}


def test_settings_do_not_matter_on_fifty_thousand_lines_of_one_key(spark):
    texts = _shapes(50_000, 40, 8, 2)
    ords, finals = fold_group([t.split() for t in texts], 0.4)
    made = {}
    for i, o in enumerate(ords):
        made.setdefault(o, cluster_name(i, texts[i]))
    want = {t: made[o] for t, o in zip(texts, ords)}
    lines = _numbered(spark, texts)
    for group_lines, step in ((20_000, 5_000), (9_000, 2_000)):
        got = {r.text: r.cluster_id for r in mine_templates(lines, group_lines=group_lines, step=step).collect()}
        assert got == want, group_lines
    assert len(finals) > 50


def test_two_batches_equal_one_run(spark):
    """The second batch starts from the clusters of the first; ids are those of the creating lines."""
    texts = _shapes(1200, 40, 6, 3)
    want = _names(texts)
    lines = _numbered(spark, texts)
    for cut, group_lines in ((700, 5000), (500, 60)):
        one = mine_templates(lines.where(F.col("line_id") < cut), group_lines=group_lines)
        _, vers = change_points(one)
        made = one.groupBy("cluster_id").agg(F.min("first_line_id").alias("created"))
        seeds = vers.groupBy("cluster_id").agg(F.max_by("template", "version").alias("template")).join(made, "cluster_id")
        two = mine_templates(lines.where(F.col("line_id") >= cut), seeds=seeds, group_lines=group_lines)
        got = {r.text: r.cluster_id for r in one.union(two).collect()}
        assert got == want


def test_odd_lines_and_empty_input(spark):
    texts = ["", " ", "a", "1 x", "2 x", "<*> x", "a b c", "a b c d", "a b c", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "line_id long, processed string")
    got = {r.text: (r.cluster_id, r.n) for r in mine_templates(rows).collect()}
    assert got["1 x"][0] == got["2 x"][0] == got["<*> x"][0] and got["a b c"][1] == 2 and len(got) == 9
    for group_lines in (1, 2):
        assert {r.text: (r.cluster_id, r.n) for r in mine_templates(rows, group_lines=group_lines).collect()} == got
    assert mine_templates(rows.limit(0)).count() == 0
