import random
import re

from pyspark.sql import functions as F

from logweave.operators.compile import compile_templates
from logweave.operators.matching import strict_match
from logweave.sources.lines import lines_from_strings

VOCAB = ["a", "b", "c", "port", "x=1", "for", "<*>", "<user.name>", "<src_endpoint.ip>"]
WORDS = ["a", "b", "c", "port", "x=1", "for", "alice", "10.0.0.1", "z"]


def _regex(tpl):
    parts = []
    for tok in tpl.split():
        parts.append(r"\S+" if re.fullmatch(r"<[^>]*>", tok) else re.escape(tok))
    return re.compile("^" + r"\s+".join(parts) + "$")


def test_strict_match_equals_anchored_regex(spark):
    rnd = random.Random(7)
    templates = [" ".join(rnd.choice(VOCAB) for _ in range(rnd.randint(1, 4))) for _ in range(40)]
    lines = []
    for _ in range(400):
        if rnd.random() < 0.5:  # derived from a template: fill wildcards
            t = rnd.choice(templates).split()
            toks = [rnd.choice(WORDS) if re.fullmatch(r"<[^>]*>", x) else x for x in t]
        else:
            toks = [rnd.choice(WORDS) for _ in range(rnd.randint(1, 4))]
        sep = rnd.choice([" ", "  ", "\t"])
        lines.append(sep.join(toks) + ("\n" if rnd.random() < 0.1 else ""))
    # reference model: most literal tokens first, ties in registry order; first match wins
    compiled_py = [(i, t, _regex(t), sum(1 for x in t.split() if not re.fullmatch(r"<[^>]*>", x)))
                   for i, t in enumerate(templates)]
    order = sorted(compiled_py, key=lambda c: -c[3])
    want = {}
    for li, line in enumerate(lines):
        want[li] = next((str(c[0]) for c in order if c[2].match(line)), None)
    tpl = spark.createDataFrame([(str(i), t, i) for i, t in enumerate(templates)],
                                "cluster_id string, labeled_template string, registry_seq long")
    got = {r.line_id: r.exact_cluster_id for r in
           strict_match(lines_from_strings(spark, lines), compile_templates(tpl)).collect()}
    assert got == want


NEAR_VOCAB = ["Accepted", "for", "from", "port", "ssh2", "ab", "x", "<*>", "DB", "query", "rows=", "on", "for", "é"]
NEAR_WORDS = ["Accepted", "for", "from", "port", "ssh2", "ab", "x", "alice", "DB", "query", "rows=5", "on", "10.0.0.1", "login\xa0ok", "é", "xab"]


def _near_tables(spark, seed, n_templates, n_lines):
    rnd = random.Random(seed)
    templates = [" ".join(rnd.choice(NEAR_VOCAB) for _ in range(rnd.randint(1, 7))) for _ in range(n_templates)]
    lines = [" ".join(rnd.choice(NEAR_WORDS) for _ in range(rnd.randint(0, 10))) for _ in range(n_lines)]
    # registry order differs from id order, and some templates share it
    rows = [(str(i), t, (i * 7) % 61) for i, t in enumerate(templates)]
    tpl = spark.createDataFrame(rows, "cluster_id string, labeled_template string, registry_seq long")
    df = spark.createDataFrame([(i, x) for i, x in enumerate([*lines, None, ""])], "line_id long, line string")
    literals = [(c, [x for x in t.split() if not re.fullmatch(r"<[^>]*>", x)], q) for c, t, q in rows]
    order = sorted((r for r in literals if r[1]), key=lambda r: (-len(r[1]), r[2], r[0]))
    return df, compile_templates(tpl), order


def _holds(lits, line):
    at = 0
    for x in lits:
        at = line.find(x, at)
        if at < 0:
            return False
        at += len(x)
    return True


def test_near_match_equals_trying_every_template(spark):
    import difflib

    from logweave.operators.matching import near_match

    df, comp, order = _near_tables(spark, 11, 70, 300)
    rows = df.collect()
    for th in (0.85, 0.5, 0.0):
        want = {}
        for r in rows:
            best, at = -1.0, None
            for c, lits, _ in order if r.line is not None else []:
                if _holds(lits, r.line):
                    m = difflib.SequenceMatcher(None, lits, r.line.split(), autojunk=False)
                    score = sum(b.size for b in m.get_matching_blocks()) / len(lits)
                    if score > best:
                        best, at = score, c
            want[r.line_id] = (at, best) if at is not None and best >= th else (None, None)
        assert any(v[0] for v in want.values())
        for shard in (200_000, 9):      # several shards give the same
            got = {r.line_id: (r.near_cluster_id, r.similarity) for r in near_match(df, comp, threshold=th, shard=shard).collect()}
            assert got == want, (th, shard)
    gated = near_match(df, comp, threshold=0.0, only_when=F.col("line_id") < 10)
    assert gated.where("near_cluster_id is not null and line_id >= 10").count() == 0
    assert near_match(df, comp.limit(0)).where("near_cluster_id is not null").count() == 0


def test_candidates_equal_trying_every_template(spark):
    from logweave.operators.matching import loose_candidates

    df, comp, order = _near_tables(spark, 3, 60, 200)
    want = {r.line_id: [c for c, lits, _ in order if r.line is not None and _holds(lits, r.line)] for r in df.collect()}
    for shard in (200_000, 7):
        assert {r.line_id: list(r.loose_ids) for r in loose_candidates(df, comp, shard=shard).collect()} == want
    assert any(want.values())


def test_unicode_white_space_cuts_tokens(spark):
    """No-break, ideographic and control separators cut tokens as Python's split does."""
    from logweave.functions.tokens import tokens

    texts = ["a\xa0b", "\u3000a b\u2003", "a\x1cb\x85c", "a\u200bb", "", " \xa0"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "line_id long, line string")
    assert [r.t for r in df.orderBy("line_id").select(tokens(F.col("line")).alias("t")).collect()] == [t.split() for t in texts]
    tpl = spark.createDataFrame([("c", "user <user.name> in", 0)], "cluster_id string, labeled_template string, registry_seq long")
    line = spark.createDataFrame([(0, "user\xa0bob\u2003in")], "line_id long, line string")
    got = strict_match(line, compile_templates(tpl)).first()
    assert got.exact_cluster_id == "c" and got.matched_fields == {"user.name": "bob"}
