"""The rendered event lines exercise every mask, every rule that can win and every event field."""
from pyspark.sql import functions as F

from logweave.functions.masks import MASKS, apply_mask
from logweave.plans import catalog
from logweave.sources.tables import event_log_lines

#: Rules 2 to 4 match only where rule 1, which comes first, matches too.
SHADOWED = {2, 3, 4}


def test_every_mask_fires(spark, sf):
    lines = event_log_lines(spark, sf)
    text, fired = F.col("line"), []
    for i, m in enumerate(MASKS):
        after = apply_mask(text, m)
        fired.append(F.count_if(after != text).alias(m.name))
        text = after
    row = lines.agg(*fired).first().asDict()
    assert [m for m, n in row.items() if n == 0] == []


def test_every_rule_that_can_win_labels_a_line(spark, sf):
    got = {r.rule_order for r in catalog.QUERIES["label_event_lines"](spark, sf).select("rule_order").distinct().collect()}
    assert got - {None} == set(range(1, 21)) - SHADOWED


def test_every_field_is_filled_somewhere(spark, sf):
    for name in ("ocsf_events", "parse_events_events"):
        df = catalog.QUERIES[name](spark, sf)
        counts = df.agg(*[F.count_if(F.col(c).isNotNull() & (F.col(c).cast("string") != "")).alias(c) for c in df.columns]).first().asDict()
        assert [c for c, n in counts.items() if n == 0] == [], name
