"""Multi-party perspective rotation of dialogues.

For every participant of a conversation the dialogue is rendered with that speaker as the
assistant and all others as named users; the mask is the assistant's text and end sign. The
result is one row per turn and perspective, with character offsets into the perspective's
whole rendering, so a conversation of any length is spread over many rows. ``assemble`` joins
the rows of conversations that fit one row.

Native. Offsets come from sums of blocks of 256 turn numbers and a running sum inside a
block, so no task holds a whole conversation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweave.llm.common import cut_lineage

END = "<|end|>\n"
_BLOCK = 256


def rotate(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text",
           system: tuple[str, ...] = ("system",)) -> DataFrame:
    """(conv, perspective, turn, speaker, segment, start, end, mask_start, mask_end).

    Turns are ordered by number (null last), ties by speaker and text; equal rows are turns of
    their own. A null speaker is named ``unknown``, a null text is empty, null conversation
    ids are one conversation. ``system`` speakers head every perspective and have none. Masks
    are null on turns without loss; other columns are ignored.
    """
    rows = turns.select(F.col(conv).alias("c"), F.col(turn).alias("n"), F.coalesce(F.col(speaker), F.lit("unknown")).alias("s"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    people = rows.where(~F.col("s").isin(*system)).select(F.col("c").alias("pc"), F.col("s").alias("p")).distinct()
    seen = rows.join(people, F.col("c").eqNullSafe(F.col("pc"))).drop("pc")
    own = F.col("s") == F.col("p")
    head = (F.when(F.col("s").isin(*system), F.lit("<|system|>\n")).when(own, F.lit("<|assistant|>\n"))
            .otherwise(F.concat(F.lit("<|user "), F.col("s"), F.lit("|>\n"))))
    seen = seen.withColumns({"h": F.length(head), "g": F.concat(head, F.col("t"), F.lit(END))})
    seen = seen.withColumns({"size": F.length("g").cast("long"), "block": F.floor(F.col("n") / _BLOCK)})
    group = ["c", "p", "block"]
    sums = seen.groupBy(*group).agg(F.sum("size").alias("block_size"))
    before = Window.partitionBy("c", "p").orderBy(F.col("block").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("c").alias("bc"), F.col("p").alias("bp"), F.col("block").alias("bb"), F.coalesce(F.sum("block_size").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy(*group).orderBy(F.col("n").asc_nulls_last(), "s", "t").rowsBetween(Window.unboundedPreceding, -1)
    seen = seen.withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    at = seen.join(sums, F.col("c").eqNullSafe(F.col("bc")) & (F.col("p") == F.col("bp")) & F.col("block").eqNullSafe(F.col("bb")))
    start = F.col("base") + F.col("ahead")
    return at.select(F.col("c").alias(conv), F.col("p").alias("perspective"), F.col("n").alias(turn), F.col("s").alias("speaker"), F.col("g").alias("segment"),
                     start.alias("start"), (start + F.col("size")).alias("end"),
                     F.when(own, start + F.col("h")).alias("mask_start"), F.when(own, start + F.col("size") - 1).alias("mask_end"))


def assemble(segments: DataFrame, *, conv: str = "conv_id", most: int = 1_000_000) -> DataFrame:
    """(conv, perspective, dialogue, masks) of perspectives of at most ``most`` characters;
    longer ones stay as segments."""
    segments = cut_lineage(segments)
    size = segments.groupBy(conv, "perspective").agg(F.max("end").alias("size")).where(F.col("size") <= most)
    fit = segments.alias("s").join(size.alias("z"), F.col("s." + conv).eqNullSafe(F.col("z." + conv)) & (F.col("s.perspective") == F.col("z.perspective")), "left_semi")
    parts = F.array_sort(F.collect_list(F.struct("start", "segment", "mask_start", "mask_end")))
    masks = F.transform(F.filter("parts", lambda x: x["mask_start"].isNotNull()), lambda x: F.struct(x["mask_start"].alias("start"), x["mask_end"].alias("end")))
    return fit.groupBy(conv, "perspective").agg(parts.alias("parts")).select(
        conv, "perspective", F.array_join(F.transform("parts", lambda x: x["segment"]), "").alias("dialogue"), masks.alias("masks"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: every conversation from every participant's side."""
    return rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


SQL = f"""
WITH r AS (SELECT conv_id AS c, turn AS n, coalesce(role, 'unknown') AS s, coalesce(text, '') AS t FROM conversations),
p AS (SELECT DISTINCT c, s AS p FROM r WHERE s <> 'system'),
g AS (SELECT r.*, p.p, CASE WHEN s = 'system' THEN '<|system|>' || chr(10) WHEN s = p.p THEN '<|assistant|>' || chr(10)
             ELSE '<|user ' || s || '|>' || chr(10) END AS h FROM r JOIN p ON r.c IS NOT DISTINCT FROM p.c),
o AS (SELECT *, h || t || '<|end|>' || chr(10) AS g, length(h || t || '<|end|>' || chr(10)) AS size FROM g),
w AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY c, p ORDER BY n NULLS LAST, s, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a FROM o)
SELECT c AS conv_id, p AS perspective, n AS turn, s AS speaker, g AS segment, a AS "start", a + size AS "end",
       CASE WHEN s = p THEN a + length(h) END AS mask_start, CASE WHEN s = p THEN a + size - 1 END AS mask_end FROM w
"""
