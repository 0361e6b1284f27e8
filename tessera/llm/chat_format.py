"""Chat formatting by perspective rotation: one rendering of a dialogue for each participant.

For every participant the dialogue is rendered with that speaker's turns as
the assistant's and the others' as named users'; narrators (the system role)
stay what they are and get no rendering of their own. Only the assistant's
words are unmasked for the loss. DataFrame functions only.

A dialogue's rendering is one text, however long. Beyond `turns_per_part` turns
it comes in consecutive parts, each with the number of characters before it, so
that no task or cell has to hold it all; put together they are the rendering,
and spans count from its start.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import session, table

NARRATORS = ("system",)
TURNS_PER_PART = 512
END = "<|end|>\n"


def rotate_perspectives(turns: DataFrame, narrators: tuple[str, ...] = NARRATORS, turns_per_part: int = TURNS_PER_PART) -> DataFrame:
    """One row per dialogue, participant and part: its rendering and its loss spans.

    turns: conv_id, turn, role, text; other columns are ignored. Columns out:
    conv_id, perspective, block, part, offset (characters of the parts before
    it), n_turns, n_chars, rendered, spans (array of [start, end) in
    characters of the whole rendering: the assistant's words with their end
    mark, to learn from). In order of block and part, the parts of a dialogue
    and participant are one rendering from the first turn on. Turns are in order of turn, then role, then text;
    repeated rows are rendered as often as they stand there. Parts are cut at
    multiples of turns_per_part of the turn's number (block), and again where
    repeated numbers make a block longer. A null conv_id is one dialogue, a
    null turn comes first in a block of its own, a null role is the
    participant "", a null text is empty. Dialogues of narrators alone give
    no row, as does an empty table.
    """
    session(turns)
    rows = turns.select(
        "conv_id",
        "turn",
        F.coalesce(F.floor(F.col("turn") / turns_per_part), F.lit(-1)).cast("long").alias("block"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    order = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    rows = rows.withColumn("rank", F.row_number().over(order) - 1)
    rows = rows.withColumn("part", F.floor(F.col("rank") / turns_per_part).cast("long"))
    narrator = F.col("role").isin(*narrators) if narrators else F.lit(False)
    speakers = rows.filter(~narrator).select(F.col("conv_id").alias("of"), F.col("role").alias("perspective")).distinct()
    seen = rows.join(speakers, F.col("conv_id").eqNullSafe(F.col("of")))

    own = F.col("role") == F.col("perspective")
    head = F.when(own, "<|assistant|>\n").when(narrator, F.concat(F.lit("<|"), "role", F.lit("|>\n")))
    head = head.otherwise(F.concat(F.lit("<|user name="), "role", F.lit("|>\n")))
    seen = seen.withColumn("head", head).withColumn("said", F.concat("head", "text", F.lit(END)))
    place = Window.partitionBy("conv_id", "block", "part", "perspective").orderBy("rank")
    end = F.sum(F.length("said")).over(place)
    start = end - F.length("said") + F.length("head")
    seen = seen.select("conv_id", "perspective", "block", "part", "rank", "said", F.when(own, F.struct(start.alias("start"), end.alias("end"))).alias("span"))
    turn = F.sort_array(F.collect_list(F.struct("rank", "said", "span")))
    parts = seen.groupBy("conv_id", "perspective", "block", "part").agg(turn.alias("t"), F.sum(F.length("said")).alias("n_chars"))
    before = Window.partitionBy("conv_id", "perspective").orderBy("block", "part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("offset", F.coalesce(F.sum("n_chars").over(before), F.lit(0)))
    spans = F.filter("t.span", lambda s: s.isNotNull())
    return parts.select(
        "conv_id",
        "perspective",
        "block",
        "part",
        "offset",
        F.size("t").cast("long").alias("n_turns"),
        "n_chars",
        F.array_join("t.said", "").alias("rendered"),
        F.transform(spans, lambda s: F.struct((s["start"] + F.col("offset")).alias("start"), (s["end"] + F.col("offset")).alias("end"))).alias("spans"),
    )


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = rotate_perspectives(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return done.select("conv_id", "perspective", "block", "part", "offset", "n_turns", "n_chars", F.sha2("rendered", 256).alias("rendered_sha256"), spans.alias("spans"))


OP8_SQL = f"""
WITH ranked AS (
  SELECT conv_id, turn, coalesce(CAST(floor(turn / {TURNS_PER_PART}.0) AS BIGINT), -1) AS block,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, block ORDER BY turn NULLS FIRST, role, text) - 1 AS rnk FROM ranked
), parted AS (
  SELECT *, CAST(floor(rnk / {TURNS_PER_PART}.0) AS BIGINT) AS part FROM numbered
), speakers AS (
  SELECT DISTINCT conv_id AS of_conv, role AS perspective FROM parted WHERE role <> 'system'
), seen AS (
  SELECT conv_id, perspective, block, part, rnk, text, role = perspective AS own,
         CASE WHEN role = perspective THEN '<|assistant|>' || chr(10)
              WHEN role = 'system' THEN '<|system|>' || chr(10)
              ELSE '<|user name=' || role || '|>' || chr(10) END AS head
  FROM parted JOIN speakers ON conv_id IS NOT DISTINCT FROM of_conv
), said AS (
  SELECT *, head || text || '<|end|>' || chr(10) AS said FROM seen
), placed AS (
  SELECT *, CAST(sum(length(said)) OVER (PARTITION BY conv_id, perspective ORDER BY block, part, rnk) AS BIGINT) AS stop FROM said
)
SELECT conv_id, perspective, block, part, min(stop - length(said)) AS "offset", count(*) AS n_turns, CAST(sum(length(said)) AS BIGINT) AS n_chars,
       sha256(string_agg(said, '' ORDER BY rnk)) AS rendered_sha256,
       coalesce(string_agg((stop - length(said) + length(head)) || '-' || stop, ',' ORDER BY rnk) FILTER (WHERE own), '') AS spans
FROM placed GROUP BY conv_id, perspective, block, part
"""
