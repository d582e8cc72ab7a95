"""Chat formatting by perspective rotation.

For every participant of a conversation the whole dialogue is rendered once with that speaker as the assistant and all
others as named users; the masks are the character spans (end exclusive) of the speaker's own texts, the only ones a
loss would count.

A rendering is delivered in parts of at most ``PART`` turns, so that no row and no task holds an unbounded
conversation. Parts are cut by the turns' places in the dialogue, whatever their numbers; ``start`` is where a part
begins, and masks count from the start of the dialogue, so the parts of a speaker, joined in order, are the rendering.

Turns are ordered by turn, role and text. No text can look like a turn's head: ``<|`` in a text becomes ``<||``, and
``%``, ``|`` and line breaks in a role are written as %25, %7C, %0A and %0D.

Defined results: a null role is a participant of its own (speaker null, headed ``<|user|>``), a null text is empty,
null turns come first and are ordinary turns, repeated turns are all kept; an empty table gives an empty one. Only the
four named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.common import table

PART = 512


def plain_role(role: Column) -> Column:
    for mark, code in (("%", "%25"), ("|", "%7C"), ("\n", "%0A"), ("\r", "%0D")):
        role = F.replace(role, F.lit(mark), F.lit(code))
    return role


def placed(rows: DataFrame, span: int) -> DataFrame:
    """``rows`` with their place (from 0) in their conversation. Rows are put in order within spans of turn numbers; what
    stands before a span comes from counts, a row for each span."""
    rows = rows.withColumn("span", F.floor(F.col("turn") / span))
    counts = rows.groupBy("conv_id", "span").agg(F.count("*").alias("n"))
    before = counts.select(F.col("conv_id").alias("of"), F.col("span").alias("at"), (F.sum("n").over(Window.partitionBy("conv_id").orderBy("span")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("conv_id", "span").orderBy("turn", "role", "text")) - 1
    ranked = rows.withColumn("own", own)
    both = ranked.join(before, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("span") == F.col("at")))
    return both.withColumn("row", F.col("before") + F.col("own")).drop("of", "at", "before", "own", "span")


def perspectives(turns: DataFrame, part: int = PART) -> DataFrame:
    """conv_id, speaker, part, n_turns, n_own, start, rendered, masks (array of (start, end))."""
    text = F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("<||"))
    rows = turns.select("conv_id", F.coalesce("turn", F.lit(-1)).cast("long").alias("turn"), "role", text.alias("text"))
    rows = placed(rows, part).withColumn("piece", F.floor(F.col("row") / part))
    parts = rows.groupBy("conv_id", "piece").agg(F.sort_array(F.collect_list(F.struct("row", "role", "text"))).alias("said"))
    speakers = rows.select(F.col("conv_id").alias("of"), F.col("role").alias("speaker")).distinct()
    seen = parts.join(speakers, F.col("conv_id").eqNullSafe(F.col("of")))

    own = lambda m: m["role"].eqNullSafe(F.col("speaker"))
    head = lambda m: F.when(own(m), F.lit("<|assistant|>\n")).when(m["role"].isNull(), F.lit("<|user|>\n")).otherwise(F.concat(F.lit("<|user:"), plain_role(m["role"]), F.lit("|>\n")))
    lines = F.transform("said", lambda m: F.struct(head(m).alias("head"), m["text"].alias("text"), own(m).alias("own")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("CAST(array() AS array<struct<start:bigint,end:bigint>>)").alias("spans"))

    def add(state, m):
        begin = state["at"] + F.length(m["head"])
        end = begin + F.length(m["text"])
        span = F.struct(begin.alias("start"), end.alias("end"))
        return F.struct((end + 1).alias("at"), F.when(m["own"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    seen = seen.withColumn("lines", lines).select(
        "conv_id",
        "speaker",
        "piece",
        F.size("lines").cast("long").alias("n_turns"),
        F.size(F.filter("lines", lambda m: m["own"])).cast("long").alias("n_own"),
        F.array_join(F.transform("lines", lambda m: F.concat(m["head"], m["text"], F.lit("\n"))), "").alias("rendered"),
        F.aggregate("lines", start, add, lambda s: s["spans"]).alias("masks"),
    )
    # Few rows: a part has up to ``part`` turns.
    reach = F.sum(F.length("rendered")).over(Window.partitionBy("conv_id", "speaker").orderBy("piece"))
    seen = seen.withColumn("start", reach - F.length("rendered"))
    moved = F.transform("masks", lambda m: F.struct((m["start"] + F.col("start")).alias("start"), (m["end"] + F.col("start")).alias("end")))
    return seen.select("conv_id", "speaker", (F.col("piece") + 1).cast("long").alias("part"), "n_turns", "n_own", "start", "rendered", moved.alias("masks"))


def op2_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.array_join(F.transform("masks", lambda m: F.concat_ws(":", m["start"], m["end"])), ",")
    return perspectives(table(spark, sf_dir, "conversations")).withColumn("masks", shown)


OP2_SQL = """
WITH rows AS (
  SELECT conv_id, coalesce(turn, -1) AS turn, role, replace(coalesce(text, ''), '<|', '<||') AS text FROM conversations
), pieces AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role NULLS FIRST, text) - 1 AS nth FROM rows
), speakers AS (
  SELECT DISTINCT conv_id AS of_conv, role AS speaker FROM rows
), seen AS (
  SELECT p.conv_id, s.speaker, p.nth // 512 AS piece, p.nth, p.text, p.role IS NOT DISTINCT FROM s.speaker AS own,
         CASE WHEN p.role IS NOT DISTINCT FROM s.speaker THEN '<|assistant|>' WHEN p.role IS NULL THEN '<|user|>'
              ELSE '<|user:' || replace(replace(replace(replace(p.role, '%', '%25'), '|', '%7C'), chr(10), '%0A'), chr(13), '%0D') || '|>' END || chr(10) AS head
  FROM pieces p JOIN speakers s ON p.conv_id IS NOT DISTINCT FROM s.of_conv
), offsets AS (
  SELECT *, sum(length(head) + length(text) + 1) OVER (PARTITION BY conv_id, speaker ORDER BY nth) AS reach FROM seen
)
SELECT conv_id, speaker, piece + 1 AS part, count(*) AS n_turns, count(*) FILTER (WHERE own) AS n_own,
       CAST(min(reach - length(head) - length(text) - 1) AS BIGINT) AS start,
       string_agg(head || text || chr(10), '' ORDER BY nth) AS rendered,
       coalesce(string_agg(CAST(reach - 1 - length(text) AS BIGINT) || ':' || CAST(reach - 1 AS BIGINT), ',' ORDER BY nth)
                FILTER (WHERE own), '') AS masks
FROM offsets
GROUP BY conv_id, speaker, piece
"""
