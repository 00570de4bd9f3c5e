"""Chat formatting by perspective rotation.

A dialogue is rendered once for each of its participants: that speaker's turns are the assistant's,
all other participants' are turns of named users, and turns of a narrator (``system``) are the
system's in every rendering. The result has a row for each turn of each rendering, in order of
``message``: the segment, its place in the rendering (``start``, ``end``, in characters) and, for
the assistant's turns, the place of what is trained on (``mask_start``, ``mask_end``: the text and
its end mark). A rendering is the concatenation of its segments; its masks are exactly the
assistant's words. In texts and names ``<|`` becomes ``< |``, so no text can forge a mark.

Turns are ordered by (turn, role, text), nulls first. A null text is empty; a null role is the
participant named ``unknown``; a null conv_id is a conversation of its own. Repeated rows are
repeated turns. A dialogue of narrators alone has no participant and no rendering. Other columns are
ignored. A very long dialogue is rendered in parts: places are prefix sums over range partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import only, table, written

NARRATORS = ("system",)
END = "<|end|>"
NO_ID = -(2**63)


def rotate(conversations: DataFrame, narrators: tuple[str, ...] = NARRATORS) -> DataFrame:
    n = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = only(conversations, conv_id="long", turn="long", role="string", text="string").select(
        F.coalesce("conv_id", F.lit(NO_ID)).alias("conv"),
        "turn",
        F.coalesce("role", F.lit("unknown")).alias("speaker"),
        F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"),
    )
    order = ["conv", F.col("turn").asc_nulls_first(), "speaker", "text"]
    placed = written(
        rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")),
        "turns",
    )
    people = written(placed.where(~F.col("speaker").isin(*narrators)).select("conv", F.col("speaker").alias("perspective")).distinct(), "people")
    name = F.replace("speaker", F.lit("<|"), F.lit("< |"))
    role = F.when(F.col("speaker").isin(*narrators), "system").when(F.col("speaker") == F.col("perspective"), "assistant").otherwise("user")
    head = F.when(F.col("message_role") == "user", F.concat(F.lit("<|user name="), name, F.lit("|>\n"))).otherwise(F.concat(F.lit("<|"), F.col("message_role"), F.lit("|>\n")))
    turns = (
        placed.hint("merge")
        .join(people, "conv")
        .withColumn("message_role", role)
        .withColumn("head", F.length(head))
        .withColumn("segment", F.concat(head, F.col("text"), F.lit(END + "\n")))
        .withColumn("size", F.length("segment").cast("long"))
        .drop("text")
    )
    turns = written(turns, "segments")
    own = ["conv", "perspective"]
    here = Window.partitionBy(*own, "part").orderBy("place")
    before = Window.partitionBy(*own).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = written(turns.groupBy(*own, "part").agg(F.sum("size").alias("sizes"), F.count("*").alias("turns")), "parts")
    bases = written(
        parts.select(*own, "part", F.coalesce(F.sum("sizes").over(before), F.lit(0)).alias("base"), F.coalesce(F.sum("turns").over(before), F.lit(0)).alias("base_turn")), "bases"
    )
    local = turns.withColumns({"local": F.sum("size").over(here.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"), "nth": F.row_number().over(here) - 1})
    mine = F.col("message_role") == "assistant"
    return (
        local.hint("merge")
        .join(bases, [*own, "part"])
        .withColumn("start", F.col("base") + F.col("local"))
        .select(
            F.when(F.col("conv") != NO_ID, F.col("conv")).alias("conv_id"),
            "perspective",
            (F.col("base_turn") + F.col("nth")).alias("message"),
            "turn",
            "speaker",
            "message_role",
            "segment",
            "start",
            (F.col("start") + F.col("size")).alias("end"),
            F.when(mine, F.col("start") + F.col("head")).alias("mask_start"),
            F.when(mine, F.col("start") + F.col("size") - 1).alias("mask_end"),
        )
    )


def op7_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(table(spark, sf_dir, "conversations"))


_TURNS = """
  SELECT coalesce(conv_id, -9223372036854775808) AS conv, turn, coalesce(role, 'unknown') AS speaker,
         replace(coalesce(text, ''), '<|', '< |') AS text
  FROM conversations"""
SQL = f"""
WITH turns AS ({_TURNS}),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, speaker, text) AS nth FROM turns),
people AS (SELECT DISTINCT conv, speaker AS perspective FROM turns WHERE speaker <> 'system'),
roles AS (
  SELECT n.*, perspective, CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS message_role
  FROM numbered n JOIN people USING (conv)),
heads AS (SELECT *, CASE WHEN message_role = 'user' THEN '<|user name=' || replace(speaker, '<|', '< |') || '|>' || chr(10) ELSE '<|' || message_role || '|>' || chr(10) END AS head FROM roles),
segments AS (SELECT *, head || text || '<|end|>' || chr(10) AS segment FROM heads),
placed AS (
  SELECT *, CAST(sum(length(segment)) OVER w - length(segment) AS BIGINT) AS start
  FROM segments WINDOW w AS (PARTITION BY conv, perspective ORDER BY nth ROWS UNBOUNDED PRECEDING))
SELECT nullif(conv, -9223372036854775808) AS conv_id, perspective, nth - 1 AS message, turn, speaker, message_role, segment, start,
       start + length(segment) AS "end",
       CASE WHEN message_role = 'assistant' THEN start + length(head) END AS mask_start,
       CASE WHEN message_role = 'assistant' THEN start + length(segment) - 1 END AS mask_end
FROM placed
"""
