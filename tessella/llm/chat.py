"""Chat formatting by multi-party perspective rotation.

A conversation is rendered once for every participant, with that speaker as the assistant and the others as named users; the
mask selects what the assistant says. Turns go in order of turn, role and text, so that a rendering depends on the rows alone,
not on files or partitions.

A rendering is one row, however many turns it has, up to PART characters. A longer one, which no row could hold in the
end, comes as consecutive parts: a message belongs to the part in which it starts, counting the characters of all
messages before it (with SIZE for each one's marks). Parts are numbered from 0; their texts, joined in that order,
are the whole rendering, and each later part carries the conversation's first system turn in a column of its own.

Built-in functions only. Conversations are gathered by their key; one of more than PART characters is never gathered: its rows are
dealt out in ranges of their order, and sums of the ranges give each row its place. Messages meet their conversation's
participants in a join (AQE splits a hot conversation).

Defined results: nulls go first; a null text is empty; the system role is rendered as
such in every perspective and is no participant, nor is a null role, which speaks as a user without a name; a
conversation without participants gives no rows; repeated rows are repeated turns; null conversation ids are one
conversation; very long texts stay whole, in a part of their own if need be; an empty table gives an empty result. "<|" in a text or a name becomes "< |",
so that no text can open a mark. Columns other than those named are ignored, also of clashing names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import checkpoint, table

#: Characters of a part, and those counted for a message's marks.
PART, SIZE = 1 << 20, 64
#: Bytes of keys of long conversations that are broadcast.
BROADCAST = 8 << 20
SYSTEM = "system"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
ORDER = ("turn", "role", "text")


def _clean(x: Column) -> Column:
    return F.replace(x, F.lit("<|"), F.lit("< |"))


def parts(turns: DataFrame, most: int = PART) -> DataFrame:
    """(conv_id, part, messages) with messages (turn, role, text) in order."""
    x = turns.select("conv_id", "turn", "role", _clean(F.coalesce("text", F.lit(""))).alias("text"))
    size = (F.length("text") + F.length(F.coalesce("role", F.lit(""))) + SIZE).cast("long")
    x = x.withColumn("size", size)
    long_ = checkpoint(x.groupBy("conv_id").agg(F.sum("size").alias("total")).filter(F.col("total") > most).select(F.col("conv_id").alias("__c")))
    gathered = lambda rows: rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(*ORDER))).alias("messages")).select("conv_id", F.lit(0).cast("long").alias("part"), "messages")
    held = long_.agg(F.sum(32 + F.coalesce(F.octet_length(F.col("__c").cast("string")), F.lit(0)))).first()[0]
    if not held:
        return gathered(x)
    long_ = F.broadcast(long_) if held <= BROADCAST else long_
    same = F.col("conv_id").eqNullSafe(F.col("__c"))
    return gathered(x.join(long_, same, "left_anti")).unionByName(_runs(x.join(long_, same, "left_semi"), most))


def _runs(rows: DataFrame, most: int) -> DataFrame:
    """(conv_id, part, messages) of long conversations.

    Equal rows are counted first; the others are dealt out in ranges of their order, and a row's place is the sum of its
    conversation's sizes in earlier ranges and earlier in its own. So neither a long conversation nor a row repeated many times goes
    to one task.
    """
    own = ["conv_id", *ORDER, "size"]
    counted = rows.groupBy(*own).agg(F.count("*").alias("n"))
    x = checkpoint(counted.repartitionByRange("conv_id", *ORDER).withColumn("range", F.spark_partition_id()))
    size = F.col("n") * F.col("size")
    ranges = x.groupBy("conv_id", "range").agg(F.sum(size).alias("__sum"))
    upto = lambda by, c: F.coalesce(F.sum(c).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select(F.col("conv_id").alias("__c"), F.col("range").alias("__r"), upto(Window.partitionBy("conv_id").orderBy("range"), "__sum").alias("__before"))
    x = x.withColumn("at", upto(Window.partitionBy("conv_id", "range").orderBy(*ORDER), size))
    x = x.join(ranges, F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("range") == F.col("__r"))).withColumn("at", F.col("at") + F.col("__before"))
    # copies of a row start at at, at + size, ...; each part takes those that start in it
    x = x.withColumn("part", F.explode(F.expr(f"sequence(at div {most}, (at + (n - 1) * size) div {most})")))
    first = F.expr(f"(greatest(part * {most} - at, 0) + size - 1) div size")
    last = F.least(F.col("n"), F.expr(f"((part + 1) * {most} - at + size - 1) div size"))
    x = x.withColumn("times", (last - first).cast("int")).filter("times > 0")
    grouped = x.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct(F.struct(*ORDER).alias("message"), "times"))).alias("__m"))
    return grouped.select("conv_id", "part", F.flatten(F.transform("__m", lambda m: F.array_repeat(m["message"], m["times"]))).alias("messages"))


def _head(m: Column, speaker: Column) -> Column:
    who = (
        F.when(m["role"].isNull(), F.lit("user"))
        .when(m["role"] == SYSTEM, F.lit("system"))
        .when(m["role"] == speaker, F.lit("assistant"))
        .otherwise(F.concat(F.lit("user name="), _clean(m["role"])))
    )
    return F.concat(F.lit(OPEN), who, F.lit("\n"))


def rotate(turns: DataFrame, most: int = PART) -> DataFrame:
    """(conv_id, part, speaker, n_turns, text, spans, system): spans are (start, end) in text of what the assistant says,
    system the first system turn where an earlier part holds it. most: characters of a part; the parts of a longer rendering, joined in order, are all of it."""
    p = parts(turns, most)
    speakers = turns.select(F.col("conv_id").alias("__c"), F.col("role").alias("speaker")).distinct()
    speakers = speakers.filter(F.col("speaker").isNotNull() & (F.col("speaker") != SYSTEM))
    x = p.join(speakers, F.col("conv_id").eqNullSafe(F.col("__c"))).drop("__c")
    first = F.min(F.struct("turn", _clean(F.coalesce("text", F.lit(""))).alias("text")))
    ruled = turns.filter(F.col("role") == SYSTEM).groupBy(F.col("conv_id").alias("__c")).agg(first.alias("__first"))
    later = p.filter("part > 0").select(F.col("conv_id").alias("__l")).distinct()
    ruled = ruled.join(later, F.col("__c").eqNullSafe(F.col("__l")), "left_semi").select("__c", F.col("__first.text").alias("__system"))
    x = x.join(ruled, F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("part") > 0), "left")
    head = lambda m: _head(m, F.col("speaker"))
    text = F.array_join(F.transform("messages", lambda m: F.concat(head(m), m["text"], F.lit(CLOSE))), "")
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long>>").alias("spans"))

    def step(acc: Column, m: Column) -> Column:
        start = acc["at"] + F.length(head(m))
        end = start + F.length(m["text"])
        said = F.array(F.struct(start.cast("long").alias("start"), end.cast("long").alias("end")))
        spans = F.when(F.coalesce(m["role"] == F.col("speaker"), F.lit(False)), F.concat(acc["spans"], said)).otherwise(acc["spans"])
        return F.struct((end + len(CLOSE)).cast("long").alias("at"), spans.alias("spans"))

    spans = F.aggregate("messages", empty, step, lambda acc: acc["spans"])
    return x.select("conv_id", "part", "speaker", F.size("messages").cast("long").alias("n_turns"), text.alias("text"), spans.alias("spans"), F.col("__system").alias("system"))


def op7_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from each participant's view; null ids are one conversation, repeated rows repeated turns."""
    x = rotate(table(spark, sf_dir, "conversations"))
    return x.select(
        "conv_id", "part", "speaker", "n_turns", "text", F.length("text").cast("long").alias("n_chars"),
        F.concat_ws(",", F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"]))).alias("spans"),
        F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"]).alias("n_assistant_chars"), "system",
    )


def oracle(part: int) -> str:
    by = "turn NULLS FIRST, role NULLS FIRST, x"
    return f"""
WITH c AS (SELECT conv_id, turn, role, replace(coalesce(text, ''), '<|', '< |') AS x FROM conversations),
m AS (
  SELECT *, CAST(floor(coalesce(sum(length(x) + length(coalesce(role, '')) + {SIZE}) OVER (PARTITION BY conv_id ORDER BY {by} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / {part}.0) AS BIGINT) AS part FROM c
),
s AS (SELECT DISTINCT conv_id, role AS speaker FROM c WHERE role <> '{SYSTEM}'),
y AS (SELECT conv_id, first(x ORDER BY turn NULLS FIRST, x) AS system FROM c WHERE role = '{SYSTEM}' GROUP BY conv_id),
r AS (
  SELECT m.*, speaker, '{OPEN}' || CASE WHEN role IS NULL THEN 'user' WHEN role = '{SYSTEM}' THEN 'system' WHEN role = speaker THEN 'assistant' ELSE 'user name=' || replace(role, '<|', '< |') END || chr(10) AS head
  FROM m JOIN s ON m.conv_id IS NOT DISTINCT FROM s.conv_id
),
o AS (
  SELECT *, head || x || '<|im_end|>' || chr(10) AS seg,
    coalesce(sum(length(head) + length(x) + {len(CLOSE)}) OVER (PARTITION BY conv_id, part, speaker ORDER BY {by} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS a
  FROM r
),
g AS (
  SELECT conv_id, part, speaker, count(*) AS n_turns, string_agg(seg, '' ORDER BY {by}) AS text,
    CAST(sum(length(seg)) AS BIGINT) AS n_chars,
    coalesce(string_agg(CASE WHEN role = speaker THEN CAST(CAST(a AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(a + length(x) AS BIGINT) AS VARCHAR) END, ',' ORDER BY {by}), '') AS spans,
    CAST(coalesce(sum(CASE WHEN role = speaker THEN length(x) END), 0) AS BIGINT) AS n_assistant_chars
  FROM o GROUP BY conv_id, part, speaker
)
SELECT g.*, CASE WHEN part > 0 THEN system END AS system FROM g LEFT JOIN y ON g.conv_id IS NOT DISTINCT FROM y.conv_id
"""


ORACLE = oracle(PART)
