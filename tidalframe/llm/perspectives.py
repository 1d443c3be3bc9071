"""Multi-party perspective rotation of dialogues, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_CHARS = 16_000_000  # rendered characters from which a dialogue goes on in another row: what a row can well hold
BLOCK_TURNS = 1024  # turn numbers whose sizes are added up before a dialogue's row ends are found
SYSTEM = "system"  # speaker of instructions, who takes no part


def rotate_perspectives(turns: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """Renders each dialogue once for every participant, with that speaker as assistant.

    turns: conv_id, turn, role (the speaker), text. Returns one row for each
    (conv_id, perspective), chunk and part 0: ``text``, the rendered messages in
    order; ``roles``, ``names``, ``contents`` and ``mask``, one entry a message
    (mask 1: the perspective speaker's own, to be trained on); ``spans``, the
    trained stretches of ``text`` as start:end in code points, comma-joined;
    ``n_turns``.

    A message is ``<|role|name|>`` newline content newline, where role is
    assistant for the speaker, system for the speaker "system", who gets no
    perspective, and user for everyone else. In names and contents ``<|`` is
    rendered as ``<\\|``, and ``|>`` in names as ``|\\>``, so that no message can forge a header.

    Only a dialogue of more than ``max_chars`` rendered characters takes several
    rows: its blocks of BLOCK_TURNS turn numbers are dealt into chunks by their
    sizes, counted before the shuffle, and a chunk that is still longer is cut
    into parts between messages. Rows in order (chunk, part) are the whole
    dialogue, so one dialogue with a third of all messages spreads over tasks. The
    participants, without texts, join the rows at the end.

    Null text: an empty message. Null role: the participant "unknown". Null
    turn: before the first. Null conv_id: one dialogue of its own. Ties and
    repeated rows: all kept, in order of turn, role, text. A dialogue of system
    messages only: no rows. Empty table: no rows. Extra columns are ignored.
    """
    lowest = -(2**60)
    base = turns.select(
        F.col("conv_id").isNull().alias("k0"),
        F.coalesce(F.col("conv_id").cast("bigint"), F.lit(0)).alias("k1"),
        F.coalesce(F.floor(F.col("turn") / BLOCK_TURNS).cast("bigint"), F.lit(lowest)).alias("block"),
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("size", (F.length("role") + F.length("text") + 16).cast("bigint"))
    blocks = base.groupBy("k0", "k1", "block").agg(F.sum("size").alias("size"))
    dialogue = Window.partitionBy("k0", "k1")
    before = dialogue.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    chunks = blocks.select("k0", "k1", "block", F.sum("size").over(dialogue).alias("whole"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))
    later = chunks.where(F.col("whole") > max_chars).select(F.col("k0").alias("b0"), F.col("k1").alias("b1"), F.col("block").alias("b"), F.floor(F.col("before") / max_chars).cast("bigint").alias("chunk"))
    placed = base.join(later, (F.col("k0") == F.col("b0")) & (F.col("k1") == F.col("b1")) & (F.col("block") == F.col("b")), "left").withColumn("chunk", F.coalesce("chunk", F.lit(0).cast("bigint")))
    key = ["k0", "k1", "chunk"]
    order = Window.partitionBy(*key).orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    so_far = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = (
        placed.withColumn("n", F.row_number().over(order))
        .withColumn("part", F.when(F.sum("size").over(Window.partitionBy(*key)) > max_chars, F.floor(so_far / max_chars)).otherwise(0).cast("bigint"))
        .groupBy(*key, "part")
        .agg(F.sort_array(F.collect_list(F.struct("n", "role", "text"))).alias("said"))
    )
    speakers = base.where(F.col("role") != SYSTEM).select("k0", "k1", F.col("role").alias("perspective")).distinct()
    speakers = speakers.groupBy("k0", "k1").agg(F.sort_array(F.collect_list("perspective")).alias("speakers"))
    rows = parts.join(speakers, ["k0", "k1"]).select(*key, "part", "said", F.explode("speakers").alias("perspective"))
    mine = lambda m: m["role"] == F.col("perspective")
    as_role = lambda m: F.when(mine(m), F.lit("assistant")).when(m["role"] == SYSTEM, F.lit("system")).otherwise(F.lit("user"))
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("<\\|"))
    head = lambda m: F.concat(F.lit("<|"), as_role(m), F.lit("|"), F.replace(safe(m["role"]), F.lit("|>"), F.lit("|\\>")), F.lit("|>\n"))
    shown = F.transform("said", lambda m: F.struct(as_role(m).alias("role"), m["role"].alias("name"), m["text"].alias("content"), mine(m).cast("int").alias("mask"), head(m).alias("head"), safe(m["text"]).alias("shown")))
    rows = rows.withColumn("shown", shown)
    # the start of each message, by running sums; then the spans of the masked contents
    walk = F.aggregate(
        "shown",
        F.struct(F.lit(0).cast("bigint").alias("at"), F.expr("cast(array() as array<string>)").alias("spans")),
        lambda acc, m: F.struct(
            (acc["at"] + F.length(m["head"]) + F.length(m["shown"]) + 1).cast("bigint").alias("at"),
            F.when(m["mask"] == 1, F.array_append(acc["spans"], F.concat((acc["at"] + F.length(m["head"])).cast("string"), F.lit(":"), (acc["at"] + F.length(m["head"]) + F.length(m["shown"])).cast("string")))).otherwise(acc["spans"]).alias("spans"),
        ),
    )
    return rows.select(
        F.when(~F.col("k0"), F.col("k1")).alias("conv_id"),
        "perspective",
        "chunk",
        "part",
        F.size("shown").cast("bigint").alias("n_turns"),
        F.concat_ws("", F.transform("shown", lambda m: F.concat(m["head"], m["shown"], F.lit("\n")))).alias("text"),
        F.transform("shown", lambda m: m["role"]).alias("roles"),
        F.transform("shown", lambda m: m["name"]).alias("names"),
        F.transform("shown", lambda m: m["content"]).alias("contents"),
        F.transform("shown", lambda m: m["mask"]).alias("mask"),
        F.array_join(walk["spans"], ",").alias("spans"),
    )


def op5_query(spark, sf_dir: str) -> DataFrame:
    out = rotate_perspectives(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return out.select("conv_id", "perspective", "chunk", "part", "n_turns", "text", F.concat_ws(",", F.transform("mask", lambda x: x.cast("string"))).alias("mask"), "spans")


OP5_SQL = f"""
WITH base AS (
  SELECT conv_id, CAST(floor(turn / {BLOCK_TURNS}.0) AS BIGINT) AS block, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
sized AS (
  SELECT *, length(role) + length(text) + 16 AS size FROM base),
blocks AS (
  SELECT conv_id, block, sum(sum(size)) OVER (PARTITION BY conv_id) AS whole,
    coalesce(sum(sum(size)) OVER (PARTITION BY conv_id ORDER BY block NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sized GROUP BY conv_id, block),
dealt AS (
  SELECT s.*, CASE WHEN b.whole > {MAX_CHARS} THEN CAST(floor(b.before / {MAX_CHARS}.0) AS BIGINT) ELSE 0 END AS chunk
  FROM sized s JOIN blocks b ON s.conv_id IS NOT DISTINCT FROM b.conv_id AND s.block IS NOT DISTINCT FROM b.block),
numbered AS (
  SELECT *, row_number() OVER w AS n, sum(size) OVER (PARTITION BY conv_id, chunk) AS total,
    coalesce(sum(size) OVER (PARTITION BY conv_id, chunk ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM dealt WINDOW w AS (PARTITION BY conv_id, chunk ORDER BY turn NULLS FIRST, role, text)),
cut AS (SELECT *, CASE WHEN total > {MAX_CHARS} THEN CAST(floor(before / {MAX_CHARS}.0) AS BIGINT) ELSE 0 END AS part FROM numbered),
who AS (SELECT DISTINCT conv_id, role AS perspective FROM base WHERE role <> '{SYSTEM}'),
shown AS (
  SELECT c.conv_id, w.perspective, c.chunk, c.part, c.n, c.role = w.perspective AS mine, replace(c.text, '<|', '<\\|') AS text,
    '<|' || CASE WHEN c.role = w.perspective THEN 'assistant' WHEN c.role = '{SYSTEM}' THEN 'system' ELSE 'user' END || '|' || replace(replace(c.role, '<|', '<\\|'), '|>', '|\\>') || '|>' || chr(10) AS head
  FROM cut c JOIN who w ON c.conv_id IS NOT DISTINCT FROM w.conv_id),
placed AS (
  SELECT *, sum(length(head) + length(text) + 1) OVER (PARTITION BY conv_id, perspective, chunk, part ORDER BY n) - length(text) - 1 AS start FROM shown)
SELECT conv_id, perspective, CAST(chunk AS BIGINT) AS chunk, CAST(part AS BIGINT) AS part, count(*) AS n_turns,
  string_agg(head || text || chr(10), '' ORDER BY n) AS text,
  string_agg(CASE WHEN mine THEN '1' ELSE '0' END, ',' ORDER BY n) AS mask,
  coalesce(string_agg(CASE WHEN mine THEN CAST(CAST(start AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(start AS BIGINT) + length(text) AS VARCHAR) END, ',' ORDER BY n), '') AS spans
FROM placed GROUP BY conv_id, perspective, chunk, part
"""
