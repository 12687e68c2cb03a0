"""Chat formatting: conversations logged again and again as they grow are collapsed to the longest ones, then rendered.

Each turn is hashed with its position; a prefix hash rolls over a conversation's turns as the exclusive or of these
hashes. What stands before a turn is a prefix that is continued, so a conversation whose whole hash is such a prefix
of the same length is a snapshot, and an anti-join takes it away. Of equal conversations the smallest id stays.

Positions and prefix hashes come from blocks of turns, never from a whole conversation in one task: turns are dealt
into blocks by ranges of the turn number, and counts and hashes of blocks give what came before each of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged, table

#: Turn numbers in a block, turns in a rendered chunk.
BLOCK, CHUNK = 256, 64


def positions(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv, block, at, role, text): the distinct turns with their positions from 0, by turn number, role and text."""
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv"),
        F.coalesce(F.col("turn").cast("long"), F.lit(-(2**62))).alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).distinct()
    rows = rows.withColumn("block", F.floor(F.col("turn") / block))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("conv", "block").orderBy("turn", "role", "text")) - 1)
    sizes = rows.groupBy("conv", "block").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col("conv").alias("s_conv"), F.col("block").alias("s_block"), before.alias("before"))
    rows = rows.join(starts, F.col("conv").eqNullSafe(F.col("s_conv")) & (F.col("block") == F.col("s_block")))
    return rows.select("conv", "block", (F.col("before") + F.col("nth")).alias("at"), "role", "text")


def prefixes(rows: DataFrame) -> DataFrame:
    """(conv, at, p1, p2): the hash of the turns before position ``at``, for each turn."""
    rows = rows.select("conv", "block", "at", F.xxhash64("at", "role", "text").alias("h1"), F.xxhash64(F.lit(1), "at", "role", "text").alias("h2"))
    sums = rows.groupBy("conv", "block").agg(F.bit_xor("h1").alias("b1"), F.bit_xor("h2").alias("b2"))
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("conv").alias("s_conv"), F.col("block").alias("s_block"), *[F.coalesce(F.bit_xor(b).over(before), F.lit(0)).alias(b) for b in ("b1", "b2")])
    rows = rows.join(sums, F.col("conv").eqNullSafe(F.col("s_conv")) & (F.col("block") == F.col("s_block")))
    within = Window.partitionBy("conv", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    p = [F.coalesce(F.bit_xor(h).over(within), F.lit(0)).bitwiseXOR(F.col(b)).alias(q) for h, b, q in (("h1", "b1", "p1"), ("h2", "b2", "p2"))]
    return rows.select("conv", "at", *p)


def maximal(rows: DataFrame) -> DataFrame:
    """(keep, n_turns): the conversations that are no snapshot of a longer one, the smallest id of equal ones."""
    whole = rows.groupBy("conv").agg(F.count(F.lit(1)).alias("n_turns"), F.bit_xor(F.xxhash64("at", "role", "text")).alias("w1"), F.bit_xor(F.xxhash64(F.lit(1), "at", "role", "text")).alias("w2"))
    whole = whole.groupBy("n_turns", "w1", "w2").agg(F.min("conv").alias("keep"))
    continued = prefixes(rows).where(F.col("at") > 0).select("at", "p1", "p2").distinct()
    return whole.join(continued, (F.col("n_turns") == F.col("at")) & (F.col("w1") == F.col("p1")) & (F.col("w2") == F.col("p2")), "left_anti").select("keep", "n_turns")


def escaped(text: Column) -> Column:
    """The text with a backslash more in each ``<|``, ``<\\|``, and so on."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def escaped_role(role: Column) -> Column:
    """A role's own ``|>`` must not end it either."""
    return F.regexp_replace(escaped(role), r"\|(\\*)>", r"|\\$1>")


def chat_format(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """conv_id, n_turns, chunk, text: each maximal conversation, rendered in chunks of ``chunk`` turns.

    ``turns`` has conv_id, turn, role and text. Turns are rendered as ``<|role|>\\ntext<|end|>\\n``; chunks joined in
    their order are the conversation, and nearly all conversations are one chunk. Roles and texts cannot forge such
    marks: ``<|`` in them becomes ``<\\|``, ``|>`` in a role ``|\\>``, and a backslash is added to those that stand between already, so that what
    was written can be told.

    Cases: null roles and texts are empty. Turns go by turn number, null first; turns of one number by role and text,
    and these should be few, as they share a block. Repeated rows count once. Turns with a null conv_id are one
    conversation. An empty table gives an empty table. Other columns are left alone.
    """
    rows = staged(positions(turns), "turns")
    kept = rows.join(maximal(rows), F.col("conv").eqNullSafe(F.col("keep")))
    said = F.concat(F.lit("<|"), escaped_role(F.col("role")), F.lit("|>\n"), escaped(F.col("text")), F.lit("<|end|>\n"))
    parts = kept.groupBy("conv", "n_turns", F.expr(f"at div {chunk}").alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("at", said.alias("said")))).alias("turns"))
    return parts.select(F.col("conv").alias("conv_id"), "n_turns", "chunk", F.array_join(F.col("turns.said"), "").alias("text"))


def op1_chat_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format(table(spark, sf_dir, "conversations"))


def _esc(x: str) -> str:
    return f"regexp_replace({x}, '<(\\\\*)\\|', '<\\\\\\1|', 'g')"


def _esc_role(x: str) -> str:
    return f"regexp_replace({_esc(x)}, '\\|(\\\\*)>', '|\\\\\\1>', 'g')"


OP1_SQL = f"""
WITH t AS (SELECT DISTINCT conv_id, coalesce(turn, -4611686018427387904) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
c AS (SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY turn, role, text) AS ts FROM t GROUP BY conv_id),
p AS (SELECT DISTINCT ts[1:k] AS ts FROM (SELECT ts, unnest(range(1, len(ts))) AS k FROM c)),
m AS (SELECT min(conv_id) AS conv_id, ts FROM c GROUP BY ts),
k AS (SELECT conv_id, ts, unnest(range(0, (len(ts) + {CHUNK - 1}) // {CHUNK})) AS chunk FROM m ANTI JOIN p USING (ts))
SELECT conv_id, len(ts)::BIGINT AS n_turns, chunk,
  array_to_string(list_transform(ts[chunk * {CHUNK} + 1:(chunk + 1) * {CHUNK}], lambda x: '<|' || {_esc_role("x.role")} || '|>' || chr(10) || {_esc("x.text")} || '<|end|>' || chr(10)), '') AS text
FROM k
"""
