"""Mixing sources to target weights by Pfair scheduling (DataFrame functions only).

A weight is a fraction w of all slots. The i-th block of a source is released at slot floor((i-1) / w) and due before
slot ceil(i / w). In each slot the released block with the earliest deadline runs. The weights add up to one, so
earliest-deadline-first meets all deadlines: after t slots a source has had w * t blocks, give or take less than one.
Such a schedule repeats as soon as every w * t is whole; that one period is computed, and its size depends on the
weights' denominators, not on the data.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import free_names, table

#: Documents in a block, most slots in a period, rows that a bucket of a source should not exceed by much.
BLOCK, LONGEST, BUCKET_ROWS = 64, 10_000, 4096
#: Production weights; all other sources, null among them, share OTHER.
WEIGHTS, OTHER = {"src0": 0.25, "src1": 0.10, "src2": 0.10, "src3": 0.05, "src4": 0.05, "src5": 0.05, "src6": 0.05, "src7": 0.05}, 0.30


def quotas(weights: dict[str, float], other: float) -> list[tuple[str | None, int]]:
    """Each group's blocks in one period, exactly in proportion to the weights; the group None is of all other sources.

    Weights are taken as the decimals that they are written as, and divided by their sum. If their common period has
    more than ``LONGEST`` slots the weights are refused: rounding them would make the mix drift away from its target.
    """
    groups = [*sorted(weights.items()), (None, other)]
    if any(not 0 < w < math.inf for _, w in groups):
        raise ValueError("weights must be positive")
    exact = [Fraction(repr(w) if isinstance(w, float) else w) for _, w in groups]
    shares = [w / sum(exact) for w in exact]
    period = math.lcm(*(w.denominator for w in shares))
    if period > LONGEST:
        raise ValueError(f"the weights repeat only after {period} slots; round them so that it is {LONGEST} at most")
    return [(name, int(w * period)) for (name, _), w in zip(groups, shares)]


def schedule(spark: SparkSession, quota: list[int]) -> DataFrame:
    """(grp, nth, slot): the slot of each group's nth block in one period of sum(quota) slots; ties go to the first group."""
    period, k = sum(quota), len(quota)
    q = f"array({', '.join(f'{a}L' for a in quota)})"
    pick = f"""array_min(filter(transform({q}, (a, j) -> if(element_at(s.had, j + 1) < a and element_at(s.had, j + 1) * {period}L div a <= t,
        named_struct('due', ((element_at(s.had, j + 1) + 1) * {period}L + a - 1) div a, 'j', j), null)), x -> x is not null)).j"""
    fold = f"""aggregate(sequence(0L, {period - 1}L), named_struct('had', array_repeat(0L, {k}), 'runs', cast(array() as array<int>)),
        (s, t) -> transform(array({pick}), p -> named_struct(
            'had', transform(s.had, (c, i) -> if(i = p, c + 1L, c)), 'runs', concat(s.runs, array(p))))[0]).runs"""
    runs = spark.range(1).select(F.posexplode(F.expr(fold)).alias("slot", "grp"))
    nth = F.row_number().over(Window.partitionBy("grp").orderBy("slot")) - 1
    return runs.select("grp", nth.cast("long").alias("nth"), F.col("slot").cast("long").alias("slot"))


def mixed(docs: DataFrame, weights: dict[str, float], other: float, block: int = BLOCK, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """All columns of ``docs`` (doc_id, source, ...), and ``_mix`` = struct(grp, block, slot, pos).

    Ordering the rows by (slot, pos) interleaves the sources. Documents of a source stand in the order of
    md5(doc_id), so each block is a fixed random sample, and ``block`` documents make a block; the last one may be
    shorter. As long as no source has ended, each has had its weight's share of the blocks, with less than one block of
    deviation, however long the schedule. A source that has ended leaves its slots empty: no row is dropped or repeated, and
    the others keep their proportions.

    A row's rank in its source is its rank in one of many buckets, cut from the order by ranges of md5, and the
    number of rows in the buckets before: no source is gathered in one task.

    Cases: sources without a weight, null among them, are one group with weight ``other``. Rows with a null doc_id are
    ordered by a hash of all their columns. Rows of one doc_id and source are ties: each gets a place of its own, which of
    them gets which is open.
    An empty table gives an empty table. Extra columns stay; only ``_mix`` is reserved.
    """
    spark = docs.sparkSession
    shares = quotas(weights, other)
    period = sum(a for _, a in shares)
    group = F.lit(len(shares) - 1)
    for i, (name, _) in enumerate(shares[:-1]):
        group = F.when(F.col("source") == name, i).otherwise(group)
    # rows without an id are spread by what else they hold, as there may be many
    others = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    rank_key = F.coalesce(F.md5(F.col("doc_id").cast("string")), F.md5(F.concat(F.lit("row "), F.xxhash64(*others).cast("string"))))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(group, F.lit(len(shares) - 1)).alias("grp"), rank_key.alias("rank_key"))
    buckets = max(256, 2 ** math.ceil(math.log2(max(1, docs.count() / bucket_rows))))
    rows = rows.withColumn("bucket", F.floor(F.conv(F.substring("rank_key", 1, 8), 16, 10).cast("long") * buckets / 2**32))
    sizes = rows.groupBy("grp", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("grp").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col("grp").alias("s_grp"), F.col("bucket").alias("s_bucket"), before.alias("before"))
    local = F.row_number().over(Window.partitionBy("grp", "bucket").orderBy("rank_key"))
    rows = rows.withColumn("local", local).join(starts, (F.col("grp") == F.col("s_grp")) & (F.col("bucket") == F.col("s_bucket")))
    rank = F.col("before") + F.col("local") - 1
    rows = rows.withColumn("at", rank).withColumn("block", F.expr(f"at div {block}")).withColumn("pos", F.col("at") % block)
    quota = F.element_at(F.array(*[F.lit(a).cast("long") for _, a in shares]), F.col("grp") + 1)
    rows = rows.withColumn("quota", quota).withColumn("round", F.expr("block div quota")).withColumn("turn", F.col("block") % F.col("quota"))
    plan = schedule(spark, [a for _, a in shares]).withColumnsRenamed({"grp": "p_grp", "slot": "p_slot"})  # `period` rows
    rows = rows.join(F.broadcast(plan), (F.col("grp") == F.col("p_grp")) & (F.col("turn") == F.col("nth")))
    mix = F.struct("grp", "block", (F.col("round") * period + F.col("p_slot")).alias("slot"), "pos")
    return rows.select("row", mix.alias("_mix")).select("row.*", "_mix")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixed(docs, WEIGHTS, OTHER).select("doc_id", "source", "_mix.block", "_mix.slot", "_mix.pos")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with all their columns, the slot of their block and their place in it: slot and pos.

    Cases are those of ``mixed``. Where a column of ``docs`` is named so already, ours get underscores behind.
    """
    slot, pos = free_names(docs, "slot", "pos")
    return mixed(docs, WEIGHTS, OTHER).select(*[F.col(f"`{c}`") for c in docs.columns], F.col("_mix.slot").alias(slot), F.col("_mix.pos").alias(pos))


_Q = quotas(WEIGHTS, OTHER)
_PERIOD = sum(a for _, a in _Q)
_CASES = " ".join(f"WHEN '{name}' THEN {i}" for i, (name, _) in enumerate(_Q[:-1]))
_LIST = "[" + ", ".join(f"{a}::BIGINT" for _, a in _Q) + "]"
OP4_SQL = f"""
WITH RECURSIVE edf(t, had, pick) AS (
  SELECT -1::BIGINT, list_transform(range({len(_Q)}), lambda x: 0::BIGINT), -1::BIGINT
  UNION ALL
  SELECT t, list_transform(range({len(_Q)}), lambda j: had[j + 1] + (CASE WHEN j = p THEN 1 ELSE 0 END)), p FROM (
    SELECT t + 1 AS t, had, list_min(list_transform(list_filter(range({len(_Q)}), lambda j: had[j + 1] < {_LIST}[j + 1] AND had[j + 1] * {_PERIOD} // {_LIST}[j + 1] <= t + 1),
      lambda j: (((had[j + 1] + 1) * {_PERIOD} + {_LIST}[j + 1] - 1) // {_LIST}[j + 1]) * 1000 + j)) % 1000 AS p
    FROM edf WHERE t < {_PERIOD - 1})),
plan AS (SELECT pick AS grp, t AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS nth FROM edf WHERE t >= 0),
d AS (SELECT doc_id, source, CASE source {_CASES} ELSE {len(_Q) - 1} END AS grp FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY md5(coalesce(doc_id::VARCHAR, ''))) - 1 AS rank FROM d),
b AS (SELECT *, rank // {BLOCK} AS block, rank % {BLOCK} AS pos, {_LIST}[grp + 1] AS quota FROM r)
SELECT doc_id, source, block, (block // quota) * {_PERIOD} + slot AS slot, pos
FROM b JOIN plan ON plan.grp = b.grp AND plan.nth = b.block % quota
"""
