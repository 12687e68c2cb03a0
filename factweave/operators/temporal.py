"""Event-log operators: ordered reads, sequences and clusters. Events go by (at, doc_id) within an item.

Windows partitioned by item spill; nothing gathers an item's whole log in one row.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.facts import DocTable, FactTable


def window_query(facts: FactTable | DocTable, item_id, types: list[str] = (), window: int = 0) -> DataFrame:
    """An item's events in their order, of the given types or of all. ``window`` is accepted and ignored."""
    rows = facts.events().where(F.col("item_id") == item_id)
    if types:
        rows = rows.where(F.col("type").isin(*types))
    return rows.orderBy("at", "doc_id")


def sequence_join(facts: FactTable | DocTable, steps: list[str], window: int = 0, items: list | None = None) -> DataFrame:
    """(item_id, at_0.., doc_0..): each item's first match of ``steps``, one followed by the next.

    From each event of the first type, the next event of each later type is taken; a match counts if it spans
    ``window`` nanoseconds at most (0 or less: any span), and the first start that leads to one wins. ``items``
    restricts the items. All steps share one exchange and one sort: the log is read backwards, so that "the next event
    of a type" is the last one seen.
    """
    if not steps:
        return facts.events().select("item_id").limit(0)
    rows = facts.events().where(F.col("type").isin(*set(steps)))
    if items is not None:
        rows = rows.where(F.col("item_id").isin(*items))
    back = Window.partitionBy("item_id").orderBy(F.col("at").desc(), F.col("doc_id").desc()).rowsBetween(Window.unboundedPreceding, -1)
    here = F.struct("at", "doc_id")
    rows = rows.withColumn("chain", F.when(F.col("type") == steps[-1], F.array(here)))
    for step in reversed(steps[:-1]):
        # an event whose later steps are missing still hides those behind it
        rows = rows.withColumn("next", F.last("chain", ignorenulls=True).over(back))
        rows = rows.withColumn("chain", F.when(F.col("type") == step, F.concat(F.array(here), F.coalesce("next", F.slice(F.array(here), 1, 0)))))
    n = len(steps)
    ok = F.size("chain") == n
    if window > 0:
        ok = ok & (F.element_at("chain", n)["at"] - F.element_at("chain", 1)["at"] <= window)
    first = rows.where((F.col("type") == steps[0]) & ok).groupBy("item_id").agg(F.min("chain").alias("c"))
    return first.select("item_id", *[F.col("c")[i]["at"].alias(f"at_{i}") for i in range(n)], *[F.col("c")[i]["doc_id"].alias(f"doc_{i}") for i in range(n)])


def _clustered(rows: DataFrame, window: int, min_size: int) -> DataFrame:
    """(item_id, cluster, at, doc_id): every event of every cluster, clusters numbered from 0 within their item.

    One pass over each item's events in their order. What is held is an item's open cluster while it has fewer than
    ``min_size`` events; later members go out at once, so a log of any length and steadiness takes bounded memory.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item, few, start, n, number = None, deque(), 0, 0, 0  # the open cluster: its events while too few, its start and size
        for batch in batches:
            out: list[tuple] = []
            for key, at, doc in zip(*(batch.column(c).to_pylist() for c in ("item_id", "at", "doc_id"))):
                if key != item:
                    item, n, number = key, 0, 0
                    few.clear()
                if n >= min_size and 0 < window < at - start:  # the open cluster is complete
                    n, number = 0, number + 1
                    few.clear()
                if n >= min_size:
                    n += 1
                    out.append((item, number, at, doc))
                    continue
                few.append((at, doc))
                while 0 < window < at - few[0][0]:  # too few by now: the search goes on at the next event
                    few.popleft()
                start, n = few[0][0], len(few)
                if n >= min_size:
                    out += [(item, number, a, d) for a, d in few]
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, (batch.schema.field("item_id").type, pa.int64(), pa.int64(), batch.schema.field("doc_id").type))], names=["item_id", "cluster", "at", "doc_id"])

    types = dict(rows.dtypes)
    rows = rows.select("item_id", F.col("at").cast("long").alias("at"), "doc_id").repartition("item_id").sortWithinPartitions("item_id", "at", "doc_id")
    return rows.mapInArrow(fold, f"item_id {types['item_id']}, cluster long, at long, doc_id {types['doc_id']}")


def cluster_members(facts: FactTable | DocTable, window: int, min_size: int = 1, types: list[str] = (), item_id=None) -> DataFrame:
    """(item_id, cluster, at, doc_id): the events of greedy clusters of at least ``min_size`` events within ``window`` nanoseconds.

    From an event as many as possible follow that are at most ``window`` after it; if they are enough they are a
    cluster and the search goes on behind them, else at the next event. A window of 0 or less has no bound, so that an
    item is one cluster. Clusters are numbered from 0 within their item, in the order of time.
    """
    rows = facts.events()
    if types:
        rows = rows.where(F.col("type").isin(*types))
    if item_id is not None:
        rows = rows.where(F.col("item_id") == item_id)
    return _clustered(rows, window, max(1, min_size))


def cluster_query(facts: FactTable | DocTable, window: int, min_size: int = 1, types: list[str] = (), item_id=None) -> DataFrame:
    """(item_id, cluster, first_at, last_at, n) of the clusters of ``cluster_members``."""
    rows = cluster_members(facts, window, min_size, types, item_id)
    return rows.groupBy("item_id", "cluster").agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count(F.lit(1)).alias("n"))
