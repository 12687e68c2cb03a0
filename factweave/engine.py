"""Engine: one folder of documents and vectors, and every operator by tenant.

Results are DataFrames, so that they can be ordered, limited, joined and written like any other; single values are
plain Python.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from .operators import closure, lookup, rollup, temporal
from .plans.query import Agg, query
from .sources.docstore import DocStore
from .sources.vectorstore import VectorStore
from .streaming import changes


class Engine:
    def __init__(self, spark: SparkSession, path: str):
        self.docs = DocStore(spark, f"{path.rstrip('/')}/docs")
        self.vectors = VectorStore(spark, f"{path.rstrip('/')}/vectors")
        self.path = path.rstrip("/")

    def health(self) -> dict:
        return self.docs.health()

    def compact(self) -> None:
        self.docs.compact()

    def put(self, entity: str, doc_id: str, doc: bytes) -> None:
        self.docs.put(entity, doc_id, doc)

    def batch_put(self, entity: str, docs: dict[str, bytes]) -> None:
        self.docs.batch_put(entity, docs)

    def get(self, entity: str, doc_id: str) -> bytes:
        return self.docs.get(entity, doc_id)

    def delete(self, entity: str, doc_id: str) -> None:
        self.docs.delete(entity, doc_id)

    def scan(self, entity: str, each: Callable[[str, bytes], bool] | None = None) -> DataFrame:
        return self.docs.scan(entity, each)

    def lookup(self, entity: str, term: str) -> DataFrame:
        return lookup.lookup(self.docs.facts(entity), term)

    def lookup_prefix(self, entity: str, prefix: str) -> DataFrame:
        return lookup.lookup_prefix(self.docs.facts(entity), prefix)

    def lookup_numeric_range(self, entity: str, attr: str, low: float, high: float, low_open: bool = False, high_open: bool = False) -> DataFrame:
        return lookup.lookup_range(self.docs.facts(entity), attr, low, high, low_open, high_open)

    def window_query(self, entity: str, item_id: str, types: list[str] = (), window: int = 0) -> DataFrame:
        return temporal.window_query(self.docs.facts(entity), item_id, types, window)

    def cluster_query(self, entity: str, item_id: str, types: list[str], window: int, min_size: int) -> DataFrame:
        return temporal.cluster_query(self.docs.facts(entity), window, min_size, types, item_id)

    def cluster_members(self, entity: str, item_id: str, types: list[str], window: int, min_size: int) -> DataFrame:
        """The events of each cluster, which ``cluster`` numbers as in ``cluster_query``."""
        return temporal.cluster_members(self.docs.facts(entity), window, min_size, types, item_id)

    def sequence_join(self, entity: str, items: list[str], steps: list[str], window: int) -> DataFrame:
        """No items are all items."""
        return temporal.sequence_join(self.docs.facts(entity), steps, window, items or None)

    def last_seen(self, entity: str, item_id: str, kind: str) -> int | None:
        row = rollup.last_seen(self.docs.facts(entity)).where((F.col("item_id") == item_id) & (F.col("type") == kind)).first()
        return row["last_at"] if row else None

    def group_count(self, entity: str, item_id: str, attr: str, value: str) -> tuple[int, int, int, DataFrame]:
        """How many documents, their first and last time, and the documents."""
        facts = self.docs.facts(entity)
        return (*rollup.group_count(facts, item_id, attr, value).first(), rollup.group_members(facts, item_id, attr, value))

    def stats(self, entity: str, attr: str) -> dict:
        row = rollup.stats(self.docs.facts(entity), attr).first()
        return row.asDict() if row else {"path": attr, "n": 0, "mean": 0.0, "m2": 0.0, "min": 0.0, "max": 0.0}

    def ancestors(self, entity: str, doc_id: str) -> list[str]:
        return [r["ancestor"] for r in closure.ancestors(self.docs.facts(entity).edges(), doc_id).collect()]

    def descendants(self, entity: str, root: str) -> DataFrame:
        return closure.descendants(self.docs.facts(entity).edges(), root).select("doc_id")

    def query(self, entity: str, where: list, find: list[str] = (), aggregates: list[Agg] = (), group_by: list[str] = ()) -> DataFrame:
        return query(self.docs.facts(entity), where, find, aggregates, group_by, ordered=True)

    def vector_insert(self, entity: str, scope: str, id: str, vec: list[float], metric: str = "cosine") -> None:
        self.vectors.insert(entity, scope, id, vec, metric)

    def vector_search(self, entity: str, scope: str, vec: list[float], k: int) -> DataFrame:
        return self.vectors.search(entity, scope, vec, k)

    def vector_delete(self, entity: str, scope: str, id: str) -> None:
        self.vectors.delete(entity, scope, id)

    def vector_drop_scope(self, entity: str, scope: str) -> None:
        self.vectors.drop_scope(entity, scope)

    def vector_list_scopes(self, entity: str) -> DataFrame:
        return self.vectors.scopes(entity)

    def subscribe(self, callback: Callable[[list], None], entity: str = "", prefix: str = "", checkpoint: str | None = None) -> StreamingQuery:
        """Events of changes from now on; one query a subscriber."""
        events = changes.change_stream(changes.read_log(self.docs.spark, self.docs.path))
        # all changes are read, as what was there before decides between assert and change; only new events are let through
        events = events.where(F.col("at_nanos") > time.time_ns())
        return changes.subscribe(events, callback, checkpoint or f"{self.path}/subscribers/{uuid.uuid4().hex}", entity, prefix)
