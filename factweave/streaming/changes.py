"""The change stream: assert, change and retract events from a changelog, as a batch and as a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from ..functions.extract import extract
from ..sources.docstore import SCHEMA

EVENTS = "kind string, entity_id string, doc_id string, old binary, new binary, seq long, at_nanos long"


def change_events(log: DataFrame) -> DataFrame:
    """(kind, entity_id, doc_id, old, new, seq, at_nanos) of a changelog (entity_id, doc_id, seq, op, doc, at_nanos).

    A put of a missing document asserts it, any other put changes it, even to equal bytes; a delete retracts it, and
    one of a missing document is no event.
    """
    w = Window.partitionBy("entity_id", "doc_id").orderBy("seq")
    rows = log.withColumn("old", F.lag("doc").over(w)).withColumn("was", F.coalesce(F.lag("op").over(w) == "put", F.lit(False)))
    kind = F.when((F.col("op") == "put") & ~F.col("was"), "assert").when(F.col("op") == "put", "change").when(F.col("was"), "retract")
    rows = rows.select(kind.alias("kind"), "entity_id", "doc_id", F.when(F.col("was"), F.col("old")).alias("old"), F.when(F.col("op") == "put", F.col("doc")).alias("new"), "seq", "at_nanos")
    return rows.where("kind is not null")


class _Last(StatefulProcessor):
    """Holds each document's last bytes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("last", "doc binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = [r for r in rows]
        if not frames:
            return
        out = []
        held = self._state.get()[0] if self._state.exists() else None
        for r in pd.concat(frames).sort_values("seq").itertuples(index=False):
            if r.op == "put":
                out.append(("assert" if held is None else "change", r.entity_id, r.doc_id, held, bytes(r.doc), r.seq, r.at_nanos))
                held = bytes(r.doc)
            elif held is not None:
                out.append(("retract", r.entity_id, r.doc_id, held, None, r.seq, r.at_nanos))
                held = None
        if held is None:
            self._state.clear()
        else:
            self._state.update((held,))
        if out:
            yield pd.DataFrame(out, columns=["kind", "entity_id", "doc_id", "old", "new", "seq", "at_nanos"])

    def close(self) -> None:
        pass


def change_stream(log: DataFrame) -> DataFrame:
    """The same events from a streaming changelog. Needs the RocksDB state store, which keeps one row a document."""
    return log.groupBy("entity_id", "doc_id").transformWithStateInPandas(_Last(), EVENTS, "Append", "None")


def filtered(events: DataFrame, entity: str = "", prefix: str = "") -> DataFrame:
    """The events of a tenant, of documents whose id starts with ``prefix``; empty filters let all through."""
    if entity:
        events = events.where(F.col("entity_id") == entity)
    return events.where(F.col("doc_id").startswith(prefix)) if prefix else events


def read_log(spark: SparkSession, path: str, files: int = 1000) -> DataFrame:
    """A DocStore's changelog as a stream of its batches, at most ``files`` of their files at a time."""
    reader = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", files)
    return reader.parquet(f"{path.rstrip('/')}/log")


def subscribe(events: DataFrame, callback: Callable[[list], None], checkpoint: str, entity: str = "", prefix: str = "") -> StreamingQuery:
    """Calls ``callback`` with each micro-batch's events, in the order of seq. Every subscriber is a query of its own, and none loses events."""

    def deliver(batch: DataFrame, _: int) -> None:
        rows = batch.orderBy("seq").collect()
        if rows:
            callback(rows)

    return filtered(events, entity, prefix).writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint).outputMode("append").start()


def term_changes(events: DataFrame) -> DataFrame:
    """(kind, entity_id, doc_id, seq, added, removed): what each event changes in the index of terms."""
    old, new = (F.coalesce(_terms(F.col(c)), F.array().cast("array<string>")) for c in ("old", "new"))
    rows = events.select("kind", "entity_id", "doc_id", "seq", old.alias("was"), new.alias("now"))
    return rows.select("kind", "entity_id", "doc_id", "seq", F.array_except("now", "was").alias("added"), F.array_except("was", "now").alias("removed"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _terms(docs: pd.Series) -> pd.Series:
    def of(doc):
        try:
            return extract(doc)[0]
        except ValueError:
            return []

    return docs.map(of, na_action="ignore")
