"""DocStore: tenants' documents as an append-only changelog of Parquet batches, and snapshots of their state.

A batch is written to its own folder and published by renaming it into place, so that a reader sees it whole or not
at all. A document's state is what its last change says; versions count the puts since the last delete. A snapshot
holds the state of all documents up to a batch, partitioned by tenant; readers of the state take the newest snapshot's
rows of a tenant and the batches after it. The changelog stays whole for those who read changes.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import __version__
from ..errors import NotFound, check_entity, check_id
from ..functions import extract
from ..operators import closure
from .facts import DocTable

SCHEMA = "entity_id string, doc_id string, seq long, op string, doc binary, at_nanos long"
STATE = "doc_id string, doc binary, version long, created_at long, updated_at long, entity_id string"
#: Batches after a snapshot that make the next one.
COMPACT_AFTER = 64


class DocStore:
    """One folder of changes; a single writer, any number of readers."""

    def __init__(self, spark: SparkSession, path: str, compact_after: int = COMPACT_AFTER):
        self.spark, self.path, self.compact_after = spark, path.rstrip("/"), compact_after
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(conf)
        for folder in ("log", "snapshots"):
            self._fs.mkdirs(self._path(f"{self.path}/{folder}"))
        self._seq = self.log().agg(F.max("seq")).first()[0] or 0

    def close(self) -> None:
        """Nothing is held open."""

    def health(self) -> dict:
        return {"status": "ok", "version": __version__}

    def _names(self, folder: str, prefix: str) -> list[str]:
        return sorted(n for s in self._fs.listStatus(self._path(f"{self.path}/{folder}")) if (n := s.getPath().getName()).startswith(prefix))

    def _temp(self) -> str:
        return f"{self.path}/_writing-{uuid.uuid4().hex}"

    def _snapshot(self) -> str | None:
        """The newest snapshot, named by the last batch that it covers."""
        names = self._names("snapshots", "until-")
        return names[-1] if names else None

    def log(self, after: str = "") -> DataFrame:
        """All published changes, or those of the batches behind the batch ``after``."""
        names = [n for n in self._names("log", "batch-") if n > after]
        if not names:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*[f"{self.path}/log/{n}" for n in names])

    def _state(self, entity: str | None) -> tuple[DataFrame, DataFrame]:
        """The newest snapshot and the changes since, of a tenant or of all."""
        name = self._snapshot()
        if name is None:
            base, tail = self.spark.createDataFrame([], STATE), self.log()
        else:
            base, tail = self.spark.read.schema(STATE).parquet(f"{self.path}/snapshots/{name}"), self.log(name.removeprefix("until-"))
        if entity is None:
            return base, tail
        return (x.where(F.col("entity_id") == check_entity(entity)) for x in (base, tail))

    def _publish(self, rows: DataFrame) -> None:
        name = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        temp = f"{self.path}/_writing-{name}"
        rows.write.option("compression", "snappy").parquet(temp)
        if not self._fs.rename(self._path(temp), self._path(f"{self.path}/log/batch-{name}")):
            raise OSError(f"could not publish {temp}")
        newest = self._snapshot()
        if sum(n > (newest or "").removeprefix("until-") for n in self._names("log", "batch-")) >= self.compact_after:
            self.compact()

    def compact(self) -> None:
        """Write a snapshot of all documents, partitioned by tenant, and delete the ones before it but the last, which may be being read."""
        names, old = self._names("log", "batch-"), self._names("snapshots", "until-")
        if not names or (old and old[-1] == f"until-{names[-1]}"):
            return
        temp = self._temp()
        self.current().write.option("compression", "snappy").partitionBy("entity_id").parquet(temp)
        if not self._fs.rename(self._path(temp), self._path(f"{self.path}/snapshots/until-{names[-1]}")):
            raise OSError(f"could not publish {temp}")
        for name in old[:-1]:
            self._fs.delete(self._path(f"{self.path}/snapshots/{name}"), True)

    def _append(self, changes: list[tuple[str, str, str, bytes | None]]) -> None:
        now = time.time_ns()
        rows = [(e, d, self._seq + i + 1, op, None if doc is None else bytearray(doc), now) for i, (e, d, op, doc) in enumerate(changes)]
        self._publish(self.spark.createDataFrame(rows, SCHEMA).coalesce(1))
        self._seq += len(rows)

    def put(self, entity: str, doc_id: str, doc: bytes) -> None:
        self.batch_put(entity, {doc_id: doc})

    def batch_put(self, entity: str, docs: dict[str, bytes] | Iterable[tuple[str, bytes]]) -> None:
        """All documents in one batch, or none; of repeated ids the last one counts. A parent that would close a cycle raises."""
        check_entity(entity)
        docs = dict(docs)
        for d in docs:
            check_id(d)
        if not docs:
            return
        parents = {d: p for d, doc in docs.items() if (p := extract._object(doc).get("parent")) and isinstance(p, str)}
        if parents:
            added = self.spark.createDataFrame(list(parents.items()), "doc_id string, parent string")
            closure.check_edges(self.facts(entity).edges().where(~F.col("doc_id").isin(*docs)).unionByName(added), self._temp())
        self._append([(entity, d, "put", doc) for d, doc in docs.items()])

    def put_rows(self, rows: DataFrame) -> None:
        """Bulk load of (entity_id, doc_id, doc); of repeated keys the one with the largest bytes counts. Runs on the executors.

        Like a single put it raises, and loads nothing, if a parent closes a cycle; all documents are checked at once.
        """
        bad = rows.where("entity_id is null or entity_id = '' or contains(entity_id, ':') or doc_id is null or doc_id = ''").limit(1)
        if not bad.isEmpty():
            r = bad.first()
            check_entity(r["entity_id"])
            check_id(r["doc_id"])
        one = rows.groupBy("entity_id", "doc_id").agg(F.max(F.col("doc").cast("binary")).alias("doc"))
        self._check_hierarchy(one)
        # One number for the whole batch: its keys are distinct, so that nothing in it needs an order.
        seq = self._seq + 1
        self._publish(one.select("entity_id", "doc_id", F.lit(seq).cast("long").alias("seq"), F.lit("put").alias("op"), "doc", F.lit(time.time_ns()).alias("at_nanos")))
        self._seq = seq

    def put_changes(self, changes: DataFrame) -> None:
        """Bulk load of a changelog (entity_id, doc_id, seq, op, doc, at_nanos); its numbers count on from the last one here."""
        rows = changes.select("entity_id", "doc_id", (F.col("seq") + self._seq).alias("seq"), "op", "doc", "at_nanos")
        self._publish(rows)
        self._seq = max(self._seq, self.log().agg(F.max("seq")).first()[0] or 0)

    def _check_hierarchy(self, docs: DataFrame) -> None:
        """Whether the tenants' hierarchies hold with ``docs`` (entity_id, doc_id, doc): for all at once, over keys of tenant and id."""
        key = lambda c: F.concat("entity_id", F.lit(":"), c)
        new = extract.edges(extract.project(docs)).select(key("doc_id").alias("doc_id"), key("parent").alias("parent"))
        if new.isEmpty():
            return
        old = extract.edges(extract.project(self._latest(*self._state(None)).join(docs.select("entity_id", "doc_id"), ["entity_id", "doc_id"], "left_anti")))
        closure.check_edges(old.select(key("doc_id").alias("doc_id"), key("parent").alias("parent")).unionByName(new), self._temp())

    def delete(self, entity: str, doc_id: str) -> None:
        """What is not there needs no delete, and makes no change."""
        check_entity(entity)
        check_id(doc_id)
        if not self.latest(entity).where(F.col("doc_id") == doc_id).isEmpty():
            self._append([(entity, doc_id, "del", None)])

    def current(self, entity: str | None = None) -> DataFrame:
        """(entity_id, doc_id, doc, version, created_at, updated_at) of the live documents."""
        base, tail = self._state(entity)
        w = Window.partitionBy("entity_id", "doc_id").orderBy("seq")
        rows = tail.withColumn("life", F.sum((F.col("op") == "del").cast("long")).over(w))
        last = Window.partitionBy("entity_id", "doc_id").orderBy(F.col("seq").desc())
        life = Window.partitionBy("entity_id", "doc_id", "life")
        puts = F.count_if(F.col("op") == "put").over(life)
        born = F.min(F.when(F.col("op") == "put", F.col("at_nanos"))).over(life)
        rows = rows.withColumn("puts", puts).withColumn("born", born).withColumn("nth", F.row_number().over(last)).where("nth = 1")
        rows = rows.select(F.col("entity_id").alias("e"), F.col("doc_id").alias("d"), "op", F.col("doc").alias("new"), "life", "puts", "born", "at_nanos")
        both = base.join(rows, (F.col("entity_id") == F.col("e")) & (F.col("doc_id") == F.col("d")), "full").where("op is null or op = 'put'")
        same = F.col("op").isNull()
        on = (F.col("life") == 0) & F.col("version").isNotNull()  # put again, without a delete since the snapshot
        return both.select(
            F.coalesce("entity_id", "e").alias("entity_id"),
            F.coalesce("doc_id", "d").alias("doc_id"),
            F.when(same, F.col("doc")).otherwise(F.col("new")).alias("doc"),
            F.when(same, F.col("version")).when(on, F.col("version") + F.col("puts")).otherwise(F.col("puts")).alias("version"),
            F.when(same | on, F.col("created_at")).otherwise(F.col("born")).alias("created_at"),
            F.when(same, F.col("updated_at")).otherwise(F.col("at_nanos")).alias("updated_at"),
        )

    @staticmethod
    def _latest(base: DataFrame, tail: DataFrame) -> DataFrame:
        """(entity_id, doc_id, doc): one aggregation, which keeps only the last change of a key; the snapshot's rows come before all."""
        rows = tail.select("entity_id", "doc_id", "seq", "op", "doc").unionByName(base.select("entity_id", "doc_id", F.lit(-1).cast("long").alias("seq"), F.lit("put").alias("op"), "doc"))
        last = rows.groupBy("entity_id", "doc_id").agg(F.max_by(F.struct("op", "doc"), "seq").alias("last"))
        return last.where("last.op = 'put'").select("entity_id", "doc_id", "last.doc")

    def latest(self, entity: str) -> DataFrame:
        """(doc_id, doc) of the tenant's live documents."""
        return self._latest(*self._state(entity)).drop("entity_id")

    def get(self, entity: str, doc_id: str) -> bytes:
        row = self.latest(entity).where(F.col("doc_id") == check_id(doc_id)).first()
        if row is None:
            raise NotFound(f"{entity}/{doc_id}")
        return bytes(row["doc"])

    def scan(self, entity: str, each: Callable[[str, bytes], bool] | None = None) -> DataFrame:
        """The tenant's (doc_id, doc); ``each`` is called with them one by one until it returns False."""
        rows = self.latest(entity)
        if each is not None:
            for r in rows.toLocalIterator():
                if each(r["doc_id"], bytes(r["doc"])) is False:
                    break
        return rows

    def facts(self, entity: str) -> DocTable:
        return DocTable(self.latest(entity), entity)
