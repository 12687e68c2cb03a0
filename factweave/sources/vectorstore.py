"""VectorStore: vectors of tenants' scopes, each scope with one dimension and metric, as an append-only changelog."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DimensionMismatch, EmptyVector, InvalidValue, NotFound, ScopeNotFound, check_entity, check_id
from ..functions.vectors import METRICS
from ..operators import vector

SCHEMA = "entity_id string, scope string, id string, seq long, op string, vec array<float>, metric string"


class VectorStore:
    """Operations are insert, delete and drop of a scope; the first insert fixes a scope's dimension and metric."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.path}/log"))
        self._seq = self.log().agg(F.max("seq")).first()[0] or 0
        #: (dim, metric) of the scopes of the tenants that were asked for; a store has one writer, which keeps it up to date.
        self._known: dict[str, dict[str, tuple[int, str]]] = {}

    def log(self) -> DataFrame:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.path}/log")) if s.getPath().getName().startswith("batch-")]
        if not names:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*[f"{self.path}/log/{n}" for n in sorted(names)])

    def _publish(self, rows: DataFrame) -> None:
        name = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        rows.write.parquet(f"{self.path}/_writing-{name}")
        if not self._fs.rename(self._path(f"{self.path}/_writing-{name}"), self._path(f"{self.path}/log/batch-{name}")):
            raise OSError(f"could not publish {name}")

    def _append(self, rows: list[tuple]) -> None:
        rows = [(e, s, i, self._seq + n + 1, op, vec, metric) for n, (e, s, i, op, vec, metric) in enumerate(rows)]
        self._publish(self.spark.createDataFrame(rows, SCHEMA).coalesce(1))
        self._seq += len(rows)

    def _living(self, entity: str) -> DataFrame:
        """The tenant's changes since each scope was last dropped."""
        rows = self.log().where(F.col("entity_id") == check_entity(entity))
        drops = rows.where("op = 'drop'").groupBy(F.col("scope").alias("d_scope")).agg(F.max("seq").alias("dropped"))  # a row a scope
        rows = rows.where("op <> 'drop'").join(drops, F.col("scope") == F.col("d_scope"), "left")
        return rows.where(F.col("seq") > F.coalesce("dropped", F.lit(0))).drop("d_scope", "dropped")

    def current(self, entity: str) -> DataFrame:
        """(scope, id, vec) of the live vectors."""
        last = self._living(entity).groupBy("scope", "id").agg(F.max_by(F.struct("op", "vec"), "seq").alias("x"))
        return last.where("x.op = 'put'").select("scope", "id", "x.vec")

    def scopes(self, entity: str) -> DataFrame:
        """(scope, dim, n, metric), by scope; a scope whose vectors are all deleted stays with n = 0 until it is dropped."""
        first = self._living(entity).where("op = 'put'").groupBy("scope").agg(F.min_by(F.struct(F.size("vec").alias("dim"), "metric"), "seq").alias("x"))
        n = self.current(entity).groupBy("scope").agg(F.count(F.lit(1)).alias("n"))
        return first.join(n, "scope", "left").select("scope", "x.dim", F.coalesce("n", F.lit(0)).alias("n"), "x.metric").orderBy("scope")

    def _scopes(self, entity: str) -> dict[str, tuple[int, str]]:
        """The tenant's scopes; the log is read for them once, not at each insert."""
        if entity not in self._known:
            first = self._living(entity).where("op = 'put'").groupBy("scope").agg(F.min_by(F.struct(F.size("vec").alias("dim"), "metric"), "seq").alias("x"))
            self._known[entity] = {r["scope"]: (r["x"]["dim"], r["x"]["metric"]) for r in first.collect()}
        return self._known[entity]

    def dim(self, entity: str, scope: str) -> int:
        if scope not in self._scopes(entity):
            raise ScopeNotFound(scope)
        return self._scopes(entity)[scope][0]

    def size(self, entity: str, scope: str) -> int:
        """Live vectors of a scope, 0 of an unknown one."""
        return self.current(entity).where(F.col("scope") == scope).count()

    def insert(self, entity: str, scope: str, id: str, vec: list[float], metric: str = "cosine") -> None:
        self.insert_many(entity, scope, {id: vec}, metric)

    def insert_many(self, entity: str, scope: str, vectors: dict[str, list[float]], metric: str = "cosine") -> None:
        check_entity(entity)
        check_id(scope, "scope")
        if metric not in METRICS:
            raise InvalidValue(f"unknown metric {metric!r}")
        known = self._scopes(entity).get(scope)
        dim = known[0] if known else None
        for i, v in vectors.items():
            check_id(i, "id")
            if len(v) == 0:
                raise EmptyVector(i)
            dim = dim or len(v)
            if len(v) != dim:
                raise DimensionMismatch(f"{i} has {len(v)} elements, not {dim}")
        if vectors:
            metric = known[1] if known else metric
            self._append([(entity, scope, i, "put", [float(x) for x in v], metric) for i, v in vectors.items()])
            self._known[entity][scope] = dim, metric

    def insert_rows(self, rows: DataFrame, metric: str = "cosine") -> None:
        """Bulk load of (entity_id, scope, id, vec): runs on the executors. Each scope's vectors must have one dimension, that of the scope if it is there."""
        if metric not in METRICS:
            raise InvalidValue(f"unknown metric {metric!r}")
        rows = rows.select("entity_id", "scope", "id", F.col("vec").cast("array<float>").alias("vec"))
        dims = rows.groupBy("entity_id", "scope").agg(F.min(F.size("vec")).alias("least"), F.max(F.size("vec")).alias("most"), F.count_if(F.col("id").isNull() | (F.col("id") == "")).alias("bad")).collect()
        for r in dims:  # a row a scope
            check_entity(r["entity_id"]), check_id(r["scope"], "scope")
            if r["bad"]:
                raise InvalidValue("id must not be empty")
            if r["least"] <= 0:
                raise EmptyVector(r["scope"])
            known = self._scopes(r["entity_id"]).get(r["scope"], (r["most"], metric))
            if not r["least"] == r["most"] == known[0]:
                raise DimensionMismatch(f"{r['scope']} has vectors of {r['least']} to {r['most']} elements, not {known[0]}")
        metrics = [(r["entity_id"], r["scope"], self._scopes(r["entity_id"]).get(r["scope"], (0, metric))[1]) for r in dims]
        if not metrics:
            return
        of = self.spark.createDataFrame(metrics, "m_entity string, m_scope string, metric string")
        rows = rows.join(of, (F.col("entity_id") == F.col("m_entity")) & (F.col("scope") == F.col("m_scope")))
        # one number for all: of a repeated id the vector that is the largest, element by element, counts
        one = rows.groupBy("entity_id", "scope", "id", "metric").agg(F.max("vec").alias("vec"))
        seq = self._seq + 1
        self._publish(one.select("entity_id", "scope", "id", F.lit(seq).cast("long").alias("seq"), F.lit("put").alias("op"), "vec", "metric"))
        self._seq = seq
        for r in dims:
            self._scopes(r["entity_id"]).setdefault(r["scope"], (r["most"], metric))

    def delete(self, entity: str, scope: str, id: str) -> None:
        if self.current(entity).where((F.col("scope") == scope) & (F.col("id") == id)).isEmpty():
            raise NotFound(f"{scope}/{id}")
        self._append([(entity, scope, id, "del", None, None)])

    def drop_scope(self, entity: str, scope: str) -> None:
        if scope not in self._scopes(entity):
            raise ScopeNotFound(scope)
        self._append([(entity, scope, "", "drop", None, None)])
        del self._known[entity][scope]

    def search(self, entity: str, scope: str, query: list[float], k: int) -> DataFrame:
        if scope not in self._scopes(entity):
            raise ScopeNotFound(scope)
        dim, metric = self._scopes(entity)[scope]
        return vector.knn(self.current(entity).where(F.col("scope") == scope), query, k, metric, dim)
