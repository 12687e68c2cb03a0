"""Vectors: exact nearest neighbours of one or many queries, approximate ones, and scopes with a fixed dimension."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import DimensionMismatch, EmptyVector, InvalidValue
from ..functions.vectors import METRICS

#: Query vectors that one broadcast block holds.
QUERY_BLOCK = 4096


def _checked(query: list[float], k: int, metric: str) -> None:
    if metric not in METRICS:
        raise InvalidValue(f"unknown metric {metric!r}")
    if len(query) == 0:
        raise EmptyVector("the query has no elements")


def knn(vectors: DataFrame, query: list[float], k: int, metric: str = "cosine", dim: int | None = None) -> DataFrame:
    """(id, dist): the ``k`` nearest of ``vectors`` (id, vec), closest first, ties by id; k of 0 or less gives none.

    One scan with a partial top-k in each task.
    """
    _checked(query, k, metric)
    if dim is not None and len(query) != dim:
        raise DimensionMismatch(f"the query has {len(query)} elements, not {dim}")
    q = F.array(*[F.lit(float(np.float32(x))) for x in query])
    rows = vectors.where(F.size("vec") == len(query)).select("id", METRICS[metric](F.col("vec"), q).alias("dist"))
    return rows.orderBy("dist", "id").limit(max(0, k))


def _distances(queries: np.ndarray, rows: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        norms = np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(rows, axis=1)[None]
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(norms == 0, 1.0, 1.0 - queries @ rows.T / norms)
    # not by the expanded square, which loses digits where vectors are close
    return np.sqrt(np.array([((rows - q) ** 2).sum(1) for q in queries])).reshape(len(queries), len(rows))


def knn_batch(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, id, dist, rank) of every query's ``k`` nearest; ``queries`` has query_id and vec.

    Queries go in blocks of ``block``: each block is sent to all tasks, which keep the k best of their rows; only those
    are shuffled. Vectors of another dimension than a query's are not its neighbours.
    """
    if metric not in METRICS:
        raise InvalidValue(f"unknown metric {metric!r}")
    id_type = vectors.schema["id"].dataType.simpleString()
    q_type = queries.schema["query_id"].dataType.simpleString()
    out = None
    held: list = []

    def search(rows: list) -> DataFrame:
        ids = [r["query_id"] for r in rows]
        by_dim: dict[int, list[int]] = {}
        for i, r in enumerate(rows):
            by_dim.setdefault(len(r["vec"]), []).append(i)
        sets = {d: (np.array(at), np.array([rows[i]["vec"] for i in at], np.float64)) for d, at in by_dim.items()}
        cast = vectors.sparkSession.sparkContext.broadcast(sets)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: dict[int, tuple[np.ndarray, list]] = {}
            for batch in batches:
                names, vecs = batch.column("id").to_pylist(), batch.column("vec").to_pylist()
                for d, (at, q) in cast.value.items():
                    mine = [i for i, v in enumerate(vecs) if v is not None and len(v) == d]
                    if not mine:
                        continue
                    dist = _distances(q, np.array([vecs[i] for i in mine], np.float64), metric)
                    for n, row in zip(at, dist):
                        old = best.get(int(n), (np.zeros(0), []))
                        far, who = np.r_[old[0], row], old[1] + [names[i] for i in mine]
                        edge = np.partition(far, k - 1)[k - 1] if len(far) > k else np.inf
                        near = sorted((i for i in range(len(far)) if far[i] <= edge), key=lambda i: (far[i], who[i]))[:k]
                        best[int(n)] = far[near], [who[i] for i in near]
            for n, (far, who) in best.items():
                yield pa.RecordBatch.from_arrays([pa.array([n] * len(who), pa.int64()), pa.array(who, type=batch_type), pa.array(far, pa.float64())], names=["n", "id", "dist"])

        batch_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[id_type]
        got = vectors.select("id", "vec").mapInArrow(scan, f"n long, id {id_type}, dist double")
        got = got.withColumn("rank", F.row_number().over(Window.partitionBy("n").orderBy("dist", "id"))).where(F.col("rank") <= k)
        keys = vectors.sparkSession.createDataFrame(list(enumerate(ids)), f"qn long, query_id {q_type}")
        return got.join(F.broadcast(keys), F.col("n") == F.col("qn")).select("query_id", "id", "dist", "rank")

    if k <= 0:
        return queries.select("query_id").limit(0).join(vectors.select("id").limit(0), F.lit(True)).select("query_id", "id", F.lit(0.0).alias("dist"), F.lit(0).alias("rank"))
    for row in queries.select("query_id", "vec").toLocalIterator():
        held.append(row)
        if len(held) == block:
            part, held = search(held), []
            out = part if out is None else out.unionByName(part)
    if held or out is None:
        part = search(held)
        out = part if out is None else out.unionByName(part)
    return out


def knn_approximate(vectors: DataFrame, query: list[float], k: int, metric: str = "cosine", tables: int = 8, bucket: float | None = None) -> DataFrame:
    """(id, dist) by random-projection hashing: faster to repeat, with a recall that ``tables`` raises."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    _checked(query, k, metric)
    v, q = F.col("vec").cast("array<double>"), np.array(query, float)
    if metric == "cosine":  # among vectors of length 1 the euclidean order is the cosine order
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
        v, q = F.transform(v, lambda x: x / F.greatest(norm, F.lit(1e-30))), q / max(float(np.linalg.norm(q)), 1e-30)
    rows = vectors.where(F.size("vec") == len(query)).select("id", array_to_vector(v).alias("features"))
    lsh = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=bucket or 2.0, numHashTables=tables, seed=7)
    near = lsh.fit(rows).approxNearestNeighbors(rows, Vectors.dense(q), max(1, k), distCol="d")
    dist = F.col("d") ** 2 / 2 if metric == "cosine" else F.col("d")
    return near.select("id", dist.alias("dist")).orderBy("dist", "id").limit(max(0, k))
