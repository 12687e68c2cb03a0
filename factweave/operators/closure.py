"""Hierarchies: ancestors, descendants and the whole closure of (doc_id, parent) edges, by recursive SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ClosureCycle

#: Levels of a hierarchy; a longer chain is an error.
MAX_DEPTH = 256


def closure(edges: DataFrame, start: str | None = None, column: str = "doc_id") -> DataFrame:
    """(doc_id, ancestor, depth): each node with all above it, depth 1 for its parent.

    ``start`` begins at one node only, as the lower end (``column`` doc_id) or the upper one (parent). A node may be its own ancestor only in a cycle, which raises as soon as the
    rows are read, like chains of more than MAX_DEPTH.
    """
    edges = edges.select("doc_id", "parent")
    begin = "" if start is None else f"WHERE {column} = {_literal(start)}"
    up = f"SELECT c.doc_id, e.parent, c.depth + 1 FROM c JOIN {{edges}} e ON e.doc_id = c.ancestor WHERE c.depth <= {MAX_DEPTH} AND c.ancestor <> c.doc_id"
    down = f"SELECT e.doc_id, c.ancestor, c.depth + 1 FROM c JOIN {{edges}} e ON e.parent = c.doc_id WHERE c.depth <= {MAX_DEPTH} AND c.ancestor <> c.doc_id"
    step = down if start is not None and column == "parent" else up
    # LIMIT ALL lifts the limit of recursive rows for this query alone
    rows = edges.sparkSession.sql(
        f"""WITH RECURSIVE c(doc_id, ancestor, depth) MAX RECURSION LEVEL {MAX_DEPTH + 44} AS (
            SELECT doc_id, parent, 1 FROM {{edges}} {begin} UNION ALL {step}) SELECT doc_id, ancestor, depth FROM c LIMIT ALL""",
        edges=edges)
    deep = F.raise_error(F.lit(f"the hierarchy has a cycle or more than {MAX_DEPTH} levels"))
    return rows.where(F.when((F.col("depth") > MAX_DEPTH) | (F.col("doc_id") == F.col("ancestor")), deep.cast("boolean")).otherwise(True))


def _literal(value: str) -> str:
    if not isinstance(value, str):
        return str(int(value))
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def ancestors(edges: DataFrame, doc_id: str) -> DataFrame:
    """(ancestor, depth) from the parent up; a root or an unknown node has none."""
    return closure(edges, doc_id).select("ancestor", "depth").orderBy("depth")


def descendants(edges: DataFrame, root: str) -> DataFrame:
    """(doc_id, depth) of all nodes below ``root``, which need not be a document itself."""
    return closure(edges, root, "parent").select("doc_id", "depth")


def check_edges(edges: DataFrame, folder: str) -> None:
    """Raises if a chain of ``edges`` is a cycle or exceeds MAX_DEPTH.

    Pointers are doubled: after n rounds each node that is left points to its 2^n-th ancestor, and only nodes that have one
    are left, so that a hierarchy of depth d takes about log2(d) joins, and a cycle no more than log2(MAX_DEPTH). Each
    round is written below ``folder``, which driver and executors share, and read again: plans stay small, and a lost
    executor costs a task. The folder is deleted at the end.
    """
    spark, levels = edges.sparkSession, 1
    far = edges.select("doc_id", "parent")
    try:
        while True:
            far.write.parquet(f"{folder}/{levels}")
            far = spark.read.schema("doc_id string, parent string").parquet(f"{folder}/{levels}")
            if far.isEmpty():
                return
            if levels == MAX_DEPTH:  # a power of two; one parent more is too many
                if far.join(edges.select(F.col("doc_id").alias("at")), F.col("parent") == F.col("at")).isEmpty():
                    return
                raise ClosureCycle(f"a document would be its own ancestor, or more than {MAX_DEPTH} levels deep")
            next_ = far.select(F.col("doc_id").alias("at"), F.col("parent").alias("farther"))
            far, levels = far.join(next_, F.col("parent") == F.col("at")).select("doc_id", F.col("farther").alias("parent")), levels * 2
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
