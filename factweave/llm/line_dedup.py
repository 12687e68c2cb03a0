"""Line dedup over levelled sorted runs of line hashes (DataFrame functions only).

Lines are reduced to 128-bit hashes of their keys once; only those hashes, their documents and positions are staged.
Batches of documents, the largest ids first, then meet the runs: each batch's distinct keys, sorted, are merge-joined
with the runs of all batches before it. That tells which of its keys are new, how many documents hold each so far, and
which of them, the largest, keeps it; lines of keys that enough documents hold are dropped at once. The batch's keys are
added as a sorted run of their own at level 0, and as soon as a level holds ``fanout`` runs they are merged into one run
of the next level. Runs are bucketed by key, so that they are joined as they lie, without an exchange.

A line whose key has, with its batch, been found in more than one document but not in enough yet waits: at the end the
lines that wait, and only those, are looked up in the runs once more.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, lower_ascii, shared_folder, staged, table, text_of

#: A key needs so many code points and so many documents; the input is dealt into so many batches, by ranges of doc_id.
MIN_CHARS, MIN_DOCS, BATCHES, FANOUT = 20, 3, 4, 2
RUN = "h1 long, h2 long, n_docs long, last_doc long, total long, last long"


def line_keys(text: Column, min_chars: int) -> Column:
    """For each line of ``text`` the 128-bit hash of its key, null where the key is shorter than ``min_chars``."""
    keys = F.transform(F.split(lower_ascii(text), "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)))
    return F.transform(
        keys,
        lambda k: F.when(F.char_length(k) >= min_chars, F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(1), k).alias("h2"))),
    )


class LineRuns:
    """Levelled sorted runs (h1, h2, n_docs, last_doc, total, last) below one folder of the cluster's shared storage.

    A run has a row for each key of its batch: the documents of the batch that hold it and the largest of them, and the
    same over all batches so far. Runs are tables of the session's catalog while they are in use, as only these can be
    bucketed; ``close`` takes them out again.
    """

    def __init__(self, spark: SparkSession, path: str, fanout: int = FANOUT):
        self.spark, self.path, self.fanout = spark, path, max(2, fanout)
        self.levels: list[list[str]] = [[]]
        self._buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self._name = f"line_runs_{uuid.uuid4().hex}"
        self._made = 0

    def _write(self, run: DataFrame, level: int) -> str:
        while len(self.levels) <= level:
            self.levels.append([])
        name = f"{self._name}_{self._made}"
        self._made += 1
        # what is grouped by key has each bucket in one task already, so that a bucket is one sorted file
        run.write.bucketBy(self._buckets, "h1", "h2").sortBy("h1", "h2").option("path", f"{self.path}/{name}").saveAsTable(name)
        self.levels[level].append(name)
        return name

    def _merged(self, names: list[str]) -> DataFrame:
        """Full merge joins, one run after the other; two runs are joined as they lie."""
        rows = None
        for name in names:
            run = self.spark.table(name).select("h1", "h2", "n_docs", "last_doc")
            if rows is None:
                rows = run
                continue
            run = run.withColumnsRenamed({"h1": "a", "h2": "b", "n_docs": "n", "last_doc": "l"}).hint("merge")
            rows = rows.join(run, (F.col("h1") == F.col("a")) & (F.col("h2") == F.col("b")), "full")
            n_docs = F.coalesce("n_docs", F.lit(0)) + F.coalesce("n", F.lit(0))
            rows = rows.select(F.coalesce("h1", "a").alias("h1"), F.coalesce("h2", "b").alias("h2"), n_docs.alias("n_docs"), F.greatest("last_doc", "l").alias("last_doc"))
        return rows

    def _compact(self) -> None:
        """Merge the runs of each level that is full, the lowest first."""
        level = 0
        while level < len(self.levels):
            if len(self.levels[level]) >= self.fanout:
                full, self.levels[level] = self.levels[level], []
                self._write(self._merged(full).withColumns({"total": F.col("n_docs"), "last": F.col("last_doc")}), level + 1)
                self._drop(full)
            level += 1

    def _drop(self, names: list[str]) -> None:
        for n in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {n}")

    def met(self, lines: DataFrame) -> DataFrame:
        """The keys of a batch, whose documents are in no earlier batch, merge-joined with all runs: a run with its totals."""
        per_doc = lines.select("h1", "h2", "id").distinct()
        keys = per_doc.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("id").alias("last_doc"))
        total, last = F.col("n_docs"), [F.col("last_doc")]
        for i, name in enumerate(n for level in self.levels for n in level):
            run = self.spark.table(name).select(F.col("h1").alias("a"), F.col("h2").alias("b"), F.col("n_docs").alias(f"n{i}"), F.col("last_doc").alias(f"last{i}"))
            keys = keys.join(run.hint("merge"), (F.col("h1") == F.col("a")) & (F.col("h2") == F.col("b")), "left").drop("a", "b")
            total, last = total + F.coalesce(f"n{i}", F.lit(0)), [*last, F.col(f"last{i}")]
        return keys.select("h1", "h2", "n_docs", "last_doc", total.alias("total"), (F.greatest(*last) if len(last) > 1 else last[0]).alias("last"))

    def add(self, lines: DataFrame) -> DataFrame:
        """Merge-join a batch with the runs and add it as a run, whose rows are returned."""
        self._compact()
        name = self._write(self.met(lines), 0)
        return self.spark.read.schema(RUN).parquet(f"{self.path}/{name}")  # as files, so that a key's many lines can be dealt apart

    def keys(self, min_docs: int) -> DataFrame:
        """(h1, h2) that at least ``min_docs`` documents of all runs hold; staged."""
        return staged(self._merged([n for level in self.levels for n in level]).where(F.col("n_docs") >= min_docs).select("h1", "h2"), "keys")

    def close(self) -> None:
        self._drop([n for level in self.levels for n in level])


def _at(keys: DataFrame) -> tuple[DataFrame, Column]:
    return keys.withColumnsRenamed({"h1": "k1", "h2": "k2"}), (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2"))


def repeats(spark: SparkSession, lines: DataFrame, batches: int, min_docs: int, fanout: int) -> DataFrame:
    """(id, version, pos) of the lines to drop, of ``lines`` (id, version, pos, h1, h2, batch), batch 0 having the largest ids."""
    runs = LineRuns(spark, shared_folder(spark, "runs"), fanout)
    drops, waiting = [], []
    for i in range(batches):
        batch = lines.where(F.col("batch") == i)
        keys, at = _at(runs.add(batch).where("total > 1").select("h1", "h2", "total", "last"))
        found = batch.join(keys, at).where(~F.col("id").eqNullSafe(F.col("last")))
        found = staged(found.select("id", "version", "pos", "h1", "h2", (F.col("total") >= min_docs).alias("enough")), "repeats")
        drops.append(found.where("enough").select("id", "version", "pos"))
        waiting.append(found.where("not enough").select("id", "version", "pos", "h1", "h2"))
    if batches > 1:
        keys, at = _at(runs.keys(min_docs))
        drops.append(reduce(DataFrame.unionByName, waiting[:-1]).join(keys, at, "left_semi").select("id", "version", "pos"))
    runs.close()
    return reduce(DataFrame.unionByName, drops)


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """All columns of ``docs`` (doc_id, text, ...), and ``_dedup`` = struct(n_lines, n_dropped, kept).

    A line's key is the line without blanks at its ends, A-Z lower-cased. Keys of at least ``min_chars`` code points
    that at least ``min_docs`` documents hold lose all their lines except those in the largest doc_id; other lines
    stay, joined by newlines.

    Cases: a null text is one empty line. Documents are counted by doc_id: rows of one doc_id hold its lines together,
    whether they repeat one another or not, and all of them keep a line whose largest doc_id is theirs. A null doc_id
    is a document like any other, smaller than all others. Very long texts are split whole. An empty table gives an
    empty table. Extra columns stay as they are; only ``_dedup`` is reserved.
    """
    spark = docs.sparkSession
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), text_of().alias("text"))
    rows = rows.withColumn("version", F.xxhash64("text"))
    cuts = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), [i / batches for i in range(1, batches)], 1000)).first()[0] if batches > 1 else []
    cuts = sorted(set(cuts or []))
    batch = sum((F.coalesce(F.col("id") <= c, F.lit(True)).cast("int") for c in cuts), F.lit(0))
    lines = rows.select("id", "version", F.posexplode(line_keys(F.col("text"), min_chars)).alias("pos", "key")).where(F.col("key").isNotNull())
    lines = staged(lines.select("id", "version", "pos", "key.h1", "key.h2", batch.alias("batch")), "lines", "batch")
    drops = repeats(spark, lines, len(cuts) + 1, min_docs, fanout).groupBy("id", "version").agg(F.collect_set("pos").alias("gone"))
    drops = drops.withColumnsRenamed({"id": "d_id", "version": "d_version"})
    rows = rows.join(drops, F.col("id").eqNullSafe(F.col("d_id")) & (F.col("version") == F.col("d_version")), "left")
    # The lines are split once: as the only element of an array they are bound to a lambda's variable.
    kept = F.transform(
        F.array(F.split("text", "\n", -1)),
        lambda ls: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("gone")), lambda i: F.get(ls, i)), "\n"),
    )[0]
    n_lines = F.size(F.split("text", "\n", -1))
    dedup = F.struct(
        n_lines.cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("kept"),
    )
    return rows.select("row", dedup.alias("_dedup")).select("row.*", "_dedup")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "_dedup.n_lines", "_dedup.n_dropped", F.sha2(F.col("_dedup.kept"), 256).alias("kept_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the lines that are left, with all their columns, whatever their names; n_chars is counted anew.

    Cases are those of ``line_dedup``; null texts become empty ones. A document goes if lines were taken from it and no word is left, as all it said is in larger documents; one that
    had no word before keeps its row.
    """
    out = line_dedup(docs)
    out = out.where((F.col("_dedup.n_dropped") == 0) | (F.btrim("_dedup.kept", F.lit(BLANKS)) != ""))
    swap = {"text": F.col("_dedup.kept"), "n_chars": F.char_length("_dedup.kept").cast("long")}
    return out.select(*[swap[c].alias(c) if c in swap else F.col(f"`{c}`") for c in docs.columns])


OP5_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
hot AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
j AS (SELECT k.doc_id, pos, line, last IS NOT NULL AND last <> k.doc_id AS gone FROM k LEFT JOIN hot USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
