"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly (DataFrame functions only).

An item of q distinct shingles lies in a document if the document has at least ``share`` * q of them. At most
q - ceil(share * q) may be missing, so of the item's smallest q - ceil(share * q) + 1 shingle hashes, its MinHash
sketch, one at least is in every document that contains it. Items are partitioned by size in powers of two, and the
sketch of a partition is as long as its largest item needs: the search loses nothing. All partitions' sketches probe the
documents in one join. What it finds is verified by counting the item's distinct shingles in the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, staged, table, text_of, words_of

#: Words of a shingle; the share of an item's shingles that makes a leak; the most rows that are broadcast.
K, SHARE, BROADCAST_ROWS = 5, 0.8, 1_000_000


def shingles(words: Column, k: int) -> Column:
    """64-bit hashes of all runs of ``k`` words, from the words' own, so that a word is hashed once; of fewer words none."""
    return F.transform(
        F.array(F.transform(words, lambda w: F.xxhash64(w))),
        lambda w: F.when(
            F.size(w) >= k,
            F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)])),
        ),
    )[0]


def item_shingles(items: DataFrame, k: int = K, share: float = SHARE) -> DataFrame:
    """(item, width, h, need, size, in_sketch): the distinct shingles of each item.

    An item of fewer than ``k`` words has one shingle, all its words; ``width`` is its number of words. Items
    without words have none.
    """
    rows = items.select(F.col("item_id").alias("item"), words_of(lower_ascii(text_of())).alias("w")).where(F.size("w") > 0).distinct()
    width = F.least(F.size("w"), F.lit(k))
    hashes = F.when(width == k, shingles(F.col("w"), k))
    for n in range(1, k):
        hashes = hashes.when(width == n, shingles(F.col("w"), n))
    rows = rows.select("item", width.alias("width"), F.array_sort(F.array_distinct(hashes)).alias("hs"))
    rows = rows.withColumn("size", F.size("hs"))
    # ceil on integers: share as a whole number of thousandths
    mille = round(share * 1000)
    need = F.expr(f"(size * {mille} + 999) div 1000")
    largest = F.pow(F.lit(2), F.ceil(F.log2("size"))).cast("int")  # of the item's size partition
    rows = rows.withColumn("largest", largest)
    sketch = F.expr(f"largest - (largest * {mille} + 999) div 1000 + 1")
    rows = rows.select("item", "width", "size", need.alias("need"), sketch.alias("sketch"), F.posexplode("hs").alias("nth", "h"))
    return rows.select("item", "width", "size", "need", "h", (F.col("nth") < F.col("sketch")).alias("in_sketch"))


def _hits(text: DataFrame, parts: DataFrame, widths: list[int]) -> DataFrame:
    """(doc, and the columns of ``parts``) for each shingle of ``text`` (doc, w) that is one of ``parts``; one scan for all widths."""
    own = [F.coalesce(shingles(F.col("w"), n), F.array().cast("array<bigint>")) for n in widths]
    rows = text.select("doc", F.explode(F.concat(*own)).alias("s"))
    return rows.join(parts, F.col("s") == F.col("h")).drop("s", "width")


def _small(df: DataFrame, n: int, broadcast_rows: int) -> DataFrame:
    return F.broadcast(df) if n <= broadcast_rows else df


def candidates(text: DataFrame, parts: DataFrame, widths: list[int], broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc, item): the pairs in which ``text`` (doc, w) holds a sketch hash of the item, of all size partitions; staged.

    ``parts`` are ``item_shingles``; no other of their hashes is looked up.
    """
    sketch = parts.where("in_sketch").select("item", "width", "h")
    return staged(_hits(text, _small(sketch, sketch.count(), broadcast_rows), widths).select("doc", "item").distinct(), "candidates")


def leaks(docs: DataFrame, items: DataFrame, k: int = K, share: float = SHARE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared): each document and each item that lies in it.

    ``docs`` has doc_id and text, ``items`` item_id and text; other columns are left alone. Shingles are of ``k``
    words, A-Z lower-cased. The documents are probed with the items' sketches; only documents that are found are
    shingled again, and the shingles of the pairs found are counted. Sketches, items' shingles and the ids of the
    documents found are counted, and broadcast only if they are ``broadcast_rows`` at most; beyond that both sides
    are shuffled.

    Cases: null and empty texts hold nothing and lie in nothing. Rows that share a doc_id are one document, whose
    shingles are those of all its rows; a null doc_id is a document like any other, and so are items. Repeated rows
    add nothing. An empty table gives no rows.
    """
    parts = staged(item_shingles(items, k, share), "items")
    counts = parts.groupBy("width").count().collect()  # at most k rows
    widths = sorted({r["width"] for r in counts}) or [k]
    docs = docs.select(F.col("doc_id").alias("doc"), "text")
    words = words_of(lower_ascii(text_of())).alias("w")
    pairs = candidates(docs.select("doc", words), parts, widths, broadcast_rows)
    ids = staged(pairs.select(F.col("doc").alias("c_doc")).distinct(), "found")
    docs = docs.join(_small(ids, ids.count(), broadcast_rows), F.col("doc").eqNullSafe(F.col("c_doc")), "left_semi")
    hits = _hits(docs.select("doc", words), _small(parts.drop("in_sketch"), sum(r["count"] for r in counts), broadcast_rows), widths)
    pairs = pairs.withColumnsRenamed({"doc": "c_doc", "item": "c_item"})
    hits = hits.join(pairs, F.col("doc").eqNullSafe(F.col("c_doc")) & F.col("item").eqNullSafe(F.col("c_item")), "left_semi")
    found = hits.groupBy("doc", "item", "size", "need").agg(F.count_distinct("h").alias("shared")).where(F.col("shared") >= F.col("need"))
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), F.col("size").cast("long").alias("n_item"), F.col("shared").cast("long").alias("n_shared"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in which no item of ``benchmark`` lies, with all their columns, whatever their names.

    Cases are those of ``leaks``: null and empty texts stay, and rows that share a doc_id, null among them, go together.
    """
    bad = leaks(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_leak")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_leak"]), "left_anti")


OP9_SQL = f"""
WITH docs AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\x09-\\x0D]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\x09-\\x0D]+') AS w FROM benchmark),
ish AS (SELECT DISTINCT item_id, least(len(w), {K}) AS width, unnest([array_to_string(w[i:i + least(len(w), {K}) - 1], ' ') FOR i IN range(1, len(w) - least(len(w), {K}) + 2)]) AS s FROM items WHERE len(w) > 0),
sizes AS (SELECT item_id, count(*) AS n_item FROM ish GROUP BY item_id),
widths AS (SELECT DISTINCT width FROM ish),
dsh AS (SELECT DISTINCT doc_id, width, unnest([array_to_string(w[i:i + width - 1], ' ') FOR i IN range(1, len(w) - width + 2)]) AS s FROM docs, widths WHERE len(w) >= width),
hits AS (SELECT doc_id, item_id, count(*) AS n_shared FROM dsh JOIN ish USING (width, s) GROUP BY ALL)
SELECT doc_id, item_id, n_item, n_shared FROM hits JOIN sizes USING (item_id) WHERE n_shared * 1000 >= n_item * {round(SHARE * 1000)}
"""
