"""Quality rules: word and symbol counts of each document, and line frequency across the documents of a host.

Lines are normalised and hashed. For each host (a document's source) the documents holding a line are counted. Lines
above the limit are removed from the documents of the host, the first to hold them spared or not, and documents that have
lost too many of their words are rejected. Exact copies count as documents, or as one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SQL_BLANKS, staged, table

#: A line is boilerplate if more than MAX_DOCS documents of its host hold it; a document is depleted if
#: less than LEAST_PERCENT of its words are in other lines. Base rules: least words, most percent of repeated words.
MAX_DOCS, LEAST_PERCENT, MIN_WORDS, MAX_REPEAT_PERCENT, SPAN = 10, 30, 20, 30, 8

_SYMBOLS, _WHITE = b"#*$%&|<>", b" \t\n\x0b\x0c\r"
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def repeated_words(words: list[bytes], span: int = SPAN) -> int:
    """Words that lie in windows of ``span`` (a power of two) words found twice or more.

    Windows are named by doubling: the names of two halves make the name of a window of twice their length, so that
    equal names mean equal windows, not just equal hashes.
    """
    n = len(words) - span + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    names = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    if len(seen) == len(words):
        return 0
    width = 1
    while width < span:
        pairs = names[:-width] * (len(words) + 1) + names[width:]
        names = np.unique(pairs, return_inverse=True)[1]
        width *= 2
    twice = np.bincount(names)[names] > 1
    edges = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + span, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each text, and its distinct lines: two 64-bit halves of the hash and the words in all its copies."""
    for batch in batches:
        cols: list[list] = [[] for _ in range(8)]
        for value in batch.column("text"):
            text = value.as_py() or ""
            data = text.encode("utf-8", "surrogatepass")
            words = data.split()
            lines: dict[bytes, list] = {}
            seen: set[bytes] = set()
            dups = 0
            for line in data.split(b"\n"):
                n = len(line.split())
                if not n:
                    continue
                dups += line in seen
                seen.add(line)
                lines.setdefault(xxhash.xxh3_128_digest(line.strip(_WHITE).translate(_LOWER)), [0])[0] += n
            white = sum(data.count(bytes((c,))) for c in _WHITE)
            row = (
                len(words),
                len(text) - white,
                sum(data.count(bytes((c,))) for c in _SYMBOLS),
                dups,
                repeated_words(words),
                [{"h1": int.from_bytes(h[:8], "little", signed=True), "h2": int.from_bytes(h[8:], "little", signed=True), "n": n} for h, (n,) in lines.items()],
                *(lambda h: (int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)))(xxhash.xxh3_128_digest(data)),
            )
            for c, x in zip(cols, row):
                c.append(x)
        line_type = pa.list_(pa.struct([("h1", pa.int64()), ("h2", pa.int64()), ("n", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("host"), *(pa.array(c, pa.int64()) for c in cols[:5]), pa.array(cols[5], line_type), *(pa.array(c, pa.int64()) for c in cols[6:])],
            names=["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines", "t1", "t2"],
        )


SCHEMA = """doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,
    lines array<struct<h1: long, h2: long, n: long>>, t1 long, t2 long"""


def quality(docs: DataFrame, max_docs: int = MAX_DOCS, least_percent: int = LEAST_PERCENT, copies_as_one: bool = False, spare_first: bool = True) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_boiler_words, base_failed, kept.

    ``docs`` has doc_id, text and source, the host. A line, without blanks at its ends and A-Z lower-cased, is removed
    where more than ``max_docs`` documents of the host hold it, with ``spare_first`` not from the one with the smallest
    doc_id; n_boiler_words are the words of removed lines. With ``copies_as_one`` distinct texts are counted, and spared,
    in place of documents. kept is false if base_failed, or if less than ``least_percent`` percent of the words are left.

    Cases: a null text has no words and fails. Null hosts are one host. Rows of one doc_id are one document for the
    counts, and so are rows without one, but each is judged by its own text. With ``copies_as_one`` copies of a text in a
    host share its verdict. A null doc_id counts as larger than all others. An empty table gives an empty table. Other
    columns are left alone.
    """
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text", "coalesce(cast(source as string), '') host")
    rows = staged(rows.mapInArrow(_count, SCHEMA), "quality").withColumn("id", F.coalesce("doc_id", F.lit(2**63 - 1)))
    lines = rows.select("host", "t1", "t2", "id", F.inline("lines"))
    # each line once for all rows of a document, or all copies of a text; the counts combine before they are shuffled
    if copies_as_one:
        key, holder, n_docs = ["host", "t1", "t2"], F.struct("id", "t1", "t2"), F.count(F.lit(1))
        lines = lines.groupBy("host", "h1", "h2", "t1", "t2").agg(F.min("id").alias("id"), F.max("n").alias("n"))
    else:
        key, holder, n_docs = ["host", "t1", "t2", "id"], F.col("id"), F.count_distinct("id")
        lines = lines.groupBy("host", "h1", "h2", "t1", "t2", "id").agg(F.max("n").alias("n"))
    lines = staged(lines, "distinct")
    common = lines.groupBy("host", "h1", "h2").agg(n_docs.alias("n_docs"), F.min(holder).alias("first"))
    common = common.where(F.col("n_docs") > max_docs).select(F.col("host").alias("c_host"), F.col("h1").alias("c1"), F.col("h2").alias("c2"), "first")
    common = staged(common, "common")  # so that both sides of the join are dealt for it, and a line's hot rows can be split
    hit = lines.join(common, (F.col("host") == F.col("c_host")) & (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")))
    if spare_first:
        hit = hit.where(F.col("first") != holder)
    lost = hit.groupBy(*key).agg(F.sum("n").alias("lost"))
    rows = rows.drop("lines").join(lost, key, "left")
    boiler = F.coalesce(F.col("lost"), F.lit(0))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    depleted = 100 * (F.col("n_words") - boiler) < least_percent * F.col("n_words")
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", boiler.alias("n_boiler_words"), failed.alias("base_failed"), (~failed & ~depleted).alias("kept"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With copies as one document and the first spared, as OP2_SQL has it."""
    return quality(table(spark, sf_dir, "documents"), copies_as_one=True)


OP2_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS host FROM documents),
w AS (SELECT doc_id, host, text, regexp_extract_all(text, '[^ \\x09-\\x0D]+') AS w FROM d),
win AS (SELECT doc_id, unnest(range(1, len(w) - {SPAN - 2})) AS i, w FROM w WHERE len(w) >= {SPAN}),
g AS (SELECT doc_id, i, array_to_string(w[i:i + {SPAN - 1}], ' ') AS g FROM win),
tw AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM tw, range({SPAN}) r(o) GROUP BY doc_id),
l AS (SELECT doc_id, host, text, pos, line FROM (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d)
  WHERE regexp_matches(line, '[^ \\x09-\\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM l GROUP BY doc_id),
k AS (SELECT doc_id, host, text, translate(trim(line, {SQL_BLANKS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key, len(regexp_extract_all(line, '[^ \\x09-\\x0D]+')) AS n FROM l),
hot AS (SELECT host, key, arg_min(text, doc_id) AS first FROM k GROUP BY host, key HAVING count(DISTINCT text) > {MAX_DOCS}),
lost AS (SELECT doc_id, sum(n)::BIGINT AS n FROM k JOIN hot USING (host, key) WHERE text <> first GROUP BY doc_id),
f AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
  coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(lost.n, 0)::BIGINT AS n_boiler_words
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT *, base_failed IS FALSE AND 100 * (n_words - n_boiler_words) >= {LEAST_PERCENT} * n_words AS kept
FROM (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM f)
"""
