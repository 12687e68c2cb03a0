"""What the operators share: whole tables, staged results in the cluster's shared folder, word splitting."""

from __future__ import annotations

import tempfile
import uuid
from bisect import bisect_left
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six characters that separate words, and the letters that lower-casing covers.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: DuckDB's list of the same six characters.
SQL_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below ``spark.checkpoint.dir``, which driver and executors share.

    Only where that setting is missing, as in tests on one machine, is a temporary folder set instead.
    """
    base = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        base = f"file://{tempfile.mkdtemp(prefix='factweave-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if (made := _MADE.get()) is not None:
        made.append(path)
    return path


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Delete shared folders; frames that read them end with that."""
    for path in paths:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


@contextmanager
def scratch(spark: SparkSession, keep_last: bool = False) -> Iterator[list[str]]:
    """The shared folders that are made within, by this thread, are deleted at the end, but the last one with ``keep_last``.

    Operators return frames that read such folders: write their result within, and it will outlive them.
    """
    made: list[str] = []
    token = _MADE.set(made)
    try:
        yield made
    except BaseException:
        keep_last = False
        raise
    finally:
        _MADE.reset(token)
        delete(spark, made[: len(made) - keep_last])


def staged(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: its lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as it takes to differ from all columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def text_of(column: str = "text") -> Column:
    """The text, '' for null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased; all other characters stay."""
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text as an array."""
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")


class Covered:
    """Spans (start, kind, end), sorted, that are asked for overlaps in logarithmic time."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        self._starts = [a for a, _, _ in spans]
        self._ends = list(accumulate((b for _, _, b in spans), max))

    def overlaps(self, start: int, end: int) -> bool:
        n = bisect_left(self._starts, end)
        return n > 0 and self._ends[n - 1] > start
