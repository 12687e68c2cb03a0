"""A corpus pipeline of five operators: each stage works on all that the stage before has kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes to the cluster's shared folder and
reads again as the next stage's documents.

Cases: each stage's docstring gives its result for nulls, empty and very long texts, ties, repeated rows and columns
with names of its own; all columns of the documents come through. An empty table of documents gives an empty table, and
with no usable labels nothing is toxic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factweave.llm import decontaminate, line_dedup, mixing, ngram_join, toxicity
from factweave.llm.common import delete, scratch, staged, table

STAGES = [
    ("toxicity", toxicity.stage),
    ("line_dedup", line_dedup.stage),
    ("ngram_join", ngram_join.stage),
    ("decontaminate", decontaminate.stage),
    ("mixing", mixing.stage),
]

#: SQL can't express the first stage; each stage is tested against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with scratch(spark, keep_last=True) as made:  # of a stage's folders its result stays, until the next one is written
            docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
        delete(spark, before)
        before = made[-1:]
    return docs
