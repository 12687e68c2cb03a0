"""Reader of .fvecs files: records of a 4-byte little-endian dimension and as many 4-byte floats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def read_fvecs(spark: SparkSession, path: str) -> DataFrame:
    """(path, id, vec): ids count from 0 in each file. A file is one task's work, so large sets should come in many files."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content")):
                raw = np.frombuffer(data.as_buffer(), "<i4")
                if not len(raw):
                    continue
                dim = int(raw[0])
                if dim <= 0 or len(raw) % (dim + 1) or (raw[:: dim + 1] != dim).any():
                    raise ValueError(f"{name} is no .fvecs file of one dimension")
                vecs = raw.reshape(-1, dim + 1)[:, 1:].view("<f4")
                for at in range(0, len(vecs), 8192):
                    part = vecs[at : at + 8192]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(range(at, at + len(part)), pa.int64()), pa.array(list(part), pa.list_(pa.float32()))], names=["path", "id", "vec"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(parse, "path string, id long, vec array<float>")
