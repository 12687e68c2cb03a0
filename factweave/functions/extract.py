"""What documents hold: index terms, numeric fields, events, top-level scalars and parents, each as a DataFrame."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .values import number_text


def extract(doc: str | bytes | None) -> tuple[list[str], list[tuple[str, float]]]:
    """Sorted distinct terms and (last key, value) pairs of a JSON object; raises ValueError for anything else.

    A leaf gives its bare text, unless that is empty, and ``key:text`` under the last key on its path. Array elements
    have the path of their array, nulls give nothing, all numbers are doubles.
    """
    if doc is None or len(doc) == 0:
        return [], []
    root = json.loads(doc, parse_int=float)
    if not isinstance(root, dict):
        raise ValueError("the top level must be an object")
    terms: set[str] = set()
    numbers: list[tuple[str, float]] = []
    todo = [(k, v) for k, v in root.items()]
    while todo:
        key, v = todo.pop()
        if isinstance(v, dict):
            todo += v.items()
            continue
        if isinstance(v, list):
            todo += [(key, x) for x in v]
            continue
        if v is None:
            continue
        if isinstance(v, bool):
            text = "true" if v else "false"
        elif isinstance(v, float):
            text = number_text(v)
            if math.isfinite(v):
                numbers.append((key, v))
        else:
            text = v
        terms.update({text, f"{key}:{text}"} - {""})
    return sorted(terms), sorted(numbers)


def nanos(at) -> int | None:
    """Nanoseconds of a JSON ``at``: a number, or an RFC 3339 string; None for anything else."""
    if isinstance(at, bool) or at is None:
        return None
    if isinstance(at, (int, float)):
        return int(float(at)) if math.isfinite(at) else None
    if not isinstance(at, str):
        return None
    head, dot, tail = at.partition(".")
    digits = ""
    if dot:
        n = next((i for i, c in enumerate(tail) if not c.isdigit()), len(tail))
        digits, zone = tail[:n], tail[n:]
        if not digits or not zone:
            return None
        head += zone
    try:
        t = datetime.fromisoformat(head)
    except ValueError:
        return None
    if t.tzinfo is None or "T" not in at:
        return None
    since = t - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return (since.days * 86400 + since.seconds) * 10**9 + int(digits[:9].ljust(9, "0") or 0)


def _object(doc: str | bytes | None) -> dict:
    try:
        x = json.loads(doc or b"", parse_int=float)
    except ValueError:
        return {}
    return x if isinstance(x, dict) else {}


PROJECTION = """entity_id string, doc_id string, terms array<string>, numerics array<struct<path: string, value: double>>,
    item_id string, type string, at long, parent string, scalars array<struct<attr: string, value: string>>"""


def project(docs: DataFrame) -> DataFrame:
    """All projections of ``docs`` (entity_id, doc_id, doc) in one pass; what is no JSON object has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for entity, doc_id, doc in zip(*(batch.column(c).to_pylist() for c in ("entity_id", "doc_id", "doc"))):
                try:
                    terms, numbers = extract(doc)
                except ValueError:
                    terms, numbers = [], []
                d = _object(doc)
                item, kind, at = d.get("item_id"), d.get("type"), nanos(d.get("at"))
                item = item if isinstance(item, str) and item else None
                event = item is not None and isinstance(kind, str) and kind != "" and at is not None
                parent = d.get("parent")
                scalars = []
                if item is not None:
                    for k, v in d.items():
                        if isinstance(v, bool):
                            scalars.append({"attr": k, "value": "true" if v else "false"})
                        elif isinstance(v, (str, float)):
                            scalars.append({"attr": k, "value": v if isinstance(v, str) else number_text(v)})
                rows.append(
                    {
                        "entity_id": entity, "doc_id": doc_id, "terms": terms, "numerics": [{"path": k, "value": v} for k, v in numbers],
                        "item_id": item, "type": kind if event else None, "at": at if event else None,
                        "parent": parent if isinstance(parent, str) and parent else None, "scalars": scalars,
                    }
                )
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return docs.select("entity_id", "doc_id", "doc").mapInArrow(run, PROJECTION)


_ARROW = pa.schema(
    [
        ("entity_id", pa.string()),
        ("doc_id", pa.string()),
        ("terms", pa.list_(pa.string())),
        ("numerics", pa.list_(pa.struct([("path", pa.string()), ("value", pa.float64())]))),
        ("item_id", pa.string()),
        ("type", pa.string()),
        ("at", pa.int64()),
        ("parent", pa.string()),
        ("scalars", pa.list_(pa.struct([("attr", pa.string()), ("value", pa.string())]))),
    ]
)


def terms(projected: DataFrame) -> DataFrame:
    return projected.select("entity_id", "doc_id", F.explode("terms").alias("term"))


def numerics(projected: DataFrame) -> DataFrame:
    return projected.select("entity_id", "doc_id", F.inline("numerics")).select("entity_id", "doc_id", "path", "value")


def events(projected: DataFrame) -> DataFrame:
    return projected.where("type is not null").select("entity_id", "item_id", "type", "at", "doc_id")


def scalars(projected: DataFrame) -> DataFrame:
    return projected.select("entity_id", "item_id", "doc_id", "at", F.inline("scalars")).select("entity_id", "item_id", "doc_id", "attr", "value", "at")


def edges(projected: DataFrame) -> DataFrame:
    return projected.where("parent is not null").select("entity_id", "doc_id", "parent")
