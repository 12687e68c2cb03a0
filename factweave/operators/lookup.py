"""Lookups of documents by term, by term prefix and by numeric range; each gives a DataFrame of distinct doc_ids."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidValue
from ..functions.values import column_kind, number_text
from ..sources.facts import DocTable, FactTable

#: What the text of a finite number looks like.
NUMBER = re.compile(r"-?[0-9]+(\.[0-9]+)?(e[+-][0-9]{2,3})?")


def lookup(facts: FactTable | DocTable, term: str) -> DataFrame:
    """Documents that have the term, bare or as ``name:text``. In table mode no row is exploded: columns are compared."""
    if isinstance(facts, DocTable):
        return facts.terms().where(F.col("term") == term).select("doc_id").distinct()
    cond = F.lit(False)
    for n in facts.names():
        for text in {term} | ({term[len(n) + 1 :]} if term.startswith(f"{n}:") else set()):
            if text or term != text:
                cond = cond | _has_text(facts, n, text)
    return facts.df.where(cond).select(facts._col(facts.doc_id).alias("doc_id")).distinct()


def _has_text(facts: FactTable, name: str, text: str) -> Column:
    """Whether an attribute's text is ``text``; numbers are compared as numbers, so that the scan can use it."""
    c = facts._col(facts.attrs[name])
    kind = column_kind(facts.df.select(c).schema[0].dataType)
    if kind == "string":
        return c == text
    if kind == "bool":
        return c == (text == "true") if text in ("true", "false") else F.lit(False)
    if kind == "number" and NUMBER.fullmatch(text):
        whole = facts.df.select(c).schema[0].dataType.typeName() in ("byte", "short", "integer", "long")
        if whole:
            return c == int(text) if text.lstrip("-").isdigit() and str(int(text)) == text else F.lit(False)
        return c == float(text) if number_text(float(text)) == text else F.lit(False)
    return F.lit(False)


def lookup_prefix(facts: FactTable | DocTable, prefix: str) -> DataFrame:
    """Documents with a term that starts with ``prefix``; '' gives all that have any term."""
    if isinstance(facts, DocTable):
        return facts.terms().where(F.col("term").startswith(prefix)).select("doc_id").distinct()
    cond = F.lit(False)
    for n in facts.names():
        c = facts._col(facts.attrs[n])
        kind = column_kind(facts.df.select(c).schema[0].dataType)
        if kind == "other":
            continue
        if f"{n}:".startswith(prefix):
            cond = cond | c.isNotNull()
            continue
        for start in {prefix} | ({prefix[len(n) + 1 :]} if prefix.startswith(f"{n}:") else set()):
            # no number's text has other characters, so that most prefixes need no number as text
            if kind == "string" or kind == "bool" or set(start) <= set("0123456789.eE+-NaInf"):
                cond = cond | facts._text(n).startswith(start)
    return facts.df.where(cond).select(facts._col(facts.doc_id).alias("doc_id")).distinct()


def lookup_range(facts: FactTable | DocTable, attr: str, low: float, high: float, low_open: bool = False, high_open: bool = False) -> DataFrame:
    """Documents whose number ``attr`` lies between the bounds; reversed bounds give none, bounds that are no finite numbers an error."""
    if not (math.isfinite(low) and math.isfinite(high)):
        raise InvalidValue("bounds must be finite")
    if isinstance(facts, FactTable) and attr in facts.names():
        c, rows = facts._col(facts.attrs[attr]), facts.df.select(facts._col(facts.doc_id).alias("doc_id"), facts._col(facts.attrs[attr]).alias("value"))
        c = F.col("value")
    else:
        rows, c = facts.numerics(attr), F.col("value")
    return rows.where((c > low if low_open else c >= low) & (c < high if high_open else c <= high)).select("doc_id").distinct()


def intersect(*ids: DataFrame) -> DataFrame:
    out = ids[0]
    for x in ids[1:]:
        out = out.join(x, "doc_id", "left_semi")
    return out


def union(*ids: DataFrame) -> DataFrame:
    out = ids[0]
    for x in ids[1:]:
        out = out.unionByName(x)
    return out.distinct()


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, "doc_id", "left_anti")


def contains(ids: DataFrame, doc_id) -> bool:
    return not ids.where(F.col("doc_id") == doc_id).limit(1).isEmpty()
