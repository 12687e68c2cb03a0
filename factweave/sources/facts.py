"""FactTable: typed tables and JSON documents behind one interface."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import extract
from ..functions.values import Value, column_kind, number_text_udf


@dataclass(frozen=True)
class FactTable:
    """Facts of one tenant in table mode: each row is a document, ``attrs`` names its attributes.

    Roles are column names or Columns: ``doc_id``, and for event logs ``item_id``, ``type`` and ``at`` (nanoseconds),
    for hierarchies ``parent``. A null attribute is an absent one.
    """

    df: DataFrame
    doc_id: str | Column
    attrs: dict[str, str | Column] = field(default_factory=dict)
    item_id: str | Column | None = None
    type: str | Column | None = None
    at: str | Column | None = None
    parent: str | Column | None = None

    @staticmethod
    def of(df: DataFrame, doc_id: str, **roles) -> FactTable:
        """With all other columns as attributes of their names."""
        return FactTable(df, doc_id, {c: c for c in df.columns if c != doc_id}, **roles)

    def _col(self, c: str | Column) -> Column:
        return F.col(c) if isinstance(c, str) else c

    def id_value(self) -> Value:
        c = self._col(self.doc_id)
        return Value.column(c, self.df.select(c).schema[0].dataType)

    def attribute(self, name: str) -> tuple[Column, Value]:
        """Whether a row has the attribute, and its value."""
        if name not in self.attrs:
            return F.lit(False), Value("null", F.lit(None))
        c = self._col(self.attrs[name])
        return c.isNotNull(), Value.column(c, self.df.select(c).schema[0].dataType)

    def names(self) -> list[str]:
        return list(self.attrs)

    def _text(self, name: str) -> Column | None:
        c = self._col(self.attrs[name])
        t = self.df.select(c).schema[0].dataType
        kind = column_kind(t)
        if kind == "number":
            return c.cast("string") if t.typeName() in ("byte", "short", "integer", "long") else number_text_udf(c.cast("double"))
        return c.cast("string") if kind in ("string", "bool") else None

    def terms(self) -> DataFrame:
        """(doc_id, term): bare texts and ``name:text``; empty texts have no bare term."""
        pairs = [F.array(t, F.concat(F.lit(f"{n}:"), t)) for n in self.attrs if (t := self._text(n)) is not None]
        found = F.array_distinct(F.filter(F.concat(*pairs), lambda x: x.isNotNull() & (x != ""))) if pairs else F.array().cast("array<string>")
        return self.df.select(self._col(self.doc_id).alias("doc_id"), F.explode(found).alias("term"))

    def numerics(self, *names: str) -> DataFrame:
        """(doc_id, path, value) of the numeric attributes, or of those named; NaN and infinities are left out."""
        cols = [(n, self._col(self.attrs[n]).cast("double")) for n in names or self.attrs if n in self.attrs and column_kind(self.df.select(self._col(self.attrs[n])).schema[0].dataType) == "number"]
        if not cols:
            return self.df.select(self._col(self.doc_id).alias("doc_id"), F.lit("").alias("path"), F.lit(0.0).alias("value")).limit(0)
        if len(cols) == 1:
            rows = self.df.select(self._col(self.doc_id).alias("doc_id"), F.lit(cols[0][0]).alias("path"), cols[0][1].alias("value"))
        else:
            rows = self.df.select(self._col(self.doc_id).alias("doc_id"), F.inline(F.array(*[F.struct(F.lit(n).alias("path"), c.alias("value")) for n, c in cols])))
        finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf"))
        return rows.where(finite)

    def events(self) -> DataFrame:
        """(item_id, type, at, doc_id) of the rows that have all three."""
        cols = [self._col(c).alias(n) for n, c in (("item_id", self.item_id), ("type", self.type), ("at", self.at), ("doc_id", self.doc_id))]
        return self.df.select(*cols).where("item_id is not null and type is not null and at is not null")

    def scalars(self) -> DataFrame:
        """(item_id, doc_id, attr, value, at): every scalar of the rows that have an item; ``at`` only of events."""
        pairs = [F.struct(F.lit(n).alias("attr"), t.alias("value")) for n in self.attrs if (t := self._text(n)) is not None]
        at = self._col(self.at) if self.at is not None else F.lit(None).cast("long")
        dated = self._col(self.type).isNotNull() if self.type is not None else F.lit(False)
        rows = self.df.select(self._col(self.item_id).alias("item_id"), self._col(self.doc_id).alias("doc_id"), F.when(dated, at).alias("at"), F.array(*pairs).alias("s")).where("item_id is not null")
        return rows.select("item_id", "doc_id", "at", F.inline("s")).where("value is not null").select("item_id", "doc_id", "attr", "value", "at")

    def edges(self) -> DataFrame:
        return self.df.select(self._col(self.doc_id).alias("doc_id"), self._col(self.parent).alias("parent")).where("parent is not null")


@dataclass(frozen=True)
class DocTable:
    """Facts of one tenant in document mode: ``docs`` has doc_id and doc, the bytes of what may be a JSON object.

    Attributes are read from a map of variants; of duplicate keys the last counts, and what is no object has none.
    """

    docs: DataFrame
    entity: str = ""

    @property
    def df(self) -> DataFrame:
        attrs = F.from_json(F.decode(F.col("doc"), "UTF-8"), "map<string,variant>")
        return self.docs.select("doc_id", "doc", attrs.alias("attrs"))

    def id_value(self) -> Value:
        c = F.col("doc_id")
        num = F.when(c.rlike(r"^[+-]?[0-9]+$"), F.expr("try_cast(doc_id as bigint)").cast("double"))
        return Value("dynamic", c, F.when(num.isNull(), c), num, F.lit(None).cast("boolean"), F.lit(False))

    def attribute(self, name: str) -> tuple[Column, Value]:
        key = F.lit(name)
        v = F.try_element_at("attrs", key)
        kind = F.schema_of_variant(v)
        text = F.when(kind == "STRING", F.try_variant_get(v, "$", "string"))
        num = F.when(kind.rlike(r"^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(v, "$", "double"))
        flag = F.when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
        present = F.coalesce(F.map_contains_key("attrs", key), F.lit(False))
        nil = ~present | F.coalesce(kind == "VOID", F.lit(True))
        return present, Value("dynamic", F.coalesce(text, number_text_udf(num), flag.cast("string")), text, num, flag, nil)

    def names(self) -> None:
        return None

    def any_text(self, test) -> Column:
        """Whether any top-level string passes."""
        return F.coalesce(F.exists(F.map_values("attrs"), lambda v: (F.schema_of_variant(v) == "STRING") & test(F.try_variant_get(v, "$", "string"))), F.lit(False))

    def _projected(self) -> DataFrame:
        return extract.project(self.docs.select(F.lit(self.entity).alias("entity_id"), "doc_id", "doc"))

    def terms(self) -> DataFrame:
        return extract.terms(self._projected()).drop("entity_id")

    def numerics(self, *names: str) -> DataFrame:
        rows = extract.numerics(self._projected()).drop("entity_id")
        return rows.where(F.col("path").isin(*names)) if names else rows

    def events(self) -> DataFrame:
        return extract.events(self._projected()).drop("entity_id")

    def scalars(self) -> DataFrame:
        return extract.scalars(self._projected()).drop("entity_id")

    def edges(self) -> DataFrame:
        return extract.edges(self._projected()).drop("entity_id")
