"""Scalars of facts: their types, equality without coercion, and the text of numbers."""

from __future__ import annotations

import math
from dataclasses import dataclass
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def number_text(x: float | None) -> str | None:
    """Shortest decimal text that reads back as ``x``: plain from 1e-4 up to 1e6, with an exponent of two digits beyond."""
    if x is None:
        return None
    x = float(x)
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "+Inf" if x > 0 else "-Inf"
    sign, digits, exponent = Decimal(repr(x)).normalize().as_tuple()
    text = "".join(map(str, digits))
    point = len(text) + exponent - 1  # exponent in scientific form
    minus = "-" if sign else ""
    if x == 0:
        return f"{minus}0"
    if point < -4 or point >= 6:
        tail = text[1:] and f".{text[1:]}"
        return f"{minus}{text[0]}{tail}e{'-' if point < 0 else '+'}{abs(point):02d}"
    if exponent >= 0:
        return f"{minus}{text}{'0' * exponent}"
    if point >= 0:
        return f"{minus}{text[: point + 1]}.{text[point + 1 :]}"
    return f"{minus}0.{'0' * (-point - 1)}{text}"


@F.pandas_udf(T.StringType())
def number_text_udf(xs: pd.Series) -> pd.Series:
    return xs.map(number_text, na_action="ignore").astype(object)


def column_kind(data_type: T.DataType) -> str:
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    if isinstance(data_type, T.BooleanType):
        return "bool"
    if isinstance(data_type, T.NumericType):
        return "number"
    if isinstance(data_type, T.NullType):
        return "null"
    return "other"


@dataclass(frozen=True)
class Value:
    """A scalar: a column of one kind, or for ``dynamic`` one column for each kind, all but one of them null.

    Kinds are string, number, bool, null, other (arrays and objects, equal to nothing) and dynamic.
    """

    kind: str
    out: Column
    text: Column | None = None
    num: Column | None = None
    flag: Column | None = None
    nil: Column | None = None
    may_be_nan: bool = False

    @staticmethod
    def literal(x) -> Value:
        if x is None:
            return Value("null", F.lit(None))
        if isinstance(x, bool):
            return Value("bool", F.lit(x))
        if isinstance(x, (int, float)):
            return Value("number", F.lit(x), may_be_nan=x != x)
        if isinstance(x, str):
            return Value("string", F.lit(x))
        return Value("other", F.lit(None))

    @staticmethod
    def column(c: Column, data_type: T.DataType) -> Value:
        return Value(column_kind(data_type), c, may_be_nan=isinstance(data_type, T.FractionalType) and not isinstance(data_type, T.DecimalType))

    def parts(self) -> tuple[Column, Column, Column, Column]:
        """Text, number, flag and whether it is null."""
        if self.kind == "dynamic":
            return self.text, self.num, self.flag, self.nil
        none = {"string": "string", "number": "double", "bool": "boolean"}
        text, num, flag = (self.out.cast(t) if self.kind == k else F.lit(None).cast(t) for k, t in none.items())
        return text, num, flag, F.lit(True) if self.kind == "null" else F.lit(False) if self.kind == "other" else self.out.isNull()

    def number(self) -> Column:
        """As a double, null if it is no number."""
        return self.parts()[1]

    def string(self) -> Column:
        """As a string, null if it is none."""
        return self.parts()[0]


def dynamic(choices: list[tuple[Column, Value]], otherwise: Value | None) -> Value:
    """The value of the first choice whose condition holds."""
    values = [v for _, v in choices] + ([otherwise] if otherwise is not None else [])
    kinds = {v.kind for v in values if v.kind != "null"}

    def pick(of) -> Column:
        out = None
        for c, v in choices:
            out = F.when(c, of(v)) if out is None else out.when(c, of(v))
        return out.otherwise(of(otherwise)) if otherwise is not None else out

    if len(kinds) == 1 and "dynamic" not in kinds and all(v.kind != "null" for v in values):
        return Value(kinds.pop(), pick(lambda v: v.out), may_be_nan=any(v.may_be_nan for v in values))
    text, num, flag, nil = (pick(lambda v, i=i: v.parts()[i]) for i in range(4))
    return Value("dynamic", F.coalesce(text, number_text_udf(num), flag.cast("string")), text, num, flag, nil)


def numbers(a: Value, b: Value, test: Column) -> Column:
    """``test``, false where one of the two is not a number at all: Spark holds NaN for the largest."""
    for v in (a, b):
        if v.may_be_nan:
            test = test & ~F.isnan(v.out)
    return test


def equal(a: Value, b: Value) -> Column:
    """Typed equality: numbers as doubles, null equals null, no text equals a number, NaN equals nothing; may be null where false is meant."""
    if "other" in (a.kind, b.kind):
        return F.lit(False)
    if a.kind == b.kind != "dynamic":
        return F.lit(True) if a.kind == "null" else numbers(a, b, a.out.eqNullSafe(b.out))
    if "dynamic" not in (a.kind, b.kind):
        if "null" in (a.kind, b.kind):
            return (b if a.kind == "null" else a).out.isNull()
        return a.out.isNull() & b.out.isNull()
    x, y = a.parts(), b.parts()
    return F.coalesce(x[0] == y[0], F.lit(False)) | F.coalesce(x[1] == y[1], F.lit(False)) | F.coalesce(x[2] == y[2], F.lit(False)) | (x[3] & y[3])
