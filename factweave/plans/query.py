"""Composite queries: clauses are compiled into one Catalyst plan of filters, projections and aggregates.

Clauses are read from left to right and collect bindings as columns; a predicate that stands before the pattern that
binds its variable sees null. At the top level predicates stay bare, so that they are pushed to the scan; below Or and
Not, where null must be false, they are wrapped.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidValue
from ..functions.values import Value, dynamic, equal, numbers
from ..sources.facts import DocTable, FactTable


@dataclass(frozen=True)
class Var:
    """A variable, such as Var("?km"); ``?e`` is the document's id."""

    name: str


#: A pattern value that matches whatever the attribute holds.
ANY = None


@dataclass(frozen=True)
class Pattern:
    """The attribute is there, and equals the literal or unifies with the variable; a null literal is ANY."""

    attr: str
    value: Any = ANY


@dataclass(frozen=True)
class Predicate:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Or:
    """The first branch that matches counts, and exports its bindings. A branch is a list of clauses."""

    branches: list[list]


@dataclass(frozen=True)
class Not:
    body: list


@dataclass(frozen=True)
class FullText:
    """The attribute, or any top-level string, has the text in it, whatever its case."""

    query: str
    attr: str = ""


@dataclass(frozen=True)
class Agg:
    fn: str
    over: str = ""
    name: str = ""


NUMERIC = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
STRING = {"starts_with": lambda a, b: a.startswith(b), "ends_with": lambda a, b: a.endswith(b), "contains": lambda a, b: a.contains(b)}
AGGREGATES = ("count", "sum", "total", "avg", "min", "max")

Facts = FactTable | DocTable
Env = dict[str, Value]


def _false_for_null(c: Column, bare: bool) -> Column:
    return c if bare else F.coalesce(c, F.lit(False))


def _number(v: Value) -> Column:
    """For comparisons a number keeps its type, so that the scan can use it."""
    return v.out if v.kind == "number" else v.number()


def _term(t: Any, env: Env) -> Value:
    return env.get(t.name, Value.literal(None)) if isinstance(t, Var) else Value.literal(t)


def _all(facts: Facts, clauses: list, env: Env, bare: bool) -> tuple[Column, Env]:
    cond, env = None, dict(env)
    for clause in clauses:
        c, env = _one(facts, clause, env, bare)
        cond = c if cond is None else cond & c
    return (F.lit(True) if cond is None else cond), env


def _one(facts: Facts, clause: Any, env: Env, bare: bool) -> tuple[Column, Env]:
    if isinstance(clause, Pattern):
        present, value = facts.attribute(clause.attr)
        if isinstance(clause.value, Var):
            if clause.value.name in env:
                return present & _false_for_null(equal(env[clause.value.name], value), bare), env
            return present, env | {clause.value.name: value}
        if clause.value is ANY:
            return present, env
        # A column equal to a literal is there; the bare comparison is what the scan understands.
        wanted = Value.literal(clause.value)
        if value.kind == wanted.kind and value.kind in ("string", "number", "bool"):
            return _false_for_null(numbers(value, wanted, value.out == wanted.out), bare), env
        return present & _false_for_null(equal(value, wanted), bare), env
    if isinstance(clause, Predicate):
        left, right = _term(clause.left, env), _term(clause.right, env)
        if clause.op == "==":
            return _false_for_null(equal(left, right), bare), env
        if clause.op == "!=":
            return ~F.coalesce(equal(left, right), F.lit(False)), env
        if clause.op in NUMERIC:
            if {left.kind, right.kind} - {"number", "dynamic"}:
                return F.lit(False), env
            return _false_for_null(numbers(left, right, NUMERIC[clause.op](_number(left), _number(right))), bare), env
        if clause.op in STRING:
            if {left.kind, right.kind} - {"string", "dynamic"}:
                return F.lit(False), env
            return _false_for_null(STRING[clause.op](left.string(), right.string()), bare), env
        return F.lit(False), env
    if isinstance(clause, Or):
        found = [_all(facts, branch, env, False) for branch in clause.branches]
        if not found:
            return F.lit(False), env
        cond = found[0][0]
        for c, _ in found[1:]:
            cond = cond | c
        new = {v for _, e in found for v in e} - set(env)
        nil = Value.literal(None)
        return cond, env | {v: dynamic([(c, e.get(v, nil)) for c, e in found], None) if any(v not in e for _, e in found) else dynamic([(c, e[v]) for c, e in found[:-1]] or [(F.lit(True), found[0][1][v])], found[-1][1][v]) for v in sorted(new)}
    if isinstance(clause, Not):
        cond, _ = _all(facts, clause.body, env, False)
        return ~cond, env
    if isinstance(clause, FullText):
        return _full_text(facts, clause), env
    raise InvalidValue(f"not a clause: {clause!r}")


def _full_text(facts: Facts, clause: FullText) -> Column:
    if not clause.query:
        return F.lit(False)
    test = lambda c: F.lower(c).contains(clause.query.lower())
    if clause.attr:
        _, value = facts.attribute(clause.attr)
        return F.lit(False) if value.kind not in ("string", "dynamic") else F.coalesce(test(value.string()), F.lit(False))
    if isinstance(facts, DocTable):
        return facts.any_text(test)
    cond = F.lit(False)
    for name in facts.names():
        _, value = facts.attribute(name)
        if value.kind == "string":
            cond = cond | F.coalesce(test(value.out), F.lit(False))
    return cond


def query(facts: Facts, where: list, find: list[str] = (), aggregates: list[Agg] = (), group_by: list[str] = (), ordered: bool = False) -> DataFrame:
    """Rows of the ``find`` variables, one for each matching document; with ``aggregates``, of groups instead.

    One top-level Pattern with a literal value, an anchor, is required. Columns are named like the variables, without
    the question mark; a variable that nothing binds is null. count is a double, sums and averages of nothing are 0,
    min and max null; they see numbers only, and NaN is none. Without ``group_by`` aggregates give exactly one row. ``ordered`` sorts
    by document id, or by group.
    """
    if not any(isinstance(c, Pattern) and not isinstance(c.value, Var) and c.value is not ANY for c in where):
        raise InvalidValue("a query needs a top-level pattern with a literal value")
    for a in aggregates:
        if a.fn not in AGGREGATES:
            raise InvalidValue(f"unknown aggregate {a.fn!r}")
    cond, env = _all(facts, list(where), {"?e": facts.id_value()}, True)
    rows = facts.df.where(cond)
    name = lambda v: v.lstrip("?")
    if not aggregates:
        if ordered:
            rows = rows.orderBy(facts.id_value().out)
        return rows.select(*[(env[v].out if v in env else F.lit(None).cast("string")).alias(name(v)) for v in find])
    keys = {v: env[v].out if v in env else F.lit(None).cast("string") for v in group_by}
    nums = {a.over: F.nanvl(env[a.over].number(), F.lit(None).cast("double")) if a.over in env else F.lit(None).cast("double") for a in aggregates}
    rows = rows.select(*[c.alias(f"k{i}") for i, c in enumerate(keys.values())], *[c.alias(f"n{i}") for i, c in enumerate(nums.values())])
    at = {v: f"n{i}" for i, v in enumerate(nums)}
    fns = {"count": lambda c: F.count(F.lit(1)).cast("double"), "sum": lambda c: F.coalesce(F.sum(c), F.lit(0.0)), "avg": lambda c: F.coalesce(F.avg(c), F.lit(0.0)), "min": F.min, "max": F.max}
    fns["total"] = fns["sum"]
    out = [fns[a.fn](at[a.over]).alias(a.name or (f"{a.fn}_{name(a.over)}" if a.over else a.fn)) for a in aggregates]
    if not keys:
        return rows.agg(*out)
    grouped = rows.groupBy(*[f"k{i}" for i in range(len(keys))]).agg(*out)
    grouped = grouped.withColumnsRenamed({f"k{i}": name(v) for i, v in enumerate(keys)})
    return grouped.orderBy(*[name(v) for v in keys]) if ordered else grouped
