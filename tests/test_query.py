import math
import random

import pytest

from factweave.errors import InvalidValue
from factweave.plans.query import ANY, Agg, FullText, Not, Or, Pattern, Predicate, Var, query
from factweave.sources.facts import FactTable

KIND, STATE, DEPTH, LABEL = "kind", "state", "depth", "label"
V = Var


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def wells(n=60, seed=91):
    rnd = random.Random(seed)
    docs = {}
    for i in range(n):
        doc = {KIND: rnd.choice(["well", "well", "spring"]), STATE: rnd.choice(["dry", "wet", "iced"]), DEPTH: rnd.choice([5, 12, 12.5, 90, "12", None, True, [12]]), LABEL: rnd.choice(["Old Mill", "mill lane", "Upper Farm"])}
        for k in (STATE, DEPTH, LABEL):
            if rnd.random() < 0.2:
                del doc[k]
        docs[f"w{i:02d}"] = doc
    return docs


@pytest.fixture(scope="module")
def known():
    return wells()


@pytest.fixture()
def table(docs_of, known):
    return docs_of(known | {"zz": b"{broken", "zy": b"[]"})


def number(x):
    return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else None


def same(x, y):
    if isinstance(x, list) or isinstance(y, list):
        return False
    if number(x) is not None or number(y) is not None:
        return number(x) is not None and number(x) == number(y)
    return type(x) is type(y) and x == y


def holds(doc, clauses, env):
    """One document against clauses, one after the other; the bindings if all hold, else None."""
    env = dict(env)
    for c in clauses:
        if isinstance(c, Pattern):
            if c.attr not in doc:
                return None
            if isinstance(c.value, Var):
                if c.value.name in env and not same(env[c.value.name], doc[c.attr]):
                    return None
                env.setdefault(c.value.name, doc[c.attr])
            elif c.value is not ANY and not same(c.value, doc[c.attr]):
                return None
        elif isinstance(c, Predicate):
            x, y = (env.get(t.name) if isinstance(t, Var) else t for t in (c.left, c.right))
            if c.op in ("==", "!="):
                ok = same(x, y) == (c.op == "==")
            elif c.op in ("<", "<=", ">", ">="):
                a, b = number(x), number(y)
                ok = a is not None and b is not None and {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[c.op]
            else:
                ok = isinstance(x, str) and isinstance(y, str) and {"starts_with": x.startswith, "ends_with": x.endswith, "contains": lambda s: s in x}[c.op](y)
            if not ok:
                return None
        elif isinstance(c, Or):
            found = next((e for b in c.branches if (e := holds(doc, b, env)) is not None), None)
            if found is None:
                return None
            env = found
        elif isinstance(c, Not):
            if holds(doc, c.body, env) is not None:
                return None
        else:
            texts = [doc.get(c.attr)] if c.attr else list(doc.values())
            if not c.query or not any(isinstance(t, str) and c.query.lower() in t.lower() for t in texts):
                return None
    return env


WELL = Pattern(KIND, "well")
QUERIES = [
    [WELL],
    [WELL, Pattern(STATE, "dry")],
    [WELL, Pattern(DEPTH, 12)],
    [WELL, Pattern(DEPTH, "12")],
    [WELL, Pattern(DEPTH, True)],
    [WELL, Pattern(DEPTH)],
    [WELL, Pattern(DEPTH, V("?d")), Predicate(">", V("?d"), 10)],
    [WELL, Pattern(DEPTH, V("?d")), Predicate("<=", V("?d"), 12)],
    [WELL, Pattern(DEPTH, V("?d")), Predicate("!=", V("?d"), 12)],
    [WELL, Pattern(DEPTH, V("?d")), Predicate("==", V("?d"), None)],
    [WELL, Predicate("==", V("?d"), None), Pattern(DEPTH, V("?d"))],
    [WELL, Pattern(LABEL, V("?l")), Predicate("contains", V("?l"), "ill")],
    [WELL, Pattern(LABEL, V("?l")), Predicate("starts_with", V("?l"), "mill")],
    [WELL, Pattern(DEPTH, V("?l")), Predicate("ends_with", V("?l"), "2")],
    [WELL, Or([[Pattern(STATE, "dry"), Pattern(DEPTH, V("?x"))], [Pattern(STATE, "wet"), Pattern(LABEL, V("?x"))]])],
    [WELL, Or([])],
    [WELL, Not([Pattern(STATE, "iced")])],
    [WELL, Not([Pattern(STATE, "dry"), Pattern(DEPTH, 5)])],
    [WELL, Not([])],
    [WELL, Pattern(STATE, V("?s")), Not([Pattern(LABEL, V("?l")), Predicate("contains", V("?l"), "Farm")])],
    [WELL, FullText("MILL", LABEL)],
    [WELL, FullText("mill")],
    [WELL, FullText("1", DEPTH)],
    [WELL, FullText("")],
    [WELL, Pattern(STATE, V("?x")), Pattern(LABEL, V("?x"))],
]


@pytest.mark.parametrize("n", range(len(QUERIES)))
def test_as_by_a_scan(table, known, n):
    assert rows(query(table, QUERIES[n], ["?e"])) == [(i,) for i in sorted(known) if holds(known[i], QUERIES[n], {}) is not None]


def test_bindings_and_order(table, known):
    where = QUERIES[14]
    text = lambda x: None if x is None or isinstance(x, list) else "true" if x is True else f"{x:g}" if number(x) is not None else x
    got = [tuple(r) for r in query(table, where, ["?e", "?x", "?nothing"], ordered=True).collect()]
    assert got == [(i, text(env.get("?x")), None) for i in sorted(known) if (env := holds(known[i], where, {})) is not None]


def test_unknown_operators_hold_for_nothing(table):
    assert rows(query(table, [WELL, Predicate("~", 1, 1)], ["?e"])) == []


def test_unification_in_tables(spark):
    df = spark.createDataFrame([(1, "k", 8, 8.0), (2, "k", 8, 9.0), (3, "l", 2, 2.0)], "id long, f string, a int, b double")
    assert rows(query(FactTable.of(df, "id"), [Pattern("f", "k"), Pattern("a", V("?x")), Pattern("b", V("?x"))], ["?e", "?x"])) == [(1, 8)]


def test_what_is_not_a_number_compares_with_nothing(spark):
    nan = math.nan
    df = spark.createDataFrame([(1, "k", nan, 1.0), (2, "k", 7.0, nan), (3, "k", 3.0, 3.0), (4, "k", None, 1.0), (5, "k", math.inf, 5.0), (6, "k", nan, nan)], "id long, f string, a double, b double")
    t = FactTable.of(df, "id")
    run = lambda *where: [r[0] for r in rows(query(t, [Pattern("f", "k"), *where], ["?e"]))]
    a, b = Pattern("a", V("?a")), Pattern("b", V("?b"))
    assert run(a, Predicate(">", V("?a"), 5)) == [2, 5] and run(a, Predicate(">=", V("?a"), 3)) == [2, 3, 5] and run(a, Predicate("<", V("?a"), 5)) == [3]
    assert run(a, b, Predicate("<", V("?a"), V("?b"))) == [] and run(a, b, Predicate(">=", V("?a"), V("?b"))) == [3, 5] and run(a, b, Predicate("==", V("?a"), V("?b"))) == [3]
    assert run(a, Predicate("<", V("?a"), nan)) == [] and run(Pattern("a", nan)) == [] and run(a, Predicate("!=", V("?a"), 3)) == [1, 2, 5, 6]
    got = query(t, [Pattern("f", "k"), b], aggregates=[Agg("sum", "?b"), Agg("min", "?b"), Agg("max", "?b"), Agg("avg", "?b"), Agg("count")]).first()
    assert tuple(got) == (10.0, 1.0, 5.0, 2.5, 6.0)


def test_needs_an_anchor(table):
    for where in ([Predicate("==", 1, 1)], [Pattern(KIND, V("?k"))], [Pattern(KIND)], [Or([[WELL]])], []):
        with pytest.raises(InvalidValue):
            query(table, where, ["?e"])


def test_aggregates_as_by_a_scan(table, known):
    where = [WELL, Pattern(STATE, V("?s")), Pattern(DEPTH, V("?d"))]
    found = [env for doc in known.values() if (env := holds(doc, where, {})) is not None]
    groups = {s: [number(e["?d"]) for e in found if e["?s"] == s and number(e["?d"]) is not None] for s in {e["?s"] for e in found}}
    want = [(s, float(sum(e["?s"] == s for e in found)), sum(x), sum(x) / len(x) if x else 0.0, min(x, default=None), max(x, default=None)) for s, x in groups.items()]
    aggs = [Agg("count"), Agg("sum", "?d"), Agg("avg", "?d"), Agg("min", "?d"), Agg("max", "?d")]
    assert rows(query(table, where, aggregates=aggs, group_by=["?s"])) == sorted(want, key=repr)
    assert [r["s"] for r in query(table, where, aggregates=aggs, group_by=["?s"], ordered=True).collect()] == sorted(groups)
    whole = [x for g in groups.values() for x in g]
    assert tuple(query(table, where, aggregates=aggs).first()) == (float(len(found)), sum(whole), pytest.approx(sum(whole) / len(whole)), min(whole), max(whole))
    none = [Pattern(KIND, "lake"), Pattern(DEPTH, V("?d"))]
    assert rows(query(table, none, aggregates=[Agg(f, "?d", f) for f in ("count", "sum", "total", "avg", "min", "max")])) == [(0.0, 0.0, 0.0, 0.0, None, None)]
    assert rows(query(table, none, aggregates=[Agg("count")], group_by=["?d"])) == []
    with pytest.raises(InvalidValue):
        query(table, where, aggregates=[Agg("median", "?d")])


def test_literals_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([(1, "F", 2.0)], "id long, s string, p double").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    out = query(FactTable.of(df, "id"), [Pattern("s", "F"), Pattern("p", V("?p")), Predicate(">", V("?p"), 1)], ["?e"])
    plan = out._jdf.queryExecution().toString()
    assert "EqualTo(s,F)" in plan and "GreaterThan(p,1.0)" in plan
