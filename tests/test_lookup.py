import math
import random
from collections import defaultdict

import pytest

from factweave.errors import InvalidValue
from factweave.operators import lookup as L
from factweave.operators import rollup as R
from factweave.sources.facts import FactTable


def ids(df):
    return sorted(r[0] for r in df.collect())


def plants(n=120, seed=81):
    rnd = random.Random(seed)
    out = {}
    for i in range(n):
        out[f"plant{i}"] = {"genus": rnd.choice(["salvia", "salix", "sedum", "stachys"]), "bed": rnd.choice(["north", "south", "pond"]), "height": rnd.choice([3, 12.5, 40, 180, 2.5e6])}
        for k in list(out[f"plant{i}"]):
            if rnd.random() < 0.15:
                del out[f"plant{i}"][k]
    return out


def test_document_mode_as_by_a_scan(docs_of):
    docs = plants()
    d = docs_of(docs | {"noise": b"\xff\xfe", "list": b"[1]"})
    text = {3: "3", 12.5: "12.5", 40: "40", 180: "180", 2.5e6: "2.5e+06"}
    terms = {i: {t for k, v in doc.items() for t in (text.get(v, v), f"{k}:{text.get(v, v)}")} for i, doc in docs.items()}
    for term in ("genus:salix", "salix", "12.5", "height:2.5e+06", "height:2500000", "bed:pond", "moss", "genus:"):
        assert ids(L.lookup(d, term)) == sorted(i for i in docs if term in terms[i]), term
    for prefix in ("genus:sal", "s", "height:1", "bed:n", "zz", ""):
        assert ids(L.lookup_prefix(d, prefix)) == sorted(i for i in docs if any(t.startswith(prefix) for t in terms[i])), prefix
    assert ids(L.lookup_range(d, "height", 4, 100)) == sorted(i for i, doc in docs.items() if 4 <= doc.get("height", -1) <= 100)


def test_ranges_as_by_a_filter(spark):
    rnd = random.Random(82)
    values = [rnd.choice([None, math.nan, math.inf, -math.inf, *(round(rnd.uniform(-5, 5)) for _ in range(9))]) for _ in range(80)]
    t = FactTable.of(spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(values)], "id long, depth double"), "id")
    for _ in range(25):
        low, high = rnd.randint(-6, 6), rnd.randint(-6, 6)
        open_low, open_high = rnd.random() < 0.5, rnd.random() < 0.5
        inside = lambda v: v is not None and math.isfinite(v) and (low < v or (low == v and not open_low)) and (v < high or (v == high and not open_high))
        assert ids(L.lookup_range(t, "depth", low, high, open_low, open_high)) == [i for i, v in enumerate(values) if inside(v)]


def test_bounds_are_finite(docs_of):
    d = docs_of(plants(3))
    for x in (math.nan, math.inf, -math.inf):
        for low, high in ((x, 1), (1, x)):
            with pytest.raises(InvalidValue):
                L.lookup_range(d, "height", low, high)


def test_table_mode_as_by_its_own_terms(spark):
    rows = [(1, "opal", 7200.0, 4, True), (2, "onyx", 3e6, 5, False), (3, None, None, None, None), (4, "", -0.5, 4, None)]
    t = FactTable.of(spark.createDataFrame(rows, "id long, stone string, weight double, grade int, cut boolean"), "id")
    want = {"opal": [1], "stone:opal": [1], "7200": [1], "weight:7200": [1], "7200.0": [], "weight:3e+06": [2], "3000000": [], "grade:4": [1, 4], "4": [1, 4], "cut:false": [2], "true": [1], "-0.5": [4], "": []}
    for term, found in want.items():
        assert ids(L.lookup(t, term)) == found, term
        assert ids(t.terms().where(f"term = '{term}'").select("doc_id").distinct()) == found, term
    terms = [(r["doc_id"], r["term"]) for r in t.terms().collect()]
    for prefix in ("o", "stone:o", "weight:7", "3", "cut:", "grade", "x", ""):
        assert ids(L.lookup_prefix(t, prefix)) == sorted({i for i, x in terms if x.startswith(prefix)}), prefix


def test_sets(spark):
    rnd = random.Random(83)
    for _ in range(3):
        a, b = ({rnd.randrange(12) for _ in range(7)} for _ in range(2))
        x, y = (spark.createDataFrame([(i,) for i in s], "doc_id long") for s in (a, b))
        assert ids(L.intersect(x, y)) == sorted(a & b) and ids(L.union(x, y)) == sorted(a | b) and ids(L.difference(x, y)) == sorted(a - b)
        assert all(L.contains(x, i) == (i in a) for i in (0, 5, 11))


def test_groups_as_by_hand(docs_of):
    rnd = random.Random(84)
    docs = {}
    for i in range(90):
        docs[f"g{i}"] = {"item_id": rnd.choice(["hive1", "hive2"]), "type": rnd.choice(["feed", "smoke"]), "at": rnd.randrange(1000), "mood": rnd.choice(["calm", "cross"])}
        for k in rnd.sample(list(docs[f"g{i}"]), rnd.choice([0, 0, 0, 1])):
            del docs[f"g{i}"][k]
    d = docs_of(docs)
    event = lambda x: all(k in x for k in ("item_id", "type", "at"))
    for item, attr, value in (("hive1", "mood", "calm"), ("hive2", "type", "smoke"), ("hive3", "mood", "calm"), ("hive1", "mood", "none")):
        members = [i for i, x in docs.items() if x.get("item_id") == item and x.get(attr) == value]
        at = [docs[i]["at"] for i in members if event(docs[i])]
        assert tuple(R.group_count(d, item, attr, value).first()) == (len(members), min(at, default=0), max(at, default=0))
        assert ids(R.group_members(d, item, attr, value)) == sorted(members)
    last = defaultdict(int)
    for x in filter(event, docs.values()):
        last[x["item_id"], x["type"]] = max(last[x["item_id"], x["type"]], x["at"])
    assert {(r[0], r[1]): r[2] for r in R.last_seen(d).collect()} == last
    newest = max(last.values())
    assert {(r[0], r[1]): r[3] for r in R.absences(d, 3).collect()} == {k: newest - v for k, v in last.items() if newest - v > 3}


def test_stats(docs_of):
    values = [4, 8, 15, 16, 23, 42, -7.5]
    d = docs_of({str(i): {"depth": v} for i, v in enumerate(values)} | {"t": {"depth": "9"}, "n": {"depth": None}})
    path, n, mean, m2, low, high = R.stats(d, "depth").first()
    middle = sum(values) / len(values)
    assert (path, n, low, high) == ("depth", 7, -7.5, 42.0) and math.isclose(mean, middle) and math.isclose(m2, sum((v - middle) ** 2 for v in values))
