import random
from collections import defaultdict

import pytest

from factweave.operators import temporal as T
from factweave.sources.facts import FactTable


def table(spark, events):
    df = spark.createDataFrame([(i, *e) for i, e in enumerate(events)], "id long, item string, type string, at long")
    return FactTable(df, "id", item_id="item", type="type", at="at")


def clusters(log, window, least):
    """Lists of (at, id), by looking ahead from every event."""
    out, i = [], 0
    while i < len(log):
        j = i
        while j + 1 < len(log) and (window <= 0 or log[j + 1][0] - log[i][0] <= window):
            j += 1
        if j - i + 1 >= least:
            out.append(log[i : j + 1])
            i = j + 1
        else:
            i += 1
    return out


def steady(rnd, n):
    """A log without any gap, and one with ties."""
    return [("steady", "t", 5 * i) for i in range(n)] + [("ties", "t", rnd.randrange(n // 10)) for _ in range(n)]


@pytest.mark.parametrize(("window", "least"), [(0, 1), (0, 50), (-3, 2), (1, 1), (3, 2), (10, 5), (25, 30), (40, 9), (10**6, 3), (5, 10**6)])
def test_clusters_and_members_as_by_brute_force(spark, window, least):
    rnd = random.Random(window * 1000 + least)
    events = [(rnd.choice("abc"), rnd.choice("xy"), rnd.randrange(300)) for _ in range(300)] + steady(rnd, 200)
    t = table(spark, events)
    log = defaultdict(list)
    for i, (item, _, at) in enumerate(events):
        log[item].append((at, i))
    want = {item: clusters(sorted(x), window, least) for item, x in log.items()}
    got = sorted((r["item_id"], r["cluster"], r["first_at"], r["last_at"], r["n"]) for r in T.cluster_query(t, window, least).collect())
    assert got == sorted((item, n, c[0][0], c[-1][0], len(c)) for item, x in want.items() for n, c in enumerate(x))
    members = sorted((r["item_id"], r["cluster"], r["at"], r["doc_id"]) for r in T.cluster_members(t, window, least).collect())
    assert members == sorted((item, n, at, i) for item, x in want.items() for n, c in enumerate(x) for at, i in c)


def test_clusters_of_some_types_and_items(spark):
    events = [("a", "x", 1), ("a", "y", 2), ("a", "x", 3), ("b", "x", 1), ("b", "x", 2)]
    t = table(spark, events)
    assert [(r["item_id"], r["n"]) for r in T.cluster_query(t, 5, 2, ["x"], "a").collect()] == [("a", 2)]
    assert T.cluster_members(t, 5, 2, ["z"]).count() == 0 and T.cluster_members(t, 5, 2, ["x"], "b").count() == 2


def test_a_long_steady_log(spark):
    df = spark.range(300_000).selectExpr("id", "'i' item", "'t' type", "id * 10 at")
    t = FactTable(df, "id", item_id="item", type="type", at="at")
    got = T.cluster_query(t, 1000, 3).selectExpr("count(*) c", "sum(n) n", "max(n) high").first()
    whole, rest = divmod(300_000, 101)  # an event and the hundred that are at most 1000 after it
    assert (got["c"], got["n"], got["high"]) == (whole + (rest >= 3), 101 * whole + (rest if rest >= 3 else 0), 101)


def first_match(log, steps, window):
    for s, (at, i, kind) in enumerate(log):
        if kind != steps[0]:
            continue
        match, p = [(at, i)], s
        for step in steps[1:]:
            p = next((q for q in range(p + 1, len(log)) if log[q][2] == step), None)
            if p is None:
                break
            match.append(log[p][:2])
        if len(match) == len(steps) and (window <= 0 or match[-1][0] - match[0][0] <= window):
            return match
    return None


def test_sequences_as_by_brute_force(spark):
    rnd = random.Random(2)
    events = [(rnd.choice("abcdefgh"), rnd.choice("xyz"), rnd.randrange(500)) for _ in range(160)]
    t = table(spark, events)
    for steps, window in ((["x", "y"], 5), (["x", "y", "z"], 40), (["x", "x"], 0), (["z"], 1), (["x", "z", "x", "y"], 60), (["x", "none"], 0)):
        got = {r["item_id"]: [(r[f"at_{i}"], r[f"doc_{i}"]) for i in range(len(steps))] for r in T.sequence_join(t, steps, window).collect()}
        want = {}
        for item in "abcdefgh":
            log = sorted((a, i, k) for i, (x, k, a) in enumerate(events) if x == item)
            if (m := first_match(log, steps, window)) is not None:
                want[item] = m
        assert got == want


def test_items_and_no_steps(spark):
    t = table(spark, [("a", "x", 1), ("a", "y", 2), ("b", "x", 1), ("b", "y", 2)])
    assert [r["item_id"] for r in T.sequence_join(t, ["x", "y"], items=["b", "b"]).collect()] == ["b"]
    assert T.sequence_join(t, []).count() == 0


def test_window_query(docs_of):
    log = {"w1": ("bee", "hatch", 40), "w2": ("bee", "dance", "1970-01-01T00:00:00.00000005Z"), "w3": ("bee", "hatch", 60), "w4": ("wasp", "hatch", 1)}
    d = docs_of({k: {"item_id": i, "type": t, "at": at} for k, (i, t, at) in log.items()} | {"w5": {"item_id": "bee", "type": "dance"}})
    assert [(r["at"], r["doc_id"]) for r in T.window_query(d, "bee").collect()] == [(40, "w1"), (50, "w2"), (60, "w3")]
    assert T.window_query(d, "bee", ["dance"], window=7).count() == 1 and T.window_query(d, "fly").count() == 0
