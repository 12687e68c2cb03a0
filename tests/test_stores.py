import json
import random
import struct

import pytest

from factweave.errors import ClosureCycle, DimensionMismatch, EmptyVector, InvalidEntity, InvalidValue, NotFound, ScopeNotFound
from factweave.operators import closure as C
from factweave.operators import vector
from factweave.sources.docstore import DocStore
from factweave.sources.fvecs import read_fvecs
from factweave.sources.vectorstore import VectorStore
from factweave.streaming import changes


def test_documents_as_by_a_dict(spark, tmp_path):
    """Puts, batches and deletes in any order, with snapshots between them, against a plain dict."""
    rnd = random.Random(101)
    s = DocStore(spark, str(tmp_path / "s"), compact_after=5)
    assert s.health()["status"] == "ok" and s.current("lab").count() == 0
    held: dict = {}
    for n in range(14):
        tenant, key, doc = rnd.choice(["lab", "attic"]), rnd.choice("abc"), b"%d" % n
        if rnd.random() < 0.3:
            s.delete(tenant, key)
            held.pop((tenant, key), None)
        elif rnd.random() < 0.3:
            s.batch_put(tenant, [(key, b"first"), ("other", doc), (key, doc)])
            for k in (key, "other"):
                held[tenant, k] = doc, held.get((tenant, k), (b"", 0))[1] + 1
        else:
            s.put(tenant, key, doc)
            held[tenant, key] = doc, held.get((tenant, key), (b"", 0))[1] + 1
    got = {(r["entity_id"], r["doc_id"]): (bytes(r["doc"]), r["version"]) for r in s.current().collect()}
    assert got == held and s._snapshot() is not None and len(s._names("snapshots", "until-")) <= 2
    again = DocStore(spark, str(tmp_path / "s"))
    for tenant in ("lab", "attic"):
        mine = {k: d for (t, k), (d, _) in held.items() if t == tenant}
        assert {r["doc_id"]: bytes(r["doc"]) for r in again.scan(tenant).collect()} == mine
        assert all(again.get(tenant, k) == d for k, d in mine.items())
        with pytest.raises(NotFound):
            again.get(tenant, "never")
    born = {(r["entity_id"], r["doc_id"]): (r["created_at"], r["updated_at"]) for r in again.current().collect()}
    again.compact()
    assert again.log(again._snapshot().removeprefix("until-")).count() == 0
    assert {(r["entity_id"], r["doc_id"]): (r["created_at"], r["updated_at"]) for r in again.current().collect()} == born
    assert all(a <= b for a, b in born.values())


def test_what_is_refused(spark, tmp_path):
    s = DocStore(spark, str(tmp_path / "s"))
    n = s.log().count()
    s.delete("lab", "missing")
    s.batch_put("lab", {})
    assert s.log().count() == n
    for entity in ("", "a:b", None):
        with pytest.raises(InvalidEntity):
            s.put(entity, "x", b"")
    with pytest.raises(InvalidValue):
        s.batch_put("lab", {"x": b"1", "": b"2"})
    assert s.log().count() == n
    seen = []
    s.batch_put("lab", {k: b"{}" for k in "pqrs"})
    s.scan("lab", lambda d, doc: seen.append(d) or len(seen) < 3)
    assert len(seen) == 3


def test_bulk_load(spark, tmp_path):
    s = DocStore(spark, str(tmp_path / "s"))
    s.put_rows(spark.range(100).selectExpr("'lab' entity_id", "cast(id as string) doc_id", "cast('{}' as binary) doc"))
    s.put("lab", "5", b"new")
    assert s.current("lab").count() == 100 and s.get("lab", "5") == b"new"
    for entity, doc_id in (("lab", ""), ("a:b", "x"), (None, "x"), ("lab", None)):
        with pytest.raises(InvalidValue if entity == "lab" else InvalidEntity):
            s.put_rows(spark.createDataFrame([(entity, doc_id, bytearray(b""))], "entity_id string, doc_id string, doc binary"))
    log = spark.createDataFrame([("lab", "5", 1, "del", None, 7), ("lab", "5", 2, "put", bytearray(b"again"), 8), ("lab", "6", 3, "del", None, 9)], changes.SCHEMA)
    s.put_changes(log)
    assert s.get("lab", "5") == b"again" and s.current("lab").count() == 99 and s.current("lab").where("doc_id = '5'").first()["version"] == 1
    s.put("lab", "6", b"back")
    assert s.get("lab", "6") == b"back"


def above_by_hand(parents, x):
    out = []
    while x in parents:
        x = parents[x]
        out.append(x)
    return out


def test_hierarchy_as_by_hand(spark, tmp_path):
    rnd = random.Random(103)
    parents = {f"n{i}": f"n{rnd.randrange(i)}" for i in range(1, 30)}
    s = DocStore(spark, str(tmp_path / "s"))
    s.batch_put("lab", {k: json.dumps({"parent": p}).encode() for k, p in parents.items()} | {"n0": b"{}", "other": b'{"parent":7}'})
    edges = s.facts("lab").edges()
    for x in ("n0", "n7", "n29", "none"):
        assert [r["ancestor"] for r in C.ancestors(edges, x).collect()] == above_by_hand(parents, x)
        assert {r["doc_id"]: r["depth"] for r in C.descendants(edges, x).collect()} == {k: above_by_hand(parents, k).index(x) + 1 for k in parents if x in above_by_hand(parents, k)}
    assert C.closure(edges).count() == sum(len(above_by_hand(parents, k)) for k in parents)
    assert spark.conf.get("spark.sql.cteRecursionRowLimit", None) is None and not spark.catalog.listTables()
    deep = max(parents, key=lambda k: len(above_by_hand(parents, k)))
    n = s.log().count()
    for docs in ({above_by_hand(parents, deep)[-1]: deep}, {"self": "self"}, {"x": "y", "y": "z", "z": "x"}):
        with pytest.raises(ClosureCycle):
            s.batch_put("lab", {k: json.dumps({"parent": p}).encode() for k, p in docs.items()})
        with pytest.raises(ClosureCycle):
            s.put_rows(spark.createDataFrame([("lab", k, bytearray(json.dumps({"parent": p}).encode())) for k, p in docs.items()], "entity_id string, doc_id string, doc binary"))
    assert s.log().count() == n
    s.put_rows(spark.createDataFrame([("attic", "n0", bytearray(json.dumps({"parent": deep}).encode()))], "entity_id string, doc_id string, doc binary"))  # another tenant's
    s.put("lab", "n29", b'{"parent":"n0"}')
    assert [r["ancestor"] for r in C.ancestors(s.facts("lab").edges(), "n29").collect()] == ["n0"]


def test_cycles_and_long_chains_raise(spark, tmp_path):
    for edges in ([("a", "b"), ("b", "a")], [("s", "s")]):
        with pytest.raises(Exception, match="cycle"):
            C.closure(spark.createDataFrame(edges, "doc_id string, parent string")).collect()
    chain = lambda n: spark.createDataFrame([(f"{i}", f"{i + 1}") for i in range(n)], "doc_id string, parent string")
    C.check_edges(chain(256), str(tmp_path / "c"))
    with pytest.raises(ClosureCycle):
        C.check_edges(chain(257), str(tmp_path / "c"))


def test_vectors(spark, tmp_path):
    v = VectorStore(spark, str(tmp_path / "v"))
    v.insert_many("lab", "hue", {"red": [9, 1, 0], "green": [1, 8, 1], "blue": [0, 1, 7]})
    assert [r["id"] for r in v.search("lab", "hue", [1, 9, 0], 2).collect()][0] == "green"
    assert v.search("lab", "hue", [1, 0, 0], 50).count() == 3 and v.search("lab", "hue", [1, 0, 0], 0).count() == 0
    for bad in (lambda: v.insert("lab", "hue", "x", [1, 2]), lambda: v.search("lab", "hue", [1, 2], 1), lambda: v.insert_many("lab", "new", {"p": [1], "q": [1, 2]})):
        with pytest.raises(DimensionMismatch):
            bad()
    with pytest.raises(EmptyVector):
        v.insert("lab", "hue", "x", [])
    with pytest.raises(InvalidValue):
        v.insert("lab", "tone", "x", [1], "manhattan")
    for missing in (lambda: v.search("lab", "none", [1], 1), lambda: v.dim("lab", "none"), lambda: v.drop_scope("attic", "hue")):
        with pytest.raises(ScopeNotFound):
            missing()
    with pytest.raises(NotFound):
        v.delete("lab", "hue", "pink")
    v.insert("lab", "hue", "red", [8, 2, 1], "euclidean")  # the scope's metric stays
    v.delete("lab", "hue", "blue")
    assert [tuple(r) for r in v.scopes("lab").collect()] == [("hue", 3, 2, "cosine")] and v.size("lab", "hue") == 2 and v.size("lab", "none") == 0
    v.delete("lab", "hue", "red")
    v.delete("lab", "hue", "green")
    assert [tuple(r) for r in v.scopes("lab").collect()] == [("hue", 3, 0, "cosine")]
    v.drop_scope("lab", "hue")
    assert v.scopes("lab").count() == 0
    v.insert("lab", "hue", "red", [1, 2, 3, 4, 5], "euclidean")
    for store in (v, VectorStore(spark, str(tmp_path / "v"))):
        assert [tuple(r) for r in store.scopes("lab").collect()] == [("hue", 5, 1, "euclidean")] and store.dim("lab", "hue") == 5


def test_vectors_in_bulk(spark, tmp_path):
    v = VectorStore(spark, str(tmp_path / "v"))
    make = lambda rows: spark.createDataFrame(rows, "entity_id string, scope string, id string, vec array<double>")
    v.insert_rows(make([("lab", f"s{i % 3}", f"v{i}", [float(i), 1.0]) for i in range(60)]), "euclidean")
    v.insert_rows(make([("lab", "s0", "v0", [50.0, 1.0]), ("lab", "s3", "w", [1.0])]))
    assert [tuple(r) for r in v.scopes("lab").collect()] == [("s0", 2, 20, "euclidean"), ("s1", 2, 20, "euclidean"), ("s2", 2, 20, "euclidean"), ("s3", 1, 1, "cosine")]
    assert {r["id"] for r in v.search("lab", "s0", [50, 1], 2).collect()} == {"v0", "v51"}
    for rows, error in (([("lab", "s0", "x", [1.0])], DimensionMismatch), ([("lab", "n", "x", [])], EmptyVector), ([("lab", "n", "", [1.0])], InvalidValue), ([("a:b", "n", "x", [1.0])], InvalidEntity)):
        with pytest.raises(error):
            v.insert_rows(make(rows))
    v.insert_rows(make([]))
    assert v.current("lab").count() == 61


def test_batches_and_approximate_neighbours(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 16)).astype("float32")
    df = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "id long, vec array<float>")
    q = df.where("id % 50 = 0").selectExpr("id query_id", "vec")
    for metric in ("cosine", "euclidean"):
        got = vector.knn_batch(df, q, 10, metric, block=4).collect()
        for n in range(0, 300, 50):
            one = [r["id"] for r in vector.knn(df, x[n].tolist(), 10, metric).collect()]
            assert [r["id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == n] == one
    hit = sum(len({r["id"] for r in vector.knn_approximate(df, x[n].tolist(), 10, "euclidean", bucket=8.0).collect()} & {r["id"] for r in vector.knn(df, x[n].tolist(), 10, "euclidean").collect()}) for n in (0, 7, 99))
    assert hit / 30 >= 0.9


def test_fvecs(spark, tmp_path):
    (tmp_path / "a.fvecs").write_bytes(b"".join(struct.pack("<i3f", 3, i, i + 1, i + 2) for i in range(4)))
    rows = read_fvecs(spark, str(tmp_path / "a.fvecs")).orderBy("id").collect()
    assert [r["id"] for r in rows] == [0, 1, 2, 3] and rows[2]["vec"] == [2.0, 3.0, 4.0]


def test_change_events_as_batch_and_stream(spark, tmp_path):
    s = DocStore(spark, str(tmp_path / "s"))
    s.put("t", "ring-1", b"v1")
    s.put("t", "ring-1", b"v2")
    s.delete("t", "ring-1")
    s.delete("t", "moth-1")
    s.put("t", "moth-1", b"u")
    want = [("assert", "ring-1", None, b"v1"), ("change", "ring-1", b"v1", b"v2"), ("retract", "ring-1", b"v2", None)]
    as_rows = lambda rs: [(r["kind"], r["doc_id"], r["old"] and bytes(r["old"]), r["new"] and bytes(r["new"])) for r in rs]
    assert as_rows(changes.filtered(changes.change_events(s.log()), "t", "ring-").orderBy("seq").collect()) == want
    got = []
    q = changes.subscribe(changes.change_stream(changes.read_log(spark, s.path)), got.extend, str(tmp_path / "c"), "t", "ring-")
    try:
        q.processAllAvailable()
        assert as_rows(got) == want
        s.put("t", "ring-2", b"x")
        q.processAllAvailable()
        assert as_rows(got)[3:] == [("assert", "ring-2", None, b"x")]
    finally:
        q.stop()


def test_term_changes(spark, tmp_path):
    s = DocStore(spark, str(tmp_path / "s"))
    s.put("t", "a", b'{"tide":"low","depth":5}')
    s.put("t", "a", b'{"tide":"high","depth":5}')
    s.put("t", "b", b"not json")
    s.delete("t", "a")
    rows = [(r["kind"], sorted(r["added"]), sorted(r["removed"])) for r in changes.term_changes(changes.change_events(s.log())).orderBy("seq").collect()]
    assert rows == [
        ("assert", ["5", "depth:5", "low", "tide:low"], []),
        ("change", ["high", "tide:high"], ["low", "tide:low"]),
        ("assert", [], []),
        ("retract", [], ["5", "depth:5", "high", "tide:high"]),
    ]
