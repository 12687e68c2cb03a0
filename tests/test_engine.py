from factweave.engine import Engine
from factweave.plans.query import Agg, Pattern, Var


def test_every_operator_by_tenant(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    assert e.health()["status"] == "ok"
    e.batch_put("t", {"a": b'{"item_id":"i","type":"inspect","at":100,"km":10}', "b": b'{"item_id":"i","type":"fault","at":150,"km":30}', "c": b'{"parent":"a"}'})
    e.put("u", "a", b'{"km":99}')
    assert e.get("t", "c") == b'{"parent":"a"}' and e.scan("t").count() == 3
    ids = lambda df: sorted(r["doc_id"] for r in df.collect())
    assert ids(e.lookup("t", "type:fault")) == ["b"] and ids(e.lookup_prefix("t", "type:")) == ["a", "b"] and ids(e.lookup_numeric_range("t", "km", 10, 30, low_open=True)) == ["b"]
    assert e.window_query("t", "i").count() == 2 and e.cluster_query("t", "i", [], 100, 2).first()["n"] == 2
    assert e.sequence_join("t", [], ["inspect", "fault"], 50).count() == 1 and e.sequence_join("t", ["i"], ["inspect", "fault"], 49).count() == 0
    assert e.last_seen("t", "i", "fault") == 150 and e.last_seen("t", "i", "none") is None
    assert e.group_count("t", "i", "type", "inspect")[:3] == (1, 100, 100)
    assert e.stats("t", "km")["mean"] == 20 and e.stats("t", "none")["n"] == 0
    assert e.ancestors("t", "c") == ["a"] and ids(e.descendants("t", "a")) == ["c"]
    assert [tuple(r) for r in e.query("t", [Pattern("item_id", "i"), Pattern("km", Var("?k"))], aggregates=[Agg("sum", "?k")]).collect()] == [(40.0,)]
    e.vector_insert("t", "s", "x", [1, 0])
    assert e.vector_search("t", "s", [1, 0], 1).first()["id"] == "x" and e.vectors.dim("t", "s") == 2 and e.vectors.size("t", "s") == 1
    e.vector_delete("t", "s", "x")
    assert e.vector_list_scopes("t").first()["n"] == 0
    e.vector_drop_scope("t", "s")
    assert e.vector_list_scopes("t").count() == 0
    got = []
    q = e.subscribe(got.extend, "t", "a")
    try:
        q.processAllAvailable()
        e.put("t", "a", b"{}")
        e.delete("t", "b")
        q.processAllAvailable()
        assert [(r["kind"], r["doc_id"]) for r in got] == [("change", "a")]
    finally:
        q.stop()
