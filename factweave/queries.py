"""The driver's queries over its typed tables, and the SQL of each."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import ClosureCycle
from .functions import extract
from .operators import closure, lookup, rollup, temporal, vector
from .plans.query import Agg, FullText, Not, Or, Pattern, Predicate, Var, query
from .sources.docstore import DocStore
from .sources.facts import DocTable, FactTable
from .sources.vectorstore import VectorStore
from .streaming import changes

DAY = 86_400 * 10**9


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _nanos(ts: str) -> Column:
    """Nanoseconds of a timestamp without zone, read as UTC."""
    return F.unix_micros(F.col(ts).cast("timestamp")) * 1000


def events(spark: SparkSession, d: str) -> FactTable:
    df = _read(spark, d, "events")
    return FactTable(df, "event_id", {"event_type": "event_type", "user_id": "user_id", "value": "value", "props": "props"}, item_id="user_id", type="event_type", at=_nanos("ts"))


def _facts(name: str, doc_id: str | Column) -> Callable[[SparkSession, str], FactTable]:
    def make(spark: SparkSession, d: str) -> FactTable:
        df = _read(spark, d, name)
        return FactTable(df, doc_id, {c: c for c in df.columns})

    return make


lineitem = _facts("lineitem", "l_orderkey")
orders = _facts("orders", "o_orderkey")
part = _facts("part", "p_partkey")
documents = _facts("documents", "doc_id")
pages = _facts("pages", "page_id")
customer = _facts("customer", "c_custkey")


def hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """Customers and suppliers below nations below regions."""
    s = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    nodes = [("customer", "c", "c_custkey", "n", "c_nationkey"), ("supplier", "s", "s_suppkey", "n", "s_nationkey"), ("nation", "n", "n_nationkey", "r", "n_regionkey")]
    out = None
    for name, p, key, q, parent in nodes:
        rows = _read(spark, d, name).select(s(p, key).alias("doc_id"), s(q, parent).alias("parent"))
        out = rows if out is None else out.unionByName(rows)
    return out


def prop_docs(spark: SparkSession, d: str) -> DocTable:
    """events.props as JSON documents."""
    return DocTable(_read(spark, d, "events").select(F.col("event_id").cast("string").alias("doc_id"), F.col("props").cast("binary").alias("doc")), "tenant-a")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def order_log(spark: SparkSession, d: str) -> DataFrame:
    """Orders as changes of their customers' documents: the status, or a delete where the status is P."""
    o = _read(spark, d, "orders")
    return o.select(
        F.lit("tenant-a").alias("entity_id"), F.col("o_custkey").cast("string").alias("doc_id"), F.col("o_orderkey").alias("seq"),
        F.when(F.col("o_orderstatus") == "P", "del").otherwise("put").alias("op"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).cast("binary").alias("doc"), F.lit(0).cast("long").alias("at_nanos"),
    )


def _change_rows(rows: DataFrame) -> DataFrame:
    return rows.select("kind", "doc_id", F.col("old").cast("string").alias("old"), F.col("new").cast("string").alias("new"), "seq")


def _clusters(rows: DataFrame) -> DataFrame:
    return rows.select("item_id", "cluster", "first_at", "last_at", F.col("n").cast("long").alias("n"))


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder for a store, below the folder that the cluster shares; a temporary one where none is named, on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        base = f"file://{tempfile.gettempdir()}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _customers(spark: SparkSession, d: str) -> DocStore:
    """Customers as JSON documents of their nations' tenants, loaded in bulk."""
    store = DocStore(spark, _folder(spark, "customers"))
    c = _read(spark, d, "customer")
    doc = F.to_json(F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.concat(F.lit("c"), (F.col("c_custkey") % 97).cast("string")).alias("parent")))
    store.put_rows(c.select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("entity_id"), F.concat(F.lit("d"), F.col("c_custkey").cast("string")).alias("doc_id"), doc.cast("binary").alias("doc")))
    return store


def _texts(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", F.col("doc").cast("string").alias("doc"))


def store_scan(spark: SparkSession, d: str) -> DataFrame:
    return _texts(_customers(spark, d).scan("n7"))


def store_delete(spark: SparkSession, d: str) -> DataFrame:
    """Some puts, a delete and a snapshot after the bulk load."""
    store = _customers(spark, d)
    store.batch_put("n7", {"extra": b"one", "more": b"two"})
    store.compact()
    store.delete("n7", "extra")
    store.put("n7", "more", b"three")
    return store.current("n7").select("doc_id", F.col("doc").cast("string").alias("doc"), "version")


def store_get(spark: SparkSession, d: str) -> DataFrame:
    store = _customers(spark, d)
    store.put("n7", "extra", b"one")
    return spark.createDataFrame([(store.get("n7", "extra").decode(),)], "doc string")


def _log_store(spark: SparkSession, d: str) -> DocStore:
    store = DocStore(spark, _folder(spark, "orders"))
    store.put_changes(order_log(spark, d))
    return store


def store_versions(spark: SparkSession, d: str) -> DataFrame:
    return _log_store(spark, d).current().select("doc_id", F.col("doc").cast("string").alias("doc"), "version")


def doc_latest_version(spark: SparkSession, d: str) -> DataFrame:
    store = _log_store(spark, d)
    store.compact()
    return _texts(store.latest("tenant-a"))


def _vector_store(spark: SparkSession, d: str) -> VectorStore:
    store = VectorStore(spark, _folder(spark, "vectors"))
    store.insert_rows(vectors(spark, d).select(F.lit("tenant-a").alias("entity_id"), F.col("label").cast("string").alias("scope"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("id"), "vec"), "euclidean")
    return store


def vector_scopes(spark: SparkSession, d: str) -> DataFrame:
    return _vector_store(spark, d).scopes("tenant-a").select("scope", F.col("dim").cast("long").alias("dim"), "n", "metric")


def vector_store_search(spark: SparkSession, d: str) -> DataFrame:
    """The nearest in the first scope, after a delete there and a drop of all other scopes."""
    store = _vector_store(spark, d)
    scopes = [r["scope"] for r in store.scopes("tenant-a").collect()]
    first = store.search("tenant-a", scopes[0], _first_vector(spark, d), 1).first()["id"]
    store.delete("tenant-a", scopes[0], first)
    for scope in scopes[1:3]:
        store.drop_scope("tenant-a", scope)
    near = store.search("tenant-a", scopes[0], _first_vector(spark, d), 5)
    return _rounded(near.crossJoin(F.broadcast(store.scopes("tenant-a").agg(F.count(F.lit(1)).alias("scopes")))))


def closure_cycle(spark: SparkSession, d: str) -> DataFrame:
    """Whether edges of the hierarchy, with one more, are refused."""
    rows = []
    for name, child, parent in (("open", "r1", "top"), ("closed", "r1", "c1"), ("self", "r1", "r1")):
        edges = hierarchy(spark, d).unionByName(spark.createDataFrame([(child, parent)], "doc_id string, parent string"))
        region = edges.where("doc_id = 'c1'").join(edges.selectExpr("doc_id n", "parent p"), F.col("parent") == F.col("n")).first()["p"]
        edges = edges.where("doc_id <> 'r1'").unionByName(spark.createDataFrame([(region, region if parent == child else parent)], "doc_id string, parent string"))
        try:
            closure.check_edges(edges, _folder(spark, "edges"))
            rows.append((name, False))
        except ClosureCycle:
            rows.append((name, True))
    return spark.createDataFrame(rows, "edge string, refused boolean")


def event_docs(spark: SparkSession, d: str) -> DocTable:
    """Events as JSON documents, their times as RFC 3339 texts."""
    at = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    doc = F.to_json(F.struct(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("item_id"), F.col("event_type").alias("type"), at.alias("at"), "value"))
    return DocTable(_read(spark, d, "events").select(F.col("event_id").cast("string").alias("doc_id"), doc.cast("binary").alias("doc")), "tenant-a")


def q_doc_bindings(spark: SparkSession, d: str) -> DataFrame:
    """Entities, bindings and comparisons in document mode, in the order of ids."""
    where = [Pattern("type", "purchase"), Pattern("item_id", Var("?user")), Pattern("value", Var("?v")), Predicate(">=", Var("?v"), 40), Not([Predicate("ends_with", Var("?user"), "3")])]
    return query(event_docs(spark, d), where, ["?e", "?user"], ordered=True)


def _knn_queries(spark: SparkSession, d: str) -> DataFrame:
    """The stated queries: every vector whose id is divisible by 50."""
    return vectors(spark, d).where("id % 50 = 0").select(F.col("id").alias("query_id"), "vec")


def _first_vector(spark: SparkSession, d: str) -> list[float]:
    return list(vectors(spark, d).where("id = 0").first()["vec"])


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Purchases of more than 50 by user: how many, and what they come to."""
    where = [Pattern("event_type", "purchase"), Pattern("user_id", Var("?user")), Pattern("value", Var("?value")), Predicate(">", Var("?value"), 50)]
    out = query(events(spark, d), where, aggregates=[Agg("count"), Agg("sum", "?value")], group_by=["?user"])
    return _rounded(out)


def _predicate(op: str, number: float):
    def run(s: SparkSession, d: str) -> DataFrame:
        where = [Pattern("l_returnflag", "R"), Pattern("l_quantity", Var("?q")), Pattern("l_linenumber", Var("?line")), Predicate(op, Var("?q"), number)]
        return query(lineitem(s, d), where, ["?e", "?line", "?q"])

    return run


_PURCHASES = [Pattern("event_type", "purchase"), Pattern("user_id", Var("?user")), Pattern("value", Var("?v"))]
_NOTHING = [Pattern("event_type", "no such type"), Pattern("user_id", Var("?user")), Pattern("value", Var("?v"))]
_AGGS = [Agg("count"), Agg("sum", "?v"), Agg("avg", "?v"), Agg("min", "?v"), Agg("max", "?v")]


def _rounded(df: DataFrame) -> DataFrame:
    """Doubles to four digits; the small addend keeps ties from falling either way."""
    return df.select(*[F.round(F.col(c) + 1e-7, 4).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "flagship": flagship,
    "q_pattern_literal": lambda s, d: query(orders(s, d), [Pattern("o_orderstatus", "F"), Pattern("o_custkey", Var("?c"))], ["?e", "?c"]),
    "q_pattern_wildcard": lambda s, d: query(orders(s, d), [Pattern("o_orderstatus", "O"), Pattern("o_orderpriority")], ["?e"]),
    "q_pattern_multi_anchor": lambda s, d: query(lineitem(s, d), [Pattern("l_returnflag", "N"), Pattern("l_linestatus", "O"), Pattern("l_linenumber", Var("?n"))], ["?e", "?n"]),
    "q_pattern_unify": lambda s, d: query(lineitem(s, d), [Pattern("l_returnflag", "R"), Pattern("l_linenumber", Var("?x")), Pattern("l_quantity", Var("?x"))], ["?e", "?x"]),
    "q_predicate_eq": _predicate("==", 25),
    "q_predicate_ne": _predicate("!=", 25),
    "q_predicate_lt": _predicate("<", 25),
    "q_predicate_le": _predicate("<=", 25),
    "q_predicate_gt": _predicate(">", 25),
    "q_predicate_ge": _predicate(">=", 25),
    "q_starts_with": lambda s, d: query(part(s, d), [Pattern("p_size", 7), Pattern("p_brand", Var("?b")), Predicate("starts_with", Var("?b"), "Brand#1")], ["?e", "?b"]),
    "q_ends_with": lambda s, d: query(part(s, d), [Pattern("p_size", 7), Pattern("p_brand", Var("?b")), Predicate("ends_with", Var("?b"), "3")], ["?e", "?b"]),
    "q_contains": lambda s, d: query(part(s, d), [Pattern("p_brand", "Brand#13"), Pattern("p_type", Var("?t")), Predicate("contains", Var("?t"), "A")], ["?e", "?t"]),
    "q_unknown_op": lambda s, d: query(part(s, d), [Pattern("p_size", 7), Predicate("~", 1, 1)], ["?e"]),
    "q_or_bindings": lambda s, d: query(orders(s, d), [Pattern("o_orderstatus", "F"), Or([[Pattern("o_orderpriority", "1-URGENT"), Pattern("o_custkey", Var("?x"))], [Pattern("o_orderpriority", "2-HIGH"), Pattern("o_orderkey", Var("?x"))]])], ["?e", "?x"]),
    "q_not": lambda s, d: query(events(s, d), [Pattern("event_type", "purchase"), Pattern("value", Var("?v")), Not([Predicate(">", Var("?v"), 50)])], ["?e", "?v"]),
    "q_fulltext_attr": lambda s, d: query(documents(s, d), [Pattern("lang", "en"), FullText("THEREA", "text")], ["?e"]),
    "q_fulltext_any": lambda s, d: query(part(s, d), [Pattern("p_size", 7), FullText("brand#2")], ["?e"]),
    "q_agg_global": lambda s, d: _rounded(query(events(s, d), _PURCHASES, aggregates=_AGGS)),
    "q_agg_group": lambda s, d: _rounded(query(events(s, d), _PURCHASES, aggregates=_AGGS, group_by=["?user"])),
    "q_agg_total": lambda s, d: _rounded(query(lineitem(s, d), [Pattern("l_returnflag", "R"), Pattern("l_linestatus", Var("?s")), Pattern("l_extendedprice", Var("?p"))], aggregates=[Agg("total", "?p")], group_by=["?s"])),
    "q_agg_empty_global": lambda s, d: query(events(s, d), _NOTHING, aggregates=_AGGS),
    "q_agg_empty_group": lambda s, d: query(events(s, d), _NOTHING, aggregates=_AGGS, group_by=["?user"]),
    "q_doc_mode": lambda s, d: _rounded(query(DocTable(_read(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("doc_id"), F.to_json(F.struct("o_orderstatus", "o_totalprice")).cast("binary").alias("doc"))), [Pattern("o_orderstatus", "F"), Pattern("o_totalprice", Var("?p")), Predicate(">", Var("?p"), 100000)], aggregates=[Agg("count"), Agg("max", "?p")])),
    "lookup_term": lambda s, d: lookup.lookup(part(s, d), "p_brand:Brand#13"),
    "lookup_bare_term": lambda s, d: lookup.lookup(customer(s, d), "BUILDING"),
    "lookup_prefix": lambda s, d: lookup.lookup_prefix(part(s, d), "p_brand:Brand#1"),
    "lookup_bare_prefix": lambda s, d: lookup.lookup_prefix(customer(s, d), "BU"),
    "lookup_range_closed": lambda s, d: lookup.lookup_range(lineitem(s, d), "l_quantity", 20, 40),
    "lookup_range_open_min": lambda s, d: lookup.lookup_range(lineitem(s, d), "l_quantity", 20, 40, low_open=True),
    "lookup_range_open_max": lambda s, d: lookup.lookup_range(lineitem(s, d), "l_quantity", 20, 40, high_open=True),
    "lookup_range_open": lambda s, d: lookup.lookup_range(lineitem(s, d), "l_quantity", 20, 40, True, True),
    "lookup_range_reversed": lambda s, d: lookup.lookup_range(lineitem(s, d), "l_quantity", 40, 20),
    "terms_extract": lambda s, d: prop_docs(s, d).terms(),
    "numerics_extract": lambda s, d: prop_docs(s, d).numerics("k"),
    "group_count": lambda s, d: rollup.group_count(events(s, d), 3, "event_type", "purchase"),
    "group_count_all": lambda s, d: rollup.group_counts(events(s, d), ["event_type", "user_id"]),
    "group_members": lambda s, d: rollup.group_members(events(s, d), 3, "event_type", "click"),
    "stats": lambda s, d: _rounded(rollup.stats(lineitem(s, d), "l_quantity")),
    "stats_by_attr": lambda s, d: _rounded(rollup.stats(lineitem(s, d), "l_quantity", "l_discount", "l_tax")),
    "last_seen": lambda s, d: rollup.last_seen(events(s, d)),
    "absence_gap": lambda s, d: rollup.absences(events(s, d), 7 * DAY),
    "window_query": lambda s, d: temporal.window_query(events(s, d), 3),
    "window_query_types": lambda s, d: temporal.window_query(events(s, d), 3, ["click", "view"]),
    "sequence_2step": lambda s, d: temporal.sequence_join(events(s, d), ["view", "purchase"], DAY),
    "sequence_3step": lambda s, d: temporal.sequence_join(events(s, d), ["view", "click", "purchase"], 2 * DAY),
    "sequence_unbounded": lambda s, d: temporal.sequence_join(events(s, d), ["signup", "error", "signup"]),
    "sequence_items": lambda s, d: temporal.sequence_join(events(s, d), ["click", "view"], DAY, [1, 3, 5]),
    "cluster_query": lambda s, d: _clusters(temporal.cluster_query(events(s, d), DAY, 3)),
    "cluster_unbounded": lambda s, d: _clusters(temporal.cluster_query(events(s, d), 0, 2)),
    "cluster_types": lambda s, d: _clusters(temporal.cluster_query(events(s, d), 3 * DAY, 2, ["purchase", "error"])),
    "ancestors": lambda s, d: closure.ancestors(hierarchy(s, d), "c1"),
    "descendants": lambda s, d: closure.descendants(hierarchy(s, d), "r1"),
    "closure_all": lambda s, d: closure.closure(hierarchy(s, d)),
    "knn_cosine": lambda s, d: _rounded(vector.knn(vectors(s, d), _first_vector(s, d), 10)),
    "knn_euclidean": lambda s, d: _rounded(vector.knn(vectors(s, d), _first_vector(s, d), 10, "euclidean")),
    "knn_batch": lambda s, d: _rounded(vector.knn_batch(vectors(s, d), _knn_queries(s, d), 5, "euclidean").select("query_id", "id", "dist", F.col("rank").cast("long").alias("rank"))),
    "vector_scopes": vector_scopes,
    "change_events": lambda s, d: _change_rows(changes.change_events(order_log(s, d))),
    "subscribe_filter": lambda s, d: _change_rows(changes.filtered(changes.change_events(order_log(s, d)), "tenant-a", "1")),
    "scan": store_scan,
    "store_get": store_get,
    "store_delete": store_delete,
    "store_versions": store_versions,
    "vector_store_search": vector_store_search,
    "closure_cycle": closure_cycle,
    "cluster_members": lambda s, d: temporal.cluster_members(events(s, d), DAY, 3),
    "q_doc_bindings": q_doc_bindings,
    "window_query_docs": lambda s, d: temporal.window_query(event_docs(s, d), "u3", ["click", "view"]),
    "last_seen_docs": lambda s, d: rollup.last_seen(event_docs(s, d)),
    "group_count_docs": lambda s, d: rollup.group_count(event_docs(s, d), "u3", "type", "purchase"),
    "term_changes": lambda s, d: changes.term_changes(changes.change_events(order_log(s, d).withColumn("doc", F.when(F.col("doc").isNotNull(), F.concat(F.lit('{"s":"'), F.col("doc").cast("string"), F.lit('"}')).cast("binary"))))).select(
        "kind", "doc_id", "seq", F.array_join(F.array_sort("added"), ",").alias("added"), F.array_join(F.array_sort("removed"), ",").alias("removed")),
    "doc_latest_version": doc_latest_version,
    "set_intersect": lambda s, d: lookup.intersect(lookup.lookup(part(s, d), "Brand#13"), lookup.lookup_range(part(s, d), "p_size", 1, 20)),
    "set_union": lambda s, d: lookup.union(lookup.lookup(part(s, d), "Brand#13"), lookup.lookup_range(part(s, d), "p_size", 1, 3)),
    "set_difference": lambda s, d: lookup.difference(lookup.lookup(part(s, d), "Brand#13"), lookup.lookup_range(part(s, d), "p_size", 1, 20)),
}

_AT = "epoch_us(ts) * 1000"
def _r(x: str) -> str:
    return f"round({x} + 1e-7, 4)"


_EV = f"ev AS (SELECT user_id AS item_id, event_type AS type, {_AT} AS \"at\", event_id AS doc_id FROM events)"


def _pred(op: str) -> str:
    return f"SELECT l_orderkey AS e, l_linenumber AS line, l_quantity AS q FROM lineitem WHERE l_returnflag = 'R' AND l_quantity {op} 25"


def _agg(where: str, group: str = "") -> str:
    key, tail = (f"{group} AS user, ", f" GROUP BY {group}") if group else ("", "")
    r = _r
    return f"SELECT {key}count(*)::DOUBLE AS count, {r('coalesce(sum(value), 0.0)')} AS sum_v, {r('coalesce(avg(value), 0.0)')} AS avg_v, {r('min(value)')} AS min_v, {r('max(value)')} AS max_v FROM events WHERE {where}{tail}"


def _sequence(steps: list[str], window: int, items: str = "") -> str:
    """Each later step is the first event of its type behind the one before."""
    ctes, n = [f"WITH {_EV}", f"s0 AS (SELECT item_id, \"at\" AS at_0, doc_id AS doc_0 FROM ev WHERE type = '{steps[0]}'{items})"], len(steps)
    for i in range(1, n):
        cols = ", ".join(f"p.at_{j}, p.doc_{j}" for j in range(i))
        ctes.append(f"""s{i} AS (SELECT p.item_id, {cols}, x."at" AS at_{i}, x.doc_id AS doc_{i} FROM s{i - 1} p JOIN ev x ON x.item_id = p.item_id AND x.type = '{steps[i]}' AND (x."at", x.doc_id) > (p.at_{i - 1}, p.doc_{i - 1})
            QUALIFY row_number() OVER (PARTITION BY p.item_id, p.at_0, p.doc_0 ORDER BY x."at", x.doc_id) = 1)""")
    limit = f"WHERE at_{n - 1} - at_0 <= {window}" if window > 0 else ""
    return ", ".join(ctes) + f" SELECT * FROM s{n - 1} {limit} QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY at_0, doc_0) = 1"


def _cluster(window: int, min_size: int, types: str = "") -> str:
    return f"""WITH RECURSIVE {_EV},
n AS (SELECT item_id, "at", row_number() OVER (PARTITION BY item_id ORDER BY "at", doc_id) AS i FROM ev {types}),
r AS (SELECT item_id, "at", i, i + count(*) OVER (PARTITION BY item_id ORDER BY "at" RANGE BETWEEN CURRENT ROW AND {window} FOLLOWING)
  - (i - min(i) OVER (PARTITION BY item_id, "at")) - 1 AS j FROM n),
c(item_id, i) AS (SELECT item_id, 1::BIGINT FROM r WHERE i = 1 UNION ALL
  SELECT c.item_id, CASE WHEN r.j - r.i + 1 >= {min_size} THEN r.j + 1 ELSE r.i + 1 END FROM c JOIN r USING (item_id, i))
SELECT r.item_id, row_number() OVER (PARTITION BY r.item_id ORDER BY r.i) - 1 AS cluster, r."at" AS first_at, e."at" AS last_at, (r.j - r.i + 1)::BIGINT AS n FROM c JOIN r USING (item_id, i) JOIN n e ON e.item_id = r.item_id AND e.i = r.j WHERE r.j - r.i + 1 >= {min_size}"""


def _members(window: int, min_size: int) -> str:
    whole = _cluster(window, min_size)
    at = whole.rindex("SELECT r.item_id, row_number()")
    found = f"f AS (SELECT item_id, i AS lo, j AS hi, row_number() OVER (PARTITION BY item_id ORDER BY i) - 1 AS cluster FROM c JOIN r USING (item_id, i) WHERE j - i + 1 >= {min_size})"
    ids = 'm AS (SELECT item_id, "at", doc_id, row_number() OVER (PARTITION BY item_id ORDER BY "at", doc_id) AS i FROM ev)'
    return f'{whole[:at].rstrip()}, {found}, {ids} SELECT item_id, cluster, "at", doc_id FROM f JOIN m USING (item_id) WHERE i BETWEEN lo AND hi'


_EDGES = """e(doc_id, parent) AS (SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"""
_CLOSURE = f"WITH RECURSIVE {_EDGES}, c(doc_id, ancestor, depth) AS (SELECT doc_id, parent, 1 FROM e UNION ALL SELECT c.doc_id, e.parent, c.depth + 1 FROM c JOIN e ON e.doc_id = c.ancestor)"
_Q0 = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"
_LOG = "log AS (SELECT o_custkey::VARCHAR AS doc_id, o_orderkey AS seq, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS doc FROM orders)"
_CHANGES = f"""WITH {_LOG}, w AS (SELECT *, lag(doc) OVER (PARTITION BY doc_id ORDER BY seq) AS old FROM log)
SELECT CASE WHEN doc IS NULL THEN 'retract' WHEN old IS NULL THEN 'assert' ELSE 'change' END AS kind, doc_id, old, doc AS new, seq FROM w WHERE (doc IS NOT NULL OR old IS NOT NULL)"""
_CUSTOMERS = """SELECT 'd' || c_custkey AS doc_id, '{"name":"' || c_name || '","segment":"' || c_mktsegment || '","parent":"c' || (c_custkey % 97) || '"}' AS doc FROM customer WHERE c_nationkey = 7"""
_RANGE = "SELECT DISTINCT l_orderkey AS doc_id FROM lineitem WHERE l_quantity"


def _stats(c: str) -> str:
    return f"SELECT '{c}' AS path, count({c}) AS n, round(avg({c}) + 1e-7, 4) AS mean, round(var_pop({c}) * count({c}) + 1e-7, 4) AS m2, round(min({c}) + 1e-7, 4) AS min, round(max({c}) + 1e-7, 4) AS max FROM lineitem"


SQL: dict[str, str] = {
    "flagship": "SELECT user_id AS user, count(*)::DOUBLE AS count, round(sum(value) + 1e-7, 4) AS sum_value FROM events WHERE event_type = 'purchase' AND value > 50 AND user_id IS NOT NULL GROUP BY user_id",
    "q_pattern_literal": "SELECT o_orderkey AS e, o_custkey AS c FROM orders WHERE o_orderstatus = 'F' AND o_custkey IS NOT NULL",
    "q_pattern_wildcard": "SELECT o_orderkey AS e FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority IS NOT NULL",
    "q_pattern_multi_anchor": "SELECT l_orderkey AS e, l_linenumber AS n FROM lineitem WHERE l_returnflag = 'N' AND l_linestatus = 'O'",
    "q_pattern_unify": "SELECT l_orderkey AS e, l_linenumber AS x FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = l_quantity",
    "q_predicate_eq": _pred("="),
    "q_predicate_ne": _pred("<>"),
    "q_predicate_lt": _pred("<"),
    "q_predicate_le": _pred("<="),
    "q_predicate_gt": _pred(">"),
    "q_predicate_ge": _pred(">="),
    "q_starts_with": "SELECT p_partkey AS e, p_brand AS b FROM part WHERE p_size = 7 AND starts_with(p_brand, 'Brand#1')",
    "q_ends_with": "SELECT p_partkey AS e, p_brand AS b FROM part WHERE p_size = 7 AND suffix(p_brand, '3')",
    "q_contains": "SELECT p_partkey AS e, p_type AS t FROM part WHERE p_brand = 'Brand#13' AND contains(p_type, 'A')",
    "q_unknown_op": "SELECT p_partkey AS e FROM part WHERE false",
    "q_or_bindings": "SELECT o_orderkey AS e, CASE WHEN o_orderpriority = '1-URGENT' THEN o_custkey ELSE o_orderkey END AS x FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')",
    "q_not": "SELECT event_id AS e, value AS v FROM events WHERE event_type = 'purchase' AND value IS NOT NULL AND NOT (value > 50)",
    "q_fulltext_attr": "SELECT doc_id AS e FROM documents WHERE lang = 'en' AND contains(lower(text), 'therea')",
    "q_fulltext_any": "SELECT p_partkey AS e FROM part WHERE p_size = 7 AND (contains(lower(p_name), 'brand#2') OR contains(lower(p_brand), 'brand#2') OR contains(lower(p_type), 'brand#2'))",
    "q_agg_global": _agg("event_type = 'purchase' AND value IS NOT NULL AND user_id IS NOT NULL"),
    "q_agg_group": _agg("event_type = 'purchase' AND value IS NOT NULL AND user_id IS NOT NULL", "user_id"),
    "q_agg_total": "SELECT l_linestatus AS s, round(sum(l_extendedprice) + 1e-7, 4) AS total_p FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_linestatus",
    "q_agg_empty_global": _agg("false"),
    "q_agg_empty_group": _agg("false", "user_id"),
    "q_doc_mode": "SELECT count(*)::DOUBLE AS count, round(max(o_totalprice) + 1e-7, 4) AS max_p FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000",
    "lookup_term": "SELECT DISTINCT p_partkey AS doc_id FROM part WHERE p_brand = 'Brand#13'",
    "lookup_bare_term": "SELECT DISTINCT c_custkey AS doc_id FROM customer WHERE c_mktsegment = 'BUILDING' OR c_name = 'BUILDING'",
    "lookup_prefix": "SELECT DISTINCT p_partkey AS doc_id FROM part WHERE starts_with(p_brand, 'Brand#1')",
    "lookup_bare_prefix": "SELECT DISTINCT c_custkey AS doc_id FROM customer WHERE starts_with(c_mktsegment, 'BU') OR starts_with(c_name, 'BU')",
    "lookup_range_closed": f"{_RANGE} BETWEEN 20 AND 40",
    "lookup_range_open_min": f"{_RANGE} > 20 AND l_quantity <= 40",
    "lookup_range_open_max": f"{_RANGE} >= 20 AND l_quantity < 40",
    "lookup_range_open": f"{_RANGE} > 20 AND l_quantity < 40",
    "lookup_range_reversed": f"{_RANGE} BETWEEN 40 AND 20",
    "terms_extract": "SELECT event_id::VARCHAR AS doc_id, unnest([json_extract_string(props, '$.k'), 'k:' || json_extract_string(props, '$.k')]) AS term FROM events",
    "numerics_extract": "SELECT event_id::VARCHAR AS doc_id, 'k' AS path, json_extract(props, '$.k')::DOUBLE AS value FROM events",
    "group_count": f"SELECT count(*) AS n, coalesce(min({_AT}), 0) AS first_at, coalesce(max({_AT}), 0) AS last_at FROM events WHERE user_id = 3 AND event_type = 'purchase'",
    "group_count_all": f"""SELECT user_id AS item_id, attr, value, count(*) AS n, min("at") AS first_at, max("at") AS last_at FROM (
        SELECT user_id, 'event_type' AS attr, event_type AS value, {_AT} AS "at" FROM events UNION ALL SELECT user_id, 'user_id', user_id::VARCHAR, {_AT} FROM events) GROUP BY ALL""",
    "group_members": "SELECT DISTINCT event_id AS doc_id FROM events WHERE user_id = 3 AND event_type = 'click'",
    "stats": _stats("l_quantity"),
    "stats_by_attr": " UNION ALL ".join(map(_stats, ("l_quantity", "l_discount", "l_tax"))),
    "last_seen": f"SELECT user_id AS item_id, event_type AS type, max({_AT}) AS last_at FROM events GROUP BY ALL",
    "absence_gap": f"""WITH s AS (SELECT user_id AS item_id, event_type AS type, max({_AT}) AS last_at FROM events GROUP BY ALL)
        SELECT *, (SELECT max(last_at) FROM s) - last_at AS gap FROM s WHERE (SELECT max(last_at) FROM s) - last_at > {7 * DAY}""",
    "window_query": f"WITH {_EV} SELECT * FROM ev WHERE item_id = 3 ORDER BY \"at\", doc_id",
    "window_query_types": f"WITH {_EV} SELECT * FROM ev WHERE item_id = 3 AND type IN ('click', 'view') ORDER BY \"at\", doc_id",
    "sequence_2step": _sequence(["view", "purchase"], DAY),
    "sequence_3step": _sequence(["view", "click", "purchase"], 2 * DAY),
    "sequence_unbounded": _sequence(["signup", "error", "signup"], 0),
    "sequence_items": _sequence(["click", "view"], DAY, " AND item_id IN (1, 3, 5)"),
    "cluster_query": _cluster(DAY, 3),
    "cluster_unbounded": f"WITH {_EV} SELECT item_id, 0 AS cluster, min(\"at\") AS first_at, max(\"at\") AS last_at, count(*) AS n FROM ev GROUP BY item_id HAVING count(*) >= 2",
    "cluster_types": _cluster(3 * DAY, 2, "WHERE type IN ('purchase', 'error')"),
    "ancestors": f"{_CLOSURE} SELECT ancestor, depth FROM c WHERE doc_id = 'c1'",
    "descendants": f"{_CLOSURE} SELECT doc_id, depth FROM c WHERE ancestor = 'r1'",
    "closure_all": f"{_CLOSURE} SELECT doc_id, ancestor, depth FROM c",
    "knn_cosine": f"SELECT vec_id AS id, round(1 - list_cosine_similarity(embedding::DOUBLE[], {_Q0}::DOUBLE[]) + 1e-7, 4) AS dist FROM embeddings ORDER BY 1 - list_cosine_similarity(embedding::DOUBLE[], {_Q0}::DOUBLE[]), vec_id LIMIT 10",
    "knn_euclidean": f"SELECT vec_id AS id, round(list_distance(embedding::DOUBLE[], {_Q0}::DOUBLE[]) + 1e-7, 4) AS dist FROM embeddings ORDER BY list_distance(embedding::DOUBLE[], {_Q0}::DOUBLE[]), vec_id LIMIT 10",
    "knn_batch": """SELECT query_id, id, round(d + 1e-7, 4) AS dist, rank FROM (SELECT q.vec_id AS query_id, v.vec_id AS id, list_distance(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS d,
        row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), v.vec_id) AS rank FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0) WHERE rank <= 5""",
    "vector_scopes": "SELECT label::VARCHAR AS scope, max(len(embedding)) AS dim, count(*) AS n, 'euclidean' AS metric FROM embeddings GROUP BY label",
    "change_events": _CHANGES,
    "subscribe_filter": f"{_CHANGES} AND starts_with(doc_id, '1')",
    "scan": f"SELECT doc_id, doc FROM ({_CUSTOMERS})",
    "store_get": "SELECT 'one' AS doc",
    "store_delete": f"SELECT doc_id, doc, 1 AS version FROM ({_CUSTOMERS}) UNION ALL SELECT 'more', 'three', 2",
    "store_versions": f"""WITH {_LOG}, l AS (SELECT *, sum((doc IS NULL)::INT) OVER (PARTITION BY doc_id ORDER BY seq) AS life, row_number() OVER (PARTITION BY doc_id ORDER BY seq DESC) AS nth FROM log)
        SELECT doc_id, doc, (SELECT count(*) FROM l p WHERE p.doc_id = l.doc_id AND p.life = l.life AND p.doc IS NOT NULL) AS version FROM l WHERE nth = 1 AND doc IS NOT NULL""",
    "vector_store_search": f"""WITH s AS (SELECT DISTINCT label::VARCHAR AS scope FROM embeddings),
        v AS (SELECT 'v' || vec_id AS id, list_distance(embedding::DOUBLE[], {_Q0}::DOUBLE[]) AS d FROM embeddings WHERE label::VARCHAR = (SELECT min(scope) FROM s)),
        n AS (SELECT *, row_number() OVER (ORDER BY d, id) AS nth FROM v)
        SELECT id, round(d + 1e-7, 4) AS dist, (SELECT count(*) FROM s) - least(2, (SELECT count(*) FROM s) - 1) AS scopes FROM n WHERE nth BETWEEN 2 AND 6""",
    "closure_cycle": "SELECT * FROM (VALUES ('open', false), ('closed', true), ('self', true)) t(edge, refused)",
    "cluster_members": _members(DAY, 3),
    "q_doc_bindings": "SELECT event_id::VARCHAR AS e, 'u' || user_id AS user FROM events WHERE event_type = 'purchase' AND value >= 40 AND NOT suffix(user_id::VARCHAR, '3')",
    "window_query_docs": f"SELECT 'u' || user_id AS item_id, event_type AS type, {_AT} AS \"at\", event_id::VARCHAR AS doc_id FROM events WHERE user_id = 3 AND event_type IN ('click', 'view')",
    "last_seen_docs": f"SELECT 'u' || user_id AS item_id, event_type AS type, max({_AT}) AS last_at FROM events GROUP BY ALL",
    "group_count_docs": f"SELECT count(*) AS n, coalesce(min({_AT}), 0) AS first_at, coalesce(max({_AT}), 0) AS last_at FROM events WHERE user_id = 3 AND event_type = 'purchase'",
    "term_changes": f"""SELECT kind, doc_id, seq, CASE WHEN new IS NULL OR new IS NOT DISTINCT FROM old THEN '' ELSE concat_ws(',', new, 's:' || new) END AS added,
        CASE WHEN old IS NULL OR new IS NOT DISTINCT FROM old THEN '' ELSE concat_ws(',', old, 's:' || old) END AS removed FROM ({_CHANGES})""",
    "doc_latest_version": f"WITH {_LOG} SELECT doc_id, doc FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq DESC) AS n FROM log) WHERE n = 1 AND doc IS NOT NULL",
    "set_intersect": "SELECT DISTINCT p_partkey AS doc_id FROM part WHERE p_brand = 'Brand#13' AND p_size BETWEEN 1 AND 20",
    "set_union": "SELECT DISTINCT p_partkey AS doc_id FROM part WHERE p_brand = 'Brand#13' OR p_size BETWEEN 1 AND 3",
    "set_difference": "SELECT DISTINCT p_partkey AS doc_id FROM part WHERE p_brand = 'Brand#13' AND NOT p_size BETWEEN 1 AND 20",
}
