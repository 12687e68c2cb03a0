"""URL filters: rules for hosts and paths, and a path-template tree for all other urls (DataFrame functions only).

Per host, paths form a tree of segments. A segment that looks like a number, a hash, a date or an id becomes a wildcard
of its kind, and the words below a node become one wildcard where they are too many. Words that are left are merged
where chi-squared tests find no difference in what stands below them, nor between the labels that both have: the largest
branch first, each is joined to the first merged branch that it does not differ from. Each node's purity, its share of
blocked urls among the labelled ones, is smoothed towards the purity of the node above it, that of a host towards that
of all urls; so a branch without labels has the purity of the branches that it was merged with, or else of the wider
ones. A url is rejected where the purity of its template, the last node that still divides paths, reaches a threshold.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, staged, table

#: The rules (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

#: Words below a node above which they are one wildcard, urls that the purity above a node weighs as much as, and the
#: smoothed share of blocked urls that rejects a template.
MAX_CHILDREN, PRIOR, REJECT = 64, 8.0, 0.6
#: Branches differ if they differ by chance in less than one of a hundred cases (by degrees of freedom: fixed values of the
#: chi-squared distribution), and if the squared difference of their shares, divided by the common share, exceeds this.
CHI_SQUARED, LEAST_DIFFERENCE = (0.0, 6.635, 9.210, 11.345, 13.277, 15.086), 0.05
#: What ends every path, and the kinds of segments that are counted below a branch; all others are words.
END, KINDS = "{end}", ("{end}", "{n}", "{date}", "{hex}", "{id}")

def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both are empty where it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.substr(url, at + 3)
    ok = url.isNotNull() & (at > 0)
    host = lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(ok, host).otherwise(""), F.when(ok, path).otherwise("")


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, said in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):  # the last one wins
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name, verdict = F.when(fits, rule_host + rule_path).otherwise(name), F.when(fits, said).otherwise(verdict)
    return name, verdict


def shape(segment: Column) -> Column:
    """The segment, or a wildcard that names the kind of variable it is; a known ending stays."""
    ending = F.regexp_extract(segment, r"(\.[A-Za-z]{2,5})$", 1)
    body = F.regexp_replace(segment, r"\.[A-Za-z]{2,5}$", "")
    kind = F.when(body.rlike(r"^[0-9]+$"), "{n}").when(body.rlike(r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$"), "{date}").when(body.rlike(r"^[0-9a-fA-F-]{16,}$"), "{hex}").when(body.rlike(r"[0-9]{3,}"), "{id}")
    return F.when(kind.isNotNull(), F.concat(kind, ending)).otherwise(segment)


def segments(path: Column) -> Column:
    """The shapes of all segments of a path, and ``END``."""
    parts = F.split(F.substr(path, F.lit(2)), "/", -1)
    return F.concat(F.transform(parts, shape), F.array(F.lit(END)))


def _alike(k: str, n: str) -> str:
    """SQL: whether the counts ``k``, which add up to ``n``, of the branches l and x do not differ; they do not where one has none."""
    crit = f"array({', '.join(f'{c}D' for c in CHI_SQUARED)})"
    off = f"(x.{n} * cast(a as double) - l.{n} * cast(b as double))"
    chi = f"aggregate(zip_with(l.{k}, x.{k}, (a, b) -> if(a + b = 0, 0D, {off} * {off} / (cast(l.{n} as double) * x.{n} * (a + b)))), 0D, (t, v) -> t + v)"
    kinds = f"size(filter(zip_with(l.{k}, x.{k}, (a, b) -> a + b), v -> v > 0))"
    return f"if(l.{n} = 0 or x.{n} = 0, true, transform(array({chi}), c -> c <= element_at({crit}, {kinds}) or c * (l.{n} + x.{n}) <= {LEAST_DIFFERENCE}D * (cast(l.{n} as double) * x.{n}))[0])"


def _merged() -> str:
    """SQL: over ``xs``, the words below a node, largest first, the branch that each of them is merged into.

    The state holds the branches found so far, with the counts of all their members, and the name of each word's branch.
    """
    first = f"array_min(filter(transform(s.found, (l, i) -> if({_alike('k', 'n')} and {_alike('y', 'seen')}, i, null)), i -> i is not null))"
    add = "zip_with(l.{0}, x.{0}, (a, b) -> a + b)"
    return f"""aggregate(xs,
        named_struct('found', cast(array() as array<struct<name: string, n: bigint, k: array<bigint>, seen: bigint, y: array<bigint>>>), 'names', cast(array() as array<string>)),
        (s, x) -> transform(array({first}), p -> named_struct(
            'found', if(p is null, concat(s.found, array(named_struct('name', x.seg, 'n', x.n, 'k', x.k, 'seen', x.seen, 'y', x.y))),
                transform(s.found, (l, i) -> if(i = p, named_struct('name', l.name, 'n', l.n + x.n, 'k', {add.format("k")}, 'seen', l.seen + x.seen, 'y', {add.format("y")}), l))),
            'names', concat(s.names, array(if(p is null, x.seg, s.found[p].name)))))[0]).names"""


def branches(child: DataFrame, max_children: int = MAX_CHILDREN) -> DataFrame:
    """(b_node, b_seg, branch) of the words below the nodes that have ``max_children`` of them at most.

    ``child`` has node, seg, n, k, seen and bad: a node's children, their urls, these by the kind of what stands below
    them, and the labelled and the bad ones.
    """
    words = child.where(~F.col("seg").startswith("{"))
    few = words.groupBy(F.col("node").alias("f_node")).agg(F.count(F.lit(1)).alias("m")).where(F.col("m") <= max_children)
    words = words.join(few, F.col("node") == F.col("f_node"))
    lists = words.groupBy("node").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("less"), "seg", "n", "k", "seen", F.array(F.col("bad"), F.col("seen") - F.col("bad")).alias("y")))).alias("xs"))
    lists = lists.select(F.col("node").alias("b_node"), F.arrays_zip(F.col("xs.seg").alias("seg"), F.expr(_merged()).alias("name")).alias("pairs"))
    return lists.select("b_node", F.explode("pairs").alias("p")).select("b_node", F.col("p.seg").alias("b_seg"), F.col("p.name").alias("branch"))


def _smoothed(prior: float) -> Column:
    return (F.col("bad") + prior * F.col("above")) / (F.col("seen") + prior)


def templates(shapes: DataFrame, max_children: int = MAX_CHILDREN, prior: float = PRIOR) -> DataFrame:
    """(host, shapes, template, purity) for ``shapes`` (host, shapes, n, seen, bad), one row for each path of shapes.

    The tree grows level by level, on counts of children, until below every node there is one path. A child that all paths
    of a node share is no decision, and long paths that nothing divides cost no level.
    """
    rest = lambda d: F.xxhash64(F.expr(f"slice(shapes, {d + 1}, greatest(size(shapes) - {d}, 0))"))
    hosts = shapes.groupBy(F.col("host").alias("h_host")).agg(F.sum("seen").alias("seen"), F.sum("bad").alias("bad"), (F.min(rest(0)) == F.max(rest(0))).alias("done"))
    hosts = staged(hosts, "hosts")
    whole = hosts.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 1) / (F.coalesce(F.sum("seen"), F.lit(0)) + 2)).alias("above"))
    hosts = hosts.join(F.broadcast(whole)).select("h_host", "done", _smoothed(prior).alias("purity"))  # one row
    rows = shapes.join(hosts, F.col("host") == F.col("h_host")).select("host", "shapes", "n", "seen", "bad", F.col("host").alias("node"), F.lit("").alias("template"), "purity", "done")
    rows, out, d = staged(rows, "tree"), None, 0
    while True:
        leaves = rows.where("done").select("host", "shapes", "template", "purity")
        out = leaves if out is None else out.unionByName(leaves)
        rows = rows.where("not done")
        if rows.isEmpty():
            return out
        seg, below = F.col("shapes")[d], F.get("shapes", F.lit(d + 1))
        kind = [F.coalesce(below.startswith(k), F.lit(False)) for k in KINDS]
        kind.append(~reduce(or_, kind))
        child = rows.groupBy("node", seg.alias("seg")).agg(
            *[F.sum(c).alias(c) for c in ("n", "seen", "bad")], F.first("purity").alias("above"), F.min(rest(d + 1)).alias("lo"), F.max(rest(d + 1)).alias("hi"),
            *[F.sum(F.when(c, F.col("n")).otherwise(0)).alias(f"k{i}") for i, c in enumerate(kind)],
        )
        child = staged(child.withColumn("k", F.array(*[f"k{i}" for i in range(len(kind))])), "children")
        named = branches(child, max_children)
        child = child.join(named, (F.col("node") == F.col("b_node")) & (F.col("seg") == F.col("b_seg")), "left")
        child = child.withColumn("branch", F.coalesce("branch", F.when(F.col("seg").startswith("{"), F.col("seg")).otherwise("*")))
        child = staged(child.select("node", "seg", "branch", "seen", "bad", "above", "lo", "hi"), "branches")
        nodes = child.groupBy(F.col("node").alias("n_node"), F.col("branch").alias("n_branch")).agg(
            F.sum("seen").alias("seen"), F.sum("bad").alias("bad"), F.first("above").alias("above"), (F.min("lo") == F.max("hi")).alias("done"))
        nodes = nodes.select("n_node", "n_branch", "done", _smoothed(prior).alias("purity"))
        child = child.join(nodes, (F.col("node") == F.col("n_node")) & (F.col("branch") == F.col("n_branch")))
        child = staged(child.select(F.col("node").alias("c_node"), F.col("seg").alias("c_seg"), "branch", "purity", "done"), "nodes")
        rows = rows.drop("purity", "done").join(child, (F.col("node") == F.col("c_node")) & (seg == F.col("c_seg")))
        rows = rows.select("host", "shapes", "n", "seen", "bad", F.md5(F.concat("node", F.lit("/"), "branch")).alias("node"), F.concat("template", F.lit("/"), "branch").alias("template"), "purity", "done")
        rows, d = staged(rows, "tree"), d + 1


def url_filter(pages: DataFrame, rules=RULES, max_children: int = MAX_CHILDREN, prior: float = PRIOR, reject: float = REJECT) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity for each row of ``pages`` (page_id, url).

    Urls that a rule decides are the labelled ones; the tree carries their verdicts over to the other urls of their
    templates, and of the templates that theirs are merged with. template is the way to the node that a url is judged
    by, a merged branch named by its largest member, '*' where words are too many.

    Cases: null urls, and urls without ``://``, have an empty host and path, no rule, and are allowed unless their
    template, the empty one, is rejected. Equal urls are counted each and get equal results. A null page_id stays. An
    empty table gives an empty table. Very long paths are read whole. Other columns are left alone.
    """
    host, path = split_url(F.col("url"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    rows = pages.select("page_id", F.col("url").cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    rows = staged(rows.select("page_id", "host", "path", rule.alias("rule"), said.alias("said"), segments(F.col("path")).alias("shapes")), "urls")
    blocked = F.col("said") == "block"
    shapes = staged(rows.groupBy("host", "shapes").agg(F.count(F.lit(1)).alias("n"), F.count("said").alias("seen"), F.count_if(blocked).alias("bad")), "shapes")
    judged = templates(shapes, max_children, prior).select(F.col("host").alias("j_host"), F.col("shapes").alias("j_shapes"), "template", F.round("purity", 6).alias("purity"))
    out = rows.join(staged(judged, "judged"), (F.col("host") == F.col("j_host")) & (F.col("shapes") == F.col("j_shapes")))
    verdict = F.coalesce(F.col("said"), F.when(F.col("purity") >= reject, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages").select("page_id", "url"))


def _sql(levels: int = 6) -> str:
    """The same in SQL, with nodes named by their whole way, written out for ``levels`` levels; paths that still divide below raise."""
    fits = [(r, f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", v) for r, h, p, v in sorted(((h + p, h, p, v) for h, p, v in RULES), key=lambda r: -len(r[0]))]
    rule, said = (" ".join(["CASE", *(f"WHEN {cond} THEN '{r if what == 'rule' else v}'" for r, cond, v in fits), "END"]) for what in ("rule", "said"))
    body, ending = "regexp_replace(x, '\\.[A-Za-z]{2,5}$', '')", "regexp_extract(x, '(\\.[A-Za-z]{2,5})$', 1)"
    looks = (("{n}", "^[0-9]+$"), ("{date}", "^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$"), ("{hex}", "^[0-9a-fA-F-]{16,}$"), ("{id}", "[0-9]{3,}"))
    shaped = " ".join(["CASE", *(f"WHEN regexp_matches({body}, '{p}') THEN '{k}' || {ending}" for k, p in looks), "ELSE x END"])
    crit = f"[{', '.join(map(str, CHI_SQUARED))}]"
    smooth = f"(bad + {PRIOR} * above) / (seen + {PRIOR})"
    # unlike the DataFrame version, branches carry their members, and chi-squared is written out kind by kind
    kinds = range(1, len(KINDS) + 2)

    def alike(k: str, n: str, at) -> str:
        term = f"(x.{n} * l.{k}[0]::DOUBLE - l.{n} * x.{k}[0]::DOUBLE) * (x.{n} * l.{k}[0]::DOUBLE - l.{n} * x.{k}[0]::DOUBLE) / (l.{n}::DOUBLE * x.{n} * (l.{k}[0] + x.{k}[0]))"
        chi = "(0.0::DOUBLE + " + " + ".join(f"CASE WHEN l.{k}[{i}] + x.{k}[{i}] = 0 THEN 0.0::DOUBLE ELSE {term.replace('[0]', f'[{i}]')} END" for i in at) + ")"
        free = "(" + " + ".join(f"(l.{k}[{i}] + x.{k}[{i}] > 0)::INT" for i in at) + ")"
        return f"(l.{n} = 0 OR x.{n} = 0 OR {chi} <= {crit}[{free}] OR {chi} * (l.{n} + x.{n}) <= {LEAST_DIFFERENCE} * (l.{n}::DOUBLE * x.{n}))"

    at = f"coalesce(list_position(list_transform(s, lambda l: {alike('k', 'n', kinds)} AND {alike('y', 'seen', (1, 2))}), true), 0)"
    grown = "{'n': l.n + x.n, 'k': [" + ", ".join(f"l.k[{i}] + x.k[{i}]" for i in kinds) + "], 'seen': l.seen + x.seen, 'y': [l.y[1] + x.y[1], l.y[2] + x.y[2]], 'names': list_append(l.names, x.names[1])}"
    join = f"list_transform([{at}], lambda p: CASE WHEN p = 0 THEN list_append(s, x) ELSE list_transform(s, lambda l, i: CASE WHEN i = p THEN {grown} ELSE l END) END)[1]"
    ctes = [
        "u AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)",
        "h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u)",
        f"g AS (SELECT *, {rule} AS rule, {said} AS said, list_append(list_transform(string_split(substr(path, 2), '/'), lambda x: {shaped}), '{END}') AS shapes FROM h)",
        "q AS (SELECT host, shapes, count(*) AS n, count(said) AS seen, count(*) FILTER (WHERE said = 'block') AS bad FROM g GROUP BY ALL)",
        "a AS (SELECT (coalesce(sum(bad), 0) + 1) / (coalesce(sum(seen), 0) + 2) AS above FROM q)",
        f"o AS (SELECT host, {smooth} AS purity, one FROM (SELECT host, sum(seen) AS seen, sum(bad) AS bad, count(DISTINCT shapes) = 1 AS one FROM q GROUP BY host), a)",
        "r0 AS (SELECT q.*, host AS node, '' AS template, purity, one AS done FROM q JOIN o USING (host))",
    ]
    for d in range(levels):
        seg, below = f"shapes[{d + 1}]", f"coalesce(shapes[{d + 2}], '')"
        by_kind = [f"coalesce(sum(n) FILTER (WHERE starts_with({below}, '{k}')), 0)::BIGINT" for k in KINDS]
        by_kind.append(f"coalesce(sum(n) FILTER (WHERE NOT ({' OR '.join(f"starts_with({below}, '{k}')" for k in KINDS)})), 0)::BIGINT")
        ctes += [
            f"c{d} AS (SELECT node, {seg} AS seg, sum(n)::BIGINT AS n, [{', '.join(by_kind)}] AS k, sum(seen)::BIGINT AS seen, [sum(bad)::BIGINT, sum(seen - bad)::BIGINT] AS y FROM r{d} WHERE NOT done GROUP BY ALL)",
            f"l{d} AS (SELECT node, list({{'n': n, 'k': k, 'seen': seen, 'y': y, 'names': [seg]}} ORDER BY n DESC, seg) AS xs FROM c{d} WHERE NOT starts_with(seg, '{{') GROUP BY node HAVING count(*) <= {MAX_CHILDREN})",
            f"m{d} AS (SELECT node, unnest(list_reduce(xs, lambda s, x: {join}, xs[1:0])) AS b FROM l{d})",
            f"b{d} AS (SELECT node, b.names[1] AS branch, unnest(b.names) AS seg FROM m{d})",
            f"j{d} AS (SELECT r.host, r.shapes, r.n, r.seen, r.bad, r.purity AS above, r.node, r.template, coalesce(branch, CASE WHEN starts_with({seg}, '{{') THEN {seg} ELSE '*' END) AS branch FROM r{d} r LEFT JOIN b{d} b ON b.node = r.node AND b.seg = {seg} WHERE NOT r.done)",
            f"s{d} AS (SELECT node, branch, {smooth} AS purity, one FROM (SELECT node, branch, sum(seen) AS seen, sum(bad) AS bad, any_value(above) AS above, count(DISTINCT shapes[{d + 2}:]) = 1 AS one FROM j{d} GROUP BY ALL))",
            f"r{d + 1} AS (SELECT host, shapes, n, seen, bad, node || '/' || branch AS node, template || '/' || branch AS template, purity, one AS done FROM j{d} JOIN s{d} USING (node, branch))",
        ]
    leaves = " UNION ALL ".join(f"SELECT host, shapes, template, round(purity, 6) AS purity FROM r{d} WHERE done" for d in range(levels + 1))
    ctes.append(f"t AS ({leaves} UNION ALL SELECT host, shapes, error('more than {levels} levels'), 0 FROM r{levels} WHERE NOT done)")
    return f"WITH {', '.join(ctes)} SELECT page_id, host, path, rule, coalesce(said, CASE WHEN purity >= {REJECT} THEN 'block' ELSE 'allow' END) AS verdict, template, purity FROM g JOIN t USING (host, shapes)"


OP7_SQL = _sql()
