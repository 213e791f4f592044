"""Queries that apply the operators to the driver's tables, and DuckDB SQL for those that SQL expresses.

The tables hold no code, so each operator runs on a projection of the same shape: a graph of customers,
orders, parts and suppliers, paths from page URLs, texts from documents, flows from conversations.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text as fn
from graphloom.operators import dead_code, diff, enrich, features, graph, resolve, serve, validate
from graphloom.session import scratch, table
from graphloom.sources import files as file_source
from graphloom.sources import parse as parsing
from graphloom.streaming import progress

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# ---- graph G: customer -> order -> part -> supplier ----


def _name(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def _edges(spark: SparkSession, d: str, ring: bool = False) -> DataFrame:
    lines = table(spark, d, "lineitem")
    out = table(spark, d, "orders").select(_name("c:", "o_custkey").alias("src"), _name("o:", "o_orderkey").alias("dst"), F.lit("calls").alias("edge_type"))
    out = out.unionByName(lines.select(_name("o:", "l_orderkey").alias("src"), _name("p:", "l_partkey").alias("dst"), F.lit("instantiates").alias("edge_type")))
    out = out.unionByName(lines.select(_name("p:", "l_partkey").alias("src"), _name("s:", "l_suppkey").alias("dst"), F.lit("imports").alias("edge_type")))
    if ring:
        suppliers = table(spark, d, "supplier")
        next_ = ((F.col("s_suppkey") * 7 + 1) % F.col("n_")).alias("k_")
        step = suppliers.crossJoin(F.broadcast(suppliers.agg(F.count("*").alias("n_")))).select("s_suppkey", next_)
        out = out.unionByName(step.select(_name("s:", "s_suppkey").alias("src"), _name("s:", "k_").alias("dst"), F.lit("calls").alias("edge_type")))
    return out


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    parts = [("customer", "c_custkey", "c:"), ("orders", "o_orderkey", "o:"), ("part", "p_partkey", "p:"), ("supplier", "s_suppkey", "s:")]
    out = None
    for name, key, prefix in parts:
        one = table(spark, d, name).select(_name(prefix, key).alias("node"))
        out = one if out is None else out.unionByName(one)
    return out


def _starts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_mktsegment").alias("cluster"), _name("c:", "c_custkey").alias("node"))


_E = f"""e0 AS (SELECT 'c:' || o_custkey AS src, 'o:' || o_orderkey AS dst, 'calls' AS edge_type FROM orders
UNION ALL SELECT 'o:' || l_orderkey, 'p:' || l_partkey, 'instantiates' FROM lineitem
UNION ALL SELECT 'p:' || l_partkey, 's:' || l_suppkey, 'imports' FROM lineitem),
ring AS (SELECT * FROM e0 UNION ALL SELECT 's:' || s_suppkey, 's:' || ((s_suppkey * 7 + 1) % (SELECT count(*) FROM supplier)), 'calls' FROM supplier),
nodes AS (SELECT 'c:' || c_custkey AS node FROM customer UNION ALL SELECT 'o:' || o_orderkey FROM orders UNION ALL SELECT 'p:' || p_partkey FROM part UNION ALL SELECT 's:' || s_suppkey FROM supplier),
starts AS (SELECT c_mktsegment AS cluster, 'c:' || c_custkey AS node FROM customer)"""
_REACH = f"WITH RECURSIVE {_E}, reach AS (SELECT node FROM starts WHERE cluster = 'BUILDING' UNION SELECT ring.dst FROM reach JOIN ring ON ring.src = reach.node)"
_TAGGED = f"WITH RECURSIVE {_E}, tag0 AS (SELECT cluster, node FROM starts UNION SELECT tag0.cluster, e0.dst FROM tag0 JOIN e0 ON e0.src = tag0.node), tagged AS (SELECT DISTINCT cluster, node FROM tag0 WHERE node IN (SELECT node FROM nodes))"


@query(f"{_REACH} SELECT node FROM reach")
def reach_bfs(spark: SparkSession, d: str) -> DataFrame:
    """Nodes that customers of one segment reach, through the suppliers' cycle."""
    return graph.reachable(_starts(spark, d).where("cluster = 'BUILDING'"), _edges(spark, d, ring=True))


@query(f"{_REACH} SELECT node FROM nodes WHERE node NOT IN (SELECT node FROM reach)")
def unreachable_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.unreachable(_nodes(spark, d), _starts(spark, d).where("cluster = 'BUILDING'"), _edges(spark, d, ring=True))


@query(f"{_TAGGED} SELECT cluster, node FROM tagged")
def cluster_reach(spark: SparkSession, d: str) -> DataFrame:
    return features.tag_nodes(_starts(spark, d), _edges(spark, d), _nodes(spark, d))


@query("""WITH RECURSIVE near AS (SELECT s_suppkey AS src, (s_suppkey + 1) % (SELECT count(*) FROM supplier) AS dst FROM supplier),
reach AS (SELECT s_nationkey AS nation, min(s_suppkey) AS supplier FROM supplier GROUP BY s_nationkey UNION SELECT nation, dst FROM reach JOIN near ON src = supplier)
SELECT nation, 's:' || supplier AS node FROM reach""")
def ring_reach(spark: SparkSession, d: str) -> DataFrame:
    """What the first supplier of every nation reaches on a ring of all suppliers: as deep as there are suppliers."""
    suppliers = table(spark, d, "supplier")
    next_ = ((F.col("s_suppkey") + 1) % F.col("n_")).cast("string")
    ring = suppliers.join(F.broadcast(suppliers.agg(F.count("*").alias("n_"))))  # one row
    starts = suppliers.groupBy(F.col("s_nationkey").alias("nation")).agg(F.min("s_suppkey").alias("k_")).select("nation", _name("s:", "k_").alias("node"))
    return graph.reachable(starts, ring.select(_name("s:", "s_suppkey").alias("src"), F.concat(F.lit("s:"), next_).alias("dst")), by=("nation",))


@query(f"{_TAGGED} SELECT n.node, CASE WHEN k IS NULL THEN 'unmatched' WHEN k > 1 THEN 'shared' ELSE 'exclusive' END AS bucket FROM nodes n LEFT JOIN (SELECT node, count(*) AS k FROM tagged WHERE cluster <> 'FURNITURE' GROUP BY node) t USING (node)")
def shared_exclusive_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Customers of one segment are no entry points, so that they and their orders match no cluster."""
    return features.buckets(_nodes(spark, d), cluster_reach(spark, d).where("cluster <> 'FURNITURE'"))


@query(f"{_TAGGED}, sizes AS (SELECT cluster, count(*) + (SELECT count(*) FROM starts s WHERE s.cluster = tagged.cluster) AS size FROM tagged GROUP BY cluster), r AS (SELECT node, cluster, row_number() OVER (PARTITION BY node ORDER BY size, cluster) AS k FROM tagged JOIN sizes USING (cluster)) SELECT node, cluster AS feature FROM r WHERE k = 1")
def exclusive_assignment(spark: SparkSession, d: str) -> DataFrame:
    members = cluster_reach(spark, d).withColumnRenamed("cluster", "feature")
    counts = _starts(spark, d).groupBy(F.col("cluster").alias("feature")).agg(F.count("*").alias("entries"))
    return features.assign_exclusive(members, counts)


_DEAD = f"""WITH RECURSIVE {_E}, e AS (SELECT * FROM e0 UNION ALL SELECT 'c:' || c_custkey, 'c:' || c_custkey, 'calls' FROM customer WHERE c_acctbal < 0),
tag AS (SELECT cluster, node FROM starts WHERE cluster IN ('BUILDING', 'MACHINERY') UNION SELECT tag.cluster, e.dst FROM tag JOIN e ON e.src = tag.node),
inc AS (SELECT dst AS node, bool_and(src = dst) AS only_self, max(edge_type = 'imports') AS imported, max(edge_type IN ('calls', 'instantiates', 'inherits')) AS called FROM e GROUP BY dst),
facts AS (SELECT n.node, inc.node AS has, only_self, imported, called, n.node IN (SELECT node FROM tag) AS alive, (SELECT count(DISTINCT cluster) FROM tag WHERE tag.node = n.node) AS k FROM nodes n LEFT JOIN inc ON inc.node = n.node),
ruled AS (SELECT node, k, alive, CASE WHEN has IS NULL THEN 'no_references' WHEN only_self THEN 'self_referential' WHEN NOT alive THEN 'unreachable' WHEN imported AND NOT called THEN 'imported_not_called' END AS reason FROM facts)
SELECT node, reason, CASE reason WHEN 'no_references' THEN 0.95 WHEN 'self_referential' THEN 0.9 WHEN 'unreachable' THEN 0.8 ELSE 0.7 END::DOUBLE AS confidence FROM ruled WHERE reason IS NOT NULL AND """


def _dead(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    loops = table(spark, d, "customer").where("c_acctbal < 0").select(_name("c:", "c_custkey").alias("src"), _name("c:", "c_custkey").alias("dst"), F.lit("calls").alias("edge_type"))
    edges = _edges(spark, d).unionByName(loops)
    return edges, graph.reachable(_starts(spark, d).where("cluster in ('BUILDING', 'MACHINERY')"), edges, by=("cluster",))


@query(_DEAD + "NOT alive")
def dead_code_rules(spark: SparkSession, d: str) -> DataFrame:
    edges, tagged = _dead(spark, d)
    reached = tagged.select("node").distinct()
    return dead_code.candidates(_nodes(spark, d), edges, reached, reached)


@query(_DEAD + "k <> 1")
def dead_code_rule4(spark: SparkSession, d: str) -> DataFrame:
    """Only nodes of exactly one cluster are owned, so shared ones come to the last rule."""
    edges, tagged = _dead(spark, d)
    owned = tagged.groupBy("node").agg(F.countDistinct("cluster").alias("k")).where("k = 1")
    return dead_code.candidates(_nodes(spark, d), edges, tagged.select("node").distinct(), owned)


@query(f"WITH {_E} SELECT n.node, coalesce(i.c, 0) AS callers, coalesce(o.c, 0) AS callees, coalesce(i.s, false) AS only_self FROM nodes n LEFT JOIN (SELECT dst AS node, count(DISTINCT src) AS c, bool_and(src = dst) AS s FROM ring GROUP BY dst) i USING (node) LEFT JOIN (SELECT src AS node, count(DISTINCT dst) AS c FROM ring GROUP BY src) o USING (node)")
def degree_callers_callees(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(_nodes(spark, d), _edges(spark, d, ring=True))


@query(f"WITH {_E} SELECT src, dst, edge_type FROM e0 WHERE src IN (SELECT node FROM nodes WHERE node NOT LIKE 's:%') AND dst IN (SELECT node FROM nodes WHERE node NOT LIKE 's:%')")
def induced_subgraph(spark: SparkSession, d: str) -> DataFrame:
    return graph.induced(_edges(spark, d), _nodes(spark, d).where("node not like 's:%'"))


# ---- edges by their keys ----


@query("SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem a WHERE l_linenumber = 1 AND NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_linenumber > 1 AND a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey)")
def novel_edges_anti(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), "l_linenumber")
    return graph.novel(lines.where("l_linenumber = 1").drop("l_linenumber"), lines.where("l_linenumber > 1"), ("src", "dst"))


@query("SELECT 'o:' || l_orderkey AS src, 'p:' || l_partkey AS dst, md5('o:' || l_orderkey) AS source_id, md5('p:' || l_partkey) AS target_id FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 5)")
def fk_resolve_edges(spark: SparkSession, d: str) -> DataFrame:
    """All line items as edges; orders that are pending and small parts have no id, so their edges don't resolve."""
    edges = table(spark, d, "lineitem").select(_name("o:", "l_orderkey").alias("src"), _name("p:", "l_partkey").alias("dst"))
    known = table(spark, d, "orders").where("o_orderstatus <> 'P'").select(_name("o:", "o_orderkey").alias("fqn")).unionByName(table(spark, d, "part").where("p_size > 5").select(_name("p:", "p_partkey").alias("fqn")))
    return resolve.resolve_keys(edges, known.withColumn("id", F.md5("fqn")))


# ---- resolution ----

_RN = "SELECT 'f' || p_partkey % 50 || '.py' AS file_path, 'm' || p_partkey % 50 || ':' || replace(p_brand, '#', '') || '.' || replace(p_name, ' ', '_') AS qualified_name, replace(p_name, ' ', '_') AS name, 'f' || p_partkey % 50 || '.py::' || replace(p_name, ' ', '_') AS fqn, p_partkey AS seq FROM part UNION ALL SELECT 'g.py', 'g:' || c_name, c_name, 'g.py::' || c_name, 1000000000 + c_custkey FROM customer"


@query(f"""WITH n AS ({_RN}),
x AS (SELECT *, split_part(qualified_name, ':', 1) AS module, split_part(qualified_name, ':', 2) AS local FROM n),
l0 AS (SELECT 1 AS strategy, '' AS scope, fqn AS key, fqn, seq FROM x UNION ALL SELECT 2, '', module || '::' || name, fqn, seq FROM x UNION ALL SELECT 3, '', split_part(local, '.', 1) || '.' || name, fqn, seq FROM x WHERE contains(local, '.')),
l AS (SELECT strategy, scope, key, arg_max(fqn, seq) AS fqn FROM l0 GROUP BY ALL UNION ALL SELECT 4, file_path, name, min(fqn) FROM x GROUP BY ALL HAVING count(*) = 1 UNION ALL SELECT 5, '', name, min(fqn) FROM x GROUP BY name HAVING count(*) = 1),
own AS (SELECT qualified_name AS source, arg_max(file_path, seq) AS home, arg_max(CASE WHEN contains(local, '.') THEN split_part(local, '.', 1) END, seq) AS owner FROM x GROUP BY 1),
e AS (SELECT CAST(p_partkey AS VARCHAR) AS edge_id, 'm' || p_partkey % 50 || ':' || replace(p_brand, '#', '') || '.' || replace(p_name, ' ', '_') AS source, CASE p_partkey % 5 WHEN 0 THEN 'f' || (p_partkey + 1) % 50 || '.py::' || replace(p_name, ' ', '_') WHEN 1 THEN 'self.' || replace(p_name, ' ', '_') WHEN 2 THEN 'm' || p_partkey % 50 || '.' || replace(p_name, ' ', '_') WHEN 3 THEN 'Customer#' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') ELSE replace(p_brand, '#', '') || '.' || replace(p_name, ' ', '_') END AS target FROM part),
r AS (SELECT e.*, home, owner, CASE WHEN starts_with(target, 'self.') THEN substr(target, 6) END AS own_, regexp_extract(target, '^(.*)\\.[^.]+$', 1) AS head, split_part(target, '.', -1) AS short FROM e LEFT JOIN own USING (source)),
w AS (SELECT edge_id, 1 AS priority, 1 AS strategy, '' AS scope, target AS key FROM r UNION ALL SELECT edge_id, 2, 2, '', CASE WHEN contains(target, '.') THEN regexp_replace(target, '^([^.]*)\\.', '\\1::') ELSE target END FROM r
UNION ALL SELECT edge_id, 3, 2, '', head || '::' || short FROM r WHERE head <> '' UNION ALL SELECT edge_id, 4, 3, '', target FROM r WHERE own_ IS NULL UNION ALL SELECT edge_id, 5, 3, '', owner || '.' || own_ FROM r WHERE owner IS NOT NULL AND own_ IS NOT NULL
UNION ALL SELECT edge_id, 6, 4, coalesce(home, ''), coalesce(own_, short) FROM r UNION ALL SELECT edge_id, 7, 5, '', coalesce(own_, short) FROM r),
h AS (SELECT edge_id, arg_min(fqn, priority) AS resolved FROM w JOIN l USING (strategy, scope, key) GROUP BY edge_id)
SELECT e.edge_id, e.source, e.target, resolved FROM e LEFT JOIN h USING (edge_id)""")
def resolve_cascade(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").withColumn("n_", F.replace("p_name", F.lit(" "), F.lit("_"))).withColumn("b_", F.replace("p_brand", F.lit("#"), F.lit(""))).withColumn("k_", (F.col("p_partkey") % 50).cast("string"))
    file = F.concat(F.lit("f"), "k_", F.lit(".py"))
    qualified = F.concat(F.lit("m"), "k_", F.lit(":"), "b_", F.lit("."), "n_")
    nodes = part.select(file.alias("file_path"), qualified.alias("qualified_name"), F.col("n_").alias("name"), fn.fqn(file, F.col("n_")).alias("fqn"), F.col("p_partkey").alias("seq"))
    people = table(spark, d, "customer").select(F.lit("g.py").alias("file_path"), F.concat(F.lit("g:"), "c_name").alias("qualified_name"), F.col("c_name").alias("name"), fn.fqn(F.lit("g.py"), F.col("c_name")).alias("fqn"), (F.col("c_custkey") + 1_000_000_000).alias("seq"))
    kind = F.col("p_partkey") % 5
    target = (
        F.when(kind == 0, F.concat(F.lit("f"), ((F.col("p_partkey") + 1) % 50).cast("string"), F.lit(".py::"), "n_")).when(kind == 1, F.concat(F.lit("self."), "n_")).when(kind == 2, F.concat(F.lit("m"), "k_", F.lit("."), "n_"))
        .when(kind == 3, F.concat(F.lit("Customer#"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"))).otherwise(F.concat("b_", F.lit("."), "n_"))
    )
    edges = part.select(F.col("p_partkey").cast("string").alias("edge_id"), qualified.alias("source"), target.alias("target"))
    return resolve.resolve_targets(edges, nodes.unionByName(people))


_PATH = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '^https?://[^/]*', ''), '[?#].*$', ''), '\\.html$', ''), '/+$', '')"


def _page_paths(spark: SparkSession, d: str) -> DataFrame:
    path = F.col("url")
    for pattern in ("^https?://[^/]*", "[?#].*$", r"\.html$", "/+$"):
        path = F.regexp_replace(path, pattern, "")
    return table(spark, d, "pages").select("page_id", path.alias("path"), "url")


@query(f"WITH p AS (SELECT page_id, ltrim({_PATH}, '/') AS path FROM pages), f AS (SELECT DISTINCT path || '.py' AS file_path, path FROM p WHERE page_id % 2 = 0 AND path <> ''), m AS (SELECT DISTINCT replace(path, '/', '.') AS module_path FROM p WHERE page_id % 2 = 1 AND path <> '') SELECT DISTINCT module_path, file_path FROM m JOIN f ON f.path = replace(module_path, '.', '/') OR ends_with(f.path, '/' || replace(module_path, '.', '/'))")
def import_symbol_join(spark: SparkSession, d: str) -> DataFrame:
    rows = _page_paths(spark, d).select("page_id", F.regexp_replace("path", "^/+", "").alias("path")).where("path <> ''")
    files = rows.where("page_id % 2 = 0").select(F.concat("path", F.lit(".py")).alias("file_path")).distinct()
    return resolve.module_files(rows.where("page_id % 2 = 1").select(F.replace("path", F.lit("/"), F.lit(".")).alias("module_path")), files)


@query("SELECT DISTINCT p.p_brand AS file_path, c.class, p.method FROM (SELECT DISTINCT p_brand, split_part(p_name, ' ', 2) AS class FROM part) c JOIN (SELECT p_brand, CAST(p_partkey AS VARCHAR) AS method, 'm:' || split_part(p_name, ' ', 2) || '.' || p_partkey AS q FROM part) p ON c.p_brand = p.p_brand AND (contains(':' || q, ':' || class || '.') OR contains(':' || q, '.' || class || '.'))")
def class_method_owner(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select(F.col("p_brand").alias("file_path"), F.split("p_name", " ")[1].alias("class"), F.col("p_partkey").cast("string").alias("method"))
    methods = part.select("file_path", "method", F.concat(F.lit("m:"), "class", F.lit("."), "method").alias("qualified_name"))
    return resolve.class_members(part.select("file_path", "class").distinct(), methods)


# ---- serving ----


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    return serve.latest(table(spark, d, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name, coalesce(c, 0) AS node_count FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS c FROM customer GROUP BY 1) ON c_nationkey = n_nationkey")
def feature_counts(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("feature_id"))
    return serve.feature_list(table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name")), nodes)


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, n_name AS feature_name, CASE c_mktsegment WHEN 'BUILDING' THEN 'classNode' WHEN 'MACHINERY' THEN 'methodNode' ELSE 'functionNode' END AS view_type FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey < 20")
def graph_payload(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "class").when(F.col("c_mktsegment") == "MACHINERY", "method").otherwise("function")
    nodes = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), kind.alias("node_type"), F.col("c_nationkey").cast("string").alias("feature_id"))
    named = table(spark, d, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"), F.lit("#000000").alias("color"))
    return serve.graph_nodes(nodes, named).select("id", "feature_name", "view_type")


@query("SELECT CAST(conv_id AS VARCHAR) AS feature, CAST(turn AS VARCHAR) AS source, CAST(nxt AS VARCHAR) AS target FROM (SELECT *, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations) WHERE nxt IS NOT NULL AND role <> 'user'")
def flow_steps(spark: SparkSession, d: str) -> DataFrame:
    """Turns lead to the next one; those of users have edges of their own."""
    turns = table(spark, d, "conversations")
    node = F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    steps = turns.select(F.col("conv_id").cast("string").alias("feature"), node.alias("node"), F.col("turn").alias("list_pos"))
    found = serve.sequential_edges(steps, turns.where("role = 'user'").select(node.alias("src")))
    return found.select("feature", F.substring_index("source", "/", -1).alias("source"), F.substring_index("target", "/", -1).alias("target"))


@query("SELECT md5(coalesce(text, '')) AS h, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY 1")
def first_last_dedup(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.md5(F.coalesce("text", F.lit(""))).alias("h"), "doc_id")
    first = resolve.first_wins(docs, ["h"], ["doc_id"]).withColumnRenamed("doc_id", "first_id")
    return first.join(resolve.last_wins(docs, ["h"], ["doc_id"]).withColumnRenamed("doc_id", "last_id"), "h")


@query("SELECT p_partkey, array_to_string(list(name ORDER BY seq), ',') AS context FROM (SELECT a.p_partkey, b.p_partkey AS seq, CAST(b.p_partkey AS VARCHAR) AS name, row_number() OVER (PARTITION BY a.p_partkey ORDER BY b.p_partkey) AS k FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_partkey <> b.p_partkey) WHERE k <= 10 GROUP BY p_partkey")
def neighbour_context(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "part").select("p_partkey", "p_brand", F.col("p_partkey").alias("seq"), F.col("p_partkey").cast("string").alias("name"))
    return serve.neighbours(nodes, "p_brand").where(F.size("context") > 0).select("p_partkey", F.array_join("context", ",").alias("context"))


# ---- scalars ----

_API = f"'/api' || {_PATH} || '/{{id}}/x'"


@query(f"SELECT page_id, array_to_string(list_prepend('', list_slice(list_filter(string_split({_API}, '/'), lambda s: s <> '' AND NOT starts_with(s, '{{') AND NOT starts_with(s, ':')), 1, 2)), '/') AS prefix, array_to_string(list_filter(string_split({_API}, '/'), lambda s: s <> '' AND NOT starts_with(s, '{{') AND NOT starts_with(s, ':')), '/') AS bare FROM pages")
def url_prefix(spark: SparkSession, d: str) -> DataFrame:
    url = F.concat(F.lit("/api"), "path", F.lit("/{id}/x"))
    return _page_paths(spark, d).select("page_id", fn.url_prefix(url).alias("prefix"), fn.strip_params(url).alias("bare"))


@query("SELECT doc_id, source || '/' || lang || '.py::d' || doc_id AS fqn, replace(source || '/' || lang, '/', '.') AS module, 'd' || doc_id AS short, source AS directory, lower(regexp_replace(source || '-' || lang || '!', '[^a-zA-Z0-9]+', '_', 'g').trim('_')) AS snake FROM documents")
def scalar_paths(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    path = F.concat("source", F.lit("/"), "lang", F.lit(".py"))
    key = fn.fqn(path, _name("d", "doc_id"))
    return docs.select("doc_id", key.alias("fqn"), fn.module_name(path).alias("module"), fn.short_name(key).alias("short"), fn.directory_key(key).alias("directory"), fn.snake(F.concat("source", F.lit("-"), "lang", F.lit("!"))).alias("snake"))


@query("SELECT doc_id, sha256(text) AS sha, md5(text) AS md FROM documents")
def hashes(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    return file_source.manifest(docs, md=F.md5("content")).select(F.col("path").alias("doc_id"), F.col("content_hash").alias("sha"), "md")


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' WHEN 2 THEN 'rust' ELSE 'unknown' END AS language FROM pages")
def ext_language(spark: SparkSession, d: str) -> DataFrame:
    ends = F.element_at(F.array(F.lit(".PY"), F.lit(".tsx"), F.lit(".rs"), F.lit(".html")), (F.col("page_id") % 4 + 1).cast("int"))
    return table(spark, d, "pages").select("page_id", fn.language(F.concat(F.lit("a/b"), F.col("page_id").cast("string"), ends), "unknown").alias("language"))


@query("SELECT doc_id FROM documents WHERE n_chars BETWEEN 1 AND 2000 AND source NOT IN ('src1', 'src2')")
def file_filter(spark: SparkSession, d: str) -> DataFrame:
    folder = F.when(F.col("source") == "src1", "node_modules").when(F.col("source") == "src2", ".cache").otherwise(F.col("source"))
    path = F.concat(folder, F.lit("/"), F.col("doc_id").cast("string"), F.lit(".py"))
    return table(spark, d, "documents").where(file_source.wanted(path, F.col("n_chars"), 2000)).select("doc_id")


_HINTED = ", ".join(f"'{h}'" for h in fn.DYNAMIC_HINTS)


@query(f"WITH h AS (SELECT [{_HINTED}] AS hints), d AS (SELECT doc_id, hints, coalesce(text, '') || CASE WHEN doc_id % 30 < len(hints) THEN upper(hints[doc_id % 30 + 1]) ELSE '' END AS code FROM documents, h) SELECT doc_id FROM d WHERE len(list_filter(hints, lambda x: contains(lower(code), x))) > 0")
def dynamic_predicate(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a word of dynamic code, of which half of them get one in capitals."""
    hint = F.get(F.array(*map(F.lit, fn.DYNAMIC_HINTS)), (F.col("doc_id") % 30).cast("int"))
    code = F.concat(F.coalesce("text", F.lit("")), F.coalesce(F.upper(hint), F.lit("")))
    return table(spark, d, "documents").where(fn.has_dynamic_hint(code)).select("doc_id")


@query("SELECT doc_id, array_to_string(list_slice(string_split(text, chr(10)), 2, 3), chr(10)) AS lines, CASE WHEN length(text) > 100 THEN left(text, 100) || '...' ELSE text END AS short FROM documents")
def line_slices(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", fn.line_slice(F.col("text"), F.lit(2), F.lit(3)).alias("lines"), fn.truncated(F.col("text"), 100, "...").alias("short"))


@query("SELECT doc_id, CAST(len(list_filter(string_split(lower(text), chr(10)), lambda x: regexp_matches(trim(x), '^(if|elif|else|for|while|except|with|and|or)[ :]'))) + 1 AS INT) AS complexity FROM documents")
def complexity(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", fn.complexity(F.lower("text")).alias("complexity"))


@query("SELECT p_partkey, round(least(p_size / 50.0, 1.0) + CASE WHEN p_partkey % 2 = 0 THEN 0.3 ELSE 0 END + CASE WHEN p_partkey % 3 = 0 THEN 0.5 ELSE 0 END, 3)::DOUBLE AS score FROM part")
def importance(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", fn.importance(F.col("p_size"), F.col("p_partkey") % 2 == 0, F.col("p_partkey") % 3 == 0).alias("score"))


@query("SELECT doc_id, round(CASE WHEN quality = 0 THEN least(0.97 + 0.05, 1.0) WHEN toxic = 1 THEN greatest(0.3 - 0.3, 0.1) ELSE 0.8 * 0.7 END, 6)::DOUBLE AS confidence FROM labels")
def confidence_adjust(spark: SparkSession, d: str) -> DataFrame:
    verdict = F.when(F.col("quality") == 0, "dead_code").when(F.col("toxic") == 1, "constant").otherwise("generated")
    start = F.when(F.col("quality") == 0, 0.97).when(F.col("toxic") == 1, 0.3).otherwise(0.8)
    return table(spark, d, "labels").select("doc_id", F.round(dead_code.adjusted(start, verdict), 6).alias("confidence"))


_PALETTE = ", ".join(f"'{c}'" for c in fn.COLORS)


@query(f"SELECT p_partkey, ([{_PALETTE}])[p_partkey % 16 + 1] AS color, CASE WHEN p_size < 10 THEN '#ef4444' WHEN p_size < 20 THEN '#22c55e' ELSE ([{_PALETTE}])[p_partkey % 16 + 1] END AS border FROM part")
def colors(spark: SparkSession, d: str) -> DataFrame:
    own = fn.color(F.col("p_partkey"))
    return table(spark, d, "part").select("p_partkey", own.alias("color"), serve.border_color(F.col("p_size") < 10, F.col("p_size") < 20, own).alias("border"))


# ---- names and groups ----


@query("WITH w AS (SELECT p_brand AS g, p_partkey * 100 + i AS seq, string_split(p_name, ' ')[i] AS word FROM part, unnest(range(1, len(string_split(p_name, ' ')) + 1)) AS r(i)), c AS (SELECT g, word, count(*) AS n, min(seq) AS f FROM w GROUP BY ALL) SELECT g AS \"group\", word FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY n DESC, f) AS k FROM c) WHERE k = 1")
def name_mode(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(F.col("p_brand").alias("group"), "p_partkey", F.posexplode(F.split("p_name", " ")).alias("i", "word"))
    return features.most_common_word(rows.withColumn("seq", F.col("p_partkey") * 100 + F.col("i") + 1))


@query("WITH g AS (SELECT c_nationkey, min(c_name) AS a, max(c_name) AS b FROM customer GROUP BY 1) SELECT c_nationkey, substr(a, 1, coalesce((SELECT min(i) FROM unnest(range(1, length(a) + 1)) AS r(i) WHERE substr(a, i, 1) <> substr(b, i, 1)) - 1, length(a))) AS prefix FROM g")
def common_prefix(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").groupBy("c_nationkey").agg(F.min("c_name").alias("a"), F.max("c_name").alias("b"))
    return rows.select("c_nationkey", fn.common_prefix(F.col("a"), F.col("b")).alias("prefix"))


@query("WITH p AS (SELECT p_brand, split_part(p_name, ' ', 2) AS k, p_partkey, string_split(p_name, ' ') AS w FROM part), n AS (SELECT p_brand, k, count(*) AS n FROM p GROUP BY ALL), u AS (SELECT p_brand, k, word, count(DISTINCT p_partkey) AS c FROM (SELECT p_brand, k, p_partkey, unnest(w) AS word FROM p) GROUP BY ALL) SELECT p_brand, k, array_to_string(list(word ORDER BY word), ' ') AS words FROM u JOIN n USING (p_brand, k) WHERE c = n AND word NOT IN ('get', 'set') GROUP BY p_brand, k")
def common_words(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_brand", F.split("p_name", " ")[1].alias("k"), F.split("p_name", " ").alias("w")).groupBy("p_brand", "k").agg(F.collect_list("w").alias("w"))
    return rows.select("p_brand", "k", F.array_join(F.array_sort(features.shared_words(F.col("w"))), " ").alias("words")).where("words <> ''")


@query(f"{_TAGGED} SELECT count(*) FILTER (k = 2) / count(*) AS jaccard FROM (SELECT node, count(*) AS k FROM tagged WHERE cluster IN ('BUILDING', 'MACHINERY') GROUP BY node)")
def jaccard_overlap(spark: SparkSession, d: str) -> DataFrame:
    two = _starts(spark, d).where("cluster in ('BUILDING', 'MACHINERY')")
    return features.overlap(features.tag_nodes(two, _edges(spark, d), _nodes(spark, d)), "BUILDING", "MACHINERY")


@query(f"{_TAGGED}, m AS (SELECT DISTINCT 'F' || length(cluster) AS feature, node FROM tagged UNION SELECT 'F8', node FROM nodes WHERE node LIKE 'o:%'), r AS (SELECT DISTINCT 'F' || length(cluster) AS feature, node FROM tagged), c AS (SELECT feature, count(*) AS nodes, count(*) FILTER ((feature, node) NOT IN (SELECT (feature, node) FROM r)) AS unreached FROM m GROUP BY feature) SELECT feature, nodes, unreached, unreached / nodes AS ratio, CASE WHEN unreached / nodes > 0.5 THEN 'mostly_unreachable' END AS issue FROM c")
def unreachable_ratio(spark: SparkSession, d: str) -> DataFrame:
    reached = cluster_reach(spark, d).select(F.concat(F.lit("F"), F.length("cluster").cast("string")).alias("feature"), "node").distinct()
    members = reached.union(_nodes(spark, d).where("node like 'o:%'").select(F.lit("F8"), "node")).distinct()
    names = members.select("feature").distinct()
    return features.structure(names, members, names.withColumn("entries", F.lit(1)), reached)


@query("SELECT c_custkey, CAST(least(floor((row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) / greatest(1, count(*) OVER (PARTITION BY c_nationkey) // 3)), 2) AS INT) AS chunk FROM customer")
def chunk_split(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("feature"))
    return features.chunks(rows, 3, F.col("c_custkey")).select("c_custkey", "chunk")


@query("SELECT CAST(a.n_nationkey AS VARCHAR) AS node, a.n_name AS owner, coalesce((SELECT arg_min(b.n_name, b.n_nationkey) FROM nation b WHERE contains(lower(b.n_name), lower(a.n_name))), a.n_name) AS suggested_feature FROM nation a")
def owner_match(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation")
    members = nation.select(F.col("n_nationkey").alias("feature_idx"), F.col("n_name").alias("feature"), F.col("n_name").alias("fqn"))
    return dead_code.suggested_owner(nation.select(F.col("n_nationkey").cast("string").alias("node"), F.col("n_name").alias("owner")), members)


@query("WITH i AS (SELECT p_partkey AS item, unnest(list_distinct(string_split(p_name, ' '))) AS t FROM part), f AS (SELECT DISTINCT p_brand AS feature_idx, unnest(string_split(p_name, ' ')) AS t FROM part), c AS (SELECT item, feature_idx, count(*) AS n FROM i JOIN f USING (t) GROUP BY ALL) SELECT item, feature_idx, n AS shared FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY n DESC, feature_idx) AS k FROM c) WHERE k = 1")
def token_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Features from all parts, one per brand."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("item"), "p_brand", F.split("p_name", " ").alias("tokens"))
    words = part.select(F.col("p_brand").alias("feature_idx"), F.explode("tokens").alias("token")).distinct()
    return resolve.token_match(part.select("item", "tokens"), words.groupBy("feature_idx").agg(F.collect_list("token").alias("tokens")))


_OLD, _NEW = "SELECT doc_id AS path, md5(text) AS h FROM documents WHERE doc_id % 5 <> 0", "SELECT doc_id AS path, md5(CASE WHEN doc_id % 11 = 0 THEN text || 'x' ELSE text END) AS h FROM documents WHERE doc_id % 7 <> 0"


@query(f"""WITH o AS ({_OLD}), n AS ({_NEW}), a AS (SELECT CAST(path AS VARCHAR) AS path, h, row_number() OVER (PARTITION BY h ORDER BY CAST(path AS VARCHAR)) AS k FROM n WHERE path NOT IN (SELECT path FROM o)),
x AS (SELECT CAST(path AS VARCHAR) AS path, h, row_number() OVER (PARTITION BY h ORDER BY CAST(path AS VARCHAR)) AS k FROM o WHERE path NOT IN (SELECT path FROM n)), r AS (SELECT a.path, x.path AS old_path FROM a JOIN x USING (h, k))
SELECT path, 'renamed' AS change_type, old_path FROM r UNION ALL SELECT path, 'added', NULL FROM a WHERE path NOT IN (SELECT path FROM r) UNION ALL SELECT path, 'deleted', NULL FROM x WHERE path NOT IN (SELECT old_path FROM r)
UNION ALL SELECT CAST(o.path AS VARCHAR), 'modified', NULL FROM o JOIN n ON o.path = n.path AND o.h <> n.h""")
def manifest_diff(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    path = F.col("doc_id").cast("string").alias("path")
    old = docs.where("doc_id % 5 <> 0").select(path, F.md5("text").alias("content_hash"))
    new = docs.where("doc_id % 7 <> 0").select(path, F.md5(F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))).alias("content_hash"))
    return diff.manifest_diff(old, new)


# ---- no SQL: tests hold these against brute force ----


@query()
def parse_python(spark: SparkSession, d: str) -> DataFrame:
    """Parses a module made from each part; names, types and lines of its nodes."""
    n, b = F.replace("p_name", F.lit(" "), F.lit("_")), F.regexp_replace("p_brand", "[^A-Za-z0-9]", "")
    code = F.concat(F.lit("import os\n\nclass "), b, F.lit(":\n    def "), n, F.lit("(self, x: int):\n        return self.other(os.path.join(x))\n\ndef main():\n    "), b, F.lit("()\n"))
    files = table(spark, d, "part").select(F.concat(F.lit("pkg/p"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"), code.alias("content"))
    return parsing.nodes(parsing.parse(files)).select("fqn", "qualified_name", "node_type", "line_start", "line_end")


@query("""WITH RECURSIVE d AS (SELECT concat_ws('/', source, lang) AS repo, CAST(doc_id AS VARCHAR) AS path, n_chars AS size, row_number() OVER (PARTITION BY concat_ws('/', source, lang) ORDER BY doc_id) AS k FROM documents),
f AS (SELECT repo, path, k, size <= 80000 AS whole, CASE WHEN size <= 80000 THEN size ELSE 100 END AS total FROM d WHERE k = 1
UNION ALL SELECT d.repo, d.path, d.k, f.total + d.size <= 80000, f.total + CASE WHEN f.total + d.size <= 80000 THEN d.size ELSE 100 END FROM f JOIN d ON d.repo = f.repo AND d.k = f.k + 1)
SELECT repo, path, CASE WHEN whole THEN 'full' ELSE 'minimal' END AS form FROM f""")
def budget_fold(spark: SparkSession, d: str) -> DataFrame:
    """A prompt's budget over the documents of each source and language."""
    docs = table(spark, d, "documents").select(F.concat_ws("/", "source", "lang").alias("repo"), F.col("doc_id").cast("string").alias("path"), F.col("doc_id").alias("seq"), F.col("n_chars").alias("full_size"), F.lit(100).alias("min_size"))
    return enrich.budget_fold(docs, 80_000)


@query("""WITH a AS (SELECT 'p:' || p_partkey AS node, CASE p_size % 5 WHEN 0 THEN 'constant' WHEN 1 THEN 'dead_code' WHEN 2 THEN 'other' WHEN 3 THEN 'type_definition' END AS classification, CASE WHEN p_retailprice > 1200 THEN p_type ELSE p_brand END AS owner, p_name AS reason, p_type FROM part),
o AS (SELECT p_brand AS owner, min(p_brand || '/' || p_type) AS feature FROM part WHERE p_size > 25 GROUP BY p_brand),
t AS (SELECT p_type, min(p_brand) AS place FROM part GROUP BY p_type),
s AS (SELECT node, coalesce(classification, '') AS classification, reason, coalesce(feature, CASE WHEN coalesce(classification, '') NOT IN ('dead_code', 'other') THEN place END, '') AS found FROM a LEFT JOIN o USING (owner) LEFT JOIN t USING (p_type))
SELECT node, CASE WHEN classification = 'constant' THEN '__structural__' ELSE found END AS suggested_feature, classification, reason, CASE WHEN classification = 'constant' THEN 0.6 WHEN found <> '' THEN 0.7 ELSE 0.3 END::DOUBLE AS confidence FROM s""")
def connection_scores(spark: SparkSession, d: str) -> DataFrame:
    """Suggested features of parts: their owner is a brand, or a type, which is no feature; else their type's first brand."""
    part = table(spark, d, "part")
    kind = F.col("p_size") % 5
    said = F.when(kind == 0, "constant").when(kind == 1, "dead_code").when(kind == 2, "other").when(kind == 3, "type_definition")
    owner = F.when(F.col("p_retailprice") > 1200, F.col("p_type")).otherwise(F.col("p_brand"))
    rows = part.select(_name("p:", "p_partkey").alias("node"), said.alias("classification"), owner.alias("owner"), F.col("p_name").alias("reason"), "p_type")
    owners = part.where("p_size > 25").select(F.col("p_brand").alias("owner"), F.concat_ws("/", "p_brand", "p_type").alias("feature"))
    first = part.groupBy("p_type").agg(F.min("p_brand").alias("feature"))
    return enrich.suggestions(rows.drop("p_type"), owners, rows.select("node", "p_type").join(first, "p_type").select("node", "feature"))


@query("""SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN NOT coalesce(l_returnflag IN ('N', 'R'), false) THEN 'flag' END, CASE WHEN NOT coalesce(l_quantity BETWEEN 2 AND 45, false) THEN 'quantity' END,
CASE WHEN NOT coalesce(l_discount + l_tax < 0.15, false) THEN 'rates' END) AS broken FROM lineitem WHERE NOT coalesce(l_returnflag IN ('N', 'R') AND l_quantity BETWEEN 2 AND 45 AND l_discount + l_tax < 0.15, false)""")
def rule_violations(spark: SparkSession, d: str) -> DataFrame:
    """Line items that go to quarantine, with the rules that they break."""
    rules = (validate.Rule("flag", validate.one_of("l_returnflag", ("N", "R"))), validate.Rule("quantity", "l_quantity between 2 and 45"), validate.Rule("rates", "l_discount + l_tax < 0.15"))
    found = validate.judged(table(spark, d, "lineitem"), rules).where(F.size("broken") > 0)
    return found.select("l_orderkey", "l_linenumber", F.array_join("broken", ",").alias("broken"))


@query()
def fuzzy_match(spark: SparkSession, d: str) -> DataFrame:
    """Parts' names with a letter less, matched with the names of their type's first parts."""
    part = table(spark, d, "part")
    steps = part.select(F.col("p_partkey").alias("step_id"), F.col("p_type").alias("file"), F.expr("substr(p_name, 2)").alias("function"))
    signatures = part.groupBy(F.col("p_type").alias("file"), F.col("p_name").alias("name")).agg(F.min("p_partkey").cast("int").alias("line_start"), F.max("p_partkey").cast("int").alias("line_end"))
    return enrich.match_signatures(steps, signatures)


@query("SELECT user_id AS repo_id, event_type, ts, event_id AS seq FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def progress_stream(spark: SparkSession, d: str) -> DataFrame:
    """The latest event per user from a file stream of the events: keyed state, changes appended to a table."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d).select(F.col("user_id").alias("repo_id"), "event_type", "ts", F.col("event_id").alias("seq"))
    folder, checkpoint = scratch(spark, "progress"), scratch(spark, "progress-state")
    changes = progress.updates(stream)
    progress.start_updates(changes, folder, checkpoint, available_now=True).awaitTermination()
    return progress.current(spark, folder, changes.schema).withColumn("ts", F.col("ts").cast(schema["ts"].dataType))
