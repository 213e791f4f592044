"""More queries with SQL: views, resolution, names, groups and changes on projections of the driver's tables.

Parts stand for code nodes, line items for edges, orders for snapshots of repositories, customers for entry points.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import text as fn
from graphloom.operators import dead_code, diff, enrich, features, graph, layers, resolve, serve
from graphloom.plans import agent, analysis
from graphloom.plans.catalog import _E, _PATH, SQL, _edges, _nodes, _page_paths, manifest_diff, query
from graphloom.session import table, written
from graphloom.sources import parse as parsing
from graphloom.streaming import progress


def _text(column: str):
    return F.col(column).cast("string")


# ---- code nodes, edges and snapshots ----

_N = """n AS (SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name, (['function', 'method', 'class', 'module'])[p_partkey % 4 + 1] AS node_type, 'src/' || lower(replace(p_brand, '#', '')) || '.py' AS file_path, p_size AS line_start, p_size + 10 AS line_end,
CASE WHEN p_partkey % 6 <> 0 THEN CAST(p_partkey % 5 AS VARCHAR) END AS feature_id, CASE WHEN p_partkey % 3 <> 0 THEN p_partkey % 50 END AS flow_order, p_partkey % 7 = 0 AS is_dead_code, p_partkey FROM part)"""
_CE = "e AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey AS VARCHAR) AS source_node_id, CAST(l_suppkey AS VARCHAR) AS target_node_id, (['calls', 'imports', 'instantiates'])[l_linenumber % 3 + 1] AS edge_type FROM lineitem)"
_S = "s AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS repo_id, o_orderpriority, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status, o_orderdate AS analyzed_at FROM orders)"


def _pick(column, *values: str):
    return F.element_at(F.array(*map(F.lit, values)), (column % len(values) + 1).cast("int"))


def _code_nodes(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("p_partkey")
    meta = F.when(key % 3 == 0, F.concat(F.lit('{"reason": "r'), _text("p_size"), F.lit('", "confidence": 0.7, "suggested_feature": "f"}'))).when(key % 3 == 1, F.lit("not json"))
    return table(spark, d, "part").select(
        key.cast("string").alias("id"), F.col("p_name").alias("name"), _pick(key, "function", "method", "class", "module").alias("node_type"), F.concat(F.lit("src/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.lit(".py")).alias("file_path"),
        F.col("p_size").alias("line_start"), (F.col("p_size") + 10).alias("line_end"), F.when(key % 6 != 0, (key % 5).cast("string")).alias("feature_id"), F.when(key % 3 != 0, key % 50).alias("flow_order"), (key % 7 == 0).alias("is_dead_code"), meta.alias("metadata"),
        F.when(key % 2 == 0, F.concat(F.lit("step "), "p_name")).alias("flow_description"), F.when(key % 5 != 0, F.col("p_type")).alias("description"),
    )


def _code_edges(spark: SparkSession, d: str) -> DataFrame:
    kind = _pick(F.col("l_linenumber"), "calls", "imports", "instantiates")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", _text("l_partkey").alias("source_node_id"), _text("l_suppkey").alias("target_node_id"), kind.alias("edge_type"))


def _snapshots(spark: SparkSession, d: str, repo: str = "o_custkey") -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running").otherwise("failed")
    return table(spark, d, "orders").select(_text("o_orderkey").alias("id"), _text(repo).alias("repo_id"), status.alias("status"), F.col("o_orderdate").alias("analyzed_at"))


@query(f"WITH {_CE} SELECT l_orderkey, l_linenumber, edge_type IN ('calls', 'instantiates') AS moves, edge_type = 'calls' AS animated FROM e")
def edge_views(spark: SparkSession, d: str) -> DataFrame:
    """Which edges move in the graph, and which in a flow."""
    moves = serve.graph_edges(_code_edges(spark, d)).withColumnRenamed("animated", "moves")
    return serve.graph_edges(moves, flow=True).select("l_orderkey", "l_linenumber", "moves", "animated")


@query(f"WITH {_S} SELECT repo_id, id FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY analyzed_at DESC, id DESC) AS k FROM s WHERE status = 'completed') WHERE k = 1")
def latest_completed(spark: SparkSession, d: str) -> DataFrame:
    return serve.latest_completed(_snapshots(spark, d)).select("repo_id", "id")


@query(f"WITH {_S}, r AS (SELECT repo_id, id FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY analyzed_at DESC, id DESC) AS k FROM s WHERE status = 'completed') WHERE k = 1) SELECT repo_id, CAST(l_suppkey AS VARCHAR) AS feature_id, count(*) AS node_count FROM lineitem JOIN r ON id = CAST(l_orderkey AS VARCHAR) WHERE l_linenumber % 4 <> 0 GROUP BY ALL")
def counts_in_latest(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "lineitem").select(_text("l_orderkey").alias("snapshot_id"), F.when(F.col("l_linenumber") % 4 != 0, _text("l_suppkey")).alias("feature_id"))
    return serve.count_in_latest(nodes, _snapshots(spark, d))


@query(f"WITH {_N} SELECT count(*) AS node_count FROM n WHERE feature_id = '3'")
def feature_total(spark: SparkSession, d: str) -> DataFrame:
    return serve.feature_count(_code_nodes(spark, d), "3")


@query(f"WITH {_N} SELECT id, name FROM n WHERE id = '17'")
def node_by_id(spark: SparkSession, d: str) -> DataFrame:
    return serve.by_id(_code_nodes(spark, d), "17").select("id", "name")


@query(f"WITH {_N} SELECT id, file_path, name, node_type, line_start, line_end, CASE WHEN p_partkey % 3 = 0 THEN 'r' || line_start ELSE 'No references found' END AS reason, CASE WHEN p_partkey % 3 = 0 THEN 0.7 ELSE 0.5 END::DOUBLE AS confidence, CAST(NULL AS VARCHAR) AS llm_explanation, CASE WHEN p_partkey % 3 = 0 THEN 'f' END AS suggested_feature FROM n WHERE is_dead_code")
def dead_listing(spark: SparkSession, d: str) -> DataFrame:
    return serve.dead_list(_code_nodes(spark, d))


@query(f"WITH {_N}, {_CE}, f AS (SELECT n.*, p_type, p_name FROM n JOIN part USING (p_partkey) WHERE feature_id = '3'), c AS (SELECT source_node_id AS id, string_agg(DISTINCT target_node_id, ',' ORDER BY target_node_id) AS calls_next FROM e WHERE source_node_id IN (SELECT id FROM f) AND target_node_id IN (SELECT id FROM f) GROUP BY 1) SELECT id, name, coalesce(flow_order, 0) AS \"order\", CASE WHEN p_partkey % 2 = 0 THEN 'step ' || p_name WHEN p_partkey % 5 <> 0 THEN p_type ELSE '' END AS description, coalesce(calls_next, '') AS calls_next FROM f LEFT JOIN c USING (id)")
def flow_view(spark: SparkSession, d: str) -> DataFrame:
    return serve.flow(_code_nodes(spark, d), _code_edges(spark, d), "3").withColumn("calls_next", F.array_join("calls_next", ","))


@query(f"WITH {_N} SELECT id FROM n WHERE feature_id IS NULL OR feature_id IN ('1', '2')")
def visible_nodes(spark: SparkSession, d: str) -> DataFrame:
    return serve.visible(_code_nodes(spark, d), ["1", "2"]).select("id")


_VIEW = f"""WITH s0 AS (SELECT CAST(o_orderkey AS VARCHAR) AS snapshot_id FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' ORDER BY o_orderdate DESC, snapshot_id DESC LIMIT 1),
here AS (SELECT *, CAST(l_suppkey % 25 AS VARCHAR) AS feature_id FROM lineitem WHERE CAST(l_orderkey AS VARCHAR) IN (FROM s0)),
own AS (SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name FROM nation WHERE n_nationkey % 2 = 0)
SELECT 'node' AS kind, l_linenumber || '' AS id, n_name AS detail FROM here LEFT JOIN own ON own.id = feature_id
UNION ALL SELECT 'edge', CAST(l_linenumber AS VARCHAR), CASE WHEN l_linenumber % 3 <> 1 THEN 'true' ELSE 'false' END FROM here
UNION ALL SELECT 'feature', own.id, CAST((SELECT count(*) FROM here WHERE feature_id = own.id) AS VARCHAR) FROM own"""


@query(_VIEW)
def graph_assembly(spark: SparkSession, d: str) -> DataFrame:
    """Nodes, edges and features of the newest completed snapshot of one repository."""
    lines = table(spark, d, "lineitem").withColumn("snapshot_id", _text("l_orderkey"))
    nodes = lines.select("snapshot_id", _text("l_linenumber").alias("id"), F.lit("function").alias("node_type"), (F.col("l_suppkey") % 25).cast("string").alias("feature_id"))
    edges = lines.select("snapshot_id", _text("l_linenumber").alias("id"), _pick(F.col("l_linenumber"), "calls", "imports", "instantiates").alias("edge_type"))
    named = table(spark, d, "nation").select(_text("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit("#000000").alias("color"), F.when(F.col("n_nationkey") % 2 == 0, "1-URGENT").otherwise("x").alias("repo_id"))
    view = serve.graph_view("1-URGENT", _snapshots(spark, d, "o_orderpriority"), nodes, edges, named)
    out = view["nodes"].select(F.lit("node").alias("kind"), "id", F.col("feature_name").alias("detail"))
    out = out.union(view["edges"].select(F.lit("edge"), "id", F.col("animated").cast("string")))
    return out.union(view["features"].select(F.lit("feature"), "id", _text("node_count")))


@query(f"WITH {_S}, l AS (SELECT CAST(c_custkey AS VARCHAR) AS repo_id FROM customer WHERE c_mktsegment = 'BUILDING'), t AS (SELECT repo_id, status AS stored FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY analyzed_at DESC, id DESC) AS k FROM s) WHERE k = 1) SELECT coalesce(l.repo_id, t.repo_id) AS repo_id, CASE WHEN l.repo_id IS NOT NULL THEN 'running' ELSE stored END AS status, CASE WHEN l.repo_id IS NOT NULL THEN 50.0 WHEN stored = 'completed' THEN 100.0 ELSE 0.0 END::DOUBLE AS progress FROM l FULL JOIN t USING (repo_id)")
def status_read(spark: SparkSession, d: str) -> DataFrame:
    live = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(_text("c_custkey").alias("repo_id"), F.lit("running").alias("status"), F.lit(50.0).alias("progress"))
    return progress.status(live, _snapshots(spark, d))


# ---- resolution ----


@query("WITH n AS (SELECT p_partkey AS k, 'f' || p_partkey % 50 || '.py::' || p_partkey AS fqn, 'm' || p_partkey % 50 AS m FROM part), f AS (SELECT m, arg_min(fqn, k) AS first FROM n GROUP BY m) SELECT k, CASE k % 4 WHEN 2 THEN first WHEN 3 THEN 'x' || k ELSE fqn END AS source_fqn FROM n JOIN f USING (m)")
def source_normalise(spark: SparkSession, d: str) -> DataFrame:
    """Sources that are a node's key, its qualified name, its module, or nothing known."""
    key = F.col("p_partkey")
    module = F.concat(F.lit("m"), (key % 50).cast("string"))
    nodes = table(spark, d, "part").select(key.alias("seq"), fn.fqn(F.concat(F.lit("f"), (key % 50).cast("string"), F.lit(".py")), key.cast("string")).alias("fqn"), F.concat(module, F.lit(":n"), key.cast("string")).alias("qualified_name"))
    source = F.when(F.col("seq") % 4 == 0, F.col("fqn")).when(F.col("seq") % 4 == 1, F.col("qualified_name")).when(F.col("seq") % 4 == 2, F.substring_index("qualified_name", ":", 1)).otherwise(F.concat(F.lit("x"), _text("seq")))
    return resolve.resolve_sources(nodes.select(F.col("seq").alias("k"), source.alias("source")), nodes).select("k", "source_fqn")


@query(f"WITH p AS (SELECT page_id, ltrim({_PATH}, '/') AS path FROM pages), n AS (SELECT page_id, path || '.py' AS file_path, path, path || '.py::' || page_id AS fqn FROM p WHERE page_id % 2 = 0 AND path <> ''), m AS (SELECT DISTINCT replace(path, '/', '.') AS module FROM p WHERE page_id % 2 = 1 AND path <> '' UNION SELECT replace(path, '/', '.') FROM n WHERE page_id % 10 = 0), c AS (SELECT module, file_path, row_number() OVER (PARTITION BY module ORDER BY min(page_id)) AS k FROM m JOIN n ON path = replace(module, '.', '/') OR ends_with(path, '/' || replace(module, '.', '/')) GROUP BY module, file_path) SELECT module, fqn FROM c JOIN n USING (file_path) WHERE k = 1")
def module_expansion(spark: SparkSession, d: str) -> DataFrame:
    """Targets that are modules lead to all nodes of the first file of that name; targets that are nodes don't."""
    rows = _page_paths(spark, d).select("page_id", F.regexp_replace("path", "^/+", "").alias("path")).where("path <> ''")
    file = F.concat("path", F.lit(".py"))
    nodes = rows.where("page_id % 2 = 0").select(F.col("page_id").alias("seq"), file.alias("file_path"), fn.fqn(file, _text("page_id")).alias("fqn"))
    modules = rows.where("page_id % 2 = 1 or page_id % 10 = 0").select(F.lit("x").alias("src"), F.replace("path", F.lit("/"), F.lit(".")).alias("dst"))
    return resolve.expand_modules(modules.union(nodes.select(F.lit("x"), "fqn")), nodes)


@query("WITH n AS (SELECT p_partkey AS seq, 'f' || p_partkey % 50 || '.py::' || p_partkey AS fqn, 'm' || p_partkey % 50 || ':n' || p_partkey % 97 AS q, 'n' || p_partkey % 97 AS name FROM part), e AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'f' || c_custkey % 50 || '.py::' || c_custkey WHEN 1 THEN 'z:n' || c_custkey % 120 ELSE 'm' || c_custkey % 50 || ':n' || c_custkey % 97 END AS node_name FROM customer), x AS (SELECT node_name, min(fqn) AS a FROM (SELECT fqn AS node_name, fqn FROM n UNION ALL SELECT q, fqn FROM n) GROUP BY 1), y AS (SELECT name, arg_min(fqn, seq) AS b FROM n GROUP BY 1) SELECT c_custkey, coalesce(a, b) AS fqn FROM e LEFT JOIN x USING (node_name) LEFT JOIN y ON name = split_part(node_name, ':', -1)")
def entry_resolution(spark: SparkSession, d: str) -> DataFrame:
    key, custom = F.col("p_partkey"), F.col("c_custkey")
    nodes = table(spark, d, "part").select(key.alias("seq"), F.concat(F.lit("f"), (key % 50).cast("string"), F.lit(".py::"), key.cast("string")).alias("fqn"), F.concat(F.lit("m"), (key % 50).cast("string"), F.lit(":n"), (key % 97).cast("string")).alias("qualified_name"), F.concat(F.lit("n"), (key % 97).cast("string")).alias("name"))
    name = F.when(custom % 3 == 0, F.concat(F.lit("f"), (custom % 50).cast("string"), F.lit(".py::"), custom.cast("string"))).when(custom % 3 == 1, F.concat(F.lit("z:n"), (custom % 120).cast("string"))).otherwise(F.concat(F.lit("m"), (custom % 50).cast("string"), F.lit(":n"), (custom % 97).cast("string")))
    return resolve.resolve_entry_points(table(spark, d, "customer").select("c_custkey", name.alias("node_name")), nodes).select("c_custkey", "fqn")


_REPO = """WITH k AS (SELECT p_partkey AS k FROM part), m AS (SELECT k, 'pkg.m' || k AS m FROM k),
later AS (SELECT a.k, a.m, b.k AS j, b.m AS n, b.k - a.k AS step FROM m a JOIN m b ON b.k IN (a.k + 1, a.k + 2)),
used AS (SELECT DISTINCT j AS k, n AS m FROM later)
SELECT m || ':f' || k AS src, n AS dst, 'imports' AS edge_type FROM later UNION ALL SELECT m || ':f' || k, n || ':f' || j, 'imports' FROM later WHERE step = 2 UNION ALL SELECT m || ':f' || k, n || ':f' || j, 'calls' FROM later WHERE step = 2
UNION ALL SELECT m || ':C' || k || '.g', m || ':C' || k || '.h', 'calls' FROM m UNION ALL SELECT m || ':C' || k, m || ':C' || k || '.' || unnest(['g', 'h']), 'contains' FROM m
UNION ALL SELECT m, m || ':' || unnest(['f' || k, 'C' || k, 'C' || k || '.g', 'C' || k || '.h']), 'contains' FROM used"""


@query(_REPO)
def call_graph(spark: SparkSession, d: str) -> DataFrame:
    """A module per part: it imports the next one, a function of the one after by a relative path, and calls it."""
    k = F.col("p_partkey")
    name, one, two = k.cast("string"), (k + 1).cast("string"), (k + 2).cast("string")
    code = F.concat(
        F.lit("import os\nimport pkg.m"), one, F.lit("\nfrom .m"), two, F.lit(" import f"), two, F.lit("\n\ndef f"), name, F.lit("():\n    return f"), two,
        F.lit("()\n\nclass C"), name, F.lit(":\n    def g(self):\n        return self.h()\n\n    def h(self):\n        pass\n"),
    )
    parsed = parsing.parse(table(spark, d, "part").select(F.concat(F.lit("pkg/m"), name, F.lit(".py")).alias("path"), code.alias("content")))
    _, edges, contained, _ = analysis.call_graph(written(parsed, "parsed"))
    return edges.where("dst is not null").select("src", "dst", "edge_type").union(contained.select("src", "dst", "edge_type"))


# ---- graph ----


@query(f"WITH {_E} SELECT DISTINCT 'caller' AS role, src AS node FROM ring WHERE dst = 's:1' UNION ALL SELECT DISTINCT 'callee', dst FROM ring WHERE src = 'c:1'")
def callers_and_callees(spark: SparkSession, d: str) -> DataFrame:
    edges = _edges(spark, d, ring=True)
    return graph.callers_of(edges, "s:1").select(F.lit("caller").alias("role"), "node").union(graph.callees_of(edges, "c:1").select(F.lit("callee"), "node"))


@query(f"WITH {_E}, f AS (SELECT DISTINCT src, dst FROM ring WHERE src IN (SELECT node FROM nodes)) SELECT 'forward' AS way, src, dst FROM f UNION ALL SELECT 'reverse', dst, src FROM f WHERE dst IN (SELECT node FROM nodes)")
def adjacency(spark: SparkSession, d: str) -> DataFrame:
    forward, back = graph.adjacency(_edges(spark, d, ring=True), _nodes(spark, d))
    return forward.select(F.lit("forward").alias("way"), "src", "dst").union(back.select(F.lit("reverse"), "src", "dst"))


@query("WITH v AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'dead_code' WHEN 1 THEN 'constant' WHEN 2 THEN 'decorator' END AS verdict, l.p IS NOT NULL AS used FROM part LEFT JOIN (SELECT DISTINCT l_partkey AS p FROM lineitem WHERE l_quantity < 5) l ON p = p_partkey WHERE p_partkey % 5 <> 4) SELECT 'p:' || p_partkey AS node, CASE WHEN used THEN 'unreachable' ELSE 'no_references' END AS reason, round(CASE verdict WHEN 'dead_code' THEN least(base + 0.05, 1) WHEN 'constant' THEN greatest(base - 0.3, 0.1) WHEN 'decorator' THEN greatest(base - 0.4, 0.05) ELSE base END, 6)::DOUBLE AS confidence FROM (SELECT *, CASE WHEN used THEN 0.8 ELSE 0.95 END AS base FROM v) WHERE round(CASE verdict WHEN 'dead_code' THEN least(base + 0.05, 1) WHEN 'constant' THEN greatest(base - 0.3, 0.1) WHEN 'decorator' THEN greatest(base - 0.4, 0.05) ELSE base END, 6) >= 0.5")
def dead_detection(spark: SparkSession, d: str) -> DataFrame:
    """Candidates among parts that aren't modules, with verdicts, from the threshold on."""
    nodes = table(spark, d, "part").select(F.concat(F.lit("p:"), _text("p_partkey")).alias("node"), F.when(F.col("p_partkey") % 5 == 4, "module").otherwise("function").alias("node_type"))
    kind = F.when(F.col("l_quantity") < 5, "p:").otherwise("x:")  # most items call code of others
    edges = table(spark, d, "lineitem").select(F.concat(F.lit("o:"), _text("l_orderkey")).alias("src"), F.concat(kind, _text("l_partkey")).alias("dst"), F.lit("calls").alias("edge_type"))
    verdict = F.when(F.col("p_partkey") % 4 == 0, "dead_code").when(F.col("p_partkey") % 4 == 1, "constant").when(F.col("p_partkey") % 4 == 2, "decorator")
    verdicts = table(spark, d, "part").select(F.concat(F.lit("p:"), _text("p_partkey")).alias("node"), verdict.alias("verdict"))
    none = nodes.select("node").limit(0)
    return dead_code.detect(nodes, edges, none, none, verdicts).select("node", "reason", F.round("confidence", 6).alias("confidence"))


@query("SELECT p_partkey FROM part f WHERE p_type <> (SELECT min(p_type) FROM part) AND NOT EXISTS (SELECT 1 FROM part s WHERE s.p_size < 15 AND s.p_brand = f.p_brand AND s.p_name = f.p_name)")
def agent_dead_code(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    least = part.agg(F.min("p_type").alias("least"))
    special = F.when(F.col("p_type") == F.col("least"), "__init__").otherwise(F.col("p_name"))
    functions = part.join(F.broadcast(least)).select("p_partkey", F.col("p_brand").alias("file"), special.alias("name"))
    steps = part.where("p_size < 15").select(F.col("p_brand").alias("file"), F.col("p_name").alias("function"))
    return dead_code.agent_candidates(functions, steps).select("p_partkey")


# ---- changes ----

_KINDS = ("A", "D", "R100", "C75", "T", "M", "U")


@query("SELECT p_partkey, (['added', 'deleted', 'renamed', 'copied', 'type_changed', 'modified', 'modified'])[p_partkey % 7 + 1] AS change_type, (['added', 'deleted', 'renamed', 'modified', 'modified', 'modified', 'modified'])[p_partkey % 7 + 1] AS category FROM part")
def change_letters(spark: SparkSession, d: str) -> DataFrame:
    kind = diff.git_change(_pick(F.col("p_partkey"), *_KINDS))
    return table(spark, d, "part").select("p_partkey", kind.alias("change_type"), diff.category(kind).alias("category"))


@query(f"SELECT count(*) FILTER (change_type = 'added') AS added, count(*) FILTER (change_type = 'deleted') AS deleted, count(*) FILTER (change_type = 'modified') AS modified, count(*) FILTER (change_type = 'renamed') AS renamed, count(*) AS total, count(*) > 0 AS has_changes FROM ({SQL['manifest_diff']})")
def diff_counts(spark: SparkSession, d: str) -> DataFrame:
    return diff.counts(manifest_diff(spark, d))


@query(f"WITH c AS ({SQL['manifest_diff']}) SELECT path FROM c UNION SELECT old_path FROM c WHERE old_path IS NOT NULL")
def changed_paths(spark: SparkSession, d: str) -> DataFrame:
    return diff.changed_paths(manifest_diff(spark, d))


@query("SELECT doc_id AS path FROM documents n WHERE doc_id % 7 <> 0 AND NOT (doc_id % 5 <> 0 AND doc_id % 11 <> 0)")
def needs_analysis(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    old = docs.where("path % 5 <> 0").select("path", F.md5("text").alias("content_hash"))
    new = docs.where("path % 7 <> 0").select("path", F.md5(F.when(F.col("path") % 11 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))).alias("content_hash"))
    return diff.needs_analysis(new, old).select("path")


# ---- features ----


@query("WITH f AS (SELECT p_partkey AS idx, p_type AS name, CASE p_partkey % 3 WHEN 0 THEN p_brand WHEN 1 THEN '' END AS qualifier, count(*) OVER (PARTITION BY p_type) AS n, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS k FROM part) SELECT idx, CASE WHEN n = 1 THEN name WHEN qualifier <> '' THEN name || ' (' || qualifier || ')' ELSE name || ' ' || k END AS unique_name FROM f")
def unique_names(spark: SparkSession, d: str) -> DataFrame:
    qualifier = F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).when(F.col("p_partkey") % 3 == 1, F.lit(""))
    return features.qualify_names(table(spark, d, "part").select(F.col("p_partkey").alias("idx"), F.col("p_type").alias("name"), qualifier.alias("qualifier"))).select("idx", "unique_name")


@query("WITH e AS (SELECT c_custkey, c_custkey % 4 AS kind, CASE WHEN c_custkey % 4 < 2 THEN '/api/' || lower(c_mktsegment) WHEN c_custkey % 4 = 2 THEN c_mktsegment ELSE 'src/n' || c_nationkey END AS cluster_key FROM customer), g AS (SELECT kind, cluster_key, min(c_custkey) AS first FROM e GROUP BY kind, cluster_key), c AS (SELECT kind, cluster_key, row_number() OVER (ORDER BY kind, first) - 1 AS cluster_idx FROM g) SELECT c_custkey, cluster_key, CAST(cluster_idx AS INT) AS cluster_idx FROM e JOIN c USING (kind, cluster_key)")
def entry_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Customers as routes, sockets, commands and other entry points."""
    kind = _pick(F.col("c_custkey"), "http_route", "websocket", "cli", "main")
    info = F.create_map(F.lit("url"), F.concat(F.lit("/api/"), F.lower("c_mktsegment"), F.lit("/{id}/")), F.lit("command"), F.concat("c_mktsegment", F.lit(" run")))
    name = F.concat(F.lit("src/n"), _text("c_nationkey"), F.lit("/a.py::c"), _text("c_custkey"))
    points = table(spark, d, "customer").select("c_custkey", name.alias("node_name"), kind.alias("entry_type"), info.alias("route_info"), F.col("c_custkey").alias("ep_seq"))
    return features.cluster_entry_points(points).select("c_custkey", "cluster_key", "cluster_idx")


@query("SELECT CAST(n_nationkey AS BIGINT) AS feature FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000) OR n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9800)")
def nonempty_features(spark: SparkSession, d: str) -> DataFrame:
    members = table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").cast("long").alias("feature"))
    points = table(spark, d, "customer").where("c_acctbal > 9800").select(F.col("c_nationkey").cast("long").alias("feature"))
    return features.drop_empty(table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("feature")), members, points)


@query("SELECT max(p_partkey) AS feature_idx FROM part WHERE p_type = (SELECT min(p_type) FROM part)")
def feature_by_name(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select(F.col("p_partkey").alias("feature_idx"), F.col("p_type").alias("name"))
    return features.by_name(part, table(spark, d, "part").agg(F.min("p_type")).scalar()).select("feature_idx")


@query("SELECT c_custkey, part, (CASE n % 3 WHEN 0 THEN ['A', 'B', 'C'] ELSE ['X'] END)[part + 1] AS name FROM (SELECT c_custkey, c_nationkey AS n, CAST(least((row_number() OVER w - 1) // greatest(1, count(*) OVER (PARTITION BY c_nationkey) // CASE c_nationkey % 3 WHEN 0 THEN 3 ELSE 1 END), CASE c_nationkey % 3 WHEN 0 THEN 2 ELSE 0 END) AS INT) AS part FROM customer WHERE c_nationkey % 3 <> 2 WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey))")
def feature_splits(spark: SparkSession, d: str) -> DataFrame:
    """Entry points of features that a reviewer wants to split into three, one or no parts."""
    points = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("feature"), F.col("c_custkey").alias("ep_seq"))
    names = F.when(F.col("n_nationkey") % 3 == 0, F.array(F.lit("A"), F.lit("B"), F.lit("C"))).when(F.col("n_nationkey") % 3 == 1, F.array(F.lit("X"))).otherwise(F.array().cast("array<string>"))
    return features.split_features(points, table(spark, d, "nation").select(F.col("n_nationkey").alias("feature"), names.alias("names"))).select("c_custkey", "part", "name")


@query("WITH p AS (SELECT c_nationkey AS f, c_custkey AS s, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer WHERE c_custkey % 4 <> 0), r AS (SELECT DISTINCT o_custkey AS s, o_orderpriority AS node FROM orders), t AS (SELECT f, node, count(*) AS n FROM p JOIN r USING (s) WHERE k <= 2 GROUP BY ALL), q AS (SELECT f, avg(CASE n WHEN 2 THEN 1.0 ELSE 0.0 END) AS share FROM t GROUP BY f) SELECT CASE WHEN n_nationkey % 5 = 0 THEN 'review' ELSE 'split' END AS type, n_nationkey AS feature FROM nation WHERE n_nationkey % 5 = 0 OR n_nationkey IN (SELECT f FROM q WHERE share < 0.5 AND f IN (SELECT f FROM p GROUP BY f HAVING count(*) >= 2))")
def split_validity(spark: SparkSession, d: str) -> DataFrame:
    """Reviews, and splits of nations whose first two customers share less than half of their order priorities."""
    changes = table(spark, d, "nation").select(F.when(F.col("n_nationkey") % 5 == 0, "review").otherwise("split").alias("type"), F.col("n_nationkey").alias("feature"))
    points = table(spark, d, "customer").select(F.col("c_nationkey").alias("feature"), F.col("c_custkey").alias("ep_seq"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_custkey")).alias("start"))
    return features.valid_splits(changes, points, table(spark, d, "orders").select(F.col("o_custkey").alias("start"), F.col("o_orderpriority").alias("node")))


@query("SELECT n_name AS name, 'core' AS category FROM nation WHERE n_nationkey % 3 = 2")
def product_features(spark: SparkSession, d: str) -> DataFrame:
    return enrich.product_features(table(spark, d, "nation").select(F.col("n_name").alias("name"), _pick(F.col("n_nationkey"), "Infrastructure", "utility", "core").alias("category")))


@query("SELECT CAST(p_partkey AS VARCHAR) AS source, p_name AS target, 'calls' AS edge_type, 'm' AS mechanism, 0.9::DOUBLE AS confidence FROM part WHERE p_partkey % 4 = 0")
def inferred_calls(spark: SparkSession, d: str) -> DataFrame:
    """Answers in a fence, no objects, garbage, and one without confidence."""
    fenced = F.concat(F.lit('```json\n{"calls": [{"target": "'), "p_name", F.lit('", "mechanism": "m", "confidence": 0.9}, {"target": "x", "confidence": 0.2}]}\n```'))
    text = F.when(F.col("p_partkey") % 4 == 0, fenced).when(F.col("p_partkey") % 4 == 1, "[1]").when(F.col("p_partkey") % 4 == 2, "no json {").otherwise('{"calls": [{"target": "t"}]}')
    return enrich.inferred_edges(table(spark, d, "part").select(_text("p_partkey").alias("id"), fn.json_object(text).alias("answer")))


@query("WITH s AS (SELECT conv_id AS f, turn AS p, 'f' || conv_id || '.py::t' || turn AS node, lead('f' || conv_id || '.py::t' || turn) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt, role, 'f' || conv_id || '.py::t' || (turn + 2) AS called FROM conversations), c AS (SELECT f, p, node AS source, called AS target FROM s WHERE role = 'user' AND called IN (SELECT node FROM s)) SELECT source, target FROM c UNION ALL SELECT node, nxt FROM s WHERE nxt IS NOT NULL AND (f, p) NOT IN (SELECT (f, p) FROM c)")
def agent_step_edges(spark: SparkSession, d: str) -> DataFrame:
    """Users' turns call the turn after the next one, if it is there; all others, and users whose call leads nowhere, the next."""
    file = F.concat(F.lit("f"), _text("conv_id"), F.lit(".py"))
    called = F.when(F.col("role") == "user", F.array(F.concat(file, F.lit(":t"), (F.col("turn") + 2).cast("string"))))
    steps = table(spark, d, "conversations").select(F.col("conv_id").alias("feature_idx"), F.col("turn").alias("list_pos"), F.concat(file, F.lit("::t"), _text("turn")).alias("node"), called.alias("calls_next"))
    return agent.step_edges(steps)


# ---- scalars ----


@query("SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS title, CASE WHEN p_partkey % 2 = 0 THEN split_part(p_name, ' ', 1) ELSE 'none' END AS command, replace(lower(p_type), ' ', '_') AS owner, array_to_string(list_distinct_in_order, ' ') AS tokens, round(least(p_size * 2.5, 100.0), 1)::DOUBLE AS progress, 'says ' || p_name AS answer FROM (SELECT *, list_filter(string_split(lower(p_name), ' '), lambda w, i: list_position(string_split(lower(p_name), ' '), w) = i) AS list_distinct_in_order FROM part)")
def name_scalars(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    raw = F.replace("p_name", F.lit(" "), F.lit("_-"))
    return part.select(
        "p_partkey", fn.title(raw).alias("title"), fn.cli_group(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" "), "p_name")), F.lit("none")).alias("command"), fn.owner_key(F.col("p_type")).alias("owner"),
        F.array_join(fn.path_tokens(F.concat(F.upper("p_name"), F.lit("/."))), " ").alias("tokens"), fn.progress(F.col("p_size") * 2.5).alias("progress"), fn.answer_line(F.concat(F.lit(' "says '), "p_name", F.lit('"\nmore'))).alias("answer"),
    )


@query("SELECT p_partkey, 'a' || chr(10) || '  b' || chr(10) || chr(10) || 'c' AS code FROM part")
def dedented(spark: SparkSession, d: str) -> DataFrame:
    margin = F.repeat(F.lit(" "), (F.col("p_partkey") % 9).cast("int"))
    return table(spark, d, "part").select("p_partkey", fn.dedent(F.concat(margin, F.lit("a\n"), margin, F.lit("  b\n \n"), margin, F.lit("c"))).alias("code"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S+00:00') AS at FROM orders")
def iso_times(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", fn.iso_time(F.col("o_orderdate").cast("timestamp")).alias("at"))


_KNOWN = ", ".join(f"('{e}', '{name}')" for e, name in fn.LANGUAGES.items())


_ENDINGS = tuple(fn.LANGUAGES)


@query(f"WITH v(extension, language) AS (VALUES {_KNOWN}), p AS (SELECT ([{', '.join(repr(e) for e in _ENDINGS)}, '.none'])[page_id % {len(_ENDINGS) + 1} + 1] AS extension FROM pages) SELECT language, count(*) AS files, count(DISTINCT extension) AS extensions, coalesce(language = 'python', false) AS parsed FROM p LEFT JOIN v USING (extension) GROUP BY language")
def supported_languages(spark: SparkSession, d: str) -> DataFrame:
    """Pages as files of every known ending and one that is none: files and endings by language, and whether it is parsed."""
    files = table(spark, d, "pages").select(_pick(F.col("page_id"), *_ENDINGS, ".none").alias("extension"))
    known = files.join(F.broadcast(parsing.supported(spark)), "extension", "left")
    return known.groupBy("language").agg(F.count("*").alias("files"), F.countDistinct("extension").alias("extensions"), F.coalesce(F.bool_or("parsed"), F.lit(False)).alias("parsed"))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' WHEN 2 THEN 'unknown' ELSE 'csharp' END AS language FROM pages")
def agent_languages(spark: SparkSession, d: str) -> DataFrame:
    """Kotlin is in the longer map only."""
    path = F.concat(F.lit("a/b"), _text("page_id"), _pick(F.col("page_id"), ".PY", ".tsx", ".kt", ".cs"))
    return table(spark, d, "pages").select("page_id", fn.language(path, "unknown", fn.AGENT_LANGUAGES).alias("language"))


@query("SELECT 'pkg/p' || p_partkey || '.py' AS path, p_partkey % 10 = 0 AS has_errors, CAST(CASE WHEN p_partkey % 10 = 0 THEN 0 ELSE 2 END AS INT) AS node_count, CAST(CASE WHEN p_partkey % 10 = 0 THEN 0 ELSE 3 END AS INT) AS edge_count FROM part")
def parse_counts(spark: SparkSession, d: str) -> DataFrame:
    """Every tenth file doesn't parse; a call through a call has no name, one in a default argument is the function's."""
    return parsing.counts(parsing.parse(_files(spark, d)))


def _files(spark: SparkSession, d: str) -> DataFrame:
    code = F.when(F.col("p_partkey") % 10 == 0, "def (").otherwise("class A(B):\n    x = 1\n\ndef main(a=C()):\n    A().run()\n")
    return table(spark, d, "part").select(F.concat(F.lit("pkg/p"), _text("p_partkey"), F.lit(".py")).alias("path"), code.alias("content"))


@query("""SELECT 'pkg/p' || p_partkey || '.py' AS path, n.name, n.node_type, n.line AS line_start FROM part, (VALUES ('A', 'class', 1), ('main', 'function', 4)) n(name, node_type, line) WHERE p_partkey % 10 <> 0""")
def parse_lateral(spark: SparkSession, d: str) -> DataFrame:
    """The parser as a table function of SQL, joined laterally to the files and to its own nodes."""
    parsing.register_sql(spark)
    files = _files(spark, d)
    files = files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")  # as parse does
    sql = """SELECT f.path, n.name, n.node_type, n.line_start FROM {files} f, LATERAL parse_source(f.path, 'python', f.content) p
    LATERAL VIEW explode(p.nodes) AS n"""
    return spark.sql(sql, files=files)


# ---- components, layers and layout ----

_NEXT = """l AS (SELECT l_orderkey AS o, l_linenumber AS n, l_suppkey AS s, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) AS t FROM lineitem),
e AS (SELECT s AS src, t AS dst FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY o DESC, n DESC, t DESC) AS k FROM l WHERE t IS NOT NULL) WHERE k = 1)"""


@query(f"""WITH RECURSIVE {_NEXT}, r AS (SELECT s_suppkey AS a, s_suppkey AS b FROM supplier UNION SELECT a, dst FROM r JOIN e ON src = b)
SELECT 's' || x.a AS node, min('s' || x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a""")
def strong_components(spark: SparkSession, d: str) -> DataFrame:
    """Every supplier leads to the one after it in the last order where one follows; all line items are read, line numbers may repeat."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey")
    pairs = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.lead("l_suppkey").over(order).alias("t")).where("t is not null")
    last = pairs.groupBy("l_suppkey").agg(F.max(F.struct("l_orderkey", "l_linenumber", "t"))["t"].alias("t"))
    edges = last.select(F.concat(F.lit("s"), _text("l_suppkey")).alias("src"), F.concat(F.lit("s"), _text("t")).alias("dst"))
    return layers.strong_components(table(spark, d, "supplier").select(F.concat(F.lit("s"), _text("s_suppkey")).alias("node")), edges)


_LAYERED = f"""WITH RECURSIVE {_E}, n AS (SELECT 'c:' || c_custkey AS node FROM customer UNION SELECT 'o:' || o_orderkey FROM orders UNION SELECT 'p:' || p_partkey FROM part UNION SELECT 's:' || s_suppkey FROM supplier UNION SELECT src FROM e0 UNION SELECT dst FROM e0),
d AS (SELECT DISTINCT src, dst FROM e0 WHERE src <> dst),
w AS (SELECT node, 0 AS k FROM n UNION SELECT dst, k + 1 FROM w JOIN d ON src = node),
l AS (SELECT node, max(k) AS layer FROM w GROUP BY node),
p0 AS (SELECT node, layer, row_number() OVER (PARTITION BY layer ORDER BY node) - 1 AS place FROM l),
m AS (SELECT dst AS node, sum(a.place)::DOUBLE / count(*) AS mean FROM d JOIN p0 a ON a.node = src JOIN p0 b ON b.node = dst WHERE a.layer <> b.layer GROUP BY dst),
p1 AS (SELECT node, layer, row_number() OVER (PARTITION BY layer ORDER BY coalesce(mean, place), node) - 1 AS place FROM p0 LEFT JOIN m USING (node))
SELECT node, CAST(layer AS BIGINT) AS layer, place * 250 AS x, CAST(layer AS BIGINT) * 140 AS y FROM p1"""


@query(_LAYERED)
def layered_layout(spark: SparkSession, d: str) -> DataFrame:
    """Customers, orders, parts and suppliers in layers by their longest path, one barycentre sweep."""
    return layers.layout(_nodes(spark, d), _edges(spark, d)).select("node", "layer", "x", "y")
