"""Queries with SQL on features as a client sees them, on names of clusters, on what the parser says, and on repositories.

Nations stand for features, customers for entry points, source files and repositories, orders for snapshots.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text as fn
from graphloom.operators import enrich, features, resolve, serve
from graphloom.plans import cross_check
from graphloom.plans.catalog import query
from graphloom.plans.catalog_views import _N, _code_nodes, _pick, _text
from graphloom.session import table
from graphloom.sources import parse as parsing

# ---- features as a client sees them ----


def _features(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("feature"), F.col("n_name").alias("name"), "n_regionkey")


@query("""WITH a AS (SELECT c_custkey, n_name, CASE WHEN n_regionkey <> 0 THEN n_nationkey END AS feature, c_mktsegment = 'FURNITURE' AS parted FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal <= 5000)
SELECT CASE WHEN parted THEN 'split' ELSE 'review' END AS type, feature, n_name AS from_feature, unnest(CASE WHEN parted THEN [n_name || '_a', n_name || '_b'] ELSE [''] END) AS to_feature, 'c' || c_custkey AS reason FROM a""")
def proposed_changes(spark: SparkSession, d: str) -> DataFrame:
    """What customers' answers propose for their nation, of which one region's names aren't known."""
    own = table(spark, d, "customer").join(_features(spark, d), F.col("c_nationkey") == F.col("feature"))
    parts = F.when(F.col("c_mktsegment") == "FURNITURE", F.concat(F.lit('["'), "name", F.lit('_a", "'), "name", F.lit('_b"]'))).otherwise("[]")
    text = F.concat(F.lit('{"features": [{"name": "'), "name", F.lit('", "valid": '), (F.col("c_acctbal") > 5000).cast("string"), F.lit(', "reason": "c'), _text("c_custkey"), F.lit('", "suggested_split": '), parts, F.lit("}]}"))
    return cross_check.proposed(own.select(fn.json_object(text).alias("answer")), _features(spark, d).where("n_regionkey <> 0"))


@query("""WITH p AS (SELECT s_nationkey AS f, string_agg(s_name, ', ' ORDER BY s_suppkey) AS points FROM supplier GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY node) AS place FROM (SELECT DISTINCT c_nationkey AS f, c_name AS node FROM customer)), m AS (SELECT f, string_agg(node, ', ' ORDER BY node) AS nodes FROM k WHERE place <= 15 GROUP BY f),
l AS (SELECT n_nationkey AS f, n_name || ': starts at ' || coalesce(points, '') || '; holds ' || coalesce(nodes, '') AS line, (row_number() OVER (ORDER BY n_nationkey) - 1) // 10 AS id FROM nation LEFT JOIN p ON p.f = n_nationkey LEFT JOIN m ON m.f = n_nationkey)
SELECT id, string_agg(line, chr(10) ORDER BY f) AS lines FROM l GROUP BY id""")
def feature_prompts(spark: SparkSession, d: str) -> DataFrame:
    """What prompts say on nations, ten a prompt: suppliers are entry points, the first 15 customers nodes."""
    points = table(spark, d, "supplier").select(F.col("s_nationkey").alias("feature"), F.col("s_suppkey").alias("ep_seq"), F.col("s_name").alias("node_name"))
    members = table(spark, d, "customer").select(F.col("c_nationkey").alias("feature"), F.col("c_name").alias("node"))
    prompts = cross_check.batched_prompts(cross_check.described(_features(spark, d), points, members))
    return prompts.select("id", F.substring_index("prompt", "Features:\n", -1).alias("lines"))


@query("""WITH o AS (SELECT DISTINCT CASE WHEN p_retailprice > 1200 THEN p_brand WHEN p_size > 25 THEN upper(p_name) ELSE split_part(p_name, ' ', 1) END AS owner FROM part),
g AS (SELECT lower(replace(p_name, ' ', '_')) AS k, arg_min(replace(p_name, ' ', '_'), p_partkey) AS feature FROM part GROUP BY ALL)
SELECT owner, coalesce(g.feature, owner) AS feature FROM o LEFT JOIN g ON k = replace(lower(owner), ' ', '_') WHERE g.feature IS NOT NULL OR EXISTS (SELECT 1 FROM part WHERE contains('p:' || p_name, owner))""")
def owner_features(spark: SparkSession, d: str) -> DataFrame:
    """Owners by the names of features, else those that a node's name holds; brands are neither."""
    part = table(spark, d, "part")
    owner = F.when(F.col("p_retailprice") > 1200, F.col("p_brand")).when(F.col("p_size") > 25, F.upper("p_name")).otherwise(F.split_part("p_name", F.lit(" "), F.lit(1)))
    groups = part.select(F.col("p_partkey").alias("feature"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("name"))
    return cross_check.owner_features(part.select(owner.alias("owner")), groups, part.select(F.concat(F.lit("p:"), "p_name").alias("node")))


@query("""WITH i AS (SELECT p_partkey AS item, unnest(list_distinct(string_split('src/' || CASE WHEN p_size > 25 THEN p_type || '/' ELSE '' END || replace(p_name, ' ', '/'), '/'))) AS t FROM part),
g AS (SELECT p_type || '_' || split_part(p_name, ' ', 1) AS name, min(p_partkey) AS f FROM part GROUP BY ALL), w AS (SELECT f, name, unnest(list_distinct(string_split(name, '_'))) AS t FROM g), c AS (SELECT item, f, name, count(*) AS n FROM i JOIN w USING (t) GROUP BY ALL)
SELECT 'p' || item AS node, name AS feature FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY n DESC, f) AS k FROM c) WHERE k = 1""")
def place_features(spark: SparkSession, d: str) -> DataFrame:
    """Features of parts by what their path shares with a feature's name."""
    part = table(spark, d, "part")
    path = F.concat(F.lit("src/"), F.when(F.col("p_size") > 25, F.concat("p_type", F.lit("/"))).otherwise(""), F.replace("p_name", F.lit(" "), F.lit("/")), F.lit(".py"))
    groups = part.groupBy(F.concat("p_type", F.lit("_"), F.split_part("p_name", F.lit(" "), F.lit(1))).alias("name")).agg(F.min("p_partkey").alias("feature"))
    return cross_check.place_features(part.select(F.concat(F.lit("p"), _text("p_partkey")).alias("node"), path.alias("file_path")), groups)


@query("""WITH h AS (SELECT s_nationkey AS feature, l_partkey AS node, l_returnflag = 'R' AS listed FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
z AS (SELECT h.feature, count(DISTINCT CASE WHEN listed THEN node END) + (SELECT count(*) FROM customer WHERE c_nationkey = h.feature) AS size FROM h GROUP BY h.feature)
SELECT node, feature FROM (SELECT node, feature, row_number() OVER (PARTITION BY node ORDER BY size, feature) AS k FROM (SELECT DISTINCT node, feature FROM h) JOIN z USING (feature)) WHERE k = 1""")
def feature_matching(spark: SparkSession, d: str) -> DataFrame:
    """Parts by the smallest nation that reaches or lists them: returned items are listed, all others reached."""
    held = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("s_nationkey").alias("feature"), F.col("l_partkey").alias("node"), "l_returnflag")
    counts = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("feature")).agg(F.count("*").alias("entries"))
    return features.assign_exclusive(held.where("l_returnflag <> 'R'"), counts, held.where("l_returnflag = 'R'"))


# ---- names of clusters ----


@query("""WITH e AS (SELECT c_nationkey AS nk, c_custkey AS k, lower(c_mktsegment) AS seg, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS word, count(*) OVER (PARTITION BY c_nationkey) AS n,
CASE c_nationkey % 5 WHEN 1 THEN 'load_' || lower(c_mktsegment) || '_report' WHEN 4 THEN lower(c_mktsegment) || '_z' || c_custkey ELSE 'x' || c_custkey END AS fun FROM customer),
c AS (SELECT nk, any_value(n) AS n, count(DISTINCT seg) AS segs, arg_min(seg, k) AS first_seg, arg_min(word, k) AS first_word, min(k) AS k, (CASE any_value(n) WHEN 1 THEN 'Endpoint: ' ELSE 'Endpoints: ' END) || string_agg(fun, ', ' ORDER BY k) AS listed,
string_agg(DISTINCT CASE WHEN k % 2 = 0 THEN 'GET' ELSE 'POST' END, '/' ORDER BY CASE WHEN k % 2 = 0 THEN 'GET' ELSE 'POST' END) AS methods FROM e GROUP BY nk),
f AS (SELECT nk, word FROM (SELECT nk, word, row_number() OVER (PARTITION BY nk ORDER BY count(*) DESC, min(k)) AS place FROM e GROUP BY nk, word) WHERE place = 1)
SELECT nk AS cluster_idx, CASE WHEN nk % 5 = 0 THEN 'Shop N' || nk || ' List' WHEN nk % 5 = 1 THEN CASE WHEN n = 1 THEN 'Load ' || first_word || ' Report' WHEN segs > 1 THEN 'Load Report' WHEN first_seg < 'load' THEN first_word || ' Load Report' ELSE 'Load ' || first_word || ' Report' END
WHEN n = 1 AND nk % 5 = 4 THEN first_word || ' Z' || k WHEN n = 1 THEN 'X' || k WHEN nk % 5 = 2 THEN 'run_' || first_seg WHEN nk % 5 = 3 THEN 'WebSocket (WS)' ELSE word END AS name,
CASE WHEN nk % 5 = 0 THEN methods || ' /shop/n' || nk || '/list' ELSE listed END AS description FROM c JOIN f USING (nk)""")
def cluster_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of nations as clusters of their customers: from URLs, words that all or most functions share, commands, sockets."""
    nation, seg, key = F.col("c_nationkey"), F.lower("c_mktsegment"), _text("c_custkey")
    short = F.when(nation % 5 == 1, F.concat(F.lit("load_"), seg, F.lit("_report"))).when(nation % 5 == 4, F.concat(seg, F.lit("_z"), key)).otherwise(F.concat(F.lit("x"), key))
    url = F.when(nation % 5 == 0, F.concat(F.lit("/shop/n"), _text("c_nationkey"), F.lit("/list"))).when(nation % 5 == 3, "/")
    method = F.when(nation % 5 == 0, F.when(F.col("c_custkey") % 2 == 0, "get").otherwise("post"))
    info = F.create_map(F.lit("url"), url, F.lit("command"), F.when(nation % 5 == 2, F.concat(F.lit("run "), seg)), F.lit("method"), method)
    points = table(spark, d, "customer").select(nation.alias("cluster_idx"), F.concat(F.lit("m:"), short).alias("node_name"), F.when(nation % 5 == 3, "websocket").otherwise("http_route").alias("entry_type"), info.alias("route_info"), F.col("c_custkey").alias("ep_seq"))
    return features.name_clusters(points)


# ---- what the parser says ----


def _modules(spark: SparkSession, d: str) -> DataFrame:
    """A parsed module per customer: a coroutine with two routes, a hook of start-up and a main block."""
    verb = F.element_at(F.array(F.lit("get"), F.lit("post"), F.lit("route")), (F.col("c_custkey") % 3 + 1).cast("int"))
    code = F.concat(
        F.lit("@app."), verb, F.lit("('/"), F.lower("c_mktsegment"), F.lit("/{id}')\n@app.put('/again')\nasync def f"), _text("c_custkey"),
        F.lit("(x: int, *rest) -> str:\n    return Made(x)\n\n@app.on_event('startup')\ndef up():\n    pass\n\nif __name__ == '__main__':\n    up()\n"),
    )
    return parsing.parse(table(spark, d, "customer").select(F.concat(F.lit("pkg/c"), _text("c_custkey"), F.lit(".py")).alias("path"), code.alias("content")))


_M = "m AS (SELECT c_custkey AS k, 'pkg/c' || c_custkey || '.py' AS file_path, 'pkg.c' || c_custkey AS module, lower(c_mktsegment) AS seg, (['get', 'post', 'route'])[c_custkey % 3 + 1] AS verb FROM customer)"


@query(f"""WITH {_M} SELECT file_path, module || ':f' || k AS node_name, 'http_route' AS entry_type, '/' || seg || '/{{id}}' AS url, CASE verb WHEN 'route' THEN 'ANY' ELSE upper(verb) END AS method, NULL AS event, NULL AS line FROM m
UNION ALL SELECT file_path, module || ':up', 'lifecycle', NULL, NULL, 'startup', NULL FROM m UNION ALL SELECT file_path, module || ':__main__', 'main', NULL, NULL, NULL, '10' FROM m""")
def parsed_entries(spark: SparkSession, d: str) -> DataFrame:
    """Entry points of modules; of two routes of one function the first counts."""
    found = resolve.first_wins(parsing.entry_points(_modules(spark, d)), ["node_name"], ["file_path", "ep_seq"])
    info = F.col("route_info")
    return found.select("file_path", "node_name", "entry_type", info["url"].alias("url"), info["method"].alias("method"), info["event"].alias("event"), info["line_number"].alias("line"))


@query(f"""WITH {_M} SELECT module || ':f' || k AS qualified_name, true AS is_async, 'x: int, rest' AS args, 'str' AS returns, 'app.' || verb || '(''/' || seg || '/{{id}}''), app.put(''/again'')' AS decorators, 3 AS line_start, 4 AS line_end FROM m
UNION ALL SELECT module || ':up', false, '', NULL, 'app.on_event(''startup'')', 7, 8 FROM m""")
def parsed_signatures(spark: SparkSession, d: str) -> DataFrame:
    """Functions with arguments, annotations and decorators."""
    args = F.transform("args", lambda a: F.concat_ws(": ", a["name"], a["annotation"]))
    marks = F.transform("decorators", lambda m: F.concat(m["name"], F.lit("("), F.array_join(m["args"], ", "), F.lit(")")))
    return parsing.nodes(_modules(spark, d)).select("qualified_name", "is_async", F.array_join(args, ", ").alias("args"), "returns", F.array_join(marks, ", ").alias("decorators"), "line_start", "line_end")


@query(f"""WITH {_M} SELECT module || ':f' || k AS source, 'Made' AS target, 4 AS line_number, false AS conditional, true AS instantiation, false AS module_level FROM m
UNION ALL SELECT module, 'up', 11, true, false, true FROM m""")
def parsed_calls(spark: SparkSession, d: str) -> DataFrame:
    """Calls with what the parser notes on them."""
    return parsing.edges(_modules(spark, d)).select("source", "target", "line_number", "conditional", "instantiation", "module_level")


@query(f"WITH {_N} SELECT id, node_type FROM n WHERE node_type IN ('function', 'method')")
def describable(spark: SparkSession, d: str) -> DataFrame:
    return enrich.describable(_code_nodes(spark, d)).select("id", "node_type")


# ---- repositories ----


@query(r"SELECT c_custkey, lower(regexp_replace(regexp_replace(trim(u), '/+$', ''), '\.git$', '')) AS remote FROM (SELECT c_custkey, (['https://Host/', ' https://host/'])[c_custkey % 2 + 1] || c_mktsegment || (['', '.git', '.git/', '//'])[c_custkey % 4 + 1] AS u FROM customer)")
def same_remotes(spark: SparkSession, d: str) -> DataFrame:
    """Remotes in the form in which they are compared."""
    url = F.concat(_pick(F.col("c_custkey"), "https://Host/", " https://host/"), "c_mktsegment", _pick(F.col("c_custkey"), "", ".git", ".git/", "//"))
    return table(spark, d, "customer").select("c_custkey", fn.git_url(url).alias("remote"))


@query("""WITH c AS (SELECT s_nationkey AS id, CASE WHEN count(*) > 1 THEN min(s_name) END AS name, max(CASE WHEN s_acctbal > 5000 THEN s_name END) AS color FROM supplier GROUP BY ALL)
SELECT n_nationkey AS id, coalesce(c.name, n_name) AS name, coalesce(c.color, 'grey') AS color, n_regionkey AS region FROM nation LEFT JOIN c ON c.id = n_nationkey""")
def updated_features(spark: SparkSession, d: str) -> DataFrame:
    """Nations with the fields that their suppliers change."""
    known = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit("grey").alias("color"), F.col("n_regionkey").alias("region"))
    changes = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("id")).agg(F.when(F.count("*") > 1, F.min("s_name")).alias("name"), F.max(F.when(F.col("s_acctbal") > 5000, F.col("s_name"))).alias("color"))
    return serve.update_feature(known, changes)


@query("""SELECT 'repositories' AS name, count(*) AS kept FROM customer WHERE c_custkey <> 7 UNION ALL SELECT 'analysis_snapshots', count(*) FROM orders WHERE o_custkey <> 7 UNION ALL SELECT 'features', count(*) FROM orders WHERE o_custkey <> 7
UNION ALL SELECT 'code_nodes', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey = 7) UNION ALL SELECT 'code_edges', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey = 7)""")
def repository_removal(spark: SparkSession, d: str) -> DataFrame:
    """Rows of every table that stay when one repository goes."""
    orders = table(spark, d, "orders").select(_text("o_orderkey").alias("id"), _text("o_custkey").alias("repo_id"))
    items = table(spark, d, "lineitem").select(_text("l_orderkey").alias("snapshot_id"), "l_linenumber")
    tables = {"repositories": table(spark, d, "customer").select(_text("c_custkey").alias("id")), "analysis_snapshots": orders, "features": orders, "code_nodes": items, "code_edges": items}
    out = None
    for name, rows in serve.delete_repository(tables, "7").items():
        one = rows.agg(F.count("*").alias("kept")).select(F.lit(name).alias("name"), "kept")
        out = one if out is None else out.unionByName(one)
    return out
