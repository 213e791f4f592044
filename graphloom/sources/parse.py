"""Parsing of source text into nodes, edges, imports, entry points and errors, one row per file.

Analyzers are plug-ins by language; the Python one reads the standard library's syntax tree. A file that
doesn't parse gives one error and no nodes; the task goes on. A null text is an empty file; repeated files are
parsed each; an empty table gives an empty result.
"""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator
from importlib.metadata import entry_points as entry_points_of

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text as fn

NODE = "struct<name:string,node_type:string,line_start:int,line_end:int,source_code:string,docstring:string,qualified_name:string,is_async:boolean,decorators:array<struct<name:string,args:array<string>,kwargs:map<string,string>>>,args:array<struct<name:string,annotation:string>>,returns:string,bases:array<string>>"
EDGE = "struct<source:string,target:string,edge_type:string,line_number:int,conditional:boolean,instantiation:boolean,module_level:boolean>"
IMPORT = "struct<module_path:string,imported_names:array<string>,alias:string,is_relative:boolean,relative_level:int,line_number:int,lazy:boolean,star_import:boolean>"
ENTRY = "struct<node_name:string,entry_type:string,route_info:map<string,string>>"
SCHEMA = f"path string, language string, nodes array<{NODE}>, edges array<{EDGE}>, imports array<{IMPORT}>, entry_points array<{ENTRY}>, errors array<string>"

#: Analyzers by language; each takes (path, module, text) and returns a dict of the lists of SCHEMA.
ANALYZERS: dict[str, Callable[[str, str, str], dict]] = {}


def register(language: str, analyzer: Callable[[str, str, str], dict]) -> None:
    """Adds or replaces the analyzer of a language."""
    ANALYZERS[language] = analyzer


def supported(spark: SparkSession) -> DataFrame:
    """(language, extension, parsed) of every known extension, once, sorted; parsed: there is an analyzer."""
    rows = [(name, extension, name in ANALYZERS) for extension, name in fn.LANGUAGES.items()]
    return spark.createDataFrame(rows, "language string, extension string, parsed boolean").distinct().orderBy("language", "extension")


def module_of(path: str) -> str:
    """Dotted module of a path below the repository's root."""
    parts = path.removesuffix(".py").removesuffix(".pyi").split("/")
    return ".".join(parts[:-1] if parts[-1] == "__init__" else parts)


def dotted(node: ast.AST) -> str | None:
    """a.b.c for names and attributes of names, else nothing."""
    parts: list[str] = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *parts[::-1]]) if isinstance(node, ast.Name) else None


def _decorator(node: ast.expr) -> dict:
    call = node if isinstance(node, ast.Call) else None
    name = dotted(call.func if call else node) or ast.unparse(call.func if call else node)
    args = [ast.unparse(a) for a in call.args] if call else []
    kwargs = {k.arg: ast.unparse(k.value) for k in call.keywords if k.arg} if call else {}
    return {"name": name, "args": args, "kwargs": kwargs}


class _Walk(ast.NodeVisitor):
    """Collects a file's parts; a stack of scopes gives qualified names."""

    def __init__(self, path: str, module: str, text: str):
        self.path, self.module, self.lines = path, module, text.splitlines()
        self.scopes: list[tuple[str, str]] = []  # kind and name
        self.depth_of_if = 0
        self.out: dict[str, list] = {"nodes": [], "edges": [], "imports": [], "entry_points": [], "errors": []}

    def qualified(self, name: str | None = None) -> str:
        local = ""
        for i, (kind, scope) in enumerate(self.scopes):
            local += scope
            if i + 1 < len(self.scopes) or name is not None:
                local += ".<locals>." if kind == "function" else "."
        return f"{self.module}:{local}{name or ''}" if local or name else self.module

    def _node(self, node, kind: str, **more) -> dict:
        end = node.end_lineno or node.lineno
        source = "\n".join(self.lines[node.lineno - 1 : end])
        row = {"name": node.name, "node_type": kind, "line_start": node.lineno, "line_end": end, "source_code": source, "docstring": ast.get_docstring(node), "qualified_name": self.qualified(node.name), "decorators": [_decorator(d) for d in node.decorator_list], "is_async": False, "args": [], "returns": None, "bases": []} | more
        self.out["nodes"].append(row)
        return row

    def _function(self, node, is_async: bool) -> None:
        around = [k for k, _ in self.scopes]
        kind = "method" if "class" in around and "function" not in around else "function"
        a = node.args
        every = [*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else [])]
        args = [{"name": x.arg, "annotation": ast.unparse(x.annotation) if x.annotation else None} for x in every]
        row = self._node(node, kind, is_async=is_async, args=args, returns=ast.unparse(node.returns) if node.returns else None)
        for d in row["decorators"]:
            self._route(d, row["qualified_name"])
        self._inside("function", node)

    def _inside(self, kind: str, node) -> None:
        """Visits all of a definition but its decorators, which aren't calls of its own: defaults and bases too."""
        self.scopes.append((kind, node.name))
        for x in ast.iter_child_nodes(node):
            if x not in node.decorator_list:
                self.visit(x)
        self.scopes.pop()

    def visit_FunctionDef(self, node: ast.FunctionDef) -> None:
        self._function(node, False)

    def visit_AsyncFunctionDef(self, node: ast.AsyncFunctionDef) -> None:
        self._function(node, True)

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        bases = [dotted(b) or ast.unparse(b) for b in node.bases]
        row = self._node(node, "class", bases=bases)
        for base in bases:
            self._edge(row["qualified_name"], base, "inherits", node.lineno)
        self._inside("class", node)

    def _edge(self, source: str, target: str, kind: str, line: int, **flags) -> None:
        self.out["edges"].append({"source": source, "target": target, "edge_type": kind, "line_number": line, "conditional": False, "instantiation": False, "module_level": False} | flags)

    def visit_If(self, node: ast.If) -> None:
        test = ast.unparse(node.test).replace('"', "'")
        if not self.scopes and test in ("__name__ == '__main__'", "'__main__' == __name__"):
            self.out["entry_points"].append({"node_name": f"{self.module}:__main__", "entry_type": "main", "route_info": {"line_number": str(node.lineno)}})
        self.depth_of_if += 1
        self.generic_visit(node)
        self.depth_of_if -= 1

    def visit_Call(self, node: ast.Call) -> None:
        target = dotted(node.func)
        if target:
            first = target.split(".", 1)[0]
            made = first[:1].isupper() and not first.isupper()
            outside = all(kind != "function" for kind, _ in self.scopes)  # a class's body runs with its module
            self._edge(self.module if outside else self.qualified(), target, "calls", node.lineno, conditional=self.depth_of_if > 0, instantiation=made, module_level=outside)
        self.generic_visit(node)

    def _import(self, module: str, names: list[str], alias: str | None, level: int, line: int) -> None:
        self.out["imports"].append({"module_path": module, "imported_names": names, "alias": alias, "is_relative": level > 0, "relative_level": level, "line_number": line, "lazy": any(k == "function" for k, _ in self.scopes), "star_import": names == ["*"]})

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self._import(a.name, [], a.asname, 0, node.lineno)

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        alias = node.names[0].asname if len(node.names) == 1 else None
        self._import(node.module or "", [a.name for a in node.names], alias, node.level, node.lineno)

    def _route(self, decorator: dict, name: str) -> None:
        """Entry points by the last part of a decorator's name."""
        last = decorator["name"].rsplit(".", 1)[-1].lower()
        if last not in fn.ROUTES:
            return
        kind, key = fn.ROUTES[last]
        info = {key: decorator["args"][0].strip("'\"") if decorator["args"] else ""}
        if kind == "http_route":
            info["method"] = decorator["kwargs"].get("methods", "ANY") if last == "route" else last.upper()
        self.out["entry_points"].append({"node_name": name, "entry_type": kind, "route_info": info})


def analyze_python(path: str, module: str, text: str) -> dict:
    """Parts of one Python file."""
    walk = _Walk(path, module, text)
    try:
        walk.visit(ast.parse(text))
    except (SyntaxError, ValueError, RecursionError) as e:
        return {"nodes": [], "edges": [], "imports": [], "entry_points": [], "errors": [f"{type(e).__name__}: {e}"]}
    return walk.out


register("python", analyze_python)


def discover(group: str = "graphloom.analyzers") -> list[str]:
    """Registers analyzers that installed packages offer as entry points of the group, named by language; returns the names.

    One that can't be loaded raises: a language that is silently missing would look like dead code.
    """
    points = sorted(entry_points_of(group=group), key=lambda p: p.name)
    for point in points:
        register(point.name, point.load())
    return [p.name for p in points]


def _parts(path: str, language: str, content: str, analyzers: dict) -> dict:
    """A file's lists, empty ones if its language has no analyzer."""
    analyzer = analyzers.get(language)
    return analyzer(path, module_of(path), content) if analyzer else {"nodes": [], "edges": [], "imports": [], "entry_points": [], "errors": []}


def _dealt(files: DataFrame) -> DataFrame:
    """files (path, ...) in as many parts as shuffles have: a few MB of paths, one task to read, can take hours to parse."""
    return files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")


def parse(files: DataFrame) -> DataFrame:
    """SCHEMA rows for files (path, content); languages without an analyzer give empty lists. Files are dealt by path first."""
    analyzers = dict(ANALYZERS)
    rows = files.select("path", fn.language(F.col("path"), "unknown").alias("language"), F.coalesce("content", F.lit("")).alias("content"))
    rows = _dealt(rows)
    schema = rows.sparkSession.createDataFrame([], SCHEMA).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            out = []
            for path, language, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out.append({"path": path, "language": language} | _parts(path, language, content, analyzers))
            for row in out:  # Arrow takes maps as lists of pairs
                for node in row["nodes"]:
                    for d in node["decorators"]:
                        d["kwargs"] = list(d["kwargs"].items())
                for e in row["entry_points"]:
                    e["route_info"] = list(e["route_info"].items())
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return rows.mapInArrow(run, schema)


def register_sql(spark: SparkSession, name: str = "parse_source") -> None:
    """Registers parsing as a table function: SELECT ... FROM files, LATERAL parse_source(path, language, content).

    It takes the analyzers that are registered now and gives SCHEMA's columns but path and language, one row per file;
    a null language or one without an analyzer gives empty lists, a null text is an empty file, a null path an empty name.
    Spark joins no Arrow table functions laterally, so this one takes a row at a time; parse is the form for whole tables.
    """
    analyzers = dict(ANALYZERS)
    schema = spark.createDataFrame([], SCHEMA).drop("path", "language").schema

    class ParseSource:
        def eval(self, path: str | None, language: str | None, content: str | None) -> Iterator[tuple]:
            found = _parts(path or "", language or "unknown", content or "", analyzers)
            yield tuple(found[name] for name in schema.names)

    spark.udtf.register(name, F.udtf(ParseSource, returnType=schema))


def counts(parsed: DataFrame) -> DataFrame:
    """(path, has_errors, node_count, edge_count) of every file."""
    return parsed.select("path", (F.size("errors") > 0).alias("has_errors"), F.size("nodes").alias("node_count"), F.size("edges").alias("edge_count"))


def nodes(parsed: DataFrame) -> DataFrame:
    """One row per node, with its file, key and order."""
    rows = parsed.select(F.col("path").alias("file_path"), "language", F.posexplode("nodes").alias("node_seq", "n"))
    return rows.select("file_path", "language", "node_seq", "n.*", fn.fqn(F.col("file_path"), F.col("n.name")).alias("fqn"))


def edges(parsed: DataFrame) -> DataFrame:
    rows = parsed.select(F.col("path").alias("file_path"), F.posexplode("edges").alias("edge_seq", "e"))
    return rows.select("file_path", "edge_seq", "e.*")


def imports(parsed: DataFrame) -> DataFrame:
    rows = parsed.select(F.col("path").alias("file_path"), F.posexplode("imports").alias("import_seq", "i"))
    return rows.select("file_path", "import_seq", "i.*")


def entry_points(parsed: DataFrame) -> DataFrame:
    rows = parsed.select(F.col("path").alias("file_path"), F.posexplode("entry_points").alias("ep_seq", "p"))
    return rows.select("file_path", "ep_seq", "p.*")


def import_files(imported: DataFrame, files: DataFrame) -> DataFrame:
    """(file_path, import_seq, target, names): the files that an import names; external modules give no row.

    Absolute names are tried whole, then without their last parts; relative ones start at the importing
    file's folder, one folder up for each level beyond the first. An import of names from a folder itself
    (from . import x) tries each name as a file or package of it first. names are those that are left to be
    looked for in the target.
    """
    folder = F.regexp_extract("file_path", "^(.*)/[^/]*$", 1)
    parts = F.filter(F.split(folder, "/"), lambda p: p != "")
    base = F.slice(parts, 1, F.greatest(F.size(parts) - F.col("relative_level") + 1, F.lit(0)))
    own = F.filter(F.split("module_path", r"\."), lambda p: p != "")
    whole = F.when(F.col("is_relative"), F.concat(base, own)).otherwise(own)
    shortest = F.when(F.col("is_relative"), F.size(whole)).otherwise(1)
    stems = files.select(F.col("path").alias("target"), F.regexp_replace(F.regexp_replace("path", r"\.py$", ""), "/__init__$", "").alias("stem"))
    order = F.col("target").endswith("__init__.py").cast("int")
    key = ["file_path", "import_seq"]
    wanted = imported.withColumn("names", F.filter("imported_names", lambda n: n != "*"))
    inside = wanted.where(F.col("is_relative") & (F.size(own) == 0)).select(*key, base.alias("base"), F.explode("names").alias("name"))
    inside = inside.withColumn("stem", F.array_join(F.concat("base", F.array("name")), "/")).join(stems, "stem")
    inside = inside.groupBy(*key, "name").agg(F.max_by("target", order).alias("target"))
    found = inside.groupBy(*key).agg(F.collect_set("name").alias("found"))  # the names of one import
    rows = wanted.join(found, key, "left").withColumn("names", F.when(F.col("found").isNull(), F.col("names")).otherwise(F.array_except("names", "found")))
    rows = rows.where(F.col("found").isNull() | (F.size("names") > 0))
    rows = rows.withColumn("whole", whole).where(F.size("whole") > 0).withColumn("n", F.explode(F.sequence(shortest, F.size("whole"))))
    rows = rows.select(*key, "names", "n", F.array_join(F.slice("whole", 1, F.col("n")), "/").alias("stem"))
    rows = rows.join(stems, "stem").groupBy(*key).agg(F.max_by(F.struct("target", "names"), F.struct(F.col("n"), order)).alias("best"))
    return rows.select(*key, "best.*").unionByName(inside.select(*key, "target", F.array().cast("array<string>").alias("names")))


def signatures(parsed: DataFrame) -> DataFrame:
    """(file, name, line_start, line_end) of functions, methods also as Class.method."""
    rows = nodes(parsed).where("node_type in ('function', 'method')")
    local = F.substring_index("qualified_name", ":", -1)
    plain = rows.select(F.col("file_path").alias("file"), "name", "line_start", "line_end")
    return plain.unionByName(rows.where("node_type = 'method'").select(F.col("file_path").alias("file"), local.alias("name"), "line_start", "line_end"))
