"""Scalar functions on names, paths, URLs and source text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File extensions and their languages.
LANGUAGES = {
    ".py": "python",
    ".pyi": "python",
    ".js": "javascript",
    ".jsx": "javascript",
    ".mjs": "javascript",
    ".cjs": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".mts": "typescript",
    ".cts": "typescript",
    ".go": "go",
    ".rs": "rust",
    ".java": "java",
    ".kt": "kotlin",
    ".kts": "kotlin",
    ".rb": "ruby",
    ".php": "php",
    ".cs": "csharp",
    ".cpp": "cpp",
    ".cc": "cpp",
    ".cxx": "cpp",
    ".c": "c",
    ".h": "c",
    ".hpp": "cpp",
    ".swift": "swift",
    ".scala": "scala",
    ".ex": "elixir",
    ".exs": "elixir",
}
#: The shorter map of extensions that agent results use; others are unknown.
AGENT_LANGUAGES = {
    ".py": "python",
    ".js": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".jsx": "javascript",
    ".java": "java",
    ".go": "go",
    ".rs": "rust",
    ".rb": "ruby",
    ".php": "php",
    ".c": "c",
    ".cpp": "cpp",
    ".cs": "csharp",
}
#: Text that hints at dynamic dispatch.
DYNAMIC_HINTS = ("getattr", "setattr", "importlib", "import_module", "__import__", "globals()", "locals()", "eval(", "exec(", "dispatch", "registry", "handler_map", "callback", "plugin", "hook")
#: Palette of feature colours.
COLORS = ("#4C72B0", "#DD8452", "#55A868", "#C44E52", "#8172B3", "#937860", "#DA8BC3", "#8C8C8C", "#CCB974", "#64B5CD", "#A1D99B", "#FC9272", "#BCBDDC", "#FDD0A2", "#C7E9C0", "#FDAE6B")


def fqn(path: Column, name: Column) -> Column:
    """Key of a node within its repository."""
    return F.concat_ws("::", path, name)


def module_name(path: Column) -> Column:
    """Dotted module of a Python file; a package is named by its folder."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), "(^|/)__init__$", ""), "/", ".")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def language(path: Column, default: str | None = None, languages: dict[str, str] = LANGUAGES) -> Column:
    """Language by extension; null or the default for others."""
    known = F.create_map(*[F.lit(x) for pair in languages.items() for x in pair])
    return F.coalesce(F.element_at(known, extension(path)), F.lit(default))


def short_name(fqn_: Column) -> Column:
    """What follows the last colon."""
    return F.substring_index(F.substring_index(fqn_, "::", -1), ":", -1)


def directory_key(fqn_: Column) -> Column:
    """Folder of the file part of a name, 'root' without one."""
    file = F.when(fqn_.contains("::"), F.substring_index(fqn_, "::", 1)).otherwise(F.substring_index(fqn_, ":", 1))
    return F.coalesce(F.nullif(F.regexp_extract(file, "^(.*)/[^/]*$", 1), F.lit("")), F.lit("root"))


def _segments(url: Column) -> Column:
    return F.filter(F.split(url, "/"), lambda s: (s != "") & ~s.startswith("{") & ~s.startswith(":"))


def url_prefix(url: Column) -> Column:
    """The first two fixed segments of a URL path; the URL, or '/', if it has none."""
    parts = F.slice(_segments(url), 1, 2)
    whole = F.when(F.length(url) > 0, url).otherwise(F.lit("/"))
    return F.when(F.size(parts) > 0, F.concat(F.lit("/"), F.array_join(parts, "/"))).otherwise(whole)


def strip_params(url: Column) -> Column:
    """All fixed segments of a URL path, joined."""
    return F.array_join(_segments(url), "/")


def cli_group(command: Column, default: Column) -> Column:
    """First word of a command, else the default."""
    return F.coalesce(F.nullif(F.split(F.trim(command), r"\s+")[0], F.lit("")), default)


def snake(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(text, "[^a-zA-Z0-9]+", "_"), "^_+|_+$", ""))


def title(text: Column) -> Column:
    """Words with a capital first letter, the rest lower, separators made spaces."""
    words = F.filter(F.split(F.regexp_replace(text, "[-_/ ]+", " "), " "), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))), " ")


def owner_key(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit(" "), F.lit("_"))


def path_tokens(path: Column) -> Column:
    """Distinct lower-case parts of a path or name."""
    return F.array_distinct(F.filter(F.split(F.lower(path), "[^a-z0-9]+"), lambda t: t != ""))


def git_url(url: Column) -> Column:
    """Comparable form of a remote's URL."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(url), "/+$", ""), r"\.git$", ""))


def has_dynamic_hint(source: Column, hints: tuple[str, ...] = DYNAMIC_HINTS) -> Column:
    low = F.lower(source)
    found = F.lit(False)
    for hint in hints:
        found = found | low.contains(hint)
    return found


def line_slice(source: Column, first: Column, last: Column) -> Column:
    """Lines first to last, counted from 1."""
    return F.array_join(F.slice(F.split(source, "\n"), first, F.greatest(last - first + 1, F.lit(0))), "\n")


def dedent(source: Column) -> Column:
    """Removes the white space that all non-blank lines begin with."""
    lines = F.split(source, "\n")
    depths = F.transform(F.filter(lines, lambda x: F.trim(x) != ""), lambda x: F.length(x) - F.length(F.ltrim(x)))
    depth = F.coalesce(F.array_min(depths), F.lit(0))
    return F.array_join(F.transform(lines, lambda x: F.when(F.trim(x) == "", F.lit("")).otherwise(F.substring(x, depth + 1, F.length(x)))), "\n")


def truncated(text: Column, budget: int, mark: str) -> Column:
    return F.when(F.length(text) > budget, F.concat(F.left(text, F.lit(budget)), F.lit(mark))).otherwise(text)


def common_prefix(low: Column, high: Column) -> Column:
    """Longest common prefix of a group, given its least and greatest string."""
    size = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(low), F.lit(1))), F.lit(0), lambda n, i: F.when((n == i - 1) & (F.length(low) >= i) & (F.substring(low, i, F.lit(1)) == F.substring(high, i, F.lit(1))), i).otherwise(n))
    return F.substring(low, F.lit(1), size)


def color(index: Column, palette: tuple[str, ...] = COLORS) -> Column:
    """Palette colour of an index from 0, over and over."""
    return F.element_at(F.array(*map(F.lit, palette)), (index % len(palette) + 1).cast("int"))


def importance(lines: Column, documented: Column, is_entry: Column) -> Column:
    """Score of a function by size, documentation and role."""
    return F.bround(F.least(lines / 50.0, F.lit(1.0)) + F.when(documented, 0.3).otherwise(0.0) + F.when(is_entry, 0.5).otherwise(0.0), 3)


#: Words that add a branch where a line begins with them.
BRANCHES = ("if", "elif", "else", "for", "while", "except", "with", "and", "or")


def complexity(source: Column) -> Column:
    """One more than the number of lines that begin with a branching word."""
    lines = F.transform(F.split(source, "\n"), F.trim)
    return F.size(F.filter(lines, lambda x: x.rlike("^(" + "|".join(BRANCHES) + ")[ :]"))) + 1


def iso_time(time: Column) -> Column:
    """A timestamp as ISO text with its zone, in UTC."""
    return F.date_format(F.to_utc_timestamp(time, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def json_object(text: Column) -> Column:
    """The variant of a JSON object, without the code fence it may stand in; null for anything else."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", "")
    value = F.try_parse_json(bare)
    return F.when(F.schema_of_variant(value).startswith("OBJECT"), value)


def answer_line(text: Column) -> Column:
    """First line of a model's answer, without the quotes around it."""
    return F.regexp_replace(F.split(F.trim(text), "\n")[0], "^\"(.*)\"$", "$1")


#: Decorators (last part of the name, lower case) that make entry points: type, and what the first argument is.
ROUTES = {
    "get": ("http_route", "url"),
    "post": ("http_route", "url"),
    "put": ("http_route", "url"),
    "patch": ("http_route", "url"),
    "delete": ("http_route", "url"),
    "head": ("http_route", "url"),
    "options": ("http_route", "url"),
    "trace": ("http_route", "url"),
    "route": ("http_route", "url"),
    "websocket": ("websocket", "url"),
    "websocket_route": ("websocket", "url"),
    "on_event": ("lifecycle", "event"),
    "on_startup": ("lifecycle", "event"),
    "on_shutdown": ("lifecycle", "event"),
    "command": ("cli", "command"),
    "group": ("cli", "command"),
    "callback": ("cli", "command"),
}


def route(name: Column, first_arg: Column, methods: Column) -> Column:
    """(type, method, target) of a decorator that makes a function an entry point, else null."""
    last = F.lower(F.substring_index(name, ".", -1))
    kind = F.element_at(F.create_map(*[F.lit(x) for k, (t, _) in ROUTES.items() for x in (k, t)]), last)
    method = F.when(last == "route", F.coalesce(methods, F.lit("ANY"))).when(kind == "http_route", F.upper(last))
    arg = F.coalesce(F.regexp_replace(first_arg, "^['\"]+|['\"]+$", ""), F.lit(""))
    return F.when(kind.isNotNull(), F.struct(kind.alias("type"), method.alias("method"), arg.alias("target")))


def progress(percent: Column) -> Column:
    return F.round(F.least(percent, F.lit(100.0)), 1)
