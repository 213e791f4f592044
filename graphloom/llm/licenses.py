"""Licence scans in DataFrame functions only: sparse TF-IDF cosine to templates, then inheritance by path.

Units of a file are the whole file, its header (the lines up to the first that is neither blank nor a comment)
and every window of up to WINDOW lines. Units and templates are
TF-IDF vectors over the templates' words, document frequencies taken over all files. A unit matches a template
if it holds all words without which nothing counts as that licence (`must`), none of those that name a sister of it
(`never`), and the cosine is THRESHOLD or more;
the greatest cosine counts, then the licence's name, then the shorter unit. A file that lacks the `must` words
of every template can't match and ends in its own row; nothing else is left out.

A file is a licence file of its directory if its name says so or templates' words in its best unit are FILE_SHARE of
its words; of several the best score, then the smallest path counts. A file without a licence of its own takes that of the
nearest ancestor directory that has one.

Directories, not files, meet in the path join: their number is checked before a broadcast; beyond it the
join shuffles and Spark splits skewed directories.

Defined results: a null or empty text has no licence of its own but inherits; a null path lies in the
root directory; rows of one path are one file, whose best unit counts for each of them; ties are settled by
name and path; an empty table gives an empty result; only the named columns are used, so extra columns may
have any name.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.license_texts import ALL, STOP, Template
from graphloom.session import written

LICENSE_NAME = r"(?i)^(licen[cs]e|copying|unlicense)([.-].*)?$"
#: How a comment's line may begin, after white space.
COMMENT = r"^\s*(#|//|/\*|\*|--|;|<!--|%|$)"
THRESHOLD = 0.75
#: Lines of a window, at most.
WINDOW = 4
FILE_SHARE = 0.2
#: Directories that may be broadcast.
BROADCAST_DIRS = 200_000


def words(text: str) -> list[str]:
    """A template's words that vectors have."""
    return [w for w in re.split("[^a-z0-9]+", text.lower()) if w and w not in STOP]


def _tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def _every(found: Column, musts: list[list[str]]) -> Column:
    """Whether an array holds all words of any of the lists."""
    return reduce(Column.__or__, [reduce(Column.__and__, [F.array_contains(found, w) for w in must]) for must in musts])


def scan(files: DataFrame, path: str = "path", text: str = "text", keep: tuple[str, ...] = (), templates: tuple[Template, ...] = ALL) -> DataFrame:
    """Columns of `keep`, then path, licence, score, found ('header', 'file', 'inherited' or null) and from_path."""
    spark = files.sparkSession
    bags = [Counter(words(t.statement)) for t in templates]
    musts = sorted({tuple(sorted(set(words(t.must)))) for t in templates})
    nevers = sorted({w for t in templates for w in words(t.never)})
    vocabulary = sorted({w for bag in bags for w in bag} | {w for must in musts for w in must} | set(nevers))
    content = F.split(F.lit(" ".join(vocabulary)), " ")  # folded into one literal
    where = F.coalesce(F.col(path), F.lit(""))
    rows = files.select(*keep, where.alias("path_"), F.coalesce(F.col(text), F.lit("")).alias("text_"))

    # one pass over the texts: each file's template words, and the text of those that can match
    known = rows.select("path_", "text_", F.array_intersect(F.split(F.lower("text_"), "[^a-z0-9]+"), content).alias("known"))
    read = written(known.select("path_", "known", F.when(_every(F.col("known"), [list(m) for m in musts]), F.col("text_")).alias("text_")), "words")

    # document frequencies of the templates' words over all files: one row per word and task is shuffled
    seen = read.select(F.explode("known").alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    total = read.agg(F.count("*").alias("files"))
    listed = spark.createDataFrame([(w,) for w in vocabulary], "word string").join(F.broadcast(seen), "word", "left").crossJoin(F.broadcast(total))
    idf = written(listed.select("word", (F.log((1 + F.col("files")) / (1 + F.coalesce("df", F.lit(0)))) + 1).alias("idf")), "idf")

    terms = [(k, t.licence, w, n, w in words(t.must), len(set(words(t.must))), words(t.never)) for k, (t, bag) in enumerate(zip(templates, bags, strict=True)) for w, n in sorted(bag.items())]
    model = spark.createDataFrame(terms, "template int, licence string, word string, tf int, needed boolean, n_needed int, never array<string>").join(F.broadcast(idf), "word")
    model = model.withColumn("weight", F.col("tf") * F.col("idf"))
    norms = model.groupBy("template").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    model = written(model.join(F.broadcast(norms), "template").select("template", "licence", "word", "needed", "n_needed", "never", (F.col("weight") / F.col("norm")).alias("share")), "templates")

    own = _own(read.where("text_ is not null"), [list(m) for m in musts], nevers, idf, model)
    name = F.regexp_extract("path_", "([^/]*)$", 1)
    is_file = name.rlike(LICENSE_NAME) | (F.col("said") >= FILE_SHARE * F.col("n_words"))
    own = written(own.select("path_", "licence", "score", is_file.alias("is_file")), "own")

    # nearest ancestor directory with a licence file, for each directory
    directory = F.regexp_extract("path_", "^(.*)/[^/]*$", 1)
    given = own.where("is_file").groupBy(directory.alias("above")).agg(F.min(F.struct((-F.col("score")).alias("minus"), F.col("path_"), F.col("licence"))).alias("given"))
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("above")))
    folders = rows.select(directory.alias("dir")).distinct().select("dir", F.explode(above).alias("up")).select("dir", "up.depth", "up.above")
    nearest = folders.join(given, "above").groupBy("dir").agg(F.max_by("given", "depth").alias("given")).select("dir", F.col("given.licence").alias("near_licence"), (-F.col("given.minus")).alias("near_score"), F.col("given.path_").alias("near_path"))
    nearest = written(nearest, "directories")
    few, n_own = nearest.count() <= BROADCAST_DIRS, own.count() <= BROADCAST_DIRS
    out = rows.drop("text_").withColumn("dir", directory).join(F.broadcast(own) if n_own else own, "path_", "left").join(F.broadcast(nearest) if few else nearest, "dir", "left")
    found = F.when(F.col("licence").isNotNull(), F.when(F.col("is_file"), "file").otherwise("header")).when(F.col("near_licence").isNotNull(), "inherited")
    return out.select(*keep, F.col("path_").alias("path"), F.coalesce("licence", "near_licence").alias("licence"), F.coalesce("score", "near_score").alias("score"), found.alias("found"), F.when(F.col("licence").isNotNull(), F.col("path_")).otherwise(F.col("near_path")).alias("from_path"))


def _own(files: DataFrame, musts: list[list[str]], nevers: list[str], idf: DataFrame, model: DataFrame) -> DataFrame:
    """(path_, licence, score, said, n_words) of every file that has a unit with a licence; said: the templates' words in the unit."""
    # all that follows stays within a file's row until words are counted
    needed = F.split(F.lit(" ".join(sorted({w for must in musts for w in must}))), " ")
    lines = F.transform(F.split("text_", "\n"), lambda x: F.struct(_tokens(x).alias("bag"), x.rlike(COMMENT).alias("comment")))
    lines = F.transform(lines, lambda x: F.struct(x["bag"].alias("bag"), x["comment"].alias("comment"), F.array_intersect(x["bag"], needed).alias("needed")))
    some = files.select("path_", F.xxhash64("text_").alias("text_id"), _tokens(F.col("text_")).alias("all_"), lines.alias("lines")).withColumn("n_words", F.size("all_"))
    some = some.withColumn("head", F.array_position(F.transform("lines", lambda x: x["comment"]), F.lit(False)).cast("int"))

    def unit(kind: int, line: Column, size: Column, bag: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), line.alias("line"), size.alias("size"), bag.alias("bag"))

    def bag_of(first: Column, size: Column) -> Column:
        return F.flatten(F.transform(F.slice("lines", first, size), lambda x: x["bag"]))

    none = F.lit(0)
    header = F.when(F.col("head") > 1, F.array(unit(1, none, none, bag_of(F.lit(1), F.col("head") - 1)))).otherwise(F.array().cast("array<struct<kind:int,line:int,size:int,bag:array<string>>>"))
    places = F.flatten(F.transform(F.sequence(F.lit(1), F.size("lines")), lambda i: F.transform(F.sequence(F.lit(1), F.lit(WINDOW)), lambda k: F.struct(i.alias("i"), k.alias("k")))))
    places = F.filter(places, lambda p: _every(F.flatten(F.transform(F.slice("lines", p["i"], p["k"]), lambda x: x["needed"])), musts))
    windows = F.transform(places, lambda p: unit(2, p["i"], p["k"], bag_of(p["i"], p["k"])))
    units = F.concat(F.array(unit(0, none, none, F.col("all_"))), header, windows)
    units = some.select("path_", "text_id", "n_words", F.explode(units).alias("u")).select("path_", "text_id", "n_words", "u.*")

    unit_key = ["path_", "text_id", "n_words", "kind", "line", "size"]
    key = [*unit_key, "said"]
    heard = units.dropDuplicates(unit_key).select(*unit_key, F.explode("bag").alias("word"))
    heard = heard.join(F.broadcast(idf), "word").groupBy(*unit_key, "word").agg(F.count("*").alias("tf"), (F.count("*") * F.first("idf")).alias("weight"))
    vectors = heard.groupBy(*unit_key).agg(F.sum("tf").alias("said"), F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"), F.collect_list(F.struct("word", "weight")).alias("vector"))  # as many words as the templates have
    sister = F.array_sort(F.array_intersect(F.transform("vector", lambda x: x["word"]), F.split(F.lit(" ".join(nevers)), " ")))
    vectors = vectors.withColumn("sisters", F.array_join(sister, " "))
    pairs = vectors.select(*key, "norm", "sisters", F.explode("vector").alias("x")).select(*key, "norm", "sisters", "x.word", "x.weight").join(F.broadcast(model), "word")
    pairs = pairs.where(~F.arrays_overlap(F.split("sisters", " "), "never"))
    scored = pairs.groupBy(*key, "norm", "template", "licence", "n_needed").agg(F.sum(F.col("weight") * F.col("share")).alias("dot"), F.count_if("needed").alias("held"))
    scored = scored.withColumn("score", F.round(F.col("dot") / F.col("norm"), 9)).where((F.col("score") >= THRESHOLD) & (F.col("held") == F.col("n_needed")))
    best = scored.groupBy("path_").agg(F.min(F.struct((-F.col("score")).alias("minus"), "licence", "said", (-F.col("n_words")).alias("less"))).alias("best"))
    return best.select("path_", "best.licence", (-F.col("best.minus")).alias("score"), "best.said", (-F.col("best.less")).alias("n_words"))
