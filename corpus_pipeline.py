"""The corpus pipeline: stages that apply operators of graphloom.llm to documents, one after the other.

Each stage takes (spark, docs, sf_dir) and returns all rows that it keeps; all but the last return the
columns of docs. Columns are addressed by place, so extra columns may have any name. Rows without an id
or text pass the filters that need one: they are neither toxic, nor copies, nor contaminated.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bpe, decontaminate, near_dups, secrets, toxicity
from graphloom.llm.queries import VOCABULARY
from graphloom.llm.sampling import fold
from graphloom.session import table, written

#: Texts from this score on are toxic.
TOXIC = 0.7
#: Ids of copies that may be broadcast to drop them; beyond it the join shuffles.
BROADCAST_IDS = 500_000


def _by_place(docs: DataFrame, step: Callable[[DataFrame, list[str], str, str], DataFrame]) -> DataFrame:
    """Applies a step (frame, columns, id, text) under neutral column names and gives docs' names back."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    key, text = (names[docs.columns.index(c)] for c in ("doc_id", "text"))
    return step(docs.toDF(*names), names, key, text).select(*names).toDF(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the toxicity model rejects."""
    labels = table(spark, sf_dir, "labels")

    def step(frame: DataFrame, names: list[str], key: str, text: str) -> DataFrame:
        scored = toxicity.score(frame, labels.withColumnRenamed("doc_id", key), fold(key, 3) != 1, names, text, key=key)
        return scored.where(F.col("score") < TOXIC)

    return _by_place(docs, step)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the least id of each group of near-duplicates.

    Repeated rows of one id are one document; an id goes if none of its rows is kept.
    """

    def step(frame: DataFrame, names: list[str], key: str, text: str) -> DataFrame:
        found = near_dups.near_duplicates(frame, key, text).groupBy(F.col(key).alias("gone")).agg(F.bool_or("kept").alias("kept"))
        gone = near_dups.cut_lineage(found.where("not kept").select("gone"))
        gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
        return frame.join(gone, frame[key] == gone["gone"], "left_anti")

    return _by_place(docs, step)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    benchmark = table(spark, sf_dir, "benchmark")
    return _by_place(docs, lambda frame, names, key, text: decontaminate.contamination(frame, benchmark, names, text).where("n_hit = 0"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by marks; n_chars follows the new text."""

    def step(frame: DataFrame, names: list[str], key: str, text: str) -> DataFrame:
        found = secrets.scan(frame, [c for c in names if c != text], text).withColumn(text, F.col("redacted"))
        if "n_chars" in docs.columns:
            count = names[docs.columns.index("n_chars")]
            found = found.withColumn(count, F.when(F.size("spans") > 0, F.length(text)).otherwise(F.col(count)).cast(docs.schema["n_chars"].dataType))
        return found

    return _by_place(docs, step)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document: doc_id, n_tokens, ids, and whether decoding gives the text back."""
    import public_tokenizers

    plain = docs.select("doc_id", "text")
    found = bpe.encode_decode(plain, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, ["doc_id", "text"])
    same = F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return found.select("doc_id", "n_tokens", "ids", same.alias("round_trip"))


#: (name, function of (spark, docs, sf_dir)); each stage works on all that its predecessor kept.
STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("secrets", redact_secrets),
    ("bpe", encode),
]

#: The classifier's weights and the byte-pair ids can't be computed in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to the documents table; each stage's rows are written once and read by the next one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
