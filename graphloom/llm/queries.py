"""The registered queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bpe, decontaminate, importance, language_model, license_texts, licenses, near_dups, quality, secrets, set_join, toxicity, vector_codes, vptree, warc
from graphloom.llm.sampling import fold
from graphloom.session import table

VOCABULARY = "byte_bpe_50k.tiktoken"


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every document; digests of ids and of decoded bytes."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return bpe.encode_decode(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, ["doc_id"], digests=True)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and novel secret spans of every document."""
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents"), ["doc_id"]), ["doc_id"])


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside benchmark windows, and the items they come from."""
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.digest(decontaminate.contamination(docs, benchmark, ["doc_id"]), ["doc_id"])


OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + 9], ' ') AS s FROM b, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS r(i) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM win),
g AS (SELECT doc_id, p, n, array_to_string(w[p : p + n - 1], ' ') AS s FROM d, lens, unnest(range(1, len(w) - n + 2)) AS r(p)),
hit AS (SELECT doc_id, p, n, item_id FROM g JOIN win USING (n, s)),
covered AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM hit, unnest(range(p, p + n)) AS r(q) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS listed FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op7_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents that share three quarters of their shingles."""
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM d, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS r(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM both_ JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
comp AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN comp USING (doc_id)
"""


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all documents, stated or inherited.

    The shorter a document, the higher its path: source/id below 400 characters, source/lang/id below 1,500,
    else source/lang/group/id, so that directories at three depths have ancestors.
    """
    docs = table(spark, sf_dir, "documents")
    size = F.length(F.coalesce("text", F.lit("")))
    group = F.concat(F.lit("g"), (F.col("doc_id") % 16).cast("string"))
    folders = F.when(size < 400, F.array(F.lit(None).cast("string"))).when(size < 1500, F.array(F.coalesce("lang", F.lit("unknown")))).otherwise(F.array(F.coalesce("lang", F.lit("unknown")), group))
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), folders, F.col("doc_id").cast("string"))
    return licenses.scan(docs.withColumn("path", path), keep=("doc_id",))


def _op8_sql() -> str:
    listed = ", ".join(f"({k}, '{t.licence}', {sorted(set(licenses.words(t.must)))}, {licenses.words(t.statement)}, {licenses.words(t.never) or ['']})" for k, t in enumerate(license_texts.ALL))
    tokens = "list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda w: w <> '')"
    return f"""
WITH t AS (SELECT * FROM (VALUES {listed}) AS v(template, licence, must, bag, never)),
voc AS (SELECT DISTINCT unnest(list_filter(list_concat(bag, must, never), lambda w: w <> '')) AS word FROM t),
f AS (SELECT doc_id, coalesce(text, '') AS text, concat_ws('/', coalesce(source, 'unknown'), CASE WHEN length(coalesce(text, '')) >= 400 THEN coalesce(lang, 'unknown') END, CASE WHEN length(coalesce(text, '')) >= 1500 THEN 'g' || doc_id % 16 END) AS dir FROM documents),
w AS (SELECT *, dir || '/' || doc_id AS path, {tokens.format("text")} AS bag FROM f),
df AS (SELECT word, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct(bag)) AS word FROM w) WHERE word IN (SELECT word FROM voc) GROUP BY word),
idf AS (SELECT word, ln((1 + (SELECT count(*) FROM w)) / (1 + coalesce(df, 0))) + 1 AS idf FROM voc LEFT JOIN df USING (word)),
tm AS (SELECT template, word, count(*) * any_value(idf) AS weight FROM (SELECT template, unnest(bag) AS word FROM t) JOIN idf USING (word) GROUP BY ALL),
tn AS (SELECT template, sqrt(sum(weight * weight)) AS norm FROM tm GROUP BY template),
ls AS (SELECT path, len(bag) AS n_words, bag AS whole, list_transform(string_split(text, chr(10)), lambda x: {tokens.format("x")}) AS bags, list_position(list_transform(string_split(text, chr(10)), lambda x: regexp_matches(x, '{licenses.COMMENT}')), false) AS head FROM w),
win AS (SELECT path, n_words, bags, unnest(range(1, len(bags) + 1)) AS line FROM ls),
units AS (SELECT path, n_words, 0 AS kind, 0 AS line, 0 AS size, whole AS bag FROM ls UNION ALL SELECT path, n_words, 1, 0, 0, flatten(bags[1 : head - 1]) FROM ls WHERE head > 1
UNION ALL SELECT path, n_words, 2, line, k, flatten(bags[line : line + k - 1]) FROM win, unnest(range(1, {licenses.WINDOW} + 1)) AS r(k)),
u AS (SELECT path, n_words, kind, line, size, bag FROM units WHERE list_has_any(bag, (SELECT list(DISTINCT m) FROM (SELECT unnest(must) AS m FROM t)))),
uw AS (SELECT path, n_words, kind, line, size, word, count(*) AS tf, count(*) * any_value(idf) AS weight FROM (SELECT path, n_words, kind, line, size, unnest(bag) AS word FROM u) JOIN idf USING (word) GROUP BY ALL),
un AS (SELECT path, kind, line, size, list(word) AS held_all, sum(tf) AS said, sqrt(sum(weight * weight)) AS norm FROM uw GROUP BY ALL),
sc AS (SELECT path, uw.n_words, kind, line, size, template, any_value(said) AS said, any_value(held_all) AS held_all, round(sum(uw.weight * tm.weight) / (any_value(un.norm) * any_value(tn.norm)), 9) AS score, list(uw.word) AS held FROM uw JOIN tm USING (word) JOIN un USING (path, kind, line, size) JOIN tn USING (template) GROUP BY ALL),
own AS (SELECT path, max(score) AS score, arg_min(licence, (-score, licence, said)) AS licence, arg_min(said, (-score, licence, said)) >= {licenses.FILE_SHARE} * any_value(n_words) AS is_file FROM sc JOIN t USING (template) WHERE score >= {licenses.THRESHOLD} AND list_has_all(held, must) AND NOT list_has_any(held_all, never) GROUP BY path),
given AS (SELECT dir, max(score) AS score, arg_min(own.path, (-score, own.path)) AS path, arg_min(licence, (-score, own.path)) AS licence FROM own JOIN w USING (path) WHERE is_file GROUP BY dir),
above AS (SELECT dir, depth, array_to_string(string_split(dir, '/')[1 : depth], '/') AS up FROM (SELECT DISTINCT dir FROM w), unnest(range(0, 4)) AS r(depth)),
near AS (SELECT above.dir, arg_max(given.score, depth) AS score, arg_max(given.path, depth) AS path, arg_max(licence, depth) AS licence FROM above JOIN given ON given.dir = above.up WHERE depth <= len(string_split(above.dir, '/')) GROUP BY above.dir)
SELECT doc_id, w.path, coalesce(own.licence, near.licence) AS licence, coalesce(own.score, near.score) AS score,
CASE WHEN own.licence IS NOT NULL THEN CASE WHEN is_file THEN 'file' ELSE 'header' END WHEN near.licence IS NOT NULL THEN 'inherited' END AS found,
CASE WHEN own.licence IS NOT NULL THEN w.path ELSE near.path END AS from_path
FROM w LEFT JOIN own USING (path) LEFT JOIN near ON near.dir = w.dir
"""


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all pages as WARC records, with revisits, and reads the archive back."""
    folder = warc.archive_folder(spark)
    manifest = warc.write(table(spark, sf_dir, "pages"), folder)
    found = warc.read(spark, manifest, folder, payloads=False)
    return found.select(F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html) AS payload_bytes, CAST(CAST(unhex(sha1(html)) AS BIT) AS VARCHAR) AS b FROM p),
d AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * CAST(substr(b, i * 5 + 1, 1) AS INT) + 8 * CAST(substr(b, i * 5 + 2, 1) AS INT) + 4 * CAST(substr(b, i * 5 + 3, 1) AS INT) + 2 * CAST(substr(b, i * 5 + 4, 1) AS INT) + CAST(substr(b, i * 5 + 5, 1) AS INT), 1)), '') AS payload_digest FROM h),
f AS (SELECT payload_digest, min(page_id) AS first FROM d GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM d JOIN f USING (payload_digest)
"""


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; rows of fold 0 of 5 are held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = (fold("doc_id", 5) == 0).alias("held_out")
    scored = quality.score(docs, labels, fold("doc_id", 5) != 0, ["doc_id", held_out])
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; rows of fold 1 of 3 are held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = (fold("doc_id", 3) == 1).alias("held_out")
    scored = toxicity.score(docs, labels, fold("doc_id", 3) != 1, ["doc_id", held_out])
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest rows, by cosine, of every row whose vec_id is divisible by 50."""
    return vptree.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


OP5_SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(c.v, c.v))) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op1_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-likelihood of every document under the recurrent model; rows of fold 2 of 7 are held out."""
    return language_model.score(table(spark, sf_dir, "documents"), fold("doc_id", 7) != 2)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors by codebooks of 64 entries for 16 parts, with their errors."""
    return vector_codes.encode(table(spark, sf_dir, "embeddings"))


def _op11_sql() -> str:
    """Two rounds of assigning parts to entries and averaging, then the final assignment."""
    nearest = "SELECT vec_id, part, v, CAST(arg_min(entry, (d, entry)) AS INT) AS entry, min(d) AS d FROM (SELECT vec_id, part, p.v, entry, list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM p JOIN {book} b USING (part)) GROUP BY vec_id, part, v"
    moved = "SELECT part, entry, coalesce(m.v, b.v) AS v FROM {book} b LEFT JOIN (SELECT part, entry, list(x ORDER BY i) AS v FROM (SELECT part, entry, i, CAST(floor(sum(v[i]) / count(*)) AS BIGINT) AS x FROM {near}, unnest(range(1, len(v) + 1)) AS r(i) GROUP BY ALL) GROUP BY ALL) m USING (part, entry)"
    return f"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, part, v[part * len(v) // {vector_codes.PARTS} + 1 : (part + 1) * len(v) // {vector_codes.PARTS}] AS v FROM k, unnest(range({vector_codes.PARTS})) AS r(part)),
b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v FROM p QUALIFY entry < {vector_codes.ENTRIES}),
n0 AS MATERIALIZED ({nearest.format(book="b0")}),
b1 AS MATERIALIZED ({moved.format(book="b0", near="n0")}),
n1 AS MATERIALIZED ({nearest.format(book="b1")}),
b2 AS MATERIALIZED ({moved.format(book="b1", near="n1")}),
n2 AS MATERIALIZED ({nearest.format(book="b2")}),
c AS (SELECT vec_id, lower(string_agg(printf('%02x', entry), '' ORDER BY part)) AS code, CAST(sum(d) AS BIGINT) AS error FROM n2 GROUP BY vec_id),
s AS (SELECT sha256(string_agg(x, ',' ORDER BY part, entry)) AS codebooks_sha256 FROM (SELECT part, entry, array_to_string(v, ',') AS x FROM b2))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM c JOIN k USING (vec_id), s
"""


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents that share four fifths of their shingles."""
    return set_join.join(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM d, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS r(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM both_ JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) USING (doc_id)
"""


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of all documents towards the benchmark's words, and a tenth of them drawn."""
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
target AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
f AS (SELECT doc_id, unnest(w) AS w FROM words),
crc AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1))) AS v FROM range(256) AS r(i))),
buckets AS MATERIALIZED (SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(strlen(w)), lambda k: CAST('0x' || substr(hex(encode(w)), 2 * k + 1, 2) AS BIGINT))), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % 10000 AS bucket FROM (SELECT w FROM f UNION SELECT w FROM target), crc),
source AS (SELECT bucket, count(*) AS s FROM f JOIN buckets USING (w) GROUP BY bucket),
wanted AS (SELECT bucket, count(*) AS t FROM target JOIN buckets USING (w) GROUP BY bucket),
gain AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM f) + 10000) / ((s + 1.0::DOUBLE) * ((SELECT count(*) FROM target) + 10000)))) AS BIGINT) AS gain FROM source LEFT JOIN wanted USING (bucket)),
sums AS (SELECT doc_id, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight FROM f JOIN buckets USING (w) JOIN gain USING (bucket) GROUP BY doc_id),
noise AS (SELECT doc_id, len(w) AS n_features, coalesce(weight, 0) AS weight, CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) AS h FROM words LEFT JOIN sums USING (doc_id)),
scored AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM noise),
drawn AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_features >= 20 QUALIFY rank <= 10 * count(*) OVER () // 100)
SELECT doc_id, n_features, weight, score, rank FROM scored LEFT JOIN drawn USING (doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_language_model": op1_language_model, "op2_decontaminate": op2_decontaminate, "op3_quality": op3_quality, "op4_secrets": op4_secrets, "op5_neighbours": op5_neighbours, "op6_toxicity": op6_toxicity, "op7_near_dups": op7_near_dups, "op8_licenses": op8_licenses, "op9_byte_bpe": op9_byte_bpe, "op10_warc": op10_warc, "op11_vector_codes": op11_vector_codes, "op12_jaccard_join": op12_jaccard_join, "op13_importance": op13_importance}


def oracle_sql() -> dict[str, str]:
    return {"op2_decontaminate": OP2_SQL, "op5_neighbours": OP5_SQL, "op7_near_dups": OP7_SQL, "op8_licenses": _op8_sql(), "op10_warc": OP10_SQL, "op11_vector_codes": _op11_sql(), "op12_jaccard_join": OP12_SQL, "op13_importance": OP13_SQL}
