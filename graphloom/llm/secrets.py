"""Secret scans: exact base patterns, then zstandard novelty primed with dictionaries.

Base spans are leftmost non-overlapping matches per kind. The method adds `novel` spans: strings in a
sensitive context (a key word shortly before or after them) whose marginal compressed size, given the text
around them and a dictionary of common identifiers as zstandard dictionary, stays close to their
length. Strings of digits, of letters and of both are measured alike; of those without digits, words (most of
whose pairs of letters are PAIRS) are no secrets. The compressor takes a string in
pieces too short for coding by letter frequency, which shortens random strings of few letters too, each
with what precedes it in the dictionary, so only repetition counts. Offsets are code points, ends exclusive.

Defined results: a null text counts as empty and has no spans; rows are independent, so repeated
rows and empty tables need nothing special, and the time of a text grows with its length; only the columns asked for are carried,
so extra columns may have any name.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.carry import map_texts, pieces

#: The base patterns and the least lengths of their matches.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 8, 16, 32
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
#: Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "novel")

#: Words that make a context sensitive.
SENSITIVE = ("password", "passwd", "secret", "token", "api_key", "apikey", "api-key", "credential", "bearer", "authorization", "private_key", "private key", "access_key", "access key")
CONTEXT = re.compile("|".join(map(re.escape, SENSITIVE)), re.IGNORECASE | re.ASCII)
SENSITIVE_BYTES = tuple(x.encode() for x in SENSITIVE)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")

#: Identifiers and literals that code repeats; the start of every dictionary.
IDENTIFIERS = (
    "password passwd secret token api_key access_key private_key client_secret bearer authorization credential username "
    "localhost example changeme placeholder your_token_here xxxxxxxxxxxxxxxx 0123456789abcdef 00000000-0000-0000-0000-000000000000 "
    "https://www.example.com/ http://127.0.0.1:8080 import return function class static public private const default config settings "
    "environment variable getenv os.environ process.env document.getElementById addEventListener abcdefghijklmnopqrstuvwxyz "
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ /usr/local/bin /etc/ssl/certs application/json Content-Type charset utf-8"
).encode()

#: Frequent pairs of letters; a string without digits whose pairs are these to WORDY is made of words.
PAIRS = frozenset(
    "th he in er an re nd at on nt ha es st en ed to it ou ea hi is or ti as te et ng of al de se le sa si ar ve ra ld ur ro me ne ri li no ic la io ce co "
    "di el ch ma om ll ta ot ec ct il us tr ss ee pe na ac ca un be em ns ol pr ut rs ad id ie rt ge po ho tu su mo ai lo pa ig ul im fo mi ag am ap ab".split()
)
WORDY = 0.45

#: Code points before and after a candidate in which a sensitive word counts, and those around it that prime the dictionary.
REACH, AROUND = 64, 1024
#: A candidate is novel from this share of its length in marginal bytes on.
NOVEL_SHARE = 0.75
#: Characters of a piece, at least; pieces stay below the 64 from which zstandard codes literals by frequency.
PIECE = 32


_HEX_CLASS = bytes(104 if chr(b) in "0123456789abcdef" else 32 for b in range(256))
_RUN = b"h" * LEAST_HEX


def marginal_bytes(candidate: bytes, around: bytes) -> int:
    """Compressed bytes that a candidate adds to what its surroundings and the identifiers explain."""
    primed = zstandard.ZstdCompressionDict(IDENTIFIERS + b"\n" + around, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    packer = zstandard.ZstdCompressor(level=6, dict_data=primed, write_content_size=False, write_dict_id=False)
    return len(packer.compress(candidate)) - len(packer.compress(b""))


def _wordy(token: str) -> bool:
    low = token.lower()
    pairs = [x for x in map("".join, zip(low, low[1:], strict=False)) if x.isalpha()]
    return not any(c.isdigit() for c in low) and sum(x in PAIRS for x in pairs) >= WORDY * len(pairs)


def is_novel(token: bytes, around: bytes) -> bool:
    """Whether the token's pieces keep NOVEL_SHARE of its length, given its surroundings and its own earlier pieces."""
    n = max(1, len(token) // PIECE)
    cuts = [len(token) * k // n for k in range(n + 1)]
    return sum(marginal_bytes(token[x:y], around + token[max(0, x - AROUND) : x]) for x, y in zip(cuts, cuts[1:], strict=False)) >= NOVEL_SHARE * len(token)


def _candidates(text: str) -> Iterator[tuple[int, int]]:
    """Strings within REACH after a sensitive word, then those within REACH before one, none twice; words aren't among them."""
    words = list(CONTEXT.finditer(text))
    reached, seen = 0, set()
    for word in words:
        for m in CANDIDATE.finditer(text, max(word.end(), reached), word.end() + REACH + 16):
            begin = m.start()
            if begin > word.end() + REACH:
                break
            m = CANDIDATE.match(text, begin)  # the whole token, beyond the reach too
            reached = m.end()
            seen.add(reached)
            if not _wordy(m[0]):
                yield m.span()
    starts = [word.start() for word in words]
    for m in CANDIDATE.finditer(text):
        near = bisect_left(starts, m.end())
        if near < len(starts) and starts[near] <= m.end() + REACH and m.end() not in seen and not _wordy(m[0]):
            yield m.span()


class _Taken:
    """Whether a stretch of text touches any of some spans."""

    def __init__(self, spans: list[tuple[str, int, int]]):
        by_start = sorted((begin, end) for _, begin, end in spans)
        self.starts = [begin for begin, _ in by_start]
        self.ends = list(accumulate((end for _, end in by_start), max))

    def __call__(self, begin: int, end: int) -> bool:
        before = bisect_left(self.starts, end)
        return before > 0 and self.ends[before - 1] > begin


def spans(text: str) -> list[tuple[str, int, int]]:
    """All spans of one text, by start, then kind as listed."""
    raw = text.encode().lower()
    found: list[tuple[str, int, int]] = []
    # the byte searches only skip patterns that can't match
    if any(word in raw for word in ASSIGN_WORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    if _RUN in raw.translate(_HEX_CLASS):
        found += [("hex", *m.span()) for m in HEX.finditer(text)]
    if any(word in raw for word in SENSITIVE_BYTES):
        taken = _Taken(found)
        for begin, end in _candidates(text):
            around = text[max(0, begin - AROUND) : begin] + text[end : end + AROUND]
            if not taken(begin, end) and is_novel(text[begin:end].encode(), around.encode()):
                found.append(("novel", begin, end))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def redacted(text: str, found: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by a mark; overlapping spans become one mark."""
    out, at = [], 0
    for kind, begin, end in found:
        if begin >= at:
            out += [text[at:begin], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def scan(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Columns of `keep`, then `spans` (array of kind, start, end) and `redacted` text (null for null).

    A narrow transformation: no shuffle, one text in memory at a time beside its Arrow batch.
    """
    fields = [T.StructField("spans", SPAN), T.StructField("redacted", T.StringType())]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch], n: int, names: list[str]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in pieces(whole, n)):
            texts = batch.column(n).to_pylist()
            found = [spans(x or "") for x in texts]
            clean = [x if not s else redacted(x, s) for x, s in zip(texts, found, strict=True)]
            rows = pa.array([[{"kind": k, "start": b, "end": e} for k, b, e in s] for s in found], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], rows, pa.array(clean, pa.string())], names=names)

    return map_texts(docs, keep, text, fields, run)


def digest(scanned: DataFrame, keep: list[str]) -> DataFrame:
    """Counts, digest and listing of the spans of `scan`."""

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def listed(column):
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"] != "novel")
    return scanned.select(*keep, *map(count, KINDS), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
