"""Secret scans: fixed patterns, and a token-efficiency test under a byte-level vocabulary for random strings."""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom.llm.common import documents, lean, limit_batches

#: The base kinds, in the order in which equal starts are listed.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A run of 24 or more; shorter runs are dropped anyway.
HEX = re.compile(r"[0-9a-f]{24,}")
#: What may be a random string: a long run of the base64 alphabets.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
#: Characters a token up to which a candidate counts as random. Words and names reach 2.5 and more,
#: random base64 about 1.5, random hexadecimal about 1.7.
MOST_RATIO = 2.0
#: Lengths of usual digests in hexadecimal: MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512.
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
#: Identifiers: numbers, dates, and words, or names in parts that are each a word or a number.
NUMBERS = re.compile(r"[0-9_/+-]+")
SEPARATOR = re.compile(r"[_/+-]")
PART = re.compile(r"[A-Za-z]?[a-z]*|[A-Z]*|[0-9]{1,4}")
#: Characters of a candidate that are turned into tokens at once; merging takes the square of it.
ENCODED = 512


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


_ENCODINGS: dict[str, object] = {}


def encoding(path: str) -> object:
    if path not in _ENCODINGS:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODINGS[path] = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, leftmost and non-overlapping per kind."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def known(s: str) -> bool:
    """Digests and identifiers, which are dense in tokens but no secrets; takes time in proportion to s."""
    core = s.rstrip("=")
    if UUID.fullmatch(core) or NUMBERS.fullmatch(core) or all(map(PART.fullmatch, SEPARATOR.split(core))):
        return True
    return len(core) in DIGEST_LENGTHS and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", core) is not None


def random_spans(text: str, taken: list[tuple[int, int, str]], enc: object, most_ratio: float = MOST_RATIO) -> list[tuple[int, int, str]]:
    """(start, end, "random") of candidates with a letter, unknown and outside taken, at most most_ratio characters a token.

    taken is in order of starts. Tokens are counted over parts of ENCODED characters.
    """
    out, starts, reach = [], [a for a, _, _ in taken], list(accumulate((z for _, z, _ in taken), max))
    for m in CANDIDATE.finditer(text):
        s, before = m.group(), bisect_left(starts, m.end())
        if before and reach[before - 1] > m.start() or not any(c.isalpha() for c in s) or known(s):
            continue
        if len(s) <= most_ratio * sum(len(enc.encode_ordinary(s[k : k + ENCODED])) for k in range(0, len(s), ENCODED)):
            out.append((m.start(), m.end(), "random"))
    return out


@lean
def _scan(batches: Iterator[pa.RecordBatch], path: str, most_ratio: float) -> Iterator[pa.RecordBatch]:
    enc = encoding(path)
    joined = lambda spans: ",".join(f"{k}:{a}:{b}" for a, b, k in spans)
    for b in batches:
        base = [base_spans(t) for t in b.column("text").to_pylist()]
        rand = [random_spans(t, s, enc, most_ratio) for t, s in zip(b.column("text").to_pylist(), base, strict=True)]
        counts = [pa.array([sum(x[2] == k for x in s) for s in base], pa.int64()) for k in KINDS[:3]]
        spans = [joined(sorted(s + r, key=lambda x: (x[0], KINDS.index(x[2])))) for s, r in zip(base, rand, strict=True)]
        cols = [b.column("doc_id"), *counts, pa.array([len(r) for r in rand], pa.int64()), pa.array([hashlib.sha256(joined(s).encode()).hexdigest() for s in base], pa.string()), pa.array(spans, pa.string())]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"])


def secret_scan(docs: DataFrame, vocabulary: str | None = None, most_ratio: float = MOST_RATIO) -> DataFrame:
    """Return (doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans), one row for each row of docs.

    spans lists kind:start:end by start, then kind in the order of KINDS, in code points with exclusive ends;
    base_sha256 digests the same list of the base kinds only. A random span is a run of 20 or more characters
    with a letter, none of the known digests and identifiers, outside all base spans, that needs a token for
    every most_ratio characters or fewer; letters of one case alone are identifiers. Time grows with the
    text alone, whatever it holds. Null and empty texts have no spans; repeated rows are
    scanned as often as they come; other columns are ignored. Rows never meet, so nothing is shuffled.
    """
    limit_batches(docs.sparkSession)
    path = vocabulary or default_vocabulary()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(lambda it: _scan(it, path, most_ratio), "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(documents(spark, sf_dir))
