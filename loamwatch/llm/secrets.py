"""Secret scan: patterns, and a token-efficiency test for random strings.

Base spans come from three patterns. Besides, a run of 20 or more key characters that no base span touches is
split by a byte-level vocabulary: text that resembles what the vocabulary was made from gets several characters a
token, random strings few. A run with a letter and a digit and fewer than ``max_ratio`` characters a token is
reported as 'random', unless it is a known digest (hex digits of a usual length) or an identifier (a UUID, a
number, or words and numbers joined by separators).

Null texts are empty and have no spans; each row is scanned by itself, so null or repeated ids don't matter.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamwatch.llm import vocab
from loamwatch.llm.common import blocks, body, strings

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Lengths of usual digests in hex digits: MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512.
DIGESTS = {32, 40, 56, 64, 96, 128}
DIGEST = re.compile(r"[0-9a-fA-F]+")
UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")
#: Words and short numbers joined by separators: names of files, paths, slugs.
NAME = re.compile(r"(?:[A-Za-z]?[a-z]+|[A-Z]+|[0-9]{1,8})(?:[_/=+-]+(?:[A-Za-z]?[a-z]+|[A-Z]+|[0-9]{1,8}))*[_/=+-]*")
MAX_RATIO = 2.0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = []
    if "=" in text or ":" in text:
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return found


def is_random(run: str, encoding, max_ratio: float) -> bool:
    if not (any(c.isdigit() for c in run) and any(c.isalpha() for c in run)):
        return False
    if len(run) in DIGESTS and DIGEST.fullmatch(run) or UUID.fullmatch(run) or NAME.fullmatch(run):
        return False
    return len(run) < max_ratio * len(encoding.encode_ordinary(run))


def spans_of(text: str, encoding, max_ratio: float = MAX_RATIO) -> tuple[list, list]:
    """Base spans and all spans, each by start and kind."""
    runs = [m.span() for m in RUN.finditer(text)]
    # every hex span and every access key lies in such a run
    base = base_spans(text) if runs else [s for s in base_spans(text) if s[0] == "assign"]
    more = [("random", a, b) for a, b in runs if all(e <= a or s >= b for _, s, e in base) and is_random(text[a:b], encoding, max_ratio)]
    order = lambda s: (s[1], KINDS.index(s[0]))
    return sorted(base, key=order), sorted(base + more, key=order)


def _scan(path: str, max_ratio: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = vocab.ranked(path)
        for block in blocks(batches):
            counts, digests, spans = {k: [] for k in KINDS}, [], []
            for text in strings(block):
                base, found = spans_of(text, encoding, max_ratio)
                for k in KINDS:
                    counts[k].append(sum(s[0] == k for s in found))
                joined = lambda x: ",".join(f"{k}:{a}:{b}" for k, a, b in x)
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(found))
            yield pa.RecordBatch.from_arrays(
                [block.column(0), *[pa.array(counts[k], pa.int64()) for k in KINDS], pa.array(digests, pa.string()), pa.array(spans, pa.string())],
                names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"],
            )

    return run


def secret_spans(docs: DataFrame, path: str | None = None, max_ratio: float = MAX_RATIO, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: a count of each kind, the digest of the base spans, and all spans as kind:start:end."""
    path = path or vocab.default_path("byte_bpe_50k.tiktoken")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), body(text_col).alias("text"))
    columns = ", ".join(f"n_{k} long" for k in KINDS)
    return source.mapInArrow(_scan(path, max_ratio), f"doc_id long, {columns}, base_sha256 string, spans string")


def op7_secret_scan(spark, sf_dir: str) -> DataFrame:
    return secret_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
