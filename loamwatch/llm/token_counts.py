"""Token counts: each distinct pre-token is counted once, then joined to the documents' pre-token frequencies.

A task reads its documents in blocks. Of a block it keeps the frequency of each pre-token in each document
(row, pre-token, n), sorts out the distinct pre-tokens, has the library count the pieces of each of those once,
joins the counts back and sums. Ids are never materialised and nothing is shuffled: a pre-token's count depends
on the pre-token alone, so blocks need nothing from each other. A worker remembers counts up to a fixed number
of pre-tokens.

The cuts used here are a coarsening of the byte-level split: a blank followed by a non-blank starts a piece, and
so does the last blank of a run; within such a piece a final '.' or ',' behind a plain letter is a pre-token of
its own. Texts that hold an added token's string go to the library whole.

Null texts are empty and have no tokens; rows are counted one by one, so null or repeated ids don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamwatch.llm import vocab
from loamwatch.llm.common import blocks, body, strings

#: Unicode White_Space, what \s means to the library.
SPACE = r"\t-\r \x85\xa0  -     　"
CUT = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]")
#: Pre-tokens whose counts a worker remembers.
REMEMBERED = 800_000


@lru_cache(maxsize=1)
def _known(path: str) -> dict[str, int]:
    return {}


def _counts(path: str, tokens: list[str]) -> np.ndarray:
    """Pieces of each distinct pre-token."""
    known, library = _known(path), vocab.tokenizer(path)
    stems, tails = [], np.zeros(len(tokens), np.int64)
    dot = {c: len(library.encode(c, add_special_tokens=False)) for c in ".,"}
    for i, t in enumerate(tokens):
        if t[-1] in ".," and len(t) > 1 and (c := t[-2]) < "ɐ" and c.isalpha():
            tails[i] = dot[t[-1]]
            t = t[:-1]
        stems.append(t)
    if fresh := [t for t in dict.fromkeys(stems) if t not in known]:
        if len(known) + len(fresh) > REMEMBERED:
            known.clear()
            fresh = list(dict.fromkeys(stems))
        for i in range(0, len(fresh), 10_000):
            part = fresh[i : i + 10_000]
            known.update(zip(part, map(len, library.encode_batch_fast(part, add_special_tokens=False)), strict=True))
    return tails + np.fromiter(map(known.__getitem__, stems), np.int64, len(stems))


def _count(path: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        added, library = vocab.added_strings(path), vocab.tokenizer(path)
        for block in blocks(batches):
            texts = strings(block)
            number: dict[str, int] = {}
            whole = {i: len(library.encode(t, add_special_tokens=False)) for i, t in enumerate(texts) if any(a in t for a in added)}
            # (row, pre-token) -> n, as one number
            cut = [() if i in whole else CUT.findall(t) for i, t in enumerate(texts)]
            lengths = np.fromiter(map(len, cut), np.int64, len(cut))
            place = np.fromiter((number.setdefault(t, len(number)) for t in chain.from_iterable(cut)), np.int64, int(lengths.sum()))
            rows = np.repeat(np.arange(len(cut)), lengths)
            pairs, n = np.unique(rows * max(1, len(number)) + place, return_counts=True)
            counts = _counts(path, list(number))
            weights = n * counts[pairs % max(1, len(number))] if len(pairs) else np.zeros(0, np.int64)
            totals = np.zeros(len(texts), np.int64)
            np.add.at(totals, pairs // max(1, len(number)), weights)
            for i, k in whole.items():
                totals[i] = k
            yield pa.RecordBatch.from_arrays([block.column(0), block.column(1), pa.array(totals), pa.array(totals > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row."""
    path = path or vocab.default_path("byte_bpe_50k.json")
    text = body(text_col)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return source.mapInArrow(_count(path, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
