"""BPE encoding by a queue of merges, and decoding by vocabulary strings.

A pre-token's symbols are a doubly linked list. All neighbouring pairs with a merge stand in a priority queue of (rank,
place); the least is taken, the symbol on its right is unlinked, and the two new pairs are queued. Entries whose symbol is
gone, or whose pair no longer makes the same symbol, are stale and skipped. So a pre-token of n letters takes n log n steps,
whatever its length. Ids are decoded by putting their vocabulary strings one behind the other, with the separator that the
library uses where the file names no decoder (a blank).

A word (between ASCII blanks) has the same ids in every text, so a task reads its texts in blocks, finds the distinct words
of a block, encodes those that it doesn't remember and puts the ids of the texts together from them. Nothing is shuffled,
a block's size is bounded (a longer text is a block of its own), and a lost task needs nothing from others. The library
normalises and pre-tokenises distinct words that aren't Latin; all merges are made here. Strings of added tokens in
a text cut it; the parts between them are texts of their own.

Null texts are empty and have no ids; empty texts decode to empty ones. Rows are encoded one by one, so null or repeated
ids and repeated rows don't matter. Very long texts and words are encoded whole. Only id, text and the columns of ``keep``
are read, so others can't clash. Ids outside the vocabulary and null ids have no string and are passed over, as in the
library; null lists decode as empty ones. An empty table gives an empty table.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamwatch.llm import vocab
from loamwatch.llm.common import blocks, body
from loamwatch.llm.token_store import BYTES

#: Words whose ids a worker remembers.
REMEMBERED = 300_000
#: Letters up to this one are Latin; a word of them needs no composition, and case is all that its normal form changes.
LAST_LATIN = "ʯ"
#: Pre-tokens of a Latin word in lower case: endings behind an apostrophe, letters, single digits, other characters.
LATIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ʯ]+|[0-9²³¹¼½¾]|[^a-zªµºß-öø-ʯ0-9²³¹¼½¾]+")
#: What a file's pre-tokenizer must say for LATIN to hold.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: In place of a symbol that is gone or isn't there.
NONE = (1 << 20) - 1


class Merges:
    """Vocabulary and merges of a file; ids of words."""

    def __init__(self, path: str):
        self.library = vocab.tokenizer(path)
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")):
            raise ValueError(f"{path}: options that merges alone don't cover")
        if file.get("decoder") or file.get("post_processor"):
            raise ValueError(f"{path}: a decoder or post-processor of its own")
        self.vocabulary: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        #: pair of symbols, as one number -> rank; rank -> symbol that they make
        self.rules: dict[int, int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rules[self.vocabulary[a] << 20 | self.vocabulary[b]] = rank
            self.made.append(self.vocabulary[a + b])
        self.added = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.cut = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.plain = any(p.get("pattern", {}).get("Regex") == _PATTERN for p in (file["pre_tokenizer"] or {}).get("pretokenizers", []))
        strings = {i: s for s, i in [*self.vocabulary.items(), *self.added.items()]}
        self.strings = pa.array([strings.get(i) for i in range(max(strings, default=-1) + 1)], pa.string())
        self.known: dict[str, list[int]] = {}
        self.before: dict[str, list[int]] = {}

    def merged(self, letters: str) -> list[int]:
        """Ids of one pre-token, given in the vocabulary's letters."""
        last = self.vocabulary[letters[-1] + self.suffix]
        if (n := len(letters)) == 1:
            return [last]
        get, made = self.rules.get, self.made
        ids = [*map(self.vocabulary.__getitem__, letters[:-1]), last, NONE]  # both ends of the list lead to the NONE at n
        behind, ahead = [*range(1, n + 1), n], [n, *range(n)]
        queue = [rank << 40 | i for i in range(n - 1) if (rank := get(ids[i] << 20 | ids[i + 1])) is not None]
        heapify(queue)
        while queue:
            entry = heappop(queue)
            i = entry & 0xFFFFFFFFFF
            j = behind[i]
            rank = get(ids[i] << 20 | ids[j])
            if rank is None or made[rank] != made[entry >> 40]:
                continue  # stale
            new, k, h = made[rank], behind[j], ahead[i]
            ids[i], ids[j], behind[i], ahead[k] = new, NONE, k, i
            if (rank := get(new << 20 | ids[k])) is not None:
                heappush(queue, rank << 40 | i)
            if (rank := get(ids[h] << 20 | new)) is not None:
                heappush(queue, rank << 40 | h)
        return [x for x in ids if x != NONE]

    def ids_of(self, word: str) -> list[int]:
        """Ids of one word whose A-Z are lower-cased."""
        lower = word.lower()
        if not (self.plain and lower.isprintable() and max(lower, default="") <= LAST_LATIN):
            found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(word))
            return [i for letters, _ in found for i in self.merged(letters)]
        out: list[int] = []
        for t in LATIN.findall(lower):
            # a pre-token is a word too
            ids = self.known.get(t)
            if ids is None:
                ids = self.known[t] = self.before.get(t) or self.merged(t if t.isascii() else t.encode().decode("latin-1").translate(BYTES))
            out += ids
        return out

    def of(self, words: list[str]) -> list[list[int]]:
        """Ids of distinct words."""
        if len(self.known) > REMEMBERED:
            self.before, self.known = self.known, {}
        known, before = self.known, self.before
        for w in words:
            if w not in known:
                known[w] = before[w] if w in before else self.ids_of(w)
        return list(map(known.__getitem__, words))


@lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    return Merges(path)


def _ids_of_texts(texts: pa.Array, m: Merges) -> pa.ListArray:
    """Ids of texts without added tokens."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    offsets = split.offsets.to_numpy()
    coded = split.flatten().dictionary_encode()
    known = pa.array(m.of(coded.dictionary.to_pylist()), pa.list_(pa.int32()))
    taken = known.take(coded.indices)
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(taken).to_numpy(zero_copy_only=False))])
    return pa.ListArray.from_arrays(pa.array(ends[offsets - offsets[0]].astype(np.int32)), taken.flatten().cast(pa.int32()))


def encode_block(texts: pa.Array, path: str) -> pa.ListArray:
    """Ids of each text of a block."""
    m = merges(path)
    marked = np.zeros(len(texts), bool)
    for token in m.added:
        marked |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
    if not marked.any():
        return _ids_of_texts(texts, m)
    # parts between added tokens are texts of their own, put together again afterwards
    parts, tokens, counts = [], [], []
    for text, cut in zip(texts.to_pylist(), marked.tolist(), strict=True):
        parts += m.cut.split(text) if cut else [text]
        tokens += [[m.added[t]] for t in m.cut.findall(text)] if cut else []
        tokens.append([])
        counts.append(len(parts))
    ids = _ids_of_texts(pa.array(parts, pa.string()), m)
    n = len(parts)
    order = np.arange(2 * n).reshape(2, n).T.ravel()  # each part, then what follows it
    joined = pa.concat_arrays([ids, pa.array(tokens, pa.list_(pa.int32()))]).take(pa.array(order))
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(joined).to_numpy(zero_copy_only=False))])
    return pa.ListArray.from_arrays(pa.array(ends[2 * np.array([0, *counts])].astype(np.int32)), joined.flatten())


def decode_block(ids: pa.ListArray, path: str) -> pa.Array:
    """The text of each list of ids."""
    strings = merges(path).strings
    ids = ids.fill_null([]) if ids.null_count else ids
    flat, sizes = ids.flatten(), pc.list_value_length(ids).to_numpy(zero_copy_only=False)
    values = flat.fill_null(-1).to_numpy()
    known = (values >= 0) & (values < len(strings))
    found = strings.take(pa.array(np.where(known, values, 0)))
    keep = known & found.is_valid().to_numpy(zero_copy_only=False) if len(strings) else known
    ends = np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], np.cumsum(sizes)])]
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), found.filter(pa.array(keep))), " ")


def encode_texts(docs: DataFrame, path: str | None = None, keep: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(doc_id, keep, token_ids array<int>) of every row; with ``decoded`` also the text that those ids decode to."""
    path = path or vocab.default_path("word_bpe_49k.json")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), *keep, body(text_col).alias("_text"))
    kinds = [(name, kind) for name, kind in source.dtypes[:-1]] + [("token_ids", "array<int>")] + [("decoded", "string")] * decoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "_text"):
            ids = encode_block(block.column(block.num_columns - 1).cast(pa.string()), path)
            yield pa.RecordBatch.from_arrays([*block.columns[:-1], ids] + [decode_block(ids, path)] * decoded, names=[n for n, _ in kinds])

    return source.mapInArrow(run, ", ".join(f"`{n}` {k}" for n, k in kinds))


def decode_ids(rows: DataFrame, path: str | None = None, ids_col: str = "token_ids") -> DataFrame:
    """The rows with ``decoded``, the text of their ids."""
    path = path or vocab.default_path("word_bpe_49k.json")
    place = rows.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, decode_block(batch.column(place), path)], names=[*batch.schema.names, "decoded"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("decoded", T.StringType())]))


def op13_bpe(spark, sf_dir: str) -> DataFrame:
    t = encode_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), decoded=True)
    ids = F.array_join(F.col("token_ids").cast("array<string>"), " ")
    return t.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
