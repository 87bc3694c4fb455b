"""SentencePiece encoding and decoding by a shared-prefix forward pass.

A text is cut into marked words (blanks turned into U+2581; a cut before every run of marks and around line
feeds, which no piece crosses). A task takes the distinct marked words of a block, sorts them, and walks them as
the depth-first traversal of their trie: the forward states of the prefix that a word shares with the word
before it are still on the stack, so only the rest is scored.

The installed model is a merge model (BPE), whose encoding isn't the path of the best sum of scores, so the
forward state of a prefix is the last piece of its encoding instead: pieces u, t may follow each other exactly
if u + t encodes as [u, t], and exactly one last piece fits each prefix. Compatible pairs are remembered. Words
with several leading marks, whose pieces have tied scores, go to the library. Characters without a piece fall
back to bytes.

Null texts are empty and have no ids; rows are handled one by one, so null or repeated ids don't matter.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamwatch.llm import vocab
from loamwatch.llm.common import blocks, body, strings

MARK = "▁"
WORD = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
#: Text bytes of which one trie is made.
TRIE_BYTES = 24 << 20
#: Pairs of pieces whose compatibility a worker remembers.
PAIRS = 2_000_000


class PieceTable:
    """The pieces of a model, and which of them may follow each other."""

    def __init__(self, path: str):
        self.model = m = vocab.pieces(path)
        normal = [i for i in range(m.vocab_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        self.ids = {m.id_to_piece(i): i for i in normal}
        self.scores = {p: m.get_score(i) for p, i in self.ids.items()}
        self.bytes = {int(m.id_to_piece(i)[3:-1], 16): i for i in range(m.vocab_size()) if m.is_byte(i)}
        lengths: dict[str, set[int]] = {}
        for p in self.ids:
            if len(p) > 1:
                lengths.setdefault(p[-2:], {1}).add(len(p))
        #: Lengths of the pieces that end in two given characters, longest first.
        self.lengths = {k: tuple(sorted(v, reverse=True)) for k, v in lengths.items()}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.surface = [b""] * m.vocab_size()
        for p, i in self.ids.items():
            self.surface[i] = p.replace(MARK, " ").encode()
        for b, i in self.bytes.items():
            self.surface[i] = bytes([b])
        plain = [s for p, s in self.scores.items() if p.strip(MARK)]
        #: The cuts and the forward pass are exact only for such models; other models use the library for every text.
        self.exact = len(set(plain)) == len(plain) and bool(self.bytes) and not any("\n" in p or MARK in p.lstrip(MARK) for p in self.ids) and m.normalize("  A ﬁ  b") == f"{MARK * 3}A{MARK}ﬁ{MARK * 2}b"

    def merged(self, text: str) -> list[str]:
        """Encoding by merges: the best-scored neighbours join first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, u: str, t: str) -> bool:
        known = self.pairs.get((u, t))
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[u, t] = self.merged(u + t) == [u, t]
        return known

    def piece_ids(self, piece: str) -> list[int]:
        found = self.ids.get(piece)
        return [found] if found is not None else [self.bytes[b] for b in piece.encode()]

    def library(self, word: str) -> list[int]:
        """The library's ids of a marked word; it puts one mark in front by itself."""
        return [self.ids[MARK]] if word == MARK else self.model.encode(word[1:])

    def encode_sorted(self, words: Iterable[str]) -> Iterator[list[int]]:
        """Ids of sorted distinct marked words, sharing the forward states of common prefixes."""
        ids, lengths, pairs, follows = self.ids, self.lengths, self.pairs, self.follows
        last: list[str] = [""]  # last[i]: the last piece of the encoding of the first i characters
        before = ""
        for word in words:
            if word[0] == MARK and word[1:2] in (MARK, ""):
                yield self.library(word)
                continue
            shared = 0
            for a, b in zip(word, before, strict=False):
                if a != b:
                    break
                shared += 1
            del last[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                for n in lengths.get(word[end - 2 : end], (1,)) if end > 1 else (1,):
                    if n > end:
                        continue
                    start = end - n
                    t = word[start:end]
                    if n > 1 and t not in ids:
                        continue
                    u = last[start]
                    if not u or (known if (known := pairs.get((u, t))) is not None else follows(u, t)):
                        last.append(t)
                        break
            before = word
            out, end = [], len(word)
            while end:
                t = last[end]
                out.append(t)
                end -= len(t)
            found = []
            for t in reversed(out):
                i = ids.get(t)
                if i is not None:
                    found.append(i)
                else:
                    found += self.piece_ids(t)
            yield found


@lru_cache(maxsize=2)
def table(path: str) -> PieceTable:
    return PieceTable(path)


def marked(text: str) -> str:
    return MARK + text.replace(" ", MARK) if text else ""


def encode_block(texts: list[str], path: str) -> list[np.ndarray]:
    """Ids of each text."""
    pieces = table(path)
    if not pieces.exact:
        return [np.asarray(x, np.int32) for x in pieces.model.encode(texts)]
    number: dict[str, int] = {}
    places = [np.fromiter((number.setdefault(w, len(number)) for w in WORD.findall(marked(t))), np.int32) for t in texts]
    words = sorted(number)
    lengths, flat = np.zeros(len(number), np.int64), []
    order = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    for k, found in zip(order, pieces.encode_sorted(words), strict=True):
        lengths[k] = len(found)
        flat += found
    starts = np.zeros(len(number), np.int64)
    if len(order):
        starts[order] = np.r_[0, np.cumsum(lengths[order])[:-1]]
    flat = np.asarray(flat, np.int32)
    out = []
    for p in places:
        n = lengths[p]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        out.append(flat[np.repeat(starts[p] - (ends - n), n) + np.arange(total)] if total else np.zeros(0, np.int32))
    return out


def decode(ids: np.ndarray, path: str) -> str:
    """The text of ids: pieces and bytes joined, without the mark that encoding put in front."""
    surface = table(path).surface
    text = b"".join(map(surface.__getitem__, ids.tolist())).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, limit=TRIE_BYTES):
            ids = encode_block(strings(block), path)
            step = max(1, 2_000_000 * len(ids) // max(1, sum(map(len, ids))))
            for i in range(0, len(ids), step):
                part = ids[i : i + step]
                offsets = pa.array(np.r_[0, np.cumsum([len(x) for x in part])].astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(part)))
                texts = strings(block.slice(i, len(part)))
                same = pa.array([decode(x, path) == t.replace(MARK, " ") for x, t in zip(part, texts, strict=True)])
                yield pa.RecordBatch.from_arrays([*block.slice(i, len(part)).columns[:-1], lists, same], names=[*block.schema.names[:-1], "token_ids", "round_trip"])

    return run


def _digest(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, limit=TRIE_BYTES):
            texts = strings(block)
            ids = encode_block(texts, path)
            decoded = [decode(x, path) for x in ids]
            sha = lambda b: hashlib.sha256(b).hexdigest()
            yield pa.RecordBatch.from_arrays(
                [block.column(0), pa.array(map(len, ids), pa.int64()), pa.array([sha(x.astype("<u4").tobytes()) for x in ids]), pa.array([sha(x.encode()) for x in decoded]), pa.array([a == b.replace(MARK, " ") for a, b in zip(decoded, texts, strict=True)])],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"],
            )

    return run


def encode_texts(docs: DataFrame, path: str | None = None, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns ``keep``, token_ids array<int>, and round_trip: whether they decode to the text."""
    path = path or vocab.default_path("piece_bpe_32k.model")
    source = docs.select(*keep, body(text_col).alias("text"))
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(_encode(path), f"{kept}, token_ids array<int>, round_trip boolean")


def decode_ids(encoded: DataFrame, path: str | None = None, keep: tuple[str, ...] = ("doc_id",), ids_col: str = "token_ids") -> DataFrame:
    """The columns ``keep`` and the text of the ids."""
    path = path or vocab.default_path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decode(np.asarray(x or [], np.int32), path) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*batch.schema.names[:-1], "text"])

    source = encoded.select(*keep, ids_col)
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{kept}, text string")


def op8_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Length and digest of the ids, digest of the decoded text, and whether it equals the text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = vocab.default_path("piece_bpe_32k.model")
    source = docs.select(F.col("doc_id").cast("long"), body().alias("text"))
    return source.mapInArrow(_digest(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean")
