"""Token ids in a content-addressed store.

Layout under one folder (Parquet files, written and read by Spark alone):

* ``chunks``: (address, n_ids, payload). A rolling hash over eight ids cuts each document's id stream into
  chunks of 64 to 8192 ids, about 1,100 on average; the address is the BLAKE2b digest of the raw chunk. Each
  address is stored once. Payload: one byte for the width of an id (2 or 4), then the ids, little-endian, zstd.
* ``recipes``: (doc_id, start, n_tokens, addresses, lengths, root), files and rows in ascending doc_id order;
  ``start`` counts the ids of all documents before. ``root`` is the Merkle root of the addresses.
* ``manifest``: (part, run, documents, ids, root), for each run of documents of a part a digest over their roots.

Reading checks every chunk against its address and every recipe against its root, and fails loudly;
``verify_manifest`` lists runs of recipes that differ from the manifest.

Null texts are empty and have the end id alone. Rows are ordered by id, then by a hash of the text; nulls come
first; repeated rows are stored each. Very long texts are blocks of their own and many chunks. Other columns aren't
read, so they can't clash. An empty table gives empty tables.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loamwatch.llm import vocab
from loamwatch.llm.common import blocks, keyed
from loamwatch.staging import discard, stage_path, staged

WINDOW, LEAST, MOST, CUT_BITS = 8, 64, 8192, 10
#: Letters before this one are Latin.
LATIN = "ɐ"
#: The one of them that lower-cases to a letter and a mark.
DOTTED = "İ"
#: The vocabulary's letter of each byte: printable ones stand for themselves, the others follow from 256 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTES = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}
#: Words whose ids a worker remembers, and text bytes that it takes at a time.
REMEMBERED, BLOCK = 250_000, 12 << 20
_ENCODED = "doc_id long, row_key long, n_tokens long, addresses array<binary>, lengths array<int>, root binary, chunks array<struct<address: binary, n_ids: int, payload: binary>>"
#: Payloads are compressed and all different, and a task's row group is held in memory.
_FILES = {"compression": "uncompressed", "parquet.enable.dictionary": "false", "parquet.block.size": str(16 << 20)}
_CHUNK = pa.struct([("address", pa.binary()), ("n_ids", pa.int32()), ("payload", pa.binary())])


def digest(data: bytes | memoryview) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; a level's odd last node moves up as it is."""
    level = leaves or [b""]
    level = [digest(b"\0" + x) for x in level]
    while len(level) > 1:
        pairs = [digest(b"\1" + level[i] + level[i + 1]) for i in range(0, len(level) - 1, 2)]
        level = pairs + level[len(pairs) * 2 :]
    return level[0]


class WordIds:
    """Ids of blank-separated words; a word's ids depend on the word alone."""

    def __init__(self, path: str):
        self.library, self.added = vocab.tokenizer(path), vocab.added_strings(path)
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.kind = "H" if self.dtype.itemsize == 2 else "I"
        #: How few ids are packed, as most words have.
        self.pack = [struct.Struct(f"<{n}{self.kind}").pack for n in range(16)]
        #: Words met lately, and those met before; a full first table takes the place of the second.
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.tokenize = self.library.model.tokenize
        self.tails = {c: self.encode(c) for c in ".,"}

    def packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.kind}", *ids)

    def encode(self, text: str) -> bytes:
        return self.packed(self.library.encode(text, add_special_tokens=False).ids)

    def letters(self, word: str) -> bytes:
        """Ids of Latin letters: they are one pre-token, so the merges can run on the word's bytes at once."""
        if not word.isascii():
            word = word.lower().encode().decode("latin-1").translate(BYTES)
        ids = [t.id for t in self.tokenize(word)]
        return self.pack[len(ids)](*ids) if len(ids) < 16 else self.packed(ids)

    def of(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words without A-Z."""
        if len(self.known) > REMEMBERED:
            self.before, self.known = self.known, {}
        known, before, tails = self.known, self.before, self.tails
        found = list(map(known.get, words))
        others: dict[str, str] = {}
        for i, v in enumerate(found):
            if v is not None:
                continue
            w = words[i]
            v = before.get(w)
            if v is None and (w.isascii() or (max(w) < LATIN and DOTTED not in w)):
                if w.isalpha():
                    v = self.letters(w)
                elif w[-1:] in tails and w[:-1].isalpha():
                    v = self.letters(w[:-1]) + tails[w[-1]]
            if v is None:
                # a full stop or comma behind a plain letter is a token of its own
                others[w] = w[:-1] if w[-1:] in tails and w[-2:-1].isalpha() and w[-2] < LATIN and w[-2] != DOTTED else w
            else:
                known[w] = found[i] = v
        stems, ids = list(dict.fromkeys(others.values())), {}
        for i in range(0, len(stems), 10_000):
            part = stems[i : i + 10_000]
            for s, e in zip(part, self.library.encode_batch_fast(part, add_special_tokens=False), strict=True):
                ids[s] = self.packed(e.ids)
        for w, s in others.items():
            known[w] = ids[s] if len(s) == len(w) else ids[s] + tails[w[-1]]
        return [known[w] if v is None else v for w, v in zip(words, found, strict=True)]


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def encode_texts(texts: pa.Array, path: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts of a block, one behind the other, each with the end id; and where each text ends."""
    words = word_ids(path)
    end = np.asarray([end_id], words.dtype).tobytes()
    lower = pc.ascii_lower(texts)  # the vocabulary is lower case
    # texts with an added token's string go to the library whole, each as one word
    odd = np.zeros(len(texts), bool)
    for token in words.added:
        odd |= pc.match_substring(lower, token.lower()).to_numpy(zero_copy_only=False)
    # capitals tell these words from all others, which are lower case
    whole = {f"TEXT{i}": words.encode(texts[int(i)].as_py()) for i in np.flatnonzero(odd)}
    if whole:
        lower = pc.replace_with_mask(lower, pa.array(odd), pa.array(list(whole), pa.string()))
    split = pc.ascii_split_whitespace(lower)
    offsets = split.offsets.to_numpy()
    offsets = offsets - offsets[0]
    coded = split.flatten().dictionary_encode()
    vocabulary = coded.dictionary.to_pylist()
    known = [*words.of(vocabulary), end]
    if whole:
        known = [whole.get(w, k) for w, k in zip([*vocabulary, None], known, strict=True)]
    codes = np.insert(coded.indices.to_numpy(zero_copy_only=False), offsets[1:], len(vocabulary))
    doc_ends = offsets[1:] + np.arange(1, len(offsets))  # in codes, behind the end id
    taken = pa.array(known, pa.binary()).take(pa.array(codes))
    ends = np.frombuffer(taken.buffers()[1], np.int32)[1 : len(taken) + 1]
    ids = np.frombuffer(taken.buffers()[2] or b"", np.uint8)[: int(ends[-1]) if len(ends) else 0].view(words.dtype)
    return ids, ends[doc_ends - 1].astype(np.int64) // words.dtype.itemsize


def cuts(ids: np.ndarray, doc_ends: np.ndarray) -> np.ndarray:
    """Where chunks end: at document ends, and where the hash of the last eight ids says so."""
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    rolled = np.zeros(len(ids), np.uint64)
    for k in range(min(WINDOW, len(ids))):
        rolled[k:] = rolled[k:] + mixed[: len(ids) - k] * np.uint64(pow(0xD6E8FEB86659FD93, k, 1 << 64))
    wanted = np.flatnonzero(rolled >> np.uint64(64 - CUT_BITS) == 0) + 1
    out, at, w = [], 0, 0
    wanted = wanted.tolist()
    for end in doc_ends.tolist():
        while at < end:
            while w < len(wanted) and wanted[w] < at + LEAST:
                w += 1
            stop = min(end, at + MOST, wanted[w] if w < len(wanted) else end)
            out.append(stop)
            at = stop
    return np.asarray(out, np.int64)


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        seen: set[bytes] = set()  # what slips through is dropped later
        pack = zstandard.ZstdCompressor(level=1)
        for block in blocks(batches, limit=BLOCK):
            if len(seen) > REMEMBERED:
                seen.clear()
            ids, ends = encode_texts(block.column(2).cast(pa.string()), path, end_id)
            stops = cuts(ids, ends)
            width = ids.dtype.itemsize
            raw, tag = memoryview(ids.tobytes()), bytes([ids.dtype.itemsize])
            keys = [digest(raw[a:b]) for a, b in zip([0, *(stops[:-1] * width).tolist()], (stops * width).tolist(), strict=True)]
            sizes = np.diff(np.r_[0, stops])
            # chunks of document i: counts[i] of them
            last = np.searchsorted(stops, ends, side="right")
            new, new_ends = [], []
            at = 0
            for end in last.tolist():
                for k in range(at, end):
                    if keys[k] not in seen:
                        seen.add(keys[k])
                        new.append(k)
                new_ends.append(len(new))
                at = end
            bounds = [0, *last.tolist()]
            roots = [merkle(keys[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
            payloads = [tag + pack.compress(raw[(stops[k] - sizes[k]) * width : stops[k] * width]) for k in new]
            fresh = pa.StructArray.from_arrays([pa.array([keys[k] for k in new], pa.binary()), pa.array(sizes[new], pa.int32()), pa.array(payloads, pa.binary())], fields=list(_CHUNK))
            offsets = lambda x: pa.array(np.r_[0, x].astype(np.int32))
            columns = [
                block.column(0), block.column(1), pa.array(np.diff(np.r_[0, ends]), pa.int64()),
                pa.ListArray.from_arrays(offsets(last), pa.array(keys, pa.binary())),
                pa.ListArray.from_arrays(offsets(last), pa.array(sizes, pa.int32())),
                pa.array(roots, pa.binary()),
                pa.ListArray.from_arrays(offsets(np.asarray(new_ends)), fresh),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row_key", "n_tokens", "addresses", "lengths", "root", "chunks"])

    return run


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each address; rows are sorted by address, and all of an address are in one partition."""
    before = None
    for batch in batches:
        keep = []
        for key in batch.column(0).to_pylist():
            keep.append(key != before)
            before = key
        yield batch.filter(pa.array(keep, pa.bool_()))


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the running count of ids within the partition, rows sorted by id."""
    before = 0
    for batch in batches:
        ends = before + np.cumsum(batch.column(2).to_numpy())
        starts = np.r_[before, ends[:-1]] if len(ends) else np.zeros(0, np.int64)
        before = int(ends[-1]) if len(ends) else before
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(starts, pa.int64())], names=[*batch.schema.names, "local_start"])


def write_store(docs: DataFrame, store: str, path: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every whole text and writes chunks, recipes and manifest under ``store``."""
    path = path or vocab.default_path("word_bpe_49k.json")
    encoded = staged(keyed(docs, id_col, text_col).mapInArrow(_encode(path, end_id), _ENCODED), "token-ids", **_FILES)
    chunks = encoded.select(F.explode("chunks").alias("c")).select("c.address", "c.n_ids", "c.payload")
    chunks.repartition("address").sortWithinPartitions("address").mapInArrow(_once, "address binary, n_ids int, payload binary").write.options(**_FILES).parquet(f"{store}/chunks")
    recipes = encoded.select("doc_id", "row_key", "n_tokens", "addresses", "lengths", "root")
    ordered = recipes.repartitionByRange("doc_id", "row_key").sortWithinPartitions("doc_id", "row_key")
    numbered = ordered.mapInArrow(_number, "doc_id long, row_key long, n_tokens long, addresses array<binary>, lengths array<int>, root binary, local_start long")
    numbered = staged(numbered.withColumn("part", F.spark_partition_id()), "recipes")
    # one row a part: the parts' sizes and where each begins
    parts = numbered.groupBy("part").agg(F.count("*").alias("documents"), F.sum("n_tokens").alias("ids"))
    offsets = parts.select("part", (F.sum("ids").over(W.orderBy("part")) - F.col("ids")).alias("offset"))
    placed = numbered.join(F.broadcast(offsets), "part").select("part", "doc_id", (F.col("offset") + F.col("local_start")).alias("start"), "n_tokens", "addresses", "lengths", "root")
    # files are numbered along the ranges, and starts rise with the order of documents
    placed.repartitionByRange("start").sortWithinPartitions("start").write.parquet(f"{store}/recipes")
    _manifest(docs.sparkSession.read.parquet(f"{store}/recipes")).write.parquet(f"{store}/manifest")
    discard(numbered)
    discard(encoded)


def _manifest(recipes: DataFrame) -> DataFrame:
    """Counts and a root for each run of documents in a part."""
    run = F.floor(F.col("start") / (1 << 22))  # so many ids
    return recipes.groupBy("part", run.alias("run")).agg(F.count("*").alias("documents"), F.sum("n_tokens").alias("ids"), F.sort_array(F.collect_list(F.struct("start", "root"))).alias("roots")).select(
        "part", "run", "documents", "ids", F.sha2(F.concat_ws("", F.transform("roots", lambda r: F.hex(r["root"]))), 256).alias("root")
    )


_POLY = np.uint32(0xEDB88320)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials modulo the CRC-32 polynomial, bit 31 being x^0."""
    a, b, out = a.copy(), b.copy(), np.zeros_like(b)
    for _ in range(32):
        out ^= np.where(a & np.uint32(0x80000000), b, np.uint32(0))
        a <<= np.uint32(1)
        b = (b >> np.uint32(1)) ^ np.where(b & np.uint32(1), _POLY, np.uint32(0))
    return out


def shifted_crc(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """What each crc becomes by ``n_bytes`` more bytes; the crc of a whole is the xor of its parts' shifted ones."""
    n = n_bytes.astype(np.uint64)
    factor = np.full(len(crc), 0x80000000, np.uint32)
    power = np.full(1, 0x00800000, np.uint32)  # x^8
    while n.any():
        factor = np.where(n & np.uint64(1), _times(factor, np.broadcast_to(power, factor.shape)), factor)
        power = _times(power, power)
        n >>= np.uint64(1)
    return _times(factor, crc.astype(np.uint32))


def _check_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        crcs = []
        for key, n, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            data = unpack.decompress(payload[1:], max_output_size=n * payload[0])
            if digest(data) != key or len(data) != n * payload[0]:
                raise ValueError(f"chunk {key.hex()} does not hold what its address says")
            crcs.append(zlib.crc32(np.frombuffer(data, f"<u{payload[0]}").astype("<u4").tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(crcs, pa.int64())], names=["address", "n_ids", "crc"])


def read_digests(spark: SparkSession, store: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files: chunks are read once each, and their crcs combined along the recipes."""
    recipes = spark.read.parquet(f"{store}/recipes").select("doc_id", "start", "n_tokens", "addresses", "lengths", "root")
    chunks = spark.read.parquet(f"{store}/chunks").select("address", "n_ids", "payload").mapInArrow(_check_chunks, "address binary, n_ids int, crc long")
    steps = recipes.mapInArrow(_suffixes, "doc_id long, start long, n_tokens long, address binary, length long, behind long")
    joined = steps.join(chunks, "address", "left").select("doc_id", "start", "n_tokens", "length", "behind", "n_ids", "crc")
    shifted = joined.mapInArrow(_shift, "doc_id long, start long, n_tokens long, length long, part long")
    found = shifted.groupBy("doc_id", "start", "n_tokens").agg(F.bit_xor("part").alias("ids_crc32"), F.sum("length").alias("read"))
    return found.select("doc_id", "start", F.when(F.col("read") == F.col("n_tokens"), F.col("n_tokens")).otherwise(F.raise_error(F.lit("a document is not whole"))).cast("long").alias("n_tokens"), "ids_crc32")


def _shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.column(6).null_count or not pc.all(pc.equal(batch.column(3), batch.column(5).cast(pa.int64()))).as_py() and batch.num_rows:
            raise ValueError("a chunk is missing or has another length than its recipe says")
        part = shifted_crc(batch.column(6).to_numpy(), batch.column(4).to_numpy())
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(part.astype(np.int64))], names=["doc_id", "start", "n_tokens", "length", "part"])


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Recipes, checked against their roots, as one row a chunk: (doc_id, start, n_tokens, address, length, bytes behind it)."""
    for batch in batches:
        lists, sizes = batch.column(3), batch.column(4)
        bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py() if batch.num_rows else np.zeros(1, np.int64)
        counts = np.diff(bounds)
        keys = lists.flatten().to_pylist()
        for a, b, root in zip(bounds, bounds[1:], batch.column(5).to_pylist(), strict=False):
            if merkle(keys[a:b]) != root:
                raise ValueError("a recipe does not match its root")
        rows = np.repeat(np.arange(batch.num_rows), counts)
        length = sizes.flatten().to_numpy().astype(np.int64)
        ends = np.cumsum(length)
        total = np.repeat(ends[np.cumsum(counts) - 1], counts) if len(ends) else ends
        take = pa.array(rows)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(take), batch.column(1).take(take), batch.column(2).take(take), lists.flatten(), pa.array(length, pa.int64()), pa.array(4 * (total - ends), pa.int64())],
            names=["doc_id", "start", "n_tokens", "address", "length", "behind"],
        )


def _join_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, start, n_tokens, chunks in order) -> the ids of each document."""
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        out = []
        for n_tokens, chunks in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            parts = []
            for c in chunks:
                if c["payload"] is None:
                    raise ValueError("a chunk is missing")
                width, n = c["payload"][0], c["n_ids"]
                data = unpack.decompress(c["payload"][1:], max_output_size=n * width)
                if digest(data) != c["address"]:
                    raise ValueError(f"chunk {c['address'].hex()} does not hold what its address says")
                parts.append(np.frombuffer(data, f"<u{width}"))
            ids = np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, np.int32)
            if len(ids) != n_tokens:
                raise ValueError("a document is not whole")
            out.append(ids)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.list_(pa.int32()))], names=["doc_id", "start", "n_tokens", "ids"])


def read_ids(spark: SparkSession, store: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids array<int>): the ids of every document, put together from its recipe."""
    recipes = spark.read.parquet(f"{store}/recipes").select("doc_id", "start", "n_tokens", F.posexplode("addresses").alias("k", "address"))
    joined = recipes.join(spark.read.parquet(f"{store}/chunks"), "address", "left")
    grouped = joined.groupBy("doc_id", "start", "n_tokens").agg(F.array_sort(F.collect_list(F.struct("k", "address", "n_ids", "payload"))).alias("chunks"))
    return grouped.mapInArrow(_join_chunks, "doc_id long, start long, n_tokens long, ids array<int>")


def verify_manifest(spark: SparkSession, store: str) -> DataFrame:
    """Rows of the manifest that the recipes don't match; empty if all is well."""
    now, then = _manifest(spark.read.parquet(f"{store}/recipes")), spark.read.parquet(f"{store}/manifest")
    return then.exceptAll(now).unionByName(now.exceptAll(then))


def op10_token_ids(spark, sf_dir: str) -> DataFrame:
    store = stage_path(spark, "token-store")
    write_store(spark.read.parquet(f"{sf_dir}/documents.parquet"), store)
    if not verify_manifest(spark, store).isEmpty():
        raise ValueError("recipes and manifest differ")
    return read_digests(spark, store)
