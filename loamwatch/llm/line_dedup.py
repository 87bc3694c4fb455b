"""Line dedup: range-partitioned line hashes, a secondary sort, and keep bitmaps per document.

Lines never travel: a 128-bit hash of each line's key is sorted with its document and position, hot lines
spread over several range partitions because the document is part of the range key. A task streams its sorted
rows; only the first and the last key of a partition can continue in another one, so only those are settled by
a small table of partial counts (two rows a partition).

Null or empty texts have one empty line; empty keys never drop. Rows with the same id and the same text are one
document; rows with a null id are told apart by their text. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamwatch.llm.common import BLANKS, blocks, keyed, raw, same_row
from loamwatch.staging import staged

_BLANKS = BLANKS.encode()
_LINES = "h1 long, h2 long, doc_id long, row_key long, pos int"
_MARKS = "kind int, h1 long, h2 long, doc_id long, row_key long, pos int, n long"
DROP, OPEN, COUNT = 0, 1, 2
_MARK_SCHEMA = pa.schema([("kind", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("row_key", pa.int64()), ("pos", pa.int32()), ("n", pa.int64())])


def line_key(line: bytes) -> bytes:
    """Blanks stripped at both ends, A-Z lower-cased."""
    return line.strip(_BLANKS).lower()


def _hash_lines(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            digests, rows, places = [], [], []
            for i, text in enumerate(raw(block)):
                for pos, line in enumerate(text.split(b"\n")):
                    key = line_key(line)
                    if key and (min_chars <= 1 or len(key.decode()) >= min_chars):
                        digests.append(xxhash.xxh3_128_digest(key))
                        rows.append(i)
                        places.append(pos)
            if rows:
                h = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                take = pa.array(rows, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), block.column(0).take(take), block.column(1).take(take), pa.array(places, pa.int32())],
                    names=["h1", "h2", "doc_id", "row_key", "pos"],
                )

    return run


def _changed(*columns: np.ndarray) -> np.ndarray:
    """True where a row differs from the row before it; the first is True."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = False
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


class _Run:
    """The key that is open at the end of a batch."""

    def __init__(self, first: bool, row: tuple):
        self.first, self.head, self.docs, self.held, self.hot = first, row, 0, [], False


def _stream(min_docs: int, keep_first: bool):
    """Reads rows sorted by key, document and position; emits rows to drop, rows that another partition decides, and partial counts."""

    def marks(kind: int, frame: pd.DataFrame, n: int = 0) -> pa.RecordBatch:
        out = frame[["h1", "h2", "doc_id", "row_key", "pos"]].copy()
        out["kind"], out["n"] = np.int32(kind), np.int64(n)
        return pa.RecordBatch.from_pandas(out, schema=_MARK_SCHEMA, preserve_index=False)

    def close(run: _Run, last: bool) -> Iterator[pa.RecordBatch]:
        head = pd.DataFrame([run.head], columns=["h1", "h2", "doc_id", "row_key", "pos"]).astype({"doc_id": "Int64"})
        if run.first or last:
            if run.first or not run.hot:
                for part in run.held:
                    yield marks(OPEN, part)
            elif run.hot:
                yield marks(OPEN, head)
            yield marks(COUNT, head, run.docs)
        elif run.hot and not keep_first:
            yield marks(DROP, head)

    def run_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, before = None, None
        for batch in batches:
            frame = batch.to_pandas(integer_object_nulls=False, types_mapper={pa.int64(): pd.Int64Dtype()}.get)
            if not len(frame):
                continue
            h1, h2, key = (frame[c].to_numpy(np.int64) for c in ("h1", "h2", "row_key"))
            ids, null = frame["doc_id"].fillna(0).to_numpy(np.int64), frame["doc_id"].isna().to_numpy()
            new_key = _changed(h1, h2)
            new_doc = new_key | _changed(ids, null, key)
            now = (h1[0], h2[0]), (h1[0], h2[0], ids[0], null[0], key[0])
            if before is not None:
                new_key[0], new_doc[0] = now[0] != before[0], now[1] != before[1]
            before = (h1[-1], h2[-1]), (h1[-1], h2[-1], ids[-1], null[-1], key[-1])
            starts = np.flatnonzero(new_key)
            if len(starts) == 0 or starts[0] > 0:
                starts = np.r_[0, starts]
            ends = np.r_[starts[1:], len(frame)]
            docs = np.add.reduceat(new_doc.astype(np.int64), starts)
            # keys that begin and end inside this batch
            inner = np.arange(len(starts))[(np.arange(len(starts)) > 0) & (np.arange(len(starts)) < len(starts) - 1)]
            inner = inner[docs[inner] >= min_docs]
            if len(inner):
                yield marks(DROP, frame.iloc[np.concatenate([np.arange(starts[i] + keep_first, ends[i]) for i in inner])])
            for i in sorted({0, len(starts) - 1}):
                part = frame.iloc[starts[i] : ends[i]]
                if new_key[starts[i]]:
                    if run is not None:
                        yield from close(run, last=False)
                    run = _Run(run is None, tuple(None if pd.isna(v) else int(v) for v in part.iloc[0][["h1", "h2", "doc_id", "row_key", "pos"]]))
                run.docs += int(docs[i])
                if run.first:
                    yield marks(OPEN, part)
                    continue
                if run.hot:
                    yield marks(DROP, part)
                    continue
                run.held.append(part)
                if run.docs >= min_docs:
                    run.hot = True
                    held = pd.concat(run.held).iloc[1:]
                    run.held = []
                    if len(held):
                        yield marks(DROP, held)
        if run is not None:
            yield from close(run, last=True)

    return run_partition


def _pack(dropped: np.ndarray) -> bytes:
    """Bits of kept lines up to the last dropped one (all later lines stay), compressed."""
    keep = np.ones(int(dropped.max()) + 1, np.uint8)
    keep[dropped] = 0
    return zlib.compress(np.packbits(keep, bitorder="little").tobytes() + len(keep).to_bytes(8, "little"), 1)


def unpack(bitmap: bytes | None) -> np.ndarray:
    """The keep flags of a bitmap; lines beyond its end stay."""
    if bitmap is None:
        return np.zeros(0, np.uint8)
    data = zlib.decompress(bitmap)
    return np.unpackbits(np.frombuffer(data[:-8], np.uint8), bitorder="little")[: int.from_bytes(data[-8:], "little")]


def line_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row_key, n_dropped, keep_bitmap) of the documents that lose lines.

    A key found in at least ``min_docs`` documents loses all its lines, or all but the first occurrence in
    (document, position) order with ``keep_first``.
    """
    lines = staged(keyed(docs, id_col, text_col).mapInArrow(_hash_lines(min_chars), _LINES), "lines")
    order = ["h1", "h2", "doc_id", "row_key", "pos"]
    ranged = lines.repartitionByRange(*[F.col(c) for c in order[:4]]).sortWithinPartitions(*order)
    marked = staged(ranged.mapInArrow(_stream(min_docs, keep_first), _MARKS), "line-marks")
    # two rows a partition at most: small whatever the input
    settled = (
        marked.where(F.col("kind") == COUNT)
        .groupBy("h1", "h2")
        .agg(F.sum("n").alias("docs"), F.min(F.struct("doc_id", "row_key", "pos")).alias("head"))
        .where(F.col("docs") >= min_docs)
    )
    waiting = marked.where(F.col("kind") == OPEN).join(F.broadcast(settled), ["h1", "h2"])
    if keep_first:
        waiting = waiting.where(~F.struct("doc_id", "row_key", "pos").eqNullSafe(F.col("head")))
    dropped = marked.where(F.col("kind") == DROP).select("doc_id", "row_key", "pos").unionByName(waiting.select("doc_id", "row_key", "pos"))

    @F.pandas_udf("binary")
    def bitmap(places: pd.Series) -> pd.Series:
        return places.map(lambda p: _pack(np.asarray(p)))

    per_doc = dropped.groupBy("doc_id", "row_key").agg(F.collect_set("pos").alias("places"))
    return per_doc.select("doc_id", "row_key", F.size("places").cast("long").alias("n_dropped"), bitmap("places").alias("keep_bitmap"))


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns to keep, then text and keep_bitmap -> the same columns, n_lines, n_dropped, kept_text."""
    for block in blocks(batches):
        texts, counts, gone = [], [], []
        for text, bits in zip(raw(block), raw(block, "keep_bitmap"), strict=True):
            lines = text.split(b"\n")
            counts.append(len(lines))
            flags = unpack(bits)
            kept = lines if not len(flags) else [x for x, k in zip(lines, flags, strict=False) if k] + lines[len(flags) :]
            gone.append(len(lines) - len(kept))
            texts.append(text if not len(flags) else b"\n".join(kept))
        yield pa.RecordBatch.from_arrays(
            [*block.columns[:-2], pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())],
            names=[*block.schema.names[:-2], "n_lines", "n_dropped", "kept_text"],
        )


def drop_lines(docs: DataFrame, bitmaps: DataFrame, keep: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row_key, keep..., n_lines, n_dropped, kept_text) of every row."""
    d, b = keyed(docs, id_col, text_col, keep).alias("d"), bitmaps.alias("b")
    joined = d.join(b, same_row("d", "b"), "left").select("d.doc_id", "d.row_key", *[f"d.{c}" for c in keep], "d.text", "b.keep_bitmap")
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in joined.schema.fields[:-2])
    return joined.mapInArrow(_apply, f"{kept}, n_lines long, n_dropped long, kept_text string")


def line_dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents without their repeated lines."""
    return drop_lines(docs, line_bitmaps(docs, min_docs, min_chars, keep_first, id_col, text_col), (), id_col, text_col)


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


_AZ, _az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLE = rf"""
WITH lines AS (
  SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_AZ}', '{_az}') AS k
  FROM lines
), hot AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE k IN (FROM hot)))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE k NOT IN (FROM hot)), '')) AS kept_sha256
FROM keyed GROUP BY doc_id
"""
