"""What the corpus operators share: defaults for missing values, blocks of bounded size, row identity."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  makes pa.compute available
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamwatch.staging import staged

#: ASCII blank characters, as in [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
#: Python tasks take texts in blocks of about so many bytes.
BLOCK_BYTES = 8 << 20
#: Words or shingles of the texts whose pairs a task compares at a time.
AT_ONCE = 1 << 20
#: Rows of the table that tells which texts are in no pair; the more pairs, the less it tells.
BUCKETS = 1 << 19


def body(text_col: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, row_key, text) and the columns ``keep``: row_key is a hash of the text, so that rows that share an id or lack one stay apart.

    Rows equal in both id and text are the same document; other columns are not carried.
    """
    text = body(text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("row_key"), text.alias("text"), *keep)


def same_row(left: str, right: str) -> Column:
    """Join condition on the row identity of two aliased tables; null ids are equal."""
    return F.col(f"{left}.doc_id").eqNullSafe(F.col(f"{right}.doc_id")) & (F.col(f"{left}.row_key") == F.col(f"{right}.row_key"))


def words_of(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ in order."""
    return F.array_remove(F.split(text, BLANK_RUN), "")


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches into runs of rows whose texts have about ``limit`` bytes; a longer text is a block of its own."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(batch.schema.get_field_index(column)).cast(pa.binary())).fill_null(0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if batch.num_rows > start:
            yield batch.slice(start)


def raw(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of a text column."""
    return batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()


def strings(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return batch.column(batch.schema.get_field_index(column)).to_pylist()


def word_hashes(text: bytes) -> np.ndarray:
    """A hash of each word, A-Z lower-cased."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, text.lower().split()), np.uint64)


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k words."""
    n = len(words) - k + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = (out ^ words[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out


def _blocks_of_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (a, b, n) -> (a, b, block): runs of pairs that weigh about AT_ONCE."""
    from pyspark import TaskContext

    base, before = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        ends = before + np.cumsum(batch.column(2).to_numpy())
        before = int(ends[-1]) if len(ends) else before
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(base + ends // AT_ONCE)], names=["a", "b", "block"])


def pairs_with_texts(pairs: DataFrame, docs: DataFrame, make: Callable[[bytes], bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(block, a, b, data) of pairs (a, b, n) of row keys: rows of texts (b is null, data is made of the text), then the pairs of a block.

    Pairs are cut into blocks by their weights n, and a text goes to each block once, not to each pair; so a text in
    very many pairs is read by several tasks, and a task holds one block.
    """
    spark = pairs.sparkSession
    ordered = pairs.repartitionByRange("a", "b").sortWithinPartitions("a", "b").select("a", "b", "n")
    cut = staged(ordered.mapInArrow(_blocks_of_pairs, "a long, b long, block long"), "pair-blocks")
    sides = cut.select("block", F.explode(F.array("a", "b")).alias("row_key")).distinct()
    # texts in no pair mostly stay where they are: a table of BUCKETS rows at most tells them
    bucket = F.pmod("row_key", F.lit(BUCKETS)).alias("bucket")
    wanted = F.broadcast(sides.select(bucket).distinct())
    texts = keyed(docs, id_col, text_col).withColumn("bucket", bucket).join(wanted, "bucket", "left_semi").drop("bucket")
    # both sides grow with the data, so these are merge joins at every size
    texts = texts.join(sides.select("row_key").distinct().hint("merge"), "row_key", "left_semi")
    texts = texts.groupBy("row_key").agg(F.first("text").alias("text"))  # exact copies are one text

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array([make(t) for t in raw(block)], pa.binary())], names=["row_key", "data"])

    data = sides.hint("merge").join(texts.mapInArrow(made, "row_key long, data binary"), "row_key").select("block", F.col("row_key").alias("a"), F.lit(None).cast("long").alias("b"), "data")
    rows = data.unionByName(cut.select("block", "a", "b", F.lit(None).cast("binary").alias("data")))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), cut.select("block").distinct().count())
    return rows.repartition(parts, "block").sortWithinPartitions("block", F.col("b").isNotNull())
