"""Vector codes: each of eight parts of a vector becomes the index of its nearest codebook entry, found by ball k-means.

Components become whole numbers floor(scale * x), so all distances and sums are exact and results don't depend on
the order in which tasks add them.

Per part position, the parts of an entry are its ball. With d the squared distance of a part to the entry it had
in the round before, and D that between entries now:

* an entry's neighbours are those that its ball can lose a part to: half their distance is within the ball's radius.
  The radius is the largest d of the ball, known from the round before, plus what the entry moved since;
* a ball whose entry and neighbours didn't move keeps its parts unseen;
* parts with 4 d < D of the nearest neighbour are the stable core and keep their entry;
* the other parts lie in rings: with the neighbours in order of D, one is a candidate for a part if D <= 4 d. Only these
  are measured. Ties go to the lower index, so the bounds include equality.

One round is one pass: tasks read the vectors and their codes, write new codes beside the vectors, and at their end a
row with the count, sum and largest d of each entry. Those rows (one a task) are added up by Spark; the driver
gets the sums, as many as the codebook has components. Codes are staged as Parquet each round and the stage before is
deleted, so there are two copies at most, and a lost task is run again from files. Nothing is shuffled but sums.

Defined cases: rows with a null vector or a null or non-finite component have no code and are left out. Whole numbers
stop at +-2^24 (components beyond 4096 count as 4096 at scale 4096), so errors fit a long. Vectors of another length
than that of the row with the smallest id (nulls last, then by vector) can't be coded and are left out. If the length
isn't a multiple of the number of parts, cuts are at floor(part * length / parts); empty parts have code 0 and no error.
Fewer rows than entries: so many entries. Repeated rows and ids are coded each. Ids and labels may be null. Only the
id, vector and label columns (parameters) are read, so others can't clash; very long vectors are rows like others.
An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamwatch.staging import discard, staged

#: Largest whole number of a component.
MOST = 1 << 24
#: Rows that a task assigns at a time hold so many components.
AT_ONCE = 1 << 21
#: A label with at least a thousandth of all rows is hot; there are a thousand of them at most.
HOT_SHARE = 1000


@dataclass
class Codebook:
    """Entries (entry, component) of all parts, the cuts of the parts, and what the round before tells of the balls."""

    entries: np.ndarray
    cuts: list[int]
    moved: np.ndarray  # (part, entry): whether the entry moved since the parts were assigned
    radius: np.ndarray  # (part, entry): upper bound of the ball's radius around the entry as it is now

    @property
    def parts(self) -> int:
        return len(self.cuts) - 1

    def part(self, p: int) -> np.ndarray:
        return self.entries[:, self.cuts[p] : self.cuts[p + 1]]

    def between(self, p: int) -> np.ndarray:
        """Squared distances of the entries of a part."""
        e = self.part(p)
        return np.array([squares(e, x) for x in e]) if len(e) else np.zeros((0, 0), np.int64)

    def digest(self) -> str:
        """sha256 of all components by part, entry and position."""
        values = [str(v) for p in range(self.parts) for v in self.part(p).ravel().tolist()]
        return hashlib.sha256(",".join(values).encode()).hexdigest()


def squares(vectors: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """Squared distance of each vector to the entry."""
    gap = vectors - entry
    return np.einsum("ij,ij->i", gap, gap)


def neighbours(book: Codebook, p: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Of each entry: its ball's neighbours by distance, their squared distances, and whether the ball keeps its parts."""
    apart, found, far = book.between(p), [], []
    resting = np.zeros(len(apart), bool)
    for i, row in enumerate(apart):
        others = np.flatnonzero(np.sqrt(row.astype(float)) / 2 <= book.radius[p, i] * (1 + 1e-9) + 1e-6)
        others = others[others != i]
        others = others[np.argsort(row[others], kind="stable")]
        found.append(others)
        far.append(row[others])
        resting[i] = not book.moved[p, i] and not book.moved[p, others].any()
    return found, far, resting


def assign(vectors: np.ndarray, codes: np.ndarray, book: Codebook, p: int, near: tuple, measure: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """New codes of part p from those of the round before, squared distances, and how many distances between parts and entries were measured.

    Resting balls aren't measured (distance -1) unless ``measure``.
    """
    mine = vectors[:, book.cuts[p] : book.cuts[p + 1]]
    entries, (found, far, resting) = book.part(p), near
    best, dist, done = codes.copy(), np.full(len(codes), -1, np.int64), 0
    order = np.argsort(codes, kind="stable")
    ends = np.searchsorted(codes[order], np.arange(len(entries) + 1))
    for i in range(len(entries)):
        ball = order[ends[i] : ends[i + 1]]
        if not len(ball) or (resting[i] and not measure):
            continue
        d = squares(mine[ball], entries[i])
        done += len(ball)
        dist[ball] = d
        if resting[i] or not len(found[i]):
            continue
        rings = np.searchsorted(far[i], 4 * d, side="right")  # so many neighbours may be as near
        outside = rings > 0  # the rest is the stable core
        rim, rings, least, to = ball[outside], rings[outside], d[outside], np.full(outside.sum(), i)
        for k, j in enumerate(found[i]):
            within = np.flatnonzero(rings > k)
            if not len(within):
                break
            other = squares(mine[rim[within]], entries[j])
            done += len(within)
            better = (other < least[within]) | ((other == least[within]) & (j < to[within]))
            least[within[better]], to[within[better]] = other[better], j
        best[rim], dist[rim] = to, least
    return best, dist, done


_STATE = "vec_id long, label string, v binary, code binary, error long, sums binary"


def _round(book: Codebook, last: bool):
    """Tasks of one round: rows with new codes, and a row with the task's counts, sums and largest distances."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, parts, size = book.entries.shape[1], book.parts, len(book.entries)
        near = [neighbours(book, p) for p in range(parts)]
        count, largest = np.zeros((parts, size), np.int64), np.full((parts, size), -1, np.int64)
        total, measured, empty = np.zeros((size, width), np.int64), 0, True
        step = max(1, AT_ONCE // max(1, width))
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                batch, empty = whole.slice(start, step), False
                v = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<i4").reshape(-1, width).astype(np.int64)
                codes = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, parts).astype(np.int64)
                error, new = np.zeros(len(v), np.int64), np.empty_like(codes)
                for p in range(parts):
                    best, dist, n = assign(v, codes[:, p], book, p, near[p], last)
                    measured += n
                    new[:, p] = best
                    error += np.maximum(dist, 0)
                    count[p] += np.bincount(best, minlength=size)
                    np.maximum.at(largest[p], best, dist)
                    mine = v[:, book.cuts[p] : book.cuts[p + 1]]
                    order = np.argsort(best, kind="stable")
                    used, first = np.unique(best[order], return_index=True)
                    if len(used) and mine.shape[1]:
                        total[used, book.cuts[p] : book.cuts[p + 1]] += np.add.reduceat(mine[order], first, axis=0)
                packed = pa.array([x.tobytes() for x in new.astype(np.uint8)], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], packed, pa.array(error), pa.nulls(len(v), pa.binary())], names=_names(_STATE))
        if not empty:
            sums = np.concatenate([count.ravel(), largest.ravel(), [measured], total.ravel()]).astype("<i8").tobytes()
            none = lambda t: pa.nulls(1, t)
            yield pa.RecordBatch.from_arrays([none(pa.int64()), none(pa.string()), none(pa.binary()), none(pa.binary()), none(pa.int64()), pa.array([sums], pa.binary())], names=_names(_STATE))

    return run


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for raw in batch.column(0).to_pylist():
            values = np.frombuffer(raw, "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], names=["place", "value"])


def _totals(state: DataFrame, book: Codebook) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(count, largest distance, sum of components, distances measured) of all tasks: rows of one codebook's size come to the driver."""
    parts, size, cells = book.parts, len(book.entries), book.parts * len(book.entries)
    rows = state.where("sums IS NOT NULL").select("sums").mapInArrow(_unpack, "place long, value long")
    found = rows.groupBy("place").agg(F.sum("value").alias("sum"), F.max("value").alias("most")).collect()
    sums, most = np.zeros(2 * cells + 1 + book.entries.size, np.int64), np.full(2 * cells + 1, -1, np.int64)
    for place, total, top in found:
        sums[place] = total
        if place < len(most):
            most[place] = top
    return sums[:cells].reshape(parts, size), most[cells : 2 * cells].reshape(parts, size), sums[2 * cells + 1 :].reshape(size, -1), int(sums[2 * cells])


def _next(book: Codebook, count: np.ndarray, largest: np.ndarray, total: np.ndarray) -> Codebook:
    """Entries become the floor of their parts' mean; radii grow by the way that the entry moved."""
    entries, moved, radius = book.entries.copy(), np.zeros_like(book.moved), np.zeros_like(book.radius)
    for p in range(book.parts):
        a, b = book.cuts[p], book.cuts[p + 1]
        for i in range(len(entries)):
            if count[p, i]:
                entries[i, a:b] = total[i, a:b] // count[p, i]  # rounds down
            way = float(np.sqrt(float(squares(entries[i : i + 1, a:b], book.entries[i, a:b])[0])))
            moved[p, i] = way > 0
            # resting parts weren't measured: their bound from the rounds before holds
            measured = np.sqrt(float(largest[p, i])) if largest[p, i] >= 0 else 0.0
            kept = book.radius[p, i] if _rested(book, p, i) else 0.0
            radius[p, i] = max(measured, kept) + way
    return Codebook(entries, book.cuts, moved, radius)


def _rested(book: Codebook, p: int, i: int) -> bool:
    return bool(neighbours(book, p)[2][i])


def whole_numbers(vectors: DataFrame, scale: int, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, v array<int>) of the rows that can be coded; labels as text."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    number: Column = F.transform(v, lambda x: F.least(F.greatest(F.floor(x.cast("double") * scale), F.lit(-MOST)), F.lit(MOST)).cast("int"))
    return vectors.where(v.isNotNull() & finite).select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), number.alias("v"))


def _start(parts: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(2).flatten().to_numpy().astype("<i4").reshape(-1, width)
            n = len(values)
            code = pa.array([bytes(parts)] * n, pa.binary())
            packed = pa.array([x.tobytes() for x in values], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed, code, pa.array(np.zeros(n, np.int64)), pa.nulls(n, pa.binary())], names=_names(_STATE))

    return run


@dataclass
class Coded:
    """Result of ``compress``: rows (vec_id, label, code binary, error), the codebook, and the distances measured in each pass."""

    rows: DataFrame
    book: Codebook
    measured: list[int]


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> Coded:
    """Codes of all vectors by codebooks fitted to all of them."""
    ready = whole_numbers(vectors, scale, id_col, vector_col, label_col)
    order = [F.col("vec_id").asc_nulls_last(), F.col("v")]
    first = ready.select("vec_id", "v").orderBy(*order).limit(1).collect()
    width = len(first[0].v) if first else 0
    ready = ready.where(F.size("v") == width)
    start = [r.v for r in ready.select("vec_id", "v").orderBy(*order).limit(entries).collect()]  # so many rows
    cuts = [p * width // parts for p in range(parts + 1)]
    size = len(start)
    book = Codebook(np.array(start, np.int64).reshape(size, width), cuts, np.ones((parts, size), bool), np.full((parts, size), np.inf))
    measured: list[int] = []
    if not width or not size:
        empty = ready.select("vec_id", "label", F.lit(bytes(parts)).alias("code"), F.lit(0).cast("long").alias("error"))
        return Coded(empty, book, measured)
    state = ready.mapInArrow(_start(parts, width), _STATE)
    for k in range(rounds + 1):
        last = k == rounds
        after = staged(state.where("sums IS NULL").select(*_names(_STATE)).mapInArrow(_round(book, last), _STATE), "vector-codes")
        count, largest, total, done = _totals(after, book)
        discard(state)
        measured.append(done)
        state = after
        if not last:
            book = _next(book, count, largest, total)
    return Coded(state.where("sums IS NULL").select("vec_id", "label", "code", "error"), book, measured)


def label_errors(rows: DataFrame) -> DataFrame:
    """Adds label_error, the sum of error over the rows of equal label; nulls are together.

    Sums of hot labels, a thousand at most, go to all tasks; other labels' rows are joined by label, each a small share of all.
    """
    rows = rows.withColumn("_null", F.col("label").isNull()).withColumn("label", F.coalesce("label", F.lit("")))
    key = ["_null", "label"]
    sums = staged(rows.groupBy(*key).agg(F.sum("error").alias("label_error"), F.count("*").alias("_n")), "label-errors")
    least = (sums.agg(F.sum("_n")).first()[0] or 0) / HOT_SHARE
    hot = sums.where(F.col("_n") >= least).select(*key, "label_error")
    cold = sums.where(F.col("_n") < least).select(*key, F.col("label_error").alias("_cold"))
    tagged = rows.join(F.broadcast(hot), key, "left")
    few = tagged.where("label_error IS NULL").drop("label_error").join(cold.hint("merge"), key).withColumnRenamed("_cold", "label_error")
    both = tagged.where("label_error IS NOT NULL").unionByName(few)
    return both.withColumn("label", F.when(~F.col("_null"), F.col("label"))).drop("_null")


def op12_vector_codes(spark, sf_dir: str) -> DataFrame:
    coded = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    rows = label_errors(coded.rows)
    return rows.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(coded.book.digest()).alias("codebooks_sha256"))


def oracle(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """The same rounds in SQL, every part against every entry."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"a{k} AS MATERIALIZED (SELECT x.vec_id, x.part, any_value(x.v) AS v, min({{'d': list_sum([(t[1] - t[2]) * (t[1] - t[2]) for t in list_zip(x.v, c.v)])::BIGINT, 'e': c.entry}}) AS b FROM x JOIN c{k} c USING (part) GROUP BY 1, 2)")
        if k < rounds:
            steps.append(f"m{k} AS MATERIALIZED (SELECT part, entry, list(mean ORDER BY i) AS v FROM (SELECT part, b.e AS entry, i, floor(sum(v[i]) / count(*))::BIGINT AS mean FROM a{k}, (SELECT unnest(range(1, (SELECT max(len(v)) FROM x) + 1)) AS i) GROUP BY 1, 2, 3) GROUP BY 1, 2)")
            steps.append(f"c{k + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(m.v, c.v) AS v FROM c{k} c LEFT JOIN m{k} m USING (part, entry))")
    return f"""
WITH kept AS MATERIALIZED (SELECT vec_id, label, [floor({scale} * e::DOUBLE)::BIGINT for e in embedding] AS w FROM embeddings WHERE embedding IS NOT NULL AND len([e for e in embedding if e IS NULL OR NOT isfinite(e)]) = 0),
x AS MATERIALIZED (SELECT vec_id, part, w[part * len(w) // {parts} + 1:(part + 1) * len(w) // {parts}] AS v FROM kept, (SELECT unnest(range({parts})) AS part)),
c0 AS MATERIALIZED (SELECT part, r - 1 AS entry, v FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS r FROM kept) USING (vec_id) WHERE r <= {entries}),
{", ".join(steps)},
coded AS (SELECT vec_id, string_agg(format('{{:02x}}', b.e), '' ORDER BY part) AS code, sum(b.d)::BIGINT AS error FROM a{rounds} GROUP BY 1)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
 (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) FROM c{rounds}) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)"""


ORACLE = oracle()
