"""Benchmark decontamination with SimHash windows.

Words are runs of letters and digits, lower-cased; shingles are five words (an item with fewer words is one
shingle). A document is compared with a benchmark item through windows as long as the item, placed so that the item
lies on the diagonal of a shared shingle, or that the window starts or ends with a shared shingle. In whatever order
the shingles are, a best window is among these: one that starts with an unshared shingle loses nothing by a step to
the right. Windows with too few shared shingles for the similarity, of whatever item, are left out. Each window gets a 64-bit SimHash of its shingles. Eight blocks of eight bits index the items' SimHashes: two
codes that differ in up to ``radius`` (23) bits differ in at most two bits of some block, and every block value
within two bits of an item's is in the index, so all codes within the radius are found. Then the exact weighted
similarity decides: the shared shingles, by their counts in window and item, over all (at least 0.8).

Null texts have no words and match nothing; items without words match nothing. Items with equal words are all
reported. Rows with the same id and text are one document. Empty tables give an empty result.
Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamwatch.llm.common import keyed
from loamwatch.staging import staged

SIZE, RADIUS, LEAST = 5, 23, 0.8
BLOCKS, BITS = 8, 8
#: Rows of the item tables up to which they are sent to every task; larger ones are joined by a shuffle.
BROADCAST_ROWS = 500_000


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _shingles(words: str, size: int) -> Column:
    """Hashes of all runs of ``size`` words, in order; null if there are fewer words."""
    at = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)])
    return F.when(F.size(words) >= size, F.transform(F.sequence(F.lit(0), F.size(words) - size), at))


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _simhash(tokens: str, counts: str) -> Column:
    """Aggregate: a bit is set if it is in over half of the weighted hashes."""
    total = F.sum(counts)
    bits = [F.when(2 * F.sum(F.when(F.expr(f"shiftright({tokens}, {b}) & 1 = 1"), F.col(counts)).otherwise(0)) > total, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")) for b in range(64)]
    code = bits[0]
    for b in range(1, 64):
        code = code.bitwiseOR(F.shiftleft(bits[b], b))
    return code


def _profiles(runs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, code, bag) from (keys, shingles): SimHash, and the bag of shingles as a set of (shingle, repeat) hashes."""
    counted = runs.select(*keys, F.explode("shingles").alias("h")).groupBy(*keys, "h").agg(F.count("*").alias("c"))
    repeats = F.transform(F.sequence(F.lit(1).cast("long"), F.col("c")), lambda k: F.xxhash64("h", k))
    return counted.withColumn("r", repeats).groupBy(*keys).agg(F.sum("c").alias("n"), _simhash("h", "c").alias("code"), F.flatten(F.collect_list("r")).alias("bag"))


def _block(code: str, b: str) -> str:
    return f"cast(shiftright({code}, {BITS} * {b}) & {(1 << BITS) - 1} as int)"


def near_values() -> list[int]:
    """Differences of at most RADIUS // BLOCKS bits in a block."""
    return [v for v in range(1 << BITS) if v.bit_count() <= RADIUS // BLOCKS]


def _starts(hits: DataFrame, least: float) -> DataFrame:
    """(row_key, k, m, start): windows to compare, from (row_key, k, m, total, p, q): shingle p of a text of ``total`` is shingle q of an item of m.

    A window starts or ends with a shared shingle, or the item lies on the diagonal of one. Only those stay whose
    number of shared shingles, of any items of m, allows the similarity.
    """
    keys = ["row_key", "k", "m"]
    clamped = lambda at: F.greatest(F.lit(0), F.least(at, F.col("total") - F.col("m")))
    at = F.array(clamped(F.col("p") - F.col("q")), clamped(F.col("p")), clamped(F.col("p") - F.col("m") + 1))
    starts = hits.select(*keys, "total", F.explode(at).alias("start")).distinct()
    shared = hits.select(*keys, "p").distinct().select(*keys, F.col("p").alias("at"), F.lit(1).alias("one"), F.lit(None).cast("int").alias("total"), F.lit(None).cast("int").alias("start"), F.lit(0).alias("sign"))
    # shared shingles inside = those before the end of the window, less those before its start
    end = lambda place, sign: F.struct(place.alias("at"), F.lit(sign).alias("sign"))
    ends = starts.select(*keys, "total", "start", F.explode(F.array(end(F.col("start"), -1), end(F.col("start") + F.col("m"), 1))).alias("e"))
    ends = ends.select(*keys, "e.at", F.lit(0).alias("one"), "total", "start", "e.sign")
    before = F.sum("one").over(Window.partitionBy(*keys).orderBy("at").rangeBetween(Window.unboundedPreceding, -1))
    counted = shared.unionByName(ends).withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("sign") != 0)
    inside = counted.groupBy(*keys, "total", "start").agg(F.sum(F.col("sign") * F.col("before")).alias("n"))
    return inside.where(F.col("n") / (F.least("total", "m") + F.col("m") - F.col("n")) >= least).select(*keys, "start")


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row_key, item_id, similarity, distance, first_word, n_windows): the best window of each document and item."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text"), F.lit("")).alias("t")).distinct()
    items = items.select("item_id", _words(F.col("t")).alias("w")).where(F.size("w") > 0)
    k = F.least(F.size("w"), F.lit(SIZE))
    pick = F.when(F.size("w") >= SIZE, _shingles("w", SIZE))
    for short in range(1, SIZE):
        pick = pick.when(F.size("w") == short, _shingles("w", short))
    items = staged(items.select("item_id", k.alias("k"), pick.alias("shingles")), "bench-items")
    sizes = [r["k"] for r in items.select("k").distinct().collect()]  # at most five values
    kinds = items.groupBy("k", "shingles").agg(F.min("item_id").alias("kind"))
    kinds = staged(kinds.select("kind", "k", "shingles", F.size("shingles").alias("m")), "bench-kinds")
    seeds = staged(kinds.select("k", "m", F.posexplode("shingles").alias("q", "h")).distinct(), "bench-seeds")
    n_seeds, n_kinds = seeds.count(), kinds.count()

    source = keyed(docs, id_col, text_col).select("doc_id", "row_key", "text")
    hits = None
    for size in sizes:
        hashed = source.select("row_key", _words(F.col("text")).alias("w")).select("row_key", _shingles("w", size).alias("all"))
        # posexplode_outer: Spark would add a filter that computes the hashes twice to the inner form
        rows = hashed.select("row_key", F.size("all").alias("total"), F.posexplode_outer("all").alias("p", "h"))
        hit = rows.join(_bounded(seeds.where(F.col("k") == size), n_seeds), "h").select("row_key", F.lit(size).alias("k"), "m", "total", "p", "q")
        hits = hit if hits is None else hits.unionByName(hit)
    if hits is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, row_key long, item_id long, similarity double, distance int, first_word int, n_windows long")
    found = staged(_starts(staged(hits, "bench-hits"), least), "bench-starts")
    by_text = staged(found.groupBy("row_key", "k").agg(F.collect_list(F.struct("m", "start")).alias("at")), "bench-texts")
    n_texts = found.count()
    places = None
    for size in sizes:
        texts = source.join(_bounded(by_text.where(F.col("k") == size), n_texts), "row_key")
        hashed = texts.select("doc_id", "row_key", "at", _words(F.col("text")).alias("w")).select("doc_id", "row_key", "at", _shingles("w", size).alias("all"))
        placed = hashed.select("doc_id", "row_key", "all", F.explode("at").alias("a"))
        cut = placed.select("doc_id", "row_key", F.lit(size).alias("k"), "a.m", "a.start", F.slice("all", F.col("a.start") + 1, F.col("a.m")).alias("shingles"))
        places = cut if places is None else places.unionByName(cut)
    windows = staged(places.groupBy("doc_id", "row_key", "k", "m", "start").agg(F.first("shingles").alias("shingles")), "bench-windows")
    seen = staged(_profiles(windows, ["doc_id", "row_key", "k", "m", "start"]), "bench-profiles")

    index = staged(_profiles(kinds, ["kind", "k", "m"]), "bench-index")
    values = F.array(*[F.lit(v) for v in near_values()])
    b = F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("b")
    entries = index.select("kind", "k", "m", F.col("code").alias("item_code"), b).withColumn("d", F.explode(values))
    entries = entries.select("kind", "k", "m", "item_code", "b", F.expr(_block("item_code", "b")).bitwiseXOR(F.col("d")).alias("value"))
    probes = seen.select("doc_id", "row_key", "k", "m", "start", "code", b)
    probes = probes.withColumn("value", F.expr(_block("code", "b")))
    gap = F.bit_count(F.col("code").bitwiseXOR(F.col("item_code")))
    pairs = probes.join(_bounded(entries, n_kinds * BLOCKS * len(near_values())), ["k", "m", "b", "value"]).where(gap <= RADIUS)
    pairs = pairs.select("doc_id", "row_key", "k", "m", "start", "kind", gap.alias("distance")).distinct()

    bags = seen.select("doc_id", "row_key", "k", "m", "start", "n", "bag").alias("s")
    on = F.col("s.doc_id").eqNullSafe(F.col("p.doc_id"))
    for c in ("row_key", "k", "m", "start"):
        on = on & (F.col(f"s.{c}") == F.col(f"p.{c}"))
    both = pairs.alias("p").join(bags, on).select("p.*", "s.n", "s.bag").join(_bounded(index.select("kind", F.col("n").alias("item_n"), F.col("bag").alias("item_bag")), n_kinds * 100), "kind")
    shared = F.size(F.array_intersect("bag", "item_bag"))
    similarity = shared / (F.col("n") + F.col("item_n") - shared)
    best = both.withColumn("similarity", similarity).where(F.col("similarity") >= least)
    best = best.groupBy("doc_id", "row_key", "kind").agg(F.max_by(F.struct("similarity", "distance", "start"), F.struct("similarity", -F.col("distance"), -F.col("start"))).alias("b"), F.count("*").alias("n_windows"))
    # all items with the words of the kind
    names = items.join(kinds.select("kind", "k", "shingles"), ["k", "shingles"]).select("kind", "item_id")
    return best.join(names, "kind").select("doc_id", "row_key", "item_id", "b.similarity", "b.distance", F.col("b.start").alias("first_word"), "n_windows")


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return contaminated(read("documents"), read("benchmark")).select("doc_id", "item_id", "similarity", "distance", "first_word", "n_windows")
