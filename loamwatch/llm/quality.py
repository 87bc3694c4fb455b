"""Quality rules with adaptive thresholds.

Each document gets exact integer measures. Mergeable quantile sketches (histograms whose bucket keeps the six
leading bits of a value: exact below 64, within 1/32 above; adding counts merges them) are built per language
and source; coarser sketches are their sums. There is no fixed cutoff: a document fails if a measure lies beyond the
fences of its group, high + fence * spread or (for word length) below low - fence * spread, where low and high are two
quantiles of the group's sketch, given for each measure, and spread is their distance. A group in which a measure
hardly varies has a spread of PRIOR / sqrt(documents) at least, which vanishes as the group grows. Groups with fewer
than ``min_group`` documents use the sketch of their language, or of everything.

Null texts have no words; very long texts are measured whole; null languages and sources form groups of their own;
repeated rows count each; equal values share a bucket, so ties have one verdict. An empty table gives an empty result.
Only id, text, language and source are read, so other columns can't clash. Everything is built-in SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loamwatch.llm.common import body, words_of
from loamwatch.staging import staged

#: Measures per mille (word length: tenths of a code point): low and high quantile in percent, fence, and whether low values are bad too.
#: Repeats are absent from most documents, so their fences stand on the few that have some.
RULES = {"symbols": (25, 75, 6, False), "dup_lines": (50, 99, 1, False), "repeats": (50, 95, 6, False), "word_chars10": (25, 75, 6, True)}
PRIOR = 100
MIN_GROUP = 50
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _covered(hashes: Column) -> Column:
    """Positions covered by 3-position windows whose hash is found twice or more: sort by hash, keep equal neighbours, add up the union."""
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    alike = lambda s: F.filter(s, lambda e, i: (F.get(s, i - 1)["h"] == e["h"]) | (F.get(s, i + 1)["h"] == e["h"]))
    places = _let(pairs, lambda s: F.sort_array(F.transform(alike(s), lambda e: e["p"])))
    steps = lambda p: F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3))))
    return _let(places, lambda p: F.aggregate(steps(p), F.lit(0), lambda a, x: a + x))


def measures(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and the exact measures of each whole text."""
    text = F.col("_text")
    split = docs.select(*keep, body("text").alias("_text")).withColumn("_words", words_of(text))
    n = F.size("_words")
    word = lambda i: F.get("_words", i)
    windows = F.when(n > 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(word(i), word(i + 1), word(i + 2))))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    shaped = split.select(
        *keep,
        n.cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        windows.alias("_h"),
        lines.alias("_lines"),
    )
    repeats = F.when(F.size(F.array_distinct("_h")) < F.size("_h"), _covered(F.col("_h"))).otherwise(0)
    return shaped.select(
        *keep,
        "n_words",
        "word_chars",
        "n_symbols",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeats.cast("long").alias("n_repeat_words"),
    )


def _rate(part: str, whole: str, scale: int) -> Column:
    return F.when(F.col(whole) > 0, F.expr(f"{scale} * {part} div {whole}")).otherwise(F.lit(0).cast("long"))


def rates() -> dict[str, Column]:
    return {
        "symbols": _rate("n_symbols", "word_chars", 1000),
        "dup_lines": _rate("n_dup_lines", "n_lines", 1000),
        "repeats": _rate("n_repeat_words", "n_words", 1000),
        "word_chars10": _rate("word_chars", "n_words", 10),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def bucket(value: str) -> str:
    """SQL: a non-negative integer with all but its six leading bits cleared."""
    shift = f"greatest(0, length(bin({value})) - 6)"
    return f"shiftleft(shiftright({value}, {shift}), {shift})"


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n): the histograms; sums over sources merge them."""
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), v.alias("value")) for k, v in rates().items()]))
    long = measured.select("lang", "source", rows.alias("m")).select("lang", "source", "m.measure", F.expr(bucket("m.value")).alias("bucket"))
    return long.groupBy("lang", "source", "measure", "bucket").agg(F.count("*").alias("n"))


def fences(hist: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, docs, least and most allowed value of each measure) from merged sketches."""
    merged = hist.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    group = W.partitionBy(*keys, "measure")
    running = merged.withColumn("upto", F.sum("n").over(group.orderBy("bucket"))).withColumn("all", F.sum("n").over(group))
    of = lambda k: F.element_at(F.create_map(*[F.lit(x) for m, r in RULES.items() for x in (m, r[k])]), F.col("measure"))
    at = lambda k: F.min(F.when(F.col("upto") * 100 >= F.col("all") * of(k), F.col("bucket")))
    per = running.groupBy(*keys, "measure").agg(at(0).alias("low"), at(1).alias("high"), F.max("all").alias("docs"))
    spread = F.greatest(F.col("high") - F.col("low"), F.floor(PRIOR / F.sqrt("docs")))
    per = per.withColumns({"least": F.col("low") - of(2) * spread, "most": F.col("high") + of(2) * spread})
    limit = lambda c, m: F.max(F.when(F.col("measure") == m, F.col(c))).alias(f"{c}_{m}")
    return per.groupBy(*keys).agg(F.max("docs").alias("docs"), *[limit(c, m) for m in RULES for c in ("least", "most")])


def limits(hist: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """(lang, source, least and most of each measure): of the group, or of the language or everything where the group is small."""
    fine, coarse, whole = fences(hist, ["lang", "source"]), fences(hist, ["lang"]), fences(hist, [])
    both = fine.alias("f").join(coarse.alias("c"), F.expr("f.lang <=> c.lang")).crossJoin(F.broadcast(whole).alias("w"))  # one row
    pick = lambda m: F.when(F.col("f.docs") >= min_group, F.col(f"f.{m}")).when(F.col("c.docs") >= min_group, F.col(f"c.{m}")).otherwise(F.col(f"w.{m}")).alias(m)
    return both.select(F.col("f.lang").alias("lang"), F.col("f.source").alias("source"), *[pick(f"{c}_{m}") for m in RULES for c in ("least", "most")])


def verdicts(measured: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """``measured`` with base_failed and kept. Limits of all groups are joined, not broadcast by force: Spark sees their size."""
    hist = staged(sketches(measured), "quality-sketches")
    joined = measured.alias("d").join(limits(hist, min_group).alias("l"), F.expr("d.lang <=> l.lang AND d.source <=> l.source"), "left")
    bad = F.lit(False)
    for m, rate in rates().items():
        bad = bad | (rate > F.col(f"most_{m}"))
        if RULES[m][3]:
            bad = bad | (rate < F.col(f"least_{m}"))
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~bad).select("d.*", "base_failed", "kept")


def quality(docs: DataFrame, keep: list[str] | None = None, min_group: int = MIN_GROUP) -> DataFrame:
    """One row a document: ``keep`` columns (doc_id, lang, source by default), measures, base_failed, kept."""
    keep = keep or ["doc_id", "lang", "source"]
    return verdicts(staged(measures(docs, keep), "quality-measures"), min_group)


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality(docs).select("doc_id", *MEASURES, "base_failed", "kept")


def _sql_bucket(v: str) -> str:
    return f"(({v} >> greatest(0, length(bin({v})) - 6)) << greatest(0, length(bin({v})) - 6))"


_RULES_SQL = "(VALUES " + ", ".join(f"('{m}', {low}, {high}, {fence})" for m, (low, high, fence, _) in RULES.items()) + ") AS r(measure, q_low, q_high, fence)"
_LIMITS = [f"{c}_{m}" for m in RULES for c in ("least", "most")]
_BAD = " OR ".join([f"{m} > most_{m}" for m in RULES] + [f"{m} < least_{m}" for m, r in RULES.items() if r[3]])


def _sql_fences(keys: str) -> str:
    k = f"{keys}, " if keys else ""
    cols = ", ".join(f"max({c}) FILTER (WHERE measure = '{m}') AS {c}_{m}" for m in RULES for c in ("least", "most"))
    return f"""SELECT {k}max(docs) AS docs, {cols} FROM (SELECT *, low - fence * greatest(high - low, floor({PRIOR} / sqrt(docs))) AS least, high + fence * greatest(high - low, floor({PRIOR} / sqrt(docs))) AS most FROM (
    SELECT {k}measure, any_value(fence) AS fence, min(bucket) FILTER (WHERE upto * 100 >= n_all * q_low) AS low, min(bucket) FILTER (WHERE upto * 100 >= n_all * q_high) AS high, max(n_all) AS docs
    FROM (SELECT {k}measure, bucket, sum(n) OVER (PARTITION BY {k}measure ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {k}measure) AS n_all
          FROM (SELECT {k}measure, bucket, sum(n) AS n FROM hist GROUP BY ALL)) JOIN {_RULES_SQL} USING (measure) GROUP BY {k}measure)) {'GROUP BY ' + keys if keys else ''}"""


ORACLE = rf"""
WITH split AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), windows AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM split)
), repeated AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM repeated, (VALUES (0), (1), (2)) AS v(k) GROUP BY doc_id
), measured AS (
  SELECT s.doc_id, lang, source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM split s LEFT JOIN covered c ON s.doc_id = c.doc_id
), rated AS (
  SELECT *, CASE WHEN word_chars > 0 THEN 1000 * n_symbols // word_chars ELSE 0 END AS symbols,
         CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines ELSE 0 END AS dup_lines,
         CASE WHEN n_words > 0 THEN 1000 * n_repeat_words // n_words ELSE 0 END AS repeats,
         CASE WHEN n_words > 0 THEN 10 * word_chars // n_words ELSE 0 END AS word_chars10
  FROM measured
), hist AS (
  SELECT lang, source, measure, {_sql_bucket('v')} AS bucket, count(*) AS n
  FROM (UNPIVOT rated ON symbols, dup_lines, repeats, word_chars10 INTO NAME measure VALUE v) GROUP BY ALL
), fine AS ({_sql_fences('lang, source')}), coarse AS ({_sql_fences('lang')}), whole AS ({_sql_fences('')}),
limits AS (
  SELECT f.lang, f.source, {', '.join(f'CASE WHEN f.docs >= {MIN_GROUP} THEN f.{m} WHEN c.docs >= {MIN_GROUP} THEN c.{m} ELSE w.{m} END AS {m}' for m in _LIMITS)}
  FROM fine f JOIN coarse c ON f.lang IS NOT DISTINCT FROM c.lang, whole w
)
SELECT doc_id, {', '.join(MEASURES)}, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT ({_BAD}) AS kept
FROM rated r LEFT JOIN limits l ON r.lang IS NOT DISTINCT FROM l.lang AND r.source IS NOT DISTINCT FROM l.source
"""
