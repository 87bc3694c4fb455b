import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loamwatch.llm import line_dedup as L
from loamwatch.llm import quality as Q
from loamwatch.llm.common import BLANKS


def brute_lines(docs, least, keep_first):
    """docs: distinct (id, text) -> lines kept of each."""
    where = defaultdict(set)
    for d in docs:
        for line in (d[1] or "").split("\n"):
            where[line.strip(BLANKS).encode().lower()].add(d)
    first_seen, out = set(), {}
    for d in sorted(docs, key=lambda d: d[0]):
        kept = []
        for line in (d[1] or "").split("\n"):
            key = line.strip(BLANKS).encode().lower()
            if not key or len(where[key]) < least or (keep_first and key not in first_seen):
                kept.append(line)
            first_seen.add(key)
        out[d] = kept
    return out


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("parts", ["1", "7", "40"])
def test_lines_against_brute_force(spark, parts, keep_first):
    rng = random.Random(5)
    pool = ["Hot line", " hot LINE ", "warm", "cold a", "cold b", ""] + [f"rare {k}" for k in range(60)]
    docs = sorted({(i, "\n".join(rng.choices(pool, weights=[20, 5, 4, 2, 2, 3] + [1] * 60, k=rng.randint(0, 9)))) for i in range(150)})
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = L.line_dedup(spark.createDataFrame(docs, "doc_id long, text string"), 5, keep_first=keep_first).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = brute_lines(docs, 5, keep_first)
    texts = dict(docs)
    assert {r.doc_id: r.kept_text for r in got} == {d[0]: "\n".join(k) for d, k in want.items()}
    assert all(r.n_lines == texts[r.doc_id].count("\n") + 1 and r.n_dropped == r.n_lines - len(want[r.doc_id, texts[r.doc_id]]) for r in got)


def test_lines_of_odd_rows(odd, none):
    got = L.line_dedup(odd, 2).collect()
    assert len(got) == 11
    assert Counter(r.n_lines for r in got if r.kept_text == "" and r.n_dropped == 0)[1] == 3  # null, empty, null
    assert L.line_dedup(none).count() == 0
    assert L.line_dedup(odd, 2).where("doc_id IS NULL").count() == 2


def test_bitmap_round_trip():
    import numpy as np

    assert L.unpack(L._pack(np.array([0, 5]))).tolist() == [0, 1, 1, 1, 1, 0]
    assert len(L.unpack(None)) == 0


def brute_quality(text):
    text = text or ""
    words = text.encode().split()
    runs = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if runs[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(spark, odd, none):
    extra = odd.select("doc_id", "text", "lang", "source").union(spark.createDataFrame([(9, "a a a a", "x", "y"), (10, "a b c a b c # |", "x", "y"), (11, "x y z\nx y z\n\n", None, None)], "doc_id long, text string, lang string, source string"))
    for r in Q.quality(extra, ["doc_id", "text", "lang", "source"]).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_quality(r.text)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert Q.quality(none).count() == 0


def test_adaptive_limits_follow_the_group(spark):
    plain = "word " * 3 + " ".join(f"w{k}" for k in range(80))
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(80)), "en", "a") for i in range(200)] + [(1000, " ".join(f"v{k}$$$%%%" for k in range(80)), "en", "a")]
    got = {r.doc_id: r.kept for r in Q.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not got[1000] and all(got[i] for i in range(200)) and plain


def test_merged_sketches_equal_one_sketch(spark):
    rows = spark.range(5000).select(F.lit("l").alias("lang"), (F.col("id") % 7).cast("string").alias("source"), *[(F.col("id") * k % 991).alias(c) for k, c in ((3, "n_words"), (17, "word_chars"), (5, "n_symbols"), (7, "n_lines"), (2, "n_dup_lines"), (11, "n_repeat_words"))])
    parts, whole = Q.sketches(rows), Q.sketches(rows.withColumn("source", F.lit("all")))
    assert Q.fences(parts, ["lang"]).collect() == Q.fences(whole, ["lang"]).collect()


def test_limits_of_a_language_decide(spark):
    """The same text is usual in one language and far out in another; a larger group narrows its limits."""
    rng = random.Random(3)
    prose = lambda n: " ".join("x" * rng.randint(n - 1, n + 1) + str(rng.randint(0, 10**6)) for _ in range(80))
    rows = [(k, prose(3), "short") for k in range(200)] + [(1000 + k, prose(15), "long") for k in range(200)]
    rows += [(5000, rows[-1][1], "short"), (5001, rows[0][1], "long")]
    docs = spark.createDataFrame([(i, t, lang, "s") for i, t, lang in rows], "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in Q.quality(docs).collect()}
    assert not kept.pop(5000) and not kept.pop(5001) and all(kept.values())
    hist = lambda n: spark.createDataFrame([("a", "b", m, v, n) for m in Q.RULES for v in (0, 1)], "lang string, source string, measure string, bucket long, n long")
    small, large = (Q.fences(hist(n), ["lang"]).first() for n in (50, 500_000))
    assert small.most_symbols == 1 + 6 * 10 and large.most_symbols == 1 + 6 * 1
