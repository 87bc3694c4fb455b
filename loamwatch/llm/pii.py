"""Personal data: patterns of four kinds, and identifiers that their contexts give away.

The patterns' matches are the seeds. Every other word with a digit or an at sign is a candidate. Occurrences of
both are linked to lexical patterns: the word before, the word behind, and both. Spark scores the graph of
patterns and instances in rounds, until a round reveals nothing: a pattern's confidence for a kind is the share of its occurrences that carry an
instance believed to be of that kind, where unbelieved ones that look like the kind count a quarter; patterns above ``least_confidence`` with ``least_support`` distinct
instances make further instances believed, if those look like the kind at all. Candidates found so are added
as spans of the kind; seeds always stay.

Matches are rows, not arrays that grow: their places are running sums over the row's gaps and matches, and what
overlaps a base span is seen in two more passes over the sorted rows, so a text of very many matches takes as many
steps. A context reaches back over one further match and ahead over one, NEAR code points at most.

Null texts are empty; rows with the same id and text are one document, and each such row is returned; rows with a
null id are told apart by their text. Of kinds with equal score the one listed first wins. Other columns aren't read,
so they can't clash. An empty table gives an empty result. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loamwatch.llm.common import keyed
from loamwatch.staging import staged

KINDS = ("email", "ip", "card", "phone")
#: Possessive groups match as greedy ones do here, without recursion on long texts. An e-mail's local part starts
#: where the last match ended or where its run of characters starts, so a long run is scanned once.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
WORD = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
BYTE = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: Code points of context kept on each side.
NEAR = 64
CONFIDENCE, SUPPORT = 0.9, 5
#: Rounds end when one reveals no token; so many without an end are an error.
ROUNDS = 100
#: Weight against a pattern of an unbelieved instance that looks like its kind.
DOUBT = 0.25
WORDS = len(KINDS)
_PIECES = "array<struct<k:int,i:int,gap:int,head:string,tail:string,token:string>>"


def _let(value: Column, use) -> Column:
    return F.element_at(F.transform(F.array(value), use), 1)


def _pieces(text: Column, pattern: str, k: int) -> Column:
    """Leftmost non-overlapping matches of a pattern, each with the gap before it (its length, both ends); the last gap has no match."""

    def piece(g: Column, m: Column) -> Column:
        return F.struct(F.length(g).alias("gap"), F.left(g, F.lit(NEAR)).alias("head"), F.right(g, F.lit(NEAR)).alias("tail"), m.alias("token"))

    number = lambda x, i: F.struct(F.lit(k).alias("k"), i.alias("i"), x["gap"].alias("gap"), x["head"].alias("head"), x["tail"].alias("tail"), x["token"].alias("token"))
    rows = lambda m: F.transform(F.zip_with(F.split(text, pattern, -1), m, piece), number)
    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) > 0, rows(m)).otherwise(F.array().cast(_PIECES)))


def _digits(token: Column) -> Column:
    return F.regexp_replace(token, "[^0-9]", "")


def _holds() -> Column:
    """Whether a match keeps the further rules of its kind."""
    k, token, n = F.col("k"), F.col("token"), F.length(_digits(F.col("token")))
    return (
        F.when(k == 1, token.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$"))
        .when(k == 2, n.between(12, 19) & F.call_function("luhn_check", _digits(token)))
        .when(k == 3, n.between(9, 15))
        .otherwise(F.lit(True))
    )


def _looks_like(kind: Column, token: Column) -> Column:
    """A loose shape that a discovered identifier must have."""
    n = F.length(_digits(token))
    return (
        F.when(kind == "email", F.contains(token, F.lit("@")))
        .when(kind == "ip", token.rlike(r"[0-9]+[.:][0-9]+[.:][0-9]"))
        .when(kind == "card", n.between(12, 19))
        .otherwise(n.between(7, 15))
    )


def _joined(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["k"] + 1), s["start"], s["stop"])), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row_key, k, start, stop, token, before, behind): base spans, and candidates (k = WORDS) that touch none."""
    text, none = F.col("text"), F.array().cast(_PIECES)
    parts = F.concat(
        F.when(F.contains(text, F.lit("@")), _pieces(text, EMAIL, 0)).otherwise(none), _pieces(text, IP, 1), _pieces(text, CARD, 2),
        F.when(F.contains(text, F.lit("+")), _pieces(text, PHONE, 3)).otherwise(none), F.when(text.rlike("[0-9@]"), _pieces(text, WORD, WORDS)).otherwise(none),
    )
    doc = ["doc_id", "row_key"]
    found = keyed(docs, id_col, text_col).select(*doc, F.explode(parts).alias("p")).select(*doc, "p.*")
    found = found.repartition(*doc).dropDuplicates([*doc, "k", "i"])  # repeated rows are one document
    order = W.partitionBy(*doc, "k").orderBy("i")
    length = F.coalesce(F.length("token"), F.lit(0))
    near = lambda *parts: F.concat(*[F.coalesce(p, F.lit("")) for p in parts])
    placed = found.withColumns({
        "stop": F.sum(F.col("gap") + length).over(order).cast("int"),
        "before": F.right(near(F.lag("tail").over(order), F.right(F.lag("token").over(order), F.lit(NEAR)), F.col("tail")), F.lit(NEAR)),
        "behind": F.left(near(F.lead("head").over(order), F.left(F.lead("token").over(order), F.lit(NEAR)), F.lead("head", 2).over(order)), F.lit(NEAR)),
    })
    placed = placed.where(F.col("token").isNotNull() & _holds()).withColumn("start", F.col("stop") - F.length("token"))
    base = lambda c: F.when(F.col("k") < WORDS, F.col(c))
    so_far = W.partitionBy(*doc).orderBy("start", "k").rowsBetween(W.unboundedPreceding, -1)
    to_come = W.partitionBy(*doc).orderBy(F.desc("start"), F.desc("k")).rowsBetween(W.unboundedPreceding, -1)
    placed = placed.withColumn("reach", F.max(base("stop")).over(so_far)).withColumn("next", F.last(base("start"), ignorenulls=True).over(to_come))
    apart = (F.coalesce("reach", F.lit(0)) <= F.col("start")) & (F.coalesce(F.col("next") >= F.col("stop"), F.lit(True)))
    return placed.where((F.col("k") < WORDS) | apart).select(*doc, "k", "start", "stop", "token", "before", "behind")


def _occurrences(scanned: DataFrame) -> DataFrame:
    """(doc_id, row_key, start, stop, token, k, pattern): k is the kind of a seed, null for a candidate; one row a pattern."""
    left = F.lower(F.regexp_extract("before", r"([^\x20\x09-\x0D]+)[\x20\x09-\x0D]*$", 1))
    right = F.lower(F.regexp_extract("behind", r"^[\x20\x09-\x0D]*([^\x20\x09-\x0D]+)", 1))
    one = scanned.select("doc_id", "row_key", "start", "stop", F.lower("token").alias("token"), F.when(F.col("k") < WORDS, F.col("k")).alias("k"), left.alias("l"), right.alias("r"))
    patterns = F.array(F.when(F.col("l") != "", F.concat(F.lit("L "), "l")), F.when(F.col("r") != "", F.concat(F.lit("R "), "r")), F.when((F.col("l") != "") & (F.col("r") != ""), F.concat_ws(" ", F.lit("B"), "l", "r")))
    return one.select("doc_id", "row_key", "start", "stop", "token", "k", F.explode(F.array_compact(patterns)).alias("pattern"))


def discover(occurrences: DataFrame, least_confidence: float = CONFIDENCE, least_support: int = SUPPORT, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, row_key, start, k, stop): candidates that confident patterns reveal."""
    edges = staged(occurrences.groupBy("pattern", "token").agg(F.max("k").alias("k"), F.count("*").alias("n")), "pii-edges")
    believed = edges.where(F.col("k").isNotNull()).groupBy("token").agg(F.max("k").alias("kind")).withColumn("score", F.lit(1.0))
    confident = None
    for _ in range(rounds):  # ends when nothing new is believed
        scored = edges.select("pattern", "token", "n").join(believed, "token", "left")
        totals = scored.groupBy("pattern").agg(F.sum("n").alias("all"))
        per_kind = scored.where(F.col("kind").isNotNull()).groupBy("pattern", "kind").agg(F.sum(F.col("n") * F.col("score")).alias("mass"), F.countDistinct("token").alias("support"))
        per_kind = per_kind.where(F.col("support") >= least_support)
        # what isn't believed yet but looks like the kind is what is sought: it counts less against a pattern
        doubts = scored.where(F.col("kind").isNull()).select("pattern", "token", "n", F.explode(F.array(*[F.lit(k) for k in range(len(KINDS))])).alias("kind"))
        doubts = doubts.where(_looks_like(F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1), F.col("token"))).groupBy("pattern", "kind").agg(F.sum("n").alias("doubt"))
        weighed = per_kind.join(totals, "pattern").join(doubts, ["pattern", "kind"], "left")
        whole = F.col("all") - (1 - DOUBT) * F.coalesce("doubt", F.lit(0))
        confident = weighed.select("pattern", "kind", (F.col("mass") / whole).alias("confidence")).where(F.col("confidence") >= least_confidence)
        confident = staged(confident, "pii-patterns")
        reached = edges.where(F.col("k").isNull()).select("pattern", "token").join(confident, "pattern")
        reached = reached.where(_looks_like(F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1), F.col("token")))
        # noisy or over the patterns of the best kind
        fresh = reached.groupBy("token", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-6)))))).alias("score"))
        fresh = fresh.groupBy("token").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind"), F.max("score").alias("score"))
        fresh = staged(fresh.join(believed.select("token"), "token", "left_anti"), "pii-fresh")
        if fresh.isEmpty():
            break
        believed = staged(believed.unionByName(fresh), "pii-believed")
    else:
        raise RuntimeError(f"patterns still reveal new tokens after {rounds} rounds")
    found = occurrences.where(F.col("k").isNull()).join(confident, "pattern").join(believed.select("token", "kind"), ["token", "kind"])
    found = found.where(_looks_like(F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1), F.col("token")))
    return found.select("doc_id", "row_key", "start", F.col("kind").alias("k"), "stop").distinct()


def personal_data(docs: DataFrame, least_confidence: float = CONFIDENCE, least_support: int = SUPPORT, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row_key, base, added): arrays of spans (start, k, stop), k being the place of the kind in KINDS."""
    scanned = staged(scan(docs, id_col, text_col), "pii-spans")
    occurrences = staged(_occurrences(scanned), "pii-occurrences")
    spans = lambda df, name: df.groupBy("doc_id", "row_key").agg(F.array_sort(F.collect_list(F.struct("start", "k", "stop"))).alias(name)).withColumnsRenamed({"doc_id": f"{name}_id", "row_key": f"{name}_key"})
    base, added = spans(scanned.where(F.col("k") < WORDS), "base"), spans(discover(occurrences, least_confidence, least_support, rounds), "added")
    none = F.array().cast("array<struct<start:int,k:int,stop:int>>")
    every = keyed(docs, id_col, text_col).select("doc_id", "row_key")
    for table, name in ((base, "base"), (added, "added")):
        every = every.join(table, F.col("doc_id").eqNullSafe(F.col(f"{name}_id")) & (F.col("row_key") == F.col(f"{name}_key")), "left")
    return every.select("doc_id", "row_key", *[F.coalesce(c, none).alias(c) for c in ("base", "added")])


def op4_personal_data(spark, sf_dir: str) -> DataFrame:
    found = personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    # base spans alone are counted, so the counts don't depend on the contexts; a lambda's second parameter would be the element's index
    of_kind = lambda k: F.filter("base", lambda s: s["k"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"))
