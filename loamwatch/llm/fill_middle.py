"""Fill-in-middle: a counted-quantifier pattern cuts each whole text into prefix, middle and suffix in one match.

``regexp_count`` gives the number n of units (runs of A-Z and a-z, or single other code points). Two numbers a <= b from
0 to n are drawn from the hash of a seed and the id. The row's own pattern holds them as possessive counted groups,
``\\A(unit{a}+)(unit{b-a}+)(rest)\\z``: possessive groups are matched in a loop, without a stack, and never tried again,
so a text of any length is cut in linear time. The match's groups are put into the form's order by the same call.

Forms: plain (the text), psm (``<P>prefix<S>suffix<M>middle``), spm (``<S>suffix<P>prefix<M>middle``). Texts that are
empty or hold a marker stay plain, so markers in an output are those of the form and ``restore`` gives back the exact text.

All expressions are built-in ones: no shuffle, no Python workers, nothing kept from row to row, so a lost task is simply run again.

Null texts are empty and plain. A null id is hashed as an empty string. Repeated rows are cut alike. Very long texts are cut
whole. Only id and text are read (names are parameters), so other columns can't clash. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamwatch.llm.common import body

UNIT = "[A-Za-z]+|[^A-Za-z]"
#: The unit in a counted group: letters are taken whole, never given back.
_GROUP = "(?:[A-Za-z]++|[^A-Za-z])"
MARKERS = "<[PSM]>"
#: The form's order of the pattern's three groups.
_ORDERS = {"psm": "<P>$1<S>$3<M>$2", "spm": "<S>$3<P>$1<M>$2"}


def _draw(digest: Column, k: int) -> Column:
    """The k-th group of eight hex digits as a number."""
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, seed: str = "1", plain_from: int = 90, spm_below: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix, middle, suffix, output) of every row; the three parts are null in plain rows.

    Of 100 texts about ``plain_from`` are cut, and of 100 cut ones about ``spm_below`` have the suffix first.
    """
    text, key = F.col("_text"), F.col("doc_id")
    t = docs.select(F.col(id_col).cast("long").alias("doc_id"), body(text_col).alias("_text"))
    t = t.withColumns({"n": F.regexp_count(text, F.lit(UNIT)).cast("long"), "_hash": F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)})
    ends = [_draw(F.col("_hash"), k) % (F.col("n") + 1) for k in (1, 2)]
    plain = (text == "") | text.rlike(MARKERS) | (_draw(F.col("_hash"), 3) % 100 >= plain_from)
    form = F.when(plain, "plain").when(_draw(F.col("_hash"), 4) % 100 < spm_below, "spm").otherwise("psm")
    t = t.withColumns({"_a": F.least(*ends), "_b": F.greatest(*ends), "form": form})
    pattern = F.concat(F.lit(rf"\A({_GROUP}{{"), F.col("_a"), F.lit(rf"}}+)({_GROUP}{{"), F.col("_b") - F.col("_a"), F.lit(r"}+)((?s:.*))\z"))
    order = F.when(F.col("form") == "spm", _ORDERS["spm"]).otherwise(_ORDERS["psm"])
    t = t.withColumn("output", F.when(F.col("form") == "plain", text).otherwise(F.regexp_replace(text, pattern, order)))
    return _split(t).select("doc_id", "n", "form", *[F.get("_cut", place).alias(name) for name, place in _places().items()], "output")


def _split(cut: DataFrame) -> DataFrame:
    """Adds _cut, what stands between an output's markers. No text that was cut holds a marker, so the three markers are the cuts."""
    return cut.withColumn("_cut", F.when(F.col("form") != "plain", F.split("output", MARKERS, -1)))


def _places() -> dict[str, Column]:
    """Where each part stands in _cut."""
    spm = F.col("form") == "spm"
    return {"prefix": F.when(spm, 2).otherwise(1), "middle": F.lit(3), "suffix": F.when(spm, 1).otherwise(2)}


def restore(cut: DataFrame) -> DataFrame:
    """Adds ``restored``, the text as it was, from the columns output and form alone."""
    whole = F.concat(*[F.get("_cut", place) for place in _places().values()])
    return _split(cut).withColumn("restored", F.when(F.col("form") == "plain", F.col("output")).otherwise(whole)).drop("_cut")


def op11_fill_middle(spark, sf_dir: str) -> DataFrame:
    t = restore(fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return t.select(
        "doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"),
    )


#: SQL cuts the list of units instead.
ORACLE = r"""
WITH units AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
drawn AS (SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM units),
cut AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
 CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
pieces AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM cut)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
 sha256(p || m || s) AS restored_sha256
FROM pieces"""
