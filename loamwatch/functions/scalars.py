"""Column functions: dates, indices, masks, labels, text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loamwatch.schemas import NODATA

#: Proleptic ordinal of 1970-01-01.
EPOCH_ORDINAL = 719163


# dates ------------------------------------------------------------------------------------------------------

def date_to_ordinal(d: Column) -> Column:
    return F.datediff(d, F.lit("1970-01-01").cast("date")) + EPOCH_ORDINAL


def ordinal_to_date(n: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), n - EPOCH_ORDINAL)


def date_to_ms(d: Column) -> Column:
    return F.datediff(d, F.lit("1970-01-01").cast("date")).cast("long") * 86_400_000


def ms_to_date(ms: Column) -> Column:
    """UTC date; floors, so times before 1970 fall on the right day."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ms / 86_400_000).cast("int"))


def date_to_int(d: Column) -> Column:
    """YYYYMMDD as a number."""
    return F.date_format(d, "yyyyMMdd").cast("int")


def int_to_date(n: Column) -> Column:
    """YYYYMMDD or 0 or null -> date or null."""
    return F.try_to_timestamp(F.nullif(F.coalesce(n, F.lit(0)), F.lit(0)).cast("string"), F.lit("yyyyMMdd")).cast("date")


def clean_date(s: Column, first: int = 2017, last: int = 2024) -> Column:
    """ISO or compact dates; null if neither, or outside the years."""
    d = F.coalesce(F.try_to_timestamp(s, F.lit("yyyy-MM-dd")), F.try_to_timestamp(s, F.lit("yyyyMMdd"))).cast("date")
    return F.when(F.year(d).between(first, last), d)


def day_first(s: Column) -> Column:
    """d/M/yyyy -> ddMMyyyy; null if it isn't a date."""
    return F.date_format(F.try_to_timestamp(F.trim(s), F.lit("d/M/yyyy")), "ddMMyyyy")


def parse_ddmmyyyy(s: Column) -> Column:
    """ddMMyyyy with stray commas and blanks."""
    return F.try_to_timestamp(F.regexp_replace(s, "[,\\s]", ""), F.lit("ddMMyyyy")).cast("date")


def month_class(m: Column) -> Column:
    return F.when(m.isin(1, 2, 11, 12), "winter").when(m.isin(3, 4, 9, 10), "between").when(m.isin(5, 6, 7, 8), "summer").otherwise("other")


# bands ------------------------------------------------------------------------------------------------------

def is_clean(*bands: str, nodata: int = NODATA) -> Column:
    """No band is null or the no-data value."""
    return reduce(lambda a, b: a & b, [F.col(b).isNotNull() & (F.col(b) != nodata) for b in bands])


def ndvi_scaled(nir: Column, red: Column) -> Column:
    """10000 * NDVI, not clipped; no-data where the sum of the bands isn't positive."""
    return F.when(nir + red > 0, 10000.0 * (nir - red) / (nir + red)).otherwise(float(NODATA))


def ndvi_clipped(nir: Column, red: Column) -> Column:
    """10000 * NDVI as a whole number from 0 to 5000."""
    return F.when(nir + red > 0, F.least(F.greatest((10000.0 * (nir - red) / (nir + red)).cast("int"), F.lit(0)), F.lit(5000)))


def ndvi(nir: Column, red: Column) -> Column:
    return F.when(nir + red != 0, (nir - red) / (nir + red))


def cloud_free(qa: Column) -> Column:
    """Bits 10 (clouds) and 11 (cirrus) are both zero."""
    return (qa.bitwiseAND(F.lit(1 << 10)) == 0) & (qa.bitwiseAND(F.lit(1 << 11)) == 0)


def zeros_to_nodata(*bands: str) -> list[Column]:
    """Bands of a cell become no-data where all of them are zero."""
    empty = reduce(lambda a, b: a & b, [F.col(b) == 0 for b in bands])
    return [F.when(empty, NODATA).otherwise(F.col(b)).alias(b) for b in bands]


def subtile(x: Column, y: Column, minx: Column, miny: Column, maxx: Column, maxy: Column, n: int = 6) -> Column:
    """part_k of an n by n grid over a box, k = n * column + row + 1."""
    cell = lambda v, lo, hi: F.least(F.floor((v - lo) * n / (hi - lo)), F.lit(n - 1))
    return F.concat(F.lit("part_"), (cell(x, minx, maxx) * n + cell(y, miny, maxy) + 1).cast("string"))


# labels and text --------------------------------------------------------------------------------------------

def area_class(area: Column, bounds: list[float], names: list[str]) -> Column:
    """Right-closed classes (bounds[i], bounds[i + 1]]; null outside."""
    out = None
    for lo, hi, name in zip(bounds, bounds[1:], names, strict=False):
        hit = (area > lo) & (area <= hi)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def even_digit_sum(key: Column, n: int = 5) -> Column:
    """Whether the first n digits of an id add up to an even number."""
    return F.aggregate(F.transform(F.split(F.substring(key, 1, n), ""), lambda c: F.coalesce(F.try_to_number(c, F.lit("9")).cast("int"), F.lit(0))), F.lit(0), lambda a, x: a + x) % 2 == 0


def text_key(s: Column) -> Column:
    """Without blanks and other non-alphanumerics."""
    return F.regexp_replace(s, "[^0-9A-Za-z]", "")


def unbracket(s: Column) -> Column:
    return F.regexp_replace(s, r"[\[\]]", "")


def loose_list(s: Column) -> Column:
    """'[a, b]', 'a, b', 'a' or null -> array of strings; null is an empty array."""
    parts = F.transform(F.split(unbracket(s), ","), lambda x: F.trim(x))
    return F.coalesce(F.array_remove(parts, ""), F.array().cast("array<string>"))


def id_keys(stem: Column, suffix: str = "_EG") -> Column:
    """Ids in a file stem, each with a suffix."""
    return F.transform(F.split(stem, "_"), lambda x: F.concat(x, F.lit(suffix)))


def interval_ends(drop: Column, first: Column, second: Column, start: Column, end: Column, days: int = 5, whole: str = "1000-01-01") -> list[Column]:
    """data0 and data1 from the two analyst dates (text), the biggest drop, and the interval that '1000-01-01' stands for."""
    pick = lambda e, whole_end, shift: F.when(e == whole, whole_end).when(e.isNotNull(), F.try_to_timestamp(e, F.lit("yyyy-MM-dd")).cast("date"))
    near = lambda e, sign: (drop.isNotNull() & e.isNull(), F.date_add(drop, sign * days))
    out = []
    for e, ends, sign, name in ((first, start, -1, "data0"), (second, end, 1, "data1")):
        cond, value = near(e, sign)
        out.append(F.coalesce(pick(e, ends, sign), F.when(cond, value)).alias(name))
    return out


def signed_distance(drop: Column, first: Column, last: Column) -> Column:
    """Days of the drop before the first (negative) or after the last cut; 0 in between."""
    return F.when(drop < first, F.datediff(drop, first)).when(drop > last, F.datediff(drop, last)).when(drop.isNotNull() & first.isNotNull(), 0)
