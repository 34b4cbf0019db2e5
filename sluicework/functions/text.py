"""Column functions on text: normal form, terms, excerpts, dates."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def nfkc(values: pd.Series) -> pd.Series:
    """Spark has no NFKC; one Arrow pass over the column."""
    return values.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


def folded(c: Column) -> Column:
    """Lower case, without byte order mark and white space of any script; null becomes ''."""
    return F.lower(F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\ufeff"), F.lit("")), "(?U)\\s+", ""))


def normal_text(c: Column) -> Column:
    """NFKC, then ``folded``."""
    return folded(nfkc(c))


def hits(c: Column, terms: Sequence[str]) -> Column:
    """array<string>: the terms that the text contains, in the terms' order; a blank term never hits."""
    kept = [t for t in terms if t]
    if not kept:
        return F.array().cast("array<string>")
    return F.filter(F.array(*(F.lit(t) for t in kept)), lambda t: c.contains(t))


def sorted_union(*arrays: Column) -> Column:
    return F.array_sort(F.array_distinct(F.concat(*arrays)))


def capped_count(c: Column, pattern: str, most: int, weight: float) -> Column:
    """Occurrences of a pattern, at most so many, times a weight."""
    return F.least(F.regexp_count(c, F.lit(pattern)), F.lit(most)) * F.lit(weight)


def weighted_terms(c: Column, weights: dict[str, float]) -> Column:
    """Sum of the weights of the terms that the text contains."""
    table = F.array(*(F.struct(F.lit(t).alias("t"), F.lit(float(w)).alias("w")) for t, w in weights.items()))
    return F.aggregate(F.filter(table, lambda x: c.contains(x["t"])), F.lit(0.0), lambda a, x: a + x["w"])


def excerpt(c: Column, terms: Sequence[str], before: int = 80, width: int = 360) -> Column:
    """A window of the text that begins ``before`` characters ahead of the earliest term, with ... where it is cut."""
    at = F.array_min(F.filter(F.array(*(F.instr(c, t) for t in terms)), lambda n: n > 0))
    start = F.greatest(F.coalesce(at, F.lit(1)) - before, F.lit(1))
    part = F.substring(c, start, F.lit(width))
    return F.concat(F.when(start > 1, "...").otherwise(""), part, F.when(F.length(c) > start + width - 1, "...").otherwise(""))


def date_in(c: Column) -> Column:
    """The first date in a text as yyyy-MM-dd, or null; the day is checked against 31 only."""
    # Forms of dates.
    first = "(20\\d{2})[年/.-](\\d{1,2})[月/.-](\\d{1,2})"
    second = "(20\\d{2})(\\d{2})(\\d{2})"
    pick = lambda n: F.when(c.rlike(first), F.regexp_extract(c, first, n)).otherwise(F.regexp_extract(c, second, n))
    year, month, day = pick(1), F.lpad(pick(2), 2, "0"), F.lpad(pick(3), 2, "0")
    valid = (year != "") & month.between("01", "12") & day.between("01", "31")
    return F.when(valid, F.concat_ws("-", year, month, day))


# Chinese digits from zero, and the signs of ten, a hundred and a thousand.
DIGITS = ["零", "一", "二", "三", "四", "五", "六", "七", "八", "九"]
UNITS = ["十", "百", "千"]


def chinese_number(c: Column) -> Column:
    """The number below ten thousand that a Chinese numeral names, null for anything else; 两 counts as 二, 〇 as 零."""
    text = F.translate(c, "两〇", "二零")
    one = f"[{''.join(DIGITS[1:])}]"
    whole = text.rlike(f"^(?:{one}千零?)?(?:{one}百零?)?(?:{one}?十)?{one}?$") & (F.length(text) > 0)

    def value(pattern: str, unit: int, bare: int) -> Column:
        """The digit in front of a unit's sign; a sign without a digit counts ``bare``."""
        digit = F.instr(F.lit("".join(DIGITS)), F.regexp_extract(text, pattern, 1)) - 1
        return F.when(text.rlike(pattern), F.when(F.regexp_extract(text, pattern, 1) == "", bare).otherwise(digit) * unit).otherwise(0)

    tens = [value(f"({one}){UNITS[2]}", 1000, 0), value(f"({one}){UNITS[1]}", 100, 0), value(f"({one}?){UNITS[0]}", 10, 1), value(f"({one})$", 1, 0)]
    return F.when(text == DIGITS[0], 0).when(whole, sum(tens[1:], tens[0]))


def display(c: Column, missing: str = "unknown", shown: str = "未列出") -> Column:
    return F.when(F.coalesce(F.trim(c), F.lit("")).isin("", missing), F.lit(shown)).otherwise(c)


def json_strings(c: Column) -> Column:
    """A JSON array of strings; bad JSON and other kinds give an empty array."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def json_inside(c: Column) -> Column:
    """The outermost {...} of an answer that may have a code fence around it."""
    found = F.regexp_extract(c, "(?s)\\{.*\\}", 0)
    return F.when(found != "", found)
