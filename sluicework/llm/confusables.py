"""Visually identical text with different characters (problem 7).

Each run of letters is a token. A letter can be spelled in its own script and, if it has
look-alikes, in theirs; the intersection of these script sets over the token tells in which
scripts the whole token can be written. Mixed tokens, and tokens of another script made of
Latin look-alikes only, take the one consistent spelling; the other forms (compatibility
variants, split accents, odd spaces and hyphens, invisible signs) are normalised before.

What looks alike is taken from Unicode's confusables data, as the ICU library that Spark ships holds them.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluicework.operators.multivalue import is_no_value

# Radicals that are no compatibility forms and in no confusables data, and the ordinary characters they look like.
RADICALS = dict(zip("⺁⺆⺈⺊⺌⺕⺜⺝⺧⺩⺪⺬⺶⺻⺼⺽⻆⻗⻞⻣⻦⻧⻪⻫⻱", "厂冂刀卜小彐日月牛王疋示羊聿肉臼角雨食骨鸟卤黾斉龜"))
# Hyphens that NFKC leaves alone.
_HYPHENS = "\u2010\u2011\u2012\u2013\u2212\u2043\u058a"

_INVISIBLE = re.compile("[\u00ad͏؜ᅟᅠ឴឵᠋-᠏\u200b-\u200f‪-‮\u2060-⁯ㅤ︀-️\ufeffﾠ\U000e0000-\U000e0fff\x00-\x08\x0e-\x1f\x7f-\x84\x86-\x9f]")
_SPACES = re.compile("[\t\n\x0b\x0c\r\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Scripts whose letters are no letters of an alphabet.
_IDEOGRAPHIC = "\u2e80-\u2fff\u3040-\u318f\u31a0-\u31ff\u3400-\u4dbf\u4e00-\ua4cf\uac00-\ud7af\uf900-\ufaff\U00016fe0-\U00018fff\U0001b000-\U0001b2ff\U00020000-\U0003ffff"
_WORD = re.compile(f"(?:(?![{_IDEOGRAPHIC}])[^\\W\\d_]|[\u0300-\u036f])+")
_HAN = re.compile("[㐀-鿿ァ-ー]+")
_PLAIN = re.compile("[ -~一-鿿]*")


@dataclass(frozen=True)
class Tables:
    """What looks alike: letters of other scripts as Latin ones; signs that are no unified ideograph as the ideographs they look like."""

    latin: dict[str, str]
    ideographs: dict[str, str]

    @property
    def kana(self) -> dict[str, str]:
        return {c: x for c, x in self.ideographs.items() if "\u30a1" <= c <= "\u30fc"}

    @property
    def odd(self) -> dict[int, str]:
        return {ord(c): x for c, x in self.ideographs.items() if "\u2e80" <= c <= "\u2fff"} | {ord(c): "-" for c in _HYPHENS}


def confusable_tables(spark: SparkSession) -> Tables:
    """From the skeletons that Unicode gives confusable characters: a letter looks like the Latin one of equal skeleton, of its own case if there is one."""
    points = [*range(0x80, 0x2E80), *range(0x2E80, 0x2FE0), *range(0x30A1, 0x30FD), *range(0xA4D0, 0xAC00), *range(0xFB00, 0xFE00), *range(0x10000, 0x16FE0), *range(0x1D000, 0x20000)]
    letters = [c for c in map(chr, points) if unicodedata.category(c)[0] == "L" or 0x2E80 <= ord(c) < 0x2FE0]
    ascii_letters = [chr(n) for n in (*range(65, 91), *range(97, 123))]
    checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    skeletons = checker.getSkeleton(0, "\n".join([*ascii_letters, *letters])).split("\n")
    own = dict(zip([*ascii_letters, *letters], skeletons, strict=True))
    looks: dict[str, list[str]] = {}
    for c in ascii_letters:
        looks.setdefault(own[c], []).append(c)
    latin, ideographs = {}, dict(RADICALS)
    for c in letters:
        x = own[c]
        if "\u4e00" <= x <= "\u9fff" and len(x) == 1 and ("\u2e80" <= c <= "\u2fff" or "\u30a1" <= c <= "\u30fc"):
            ideographs[c] = x
        elif x in looks and _script(c) != "LATIN" and unicodedata.normalize("NFKC", c) == c:
            same = [y for y in looks[x] if y.isupper() == c.isupper()] if c.isupper() or c.islower() else [y for y in looks[x] if y == x]
            if same:
                latin[c] = same[0]
    return Tables(latin, ideographs)


@lru_cache(maxsize=65536)
def _script(letter: str) -> str:
    """The first word of the letter's name, which is its script."""
    return unicodedata.name(letter, "UNNAMED").split(" ", 1)[0].split("-", 1)[0]


@dataclass
class Plain:
    """The plain form of texts, by tables."""

    tables: Tables

    def __post_init__(self):
        self.latin, self.kana, self.odd = self.tables.latin, self.tables.kana, self.tables.odd
        self.other: dict[str, dict[str, str]] = {}
        for c, x in self.latin.items():
            self.other.setdefault(_script(c), {}).setdefault(x, c)

    def _spellings(self, letter: str) -> set[str]:
        """Scripts in which the letter can be spelled without a change of looks."""
        own = _script(letter)
        if own == "LATIN":
            return {own} | {s for s, pairs in self.other.items() if letter in pairs}
        return {own, "LATIN"} if letter in self.latin else {own}

    def _respelled(self, token: str, script: str) -> str:
        pairs = self.latin if script == "LATIN" else self.other.get(script, {})
        return unicodedata.normalize("NFC", "".join(pairs.get(c, c) for c in unicodedata.normalize("NFD", token)))

    def _consistent(self, match: re.Match) -> str:
        token = match[0]
        if token.isascii():
            return token
        letters = [c for c in unicodedata.normalize("NFD", token) if not unicodedata.combining(c)]
        scripts = Counter(map(_script, letters))
        if scripts.keys() <= {"LATIN"}:
            return token
        if len(letters) == 1 and letters[0].islower() and "GREEK" in scripts:
            return token  # a single Greek letter stands for itself
        possible = set.intersection(*(self._spellings(c) for c in letters))
        if "LATIN" in possible:
            return self._respelled(token, "LATIN")
        if len(scripts) == 1:
            return token
        # A mixed token: in the script that all of it can be written in, else in the one that most of it is.
        return self._respelled(token, max(possible & scripts.keys() or scripts, key=lambda s: (scripts[s], s)))

    def _han(self, match: re.Match) -> str:
        token = match[0]
        kana = [c for c in token if "\u30a1" <= c <= "\u30fc"]
        if kana and len(kana) < len(token) and all(c in self.kana for c in kana):
            return "".join(self.kana.get(c, c) for c in token)
        return token

    def text(self, value: str | None) -> str | None:
        """The plain form of a value; None stays None, '' stays ''."""
        if value is None or _PLAIN.fullmatch(value):
            return value
        text = _SPACES.sub(" ", _INVISIBLE.sub("", value))
        text = unicodedata.normalize("NFKC", text).translate(self.odd)
        text = _INVISIBLE.sub("", text)
        return _HAN.sub(self._han, _WORD.sub(self._consistent, text))


def plain_forms(df: DataFrame, keys: Sequence[str], fields: Sequence[str], tables: Tables | None = None) -> DataFrame:
    """One row per record and field: keys, ``field_name``, ``value``, ``plain_value``, ``affected``.

    A null stays null and isn't affected, an empty text neither; repeated rows stay repeated.
    Only keys and fields are read, so columns with the output's names do no harm. Map-only: no
    shuffle, one Arrow pass over the values; the tables sent along have some thousand signs.
    """
    spark = df.sparkSession
    sent = spark.sparkContext.broadcast(Plain(tables or confusable_tables(spark)))

    @F.pandas_udf(T.StringType())
    def plain_form(values: pd.Series) -> pd.Series:
        return values.map(sent.value.text, na_action="ignore")

    rows = df.select(*(df[k] for k in keys), F.explode(F.array(*(F.struct(F.lit(f).alias("f"), df[f].cast("string").alias("v")) for f in fields))).alias("__x"))
    rows = rows.select(*keys, F.col("__x.f").alias("field_name"), F.col("__x.v").alias("value"))
    rows = rows.withColumn("plain_value", plain_form("value"))
    return rows.withColumn("affected", ~F.col("value").eqNullSafe(F.col("plain_value")))


def affected_values(df: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """The rows of ``plain_forms`` whose value isn't in plain form; fields without a value are none."""
    return plain_forms(df, keys, fields).where(F.col("affected") & ~is_no_value(F.col("value")))
