"""Several values packed in one field: split into rows with positions (problem 2).

Quoted and bracketed spans are replaced by indexed placeholders, the rest is split at the
delimiters, and the spans come back by array lookup. A character of the text that equals
a placeholder's own marks is itself taken as a span, so no text collides with a placeholder.
Everything is a JVM expression: no Python, no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Whole fields without a value.
NO_VALUES = ("", "unknown", "不限", "无要求", "无限制", "不作要求", "无", "—", "-", "/")

_OPEN, _CLOSE, _MARK = "\ue000", "\ue001", "\ue002"
_HOLDER = f"{_OPEN}(\\d+){_CLOSE}"
_SPACE = "[\\s\\u0085\\u00a0\\u1680\\u2000-\\u200d\\u2028\\u2029\\u202f\\u205f\\u2060\\u3000\\ufeff]"

_PAIRS = (("“", "”"), ("「", "」"), ("『", "』"), ("‘", "’"), ("〝", "〞"))
_QUOTES = "|".join(['"[^"]*"', *(f"{a}[^{a}{b}]*{b}" for a, b in _PAIRS)])
#: A bracketed number is a numbering mark, no span. Brackets in brackets of their kind are marked before, so that none is left inside.
_ROUND = "(?:[(（](?!\\d{1,2}[)）])[^()（）]*+[)）])"
_SQUARE = "(?:[\\[［【〔][^\\[\\]［］【】〔〕]*+[\\]］】〕])|(?:[{｛][^{}｛｝]*+[}｝])|(?:《[^《》]*+》)"
_SPAN = f"[{_OPEN}{_CLOSE}{_MARK}]|{_QUOTES}|{_ROUND}|{_SQUARE}"

#: Opening and closing brackets of each kind, and the noncharacters, which no text may hold, that mark those in others.
_KINDS = (("(（", ")）"), ("[［【〔", "]］】〕"), ("{｛", "}｝"), ("《", "》"))
_BRACKETS = "".join(a + b for a, b in _KINDS)
_MARKS = "".join(chr(0xFDD0 + k) for k in range(len(_BRACKETS)))
_IN_CLASS = str.maketrans({"[": "\\[", "]": "\\]"})

_CIRCLED = "[\\u2460-\\u249b\\u2776-\\u277f\\u3220-\\u3229]"
_DELIMITER = f"(?:{_MARK}|[;；,，、/／|｜。\\n\\r\\t\\u000b\\f\\u2028\\u2029])"
_NUMBER = "(?:\\d{1,2}[.．、)）](?!\\d)|[(（]\\d{1,2}[)）])"
#: A number followed by its sign counts as a mark at the start of the field or behind a delimiter.
_NUMBERED = f"(?:(?<=^)|(?<=[;；,，、/／|｜。\\n\\r\\t])){_SPACE}*+{_NUMBER}"
_LIST = f"(?s)^{_SPACE}*[\\[［【]{_SPACE}*(?:{_QUOTES}|')"


def _joined(parts: Column, fills: Column) -> Column:
    """parts[0] fills[0] parts[1] fills[1] ... without a search for what was filled in."""
    return F.array_join(F.zip_with(parts, fills, lambda p, s: F.concat(F.coalesce(p, F.lit("")), F.coalesce(s, F.lit("")))), "")


#: The signs of _SPACE one by one.
_SPACES = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200E), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF]))


def strip_space(c: Column) -> Column:
    """Without leading and trailing white space of any script, invisible signs among it."""
    return F.btrim(c, F.lit(_SPACES))


def is_no_value(c: Column) -> Column:
    return c.isNull() | strip_space(c).isin(*NO_VALUES)


def _unquoted(c: Column) -> Column:
    """Surrounding white space off, a closing full stop off, enclosing quotes off."""
    pairs = "|".join(f"{a}[^{a}{b}]*{b}" for a, b in _PAIRS)
    bare = F.ltrim(F.rtrim(c, F.lit(_SPACES + "。．.")), F.lit(_SPACES))
    inner = F.ltrim(F.rtrim(F.substring(bare, F.lit(2), F.length(bare) - 2), F.lit(_SPACES + "。．.")), F.lit(_SPACES))
    return F.when(F.substring(bare, 1, 1).isin(*(a for a, _ in _PAIRS)) & bare.rlike(f"^(?:{pairs})$"), inner).otherwise(bare)


#: Without any of these a field holds one value as it is.
_SPECIAL = f"[{_OPEN}{_CLOSE}{_MARK};；,，、/／|｜。\\n\\r\\t\\u000b\\f\\u2028\\u2029\"“”「」『』‘’〝〞()（）\\[\\]［］【】〔〕{{}}｛｝《》\\u2460-\\u249b\\u2776-\\u277f\\u3220-\\u3229]|^{_SPACE}*\\d"


def _marked(c: Column) -> Column:
    return F.translate(c, _BRACKETS, _MARKS)


def _outermost(c: Column, opening: str, closing: str) -> Column:
    """The text with all brackets of a kind marked but the outermost pairs: those inside them, and those without a partner.

    Three sweeps, each with a count: closing brackets without an opening one before, opening ones without a closing one behind, depth.
    """
    both = f"[{(opening + closing).translate(_IN_CLASS)}]"
    parts = lambda x: F.regexp_extract_all(x, F.lit(f"(?s){both}|[^{both[1:]}+"), F.lit(0))
    state = lambda text, n: F.struct(text.alias("text"), n.cast("int").alias("n"))
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("n"))

    def sweep(pieces: Column, opens: str, closes: str, ahead: bool) -> Column:
        """Marks brackets that close without one that opened before, in the sweep's direction."""

        def step(a, x):
            known = ~x.isin(*closes) | (a["n"] > 0)
            kept = F.when(known, x).otherwise(_marked(x))
            return state(F.concat(a["text"], kept) if ahead else F.concat(kept, a["text"]), a["n"] + F.when(x.isin(*opens), 1).when(x.isin(*closes) & (a["n"] > 0), -1).otherwise(0))

        return F.aggregate(pieces, start, step, lambda a: a["text"])

    def deepen(a, x):
        after = a["n"] + F.when(x.isin(*opening), 1).when(x.isin(*closing), -1).otherwise(0)
        inner = (x.isin(*opening) & (a["n"] > 0)) | (x.isin(*closing) & (after > 0))
        return state(F.concat(a["text"], F.when(inner, _marked(x)).otherwise(x)), after)

    closed = sweep(parts(c), opening, closing, True)
    paired = sweep(F.reverse(parts(closed)), closing, opening, False)
    return F.aggregate(parts(paired), start, deepen, lambda a: a["text"])


def with_values(df: DataFrame, field: str, values: str) -> DataFrame:
    """Adds array<string> ``values``: the field's values in order, none for a field without a value.

    The steps are columns of their own, since an expression that is used twice would run twice.
    """
    text = F.when(F.col(field).startswith("\ufeff"), F.substring(field, 2, 2**31 - 1)).otherwise(F.col(field))
    df = df.withColumn("__packed", F.when(~is_no_value(F.col(field)), text))
    df = df.withColumn("__special", F.col("__packed").rlike(_SPECIAL))
    packed = F.when(F.col("__special"), F.col("__packed"))
    df = df.withColumn("__listed", F.when(packed.rlike(f"^{_SPACE}*\\[{_SPACE}*\""), F.from_json(packed, "array<string>")))
    # A bracketed list of quoted texts that is no JSON: its brackets are taken off.
    loose = F.when(F.col("__listed").isNull(), packed)
    is_list = loose.rlike(_LIST) & loose.rlike(f"(?s)[\\]］】]{_SPACE}*$")
    df = df.withColumn("__bare", F.when(is_list, F.regexp_replace(loose, f"^{_SPACE}*[\\[［【]|[\\]］】]{_SPACE}*$", "")).otherwise(loose))
    # Few cells have brackets in brackets of their kind; for all others the step is one search a kind.
    df = df.withColumn("__marked", F.lit(False))
    for opening, closing in _KINDS:
        opens, either = opening.translate(_IN_CLASS), (opening + closing).translate(_IN_CLASS)
        nested = F.col("__bare").rlike(f"[{opens}][^{either}]*+[{opens}]") & ~F.coalesce(loose.rlike(f"[{_MARKS}]"), F.lit(False))
        df = df.withColumn("__nested", F.coalesce(nested, F.lit(False))).withColumn("__marked", F.col("__marked") | F.col("__nested"))
        df = df.withColumn("__bare", F.when(F.col("__nested"), _outermost(F.col("__bare"), opening, closing)).otherwise(F.col("__bare")))
    df = df.withColumn("__spans", F.regexp_extract_all("__bare", F.lit(_SPAN), F.lit(0)))
    held = _joined(F.split("__bare", _SPAN, -1), F.transform("__spans", lambda s, i: F.concat(F.lit(_OPEN), i.cast("string"), F.lit(_CLOSE))))
    df = df.withColumn("__held", F.when(F.size("__spans") > 0, held).otherwise(F.col("__bare")))
    df = df.withColumn("__held", F.when(F.col("__held").rlike(_CIRCLED), F.regexp_replace("__held", _CIRCLED, _MARK)).otherwise(F.col("__held")))
    bracketed = F.col("__held").rlike(f"^{_SPACE}*(?:{_DELIMITER})*{_SPACE}*[(（]\\d{{1,2}}[)）]")
    df = df.withColumn("__held", F.when(bracketed, F.regexp_replace("__held", "[(（]\\d{1,2}[)）]", _MARK)).otherwise(F.col("__held")))
    df = df.withColumn("__held", F.when(F.col("__held").rlike("\\d[.．、)）]|[(（]\\d"), F.regexp_replace("__held", _NUMBERED, _MARK)).otherwise(F.col("__held")))
    df = df.withColumn("__pieces", F.split("__held", f"(?:{_SPACE}*{_DELIMITER}{_SPACE}*)+", -1))

    def restored(piece: Column) -> Column:
        at = F.transform(F.regexp_extract_all(piece, F.lit(_HOLDER), F.lit(1)), lambda i: F.get(F.col("__spans"), i.cast("int")))
        whole = _joined(F.split(piece, _HOLDER, -1), at)
        quoted = piece.rlike(f"^(?:{_OPEN}\\d+{_CLOSE})++$") & F.forall(at, lambda s: s.startswith('"'))
        return F.when(quoted, F.replace(F.substring(whole, F.lit(2), F.length(whole) - 2), F.lit('""'), F.lit('"'))).otherwise(whole)

    pieces = F.when(F.size("__spans") > 0, F.transform("__pieces", lambda p: F.when(p.contains(_OPEN), restored(strip_space(p))).otherwise(p))).otherwise(F.col("__pieces"))
    df = df.withColumn("__pieces", F.when(F.col("__packed").isNull(), F.array().cast("array<string>")).when(~F.col("__special"), F.array("__packed")).otherwise(F.coalesce("__listed", pieces)))
    df = df.withColumn("__pieces", F.when(F.col("__marked"), F.transform("__pieces", lambda p: F.translate(p, _MARKS, _BRACKETS))).otherwise(F.col("__pieces")))
    df = df.withColumn("__pieces", F.transform("__pieces", _unquoted))
    df = df.withColumn(values, F.filter("__pieces", lambda v: v.isNotNull() & (v != "")))
    return df.drop("__packed", "__special", "__listed", "__bare", "__marked", "__nested", "__spans", "__held", "__pieces")


def split_packed(df: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """One row per value of each packed field.

    Returns the key columns, ``field_name``, ``item_no`` from 1 in the field's order, ``item_value``
    and ``n_items``, the number of values in that field. A null, blank or no-value field gives no
    row; repeated input rows give repeated output rows; input columns named as the output's are
    no hindrance, as only keys and fields are read. Texts of any length are split whole. A quote
    or bracket that isn't closed is an ordinary character. Brackets may lie in others of their kind to any depth, except in a text that holds
    noncharacters from U+FDD0 on: there the inner ones are spans and the outer ones aren't.
    """
    cells = F.array(*(F.struct(F.lit(f).alias("f"), df[f].cast("string").alias("v")) for f in fields))
    rows = df.select(*(df[k] for k in keys), F.explode(cells).alias("__cell"))
    rows = rows.select(*keys, F.col("__cell.f").alias("__name"), F.col("__cell.v").alias("__field"))
    rows = with_values(rows.where(~is_no_value(F.col("__field"))), "__field", "__values")
    # A filter on the array or its size would be pushed below the steps with a copy of all of them, as Spark
    # infers one for a plain explode and a caller may set one on n_items; both stay above an outer explode's output.
    items = F.transform("__values", lambda v, i: F.struct((i + 1).alias("item_no"), v.alias("item_value"), F.size("__values").alias("n_items")))
    rows = rows.select(*keys, F.col("__name").alias("field_name"), F.explode_outer(items).alias("__item")).where("__item is not null")
    return rows.select(*keys, "field_name", "__item.item_no", "__item.item_value", "__item.n_items")
