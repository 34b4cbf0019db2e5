"""Mapping free-entered values to a canonical list (problem 3).

The names and aliases of the list are cut into tokens of two or three characters; endings and beginnings
that several of them share become tokens of their own and weigh little. The distinct pieces of the distinct
values are joined to the distinct tokens of the vocabulary by edit distance: both sides
give out the keys of their neighbourhoods, so that the join is an equi-join. An entry that has enough
weight among the repaired tokens is ranked by soft TF-IDF over all of its tokens, and an exact check of the
whole term's distance follows. A value that comes near no entry is reported as ``none``.

Values, pieces and entries are tables throughout: neither side need fit one machine.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluicework.session import checkpointed

# Traditional characters common in names of subjects, and their simplified forms.
TRADITIONAL = dict(
    zip(
        "學術語護養務動測運譯調網電傳圖預組規劃檢藝遙織藥證療農輸衛開發書計賬設閱輪濬識稅觀驗匯綠環邊產經濟財會貿業機構築礦鐵鋼車輛飛載腦軟資訊訓練體醫診斷實館廣畫戲劇樂聲話譜編輯錄攝導廠價銀險債條約賞獎應關係層級總統籌勞團隊歷紀報紙聞專門類顧賽競軌橋儲壓氣溫濕豐麗獸魚鳥龍種屬銷採購庫樣標準維檔倫輔課師範審遠監獄滅災備鍋爐燒聽視覺頻顯積個樞樓臺號灣縣鄉鎮營飲餅麵錢鏡鍵鑑陽陰階際難雲靈靜響",
        "学术语护养务动测运译调网电传图预组规划检艺遥织药证疗农输卫开发书计账设阅轮浚识税观验汇绿环边产经济财会贸业机构筑矿铁钢车辆飞载脑软资讯训练体医诊断实馆广画戏剧乐声话谱编辑录摄导厂价银险债条约赏奖应关系层级总统筹劳团队历纪报纸闻专门类顾赛竞轨桥储压气温湿丰丽兽鱼鸟龙种属销采购库样标准维档伦辅课师范审远监狱灭灾备锅炉烧听视觉频显积个枢楼台号湾县乡镇营饮饼面钱镜键鉴阳阴阶际难云灵静响",
    )
)
_SIMPLE = str.maketrans(TRADITIONAL)
_REMARK = re.compile(r"\([^()]*\)|\[[^\[\]]*\]|【[^】]*】|〔[^〕]*〕|<[^<>]*>")
_CODE = re.compile(r"(?<!\d)\d{4,8}(?!\d)")
NONE = "none"


def normal(value: str) -> str:
    """NFKC, simplified, lower case, without white space and invisible signs."""
    text = unicodedata.normalize("NFKC", value).translate(_SIMPLE).lower()
    return "".join(c for c in text if not c.isspace() and unicodedata.category(c) != "Cf")


def placed_distance(term: str, value: str) -> tuple[int, int]:
    """(edit distance with swaps of the term to the nearest part of the value, characters left over there)."""
    n, m = len(term), len(value)
    before, row = None, [(0, j) for j in range(m + 1)]
    for i in range(1, n + 1):
        nxt = [(i, 0)]
        for j in range(1, m + 1):
            cost = term[i - 1] != value[j - 1]
            best = min((row[j - 1][0] + cost, -row[j - 1][1]), (row[j][0] + 1, -row[j][1]), (nxt[j - 1][0] + 1, -nxt[j - 1][1]))
            if before and j > 1 and cost and term[i - 1] == value[j - 2] and term[i - 2] == value[j - 1]:
                best = min(best, (before[j - 2][0] + 1, -before[j - 2][1]))
            nxt.append((best[0], -best[1]))
        before, row = row, nxt
    distance, end = min((d, j) for j, (d, _) in enumerate(row))
    ends = [(j - s, j) for j, (d, s) in enumerate(row) if d == distance]
    return distance, m - max(length for length, _ in ends)


_CUT = T.StructType([T.StructField("bare", T.StringType()), T.StructField("codes", T.ArrayType(T.StringType()))])


def bare_form(value: str) -> tuple[str, list[str]]:
    """The normal form without remarks in brackets and without numbers that may be codes, and those numbers."""
    text = normal(value)
    bare = _REMARK.sub("", text) or text
    while bare != text and _REMARK.search(bare):
        bare = _REMARK.sub("", bare)
    return _CODE.sub("", bare), sorted(set(_CODE.findall(text)))


@F.pandas_udf(_CUT)
def _bare(values: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([bare_form(x) for x in values], columns=["bare", "codes"])


@F.pandas_udf(T.StringType())
def _normal(values: pd.Series) -> pd.Series:
    return values.map(normal, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _placed(terms: pd.Series, values: pd.Series) -> pd.Series:
    return pd.Series([list(placed_distance(t, v)) for t, v in zip(terms, values)], dtype=object)


def _runs(chars: Column, n: int) -> Column:
    """The runs of n of an array of characters."""
    run = lambda i: F.concat(*(F.get(chars, i + k) for k in range(n)))
    return F.when(F.size(chars) >= n, F.transform(F.sequence(F.lit(0), F.size(chars) - n), run)).otherwise(F.array().cast("array<string>"))


def _characters(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def _each(c: Column, change) -> Column:
    """What ``change(before, character, after)`` gives at each place of a short text."""
    return F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: change(F.substring(c, F.lit(1), i - 1), F.substring(c, i, F.lit(1)), F.substring(c, i + 1, F.length(c))))


def _neighbourhood(c: Column, is_token: bool) -> Column:
    """Keys of which a piece and a token share one if they are the same or one edit apart, and the edit leaves two characters or more in their places.

    e: the same; i: the piece has one character more; x: two characters swapped; d: the piece has one less; m: one differs.
    """
    tagged = lambda tag, x: F.transform(x, lambda v: F.concat(F.lit(tag), v))
    none, own, n = F.array().cast("array<string>"), F.array(c), F.length(c)
    shorter = _shorter(c)
    masked = _each(c, lambda a, x, b: F.concat(a, F.lit("\0"), b))
    swapped = _swapped(c)
    two = lambda tag, x: F.when(n >= 2, tagged(tag, x)).otherwise(none)
    three = lambda tag, x: F.when(n >= 3, tagged(tag, x)).otherwise(none)
    if is_token:
        return F.array_distinct(F.concat(tagged("e", own), two("i", own), two("x", swapped), three("d", shorter), three("m", masked)))
    return F.array_distinct(F.concat(tagged("e", own), three("i", shorter), two("x", own), two("d", own), three("m", masked)))


#: Characters of the longest token; a piece may have one more.
LONGEST = 3


@dataclass
class Vocabulary:
    """Terms of the list with their tokens and weights, and the list's codes, as tables."""

    terms: DataFrame  # entry, place, term, tokens (with their texts without one character, and with two swapped), weights, total
    codes: DataFrame  # code, entry
    least: float = 0.6


def term_tokens(terms: DataFrame) -> DataFrame:
    """Adds the tokens of each term: a beginning and an ending that five terms share, and the rest in twos, the last of which takes an odd character."""
    end = lambda n: F.when(F.length("term") > n, F.substring("term", -n, n))
    parts = terms.withColumns({"__e2": end(2), "__e1": end(1), "__s2": F.when(F.length("term") > 3, F.substring("term", 1, 2))})
    for name in ("__e2", "__e1", "__s2"):
        # Counted before it is joined: an ending of a third of all terms is one row.
        often = parts.where(F.col(name).isNotNull()).groupBy(name).agg((F.count("*") >= 5).alias(f"{name}_often"))
        parts = parts.join(often, name, "left")
    head = F.when((F.length("term") > 5) & F.col("__s2_often"), F.col("__s2")).otherwise("")
    parts = parts.withColumn("__head", head).withColumn("__rest", F.expr("substring(term, length(__head) + 1)"))
    tail = F.when((F.length("__rest") > 3) & F.col("__e2_often"), F.col("__e2")).when((F.length("__rest") > 2) & F.col("__e1_often"), F.col("__e1")).otherwise("")
    parts = parts.withColumn("__tail", tail).withColumn("__stem", F.expr("substring(__rest, 1, length(__rest) - length(__tail))"))
    pairs = F.greatest(F.lit(1), F.floor(F.length("__stem") / 2).cast("int"))
    cut = lambda i: F.substring("__stem", 2 * i + 1, F.when(i == pairs - 1, F.lit(LONGEST)).otherwise(2))
    tokens = F.concat(F.array("__head"), F.transform(F.sequence(F.lit(0), pairs - 1), cut), F.array("__tail"))
    return parts.withColumn("tokens", F.filter(tokens, lambda x: x != "")).select(*terms.columns, "tokens")


def build_vocabulary(reference: DataFrame, key: str, name: str, aliases: str | None = None, code: str | None = None, least: float = 0.6) -> Vocabulary:
    """The reference list's terms, cut and weighed; nothing of it is collected. Null keys and empty names are no terms.

    least: share of an entry's weight that a value's tokens must have.
    """
    rows = reference.select(F.col(key).alias("entry"), F.col(name).alias("n"), (F.col(aliases) if aliases else F.array().cast("array<string>")).alias("a"), (F.col(code) if code else F.lit(None).cast("string")).alias("c")).where("entry is not null")
    names = F.concat(F.array("n"), F.coalesce("a", F.array().cast("array<string>")))
    terms = rows.select("entry", F.posexplode(names).alias("place", "w")).where("w <> ''").select("entry", "place", _normal("w").alias("term")).where("term <> ''")
    terms = checkpointed(terms.groupBy("entry", "term").agg(F.min("place").alias("place")))
    terms = term_tokens(terms)
    one = terms.select("entry", "place", F.explode(F.array_distinct("tokens")).alias("token"))
    number = terms.agg(F.count("*").alias("__all"))
    idf = one.groupBy("token").agg(F.count("*").alias("n")).crossJoin(F.broadcast(number)).select("token", F.log(1 + F.col("__all") / F.col("n")).alias("idf"))
    placed = terms.select("entry", "place", "term", F.posexplode("tokens").alias("at", "token")).join(idf, "token")
    weighed = placed.groupBy("entry", "place", "term").agg(F.array_sort(F.collect_list(F.struct("at", "token", "idf"))).alias("x"))
    weighed = weighed.select("entry", "place", "term", F.transform("x", lambda x: F.struct(x["token"].alias("token"), _shorter(x["token"]).alias("shorter"), _swapped(x["token"]).alias("swapped"))).alias("tokens"), F.col("x.idf").alias("weights"))
    weighed = weighed.withColumn("total", F.aggregate("weights", F.lit(0.0), lambda a, x: a + x))
    codes = rows.where("c <> ''").groupBy(F.col("c").alias("code")).agg(F.max("entry").alias("entry"))
    return Vocabulary(checkpointed(weighed), codes, least)


def _leading(least: float) -> Column:
    """The heaviest tokens of a term, so many that without two characters in their places in one of them no value can have ``least`` of its weight: the others give half of theirs at most."""
    order = F.array_sort(F.arrays_zip(F.transform("weights", lambda w: -w).alias("w"), F.col("tokens.token").alias("t")))
    before = F.transform(F.sequence(F.lit(1), F.size("tokens")), lambda i: F.aggregate(F.slice(order, F.lit(1), i - 1), F.lit(0.0), lambda a, x: a - x["w"]))
    needed = F.filter(F.arrays_zip(order.alias("x"), before.alias("b")), lambda p: p["b"] <= 2 * (1 - F.lit(least)) * F.col("total") + 1e-9)
    return F.array_distinct(F.transform(needed, lambda p: p["x"]["t"]))


def _without_inner(chars: Column, n: int) -> Column:
    """The runs of n + 1 characters, without each of their inner ones."""
    drop = lambda i: F.array(*(F.concat(*(F.get(chars, i + k) for k in range(n + 1) if k != j)) for j in range(1, n)))
    return F.when(F.size(chars) > n, F.flatten(F.transform(F.sequence(F.lit(0), F.size(chars) - n - 1), drop))).otherwise(F.array().cast("array<string>"))


def _likeness(t: Column) -> Column:
    """1 for a token found as it is; for one an edit away, less by the edit's share of the longer side; else 0.

    t: the token with its texts without one character, and with two swapped. A differing character in the middle of three leaves
    the outer two, with something between them.
    """
    token, shorter, swapped = t["token"], t["shorter"], t["swapped"]
    n = F.length(token)
    runs = lambda k: F.when(k == 1, F.col("__1")).when(k == 2, F.col("__2")).otherwise(F.col("__3"))
    parted = F.when(n == 2, F.array_contains("__2i", token)).otherwise(F.array_contains("__3i", token))
    less = F.arrays_overlap(shorter, runs(n - 1)) | ((n == 3) & F.arrays_overlap(shorter, "__2i"))
    return F.when(F.array_contains(runs(n), token), 1.0).when(n < 2, 0.0).when(parted, 1 - 1 / (n + 1)).when(less | F.arrays_overlap(swapped, runs(n)), 1 - 1 / n).otherwise(0.0)


def _shorter(c: Column) -> Column:
    return _each(c, lambda a, x, b: F.concat(a, b))


def _swapped(c: Column) -> Column:
    n = F.length(c)
    swap = lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.lit(1)), F.substring(c, i, F.lit(1)), F.substring(c, i + 2, n))
    return F.when(n >= 2, F.transform(F.sequence(F.lit(1), n - 1), swap)).otherwise(F.array().cast("array<string>"))


def scored_terms(bares: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(bare, entry, place, term, likeness, edits, left) of the terms that a bare value may mean."""
    terms = vocabulary.terms
    values = bares.withColumn("__c", _characters(F.col("bare")))
    values = values.select("bare", *(_runs(F.col("__c"), n).alias(f"__{n}") for n in range(1, LONGEST + 2)), _without_inner(F.col("__c"), 2).alias("__2i"), _without_inner(F.col("__c"), 3).alias("__3i"))
    pieces = values.select("bare", F.explode(F.array_distinct(F.concat(*(f"__{n}" for n in range(1, LONGEST + 2))))).alias("piece"))
    keyed = pieces.select("piece").distinct().select("piece", F.explode(_neighbourhood(F.col("piece"), False)).alias("key"))
    leading = terms.select("entry", "place", F.explode(_leading(vocabulary.least)).alias("token"))
    tokens = leading.select("token").distinct().select("token", F.explode(_neighbourhood(F.col("token"), True)).alias("key"))
    repaired = keyed.join(tokens, "key").select("piece", "token").distinct()
    held = pieces.join(repaired, "piece").select("bare", "token").distinct()
    found = held.join(leading, "token").select("bare", "entry", "place").distinct().join(terms, ["entry", "place"])
    # Weighing costs far more than its bytes tell, so its tasks are as many as a shuffle's, not as few as the bytes would do with.
    tasks = int(bares.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = found.repartition(tasks, "bare").join(values.drop(f"__{LONGEST + 1}"), "bare")
    own = F.zip_with("tokens", "weights", lambda t, w: w * _likeness(t))
    found = found.withColumn("likeness", F.aggregate(own, F.lit(0.0), lambda a, x: a + x) / F.col("total")).where(F.col("likeness") >= vocabulary.least - 1e-9)
    found = found.select("bare", "entry", "place", "term", "likeness", _placed("term", "bare").alias("__d"))
    found = found.select("bare", "entry", "place", "term", "likeness", F.col("__d")[0].alias("edits"), F.col("__d")[1].alias("left"))
    return found.where(F.col("edits") <= F.greatest(F.lit(1), F.floor(F.length("term") / 3)))


def map_values(df: DataFrame, keys: Sequence[str], value: str, vocabulary: Vocabulary) -> DataFrame:
    """The entry that each value means.

    Returns the keys, ``value``, ``entry_id`` ('none' if no entry is meant), ``term``, ``likeness`` and
    ``edits``. Null and empty values give no row; repeated rows stay; ties go to the longer term, then
    the entry of the least key; only the named columns are read, whole.

    Values are made distinct before anything is looked at, by an aggregation that begins before its shuffle, so a
    value that fills a third of the rows is repaired once; its rows meet the result in a join that adaptive
    execution splits. An entry is weighed only for values that hold a repaired token of those that make up most of its weight,
    which loses none that could reach ``least``.
    """
    rows = df.select(*(df[k] for k in keys), df[value].cast("string").alias("value")).where("value is not null and value <> ''")
    seen = checkpointed(rows.select("value").distinct().select("value", _bare("value").alias("x")).select("value", "x.bare", "x.codes"))
    scored = checkpointed(scored_terms(seen.select("bare").where("bare <> ''").distinct(), vocabulary))
    named = seen.select("value", F.explode("codes").alias("code")).join(vocabulary.codes, "code").groupBy("value").agg(F.collect_set("entry").alias("__named"))
    seen = seen.join(named, "value", "left")
    hit = F.coalesce(F.array_contains("__named", F.col("entry")), F.lit(False)).cast("int")
    # A long text that merely holds a short term isn't that entry.
    score = F.col("likeness") - 0.15 * F.col("edits") / F.length("term") - 0.05 * F.col("left") / F.greatest(F.lit(1), F.length("bare")) + 0.2 * hit
    ranked = seen.join(scored, "bare").select("value", F.struct(F.col("entry").alias("entry_id"), "term", "likeness", "edits").alias("__best"), F.struct(-score, -F.length("term"), "entry", "place").alias("__rank"))
    best = ranked.groupBy("value").agg(F.min_by("__best", "__rank").alias("__best"))
    by_code = F.when((F.col("bare") == "") & (F.size("__named") == 1), F.struct(F.get("__named", F.lit(0)).alias("entry_id"), F.lit(None).cast("string").alias("term"), F.lit(1.0).alias("likeness"), F.lit(0).alias("edits")))
    none = F.struct(F.lit(NONE).alias("entry_id"), F.lit(None).cast("string").alias("term"), F.lit(0.0).alias("likeness"), F.lit(None).cast("int").alias("edits"))
    meant = seen.join(best, "value", "left").select("value", F.coalesce("__best", by_code, none).alias("__best"))
    return rows.join(meant, "value").select(*keys, "value", "__best.entry_id", "__best.term", "__best.likeness", "__best.edits")
