import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sluicework.operators.multivalue import split_packed

CASES = {
    "甲、乙,丙": ["甲", "乙", "丙"],
    "证(初级、中级)；A1证/B2证": ["证(初级、中级)", "A1证", "B2证"],
    "“甲、乙类”，“丙”": ["甲、乙类", "丙"],
    '"甲；乙""丙""","丁"': ['甲；乙"丙"', "丁"],
    "①甲②乙 ③丙": ["甲", "乙", "丙"],
    "（1）甲（2）乙【师范】（3）丙。": ["甲", "乙【师范】", "丙"],
    "1、甲证（A、B类）;2、乙证": ["甲证（A、B类）", "乙证"],
    "1.2年经历;2.3年经历": ["1.2年经历", "2.3年经历"],
    "1. 甲。2. 乙。": ["甲", "乙"],
    '["甲（一、二）", "乙", ""]': ["甲（一、二）", "乙"],
    "['甲', x": ["['甲'", "x"],
    "［“甲、乙”，“丙”］": ["甲、乙", "丙"],
    "，甲，，乙 ，": ["甲", "乙"],
    "甲和乙或丙": ["甲和乙或丙"],
    " 甲　\n乙 ｜ 丙": ["甲", "乙", "丙"],
    '甲"乙、丙': ['甲"乙', "丙"],
    "甲（乙、丙": ["甲（乙", "丙"],
    "甲\ue0000\ue001、乙": ["甲\ue0000\ue001", "乙"],
    "「甲,乙」": ["甲,乙"],
    "不限": [], "  ": [], "": [], "—": [], "unknown": [], None: [],
    "无、甲": ["无", "甲"],
    "((甲、乙)、丙)、丁": ["((甲、乙)、丙)", "丁"],
    "(((甲、乙)、丙)、(丁))、戊": ["(((甲、乙)、丙)、(丁))", "戊"],
    "[甲[乙、丙]、丁]、戊、《己《庚、辛》》": ["[甲[乙、丙]、丁]", "戊", "《己《庚、辛》》"],
    "甲((乙、丙)、丁": ["甲((乙、丙)", "丁"], "甲)、(乙(丙、丁)))、戊": ["甲)", "(乙(丙、丁)))", "戊"],
    "（" + "（、）" * 60 + "、甲）、乙": ["（" + "（、）" * 60 + "、甲）", "乙"],
    "(甲、【乙(丙、丁)】)、戊": ["(甲、【乙(丙、丁)】)", "戊"],
    "甲；" + " " * 30 + "2、乙": ["甲", "乙"],
}


def values(spark, texts):
    df = spark.createDataFrame([(i, t, "n", 7) for i, t in enumerate(texts)], "id long, f string, field_name string, item_no int")
    out = {i: [] for i in range(len(texts))}
    for r in split_packed(df, ["id"], ["f"]).orderBy("id", "item_no").collect():
        out[r.id].append(r.item_value)
        assert r.item_no == len(out[r.id])
    return list(out.values())


def test_cases(spark):
    assert values(spark, list(CASES)) == list(CASES.values())


def test_counts_repeats_and_empty_tables(spark):
    df = spark.createDataFrame([("a", "x、y", None), ("a", "x、y", "z"), (None, "u;v;w", "-")], "k string, f string, g string")
    got = sorted((r.k or "", r.field_name, r.item_no, r.item_value, r.n_items) for r in split_packed(df, ["k"], ["f", "g"]).collect())
    assert got == sorted([("a", "f", 1, "x", 2), ("a", "f", 2, "y", 2)] * 2 + [("a", "g", 1, "z", 1), ("", "f", 1, "u", 3), ("", "f", 2, "v", 3), ("", "f", 3, "w", 3)])
    assert split_packed(df.limit(0), ["k"], ["f"]).count() == 0


@pytest.mark.parametrize("text,n", [("甲、" * 50_000, 50_000), ('"' * 100_001, None), ("(" * 50_000 + ")" * 50_000, None), ("“" * 60_000, None)])
def test_long(spark, text, n):
    got = values(spark, [text])[0]
    assert n is None or len(got) == n


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["", '"', "“", "「"]), st.text("甲乙ab、；,/()", min_size=1, max_size=6)), min_size=1, max_size=6))
def test_round_trip(spark, parts):
    """Quoted values come back as they were."""
    close = {'"': '"', "“": "”", "「": "」"}
    want, text = [], []
    for q, v in parts:
        q = q or '"'
        want.append(v)
        text.append(q + v + close[q])
    assert values(spark, [";".join(text)])[0] == want
