import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from sluicework.llm.confusables import Plain, affected_values, confusable_tables, plain_forms


@pytest.fixture(scope="module")
def plain(spark):
    return Plain(confusable_tables(spark))


PLAIN = ["", "综合监理员(Москва联络)", "会计 Ω3室", "线 β线", "Café港", "Lǜyuán生态园", "II 区", "НИИ", "α", "A-1 [x]", "カニ", "一二"]
CASES = {
    "ＸＫ 37－00９": "XK 37-009", "NОVΑ-3 站": "NOVA-3 站", "ΝΟVΑ": "NOVA", "ΙΙ 区": "II 区", "急需社⼯": "急需社工", "理": "理", "巡\u200c回\ufeff": "巡回", "Café": "Café", "a\u00a0b　c": "a b c",
    "XK‑08−032": "XK-08-032", "Τ3": "T3", "Α1": "A1", "Mосква": "Москва", "⻅习": "见习", "𝟻𝟹": "53", "Саfé": "Café", "（x）": "(x)", "ロ岸": "口岸", "Ω3": "Ω3",
}


def test_cases(plain):
    plain_text = plain.text
    for text in PLAIN:
        assert plain_text(text) == text
    for text, want in CASES.items():
        assert plain_text(text) == want, text
    assert plain_text(None) is None
    assert plain_text("Ｘ" * 200_000) == "X" * 200_000


@settings(suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(text=st.text(st.characters(exclude_categories=("Cs",)), max_size=30))
def test_plain_form_is_stable(plain, text):
    once = plain.text(text)
    assert plain.text(once) == once
    assert unicodedata.is_normalized("NFC", once)


@settings(suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(code=st.text("ABCEHKMOPTX0123456789-", min_size=1, max_size=8), data=st.data())
def test_look_alikes_come_back(plain, code, data):
    pools = [plain.other[s] for s in ("CYRILLIC", "GREEK", "COPTIC", "LISU", "CHEROKEE")]
    disguised = "".join(data.draw(st.sampled_from([c, *(p[c] for p in pools if c in p)])) for c in code)
    assert plain.text(disguised) == code


def test_rows(spark):
    df = spark.createDataFrame([(1, "Ａ", None, "z"), (1, "Ａ", None, "z"), (2, "ok", "", "z"), (3, "—", "b\u200b", "z")], "id long, a string, b string, field_name string")
    got = sorted((r.id, r.field_name, r.value, r.plain_value) for r in affected_values(df, ["id"], ["a", "b"]).collect())
    assert got == [(1, "a", "Ａ", "A"), (1, "a", "Ａ", "A"), (3, "b", "b\u200b", "b")]
    assert plain_forms(df, ["id"], ["a", "b"]).count() == 8
    assert plain_forms(df.limit(0), ["id"], ["a", "b"]).count() == 0


def test_single_letters_of_other_scripts(plain):
    """Only a Greek letter stands for itself; a Cyrillic or Armenian one that looks Latin doesn't."""
    assert [plain.text(x) for x in ("3а区", "с", "5օ", "α", "3β线", "ж")] == ["3a区", "c", "5o", "α", "3β线", "ж"]


def test_mixed_tokens_without_a_common_script(plain):
    """к and W have no look-alikes in each other's script: the token isn't plain, and takes the spelling of most of it."""
    assert [plain.text(x) for x in ("WкAВ", "Мoсква", "Wѕк")] != ["WкAВ", "Мoсква", "Wѕк"] and plain.text("Мoсква") == "Москва"
