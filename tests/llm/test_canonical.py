import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from sluicework.llm import canonical
from sluicework.llm.canonical import NONE, build_vocabulary, map_values, normal, placed_distance

DATA = "/root/testdata/sf0.01"


@settings(max_examples=60, deadline=None)
@given(st.text("abcd", min_size=1, max_size=5), st.text("abcd", max_size=7))
def test_distance_against_brute_force(term, value):
    def osa(a, b):
        d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return d[-1][-1]

    want = min(osa(term, value[i:j]) for i in range(len(value) + 1) for j in range(i, len(value) + 1))
    assert placed_distance(term, value)[0] == want


def mapped(spark, v, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, w string")
    got = {r.id: r.entry_id for r in map_values(df, ["id"], "w", v).collect()}
    return [got.get(i) for i in range(len(texts))]


@pytest.fixture(scope="module")
def majors(spark):
    return build_vocabulary(spark.read.parquet(f"{DATA}/major_catalog.parquet"), "catalog_id", "catalog_name", "aliases", "major_code")


def test_planted_edits(spark, majors):
    rng = random.Random(6)
    texts, want = [], []
    for term, own in rng.sample(sorted((r.term, r.entry) for r in majors.terms.collect() if len(r.term) >= 4), 150):
        i = rng.randrange(len(term) - 1)
        edits = [term[:i] + term[i + 1 :], term[:i] + term[i] + term[i:], term[:i] + "之" + term[i + 1 :], term[:i] + term[i + 1] + term[i] + term[i + 2 :], term[:i] + " " + term[i:]]
        for e in edits:
            for text in (e, "大学本科" + e, e + "等专业", e + "（急需，外勤）", "【师范】" + e):
                texts.append(text)
                want.append(own)
    right = sum(a == b for a, b in zip(mapped(spark, majors, texts), want))
    assert right > 0.99 * len(want)
    assert mapped(spark, majors, ["见备注栏", "鹰隼驯养综合", "", "　", "x" * 100_000]) == [NONE, NONE, None, NONE, NONE]
    a, b = mapped(spark, majors, ["海圖編繪學", "海图编绘学"])
    assert a == b != NONE


def test_tokens_decide(spark, majors, monkeypatch):
    """Without the repair of tokens the edited values are lost: no other path stands in for it."""
    terms = sorted((r.term, r.entry) for r in majors.terms.collect() if len(r.term) >= 5)[:60]
    texts = [t[:1] + t[2] + t[1] + t[3:] for t, _ in terms if t[1] != t[2]]
    assert NONE not in mapped(spark, majors, texts)
    monkeypatch.setattr(canonical, "_likeness", lambda t: F.lit(0.0))
    assert set(mapped(spark, majors, texts)) == {NONE}


def test_scores_against_brute_force(spark, majors):
    """Every term of enough weight is found by the join, with the weight that trying all tokens gives."""

    def near(token, value):
        best = 0.0
        for k in range(max(1, len(token) - 1), len(token) + 2):
            for i in range(len(value) - k + 1):
                g = value[i : i + k]
                d = placed_distance(token, g)[0] if len(g) <= len(token) else placed_distance(g, token)[0]
                swap = len(g) == len(token) and any(g == token[:j] + token[j + 1] + token[j] + token[j + 2 :] for j in range(len(token) - 1))
                if g == token:
                    best = 1.0
                elif len(token) > 1 and (swap or (d <= 1 and abs(len(g) - len(token)) <= 1 and is_edit(token, g))):
                    best = max(best, 1 - 1 / max(len(g), len(token)))
        return best

    def is_edit(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) <= 1
        short, long = sorted((a, b), key=len)
        return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))

    rng = random.Random(11)
    terms = majors.terms.collect()
    values = []
    for r in rng.sample(terms, 25):
        t = list(r.term)
        i = rng.randrange(len(t) - 1)
        t[i], t[i + 1] = t[i + 1], t[i]
        values += ["".join(t), r.term[: i] + r.term[i + 1 :] + "系"]
    values = sorted(set(values))
    got = {(r.bare, r.entry, r.place): r.likeness for r in canonical.scored_terms(spark.createDataFrame([(v,) for v in values], "bare string"), majors).collect()}
    want = {}
    for v in values:
        for r in terms:
            likeness = sum(w * near(t.token, v) for t, w in zip(r.tokens, r.weights)) / r.total
            if likeness >= 0.6 and placed_distance(r.term, v)[0] <= max(1, len(r.term) // 3):
                want[v, r.entry, r.place] = likeness
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_rows_and_edges(spark):
    reference = spark.createDataFrame([("A", "port dredging", [None, ""], "110501"), ("B", "Sea ice", ["Marine Ice"], None), ("C", None, None, None), (None, "x", None, "9999")], "id string, name string, other string array, code string".replace("other string array", "other array<string>"))
    v = build_vocabulary(reference, "id", "name", "other", "code")
    df = spark.createDataFrame([(1, "PORT  dredgin", "q"), (1, "PORT  dredgin", "q"), (2, None, ""), (3, "", "x"), (4, "110501", "x"), (5, "astronomy", "x"), (6, "Marne ice", None)], "id long, w string, value string")
    got = sorted((r.id, r.entry_id) for r in map_values(df, ["id"], "w", v).collect())
    assert got == [(1, "A"), (1, "A"), (4, "A"), (5, "none"), (6, "B")]
    assert map_values(df.limit(0), ["id"], "w", v).count() == 0
    none = build_vocabulary(reference.limit(0), "id", "name", "other", "code")
    assert [r.entry_id for r in map_values(df.limit(1), ["id"], "w", none).collect()] == [NONE]
    assert normal(" Ａ\u200b 學") == "a学"
