import math
import random

import numpy as np
import pytest

from sluicework.llm.languages import LANGUAGES, Scorer, fit_scorer, label_language, label_segments, load_pieces, path_of, words_of

DATA = "/root/testdata/sf0.01"


def test_labels():
    assert [label_language(x) for x in ("zh_Hans", "ZHO", "EN", "pt-PT", "English", "deu", " fr ", "xx", None, "", "und")] == ["zh", "zh", "en", "pt", "en", "de", "fr", None, None, None, None]


def test_forward_sums_all_segmentations():
    s = Scorer(["▁a", "a", "b", "ab", "▁ab", "ba", "▁", "▁aba", "数", "据", "数据"])
    rng = np.random.default_rng(1)
    p = rng.uniform(0.01, 0.5, (len(s.ids) + 1, len(LANGUAGES)))
    sizes = np.array([*map(len, s.ids), 1], float)[:, None]
    s.odds = p * s.SCALE**sizes

    def total(text, at=0):
        if at == len(text):
            return np.ones(len(LANGUAGES))
        out = np.zeros(len(LANGUAGES))
        for end in range(at + 1, len(text) + 1):
            k = s.ids.get(text[at:end])
            if k is not None:
                out = out + p[k] * total(text, end)
        if text[at] not in s.ids:
            out = out + p[-1] * total(text, at + 1)
        return out

    for word in ("abab", "a", "bbab", "数据"):
        marked = word if word == "数据" else "▁" + word
        assert np.allclose(s.forward(word), np.log(total(marked)))
    got, n = s.scores(["数据abab", "abab abab", "1234", "数 据"])
    assert np.allclose(got[0], s.forward("数据") + s.forward("abab")) and np.allclose(got[1], 2 * s.forward("abab"))
    assert np.allclose(got[3], s.forward("数") + s.forward("据")) and n[2] == 0


def test_path_against_all_paths():
    rng = np.random.default_rng(3)
    for _ in range(20):
        scores = rng.normal(0, 5, (4, 3))
        best = max(np.ndindex(3, 3, 3, 3), key=lambda p: sum(scores[i, k] for i, k in enumerate(p)) - 6 * sum(a != b for a, b in zip(p, p[1:])))
        assert tuple(path_of(scores, 6.0)) == best


@pytest.fixture(scope="module")
def scorer(spark):
    return fit_scorer(spark.read.parquet(f"{DATA}/documents.parquet"), "text", "lang")


def test_held_out_accuracy(spark, scorer):
    """Documents beyond the sample, with labels that name a language: most labels are right."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = label_segments(docs, "doc_id", "text", "lang", scorer).where("segment_no = 1 and n_segments = 1").join(docs.selectExpr("doc_id", "lang AS label"), "doc_id").collect()
    named = [(label_language(r.label), r.lang) for r in rows if label_language(r.label)]
    assert sum(a == b for a, b in named) > 0.85 * len(named) and all(0 < r.confidence <= 1 for r in rows)


def test_mixed_and_edges(spark, scorer):
    zh, en, de = "外地人员可申请远程核验，资格终审会议改在本区召开。", "The list hangs in the hall, so please plan ahead.", "Die Liste hängt im Foyer, und Gebühren fallen nicht an."
    rows = [(1, f"{zh}\n{zh} {en} {en}\n{de}", "zh"), (2, None, "en"), (3, "", "en"), (4, "12 34 --", None), (5, zh * 3000, "fr"), (6, f"{zh}(OA){zh}", "zh-CN"), (6, f"{zh}(OA){zh}", "zh-CN"), (7, "ｔｈｅ ｌｉｓｔ ｈａｎｇｓ ｉｎ ｔｈｅ ｈａｌｌ", "eng")]
    df = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, lang string, segment_no int")
    got: dict = {}
    for r in label_segments(df, "doc_id", "text", "lang", scorer).orderBy("doc_id", "segment_no").collect():
        got.setdefault(r.doc_id, []).append((r.segment_no, r.lang, r.label_right))
    assert got == {1: [(1, "zh", True), (2, "en", True), (3, "de", True)], 5: [(1, "zh", False)], 6: [(1, "zh", True)] * 2, 7: [(1, "en", True)]}
    assert label_segments(df.limit(0), "doc_id", "text", "lang", scorer).count() == 0


def test_pieces_never_cross_words():
    assert all("▁" not in p[1:] for p in Scorer(load_pieces()).ids)
    assert words_of("a-b https://x.y/z 数据ß") == ["a", "b", "数", "据", "ß"]
    assert math.isfinite(float(Scorer(["▁a"]).forward("z" * 500).sum()))


def test_long_words_are_scored_whole():
    """A word of sixty letters and more is summed over all of its segmentations, by logarithms; so is what it adds to the fit."""
    pieces = ["▁", "ab", "ba", "aba", "a", "b", "abab", "▁ab"]
    rng = np.random.default_rng(5)
    words = {"".join(rng.choice(["a", "b"], n)): rng.uniform(0.5, 3, len(LANGUAGES)) for n in (5, 47, 60, 75)}
    short, long = Scorer(pieces), Scorer(pieces)
    short.LONG, long.LONG = 10_000, 3
    short.fit(words, rounds=2)
    long.fit(words, rounds=2)
    assert np.allclose(short.odds, long.odds)
    for w in words:
        assert np.allclose(short.forward(w), long.forward(w))
    assert np.isfinite(long.forward("ab" * 5000)).all()
