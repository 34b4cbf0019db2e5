import random

import pytest

from sluicework.llm import mojibake
from sluicework.llm.mojibake import PAIRS, find_garbled, fit_model, garble

DATA = "/root/testdata/sf0.01"
MAIN = [p for p in PAIRS if p in {("utf-8", "cp1252"), ("utf-8", "gb18030"), ("utf-8", "cp437"), ("gb18030", "cp1252"), ("gb18030", "big5"), ("utf-8", "cp932"), ("gb18030", "utf-8")}]


@pytest.fixture(scope="module")
def fitted(spark):
    df = spark.read.parquet(f"{DATA}/evidence_version.parquet").select("id", "extracted_text")
    return df, fit_model(df, "extracted_text", 400)


def test_planted_passages(spark, fitted):
    """Clean lines are garbled by us: found again, and where nothing was lost restored exactly."""
    df, model = fitted
    rng = random.Random(4)
    lines = [x for r in df.collect() if r.extracted_text for x in r.extracted_text.split("\n") if len(x) > 12 and not x.isascii()]
    clean = [x for x in rng.sample(lines, 600) if not model.suspects([x])]
    assert len(clean) > 500
    found = exact = whole = 0
    for x in clean[:300]:
        pair = rng.choice(MAIN)
        bad = garble(x, pair)
        text, spans, _ = model.repaired(bad)
        found += spans > 0
        try:
            possible = mojibake._written(bad, pair[1]).decode(pair[0]) == x and "�" not in bad
        except UnicodeError:
            possible = False
        whole += possible
        exact += possible and text == x
    assert found > 0.97 * 300 and exact > 0.9 * whole


def test_prune_is_exact(fitted):
    df, model = fitted
    lines = [x for r in df.limit(150).collect() for x in (r.extracted_text or "").split("\n")]
    kept = set(model.suspects(lines))
    assert all((i in kept) == bool(model.spans(x)) for i, x in enumerate(lines))


def test_rows_and_edges(spark, fitted):
    _, model = fitted
    bad = garble("体检地点设在指定机构，准入证明可在自助打印。", ("utf-8", "cp1252"))
    rows = [(1, f"报名办法\n{bad}", "r"), (1, f"报名办法\n{bad}", "r"), (2, None, None), (3, "", ""), (4, "Die Liste hängt im Foyer, Gebühren für Müller.", "x"), (5, "体检地点" * 60_000, "x"), (6, '["a", broken', "x")]
    df = spark.createDataFrame(rows, "id long, t string, restored string")
    got = [(r.id, r.restored, r.spans, r.spans_restored) for r in find_garbled(df, ["id"], "t", model).collect()]
    assert got == [(1, "报名办法\n体检地点设在指定机构，准入证明可在自助打印。", 1, 1)] * 2
    assert find_garbled(df.limit(0), ["id"], "t").count() == 0


def test_copies_of_a_garbled_passage(spark):
    """A garbled line, and a garbled cell in rows that differ elsewhere, are found however many rows hold them."""
    from pyspark.sql import functions as F

    df = spark.read.parquet(f"{DATA}/position_record.parquet").where("raw_row is not null").selectExpr("id", "raw_row AS t")
    copied = "医疗卫生服务中心检验技师"
    for pair in (("gb18030", "latin-1"), ("utf-8", "latin-1")):
        bad = garble(copied, pair)
        line = spark.range(150).selectExpr("concat('l', id) AS id").withColumn("t", F.lit(bad))
        cell = spark.range(150).selectExpr("concat('c', id) AS id", "id * 7919 AS n").select("id", F.concat(F.lit('["'), "n", F.lit(f'", "{bad}", "'), F.col("n") * 31, F.lit('"]')).alias("t"))
        found = {r.id for r in find_garbled(df.unionByName(line).unionByName(cell), ["id"], "t", sample_rows=40).collect()}
        assert {x for x in (f"{k}{n}" for k in "lc" for n in range(150)) if x not in found} == set()


def test_garbled_twice(spark, fitted):
    """Text read as Latin twice is one span of a composed state, and comes back whole; so does a lone sign."""
    _, model = fitted
    clean = "岚坪县渊航道测绘保障队统筹营养师"
    for chain in mojibake.CHAINS[len(PAIRS) :]:
        text, spans, _ = model.repaired(garble(clean, *chain))
        assert spans and text == clean, chain
    df = spark.read.parquet(f"{DATA}/position_record.parquet").where("raw_row is not null").selectExpr("id", "raw_row AS t")
    bad = garble(clean, ("utf-8", "cp1252"), ("utf-8", "cp1252"))
    rows = [("a", f'["1", "{bad}", "AB-01", "本科"]'), ("b", f'["2", "AB-02", "{bad}"]')]
    found = {r.id: r.restored for r in find_garbled(df.unionByName(spark.createDataFrame(rows, "id string, t string")), ["id"], "t", sample_rows=400).collect()}
    assert [found.get(i) for i, _ in rows] == [t.replace(bad, clean) for _, t in rows]
    sign = "Copyright © 2021-2026 Nerserbel All rights reserved"
    assert model.repaired(garble(sign, ("utf-8", "latin-1")))[0] == sign


def test_characters_beyond_the_first_plane(fitted):
    """They have symbols of their own, in blocks of 256, and come through unchanged."""
    _, model = fitted
    assert len(set(mojibake.code_points("\U00010000\U00020000\U0001f600").tolist())) == 3
    text = "报名办法😀𠮷地点" + garble("体检地点设在指定机构，准入证明可在自助打印。", ("utf-8", "cp1252"))
    assert model.repaired(text)[0] == "报名办法😀𠮷地点体检地点设在指定机构，准入证明可在自助打印。"


def test_no_more_is_undone_than_tells(fitted, monkeypatch):
    """Once a span is whole, no other state is tried on it; whether a line is garbled takes no more tries than to restore it."""
    _, model = fitted
    lines = [garble(x, p) for p in MAIN for x in ("体检地点设在指定机构，准入证明可在自助打印。", "报名办法", "岚坪县渊航道测绘保障队统筹营养师")] + ["报名办法", "", "Gebühren für Müller"]
    whole = []
    undone = mojibake.Model._undone
    monkeypatch.setattr(mojibake.Model, "_undone", lambda self, line, *span: whole.append((line, span[:2], x := undone(self, line, *span))) or x)
    for line in lines:
        whole.clear()
        found = model.repaired(line)[1]
        tries = [(span, x) for own, span, x in whole if own == line]
        assert all(own != span for k, (span, x) in enumerate(tries) if x and x[3] for own, _ in tries[k + 1 :])
        most = len(whole)
        whole.clear()
        assert model.is_garbled(line) == (found > 0) and len(whole) <= most


def test_lines_are_labelled_together(fitted, monkeypatch):
    """Lines of all lengths at once have the spans that each has alone, and are found in a few steps, not one after the other."""
    df, model = fitted
    rng = random.Random(7)
    lines = list(dict.fromkeys(x for r in df.limit(200).collect() if r.extracted_text for x in r.extracted_text.split("\n") if len(x) > 12 and not x.isascii()))
    bad = [garble(x, rng.choice(MAIN)) for x in lines[:300]] + ["", "x", "\U0001f600"]
    plain = lambda spans: [(start, end, chain, gains.tolist()) for start, end, chain, gains in spans]
    alone = [plain(model.spans(x)) for x in bad]
    assert [s for _, s in sorted((i, plain(s)) for i, s in model.spans_of(bad))] == alone and sum(map(bool, alone)) > 250
    calls, keys_of = [], mojibake.keys_of
    monkeypatch.setattr(mojibake, "keys_of", lambda *a: calls.append(1) or keys_of(*a))
    monkeypatch.setattr(mojibake.Model, "repaired", lambda self, line, *spans: (line, 1, 1))
    mojibake.Repairs(model).of(bad)
    assert len(calls) < 30


def test_cp1252_as_browsers_read_it():
    """All bytes, the five undefined ones as latin-1; read by a table, since looking up each character took about half of the driver's time in p1_found."""
    from sluicework.llm import mojibake

    want = "".join(chr(b) if b in mojibake._UNDEFINED else bytes([b]).decode("cp1252") for b in range(256))
    assert mojibake._read(bytes(range(256)), "cp1252", "replace") == want and len(mojibake._CP1252) == 256
