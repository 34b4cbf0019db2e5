import random

from sluicework.llm.leaks import ItemIndex, find_leaks, leaked_in, reduced

ITEM = "Das Lager zählt 3455 Säcke, dann kommen 3197 hinzu; wie viele bleiben? 仓中余米六千石又运来七千石"


def brute(docs, items, n=30):
    runs = {i: {reduced(t)[k : k + n] for k in range(len(reduced(t)) - n + 1)} for i, t in items}
    return sorted((d, i) for d, t in docs for i in runs if any(reduced(t)[k : k + n] in runs[i] for k in range(len(reduced(t)) - n + 1)))


def test_block_max_wand_against_brute_force(spark):
    rng = random.Random(2)
    words = [("".join(rng.choice("abcde") for _ in range(rng.randint(1, 4)))) for _ in range(12)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(5, 60)))) for i in range(90)]
    docs = []
    for d in range(250):
        parts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))]
        if rng.random() < 0.5:
            t = rng.choice(items)[1]
            a = rng.randint(0, len(t))
            parts.insert(rng.randint(0, 1), t[a : a + rng.randint(10, 90)].upper())
        docs.append((d, "; ".join(parts)))
    index = ItemIndex([i for i, _ in items], [t for _, t in items], ["A"] * len(items), 30)
    got = sorted((docs[n][0], index.ids[i]) for n, i, *_ in leaked_in(index, [reduced(t) for _, t in docs], 50))
    assert got == brute(docs, items) and len(got) > 30
    frame = find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, t, "A") for i, t in items], "item_id long, text string, answer string"), index_chars=2000)
    assert sorted((r.doc_id, r.item_id) for r in frame.collect()) == got  # several blocks of items


def test_edges(spark):
    items = spark.createDataFrame([(1, ITEM, "B", 0), (2, ITEM, "C", 0), (3, "short", "A", 0), (4, None, None, 0)], "item_id long, text string, answer string, run_chars int")
    cut = ITEM.replace(" ", "　").upper()
    rows = [(1, "x" * 300_000 + cut + " B", "en"), (1, "x" * 300_000 + cut + " B", "en"), (2, None, ""), (3, "", None), (4, cut[:38], "x"), (None, ITEM, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    got = sorted((r.doc_id or 0, r.item_id, r.run_chars > 50, r.answer_follows) for r in find_leaks(docs, items).collect())
    assert got == sorted([(1, 1, True, True), (1, 2, True, False)] * 2 + [(0, 1, True, False), (0, 2, True, False)] + ([(4, 1, False, False), (4, 2, False, False)] if len(reduced(cut[:38])) >= 30 else []))
    assert find_leaks(docs.limit(0), items).count() == 0
    assert find_leaks(docs, items.limit(0)).count() == 0
