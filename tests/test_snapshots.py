import random

from sluicework.operators.snapshots import snapshot_changes

SCHEMA = "no int, at int, id string, url string, text string, snapshot_no int, change string"


def run(spark, rows):
    df = spark.createDataFrame([(*r, 9, "x") for r in rows], SCHEMA)
    return sorted((r.snapshot_no, r.id or "", r.change) for r in snapshot_changes(df, "id", "no", ["url", "text"], "at").collect())


def brute(rows):
    best: dict = {}
    for no, at, key, url, text in rows:
        if no is not None:
            best.setdefault(no, {}).setdefault(key, []).append((at, url, text))
    held = {no: {k: max(v, key=lambda x: x[0])[1:] for k, v in own.items()} for no, own in best.items()}
    out, numbers = [], sorted(held)
    for a, b in zip(numbers, numbers[1:]):
        for k in held[a].keys() | held[b].keys():
            change = "added" if k not in held[a] else "removed" if k not in held[b] else "changed" if held[a][k] != held[b][k] else None
            if change:
                out.append((b, k or "", change))
    return sorted(out)


def test_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(rng.choice([1, 2, 4, 7, None]), n, rng.choice("abcdefgh"), rng.choice([None, "", "u"]), rng.choice([None, "", "t", "长" * 2000])) for n in range(300)]
    assert run(spark, rows) == brute(rows)


def test_null_is_not_empty_and_borders_count(spark):
    rows = [(1, 0, "a", None, "x"), (2, 0, "a", "", "x"), (1, 0, "b", "xy", "z"), (2, 0, "b", "x", "yz"), (1, 0, "c", None, None), (2, 0, "c", None, None)]
    assert run(spark, rows) == [(2, "a", "changed"), (2, "b", "changed")]


def test_gap_repeats_and_edges(spark):
    rows = [(1, 0, "a", "u", "t"), (1, 0, "a", "u", "t"), (3, 0, "b", "u", "t"), (9, 0, "a", "u", "t"), (9, 1, None, "u", "t")]
    assert run(spark, rows) == [(3, "a", "removed"), (3, "b", "added"), (9, "", "added"), (9, "a", "added"), (9, "b", "removed")]
    assert run(spark, []) == []
    assert run(spark, [(5, 0, "a", "u", "t")]) == []
