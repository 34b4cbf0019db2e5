import itertools
import random

from sluicework.llm.neardup import _ANCHORS, _CODE, _DISTANCE, class_rows, id_pairs, likeness, meeting_probability, normal, similar_classes


def test_code_covers_and_close_words_meet():
    assert len(_CODE) == 16 and (_DISTANCE.min(axis=1) <= 1).all()
    for w, own in enumerate(_ANCHORS):
        assert _DISTANCE[w, list(_CODE).index(own[0])] <= 1
        for bit in range(7):
            assert own[0] in _ANCHORS[w ^ 1 << bit]  # within the threshold of 1, each meets at the other's home
    assert meeting_probability(1.0, 3) == 1.0 and meeting_probability(0.6, 3) < meeting_probability(0.8, 3)


def brute(rows, gram, threshold):
    ids: dict = {}
    for i, t in rows:
        if i is not None and t is not None and len(normal(t)) >= gram:
            ids.setdefault(i, set()).add(normal(t))
    return sorted((a, b) for a, b in itertools.combinations(sorted(ids), 2) if any(likeness(x, y, gram) >= threshold for x in ids[a] for y in ids[b]))


def test_against_brute_force(spark):
    rng = random.Random(8)
    letters = "甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳午未申酉戌亥天地玄黄宇宙洪荒"
    rows = []
    for n in range(60):
        base = "".join(rng.choice(letters) for _ in range(rng.randint(30, 200)))
        for k in range(rng.choice([1, 1, 2, 4])):
            t = list(base)
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(len(t))] = rng.choice(letters)
            cut = rng.randrange(len(t)) if rng.random() < 0.3 else 0
            rows.append((f"{n}-{k}", "".join(t[cut:] + t[:cut])))
    rows += [("e1", ""), ("e2", None), (None, "甲乙丙丁戊己"), ("c1", "ＡＢＣ 甲乙丙丁"), ("c2", "abc甲乙\n丙丁"), ("c2", "abc甲乙\n丙丁"), ("s1", "甲"), ("s2", "甲"), ("l1", "甲乙丙" * 40_000), ("l2", "甲乙丙" * 39_000)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "id string, t string, a long, cls string")
    for gram, threshold in ((3, 0.6), (5, 0.7)):
        got = sorted((r.id_a, r.id_b) for r in id_pairs(*similar_classes(df, "id", "t", gram, threshold)).collect())
        want = brute(rows, gram, threshold)
        assert set(got) <= set(want) and len(got) >= 0.99 * len(want) and len(got) == len(set(got))
    assert id_pairs(*similar_classes(df.limit(0), "id", "t", 3, 0.6)).count() == 0


def test_many_copies_are_one_class(spark):
    df = spark.range(3000).selectExpr("cast(id AS string) AS id", "if(id < 1000, '同一文本的许多副本在此', concat('另一文本', id, '号与众不同', id * 7919)) AS t")
    pairs, members = similar_classes(df, "id", "t", 3, 0.9)
    assert members.groupBy("cls").count().agg({"count": "max"}).first()[0] == 1000
    assert pairs.where("a = b").count() == 0


def test_an_id_with_two_texts(spark):
    """Each text is checked against its own class's: no pair comes from the other text of the same id."""
    one, two, near = "甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳", "天地玄黄宇宙洪荒日月盈昃辰宿列张", "天地玄黄宇宙洪荒日月盈昃辰宿列法"
    rows = [("a", one), ("a", two), ("b", near), ("c", one)]
    df = spark.createDataFrame(rows, "id string, t string")
    got = sorted((r.id_a, r.id_b) for r in id_pairs(*similar_classes(df, "id", "t", 3, 0.6)).collect())
    assert got == [("a", "b"), ("a", "c")]


def test_class_rows(spark):
    texts = ["甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳", "甲乙丙丁戊己庚辛壬癸子丑寅卯辰午", "天地玄黄宇宙洪荒日月盈昃辰宿列张"]
    rows = [(f"{n}", texts[n // 3]) for n in range(9)]
    got = {r.id: (r.class_id, r.links) for r in class_rows(*similar_classes(spark.createDataFrame(rows, "id string, t string"), "id", "t", 3, 0.6)).collect()}
    assert got == {str(n): (str(n // 3 * 3), 0 if n > 5 else 1) for n in range(9)}


def test_nothing_unbounded_is_broadcast(spark, tmp_path):
    """However small Spark takes the tables for, only the bitmap of fixed size is broadcast."""
    df = spark.createDataFrame([("a", "甲乙丙丁戊己庚辛壬癸"), ("b", "甲乙丙丁戊己庚辛壬子")], "id string, t string")
    df.write.parquet(f"{tmp_path}/t")
    pairs, members = similar_classes(spark.read.parquet(f"{tmp_path}/t"), "id", "t", 3, 0.6)
    for out in (id_pairs(pairs, members), class_rows(pairs, members)):
        joins = [x for x in out._jdf.queryExecution().executedPlan().toString().split("\n") if "BroadcastHashJoin" in x or "BroadcastNestedLoopJoin" in x]
        assert joins and all("__part" in x for x in joins), joins
