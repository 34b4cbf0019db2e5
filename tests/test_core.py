"""Core operators on small literal tables."""

import random

import pytest
from pyspark.sql import functions as F

from sluicework.functions import text as tx
from sluicework.functions import urls
from sluicework.operators import catalog, health, match, topk, triage, validate, versions
from sluicework.plans import notices

P = triage.Policy(include=("招聘", ""), exclude=("培训",), workflow=("公告",), process=("面试",))


def test_triage_is_total_and_ordered(spark):
    titles = ["招聘公告", "招聘面试公告", "培训", "培训招聘", "公告", "其他", "", None, "ＡＢ\ufeff 招 聘"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "id int, t string").withColumn("n", tx.normal_text(F.col("t")))
    got = [(r.d, list(r.m)) for r in df.select("id", triage.triage(F.col("n"), P).alias("x")).orderBy("id").selectExpr("x.decision AS d", "x.matched_terms AS m").collect()]
    assert got == [("candidate", ["公告", "招聘"]), ("noise", ["面试"]), ("noise", ["培训"]), ("needs_review", ["培训", "招聘"]), ("needs_review", ["公告"]), ("noise", []), ("noise", []), ("noise", []), ("candidate", ["招聘"])]


def test_policies_by_row(spark):
    n = spark.createDataFrame([("a", "招聘公告", 1), ("b", "公告", 2), ("c", "招聘", 9)], "id string, t string, v int")
    p = spark.createDataFrame([(1, ["招聘"], [], None, ["x"]), (2, [], ["公告"], [""], [])], "v int, include_any array<string>, exclude_any array<string>, workflow_terms array<string>, process_terms array<string>")
    assert {r.id: r.new_decision for r in triage.triage_with_policies(n, p, "t", ["v"]).collect()} == {"a": "candidate", "b": "noise", "c": None}


def test_latest_ties_and_nulls(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("a", 2, "y"), (None, 1, "z"), ("b", None, "w")], "k string, at int, v string")
    got = sorted((r.k or "", r.at, r.v) for r in versions.latest(df, ["k"], ["at"]).collect())
    # Of rows alike in the order one is taken, the same whatever their order of arrival.
    assert got in ([("", 1, "z"), ("a", 2, v), ("b", None, "w")] for v in (None, "y"))
    assert got == sorted((r.k or "", r.at, r.v) for r in versions.latest(df.orderBy("v").repartition(3), ["k"], ["at"]).collect())
    assert versions.latest(df.limit(0), ["k"], ["at"]).count() == 0


def test_upsert_keeps_old_and_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a", "d1"), (2, "b", "d2")], "id int, v string, d string")
    new = spark.createDataFrame([(2, "c", None), (3, None, "d3"), (3, "e", "d4")], "id int, v string, d string")
    once = versions.upsert(old, new, ["id"], ["d"], ["d"])
    want = [(1, "a", "d1"), (2, "c", "d2"), (3, "e", "d4")]
    assert sorted(map(tuple, once.collect())) == want
    assert sorted(map(tuple, versions.upsert(once, new, ["id"], ["d"], ["d"]).collect())) == want
    assert versions.insert_or_ignore(old, new, ["id"]).count() == 1 and versions.insert_or_ignore(once, new, ["id"]).count() == 0


def test_versions_and_changes(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("a", 3, None), ("a", 4, None), ("a", 5, "x"), ("b", 1, None)], "k string, n int, v string")
    assert [(r.n, r.old_value, r.v) for r in versions.changes(df, "k", ["n"], "v").orderBy("n").collect()] == [(3, "x", None), (5, None, "x")]
    assert [r.version for r in versions.version_numbers(df, "k", ["n"], "v").orderBy("k", "n").collect()] == [1, 1, 2, 2, 3, 1]


def test_failures_against_a_loop(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), i, rng.choice([True, True, False, None])) for i in range(60)]
    run: dict = {}
    want = []
    for k, i, bad in rows:
        run[k] = run.get(k, 0) + 1 if bad else 0
        want.append((i, run[k], "degraded" if run[k] >= 3 else "enabled", min(3600, 300 * 2 ** min(run[k], 3))))
    got = health.failures_in_row(spark.createDataFrame(rows, "k string, i int, bad boolean"), "k", ["i"], F.col("bad"))
    assert [tuple(r) for r in got.select("i", "failures", health.state(F.col("failures")), health.backoff_seconds(F.col("failures"))).orderBy("i").collect()] == want


def test_regions(spark):
    e = spark.createDataFrame([(1, "JS-NATION_1"), (2, "JS-NATION-1"), (3, "JSX"), (4, None)], "e int, code string")
    p = spark.createDataFrame([("p", ["JS", "JS"]), ("q", ["JS-NATION"]), ("r", []), ("s", ["JS-NATION", None, "JS"])], "p string, regions array<string>")
    got = sorted((r.e, r.p) for r in match.region_fanout(e, "code", p, "regions").collect())
    assert got == [(1, "p"), (1, "s"), (2, "p"), (2, "q"), (2, "s")]
    flags = e.select("e", match.in_region(F.col("code"), F.lit("JS")).alias("x")).orderBy("e").collect()
    assert [r.x for r in flags] == [True, True, False, None]


def test_region_pairs_of_a_hot_region(spark):
    """The pairs of region_fanout, repeated and null ids too; no task has more than a few of a region that all watch."""
    e = spark.createDataFrame([(f"e{i}" if i else None, f"JS-{i % 3}") for i in range(90)] + [("e1", "JS-1"), ("x", "K"), ("y", None)], "e string, code string")
    p = spark.createDataFrame([(f"p{i}" if i else None, [["JS"], ["JS", "JS-1"], ["JS-2", "K"]][i % 3]) for i in range(120)] + [("q", []), ("r", None)], "p string, regions array<string>")
    got = match.region_pairs(e, "e", "code", p, "p", "regions", side=20)
    pairs = sorted(map(str, got.collect()))
    assert pairs == sorted(map(str, match.region_fanout(e, "code", p, "regions").select("e", "p").collect())) and len(pairs) > 7000
    shares = got.groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in shares) < len(pairs) / 8


def test_event_fanout_spreads_a_region(spark, tmp_path):
    """A region that everyone watches is more than one task, however few bytes its ids are."""
    ids = spark.range(13_000).select(F.sha2(F.col("id").cast("string"), 256).alias("id"))
    at = F.lit("2025-01-01").cast("timestamp")
    ids.select("id", F.lit("s").alias("source_id"), at.alias("last_seen_at")).write.parquet(f"{tmp_path}/notice.parquet")
    ids.limit(300).select("id", F.array(F.lit("JS")).alias("region_codes"), at.alias("updated_at")).write.parquet(f"{tmp_path}/user_profile.parquet")
    spark.createDataFrame([("s", "JS-1")], "id string, region_code string").write.parquet(f"{tmp_path}/source_registry.parquet")
    shares = notices.event_fanout(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in shares) == 3_900_000 and max(r["count"] for r in shares) < 0.6 * 3_900_000


def test_watched_cells(spark):
    """A row for each cell and list of regions, however many of their codes meet."""
    e = spark.createDataFrame([(["JS-1", "JS-2"],), (["JS-2"],), (["JS-2"],), (["JSX"],), ([],), (None,)], "cell array<string>")
    p = spark.createDataFrame([("p", ["JS", "JS-1"]), ("q", ["JS-1", "JS", "JS"]), ("r", []), ("s", None), ("t", [None, "JS-2"])], "p string, regions array<string>")
    p = p.withColumn("regions", match.watched_regions(F.col("regions")))
    got = sorted((tuple(r.cell), tuple(r.regions)) for r in match.watched_cells(e, "cell", p, "regions").collect())
    both, two = ("JS", "JS-1"), ("JS-2", None)
    assert got == sorted([(("JS-1", "JS-2"), both), (("JS-1", "JS-2"), two), (("JS-2",), both), (("JS-2",), two)], key=lambda x: (x[0], x[1][:1]))


def test_outbox_counts_without_pairs(spark):
    """No shuffle of outbox_pending holds a row for each notice and profile."""
    from sluicework.plans import notices

    spark.sparkContext.setJobGroup("outbox", "outbox")
    assert sum(r.messages for r in notices.outbox_pending(spark, "/root/testdata/sf0.01").collect()) > 30_000
    tracker, store = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().statusStore()
    stages = {s for j in tracker.getJobIdsForGroup("outbox") for s in tracker.getJobInfo(j).stageIds if tracker.getStageInfo(s)}
    spark.sparkContext._jsc.clearJobGroup()
    written = [store.lastStageAttempt(s).shuffleWriteRecords() for s in stages]
    assert 400 <= max(written) < 2_000


def test_a_source_of_two_regions(spark, tmp_path):
    """A notice whose source stands in the registry twice is one message of a profile that watches both regions."""
    from sluicework.plans import notices

    tables = {
        "source_registry": [("a", "X-1"), ("a", "X-2"), ("b", "Y")],
        "user_profile": [("p", ["X-1", "X-2"], 1), ("q", ["X"], 1), ("r", ["Y", "X-2"], 1), ("s", ["Z"], 1)],
        "notice": [("n1", "a", "new", "甲", 1), ("n2", "a", "new", "甲乙丙", 2), ("n3", "b", "new", "甲乙丙丁", 3)],
    }
    names = {"source_registry": "id string, region_code string", "user_profile": "id string, region_codes array<string>, updated_at long", "notice": "id string, source_id string, decision string, title string, last_seen_at long"}
    for name, rows in tables.items():
        df = spark.createDataFrame(rows, names[name])
        if name == "notice":
            df = df.withColumn("first_seen_at", F.timestamp_seconds(F.lit(1_746_057_600) + F.col("last_seen_at") * 100 + F.when(F.col("id") == "n3", 40_000_000).otherwise(0)))
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    got = sorted((r.profile_id, r.messages, r.failed) for r in notices.outbox_pending(spark, str(tmp_path)).collect())
    assert got == [("p", 1, 1), ("q", 1, 1), ("r", 2, 1)]
    ranks = sorted((r.profile_id, r.rank, r.notice_id) for r in notices.profile_notices(spark, str(tmp_path)).collect())
    assert ranks == [("p", 1, "n2"), ("p", 2, "n1"), ("q", 1, "n2"), ("q", 2, "n1"), ("r", 1, "n3"), ("r", 2, "n2"), ("r", 3, "n1")]


def test_diverse_top_k_against_a_loop(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "b", "c", "", None]), rng.randint(0, 5)) for i in range(40)]
    for k in (1, 4, 12):
        ordered = sorted(rows, key=lambda r: (-r[2], r[0]))
        first, rest, used = [], [], set()
        for r in ordered:
            blank = not (r[1] or "").strip()
            (first if blank or r[1] not in used else rest).append(r)
            used.add(r[1])
        want = (first + rest)[:k]
        got = topk.diverse_top_k(spark.createDataFrame(rows, "id int, g string, s int"), "g", [F.col("s").desc(), F.col("id")], k)
        assert [tuple(r) for r in got.collect()] == want


def test_violations(spark):
    pool = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), ("d", "z"), ("e", "w")], "id string, g string")
    one = [(1, "a"), (2, "q"), (3, "a"), (4, "b"), (5, "c"), (6, "d"), (7, "e")]
    chosen = spark.createDataFrame([(s, *r) for s in "xy" for r in one] + [("z", 1, "a")], "s string, no int, id string")
    got = {(r.s, r.no): r.violation for r in topk.selection_violations(chosen, pool, "id", "g", "no", "s").collect()}
    want = {1: None, 2: "unknown", 3: "repeated", 4: "same group", 5: None, 6: None, 7: "too many"}
    assert got == {(s, n): v for s in "xy" for n, v in want.items()} | {("z", 1): None}


def test_closure_with_cycle(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("d", None)], "s string, d string")
    got = {(r.s, r.d) for r in catalog.closure(e, "s", "d").collect()}
    assert got == {(x, y) for x in "abcd" for y in "abc"}
    assert catalog.closure(e.limit(0), "s", "d").count() == 0


def test_validation_is_all_or_nothing(spark):
    df = spark.createDataFrame([(1, "u1"), (1, "u2"), (None, ""), (2, "u2")], "id int, url string")
    checked = validate.row_errors(df, {"id missing": F.col("id").isNotNull(), "url missing": F.trim("url") != ""}, ["id", "url"], ["id", "url"])
    assert sorted((r.id or 0, r.url, sorted(r.errors)) for r in checked.collect()) == [(0, "", ["id missing", "url missing"]), (1, "u1", []), (1, "u2", ["repeated id"]), (2, "u2", ["repeated url"])]
    with pytest.raises(Exception, match="rows refused"):
        validate.accepted_or_nothing(checked).count()
    assert validate.accepted_or_nothing(checked.where("size(errors) = 0")).count() == 1


def test_text_functions(spark):
    row = spark.createDataFrame([("x" * 100 + "岗位" + "y" * 400, "公告2024年2月31日 20240105", "[\"a\", \"b\"]", "{bad", "```json\n{\"a\": {\"b\": 1}}\n```")], "t string, d string, j string, b string, f string")
    got = row.select(tx.excerpt(F.col("t"), ["岗位"], 80, 360), tx.date_in(F.col("d")), tx.json_strings(F.col("j")), tx.json_strings(F.col("b")), tx.json_inside(F.col("f")), tx.date_in(F.lit("no 2024-13-01"))).first()
    assert got[0] == "..." + "x" * 80 + "岗位" + "y" * 278 + "..." and got[1] == "2024-02-31" and got[2] == ["a", "b"] and got[3] == [] and got[4] == '{"a": {"b": 1}}' and got[5] is None


def test_urls(spark):
    rows = [("https://a.B.gov.cn/x/t1.shtml", ["*.gov.cn"]), ("https://gov.cn/", ["*.gov.cn"]), ("https://x.edu/a", ["edu"]), ("https://badedu/", [".edu"]), (None, ["a"]), ("https://a", None)]
    df = spark.createDataFrame(rows, "u string, d array<string>")
    assert [r[0] for r in df.select(urls.host_allowed(urls.host(F.col("u")), F.col("d"))).collect()] == [True, False, True, False, False, False]
    assert [r[0] for r in df.select(urls.is_page_below(F.col("u"), ".gov.cn")).collect()] == [True, False, False, False, False, False]
    assert spark.range(1).select(urls.joined(F.lit("https://a/b/c"), F.lit("../d")), urls.registrable(F.lit("https://w.x.edu.cn/")), urls.file_extension_in(F.lit("https://a/d?f=X.XLS&v=1")), urls.file_extension_in(F.lit("https://a/x.docs"))).first()[:] == ("https://a/d", "x.edu.cn", True, False)
