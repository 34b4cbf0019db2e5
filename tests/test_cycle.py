"""The cycle of fetching, the outbox, imports, lookups and selections."""

import pytest
from pyspark.sql import functions as F

from sluicework.functions import text as tx
from sluicework.functions import urls
from sluicework.operators import catalog, match, outbox, topk, validate, versions
from sluicework.sources import cycle, fetch, parsers

SOURCE = "id string, entry_url string, allowed_domains array<string>, adapter string, max_pages int"


def site(pages):
    def transport(url, headers):
        if url not in pages:
            raise OSError("no such page")
        return {"status": 200, "url": url, "content_type": "text/html", "charset": "utf-8", "body": pages[url].encode()}

    return transport


def test_walk(spark):
    """Pages in a circle are met once, a page that fails is a row, other adapters and sites have no following pages."""
    pages = {
        "https://a.cn/": "<a href='x.html'>甲</a><a href='2'>下一页</a><a href='https://evil.cn/2'>下一页</a>", "https://a.cn/2": "<a href='y.html'>乙</a><a href='/'>下一页</a><a href='3'>next page</a><a href='x.html'>又甲</a>",
        "https://a.cn/3": "<a href='4'>></a>", "https://b.cn/": "<a href='2'>下一页</a>", "https://b.cn/2": "x", "https://c.cn/": "<a href='2'>下一页</a>",
    }
    rows = [("a", "https://a.cn/", ["a.cn"], "generic_html_v1", 4), ("b", "https://b.cn/", ["b.cn"], "generic_html_v1", 1), ("c", "https://c.cn/", ["c.cn"], "rss_v1", 5), ("d", "https://d.cn/", ["d.cn"], "generic_html_v1", 2), ("e", "https://e.cn/", None, None, None)]
    seen, links = cycle.walk(spark.createDataFrame(rows, SOURCE), site(pages))
    got = sorted((r.source_id, r.page, r.step, r.error) for r in seen.collect())
    assert [x[:3] for x in got] == [("a", "https://a.cn/", 1), ("a", "https://a.cn/2", 2), ("a", "https://a.cn/3", 3), ("a", "https://evil.cn/2", 2), ("b", "https://b.cn/", 1), ("c", "https://c.cn/", 1), ("d", "https://d.cn/", 1), ("e", "https://e.cn/", 1)]
    assert [x[3] for x in got] == [None, None, None, "address not allowed", None, "not XML", "no such page", "address not allowed"]
    assert sorted((r.source_id, r.title, r.url, r.step) for r in links.collect() if r.title in ("甲", "乙", "又甲")) == [("a", "乙", "https://a.cn/y.html", 2), ("a", "甲", "https://a.cn/x.html", 1)]


def test_attachments(spark):
    pages = {
        "https://a.edu.cn/d.html": "<a href='t.xlsx'>岗位表</a><a href='sub.html'>附页</a><a href='index.html'>首页</a><a href='https://x.cn/o.html'>外</a><a href='/f?id=1'>附件下载</a>",
        "https://a.edu.cn/sub.html": "<a href='t.xlsx'>岗位表</a><a href='u.pdf'>简章</a><a href='deep.html'>更深</a>", "https://a.edu.cn/deep.html": "<a href='v.pdf'>不到</a>", "https://a.edu.cn/index.html": "<a href='w.pdf'>不取</a>",
    }
    df = spark.createDataFrame([("n", "https://a.edu.cn/d.html", ["a.edu.cn"]), ("m", None, None)], "id string, url string, allowed_domains array<string>")
    got = sorted((r.id, r.title, r.url, r.level) for r in cycle.attachments(df, site(pages), ["附件", "下载"], ".edu.cn").collect())
    assert got == [("n", "岗位表", "https://a.edu.cn/t.xlsx", 1), ("n", "简章", "https://a.edu.cn/u.pdf", 2), ("n", "附件下载", "https://a.edu.cn/f?id=1", 1)]


def test_detected(spark):
    schema = "id string, status int, digest string, etag string, last_modified string, error string"
    fetched = spark.createDataFrame([("a", 200, "1", "x", None, None), ("b", 304, None, None, None, None), ("c", 200, "2", "y", None, None), ("d", 200, "9", None, None, None), ("e", None, None, None, None, "lost")], schema)
    state = spark.createDataFrame([(k, "1", "old", None) for k in "abce"], "id string, digest string, etag string, last_modified string")
    assert sorted(tuple(r)[:4] for r in cycle.detected(fetched, state).collect()) == [("a", "unchanged", "1", "x"), ("b", "not_modified", "1", "old"), ("c", "changed", "2", "y"), ("d", "new", "9", None), ("e", "error", "1", "old")]


def test_outbox(spark):
    hits = spark.createDataFrame([("p", "n", "new", 5), ("p", "n", "new", 3), ("q", "n", "new", 4), (None, "n", "new", 1)], "profile_id string, notice_id string, event_type string, at int")
    empty = spark.createDataFrame([], "id string, profile_id string, notice_id string, event_type string, created_at int, status string, attempts int, error string")
    first = outbox.enqueue(empty, hits, "at")
    assert sorted((r.profile_id, r.created_at, r.status, r.attempts) for r in first.collect()) == [("p", 3, "pending", 0), ("q", 4, "pending", 0)]
    box = first.withColumn("error", F.lit(None).cast("string"))
    assert outbox.enqueue(box, hits, "at").count() == 0
    profiles, notices = spark.createDataFrame([("p",), ("q",)], "profile_id string"), spark.createDataFrame([("n", "t")], "notice_id string, title string")
    for n in range(4):
        waiting = outbox.retryable(box, profiles, notices)
        assert waiting.count() == (2 if n == 0 else 1 if n < 3 else 0)
        box = outbox.mark(box, waiting.select("id", (F.col("profile_id") == "p").alias("sent"), F.lit("x" * 2000).alias("error")))
    assert sorted((r.profile_id, r.status, r.attempts, len(r.error or "")) for r in box.collect()) == [("p", "sent", 0, 0), ("q", "failed", 3, 0)]


def test_import_report(spark):
    old = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, v string")
    new = spark.createDataFrame([("a", "z"), ("b", "y"), ("c", "w"), ("c", "w"), (None, "u"), ("d", None)], "id string, v string")
    after, counts = versions.import_report(old, new, "id", F.col("v").isNotNull(), ["v"])
    assert counts.first().asDict() == {"inserted": 1, "updated": 1, "unchanged": 1, "rejected": 2}
    assert sorted(map(tuple, after.collect())) == [("a", "z"), ("b", "y"), ("c", "w")]


def test_registration(spark):
    schema = "id string, entry_url string, region_code string, source_group string, institution_id string"
    registry = spark.createDataFrame([("a", "https://a.cn/", "R", "college", "i")], schema)
    batch = spark.createDataFrame([("a", "https://a.cn/", "R", "college", "i"), ("b", "https://a.cn/", "X", "college", "i"), ("c", None, None, None, None)], schema)
    got = {r.id: sorted(r.errors) for r in validate.registration_errors(batch, registry, registry.select("region_code"), registry.select("institution_id", "region_code")).collect()}
    assert got == {"a": [], "b": ["address of another source", "institution", "unknown region"], "c": ["address", "institution", "unknown region"]}


def test_nulls_repeat_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "x"), (4, "x")], "n int, k string")
    assert {r.n: r.errors for r in validate.row_errors(df, {}, ["k"], ["n"]).collect()} == {1: [], 2: [], 3: [], 4: ["repeated k"]}


def test_latest_reads_what_is_asked_for(spark, tmp_path):
    spark.createDataFrame([("a", 1, "x", "big"), ("a", 2, "y", "big"), ("b", 1, "z", "big")], "id string, at int, v string, other string").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    got = versions.latest(df, ["id"], ["at"], ["v"])
    assert sorted(map(tuple, got.collect())) == [("a", "y"), ("b", "z")]
    assert "ReadSchema: struct<id:string,at:int,v:string>" in got._jdf.queryExecution().toString()


def test_groups_are_cut_before_the_shuffle(spark):
    df = spark.createDataFrame([(n, f"g{n % 3}" if n % 4 else " ", n % 7) for n in range(60)], "id int, g string, s int")
    got = topk.diverse_top_k(df, "g", [F.col("s").desc(), F.col("id")], 20)
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()
    rows = sorted(df.collect(), key=lambda r: (-r.s, r.id))
    seen, first, rest = set(), [], []
    for r in rows:
        lone = not r.g.strip() or r.g not in seen
        seen.add(r.g)
        (first if lone else rest).append(r.id)
    assert [r.id for r in got.collect()] == (first + rest)[:20]


def test_memberships(spark):
    entries = spark.createDataFrame([("1", "法学", ["法律 学"]), ("2", "数学(师范)", None)], "cid string, catalog_name string, aliases array<string>")
    df = spark.createDataFrame([(1, "法 学"), (1, "法 学"), (2, "法学（本科）"), (3, "数学(师范)"), (4, None), (5, "x"), (6, "法律学")], "id int, m string")
    assert sorted((r.id, r.cid) for r in catalog.memberships(df, "m", entries, aliases="aliases").collect()) == [(1, "1"), (1, "1"), (2, "1"), (3, "2"), (6, "1")]


def test_lookup_with_defaults(spark):
    df = spark.createDataFrame([("a", 3, None)], "id string, version int, note string")
    ids = spark.createDataFrame([("a",), ("b",), ("b",)], "id string")
    assert sorted(map(tuple, versions.looked_up(ids, df, "id", {"version": 0, "note": "none"}).collect())) == [("a", 3, None), ("b", 0, "none")]


def test_legacy_transport(spark):
    def old(url, headers):
        raise OSError("sslv3_alert_handshake_failure" if "tls" in url else "certificate expired: handshake")

    rows = [(k, f"https://h.cn/{k}", ["h.cn"], None, None) for k in ("tls", "cert")]
    df = spark.createDataFrame(rows, "id string, url string, allowed_domains array<string>, etag string, last_modified string")
    got = {r.id: (r.status, r.error) for r in fetch.fetch_all(df, old, legacy=lambda url, headers: {"status": 200, "body": b"x"}).collect()}
    assert got == {"tls": (200, None), "cert": (None, "certificate expired: handshake")}


def test_repair(spark):
    html = bytearray("<p>甲</p>".encode())
    bodies = spark.createDataFrame([("a", html, "text/html", ""), ("b", bytearray(b"Rar!\x1a\x07"), "", ""), ("c", html, "text/html", "")], "id string, content binary, content_type string, url string")
    evidence = spark.createDataFrame([("a", "error", None), ("b", "parsed", "PK\x03"), ("c", "parsed", "x"), ("c", "parsed", None)], "id string, parser_status string, extracted_text string")
    parsed, counts = parsers.repair(evidence, bodies)
    assert sorted((r.id, r.text, r.parser_status) for r in parsed.collect()) == [("a", "甲", "parsed"), ("b", "", "unsupported_format")]
    assert tuple(counts.first()) == (2, 1, 1)


@pytest.mark.parametrize("text,number", [("零", 0), ("三", 3), ("十", 10), ("十二", 12), ("二十", 20), ("三十四", 34), ("一百零五", 105), ("两千零一", 2001), ("九千九百九十九", 9999), ("", None), ("第", None), ("三四", None), (None, None)])
def test_numerals(spark, text, number):
    assert spark.createDataFrame([(text,)], "t string").select(tx.chinese_number(F.col("t"))).first()[0] == number


def test_file_names(spark):
    rows = [("https://h/a?fileName=%E8%A1%A8.xls", "表.xls"), ("https://h/b/c%20d.pdf", "c d.pdf"), ("https://h/", None), (None, None), ("https://h/x%ZZ", None)]
    assert [r[0] for r in spark.createDataFrame([(u,) for u, _ in rows], "u string").select(urls.file_name(F.col("u"))).collect()] == [n for _, n in rows]


def test_subscription(spark):
    """None wanted means any; a null is among none of those wanted."""
    df = spark.createDataFrame([(1, "招聘公告", "i", "new"), (2, "招聘公告", None, "new"), (3, "面试公告", "i", None), (4, None, "i", "new")], "id int, t string, i string, e string")
    none = F.array().cast("array<string>")
    fits = lambda *w: [r.id for r in df.where(match.subscription_fits(F.col("t"), F.col("i"), F.col("e"), *w)).orderBy("id").collect()]
    assert fits(none, none, none, none) == [1, 2, 3, 4]
    assert fits(F.array(F.lit("公告")), F.array(F.lit("面试")), none, none) == [1, 2]
    assert fits(none, none, F.array(F.lit("i")), F.lit(None).cast("array<string>")) == [1, 3, 4]
    assert fits(none, none, none, F.array(F.lit("new"))) == [1, 2, 4]
