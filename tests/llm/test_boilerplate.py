import random

import numpy as np
from pyspark.sql import functions as F

from sluicework.llm.boilerplate import main_lines, repeats, suffix_array


def test_suffix_array_against_sorting():
    rng = random.Random(7)
    for _ in range(20):
        t = [rng.randrange(3) for _ in range(rng.randint(1, 50))] + [-1]
        order, common = suffix_array(np.array(t))
        assert [t[i:] for i in order] == sorted(t[i:] for i in range(len(t)))
        for k in range(1, len(t)):
            a, b = t[order[k - 1] :], t[order[k] :]
            n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert common[k] == n


def test_repeats():
    pages = [["m1", "m2", "own a", "", "foot 1"], ["m1", "m2", "own b", "foot 2"], ["m1", "own c"]]
    seen = repeats(pages, ["x", "y", "y"])
    assert [r for _, r in seen[0]] == [2, 2, 0, 0, 1] and seen[0][0][0] == 1.0 and seen[0][2] == (0.5, 0)
    assert repeats([], []) == [] and repeats([[], [""]], [1, 2]) == [[], [(0.0, 0)]]


BODY = "体检地点设在{}指定机构，准入证明可在自助打印，所有费用自理，外地人员可申请远程核验，资格终审会议改在本区召开，由专人引导入场。"


def title(n):
    return f"{NAMES[n % 39]}{NAMES[n * 7 % 39]}区{NAMES[n * 11 % 39]}水文观测站公开招聘{NAMES[n * 17 % 39]}{NAMES[n * 3 % 39]}班夜班讲师公告"


NAMES = "澹恪泓晗邃铄缃翊启屹苒渊浔漪岚汀桐霁蓼崤岐雁菱稷穗栎麓筠芷柳鼎徽绮砺瀚俭楷枫墨凌"


def page(n):
    top = ["function f(){var x=1;}", "机构概况 | 下载中心 | 网站地图", "您的位置: 首页 >> 招考公告 >> 详情"]
    head = [f"{title(n)}", f"发布时间:2025-01-0{n % 9 + 1} 来源:本站 浏览次数:{n * 37}"]
    body = ["", BODY.format(NAMES[n % 39] * 3 + "县"), "一、日程提示", f"1.{NAMES[n % 39]}县考务咨询在每日{n}点前接听。", "联系人:甲老师 电话:000-12345", "附件:报名表.xlsx", f"{NAMES[n % 39]}恪{NAMES[n // 7]}文物修缮博物馆", "2025年1月5日", "(此件公开发布)"]
    tail = ["收藏 | 打印 | 纠错", f"上一篇:{title(n + 13)}", "热门文章", f"▪{title(n * 5 + 3)}[01-02]", "版权所有:某区观测站", "站点备案 某字第1号"]
    own = {4, *range(7, 15)}
    return "\n".join(top + head + body + tail), own


def test_pages(spark):
    """Sixty pages of one host, of fifty of which the titles are known; a line model needs some examples of either kind."""
    rows, want = [], {}
    for n in range(1, 61):
        text, own = page(n)
        rows.append((f"p{n}", f"https://a.example/{n}", text, f"n{n}", "x"))
        want[f"p{n}"] = own
    rows += [("q", None, page(27)[0], "n80", "x"), ("r", "https://a.example/r", None, "n81", "x"), ("s", "https://b.example", "", "n82", "x"), ("t", "::", "甲" * 200_000, "n83", "x")]
    df = spark.createDataFrame(rows, "id string, url string, t string, notice string, line string")
    titles = spark.createDataFrame([(f"n{n}", title(n) + "!") for n in range(1, 51)], "id string, title string")
    for kwargs in ({"titles": titles}, {}, {"titles": titles, "block_pages": 15}):
        got: dict = {}
        for r in main_lines(df, "id", "t", "url", "notice", **kwargs).collect():
            got.setdefault(r.id, set()).add(r.line_no)
        assert "r" not in got and "s" not in got
        # A single page of an unknown host has no repeats of its own: the line model judges it.
        assert got["q"] >= want["p1"] - {4} and not got["q"] & {2, 3, 5}, str(sorted(got["q"]))
        if kwargs:
            assert {k: got.get(k) for k in want} == want
        else:  # without titles links stay, nothing is lost
            assert all(got[k] >= v - {4} and not got[k] & {1, 2, 3, 5, 15, 17, 19, 20} for k, v in want.items())
    assert main_lines(df.where(F.lit(False)), "id", "t", "url", "notice").count() == 0


def test_a_notice_that_fills_blocks(spark):
    """Thirty versions of one notice, in blocks of ten pages, are one owner: their lines aren't the site's."""
    rows = [(f"v{n}", "https://a.example/v", "\n".join([title(3), BODY.format("甲县"), f"{NAMES[n]}某附注第{n}版", "友好往来"]), "same") for n in range(30)]
    rows += [(f"p{n}", "https://a.example/p", "\n".join([title(n), BODY.format(NAMES[n] * 3), "友好往来"]), f"n{n}") for n in range(4, 30)]
    df = spark.createDataFrame(rows, "id string, url string, t string, notice string")
    whole = {(r.id, r.line_no) for r in main_lines(df, "id", "t", "url", "notice").collect()}
    parts = {(r.id, r.line_no) for r in main_lines(df, "id", "t", "url", "notice", block_pages=10).collect()}
    assert parts == whole
    assert all((f"v{n}", 2) in parts and (f"v{n}", 4) not in parts for n in range(30))


def test_repeats_decide(spark, monkeypatch):
    """Without the runs the site's lines stay: the forms and the line model can't stand in for them."""
    from sluicework.llm import boilerplate

    pages = [page(n)[0].split("\n") for n in range(1, 61)]
    owners = list(range(60))
    seen = boilerplate.repeats(pages, owners)
    number = lambda x: boilerplate._NUMBER.sub("0", x)
    split = lambda marks: [sorted({number(x) for p, s in zip(pages, marks) for x, (share, run) in zip(p, s) if x and (run >= 2 and share >= 0.3 and not boilerplate._NOTICE.search(x) if site else not run)}) for site in (True, False)]
    kept = {}
    for name, marks in (("on", seen), ("off", [[(1 / 60, 0)] * len(p) for p in pages])):
        site, unique = split(marks)
        model = boilerplate.LineModel.fit(dict.fromkeys(site, 1), [number(title(n)) for n in range(1, 61)], unique)
        facts = model.facts(boilerplate.masked_forms(pages))
        kept[name] = sum(k == "n" for p, s in zip(pages, marks) for k in boilerplate.line_kinds(p, s, 60, facts))
    assert kept["on"] == 60 * 8 and kept["off"] > 60 * 14


def test_whole_host_decides(spark):
    """What pages of different blocks share is the site's, as on a host that is judged in one block; pages without a notice are owners too."""
    rows = []
    for n in range(40):
        lines = [title(n), "乡贤书屋", "灯谜茶会", BODY.format(NAMES[n] if n < 39 else "甲"), f"{NAMES[n % 39]}恪文物修缮博物馆", "2025年1月5日"]
        if n % 20:  # the promotion stands on two of forty pages, which blocks of one page never bring together
            lines[1:3] = [f"{NAMES[n % 39]}亭水榭", f"{NAMES[n * 7 % 39]}桥花坊"]
        rows.append((f"p{n}", "https://a.example/", "\n".join(lines), None if n % 2 else f"n{n}"))
    df = spark.createDataFrame(rows, "id string, url string, t string, notice string")
    whole = {(r.id, r.line_no) for r in main_lines(df, "id", "t", "url", "notice").collect()}
    parts = {(r.id, r.line_no) for r in main_lines(df, "id", "t", "url", "notice", block_pages=2).collect()}
    assert parts == whole
    assert not {("p0", 2), ("p0", 3), ("p20", 2), ("p20", 3)} & parts and ("p1", 2) in parts


def test_the_line_model_learns_from_all_lines(spark, monkeypatch):
    """30,000 different lines that no other page has, on more pages than any sample took: each counts, and so do all titles."""
    from sluicework.llm import boilerplate

    fitted = []
    maximised = boilerplate.LineModel.maximised.__func__
    monkeypatch.setattr(boilerplate.LineModel, "maximised", classmethod(lambda cls, counts, *args: fitted.append(counts) or maximised(cls, counts, *args)))
    own = lambda n: "".join(NAMES[n // 39**k % 39] for k in range(4))
    rows = [(f"p{n}", f"https://h{n % 5}.example/", f"机构概况 | 下载中心\n网站地图 | 收藏\n" + "\n".join(f"甲{own(n * 5 + k)}乙" for k in range(5)), f"n{n}") for n in range(6000)]
    df = spark.createDataFrame(rows, "id string, url string, t string, notice string").repartition(8)
    titles = spark.range(21_000).rdd.map(lambda r: (f"n{r.id}", "公告" + own(r.id))).toDF("id string, title string")
    main_lines(df, "id", "t", "url", "notice", titles=titles).count()
    assert fitted[0][boilerplate._SLOTS :].sum(axis=0).tolist() == [2, 21_000, 30_000]
    # The table's counts are those of the lines at once.
    lines = [x for r in rows[:300] for x in r[2].split("\n")[2:]]
    table = spark.createDataFrame([(boilerplate.BODY, x) for x in lines], "kind int, line string")
    assert (boilerplate._gram_counts_of(table) == boilerplate.gram_counts(lines, boilerplate.BODY)).all()


def test_forms_in_parts():
    """Looked at in parts, a line has the same forms as by the whole patterns."""
    from sluicework.llm import boilerplate as b

    lines = ["一、总则", "（二）条件", "3.报名", "附件：表", "表.xlsx", "表.xlsx附", "二〇二五年三月一日", "（此件公开）", "首页 > 公告", "招聘 > 公告", "a→b", "第 3 页", "请展开全文", "推广 —— x", "公众号", "某某市人事局", "第", "."]
    assert [b._in_notices(x) for x in lines] == [bool(b._NOTICE.search(x)) for x in lines]
    assert [b._is_between(x) for x in lines] == [bool(b._BETWEEN.search(x)) for x in lines]
    facts = b.LineModel.fit({}, [], []).facts({x: x for x in lines})
    assert [(f.numbered, f.signed, f.dated) for f in facts.values()] == [(bool(b._NUMBERED.search(x)), bool(b._SIGNED.search(x)), bool(b._DATE.search(x))) for x in lines]


def test_each_page_is_read_once(spark):
    """A page's lines are restored and its host's repeats told once, before the line model is fitted; judging shuffles no page."""
    rows = [(f"p{n}", f"https://h{n % 3}.example/", page(n)[0], f"n{n}") for n in range(1, 31)]
    rows.append(("g", "https://h0.example/", "\n".join(["  " + title(40).encode().decode("latin-1"), BODY.format("甲县") + " "]), "n40"))
    df = spark.createDataFrame(rows, "id string, url string, t string, notice string")
    lines = main_lines(df, "id", "t", "url", "notice", titles=spark.createDataFrame([("n40", title(40))], "id string, title string"))
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in plan and "Exchange" not in plan and "InPandas" not in plan.replace("MapInPandas", "")
    # The headline comes restored, all other lines as they are.
    assert {(r.line_no, r.line) for r in lines.where("id = 'g'").collect()} == {(1, title(40)), (2, BODY.format("甲县") + " ")}


def test_grams_of_lines():
    """Counts and sums of the grams are those of each line by itself, whatever lines are next to it, across portions too."""
    from sluicework.llm import boilerplate as b

    rng = random.Random(5)
    lines = ["", "甲", "ab", "aaaa", "𠀀b\ud800", *("".join(rng.choice(NAMES + "xyz") for _ in range(rng.randint(0, 40))) for _ in range(300)), "甲乙" * 60_000, "乙"]
    sets = [b.gram_counts([x], b.TITLE) for x in lines]
    assert all(s[b._SLOTS :, b.TITLE].sum() == 1 and s.max() == 1 for s in sets) and sets[2][: b._SLOTS].sum() == 9
    assert (b.gram_counts(lines, b.TITLE) == sum(sets)).all()
    odds = np.random.default_rng(5).normal(size=(b._SLOTS, 3)).astype(np.float32)
    model = b.LineModel(odds)
    assert (model.scores(lines) == np.concatenate([model.scores([x]) for x in lines])).all()
    lean = odds[:, b.TITLE] - odds[:, b.BODY]
    chosen = [s for s, x in zip(sets, lines) if b.LineModel(np.stack([lean] * 3, 1)).scores([x])[0, 0] > 0]
    assert 0 < len(chosen) < len(lines) and (b.gram_counts(lines, b.TITLE, lean) == sum(chosen)).all()
