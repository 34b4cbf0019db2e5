"""Parsers, sheets, links, imports, object store, fetching and streams."""

import io
import json
import struct
import zipfile

import pytest

from sluicework.operators.sheets import sheet_records
from sluicework.sources import fetch, imports, links, objects, parsers
from sluicework.streaming import incremental


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


DOCX = zipped({"word/document.xml": '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>甲&amp;乙</w:t><w:tab/><w:t>丙</w:t></w:r></w:p><w:p><w:r><w:t> </w:t></w:r></w:p><w:p><w:r><w:t>丁</w:t></w:r></w:p></w:body></w:document>'})
NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
XLSX = zipped({
    "xl/workbook.xml": f'<workbook {NS}><sheets><sheet name="表一" sheetId="1"/></sheets></workbook>', "xl/sharedStrings.xml": f"<sst {NS}><si><t>岗位</t></si><si><r><t>代</t></r><r><t>码</t></r></si></sst>",
    "xl/worksheets/sheet1.xml": f'<worksheet {NS}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="B2"/></row><row><c r="A3"><v>3.0</v></c><c r="B3" t="inlineStr"><is><t> x </t></is></c></row></sheetData></worksheet>',
})


def test_parse_by_type_suffix_and_magic():
    html = "<p>甲 <b> 乙</b></p><script>var x;</script>".encode("gbk")
    status = lambda *a: parsers.parse(*a)["parser_status"]
    assert parsers.parse(html, "TEXT/HTML; charset=gbk")["text"] == "甲\n乙\nvar x;"
    assert parsers.parse(DOCX, "application/msword")["text"] == parsers.parse(DOCX, "", "a/b.DOCX?x=1")["text"] == parsers.parse(DOCX, None)["text"] == "甲&乙\t丙\n丁"
    sheet = parsers.parse(XLSX, "", "x.bin")
    assert sheet["sheets"] == [{"name": "表一", "rows": [["岗位", "", "代码"], ["3", "x"]]}] and sheet["text"] == "岗位\t\t代码\n3\tx"
    nested = parsers.parse(zipped({"a.txt": "t", "in/": "", "in/b.xlsx": XLSX}), "application/zip")
    assert nested["sheets"] == sheet["sheets"]
    assert [status(b"%PDF-1", ""), status(b"Rar!\x1a\x07", ""), status(b"a\0b", "x/y"), status(b"plain", "x/y"), status(b"PK\x03\x04 broken", ""), status(None, "text/html"), status(parsers.OLE2, "application/msword")] == ["needs_dependency", "unsupported_format", "binary_skipped", "unknown_type", "error", "parsed", "needs_dependency"]


def word_head(pieces):
    """A head of one formatting block and the piece table of (characters, where, narrow) pieces."""
    positions, at = [0], 0
    for n, _, _ in pieces:
        positions.append(at := at + n)
    table = struct.pack(f"<{len(positions)}I", *positions) + b"".join(struct.pack("<HIH", 0, 2 * where | 1 << 30 if narrow else where, 0) for _, where, narrow in pieces)
    return b"\x01\x02\x00zz" + b"\x02" + struct.pack("<I", len(table)) + table


def test_word_pieces():
    """Pieces of either width, in any order in the stream."""
    stream = "甲乙".encode("utf-16-le") + b"ab\x80"
    assert parsers.word_characters(stream, word_head([(3, 4, True), (2, 0, False), (0, 0, True)])) == "ab€甲乙"
    for head in (b"\x07", b"", b"\x02\x04\0\0\0\0\0\0\0"):
        with pytest.raises(ValueError):
            parsers.word_characters(stream, head)


def test_archives_of_any_depth():
    inner = zipped({"a.docx": DOCX})
    for n in range(5):
        inner = zipped({f"{n}.zip": inner, "note.bin": "x"})
    assert parsers.parse(inner, "application/zip")["text"] == "甲&乙\t丙\n丁"
    assert parsers.zip_members(inner, most_bytes=100)["parser_status"] == "error"


def test_documents_frame(spark):
    df = spark.createDataFrame([(1, bytearray(DOCX), None, "x.docx", "old"), (2, None, None, None, "old")], "id int, content binary, content_type string, url string, text string")
    got = {r.id: (r.text, r.parser_status) for r in parsers.parse_documents(df.withColumnRenamed("text", "note"), ["id"]).collect()}
    assert got == {1: ("甲&乙\t丙\n丁", "parsed"), 2: ("", "unknown_type")}


def test_sheets(spark):
    two = [["某表"], ["招聘单位", "岗位名称", "岗位代码", "报考条件", "", ""], ["", "", "", "学历", "专业", "其他说明"], ["甲院", "讲师", "01", "本科", "中文", "党员"], ["", "助教", "02", "硕士", "", ""], ["备注：x", "y"], ["", "", "", "", "", ""], ["单独"]]
    names = [["姓名", "岗位名称", "岗位代码", "学历"], ["张", "讲师", "01", "本科"]]
    repeat = [["单位", "岗位", "专业", "学科"], ["乙院", "社工", "法学", "法学"], ["单位", "岗位", "专业", "学科"], ["", "文员", "数学", "统计"]]
    rows = [(s, i, r) for s, sheet in (("two", two), ("names", names), ("repeat", repeat), ("bad", [["a", "b", "c"]])) for i, r in enumerate(sheet)] + [("null", 0, None)]
    got = sheet_records(spark.createDataFrame(rows, "s string, i int, c array<string>"), ["s"], "i", "c").orderBy("s", "row_index").collect()
    assert [(r.s, r.row_index, r.employer, r.position_name, r.education, r.major_requirement, r.other_requirements, r.degree) for r in got] == [
        ("repeat", 1, "乙院", "社工", "unknown", "法学", "unknown", "unknown"), ("repeat", 3, "乙院", "文员", "unknown", "数学；统计", "unknown", "unknown"),
        ("two", 3, "甲院", "讲师", "本科", "中文", "党员", "unknown"), ("two", 4, "甲院", "助教", "硕士", "unknown", "unknown", "unknown"),
    ]


def test_links(spark):
    rows = [
        (1, "generic_html_v1", "<a href='b.html'> 甲\n 乙 </a><a href='x'> </a><a>n</a>", "https://h/a/", "text/html"), (2, "json_links_v1", json.dumps({"data": {"list": [{"name": "t", "link": "/u"}, {"title": "n"}, 3]}}), "https://h/", "application/json"),
        (3, "rss_v1", "<feed xmlns='http://www.w3.org/2005/Atom'><entry><title>t</title><link href='/e'/></entry></feed>", "https://h/", "application/atom+xml"), (4, "json_links_v1", "[]", "https://h/", "text/html"), (5, "other", "", None, None),
    ]
    df = spark.createDataFrame([(i, a, bytearray(b.encode()), u, t, None) for i, a, b, u, t in rows], "id int, adapter string, body binary, url string, content_type string, charset string")
    got = {r.id: ([tuple(x) for x in r.links], bool(r.link_error)) for r in links.discover(df, ["id"]).collect()}
    assert got == {1: ([("甲 乙", "https://h/a/b.html")], False), 2: ([("t", "https://h/u")], False), 3: ([("t", "https://h/e")], False), 4: ([], True), 5: ([], True)}


def test_objects(spark, tmp_path):
    df = spark.createDataFrame([(1, bytearray(b"x")), (2, bytearray(b"x")), (3, bytearray(b"y")), (4, None)], "id int, body binary")
    root = str(tmp_path / "objects")
    digests = {r.id: r.sha256 for r in objects.put(df, "body", root).collect()}
    objects.put(df, "body", root)
    assert spark.read.parquet(root).count() == 2 and objects.get(spark, root, digests[3]) == b"y"
    with pytest.raises(ValueError):
        objects.get(spark, root, "../etc")
    with pytest.raises(KeyError):
        objects.get(spark, root, "0" * 64)
    assert objects.fetch_bodies(spark.createDataFrame([(digests[1],), ("z",)], "d string"), "d", root).where("body is null").count() == 1
    objects.write_snapshot(df, f"{root}-t")
    objects.write_snapshot(df.limit(1), f"{root}-t")
    assert objects.read_snapshot(spark, f"{root}-t").count() == 1


def test_imports(spark, tmp_path):
    (tmp_path / "i.csv").write_text("\ufeff" + ",".join(imports.INSTITUTION_FIELDS) + "\na,A,X,public,undergraduate,a.edu,https://a.edu\na,B,Y,private,undergraduate,a.edu,\n", "utf-8")
    cities = spark.createDataFrame([("X", "R-X")], "city string, region_code string")
    got = sorted((r.institution_name, sorted(r.errors)) for r in imports.read_institutions(spark, str(tmp_path / "i.csv"), cities).collect())
    assert got == [("A", []), ("B", ["official_site_url missing", "ownership", "repeated institution_id", "repeated official_domain", "unknown city"])]
    (tmp_path / "s.json").write_text(json.dumps([{"id": "s1", "entry_url": "https://h.cn/a"}, {"id": "s2", "entry_url": "https://<host>/"}, {"id": "s1", "entry_url": "ftp://x", "max_pages": 50}]))
    got = sorted((r.entry_url, sorted(r.errors), r.allowed_domains) for r in imports.read_sources(spark, str(tmp_path / "s.json")).collect())
    assert [e for _, e, _ in got] == [["max_pages", "url"], ["placeholder url"], ["repeated id"]]
    assert got[2][2] == ["h.cn"]
    (tmp_path / "p.json").write_text(json.dumps({"policies": [{"id": "p", "version": 1}]}))
    assert imports.read_policies(spark, str(tmp_path / "p.json")).first().id == "p"


def test_fetch(spark):
    def transport(url, headers):
        if "boom" in url:
            raise OSError("no route")
        if "If-None-Match" in headers:
            return {"status": 304}
        return {"status": 200, "url": "https://evil.example/" if "go" in url else url, "body": b"x" * (99 if "big" in url else 1), "content_type": "text/html", "etag": "e"}

    rows = [(k, f"https://h.cn/{k}", ["h.cn"], "e" if k == "same" else None, None) for k in ("ok", "same", "boom", "go", "big")] + [("out", "https://x.cn/", ["h.cn"], None, None), ("ftp", "ftp://h.cn/", None, None, None)]
    got = {r.id: (r.status, r.not_modified, r.error) for r in fetch.fetch_all(spark.createDataFrame(rows, "id string, url string, allowed_domains array<string>, etag string, last_modified string"), transport, 50).collect()}
    assert got == {"ok": (200, False, None), "same": (304, True, None), "boom": (None, False, "no route"), "go": (None, False, "redirected to an address not allowed"), "big": (None, False, "body too large"), "out": (None, False, "address not allowed"), "ftp": (None, False, "address not allowed")}
    assert fetch.retry_legacy_tls(OSError("SSLV3_ALERT_HANDSHAKE_FAILURE")) and not fetch.retry_legacy_tls(OSError("certificate verify failed: handshake"))


def test_streams_equal_batches(spark, tmp_path):
    path = str(tmp_path / "in")
    for n in range(3):
        rows = [(f"k{i % 4}", n * 10 + i, (i * n) % 3 != 0, f"d{(i + n) % 3}") for i in range(10)]
        spark.createDataFrame(rows, "k string, n long, failed boolean, digest string").selectExpr("*", "cast(timestamp_seconds(n) AS timestamp_ntz) AS at").coalesce(1).write.mode("append").parquet(path)
    batch = spark.read.parquet(path)
    stream = lambda: incremental.read_stream(spark, path, batch.schema)
    out = incremental.run_to_end(incremental.novel(stream().select("k", "digest"), ["k", "digest"]), "append", str(tmp_path / "a"))
    assert out.select("k", "digest").exceptAll(batch.select("k", "digest").distinct()).count() == 0 and out.count() == batch.select("k", "digest").distinct().count()
    events = incremental.run_to_end(incremental.version_events(stream(), "k", "at", "digest"), "append", str(tmp_path / "b"))
    assert events.groupBy("key", "digest").count().where("count > 1").count() == 0 and events.where("event_type = 'new'").count() == 4
    said = []
    incremental.poll(iter([{"n": 1}]).__next__, 0, 2, lambda s: said.append(s), said.append)
    assert said[0] == {"n": 1} and said[1] == 5.0 and "error" in said[2]
