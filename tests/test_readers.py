import io
import json
import struct
import zipfile
import zlib

import pytest

from lensframe.operators import semantic, series
from lensframe.operators.entity import asset_page
from lensframe.sources import binary_formats as B
from lensframe.sources import dispatch
from lensframe.sources import text_formats as X
from lensframe.sources import xml_formats as M
from lensframe.sources.rows import UnreadableFile

LAS = """~Version
VERS. 2.0 : v
WRAP. {wrap} : w
~Well
STRT.M 1 : s
NULL. -999.25 : n
WELL. 99/1-A-2 : name
~Curve
DEPT.M : depth
GR.API : gamma
~A
"""
REPORTS = """<reports xmlns="urn:x"><report uid="r1" uidWell="w"><nameWell>99/1-A</nameWell><mdReport uom="m">10</mdReport>
<activity><code>A</code><mdReport>11</mdReport></activity><activity><code>B</code></activity><commonData><x>1</x></commonData></report>
<report uid="r2"><nameWell>99/1-B</nameWell><activity><code>C</code></activity><activity><code>D</code></activity></report></reports>"""
LOGS = """<logs><log uid="l"><nameWell>W</nameWell><logCurveInfo uid="u1"><mnemonic>MD</mnemonic></logCurveInfo><logCurveInfo uid="GR"/><logData><data>1,2.5</data><data>2,</data></logData></log></logs>"""
EXPORT = """<export><CD_WELL id="1" name="a"/><CD_WELLBORE id="2" well="1"/><CD_DATUM id="3"/></export>"""


def workbook():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>well</t></si><si><t>depth</t></si><si><t>A</t></si></sst>")
        z.writestr(
            "xl/worksheets/sheet1.xml",
            '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="D1" t="inlineStr"><is><t>ok</t></is></c></row>'
            '<row><c r="A2" t="s"><v>2</v></c><c r="B2"><v>12.5</v></c><c r="C2"><v>9</v></c><c r="D2" t="b"><v>1</v></c></row><row><c r="C3"><v>5</v></c></row></sheetData></worksheet>',
        )
    return out.getvalue()


def test_delimited(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_bytes(b'id,name,flag,n\r\n1,"a, ""b""\nc",true,1.5\r\n\r\n007,x\r\n 3 ,,FALSE,2\r\n')
    df = dispatch.read_path(spark, str(p))
    assert [t for _, t in df.dtypes] == ["bigint", "string", "boolean", "double"]
    assert {tuple(r) for r in df.collect()} == {(1, 'a, "b"\nc', True, 1.5), (7, "x", None, None), (3, None, False, 2.0)}
    (tmp_path / "e.csv").write_text("id,name\n")
    with pytest.raises(UnreadableFile):
        dispatch.read_path(spark, str(tmp_path / "e.csv"))


def test_json_lines_and_trial(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"a": 2, "b": {"c": [1]}}\n')
    assert dispatch.read_path(spark, str(tmp_path / "a.jsonl")).count() == 2
    (tmp_path / "bad.ndjson").write_text('{"a": 1}\n{"a": \n')
    with pytest.raises(Exception):
        dispatch.read_path(spark, str(tmp_path / "bad.ndjson")).collect()
    with pytest.raises(UnreadableFile, match="line 2"):
        list(X.json_rows(b'{"a": 1}\n{"a": \n', "x"))
    (tmp_path / "b.json").write_text('{"one": 1}')
    assert dispatch.read_path(spark, str(tmp_path / "b.json")).count() == 1
    (tmp_path / "picks").write_text("# wells\nWell bore   Surface     MD\n99/1-A      Hugin Fm.   12.5\n99/1-B                  13\n")
    df = dispatch.read_path(spark, str(tmp_path / "picks"))
    assert df.columns == ["Well bore", "Surface", "MD"] and {tuple(r) for r in df.collect()} == {("99/1-A", "Hugin Fm.", 12.5), ("99/1-B", None, 13.0)}
    with pytest.raises(UnreadableFile):
        list(X.fixed_width(b"A    \n1    2\n", "x"))


def test_well_logs(spark, tmp_path):
    (tmp_path / "a.las").write_text(LAS.format(wrap="NO") + "1 -999.25\n2 5.5\n")
    df = dispatch.read_path(spark, str(tmp_path / "a.las"))
    assert {tuple(r) for r in df.collect()} == {("99/1-A-2", 1, None), ("99/1-A-2", 2, 5.5)}
    assert [r["GR"] for r in X.las((LAS.format(wrap="YES") + "1\n3 2\n4\n").encode(), "x")] == [3.0, 4.0]
    with pytest.raises(UnreadableFile):
        list(X.las((LAS.format(wrap="NO") + "1 2 3\n").encode(), "x"))


def test_xml(spark, tmp_path):
    rows = list(M.xml_rows(REPORTS.encode(), "x"))
    assert [r["code"] for r in rows] == ["A", "B", "C", "D"] and rows[0]["mdReport"] == "11" and rows[1]["mdReport"] == "10" and "x" not in rows[0]
    assert [(r["well"], r["MD"], r["GR"]) for r in M.xml_rows(LOGS.encode(), "x")] == [("W", "1", "2.5"), ("W", "2", None)]
    assert [(r["family"], r["id"]) for r in M.xml_rows(EXPORT.encode(), "x")] == [("CD_WELL", "1"), ("CD_WELLBORE", "2"), ("CD_DATUM", "3")]
    (tmp_path / "d" / "drilling" / "12").mkdir(parents=True)
    (tmp_path / "d" / "drilling" / "12" / "r.xml").write_text(REPORTS)
    (tmp_path / "d" / "broken.xml").write_text("<a><b></a>")
    (tmp_path / "d" / "l.csv").write_text("code,n\nZ,1\n")
    df = dispatch.read_path(spark, str(tmp_path / "d"))
    assert {(r.code, r.kind, r.file) for r in df.collect() if r.code in "AZ"} == {("A", "drilling", "drilling/12/r.xml"), ("Z", "d", "l.csv")}
    assert [tuple(r) for r in dispatch.available(spark, [str(tmp_path / "d")]).collect()] == [(str(tmp_path / "d"), 2)]


def test_binary(spark, tmp_path):
    (tmp_path / "w.xlsx").write_bytes(workbook())
    df = dispatch.read_path(spark, str(tmp_path / "w.xlsx"))
    assert df.columns == ["well", "depth", "ok"] and [tuple(r) for r in df.collect()] == [("A", 12.5, True)]
    stream = zlib.compress(b"BT (Final \\(well\\)) Tj [(re) -200 (port) 10 (s)] TJ ET")
    pdf = b"%PDF-1.4\n1 0 obj << /Filter /FlateDecode >> stream\n" + stream + b"\nendstream endobj\n2 0 obj << >> stream\n(plain page) Tj\nendstream endobj"
    (tmp_path / "r.pdf").write_bytes(pdf)
    assert [(r.page, r.text, r.via) for r in dispatch.read_path(spark, str(tmp_path / "r.pdf")).collect()] == [(1, "Final (well) re ports", "text-layer"), (2, "plain page", "text-layer")]
    var = lambda n: bytes([(n >> s & 127) | (128 if n >> s + 7 else 0) for s in range(0, max(7, n.bit_length()), 7)])
    point = lambda t, v: b"\x08" + var(t) + b"\x11" + struct.pack("<d", v)
    body = b"".join(b"\x0a" + var(len(p)) + p for p in (point(1_600_000_000_000 + i, i / 3) for i in range(50)))
    (tmp_path / "s.pb").write_bytes(b"\x12" + var(len(body)) + body)
    got = sorted((r.ts, r.value) for r in dispatch.read_path(spark, str(tmp_path / "s.pb")).collect())
    assert got == [(1_600_000_000_000 + i, i / 3) for i in range(50)]
    for junk in (b"", b"\x00", b"\xff" * 40, b"PK\x03\x04"):
        for f in (B.workbook, B.datapoints, M.xml_rows):
            try:
                list(f(junk, "x"))
            except UnreadableFile:
                pass
        assert B.pdf_pages(junk) == []


def test_series_keeps_extremes(spark):
    pts = [(1, i, 999.0 if i == 31_000 else -999.0 if i == 77_000 else 5.0) for i in range(100_000)] + [(2, 5, None), (2, 6, 1.0)]
    df = spark.createDataFrame(pts, "s int, ts bigint, v double")
    out = series.downsample(df, "s", "ts", "v", 700)
    got = {(r.s, r.ts): r.v for r in out.collect()}
    assert got[1, 31_000] == 999.0 and got[1, 77_000] == -999.0 and sum(k[0] == 1 for k in got) <= 700 and (2, 5) in got


def test_series_files(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5), (2, None)], "ts bigint, value double")
    series.write_series(df.where("value is not null"), str(tmp_path / "s"))
    assert [tuple(r) for r in series.read_series(spark, str(tmp_path / "s")).collect()] == [(1, 2.5)]


def test_chunks():
    cs = semantic.chunks_of("One sentence. " * 200)
    assert len(cs) >= 3 and all(len(c.encode()) <= 700 for c in cs) and "".join(cs).replace(" ", "") == ("One sentence. " * 200).replace(" ", "")
    assert semantic.chunks_of("") == [] and semantic.chunks_of("ø" * 2000)[0] == "ø" * 350


def test_asset_page(spark):
    a = spark.createDataFrame([(10, None, "Pump", "")], "id bigint, parentid bigint, name string, description string")
    t = spark.createDataFrame([(1, 10)], "id bigint, assetid bigint")
    e = spark.createDataFrame([(5, 1, "10; 77"), (6, 2, "110"), (7, 3, None)], "id bigint, starttime bigint, assetids string")
    docs = spark.createDataFrame([("x.pdf", [10]), ("y.pdf", [11])], "name string, assetids array<bigint>")
    page = asset_page(10, a, t, e, docs)
    assert [page[k].count() for k in ("asset", "sensors", "events", "documents")] == [1, 1, 1, 1]


def test_journal_and_manifest(spark, tmp_path):
    from lensframe.plans.catalog import Catalog

    rows = spark.createDataFrame([("ev", '{"kind": "star"}', "a", 0), ("tool", "{}", None, None)], "k string, p string, o string, s bigint")
    dispatch.append_journal(rows, str(tmp_path / "j"))
    dispatch.append_journal(rows, str(tmp_path / "j"))
    assert dispatch.read_journal(spark, str(tmp_path / "j")).groupBy("k").count().count() == 2
    (tmp_path / "t.csv").write_text("a\n1\n")
    (tmp_path / "m.json").write_text(json.dumps([{"name": "t", "path": "t.csv", "title": "T"}, {"name": "gone", "path": "gone.csv"}]))
    cat = Catalog(spark)
    assert cat.mount_manifest(str(tmp_path / "m.json")) == ["t"] and cat.resolve("T") == "t"
    cat.mount(str(tmp_path / "t.csv"), "t")
    assert cat.table("t").count() == 2 and "2 rows" in cat.line("t")
