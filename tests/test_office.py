"""Office files that the tests zip themselves, and streams of work that stop and go on."""

import zipfile

from pyspark.sql import functions as F

from sparkloom.operators import tables as X
from sparkloom.sources.office import column_number, read_decks, read_documents, read_workbooks
from sparkloom.streaming.progress import done, failed, process, unfinished

R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def zipped(path, **parts):
    with zipfile.ZipFile(path, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)


def rels(*each):
    return "<Relationships>" + "".join(f'<Relationship Id="{i}" Type="{R}/{kind}" Target="{target}"/>' for i, kind, target in each) + "</Relationships>"


def test_documents(spark, tmp_path):
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    table = "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in row) + "</w:tr>" for row in (["a", "b"], ["1", "2"])) + "</w:tbl>"
    body = p("Intro") + "<w:p/>" + p("Why so?") + table + p("Explain it.") + p("Explained.") + "<w:sectPr/>"
    zipped(tmp_path / "a.docx", **{"word/document.xml": f'<w:document xmlns:w="w"><w:body>{body}</w:body></w:document>'})
    (tmp_path / "b.docx").write_text("broken")
    (tmp_path / "~$a.docx").write_text("lock")
    rows = sorted(((r.path[-6:], r.place, r.kind, r.text, r.error and r.error[:10]) for r in read_documents(spark, str(tmp_path)).collect()), key=str)
    assert rows == sorted([("a.docx", 0, "document_block", "Intro", None), ("a.docx", 2, "prompt", "Why so?", None), ("a.docx", 3, "table", "a | b\n1 | 2", None), ("a.docx", 4, "prompt", "Explain it.", None), ("a.docx", 5, "document_block", "Explained.", None), ("b.docx", None, None, None, "BadZipFile")], key=str)
    assert {r.error[:10] for r in read_documents(spark, str(tmp_path), largest=3).collect()} == {"ValueError"}


def test_decks(spark, tmp_path):
    shape = lambda t, ph="": f'<p:sp><p:nvPr><p:ph type="{ph}"/></p:nvPr><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp>'
    slide = lambda *s: f'<p:sld xmlns:p="p" xmlns:a="a">{"".join(s)}</p:sld>'
    zipped(tmp_path / "a.pptx", **{
        "ppt/presentation.xml": f'<p:presentation xmlns:p="p" xmlns:r="{R}"><p:sldId id="1" r:id="r2"/><p:sldId id="2" r:id="r1"/></p:presentation>',
        "ppt/_rels/presentation.xml.rels": rels(("r1", "slide", "slides/slide1.xml"), ("r2", "slide", "/ppt/slides/slide2.xml")),
        "ppt/slides/slide1.xml": slide(shape("Last")), "ppt/slides/slide2.xml": slide(shape("First"), shape("point")),
        "ppt/slides/_rels/slide2.xml.rels": rels(("r1", "notesSlide", "../notesSlides/n.xml")), "ppt/notesSlides/n.xml": slide(shape("7", "sldNum"), shape("say this", "body")),
    })
    rows = sorted((r.place, r.kind, r.text) for r in read_decks(spark, str(tmp_path)).collect())
    assert rows == [(0, "slide", "First\npoint"), (0, "speaker_note", "say this"), (1, "slide", "Last")]


def test_workbooks(spark, tmp_path):
    zipped(tmp_path / "a.xlsx", **{
        "xl/workbook.xml": f'<workbook xmlns:r="{R}"><sheet name="Data" r:id="r1"/></workbook>', "xl/_rels/workbook.xml.rels": rels(("r1", "worksheet", "worksheets/s.xml")),
        "xl/sharedStrings.xml": "<sst><si><t>Region</t></si><si><r><t>a</t></r><r><t>b</t></r></si></sst>",
        "xl/worksheets/s.xml": '<worksheet><c r="A1" t="s"><v>0</v></c><c r="AB2" t="s"><v>1</v></c><c r="B2"><f>SUM(B1)</f><v>60</v></c><c r="C3"/><c r="C4" t="inlineStr"><is><t>in</t></is></c></worksheet>',
    })
    rows = sorted((r.sheet, r.cell, r.row, r.col, r.value, r.formula) for r in read_workbooks(spark, str(tmp_path)).collect())
    assert rows == [("Data", "A1", 1, 1, "Region", None), ("Data", "AB2", 2, 28, "ab", None), ("Data", "B2", 2, 2, "60", "=SUM(B1)"), ("Data", "C4", 4, 3, "in", None)]
    df = spark.createDataFrame([("$Z$9",), ("aa1",), ("x",), ("",), (None,)], "c string")
    assert [r.n for r in df.select(column_number(F.col("c")).alias("n")).collect()] == [26, 27, None, None, None]


def test_progress(spark, tmp_path):
    def put(name, rows):
        spark.createDataFrame(rows, "k int, v string").coalesce(1).write.parquet(f"{tmp_path}/in/{name}")

    def run():
        source = spark.readStream.schema("k int, v string").parquet(f"{tmp_path}/in/*")
        return process(source, f"{tmp_path}/out", ["k"], lambda d: d.withColumn("result", F.when(F.col("v") != "bad", F.upper("v"))))

    put("a", [(1, "x"), (1, "x"), (2, "bad"), (3, " ")])
    rows = run()
    assert sorted(r.k for r in done(rows).collect()) == [1] and sorted(r.k for r in failed(rows, ["k"]).collect()) == [2, 3]
    put("b", [(1, "again"), (2, "y"), (4, "z")])
    for _ in range(2):
        rows = run()
        assert sorted((r.k, r.result) for r in done(rows).collect()) == [(1, "X"), (2, "Y"), (4, "Z")]
        assert [r.k for r in failed(rows, ["k"]).collect()] == [3]
    items = spark.range(1, 7).select(F.col("id").cast("int").alias("k"))
    assert sorted(r.k for r in unfinished(items, rows, ["k"]).collect()) == [3, 5, 6]


def test_text_criterion(spark):
    df = spark.createDataFrame([("Ab",), ("ab",), ("10",), ("9",), (None,), ("a.b",)], "v string")
    met = lambda rule: [r.v for r in df.where(X.text_criterion(F.col("v"), rule)).collect()]
    assert met("=ab") == ["ab"] and met("a?") == ["Ab", "ab"] and met("<>a*") == ["10", "9", None] and met("a.?") == ["a.b"]
    assert met(">=9") == ["Ab", "ab", "10", "9", "a.b"] and met("=") == [None] and met("<9.5") == ["9", None]


def test_numbered(spark):
    df = spark.createDataFrame([("a", 5), ("a", 1), (None, 3), ("b", 2), ("a", 900)], "g string, k long")
    got = sorted(((r.g, r.k, r.n) for r in X.numbered(df, "g", "k", width=10).collect()), key=str)
    assert got == sorted([("a", 1, 1), ("a", 5, 2), ("a", 900, 3), ("b", 2, 1), (None, 3, 1)], key=str)
