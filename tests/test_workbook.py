import io
import zipfile

import pytest

from resonance.plans import flows
from resonance.sources import workbook
from resonance.sources.workbook_sink import workbook_bytes

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
RELS = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def book(sheets: dict[str, str], strings: str = "", styles: str = "") -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        listed = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f"<workbook {MAIN} {RELS}><sheets>{listed}</sheets></workbook>")
        links = "".join(f'<Relationship Id="rId{i}" Target="/xl/worksheets/s{i}.xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{links}</Relationships>")
        for i, rows in enumerate(sheets.values(), 1):
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {MAIN}><sheetData>{rows}</sheetData></worksheet>")
        if strings:
            z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>{strings}</sst>")
        if styles:
            z.writestr("xl/styles.xml", f"<styleSheet {MAIN}>{styles}</styleSheet>")
    return out.getvalue()


def cells(content):
    return [tuple(r) for r in workbook._sheet_cells(content, "PERFORMANCE")]


def test_kinds_of_cells():
    strings = "<si><t>Post URL</t></si><si><r><t>two </t></r><r><t>runs</t></r><rPh><t>hint</t></rPh></si>"
    styles = (
        '<numFmts><numFmt numFmtId="170" formatCode="dd/mm/yyyy"/><numFmt numFmtId="171" formatCode="0.0&quot;days&quot;"/>'
        '</numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs>'
    )
    rows = (
        '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row>'
        '<row r="3"><c r="A3"><v>12.5</v></c><c r="B3" s="1"><v>45419</v></c><c r="C3" s="2"><v>45419.75</v></c>'
        '<c r="D3" s="3"><v>7</v></c><c r="E3" t="b"><v>1</v></c><c r="F3" t="e"><v>#N/A</v></c>'
        '<c r="AA3" t="inlineStr"><is><t> x </t></is></c><c r="AB3"/></row>'
    )
    assert cells(book({"PERFORMANCE": rows}, strings, styles)) == [
        (0, 0, "Post URL", "string"),
        (0, 2, "two runs", "string"),
        (2, 0, "12.5", "number"),
        (2, 1, "2024-05-07 00:00:00", "datetime"),
        (2, 2, "2024-05-07 18:00:00", "datetime"),
        (2, 3, "7", "number"),
        (2, 4, "True", "boolean"),
        (2, 26, " x ", "string"),
    ]


def test_cells_without_references_count_on():
    rows = "<row><c><v>1</v></c><c><v>2</v></c></row><row><c><v>3</v></c></row>"
    assert [(r, c, v) for r, c, v, _ in cells(book({"PERFORMANCE": rows}))] == [(0, 0, "1"), (0, 1, "2"), (1, 0, "3")]


@pytest.mark.parametrize("names, want", [(("OTHER", "PERFORMANCE"), "2"), (("OTHER", "MORE"), "1")])
def test_named_sheet_else_the_first(names, want):
    sheets = {n: f"<row><c><v>{i}</v></c></row>" for i, n in enumerate(names, 1)}
    assert cells(book(sheets))[0][2] == want


def test_folder_with_bad_files(spark, tmp_path):
    url = "https://www.linkedin.com/posts/a"
    (tmp_path / "PostAnalytics_1.xlsx").write_bytes(
        workbook_bytes([(0, 0, "Post URL"), (0, 1, "Impressions"), (1, 0, url), (1, 1, "40")]))
    (tmp_path / "PostAnalytics_2.xlsx").write_bytes(b"no workbook")
    (tmp_path / "PostAnalytics_3.xlsx").write_bytes(book({"PERFORMANCE": ""}))
    torn = book({"PERFORMANCE": "<row><c><v>1</v></c></row>"}).replace(b"</sheetData>", b"</sheetDatX>")
    (tmp_path / "PostAnalytics_4.xlsx").write_bytes(torn)
    (tmp_path / "Notes_5.xlsx").write_bytes(b"not matched")
    posts, bad = flows.consolidate_workbooks(spark, str(tmp_path))
    assert [(r["post_url"], r["impressions"]) for r in posts.collect()] == [(url, 40)]
    errors = {r["file"][-6]: r["error"] for r in bad.collect()}
    assert set(errors) == {"2", "3", "4"} and "empty sheet" in errors["3"]


@pytest.mark.parametrize("pattern, recursive", [("PostAnalytics_*.xlsx", False), ("*", False), ("*_{1,2}?.x[l-m]sx", False), ("*", True)])
def test_files_are_listed_by_tasks_as_spark_lists_them(spark, tmp_path, pattern, recursive):
    names = ["PostAnalytics_1.xlsx", "PostAnalytics_1b.xlsx", "PostAnalytics_2 c.xlsx", "a_2d.xlsx", "_hidden.xlsx", ".x.xlsx",
             "notes/PostAnalytics_3.xlsx", "notes/more/PostAnalytics_4%20.xlsx", "_gone/PostAnalytics_5.xlsx", "a+b.c_1x.xmsx"]
    for n in names:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_bytes(workbook_bytes([(0, 0, n)]))
    for folder in (str(tmp_path), f"file:{tmp_path}/", f"{tmp_path}/n*", str(tmp_path / names[0])):
        there = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).load(folder)
        want = sorted(r["path"] for r in there.select("path").collect())
        listed = workbook.file_names(spark, folder, pattern, recursive)
        assert sorted(r["path"] for r in listed.collect()) == want
        read = workbook.read_sheet_cells(spark, folder, pattern, recursive=recursive)
        assert sorted((r["file"], r["value"]) for r in read.collect()) == [(p, p.removeprefix(f"file:{tmp_path}/")) for p in want]
        assert "FileScan" not in read._jdf.queryExecution().executedPlan().toString()


def test_a_folder_that_is_not_there_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="(?i)path"):
        workbook.read_sheet_cells(spark, str(tmp_path / "none")).collect()
