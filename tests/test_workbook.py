"""Workbooks made here by hand, read by the loaders of code lists, rates and reviews."""

import zipfile

import pytest
from pyspark.sql import functions as F

from gatework.operators import lookup, validation
from gatework.sources import workbook as w

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def letters(i):
    return (letters(i // 26 - 1) if i >= 26 else "") + chr(65 + i % 26)


def save(path, sheets, active=0, absolute=False, references=True):
    """A workbook of sheets {name: rows}; texts are shared, or inline if they begin with an i."""
    shared: list[str] = []

    def cell(i, n, v):
        at = f' r="{letters(i)}{n}"' if references else ""
        if v is None:
            return f"<c{at}/>" if not references else ""
        if isinstance(v, bool):
            return f'<c{at} t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (int, float)):
            return f"<c{at}><v>{v!r}</v></c>"
        if v.startswith("#"):
            return f'<c{at} t="e"><v>{v}</v></c>'
        if v.startswith("="):
            return f'<c{at} t="str"><f>A1</f><v>{v[1:]}</v></c>'
        if v.startswith("i"):
            return f'<c{at} t="inlineStr"><is><t>{v}</t></is></c>'
        if v not in shared:
            shared.append(v)
        return f'<c{at} t="s"><v>{shared.index(v)}</v></c>'

    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for k, rows in enumerate(sheets.values(), 1):
            body = "".join(f'<row r="{n}">{"".join(cell(i, n, v) for i, v in enumerate(r))}</row>' for n, r in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/s{k}.xml", f'<worksheet xmlns="{MAIN}"><sheetData>{body}</sheetData></worksheet>')
        item = lambda s: "<si>" + ("".join(f"<r><rPr/><t xml:space='preserve'>{x}</t></r>" for x in s.split("|")) + "<rPh sb='0' eb='1'><t>no</t></rPh>" if "|" in s else f"<t>{s}</t>") + "</si>"
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}">{"".join(map(item, shared))}</sst>')
        names = "".join(f'<sheet name="{name}" sheetId="{k}" r:id="r{k}"/>' for k, name in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{RELS}"><bookViews><workbookView activeTab="{active}"/></bookViews><sheets>{names}</sheets></workbook>')
        links = "".join(f'<Relationship Id="r{k}" Type="t" Target="{"/xl/" if absolute else ""}worksheets/s{k}.xml"/>' for k in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')


@pytest.mark.parametrize("absolute", [False, True])
def test_cells(spark, tmp_path, absolute):
    rows = [["Ti|tle", "a &amp; b", None], [], [5, 5.0, 5.25, 1e20, True, False, "#N/A", "=x", "inline", None, "é日"], [None] * 30 + ["far"]]
    save(tmp_path / "a.xlsx", {"One": rows, "Two": [["only"]]}, absolute=absolute)
    got = {(r.sheet, r.n): r.cells for r in w.read_workbooks(spark, str(tmp_path)).collect()}
    assert got == {
        ("One", 1): ["Title", "a & b"], ("One", 3): ["5", "5", "5.25", "1e+20", "TRUE", "FALSE", None, "x", "inline", None, "é日"], ("One", 4): [None] * 30 + ["far"], ("Two", 1): ["only"],
    }
    assert [r.sheet for r in w.read_workbooks(spark, str(tmp_path), sheet="Two").collect()] == ["Two"] and w.read_workbooks(spark, str(tmp_path), sheet="None").count() == 0


def test_cells_without_references(spark, tmp_path):
    save(tmp_path / "a.xlsx", {"One": [["x", None, 3]]}, references=False)
    assert w.read_workbooks(spark, str(tmp_path)).first().cells == ["x", None, "3"]


def test_many_rows_and_files_are_read_by_sheet(spark, tmp_path):
    for f in "ab":
        save(tmp_path / f"{f}.xlsx", {s: [[i, f"{f}{s}{i}"] for i in range(4500)] for s in ("S", "T")})
    df = w.read_workbooks(spark, str(tmp_path))
    assert df.count() == 4 * 4500 and df.where(F.concat(F.substring_index(F.regexp_replace("file", r".*/", ""), ".", 1), "sheet", (F.col("n") - 1).cast("string")) != w.cell(1)).count() == 0


def test_code_lists(spark, tmp_path):
    old, new = tmp_path / "old.xlsx", tmp_path / "new.xlsx"
    save(old, {"note": [["x"]], "codes": [["Seq", "Code", "Title"], [None, None, None], [1, 23, "Construction"], [2, "31-33", "Making"], [3, 238220, "Plumbing and heating"], [4, " 111110 ", "Soybean"]]}, active=1)
    save(new, {"codes": [["Seq", "Code", "Title"], [None, None, None], [1, 23, "Building"], [2, 238220.0, "Plumbing, heating, cooling"], [3, "n/a", "x"]]})
    lists = w.code_lists(spark, [str(old), str(new)])
    assert sorted(r.code for r in lookup.valid_codes(lists).collect()) == ["111110", "23", "238220"]
    first = {r.code: r.title for r in lookup.first_titles(w.code_lists(spark, [str(old), str(new)], 3)).collect()}
    assert first["23"] == "Construction" and first["32"] == "Making"
    assert {r.code: r.title for r in lookup.last_titles(lists).collect()}["23"] == "Building"
    assert {r.code: r.title for r in lookup.keyword_index(lists).collect()}["238220"] == "Plumbing, heating, cooling"


def test_rates(spark, tmp_path):
    save(tmp_path / "r.xlsx", {"t": [["head"], ["head"], [None, "31-33\xa0", "x", 2.5], [None, 238, "x", "1.5"], [None, 11, "x", "-"], [None, "total", "x", 9.0], [None, 238, "x", 1.75]]})
    assert {r.prefix: r.value for r in lookup.rates(w.rate_list(spark, str(tmp_path / "r.xlsx"))).collect()} == {"31": 2.5, "32": 2.5, "33": 2.5, "238": 1.75}


def test_review(spark, tmp_path):
    head = ["id", "reported_naics", "suggested_naics", "reviewer_naics", "reviewer_notes"]
    save(tmp_path / "v.xlsx", {"CLEAN": [head, ["1", 238220, None, 238220], ["2", 238220, None, "UNK"]], "MANUAL_REVIEW": [head[::-1], [None, 111110, 111110, 238220, "3"]]})
    df = w.reviewed(spark, str(tmp_path / "v.xlsx"))
    assert sorted((r.stratum, r.id, r.reviewer_naics, r.reported_naics) for r in df.collect()) == [("CLEAN", "1", "238220", "238220"), ("CLEAN", "2", "UNK", "238220"), ("MANUAL_REVIEW", "3", "111110", "238220")]
    m = {r.stratum: r.asDict() for r in validation.stratum_metrics(df).collect()}
    assert m["CLEAN"]["n_scored"] == 1 and m["MANUAL_REVIEW"]["n_scored"] == 1


def test_headings_behind_other_rows(spark, tmp_path):
    save(tmp_path / "h.xlsx", {"a": [["Report"], ["Code", "Rate", "Code"], ["0005", 5.91, "z"], [None, 1]]})
    got = w.with_header(w.read_workbooks(spark, str(tmp_path / "h.xlsx")), ["Rate", "Code", "Other"], skip=1).dropna(subset=["Code"]).collect()
    assert [(r.Code, r.Rate, r.Other) for r in got] == [("0005", "5.91", None)]
