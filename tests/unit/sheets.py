"""Small workbooks for the tests, written without any library."""

import zipfile
from xml.sax.saxutils import escape

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def workbook(path, sheets):
    """sheets: {name: (rows, merged ranges)}; a value of (number, 'd') is a number in a date's format."""
    with zipfile.ZipFile(path, "w") as z:
        names = "".join(f'<sheet name="{n}" sheetId="{k + 1}" r:id="r{k}"/>' for k, n in enumerate(sheets))
        z.writestr("xl/workbook.xml", f'<workbook {NS} xmlns:r="{REL}"><sheets>{names}</sheets></workbook>')
        links = "".join(f'<Relationship Id="r{k}" Target="worksheets/s{k}.xml" Type="x"/>' for k in range(len(sheets)))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet {NS}><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        texts = []
        for k, (rows, merged) in enumerate(sheets.values()):
            lines = []
            for r, row in enumerate(rows, 1):
                cells = ""
                for c, v in enumerate(row):
                    at = f"{chr(65 + c)}{r}"
                    if isinstance(v, tuple):
                        cells += f'<c r="{at}" s="1"><v>{v[0]}</v></c>'
                    elif isinstance(v, (int, float)):
                        cells += f'<c r="{at}"><v>{v}</v></c>'
                    elif v is not None:
                        texts.append(v)
                        cells += f'<c r="{at}" t="s"><v>{len(texts) - 1}</v></c>'
                lines.append(f'<row r="{r}">{cells}</row>')
            ranges = "".join(f'<mergeCell ref="{m}"/>' for m in merged)
            z.writestr(f"xl/worksheets/s{k}.xml", f'<worksheet {NS}><sheetData>{"".join(lines)}</sheetData><mergeCells>{ranges}</mergeCells></worksheet>')
        z.writestr("xl/sharedStrings.xml", f"<sst {NS}>{''.join(f'<si><t>{escape(t)}</t></si>' for t in texts)}</sst>")


def messy_inbox(folder):
    """Three submissions: two-level merged headers with a title and a total row; mixed writing; markers and a repeat."""
    workbook(
        folder / "a-计算机学院.xlsx",
        {
            "师资统计": (
                [
                    ["计算机学院2026年师资情况统计表"], ["填报单位：计算机学院"],
                    ["基本信息", None, "教学情况"], ["单位", "姓名", "职称", "课程数", "学生数", "填报日期"],
                    ["计算机学院", "张三", "教授", 3, 120, (46266, "d")], ["计算机学院", "李四", "讲师", 2, 80, "2026-09-02"], ["合计", None, None, 5, 200], [], [None, " "],
                ],
                ["A1:F1", "A3:B3", "C3:F3"],
            )
        },
    )
    workbook(
        folder / "b-外国语学院.xlsx",
        {"Sheet1": ([["所在学院", "教师姓名", "职称", "课时数", "学生人数", "日期"], ["外国语学院", "王　五", "副教授", "1.2万", "3,500", "2026/9/1"], ["外国语学院", "赵六", "讲师", "9800", "２１００", "2026年9月2日"]], [])},
    )
    rows = [["二级单位", "姓名", "职称", "课程数", "学生数", "填报日期"], ["马克思主义学院", "孙七", "教授", 4, 150, "2026-09-03"], ["马克思主义学院", None, "讲师", 1, 60, "2026-09-03"]]
    rows += [["马克思主义学院", "孙七", "教授", 4, 150, "2026-09-03"], ["马克思主义学院", "周八", "无", "N/A", "—", "2026/9/4"]]
    workbook(folder / "c-马克思主义学院.xlsx", {"上报表": (rows, [])})
    (folder / "~$lock.xlsx").write_bytes(b"")
