"""Results as files: JSON records, CSV sections, a workbook and an HTML report of small tables."""

from __future__ import annotations

import html
import zipfile
from datetime import date, datetime
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: More rows than this are no section of a report; write such tables with write_json or write_csv.
REPORT_ROWS = 5000


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(sections: dict[str, DataFrame], path: str) -> None:
    """A folder of CSV for each section, named as a sheet would be (31 characters)."""
    for name, df in sections.items():
        flat = [F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes]
        df.select(*flat).write.mode("overwrite").option("header", True).csv(f"{path}/{name[:31]}")


def _report_rows(name: str, df: DataFrame) -> list:
    rows = df.limit(REPORT_ROWS + 1).collect()
    if len(rows) > REPORT_ROWS:
        raise ValueError(f"section {name} has more than {REPORT_ROWS} rows")
    return rows


def _cell(value) -> str:
    if value is None:
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)) and value == value and abs(value) != float("inf"):
        return f"<c><v>{value!r}</v></c>"
    text = value.isoformat() if isinstance(value, (date, datetime)) else str(value)
    text = "".join(c if c in "\t\n\r" or ord(c) >= 32 else " " for c in text)[:32_767]  # what a cell can hold
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def write_xlsx(sections: dict[str, DataFrame | None], path: str) -> None:
    """A workbook with a sheet for each section (names cut to 31 characters, forbidden ones replaced), for small tables."""
    head, space = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>', "http://schemas.openxmlformats.org"
    names: list[str] = []
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        for k, (name, df) in enumerate(sections.items(), 1):
            title = "".join("_" if c in "[]:*?/\\" else c for c in name)[:31] or f"Sheet{k}"
            names.append(title if title.lower() not in (n.lower() for n in names) else f"{title[:27]}_{k}")
            table = [["Not applicable"]] if df is None else [df.columns, *_report_rows(name, df)]
            body = "".join("<row>" + "".join(_cell(x) for x in row) + "</row>" for row in table)
            book.writestr(f"xl/worksheets/sheet{k}.xml", f'{head}<worksheet xmlns="{space}/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>')
        sheets = "".join(f'<sheet name={quoteattr(n)} sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(names, 1))
        book.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{space}/spreadsheetml/2006/main" xmlns:r="{space}/officeDocument/2006/relationships"><sheets>{sheets}</sheets></workbook>')
        links = "".join(f'<Relationship Id="r{k}" Type="{space}/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(names) + 1))
        book.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{space}/package/2006/relationships">{links}</Relationships>')
        book.writestr("_rels/.rels", f'{head}<Relationships xmlns="{space}/package/2006/relationships"><Relationship Id="r1" Type="{space}/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{kind}.worksheet+xml"/>' for k in range(1, len(names) + 1))
        book.writestr("[Content_Types].xml", f'{head}<Types xmlns="{space}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{parts}</Types>')


def html_report(title: str, sections: dict[str, DataFrame]) -> str:
    """One page with a table for each section; a missing section is a note, a longer one than REPORT_ROWS an error."""
    parts = [f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>"]
    for name, df in sections.items():
        parts.append(f"<h2>{html.escape(name)}</h2>")
        if df is None:
            parts.append("<p>Not applicable</p>")
            continue
        rows = _report_rows(name, df)
        cell = lambda x, tag: f"<{tag}>{html.escape('' if x is None else str(x))}</{tag}>"
        parts.append("<table><tr>" + "".join(cell(c, "th") for c in df.columns) + "</tr>")
        parts += ["<tr>" + "".join(cell(x, "td") for x in row) + "</tr>" for row in rows]
        parts.append("</table>")
    return "\n".join([*parts, "</body></html>"])
