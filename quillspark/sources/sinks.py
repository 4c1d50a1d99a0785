"""Export sinks. The distributed forms write folders; the single-file forms stream rows through the driver."""

from __future__ import annotations

import csv
import datetime
import json
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from quillspark.functions.text import size_label, timestamp_label

#: The columns of an export in their order.
METADATA = ["id", "filename", "file_path", "file_size", "mime_type", "file_hash", "status", "created_at", "updated_at", "confidence_score", "error_message", "processing_time"]
COLUMNS = [*METADATA, "extracted_text", "structured_json"]


def metadata_only(docs: DataFrame) -> DataFrame:
    return docs.drop("extracted_text", "structured_json")


def projection(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """The columns of an export that docs has, in their order; without the wide ones if with_text is false."""
    return docs.select(*[c for c in (COLUMNS if with_text else METADATA) if c in docs.columns])


def write_json_lines(docs: DataFrame, path: str, mode: str = "error") -> None:
    docs.write.mode(mode).json(path)


def write_csv_folder(docs: DataFrame, path: str) -> None:
    projection(docs).write.option("header", True).option("escape", '"').csv(path)


def _rows(docs: DataFrame) -> Iterator[Row]:
    return docs.orderBy("id").toLocalIterator()


def json_file(docs: DataFrame, path: str) -> int:
    """One JSON array with indent 2, ASCII only."""
    n = 0
    with open(path, "w", encoding="ascii") as f:
        f.write("[")
        for n, r in enumerate(_rows(docs), 1):
            text = json.dumps(r.asDict(True), indent=2, default=str)
            f.write((",\n" if n > 1 else "\n") + "\n".join("  " + line for line in text.split("\n")))
        f.write("\n]" if n else "]")
    return n


def csv_file(docs: DataFrame, path: str) -> int:
    """The fixed columns with a header; no rows make an empty file."""
    names, n = [c for c in COLUMNS if c in docs.columns], 0
    with open(path, "w", encoding="utf-8", newline="") as f:
        out = csv.writer(f)
        for n, r in enumerate(_rows(docs), 1):
            if n == 1:
                out.writerow(names)
            out.writerow(["" if r[c] is None else r[c] for c in names])
    return n


def report_blocks(docs: DataFrame) -> DataFrame:
    """id and the report's block of each document, without its number."""
    schema = F.coalesce(F.get_json_object("structured_json", "$.document_type"), F.get_json_object("structured_json", "$.type"), F.lit("N/A"))
    has = F.coalesce(F.col("extracted_text"), F.lit("")) != ""
    known = {c: F.col(c) if c in docs.columns else F.lit(None) for c in ("updated_at", "processing_time")}
    line = lambda label, value: F.concat(F.lit(f"  {label + ':':<17}"), value)
    lines = [
        F.col("filename"),
        F.lit("-" * 78),
        line("ID", F.col("id").cast("string")),
        line("Type", F.col("mime_type")),
        line("Status", F.col("status")),
        line("Size", size_label(F.col("file_size"))),
        line("Created", timestamp_label(F.col("created_at"))),
        line("Updated", timestamp_label(known["updated_at"].cast("double"))),
        line("Confidence", F.format_string("%.2f", "confidence_score")),
        line("Processing time", F.format_string("%.1fs", F.coalesce(known["processing_time"].cast("double"), F.lit(0.0)))),
        F.when(has, line("Text length", F.concat(F.format_number(F.length("extracted_text"), 0), F.lit(" chars")))),
        F.when(F.col("structured_json").isNotNull(), line("Schema type", schema)),
        F.when(F.coalesce(F.col("error_message"), F.lit("")) != "", line("Error", F.col("error_message"))),
        F.lit(""),
        F.when(has, F.concat(F.lit("  Preview (first 200 chars):\n    "), F.replace(F.substring("extracted_text", 1, 200), F.lit("\n"), F.lit(" ")))),
    ]
    return docs.select("id", F.concat_ws("\n", *lines).alias("block"))


def report_file(docs: DataFrame, path: str) -> int:
    n, rule = docs.count(), "=" * 78
    with open(path, "w", encoding="utf-8") as f:
        f.write(f"{rule}\n EXPORT REPORT\n Generated: {datetime.datetime.now():%Y-%m-%d %H:%M:%S}\n Documents: {n}\n{rule}\n\n")
        for i, r in enumerate(_rows(report_blocks(docs)), 1):
            f.write(f"Document {i}: {r.block}\n\n{rule}\n\n")
    return n


def excel_file(docs: DataFrame, path: str) -> int:
    """Sheets Documents and Metadata (without texts), a styled header, columns as wide as their longest value up to 60. Rows
    are streamed into the workbook; column widths come from an aggregate."""
    try:
        from openpyxl import Workbook
        from openpyxl.cell import WriteOnlyCell
        from openpyxl.styles import Alignment, Font, PatternFill
        from openpyxl.utils import get_column_letter
    except ImportError as e:
        raise RuntimeError("Excel export needs openpyxl") from e
    book, n = Workbook(write_only=True), 0
    for title, rows in (("Documents", docs), ("Metadata", metadata_only(docs))):
        names = [c for c in COLUMNS if c in rows.columns]
        sheet = book.create_sheet(title)
        wide = excel_widths(rows.select(names)).first()
        for i, c in enumerate(names, 1):
            sheet.column_dimensions[get_column_letter(i)].width = wide[c]
        heads = [WriteOnlyCell(sheet, c) for c in names]
        for h in heads:
            h.font, h.fill, h.alignment = Font(bold=True, color="FFFFFF"), PatternFill("solid", start_color="4472C4", end_color="4472C4"), Alignment(horizontal="center")
        n = 0
        for n, r in enumerate(_rows(rows), 1):
            if n == 1:
                sheet.append(heads)
            sheet.append([r[c] for c in names])
    book.save(path)
    return n


def excel_widths(rows: DataFrame) -> DataFrame:
    """One row: for each column the width of its longest value or name, and 3, at most 60."""
    longest = lambda c: F.greatest(F.coalesce(F.max(F.length(F.col(c).cast("string"))), F.lit(0)), F.lit(len(c)))
    return rows.agg(*[F.least(longest(c) + 3, F.lit(60)).alias(c) for c in rows.columns])


SINKS = {"json": json_file, "csv": csv_file, "txt": report_file, "xlsx": excel_file}


def default_path(folder: str, kind: str, suffix: str = "", now: datetime.datetime | None = None) -> str:
    """folder/export_yyyymmdd_hhmmss[_suffix].kind"""
    stamp = f"{now or datetime.datetime.now():%Y%m%d_%H%M%S}"
    return str(Path(folder) / ("_".join(["export", stamp, *([suffix] if suffix else [])]) + f".{kind}"))


def export(docs: DataFrame, kind: str, path: str | None = None, folder: str = ".") -> dict:
    """Dispatch by format, to a timestamped name in folder if no path is given; unknown formats, and zip, are errors."""
    if kind not in SINKS:
        raise ValueError(f"unsupported export format {kind!r}")
    path = path or default_path(folder, kind)
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    n = SINKS[kind](docs, path)
    return {"format": kind, "path": path, "count": n, "bytes": Path(path).stat().st_size}


def export_one(docs: DataFrame, key: str, kind: str, path: str | None = None, folder: str = ".") -> dict:
    return export(docs.filter(F.col("id") == key), kind, path, folder)


def zip_file(docs: DataFrame, path: str, originals: list[str] = ()) -> list[str]:
    """documents.json, metadata.json, documents.csv, report.txt and the originals that exist, by bare name."""
    import tempfile

    parts = {"documents.json": (json_file, docs), "metadata.json": (json_file, metadata_only(docs)), "documents.csv": (csv_file, docs), "report.txt": (report_file, docs)}
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z, tempfile.TemporaryDirectory() as tmp:
        for name, (write, rows) in parts.items():
            write(rows, f"{tmp}/{name}")
            z.write(f"{tmp}/{name}", name)
        for f in originals:
            if Path(f).is_file():
                z.write(f, f"originals/{Path(f).name}")
        return z.namelist()
