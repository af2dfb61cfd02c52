"""Exports: CSV and JSON folders, and a small HTML report."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame

#: Rows of a section of a report, at most: a report is for reading.
REPORT_ROWS = 1_000


def export_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    (df.select(*columns) if columns else df).write.mode("overwrite").option("header", True).csv(path)


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def html_report(title: str, sections: dict[str, DataFrame]) -> str:
    """Tables of the sections' first REPORT_ROWS rows, escaped."""
    parts = [f"<h1>{html.escape(title)}</h1>"]
    for name, df in sections.items():
        head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
        rows = "".join("<tr>" + "".join(f"<td>{'' if v is None else html.escape(str(v))}</td>" for v in r) + "</tr>" for r in df.limit(REPORT_ROWS).collect())
        parts.append(f"<h2>{html.escape(name)}</h2><table><tr>{head}</tr>{rows}</table>")
    return "<!doctype html><meta charset='utf-8'>" + "".join(parts)
