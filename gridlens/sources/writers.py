"""Sinks: line and summary JSON, Parquet by split, and small reports from collected summaries."""

from __future__ import annotations

import html
import json

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


def write_jsonl(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    rows.write.mode(mode).json(path)


def write_summary(one_row: DataFrame, path: str, mode: str = "errorifexists") -> None:
    one_row.coalesce(1).write.mode(mode).json(path)


def write_split(rows: DataFrame, path: str, split_col: str = "split", mode: str = "errorifexists") -> None:
    """Parquet in one folder a split; readers of one split touch no other."""
    rows.write.mode(mode).partitionBy(split_col).parquet(path)


def bar(pct: Column, mark: str = "█") -> Column:
    """A text bar, one mark for each two percent."""
    return F.repeat(F.lit(mark), F.floor(pct / 2).cast("int"))


def summary_json(row: Row) -> str:
    return json.dumps(row.asDict(recursive=True), indent=2, default=str)


def render_report(stats: dict[str, object], issues: list[Row], title: str = "Data audit") -> str:
    """An HTML page from a collected audit: cards for figures, a list of issues with severity badges."""
    cards = "".join(f'<div class="card"><b>{html.escape(str(v))}</b><span>{html.escape(k)}</span></div>' for k, v in stats.items())
    found = "".join(
        f'<li class="{html.escape(i["severity"])}"><em>{html.escape(i["severity"])}</em> {html.escape(i["title"])}'
        + (f"<p>{html.escape(i['detail'])}</p>" if i["detail"] else "")
        + (f"<p>Fix: {html.escape(i['fix'])}</p>" if i["fix"] else "")
        + "</li>"
        for i in issues
    )
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>{cards}<ul>{found or '<li>No issues</li>'}</ul></body></html>"
