"""Text, links and tables out of HTML, XML and wikitext."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def html_text(html: Column) -> Column:
    """Visible text: scripts, styles, comments and tags out, five entities resolved, white space squeezed."""
    x = F.regexp_replace(html, r"(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", " ")
    x = F.regexp_replace(x, r"<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(x, r"[ \t\r\n]+", " "))


def html_title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?s)<title>(.*?)</title>", 1)


def links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, n (from 1, in order), href of each anchor."""
    found = F.regexp_extract_all(F.col(html), F.lit(r'<a [^>]*href="([^"]*)"'), 1)
    return pages.select(key, F.posexplode(found).alias("n", "href")).select(key, (F.col("n") + 1).alias("n"), "href")


def sitemap_locations(rows: DataFrame, key: str, xml: str) -> DataFrame:
    return rows.select(key, F.explode(F.regexp_extract_all(F.col(xml), F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), 1)).alias("loc"))


def url_parts(url: Column) -> dict[str, Column]:
    """host, path, and the last path segment as a slug."""
    host = F.regexp_extract(url, r"^[a-z]+://([^/?#]+)", 1)
    path = F.regexp_extract(url, r"^[a-z]+://[^/?#]+([^?#]*)", 1)
    return {"host": host, "path": path, "slug": F.regexp_extract(path, r"([^/]*)/?$", 1)}


def _cut(text: str, mark: str) -> list[str]:
    """text at each mark that stands outside double brackets and double braces."""
    out, depth, at, i = [], 0, 0, 0
    while i < len(text):
        two = text[i : i + 2]
        if two in ("[[", "{{"):
            depth, i = depth + 1, i + 2
        elif two in ("]]", "}}"):
            depth, i = max(0, depth - 1), i + 2
        elif not depth and text.startswith(mark, i):
            out.append(text[at:i])
            i += len(mark)
            at = i
        else:
            i += 1
    return [*out, text[at:]]


def cell_text(cell: str) -> str:
    """A cell's plain text: attributes, references, templates and quotes out, links by their label."""
    parts = _cut(cell, "|")
    body = parts[-1] if len(parts) > 1 and "=" in parts[0] else cell
    body = re.sub(r"<ref[^>]*/>|<ref[^>]*>.*?</ref>|<!--.*?-->", "", body, flags=re.S)
    body = re.sub(r"\[\[(?:[^\]|]*\|)?([^\]|]*)\]\]", r"\1", body)
    body = re.sub(r"\{\{[^{}]*\}\}", "", body)
    body = re.sub(r"<br\s*/?>", " ", body)
    return " ".join(re.sub(r"<[^>]*>|'{2,}", "", body).split())


def wiki_grid(lines: list[str]) -> list[list[str]]:
    """A table's cells as a full grid: a rowspan fills the rows below, a colspan repeats to the right."""
    rows: list[list[str]] = []
    row: list[str] | None = None
    for line in lines:
        if line.startswith("|-"):
            if row is not None:
                rows.append(row)
            row = []
        elif line[:1] in "|!" and not line.startswith(("|}", "|+")):
            row = [] if row is None else row
            for part in _cut(line[1:], "||"):
                row += _cut(part, "!!") if line[0] == "!" else [part]
        elif row:
            row[-1] += "\n" + line
    if row:
        rows.append(row)
    grid, pending = [], {}
    for cells in rows:
        out: list[str] = []
        queue = list(cells)
        while queue or len(out) in pending:
            if len(out) in pending:
                left, text = pending[len(out)]
                if left > 1:
                    pending[len(out)] = (left - 1, text)
                else:
                    del pending[len(out)]
                out.append(text)
                continue
            cell = queue.pop(0)
            span = {k: int(v) for k, v in re.findall(r'(rowspan|colspan)\s*=\s*"?(\d+)', cell)}
            for _ in range(max(1, span.get("colspan", 1))):
                if span.get("rowspan", 1) > 1:
                    pending[len(out)] = (span["rowspan"] - 1, cell_text(cell))
                out.append(cell_text(cell))
        if out:
            grid.append(out)
    return grid


def wiki_tables(text: str) -> list[list[list[str]]]:
    """The top-level tables."""
    tables, depth, held = [], 0, []
    for line in (text or "").split("\n"):
        bare = line.strip()
        if bare.startswith("{|"):
            depth += 1
            if depth == 1:
                held = []
                continue
        if depth == 1 and bare.startswith("|}"):
            depth = 0
            tables.append(wiki_grid(held))
            continue
        if depth > 1 and bare.startswith("|}"):
            depth -= 1
            continue
        if depth == 1:
            held.append(bare)
    return tables


def wikitext_cells(pages: DataFrame, key: str, text: str) -> DataFrame:
    """key, table, row, col (from 0) and text of each cell of each top-level table."""

    @F.pandas_udf("array<array<array<string>>>")
    def parse(s: pd.Series) -> pd.Series:
        return s.map(wiki_tables)

    t = pages.select(key, F.posexplode(parse(text)).alias("table", "rows"))
    r = t.select(key, "table", F.posexplode("rows").alias("row", "cells"))
    return r.select(key, "table", "row", F.posexplode("cells").alias("col", "text"))
