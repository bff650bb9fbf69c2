"""Workbook sheets with provenance, from the raw stored values.

A workbook is one compressed file with shared strings, so it is read by one task; what follows is as
parallel as the session makes it.  The header and all structural checks happen on the driver first.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import SparkSession

from tidegate.lower import FATAL, OFF, ORD, Frame
from tidegate.nodes import BuildFault, SourceDecl
from tidegate.sources import from_cells, positions, register, resolve
from tidegate.types import Schema

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _text(node) -> str:
    """Plain and rich text, without phonetic runs."""
    return "".join(t.text or "" for part in node if part.tag in (f"{MAIN}t", f"{MAIN}r") for t in ([part] if part.tag == f"{MAIN}t" else part.iter(f"{MAIN}t")))


def sheets(book: zipfile.ZipFile) -> dict[str, str]:
    """Sheet name to its part, in the workbook's order."""
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    out = {}
    for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{MAIN}sheet"):
        target = links[s.get(REL)].lstrip("/")
        out[s.get("name")] = target if target.startswith("xl/") else f"xl/{target}"
    return out


def rows(path: str, part: str) -> Iterator[tuple[int, list[str]]]:
    """(row number, cells) of the rows that are stored."""
    with zipfile.ZipFile(path) as book:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in book.namelist():
            with book.open("xl/sharedStrings.xml") as f:
                for _, node in ElementTree.iterparse(f):
                    if node.tag == f"{MAIN}si":
                        shared.append(_text(node))
                        node.clear()
        with book.open(part) as f:
            number = 0
            for _, node in ElementTree.iterparse(f):
                if node.tag != f"{MAIN}row":
                    continue
                number = int(node.get("r") or number + 1)
                cells: list[str] = []
                for c in node.iter(f"{MAIN}c"):
                    at = _column(c.get("r")) if c.get("r") else len(cells)
                    cells += [""] * (at + 1 - len(cells))
                    v, kind = c.find(f"{MAIN}v"), c.get("t")
                    if kind == "inlineStr":
                        cells[at] = _text(c.find(f"{MAIN}is"))
                    elif v is not None and v.text is not None:
                        cells[at] = shared[int(v.text)] if kind == "s" else v.text
                yield number, cells
                node.clear()


@register("xlsx")
def xlsx_source(spark: SparkSession, decl: SourceDecl, schema: Schema, base: str) -> Frame:
    path = resolve(base, decl.path)
    kinds = {"sheet": "string", "header_row": "int"}
    for name, kind in kinds.items():
        if name in decl.options and decl.options[name].kind != kind:
            raise BuildFault(f"xlsx: {name} must be {kind}, got {decl.options[name].kind}")
    head = decl.options["header_row"].value if "header_row" in decl.options else 1
    if head < 1:
        raise BuildFault(f"xlsx: header_row must be 1 or more, got {head}")
    try:
        with zipfile.ZipFile(path) as book:
            parts = sheets(book)
    except (OSError, zipfile.BadZipFile, KeyError) as e:
        raise BuildFault(f"xlsx: cannot open {path}: {e}") from e
    sheet = decl.options["sheet"].value if "sheet" in decl.options else next(iter(parts), "")
    if sheet not in parts:
        raise BuildFault(f'xlsx: sheet "{sheet}" not found; available: {", ".join(parts)}')
    part = parts[sheet]
    header = None
    for number, cells in rows(path, part):
        if number >= head:
            header = cells if number == head else []
            break
    if header is None:
        raise BuildFault(f'xlsx: sheet "{sheet}" has no row {head} for the header')
    twice = [h for i, h in enumerate(header) if h and h in header[:i]]
    if twice:
        raise BuildFault(f'xlsx: duplicate header "{twice[0]}"')
    place = positions(decl, schema, header, "xlsx")
    used = [i for i in place.values() if i is not None]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            out, ordinal = [], 0
            for number, cells in rows(path, part):
                if number <= head or all(i >= len(cells) or cells[i] == "" for i in used):
                    continue
                out.append((ordinal, number, cells, None))
                ordinal += 1
                if len(out) == 10_000:
                    yield pd.DataFrame(out, columns=[ORD, OFF, "cells", FATAL])
                    out = []
            yield pd.DataFrame(out, columns=[ORD, OFF, "cells", FATAL])

    df = spark.range(0, 1, 1, 1).mapInPandas(read, f"`{ORD}` long, `{OFF}` long, cells array<string>, `{FATAL}` string")
    return from_cells(spark, decl, schema, df, place, "xlsx")
