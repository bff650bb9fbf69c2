"""Delimited text with provenance, read in parallel.

A file is cut into byte ranges that end at line ends.  A first pass counts, per range, lines and
records for both cases (the range begins inside a quoted cell or not); the driver adds these few
numbers up, which gives every range its state, first line and first ordinal; a second pass reads the
records.  Both passes are distributed, and ordinals and line numbers are exact whatever the quoting.
A range without quotes is split column-wise, one with quotes record by record.  What a task has to
know of its range are the columns of its row.  A path may stand for several files with one and the
same header: ordinals go on from file to file, line numbers are those of each file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

from tidegate.lower import FATAL, OFF, ORD, Frame
from tidegate.nodes import BuildFault, SourceDecl
from tidegate.sources import from_cells, positions, register, resolve
from tidegate.sources.places import expand, has_scheme, opened, size_of
from tidegate.types import Schema

CHUNK = 64 << 20


class BrokenRecord(ValueError):
    pass


def split_record(text: str) -> list[str]:
    """The cells of one record; a quote may only stand around a whole cell, or doubled inside one."""
    cells, at, n = [], 0, len(text)
    while True:
        if at < n and text[at] == '"':
            parts = []
            at += 1
            while True:
                end = text.find('"', at)
                if end < 0:
                    raise BrokenRecord('extraneous or missing " in quoted-field')
                parts.append(text[at:end])
                at = end + 1
                if at < n and text[at] == '"':
                    parts.append('"')
                    at += 1
                    continue
                break
            if at < n and text[at] != ",":
                raise BrokenRecord('extraneous or missing " in quoted-field')
            cells.append("".join(parts).replace("\r\n", "\n"))
        else:
            end = text.find(",", at)
            end = n if end < 0 else end
            if '"' in text[at:end]:
                raise BrokenRecord('bare " in non-quoted-field')
            cells.append(text[at:end])
            at = end
        if at >= n:
            return cells
        at += 1


def _lines(path: str, start: int, stop: int | None) -> Iterator[bytes]:
    """The lines that begin in [start, stop); without a stop, to the end of the file."""
    with opened(path) as f:
        if start:
            f.seek(start - 1)
            f.readline()  # the rest of a line that begins in the range before
        while stop is None or f.tell() < stop:
            line = f.readline()
            if not line:
                return
            yield line


def _bare(line: bytes) -> bytes:
    return line[:-2] if line.endswith(b"\r\n") else line[:-1] if line.endswith(b"\n") else line


def _tally(path: str, start: int, stop: int) -> tuple[int, int, int, int]:
    """Lines, parity of quotes, and records that begin in the range if it does not, or does, begin inside quotes."""
    lines, odd, plain, inside = 0, 0, 0, 0
    for line in _lines(path, start, stop):
        lines += 1
        filled = bool(_bare(line))
        if filled:
            plain += not odd
            inside += odd
        odd ^= line.count(b'"') & 1
    return lines, odd, plain, inside


def _records(path: str, start: int, stop: int, quoted: bool, line_no: int, ordinal: int) -> Iterator[tuple[int, int, str]]:
    """(ordinal, line, text) of the records that begin in the range."""
    held: list[bytes] = []
    first = line_no
    with opened(path) as f:
        if start:
            f.seek(start - 1)
            f.readline()
        while True:
            place = f.tell()
            if place >= stop and not held and not quoted:
                return
            line = f.readline()
            if not line:
                break
            odd = line.count(b'"') & 1
            if quoted and not held:  # the rest of a record of the range before
                quoted = not odd
                line_no += 1
                if place >= stop:
                    return
                continue
            if not held and place >= stop:
                return
            if not held and not _bare(line):
                line_no += 1
                continue
            if not held:
                first = line_no
            held.append(line)
            line_no += 1
            quoted ^= bool(odd)
            if not quoted:
                yield ordinal, first, _bare(b"".join(held)).decode("utf-8", "replace")
                ordinal += 1
                held = []
    if held:
        yield ordinal, first, _bare(b"".join(held)).decode("utf-8", "replace")


def header_of(path: str) -> tuple[list[str], int, int]:
    """(header cells, bytes and lines it takes)."""
    try:
        with opened(path) as f:
            taken, count = b"", 0
            while True:
                line = f.readline()
                if not line and not taken.strip():
                    raise BuildFault(f"csv: cannot read header of {path}: empty file")
                taken += line
                count += 1
                if not line or (taken.count(b'"') % 2 == 0 and _bare(line)) or (taken.count(b'"') % 2 == 0 and taken.strip()):
                    break
            return split_record(_bare(taken.lstrip(b"\r\n")).decode("utf-8", "replace")), f.tell(), count
    except (OSError, BrokenRecord) as e:
        raise BuildFault(f"csv: cannot read header of {path}: {e}") from e


def _plain(path: str, start: int, stop: int, line_no: int, ordinal: int, width: int) -> pa.Table | None:
    """All records of a range without quotes; None if it has any, or a record of another width."""
    with opened(path) as f:
        if start:
            f.seek(start - 1)
            f.readline()
        data = f.read(max(0, stop - f.tell()))
        if data and not data.endswith(b"\n"):
            data += f.readline()
    if b'"' in data:
        return None
    ended = data.endswith(b"\n")
    lines = data.decode("utf-8", "replace").split("\n")
    if ended or not data:
        lines.pop()
    if b"\r" in data:
        last = len(lines) if ended else len(lines) - 1
        lines = [x[:-1] if i < last and x.endswith("\r") else x for i, x in enumerate(lines)]
    at = np.flatnonzero([bool(x) for x in lines])
    cells = pc.split_pattern(pa.array([x for x in lines if x], pa.string()), ",")
    if len(cells) and not pc.all(pc.equal(pc.list_value_length(cells), width)).as_py():
        return None
    return pa.table([pa.array(ordinal + np.arange(len(at)), pa.int64()), pa.array(line_no + at, pa.int64()), cells, pa.nulls(len(at), pa.string())], names=[ORD, OFF, "cells", FATAL])


def _quoted(path: str, start: int, stop: int, quoted: bool, line_no: int, ordinal: int, width: int) -> Iterator[pa.RecordBatch]:
    """The records of any range, one by one."""
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        n, at, cells, fault = zip(*out) if out else ((), (), (), ())
        return pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(at, pa.int64()), pa.array(cells, pa.list_(pa.string())), pa.array(fault, pa.string())], names=[ORD, OFF, "cells", FATAL])

    for n, at, text in _records(path, start, stop, quoted, line_no, ordinal):
        fault, cells = None, []
        try:
            cells = split_record(text)
            if len(cells) != width:
                fault = f"record on line {at}: wrong number of fields"
        except BrokenRecord as e:
            fault = f"record on line {at}: {e}"
        out.append((n, at, cells, fault))
        if len(out) == 10_000:
            yield batch()
            out.clear()
    yield batch()


@register("csv")
def csv_source(spark: SparkSession, decl: SourceDecl, schema: Schema, base: str, chunk: int = CHUNK) -> Frame:
    path = decl.path if has_scheme(decl.path) else resolve(base, decl.path)
    files = expand(path)
    if not files:
        raise BuildFault(f"csv: no file found at {path}")
    header = header_of(files[0])[0]
    place, width = positions(decl, schema, header), len(header)
    ranges, n = [], 0
    for f in files:
        try:
            size = size_of(f)
        except OSError as e:
            raise BuildFault(f"csv: cannot read {f}: {e}") from e
        ranges += [(n + i, f, a, min(a + chunk, size)) for i, a in enumerate(range(0, max(size, 1), chunk))]
        n = len(ranges)

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for n, f, start, stop in b.itertuples(index=False):
                skipped, wrong = 0, None
                if start == 0:  # the range of the header
                    names, start, skipped = header_of(f)
                    wrong = None if names == header else f"csv: header {names} of {f} is not that of the first file, {header}"
                out.append((n, f, start, max(start, stop), skipped, wrong, *((0, 0, 0, 0) if lone else _tally(f, start, stop))))
            yield pd.DataFrame(out, columns=["n", "file", "a", "b", "skipped", "wrong", "n_lines", "odd", "plain", "inside"])

    lone = len(ranges) == 1  # one range begins at the first record: there is nothing to add up
    counted = "n long, file string, a long, b long, skipped long, wrong string, n_lines long, odd long, plain long, inside long"
    jobs = spark.createDataFrame(spark.sparkContext.parallelize(ranges, len(ranges)), "n long, file string, a long, b long")
    line, ordinal, quoted, starts, now = 1, 0, False, [], None
    for r in sorted(tuple(x) for x in jobs.mapInPandas(tally, counted).collect()) if not lone else [next(tally(iter([pd.DataFrame(ranges)]))).iloc[0]]:
        _, f, a, b, skipped, wrong, n_lines, odd, plain, inside = r
        if wrong:
            raise BuildFault(wrong)
        if f != now:
            line, quoted, now = int(skipped) + 1, False, f
        starts.append((f, int(a), int(b), quoted, line, ordinal))
        line, ordinal, quoted = line + n_lines, ordinal + (inside if quoted else plain), quoted ^ bool(odd)
    jobs = spark.createDataFrame(spark.sparkContext.parallelize(starts, len(starts)), "file string, a long, b long, quoted boolean, line_no long, ordinal long")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for job in zip(*(c.to_pylist() for c in b.columns)):
                f, start, stop, inside, *first = job
                table = None if inside else _plain(f, start, stop, *first, width)
                yield from table.to_batches(10_000) if table is not None else _quoted(*job, width)

    rows = jobs.mapInArrow(read, f"`{ORD}` long, `{OFF}` long, cells array<string>, `{FATAL}` string")
    return from_cells(spark, decl, schema, rows, place, "csv", fatal=True)
