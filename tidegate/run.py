"""Running programs: opening, materialising once, the error policies, and writing."""

from __future__ import annotations

import os
from dataclasses import replace

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidegate import sinks, sources
from tidegate.analyze import Checked, analyze
from tidegate.functions.cutting import cut
from tidegate.lower import FAIL, FATAL, ORD, Lowered, lower, need_order, q
from tidegate.nodes import FatalFault, Program, RowFault
from tidegate.sinks.render import json_line
from tidegate.syntax import parse
from tidegate.types import Schema, Type

ENVELOPE = Schema((("source", Type("string")), ("ordinal", Type("int")), ("offset", Type("int")), ("reason", Type("string")), ("stage", Type("string"))))


def plan(spark: SparkSession, program: Program, base: str = ".") -> Lowered:
    """Checks and lowers a program; its sinks are not touched."""
    checked = analyze(program)
    return lower(spark, checked, sources.build(spark, checked.source, checked.source_schema, base))


def _lines(df: DataFrame, schema: Schema, ordered: bool = True) -> DataFrame:
    """(#ord, line); without an order only the line."""
    return df.select(*([q(ORD)] if ordered else []), json_line(schema, q).alias("line"))


def run(spark: SparkSession, program: Program, base: str = ".", *, to_console: bool = False) -> None:
    """Runs a program.  Raises RowFault (abort policy) or FatalFault after the rows before it are written."""
    checked = analyze(program)
    source = sources.build(spark, checked.source, checked.source_schema, base)
    low = lower(spark, checked, source)
    outs = [*checked.sinks, *([checked.error_sink] if checked.error_sink else [])]
    writers = {s.name: sinks.open_sink("console" if to_console else s.format, s.name, sources.resolve(base, s.path)) for s in outs}
    execute(low, checked, writers)


def execute(low: Lowered, checked: Checked, writers: dict) -> None:
    f = low.frame
    aborts = checked.policy == "abort" and f.fallible
    if aborts or checked.error_sink is not None:
        need_order(f, "the policy abort" if aborts else "an error sink")
    if len(writers) > 1 or f.fatal:
        # one pass over the source for all outputs, on storage that all executors share
        f = low.frame = replace(f, df=cut(f.df))
    stop = fault = None
    if f.fatal:
        stop = f.df.where(q(FAIL)["stage"] == FATAL).agg(F.min_by(F.struct(q(FAIL)["reason"].alias("reason"), q(ORD).alias("ord")), q(ORD))).first()[0]
        if stop is not None:
            fault = FatalFault(f'source "{f.source}": {stop.reason}')
    if aborts:
        first = f.df.where(q(FAIL).isNotNull() & (q(FAIL)["stage"] != FATAL)).select(q(ORD), q(FAIL)).orderBy(q(ORD)).limit(1)
        bad = f.numbered(first).select(q(ORD).alias("ord"), q("#n").alias("n"), q(FAIL).alias("fail")).first()
        if bad is not None and (stop is None or bad.ord < stop.ord):
            stop, fault = bad, RowFault(bad.n, f.source, bad.fail.reason, bad.fail.stage)
    key = F.lit(stop.ord) if stop is not None and not isinstance(stop.ord, Row) else F.struct(*(F.lit(v).alias(k) for k, v in stop.ord.asDict().items())) if stop is not None else None
    before = (lambda df: df.where(q(ORD) < key)) if stop is not None else (lambda df: df)
    for s in checked.sinks:
        rows = low.rows(s.name)
        writers[s.name](_lines(before(rows) if f.ordered else rows, f.schema, f.ordered))
    if checked.error_sink is not None:
        writers[checked.error_sink.name](before(_lines(low.envelopes(), ENVELOPE)))
    if fault is not None:
        raise fault


def run_text(spark: SparkSession, text: str, base: str = ".", *, to_console: bool = False) -> None:
    run(spark, parse(text), base, to_console=to_console)


def run_file(spark: SparkSession, path: str, *, to_console: bool = False) -> None:
    """Paths in a program are relative to its file."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    run_text(spark, text, os.path.dirname(os.path.abspath(path)), to_console=to_console)
