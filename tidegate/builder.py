"""Programs written in Python, onto the same trees as the text form.

    orders = rows(spark.read.parquet(path), "o_orderkey: int, o_totalprice: double", order_by="o_orderkey")
    out = orders.filter(col("o_totalprice") > 100000.0).select("o_orderkey").frame()
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

from tidegate.analyze import analyze
from tidegate.functions.binding import bind
from tidegate.lower import ORD, Lowered, lower, need_order, q
from tidegate.nodes import Branch, Expr, FieldDecl, Pipeline, Program, Record, SinkDecl, SourceDecl, Stage, lift
from tidegate.sinks.render import decimal_text
from tidegate.sources.table import frame_of
from tidegate.syntax import Reader


def fields(text: str) -> list[FieldDecl]:
    """Fields in the form of the text language: ``name: type`` with ? and tags."""
    r = Reader("{" + text + "}")
    r.need("{")
    return r.items("}", r.field)


@dataclass(frozen=True)
class Rows:
    """A pipeline under construction over a DataFrame; every method gives a new one."""

    df: DataFrame
    schema: tuple[FieldDecl, ...]
    order_by: str | None = None
    columns: dict[str, str] = field(default_factory=dict)
    stages: tuple[Stage, ...] = ()
    policy: str = "abort"

    def _with(self, *stages: Stage) -> Rows:
        return replace(self, stages=(*self.stages, *stages))

    def filter(self, e: Expr) -> Rows: return self._with(Stage("filter", [e]))
    def check(self, e: Expr, reason: str) -> Rows: return self._with(Stage("check", [e, reason]))
    def select(self, *names: str) -> Rows: return self._with(Stage("select", list(names)))
    def drop(self, *names: str) -> Rows: return self._with(Stage("drop", list(names)))
    def rename(self, **moves: str) -> Rows: return self._with(Stage("rename", list(moves.items())))
    def limit(self, n: int) -> Rows: return self._with(Stage("limit", [n]))
    def offset(self, n: int) -> Rows: return self._with(Stage("offset", [n]))
    def mask(self, *names: str) -> Rows: return self._with(Stage("mask", list(names)))
    def hash(self, *names: str) -> Rows: return self._with(Stage("hash", list(names)))
    def redact(self, *names: str) -> Rows: return self._with(Stage("redact", list(names)))
    def on_error(self, policy: str) -> Rows: return replace(self, policy=policy)

    def map(self, *, spread: bool = True, **items: object) -> Rows:
        return self._with(Stage("map", [Record("row" if spread else None, [(k, lift(v)) for k, v in items.items()])]))

    def apply(self, segment) -> Rows:
        """A reusable segment: a function from rows to rows."""
        return segment(self)

    def lowered(self, branches: list[Branch] | None = None, sinks: tuple[str, ...] = ("out",)) -> Lowered:
        ends = [Stage("route", branches)] if branches is not None else [Stage("ref", [s]) for s in sinks]
        names = dict.fromkeys(b.sink for b in branches if b.sink) if branches is not None else sinks
        policy = self.policy if self.policy in ("abort", "skip") else "sink"
        p = Program([SourceDecl("in", "frame", "", list(self.schema))], [SinkDecl(s, "frame", "") for s in (*names, *(["errors"] if policy == "sink" else []))], [Pipeline("main", [Stage("ref", ["in"]), *self.stages, *ends])], policy, "errors" if policy == "sink" else None)
        checked = analyze(p)
        source = frame_of(self.df, checked.source_schema, "in", columns=self.columns, order_by=self.order_by)
        return lower(self.df.sparkSession, checked, source)

    def frame(self, sink: str = "out") -> DataFrame:
        """The rows as a DataFrame: the healthy ones, or under the policy abort an error when it is read, should a row have failed."""
        return plain(self.lowered(), sink)

    def errors(self) -> DataFrame:
        low = self.on_error("sink").lowered()
        need_order(low.frame, "an error sink")
        return low.envelopes().drop(ORD)

    def route(self, **branches: Expr | None) -> Lowered:
        """Branches by sink name in order; None is else, and the name discard drops the rows."""
        return self.lowered([Branch(e, None if s == "discard" else s) for s, e in branches.items()])


def plain(low: Lowered, sink: str) -> DataFrame:
    """A sink's rows without the order key, decimals as text at their scale."""
    rows = (low.strict(sink) if low.checked.policy == "abort" else low.rows(sink)).drop(ORD)
    kinds = dict(low.frame.schema.fields)
    names = rows.columns
    for n in names:
        if kinds[n].kind == "decimal" and not kinds[n].sealed:  # its text reads the value many times
            rows = bind(rows.withColumnRenamed(n, f"#{n}"), n, q(f"#{n}"))
    rows = rows.select(*(q(n) for n in names))
    return rows.select(*(decimal_text(q(n)).alias(n) if kinds[n].kind == "decimal" and not kinds[n].sealed else q(n) for n in rows.columns))


def rows(df: DataFrame, schema: str, *, order_by: str | None = None, columns: dict[str, str] | None = None) -> Rows:
    return Rows(df, tuple(fields(schema)), order_by, columns or {})
