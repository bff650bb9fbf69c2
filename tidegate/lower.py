"""Lowering of analyzed programs to DataFrames.

A frame carries the row's provenance and failure beside its columns: ``#ord`` (ordinal or order key),
``#off`` (place in the source) and ``#fail`` (null while the row is healthy).  User columns have
internal names, so that case and odd names never clash.  Projections only change the mapping of names;
``map`` is one select; expressions are guarded so that a failed row is never evaluated, as long as
one can have failed.  A filter is written as bare conjuncts, which reach the scan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.analyze import Checked, Typer
from tidegate.coerce import decimal_literal, trim_blank
from tidegate.nodes import Binary, BuildFault, Call, Expr, Field, Literal, Record, Stage
from tidegate.types import SPARK, Schema

ORD, OFF, FAIL = "#ord", "#off", "#fail"
FATAL = "#fatal"
FAIL_TYPE = "struct<reason:string,stage:string>"
_fresh = count()


def q(name: str) -> Column:
    return F.col(f"`{name}`")


@contextmanager
def settings(spark: SparkSession, **conf: str) -> Iterator[None]:
    """Settings that are read while a DataFrame is built, put back afterwards."""
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def engine_settings(spark: SparkSession):
    """Integers wrap around, and parsed moments have no zone, whatever the session says."""
    return settings(spark, **{"spark.sql.ansi.enabled": "false", "spark.sql.timestampType": "TIMESTAMP_NTZ"})


@dataclass
class Frame:
    """``names`` maps user names to columns of ``df``; ``dense``: ordinals are 0, 1, 2, … without gaps; ``fatal``: the source may hold
    a fatal row; ``ordered``: ``#ord`` gives the rows their order; ``fallible``: a row can have failed; ``number``: adds ``#n``, the
    ordinal, to rows that have an order key, if that is not the ordinal itself."""

    df: DataFrame
    schema: Schema
    names: dict[str, str]
    source: str
    dense: bool = True
    fatal: bool = False
    ordered: bool = True
    fallible: bool = True
    number: Callable[[DataFrame], DataFrame] | None = None

    def numbered(self, df: DataFrame) -> DataFrame:
        """Adds ``#n``, the ordinal of each row."""
        if self.number is not None:
            return self.number(df)
        return df.withColumn("#n", q(ORD) if self.ordered else F.lit(None).cast("bigint"))

    @property
    def healthy(self) -> Column:
        return q(FAIL).isNull()

    def user(self, name: str) -> Column:
        return q(self.names[name])


# -- decimals with a scale of their own
def _pow10(n: Column) -> Column:
    powers = F.array(*(F.lit("1" + "0" * k).cast("decimal(38,0)") for k in range(38)))  # folded to one constant
    return F.get(powers, n)


def _rescaled(d: Column, s: Column) -> Column:
    return F.when(d["s"] == s, d["u"]).otherwise((d["u"] * _pow10(s - d["s"])).cast("decimal(38,0)"))


def _dec(u: Column, s: Column, *operands: Column) -> Column:
    present = reduce(lambda x, y: x & y, (o.isNotNull() for o in operands))
    made = F.struct(F.coalesce(u, F.raise_error(F.lit("decimal beyond 38 digits")).cast("decimal(38,0)")).cast("decimal(38,0)").alias("u"), s.cast("int").alias("s"))
    return F.when(present, made)


def _decimal_op(op: str, a: Column, b: Column) -> Column:
    s = F.greatest(a["s"], b["s"])
    x, y = _rescaled(a, s), _rescaled(b, s)
    if op in COMPARE:
        return COMPARE[op](x, y)
    if op in "+-":
        return _dec(x + y if op == "+" else x - y, s, a, b)
    if op == "*":
        return _dec(a["u"] * b["u"], a["s"] + b["s"], a, b)
    shift = 16 + b["s"] - a["s"]
    num = (F.abs(a["u"]) * _pow10(F.greatest(shift, F.lit(0)))).cast("decimal(38,0)")
    den = (F.abs(b["u"]) * _pow10(F.greatest(-shift, F.lit(0)))).cast("decimal(38,0)")
    den = F.when(den == 0, F.raise_error(F.lit("decimal division by zero")).cast("decimal(38,0)")).otherwise(den)
    rest = num % den
    whole = ((num - rest) / den).cast("decimal(38,0)")
    rounded = whole + F.when(rest * 2 >= den, 1).otherwise(0)
    return _dec(F.when((a["u"] < 0) != (b["u"] < 0), -rounded).otherwise(rounded), F.lit(16), a, b)


COMPARE = {"<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b}
FUNCTION = {
    "upper": F.upper,
    "lower": F.lower,
    "trim": trim_blank,
    "mask": lambda c: F.repeat(F.lit("*"), F.octet_length(c)),
    "hash": lambda c: F.sha2(c, 256),
    "redact": lambda c: F.when(c.isNotNull(), F.lit("[REDACTED]")),
}


class Lowerer:
    """Expressions over a frame to columns. Absent is null: every operator but ?? gives null if an operand is null."""

    def __init__(self, frame: Frame) -> None:
        self.frame, self.typer = frame, Typer(frame.schema)

    def column(self, e: Expr) -> Column:
        if isinstance(e, Field):
            return self.frame.user(e.name)
        if isinstance(e, Literal):
            if e.kind == "decimal":
                u, s = decimal_literal(e.text or repr(e.value))
                return F.struct(F.lit(str(u)).cast("decimal(38,0)").alias("u"), F.lit(s).cast("int").alias("s"))
            return F.lit(e.value).cast(SPARK[e.kind])
        if isinstance(e, Call):
            return FUNCTION[e.function](self.column(e.args[0]))
        assert isinstance(e, Binary)
        a, b, kind = self.column(e.left), self.column(e.right), self.typer.of(e.left).kind
        if e.op == "??":
            return F.coalesce(a, b)
        if e.op in ("&&", "||"):
            both = a & b if e.op == "&&" else a | b
            return F.when(a.isNotNull() & b.isNotNull(), both)
        if kind == "decimal":
            return _decimal_op(e.op, a, b)
        if e.op in COMPARE:
            out = COMPARE[e.op](a, b)
            if kind == "double":  # a NaN differs from everything, itself included
                nan = F.isnan(a) | F.isnan(b)
                out = F.when(nan, F.lit(e.op == "!=")).otherwise(out)
                out = F.when(a.isNotNull() & b.isNotNull(), out)
            return out
        if e.op == "+":
            return F.concat(a, b) if kind == "string" else a + b
        if e.op == "-":
            return a - b
        if e.op == "*":
            return a * b
        if kind == "int":
            return F.when(b == 0, F.raise_error(F.lit("integer divide by zero")).cast("bigint")).otherwise(F.call_function("div", a, b).cast("bigint"))
        signed = F.when(b.cast("string").startswith("-"), -a).otherwise(a)  # 1 / -0.0 is -Infinity
        by_zero = F.when(a.isNull() | F.isnan(a) | (a == 0), F.when(a.isNotNull(), F.lit(float("nan")))).otherwise(F.when(signed > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf"))))
        return F.when(b == 0, by_zero).otherwise(a / b)


    def predicate(self, e: Expr) -> Column:
        """An expression as the condition of a filter, which drops absent as it drops false: conjuncts and comparisons stay bare."""
        if isinstance(e, Binary) and e.op == "&&":
            return self.predicate(e.left) & self.predicate(e.right)
        if isinstance(e, Binary) and e.op == "||" and not _gives_default(e):
            # absent on one side is absent, whatever the other says
            present = reduce(lambda x, y: x & y, (self.frame.user(n).isNotNull() for n in sorted(_fields(e))), F.lit(True))
            return present & (self.predicate(e.left) | self.predicate(e.right))
        if isinstance(e, Binary) and e.op in COMPARE and self.typer.of(e.left).kind == "double" and (isinstance(e.left, Field) and isinstance(e.right, Literal) or isinstance(e.left, Literal) and isinstance(e.right, Field)):
            a, b = self.column(e.left), self.column(e.right)
            value = a if isinstance(e.left, Field) else b
            above = e.op in ((">", ">=") if isinstance(e.left, Field) else ("<", "<="))  # a NaN counts as the largest number
            return COMPARE[e.op](a, b) & ~F.isnan(value) if above else COMPARE[e.op](a, b)
        return self.column(e)


def _fields(e: Expr) -> set[str]:
    if isinstance(e, Field):
        return {e.name}
    return set().union(*map(_fields, e.args)) if isinstance(e, Call) else _fields(e.left) | _fields(e.right) if isinstance(e, Binary) else set()


def _gives_default(e: Expr) -> bool:
    """Whether ?? stands anywhere, so that an absent field need not make the whole absent."""
    return isinstance(e, Binary) and (e.op == "??" or _gives_default(e.left) or _gives_default(e.right)) or isinstance(e, Call) and any(map(_gives_default, e.args))


def need_order(f: Frame, what: str) -> None:
    if not f.ordered:
        raise BuildFault(f'{what} needs an order of the rows of "{f.source}": give order_by, a unique column')


def step(f: Frame, s: Stage, schema: Schema, *, drop_failed: bool = False) -> Frame:
    """One stage; ``schema`` is the schema behind it.  With ``drop_failed`` nobody asks for failed rows any more."""
    if s.op == "filter":
        if not f.fallible:
            return replace(f, df=f.df.where(Lowerer(f).predicate(s.args[0])), dense=False)
        keep = ~f.healthy | F.coalesce(Lowerer(f).column(s.args[0]), F.lit(False))
        return replace(f, df=f.df.where(keep), dense=False)
    if s.op == "check":
        if drop_failed and not f.fallible:
            return replace(f, df=f.df.where(Lowerer(f).predicate(s.args[0])), dense=False)
        bad = f.healthy & ~F.coalesce(Lowerer(f).column(s.args[0]), F.lit(False))
        fail = F.when(bad, F.struct(F.lit(s.args[1]).alias("reason"), F.lit("check").alias("stage"))).otherwise(q(FAIL)).cast(FAIL_TYPE)
        return replace(f, df=f.df.withColumn(FAIL, fail), fallible=True)
    if s.op == "map":
        r: Record = s.args[0]
        low = Lowerer(f)
        names = dict(f.names) if r.spread else {}
        new: dict[str, Column] = {}
        for name, e in r.items:
            inner = f"c{next(_fresh)}"
            if name in names:
                new.pop(names[name], None)
            names[name] = inner
            new[inner] = F.when(f.healthy, low.column(e)) if f.fallible else low.column(e)
        kept = [q(c) for c in dict.fromkeys(names.values()) if c not in new]
        return replace(f, df=f.df.select(*_carriers(f.df), *kept, *(v.alias(k) for k, v in new.items())), schema=schema, names={n: names[n] for n in schema.names})
    if s.op in ("select", "drop"):
        return replace(f, schema=schema, names={n: f.names[n] for n in schema.names})
    if s.op == "rename":
        moves = dict(s.args)
        return replace(f, schema=schema, names={moves.get(n, n): c for n, c in f.names.items()})
    if s.op in ("mask", "hash", "redact"):
        changed = {f.names[n]: f"c{next(_fresh)}" for n in s.args}
        df = f.df.select(*(c for c in _carriers(f.df)), *((F.when(f.healthy, FUNCTION[s.op](q(c))) if f.fallible else FUNCTION[s.op](q(c))).alias(changed[c]) if c in changed else q(c) for c in dict.fromkeys(f.names.values())))
        return replace(f, df=df, schema=schema, names={n: changed.get(c, c) for n, c in f.names.items()})
    n = s.args[0]
    need_order(f, s.op)
    if s.op == "limit":
        if f.dense:  # ordinals have no gaps, so no sort is needed
            return replace(f, df=f.df.where(q(ORD) < n))
        return replace(f, df=f.df.orderBy(q(ORD)).limit(n), dense=False)
    fatal = q(FAIL)["stage"] == FATAL
    rows = f.df.where(f.healthy | ~fatal) if f.fatal else f.df
    if f.dense:
        rows = rows.where(q(ORD) >= n)
    elif n:
        # the last of the first n rows is found by a top-n; what lies behind it is a filter, whatever its size
        last = rows.select(q(ORD).alias("#first")).orderBy("`#first`").limit(n).agg(F.max("`#first`").alias("#last"), F.count(F.lit(1)).alias("#seen"))
        rows = rows.crossJoin(F.broadcast(last)).where((q("#seen") == n) & (q(ORD) > q("#last"))).drop("#last", "#seen")  # one row
    return replace(f, df=rows.unionByName(f.df.where(~f.healthy & fatal)) if f.fatal else rows, dense=False)


def _carriers(df: DataFrame) -> list[Column]:
    return [q(c) for c in (ORD, OFF, FAIL) if c in df.columns]


@dataclass
class Lowered:
    """The unified frame behind all stages (failed rows still inside) and, per sink, which rows it gets."""

    frame: Frame
    checked: Checked
    which: dict[str, Column] = field(default_factory=dict)

    def rows(self, sink: str) -> DataFrame:
        """The healthy rows of a sink with order key and user columns."""
        f = self.frame
        wanted = f.healthy & self.which[sink] if f.fallible else self.which[sink]
        return f.df.where(wanted).select(q(ORD), *(f.user(n).alias(n) for n in f.schema.names))

    def routed(self, name: str = "target") -> DataFrame:
        """The healthy rows of all sinks of a route in one pass, with the sink's name; discarded rows are left out."""
        f = self.frame
        sink = reduce(lambda c, s: c.when(self.which[s], F.lit(s)), self.which, F.when(F.lit(False), F.lit("")))
        df = f.df.where(f.healthy) if f.fallible else f.df
        return df.select(sink.alias(name), *(f.user(n).alias(n) for n in f.schema.names)).where(q(name).isNotNull())

    def strict(self, sink: str) -> DataFrame:
        """The rows of a sink under the policy abort, read as a DataFrame: a failed row is an error of the query, never left out."""
        f = self.frame
        if not f.fallible:
            return self.rows(sink)
        fault = F.raise_error(F.concat(F.lit(f'a row from "{f.source}": '), q(FAIL)["reason"])).cast("boolean")
        return f.df.where(F.when(f.healthy, self.which[sink]).otherwise(fault)).select(q(ORD), *(f.user(n).alias(n) for n in f.schema.names))

    def envelopes(self) -> DataFrame:
        """The failed rows, as provenance and reason and nothing else."""
        f = self.frame
        bad = f.numbered(f.df.where(~f.healthy & (q(FAIL)["stage"] != FATAL)))
        return bad.select(q(ORD), F.lit(f.source).alias("source"), q("#n").alias("ordinal"), F.coalesce(q(OFF), q("#n")).alias("offset"), q(FAIL)["reason"].alias("reason"), q(FAIL)["stage"].alias("stage"))


def lower(spark: SparkSession, checked: Checked, source: Frame) -> Lowered:
    from tidegate.analyze import Analyzer

    walker = Analyzer.__new__(Analyzer)
    walker.steps = []
    with engine_settings(spark):
        f, schema = source, checked.source_schema
        for i, s in enumerate(checked.steps):
            schema = getattr(walker, f"_{s.op}")(s, schema)
            # limit and offset count failed rows, so they are kept as long as one follows
            drop = checked.policy == "skip" and not any(x.op in ("limit", "offset") for x in checked.steps[i:])
            f = step(f, s, schema, drop_failed=drop)
        out = Lowered(f, checked)
        if checked.branches is None:
            out.which = {s.name: F.lit(True) for s in checked.sinks}
        else:
            low = Lowerer(f)
            target = None
            for i, b in enumerate(checked.branches):
                if b.when is not None:
                    hit = F.coalesce(low.column(b.when), F.lit(False))
                    target = F.when(hit, i) if target is None else target.when(hit, i)
            other = next(i for i, b in enumerate(checked.branches) if b.when is None)
            target = F.lit(other) if target is None else target.otherwise(other)
            inner = f"c{next(_fresh)}"
            out.frame = f = replace(f, df=f.df.withColumn(inner, F.when(f.healthy, target) if f.fallible else target))
            out.which = {s.name: q(inner).isin([i for i, b in enumerate(checked.branches) if b.sink == s.name]) for s in checked.sinks}
        return out
