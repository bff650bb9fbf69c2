"""Programs as trees: built by the Python builder or by the text language, read by the analyzer."""

from __future__ import annotations

from dataclasses import dataclass, field

Pos = tuple[int, int] | None


class TidegateError(Exception):
    """An error of a program or run; ``pos`` is (line, column) where the text has one."""

    def __init__(self, message: str, pos: Pos = None) -> None:
        super().__init__(message)
        self.message, self.pos = message, pos


class SyntaxFault(TidegateError):
    """The text is no program."""


class AnalysisFault(TidegateError):
    """The program is refused."""


class BuildFault(TidegateError):
    """A source or sink cannot be opened."""


class RowFault(TidegateError):
    """A failed row under the abort policy."""

    def __init__(self, ordinal: int, source: str, reason: str, stage: str) -> None:
        super().__init__(f'row {ordinal} from "{source}": {reason}')
        self.ordinal, self.source, self.reason, self.stage = ordinal, source, reason, stage


class FatalFault(TidegateError):
    """The input cannot be read any further, whatever the policy."""


class Expr:
    """Operators build trees, so that ``col("a") >= 18`` is an expression."""

    pos: Pos = None

    def __add__(self, o): return Binary("+", self, lift(o))
    def __sub__(self, o): return Binary("-", self, lift(o))
    def __mul__(self, o): return Binary("*", self, lift(o))
    def __truediv__(self, o): return Binary("/", self, lift(o))
    def __lt__(self, o): return Binary("<", self, lift(o))
    def __le__(self, o): return Binary("<=", self, lift(o))
    def __gt__(self, o): return Binary(">", self, lift(o))
    def __ge__(self, o): return Binary(">=", self, lift(o))
    def __and__(self, o): return Binary("&&", self, lift(o))
    def __or__(self, o): return Binary("||", self, lift(o))
    def eq(self, o): return Binary("==", self, lift(o))
    def ne(self, o): return Binary("!=", self, lift(o))
    def default(self, o): return Binary("??", self, lift(o))


@dataclass(eq=False)
class Field(Expr):
    name: str
    pos: Pos = None


@dataclass(eq=False)
class Literal(Expr):
    value: object
    kind: str
    text: str = ""
    pos: Pos = None


@dataclass(eq=False)
class Name(Expr):
    """A parameter's name."""

    name: str
    pos: Pos = None


@dataclass(eq=False)
class Binary(Expr):
    op: str
    left: Expr
    right: Expr
    pos: Pos = None


@dataclass(eq=False)
class Call(Expr):
    function: str
    args: list[Expr]
    pos: Pos = None


@dataclass
class Record(Expr):
    spread: str | None
    items: list[tuple[str, Expr]]
    pos: Pos = None


def lift(value) -> Expr:
    if isinstance(value, Expr):
        return value
    kind = {bool: "bool", int: "int", float: "double", str: "string"}[type(value)]
    return Literal(value, kind, repr(value) if kind in ("int", "double") else "")


def col(name: str) -> Field:
    return Field(name)


def upper(e) -> Call: return Call("upper", [lift(e)])
def lower(e) -> Call: return Call("lower", [lift(e)])
def trim(e) -> Call: return Call("trim", [lift(e)])
def mask(e) -> Call: return Call("mask", [lift(e)])
def hash_(e) -> Call: return Call("hash", [lift(e)])
def redact(e) -> Call: return Call("redact", [lift(e)])


@dataclass
class Stage:
    """``op`` names the stage; ``args`` are expressions, column names, pairs or a count, as the stage needs them."""

    op: str
    args: list
    pos: Pos = None
    poss: list = field(default_factory=list)


@dataclass
class Branch:
    when: Expr | None  # None: else
    sink: str | None  # None: discard
    pos: Pos = None


@dataclass
class Param:
    name: str
    kind: str | None  # None: a column
    pos: Pos = None


@dataclass
class FieldDecl:
    name: str
    kind: str
    optional: bool = False
    pii: bool = False
    sealed: bool = False
    pos: Pos = None


@dataclass
class SourceDecl:
    name: str
    format: str
    path: str
    schema: list[FieldDecl]
    columns: dict[str, str] = field(default_factory=dict)
    formats: dict[str, str] = field(default_factory=dict)
    key: str | None = None
    options: dict[str, Literal] = field(default_factory=dict)
    pos: Pos = None


@dataclass
class SinkDecl:
    name: str
    format: str
    path: str
    pos: Pos = None


@dataclass
class Pipeline:
    name: str
    body: list[Stage]
    params: list[Param] = field(default_factory=list)
    pos: Pos = None


@dataclass
class Program:
    sources: list[SourceDecl] = field(default_factory=list)
    sinks: list[SinkDecl] = field(default_factory=list)
    pipelines: list[Pipeline] = field(default_factory=list)
    policy: str = "abort"  # abort, skip, or sink
    error_sink: str | None = None
    policy_pos: Pos = None
