"""Column types with the governance facts that travel with them."""

from __future__ import annotations

from dataclasses import dataclass, replace

KINDS = ("string", "int", "double", "bool", "date", "datetime", "decimal")
NUMERIC = frozenset(("int", "double", "decimal"))
ORDERED = NUMERIC | {"date", "datetime"}
#: Spark type of each kind's column; a decimal keeps each value's own scale.
SPARK = {"string": "string", "int": "bigint", "double": "double", "bool": "boolean", "date": "date", "datetime": "timestamp_ntz", "decimal": "struct<u:decimal(38,0),s:int>"}


@dataclass(frozen=True)
class Type:
    """``optional``: may be absent; ``pii``: personal data; ``sealed``: encrypted when read, and then opaque."""

    kind: str
    optional: bool = False
    pii: bool = False
    sealed: bool = False

    def __str__(self) -> str:
        if self.sealed:
            return f"deidentified<{self.kind}{'?' * self.optional}>"
        return f"{self.kind}{'?' * self.optional}{' @pii' * self.pii}"

    def but(self, **changes) -> Type:
        return replace(self, **changes)


@dataclass(frozen=True)
class Schema:
    """Ordered fields."""

    fields: tuple[tuple[str, Type], ...] = ()

    def __str__(self) -> str:
        return "{" + ", ".join(f"{n}: {t}" for n, t in self.fields) + "}"

    def __contains__(self, name: str) -> bool:
        return any(n == name for n, _ in self.fields)

    @property
    def names(self) -> list[str]:
        return [n for n, _ in self.fields]

    def get(self, name: str) -> Type | None:
        return next((t for n, t in self.fields if n == name), None)

    def with_field(self, name: str, type_: Type) -> Schema:
        """Replaced in its place, or appended."""
        if name in self:
            return Schema(tuple((n, type_ if n == name else t) for n, t in self.fields))
        return Schema((*self.fields, (name, type_)))

    def first(self, fact: str) -> str | None:
        """The first field that is ``optional`` or ``pii`` (an encrypted field is neither)."""
        return next((n for n, t in self.fields if not t.sealed and getattr(t, fact)), None)
