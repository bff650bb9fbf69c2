"""Values as text: canonical text, and JSON lines built by column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegate.types import Schema, Type

# Characters that JSON text carries as escapes here, markup and line separators included.
ESCAPES = (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f"), ("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026"), (" ", "\\u2028"), (" ", "\\u2029"))


def double_text(c: Column) -> Column:
    """The shortest digits that give the number back: plain from 1e-6 up to 1e21, else with an exponent."""
    text = F.abs(c).cast("string")
    mantissa, power = F.split(text, "E")[0], F.coalesce(F.get(F.split(text, "E"), F.lit(1)).try_cast("int"), F.lit(0))
    whole = F.split(mantissa, r"\.")[0]
    frac = F.regexp_replace(F.coalesce(F.get(F.split(mantissa, r"\."), F.lit(1)), F.lit("")), "0+$", "")
    digits, point = F.concat(whole, frac), F.length(whole) + power
    join = lambda a, b: F.when(b == "", a).otherwise(F.concat(a, F.lit("."), b))
    padded = F.when(F.length(digits) < point, F.rpad(digits, point, F.lit("0"))).otherwise(digits)
    plain = F.when(power == 0, join(whole, frac)).when(point > 0, join(F.substring(padded, F.lit(1), point), F.substring(padded, point + 1, F.length(padded)))).otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
    sci = F.concat(join(whole, frac), F.when(power < 0, "e-").otherwise("e+"), F.abs(power).cast("string"))
    big = (F.abs(c) >= 1e21) | ((F.abs(c) < 1e-6) & (c != 0))
    out = F.when(big, sci).otherwise(plain)
    return F.concat(F.when((c < 0) | (c.cast("string").startswith("-")), "-").otherwise(""), out)


def decimal_text(c: Column) -> Column:
    """A decimal at the scale it remembers."""
    digits, s = F.abs(c["u"]).cast("string"), c["s"]
    padded = F.when(F.length(digits) <= s, F.lpad(digits, s + 1, F.lit("0"))).otherwise(digits)
    cut = F.length(padded) - s
    body = F.when(s == 0, digits).otherwise(F.concat(F.substring(padded, F.lit(1), cut), F.lit("."), F.substring(padded, cut + 1, F.length(padded))))
    return F.concat(F.when(c["u"] < 0, "-").otherwise(""), body)


def canonical(kind: str, c: Column) -> Column:
    if kind == "double":
        return double_text(c)
    if kind == "decimal":
        return decimal_text(c)
    if kind == "datetime":
        return F.replace(F.substring(c.cast("string"), 1, 19), F.lit(" "), F.lit("T"))  # a format would go through the session's zone
    if kind == "date":
        return c.cast("string")
    return c.cast("string")


def json_string(c: Column) -> Column:
    for plain, escaped in ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(escaped))
    for code in range(0x20):
        if chr(code) not in "\n\r\t\b\f":
            c = F.replace(c, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    return F.concat(F.lit('"'), c, F.lit('"'))


def json_value(t: Type, c: Column) -> Column:
    if t.sealed or t.kind == "string":
        out = json_string(c)
    elif t.kind in ("date", "datetime"):
        out = F.concat(F.lit('"'), canonical(t.kind, c), F.lit('"'))
    elif t.kind == "double":
        out = F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.raise_error(F.lit("json: unsupported value: not a finite number")).cast("string")).otherwise(double_text(c))
    else:
        out = canonical(t.kind, c)
    return F.coalesce(out, F.lit("null"))


def json_line(schema: Schema, column_of) -> Column:
    """One object per row, keys in the order of the schema."""
    parts = []
    for i, (name, t) in enumerate(schema.fields):
        parts += [F.lit(("," if i else "{") + f'"{name}":'), json_value(t, column_of(name))]
    return F.concat(*parts, F.lit("}")) if parts else F.lit("{}")
