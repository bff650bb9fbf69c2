"""Cells of text to typed values, as column expressions: the value, and null where the cell does not parse."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegate.nodes import BuildFault
from tidegate.types import SPARK, Type

# The pieces of a layout, longest first, and their patterns.
PIECES = (("January", "MMMM"), ("Monday", "EEEE"), ("2006", "yyyy"), ("Z07:00:00", "XXXXX"), ("-07:00:00", "xxxxx"), ("Z07:00", "XXX"), ("-07:00", "xxx"), ("Z0700", "XX"), ("-0700", "xx"), ("Z07", "X"), ("-07", "x"), ("MST", "z"), ("002", "DDD"), ("_2", "[ ]d"), ("Jan", "MMM"), ("Mon", "EEE"), ("01", "MM"), ("02", "dd"), ("03", "hh"), ("04", "mm"), ("05", "ss"), ("06", "yy"), ("15", "HH"), ("PM", "a"), ("pm", "a"), ("1", "M"), ("2", "d"), ("3", "h"), ("4", "m"), ("5", "s"))
LAYOUTS = {"date": "2006-01-02", "datetime": "2006-01-02T15:04:05"}
TRUE, FALSE = ("1", "t", "T", "TRUE", "true", "True"), ("0", "f", "F", "FALSE", "false", "False")
BLANK = r"\A[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+|[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+\z"


def trim_blank(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, BLANK, "")


def layout_pattern(layout: str) -> tuple[str, str]:
    """(datetime pattern, guard expression) of a layout written as the reference moment."""
    out, guard, at = "", "", 0
    shapes = {"yyyy": "[0-9]{4}", "yy": "[0-9]{2}", "MM": "[0-9]{2}", "dd": "[0-9]{2}", "hh": "[0-9]{2}", "HH": "[0-9]{2}", "mm": "[0-9]{2}", "ss": "[0-9]{2}", "M": "[0-9]{1,2}", "d": "[0-9]{1,2}", "h": "[0-9]{1,2}", "m": "[0-9]{1,2}", "s": "[0-9]{1,2}", "a": "[APap][Mm]", "DDD": "[0-9]{3}", "[ ]d": " ?[0-9]{1,2}", "z": "[A-Z]{3,4}"}
    signs = r"[+\-][0-9]{2}"
    shapes |= {"XXXXX": f"(?:Z|{signs}:[0-9]{{2}}:[0-9]{{2}})", "xxxxx": f"{signs}:[0-9]{{2}}:[0-9]{{2}}", "XXX": f"(?:Z|{signs}:[0-9]{{2}})", "xxx": f"{signs}:[0-9]{{2}}", "XX": f"(?:Z|{signs}[0-9]{{2}})", "xx": f"{signs}[0-9]{{2}}", "X": f"(?:Z|{signs})", "x": signs}
    while at < len(layout):
        fraction = re.match(r"[.,](0+|9+)", layout[at:])
        if fraction:
            n = len(fraction[1])
            out += f"'{fraction[0][0]}'" + "S" * n
            guard += re.escape(fraction[0][0]) + f"[0-9]{{{n}}}"
            at += len(fraction[0])
            continue
        piece = next(((p, j) for p, j in PIECES if layout.startswith(p, at)), None)
        if piece:
            out, guard = out + piece[1], guard + shapes.get(piece[1], r"\p{L}+")
            at += len(piece[0])
        elif layout[at].isdigit():
            raise BuildFault(f'unknown piece in layout "{layout}" at "{layout[at:]}"')
        else:
            c = layout[at]
            out += "''" if c == "'" else f"'{c}'" if c.isalpha() else c
            guard += re.escape(c)
            at += 1
    return out, rf"\A{guard}\z"


def decimal_literal(text: str) -> tuple[int, int]:
    """(unscaled, scale) of a literal by its shortest form."""
    value = repr(float(text)) if "." in text else text
    if value.endswith(".0"):
        value = value[:-2]
    whole, _, frac = value.partition(".")
    return int(whole + frac), len(frac)


def _decimal(raw: Column) -> Column:
    """Thousands commas before the last point are dropped; one behind it leaves the cell unreadable."""
    point = F.length(raw) - F.instr(F.reverse(raw), ".")
    plain = F.when(F.instr(raw, ".") == 0, F.replace(raw, F.lit(","), F.lit(""))).otherwise(F.concat(F.replace(F.substring(raw, F.lit(1), point), F.lit(","), F.lit("")), F.substring(raw, point + 1, F.length(raw))))
    form = r"\A([+-]?)([0-9]*)\.?([0-9]*)(?:[eE]([+-]?[0-9]{1,3}))?\z"
    ok = plain.rlike(r"\A[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]{1,3})?\z")
    part = lambda i: F.regexp_extract(plain, form, i)
    scale = F.length(part(3)) - F.coalesce(part(4).try_cast("int"), F.lit(0))
    unscaled = F.concat(part(1), part(2), part(3), F.repeat(F.lit("0"), F.greatest(-scale, F.lit(0)))).try_cast("decimal(38,0)")
    return F.when(ok & unscaled.isNotNull(), F.struct(unscaled.alias("u"), F.greatest(scale, F.lit(0)).cast("int").alias("s")))


def _hex_double(raw: Column) -> Column:
    """A number with hexadecimal digits and a binary exponent, as 0x1.8p-3; up to 15 digits are exact, more are unreadable."""
    form = r"\A([+-]?)0[xX]0*([0-9a-fA-F]*)\.?([0-9a-fA-F]*)[pP]([+-]?[0-9]{1,4})\z"
    part = lambda i: F.regexp_extract(raw, form, i)
    digits = F.concat(part(2), part(3))
    value = F.conv(digits, 16, 10).cast("double") * F.pow(F.lit(2.0), part(4).try_cast("int") - F.length(part(3)) * 4)
    signed = F.when(part(1) == "-", -value).otherwise(value)
    ok = raw.rlike(r"\A[+-]?0[xX](?:[0-9a-fA-F]+\.?[0-9a-fA-F]*|\.[0-9a-fA-F]+)[pP][+-]?[0-9]{1,4}\z") & (F.length(digits) <= 15)
    return F.when(ok & (F.length(digits) == 0), F.lit(0.0)).when(ok & (F.abs(signed) < float("inf")), signed)


def parse_cell(kind: str, raw: Column, layout: str | None = None) -> Column:
    """The value of a cell, null if it does not parse."""
    if kind == "string":
        return raw
    if kind == "int":
        return F.when(raw.rlike(r"\A[+-]?[0-9]+\z"), raw.try_cast("bigint"))
    if kind == "double":
        number = raw.rlike(r"\A[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z")
        word = F.lower(raw)
        value = raw.try_cast("double")
        finite = (value < float("inf")) & (value > float("-inf"))
        return F.when(number & finite, value).when(raw.contains("x") | raw.contains("X"), _hex_double(raw)).when(word.isin("nan"), F.lit(float("nan"))).when(word.isin("inf", "+inf", "infinity", "+infinity"), F.lit(float("inf"))).when(word.isin("-inf", "-infinity"), F.lit(float("-inf")))
    if kind == "bool":
        return F.when(raw.isin(*TRUE), True).when(raw.isin(*FALSE), False)
    if kind == "decimal":
        return _decimal(raw)
    pattern, guard = layout_pattern(layout or LAYOUTS[kind])
    moment = F.when(raw.rlike(guard), F.try_to_timestamp(raw, F.lit(pattern)))
    return moment.cast("date") if kind == "date" else moment.cast("timestamp_ntz")


def coerce(t: Type, raw: Column, layout: str | None = None) -> tuple[Column, Column]:
    """(value, reason of failure or null). A blank cell of an optional field is absent."""
    value = parse_cell(t.kind, raw, layout)
    if t.kind == "string" and not t.optional:
        return value, F.lit(None).cast("string")
    blank = trim_blank(raw) == ""
    # the raw cell of personal data is never part of a reason
    reason = F.lit(f"cannot parse cell as {t.kind}") if t.pii or t.sealed else F.concat(F.lit("cannot parse "), quoted(raw), F.lit(f" as {t.kind}"))
    bad = value.isNull() & (raw.isNotNull() if t.optional else F.lit(True))
    if t.optional:
        value, bad = F.when(~blank, value), bad & ~blank
    return value.cast(SPARK[t.kind]), F.when(bad, F.coalesce(reason, F.lit(f'cannot parse "" as {t.kind}')))


def quoted(raw: Column) -> Column:
    out = F.replace(raw, F.lit("\\"), F.lit("\\\\"))
    for c, e in (('"', '\\"'), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        out = F.replace(out, F.lit(c), F.lit(e))
    return F.concat(F.lit('"'), out, F.lit('"'))
