"""Sources by format name: each builder gives a frame with provenance."""

from __future__ import annotations

import base64
import binascii
import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.coerce import coerce
from tidegate.functions.cutting import cut
from tidegate.lower import FAIL, FAIL_TYPE, FATAL, OFF, ORD, Frame, engine_settings, q
from tidegate.nodes import BuildFault, SourceDecl
from tidegate.types import Schema

Builder = Callable[[SparkSession, SourceDecl, Schema, str], Frame]
_BUILDERS: dict[str, Builder] = {}


def register(name: str):
    def keep(builder: Builder) -> Builder:
        _BUILDERS[name] = builder
        return builder

    return keep


def build(spark: SparkSession, decl: SourceDecl, schema: Schema, base: str = ".") -> Frame:
    from tidegate.sources import csv, table, xlsx  # noqa: F401  they register themselves

    builder = _BUILDERS.get(decl.format)
    if builder is None:
        raise BuildFault(f'no source format registered under "{decl.format}"')
    return builder(spark, decl, schema, base)


def resolve(base: str, path: str) -> str:
    return path if os.path.isabs(path) else os.path.join(base, path)


def positions(decl: SourceDecl, schema: Schema, header: list[str], what: str = "csv") -> dict[str, int | None]:
    """Field to column: alias, else the exact name, else absent if optional. A header written twice counts with its last place."""
    place = {h: i for i, h in enumerate(header) if h != ""}
    out: dict[str, int | None] = {}
    for name, t in schema.fields:
        at = place.get(decl.columns.get(name, name))
        if at is None and name in decl.columns:
            at = place.get(name)
        if at is None and not t.optional:
            raise BuildFault(f'{what}: required column "{decl.columns.get(name, name)}" not found in header {header}')
        out[name] = at
    return out


def seal_key(decl: SourceDecl, schema: Schema) -> bytes | None:
    """The 32-byte key of encrypted fields; not looked at where there are none."""
    if not any(t.sealed for _, t in schema.fields):
        return None
    if decl.key is None:
        raise BuildFault(f'source "{decl.name}": @deidentify needs key: env("NAME")')
    text = os.environ.get(decl.key, "")
    if not text:
        raise BuildFault(f'key: environment variable "{decl.key}" is not set')
    key = None
    for decode in (bytes.fromhex, lambda t: base64.b64decode(t, validate=True)):
        try:
            key = decode(text)
            break
        except (ValueError, binascii.Error):
            pass
    if key is None:
        raise BuildFault(f'key: "{decl.key}" is neither hex nor base64')
    if len(key) != 32:
        raise BuildFault(f'key: "{decl.key}" must be 32 bytes, got {len(key)}')
    return key


def from_cells(spark: SparkSession, decl: SourceDecl, schema: Schema, rows: DataFrame, place: dict[str, int | None], stage: str, *, fatal: bool = False) -> Frame:
    """Coerces (#ord, #off, cells, #fatal) under the schema; a row fails with its first bad cell in schema order."""
    key = seal_key(decl, schema)
    df = rows
    if key is not None:
        # the key is a column of a one-row table: literals are printed in plans, and a constant would be folded into one nonce
        df = df.crossJoin(F.broadcast(spark.createDataFrame([(bytearray(key),)], "`#key` binary")))
    with engine_settings(spark):
        values: list[Column] = []
        fails: list[Column] = [F.when(q(FATAL).isNotNull(), F.struct(q(FATAL).alias("reason"), F.lit(FATAL).alias("stage")))]
        names: dict[str, str] = {}
        for i, (name, t) in enumerate(schema.fields):
            raw = F.lit(None).cast("string") if place[name] is None else F.coalesce(F.get(q("cells"), F.lit(place[name])), F.lit(""))
            value, reason = coerce(t, raw, decl.formats.get(name))
            if place[name] is None:
                reason = F.lit(None).cast("string")
            fails.append(F.when(reason.isNotNull(), F.struct(reason.alias("reason"), F.lit(f"{stage}:{name}").alias("stage"))))
            if t.sealed:
                value = sealed(value, t, i)
            names[name] = f"s{i}"
            values.append(value.alias(f"s{i}"))
        df = df.select(q(ORD), q(OFF), F.coalesce(*fails).cast(FAIL_TYPE).alias(FAIL), *values)
    if key is not None:
        df = cut(df)  # encrypting again would give other texts
    return Frame(df, schema, names, decl.name, fatal=fatal)


def sealed(value: Column, t, i: int) -> Column:
    """Base64 of nonce, ciphertext and tag; the plain text is a presence byte and the canonical text."""
    from tidegate.sinks.render import canonical

    plain = F.when(value.isNull(), F.unhex(F.lit("00"))).otherwise(F.concat(F.unhex(F.lit("01")), F.encode(canonical(t.kind, value), "UTF-8")))
    # each field and row has an expression of its own, so that neither is computed once for several
    own = F.when(q(ORD) >= -1 - i, plain)
    return F.base64(F.aes_encrypt(own, q("#key"), F.lit("GCM")))
