"""Sinks by format name: each gets a DataFrame of (#ord, line) that is already in JSON form."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame

from tidegate.lower import ORD, q
from tidegate.nodes import BuildFault

Writer = Callable[[DataFrame], None]
_OPENERS: dict[str, Callable[[str, str], Writer]] = {}


def register(name: str):
    def keep(opener):
        _OPENERS[name] = opener
        return opener

    return keep


def open_sink(format_: str, name: str, path: str) -> Writer:
    """Opens (and empties) a sink; the result writes its rows."""
    if format_ not in _OPENERS:
        raise BuildFault(f'no sink format registered under "{format_}"')
    return _OPENERS[format_](name, path)


def in_order(df: DataFrame) -> DataFrame:
    """The lines in row order; rows without an order come as the source gives them."""
    return (df.orderBy(q(ORD)) if ORD in df.columns else df).select("line")


@register("jsonl")
def jsonl(name: str, path: str) -> Writer:
    """One file in row order, streamed partition by partition; a path that ends in a slash is a folder written in parallel, its files in row order."""
    if path.endswith("/"):
        return lambda df: in_order(df).write.mode("overwrite").text(path)
    try:
        open(path, "w").close()
    except OSError as e:
        raise BuildFault(f'jsonl: cannot create "{path}": {e}') from e

    def write(df: DataFrame) -> None:
        with open(path, "w", encoding="utf-8", newline="") as f:
            for r in in_order(df).toLocalIterator(prefetchPartitions=True):
                f.write(r.line + "\n")

    return write


@register("console")
def console(name: str, path: str) -> Writer:
    """Prints a heading and the lines when the run ends."""

    def write(df: DataFrame) -> None:
        print(f"=== {name} ===")
        for r in in_order(df).toLocalIterator(prefetchPartitions=True):
            print(r.line)
        sys.stdout.flush()

    return write


@register("parquet")
def parquet(name: str, path: str) -> Writer:
    """The lines as a Parquet folder (an addition for large outputs)."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    return lambda df: df.select("line").write.mode("overwrite").parquet(path)
