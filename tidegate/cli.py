"""Command line: run FILE [--print] | --emit-ast FILE | --emit-schema FILE."""

from __future__ import annotations

import sys

from tidegate.analyze import analyze
from tidegate.nodes import Binary, Call, Expr, Field, Literal, Name, Program, Record, Stage, TidegateError
from tidegate.syntax import parse

USAGE = "usage: tidegate run <file> [--print] | tidegate --emit-ast <file> | tidegate --emit-schema <file>"


def show(e: Expr) -> str:
    if isinstance(e, Field):
        return f".{e.name}"
    if isinstance(e, Name):
        return e.name
    if isinstance(e, Literal):
        return {"string": lambda: '"' + str(e.value).replace("\\", "\\\\").replace('"', '\\"') + '"', "bool": lambda: str(e.value).lower()}.get(e.kind, lambda: e.text or str(e.value))()
    if isinstance(e, Binary):
        return f"({show(e.left)} {e.op} {show(e.right)})"
    if isinstance(e, Call):
        return f"{e.function}({', '.join(map(show, e.args))})"
    assert isinstance(e, Record)
    return "{ " + ", ".join([f"...{e.spread}"] * bool(e.spread) + [f"{k}: {show(v)}" for k, v in e.items]) + " }"


def show_stage(s: Stage) -> str:
    if s.op == "ref":
        return s.args[0]
    if s.op == "route":
        return "route { " + ", ".join(f"{'else' if b.when is None else show(b.when)} => {b.sink or 'discard'}" for b in s.args) + " }"
    name, args = (s.args[0], s.args[1:]) if s.op == "call" else (s.op, s.args)
    text = [f"{a[0]}: {a[1]}" if isinstance(a, tuple) else show(a) if isinstance(a, Expr) else f'"{a}"' if s.op == "check" else str(a) for a in args]
    return f"{name}({', '.join(text)})"


def show_program(p: Program) -> str:
    out = []
    for s in p.sources:
        fields = ", ".join(f"{f.name}: {f.kind}{'?' * f.optional}{' @pii' * f.pii}{' @deidentify' * f.sealed}" for f in s.schema)
        out.append(f'source {s.name} = {s.format}("{s.path}", schema: {{ {fields} }}{"".join(f", {k}: {show(v)}" for k, v in s.options.items())})')
    out += [f'sink {s.name} = {s.format}("{s.path}")' for s in p.sinks]
    for x in p.pipelines:
        out += [f"pipeline {x.name}:", *(f"  {show_stage(s)}" for s in x.body)]
    return "\n".join(out)


def show_schema(p: Program) -> str:
    c = analyze(p)
    return "\n".join([f"source {c.source.name}: {c.source_schema}", *(f"sink {s.name}: {c.schema}" for s in c.sinks)])


def main(argv: list[str] | None = None) -> int:
    args = list(sys.argv[1:] if argv is None else argv)
    to_console = "--print" in args
    args = [a for a in args if a != "--print"]
    if len(args) != 2 or args[0] not in ("run", "--emit-ast", "--emit-schema"):
        print(USAGE, file=sys.stderr)
        return 2
    verb, path = args
    try:
        if verb == "run":
            from pyspark.sql import SparkSession

            from tidegate.run import run_file

            run_file(SparkSession.builder.appName("tidegate").getOrCreate(), path, to_console=to_console)
        else:
            with open(path, encoding="utf-8") as f:
                program = parse(f.read())
            print(show_program(program) if verb == "--emit-ast" else show_schema(program))
    except (TidegateError, OSError) as e:
        pos = getattr(e, "pos", None)
        print(f"{path}:{pos[0]}:{pos[1]}: error: {e}" if pos else f"{path}: error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
