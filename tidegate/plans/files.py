"""Queries over files in the shared folder: provenance, fatal records, workbooks, written lines, sealed cells, diagnostics and the command line."""

from __future__ import annotations

import contextlib
import io
import os
import uuid
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate import cli
from tidegate.builder import rows
from tidegate.functions.cutting import folder
from tidegate.lower import FAIL, OFF, ORD, q
from tidegate.nodes import FatalFault, TidegateError, col
from tidegate.plans import catalogue
from tidegate.run import execute, plan, run_text
from tidegate.sources import build
from tidegate.syntax import parse

QUERIES: dict[str, catalogue.Query] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def keep(f: catalogue.Query) -> catalogue.Query:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


def place(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one."""
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}".removeprefix("file://").removeprefix("file:")
    os.makedirs(path, exist_ok=True)
    return path


def one_file(spark: SparkSession, lines: DataFrame, header: str, name: str) -> str:
    """A header and the column ``line`` in order of ``at`` as one text file, written by one task."""
    path = f"{place(spark, name)}/text"
    head = spark.range(1).select(F.lit(header).alias("line"), F.lit(-1).cast("bigint").alias("at"))
    head.unionByName(lines.select("line", "at")).repartition(1).sortWithinPartitions("at").select("line").write.text(path)
    return next(os.path.join(path, f) for f in os.listdir(path) if f.startswith("part-"))


def source_frame(spark: SparkSession, text: str):
    """The frame of a program's source."""
    from tidegate.analyze import analyze

    checked = analyze(parse(text + '\nsink out = jsonl("unused")\npipeline main { in |> out }'))
    return build(spark, checked.source, checked.source_schema)


@query("""with r as (select rec_id, coalesce(full_name, '') as full_name, replace(coalesce(internal_notes, ''), chr(13), '') as note, row_number() over (order by rec_id) - 1 as ordinal from customer_export),
l as (select *, 1 + length(full_name || note) - length(replace(full_name || note, chr(10), '')) + case when rec_id % 7 = 0 then 1 else 0 end as n from r)
select ordinal, cast(2 + coalesce(sum(n) over (order by rec_id rows between unbounded preceding and 1 preceding), 0) as bigint) as "offset", rec_id, full_name, note from l""")
def csv_provenance(spark, d):
    """Ordinals and line numbers of records with quotes, line breaks and blank lines between them."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    df = spark.read.parquet(f"{d}/customer_export.parquet").select("rec_id", F.coalesce("full_name", F.lit("")).alias("full_name"), F.replace(F.coalesce("internal_notes", F.lit("")), F.lit("\r"), F.lit("")).alias("note"))
    line = F.concat_ws(",", F.col("rec_id").cast("string"), quoted(F.col("full_name")), quoted(F.col("note")))
    path = one_file(spark, df.select(F.when(F.col("rec_id") % 7 == 0, F.concat(line, F.lit("\n"))).otherwise(line).alias("line"), F.col("rec_id").alias("at")), "rec_id,full_name,note", "provenance")
    f = source_frame(spark, f'source in = csv("{path}", schema: {{ rec_id: int, full_name: string, note: string }})')
    return f.df.where(f.healthy).select(q(ORD).alias("ordinal"), q(OFF).alias("offset"), *(f.user(n).alias(n) for n in ("rec_id", "full_name", "note")))


@query("select o_orderkey from (select o_orderkey, row_number() over (order by o_orderkey) as rn from orders) where rn <= 1000")
def csv_fatal_prefix(spark, d):
    """A record with a cell too many ends the run whatever the policy; what was read before it is written."""
    keys = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey").withColumnRenamed("o_orderkey", "at")
    stop = keys.orderBy("at").limit(1001).agg(F.max("at").alias("stop"))
    lines = keys.crossJoin(F.broadcast(stop)).select("at", F.concat(F.col("at").cast("string"), F.when(F.col("at") == F.col("stop"), ",x,y").otherwise(",x")).alias("line"))  # one row
    path = one_file(spark, lines, "o_orderkey,x", "fatal")
    low = plan(spark, parse(f'on error skip\nsource in = csv("{path}", schema: {{ o_orderkey: int, x: string }})\nsink out = jsonl("unused")\npipeline main {{ in |> drop(x) |> out }}'))
    written = {}
    with contextlib.suppress(FatalFault):
        execute(low, low.checked, {"out": lambda df: written.update(out=df)})
        raise AssertionError("the broken record was not noticed")
    return written["out"].select(F.get_json_object("line", "$.o_orderkey").cast("bigint").alias("o_orderkey"))


def workbook(path: str, lines: list[tuple[int, list[str]]], sheet: str) -> None:
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    cell = lambda n, i, v: f'<c r="{chr(65 + i)}{n}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>'
    body = "".join(f'<row r="{n}">{"".join(cell(n, i, v) for i, v in enumerate(cells) if v)}</row>' for n, cells in lines)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="{sheet}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')


@query("""with r as (select nickname, given_name, length(nickname) as n, row_number() over (order by nickname, given_name) - 1 as ordinal from nicknames)
select ordinal, 3 + ordinal + ordinal // 4 as "offset", nickname, case when n <> 4 then given_name end as given_name, case when n <> 4 then n end as n, case when n = 4 then 'cannot parse "four" as int' end as reason, case when n = 4 then 'xlsx:n' end as stage from r""")
def xlsx_provenance(spark, d):
    """A workbook with a title, a header below it and a blank row after every fourth: sheet rows, ordinals and failures of cells."""
    names = sorted(tuple(r) for r in spark.read.parquet(f"{d}/nicknames.parquet").select("nickname", "given_name").collect())  # a fixed table of about 90 rows
    lines = [(1, ["names"]), (2, ["nickname", "given_name", "n"])]
    lines += [(3 + i + i // 4, [a, b, "four" if len(a) == 4 else str(len(a))]) for i, (a, b) in enumerate(names)]
    path = f"{place(spark, 'book')}/names.xlsx"
    workbook(path, lines, "Names")
    f = source_frame(spark, f'source in = xlsx("{path}", sheet: "Names", header_row: 2, schema: {{ nickname: string, given_name: string, n: int }})')
    kept = lambda n: F.when(f.healthy, f.user(n)).alias(n)
    return f.df.select(q(ORD).alias("ordinal"), q(OFF).alias("offset"), f.user("nickname").alias("nickname"), kept("given_name"), kept("n"), q(FAIL)["reason"].alias("reason"), q(FAIL)["stage"].alias("stage"))


@query("""with a as (select l_orderkey, l_linenumber, cast(cast(l_extendedprice as decimal(15,2)) * 100 as hugeint) as p, cast(cast(l_quantity as decimal(15,2)) * 100 as hugeint) as n from lineitem),
b as (select *, (2 * p * 10000000000000000::hugeint + n) // (2 * n) as r from a)
select l_orderkey, l_linenumber, cast(r // 10000000000000000::hugeint as varchar) || '.' || lpad(cast(r % 10000000000000000::hugeint as varchar), 16, '0') as unit from b""")
def decimal_div(spark, d):
    """Quotients of decimals: sixteen places, halves away from zero."""
    df = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("decimal(15,2)").alias("price"), F.col("l_quantity").cast("decimal(15,2)").alias("n"))
    return rows(df, "l_orderkey: int, l_linenumber: int, price: decimal, n: decimal").map(spread=False, l_orderkey=col("l_orderkey"), l_linenumber=col("l_linenumber"), unit=col("price") / col("n")).frame()


@query("select o_orderkey, cast(o_custkey as varchar) as o_custkey, strftime(o_orderdate, '%Y-%m-%d') as o_orderdate, case when o_orderstatus = 'P' then null else o_orderpriority end as o_orderpriority from orders")
def deidentify_opened(spark, d):
    """Sealed whole numbers, dates, texts and absent cells of all orders, opened again with the key."""
    from tidegate.analyze import source_schema
    from tidegate.builder import fields
    from tidegate.lower import FATAL
    from tidegate.nodes import SourceDecl
    from tidegate.sources import from_cells

    key = "5a" * 32
    os.environ["TIDEGATE_OPEN_KEY"] = key
    decl = SourceDecl("in", "cells", "", fields("o_orderkey: int, o_custkey: int @deidentify, o_orderdate: date @deidentify, o_orderpriority: string? @deidentify"), key="TIDEGATE_OPEN_KEY")
    schema = source_schema(decl)
    cells = F.array(F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderpriority")))
    df = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias(ORD), F.col("o_orderkey").alias(OFF), cells.alias("cells"), F.lit(None).cast("string").alias(FATAL))
    f = from_cells(spark, decl, schema, df, {n: i for i, n in enumerate(schema.names)}, "csv")
    plain = lambda n: F.aes_decrypt(F.unbase64(f.user(n)), F.unhex(F.lit(key)), F.lit("GCM"))
    opened = lambda n: F.when(F.substring(F.hex(plain(n)), 1, 2) == "01", F.decode(F.substring(plain(n), F.lit(2), F.octet_length(plain(n))), "UTF-8")).alias(n)
    return f.df.where(f.healthy).select(f.user("o_orderkey").alias("o_orderkey"), *map(opened, ("o_custkey", "o_orderdate", "o_orderpriority")))


_ESCAPED = "coalesce(full_name, '')"
for _from, _to in (("\\", "\\\\"), ('"', '\\"'), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r"), ("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026"), (" ", "\\u2028"), (" ", "\\u2029")):
    _ESCAPED = f"replace({_ESCAPED}, chr({ord(_from)}), '{_to}')"


@query(f"""select '{{"rec_id":' || rec_id || ',"full_name":"' || {_ESCAPED} || '","paid":' || (coalesce(plan, '') <> 'free') || '}}' as line from customer_export""")
def jsonl_written(spark, d):
    """The file that the jsonl sink writes, read as plain lines."""
    base = place(spark, "lines")
    run_text(spark, f"""
source in = parquet("{d}/customer_export.parquet", schema: {{ rec_id: int, full_name: string?, plan: string? }})
sink out = jsonl("out.jsonl")
pipeline main {{ in |> map({{ rec_id: .rec_id, full_name: .full_name ?? "", paid: (.plan ?? "") != "free" }}) |> out }}""", base)
    return spark.read.option("lineSep", "\n").text(f"{base}/out.jsonl").select(F.col("value").alias("line"))


@query("""select 0 as n, '=== out ===' as line union all select row_number() over (order by n_nationkey), '{"n_nationkey":' || n_nationkey || ',"name":"' || lower(n_name) || '"}' from nation""")
def console_lines(spark, d):
    """What a program prints with --print."""
    with contextlib.redirect_stdout(io.StringIO()) as out:
        run_text(spark, f'source in = parquet("{d}/nation.parquet", order_by: "n_nationkey", schema: {{ n_nationkey: int, n_name: string }})\nsink out = jsonl("never")\npipeline main {{ in |> map({{ n_nationkey: .n_nationkey, name: lower(.n_name) }}) |> out }}', to_console=True)
    return spark.createDataFrame(list(enumerate(out.getvalue().splitlines())), "n long, line string")


_PROGRAM = """on error |> bad
source in = csv("hulls.csv", schema: { hull: string, tons: int?, master: string @pii, seal: date @deidentify }, key: env("K"))
sink heavy = jsonl("heavy.jsonl")
sink light = jsonl("light.jsonl")
sink bad = jsonl("bad.jsonl")
pipeline least(n: int) = filter((.tons ?? 0) >= n)
pipeline main { in |> least(5) |> mask(master) |> map({ ...row, tons: .tons ?? 0 }) |> route { .tons > 500 => heavy, else => light } }"""

_SHOWN = [
    "ast: source in = csv(\"hulls.csv\", schema: { hull: string, tons: int?, master: string @pii, seal: date @deidentify })",
    "ast: sink heavy = jsonl(\"heavy.jsonl\")",
    "ast: sink light = jsonl(\"light.jsonl\")",
    "ast: sink bad = jsonl(\"bad.jsonl\")",
    "ast: pipeline least:",
    "ast:   filter(((.tons ?? 0) >= n))",
    "ast: pipeline main:",
    "ast:   in",
    "ast:   least(5)",
    "ast:   mask(master)",
    "ast:   map({ ...row, tons: (.tons ?? 0) })",
    "ast:   route { (.tons > 500) => heavy, else => light }",
    "schema: source in: {hull: string, tons: int?, master: string @pii, seal: deidentified<date>}",
    "schema: sink heavy: {hull: string, tons: int, master: string, seal: deidentified<date>}",
    "schema: sink light: {hull: string, tons: int, master: string, seal: deidentified<date>}",
]


def _values(lines: list[str]) -> str:
    return "select * from (values " + ", ".join(f"({i}, '{x.replace(chr(39), chr(39) * 2)}')" for i, x in enumerate(lines)) + ") t(n, line)"


@query(_values(_SHOWN))
def emitted_forms(spark, d):
    """--emit-ast and --emit-schema of a program with every kind of declaration."""
    path = f"{place(spark, 'program')}/p.tg"
    with open(path, "w", encoding="utf-8") as f:
        f.write(_PROGRAM)
    lines = []
    for verb in ("ast", "schema"):
        with contextlib.redirect_stdout(io.StringIO()) as out:
            assert cli.main([f"--emit-{verb}", path]) == 0
        lines += [f"{verb}: {x}" for x in out.getvalue().splitlines()]
    return spark.createDataFrame(list(enumerate(lines)), "n long, line string")


_S, _K = 'source in = csv("a.csv", schema: { a: int, s: string @pii, o: int? })\n', 'sink out = jsonl("o.jsonl")\n'
#: Programs that are refused, and why.
_REFUSED = {
    _S + _K + "pipeline top(c) = select(c) |> drop(c)\npipeline main { in |> top(a) |> out }": 'drop leaves no columns\n  in segment top(c = a)\n  instantiated at 4:23',
    _S + _K + "pipeline f(x, x) = select(x)\npipeline main { in |> f(a, a) |> out }": 'duplicate parameter "x"',
    _S + _K + "pipeline filter = select(a)\npipeline main { in |> out }": '"filter" is a built-in stage name',
    "on error skip\non error abort\n" + _S + _K + "pipeline main { in |> select(a) |> out }": "duplicate error policy declaration",
    _S + _K + "pipeline main { in |> select(s) |> out }": 'field "s" (string @pii) reaches sink "out" unmasked @pii: use mask, hash or redact, or drop it',
    _S + _K + "pipeline main { in |> select(o) |> out }": 'field "o" (int?) reaches sink "out" still optional: use ?? to give a default',
    "on error |> out\n" + _S + _K + "pipeline main { in |> select(a) |> out }": 'error sink "out" is also written by the pipeline',
    _S.replace("csv", "yaml") + _K + "pipeline main { in |> select(a) |> out }": 'no source format registered under "yaml"',
    _S.replace(" }", ", d: int @deidentify }") + _K + "pipeline main { in |> select(a) |> out }": 'source "in": @deidentify needs key: env("NAME")',
    _S.replace("csv(\"a.csv\"", 'xlsx("a.xlsx", header_row: "x"') + _K + "pipeline main { in |> select(a) |> out }": "xlsx: header_row must be int, got string",
}


@query(_values([x.replace("\n", " | ") for x in _REFUSED.values()]))
def refused_programs(spark, d):
    """The diagnostics of declarations, segments, tags, policies, formats and keys."""
    lines = []
    base = place(spark, "refused")
    with open(f"{base}/a.csv", "w", encoding="utf-8") as f:
        f.write("a,s,o,d\n1,x,2,3\n")
    for text in _REFUSED:
        try:
            run_text(spark, text, base)
            lines.append("accepted")
        except TidegateError as e:
            lines.append(str(e).replace("\n", " | "))
    return spark.createDataFrame(list(enumerate(lines)), "n long, line string")
