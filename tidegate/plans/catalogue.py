"""One query per operator of row pipelines, over whole driver tables, each with its SQL."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.builder import Rows, plain, rows
from tidegate.functions.cutting import folder
from tidegate.nodes import RowFault, col, hash_, lower, mask, redact, trim, upper
from tidegate.plans.problems import _RECORDS
from tidegate.run import execute, plan
from tidegate.syntax import parse

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

ORDERS = "o_orderkey: int, o_custkey: int, o_orderstatus: string, o_totalprice: double, o_orderdate: datetime, o_orderpriority: string"
CUSTOMER = "c_custkey: int, c_name: string @pii, c_nationkey: int, c_acctbal: double, c_mktsegment: string"
LINEITEM = "l_orderkey: int, l_partkey: int, l_suppkey: int, l_linenumber: int, l_quantity: double, l_extendedprice: double, l_discount: double, l_tax: double, l_returnflag: string, l_linestatus: string"
EVENTS = "event_id: int, user_id: int, event_type: string, value: double, props: string"


def query(sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def orders(spark: SparkSession, d: str, **kw) -> Rows:
    return rows(spark.read.parquet(f"{d}/orders.parquet"), ORDERS, **kw)


def customer(spark: SparkSession, d: str, **kw) -> Rows:
    return rows(spark.read.parquet(f"{d}/customer.parquet"), CUSTOMER, **kw)


def lineitem(spark: SparkSession, d: str) -> Rows:
    return rows(spark.read.parquet(f"{d}/lineitem.parquet"), LINEITEM)


def events(spark: SparkSession, d: str, **kw) -> Rows:
    return rows(spark.read.parquet(f"{d}/events.parquet"), EVENTS, **kw)


# -- filter, projection
@query("select o_orderkey, o_totalprice, o_orderstatus from orders where o_totalprice > 100000.0 and o_orderstatus = 'F'")
def filter_and(spark, d):
    return orders(spark, d).filter((col("o_totalprice") > 100000.0) & col("o_orderstatus").eq("F")).select("o_orderkey", "o_totalprice", "o_orderstatus").frame()


@query("select o_orderkey, o_orderpriority from orders where o_orderstatus <> 'F' or o_totalprice <= 50000.0")
def filter_or_ne(spark, d):
    return orders(spark, d).filter(col("o_orderstatus").ne("F") | (col("o_totalprice") <= 50000.0)).select("o_orderkey", "o_orderpriority").frame()


@query("select o_orderkey, o_custkey, lower(o_orderstatus) as o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, o_totalprice >= 100000.0 as big from orders")
def map_spread_override(spark, d):
    return orders(spark, d).map(o_orderstatus=lower(col("o_orderstatus")), big=col("o_totalprice") >= 100000.0).frame()


@query("select c_custkey as id, c_acctbal + 1.5 as more from customer")
def map_no_spread(spark, d):
    return customer(spark, d).map(spread=False, id=col("c_custkey"), more=col("c_acctbal") + 1.5).frame()


@query("select l_partkey as l_orderkey, l_orderkey as l_partkey, l_linenumber from lineitem")
def map_reads_input_row(spark, d):
    return lineitem(spark, d).select("l_orderkey", "l_partkey", "l_linenumber").map(l_orderkey=col("l_partkey"), l_partkey=col("l_orderkey")).frame()


@query("select l_tax, l_orderkey, l_returnflag from lineitem")
def select_reorder(spark, d):
    return lineitem(spark, d).select("l_tax", "l_orderkey", "l_returnflag").frame()


@query("select c_custkey, c_nationkey, c_acctbal, c_mktsegment from customer")
def drop_cols(spark, d):
    return customer(spark, d).drop("c_name").frame()


@query("select o_orderkey as o_custkey, o_custkey as o_orderkey, o_orderstatus as status from orders")
def rename_swap(spark, d):
    return orders(spark, d).select("o_orderkey", "o_custkey", "o_orderstatus").rename(o_orderkey="o_custkey", o_custkey="o_orderkey", o_orderstatus="status").frame()


# -- positional stages
@query("select o_orderkey, o_totalprice from orders order by o_orderkey limit 100")
def limit_first(spark, d):
    return orders(spark, d, order_by="o_orderkey").limit(100).select("o_orderkey", "o_totalprice").frame()


@query("select o_orderkey, o_totalprice from orders order by o_orderkey offset 100")
def offset_rest(spark, d):
    return orders(spark, d, order_by="o_orderkey").offset(100).select("o_orderkey", "o_totalprice").frame()


@query("select event_id, value from events order by event_id limit 50 offset 20")
def page(spark, d):
    return events(spark, d, order_by="event_id").offset(20).limit(50).select("event_id", "value").frame()


@query("select o_orderkey from (select o_orderkey, row_number() over (order by o_orderkey) as rn from orders where o_orderstatus = 'O') where rn > 5 and rn <= 45")
def page_after_filter(spark, d):
    return orders(spark, d, order_by="o_orderkey").filter(col("o_orderstatus").eq("O")).offset(5).limit(40).select("o_orderkey").frame()


@query("select o_orderkey from (select *, row_number() over (order by o_orderkey) as rn from orders) where rn <= 500 and o_totalprice > 50000.0")
def limit_counts_failed(spark, d):
    return orders(spark, d, order_by="o_orderkey").check(col("o_totalprice") > 50000.0, "cheap").on_error("skip").limit(500).select("o_orderkey").frame()


# -- declassifying stages and functions
@query("select c_custkey, repeat('*', strlen(c_name)) as c_name from customer")
def mask_stage(spark, d):
    return customer(spark, d).mask("c_name").select("c_custkey", "c_name").frame()


@query("select doc_id, repeat('*', strlen(coalesce(text, 'none'))) as text from documents")
def mask_fn_utf8(spark, d):
    docs = rows(spark.read.parquet(f"{d}/documents.parquet"), "doc_id: int, text: string? @pii")
    return docs.map(text=mask(col("text").default("none"))).frame()


@query("select c_custkey, sha256(c_name) as c_name from customer")
def hash_stage(spark, d):
    return customer(spark, d).hash("c_name").select("c_custkey", "c_name").frame()


@query("select c_custkey, sha256(c_name) as digest, '[REDACTED]' as c_name from customer")
def hash_redact_fn(spark, d):
    return customer(spark, d).map(spread=False, c_custkey=col("c_custkey"), digest=hash_(col("c_name")), c_name=redact(col("c_name"))).frame()


@query("select c_custkey, '[REDACTED]' as c_name from customer")
def redact_stage(spark, d):
    return customer(spark, d).redact("c_name").select("c_custkey", "c_name").frame()


# -- failures and policies
@query("select o_orderkey, o_totalprice from orders where o_totalprice > 50000.0")
def check_skip(spark, d):
    return orders(spark, d).check(col("o_totalprice") > 50000.0, "cheap").on_error("skip").select("o_orderkey", "o_totalprice").frame()


@query("""select 'in' as source, rn - 1 as ordinal, rn - 1 as "offset", case when o_totalprice <= 50000.0 then 'cheap' else 'finished' end as reason, 'check' as stage
from (select *, row_number() over (order by o_orderkey) as rn from orders) where o_totalprice <= 50000.0 or o_orderstatus = 'F'""")
def check_route_envelope(spark, d):
    return orders(spark, d, order_by="o_orderkey").check(col("o_totalprice") > 50000.0, "cheap").check(col("o_orderstatus").ne("F"), "finished").errors()


@query("select o_orderkey from orders where o_orderkey < (select min(o_orderkey) from orders where o_totalprice < 2000.0) or not exists (select 1 from orders where o_totalprice < 2000.0)")
def check_abort_prefix(spark, d):
    """What the engine writes before it aborts at the first failed row."""
    low = orders(spark, d, order_by="o_orderkey").check(col("o_totalprice") >= 2000.0, "tiny").select("o_orderkey").lowered()
    written = {}
    try:
        execute(low, low.checked, {"out": lambda df: written.update(out=df)})
    except RowFault:
        pass
    return written["out"].select(F.get_json_object("line", "$.o_orderkey").cast("bigint").alias("o_orderkey"))


# -- terminals
@query("select o_orderkey, case when o_orderstatus = 'F' then 'finished' when o_totalprice > 150000.0 then 'large' else 'rest' end as target from orders")
def route_first_match(spark, d):
    low = orders(spark, d).select("o_orderkey", "o_orderstatus", "o_totalprice").route(finished=col("o_orderstatus").eq("F"), large=col("o_totalprice") > 150000.0, rest=None)
    return low.routed().select("o_orderkey", "target")


@query("select o_orderkey from orders where o_orderstatus = 'P'")
def route_discard(spark, d):
    return plain(orders(spark, d).select("o_orderkey", "o_orderstatus").route(kept=col("o_orderstatus").eq("P"), discard=None), "kept").select("o_orderkey")


@query("select case when o_orderstatus = 'F' then 'a' when o_orderstatus = 'O' then 'b' else 'c' end as target, count(*) as n from orders group by 1")
def route_conservation(spark, d):
    low = orders(spark, d).select("o_orderkey", "o_orderstatus").route(a=col("o_orderstatus").eq("F"), b=col("o_orderstatus").eq("O"), c=None)
    return low.routed().groupBy("target").agg(F.count(F.lit(1)).alias("n"))


@query("select 'audit' as sink, c_custkey from customer where c_acctbal > 0.0 union all select 'warehouse', c_custkey from customer where c_acctbal > 0.0")
def broadcast_both(spark, d):
    low = customer(spark, d).filter(col("c_acctbal") > 0.0).select("c_custkey").lowered(sinks=("warehouse", "audit"))
    return plain(low, "warehouse").select(F.lit("warehouse").alias("sink"), "c_custkey").unionByName(plain(low, "audit").select(F.lit("audit").alias("sink"), "c_custkey"))


# -- expressions
@query("select c_custkey, c_mktsegment || '/' || c_mktsegment as twice from customer")
def concat(spark, d):
    return customer(spark, d).map(spread=False, c_custkey=col("c_custkey"), twice=col("c_mktsegment") + "/" + col("c_mktsegment")).frame()


@query("select p_partkey, upper(p_name) as u, lower(p_brand) as l, trim('  ' || p_type || '  ') as t from part")
def upper_lower_trim(spark, d):
    part = rows(spark.read.parquet(f"{d}/part.parquet"), "p_partkey: int, p_name: string, p_brand: string, p_type: string")
    from tidegate.nodes import lift

    return part.map(spread=False, p_partkey=col("p_partkey"), u=upper(col("p_name")), l=lower(col("p_brand")), t=trim(lift("  ") + col("p_type") + "  ")).frame()


@query("select l_orderkey + l_partkey * 2 - l_suppkey as x, l_linenumber from lineitem")
def int_arith(spark, d):
    return lineitem(spark, d).map(spread=False, x=col("l_orderkey") + col("l_partkey") * 2 - col("l_suppkey"), l_linenumber=col("l_linenumber")).frame()


@query("select l_orderkey, (l_suppkey - l_partkey) // 7 as q from lineitem")
def int_div_trunc(spark, d):
    return lineitem(spark, d).map(spread=False, l_orderkey=col("l_orderkey"), q=(col("l_suppkey") - col("l_partkey")) / 7).frame()


@query("select l_orderkey, l_extendedprice * (1.0::double - l_discount) / l_quantity as unit from lineitem")
def double_arith(spark, d):
    from tidegate.nodes import lift

    return lineitem(spark, d).map(spread=False, l_orderkey=col("l_orderkey"), unit=col("l_extendedprice") * (lift(1.0) - col("l_discount")) / col("l_quantity")).frame()


@query("select l_orderkey, cast(cast(l_extendedprice as decimal(15,2)) * 0.08 as varchar) as tax, cast(cast(l_extendedprice as decimal(15,2)) + cast(l_discount as decimal(15,2)) as varchar) as total, cast(l_extendedprice as decimal(15,2)) > 1000.5 as over_ from lineitem")
def decimal_arith(spark, d):
    df = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", F.col("l_extendedprice").cast("decimal(15,2)").alias("price"), F.col("l_discount").cast("decimal(15,2)").alias("off"))
    return rows(df, "l_orderkey: int, price: decimal, off: decimal").map(spread=False, l_orderkey=col("l_orderkey"), tax=col("price") * 0.08, total=col("price") + col("off"), over_=col("price") > 1000.5).frame()


@query("select o_orderkey from orders where cast(o_orderdate as date) < date '1996-01-01'")
def date_compare(spark, d):
    df = spark.read.parquet(f"{d}/orders.parquet").withColumn("edge", F.lit("1996-01-01").cast("date"))
    return rows(df, "o_orderkey: int, o_orderdate: date, edge: date").filter(col("o_orderdate") < col("edge")).select("o_orderkey").frame()


@query("select l_orderkey, l_linenumber, l_shipdate from lineitem where l_shipdate >= timestamp '1997-06-01 00:00:00'")
def datetime_compare(spark, d):
    df = spark.read.parquet(f"{d}/lineitem.parquet").withColumn("edge", F.lit("1997-06-01 00:00:00").cast("timestamp_ntz"))
    return rows(df, "l_orderkey: int, l_linenumber: int, l_shipdate: datetime, edge: datetime").filter(col("l_shipdate") >= col("edge")).select("l_orderkey", "l_linenumber", "l_shipdate").frame()


_ABSENT = "customer_export"


@query("select rec_id, coalesce(email, 'n/a') || '!' as email, coalesce(plan, 'none') as plan from customer_export")
def coalesce_optional(spark, d):
    df = spark.read.parquet(f"{d}/{_ABSENT}.parquet")
    return rows(df, "rec_id: int, email: string?, plan: string?").map(email=col("email").default("n/a") + "!", plan=col("plan").default("none")).frame()


@query("select rec_id, coalesce(case when email is null or plan is null then null else email <> '' and plan = 'free' end, true) as both from customer_export")
def strict_absent_and(spark, d):
    df = spark.read.parquet(f"{d}/{_ABSENT}.parquet")
    return rows(df, "rec_id: int, email: string?, plan: string?").map(spread=False, rec_id=col("rec_id"), both=(col("email").ne("") & col("plan").eq("free")).default(True)).frame()


@query("select rec_id, 'x' as kind, coalesce(upper(phone), '?') as phone from showcase where region = 'EU'")
def optional_functions(spark, d):
    df = spark.read.parquet(f"{d}/showcase.parquet")
    return rows(df, "rec_id: int, phone: string?, region: string?").filter(col("region").default("-").eq("EU")).map(spread=False, rec_id=col("rec_id"), kind="x", phone=upper(col("phone")).default("?")).frame()


# -- text cells: coercion
def _cells(spark: SparkSession, df: DataFrame, schema: str, formats: dict[str, str] | None = None):
    """Cells of text under a schema, as the readers of files give them."""
    from tidegate.analyze import source_schema
    from tidegate.builder import fields
    from tidegate.lower import FATAL, OFF, ORD
    from tidegate.nodes import SourceDecl
    from tidegate.sources import from_cells

    decl = SourceDecl("in", "cells", "", fields(schema), formats=formats or {})
    typed = source_schema(decl)
    cells = df.select(F.col(df.columns[0]).alias(ORD), F.col(df.columns[0]).alias(OFF), F.array(*df.columns).alias("cells"), F.lit(None).cast("string").alias(FATAL))
    return from_cells(spark, decl, typed, cells, {n: i for i, n in enumerate(typed.names)}, "csv")


@query(r"""select rec_id, case when regexp_full_match(age, '[+-]?[0-9]+') then try_cast(age as bigint) end as age,
case when regexp_full_match(age, '[+-]?[0-9]+') and try_cast(age as bigint) is not null then null else 'cannot parse "' || age || '" as int' end as reason,
case when regexp_full_match(age, '[+-]?[0-9]+') and try_cast(age as bigint) is not null then null else 'csv:age' end as stage from showcase""")
def coerce_int_fail(spark, d):
    df = spark.read.parquet(f"{d}/showcase.parquet").select(F.col("rec_id").cast("string"), "age")
    f = _cells(spark, df, "rec_id: int, age: int")
    return f.df.select(F.col("s0").alias("rec_id"), F.col("s1").alias("age"), F.col("`#fail`.reason").alias("reason"), F.col("`#fail`.stage").alias("stage"))


@query(_RECORDS.rstrip().rstrip(",") + r""" , v as (select line_id, case when strpos(a, '.') = 0 then replace(a, ',', '') else replace(regexp_replace(a, '[.][^.]*$', ''), ',', '') || regexp_extract(a, '[.][^.]*$') end as a, a as raw
  from (select line_id, coalesce(case when ok then x[7] end, '') as a from c))
select line_id, case when ok then cast(a as decimal(38,10)) end as amount, case when ok then null else 'cannot parse cell as decimal' end as reason
from (select *, regexp_full_match(a, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]{1,3})?') as ok from v)""")
def coerce_decimal(spark, d):
    """The amount of every record, whether or not the rest of the record loads: value by value."""
    from tidegate.operators.badrows import ETL_COLUMNS, classify

    cells = classify(spark.read.parquet(f"{d}/etl_lines.parquet").select("line_id", "raw_line"), "raw_line")
    df = cells.select(F.col("line_id").cast("string"), F.coalesce(F.get("`#cells`", F.lit(ETL_COLUMNS.index("amount"))), F.lit("")).alias("v"))
    f = _cells(spark, df, "line_id: int, v: decimal @pii")
    amount = F.col("s1.u").cast("decimal(38,10)") / F.pow(F.lit(10), F.col("s1.s"))
    return f.df.select(F.col("s0").alias("line_id"), amount.cast("decimal(38,10)").alias("amount"), F.col("`#fail`.reason").alias("reason"))


@query(r"""select term_id, case when regexp_full_match(renewed_on, '[0-9]{2}/[0-9]{2}/[0-9]{4}') then try_strptime(renewed_on, '%d/%m/%Y')::date end as renewed_on,
renewed_on is not null and trim(renewed_on) <> '' and not (regexp_full_match(renewed_on, '[0-9]{2}/[0-9]{2}/[0-9]{4}') and try_strptime(renewed_on, '%d/%m/%Y') is not null) as failed from date_terms""")
def coerce_date_layout(spark, d):
    df = spark.read.parquet(f"{d}/date_terms.parquet").select(F.col("term_id").cast("string"), F.coalesce("renewed_on", F.lit("")).alias("renewed_on"))
    f = _cells(spark, df, "term_id: int, renewed_on: date?", {"renewed_on": "02/01/2006"})
    return f.df.select(F.col("s0").alias("term_id"), F.col("s1").alias("renewed_on"), F.col("`#fail`").isNotNull().alias("failed"))


# -- text programs and segments
def _program(spark: SparkSession, d: str, text: str, sink: str = "out") -> DataFrame:
    return plain(plan(spark, parse(text.replace("{d}", d))), sink)


@query("select o_orderkey, lower(trim(o_orderpriority)) as o_orderpriority from orders where o_totalprice > 0.0")
def segment_named(spark, d):
    return _program(spark, d, """
on error skip
source in = parquet("{d}/orders.parquet", schema: { o_orderkey: int, o_totalprice: double, o_orderpriority: string })
sink out = jsonl("unused")
pipeline clean = check(.o_totalprice > 0.0, "no price") |> map({ ...row, o_orderpriority: lower(trim(.o_orderpriority)) })
pipeline main { in |> clean |> select(o_orderkey, o_orderpriority) |> out }""")


@query("select c_custkey, repeat('*', strlen(c_name)) as c_name from customer where c_acctbal >= 1000.0 and c_nationkey < 10")
def segment_params(spark, d):
    return _program(spark, d, """
source in = parquet("{d}/customer.parquet", schema: { c_custkey: int, c_name: string @pii, c_nationkey: int, c_acctbal: double })
sink out = jsonl("unused")
pipeline scrub(what) = mask(what)
pipeline rich(least: double, n: int) = filter(.c_acctbal >= least) |> filter(.c_nationkey < n)
pipeline main { in |> scrub(c_name) |> rich(1000.0, 10) |> select(c_custkey, c_name) |> out }""")


@query("select doc_id, upper(coalesce(source, 'none')) as origin, coalesce(lang, '??') as lang from documents")
def column_alias(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return rows(docs, "doc_id: int, origin: string?, lang: string?", columns={"origin": "source"}).map(spread=False, doc_id=col("doc_id"), origin=upper(col("origin").default("none")), lang=col("lang").default("??")).frame()


@query("""with a as (select * from orders where o_totalprice > 1000.0), b as (select * from a where o_orderstatus <> 'P' and o_totalprice >= 100000.0)
select o_orderkey as id, sha256(o_orderpriority) as priority, repeat('*', strlen(cast(o_orderstatus as varchar))) as status, o_totalprice >= 200000.0 as high, o_totalprice as price from b""")
def etl_composite(spark, d):
    df = spark.read.parquet(f"{d}/orders.parquet")
    r = rows(df, "o_orderkey: int, o_orderstatus: string @pii, o_totalprice: double, o_orderpriority: string @pii").check(col("o_totalprice") > 1000.0, "non-positive").on_error("skip")
    r = r.filter(col("o_orderstatus").ne("P")).filter(col("o_totalprice") >= 100000.0).map(high=col("o_totalprice") >= 200000.0)
    return r.hash("o_orderpriority").mask("o_orderstatus").rename(o_orderkey="id", o_orderpriority="priority", o_orderstatus="status", o_totalprice="price").select("id", "priority", "status", "high", "price").frame()


@query()
def deidentify_sealed(spark, d):
    """Encrypted names of all customers; a fresh nonce per cell makes the texts differ from run to run."""
    os.environ.setdefault("TIDEGATE_DEMO_KEY", "00" * 32)
    from tidegate.analyze import source_schema
    from tidegate.builder import fields
    from tidegate.lower import FATAL, OFF, ORD
    from tidegate.nodes import SourceDecl
    from tidegate.sources import from_cells

    decl = SourceDecl("in", "cells", "", fields("c_custkey: int, c_name: string @deidentify"), key="TIDEGATE_DEMO_KEY")
    df = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias(ORD), F.col("c_custkey").alias(OFF), F.array(F.col("c_custkey").cast("string"), "c_name").alias("cells"), F.lit(None).cast("string").alias(FATAL))
    f = from_cells(spark, decl, source_schema(decl), df, {"c_custkey": 0, "c_name": 1}, "csv")
    return f.df.select(F.col("s0").alias("c_custkey"), F.col("s1").alias("c_name"))


_TRIP = "o_orderkey: int, o_custkey: int, o_orderstatus: string, o_totalprice: double, o_orderdate: datetime, o_orderpriority: string"


def _file(spark: SparkSession, df: DataFrame, name: str) -> str:
    """One file of delimited text in the shared folder, written by a task of the cluster."""
    target = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.coalesce(1).write.option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss").csv(target, header=True, quoteAll=True)
    local = target.removeprefix("file://").removeprefix("file:")
    return next(os.path.join(local, f) for f in os.listdir(local) if f.endswith(".csv"))


@query("select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority from orders")
def csv_roundtrip(spark, d):
    """All columns of orders written as one delimited file and read back with coercion."""
    path = _file(spark, spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.col("o_orderdate").cast("timestamp_ntz").alias("o_orderdate"), "o_orderpriority"), "orders")
    return _program(spark, path, f'source in = csv("{{d}}", schema: {{ {_TRIP} }})\nsink out = jsonl("unused")\npipeline main {{ in |> out }}')


@query("""select '{"id":' || c_custkey || ',"segment":"' || c_mktsegment || '","rich":' || (c_acctbal > 0.0) || '}' as line from customer""")
def jsonl_lines(spark, d):
    from tidegate.lower import q
    from tidegate.sinks.render import json_line

    low = customer(spark, d).map(spread=False, id=col("c_custkey"), segment=col("c_mktsegment"), rich=col("c_acctbal") > 0.0).lowered()
    return low.rows("out").select(json_line(low.frame.schema, q).alias("line"))
