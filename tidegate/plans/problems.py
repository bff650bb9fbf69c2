"""Queries of the general data problems over the driver's tables, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.operators import badrows, intervals, profile, timestamps


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return timestamps.found(spark, table(spark, d, "datetime_punches"), table(spark, d, "sites"), table(spark, d, "showcase"), table(spark, d, "date_terms"))


def p1_renewed(spark: SparkSession, d: str) -> DataFrame:
    """The day-first dates of date_terms.renewed_on."""
    terms = table(spark, d, "date_terms").select("term_id", "renewed_on")
    out = timestamps.normalise(terms, "renewed_on", day_first=F.lit(True), zone=F.lit(None).cast("string"), as_date=True, zones=timestamps.known_zones(spark), out="normal")
    return out.where("normal is not null").select("term_id", "normal")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return intervals.found(table(spark, d, "datetime_shifts"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return badrows.found(table(spark, d, "etl_lines"), table(spark, d, "showcase"))


def p3_loaded(spark: SparkSession, d: str) -> DataFrame:
    """The records that load, with typed columns."""
    good, _ = badrows.split_records(table(spark, d, "etl_lines").select("line_id", "raw_line"), "raw_line")
    return good.select(F.col("in_line_id").alias("line_id"), "id", "full_name", "email", "phone", "ssn", "age", "amount", "plan", F.col("signup_date").cast("string").alias("signup_date"), "internal_notes")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return profile.found(table(spark, d, "customer_export"))


def p6_profile(spark: SparkSession, d: str) -> DataFrame:
    """Null rates, distinct counts, misfits and ranges of each column and load."""
    return profile.profile(table(spark, d, "customer_export"))


def p6_masks(spark: SparkSession, d: str) -> DataFrame:
    """The masks of each column with their counts, the rare ones marked."""
    return profile.dominant_masks(table(spark, d, "customer_export")).select("field", "mask", "n", "dominant")


def p6_rare(spark: SparkSession, d: str) -> DataFrame:
    return profile.rare_values(table(spark, d, "customer_export"), "rec_id")


def p6_mask_divergence(spark: SparkSession, d: str) -> DataFrame:
    return profile.mask_divergence(table(spark, d, "customer_export")).withColumn("distance", F.round("distance", 6))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_renewed, p2_found, p3_found, p3_loaded, p6_found, p6_profile, p6_masks, p6_rare, p6_mask_divergence)}

_LEAD = r"regexp_extract(value, '^[ .()-]*\+[ .()-]*1')"
_MASK = rf"{_LEAD} || regexp_replace(regexp_replace(regexp_replace(value[length({_LEAD}) + 1:], '[0-9]', '9', 'g'), '\p{{Lu}}', 'A', 'g'), '\p{{Ll}}', 'a', 'g')"
_CELLS = """cells as (
  select feed_no, load_no, rec_id, field, nullif(case when trim(v, ' ') = '' then '' else v end, '') as value
  from (select feed_no, load_no, rec_id, unnest(['phone', 'ssn', 'plan']) as field, unnest([phone, ssn, plan]) as v from customer_export))"""
_FITS = r"case field when 'phone' then regexp_full_match(regexp_replace(value, '[ .()-]', '', 'g'), '(\+1)?[0-9]{10}') when 'ssn' then regexp_full_match(value, '[0-9]{3}-[0-9]{2}-[0-9]{4}') else value in ('free', 'pro', 'team', 'enterprise') end"

_RECORDS = r"""
with t as (select line_id, regexp_replace(raw_line, '(\r\n|\n|\r)$', '') as r, str_split(regexp_replace(raw_line, '(\r\n|\n|\r)$', ''), '"') as p from etl_lines),
q as (select *, len(p) % 2 = 1 and coalesce(list_bool_and([i % 2 = 0 or p[i] = '' or ((i = 1 or starts_with(p[i], ',')) and (i = len(p) or ends_with(p[i], ','))) for i in range(1, len(p) + 1)]), false) as ok from t),
c as (select line_id, ok, str_split(list_aggregate([case when i % 2 = 1 and p[i] = '' and i > 1 and i < len(p) then '"' when i % 2 = 1 then replace(p[i], ',', chr(1)) else p[i] end for i in range(1, len(p) + 1)], 'string_agg', ''), chr(1)) as x from q),
f as (select line_id, x, case when not ok then 'quote' when len(x) <> 10 then 'columns'
  when not (regexp_full_match(x[1], '[+-]?[0-9]+') and try_cast(x[1] as bigint) is not null) then 'id'
  when not (regexp_full_match(x[6], '[+-]?[0-9]+') and try_cast(x[6] as bigint) is not null) then 'age'
  when not regexp_full_match(x[7], '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') then 'amount'
  when not (regexp_full_match(x[9], '[0-9]{4}-[0-9]{2}-[0-9]{2}') and try_cast(x[9] as date) is not null) then 'signup_date' end as reason from c)
"""

SQL: dict[str, str] = {
    "p1_renewed": r"select term_id, strftime(strptime(renewed_on, '%d/%m/%Y'), '%Y-%m-%d') as normal from date_terms where try_strptime(renewed_on, '%d/%m/%Y') is not null",
    "p2_found": """
with s as (select name, clock_in as a, clock_out as b from datetime_shifts where clock_out > clock_in),
m as (select *, max(b) over (partition by name order by a, b rows between unbounded preceding and 1 preceding) as reach from s),
i as (select *, sum(case when reach is null or a > reach then 1 else 0 end) over (partition by name order by a, b rows unbounded preceding) as island from m),
p as (select name, island, min(a) as a, max(b) as b from i group by name, island),
g as (select name, lag(b) over (partition by name order by a) as a, a as b from p)
select name, 'period' as kind, strftime(a, '%Y-%m-%dT%H:%M:%S') as starts_at, strftime(b, '%Y-%m-%dT%H:%M:%S') as ends_at from p
union all
select name, 'gap', strftime(a, '%Y-%m-%dT%H:%M:%S'), strftime(b, '%Y-%m-%dT%H:%M:%S') from g where a is not null and b - a <= interval 24 hours""",
    "p6_found": f"""
with {_CELLS},
m as (select feed_no, load_no, field, count(*) as n, count(value) as v, count(distinct value) as d, count(*) filter (value is not null and not ({_FITS})) as bad from cells group by all),
s as (select *, (n - v) / n as nulls, case when v > 0 then bad / v end as pattern, case when v > 0 and field <> 'plan' then d / v end as dist from m),
l as (select *, lag(nulls) over w as nulls0, lag(pattern) over w as pattern0, lag(dist) over w as dist0 from s window w as (partition by feed_no, field order by load_no)),
x0 as (select feed_no, load_no, value, count(*) as c from cells where field = 'plan' and value is not null group by all),
x as (select *, sum(c) over (partition by feed_no, load_no) as t from x0),
loads as (select feed_no, load_no, lag(load_no) over (partition by feed_no order by load_no) as before from (select distinct feed_no, load_no from customer_export)),
j as (select l.feed_no, l.load_no, value, c / t as sh, 0.0 as old, 1 as here, 0 as there from loads l join x using (feed_no, load_no)
      union all select l.feed_no, l.load_no, value, 0.0, c / t, 0, 1 from loads l join x on x.feed_no = l.feed_no and x.load_no = l.before),
mix as (select feed_no, load_no, sum(d) / 2 as dist from (select feed_no, load_no, value, abs(sum(sh) - sum(old)) as d from j group by all) group by all),
ok as (select feed_no, load_no from j group by all having max(here) = 1 and max(there) = 1)
select feed_no, load_no, field, 'nulls' as finding from l where abs(nulls - nulls0) > 0.0777
union all select feed_no, load_no, field, 'pattern' from l where abs(pattern - pattern0) > 0.0777
union all select feed_no, load_no, field, 'distinct' from l where abs(dist - dist0) > 0.0777
union all select feed_no, load_no, 'plan', 'mix' from mix join ok using (feed_no, load_no) where dist > 0.1777""",
    "p6_profile": f"""
with {_CELLS}
select feed_no, load_no, field, count(*) as n_rows, count(*) - count(value) as n_missing, count(distinct value) as n_distinct,
  count(*) filter (value is not null and not ({_FITS})) as n_misfit, min(value) as min_value, max(value) as max_value, min(length(value))::int as min_length, max(length(value))::int as max_length
from cells group by all""",
    "p6_masks": f"""
with {_CELLS}, m as (select field, {_MASK} as mask, count(*) as n from cells where value is not null group by all)
select field, mask, n, n / sum(n) over (partition by field) >= 0.05 as dominant from m""",
    "p6_rare": f"""
with {_CELLS}, m as (select rec_id, field, value, {_MASK} as mask from cells where value is not null),
c0 as (select field, mask, count(*) as n from m group by all),
c as (select field, mask, n / sum(n) over (partition by field) as share from c0)
select rec_id as row_key, field, value, mask from m join c using (field, mask) where share < 0.05""",
    "p3_found": _RECORDS + r"""
select 'etl_lines' as tbl, line_id as row_key, reason from f where reason is not null
union all
select 'showcase', rec_id, 'age' from showcase where age is null or not (regexp_full_match(age, '[+-]?[0-9]+') and try_cast(age as bigint) is not null)""",
    "p3_loaded": _RECORDS + r"""
select line_id, cast(x[1] as bigint) as id, x[2] as full_name, x[3] as email, x[4] as phone, x[5] as ssn, cast(x[6] as bigint) as age, cast(x[7] as double) as amount, x[8] as plan, x[9] as signup_date, x[10] as internal_notes
from f where reason is null""",
    "p6_mask_divergence": f"""
with {_CELLS},
m as (select feed_no, load_no, field, {_MASK} as mask, count(*) as n from cells where value is not null group by all),
sh as (select feed_no, load_no, field, mask, n / sum(n) over (partition by feed_no, load_no, field) as share from m),
loads as (select feed_no, load_no, lag(load_no) over (partition by feed_no order by load_no) as before from (select distinct feed_no, load_no from customer_export)),
j as (select l.feed_no, l.load_no, field, mask, share as sh, 0.0 as old, 1 as here, 0 as there from loads l join sh using (feed_no, load_no)
      union all select l.feed_no, l.load_no, field, mask, 0.0, share, 0, 1 from loads l join sh on sh.feed_no = l.feed_no and sh.load_no = l.before),
d as (select feed_no, load_no, field, mask, abs(sum(sh) - sum(old)) as d, max(here) as here, max(there) as there from j group by all)
select feed_no, load_no, field, round(sum(d) / 2, 6) as distance from d group by all having max(here) = 1 and max(there) = 1""",
}
