"""Order, policies and predicates of table sources."""

import pytest

from tidegate.builder import rows
from tidegate.nodes import BuildFault, RowFault, col
from tidegate.run import run_text

FIELDS = "id: int, x: double?, note: string?"


@pytest.fixture(scope="module")
def boats(spark):
    data = [(i * 3 % 101, float(i) if i % 7 else None if i % 2 else float("nan"), None if i % 5 == 0 else f"n{i}") for i in range(101)]
    return spark.createDataFrame(data, "id long, x double, note string").repartition(5)


def test_unordered_sources_are_refused(spark, boats):
    plain_rows = rows(boats, FIELDS).drop("x", "note")
    for wrong in (lambda: plain_rows.limit(3).frame(), lambda: plain_rows.offset(3).frame(), lambda: plain_rows.check(col("id") > 5, "low").errors()):
        with pytest.raises(BuildFault, match="needs an order"):
            wrong()
    assert plain_rows.frame().count() == 101


def test_abort_never_drops_failed_rows(spark, boats):
    pipe = rows(boats, FIELDS).drop("x", "note").check(col("id") > 5, "low")
    with pytest.raises(Exception, match="low"):
        pipe.frame().collect()
    assert pipe.on_error("skip").frame().count() == 95


def test_abort_over_files(spark, boats, tmp_path):
    boats.orderBy("id").coalesce(1).write.parquet(str(tmp_path / "boats"))
    program = 'source in = parquet("boats", {extra}schema: {{ id: int }})\nsink out = jsonl("out.jsonl")\npipeline main {{ in |> check(.id != 40, "forty") |> out }}'
    for extra in ("", 'order_by: "id", '):
        with pytest.raises(RowFault, match='row 40 from "in": forty'):
            run_text(spark, program.format(extra=extra), str(tmp_path))
        assert (tmp_path / "out.jsonl").read_text().split() == [f'{{"id":{i}}}' for i in range(40)]
    spark.read.parquet(str(tmp_path / "boats")).createOrReplaceTempView("boats_view")
    with pytest.raises(BuildFault, match="needs an order"):
        run_text(spark, program.format(extra="").replace('parquet("boats"', 'table("boats_view"'), str(tmp_path))
    run_text(spark, program.format(extra="").replace('parquet("boats"', 'table("boats_view"').replace(' |> check(.id != 40, "forty")', ""), str(tmp_path))
    assert (tmp_path / "out.jsonl").read_text().count("\n") == 101


def test_error_sink_over_files(spark, boats, tmp_path):
    boats.orderBy("id").repartitionByRange(3, "id").sortWithinPartitions("id").write.parquet(str(tmp_path / "boats"))
    program = 'on error |> bad\nsource in = parquet("boats", schema: { id: int })\nsink out = jsonl("out.jsonl")\nsink bad = jsonl("bad.jsonl")\npipeline main { in |> check(.id != 40, "forty") |> check(.id < 99, "high") |> out }'
    run_text(spark, program, str(tmp_path))
    assert (tmp_path / "bad.jsonl").read_text().splitlines() == [f'{{"source":"in","ordinal":{i},"offset":{i},"reason":"{r}","stage":"check"}}' for i, r in ((40, "forty"), (99, "high"), (100, "high"))]


@pytest.mark.parametrize("n, left", [(0, 101), (1, 100), (100, 1), (101, 0), (500, 0)])
def test_offset_counts(spark, boats, n, left):
    got = sorted(r.id for r in rows(boats, FIELDS, order_by="id").drop("x", "note").offset(n).frame().collect())
    assert got == list(range(101))[n:] and len(got) == left


def test_pages_behind_filters(spark, boats):
    even = [i for i in range(101) if i >= 50]
    r = rows(boats, FIELDS, order_by="id").drop("x", "note").filter(col("id") >= 50)
    assert sorted(x.id for x in r.offset(7).limit(9).frame().collect()) == even[7:16]
    assert sorted(x.id for x in r.limit(9).offset(7).frame().collect()) == even[7:9]


def test_nulls_in_the_order_column(spark):
    df = spark.createDataFrame([(1,), (None,)], "id long")
    with pytest.raises(Exception, match="holds a null"):
        rows(df, "id: int", order_by="id").limit(2).frame().collect()


@pytest.mark.parametrize(
    "make",
    [
        lambda: (col("x") > 10.0) & (col("note").ne("n12")),
        lambda: (col("x") > 90.0) | (col("note").eq("n12")),
        lambda: ((col("x") <= 20.0) | (col("x") >= 90.0)) & (col("note").ne("n12") | col("note").eq("n91")),
        lambda: col("x").ne(12.0),
        lambda: col("x") >= 0.0,
        lambda: col("x").eq(col("x")),
        lambda: (col("x").default(1.0) > 0.0) | (col("note").default("") .eq("n1")),
    ],
)
def test_filters_as_expressions_say(spark, boats, make):
    """A filter keeps the rows for which the expression, computed as a column, is true."""
    as_filter = rows(boats, FIELDS).map(id=col("id"), ok=make().default(False)).filter(col("ok")).select("id").frame()
    direct = rows(boats, FIELDS).filter(make().default(False)).select("id").frame()
    from tidegate.lower import Lowerer
    from tidegate.analyze import source_schema
    from tidegate.builder import fields
    from tidegate.nodes import SourceDecl
    from tidegate.sources.table import frame_of

    f = frame_of(boats, source_schema(SourceDecl("in", "frame", "", fields(FIELDS))), "in")
    bare = f.df.where(Lowerer(f).predicate(make())).select(f.user("id").alias("id"))
    want = sorted(r.id for r in as_filter.collect())
    assert sorted(r.id for r in direct.collect()) == want == sorted(r.id for r in bare.collect())
