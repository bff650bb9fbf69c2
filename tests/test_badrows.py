"""Classification of records that do not load."""

import csv
import io
import random

from tests.conftest import all_rows
from tidegate.operators import badrows

GOOD = '7,"A ""B"" C",a@x,,,30,1.5,free,2024-01-02,note'
CASES = [
    (GOOD, None),
    (GOOD + "\r", None),
    ('7,A,a,,,+30,-.5e3,free,2024-02-29,"line\nbreak, and comma"', None),
    ("7,A,a,,,030,1.,free,2024-01-02,", None),
    ("7,A,a,,,30,1.5,free,2024-01-02,x\u0001y\u0003", None),
    ('7,A,a,,,30,1.5,free,2024-01-02,size 12"', "quote"),
    ('7,"A,a,,,30,1.5,free,2024-01-02,x', "quote"),
    ('7,"A"b,a,,,30,1.5,free,2024-01-02,x', "quote"),
    ('7,"A" ,a,,,30,1.5,free,2024-01-02,x', "quote"),
    ("7,A,a", "columns"),
    ("", "columns"),
    (None, "columns"),
    ('"7,A,a,,,30,1.5,free,2024-01-02,x"', "columns"),
    ("7,A,a,,,30,1,5,free,2024-01-02,x", "columns"),
    ("x,A,a,,,y,1.5,free,2024-01-02,x", "id"),
    (" 7,A,a,,,30,1.5,free,2024-01-02,x", "id"),
    (",A,a,,,30,1.5,free,2024-01-02,x", "id"),
    ("99999999999999999999,A,a,,,30,1.5,free,2024-01-02,x", "id"),
    ("7,A,a,,,４２,1.5,free,2024-01-02,x", "age"),
    ("7,A,a,,,3.0,z,free,2024-01-02,x", "age"),
    ("7,A,a,,,30,NaN,free,2024-01-02,x", "amount"),
    ("7,A,a,,,30,1.5d,free,2024-01-02,x", "amount"),
    ("7,A,a,,,30,.,free,2024-01-02,x", "amount"),
    ("7,A,a,,,30,1e,free,2024-01-02,x", "amount"),
    ("7,A,a,,,30,1.5,free,2024-1-2,x", "signup_date"),
    ("7,A,a,,,30,1.5,free,2023-02-29,x", "signup_date"),
    ("7,A,a,,,30,1.5,free,2024-01-02T00:00:00,x", "signup_date"),
    ('7,A,a,,,30,1.5,free,2024-01-02,"' + '""' * 50_000 + '"', None),
    ("7,A,a,,,30,1.5,free,2024-01-02," + "x" * 300_000, None),
]


def test_reasons(spark):
    df = spark.createDataFrame([(i, c[0], 1) for i, c in enumerate(CASES)], "i int, raw string, reason int")
    got = {r.i: r["#reason"] for r in badrows.classify(df, "raw").select("i", "`#reason`").collect()}
    assert [(c[0] and c[0][:60], got[i]) for i, c in enumerate(CASES)] == [(c[0] and c[0][:60], c[1]) for c in CASES]


def test_cells_agree_with_the_csv_module(spark):
    r = random.Random(4)
    rows = []
    for i in range(300):
        cells = [str(i), *("".join(r.choice('ab,"\n\u0001 ') for _ in range(r.randrange(6))) for _ in range(4)), "3", "4.5", "p", "2024-01-02", "".join(r.choice('x,"\n') for _ in range(5))]
        out = io.StringIO()
        csv.writer(out, lineterminator="").writerow(cells)
        rows.append((i, out.getvalue(), cells))
    df = spark.createDataFrame([x[:2] for x in rows], "i int, raw string")
    got = {x.i: (x["#reason"], x["#cells"]) for x in badrows.classify(df, "raw").select("i", "`#reason`", "`#cells`").collect()}
    for i, _, cells in rows:
        assert got[i] == (None, cells)


def test_split_and_found(spark):
    df = spark.createDataFrame([(1, GOOD, 5), (2, "x", 6), (2, "x", 6)], "line_id long, raw_line string, id int")
    good, bad = badrows.split_records(df, "raw_line")
    row = good.first()
    assert (row["in_line_id"], row["id"], row["amount"], str(row["signup_date"]), row["full_name"]) == (1, 7, 1.5, "2024-01-02", 'A "B" C')
    assert all_rows(bad.select("in_line_id", "reason")) == [(2, "columns")] * 2
    show = spark.createDataFrame([(8, "+5"), (9, " 5"), (10, None)], "rec_id long, age string")
    assert all_rows(badrows.found(df, show)) == sorted([("etl_lines", 2, "columns")] * 2 + [("showcase", 9, "age"), ("showcase", 10, "age")], key=repr)
    assert badrows.found(df.limit(0), show.limit(0)).count() == 0
