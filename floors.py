
import os
import shutil
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    d, cpus, base = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8"), tempfile.mkdtemp(prefix="floors-")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.python.sql.dataFrameDebugging.enabled", "false").config("spark.checkpoint.dir", f"{base}/cut").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    from tidegate.nodes import col, hash_, mask
    from tidegate.plans import catalogue as c
    from tidegate.run import run_text

    read = lambda t: spark.read.parquet(f"{d}/{t}.parquet")
    noop = lambda df: df.write.format("noop").mode("overwrite").save()
    to = lambda df, name: df.write.mode("overwrite").parquet(f"{base}/{name}")
    orders, events, items = read("orders"), read("events"), read("lineitem")
    csv = f"{base}/orders.csv"
    orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority").toPandas().to_csv(csv, index=False)
    schema = "o_orderkey: int, o_custkey: int, o_totalprice: double, o_orderpriority: string"

    def five(p, engine):
        a, b, x, y = ("l_extendedprice", "l_discount", "l_orderkey", "l_partkey")
        if engine:
            return p.map(spread=False, a=col(a) * col(b), b=col(a) + col(b), c=col(x) + col(y), d=col(x) * 2, e=col(a) > 1000.0).frame()
        return p.select((F.col(a) * F.col(b)).alias("a"), (F.col(a) + F.col(b)).alias("b"), (F.col(x) + F.col(y)).alias("c"), (F.col(x) * 2).alias("d"), (F.col(a) > 1000).alias("e"))

    def program(text):
        run_text(spark, text.replace("{d}", d), base)

    priced = F.col("value") > 10
    states = [("f", F.col("o_orderstatus") == "F"), ("o", F.col("o_orderstatus") == "O"), ("p", ~F.col("o_orderstatus").isin("F", "O"))]
    line = F.concat(F.lit('{"event_id":'), F.col("event_id"), F.lit(',"event_type":"'), F.col("event_type"), F.lit('"}')).alias("line")
    numbered = lambda df, key: df.withColumn("n", F.row_number().over(__import__("pyspark.sql", fromlist=["Window"]).Window.orderBy(key)) - 1)

    def checked_floor():
        to(events.where(priced).select("event_id", "value"), "ok")
        to(numbered(events, "event_id").where(~priced).select(F.lit("in").alias("source"), F.col("n").alias("ordinal"), F.lit("low").alias("reason")), "bad")

    def route_floor():
        for name, when in states:
            to(orders.where(when).select("o_orderkey", "o_orderstatus"), name)

    def lines_floor():
        events.orderBy("event_id").select(line).write.mode("overwrite").text(f"{base}/lines")

    cases = [
        ("scan, filter, select (orders)", lambda: noop(c.filter_and(spark, d)), lambda: noop(orders.where("o_totalprice > 100000 and o_orderstatus = 'F'").select("o_orderkey", "o_totalprice", "o_orderstatus"))),
        ("map, 5 expressions (lineitem)", lambda: noop(five(c.lineitem(spark, d), True)), lambda: noop(five(items, False))),
        ("hash + mask (documents.text)", lambda: noop(c.rows(read("documents"), "doc_id: int, text: string? @pii").map(spread=False, doc_id=col("doc_id"), h=hash_(col("text").default("")), m=mask(col("text").default(""))).frame()), lambda: noop(read("documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"), F.repeat(F.lit("*"), F.octet_length(F.coalesce("text", F.lit("")))).alias("m")))),
        ("check + error envelope, two outputs (events)", lambda: program('on error |> bad\nsource in = parquet("{d}/events.parquet", order_by: "event_id", schema: { event_id: int, value: double })\nsink ok = parquet("e_ok")\nsink bad = parquet("e_bad")\npipeline main { in |> check(.value > 10.0, "low") |> ok }'), checked_floor),
        ("route into 3 sinks (orders)", lambda: program('source in = parquet("{d}/orders.parquet", schema: { o_orderkey: int, o_orderstatus: string })\nsink f = parquet("e_f")\nsink o = parquet("e_o")\nsink p = parquet("e_p")\npipeline main { in |> route { .o_orderstatus == "F" => f, .o_orderstatus == "O" => o, else => p } }'), route_floor),
        ("limit by key (orders)", lambda: noop(c.limit_first(spark, d)), lambda: noop(orders.orderBy("o_orderkey").limit(100).select("o_orderkey", "o_totalprice"))),
        ("offset by key (orders)", lambda: noop(c.offset_rest(spark, d)), lambda: noop(orders.orderBy("o_orderkey").offset(100).select("o_orderkey", "o_totalprice"))),
        ("csv with provenance and coercion (orders)", lambda: noop(c._program(spark, d, f'source in = csv("{csv}", schema: {{ {schema} }})\nsink out = jsonl("x")\npipeline main {{ in |> out }}')), lambda: noop(spark.read.csv(csv, header=True, schema=schema.replace(":", "").replace(" int", " bigint")))),
        ("ordered jsonl, one file against a folder (events)", lambda: program('source in = parquet("{d}/events.parquet", order_by: "event_id", schema: { event_id: int, event_type: string })\nsink out = jsonl("e.jsonl")\npipeline main { in |> out }'), lines_floor),
        ("ordered jsonl folder (events)", lambda: program('source in = parquet("{d}/events.parquet", order_by: "event_id", schema: { event_id: int, event_type: string })\nsink out = jsonl("e_lines/")\npipeline main { in |> out }'), lines_floor),
    ]

    def median(f) -> float:
        f()
        took = []
        for _ in range(5):
            began = time.time()
            f()
            took.append(time.time() - began)
        return statistics.median(took)

    try:
        for name, engine, floor in cases:
            a, b = median(engine), median(floor)
            print(f"| {name} | {a:.2f} | {b:.2f} | {a / b:.1f} |", flush=True)
    finally:
        shutil.rmtree(base, ignore_errors=True)


if __name__ == "__main__":
    main()
