"""Pipelines over a stream of files."""

import pytest

from tidegate.builder import rows
from tidegate.nodes import AnalysisFault, col
from tidegate.streaming import stream


def test_files_as_a_stream(spark, tmp_path):
    folder = str(tmp_path / "in")
    for i in range(3):
        spark.createDataFrame([(10 * i + k, float(k)) for k in range(5)], "id long, v double").write.mode("append").parquet(folder)
    df = spark.readStream.schema("id long, v double").option("maxFilesPerTrigger", 1).parquet(folder)
    pipe = rows(df, "id: int, v: double").check(col("v") < 4.0, "large").filter(col("v") > 0.5).map(v=col("v") * 2.0)
    got, bad = [], []
    q = stream(pipe.on_error("sink"), lambda s, b, n: (got if s == "out" else bad).extend(map(tuple, b.collect())), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert sorted(got) == [(10 * i + k, 2.0 * k) for i in range(3) for k in (1, 2, 3)]
    assert bad == [("in", "large", "check")] * 3
    for wrong in (pipe, pipe.limit(3).on_error("skip"), rows(spark.range(3).toDF("id"), "id: int").on_error("skip")):
        with pytest.raises(AnalysisFault):
            stream(wrong, lambda *_: None, str(tmp_path / "cp2"))
