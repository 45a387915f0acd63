"""Table functions called from SQL."""

import json
import os
import tempfile

import pytest

from chronolith.sources import table_functions


@pytest.fixture(scope="module")
def sql(spark):
    spark.sparkContext.addPyFile(os.path.join(os.path.dirname(__file__), "counting_engines.py"))
    table_functions.register(spark)
    return spark.sql


def test_images_come_some_at_a_time(spark, sql):
    folder = tempfile.mkdtemp(prefix="spark-images-")
    rows = [(k % 2, f"{folder}/{k}", k * 10, "old") for k in range(40)]
    spark.createDataFrame(rows, "shard int, path string, size int, text string").repartition(7).createOrReplaceTempView("images")
    got = sql("SELECT * FROM recognise(TABLE(images) PARTITION BY (shard), 'counting_engines:read_texts', 8)")
    assert got.columns == ["shard", "path", "size", "text"]
    seen = {r.path.rsplit("/", 1)[1]: (r.size, r.text) for r in got.collect()}
    calls = []
    for name in os.listdir(folder):
        with open(f"{folder}/{name}") as f:
            calls.append(json.load(f))
    assert len(seen) == 40 and sorted(calls) == [4, 4, 8, 8, 8, 8]  # twenty of each shard
    assert seen["0"] == (0, "text of 0") and seen["2"] == (20, None)
    lost = sum(t is None for _, t in seen.values())
    assert seen["13"][1] is None and lost in (4 + 1, 8 + 1, 4 + 2, 8 + 2)  # one call failed; 1 and 2 have no text


def test_engines_are_tried_row_by_row(spark, sql):
    spark.createDataFrame([("a", b"easy"), ("b", b"hard"), ("c", b"silence"), ("d", b"broken")], "series string, content binary").createOrReplaceTempView("audio")
    got = sql("SELECT * FROM transcribe(TABLE(audio), 'counting_engines:fast, counting_engines:slow, nowhere:none') ORDER BY series, i")
    assert [(r.series, r.i, r.text, r.source.split(":")[1]) for r in got.collect()] == [("a", 0, "fast easy", "fast"), ("b", 0, "hard", "slow"), ("b", 1, "more", "slow"), ("d", 0, "broken", "slow"), ("d", 1, "more", "slow")]


def test_tables_without_the_column_are_told(sql):
    with pytest.raises(Exception, match="no column path"):
        sql("SELECT * FROM recognise(TABLE(SELECT 1 AS x), 'counting_engines:read_texts', 8)").collect()
