"""The landing folder as a data source: batch with filters, stream with offsets."""

import json
import os

import pytest
from pyspark.sql import functions as F

from harrow.sources.landed import landed_files, register


@pytest.fixture
def folder(spark, tmp_path):
    register(spark)
    land(tmp_path, "2026-03-01", "0001.json", [{"id": i} for i in range(5)])
    land(tmp_path, "2026-03-01", "0002.json", [{"id": 5}])
    land(tmp_path, "2026-03-02", "0003.json", [{"id": i} for i in range(6, 9)])
    land(tmp_path, "2026-03-03", "_0004.json", [{"id": 99}])
    return str(tmp_path)


def land(root, day, name, rows):
    os.makedirs(root / day, exist_ok=True)
    (root / day / name).write_text("\n".join(map(json.dumps, rows)))


def ids(df):
    return sorted(int(r[0]) for r in df.select(F.get_json_object("value", "$.id")).collect())


def test_batch_reads_each_line_once(spark, folder):
    df = spark.read.format("landed").load(folder)
    assert ids(df) == list(range(9)) and df.rdd.getNumPartitions() == 3
    assert {(r.day, r.line) for r in df.where("path LIKE '%0003.json'").collect()} == {("2026-03-02", i) for i in range(3)}
    assert spark.read.format("landed").load(folder + "/none").count() == 0 and landed_files(folder)[-1] == ("2026-03-02", "0003.json")


def test_day_filters_are_taken_by_the_source(spark, folder):
    df = spark.read.format("landed").load(folder)
    for test, want in (("day = '2026-03-02'", [6, 7, 8]), ("day > '2026-03-01'", [6, 7, 8]), ("day <= '2026-03-01'", list(range(6))), ("day IN ('2026-03-01', '2026-03-09')", list(range(6))), ("day >= '2026-03-01' AND day < '2026-03-02' AND line > 3", [4])):
        assert ids(df.where(test)) == want, test
    one = df.where("day = '2026-03-02'")
    plan = one._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert one.rdd.getNumPartitions() == 1 and "PushedFilters: [EqualTo(day,2026-03-02)]" in plan
    os.chmod(f"{folder}/2026-03-01/0001.json", 0)
    assert ids(one) == [6, 7, 8]  # files of other days are not opened


def test_a_restarted_stream_reads_what_landed_since(spark, folder, tmp_path):
    out, state = str(tmp_path.parent / f"{tmp_path.name}-out"), str(tmp_path.parent / f"{tmp_path.name}-state")

    def run():
        rows = spark.readStream.format("landed").load(folder)
        rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        return ids(spark.read.parquet(out))

    assert run() == list(range(9))
    assert run() == list(range(9))
    land(tmp_path, "2026-03-02", "0005.json", [{"id": 10}])
    land(tmp_path, "2026-03-04", "0006.json", [{"id": 11}, {"id": 12}])
    assert run() == [*range(9), 10, 11, 12]


def test_long_files_come_in_batches(spark, tmp_path):
    register(spark)
    land(tmp_path, "2026-03-01", "a.json", [{"id": i, "x": "é" * 50} for i in range(25_000)])
    df = spark.read.format("landed").load(str(tmp_path))
    assert ids(df) == list(range(25_000)) and df.agg(F.count_distinct("line")).first()[0] == 25_000
