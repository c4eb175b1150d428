"""Classes from edges: a few edges take a few tasks, however many partitions they come in."""

import random

import pytest

from harrow.functions.storage import checkpointed, tasks_for
from harrow.llm.minhash_dedup import components

NAMES = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")


def expected(edges):
    root = {}

    def find(v):
        while root.setdefault(v, v) != v:
            v = root[v]
        return v

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {v: find(v) for v in list(root)}


@pytest.fixture
def many_partitions(spark):
    before = {k: spark.conf.get(k) for k in NAMES}
    spark.conf.set(NAMES[0], "40")
    spark.conf.set(NAMES[1], "false")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_few_edges_take_few_tasks(spark, many_partitions):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(30)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(150)]
    rows = checkpointed(spark.createDataFrame(edges, "a long, b long").repartition(40))
    sc, group = spark.sparkContext, "few-edges"
    sc.setJobGroup(group, group)
    try:
        got = {r.v: r.label for r in components(rows).collect()}
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert got == expected(edges)
    told = sc.statusTracker()
    stages = {s for j in told.getJobIdsForGroup(group) for s in told.getJobInfo(j).stageIds}
    assert sum(i.numTasks for i in map(told.getStageInfo, stages) if i and i.numCompletedTasks) < 1000


def test_many_edges_take_several_tasks(spark, many_partitions, monkeypatch):
    import harrow.llm.minhash_dedup as M

    monkeypatch.setattr(M, "tasks_for", lambda rows: tasks_for(rows, 50))
    rng = random.Random(6)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)]
    rows = checkpointed(spark.createDataFrame(edges, "a long, b long").repartition(40))
    assert {r.v: r.label for r in components(rows).collect()} == expected(edges)
    assert components(rows.limit(0)).collect() == []
    assert tasks_for(rows.limit(0)) == 1 and tasks_for(rows, 50) == 5
