"""Readers and writers, round trip or on small files."""

import json

from pyspark.sql import functions as F

from harrow.functions import text as X
from harrow.operators import curation as U
from harrow.sources import manifests as M
from harrow.streaming.run import publish

ROWS = [("a/x.jpg", "c1", "pest", None, "larva", "g1", "train", "s"), ("a/y.jpg", "c2", "disease", "low", None, "g2", "val", "s"), ("b/z.jpg", "c1", "pest", "", None, "g3", None, None)]


def manifest(spark):
    return spark.createDataFrame(ROWS, ", ".join(f"{f} string" for f in M.FIELDS))


def test_manifest_round_trip_and_split(spark, tmp_path):
    for fmt in ("csv", "parquet"):
        M.write_manifest(manifest(spark).na.fill("train", ["split"]), str(tmp_path / fmt), fmt)
        got = {r.path: r for r in M.read_manifest(spark, str(tmp_path / fmt), fmt=fmt).collect()}
        assert got["a/x.jpg"].severity == "unknown" and got["a/y.jpg"].life_stage == "unknown" and got["b/z.jpg"].split == "train" and got["b/z.jpg"].source == ""
        assert [r.path for r in M.read_manifest(spark, str(tmp_path / fmt), "val", fmt).collect()] == ["a/y.jpg"]


def test_list_images(spark, tmp_path):
    for p in ("c/one.JPG", "c/d/two.webp", "c/no.txt", "three.png"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b"12345")
    got = M.list_images(spark, str(tmp_path)).collect()
    assert sorted(r.path.rsplit("/", 1)[1] for r in got) == ["one.JPG", "three.png", "two.webp"] and {r.length for r in got} == {5}


def test_classes_object_or_list_and_back(spark, tmp_path):
    items = [{"id": "b", "crop": "rice", "name": "B", "category": "pest", "spread_risk": "high", "aliases": ["bb"], "etl": {"threshold": 2.5, "unit": "per_leaf"}}, {"id": "a", "crop": "any", "name": "A", "category": "healthy"}]
    for i, body in enumerate(({"classes": items}, items)):
        (tmp_path / f"{i}.json").write_text(json.dumps(body, indent=1))
        got = M.read_classes(spark, str(tmp_path / f"{i}.json"))
        rows = {r.id: r for r in got.collect()}
        assert rows["b"].class_idx == 0 and rows["b"].etl.threshold == 2.5 and rows["a"].aliases == [] and rows["a"].spread_risk == "none" and rows["a"].generic is False
    M.write_classes(got.where("id = 'a'"), str(tmp_path / "sub"))
    back = M.read_classes(spark, str(tmp_path / "sub") + "/part-*").collect()
    assert [(r.id, r.name) for r in back] == [("a", "A")]


def test_maps_names_and_knowledge(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"map": {"0": ["x", "larva"], "3": ["y", "any"]}, "excluded": {"7": "not here"}}))
    mapped, excluded = M.read_dataset_map(spark, str(tmp_path / "m.json"))
    assert {tuple(r) for r in mapped.collect()} == {(0, "x", "larva"), (3, "y", "any")} and [tuple(r) for r in excluded.collect()] == [(7, "not here")]
    (tmp_path / "n.txt").write_text("0\tFirst one\nbroken\n12 Second\n")
    assert {tuple(r) for r in M.read_index_names(spark, str(tmp_path / "n.txt")).collect()} == {(0, "First one"), (12, "Second")}
    (tmp_path / "k.json").write_text(json.dumps({"defaults": {"pest": {"urgency": "watch", "steps": ["a"]}}, "classes": {"c": {"urgency": "critical"}}, "generic_messages": {"hi": {"en": "Hello", "fr": "Salut"}}}))
    defaults, classes, messages = M.read_knowledge(spark, str(tmp_path / "k.json"))
    assert defaults.first().entry["urgency"] == "watch" and classes.first().entry["urgency"] == "critical" and messages.count() == 2


def test_report_audit_provenance_and_tables(spark, tmp_path):
    M.write_report(spark.range(1).select(F.lit(3).alias("n"), F.array(F.lit("x")).alias("ids")), str(tmp_path / "r"))
    assert json.loads(spark.read.text(str(tmp_path / "r")).first().value) == {"n": 3, "ids": ["x"]}
    cleaned = spark.createDataFrame([("b", "2", "c"), (None, "1", "c"), ("a", "3", "c")], "reason string, path string, class_id string")
    M.write_dropped(cleaned, str(tmp_path / "d"))
    assert [r.reason for r in spark.read.csv(str(tmp_path / "d"), header=True).collect()] == ["a", "b"]
    row = spark.createDataFrame([tuple("abcdefghijkl")], ", ".join(f"{c} string" for c in M.PROVENANCE))
    M.write_provenance(row.withColumn("extra", F.lit(1)), str(tmp_path / "p"))
    assert spark.read.csv(str(tmp_path / "p"), header=True).columns == list(M.PROVENANCE)
    M.save_tables({"means": spark.range(3), "stats": spark.range(1)}, str(tmp_path / "t"))
    assert M.load_tables(spark, str(tmp_path / "t"), "means", "stats")["means"].count() == 3


def test_observation_pages(spark, tmp_path):
    page = {"results": [{"id": 1, "taxon": {"name": "T"}, "user": {"login": "u"}, "photos": [{"id": 5, "license_code": "CC0", "url": "h/square.jpg"}, {"id": 6, "license_code": None, "url": "h/square.jpg"}, {"id": 7, "license_code": "cc-by", "url": ""}]}, {"id": 2, "photos": []}]}
    (tmp_path / "o.json").write_text(json.dumps(page))
    got = U.photos(U.read_observations(spark, str(tmp_path / "o.json"))).collect()
    assert [(r.photo_id, r.licence, r.url, r.observer, r.place_guess) for r in got] == [(5, "cc0", "h/large.jpg", "u", "")]


def test_publish_is_idempotent(spark, tmp_path):
    sink = publish(str(tmp_path))
    sink(spark.range(3), 0)
    sink(spark.range(2), 0)
    sink(spark.range(1), 1)
    assert spark.read.parquet(str(tmp_path / "batch-*")).count() == 3


def test_text_functions(spark):
    rows = spark.createDataFrame([("root/a/leaf0003__sev-Low_aug2.jpg",), ("root/a/_copy.jpg",), ("img_0042.jpg",)], "p string")
    got = [(r.g, r.s) for r in rows.select(X.group_key(F.col("p")).alias("g"), X.severity(X.stem(F.col("p"))).alias("s")).collect()]
    assert got == [("root/a/leaf0003", "low"), ("root/a/_copy", "unknown"), ("./img_0042", "unknown")]
    names = spark.createDataFrame([("anthracnose",), ("ants",), ("Leaf Miner fly",), ("early_blight",), ("aphids",), ("Spodoptera larva x",)], "n string")
    got = names.select("n", X.looks_like_condition(F.col("n")).alias("c"), X.life_stage(F.col("n")).alias("l"), X.strip_stage(F.col("n")).alias("b")).collect()
    assert [r.c for r in got] == [True, False, False, True, False, False] and got[-1].l == "larva" and got[-1].b == "Spodoptera x"
