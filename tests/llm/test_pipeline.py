"""Each stage of the corpus pipeline, on what the stage before kept, against brute force."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from harrow.llm import quality
from tests_llm_force import classes_by_force, targets_by_force

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
tokens = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(11)
    folder = tmp_path_factory.mktemp("sf")
    words = [f"{a}{b}" for a in ("so", "ra", "le", "fi", "to", "ma") for b in ("il", "in", "af", "eld", "ota", "ize", "ck", "nt")]
    text = lambda n: "\n".join(" ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(12)) for _ in range(n))
    items = [(i, text(2)) for i in range(6)]
    shared = text(14)
    rows = []
    for i in range(240):
        body = text(rng.randrange(3, 9))
        if i % 12 == 5:
            body = re.sub(r" ", "$$$ ### ", body)
        if i % 15 == 7:
            body += "\n" + items[i % 6][1].replace("\n", " ").upper()
        if i % 10 == 3:
            body += "\n" + shared + "\n" + text(1)
        rows.append((i, body, "en", rng.choice(["a", "b", "c", "c", "c", None]), len(body)))
    for i in range(20):  # near and exact copies
        _, body, lang, source, _ = rows[i]
        body = body.replace(body.split()[3], "edited", 1) if i % 2 else body
        rows.append((300 + i, body, lang, source, len(body)))
    rows += [(900, None, "en", "a", None), (901, "", None, "a", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 12 != 5), 0) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    return str(folder), dict(items)


def test_stages(spark, tables, tmp_path):
    folder, items = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        rows = after.collect()
        seen[name] = len(rows)
        if name != "mixing":
            assert after.columns == columns and len({r.doc_id for r in rows}) == len(rows)
        if name == "quality":
            fitted = quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
            good = {r.doc_id for r in quality.score(docs, fitted).collect() if r.score >= 0.7}
            assert {r.doc_id for r in rows} == good and not [i for i in good if i < 240 and i % 12 == 5] and len(good) >= 220
        if name == "line_dedup":
            for r in rows:
                lines, left = (before[r.doc_id].text or "").split("\n"), (r.text or "").split("\n")
                assert Counter(left) - Counter(lines) == Counter() and (r.text != before[r.doc_id].text or r.n_chars == before[r.doc_id].n_chars)
            first = {}
            for i in sorted(before):
                for x in (before[i].text or "").split("\n"):
                    first.setdefault(x, i)
            kept = {r.doc_id: (r.text or "").split("\n") for r in rows}
            assert all(x in kept[i] for x, i in first.items()), "the first of each line stays"
        if name == "near_dedup":
            want = classes_by_force([(i, r.text) for i, r in before.items()])
            assert {r.doc_id for r in rows} == {i for i, c in want.items() if i == c}
        if name == "decontamination":
            windows = {tuple(w[j:j + 10]) for w in map(tokens, items.values()) for j in range(len(w) - 9)}
            dirty = {i for i, r in before.items() if any(tuple(w[j:j + 10]) in windows for w in [tokens(r.text)] for j in range(len(w) - 9))}
            assert dirty and {r.doc_id for r in rows} == set(before) - dirty
        if name == "mixing":
            sizes, taken = Counter(), Counter()
            for r in before.values():
                sizes[r.source] += len((r.text or "").split())
            for r in rows:
                taken[r.source] += r.taken
                assert len(r.text.split()) == r.taken
            assert all(taken[s] == int(t + 1e-6) for s, t in targets_by_force(sizes).items())
        docs = after
    assert seen["quality"] > seen["near_dedup"] > seen["decontamination"]


def test_run(spark, tables):
    out = corpus_pipeline.run(spark, tables[0])
    assert {"doc_id", "text", "epoch", "taken"} <= set(out.columns) and out.count() > 100


def test_stages_on_nulls_repeats_clashing_columns_and_nothing(spark, tables, tmp_path):
    folder, _ = tables
    plain = spark.read.parquet(f"{folder}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "a b c d e f g", None, None, 13), (0, "twice " * 30, "en", "a", 180), (0, "twice " * 30, "en", "a", 180), (950, "word " * 30000, "en", "b", 150000)], plain.schema)
    clash = {c: F.lit("x") for c in ("size", "key", "h", "rid", "chunk", "words", "score", "taken", "epoch", "class_id", "id", "body", "__row", "row", "row_", "__mix_row", "__mix_n", "_before", "_key", "copy", "shingles", "first")} | {"map": F.create_map(F.lit("k"), F.lit(1)), "maps": F.array(F.create_map(F.lit(1), F.lit(None).cast("string")))}
    for name, docs in (("empty", plain.limit(0)), ("odd", plain.limit(60).union(odd).withColumns(clash))):
        kept = Counter()
        for stage, f in corpus_pipeline.STAGES:
            before = kept
            f(spark, docs, folder).write.parquet(str(tmp_path / name / stage))
            after = spark.read.parquet(str(tmp_path / name / stage))
            assert set(docs.columns) <= set(after.columns)
            assert name == "empty" or {r["row"] for r in after.select("row").collect()} == {"x"} and {r["__mix_row"] for r in after.select("__mix_row").collect()} == {"x"}
            if stage != "mixing":  # of rows that share an id or have none, those with texts of their own stay
                kept = Counter((r.doc_id, r.text) for r in after.where("doc_id is null or doc_id = 0").collect() if r.text is None or r.text.startswith(("a b", "twice")))
                assert kept[None, None] == before[None, None] or stage == "quality"
                assert kept[0, "twice " * 30] <= (1 if stage in ("near_dedup", "decontamination") else 2)
            docs = after
        assert (docs.count() == 0) == (name == "empty")
