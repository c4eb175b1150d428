"""Tokenizer alignment and the hash table of pairs against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from harrow.llm.alignment import FIGURES, Aligned, Tokenizers, align, count_pairs, pair_table, tokenizer_paths  # noqa: E402
from harrow.llm.perfect_hash import PerfectHash, build, shard_of  # noqa: E402

SCHEMA = "doc_id long, text string, key string, pair string, n_a int, shard long"


@pytest.fixture(scope="module")
def tok():
    return Tokenizers(*tokenizer_paths())


def one(text, tok):
    """(a ids, b ids, links, groups) of a whole text, token by token, or None."""
    if not text:
        return None
    a, b = tok.a.encode(" " + text, add_special_tokens=False).ids, tok.b.encode(text)
    parts = [[tok.bytes_a[i] for i in a], [tok.bytes_b[i] for i in b]]
    if any(b"".join(p) != (" " + text).encode() for p in parts):
        return None
    spans = []
    for p in parts:
        ends = np.cumsum([len(x) for x in p]).tolist()
        spans.append(list(zip([0, *ends[:-1]], ends)))
    links, j = [], 0
    for i, (s, e) in enumerate(spans[0]):
        while spans[1][j][1] <= s:
            j += 1
        k = j
        while k < len(b) and spans[1][k][0] < e:
            links.append((a[i], b[k]))
            k += 1
    groups, x, y = [], [], []
    shared = {e for _, e in spans[0]} & {e for _, e in spans[1]}
    at = [0, 0]
    for end in sorted(shared):
        group = []
        for side, ids in enumerate((a, b)):
            begin = at[side]
            while at[side] < len(ids) and spans[side][at[side]][1] <= end:
                at[side] += 1
            group.append(",".join(map(str, ids[begin:at[side]])))
        groups.append("|".join(group))
    return a, b, links, groups


def by_force(texts, tok):
    docs = [one(t, tok) for t in texts]
    counts = Counter(p for d in docs if d for p in set(d[2]))
    top = {}
    for (a, _), n in counts.items():
        top[a] = max(top.get(a, 0), n)
    none = (0, 0, 0, 0, 0, 0, "")
    return [none if d is None else (len(d[0]), len(d[1]), len(d[3]), len(d[2]), sum(counts[p] == top[p[0]] for p in d[2]), sum(counts[p] for p in d[2]), hashlib.sha256(";".join(d[3]).encode()).hexdigest()) for d in docs], counts


def texts(n=60, seed=3):
    rng = random.Random(seed)
    words = [rng.choice(["the", "a", "model", "Übung", "naïve", "日本語", "🙂🙃", "x1y2", "don't", "12345", "<|endoftext|>", "</s>", "<0x41>", "…", "é", " ", "\x00", "zz" * 9]) + rng.choice(["", ".", ",", "?!"]) for _ in range(80)]
    glue = [" ", " ", " ", "  ", "\n", "\n\n ", "\t", "\r\n", "", "   ", "\x1c ", "　"]
    out = ["".join(rng.choice(words) + rng.choice(glue) for _ in range(rng.randrange(1, 60))) for _ in range(n)]
    return [*out, *out[:7], "", None, " ", "   ", "\n", " lead", "trail ", "with ▁ mark", "▁", "x" * 5000, "word " * 3000, "﻿bom", "a b c"]


def test_equals_brute_force(spark, tok):
    rows = texts()
    docs = spark.createDataFrame([(None if i == 5 else i // 2 if i < 6 else i, t, "k", "p", 1, 2) for i, t in enumerate(rows)], SCHEMA).repartition(5)
    want, _ = by_force(rows, tok)
    expect = sorted((str(None if i == 5 else i // 2 if i < 6 else i), *w) for i, w in enumerate(want))
    for options in ({}, {"broadcast_bytes": 0}, {"block_bytes": 300, "keys_per_shard": 40}):
        got = align(docs, **options)
        assert got.columns == ["doc_id", *FIGURES, "groups_sha256"]
        assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == expect
    assert sum(w[0] == 0 for w in want) >= 4


def test_no_documents(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for broadcast_bytes in (0, 1 << 20):
        assert align(docs, broadcast_bytes=broadcast_bytes).collect() == []
    none = spark.createDataFrame([(1, None, "k", "p", 1, 2), (2, "", "k", "p", 1, 2)], SCHEMA)
    assert [tuple(r) for r in align(none).orderBy("doc_id").collect()] == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
    broken = spark.sql("SELECT 1L AS doc_id, cast(x'ff41' AS string) AS text")
    assert [tuple(r)[1:] for r in align(broken).collect()] == [(0, 0, 0, 0, 0, 0, "")]


def test_counts_are_added_over_many_tasks(spark, tok):
    rows = texts(40, 8)
    docs = spark.createDataFrame([(i, t, "k", "p", 1, 2) for i, t in enumerate(rows)], SCHEMA).repartition(11)
    _, counts = by_force(rows, tok)
    table = pair_table(count_pairs(docs, most_pairs=50), keys_per_shard=30, fan_in=2).collect()
    got = {}
    for r in table:
        keys, n = np.frombuffer(r["keys"], np.int64), np.frombuffer(r["counts"], np.int64)
        assert len(keys) == len(n)
        got |= {(k >> 32, k & 0xFFFFFFFF): c for k, c in zip(keys.tolist(), n.tolist())}
    assert got == counts and sum(len(r["keys"]) for r in table) == 8 * len(counts)


def test_perfect_hash():
    keys = np.random.default_rng(2).integers(0, 1 << 62, 20_000)
    keys = np.unique(keys)
    shard = shard_of(keys, 7)
    whole = PerfectHash([build(keys[shard == s]) for s in range(7)])
    slots = whole.slots(keys)
    assert sorted(slots.tolist()) == list(range(len(keys)))
    assert PerfectHash([build(keys[:0])]).slots(keys[:3]).tolist() == [-1] * 3 and PerfectHash([]).slots(keys[:2]).tolist() == [-1, -1]
    others = whole.slots(keys + 1)
    assert ((others >= -1) & (others < len(keys))).all()


def test_parts_give_what_whole_texts_give(tok):
    rows = [t for t in texts(200, 11) if t]
    cut, whole = Aligned(rows, tok), [one(t, tok) for t in rows]
    assert cut.group_texts() == [";".join(w[3]) if w else "" for w in whole]
