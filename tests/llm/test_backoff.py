"""Language-model scores against plain dictionaries of counts, and the automaton's own properties."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from harrow.llm.backoff import Grams, automaton, numbered, score, traverse

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
SCHEMA = "doc_id long, text string, chunk string, key int, score string"


def is_held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def by_force(rows, order):
    docs = [(i, [*SPACE.findall((t or "").translate(LOWER)), "</s>"]) for i, t in rows]
    grams = [Counter() for _ in range(order)]
    contexts = [Counter() for _ in range(order)]
    for i, w in docs:
        if not is_held_out(i):
            padded = ["<s>"] * (order - 1) + w
            for at in range(order - 1, len(padded)):
                for k in range(order):
                    grams[k][tuple(padded[at - k:at + 1])] += 1
                    contexts[k][tuple(padded[at - k:at])] += 1
    n, v = sum(grams[0].values()), len(grams[0])
    weight = [(sum(c == 1 for c in g.values()) + 0.5) / (sum(g.values()) + 1) for g in grams]

    def p(gram):
        if len(gram) == 1:
            return (grams[0][gram] + 0.5) / (n + 0.5 * (v + 1))
        k, c = len(gram) - 1, contexts[len(gram) - 1][gram[:-1]]
        return p(gram[1:]) if not c else (1 - weight[k]) * grams[k][gram] / c + weight[k] * p(gram[1:])

    out = []
    for i, w in docs:
        padded = ["<s>"] * (order - 1) + w
        logs = [math.log10(p(tuple(padded[at:at + order]))) for at in range(len(w))]
        out.append((i, is_held_out(i), len(w), sum(grams[0][(x,)] > 0 for x in w), n, sum(math.log10(p((x,))) for x in w), sum(logs)))
    return out


def rows_of(seed, n=80):
    rng = random.Random(seed)
    text = lambda: "".join(rng.choice("a b c Dd e f gg h É ß 日本 x,y z.".split()) + rng.choice([" ", "\n", "  ", "\t", " "]) for _ in range(rng.randrange(0, 40)))
    rows = [(i, text()) for i in range(n)]
    return [*rows, *[(n + i, t) for i, (_, t) in enumerate(rows[:9])], (n + 20, None), (n + 21, ""), (n + 22, " \n"), (None, "a b c"), (3, "b new words here"), (3, rows[3][1]), (n + 23, "long " * 4000), (n + 24, "x" * 30_000)]


@pytest.mark.parametrize("order,options", [(1, {}), (2, {}), (3, {"chunk_bytes": 700, "bucket_bytes": 900}), (4, {"chunk_bytes": 5000})])
def test_equals_brute_force(spark, order, options):
    rows = rows_of(order)
    got = score(spark.createDataFrame([(i, t, "c", 1, "s") for i, t in rows], SCHEMA).repartition(3), order=order, **options)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    got, want = sorted(map(tuple, got.collect()), key=key), sorted(by_force(rows, order), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(g[5:] == pytest.approx(w[5:], rel=1e-9) for g, w in zip(got, want))
    if order == 1:
        assert all(r[5] == pytest.approx(r[6], rel=1e-9) for r in got)


def test_nothing_to_learn_from(spark):
    assert score(spark.createDataFrame([], SCHEMA)).collect() == []
    held = [i for i in range(60) if is_held_out(i)]
    got = score(spark.createDataFrame([(i, "a b", "c", 1, "s") for i in held], SCHEMA)).collect()
    assert [tuple(r)[1:] for r in got] == [(True, 3, 0, 0, 0.0, 0.0)] * len(held)


def test_probabilities_add_up_to_one():
    """In each state: the arcs of all known tokens and of one unknown."""
    texts = [b"a b a c", b"b a", b"", b"a a b"]
    words = ["a", "b", "c", "unknown", None]
    order = 3
    base = Grams(texts, order)
    tables = []
    for h in base.levels:
        found, at = numbered(h)
        tables.append(dict(zip(found.tolist(), np.bincount(at).tolist())))
    tokens, types = len(base.levels[0]), len(tables[0])
    for context in ([], ["a"], ["b"], ["a", "b"], ["c"], ["unknown"], ["a", "unknown"], ["b", "a"], ["unknown", "a"]):
        total = 0.0
        for w in words:
            g = Grams([" ".join([*context, *([w] if w else [])]).encode()], order)
            counts = [np.array([t.get(x, 0) for x in h.tolist()]) for t, h in zip(tables, g.levels)]
            arcs, there, fails = automaton(g, counts, len(texts), tokens, types, [1.0, 0.4, 0.7])
            at = len(context) + 1
            whole = lambda n: traverse([a[:n].tolist() for a in arcs], [a[:n].tolist() for a in there], (counts[0] > 0)[:n].tolist(), fails, order - 1)  # noqa: B023, E731
            total += 10 ** (whole(at) - whole(at - 1))
        assert total == pytest.approx(1, abs=1e-12), context


def test_long_texts_are_hashed_in_pieces():
    text = ("word " * 50 + "y" * 300 + "\n").encode() * 20
    whole, parts = Grams([text, b"a b"], 3), Grams([text, b"a b"], 3, piece_bytes=64)
    assert all((a == b).all() for a, b in zip(whole.levels, parts.levels)) and (whole.last == parts.last).all()
