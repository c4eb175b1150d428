"""Each training-text operator against brute force on small fixtures, and its defined results in edge cases."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

from harrow.llm import chat_repair, language_id, quality
from harrow.llm.chat_repair import repair_roles
from harrow.llm.decontamination import contamination
from harrow.llm.line_dedup import drop_repeated_chunks, drop_repeated_runs
from harrow.llm.minhash_dedup import dart_minhash, near_duplicates, shingles
from harrow.llm.mixing import mix_sources, take_mix
from harrow.llm.substring_dedup import drop_repeated_spans
from harrow.llm.topk import as_integers, nra, top_k
from harrow.llm.warc import export_warc, read_archive, read_warc, write_archive
from harrow.llm.wordhash import Words, mix
from tests_llm_force import classes_by_force, targets_by_force

#: Documents with columns whose names the operators use for themselves.
DOCS = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()), ("size", T.StringType()), ("key", T.StringType()), ("h", T.StringType()), ("chunk", T.StringType()), ("rid", T.StringType()))])
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark, rows):
    """rows: (doc_id, text[, source, lang])."""
    full = [(r[0], r[1], r[3] if len(r) > 3 else None, r[2] if len(r) > 2 else None, len(r[1] or ""), "x", "y", "z", "c", "r") for r in rows]
    return spark.createDataFrame(full, DOCS)


def corpus(seed=0, n=60, vocabulary=400, copies=True):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(vocabulary)}"
    out = [[word() for _ in range(rng.randrange(0, 120))] for _ in range(n)]
    passage = [word() for _ in range(30)]
    for w in out[::4]:
        at = rng.randrange(len(w) + 1)
        w[at:at] = passage
    if copies:
        out += [list(w) for w in out[:6]]
        for w in [list(w) for w in out[:10]]:
            if w:
                w[rng.randrange(len(w))] = "edited"
            out.append(w)
    sep = lambda: rng.choice([" ", "  ", "\n", "\t"])
    rows = [(i, "".join(w + sep() for w in ws)) for i, ws in enumerate(out)]
    rng.shuffle(rows)
    return rows


EDGES = [(1000, None), (1001, ""), (1002, " \n\t "), (1003, "one"), (1004, "one"), (None, "null id " * 10), (1005, "null id " * 10)]


def test_words_hash_alike_wherever_they_stand():
    w = Words([b"a bb  a\n", b"", b"bb a"])
    assert w.n.tolist() == [3, 0, 2]
    assert w.hash[0] == w.hash[2] == w.hash[4] and w.hash[1] == w.hash[3] != w.hash[0]
    assert len(set(w.windows(np.array([0, 1, 3]), 2).tolist())) == 2  # "a bb", "bb a", "bb a"


# ---- 1
def test_near_duplicates_equal_brute_force(spark):
    rows = corpus(1)
    rng = random.Random(5)
    base = [f"b{i}" for i in range(150)]
    for i in range(40):  # a chain of edits: the ends differ by more than the threshold
        base = list(base)
        base[rng.randrange(150)] = f"e{i}"
        rows.append((500 + i, " ".join(base)))
    got = {r.doc_id: r.class_id for r in near_duplicates(docs_of(spark, rows)).collect()}
    assert got == classes_by_force(rows)


def test_near_duplicates_edges(spark):
    got = {r.doc_id: r.class_id for r in near_duplicates(docs_of(spark, EDGES)).collect()}
    assert got == {1000: 1000, 1001: 1001, 1002: 1002, 1003: 1003, 1004: 1003, None: 1005, 1005: 1005}  # a null id is classed by its text
    assert near_duplicates(docs_of(spark, [])).collect() == []
    same = near_duplicates(docs_of(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (2, "x y z u v w"), (2, "k l m n o p")])).collect()
    assert sorted((r.doc_id, r.class_id) for r in same) == [(1, 1), (1, 1), (2, 2), (2, 2)]


def test_dart_signatures_estimate_weighted_similarity():
    texts = [b" ".join([b"x%d" % i for i in range(200)] + [b"r"] * 50), b" ".join([b"x%d" % i for i in range(60, 260)] + [b"r"] * 20)]
    t, h, n = shingles(texts, 1)
    sig = dart_minhash(t, h, n, 2, 4000)
    assert abs((sig[0] == sig[1]).mean() - 160 / 310) < 0.04  # 140 and 20 in common of 250 + 220 - 160
    assert (dart_minhash(t, h, n, 2, 64) == dart_minhash(t, h, n, 2, 64)).all()


# ---- 2
def test_mix_meets_targets(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 60)), rng.choice(["b", "a", "é", "Z", None, "a", "a", "a"])) for i in range(3000)]
    got = mix_sources(docs_of(spark, rows)).collect()
    again = mix_sources(docs_of(spark, rows[::-1]).repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want = targets_by_force(sizes)
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(taken[s] == int(want[s] + 1e-6) for s in sizes) and len(got) == 3000


def test_mix_edges(spark):
    assert mix_sources(docs_of(spark, [])).collect() == []
    got = {r.doc_id: r for r in mix_sources(docs_of(spark, EDGES)).collect()}
    assert got[1000].size == got[1001].size == 0 and got[1000].taken == 0 and got[None].size == 20
    mixed = take_mix(docs_of(spark, [(1, "a b c d", "s"), (1, "a b c d", "s"), (2, "e f  g h", "t")])).collect()
    assert {"epoch", "taken", "size", "key"} <= set(mixed[0].asDict()) and all(len(r.text.split()) == r.taken and r.n_chars == len(r.text) for r in mixed)


def test_mix_takes_each_of_rows_that_share_an_id(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, None, 1, 2, i]), " ".join(f"w{rng.randrange(9)}" for _ in range(rng.randrange(1, 9))), rng.choice(["a", "b", "c"])) for i in range(400)]
    rows += [(None, "same text", "a")] * 50 + [(7, "same text", "a"), (7, "same text", "b"), (7, "same text", "b", "en")]
    sizes, taken, first = Counter(), Counter(), Counter()
    for r in rows:
        sizes[r[2]] += len(r[1].split())
    got = take_mix(docs_of(spark, rows)).collect()
    for r in got:
        assert len(r.text.split()) == r.taken
        taken[r.source] += r.taken
        if r.epoch == 0:
            first[r.doc_id, r.text, r.source, r.lang] += 1
    assert all(taken[s] == int(t + 1e-6) for s, t in targets_by_force(sizes).items())
    all_of = {s for s in sizes if taken[s] >= sizes[s]}
    want = Counter((r[0], r[1], r[2], r[3] if len(r) > 3 else None) for r in rows if r[2] in all_of)
    assert all_of and {k: n for k, n in first.items() if k[2] in all_of} == want


# ---- 3 and 5
def test_quality_learns_from_labels_and_scores_whole_texts(spark):
    rng = random.Random(2)
    good = lambda: " ".join(rng.choice(["field", "rain", "leaf", "soil", "root"]) for _ in range(rng.randrange(20, 300)))
    rows = [(i, good() if i % 3 else good()[:400] + " $$$ ### !!! " * 30) for i in range(400)]
    labels = spark.createDataFrame([(i, 1 if i % 3 else 0) for i in range(400)] + [(1, 0), (2, None), (None, 1)], "doc_id long, quality int")
    fitted = quality.fit(docs_of(spark, rows), labels)
    got = {r.doc_id: r for r in quality.score(docs_of(spark, rows + EDGES), fitted).collect()}
    assert np.mean([(got[i].score >= 0.7) == bool(i % 3) for i in range(400)]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values()) and got[1000].n_passages == 1
    long = " ".join(["soil"] * 20000) + " $$$ ###" * 2000
    assert quality.score(docs_of(spark, [(1, long)]), fitted).first().n_passages == -(-24000 // 64)
    assert quality.score(docs_of(spark, []), fitted).collect() == []
    none = quality.fit(docs_of(spark, []), labels)
    assert quality.score(docs_of(spark, [(1, "x")]), none).first().score == 0.5


def test_quality_learns_wording(spark):
    rng = random.Random(12)
    good, bad = ([f"{''.join(rng.choice('abcdefghij') for _ in range(5))}" for _ in range(40)] for _ in range(2))
    both = [f"{''.join(rng.choice('abcdefghij') for _ in range(5))}" for _ in range(200)]
    rows = [(i, " ".join(rng.choice((good if i % 2 else bad) if rng.random() < 0.2 else both) for _ in range(150))) for i in range(600)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(600)] + [(i, 0) for i in range(5000, 9000)], "doc_id long, quality int")
    fitted = quality.fit(docs_of(spark, rows), labels, most=400)
    from zlib import crc32
    got = {r.doc_id: r.score for r in quality.score(docs_of(spark, rows), fitted).collect()}
    hidden = [i for i in range(600) if crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(got[i] >= 0.5) == bool(i % 2) for i in hidden]) > 0.9


def test_quality_scores_equal_brute_force(spark):
    rng = random.Random(13)
    rows = corpus(13, n=30) + [(500, "Long. Words! " * 9000), (501, "A, b; (c)\n\n d"), *EDGES]
    labels = spark.createDataFrame([(i, rng.randrange(2)) for i in range(30)], "doc_id long, quality int")
    fitted = quality.fit(docs_of(spark, rows), labels)
    p = fitted.p

    def features(text, first, last):  # of the words first to last of a text
        found = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0d]+", text)]
        words = [text[a:b] for a, b in found]
        begin, end = (0 if first == 0 else found[first][0]), (found[last][0] if last < len(found) else len(text) + 1)
        kinds = [int(quality.KIND[b]) for b in text + b"\n"]
        shares, pairs, sums = np.zeros(quality.KINDS), np.zeros(quality.PAIRS), np.zeros(quality.WORDS)
        for i in range(begin, end):
            shares[kinds[i]] += 1
            if i + 1 < len(kinds):
                pairs[(kinds[i] * 31 + kinds[i + 1] * 7) % quality.PAIRS] += 1
        mine, n = words[first:last], len(words[first:last])
        often = Counter(words)
        long = np.array([len(w) for w in mine])
        for w in mine:
            h = int(mix(Words([w.translate(quality.PLAIN)]).hash)[0])
            sums[h % quality.WORDS] += -1 if h >> 40 & 1 else 1
        stats = [long.mean() / 10, long.std() / 10, len(set(mine)) / n, np.mean([quality.KIND[w[-1]] >= 6 for w in mine]), np.mean([quality.KIND[w[0]] == 2 for w in mine]), np.mean([often[w] >= 3 for w in mine])]
        return np.r_[np.sqrt(shares / (end - begin)), np.sqrt(pairs / (end - begin)), stats, sums / np.sqrt(n)]

    got = {(r.doc_id, r.n_passages): r.score for r in quality.score(docs_of(spark, rows), fitted).collect()}
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    for i, t in rows:
        text = (t or "").encode()
        n = len(SPACE.findall(t or ""))
        hs, ss = [], []
        for a in range(0, max(n, 1), 64):
            x = features(text, a, min(n, a + 64)) if n else np.zeros(quality.WIDTH)
            h = np.tanh(np.clip((x - fitted.mean) / fitted.scale, -6, 6) @ p["E"] + p["e"])
            hs.append(h)
            ss.append(p["u"] @ (np.tanh(h @ p["V"]) * sigmoid(h @ p["G"])))
        a = np.exp(np.array(ss) - max(ss))
        want = sigmoid(p["c"] @ ((a / a.sum()) @ np.array(hs)) + p["b"][0])
        assert got[i, len(hs)] == pytest.approx(want, abs=0.02)


def test_attention_gradient():
    rng = np.random.default_rng(0)
    owner, x, y = np.repeat(np.arange(6), [1, 2, 3, 1, 4, 2]), rng.normal(size=(13, quality.WIDTH)), np.array([0, 1, 0, 1, 1, 0.0])
    loss = lambda m: -np.mean(y * np.log(m.forward(owner, x, 6)["score"]) + (1 - y) * np.log(1 - m.forward(owner, x, 6)["score"]))
    m = quality.AttentionClassifier(hidden=4, gate=3)
    before = loss(m)
    m.fit(owner, x, y, rounds=200)
    assert loss(m) < 0.05 < before


def test_language_id(spark):
    rng = random.Random(4)
    vocab = {"aa": ["bana", "kalo", "mira", "tosa"], "bb": ["schtr", "wurzt", "krampf", "zwolf"]}
    rows = [(i, " ".join(rng.choice(vocab[k]) for _ in range(30)), "s", k) for i, k in enumerate(["aa", "bb"] * 150)]
    fitted = language_id.fit(docs_of(spark, rows), per_language=60, clusters=2)
    got = {r.doc_id: r for r in language_id.identify(docs_of(spark, rows + [r for r in EDGES] + [(2000, "123 !!!")]), fitted).collect()}
    assert all(got[i].lang_pred == k and 0 <= got[i].score <= 1 for i, _, _, k in rows)
    assert got[1000].lang_pred == got[1002].lang_pred == got[2000].lang_pred == "und" and got[1000].score == 0
    assert language_id.identify(docs_of(spark, []), fitted).collect() == []
    # scores by force: cosine with each centroid of the TF-IDF of a text's n-grams
    for i, t, _, k in rows[:20] + [(2001, "bana " * 50_000, "s", "aa")]:
        folded, n = t.encode().translate(language_id.FOLD) + b"   ", Counter()
        for j in range(len(t) + 1):
            a, b, c = folded[j:j + 3]
            if a != 32 or b != 32:
                n[((a << 8 | b) * 2654435761 % 2**32) >> 19] += 1
                n[(((a << 16 | b << 8 | c) * 2246822519 + 374761393) % 2**32) >> 19] += 1
        v = np.zeros(language_id.DIM)
        v[list(n)] = [np.log1p(x) * fitted.idf[j] for j, x in n.items()]
        cosine = fitted.vectors @ v / np.linalg.norm(v)
        r = got.get(i) or language_id.identify(docs_of(spark, [(i, t)]), fitted).first()
        assert r.score == pytest.approx(min(1, cosine.max()), abs=1e-4) and fitted.languages[fitted.owner[cosine.argmax()]] == r.lang_pred == k
    # a text that most rows of a language share takes one place in its sample
    copies = docs_of(spark, [(i, "kalo mira", "s", "aa") for i in range(900)] + rows)
    assert {r.lang_pred for r in language_id.identify(docs_of(spark, rows), language_id.fit(copies, per_language=40, clusters=2)).collect()} == {"aa", "bb"}
    assert language_id.identify(docs_of(spark, [(1, "abc")]), language_id.fit(docs_of(spark, []))).first().lang_pred == "und"


# ---- 4
def least_cost(roles, costs=chat_repair.Costs()):
    """Brute force: all ways to give each turn a role and to put empty turns before it."""
    code = {"system": 1, "user": 2, "assistant": 3}
    best = {0: 0.0}
    for r in roles:
        nxt = {}
        for s, c in best.items():
            for to in (1, 2, 3):
                relabel = 0 if code.get(r) == to else costs.relabel if r in code else costs.name
                for put in ((), (1,), (2,), (3,)):
                    way = [s, *put, to]
                    if all(p in chat_repair.LEGAL for p in zip(way, way[1:])) and 1 not in put:
                        nxt[to] = min(nxt.get(to, 1e9), c + relabel + costs.insert * len(put))
                if s == to:
                    nxt[to] = min(nxt.get(to, 1e9), c + relabel + costs.merge)
        best = nxt
    return min(c + costs.tables()[2][s] for s, c in best.items())


def cost_of(rows, costs=chat_repair.Costs()):
    change = lambda r: ("relabel" in r.action) * (costs.relabel if (r.role_in or "").lower() in ("user", "human", "assistant", "system") else costs.name) + ("merge" in r.action) * costs.merge
    return sum(change(r) + costs.insert * (r.inserted is not None) + costs.insert * len((r.closing or "").split(",")) * (r.closing is not None) for r in rows)


@pytest.mark.parametrize(("part", "costs"), [(512, chat_repair.Costs()), (3, chat_repair.Costs()), (4, chat_repair.Costs(relabel=1.5, name=1.0, merge=2.0, insert=1.0))])
def test_chat_repair_is_legal_and_of_least_cost(spark, part, costs):
    rng = random.Random(part)
    convs = {i: [rng.choice(["user", "assistant", "system", "Human", "tool", None]) for _ in range(rng.randrange(1, 30))] for i in range(60)}
    rows = [(i, t, r, f"text {i} {t} <|im_end|>") for i, rs in convs.items() for t, r in enumerate(rs)]
    rng.shuffle(rows)
    out = repair_roles(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), part=part, costs=costs).collect()
    assert len(out) == len(rows)
    for i, roles in convs.items():
        mine = sorted((r for r in out if r.conv_id == i), key=lambda r: r.seq)
        assert [r.turn for r in mine] == list(range(len(roles)))
        assert cost_of(mine, costs) == least_cost([(r or "").lower().replace("human", "user") for r in roles], costs)
        text = "".join(r.piece for r in mine)
        found = re.findall(r"<\|im_start\|>(\w+)\n", text)
        assert re.fullmatch(r"(system )?(user assistant )+", " ".join(found) + " ") and text.count("<|im_end|>") == len(found)


def test_chat_repair_edges(spark):
    schema = "conv_id long, turn long, role string, text string, c string, seq string"
    assert repair_roles(spark.createDataFrame([], schema)).collect() == []
    out = repair_roles(spark.createDataFrame([(None, None, None, None, "c", "s"), (1, 0, "user", "a", "c", "s"), (1, 0, "user", "a", "c", "s")], schema)).collect()
    assert len(out) == 3 and {r.action for r in out if r.conv_id == 1} == {"keep", "merge"}
    # turns without a number, turns numbered by time, repeated rows and a very long text
    rows = [(1, None, "user", "x" * 200_000)] * 40 + [(2, 10**9 * t, ("user", "assistant")[t % 2], "t") for t in range(60)] + [(2, 5, "owner", "tie"), (2, 5, "owner", "tie")]
    out = repair_roles(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), part=7, aliases={"system": "system", "user": "user", "assistant": "assistant", "owner": "assistant"}).collect()
    one, two = ([r for r in sorted(out, key=lambda r: r.seq) if r.conv_id == c] for c in (1, 2))
    assert [r.seq for r in one] == list(range(40)) and [r.action for r in one] == ["keep"] + ["merge"] * 39 and one[-1].closing == "assistant"
    assert len(two) == 62 and [r.turn for r in two] == sorted(r.turn for r in two) and all(r.role == "assistant" for r in two if r.role_in == "owner")


# ---- 6
def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    vec = [(i, (rng.normal(size=8) / 3).astype(np.float32).tolist()) for i in range(700)] + [(700 + i, [0.5] * 8) for i in range(60)]
    vec += [(900, None), (901, [float("nan")] * 8), (902, [None] * 8), (903, [float("inf")] * 8), (904, [0.25] * 3), (None, [0.1] * 8), (750, [0.5] * 8)]
    df = spark.createDataFrame(vec, "vec_id long, embedding array<float>")
    v = as_integers(df)
    got = top_k(v, v.where("vec_id % 50 = 0"), block_rows=100, query_rows=4, list_rows=40, seed_rows=60).collect()
    ints = {i: np.r_[np.floor(256 * np.array(x, float)), np.zeros(8 - len(x))].astype(int) for i, x in vec if i is not None and x and None not in x and np.isfinite(x).all()}
    want = {(q, n + 1, i, s) for q in ints if q % 50 == 0 for n, (s, i) in enumerate(sorted(((int(ints[q] @ ints[i]), i) for i in ints if i != q), key=lambda x: (-x[0], x[1]))[:5])}
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == want
    assert top_k(v.limit(0), v).collect() == []
    few = v.where("vec_id in (0, 1, 2)")
    assert len(top_k(few, few).collect()) == 6
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in top_k(v, v.where("vec_id % 50 = 0"), seed_rows=0).collect()} == want


def test_lists_are_read_only_as_far_as_needed():
    rng = np.random.default_rng(8)
    rows, queries = (np.floor(256 * rng.normal(size=(n, 6))) for n in (4000, 20))
    scores = queries @ rows.T
    floor = np.sort(scores, axis=1)[:, -5]
    q, c, score, read = nra(np.arange(4000), rows, np.arange(-20, 0), queries, 5, floor)
    assert (read < 0.6).all() and all(set(score[q == i]) == set(np.sort(scores[i])[-5:]) for i in range(20))
    assert len(nra(np.arange(4000), rows, np.arange(-20, 0), queries, 5, floor + 10**9)[0]) == 0


# ---- 7
def test_line_chunks(spark):
    rng = random.Random(7)
    lines = [f"line {i}" for i in range(400)]
    block = [f"shared {i}" for i in range(20)]
    rows = [(i, "\n".join(rng.sample(lines, 4) + (block if i % 2 else []) + rng.sample(lines, 4))) for i in range(20)]
    got = {r.doc_id: r for r in drop_repeated_chunks(docs_of(spark, rows), carry=("key",)).collect()}
    first = min(i for i, t in rows if "shared 0" in t)
    for i, t in rows:
        left = got[i].kept_text.split("\n")
        assert got[i].n_lines == t.count("\n") + 1 == len(left) + got[i].n_removed and got[i].key == "y"
        assert i != first or left == t.split("\n")
        if "shared 0" in t:
            assert sum("shared" in x for x in left) == 20 if i == first else sum("shared" in x for x in left) < 14
    edge = {r.doc_id: r for r in drop_repeated_chunks(docs_of(spark, EDGES + [(1, "a\nb\nc\nd"), (1, "a\nb\nc\nd")])).collect()}
    assert edge[1000].kept_text is None and edge[1001].kept_text == "" and edge[1001].n_lines == 1 and edge[1].n_removed == 0
    # by force: chunks cut where 31 * hash of the line before + hash is 0 modulo 3, of two lines or more, seen before
    rows = rows + [(100, rows[3][1]), (101, "same\n" * 30), (102, "same\n" * 30), (103, "long " * 50_000 + "\nb\nc")]
    got, seen = {r.doc_id: r for r in drop_repeated_chunks(docs_of(spark, rows)).collect()}, set()
    for i, t in sorted(rows):
        lines, left = t.split("\n"), []
        h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
        starts = [j for j in range(len(lines)) if j == 0 or (h[j - 1] * 31 + h[j]) % 3 == 0]
        for a, b in zip(starts, [*starts[1:], len(lines)]):
            chunk = tuple(lines[a:b])
            left += [] if len(chunk) > 1 and chunk in seen else chunk
            seen.add(chunk)
        assert (got[i].n_removed, got[i].kept_text) == (len(lines) - len(left), "\n".join(left))
    assert drop_repeated_chunks(docs_of(spark, [])).collect() == []


def test_broadcasts_are_bounded_by_bytes(spark):
    from harrow.llm.common import is_small, join_few

    few = spark.range(20).selectExpr("id", "repeat('x', 1000) AS wide", "array(1, 2) AS a", "map('k', 1) AS m", "CAST(NULL AS STRING) AS none")
    assert is_small(few) and not is_small(few, most_bytes=10_000) and not is_small(few, most_rows=5) and is_small(few.limit(0))
    plan = lambda **how: join_few(spark.range(100), few, "id", **how)._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan() and "broadcast" not in plan(broadcast_bytes=10_000)


def test_line_runs_equal_brute_force(spark):
    rng = random.Random(17)
    own = iter(range(10**6))
    passages = [[f"p{n} {i}" for i in range(n)] for n in (2, 3, 4, 5, 6)]
    rows = []
    for i in range(60):
        foreign = lambda: [f"own {next(own)}" for _ in range(rng.randrange(4))]
        rows.append((i, "\n".join(foreign() + passages[i % 5] + foreign() + (passages[rng.randrange(1, 5)][1:] if i % 3 else ["alone"]) + foreign())))
    rows += [(70, "r\nr\nr\nr"), (71, rows[0][1]), (72, "only"), (73, "only"), (74, "x\nx\nx"), (75, "c\n\n\nd"), (76, "e\n\n \t\nf"), (77, "\n\n\n"), (78, "d\nx\nx"), (79, "\n\nd\nx")]
    rng.shuffle(rows)
    got = {r.doc_id: r for r in drop_repeated_runs(docs_of(spark, rows), carry=("key",)).collect()}
    seen = {}
    for i, t in sorted(rows):
        lines, gone = t.split("\n"), set()
        for j, pair in enumerate(zip(lines, lines[1:])):
            if "".join(pair).strip(" \t\n\v\f\r"):
                d, k = seen.setdefault(pair, (i, j))
                gone |= {j, j + 1} if d != i or j >= k + 2 else set()
        left = [x for j, x in enumerate(lines) if j not in gone]
        assert (got[i].n_lines, got[i].n_removed, got[i].kept_text, got[i].key) == (len(lines), len(gone), "\n".join(left), "y")
        assert i < 5 or i >= 60 or not set(passages[i % 5]) & set(left)
    edge = {r.doc_id: r for r in drop_repeated_runs(docs_of(spark, EDGES + [(1, "a\nb\nc\nd"), (1, "a\nb\nc\nd"), (None, "c\nd")])).collect()}
    assert edge[1000].kept_text is None and edge[1001].kept_text == "" and edge[1001].n_lines == 1 and edge[1].n_removed == 2
    assert drop_repeated_runs(docs_of(spark, [])).collect() == []


# ---- 8
def test_warc_query_on_urls_and_ids_of_all_kinds(spark, tmp_path):
    from harrow.llm.queries import QUERIES

    pages = [("b", "http://e/ü/é", "<b>hi</b>"), ("c", "http://plain", "<b>hi</b>"), ("日本", "http://日本", "zz"), ("", "u", "x"), ("x", "v", "x"), ("é%/ 1", "w", "y"), ("f", "w", "y"), (None, "http://ü", None), (" ", "s", "blank id")]
    spark.createDataFrame(pages, "page_id string, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: tuple(r)[1:] for r in QUERIES["op8_warc_archive"](spark, str(tmp_path)).collect()}
    import base64

    for i, _, html in pages:
        body = (html or "").encode()
        owner = min(j for j, _, h in pages if j is not None and (h or "") == (html or "")) if i is not None else None
        assert got[i] == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if i == owner else "revisit", None if i == owner else owner), i


def test_warc_round_trip(spark, tmp_path):
    rows = [(3, "http://a", "<p>x</p>"), (1, "http://b", "<p>x</p>"), (2, None, None), (5, "u\r\nv", ""), (4, "http://c", "é" * 50), (None, "n", "<p>x</p>")]
    rows += [(6, "http://é/ x", "long " * 200_000)]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, payload string")
    write_archive(pages, str(tmp_path / "w"))
    got = {r.page_id: r for r in read_archive(spark, str(tmp_path / "w")).collect()}
    assert spark.read.parquet(str(tmp_path / "w/payloads")).count() == 4
    import base64
    for i, url, html in rows:
        body = (html or "").encode()
        r = got[i]
        assert bytes(r.payload) == body and r.payload_bytes == len(body) and r.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
        first = min(j for j, _, h in rows if (h or "") == (html or "") and j is not None)
        assert (r.record_type, r.refers_to) == (("response", None) if i == first else ("revisit", first))
        record = bytes(r.record)
        head, _, rest = record.partition(b"\r\n\r\n")
        length = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert len(rest) == length + 4 and rest.endswith(b"\r\n\r\n") and head.startswith(b"WARC/1.1\r\n")
    export_warc(read_archive(spark, str(tmp_path / "w")), str(tmp_path / "files"))
    whole = b"".join(p.read_bytes() for p in sorted((tmp_path / "files").glob("part-*")))
    found = []
    while whole:  # by the lengths that the headers give
        head, _, whole = whole.partition(b"\r\n\r\n")
        n = int(re.search(rb"Content-Length: (\d+)", head)[1])
        found.append(head + b"\r\n\r\n" + whole[:n + 4])
        whole = whole[n + 4:]
    assert sorted(found) == sorted(bytes(r.record) for r in got.values())
    read = read_warc(spark, str(tmp_path / "files")).collect()
    assert sorted(r.header.encode() + bytes(r.content) + b"\r\n\r\n" for r in read) == sorted(found)
    write_archive(pages, str(tmp_path / "x"), least_bytes=60)
    assert {r.page_id for r in read_archive(spark, str(tmp_path / "x"), False).collect() if r.record_type == "revisit"} == set()
    raw = [("a>b", bytes(range(256))), ("a%b", b"WARC/1.1\r\n\r\nno record"), ("null", bytes(range(256))), ("a b", b"")]  # bytes that are no text, ids that need an encoding
    write_archive(spark.createDataFrame([(i, None, b) for i, b in raw], "page_id string, url string, html binary"), str(tmp_path / "b"))
    back = read_archive(spark, str(tmp_path / "b"))
    assert {(r.page_id, bytes(r.payload), r.refers_to) for r in back.collect()} == {(i, b, "a>b" if i == "null" else None) for i, b in raw}
    export_warc(back, str(tmp_path / "bytes"))
    assert sorted(r.header.encode() + bytes(r.content) + b"\r\n\r\n" for r in read_warc(spark, str(tmp_path / "bytes")).collect()) == sorted(bytes(r.record) for r in back.collect())
    write_archive(pages.limit(0), str(tmp_path / "y"))
    assert read_archive(spark, str(tmp_path / "y")).collect() == []


# ---- 9
@pytest.mark.parametrize("chunk_bytes", [8_000_000, 700])
def test_substring_dedup_equals_brute_force(spark, chunk_bytes):
    rows = corpus(9, vocabulary=6) + EDGES
    got = {r.doc_id: r for r in drop_repeated_spans(docs_of(spark, rows), chunk_bytes=chunk_bytes).collect()}
    first = {}
    words = {i: SPACE.findall(t or "") for i, t in rows}
    rank = lambda i: float("inf") if i is None else i
    for i, w in words.items():
        for j in range(len(w) - 12):
            k = tuple(w[j:j + 13])
            first[k] = min(first.get(k, float("inf")), rank(i))
    for i, w in words.items():
        gone = {x for j in range(len(w) - 12) if first[tuple(w[j:j + 13])] < rank(i) for x in range(j, j + 13)}
        assert (got[i].n_words, got[i].n_removed, got[i].kept_text) == (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
        assert {x for a, b in zip(got[i].removed[::2], got[i].removed[1::2]) for x in range(a, b)} == gone
    # ids that are text, repeated rows, and no ids at all
    named = [(f"{i:05d}" if i is not None else None, t) for i, t in rows]
    text_ids = {r.doc_id: r for r in drop_repeated_spans(spark.createDataFrame(named, "doc_id string, text string"), chunk_bytes=chunk_bytes).collect()}
    assert all((text_ids[a].n_removed, text_ids[a].kept_text) == (got[b].n_removed, got[b].kept_text) for (a, _), (b, _) in zip(named, rows))
    passage = " ".join(f"p{i}" for i in range(20))
    odd = drop_repeated_spans(docs_of(spark, [(None, passage), (None, passage), (None, f"x {passage}"), (5, passage), (5, f"{passage} y"), (7, passage), (7, passage), (9, "w " * 50_000)]), chunk_bytes=chunk_bytes).collect()
    assert sorted((r.doc_id or 99, r.n_words, r.n_removed) for r in odd) == [(5, 20, 0), (5, 21, 0), (7, 20, 20), (7, 20, 20), (9, 50_000, 0), (99, 20, 20), (99, 20, 20), (99, 21, 20)]
    assert drop_repeated_spans(docs_of(spark, [])).collect() == []
    with pytest.raises(ValueError):
        drop_repeated_spans(docs_of(spark, rows), cover=(0, 1, 2))


# ---- 10
def test_decontamination_equals_brute_force(spark):
    rng = random.Random(10)
    pool = [f"t{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(pool) for _ in range(n))) for i, n in enumerate([25, 14, 10, 9, 3, 0, 12, 30])] + [(8, None)]
    rows = [(i, " ".join(rng.choice(pool) for _ in range(60))) for i in range(30)]
    for k in range(12):
        i, t = rows[k]
        w = items[k % 8][1].split()
        rows[k] = (i, t + "! " + " ".join(w).upper() + " ÉT " + " ".join(w[3:]))
    rows += EDGES
    bench = spark.createDataFrame([(*x, "e") for x in items], "item_id long, text string, rid string")
    got = {r.doc_id: r for r in contamination(docs_of(spark, rows), bench).collect()}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower))
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[j:j + n]), set()).add(i)
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for g, who in windows.items():
            for j in range(len(w) - len(g) + 1):
                if tuple(w[j:j + len(g)]) == g:
                    hit |= set(range(j, j + len(g)))
                    found |= who
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r["items"], r.contaminated) == (len(w), len(hit), len(found), sorted(map(str, found)), bool(hit))
    long = "é " * 40_000 + items[0][1]
    odd = contamination(docs_of(spark, [(1, long), (1, items[1][1]), (1, items[1][1]), (1, "no")]), bench).collect()
    assert sorted((r.n_words, r.contaminated) for r in odd) == [(1, False), (14, True), (14, True), (40_025, True)]
    shared = spark.createDataFrame([(i, f"{items[0][1]} own{i}") for i in range(50)], "item_id long, text string")
    assert {(r.n_items, r.n_hit) for r in contamination(docs_of(spark, [(i, items[0][1]) for i in range(50)]), shared).collect()} == {(50, 25)}
    assert contamination(docs_of(spark, []), bench).collect() == []
    assert {r.contaminated for r in contamination(docs_of(spark, rows), bench.limit(0)).collect()} == {False}


def test_quality_learns_from_so_many_rows_at_most(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality.AttentionClassifier, "fit", lambda self, owner, x, y: seen.append(len(y)) or self)
    docs = [(0, f"text number {i}") for i in range(500)] + [(i, "other words") for i in range(1, 30)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    quality.fit(docs_of(spark, docs), labels, most=20)
    assert seen == [20]


def test_line_runs_go_through_content_defined_chunks(spark, monkeypatch):
    from harrow.llm import line_dedup

    asked, found = [], []
    chunks, repeated = line_dedup.chunks, line_dedup._repeated_chunks
    monkeypatch.setattr(line_dedup, "chunks", lambda text, divisor, with_text: asked.append(divisor) or chunks(text, divisor, with_text))
    monkeypatch.setattr(line_dedup, "_repeated_chunks", lambda rows, divisor: found.append(repeated(rows, divisor)) or found[0])
    passage = "\n".join(f"line {i}" for i in range(40))
    got = {r.doc_id: r for r in drop_repeated_runs(docs_of(spark, [(1, "a\n" + passage), (2, "b\n" + passage + "\nc"), (3, "\n\n\n\n\n"), (4, "x\n\n\n\n\n\n")])).collect()}
    assert asked == [3, 3] and sum(r.n for r in found[0].where("doc_id = 2").collect()) > 20
    assert (got[2].kept_text, got[2].n_removed, got[1].n_removed, got[3].n_removed, got[4].n_removed) == ("b\nc", 40, 0, 0, 0)
