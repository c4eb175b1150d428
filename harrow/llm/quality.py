"""Document quality by attention-based multiple-instance learning over passages."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.llm.common import cut, held_out, small_batches
from harrow.llm.wordhash import Words, batches, mix

#: Bytes by kind: each mark of ASCII its own; letters by case, digits, white space, line feeds, other bytes one each.
KIND = np.zeros(256, np.int64)
KIND[97:123], KIND[65:91], KIND[48:58], KIND[10], KIND[128:] = 1, 2, 3, 4, 5
_marks = [c for c in range(33, 127) if not chr(c).isalnum()]
KIND[_marks] = np.arange(6, 6 + len(_marks))
#: Capitals in lower case and marks as one sign, so that words stay words.
PLAIN = bytes((c | 32) if 65 <= c <= 90 else 46 if c in _marks else c for c in range(256))
KINDS, PAIRS, STATS, WORDS = 6 + len(_marks), 64, 6, 128
WIDTH = KINDS + PAIRS + STATS + WORDS


def passages(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """(text of each passage, its features). A passage is up to `words` words and what stands between them; a text without words is one passage of zeros.

    Features: shares of each kind of byte, of hashed pairs of kinds, and six of words: length, its spread, share of different words in the passage, share of
    words that end in a mark, share of words that begin with a capital, share of words that the text repeats at least three times; and the words themselves, in lower case and
    without marks, each hashed to one of 128 sums that it adds to or takes from.
    """
    w = Words(texts)
    count = np.maximum(1, -(-w.n // words))
    begin = np.cumsum(count) - count
    owner = np.repeat(np.arange(len(texts)), count)
    total = len(owner)
    joined = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = (joined == 32) | ((joined >= 9) & (joined <= 13))
    edges = np.flatnonzero(np.diff(np.r_[True, space].view(np.int8)))
    starts, ends = edges[0::2], edges[1::2]
    of_word = begin[w.text] + w.place() // words
    if len(of_word):  # a byte is in the passage of the word before it; what comes before the first word is in the first word's
        of_byte = of_word[np.maximum(np.searchsorted(starts, np.arange(len(joined)), "right") - 1, 0)]
    else:
        of_byte = np.zeros(len(joined), np.int64)
    kind = KIND[joined]
    shares = np.bincount(of_byte * KINDS + kind, minlength=total * KINDS).reshape(total, KINDS).astype(np.float32)
    pair = (kind[:-1] * 31 + kind[1:] * 7) % PAIRS
    pairs = np.bincount(of_byte[:-1] * PAIRS + pair, minlength=total * PAIRS).reshape(total, PAIRS).astype(np.float32)
    size = np.maximum(shares.sum(1, keepdims=True), 1)
    n = np.maximum(np.bincount(of_word, minlength=total), 1)
    mean = lambda x: np.bincount(of_word, x, total) / n
    long = (ends - starts).astype(float)
    _, code, often = np.unique(w.hash + w.text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), return_inverse=True, return_counts=True)
    different = np.bincount(np.unique(of_word * (len(often) + 1) + code) // (len(often) + 1), minlength=total) / n
    length = mean(long)
    stats = np.stack([length / 10, np.sqrt(np.maximum(mean(long**2) - length**2, 0)) / 10, different, mean(KIND[joined[ends - 1]] >= 6), mean(KIND[joined[starts]] == 2), mean(often[code] >= 3)], 1)
    plain = mix(Words([t.translate(PLAIN) for t in texts]).hash)
    sign = 1.0 - 2.0 * ((plain >> np.uint64(40)) & np.uint64(1)).astype(float)
    bags = np.bincount(of_word * WORDS + (plain & np.uint64(WORDS - 1)).astype(np.int64), sign, total * WORDS).reshape(total, WORDS) / np.sqrt(n)[:, None]
    found = np.concatenate([np.sqrt(shares / size), np.sqrt(pairs / size), stats, bags], 1).astype(np.float32)
    found[np.repeat(w.n == 0, count)] = 0
    return owner, found


class AttentionClassifier:
    """h = tanh(E x), attention by softmax of u . (tanh(V h) * sigmoid(G h)) over a document's passages, score = sigmoid(c . (sum of attention * h) + b)."""

    def __init__(self, hidden=24, gate=12, seed=7):
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.mean, self.scale = np.zeros(WIDTH, np.float32), np.ones(WIDTH, np.float32)
        self.p = {"E": draw(WIDTH, hidden), "e": np.zeros(hidden, np.float32), "V": draw(hidden, gate), "G": draw(hidden, gate), "u": draw(gate), "c": draw(hidden), "b": np.zeros(1, np.float32)}

    def forward(self, owner: np.ndarray, x: np.ndarray, n: int) -> dict:
        p = self.p
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        h = np.tanh(x @ p["E"] + p["e"])
        v, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["G"])))
        s = (v * g) @ p["u"]
        top = np.full(n, -np.inf)
        np.maximum.at(top, owner, s)
        a = np.exp(s - top[owner])
        a /= np.bincount(owner, a, n)[owner]
        z = np.stack([np.bincount(owner, a * h[:, k], n) for k in range(h.shape[1])], 1)
        return {"x": x, "h": h, "v": v, "g": g, "a": a, "z": z, "score": 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["b"], -30, 30)))}

    def fit(self, owner: np.ndarray, x: np.ndarray, y: np.ndarray, rounds=300, rate=0.02, decay=1e-3) -> AttentionClassifier:
        """Full-batch Adam on the documents' labels; passages have none of their own."""
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-3)
        n = len(y)
        m, s = {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}
        for i in range(1, rounds + 1):
            f, p = self.forward(owner, x, n), self.p
            d = (f["score"] - y) / n
            dz = d[:, None] * p["c"]
            da = (f["h"] * dz[owner]).sum(1)
            ds = f["a"] * (da - np.bincount(owner, f["a"] * da, n)[owner])
            dv, dg = ds[:, None] * p["u"] * f["g"] * (1 - f["v"] ** 2), ds[:, None] * p["u"] * f["v"] * f["g"] * (1 - f["g"])
            dh = f["a"][:, None] * dz[owner] + dv @ p["V"].T + dg @ p["G"].T
            de = (dh * (1 - f["h"] ** 2)).astype(np.float32)
            grads = {"E": f["x"].T @ de, "e": de.sum(0), "V": f["h"].T @ dv, "G": f["h"].T @ dg, "u": (f["v"] * f["g"]).T @ ds, "c": f["z"].T @ d, "b": np.array([d.sum()])}
            for k, g in grads.items():
                g = g.astype(np.float32) + np.float32(decay * (k not in ("e", "b"))) * p[k]
                m[k], s[k] = 0.9 * m[k] + 0.1 * g, 0.999 * s[k] + 0.001 * g * g
                p[k] = p[k] - np.float32(rate) * (m[k] / np.float32(1 - 0.9**i)) / (np.sqrt(s[k] / np.float32(1 - 0.999**i)) + np.float32(1e-8))
        return self


def fit(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="quality", most=2000, most_passages=40, passage_words=64) -> AttentionClassifier:
    """Learns from at most `most` labelled documents (those with the least hashes of their id), of rows that are not held out, and of at most most_passages passages, evenly spread, of each.

    Ids with several different labels, null labels, null ids and labels without a document take no part. The chosen ids, at most `most` rows, are broadcast; their passages' features
    are collected, so at most most * most_passages rows of WIDTH numbers: of rows that repeat an id, the text with the least hash is learned from.
    With no labelled document, or labels of one kind only, every score is that kind's share (0.5 for none).
    """
    small_batches(docs.sparkSession)
    agreed = labels.where(~held_out(id_col) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("y"), F.max(label_col).alias("_y")).where("y = _y")
    there = docs.select(F.col(id_col).alias("id")).where("id is not null")
    chosen = agreed.join(there, "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(most).select("id", F.col("y").cast("double").alias("y"))
    bags = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("body")).join(F.broadcast(cut(chosen)), "id")
    bags = bags.groupBy("id", "y").agg(F.min_by("body", F.xxhash64("body")).alias("body"))

    def encode(parts):
        for pdf in parts:
            texts = [b"" if t is None else t for t in pdf["body"]]
            for a, b in batches(texts, 500_000):
                owner, x = passages(texts[a:b], passage_words)
                stop = np.searchsorted(owner, np.arange(1, b - a + 1))
                yield pd.DataFrame({"y": pdf["y"].iloc[a:b].to_numpy(), "x": [x[np.unique(np.linspace(p, q - 1, min(q - p, most_passages)).astype(int))].tobytes() for p, q in zip(np.r_[0, stop[:-1]], stop)]})

    got = bags.select("body", "y", "id").mapInPandas(encode, "y double, x binary").toPandas()
    got = got.sort_values(["x", "y"], ignore_index=True)  # the order in which tasks end must not matter
    fitted = AttentionClassifier()
    y = got["y"].to_numpy(float)
    if len(set(y)) < 2:
        fitted.p["c"][:] = 0
        fitted.p["b"][:] = (30.0 if y[0] else -30.0) if len(y) else 0.0
        return fitted
    x = [np.frombuffer(b, np.float32).reshape(-1, WIDTH) for b in got["x"]]
    return fitted.fit(np.repeat(np.arange(len(x)), [len(b) for b in x]), np.concatenate(x), y.astype(np.float32))


def score(docs: DataFrame, fitted: AttentionClassifier, id_col="doc_id", text_col="text", passage_words=64) -> DataFrame:
    """(doc_id, score, n_passages, top_passage, top_weight): each whole text's score, and the passage (from 0) that attention weighs most.

    Only the text is an input. Null and wordless texts are one passage of zeros and have a score too. Repeated rows get equal results; other columns are
    ignored; no rows give no rows.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("body"))

    def predict(parts):
        for pdf in parts:
            texts = [b"" if t is None else t for t in pdf["body"]]
            for a, b in batches(texts, 500_000):
                owner, x = passages(texts[a:b], passage_words)
                f = fitted.forward(owner, x, b - a)
                first = np.searchsorted(owner, np.arange(b - a))
                order = np.lexsort((np.arange(len(owner)), -f["a"], owner))
                top = order[np.searchsorted(owner[order], np.arange(b - a))]
                yield pd.DataFrame({"doc_id": pdf["doc_id"].iloc[a:b], "score": f["score"], "n_passages": np.bincount(owner, minlength=b - a), "top_passage": top - first, "top_weight": f["a"][top]})

    return rows.mapInPandas(predict, f"doc_id {docs.schema[id_col].dataType.simpleString()}, score double, n_passages long, top_passage long, top_weight double")
