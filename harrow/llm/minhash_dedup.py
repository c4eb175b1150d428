"""Near-duplicate classes with DartMinHash signatures over weighted word shingles."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.functions.storage import tasks_for
from harrow.llm.common import cut, small_batches
from harrow.llm.wordhash import U, Words, batches, mix, rolling

#: A broadcast side has at most so many rows of an id and a digest; more are shuffled.
BROADCAST_ROWS = 300_000
#: The rank axis is cut at LEAST_RANK and its doublings, the weight axis at 1 and its doublings.
LEAST_RANK = 2.0**-14
UNIT = 2.0**-32


def shingles(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, count) of each text's different k-word shingles, by text and hash. A text of fewer than k words, but not none, is one shingle."""
    w = Words(texts)
    at = np.flatnonzero(w.left() >= k)
    short = np.flatnonzero((w.n > 0) & (w.n < k))
    text = np.r_[w.text[at], short]
    h = np.r_[rolling(w.hash, at, at + k, 0xD1342543DE82EF95), rolling(w.hash, w.first[short], w.last[short], 0xD1342543DE82EF95)]
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.r_[True, (text[1:] != text[:-1]) | (h[1:] != h[:-1])] if len(h) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return text[first], h[first], np.diff(np.r_[first, len(h)])


def _poisson(mean: float) -> np.ndarray:
    """The distribution function, as far as 64 bits tell it from 1."""
    top = int(mean + 12 * math.sqrt(mean) + 30)
    logs = np.arange(top) * math.log(mean) - mean - np.r_[0, np.cumsum(np.log(np.arange(1, top)))]
    return np.cumsum(np.exp(logs))


def dart_minhash(text: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, size: int) -> np.ndarray:
    """An (n, size) array of signatures of n weighted sets; equal coordinates have the sets' weighted Jaccard similarity as probability.

    Darts fall on the plane of each element (weight up, rank across) at a rate of `size` a unit of area, each for one coordinate, at places
    that depend on the element only. The plane is cut into regions by doublings of weight and rank; a hash of element and region gives the
    number of its darts, and hashes of those their places. A set throws the darts of its own regions only: up to each element's weight, and up to a rank
    by which each coordinate should have one. Each coordinate keeps its earliest dart; sets with an empty one throw again to twice the rank.
    """
    out = np.zeros((n, size), U)
    total = np.bincount(text, weight, n)
    limit = np.divide(math.log(size) + 2, total, out=np.zeros(n), where=total > 0)
    open_ = total > 0
    while open_.any():
        mine = open_[text]
        t, e, x = text[mine], element[mine], weight[mine]
        far = limit[t]
        ids, places, ranks = [], [], []
        for i in range(64):
            lo, hi = (0 if i == 0 else LEAST_RANK * 2.0 ** (i - 1)), LEAST_RANK * 2.0**i
            on = far > lo
            if not on.any():
                break
            for j in range(64):
                wlo, whi = (0 if j == 0 else 2.0 ** (j - 1)), 2.0**j
                at = np.flatnonzero(on & (x > wlo))
                if not len(at):
                    break
                cdf = _poisson((hi - lo) * (whi - wlo) * size)
                h = mix(e[at] ^ mix(np.array([i * 64 + j + 1], U)))
                u = (h >> U(11)).astype(float) * 2.0**-53
                some = u >= cdf[0]
                at, h, u = at[some], h[some], u[some]
                many = np.searchsorted(cdf, u, "right")
                k = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                at, a = np.repeat(at, many), mix(np.repeat(h, many) + (k.astype(U) + U(1)) * U(0x9E3779B97F4A7C15))
                rank, up = lo + (a >> U(32)) * UNIT * (hi - lo), wlo + (a & U(0xFFFFFFFF)) * UNIT * (whi - wlo)
                keep = (rank <= far[at]) & (up <= x[at])
                at, a, rank = at[keep], a[keep], rank[keep]
                b = mix(a ^ U(0x2545F4914F6CDD1D))
                ids.append(b)
                places.append(t[at] * size + (b % U(size)).astype(np.int64))
                ranks.append(rank)
        b, place = np.concatenate(ids), np.concatenate(places)
        order = np.argsort(-np.concatenate(ranks), kind="stable")  # the earliest is written last
        got = np.zeros(n * size, bool)
        got[place] = True
        full = got.reshape(n, size).all(1) & open_
        sig = np.zeros(n * size, U)
        sig[place[order]] = b[order]
        out[full] = sig.reshape(n, size)[full]
        open_ &= ~full
        limit[open_] *= 2
    return out


def _similarity(a: bytes, b: bytes) -> float:
    """Weighted Jaccard similarity of two blobs of (hash, count) columns."""
    (ha, na), (hb, nb) = (np.frombuffer(x, U).reshape(2, -1) for x in (a, b))
    _, i, j = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    common = int(np.minimum(na[i], nb[j]).sum())
    return common / (int(na.sum()) + int(nb.sum()) - common)


def components(edges: DataFrame) -> DataFrame:
    """(v, label): the smallest id that each id of an edge (a, b) is connected with. Labels are passed along edges and then to their labels' labels, until none changes; few edges take few tasks."""
    both = cut(edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b").distinct())
    tasks = tasks_for(both)
    both = both.coalesce(tasks)
    few = F.broadcast if tasks == 1 else lambda rows: rows
    labels = cut(both.groupBy("a").agg(F.min(F.least("a", "b")).alias("label")).withColumnRenamed("a", "v"))
    while True:
        labels = labels.coalesce(tasks)
        near = both.join(few(labels.withColumnRenamed("v", "b")), "b").groupBy("a").agg(F.min("label").alias("near")).withColumnRenamed("a", "v")
        step = labels.join(few(near), "v").select("v", F.col("label").alias("old"), F.least("label", "near").alias("to"))
        heads = labels.select(F.col("v").alias("to"), F.col("label").alias("beyond"))
        labels = cut(step.join(few(heads), "to", "left").select("v", "old", F.least("to", F.coalesce("beyond", "to")).alias("label")))
        if labels.where("old <> label").isEmpty():
            return labels.select("v", "label")
        labels = labels.select("v", "label")


def near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text", k=5, least=0.8, bands=28, rows=5) -> DataFrame:
    """(doc_id, class_id, text_md5, class_md5, shingles) for each row: class_id and class_md5 name the first document, by id and digest, of those that links of weighted Jaccard similarity >= least connect.

    Elements are k-word shingles (words between ASCII white space, unchanged), weighted by how often a text has them. Equal texts are one
    node from the start. Signatures of bands * rows coordinates are banded: at a similarity of 0.8, 28 bands of 5 miss a
    pair with a probability of 0.00002. In each bucket all nodes are compared with the bucket's smallest, its hub, on all shingles. That gives classes. What is
    left are pairs that share a bucket and not a class: they share the bucket's hub, and all members of that hub's buckets that are not in its class are compared
    with all others there, on all shingles, in blocks that return links only. So no candidate is lost, and pairs inside a class are never compared or listed. That step's
    work is the product of a group's members outside the class and its members.

    Null texts and texts without words are in classes of their own, of their own id. Rows that repeat an id are classed each by its own text, rows that repeat id and text alike.
    A null id comes last: a class whose ids are all null has a null class_id. No rows give no rows. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("body")).withColumn("h", F.md5("body"))

    def sign(parts):
        for pdf in parts:
            texts = [b"" if t is None else t for t in pdf["body"]]
            for a, b in batches(texts, 1_000_000):
                t, e, x = shingles(texts[a:b], k)
                n = b - a
                sig = dart_minhash(t, e, x, n, bands * rows).reshape(n, bands, rows)
                key = np.broadcast_to(np.arange(1, bands + 1, dtype=U) * U(0x9E3779B97F4A7C15), (n, bands))
                for i in range(rows):
                    key = mix(key * U(0xD1342543DE82EF95) + sig[:, :, i])
                total = np.bincount(t, x, n).astype(np.int64)
                keys = key.view(np.int64)
                yield pd.DataFrame({"id": pdf["id"].iloc[a:b], "h": pdf["h"].iloc[a:b], "total": total, "keys": [keys[i] if total[i] else keys[i][:0] for i in range(n)]})

    signed = cut(text.mapInPandas(sign, f"id {text.schema['id'].dataType.simpleString()}, h string, total long, keys array<long>"))
    texts = signed.where("total > 0").groupBy("h").agg(F.min("id").alias("least"), F.first("total").alias("total"), F.first("keys").alias("keys"))
    texts = cut(texts.withColumn("node", F.monotonically_increasing_id()))
    keyed = texts.select("node", "total", F.explode("keys").alias("key"))
    buckets = keyed.groupBy("key").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "hub")
    members = cut(keyed.join(buckets, "key").select("hub", "node", "total").distinct())
    sets = _sets(text, texts.join(members.select("node").distinct(), "node").select("node", "h", "least"), k)
    edges = cut(_compare(members.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")), sets).where(F.col("s") >= least).select("a", "b"))
    edges = edges.coalesce(tasks_for(edges))
    labels = components(edges)
    more = cut(_between_classes(members, labels, sets, least))
    if not more.isEmpty():
        labels = components(edges.union(more))
    own = texts.select("h", "node", "least").join(labels.withColumnRenamed("v", "node"), "node", "left").select("h", "least", F.coalesce("label", "node").alias("label"))
    first = own.groupBy("label").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "h")).alias("first"))
    classes = own.join(first, "label").select("h", F.col("first.least").alias("class_id"), F.col("first.h").alias("class_md5"))
    rows_ = signed.select("id", "h", "total").join(classes, "h", "left")
    return rows_.select(F.col("id").alias("doc_id"), F.when(F.col("class_md5").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.col("h").alias("text_md5"), F.coalesce("class_md5", "h").alias("class_md5"), F.col("total").alias("shingles"))


def _between_classes(members: DataFrame, labels: DataFrame, sets: DataFrame, least: float, block_size=500_000) -> DataFrame:
    """Links (a, b) between classes among the members (hub, node, total) of each hub's buckets.

    A stray is a member that is not in its hub's class. Strays are compared with all members of the same hub on all shingles. Strays are hashed into blocks of about
    block_size shingles of their own, all members into others; a pair of blocks is one task's group, which returns no more links than join its classes: at most one for each
    class. A member is sent once for each block of strays, and a stray once for each block of members.
    """
    named = cut(members.join(labels.withColumnRenamed("v", "node"), "node", "left").select("hub", "node", "total", F.coalesce("label", "node").alias("label")))
    by_class = named.groupBy("hub", "label").agg(F.sum("total").alias("t"), F.max(F.col("node") == F.col("hub")).alias("own"))
    blocks = lambda total: F.ceil(F.sum(total) / block_size).cast("int")
    groups = by_class.groupBy("hub").agg(F.min(F.when(F.col("own"), F.col("label"))).alias("hub_label"), blocks(F.when(~F.col("own"), F.col("t"))).alias("ni"), blocks("t").alias("nj")).where("ni > 0")
    named = cut(named.join(groups, "hub").where("node <> hub"))
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    block = lambda n: F.pmod(F.hash("node"), n)
    strays = named.where("label <> hub_label").select("hub", block(F.col("ni")).alias("i"), every(F.col("nj")).alias("j"), "node", "label").join(sets, "node")
    others = named.select("hub", every(F.col("ni")).alias("i"), block(F.col("nj")).alias("j"), "node", "label").join(sets, "node")
    others = others.select(*[F.col(c).alias(c) for c in ("hub", "i", "j", "node", "label", "blob")])  # columns of their own

    def links(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        root: dict = {}

        def find(v):
            while v in root:
                v = root[v]
            return v

        if len(a) and len(b):
            each = [np.frombuffer(x, U).reshape(2, -1) for x in b["blob"]]
            size = np.array([int(x[1].sum()) for x in each])
            order = np.argsort(size, kind="stable")
            each, size, classes, ids = [each[i] for i in order], size[order], b["label"].to_numpy()[order], b["node"].to_numpy()[order]
            known, local = np.unique(np.concatenate([x[0] for x in each]), return_inverse=True)
            count = np.concatenate([x[1] for x in each]).astype(np.int64)
            starts = np.cumsum([0] + [x.shape[1] for x in each])
            for node, label, blob in zip(a["node"], a["label"], a["blob"]):
                h, n = np.frombuffer(blob, U).reshape(2, -1)
                total = int(n.sum())
                lo, hi = np.searchsorted(size, [least * total - 1, total / least + 1])  # others' sizes differ too much
                if lo == hi:
                    continue
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                mine = np.zeros(len(known), np.int64)
                mine[at[known[at] == h]] = n[known[at] == h]
                p, q = starts[lo], starts[hi]
                both = np.add.reduceat(np.minimum(mine[local[p:q]], count[p:q]), starts[lo:hi] - p)
                found = (both >= least * (total + size[lo:hi] - both)) & (classes[lo:hi] != label)
                for of, first in zip(*np.unique(classes[lo:hi][found], return_index=True)):  # one link for each class that is not joined yet
                    x, y = find(label), find(of)
                    if x != y:
                        root[x] = y
                        out.append((node, ids[lo:hi][found][first]))
        return pd.DataFrame(out, columns=["a", "b"])

    return strays.groupBy("hub", "i", "j").cogroup(others.groupBy("hub", "i", "j")).applyInPandas(links, "a long, b long")


def _sets(text: DataFrame, needed: DataFrame, k: int) -> DataFrame:
    """(node, blob): the shingles, as (hash, count) columns, of the texts (id, body, h) that `needed` (node, h, least: id) names."""
    def blobs(parts):
        for pdf in parts:
            texts = list(pdf["body"])
            for i, j in batches(texts, 1_000_000):
                t, h, x = shingles(texts[i:j], k)
                stop = np.searchsorted(t, np.arange(1, j - i + 1))
                begin = np.r_[0, stop[:-1]]
                yield pd.DataFrame({"node": pdf["node"].iloc[i:j].to_numpy(), "blob": [h[p:q].tobytes() + x[p:q].astype(U).tobytes() for p, q in zip(begin, stop)]})

    needed = cut(needed.withColumnRenamed("h", "of"))
    few = F.broadcast(needed) if needed.count() <= BROADCAST_ROWS else needed
    found = text.join(few, (F.col("h") == F.col("of")) & F.col("id").eqNullSafe(F.col("least"))).select("node", "body")
    return cut(found.mapInPandas(blobs, "node long, blob binary").groupBy("node").agg(F.first("blob").alias("blob")))


def _compare(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) with their similarity s."""
    def compare(parts):
        for pdf in parts:
            yield pd.DataFrame({"a": pdf["a"], "b": pdf["b"], "s": [_similarity(x, y) for x, y in zip(pdf["x"], pdf["y"])]})

    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("blob").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("blob").alias("y")), "b")
    return both.mapInPandas(compare, "a long, b long, s double")
