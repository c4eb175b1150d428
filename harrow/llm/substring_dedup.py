"""Substring deduplication with difference-cover anchors."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harrow.functions.ranking import running
from harrow.llm.common import cut, join_few, text_bytes
from harrow.llm.wordhash import Words, batches

#: A null id comes after all others.
NO_ID = np.iinfo(np.int64).max


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where a new run of equal keys begins, in sorted arrays."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    """Equal ranges of the hash, so that sorted hashes are sorted by bucket."""
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _ids(pdf: pd.DataFrame) -> np.ndarray:
    return pdf["id"].to_numpy(np.int64)


def _copies(pdf: pd.DataFrame, copied: pd.DataFrame) -> np.ndarray:
    """Which rows' texts a document with a smaller id has too. Ids that rows repeat with different texts are told apart by the text's md5."""
    known = set(copied["copy"])
    some = {x.partition(":")[0] for x in known}
    return np.array([str(i) in some and b is not None and f"{i}:{hashlib.md5(b).hexdigest()}" in known for i, b in zip(_ids(pdf).tolist(), pdf["body"])], bool)


def _without(pdf: pd.DataFrame, copied: pd.DataFrame) -> pd.DataFrame:
    return pdf[~_copies(pdf, copied)] if len(copied) and len(pdf) else pdf


def _join(blobs, kind) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), kind)


def _texts(pdf: pd.DataFrame) -> list[bytes]:
    return [t if t is not None else b"" for t in pdf["body"]]


def drop_repeated_spans(docs: DataFrame, id_col="doc_id", text_col="text", window=13, period=7, cover=(0, 1, 3), chunk_bytes=8_000_000) -> DataFrame:
    """Removes each word covered by a `window` of words that also starts in a document with a smaller id.

    Anchors are windows of window - period + 1 words at places that are, modulo period, in cover. As the differences of cover are all
    residues, two equal windows hold an equal anchor at the same offset. So: (1) each chunk of documents hashes its anchors, (2)
    anchors seen in two documents are found by hash, (3) windows around those anchors are extended to full width and hashed with 128 bits, (4)
    each such window gets the smallest id that holds it, (5) the documents with larger ids lose what it covers. Of equal texts only
    the one with the smallest id goes through this; the others lose all words if they have a window. Chunks are hashes of
    id and text, about chunk_bytes of text each; what a chunk sends of a hash is one value however often it occurs, so a passage or document
    that a third of the corpus repeats adds one value for each chunk. Windows are judged on the input, not on what is left.

    Result: (doc_id, n_words, n_removed, kept_text: the kept words joined by one space, removed: the removed word ranges as start, end, start, ...).
    Null texts have no words and an empty kept_text. Texts shorter than a window keep all. A null id counts as larger than all ids (the
    largest long too). Rows that repeat an id are judged as one document for "smaller", each keeps its own row. No rows give no rows; other columns are ignored.
    Ids of any type that sorts and can be cast to text and back will do; those that are not whole numbers are numbered in their order first, and joined with the texts.
    """
    width = window - period + 1
    if width < 1 or {(a - b) % period for a in cover for b in cover} != set(range(period)):
        raise ValueError("the cover's differences must be all residues, and the period at most the window")
    n = max(1, -(-text_bytes(docs, text_col) // chunk_bytes))
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("own"), F.col(text_col).cast("binary").alias("body"), F.pmod(F.xxhash64(id_col, text_col), F.lit(n)).alias("chunk"))
    if isinstance(kind, T.IntegralType):
        rows = rows.withColumn("id", F.col("own").cast("long"))
    else:
        rows = join_few(rows, running(rows.select("own").where("own is not null").distinct(), ["own"], id=F.lit(1)), "own", "left")
    rows = rows.select(F.coalesce("id", F.lit(NO_ID)).alias("id"), F.col("own").cast("string").alias("own"), "body", "chunk")
    covered = np.isin(np.arange(period), cover)

    def anchors(w: Words) -> np.ndarray:
        at = np.flatnonzero(covered[w.place() % period] & (w.left() >= width))
        return at[w.n[w.text[at]] >= window]

    def gather(pdf: pd.DataFrame, copied: pd.DataFrame) -> pd.DataFrame:
        pdf = _without(pdf, copied)
        texts, ids, found, owners = _texts(pdf), _ids(pdf), [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for a, b in batches(texts):
            w = Words(texts[a:b])
            at = anchors(w)
            found.append(w.windows(at, width))
            owners.append(ids[a:b][w.text[at]])
        h, who = np.concatenate(found), np.concatenate(owners)
        order = np.argsort(h, kind="stable")
        h, who = h[order], who[order]
        first = _runs(h)
        out = []
        if len(first):
            many = np.minimum.reduceat(who, first) != np.maximum.reduceat(who, first)
            h = h[first]
            at = _bucket(h, n)
            starts = _runs(at)
            for s, e in zip(starts, np.r_[starts[1:], len(at)]):
                out.append((at[s], pdf["chunk"].iloc[0], h[s:e][~many[s:e]].tobytes(), h[s:e][many[s:e]].tobytes()))
        return pd.DataFrame(out, columns=["bucket", "chunk", "one", "many"])

    def repeated(pdf: pd.DataFrame) -> pd.DataFrame:
        one, many = _join(pdf["one"], np.uint64), _join(pdf["many"], np.uint64)
        h = np.concatenate([one, many])
        chunk = np.concatenate([np.repeat(pdf["chunk"].to_numpy(), pdf[c].map(len) // 8) for c in ("one", "many")])
        sure = np.arange(len(h)) >= len(one)
        order = np.argsort(h, kind="stable")
        first = _runs(h[order])
        size = np.diff(np.r_[first, len(h)])
        keep = np.repeat((size > 1) | np.logical_or.reduceat(sure[order], first), size) if len(first) else np.zeros(0, bool)
        order = order[keep]
        return _by_chunk(chunk[order], h[order])

    def _by_chunk(chunk: np.ndarray, *values: np.ndarray) -> pd.DataFrame:
        order = np.argsort(chunk, kind="stable")
        chunk, values = chunk[order], [v[order] for v in values]
        starts = _runs(chunk)
        return pd.DataFrame([(chunk[s], *(v[s:e].tobytes() for v in values)) for s, e in zip(starts, np.r_[starts[1:], len(chunk)])], columns=["chunk", *(f"v{i}" for i in range(len(values)))])

    def extend(pdf: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        names = ["bucket", "chunk", "a", "b", "least", "several"]
        pdf = _without(pdf, known[known["copy"].notna()])
        hot = np.sort(_join(known["v0"].dropna(), np.uint64))
        if not len(pdf) or not len(hot):
            return pd.DataFrame([], columns=names)
        texts, ids, parts = _texts(pdf), _ids(pdf), []
        for i, j in batches(texts):
            w = Words(texts[i:j])
            at = anchors(w)
            h = w.windows(at, width)
            at = at[hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h]
            near = np.zeros(len(w.hash), bool)
            for k in range(period):
                p = at[at - w.first[w.text[at]] >= k] - k
                near[p] = True
            p = np.flatnonzero(near & (w.left() >= window))
            parts.append((w.windows(p, window, 1), w.windows(p, window, 2), ids[i:j][w.text[p]]))
        a, b, who = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((b, a))
        a, b, who = a[order], b[order], who[order]
        first = _runs(a, b)
        if not len(first):
            return pd.DataFrame([], columns=names)
        least, several = np.minimum.reduceat(who, first), np.minimum.reduceat(who, first) != np.maximum.reduceat(who, first)
        a, b = a[first], b[first]
        at = _bucket(a, n)
        starts = _runs(at)
        return pd.DataFrame([(at[s], pdf["chunk"].iloc[0], a[s:e].tobytes(), b[s:e].tobytes(), least[s:e].tobytes(), several[s:e].tobytes()) for s, e in zip(starts, np.r_[starts[1:], len(at)])], columns=names)

    def owners(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, least, several = _join(pdf["a"], np.uint64), _join(pdf["b"], np.uint64), _join(pdf["least"], np.int64), _join(pdf["several"], bool)
        chunk = np.repeat(pdf["chunk"].to_numpy(), pdf["a"].map(len) // 8)
        order = np.lexsort((b, a))
        a, b, least, several, chunk = a[order], b[order], least[order], several[order], chunk[order]
        first = _runs(a, b)
        size = np.diff(np.r_[first, len(a)])
        owner = np.repeat(np.minimum.reduceat(least, first), size)
        keep = (owner < least) | several  # else the chunk holds the first document only
        return _by_chunk(chunk[keep], a[keep], b[keep], owner[keep])

    def remove(pdf: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(pdf):
            texts, ids = _texts(pdf), _ids(pdf)
            own = [None if pd.isna(x) else x for x in pdf["own"]]
            copy = _copies(pdf, known[known["copy"].notna()])
            ha, hb, ho = (_join(known[c].dropna(), t) for c, t in (("v0", np.uint64), ("v1", np.uint64), ("v2", np.int64)))
            order = np.lexsort((hb, ha))
            ha, hb, ho = ha[order], hb[order], ho[order]
            for i, j in batches(texts):
                w = Words(texts[i:j])
                gone = np.zeros(len(w.hash) + 1, np.int64)
                if len(ha):
                    p = np.flatnonzero(w.left() >= window)
                    a = w.windows(p, window, 1)
                    k = np.searchsorted(ha, a)
                    hit = ha[np.minimum(k, len(ha) - 1)] == a
                    p, a, k = p[hit], a[hit], k[hit]
                    b = w.windows(p, window, 2)
                    live = np.ones(len(p), bool)
                    owner = np.full(len(p), NO_ID)
                    while live.any():  # equal first halves of different windows, if ever
                        same = live & (hb[np.minimum(k, len(hb) - 1)] == b)
                        owner[same] = ho[k[same]]
                        live &= ~same
                        k = k + live
                        live &= (k < len(ha)) & (ha[np.minimum(k, len(ha) - 1)] == a)
                    p = p[owner < ids[i:j][w.text[p]]]
                    np.add.at(gone, p, 1)
                    np.add.at(gone, p + window, -1)
                gone = np.cumsum(gone[:-1]) > 0
                for t in range(j - i):
                    g, words = gone[w.first[t]:w.last[t]], texts[i + t].split()
                    if copy[i + t] and len(g) >= window:
                        g = np.ones(len(g), bool)
                    spans: list[int] = []
                    if g.any():
                        spans = np.flatnonzero(np.diff(np.r_[False, g, False].view(np.int8))).tolist()
                        words = [x for x, drop in zip(words, g.tolist()) if not drop]
                    out.append((own[i + t], len(g), len(g) - len(words), b" ".join(words), spans))
        return pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept", "removed"])

    texts_ = rows.where(F.col("body").isNotNull()).select("id", "chunk", F.md5("body").alias("h"))
    first_ids = texts_.groupBy("h").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "least")
    copied = cut(join_few(texts_, first_ids, "h").where("id > least").select("chunk", F.concat(F.col("id").cast("string"), F.lit(":"), "h").alias("copy")).distinct())
    found = rows.groupBy("chunk").cogroup(copied.groupBy("chunk")).applyInPandas(gather, "bucket long, chunk long, one binary, many binary")
    hot = found.groupBy("bucket").applyInPandas(repeated, "chunk long, v0 binary")
    spans = rows.groupBy("chunk").cogroup(hot.unionByName(copied, True).groupBy("chunk")).applyInPandas(extend, "bucket long, chunk long, a binary, b binary, least binary, several binary")
    known = spans.groupBy("bucket").applyInPandas(owners, "chunk long, v0 binary, v1 binary, v2 binary")
    kept = rows.groupBy("chunk").cogroup(known.unionByName(copied, True).groupBy("chunk")).applyInPandas(remove, "doc_id string, n_words long, n_removed long, kept binary, removed array<int>")
    return kept.select(F.col("doc_id").cast(kind).alias("doc_id"), "n_words", "n_removed", F.col("kept").cast("string").alias("kept_text"), "removed")
