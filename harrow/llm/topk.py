"""Exact top-k inner products by no-random-access aggregation over sorted lists, in blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harrow.llm.common import cut


def as_integers(vectors: DataFrame, id_col="vec_id", vector_col="embedding", scale=256) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component. Rows with a null id, a null vector, or a null or non-finite component take no part."""
    x = F.col(vector_col)
    sound = F.col(id_col).isNotNull() & x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    return vectors.where(F.coalesce(sound, F.lit(False))).select(F.col(id_col).alias("vec_id"), F.transform(x, lambda e: F.floor(e.cast("double") * F.lit(float(scale))).cast("long")).alias("v"))


def _matrix(vectors, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


#: Lists are read to multiples of this share of their length.
STEP = 1 / 16


def nra(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query position, candidate position, score) of rows that may be among each query's k best, at most k and never one that scores under its floor, ties to the smaller id; and the share of the lists
    that each query read. floor[j] is a score that k rows known elsewhere reach (-inf for none). A row of the query's own id is left out.

    Each dimension's values are a list, sorted; a positive weight reads it from its high end and a negative one from its low end. All lists are read
    in turn to the same depth, and never at random. The last values read bound what a row that is in none of them can reach: no query can stop before that bound is under
    its k-th score, so bounds of single rows begin at that depth. There, a row's upper bound is what was read of it plus the last values of the other lists, its lower bound takes the
    far ends of those. Rows whose upper bound is under the k-th best lower bound, or under floor, are out. A query stops when few rows are left, and those are resolved in full; else it
    reads on. At full depth the bounds are the scores.
    """
    n, width = rows.shape
    order = np.argsort(rows, axis=0, kind="stable")
    lists = np.take_along_axis(rows, order, 0)
    col = np.arange(width)[None, :]
    plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
    depths = np.unique(np.maximum(1, np.ceil(np.arange(1, round(1 / STEP) + 1) * STEP * n).astype(int)))
    unread = np.stack([plus @ lists[n - d] + minus @ lists[d - 1] for d in depths])
    start = np.where((unread < floor).any(0), (unread < floor).argmax(0), 0)
    read, out = np.zeros(len(queries)), []
    open_ = np.arange(len(queries))
    for i, depth in enumerate(depths):
        last = depth == n
        here = open_[(start[open_] <= i) & ((start[open_] - i) % 2 == 0) | last]
        if not len(here):
            continue
        high, low = order[n - depth:], order[:depth]
        bounds = []
        for top, bottom in ((lists[n - depth], lists[depth - 1]), (lists[0], lists[n - 1])):  # the upper bound's, then the lower's
            a, b = np.broadcast_to(top, rows.shape).copy(), np.broadcast_to(bottom, rows.shape).copy()
            a[high, col], b[low, col] = lists[n - depth:], lists[:depth]
            bounds.append(plus[here] @ a.T + minus[here] @ b.T)
        upper, lower = bounds
        own = query_ids[here][:, None] == ids[None, :]
        upper[own] = lower[own] = -np.inf
        kth = np.partition(lower, n - k, axis=1)[:, n - k] if n > k else np.full(len(here), -np.inf)
        inside = (upper >= np.maximum(kth, floor[here])[:, None]) & ~own
        stop = (inside.sum(1) <= max(8 * k, n // 8)) | last
        for j in np.flatnonzero(stop):
            q, at = here[j], np.flatnonzero(inside[j])
            score = rows[at] @ queries[q]
            best = np.lexsort((ids[at], -score))[:k]
            best = best[score[best] >= floor[q]]
            out.append((np.full(len(best), q), at[best], score[best]))
            read[q] = depth / n
        open_ = np.setdiff1d(open_, here[stop], assume_unique=True)
    if not out:
        return (*(np.zeros(0, np.int64) for _ in range(3)), read)
    return (*(np.concatenate(x) for x in zip(*out)), read)


def _sides(*frames: pd.DataFrame) -> list[np.ndarray]:
    """Ids and matrix of each frame, by id, of rows that repeat an id the smallest; all as wide as the widest vector."""
    width, out = max(max(map(len, f.v)) for f in frames) or 1, []
    for f in frames:
        ids, rows = f.vec_id.to_numpy(), _matrix(f.v, width)
        at = np.lexsort((*rows.T[::-1], ids))
        ids, rows = ids[at], rows[at]
        first = np.r_[True, ids[1:] != ids[:-1]]
        out += [ids[first], rows[first]]
    return out


def _scan(ids, rows, query_ids, queries, k, floor, block) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """The k best of all rows that reach the floor, block after block, where each block's results raise the floor of the next; the last floor; the mean share of lists that was read."""
    best, read, done = np.full((len(queries), k), -np.inf), np.zeros(len(queries)), 0
    found = []
    for a in range(0, len(ids), block):
        part = ids[a:a + block]
        q, c, score, depth = nra(part, rows[a:a + block], query_ids, queries, k, floor)
        found.append(pd.DataFrame({"query_id": query_ids[q], "vec_id": part[c], "score": score.astype("int64"), "q": q}))
        read, done = read + depth * len(part), done + len(part)
        rank = found[-1].groupby("q").cumcount().to_numpy()
        new = np.full((len(queries), k), -np.inf)
        new[q, rank] = score
        best = -np.sort(-np.concatenate([best, new], 1), axis=1)[:, :k]
        floor = np.maximum(floor, best[:, k - 1])
    out = pd.concat(found).sort_values(["q", "score", "vec_id"], ascending=[True, False, True])
    return out[out.groupby("q").cumcount() < k][["query_id", "vec_id", "score"]], floor, read / max(done, 1)


def top_k(candidates: DataFrame, queries: DataFrame, k=5, block_rows=8192, query_rows=4096, list_rows=4096, seed_rows=8192) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best candidates by integer inner product, its own id left out, ties to the smaller id.

    Both inputs have (vec_id, v: array of long), as as_integers() gives them. Each query first finds its k-th best score among about seed_rows candidates (those with the least hashes
    of their id), which are collected and broadcast: a floor under its final k-th score, with which reading elsewhere stops earlier. Candidates are then hashed into blocks of about
    block_rows and queries into blocks of about query_rows; each pair of blocks is a task of bounded size, reads its lists in parts of list_rows, and returns at most k rows for each
    query; the best k of those stay. Ids are hashed, so a vector that many rows share is spread over all blocks. A candidate is sent once for each query block, a query once for each
    block of candidates.

    Shorter vectors count as padded with zeros. Of rows that repeat an id, the one with the smallest vector counts. Fewer than k candidates give
    fewer rows; no queries or no candidates give none. Other columns are ignored. Scores are exact below 2**53.
    """
    n, m = max(1, candidates.count()), max(1, queries.count())
    blocks, parts = -(-n // block_rows), -(-m // query_rows)
    share = min(1.0, seed_rows / n)
    chosen = candidates.select("vec_id", "v").where(F.pmod(F.xxhash64("vec_id", F.lit("seed")), F.lit(1_000_003)) < F.lit(int(share * 1_000_003)))
    seeds = chosen.groupBy("vec_id").agg(F.min("v").alias("v")).toPandas().sort_values("vec_id", ignore_index=True)

    def floors(frames):
        for pdf in frames:
            floor = np.full(len(pdf), -np.inf)
            if len(seeds) and len(pdf):
                for a in range(0, len(pdf), query_rows):
                    some = pdf.iloc[a:a + query_rows]
                    width = max(max(map(len, seeds.v)), max(map(len, some.v))) or 1
                    floor[a:a + query_rows] = _scan(seeds.vec_id.to_numpy(), _matrix(seeds.v, width), some.vec_id.to_numpy(), _matrix(some.v, width), k, floor[a:a + query_rows], list_rows)[1]
            yield pdf.assign(floor=floor)

    # of rows that repeat a query's id only the smallest vector counts; the floor of another one must not be used
    unique = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = cut(unique.mapInPandas(floors, "vec_id long, v array<long>, floor double"))
    left = candidates.select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("c"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("q"))
    right = asked.select("vec_id", "v", "floor", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias("q"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("c"))

    def pair(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        ids, rows, query_ids, asked_rows = _sides(a, b)
        return _scan(ids, rows, query_ids, asked_rows, k, b.sort_values("vec_id").floor.to_numpy(), list_rows)[0]

    best = left.groupBy("c", "q").cogroup(right.groupBy("c", "q")).applyInPandas(pair, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
