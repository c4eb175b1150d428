"""Novelty of embeddings: distance to the nearest class centre."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.functions.ranking import quantiles
from harrow.functions.storage import checkpointed


def centroids(rows: DataFrame, dim: DataFrame | None = None) -> DataFrame:
    """(label, mean): the mean vector of each label of dim; a label without rows has the mean of all."""
    cells = rows.select("label", F.posexplode("embedding").alias("i", "x"))
    vector = lambda df, *by: df.groupBy(*by, "i").agg(F.avg(F.col("x").cast("double")).alias("m")).groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mean"))
    own = vector(cells, "label")
    if dim is None:
        return own
    every = vector(cells.withColumn("label", F.lit(0)), "label").select(F.col("mean").alias("_all"))
    return dim.select("label").join(own, "label", "left").crossJoin(F.broadcast(every)).select("label", F.coalesce("mean", "_all").alias("mean"))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, d: s + d)


def with_means(rows: DataFrame, means: DataFrame) -> DataFrame:
    """rows with `means`, the centres in order of label. The centres are one row, of as many vectors as there are classes."""
    one = means.agg(F.transform(F.array_sort(F.collect_list(F.struct("label", "mean"))), lambda s: s["mean"]).alias("means"))
    return rows.crossJoin(F.broadcast(one))


def scores(rows: DataFrame, means: DataFrame) -> DataFrame:
    """rows with scores: minus the squared distance to each centre."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    return with_means(rows.withColumn("_x", x), means).withColumn("scores", F.transform("means", lambda m: -squared_distance(F.col("_x"), m))).drop("means", "_x")


def nearest_sq(rows: DataFrame, means: DataFrame) -> DataFrame:
    """rows with score: the squared distance to the nearest centre."""
    return scores(rows, means).withColumn("score", -F.array_max("scores")).drop("scores")


def _array(means: DataFrame) -> tuple[list, np.ndarray]:
    got = sorted((r.label, list(r["mean"])) for r in means.collect())  # one row a class
    return [x for x, _ in got], np.array([m for _, m in got], float)


def pooled_covariance(rows: DataFrame, means: DataFrame) -> DataFrame:
    """(i, j, v): within-class covariance over max(1, n - classes). Each task sums its own D x D products; D * D sums are shuffled."""
    labels, mu = _array(means)
    place = {x: i for i, x in enumerate(labels)}

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = None, 0
        for pdf in batches:
            x = np.stack(pdf["embedding"].to_numpy()).astype(float) - mu[[place[v] for v in pdf["label"]]]
            total, n = (x.T @ x if total is None else total + x.T @ x), n + len(x)
        if total is not None:
            d = len(total)
            yield pd.DataFrame({"i": np.repeat(np.arange(d), d), "j": np.tile(np.arange(d), d), "v": total.ravel(), "n": n})

    sums = rows.select("label", "embedding").mapInPandas(part, "i int, j int, v double, n long").groupBy("i", "j").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    return sums.select("i", "j", (F.col("v") / F.greatest(F.col("n") - len(labels), F.lit(1))).alias("v"))


def shrinkage(rows: DataFrame, means: DataFrame, cov: DataFrame) -> DataFrame:
    """One row (n, d, mu, delta, beta, intensity): the Ledoit-Wolf intensity from sums of fourth powers of norms, of squared covariances, and the trace."""
    centred = rows.select(F.col("label"), "embedding").join(means, "label")
    q = F.pow(squared_distance(F.transform("embedding", lambda e: e.cast("double")), F.col("mean")), F.lit(2))
    s = centred.agg(F.count(F.lit(1)).alias("n"), F.sum(q).alias("fourth"))
    c = cov.agg((F.max("i") + 1).alias("d"), F.sum(F.when(F.col("i") == F.col("j"), F.col("v"))).alias("trace"), F.sum(F.col("v") * F.col("v")).alias("squares"))
    row = s.crossJoin(F.broadcast(c)).withColumn("mu", F.col("trace") / F.col("d"))  # one row each
    row = row.withColumn("delta", (F.col("squares") - F.col("d") * F.col("mu") * F.col("mu")) / F.col("d"))
    row = row.withColumn("beta", F.greatest(F.lit(0.0), F.least("delta", (F.col("fourth") / F.col("n") - F.col("squares")) / (F.col("n") * F.col("d")))))
    return row.withColumn("intensity", F.when((F.col("n") < 2) | (F.col("delta") <= 0), 1.0).otherwise(F.col("beta") / F.col("delta"))).select("n", "d", "mu", "delta", "beta", "intensity")


def precision(cov: DataFrame, intensity: float, mu: float) -> np.ndarray:
    """The inverse of the shrunk covariance. Its D * D cells are collected; D is the length of a vector."""
    cells = cov.toPandas()
    d = int(cells["i"].max()) + 1
    c = np.zeros((d, d))
    c[cells["i"], cells["j"]] = cells["v"]
    return inverse_of(c, intensity, mu)


def inverse_of(covariance: np.ndarray, intensity: float, mu: float) -> np.ndarray:
    """The inverse, or pseudo-inverse, of a covariance that is shrunk towards mu times the identity."""
    c = (1 - intensity) * covariance + intensity * max(mu, 1e-12) * np.eye(len(covariance))
    try:
        return np.linalg.inv(c)
    except np.linalg.LinAlgError:
        return np.linalg.pinv(c)


def least_distance(x: np.ndarray, mu: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """Of each row the least squared Mahalanobis distance to a row of mu."""
    best = np.full(len(x), np.inf)
    for m in mu:
        d = x - m
        best = np.minimum(best, ((d @ inverse) * d).sum(1))
    return best


def mahalanobis(rows: DataFrame, means: DataFrame, inverse: np.ndarray, key: str) -> DataFrame:
    """(key, score): the least squared Mahalanobis distance to a centre, one centre at a time over each batch."""
    _, mu = _array(means)

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.stack(pdf["embedding"].to_numpy()).astype(float)
            yield pd.DataFrame({key: pdf[key], "score": least_distance(x, mu, inverse)})

    return rows.select(key, "embedding").mapInPandas(part, f"{key} {rows.schema[key].dataType.simpleString()}, score double")


def fit(rows: DataFrame) -> tuple[DataFrame, np.ndarray, float]:
    """(means, precision, intensity) of labelled embeddings."""
    means = checkpointed(centroids(rows))
    cov = checkpointed(pooled_covariance(rows, means))
    s = shrinkage(rows, means, cov).first()
    intensity = min(1.0, max(0.0, s.intensity))
    return means, precision(cov, intensity, s.mu), intensity


def spread(rows: DataFrame, least=1e-5) -> DataFrame:
    """(spread, degenerate): mean deviation of a component over the mean absolute value."""
    cells = rows.select(F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    each = cells.groupBy("i").agg(F.stddev_pop("x").alias("s"), F.sum(F.abs("x")).alias("a"), F.count(F.lit(1)).alias("n"))
    s = each.agg((F.avg("s") / F.greatest(F.sum("a") / F.sum("n"), F.lit(1e-6))).alias("spread"))
    return s.withColumn("degenerate", F.col("spread") < least)


def calibrate(scored: DataFrame, q=0.975) -> DataFrame:
    """(threshold, median, reject_rate) of in-distribution scores: exact quantiles."""
    t = quantiles(scored.select(F.lit("all").alias("name"), F.col("score").alias("x")), {"threshold": q, "median": 0.5}).select("threshold", "median")
    return scored.crossJoin(F.broadcast(t)).groupBy("threshold", "median").agg(F.avg((F.col("score") > F.col("threshold")).cast("double")).alias("reject_rate"))


def judge(scored: DataFrame, threshold: float | None) -> DataFrame:
    """scored with is_novel and novelty_ratio; without a threshold the detector is off: false and 0."""
    if threshold is None or threshold <= 0 or threshold == float("inf"):
        return scored.withColumns({"is_novel": F.lit(False), "novelty_ratio": F.lit(0.0)})
    return scored.withColumns({"is_novel": F.col("score") > threshold, "novelty_ratio": F.col("score") / threshold})


def verdict(noise_reject: Column, in_reject: Column) -> Column:
    return F.when((noise_reject < 0.5) | (in_reject > 0.15), "weak").otherwise("separates")


def _added(parts: DataFrame, by: list[str], salts: int, fan_in=64) -> DataFrame:
    """(by, m): the sums of parts (by, salt from 0 to salts - 1, m: doubles as bytes), fan_in rows at a time at each level, so that no group grows with the parts."""
    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[:1].copy()
        first["m"] = [sum(np.frombuffer(m) for m in pdf["m"]).tobytes()]
        return first

    schema = parts.select(*by, "salt", "m").schema
    while salts > fan_in:
        parts = parts.withColumn("salt", F.floor(F.col("salt") / fan_in).cast("long")).groupBy(*by, "salt").applyInPandas(add, schema)
        salts = -(-salts // fan_in)
    return parts.withColumn("salt", F.lit(0).cast("long")).groupBy(*by).applyInPandas(add, schema).drop("salt")


def grouped_moments(rows: DataFrame, most_bytes=256 << 20) -> DataFrame:
    """(version, label, m) by one pass over rows (version, label, embedding): of each version and class, as doubles in a row, n, the sum of |x|^2, that of |x|^4, then the sums of x, of |x|^2 x and of x x'.

    Moments of parts add up to those of the whole. A task holds at most most_bytes of them and writes what it has where it would hold more.
    """
    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, salt = {}, 0, TaskContext.get().partitionId()

        def out() -> pd.DataFrame:
            return pd.DataFrame([(v, k, salt, m.tobytes()) for (v, k), m in held.items()], columns=["version", "label", "salt", "m"])

        for pdf in batches:
            for key, group in pdf.groupby(["version", "label"], dropna=False):
                x = np.stack(group["embedding"].to_numpy()).astype(float)
                s = (x * x).sum(1)
                m = np.concatenate([[len(x), s.sum(), (s * s).sum()], x.sum(0), s @ x, (x.T @ x).ravel()])
                size += m.nbytes * (key not in held)
                held[key] = held.get(key, 0) + m
                if size > most_bytes:
                    yield out()
                    held, size = {}, 0
        if held:
            yield out()

    fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    parts = rows.select("version", "label", "embedding").mapInPandas(part, f"version {fields['version']}, label {fields['label']}, salt long, m binary")
    return _added(parts, ["version", "label"], rows.rdd.getNumPartitions())


def fit_versions(rows: DataFrame, fan_in=64) -> dict:
    """version -> (labels, their means as rows, precision, intensity, n): the detectors of all versions from grouped_moments(), what fit() gives for each on its own.

    Within-class scatter and the sum of |x - mean|^4 follow from a class's moments, on the workers; of each version the means and one D x D matrix reach the driver.
    """
    def centred(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for version, label, blob in zip(pdf["version"], pdf["label"], pdf["m"]):
                m = np.frombuffer(blob)
                d = int(round(np.sqrt(len(m) - 2))) - 1  # 3 + 2 d + d^2 numbers
                n, squares, fourth, x, sx, xx = m[0], m[1], m[2], m[3:3 + d], m[3 + d:3 + 2 * d], m[3 + 2 * d:].reshape(d, d)
                mean = x / n
                mm = mean @ mean
                # the sum of (|x|^2 - 2 x.mean + |mean|^2)^2, multiplied out
                fourth = fourth + 4 * mean @ xx @ mean + n * mm * mm - 4 * sx @ mean + 2 * mm * squares - 4 * mm * (x @ mean)
                out.append((version, label, mean.tobytes(), np.concatenate([[n, 1.0, fourth], (xx - n * np.outer(mean, mean)).ravel()]).tobytes()))
            yield pd.DataFrame(out, columns=["version", "label", "mean", "m"])

    fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    each = checkpointed(grouped_moments(rows).mapInPandas(centred, f"version {fields['version']}, label {fields['label']}, mean binary, m binary"))
    place = each.select("version", F.pmod(F.xxhash64("label"), F.lit(fan_in * fan_in)).alias("salt"), "m")
    pooled = _added(place, ["version"], fan_in * fan_in, fan_in).collect()  # one row a version
    means: dict = {}
    for r in each.select("version", "label", "mean").collect():  # one row a class
        means.setdefault(r.version, []).append((r.label, np.frombuffer(r["mean"])))
    out = {}
    for r in pooled:
        m = np.frombuffer(r.m)
        d = int(round(np.sqrt(len(m) - 3)))
        n, classes, fourth, cov = m[0], m[1], m[2], m[3:].reshape(d, d) / max(m[0] - m[1], 1)
        mu = np.trace(cov) / d
        squares = (cov * cov).sum()
        delta = (squares - d * mu * mu) / d
        beta = max(0.0, min(delta, (fourth / n - squares) / (n * d)))
        intensity = 1.0 if n < 2 or delta <= 0 else min(1.0, beta / delta)
        labelled = sorted(means[r.version], key=lambda x: x[0])
        out[r.version] = ([k for k, _ in labelled], np.array([v for _, v in labelled]), inverse_of(cov, intensity, mu), intensity, int(n))
    return out


def noise(keys: np.ndarray, d: int, seed: int) -> np.ndarray:
    """Normal numbers, d for each key (64 bits), that depend on the key, the place and the seed only."""
    x = keys.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, 2 * d + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64(seed)
    for by, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(by))) * np.uint64(times)
    u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / (1 << 53)
    return np.sqrt(-2 * np.log1p(-u[:, :d])) * np.cos(2 * np.pi * u[:, d:])


def refit(rows: DataFrame, key: str, seed=17) -> DataFrame:
    """The detector fitted again for each version of a classifier: (version, classes, n, enough, shrinkage, threshold, in_reject, noise_reject, verdict).

    rows (version, key, label, embedding) hold each version's embeddings, whose lengths may differ between versions. They are read twice, however many versions there are: once for the moments of all versions and
    classes, once for the distances of each row, and of normal noise of the same length in its place, to its version's centres. enough says whether a version
    has at least two rows for each of its classes; without that its covariance says little. noise_reject is the share of noise that is called novel.
    """
    fitted = fit_versions(rows)

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for version, group in pdf.groupby("version", dropna=False):
                _, mu, inverse, _, _ = fitted[version if version == version else None]
                x = np.stack(group["embedding"].to_numpy()).astype(float)
                yield pd.DataFrame({"version": group["version"], "score": least_distance(x, mu, inverse), "noise": least_distance(noise(group["key"].to_numpy(), x.shape[1], seed), mu, inverse)})

    kind = rows.schema["version"].dataType.simpleString()
    scored = checkpointed(rows.select("version", F.xxhash64(key).alias("key"), "embedding").mapInPandas(part, f"version {kind}, score double, noise double"))
    cut = quantiles(scored.select("version", F.col("score").alias("x")), {"threshold": 0.975}, by="version").select("version", "threshold")
    known = [(v, len(labels), n, float(intensity)) for v, (labels, _, _, intensity, n) in fitted.items()]
    sizes = rows.sparkSession.createDataFrame(known, f"version {kind}, classes long, n long, shrinkage double").withColumn("enough", F.col("n") >= 2 * F.col("classes"))
    share = lambda c: F.avg((F.col(c) > F.col("threshold")).cast("double"))
    rejected = scored.join(cut, "version").groupBy("version", "threshold").agg(share("score").alias("in_reject"), share("noise").alias("noise_reject"))
    return sizes.join(rejected, "version").select("version", "classes", "n", "enough", "shrinkage", "threshold", "in_reject", "noise_reject").withColumn("verdict", verdict(F.col("noise_reject"), F.col("in_reject")))
