"""Language identification by nearest centroids of TF-IDF n-gram vectors."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harrow.llm.common import held_out, join_few, small_batches
from harrow.llm.wordhash import batches

DIM = 8192
#: A broadcast side has at most so many rows; more are shuffled.
BROADCAST_ROWS = 100_000
#: ASCII letters in lower case and bytes of other letters as they are; all else is a space.
FOLD = bytes((c | 32) if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def ngram_counts(texts: list[bytes]) -> np.ndarray:
    """(texts, DIM) counts of hashed 2- and 3-grams of bytes, over whole texts; other characters count as a space each, and two spaces follow."""
    buf = np.frombuffer(b"  ".join(t.translate(FOLD) for t in texts) + b"    ", np.uint8).astype(np.uint32)
    sizes = np.array([len(t) + 2 for t in texts])
    owner = np.repeat(np.arange(len(texts)), sizes)
    a, b, c = buf[:-2], buf[1:-1], buf[2:]
    n, owner = len(owner), owner * DIM
    letters = (a != 32) | (b != 32)
    letters[n:] = False
    letters[np.cumsum(sizes) - 1] = False  # the space before the next text
    two = ((a << 8 | b) * np.uint32(2654435761)) >> np.uint32(19)
    three = ((a << 16 | b << 8 | c) * np.uint32(2246822519) + np.uint32(374761393)) >> np.uint32(19)
    at = np.flatnonzero(letters[:n])
    place = owner[at]
    return np.bincount(np.concatenate([place + two[at], place + three[at]]), minlength=len(texts) * DIM).reshape(len(texts), DIM)


@dataclass
class Centroids:
    languages: list[str]
    idf: np.ndarray
    vectors: np.ndarray  # one row a centroid, unit length
    owner: np.ndarray  # of each centroid, the place of its language
    least: np.ndarray  # of each centroid, the cosine under which a text is rejected

    def weigh(self, counts: np.ndarray) -> np.ndarray:
        v = np.log1p(counts.astype(np.float32)) * self.idf
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def nearest(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cosine = self.weigh(counts) @ self.vectors.T
        best = cosine.argmax(1)
        return best, np.clip(cosine[np.arange(len(best)), best], 0, 1)


def _cluster(v: np.ndarray, k: int, rounds=12) -> np.ndarray:
    """Spherical k-means, begun with the rows farthest from those chosen before."""
    centers = [v.mean(0)]
    for _ in range(min(k, len(v)) - 1):
        centers.append(v[(v @ np.array(centers).T).max(1).argmin()])
    c = np.array(centers)
    for _ in range(rounds):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
        near = (v @ c.T).argmax(1)
        c = np.array([v[near == i].mean(0) if (near == i).any() else c[i] for i in range(len(c))])
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)


def _has_letter(text):
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


def fit(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", per_language=500, clusters=4, reject_share=0.002) -> Centroids:
    """Learns from at most per_language different texts of each language (those with the least hashes), of rows that are not held out.

    Texts are told apart before they are ranked, so that copies take one place, and only the chosen ones are fetched; only the sample's n-gram counts reach the driver. A centroid's rejection bound is the cosine that all but
    reject_share of its own sample exceed, less a twentieth.
    """
    rows = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & _has_letter(text_col)).select(F.col(lang_col).alias("lang"), F.col(text_col).cast("binary").alias("body"), F.xxhash64(text_col).alias("h"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    chosen = rows.select("lang", "h").distinct().withColumn("r", rank).where(F.col("r") <= per_language).select("lang", "h")
    sample = join_few(rows, chosen, ["lang", "h"], broadcast_rows=BROADCAST_ROWS).groupBy("lang", "h").agg(F.min("body").alias("body")).select("lang", "body")

    def count(parts):
        for pdf in parts:
            texts = list(pdf["body"])
            for a, b in batches(texts, 500_000):
                c = ngram_counts(texts[a:b])
                yield pd.DataFrame({"lang": pdf["lang"].iloc[a:b].to_numpy(), "at": [np.flatnonzero(x).astype(np.uint16).tobytes() for x in c], "n": [x[x > 0].astype(np.uint32).tobytes() for x in c]})

    got = sample.mapInPandas(count, "lang string, at binary, n binary").toPandas().sort_values(["lang", "at", "n"], ignore_index=True)  # the order in which tasks end must not matter
    counts = np.zeros((len(got), DIM), np.float32)
    for i, (at, n) in enumerate(zip(got["at"], got["n"])):
        counts[i, np.frombuffer(at, np.uint16)] = np.frombuffer(n, np.uint32)
    languages = sorted(set(got["lang"]))
    fitted = Centroids(languages, (np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))) + 1).astype(np.float32), np.zeros((0, DIM), np.float32), np.zeros(0, int), np.zeros(0))
    v = fitted.weigh(counts)
    lang = got["lang"].to_numpy()
    for i, name in enumerate(languages):
        mine = v[lang == name]
        c = _cluster(mine, clusters)
        cosine = mine @ c.T
        near = cosine.argmax(1)
        least = [max(0.0, float(np.quantile(cosine[near == j, j], reject_share)) - 0.05) if (near == j).any() else 0.0 for j in range(len(c))]
        fitted.vectors, fitted.owner, fitted.least = np.vstack([fitted.vectors, c.astype(np.float32)]), np.r_[fitted.owner, [i] * len(c)], np.r_[fitted.least, least]
    return fitted


def identify(docs: DataFrame, fitted: Centroids, id_col="doc_id", text_col="text", unknown="und") -> DataFrame:
    """(doc_id, lang_pred, score, rejected): each whole text's nearest centroid by cosine, and whether it is farther off than the centroid's own texts.

    A null text, one without a letter, or any text if no language was learned gets `unknown` and score 0. A rejected text keeps its nearest language, with
    rejected true, so that the caller decides. Other columns are ignored; repeated rows get equal results. No rows give no rows.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.when(_has_letter(text_col), F.col(text_col).cast("binary")).alias("body"))
    m = fitted

    def predict(parts):
        for pdf in parts:
            texts = [b"" if t is None else t for t in pdf["body"]]
            none = pdf["body"].isna().to_numpy()
            for a, b in batches(texts, 500_000):
                if not len(m.owner):
                    yield pd.DataFrame({"doc_id": pdf["doc_id"].iloc[a:b], "lang_pred": unknown, "score": 0.0, "rejected": True})
                    continue
                best, score = m.nearest(ngram_counts(texts[a:b]))
                name = np.where(none[a:b], unknown, np.array(m.languages, object)[m.owner[best]])
                yield pd.DataFrame({"doc_id": pdf["doc_id"].iloc[a:b], "lang_pred": name, "score": np.where(none[a:b], 0.0, score.astype(float)), "rejected": none[a:b] | (score < m.least[best])})

    return rows.mapInPandas(predict, f"doc_id {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double, rejected boolean")
