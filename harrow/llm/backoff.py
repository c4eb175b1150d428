"""Language-model scores by a weighted backoff automaton over n-gram counts of the whole corpus."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harrow.llm.common import shared_path, small_batches, text_bytes
from harrow.llm.wordhash import BASES, Words, batches, mix

U = np.uint64
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: The token that ends each text, and the contexts of a text's first tokens.
END, START = U(0x51ED270B8A5F3C17), U(0xB7E151628AED2A6B)


def training(id_col: str) -> Column:
    """True for rows to learn from: crc32 of the id as text, modulo 5, is not 1; a null id is no held-out one."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 != 1, F.lit(True))


def _slices(text: bytes, most: int):
    """text in pieces of about `most` bytes, cut at white space; a longer word stays whole."""
    begin = 0
    while len(text) - begin > most:
        cut = max(text.rfind(c, begin + 1, begin + most) for c in b" \t\n\v\f\r")
        if cut < 0:
            cut = min((at for c in b" \t\n\v\f\r" if (at := text.find(c, begin + most)) >= 0), default=len(text))
        yield text[begin:cut]
        begin = cut
    yield text[begin:]


class Grams:
    """The tokens of some texts, each text's words in lower case and then END, and for each level k up to order the hash of the k tokens that end at each place; before the first stands START."""

    def __init__(self, texts: list[bytes], order: int, piece_bytes=2_000_000):
        pieces, text = [], []
        for i, t in enumerate(texts):
            for p in _slices(t.translate(LOWER), piece_bytes):
                pieces.append(p)
                text.append(i)
        hashes, words = [], np.zeros(len(texts), np.int64)
        for a, b in batches(pieces, piece_bytes):
            w = Words(pieces[a:b])
            hashes.append(w.hash)
            np.add.at(words, text[a:b], w.n)
        self.last = np.cumsum(words + 1)
        self.first = self.last - words - 1
        tokens = np.full(int(self.last[-1]) if len(texts) else 0, END, U)
        inner = np.ones(len(tokens), bool)
        inner[self.last - 1] = False
        tokens[inner] = np.concatenate(hashes or [np.zeros(0, U)])
        self.levels = [tokens]
        for k in range(2, order + 1):
            self.levels.append(mix(self.before(self.levels[-1], mix(np.array([START + U(k)]))[0]) * U(BASES[1]) + tokens))

    def before(self, values: np.ndarray, at_first) -> np.ndarray:
        """Of each place, the value of the place before in its text, or at_first."""
        out = np.empty_like(values)
        out[1:] = values[:-1]
        out[self.first] = at_first
        return out

    def of_texts(self, flags: np.ndarray) -> np.ndarray:
        """flags (a value for each text) at each place."""
        return np.repeat(flags, self.last - self.first)


def numbered(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different hashes in order, and of each place the number of its hash."""
    order = np.argsort(hashes)
    ordered = hashes[order]
    new = np.r_[np.ones(min(1, len(hashes)), bool), ordered[1:] != ordered[:-1]]
    at = np.empty(len(hashes), np.int64)
    at[order] = np.cumsum(new) - 1
    return ordered[new], at


def _packed(values: np.ndarray, width: int) -> bytes:
    """Integers as planes of their bytes, compressed."""
    return pa.compress(np.ascontiguousarray(values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes(), codec="zstd", asbytes=True)


def _unpacked(blob: bytes, n: int, width: int) -> np.ndarray:
    flat = np.frombuffer(pa.decompress(blob, n * width, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(flat.reshape(width, n).T).view(f"<u{width}").ravel()


def _edges(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket, an equal range of hashes, begins in the ordered hashes, and the end."""
    return np.r_[np.searchsorted(hashes, np.array([(b << 64) // buckets for b in range(buckets)], U)), len(hashes)]


def chunked(docs: DataFrame, id_col: str, text_col: str, learn: Column, chunk_bytes: int) -> DataFrame:
    """A row for each chunk of documents: chunk, ids, learn, sizes, body (their texts, compressed). A chunk has about chunk_bytes of text, or one longer text."""
    id_type = docs.schema[id_col].dataType

    def pack(held: list, number: int) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        texts, ids = table.column(2).to_pylist(), table.column(0).chunk(0)
        return pa.RecordBatch.from_arrays([
            pa.array([f"{TaskContext.get().partitionId()}-{number}"]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([table.column(1).to_pylist()], pa.list_(pa.bool_())),
            pa.array([[len(t) for t in texts]], pa.list_(pa.int32())), pa.array([pa.compress(b"".join(texts), codec="zstd", asbytes=True)]),
        ], names=["chunk", "ids", "learn", "sizes", "body"])

    def chunks(parts):
        held, size, number = [], 0, 0
        for b in parts:
            begin = 0
            for i, n in enumerate(pc.binary_length(b.column(2)).to_pylist()):
                if size and size + n > chunk_bytes:
                    yield pack([*held, b.slice(begin, i - begin)], number)
                    held, size, begin, number = [], 0, i, number + 1
                size += n
            if b.num_rows > begin:
                held.append(b.slice(begin))
        if held:
            yield pack(held, number)

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), learn.alias("learn"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    return rows.mapInArrow(chunks, T.StructType([T.StructField("chunk", T.StringType()), T.StructField("ids", T.ArrayType(id_type)), T.StructField("learn", T.ArrayType(T.BooleanType())), T.StructField("sizes", T.ArrayType(T.IntegerType())), T.StructField("body", T.BinaryType())]))


def _grams(body: bytes, sizes: list[int], order: int) -> Grams:
    texts, at = pa.decompress(body, sum(sizes), codec="zstd", asbytes=True), 0
    parts = []
    for n in sizes:
        parts.append(texts[at:at + n])
        at += n
    return Grams(parts, order)


def requested(chunks: DataFrame, order: int, buckets: int) -> DataFrame:
    """(chunk, key, n, grams, counts): of each chunk, level and bucket (an equal range of hashes) the different n-grams in order, as differences, with their counts in the chunk's training texts."""
    def requests(parts):
        for b in parts:
            for chunk, learn, sizes, body in zip(*[c.to_pylist() for c in b.columns]):
                grams = _grams(body, sizes, order)
                places = grams.of_texts(np.array(learn, bool))
                for level, hashes in enumerate(grams.levels):
                    found, at = numbered(hashes)
                    counts, edges = np.bincount(at, places, len(found)).astype(np.int64), _edges(found, buckets)
                    held = [(k, i, j) for k, (i, j) in enumerate(zip(edges, edges[1:])) if j > i]
                    yield pa.RecordBatch.from_pydict({
                        "chunk": pa.array([chunk] * len(held), pa.string()), "key": pa.array([level * buckets + k for k, _, _ in held], pa.int32()), "n": pa.array([int(j - i) for _, i, j in held], pa.int32()),
                        "grams": pa.array([_packed(np.diff(found[i:j], prepend=U(0)), 8) for _, i, j in held], pa.binary()), "counts": pa.array([_packed(counts[i:j], 4) for _, i, j in held], pa.binary()),
                    })

    return chunks.select("chunk", "learn", "sizes", "body").mapInArrow(requests, "chunk string, key int, n int, grams binary, counts binary")


def _answered(key, table):
    """Of one bucket: to each chunk the corpus-wide counts of the n-grams that it asked for, in its order; and a row without a chunk with the bucket's different n-grams, those that occur once, and occurrences."""
    ns = table.column("n").to_pylist()
    grams = [np.cumsum(_unpacked(b, n, 8), dtype=U) for b, n in zip(table.column("grams").to_pylist(), ns)]
    counts = np.concatenate([_unpacked(b, n, 4) for b, n in zip(table.column("counts").to_pylist(), ns)])
    found, at = numbered(np.concatenate(grams))
    totals = np.bincount(at, counts, len(found)).astype(np.int64)
    mine = np.split(totals[at], np.cumsum(ns)[:-1])
    facts = [int((totals > 0).sum()), int((totals == 1).sum()), int(totals.sum())]
    rows = len(ns)
    return pa.table({
        "chunk": pa.array([*table.column("chunk").to_pylist(), None], pa.string()), "key": pa.array([key[0].as_py()] * (rows + 1), pa.int32()), "n": pa.array([*ns, 0], pa.int32()),
        "counts": pa.array([*[_packed(m, 8) for m in mine], None], pa.binary()), "facts": pa.array([None] * rows + [facts], pa.list_(pa.int64())),
    })


def automaton(grams: Grams, counts: list[np.ndarray], starts: float, tokens: int, words: int, weights: list[float]) -> tuple[list[np.ndarray], list[np.ndarray], list[float]]:
    """(log10 weight of the arc, whether it is there, weight of the failure arc) for states of depth 0, 1, ...: of each place, what reading its token costs from the state of the d tokens before.

    A state is a context of d tokens that training texts have. It has an arc for each token that follows it there, whose probability mixes the token's share of the context's followers with the state of one token
    less: (1 - weight) * share + weight * lower; other tokens take the failure arc, of probability weight, to that state. The root has an arc for every token, unknown ones included: (c + 0.5) / (N + 0.5 (V + 1)).
    So the probabilities of all tokens, in any state, add up to 1.
    """
    lower = (counts[0] + 0.5) / (tokens + 0.5 * (words + 1))
    arcs, there, fails = [np.log10(lower)], [np.ones(len(lower), bool)], [0.0]
    for k in range(1, len(counts)):
        context = grams.before(counts[k - 1], starts)
        with np.errstate(divide="ignore", invalid="ignore"):
            lower = np.where(context > 0, (1 - weights[k]) * counts[k] / context + weights[k] * lower, lower)
        arcs.append(np.log10(lower))
        there.append(counts[k] > 0)
        fails.append(math.log10(weights[k]))
    return arcs, there, fails


def traverse(arcs: list[list[float]], there: list[list[bool]], known: list[bool], fails: list[float], depth: int) -> float:
    """One walk over a text's tokens from the state of the given depth: the sum of the arcs taken. After an arc the state is that of one token more, as deep as states go."""
    total, deepest = 0.0, len(arcs) - 1
    for i, word in enumerate(known):
        while not there[depth][i]:
            total += fails[depth]
            depth -= 1
        total += arcs[depth][i]
        depth = min(depth + 1, deepest) if word else 0
    return total


def score(docs: DataFrame, id_col="doc_id", text_col="text", learn: Column | None = None, order=2, chunk_bytes=8 << 20, bucket_bytes=32 << 20) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): a row for each document.

    Tokens are a text's words (runs of characters other than ASCII white space, A-Z in lower case) and one end. n-grams up to `order` are counted over all training documents, none left out; states, arcs and
    failure arcs are those of automaton(), whose weight at a level is that share of the level's training tokens whose n-gram occurs once. base_score is the root alone.

    Documents are packed into chunks, kept as Parquet in the shared folder. A chunk sends its different n-grams, ordered and as differences, with their counts to buckets of hashes (64 bits); a bucket adds up and sends
    back the totals in the chunk's order. So what a worker holds follows chunk_bytes and bucket_bytes and not the corpus, an n-gram of every chunk is one entry for each, and a chunk has the
    part of the automaton that its texts can reach. Each text is then walked once.

    Null and empty texts are one end token. Rows that repeat an id, or have none, are documents of their own; a null id is trained on. No training rows make the root's one unknown token certain: scores of 0.
    No rows give no rows. Other columns are ignored. A text longer than a chunk is a chunk.
    """
    spark = docs.sparkSession
    learn = training(id_col) if learn is None else learn
    id_type = docs.schema[id_col].dataType
    buckets = max(1, -(-text_bytes(docs, text_col) // bucket_bytes))
    path, answers_path = shared_path(spark, "chunks"), shared_path(spark, "counts")
    chunked(docs, id_col, text_col, learn, chunk_bytes).write.parquet(path)
    chunks = spark.read.parquet(path)
    requested(chunks, order, buckets).groupBy("key").applyInArrow(_answered, "chunk string, key int, n int, counts binary, facts array<long>").write.parquet(answers_path)
    answers = spark.read.parquet(answers_path)
    facts = answers.where("chunk IS NULL").groupBy(F.floor(F.col("key") / buckets).cast("int").alias("level")).agg(*[F.sum(F.col("facts")[i]).alias(n) for i, n in enumerate(("types", "singles", "tokens"))])
    facts = {r["level"]: r for r in facts.collect()}
    tokens, words = (facts[0]["tokens"], facts[0]["types"]) if facts else (0, 0)
    weights = [(facts[k]["singles"] + 0.5) / (facts[k]["tokens"] + 1.0) if facts else 1.0 for k in range(order)]

    def walk(left, right):
        ids, out = pa.array([], left.schema.field("ids").type.value_type), {n: [] for n in ("held_out", "n_tokens", "n_known", "base_score", "score")}
        if left.num_rows:
            if left.num_rows > 1:
                raise ValueError("chunks share a name")
            ids = left.column("ids").combine_chunks().flatten()
            if isinstance(ids, pa.ChunkedArray):
                ids = ids.combine_chunks()
            grams = _grams(left.column("body")[0].as_py(), left.column("sizes")[0].as_py(), order)
            got = sorted(zip(right.column("key").to_pylist(), right.column("n").to_pylist(), right.column("counts").to_pylist()))
            counts = []
            for level, hashes in enumerate(grams.levels):
                found, at = numbered(hashes)
                mine = np.concatenate([_unpacked(c, n, 8) for k, n, c in got if k // buckets == level])
                if len(mine) != len(found):
                    raise ValueError("a chunk has not all its counts")
                counts.append(mine.astype(np.int64)[at])
            starts = int(counts[0][grams.last[0] - 1])  # training texts: as many as ends
            arcs, there, fails = automaton(grams, counts, starts, tokens, words, weights)
            known = counts[0] > 0
            total = np.r_[0, np.cumsum(known)]
            out["held_out"] = [not x for x in left.column("learn")[0].as_py()]
            out["n_tokens"], out["n_known"] = (grams.last - grams.first).tolist(), (total[grams.last] - total[grams.first]).tolist()
            out["base_score"] = np.add.reduceat(arcs[0], grams.first).tolist()
            depth = order - 1 if starts else 0
            out["score"] = [traverse([x[a:b].tolist() for x in arcs], [x[a:b].tolist() for x in there], known[a:b].tolist(), fails, depth) for a, b in zip(grams.first.tolist(), grams.last.tolist())]
        n = len(ids)
        return pa.table([ids, pa.array(out["held_out"], pa.bool_()), pa.array(out["n_tokens"], pa.int64()), pa.array(out["n_known"], pa.int64()), pa.array([tokens] * n, pa.int64()), pa.array(out["base_score"], pa.float64()), pa.array(out["score"], pa.float64())],
                        names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("held_out", T.BooleanType()), *[T.StructField(n, T.LongType()) for n in ("n_tokens", "n_known", "train_tokens")], T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])
    return chunks.groupBy("chunk").cogroup(answers.where("chunk IS NOT NULL").drop("facts").groupBy("chunk")).applyInArrow(walk, schema)
