"""Alignment of two tokenizers over all documents, with corpus-wide counts of linked id pairs in a minimal perfect hash table."""

from __future__ import annotations

import hashlib
import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harrow.llm.common import cut, shared_path, small_batches
from harrow.llm.perfect_hash import PerfectHash, build, shard_of

U = np.uint64
SPACE_MARK = "▁"
#: A place where both tokenizers begin anew whatever stands on its two sides: before a space that follows a character other than white space.
SEAM = re.compile(r"(?<=\S) ")
DOUBLE = re.compile(r"\s ")
FIGURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def tokenizer_paths() -> tuple[str, str]:
    """Where the installed public vocabularies lie."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _byte_of_letter() -> dict[str, int]:
    """Byte-level vocabularies write each byte as one letter: printable ones as themselves, the others, in order, as the letters from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class Tokenizers:
    """Both tokenizers, and of each of their ids the bytes and the decimal text."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters, vocabulary = _byte_of_letter(), self.a.get_vocab(with_added_tokens=True)
        bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            bytes_a[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE_MARK, " ").encode() for i, p in enumerate(pieces)]
        self.bytes_a, self.bytes_b = (np.array([*x, None], object)[:-1] for x in (bytes_a, bytes_b))
        self.len_a, self.len_b = (np.array([len(t) for t in x], np.int64) for x in (bytes_a, bytes_b))
        name = lambda n, ends: np.array([f"{i}{e}" for e in ends for i in range(n)], object)
        self.name_a, self.name_b = name(len(bytes_a), ",|"), name(len(bytes_b), ",;")
        # no piece goes over a seam: none has the space mark after another character
        self.seams = not any(re.search(f"[^{SPACE_MARK}]{SPACE_MARK}", p) for p in pieces)

    def encode(self, parts: list[str], at_once=8192):
        """ids and number of ids of each part, for a and b; each part stands after a space, which b adds by itself."""
        out = [], [], [], []
        flat = lambda x: (np.fromiter(chain.from_iterable(x), np.int64), np.fromiter(map(len, x), np.int64, len(x)))
        for i in range(0, len(parts), at_once):
            some = parts[i:i + at_once]
            a = [e.ids for e in self.a.encode_batch_fast([" " + p for p in some], add_special_tokens=False)]
            for into, x in zip(out, (*flat(a), *flat(self.b.encode(some, num_threads=1)))):
                into.append(x)
        return [np.concatenate([np.zeros(0, np.int64), *x]) for x in out]


@lru_cache(maxsize=2)
def _tokenizers(path_a: str, path_b: str) -> Tokenizers:
    return Tokenizers(path_a, path_b)


def _parts(text: str) -> list[str]:
    """text with a space before it, cut at its seams; of each part what follows its first space."""
    if text[0] != " " and not DOUBLE.search(text):
        return text.split(" ")
    first, *more = SEAM.split(" " + text)
    return [first[1:], *more]


class _Numbers(dict):
    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def _different(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.r_[np.ones(min(1, len(x)), bool), x[1:] != x[:-1]]]


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], ..., first[0] + size[0] - 1, first[1], ..."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - size), size)


def _sums(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(values, dtype=np.int64)]
    return total[last] - total[first]


class Aligned:
    """The aligned tokens of some texts (None where a text is null or no UTF-8).

    A text is cut at its seams; equal parts of all texts are encoded and aligned once, and a text's alignment is that of its parts in order, as both tokenizers end a token at each seam.
    A text of which a part does not decode to itself is encoded again as a whole, and has no tokens if that fails too.
    """

    def __init__(self, texts: list[str | None], tok: Tokenizers):
        self.tok, numbers, found = tok, _Numbers(), []
        for t in texts:
            found.append(list(map(numbers.__getitem__, _parts(t) if tok.seams else [t])) if t else [])
        self._align(list(numbers))
        if not self.sound.all():
            for i, parts in enumerate(found):
                if parts and not self.sound[parts].all():
                    found[i] = [numbers[texts[i]]]
            if len(numbers) > len(self.sound):
                self._align(list(numbers))
            found = [p if not p or self.sound[p].all() else [] for p in found]
        self.size = np.fromiter(map(len, found), np.int64, len(found))
        self.parts = np.fromiter(chain.from_iterable(found), np.int64, int(self.size.sum()))
        self.last = np.cumsum(self.size)
        self.first = self.last - self.size

    def _align(self, parts: list[str]) -> None:
        tok, raw = self.tok, [b" " + p.encode() for p in parts]
        ids_a, n_a, ids_b, n_b = tok.encode(parts)
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        last_a, last_b = np.cumsum(n_a), np.cumsum(n_b)
        joined = [b"".join(tok.bytes_a[ids_a]), b"".join(tok.bytes_b[ids_b])]
        self.sound = np.ones(len(raw), bool)
        if any(j != b"".join(raw) for j in joined) or (_sums(tok.len_a[ids_a], last_a - n_a, last_a) != size).any() or (_sums(tok.len_b[ids_b], last_b - n_b, last_b) != size).any():
            for i, r in enumerate(raw):
                self.sound[i] = all(b"".join(by[ids[e - n:e]]) == r for by, ids, e, n in ((tok.bytes_a, ids_a, last_a[i], n_a[i]), (tok.bytes_b, ids_b, last_b[i], n_b[i])))
            ids_a, ids_b = ids_a[np.repeat(self.sound, n_a)], ids_b[np.repeat(self.sound, n_b)]
            n_a, n_b, size = n_a * self.sound, n_b * self.sound, size * self.sound
        self.ids_a, self.ids_b, self.n_a, self.n_b = ids_a, ids_b, n_a, n_b
        self.end_a, self.end_b = np.cumsum(tok.len_a[ids_a]), np.cumsum(tok.len_b[ids_b])
        # between two neighbouring ends of either kind lies a part of one token of a and of one of b: that is a link, and each link is there once
        every = np.sort(np.concatenate([self.end_a, self.end_b]))
        again = np.r_[every[1:] == every[:-1], np.zeros(min(1, len(every)), bool)]
        cuts, self.group_ends = every[~again], every[again]
        ends = np.cumsum(size)
        at = np.searchsorted(cuts, ends, "right")
        self.link_last, self.link_first = at, np.r_[0, at[:-1]].astype(np.int64)
        self.pairs = (ids_a[np.searchsorted(self.end_a, cuts)] << 32) | ids_b[np.searchsorted(self.end_b, cuts)]
        at = np.searchsorted(self.group_ends, ends, "right")
        self.n_groups = np.diff(np.r_[0, at])

    def of_texts(self, of_parts: np.ndarray) -> np.ndarray:
        return _sums(of_parts[self.parts], self.first, self.last)

    def used_links(self) -> np.ndarray:
        """The links of parts that texts with tokens have; a text without may have left others."""
        parts = _different(self.parts)
        return _ranges(self.link_first[parts], self.link_last[parts] - self.link_first[parts])

    def pair_documents(self) -> tuple[np.ndarray, np.ndarray]:
        """The different pairs and of each the number of texts that hold it."""
        pairs = _different(self.pairs)
        number = np.searchsorted(pairs, self.pairs)
        step = len(self.n_a) + 1
        held = _different(np.repeat(np.arange(len(self.size)), self.size) * step + self.parts)
        text, part = held // step, held % step
        n = self.link_last[part] - self.link_first[part]
        links = number[_ranges(self.link_first[part], n)]
        held = _different(np.repeat(text, n) * (len(pairs) + 1) + links)
        counts = np.bincount(held % (len(pairs) + 1), minlength=len(pairs))
        return pairs[counts > 0], counts[counts > 0]

    def group_texts(self) -> list[str]:
        """Of each text its groups, as a1,a2|b1;a3|b2,b3."""
        group_a, group_b = np.searchsorted(self.group_ends, self.end_a), np.searchsorted(self.group_ends, self.end_b)
        closes = lambda g: np.r_[g[1:] != g[:-1], np.ones(min(1, len(g)), bool)]
        names = np.empty(len(group_a) + len(group_b), object)
        names[np.arange(len(group_a)) + np.searchsorted(group_b, group_a)] = self.tok.name_a[self.ids_a + len(self.tok.len_a) * closes(group_a)]
        names[np.arange(len(group_b)) + np.searchsorted(group_a, group_b, "right")] = self.tok.name_b[self.ids_b + len(self.tok.len_b) * closes(group_b)]
        names, stop = names.tolist(), np.cumsum(self.n_a + self.n_b)
        of_part = ["".join(names[a:b]) for a, b in zip(stop - self.n_a - self.n_b, stop)]
        return ["".join([of_part[p] for p in self.parts[a:b].tolist()])[:-1] for a, b in zip(self.first, self.last)]


def _texts(column) -> list[str | None]:
    out = []
    for b in column.to_pylist():
        try:
            out.append(b.decode() if b else None)
        except UnicodeDecodeError:
            out.append(None)
    return out


def _blocks(batches, most: int):
    """The rows of Arrow batches as tables whose texts (last column) are about `most` bytes together; one text at least."""
    held, size = [], 0
    for b in batches:
        begin = 0
        for i, n in enumerate(pc.fill_null(pc.binary_length(b.column(b.num_columns - 1)), 0).to_pylist()):
            if size and size + n > most:
                yield pa.Table.from_batches([*held, b.slice(begin, i - begin)])
                held, size, begin = [], 0, i
            size += n
        held.append(b.slice(begin))
    if any(b.num_rows for b in held):
        yield pa.Table.from_batches(held)


def _merged(pairs: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate(pairs), return_inverse=True)
    return keys, np.bincount(at, np.concatenate(counts), len(keys)).astype(np.int64)


def count_pairs(docs: DataFrame, text_col="text", paths: tuple[str, str] | None = None, block_bytes=16 << 20, most_pairs=2_000_000) -> DataFrame:
    """(task, pair, n): of each task and pair of linked ids (a << 32 | b) the documents that hold it; a task that meets more than most_pairs different ones writes them in several parts."""
    paths = paths or tokenizer_paths()

    def count(batches):
        task, pairs, counts = TaskContext.get().partitionId(), [], []

        def out():
            k, n = _merged(pairs, counts)
            for i in range(0, len(k), 100_000):
                yield pa.RecordBatch.from_pydict({"task": pa.array(np.full(len(k[i:i + 100_000]), task)), "pair": pa.array(k[i:i + 100_000]), "n": pa.array(n[i:i + 100_000])})

        for b in _blocks(batches, block_bytes):
            k, n = Aligned(_texts(b.column(0)), _tokenizers(*paths)).pair_documents()
            pairs, counts = [*pairs, k], [*counts, n]
            if sum(map(len, pairs)) > most_pairs:
                k, n = _merged(pairs, counts)
                pairs, counts = [k], [n]
                if len(k) > most_pairs:
                    yield from out()
                    pairs, counts = [], []
        if pairs:
            yield from out()

    small_batches(docs.sparkSession)
    return docs.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(count, "task long, pair long, n long")


def pair_table(counted: DataFrame, keys_per_shard=50_000, fan_in=64) -> DataFrame:
    """(shard, sizes, words, keys, counts): a minimal perfect hash function over all different pairs of `counted`, and of each slot its key and the documents that hold it.

    Different pairs are dealt to shards by hash, and a shard's function is built in one task. Each block of fan_in tasks adds its counts to a dense vector over the shard's slots, and vectors are added
    fan_in at a time until each shard has one; so no group has more than fan_in vectors or the pairs of fan_in tasks. A pair whose slot holds another key stops the job.
    """
    pairs = cut(counted.select("pair").distinct())
    shards = max(1, -(-pairs.count() // keys_per_shard))

    def with_shard(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shard_of(b.column(b.num_columns - 1).to_numpy(), shards))], names=[*b.schema.names, "shard"])

    def functions(key, frame):
        keys = np.sort(frame["pair"].to_numpy())
        sizes, words = build(keys)
        placed = np.empty_like(keys)
        placed[_slots(sizes, words, keys)] = keys
        return pd.DataFrame([(key[0], sizes, words.tobytes(), placed.tobytes())], columns=["shard", "sizes", "words", "keys"])

    made = cut(pairs.mapInArrow(with_shard, "pair long, shard long").groupBy("shard").applyInPandas(functions, "shard long, sizes array<long>, words binary, keys binary"))
    dealt = counted.select((F.col("task") / fan_in).cast("long").alias("block"), "n", "pair").mapInArrow(with_shard, "block long, n long, pair long, shard long")
    blocks = dealt.agg(F.max("block")).first()[0] or 0
    each = made.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks).cast("long"))))

    def dense(key, found, function):
        if not len(function) or not len(found):
            return pd.DataFrame({"shard": [], "block": [], "counts": []})
        f = function.iloc[0]
        keys, at = np.frombuffer(f["keys"], np.int64), _slots(list(f["sizes"]), np.frombuffer(f["words"], U), found["pair"].to_numpy())
        if (at < 0).any() or (keys[at] != found["pair"].to_numpy()).any():
            raise ValueError("a pair is not the key of its slot")
        counts = np.bincount(at, found["n"].to_numpy(), len(keys)).astype(np.int64)
        return pd.DataFrame([(key[0], key[1] // fan_in, counts.tobytes())], columns=["shard", "block", "counts"])

    def added(key, frame):
        total = sum(np.frombuffer(c, np.int64) for c in frame["counts"])
        return pd.DataFrame([(key[0], key[1] // fan_in, total.tobytes())], columns=["shard", "block", "counts"])

    vectors, schema = dealt.groupBy("shard", "block").cogroup(each.groupBy("shard", "block")).applyInPandas(dense, "shard long, block long, counts binary"), "shard long, block long, counts binary"
    while blocks:
        vectors, blocks = vectors.groupBy("shard", "block").applyInPandas(added, schema), blocks // fan_in
    return made.join(vectors.drop("block"), "shard")


def _slots(sizes: list[int], words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The slots of keys in one shard."""
    whole = PerfectHash([(sizes, words)])
    return whole.slots(keys)


class PairCounts:
    """The hash table as a worker holds it: slot -> key, count, and whether the count is the highest of the key's id of a."""

    def __init__(self, shards: list[tuple], highest: dict[int, int]):
        self.hash = PerfectHash([(s, np.frombuffer(w, U)) for s, w, _, _ in shards])
        self.keys = np.concatenate([np.frombuffer(k, np.int64) for *_, k, _ in shards] or [np.zeros(0, np.int64)])
        self.counts = np.concatenate([np.frombuffer(c, np.int64) for *_, c in shards] or [np.zeros(0, np.int64)])
        self.best = self.counts == np.array([highest[a] for a in (self.keys >> 32).tolist()], np.int64)

    def look_up(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        different = _different(pairs)
        at = np.searchsorted(different, pairs)
        slots = self.hash.slots(different)
        if (slots < 0).any() or (self.keys[slots] != different).any():
            raise ValueError("a pair is not the key of its slot")
        return self.counts[slots][at], self.best[slots][at]


def _figures(aligned: Aligned) -> dict[str, np.ndarray]:
    return {"n_a": aligned.of_texts(aligned.n_a), "n_b": aligned.of_texts(aligned.n_b), "n_groups": aligned.of_texts(aligned.n_groups), "n_links": aligned.of_texts(aligned.link_last - aligned.link_first)}


def _digests(aligned: Aligned) -> list[str]:
    return [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in aligned.group_texts()]


def align(docs: DataFrame, id_col="doc_id", text_col="text", paths: tuple[str, str] | None = None, broadcast_bytes=128 << 20, block_bytes=16 << 20, keys_per_shard=50_000) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256): a row for each document.

    Token a of the byte-level vocabulary and token b of the piece vocabulary are linked where their bytes in space+text overlap; groups lie between places where both end. A first pass aligns all
    documents and counts, for each task and pair of ids, the documents that hold it linked; pair_table() hashes all different pairs and adds the counts up. A second pass aligns the documents again and
    looks the counts up: count_sum adds them over the document's links, n_best counts links whose count is the highest of their a.

    The second pass holds the table in each worker if it has at most broadcast_bytes (about 21 bytes a pair); a larger one is joined by pair with the links of each different text. Of the driver's
    memory, the table's highest counts take a number for each id of a's vocabulary.

    Null and empty texts, texts that are no UTF-8 and texts that either tokenizer does not give back byte for byte have no tokens: zeros, and '' for the digest. Rows that repeat an id, or id and text, are
    documents of their own; null ids too. No rows give no rows. Other columns are ignored. A text is one task's, whatever its length.
    """
    spark, paths = docs.sparkSession, paths or tokenizer_paths()
    path = shared_path(spark, "pairs")
    count_pairs(docs, text_col, paths, block_bytes).write.parquet(path)
    table = cut(pair_table(spark.read.parquet(path), keys_per_shard))

    def tops(batches):
        for b in batches:
            for keys, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                a, n = np.frombuffer(keys, np.int64) >> 32, np.frombuffer(counts, np.int64)
                order = np.lexsort((n, a))
                last = np.flatnonzero(np.r_[a[order][1:] != a[order][:-1], True])
                yield pa.RecordBatch.from_pydict({"a": pa.array(a[order][last]), "n": pa.array(n[order][last])})

    highest = {r["a"]: r["n"] for r in table.select("keys", "counts").mapInArrow(tops, "a long, n long").groupBy("a").agg(F.max("n").alias("n")).collect()}
    size = table.agg(F.sum(F.length("keys") + F.length("counts") + F.length("words")).cast("long")).first()[0] or 0
    id_type = docs.schema[id_col].dataType
    head = [T.StructField("doc_id", id_type)]
    figure = lambda names: [T.StructField(n, T.LongType()) for n in names]
    digest = [T.StructField("groups_sha256", T.StringType())]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    if size <= broadcast_bytes:
        held = spark.sparkContext.broadcast(([tuple(r) for r in table.orderBy("shard").select("sizes", "words", "keys", "counts").collect()], highest))

        def look_up(batches):
            counts = PairCounts(*held.value)
            for b in _blocks(batches, block_bytes):
                aligned = Aligned(_texts(b.column(1)), _tokenizers(*paths))
                used = aligned.used_links()
                count, best = np.zeros((2, len(aligned.pairs)), np.int64)
                count[used], best[used] = counts.look_up(aligned.pairs[used])
                of = lambda x: aligned.of_texts(_sums(x, aligned.link_first, aligned.link_last))  # noqa: B023, E731
                cols = _figures(aligned) | {"n_best": of(best), "count_sum": of(count)}
                yield from pa.table([b.column(0), *[pa.array(cols[n].astype(np.int64)) for n in FIGURES], pa.array(_digests(aligned), pa.string())], names=["doc_id", *FIGURES, "groups_sha256"]).combine_chunks().to_batches()

        return rows.mapInArrow(look_up, T.StructType(head + figure(FIGURES) + digest))

    def plain(batches):
        for b in _blocks(batches, block_bytes):
            aligned = Aligned(_texts(b.column(2)), _tokenizers(*paths))
            cols = _figures(aligned)
            yield from pa.table([b.column(0), b.column(1), *[pa.array(cols[n].astype(np.int64)) for n in FIGURES[:4]], pa.array(_digests(aligned), pa.string())], names=["doc_id", "key", *FIGURES[:4], "groups_sha256"]).combine_chunks().to_batches()

    def links(batches):
        for b in _blocks(batches, block_bytes):
            for i in range(b.num_rows):
                aligned = Aligned(_texts(b.column(1).slice(i, 1)), _tokenizers(*paths))
                n = aligned.link_last[aligned.parts] - aligned.link_first[aligned.parts]
                pairs, times = np.unique(aligned.pairs[_ranges(aligned.link_first[aligned.parts], n)], return_counts=True)
                yield pa.RecordBatch.from_pydict({"key": pa.array([b.column(0)[i].as_py()] * len(pairs), pa.binary()), "pair": pa.array(pairs), "times": pa.array(times)})

    def counts(batches):
        for b in batches:
            for keys, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                k, c = np.frombuffer(keys, np.int64), np.frombuffer(n, np.int64)
                yield pa.RecordBatch.from_pydict({"pair": pa.array(k), "n": pa.array(c), "best": pa.array(c == np.array([highest[a] for a in (k >> 32).tolist()]))})

    keyed = rows.withColumn("key", F.unhex(F.sha2(F.coalesce("text", F.lit(b"")), 256)))
    basic = keyed.select("doc_id", "key", "text").mapInArrow(plain, T.StructType([*head, T.StructField("key", T.BinaryType()), *figure(FIGURES[:4]), *digest]))
    linked = keyed.select("key", "text").dropDuplicates(["key"]).mapInArrow(links, "key binary, pair long, times long")
    found = linked.join(table.select("keys", "counts").mapInArrow(counts, "pair long, n long, best boolean"), "pair")
    sums = found.groupBy("key").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
    return basic.join(sums, "key", "left").na.fill(0, ["n_best", "count_sum"]).select("doc_id", *FIGURES, "groups_sha256")
