"""Whitening of embeddings: leading components by Chebyshev-filtered subspace iteration over passes of Spark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harrow.llm.common import shared_path

#: Integers up to here are exact as doubles.
LARGEST = 1 << 52


def integers(vectors: DataFrame, id_col="vec_id", vec_col="embedding", scale=1024, offset=100_000) -> DataFrame:
    """(vec_id, x): x = floor(scale * entry) + offset, as longs. Vectors that are null, empty or hold a null or non-finite entry take no part; an entry whose integer is beyond 2^52 stops the job."""
    v = F.col(vec_col).cast("array<double>")
    sound = vectors.where(v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    whole = lambda c: F.when(F.abs(c) * scale < LARGEST - offset, F.floor(c * scale) + offset).otherwise(F.raise_error(F.lit("an entry is too large for exact integers")).cast("long"))
    return sound.select(F.col(id_col).alias("vec_id"), F.transform(v, whole).alias("x"))


def _matrix(column, dims: int) -> np.ndarray:
    """The vectors of an Arrow column as rows; another length than dims stops the job."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) != dims * len(column) or (np.diff(column.offsets.to_numpy()) != dims).any():
        raise ValueError(f"vectors have different lengths; the first has {dims}")
    return flat.reshape(-1, dims)


#: Columns of packed vectors: the narrowest that holds a block's integers holds it.
WIDTHS = {"i2": np.dtype("<i2"), "i4": np.dtype("<i4"), "i8": np.dtype("<i8")}
#: Blocks are so large that an Arrow batch of them has about so many bytes.
BATCH_BYTES = 32 << 20


def packed(rows: DataFrame, offset: int) -> DataFrame:
    """(dims, ids, i2, i4, i8) of rows (vec_id, x): blocks of vectors of one length, x - offset as bytes in one of the three columns, the others empty.

    A pass over them moves bytes, where one over arrays would convert each entry twice. Nothing is shuffled. Other lengths in a batch stop the job.
    """
    most = int(rows.sparkSession.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    block_bytes = BATCH_BYTES // (most if most > 0 else 10_000)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            dims = len(b.column(1)[0])
            x = _matrix(b.column(1), dims) - offset
            name, kind = next((w, k) for w, k in WIDTHS.items() if np.iinfo(k).min <= x.min() and x.max() <= np.iinfo(k).max)
            each = max(1, block_bytes // (dims * kind.itemsize))
            edges = np.r_[np.arange(0, len(x), each), len(x)].astype(np.int32)
            data = pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges * np.int32(dims * kind.itemsize)), pa.py_buffer(np.ascontiguousarray(x.astype(kind)))])
            none = pa.array([b""] * len(data), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([dims] * len(data), pa.int32()), pa.ListArray.from_arrays(pa.array(edges), b.column(0)), *[data if w == name else none for w in WIDTHS]], ["dims", "ids", *WIDTHS])

    ids = T.StructField("ids", T.ArrayType(rows.schema["vec_id"].dataType))
    return rows.select("vec_id", "x").mapInArrow(pack, T.StructType([T.StructField("dims", T.IntegerType()), ids, *[T.StructField(w, T.BinaryType()) for w in WIDTHS]]))


def unpacked(batch: pa.RecordBatch, dims: int, at_once=256) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """(blocks, their vectors as rows of integers), up to at_once blocks of one width at a time."""
    for name, kind in WIDTHS.items():
        some = batch.filter(pc.greater(pc.binary_length(batch.column(name)), 0))
        for i in range(0, some.num_rows, at_once):
            blocks = some.slice(i, at_once)
            yield blocks, np.frombuffer(b"".join(blocks.column(name).to_pylist()), kind).reshape(-1, dims)


#: So many partial sums are added at once.
FAN_IN = 64
#: A round's filter lets a vector grow by this at most, relative to those it damps.
MOST_GROWTH = 1e10


def _blob(matrix: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"m": pa.array([np.ascontiguousarray(matrix, np.float64).tobytes()], pa.binary())})


class Centred:
    """Distributed sums over the centred vectors of a table of blocks (packed()).

    The mean is kept as whole part and remainder, so that a centred entry has the precision of its own size and not of the offset's. Each pass reads the table once, without a shuffle of its rows;
    a partition gives one matrix whose size follows the dimensions and not the vectors, and these are added up in a tree.
    """

    def __init__(self, rows: DataFrame, dims: int):
        self.rows, self.dims, self.partitions = rows, dims, rows.rdd.getNumPartitions()

        def sums(batches):
            n, total = 0, [0] * dims
            for _, x in (m for b in batches for m in unpacked(b, dims)):
                step = 1 << 9 if x.dtype.itemsize == 8 and np.abs(x).max(initial=0) >= 1 << 40 else 1 << 20  # sums of so many stay within a long
                for i in range(0, len(x), step):
                    total = [t + int(s) for t, s in zip(total, x[i:i + step].sum(axis=0, dtype=np.int64))]
                n += len(x)
            if n:
                yield pa.RecordBatch.from_pydict({"dim": pa.array(range(dims), pa.int32()), "n": pa.array([n] * dims, pa.int64()), "total": pa.array(map(str, total), pa.string())})

        found = rows.select(*WIDTHS).mapInArrow(sums, "dim int, n long, total string").groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
        self.n = found[0]["n"]
        self.sums = [int(t) for _, t in sorted((r["dim"], r["total"]) for r in found)]
        self.whole = np.array([s // self.n for s in self.sums], np.int64)
        self.left = [s % self.n for s in self.sums]
        self.part = np.array([r / self.n for r in self.left])

    def centre(self):
        whole, part = self.whole, self.part
        return lambda x: (x - whole) - part

    def _added(self, width: int, per_batch) -> np.ndarray:
        """The sum of per_batch(centred rows), a matrix of fixed size with `width` columns, over all batches: one for each partition, then FAN_IN at a time on the workers until at most FAN_IN are left for the driver."""
        centre, dims = self.centre(), self.dims

        def partial(batches):
            total = None
            for _, x in (m for b in batches for m in unpacked(b, dims)):
                one = per_batch(centre(x))
                total = one if total is None else total + one
            if total is not None:
                yield _blob(total)

        def together(batches):
            blobs = [m for b in batches for m in b.column(0).to_pylist()]
            if blobs:
                yield _blob(sum(np.frombuffer(m) for m in blobs))

        parts, n = self.rows.select(*WIDTHS).mapInArrow(partial, "m binary"), self.partitions
        while n > FAN_IN:
            n = -(-n // FAN_IN)
            parts = parts.repartition(n).mapInArrow(together, "m binary")
        return sum(np.frombuffer(r["m"]) for r in parts.collect()).reshape(-1, width)

    def times(self, q: np.ndarray) -> np.ndarray:
        """V q for the covariance V (divisor n), by one pass: each row y adds y (y q)."""
        return self._added(q.shape[1], lambda y: y.T @ (y @ q)) / self.n

    def trace(self) -> float:
        return float(self._added(1, lambda y: (y * y).sum(axis=0)[:, None]).sum() / self.n)

    def spread(self, axes: np.ndarray) -> np.ndarray:
        """The covariance (divisor n) of the rows projected on axes."""
        k = axes.shape[1]

        def moments(y):
            z = y @ axes
            return np.c_[z.T @ z, z.sum(axis=0)]

        m = self._added(k + 1, moments) / self.n
        return m[:, :k] - np.outer(m[:, k], m[:, k])


def least_eigenvalue(times, dims: int, steps: int, rng) -> float:
    """A lower estimate of the smallest eigenvalue, 0 at least, by a short Lanczos run with full reorthogonalisation: the smallest Ritz value less its residual."""
    q, qs, alpha, beta = rng.standard_normal(dims), [], [], []
    q /= np.linalg.norm(q)
    for _ in range(min(steps, dims)):
        qs.append(q)
        w = times(q[:, None])[:, 0]
        alpha.append(q @ w)
        basis = np.array(qs)
        for _ in range(2):
            w = w - basis.T @ (basis @ w)
        beta.append(np.linalg.norm(w))
        if beta[-1] <= 1e-12 * max(map(abs, alpha)):
            break
        q = w / beta[-1]
    e, z = np.linalg.eigh(np.diag(alpha) + np.diag(beta[:-1], 1) + np.diag(beta[:-1], -1))
    return max(0.0, float(e[0] - beta[-1] * abs(z[-1, 0])))


def leading(times, dims: int, count: int, guard=16, degree=16, tolerance=1e-13, most_rounds=60, seed=20) -> tuple[np.ndarray, np.ndarray, dict]:
    """(eigenvalues, unit eigenvectors as columns, facts) of the `count` largest of a symmetric non-negative operator given by times(block).

    A block of count + guard random vectors is filtered by a Chebyshev polynomial of the operator that stays within 1 on the unwanted part of the spectrum, between a Lanczos
    estimate of the smallest eigenvalue and the block's smallest Ritz value, and grows beyond it; each step of the three-term recurrence is one pass. Then come QR and
    Rayleigh-Ritz. It ends when the residual |Vu - eu| of each wanted pair is at most tolerance times the largest eigenvalue, or, once below a hundred times that, when rounding lets it fall no
    further; that bounds the distance of e to an eigenvalue, and that of u, over its gap. If that is not reached in most_rounds rounds, it raises. Guard vectors make the rate that of the gap to the value after the
    whole block. A block as large as the space needs no filter. Vectors have their largest entry positive.

    A filter of full degree would blow up the vector of an eigenvalue far above the others (that of many copies, say) until rounding leaves nothing else in the block. So a round's degree is the largest that amplifies by MOST_GROWTH
    at most, and leading pairs that have converged are projected out of each step; they stay in the block as they are.
    """
    rng = np.random.default_rng(seed)
    width, passes = min(dims, count + guard), [0]

    def counted(q):
        passes[0] += 1
        return times(q)

    q = np.linalg.qr(rng.standard_normal((dims, width)))[0]
    low = least_eigenvalue(counted, dims, 10, rng) if width < dims else 0.0
    worst = np.inf
    for rounds in range(most_rounds):
        w = counted(q)
        h = q.T @ w
        e, z = np.linalg.eigh((h + h.T) / 2)
        e, z = e[::-1], z[:, ::-1]
        u, vu = q @ z, w @ z
        residuals = np.linalg.norm(vu - u * e, axis=0)[:count]
        before, worst = worst, residuals.max()
        if worst <= tolerance * e[0] or (worst <= 100 * tolerance * e[0] and worst > before / 4):
            u = u[:, :count]
            return e[:count], u * np.sign(u[np.abs(u).argmax(axis=0), range(u.shape[1])]), {"rounds": rounds + 1, "passes": passes[0], "residual": float(worst)}
        done = int((residuals <= tolerance * e[0]).cumprod().sum())
        kept, u, vu = u[:, :done], u[:, done:], vu[:, done:]
        high = max(e[-1] if e[done] - e[-1] > 1e-6 * e[0] else (low + e[-1]) / 2, low + 1e-6 * e[0])  # what is left of the block is one value: damp what lies well below it
        centre, half = (high + low) / 2, (high - low) / 2
        top = (max(e[done], high * (1 + 1e-6)) - centre) / half
        steps = max(1, min(degree, int(np.log(2 * MOST_GROWTH) / np.arccosh(top))))
        left = lambda y: y - kept @ (kept.T @ y)
        first = 1 / top
        ratio, old, new = first, u, left(vu - centre * u) * (first / half)
        for _ in range(steps - 1):
            after = 1 / (2 / first - ratio)
            old, new = new, left(counted(new) - centre * new) * (2 * after / half) - ratio * after * old  # projected as a whole: of V's part alone the rest is an eigenvalue 0, which lies far below a narrow spectrum, and rounding would grow along kept
            ratio = after
        q = np.linalg.qr(np.c_[kept, left(new)])[0]
    raise ValueError(f"residual {worst} after {most_rounds} rounds")


def deviations(x: np.ndarray, n: int, left: list[int], exact=False) -> pa.Array:
    """Of each row the exact sum of (n x - left)^2 over the dimensions, for whole x: as longs, of which one that does not fit raises, or, if exact, as decimals of 38 digits."""
    dims, most, kind = x.shape[1], int(np.abs(x).max(initial=0)), pa.decimal128(38, 0) if exact else pa.int64()
    if max(most, n) * most * dims < 1 << 62 and n < 1 << 62:
        squares, cross, rest = (x * x).sum(axis=1), (x * np.array(left, np.int64)).sum(axis=1), sum(r * r for r in left)
        if n * n * int(squares.max(initial=1)) + 2 * n * int(np.abs(cross).max(initial=0)) + rest < 1 << 62:
            return pa.array(n * n * squares - 2 * n * cross + rest, pa.int64()).cast(kind)
        found = [n * n * a - 2 * n * b + rest for a, b in zip(squares.tolist(), cross.tolist())]
    else:
        found = ((x.astype(object) * n - np.array(left, object)) ** 2).sum(axis=1).tolist()
    if max(found, default=0) >= (10 ** 38 if exact else 1 << 63):
        raise ValueError("a deviation is beyond 38 digits" if exact else "a deviation is beyond a long")
    return pa.array(found, kind)


def whiten(vectors: DataFrame, id_col="vec_id", vec_col="embedding", components=8, scale=1024, offset=100_000, exact=False, **method) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each vector and leading component.

    x-vectors are integers() of all sound vectors, kept once, packed, as Parquet in the shared folder; the fit is over all of them, with exact sums S. deviation is the exact sum of (n x - S)^2 over the
    dimensions; as that grows with the square of n, it leaves a long from some 3,000,000 vectors of length 1 on. One beyond a long stops the job, unless exact is set: then a last column, deviation_exact, has each as a decimal of 38 digits (one
    beyond that stops the job), and deviation is null where it is no long. whitened the centred x on the component's unit eigenvector over the root of its eigenvalue, explained that eigenvalue's share of the trace,
    identity_error the largest entry of whitened's covariance less the identity.

    Null, empty and non-finite vectors give no rows; null ids and repeated rows are rows as all others. Components whose eigenvalue is 0 up to rounding (1e-12 of the largest) are left out, so
    equal vectors, and a single one, give no rows; nor do no vectors. Equal eigenvalues have any basis of their space. Vectors of different lengths stop the job. Other columns are ignored.
    """
    spark = vectors.sparkSession
    path = shared_path(spark, "whitening")
    packed(integers(vectors, id_col, vec_col, scale, offset), offset).write.parquet(path)
    rows = spark.read.parquet(path)
    measure = T.DecimalType(38, 0) if exact else T.LongType()
    schema = T.StructType([T.StructField("vec_id", rows.schema["ids"].dataType.elementType), T.StructField("exactly", measure), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    least, most = rows.agg(F.min("dims"), F.max("dims")).first()
    if least != most:
        raise ValueError(f"vectors have different lengths, {least} to {most}")
    values, axes, n, trace, error = np.zeros(0), None, 0, 1.0, 0.0
    if least:
        table = Centred(rows, least)
        n, trace = table.n, table.trace()
        if trace > 0:
            values, axes, _ = leading(table.times, table.dims, min(components, table.dims), **method)
            sound = values > 1e-12 * values[0]
            values, axes = values[sound], axes[:, sound] / np.sqrt(values[sound])
            error = float(np.abs(table.spread(axes) - np.eye(len(values))).max())
    if not len(values):
        done = spark.createDataFrame([], schema)
    else:
        centre, dims, whole, left = table.centre(), table.dims, table.whole, table.left

        def project(batches):
            for blocks, x in (m for b in batches for m in unpacked(b, dims)):
                z = np.ascontiguousarray(centre(x) @ axes)
                spots = pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1])
                yield pa.RecordBatch.from_arrays([blocks.column("ids").flatten(), deviations(x - whole, n, left, exact), pa.ListArray.from_arrays(spots, pa.array(z.ravel()))], names=["vec_id", "exactly", "whitened"])

        done = rows.select("ids", *WIDTHS).mapInArrow(project, schema)
    deviation = F.when(F.col("exactly") <= F.lit((1 << 63) - 1), F.col("exactly")).cast("long").alias("deviation") if exact else F.col("exactly").alias("deviation")
    share = F.get(F.array(*[F.lit(float(v / trace)) for v in values]), F.col("at")) if len(values) else F.lit(None).cast("double")
    spread = done.select("vec_id", deviation, F.posexplode("whitened").alias("at", "whitened"), "exactly")
    return spread.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error"), *[F.col("exactly").alias("deviation_exact")] * exact)
