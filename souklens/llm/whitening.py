"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

The leading eigenvectors of a covariance V that is never formed: a block Q of a few more columns than
components is multiplied by V in distributed passes, each of which centres the rows and adds up
``X'(XQ)`` per task. A Chebyshev polynomial of V, run as its three-term recurrence over such passes,
damps the part of the spectrum below the block's smallest Ritz value; QR and a Rayleigh-Ritz step
follow, and their pass also gives the residuals that certify the components. The lower end of the
unwanted spectrum comes from a Lanczos column that rides along in the first filter's passes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souklens.functions.storage import materialise
from souklens.llm.textbytes import small_batches
from souklens.llm.vectors import matrix, usable

SCALE, SHIFT = 1024, 100_000
#: x saturates here, so that every x is exact as a double too.
X_LIMIT = 1 << 53
#: Columns of the block beside the wanted components.
EXTRA = 24
#: Residuals of certified components, as a share of the largest eigenvalue: reached, or else the least
#: that may be accepted once they no longer fall.
RESIDUAL, ACCEPTED = 1e-14, 1e-11
#: A component whose eigenvalue is under this share of the largest has no variance beyond rounding.
NO_VARIANCE = 1e-12
#: Degree of a filter, and how much more it may raise the largest eigenvalue than the last wanted one.
DEGREES, SPREAD = (4, 40), 1e12
ROUNDS = 60
#: Rows of a stored block, and the tasks whose partial sums go to the driver at once.
BLOCK_ROWS, FAN = 4096, 64


def quantised(values: np.ndarray) -> np.ndarray:
    """x = floor(1024 c) + 100000, saturated at 2^53."""
    return np.clip(np.floor(values * SCALE), -X_LIMIT + SHIFT, X_LIMIT - SHIFT).astype(np.int64) + SHIFT


class Moments:
    """Number of rows and exact sums per dimension; S = n q + r with 0 <= r < n."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        parts = [divmod(s, n) for s in sums]
        self.q = np.array([q for q, _ in parts], np.int64)
        self.r = [r for _, r in parts]
        self.fraction = np.array([r / n for r in self.r])

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n, subtracted in integers before rounding."""
        return (x - self.q).astype(np.float64) - self.fraction

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2, exact; None where it doesn't fit 64 bits."""
        off = x - self.q
        most = (int(np.abs(off).max(initial=0)) + 1) * self.n
        if most * most * len(self.q) < 1 << 62:
            wide = off * self.n - np.array(self.r, np.int64)
            return (wide * wide).sum(axis=1).tolist()
        wide = off.astype(object) * self.n - np.array(self.r, object)
        return [v if v < 1 << 63 else None for v in (wide * wide).sum(axis=1).tolist()]


def store_blocks(rows: DataFrame, d: int) -> DataFrame:
    """``ids array, x binary``: blocks of at most ``BLOCK_ROWS`` vectors as matrices of 64-bit integers, written once."""
    kind = rows.schema["id"].dataType.simpleString()

    def pack(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(a, BLOCK_ROWS)
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
                yield pa.RecordBatch.from_arrays([ids, pa.array([quantised(matrix(part.column(1), d)).tobytes()], pa.binary())], names=["ids", "x"])

    return materialise(rows.mapInArrow(pack, f"ids array<{kind}>, x binary"))


def block_of(raw: bytes, d: int) -> np.ndarray:
    return np.frombuffer(raw, np.int64).reshape(-1, d)


def tree_sum(parts: DataFrame, shape: tuple[int, ...], tasks: int) -> np.ndarray:
    """Sum of the double arrays in ``part``, one row per task; no more than ``FAN`` of them reach the driver."""

    def add(batches):
        total = np.zeros(shape)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                total += np.frombuffer(raw).reshape(shape)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    while tasks > FAN:
        tasks = math.ceil(tasks / FAN)
        parts = parts.repartition(tasks).mapInArrow(add, "part binary")
    return sum((np.frombuffer(r["part"]).reshape(shape) for r in parts.collect()), np.zeros(shape))


def moments(blocks: DataFrame, d: int) -> Moments | None:
    """Exact counts and sums; halves of 32 bits are added apart, so that no partial sum overflows."""

    def add(batches):
        n, halves = 0, np.zeros((2, d), np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                x = block_of(raw, d)
                n += len(x)
                halves += np.stack([(x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)])
        at = np.arange(d)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(np.full(d, n), pa.int64()), pa.array(halves[0]), pa.array(halves[1])], names=["j", "n", "high", "low"])

    sums = blocks.select("x").mapInArrow(add, "j int, n long, high long, low long").groupBy("j").agg(
        F.sum("n").alias("n"), *[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]).orderBy("j").collect()
    return Moments(sums[0]["n"], [(int(r["high"]) << 32) + int(r["low"]) for r in sums]) if sums and sums[0]["n"] else None


class Covariance:
    """V of the stored blocks, applied to a block of columns by one pass over them."""

    def __init__(self, blocks: DataFrame, d: int, known: Moments):
        self.blocks, self.d, self.known, self.passes = blocks.select("x"), d, known, 0
        self.tasks = self.blocks.rdd.getNumPartitions()
        self.context = blocks.sparkSession.sparkContext

    def _sum(self, work, shape: tuple[int, ...]) -> np.ndarray:
        d, known = self.d, self.known

        def add(batches):
            total = np.zeros(shape)
            for batch in batches:
                for raw in batch.column(0).to_pylist():
                    total += work(known.centred(block_of(raw, d)))
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

        self.passes += 1
        return tree_sum(self.blocks.mapInArrow(add, "part binary"), shape, self.tasks) / known.n

    def times(self, columns: np.ndarray) -> np.ndarray:
        shared = self.context.broadcast(columns)
        out = self._sum(lambda x: x.T @ (x @ shared.value), columns.shape)
        shared.destroy()
        return out

    def trace(self) -> float:
        return float(self._sum(lambda x: np.array([(x * x).sum()]), (1,))[0])

    def identity_error(self, vectors: np.ndarray, values: np.ndarray) -> float:
        """Largest entry of the whitened columns' covariance minus the identity."""
        shared, k = self.context.broadcast(vectors / np.sqrt(values)), len(values)

        def work(x: np.ndarray) -> np.ndarray:
            y = x @ shared.value
            return np.vstack([y.T @ y, y.sum(axis=0)])

        got = self._sum(work, (k + 1, k))
        return float(np.abs(got[:k] - np.outer(got[k], got[k]) - np.eye(k)).max())


class Ritz:
    """QR and Rayleigh-Ritz of a block: values falling, vectors, and residuals from the same pass."""

    def __init__(self, v: Covariance, block: np.ndarray):
        q = np.linalg.qr(block)[0]
        image = v.times(q)
        small = q.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-values, kind="stable")
        self.values, turn = values[order], turn[:, order]
        self.vectors = q @ turn
        self.image = image @ turn
        self.residuals = np.linalg.norm(self.image - self.vectors * self.values, axis=0)


def chebyshev(v: Covariance, ritz: Ritz, low: float, cut: float, degree: int, lanczos: "Lanczos | None") -> np.ndarray:
    """The block under the Chebyshev polynomial that is at most 1 on [low, cut], each column scaled as it goes."""
    centre, half = (cut + low) / 2, (cut - low) / 2
    before, now = ritz.vectors, (ritz.image - centre * ritz.vectors) / half
    for _ in range(degree - 1):
        size = np.maximum(np.linalg.norm(now, axis=0), np.finfo(float).tiny)
        before, now = before / size, now / size
        if lanczos:
            image = v.times(np.column_stack([now, lanczos.column]))
            lanczos.step(image[:, -1])
            image = image[:, :-1]
        else:
            image = v.times(now)
        before, now = now, 2 * (image - centre * now) / half - before
    return now


class Lanczos:
    """A Lanczos run for the smallest eigenvalue, one step for each pass that it rides along."""

    def __init__(self, d: int):
        start = np.random.default_rng(7).normal(size=d)
        self.basis, self.a, self.b = [start / np.linalg.norm(start)], [], []

    @property
    def column(self) -> np.ndarray:
        return self.basis[-1]

    def step(self, image: np.ndarray) -> None:
        if self.b and not self.b[-1]:
            return
        self.a.append(float(self.column @ image))
        basis = np.array(self.basis)
        for _ in range(2):  # against loss of orthogonality
            image = image - basis.T @ (basis @ image)
        size = float(np.linalg.norm(image))
        self.b.append(size if size > 1e-10 * max(map(abs, self.a)) else 0.0)
        if self.b[-1]:
            self.basis.append(image / size)

    def low(self) -> float:
        """A value at most the smallest eigenvalue, as a rule: the Ritz value less its residual."""
        if not self.a:
            return 0.0
        t = np.diag(self.a) + np.diag(self.b[:-1], 1) + np.diag(self.b[:-1], -1)
        values, vectors = np.linalg.eigh(t)
        return max(0.0, float(values[0] - self.b[-1] * abs(vectors[-1, 0])))


def principal(v: Covariance, k: int, extra: int = EXTRA) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The leading eigenvalues of V, falling, unit eigenvectors as columns, and their residuals.

    Ends when all residuals are at most ``RESIDUAL`` of the largest eigenvalue, or no longer fall and
    are at most ``ACCEPTED`` of it; raises ``ArithmeticError`` if ``ROUNDS`` filters don't get there.
    """
    d = v.d
    wide = min(d, k + extra)
    k = min(k, d)
    ritz = Ritz(v, np.random.default_rng(3).normal(size=(d, wide)))
    low, lanczos, best, still = 0.0, Lanczos(d), math.inf, 0
    for _ in range(ROUNDS):
        top = ritz.values[0]
        if not top > 0:
            return ritz.values[:0], ritz.vectors[:, :0], ritz.residuals[:0]
        worst = float(ritz.residuals[:k].max() / top)
        still = 0 if worst < best / 2 else still + 1
        best = min(best, worst)
        if worst <= RESIDUAL or worst <= ACCEPTED and still >= 2:
            return ritz.values[:k], ritz.vectors[:, :k], ritz.residuals[:k]
        low = min(low, float(ritz.values[-1]) / 2) if low >= ritz.values[-1] else low  # the estimate was too high
        cut = float(ritz.values[-1])
        if cut <= low or cut <= NO_VARIANCE * top:  # fewer directions than columns: nothing below to be damped
            cut = max(NO_VARIANCE * top, low * (1 + 1e-9))
        rise = lambda e: math.acosh(max(1 + 1e-12, (2 * e - cut - low) / (cut - low)))  # noqa: E731  growth of a column for each degree, as a logarithm
        last, first = rise(float(ritz.values[k - 1])), rise(float(top))
        need = math.log(max(10.0, 10 * worst / RESIDUAL)) / last
        room = math.log(SPREAD) / (first - last) if first > last else need
        degree = int(min(max(min(need, room), DEGREES[0]), DEGREES[1]))
        block = chebyshev(v, ritz, low, cut, degree, lanczos)
        if lanczos:
            low, lanczos = lanczos.low(), None
        ritz = Ritz(v, block / np.linalg.norm(block, axis=0))
    raise ArithmeticError(f"components not certified: residual {best:.2e} of the largest eigenvalue")


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 8) -> DataFrame:
    """``id, component, n, deviation, whitened, explained, identity_error`` for each vector and component up to ``k``.

    An entry c becomes x = floor(1024 c) + 100000 (saturated at 2^53). Components are unit eigenvectors of
    x's covariance (divisor n), numbered from 1 by falling eigenvalue e; ``whitened`` is x - S/n projected
    on the component, over sqrt(e); ``explained`` is e over the trace; ``deviation`` the exact sum over
    dimensions of (n x - S)^2, null where it doesn't fit 64 bits; ``identity_error`` the largest entry of
    the whitened columns' covariance minus the identity.

    Vectors that are null, empty or hold null or non-finite entries take no part, nor do those of another
    than the most frequent length. Components without variance are left out, so fewer than ``k`` come out of
    vectors that span fewer directions, and no row out of an empty table, one vector or equal vectors.
    Null ids and repeated rows are returned as given; other columns are ignored. The passes run when this is called.
    """
    kind = rows.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    small_batches(rows.sparkSession)
    picked, d = usable(rows, id_col, vector_col)
    blocks = store_blocks(picked, d) if d else None
    known = moments(blocks, d) if d else None
    if known is None:
        return rows.sparkSession.createDataFrame([], schema)
    v = Covariance(blocks, d, known)
    values, vectors, _ = principal(v, k)
    trace = v.trace()
    real = values > NO_VARIANCE * values.max(initial=0.0)
    values, vectors = values[real], vectors[:, real]
    k = len(values)
    if not k:
        return rows.sparkSession.createDataFrame([], schema)
    error = v.identity_error(vectors, values)
    turn, explained = v.context.broadcast(vectors / np.sqrt(values)), values / trace

    def project(batches):
        for batch in batches:
            for ids, raw in zip(batch.column(0), batch.column(1).to_pylist()):
                x = block_of(raw, d)
                n, at = len(x), np.repeat(np.arange(len(x)), k)
                deviation = pa.array(known.deviations(x), pa.int64()).take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [ids.values.take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1), n), pa.int32()), pa.array(np.full(n * k, known.n), pa.int64()), deviation,
                     pa.array((known.centred(x) @ turn.value).reshape(-1)), pa.array(np.tile(explained, n)), pa.array(np.full(n * k, error))],
                    names=["i", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    made = blocks.select("ids", "x").mapInArrow(project, f"i {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return made.withColumnRenamed("i", id_col)
