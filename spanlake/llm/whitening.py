"""Embedding whitening by a bidiagonal qd solver.

Vectors are integers.  Centred rows are reduced by blockwise QR factorisations to one triangle R; Householder reflections
bring R to an upper bidiagonal B; dqds (differential quotient-difference with shifts) finds the squares of its singular values
to high relative accuracy; twisted factorisations of B'B minus each square give the right singular vectors, which the reflections
carry back to whitening directions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.llm.common import python_ready, stored

#: An entry c becomes floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: Directions of largest variance that are returned at most; rows of a block; triangles merged in one task.
COMPONENTS, BLOCK, FAN = 16, 4096, 16
#: Scaled entries are held to this size, so that integers fit.
_LARGEST = float(1 << 62)
#: Share of the largest eigenvalue up to which a direction counts as one without variance: rounding alone may bring it about.
_NO_VARIANCE = 1e-20
#: Relative distance below which eigenvalues are a cluster, whose vectors are made orthogonal one after the other.
_CLUSTER = 1e-6


def integer_vectors(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """(id_col, x): the vectors as arrays of long; rows whose vector is NULL, empty, or holds NULL, NaN or infinity are left out.

    Vectors have the most frequent length (of equally frequent ones the largest); others are left out as well.
    """
    v = F.col("_v")
    rows = embeddings.select(F.col(id_col), F.col(vector_col).cast("array<double>").alias("_v"))
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    rows = rows.filter(v.isNotNull() & (F.size(v) > 0) & F.coalesce(F.forall(v, finite), F.lit(False)))
    lengths = rows.groupBy(F.size(v).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    held = lambda c: F.floor(F.greatest(F.least(c * float(scale), F.lit(_LARGEST)), F.lit(-_LARGEST))) + F.lit(offset).cast("long")
    return rows.filter(F.size(v) == (lengths[0]["d"] if lengths else 0)).select(id_col, F.transform(v, held).alias("x"))


def _matrix(column):
    """An Arrow list column without NULLs as a matrix."""
    import numpy as np
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _deviations(x, n: int, sums: list[int]):
    """n * x - sums, exact: int64 where everything fits, else Python integers."""
    import numpy as np
    largest = max(int(x.max()), -int(x.min()), 1)
    if largest * n + max(map(abs, sums)) < 1 << 63:
        return x * np.int64(n) - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _centred(x, n: int, sums: list[int]):
    """x minus the mean, as doubles, rounded once or twice."""
    return _deviations(x, n, sums).astype(float) / n


def _squared(deviations) -> list[int | None]:
    """Exact sums of squares; None where a long can't hold them."""
    import numpy as np
    largest = max(int(deviations.max()), -int(deviations.min()), 1)
    if deviations.dtype != object and largest * largest * deviations.shape[1] < 1 << 63:
        return (deviations * deviations).sum(axis=1).tolist()
    total = (deviations.astype(object) ** 2).sum(axis=1)
    return [int(t) if t < 1 << 63 else None for t in total]


def column_sums(fit: DataFrame) -> tuple[int, list[int]]:
    """Number of rows of ``fit`` (x) and exact sums by dimension; one number a dimension comes back to the driver."""
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        n, high, low = 0, 0, 0
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("x"))
                # Halves of 32 bits: no sum of up to 2^31 rows overflows.
                n, high, low = n + len(x), high + (x >> np.int64(32)).sum(axis=0), low + (x & np.int64(0xFFFFFFFF)).sum(axis=0)
        if n:
            d, longs = len(high), pa.int64()
            yield pa.RecordBatch.from_arrays([pa.array(range(d), longs), pa.array([n] * d, longs), pa.array(high, longs), pa.array(low, longs)], names=["at", "n", "high", "low"])

    whole = lambda c: F.sum(F.col(c).cast("decimal(28,0)")).alias(c)
    rows = fit.select("x").mapInArrow(run, "at long, n long, high long, low long").groupBy("at").agg(whole("n"), whole("high"), whole("low")).collect()
    if not rows:
        return 0, []
    return int(rows[0]["n"]), [(int(r["high"]) << 32) + int(r["low"]) for r in sorted(rows, key=lambda r: r["at"])]


def triangle(fit: DataFrame, n: int, sums: list[int], block: int = BLOCK, fan: int = FAN):
    """The R of a QR factorisation of all centred rows: one triangle a task, merged ``fan`` by ``fan``; one comes back to the driver."""
    import numpy as np
    d = len(sums)

    def reduce(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext
        r = np.zeros((0, d))
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                r = np.linalg.qr(np.vstack((r, _centred(_matrix(batch.column("x").slice(at, block)), n, sums))), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()], pa.binary())], names=["part", "r"])

    def merge(group):
        import numpy as np
        rows = np.vstack([np.frombuffer(x).reshape(-1, d) for x in group.sort_values("part")["r"]])
        return group.assign(part=group["part"] // fan, r=np.linalg.qr(rows, mode="r").tobytes()).head(1)

    parts = stored(fit.select("x").mapInArrow(reduce, "part long, r binary"), "triangles")
    while parts.count() > 1:
        # Part numbers start below the number of tasks and shrink by ``fan`` a round.
        parts = stored(parts.groupBy(F.floor(F.col("part") / fan)).applyInPandas(merge, "part long, r binary"), "triangles")
    found = parts.collect()
    r = np.frombuffer(found[0]["r"]).reshape(-1, d)
    return np.vstack((r, np.zeros((d - len(r), d))))


def bidiagonal(r):
    """(a, b, v): diagonal and superdiagonal of B and the orthogonal v with R = U B v'; Householder reflections from both sides."""
    import numpy as np
    a, d = np.array(r, float), r.shape[1]
    v = np.eye(d)

    def reflector(x):
        w = x.copy()
        size = np.linalg.norm(x)
        if size == 0 or not np.any(x[1:]):
            return None
        w[0] += size if x[0] >= 0 else -size
        return w / np.linalg.norm(w)

    for k in range(d):
        w = reflector(a[k:, k])
        if w is not None:
            a[k:, k:] -= 2 * np.outer(w, w @ a[k:, k:])
        if k + 2 < d:
            w = reflector(a[k, k + 1:])
            if w is not None:
                a[k:, k + 1:] -= 2 * np.outer(a[k:, k + 1:] @ w, w)
                v[:, k + 1:] -= 2 * np.outer(v[:, k + 1:] @ w, w)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def _sweep(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float, bool]:
    """One dqds transform: new q, e, the least pivot before the last, and whether all pivots stayed non-negative."""
    n, d, least = len(q), q[0] - shift, float("inf")
    new_q, new_e = [0.0] * n, [0.0] * (n - 1)
    for i in range(n - 1):
        if d < 0:
            return q, e, d, False
        least = min(least, d)
        new_q[i] = top = d + e[i]
        if top == 0:
            d = q[i + 1] - shift
        else:
            ratio = q[i + 1] / top
            new_e[i] = e[i] * ratio
            d = d * ratio - shift
    new_q[n - 1] = d
    return new_q, new_e, min(least, d), d >= 0


def dqds(a, b) -> list[float]:
    """Squares of the singular values of the bidiagonal (a, b), largest first."""
    from math import sqrt
    tiny = 16 * 2.0 ** -104
    found: list[float] = []
    blocks = [([float(x) ** 2 for x in a], [float(x) ** 2 for x in b], 0.0)]
    while blocks:
        q, e, moved = blocks.pop()
        caution = 0.75
        while q:
            n = len(q)
            if n == 1:
                found.append(max(0.0, q[0] + moved))
                break
            cut = next((i for i in range(n - 2, -1, -1) if e[i] <= tiny * (moved + min(q[i], q[i + 1]))), None)
            if cut is not None:  # a coupling that no longer counts
                blocks.append((q[:cut + 1], e[:cut], moved))
                q, e = q[cut + 1:], e[cut + 1:]
                continue
            if 1.5 * q[0] < q[-1]:
                q, e = q[::-1], e[::-1]
            side = [sqrt(x * y) for x, y in zip(q, e)]
            sure = min(q[i] + (e[i - 1] if i else 0.0) - (side[i] if i < n - 1 else 0.0) - (side[i - 1] if i else 0.0) for i in range(n))
            bold = caution * min(q)
            for shift in sorted({max(0.0, sure), max(0.0, sure, bold), 0.0}, reverse=True):
                new_q, new_e, _, good = _sweep(q, e, shift)
                if good:
                    break
                caution /= 4
            else:  # only rounding makes a sweep without a shift fail
                new_q = [max(0.0, x) for x in new_q]
                shift = 0.0
            q, e, moved = new_q, new_e, moved + shift
    return sorted(found, reverse=True)


def twisted(a, b, value: float):
    """The unit vector z with B'B z = value z, from the twisted factorisation whose twist has the least pivot."""
    import numpy as np
    n = len(a)
    small = np.finfo(float).tiny * 2.0 ** 60 + np.finfo(float).eps ** 2 * value
    whole = lambda x: x if abs(x) > small else small
    down, up, s, p = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    s[0] = -value
    for i in range(n - 1):  # from the top: L+ D+ L+'
        pivot = whole(s[i] + a[i] ** 2)
        down[i] = a[i] * b[i] / pivot
        s[i + 1] = b[i] ** 2 * s[i] / pivot - value
    p[n - 1] = a[n - 1] ** 2 - value
    for i in range(n - 2, -1, -1):  # from the bottom: U- D- U-'
        pivot = whole(b[i] ** 2 + p[i + 1])
        up[i] = a[i] * b[i] / pivot
        p[i] = a[i] ** 2 * p[i + 1] / pivot - value
    r = int(np.argmin(np.abs(s + p + value)))
    z = np.zeros(n)
    z[r] = 1.0
    for i in range(r - 1, -1, -1):
        z[i] = -down[i] * z[i + 1]
    for i in range(r, n - 1):
        z[i + 1] = -up[i] * z[i]
    return z / np.linalg.norm(z)


def right_vectors(a, b, values: list[float], k: int):
    """Orthonormal right singular vectors of the bidiagonal for the first ``k`` of the descending ``values``, as columns.

    Inside a cluster of nearly equal values each vector is made orthogonal to the ones before and corrected by inverse iteration.
    """
    import numpy as np
    n, out = len(a), []
    first = 0
    dense = None
    for i in range(k):
        if i and values[i - 1] - values[i] > _CLUSTER * values[i - 1]:
            first = i
        z = twisted(a, b, values[i])
        before = np.array(out[first:]).reshape(-1, n)
        if len(before):
            if dense is None:
                full = np.diag(a) + np.diag(b, 1)
                dense = full.T @ full
            draw = np.random.default_rng(i)
            z = z - before.T @ (before @ z)
            if np.linalg.norm(z) < 0.5:
                z = draw.standard_normal(n)
            system = dense - np.eye(n) * (values[i] * (1 + 4 * np.finfo(float).eps) + np.finfo(float).tiny)
            for _ in range(3):
                z -= before.T @ (before @ z)
                try:
                    z = np.linalg.solve(system, z / np.linalg.norm(z))
                except np.linalg.LinAlgError:  # exactly singular: the shift is an eigenvalue to the last bit
                    z = np.linalg.lstsq(system + np.eye(n) * values[0] * np.finfo(float).eps, z, rcond=None)[0]
                z /= np.linalg.norm(z)
            for _ in range(2):
                z -= before.T @ (before @ z)
                z /= np.linalg.norm(z)
        out.append(z)
    return np.array(out).reshape(-1, n).T


def directions(r, n: int, components: int = COMPONENTS):
    """(eigenvalues, vectors as columns, trace) of R'R / n; directions without variance are left out."""
    import numpy as np
    size = np.abs(r).max() if r.size else 0.0
    if not size:
        return [], np.zeros((r.shape[1], 0)), 0.0
    a, b, v = bidiagonal(r / size)
    values = dqds(a, b)
    k = min(components, sum(x > _NO_VARIANCE * values[0] for x in values))
    return [x * size * size / n for x in values[:k]], v @ right_vectors(a, b, values, k), sum(values) * size * size / n


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening: rows and exact sums of the fit list, eigenvalues (falling) with unit vectors as columns, trace, and
    the largest absolute entry of the whitened fit list's covariance minus the identity."""

    n: int
    sums: list[int]
    eigenvalues: list[float]
    vectors: object
    trace: float
    identity_error: float

    def project(self, x):
        """Whitened rows of an integer matrix."""
        import numpy as np
        return _centred(x, self.n, self.sums) @ self.vectors / np.sqrt(self.eigenvalues)


def _identity_error(fit: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened ``fit`` minus the identity; products are added up in the tasks."""
    import numpy as np
    k = len(model.eigenvalues)
    shared = fit.sparkSession.sparkContext.broadcast(model)  # dimensions times components

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        products, sums = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            if batch.num_rows:
                w = shared.value.project(_matrix(batch.column("x")))
                products += w.T @ w
                sums += w.sum(axis=0)
        flat = np.concatenate((products.ravel(), sums))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int64()), pa.array(flat, pa.float64())], names=["at", "v"])

    got = fit.select("x").mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    flat = np.array([r["v"] for r in sorted(got, key=lambda r: r["at"])])
    mean = flat[k * k:] / model.n
    return float(np.abs(flat[:k * k].reshape(k, k) / model.n - np.outer(mean, mean) - np.eye(k)).max())


def fit_whitening(rows: DataFrame, components: int = COMPONENTS) -> Whitening:
    """Whitening of integer vectors (x), fitted on every distinct vector once.

    Nothing but matrices of dimensions by dimensions comes back to the driver.  Equal rows meet in the tasks before they are shuffled.
    Without rows, or if all vectors are equal, there is no direction.
    """
    from dataclasses import replace
    python_ready(rows.sparkSession)
    fit = stored(rows.select("x").distinct(), "distinct-vectors")
    n, sums = column_sums(fit)
    if not n:
        return Whitening(0, [], [], None, 0.0, 0.0)
    values, vectors, trace = directions(triangle(fit, n, sums), n, components)
    model = Whitening(n, sums, values, vectors, trace, 0.0)
    return replace(model, identity_error=_identity_error(fit, model)) if values else model


def whitened(rows: DataFrame, model: Whitening, id_col: str = "vec_id") -> DataFrame:
    """(id_col, deviation, whitened) of integer vectors (id_col, x): n^2 times the squared distance from the mean, and the whitened vector.

    ``deviation`` is exact, NULL where a long can't hold it.  Without directions no row is returned.
    """
    kind = f"`{id_col}` {dict(rows.dtypes)[id_col]}, deviation long, whitened array<double>"
    spark = rows.sparkSession
    if not model.eigenvalues:
        return spark.createDataFrame([], kind)
    shared = spark.sparkContext.broadcast(model)  # dimensions times components

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        for batch in batches:
            if batch.num_rows:
                x, m = _matrix(batch.column("x")), shared.value
                w = m.project(x)
                offsets = pa.array(range(0, w.size + 1, w.shape[1]), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(_squared(_deviations(x, m.n, m.sums)), pa.int64()),
                                                  pa.ListArray.from_arrays(offsets, pa.array(w.ravel(), pa.float64()))], names=[id_col, "deviation", "whitened"])

    return rows.select(id_col, "x").mapInArrow(run, kind)


def whiten_embeddings(embeddings: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Whitened components of every usable vector: id, ``component`` (from 1), ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    Vectors that are NULL, empty or hold NULL or non-finite entries are left out (``integer_vectors``); repeated rows come back as often as they
    are there but count once in the fit; a NULL id stays NULL; other columns play no part.  Entries beyond 2^62 / 64 in size are held there; a
    deviation beyond a long is NULL.  There are as many components as directions with variance, ``components`` at most: none for an empty
    table or for equal vectors only.  Of equal eigenvalues any orthonormal vectors are components, the same for all rows.
    """
    rows = integer_vectors(embeddings, id_col, vector_col)
    model = fit_whitening(rows, components)
    explained = F.get(F.array(*[F.lit(e / model.trace) for e in model.eigenvalues]), F.col("component") - 1) if model.eigenvalues else F.lit(0.0)
    parts = whitened(rows, model, id_col).select(id_col, "deviation", F.posexplode("whitened").alias("_at", "whitened"))
    return parts.select(id_col, (F.col("_at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened").withColumn(
        "explained", explained).withColumn("identity_error", F.lit(model.identity_error))
