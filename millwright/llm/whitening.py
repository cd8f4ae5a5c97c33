"""Whitening of embeddings with weighted multiplicities.

Vectors become whole numbers; equal ones are grouped and carry their count as weight. Sums, covariance and the
whitening itself then run over the different vectors only, once each, and the results are joined back to every row.
A covariance is a matrix product of centred vectors, weighted, one per task and length; only these products are added up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from millwright.session import scratch_table


@dataclass(frozen=True)
class WhitenParams:
    components: int = 8
    scale: int = 1024  # an entry c becomes floor(scale * c) + shift
    shift: int = 100_000
    hot: int = 1000  # vectors that hold more than one in so many rows (fewer than so many vectors) are sent to every task of the join


DEFAULTS = WhitenParams()


@dataclass(frozen=True)
class Fit:
    """What is known of the vectors of one length."""

    n: int
    sums: list[int]
    axes: np.ndarray  # components in columns, each over the root of its eigenvalue; a component without variance is NaN
    explained: list[float | None]

    def centred(self, x: np.ndarray) -> np.ndarray:
        return _centred(x, self.n, self.sums)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n: whole numbers are taken off exactly, the fraction last."""
    whole = np.array([s // n for s in sums], np.int64)
    return (x - whole).astype(np.float64) - np.array([s % n / n for s in sums])


def _deviation(x: np.ndarray, fit: Fit) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, exact; None where a long cannot hold it."""
    whole = np.array([s // fit.n for s in fit.sums], np.int64)
    rest = np.array([s % fit.n for s in fit.sums], np.int64)
    off = x - whole
    if float(fit.n) * (float(np.abs(off).max(initial=0)) + 1) < (2.0 ** 62 / x.shape[1]) ** 0.5:
        step = fit.n * off - rest
        return (step * step).sum(axis=1).tolist()
    exact = [sum((fit.n * a - b) ** 2 for a, b in zip(row, rest.tolist())) for row in off.tolist()]
    return [v if v < 1 << 63 else None for v in exact]


def _binary(matrix: np.ndarray) -> pa.Array:
    """Each row's bytes."""
    matrix = np.ascontiguousarray(matrix)
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * np.int32(matrix.shape[1] * matrix.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(offsets), pa.py_buffer(matrix)])


def _whole_numbers(vectors: DataFrame, vec_col: str, carried: list[str], p: WhitenParams) -> DataFrame:
    """Rows (row, dim, xs): the carried columns, the vector's length, its whole numbers as 32-bit or, if one needs it, 64-bit."""
    narrow = vectors.select(F.struct(*(F.col(f"`{c}`") for c in carried)).alias("row"), F.col(vec_col).cast("array<double>").alias("vec"))

    def convert(batches):
        for batch in batches:
            row, vec = batch.column("row"), batch.column("vec")
            lengths = pc.fill_null(pc.list_value_length(vec), 0).to_numpy(zero_copy_only=False)
            for dim in np.unique(lengths[lengths > 0]).tolist():
                at = np.flatnonzero(lengths == dim)
                c = vec.take(pa.array(at)).flatten().fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(len(at), dim)
                with np.errstate(over="ignore", invalid="ignore"):
                    x = np.floor(p.scale * c)
                    good = (np.abs(x) < 2.0 ** 62).all(axis=1)  # NaN compares false
                at, x = at[good], x[good].astype(np.int64) + p.shift
                small = (np.abs(x) < 2 ** 31).all(axis=1)
                for some, kind in ((small, "<i4"), (~small, "<i8")):
                    if some.any():
                        yield pa.RecordBatch.from_arrays([row.take(pa.array(at[some])), pa.array(np.full(some.sum(), dim, np.int32)), _binary(x[some].astype(kind))], ["row", "dim", "xs"])

    return narrow.mapInArrow(convert, StructType([narrow.schema["row"], StructField("dim", IntegerType()), StructField("xs", BinaryType())]))


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places in the batch, vectors) of different vectors (dim, xs)."""
    dims, sizes = batch.column("dim").to_numpy(), pc.binary_length(batch.column("xs")).to_numpy()
    for dim in np.unique(dims).tolist():
        for width in (4, 8):
            at = np.flatnonzero((dims == dim) & (sizes == width * dim))
            if len(at):
                body = b"".join(batch.column("xs").take(pa.array(at)).to_pylist())
                yield dim, at, np.frombuffer(body, f"<i{width}").reshape(len(at), dim).astype(np.int64)


def _sums(distinct: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """By length: how many vectors, and the exact sum of every dimension."""
    def add(batches):
        held = {}
        for batch in batches:
            weight = batch.column("weight").to_numpy()
            for dim, at, x in _by_length(batch):
                w, own = weight[at], held.setdefault(dim, [0, [0] * dim])
                wide = float(np.abs(x).max()) * float(w.sum()) >= 2.0 ** 62
                part = (x.astype(object) * w.astype(object)[:, None]).sum(axis=0) if wide else w @ x
                own[0] += int(w.sum())
                own[1] = [a + int(b) for a, b in zip(own[1], part)]
        for dim, (n, sums) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([dim] * (dim + 1), pa.int32()), pa.array(range(-1, dim), pa.int32()),
                                              pa.array([Decimal(v) for v in (n, *sums)], pa.decimal128(38, 0))], ["dim", "j", "s"])

    rows = distinct.select("dim", "xs", "weight").mapInArrow(add, "dim int, j int, s decimal(38,0)").groupBy("dim", "j").agg(F.sum("s").alias("s")).collect()
    out = {r.dim: [0] * (r.dim + 1) for r in rows}
    for r in rows:
        out[r.dim][r.j + 1] = int(r.s)
    return {dim: (v[0], v[1:]) for dim, v in out.items()}


def _covariances(rows: DataFrame, blocks: Callable[[pa.RecordBatch], Iterator[tuple[int, np.ndarray, np.ndarray]]]) -> dict[int, np.ndarray]:
    """By length, the weighted sum of products of centred vectors; ``blocks`` gives (length, weights, centred vectors).

    Each task adds up its own product and tells it row by row; the rows of the tasks are added in the order of the
    tasks, so that runs agree. The driver gets one matrix of a length.
    """
    def multiply(batches):
        held = {}
        for batch in batches:
            for dim, w, c in blocks(batch):
                product = (c * w[:, None]).T @ c
                held[dim] = held[dim] + product if dim in held else product
        part = TaskContext.get().partitionId()
        for dim, m in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([dim] * len(m), pa.int32()), pa.array([part] * len(m), pa.int32()), pa.array(range(len(m)), pa.int32()), _binary(m)],
                                             ["dim", "part", "i", "line"])

    def total(table: pa.Table) -> pa.Table:
        lines = table.sort_by("part").column("line").to_pylist()
        added = np.sum([np.frombuffer(line, np.float64) for line in lines], axis=0)
        return pa.table({"dim": table.column("dim")[:1], "i": table.column("i")[:1], "line": pa.array([added.tobytes()], pa.binary())})

    lines = rows.mapInArrow(multiply, "dim int, part int, i int, line binary").groupBy("dim", "i").applyInArrow(total, "dim int, i int, line binary").collect()
    out = {}
    for r in sorted(lines, key=lambda r: r.i):
        out.setdefault(r.dim, []).append(np.frombuffer(r.line, np.float64))
    return {dim: np.array(m) for dim, m in out.items()}


def fit_whitening(distinct: DataFrame, p: WhitenParams = DEFAULTS) -> dict[int, Fit]:
    """By length, the components of the vectors (dim, xs, weight). The driver holds a matrix of length by length numbers."""
    sums = _sums(distinct)

    def blocks(batch):
        weight = batch.column("weight").to_numpy().astype(np.float64)
        for dim, at, x in _by_length(batch):
            yield dim, weight[at], _centred(x, *sums[dim])

    out = {}
    for dim, products in _covariances(distinct.select("dim", "xs", "weight"), blocks).items():
        n, own = sums[dim]
        cov = products / n
        values, vectors = np.linalg.eigh((cov + cov.T) / 2)
        values, vectors = values[::-1][:p.components], vectors[:, ::-1][:, :p.components]
        spread = float(np.trace(cov))
        real = values > dim * np.finfo(float).eps * max(spread, 0.0)
        axes = vectors / np.sqrt(np.where(real, values, np.nan))
        out[dim] = Fit(n, own, axes, [max(float(v), 0.0) / spread if spread > 0 else None for v in values])
    return out


def _whitened(distinct: DataFrame, fits: dict[int, Fit]) -> DataFrame:
    """Rows (dim, xs, weight, deviation, z): every different vector once."""
    def project(batches):
        for batch in batches:
            for dim, at, x in _by_length(batch):
                fit = fits[dim]
                z = fit.centred(x) @ fit.axes
                flat = pa.array(z.ravel(), from_pandas=True)  # NaN: no variance, null
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * z.shape[1], pa.int32()), flat)
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([batch.column("dim").take(take), batch.column("xs").take(take), batch.column("weight").take(take),
                                                  pa.array(_deviation(x, fit), pa.int64()), lists], ["dim", "xs", "weight", "deviation", "z"])

    return distinct.select("dim", "xs", "weight").mapInArrow(project, "dim int, xs binary, weight long, deviation long, z array<double>")


def _identity_errors(whitened: DataFrame, fits: dict[int, Fit], p: WhitenParams) -> dict[int, float | None]:
    """By length, the largest absolute entry of the whitened vectors' covariance minus the identity."""
    means = {r.dim: r for r in whitened.groupBy("dim").agg(*[
        F.sum(F.col("weight") * F.coalesce(F.get("z", F.lit(k)), F.lit(0.0))).alias(f"m{k}") for k in range(p.components)]).collect()}

    def blocks(batch):
        dims, weight = batch.column("dim").to_numpy(), batch.column("weight").to_numpy().astype(np.float64)
        for dim in np.unique(dims).tolist():
            at = np.flatnonzero(dims == dim)
            z = batch.column("z").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1)
            yield dim, weight[at], np.nan_to_num(z) - centre[dim]

    centre = {dim: np.array([r[f"m{k}"] for k in range(fits[dim].axes.shape[1])]) / fits[dim].n for dim, r in means.items()}
    out = {}
    for dim, products in _covariances(whitened.select("dim", "weight", "z"), blocks).items():
        real = np.isfinite(fits[dim].axes[0])
        left = products[np.ix_(real, real)] / fits[dim].n - np.eye(real.sum())
        out[dim] = float(np.abs(left).max()) if real.any() else None
    return out


def whiten(vectors: DataFrame, p: WhitenParams = DEFAULTS, vec_col: str = "embedding", carry: list[str] | None = None) -> DataFrame:
    """Rows of ``carry`` (all columns if not given), a component each, with n, deviation, whitened, explained, identity_error.

    Rows whose vector is null or empty, holds a null or a non-finite entry, or one beyond 2^62 when scaled, take no
    part. All others are the fit list; repeated rows and rows with a null identifier count and come back as often as they
    stand there. Vectors of another length are fitted by themselves. A component without variance (all vectors equal,
    more components than directions) has ``whitened`` null and plays no part in ``identity_error``, which is null where
    no component has any; ``explained`` is null where nothing varies. ``deviation`` is null if a long cannot hold it.
    An empty table gives an empty result. Carried columns of these five names or ``component`` are left out.
    """
    own = ("component", "n", "deviation", "whitened", "explained", "identity_error")
    carried = [c for c in carry or vectors.columns if c.lower() not in own]
    rows = scratch_table(_whole_numbers(vectors, vec_col, carried, p), "whiten-rows")
    distinct = scratch_table(rows.groupBy("dim", "xs").agg(F.count("*").alias("weight")), "whiten-vectors")
    fits = fit_whitening(distinct, p)
    whitened = scratch_table(_whitened(distinct, fits), "whiten-results")
    errors = _identity_errors(whitened, fits, p)
    told = [(dim, k, fit.n, fit.explained[k], errors[dim]) for dim, fit in fits.items() for k in range(fit.axes.shape[1])]
    model = rows.sparkSession.createDataFrame(told, "d int, k int, n long, explained double, identity_error double")
    placed = _joined(rows, whitened, sum(fit.n for fit in fits.values()), p)
    each = placed.select("row", "dim", "deviation", F.posexplode("z").alias("pos", "whitened"))
    return each.join(F.broadcast(model), (F.col("dim") == F.col("d")) & (F.col("pos") == F.col("k"))).select(
        "row.*", (F.col("pos") + 1).alias("component"), "n", "deviation", "whitened", "explained", "identity_error")


def _joined(rows: DataFrame, whitened: DataFrame, n: int, p: WhitenParams) -> DataFrame:
    """Every row with what was worked out for its vector; a vector that many rows hold is sent to them, not they to it."""
    often = F.col("weight") > n / p.hot
    results = whitened.select("dim", "xs", "deviation", "z")
    if whitened.where(often).limit(1).count() == 0:
        return rows.join(results, ["dim", "xs"])
    hot = scratch_table(whitened.where(often).select("dim", "xs", "deviation", "z"), "whiten-hot")  # fewer than ``hot`` rows
    rest = whitened.where(~often).select("dim", "xs", "deviation", "z")
    cold = rows.join(F.broadcast(hot.select("dim", "xs")), ["dim", "xs"], "left_anti")
    return rows.join(F.broadcast(hot), ["dim", "xs"]).unionByName(cold.join(rest, ["dim", "xs"]))
