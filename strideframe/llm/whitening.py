"""Whitening of embeddings by the covariance of distinct vectors, weighted with their multiplicity.

(1) Vectors become integers and equal ones are grouped, with map-side partial counts. (2) Sums per dimension over the
distinct vectors, times their weights (counts, or one), are exact. (3) The weighted Gram matrix of the centred vectors is
a matrix product per batch; the partial matrices of the tasks are added in a tree, so that the driver gets one matrix of
dimension x dimension. (4) Its eigenvectors, scaled by the root of their eigenvalue, whiten every distinct vector once.
(5) The result is joined back to the rows: vectors with more than a thousandth of all rows (at most a thousand of them)
by broadcast, the others by a shuffled join, in which no key is hot any more.

Vectors are kept as the narrowest signed integers that hold floor(scale * c); the shift moves only the means, so it is
added where a sum or a value leaves this module. Centring subtracts floor(S / n) as an integer and the fraction as a
double, which loses nothing however large the shift is.

Defined cases: rows whose vector is NULL, empty, or holds a NULL or non-finite entry take no part; vectors of different
lengths are whitened apart, each length by its own fit (more than ``LENGTHS`` different lengths raise ValueError);
a direction without variance whitens to 0.0, explains 0.0, and shows as an identity error of 1.0; an entry
beyond 2**62 / scale has no integer form and raises ValueError; NULL ids and repeated rows are rows like any other;
an empty table gives no row; further columns are ignored. ``deviation`` is NULL beyond 38 digits.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.llm.stages import Scratch

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 32
LENGTHS = 64
#: A vector with more than this share of the rows is joined by broadcast.
HOT_SHARE = 0.001
_FAN = 32
_INTS = [np.dtype(t) for t in ("<i1", "<i2", "<i4", "<i8")]
_DECIMAL = pa.decimal128(38, 0)


def _quantised(scale: int):
    """(id, dim, raw): raw holds floor(scale * c) in the narrowest signed integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            sizes = np.diff(column.offsets.to_numpy().astype(np.int64))
            starts = column.offsets.to_numpy().astype(np.int64)[:-1] - column.offsets[0].as_py()
            flat = column.flatten() if not column.null_count else None
            if flat is None:  # rows that are NULL may still span values
                column = column.filter(column.is_valid())
                kept = np.flatnonzero(batch.column(1).is_valid().to_numpy(zero_copy_only=False))
                sizes, flat = sizes[kept], column.flatten()
                starts = np.cumsum(sizes) - sizes
            else:
                kept = np.arange(len(column))
            values = np.floor(scale * flat.to_numpy(zero_copy_only=False).astype(np.float64))  # NULL entries become NaN
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            usable = (sizes > 0) & (bad[starts + sizes] == bad[starts])
            ids, dims, raws = [], [], []
            for dim in np.unique(sizes[usable]).tolist():
                rows = np.flatnonzero(usable & (sizes == dim))
                own = values[starts[rows][:, None] + np.arange(dim)]
                largest = np.abs(own).max(1)
                if largest.max() > 2.0**62:
                    raise ValueError("an entry is too large for a 64-bit integer")
                whole = own.astype(np.int64)
                low, high = whole.min(1), whole.max(1)
                width = np.zeros(len(rows), np.int64)
                for kind in _INTS[:-1]:
                    limits = np.iinfo(kind)
                    width += (low < limits.min) | (high > limits.max)
                for w in np.unique(width).tolist():
                    mine = np.flatnonzero(width == w)
                    data, step = whole[mine].astype(_INTS[w]).tobytes(), dim * _INTS[w].itemsize
                    ids += kept[rows[mine]].tolist()
                    dims += [dim] * len(mine)
                    raws += [data[i * step : (i + 1) * step] for i in range(len(mine))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(ids, pa.int64())), pa.array(dims, pa.int32()), pa.array(raws, pa.binary())],
                names=["id", "dim", "raw"],
            )

    return run


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dim, rows, their integers as a matrix) for the columns ``dim`` and ``raw`` of a batch."""
    dims = batch.column("dim").to_numpy()
    raws = batch.column("raw").to_pylist()
    sizes = np.array([len(r) for r in raws], np.int64)
    for dim, size in sorted(set(zip(dims.tolist(), sizes.tolist()))):
        rows = np.flatnonzero((dims == dim) & (sizes == size))
        kind = next(t for t in _INTS if t.itemsize * dim == size)
        yield dim, rows, np.frombuffer(b"".join(raws[i] for i in rows.tolist()), kind).reshape(-1, dim).astype(np.int64)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(dim, j, n, s): weights and exact weighted sums of one task, one row per dimension."""
    totals: dict[int, tuple[int, np.ndarray]] = {}
    for batch in batches:
        weights = batch.column("w").to_numpy()
        for dim, rows, x in _matrices(batch):
            w = weights[rows]
            if float(w.sum()) * float(max(abs(int(x.min())), abs(int(x.max())), 1)) < 2.0**62:
                s = (w @ x).astype(object)
            else:
                s = w.astype(object) @ x.astype(object)
            n, before = totals.get(dim, (0, 0))
            totals[dim] = (n + int(w.sum()), before + s)
    for dim, (n, s) in totals.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([dim] * dim, pa.int32()), pa.array(range(dim), pa.int32()), pa.array([n] * dim, pa.int64()),
             pa.array([Decimal(int(v)) for v in s], _DECIMAL)], names=["dim", "j", "n", "s"],
        )


@dataclass
class Centre:
    """Mean of the vectors of one length: sums ``s`` over weight ``n``; ``whole`` + ``part`` is s / n."""

    n: int
    s: list[int]

    def __post_init__(self) -> None:
        self.whole = np.array([v // self.n for v in self.s], np.int64)
        self.rest = [v % self.n for v in self.s]
        self.part = np.array([r / self.n for r in self.rest])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.part

    def deviations(self, x: np.ndarray) -> list[Decimal | None]:
        """Sum over dimensions of (n * x - s) ** 2, exact."""
        steps = x - self.whole
        reach = self.n * (float(np.abs(steps).max(initial=0)) + 1)
        if reach * reach * x.shape[1] < 2.0**62:
            found = ((steps * self.n - np.array(self.rest, np.int64)) ** 2).sum(1)
        else:
            found = ((steps.astype(object) * self.n - np.array(self.rest, object)) ** 2).sum(1)
        return [Decimal(int(v)) if v < 10**38 else None for v in found]


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the matrices of rows with the same (dim, number), which arrive together."""
    key, total = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int64()),
             pa.array([total.tobytes()], pa.binary())], names=["dim", "number", "matrix"],
        )

    for batch in batches:
        for dim, number, raw in zip(*(batch.column(i).to_pylist() for i in range(3))):
            own = np.frombuffer(raw)
            if key == (dim, number):
                total = total + own
            else:
                if key is not None:
                    yield row()
                key, total = (dim, number), own
    if key is not None:
        yield row()


def _gram(vectors: DataFrame, made, scratch: Scratch, name: str) -> dict[int, np.ndarray]:
    """Per length the sum over all rows of w * a aT, where ``made(batch)`` gives (dim, rows, a). One matrix per task and
    length, added in a tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            weights = batch.column("w").to_numpy().astype(np.float64)
            for dim, rows, a in made(batch):
                own = (a * weights[rows, None]).T @ a
                totals[dim] = totals[dim] + own if dim in totals else own
        number = TaskContext.get().partitionId()
        for dim, total in totals.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([dim], pa.int32()), pa.array([number], pa.int64()), pa.array([total.tobytes()], pa.binary())],
                names=["dim", "number", "matrix"],
            )

    kind, level = "dim int, number long, matrix binary", 0
    parts = scratch.keep(vectors.mapInArrow(run, kind), f"{name}-0")
    while (parts.agg(F.max("number")).first()[0] or 0) > 0:
        level += 1
        up = parts.withColumn("number", F.floor(F.col("number") / _FAN))
        up = up.repartition("dim", "number").sortWithinPartitions("dim", "number")
        parts = scratch.keep(up.select("dim", "number", "matrix").mapInArrow(_added, kind), f"{name}-{level}")
    out = {}
    for r in parts.collect():  # one row per length
        values = np.frombuffer(r["matrix"])
        side = int(round(len(values) ** 0.5))
        out[r["dim"]] = values.reshape(side, side)
    return out


def _components(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(matrix that whitens centred rows, share of the trace) of the first components."""
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")[:most]
    values, vectors = values[order], vectors[:, order]
    flat = values <= len(covariance) * np.finfo(float).eps * max(values[0], 0.0)
    roots = np.sqrt(np.where(flat, 1.0, values))
    trace = float(np.trace(covariance))
    return np.where(flat, 0.0, vectors / roots), np.where(flat, 0.0, values) / (trace or 1.0)


def whiten(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE,
    components: int = COMPONENTS, weights: str = "counts",
) -> DataFrame:
    """``id, dim, n, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error`` of every
    usable row. ``weights``: ``counts`` fits on all rows, ``one`` on every distinct vector once."""
    if weights not in ("counts", "one"):
        raise ValueError("weights are 'counts' or 'one'")
    spark = vectors.sparkSession
    scratch = Scratch(spark, "whitening")
    plain = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    id_kind = plain.schema["id"].dataType.simpleString()
    points = scratch.keep(plain.mapInArrow(_quantised(scale), f"id {id_kind}, dim int, raw binary"), "points")
    counted = points.groupBy("dim", "raw").agg(F.count(F.lit(1)).alias("copies"))
    weight = F.col("copies") if weights == "counts" else F.lit(1).cast("long")
    distinct = scratch.keep(counted.withColumn("w", weight), "distinct")

    sums = distinct.select("dim", "raw", "w").mapInArrow(_sums, "dim int, j int, n long, s decimal(38,0)")
    sums = sums.groupBy("dim", "j").agg(F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s"))
    if len(distinct.select("dim").distinct().limit(LENGTHS + 1).collect()) > LENGTHS:
        raise ValueError(f"vectors of more than {LENGTHS} different lengths")
    found: dict[int, tuple[int, list[int]]] = {}
    for r in sums.orderBy("dim", "j").collect():  # one row per length and dimension
        found.setdefault(r["dim"], (r["n"], []))[1].append(int(r["s"]))
    centres = {dim: Centre(n, s) for dim, (n, s) in found.items()}
    centre = spark.sparkContext.broadcast(centres)

    def centred(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for dim, rows, x in _matrices(batch):
            yield dim, rows, centre.value[dim].centred(x)

    grams = _gram(distinct.select("dim", "raw", "w"), centred, scratch, "gram")
    fits = {d: _components(g / centres[d].n, components) for d, g in grams.items()}
    turn = spark.sparkContext.broadcast({d: f[0] for d, f in fits.items()})

    def whitened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, rows, x in _matrices(batch):
                own = centre.value[dim]
                z = own.centred(x) @ turn.value[dim]
                ends = np.arange(len(z) + 1, dtype=np.int32) * z.shape[1]
                taken = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [*taken.columns, pa.array(own.deviations(x), _DECIMAL),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(z.reshape(-1)))],
                    names=["dim", "raw", "copies", "w", "deviation", "whitened"],
                )

    kind = "dim int, raw binary, copies long, w long, deviation decimal(38,0), whitened array<double>"
    made = scratch.keep(distinct.select("dim", "raw", "copies", "w").mapInArrow(whitened, kind), "whitened")

    def augmented(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims).tolist():
            rows = np.flatnonzero(dims == dim)
            z = batch.column("whitened").take(pa.array(rows)).flatten().to_numpy().reshape(len(rows), -1)
            yield dim, rows, np.hstack([z, np.ones((len(rows), 1))])

    facts = []
    for dim, g in _gram(made.select("dim", "whitened", "w"), augmented, scratch, "identity").items():
        n, mean = g[-1, -1], g[:-1, -1] / g[-1, -1]
        error = np.abs(g[:-1, :-1] / n - np.outer(mean, mean) - np.eye(len(mean))).max()
        facts.append((dim, centres[dim].n, float(error), fits[dim][1].tolist()))
    for used in (centre, turn):
        used.unpersist()
    known = F.broadcast(spark.createDataFrame(facts, "dim int, n long, identity_error double, explained array<double>"))

    everything = sum(c[1] for c in facts) if weights == "counts" else points.count()
    hot = made.where(F.col("copies") > HOT_SHARE * everything).select("dim", "raw", "deviation", "whitened")
    rest = made.where(F.col("copies") <= HOT_SHARE * everything).select("dim", "raw", "deviation", "whitened")
    common = points.join(F.broadcast(hot), ["dim", "raw"])
    others = points.join(F.broadcast(hot.select("dim", "raw")), ["dim", "raw"], "left_anti").join(rest, ["dim", "raw"])
    return common.unionByName(others).join(known, "dim").select(
        "id", "dim", "n", "deviation", "whitened", "explained", "identity_error"
    )


def digest(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component, numbered from 1. The shift of the integers cancels in every column."""
    made = whiten(vectors, components=components)
    wide = made.select("*", F.posexplode("whitened").alias("at", "value"))
    return wide.select(
        F.col("id").alias("vec_id"), (F.col("at") + 1).alias("component"), "n",
        F.expr("try_cast(deviation AS long)").alias("deviation"), F.col("value").alias("whitened"),
        F.get("explained", F.col("at")).alias("explained"), "identity_error",
    )
