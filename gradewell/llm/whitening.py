"""Whitening of vectors by an eigendecomposition that grows row by row.

Each partition takes its rows up by centred rank-one updates (secular equation, deflation, see _spectrum), the spectra of partitions
are combined by successive rank-one updates in a tree, and Rayleigh-Ritz passes over all rows refine the result to double precision.
Copies of a vector are one update of their number, so a hot vector is one row. What reaches the driver is the mean, one spectrum and
sums of its size: dimensions times rank, whatever the number of rows.

Edge cases: a vector that is null, holds a null or a non-finite entry, or an entry of 2^46 or more in size (it has no exact whole
number in a double) is dropped; of vectors of several lengths those of the most frequent length count (of equally frequent ones the longest),
others and empty vectors are dropped. Components without variance are left out, so one vector, equal vectors and an empty table give no
rows. Null and repeated ids are kept row by row; columns other than the two named are not read. A deviation that is no long is null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewell.llm._spectrum import Spectrum
from gradewell.llm._store import store, table

COMPONENTS = 32
RANK = 512  # eigenpairs that a spectrum keeps; vectors of more dimensions take several refining passes
ROWS = 2048  # different vectors of one spectrum
PASSES = 30  # refining passes at most, where the rank is below the dimensions
LARGEST = 2.0**46
SPECTRUM = "weight long, mean array<double>, vals array<double>, vecs array<double>"


def whole_numbers(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id and x, the vector's whole numbers, of the rows that remain."""
    sound = F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST))
    rows = df.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{embedding}`").cast("array<double>").alias("e"))
    # the filter stands before the numbers: a sum of entries that are not finite has no whole number
    x = F.when(sound, F.transform("e", lambda c: F.floor(64 * c) + 1000000))
    return rows.where(F.col("e").isNotNull() & (F.size("e") > 0)).select("vec_id", x.alias("x")).where(F.col("x").isNotNull())


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _spectra(dim: int, rank: int, first: list[float]):
    shift = np.array(first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Spectrum(dim, rank)
        for b in batches:
            if b.num_rows:
                for x, w in zip(_matrix(b.column("x")) - shift, b.column("w").to_pylist(), strict=True):
                    s.add(x, w)
        if s.weight:
            yield _row(s)

    return run


def _row(s: Spectrum) -> pa.RecordBatch:
    columns = [pa.array([s.weight], pa.int64()), *(pa.array([list(map(float, v.ravel()))], pa.list_(pa.float64())) for v in (s.mean, s.values, s.vectors))]
    return pa.RecordBatch.from_arrays(columns, names=["weight", "mean", "vals", "vecs"])


def _spectrum(row: dict, dim: int, rank: int) -> Spectrum:
    s = Spectrum(dim, rank, row["weight"])
    s.mean, s.values = np.array(row["mean"], float), np.array(row["vals"], float)
    s.vectors = np.array(row["vecs"], float).reshape(dim, -1)
    return s


def _merged(dim: int, rank: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = None
        for b in batches:
            for row in b.to_pylist():
                other = _spectrum(row, dim, rank)
                if s is None:
                    s = other
                else:
                    s.merge(other)
        if s is not None:
            yield _row(s)

    return run


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S/n, the difference taken in whole numbers."""
    return (n * x - sums) / n


def _products(n: int, sums: list[int], basis: np.ndarray):
    """For a partition, the sum of c (c'Q) over its centred rows c, flat, divided by n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(basis.shape)
        for b in batches:
            if b.num_rows:
                c = _centred(_matrix(b.column("x")), n, np.array(sums))
                total += c.T @ ((c @ basis) * (b.column("w").to_numpy()[:, None] / n))
        yield pa.RecordBatch.from_arrays([pa.array([list(map(float, total.ravel()))], pa.list_(pa.float64()))], names=["part"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for b in batches:
        if b.num_rows:
            part = _matrix(b.column("part")).sum(0)
            total = part if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["part"])


def _in_tree(parts: DataFrame, join, schema: str, count: int) -> list:
    """The partial results joined in two rounds, so that no task reads more than the root of their number."""
    for tasks in (max(1, int(count**0.5)), 1):
        if tasks < count:
            parts = parts.repartition(tasks).mapInArrow(join, schema)
            count = tasks
    return parts.collect()


class Whitener:
    """Means and components fitted on whole-number vectors: distinct vectors x with their number w, in a stored table."""

    def __init__(self, weighted: DataFrame, components: int = COMPONENTS, rank: int = RANK):
        self.rows = weighted
        self.values, self.vectors, self.trace, self.identity_error = np.zeros(0), np.zeros((0, 0)), 0.0, 0.0
        self.n, self.sums = 0, []
        dim = weighted.select(F.size("x").alias("d")).first()
        if dim is None:
            return
        self.dim = dim.d
        one = weighted.agg(F.sum("w"), F.count(F.lit(1)), *[F.sum(F.col("w") * F.get("x", F.lit(i))) for i in range(self.dim)]).first()
        self.n, distinct, self.sums = one[0], one[1], list(one[2:])
        self.rank = min(rank, self.dim)
        self.tasks = max(1, -(-distinct // ROWS))
        values, basis = self._grown()
        self._refine(basis, components)

    def _grown(self) -> tuple[np.ndarray, np.ndarray]:
        """Spectra of partitions by rank-one updates, combined by rank-one updates."""
        shift = [s / self.n for s in self.sums]  # a spectrum's own mean starts near nought, so updates keep their digits
        parts = self.rows.repartition(self.tasks).mapInArrow(_spectra(self.dim, self.rank, shift), SPECTRUM)
        found = _in_tree(parts, _merged(self.dim, self.rank), SPECTRUM, self.tasks)
        s = _spectrum(found[0].asDict(), self.dim, self.rank)
        return s.values[::-1] / self.n, s.vectors[:, ::-1]

    def _times(self, basis: np.ndarray) -> np.ndarray:
        """V Q by one pass over all rows."""
        parts = self.rows.mapInArrow(_products(self.n, self.sums, basis), "part array<double>")
        count = max(2, parts.rdd.getNumPartitions())
        return np.array(_in_tree(parts, _added, "part array<double>", count)[0].part).reshape(basis.shape)

    def _refine(self, basis: np.ndarray, components: int) -> None:
        """Rayleigh-Ritz: the covariance seen in the spectrum's own directions; with fewer directions than dimensions, block power steps between."""
        if not basis.shape[1]:
            return
        for _ in range(PASSES):
            q = np.linalg.qr(basis)[0]
            image = self._times(q)
            small = q.T @ image
            theta, w = np.linalg.eigh((small + small.T) / 2)
            theta, w = theta[::-1], w[:, ::-1]
            vectors, k = q @ w, min(components, len(theta))
            left = np.linalg.norm(image @ w[:, :k] - vectors[:, :k] * theta[:k], axis=0)
            if (left <= 1e-13 * self.dim * max(theta[0], 0.0)).all():
                break
            basis = image if q.shape[1] < self.dim else vectors
        kept = [i for i in range(k) if theta[i] > 1e-12 * self.dim * theta[0] and theta[i] > 0]
        self.values, self.vectors = theta[kept], vectors[:, kept]
        if not kept:
            return
        diag = self.rows.select(F.aggregate(F.transform(F.arrays_zip("x", F.lit(self.sums).alias("s")), lambda p: F.pow((self.n * p["x"] - p["s"]) / self.n, 2)), F.lit(0.0), lambda a, x: a + x).alias("q"), "w")
        self.trace = diag.agg(F.sum(F.col("q") * F.col("w")) / self.n).first()[0]
        scaled = self.vectors / np.sqrt(self.values)
        self.identity_error = float(np.abs(scaled.T @ self._times(scaled) - np.eye(len(kept))).max())

    def transform(self, numbers: DataFrame) -> DataFrame:
        """A row for each row and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
        n, sums, scaled = self.n, self.sums, self.vectors / np.sqrt(self.values) if len(self.values) else None
        kind = numbers.schema["vec_id"].dataType.simpleString()
        if scaled is None:
            return numbers.where("false").selectExpr("vec_id", "0 component", "0L n", "0L deviation", "0d whitened", "0d explained", "0d identity_error")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                away = n * _matrix(b.column("x")) - np.array(sums)
                if float((away.astype(float) ** 2).sum(1).max()) < 2.0**62:
                    deviation = (away * away).sum(1).tolist()
                else:
                    deviation = [s if s < 2**63 else None for s in (away.astype(object) ** 2).sum(1).tolist()]
                white = (away / n) @ scaled
                flat = pa.ListArray.from_arrays(np.arange(len(white) + 1, dtype=np.int32) * white.shape[1], pa.array(white.ravel()))
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(deviation, pa.int64()), flat], names=["vec_id", "deviation", "w"])

        rows = numbers.mapInArrow(run, f"vec_id {kind}, deviation long, w array<double>")
        explained = F.lit([float(v / self.trace) for v in self.values])
        return rows.select("vec_id", "deviation", F.posexplode("w").alias("k", "whitened")).select(
            "vec_id",
            (F.col("k") + 1).cast("int").alias("component"),
            F.lit(n).cast("long").alias("n"),
            "deviation",
            "whitened",
            F.get(explained, F.col("k")).alias("explained"),
            F.lit(self.identity_error).alias("identity_error"),
        )


def whiten(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS, rank: int = RANK) -> DataFrame:
    """Fit on all remaining rows of df and give each its whitened components."""
    numbers = store(whole_numbers(df, vec_id, embedding), "vectors")
    lengths = numbers.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is not None:
        numbers = numbers.where(F.size("x") == lengths.d)
    weighted = store(numbers.groupBy("x").agg(F.count(F.lit(1)).alias("w")), "weighted")
    return Whitener(weighted, components, rank).transform(numbers)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
