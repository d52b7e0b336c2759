"""Whitening of embedding vectors: exact sums, blockwise QR of the centred rows, and a small singular value problem."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.bidiagonal import decomposed
from quillon.llm.common import ship_package, stored
from quillon.llm.vectors import matrix, usable

#: Fixed values of the integer form: x = floor(SCALE * c) + SHIFT, an x beyond LIMIT counting as LIMIT.
SCALE, SHIFT, LIMIT = 1024, 100_000, 2**53
#: Triangular factors that one task, or the driver, puts together.
FAN_IN = 32
#: Components that hold less than this share of the variance have no direction of their own.
NO_VARIANCE = 1e-20


def whole(vectors: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(SCALE * vectors) + SHIFT, -LIMIT, LIMIT).astype(np.int64)


def sums(rows: DataFrame, vec_col: str, d: int) -> tuple[int, list[int], int]:
    """(rows, their exact sum in each dimension, the largest absolute entry). Tasks add up halves of 27 bits, so that nothing overflows."""

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, top, total = 0, 0, np.zeros((d, 2), np.int64)
        for batch in parts:
            if batch.num_rows:
                x = whole(matrix(batch.column(0), d))
                n, top = n + len(x), max(top, int(np.abs(x).max()))
                total += np.stack([(x >> 27).sum(axis=0), (x & (1 << 27) - 1).sum(axis=0)], axis=1)
        at = np.arange(d, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[:, 0]), pa.array(total[:, 1]), pa.array(np.full(d, n)), pa.array(np.full(d, top))], ["at", "high", "low", "n", "top"])

    added = rows.select(vec_col).mapInArrow(add, "at int, high long, low long, n long, top long")
    exact = lambda c: F.sum(F.col(c).cast("decimal(28,0)")).alias(c)
    found = sorted(added.groupBy("at").agg(exact("high"), exact("low"), F.sum("n").alias("n"), F.max("top").alias("top")).collect())  # one row a dimension
    return found[0].n, [(int(r.high) << 27) + int(r.low) for r in found], max(r.top for r in found)


def times_n_less_sum(x: np.ndarray, n: int, total: list[int], top: int) -> np.ndarray:
    """n * x - S exactly: 64-bit integers where they hold it, else Python's."""
    if 2 * n * max(top, 1) < 2**62:
        return n * x - np.array(total, np.int64)
    return n * x.astype(object) - np.array(total, object)


def centred(x: np.ndarray, n: int, total: list[int], top: int) -> np.ndarray:
    return times_n_less_sum(x, n, total, top).astype(np.float64) / n


def triangle(rows: DataFrame, vec_col: str, d: int, n: int, total: list[int], top: int) -> np.ndarray:
    """R of the QR factorisation of all centred rows. Each task folds its rows into a triangle, block by block; triangles are
    stacked FAN_IN at a time and factored again, in tasks, until so few are left that the driver takes the last step."""
    schema = "part long, r binary"

    def fold(blocks: Iterator[np.ndarray]) -> np.ndarray:
        r = np.zeros((0, d))
        for block in blocks:
            r = np.linalg.qr(np.vstack([r, block]), mode="r")
        return r

    def own(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = fold(centred(whole(matrix(b.column(0), d)), n, total, top) for b in parts if b.num_rows)
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()], pa.binary())], ["part", "r"])

    def stacked(group: pa.Table) -> pa.Table:
        r = fold(np.frombuffer(x.as_py()).reshape(-1, d) for x in group.column("r"))
        return pa.table([pa.array([group.column("part")[0].as_py() // FAN_IN], pa.int64()), pa.array([r.tobytes()], pa.binary())], names=["part", "r"])

    found = stored(rows.select(vec_col).mapInArrow(own, schema))
    while found.count() > FAN_IN:
        found = stored(found.groupBy(F.floor(F.col("part") / FAN_IN)).applyInArrow(stacked, schema))
    return fold(np.frombuffer(bytes(r.r)).reshape(-1, d) for r in found.orderBy("part").collect())  # FAN_IN triangles at most


def identity_error(rows: DataFrame, vec_col: str, d: int, project, width: int) -> float:
    """The largest absolute entry of the projections' covariance less the identity. Tasks centre on their own means; the means'
    deviations from the mean of all are added in a second step."""

    def moments(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, square = 0, np.zeros(width), np.zeros((width, width))
        for batch in parts:
            if batch.num_rows:
                w = project(whole(matrix(batch.column(0), d)))
                own = w.mean(axis=0)
                more, step = len(w), own - mean
                square += (w - own).T @ (w - own) + np.outer(step, step) * (n * more / (n + more))
                mean, n = mean + step * (more / (n + more)), n + more
        if n:
            i, j = map(np.ravel, np.indices((width, width)))
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(np.full(len(i), n)), pa.array(mean[i]), pa.array(mean[j]), pa.array(square[i, j])], ["i", "j", "n", "mi", "mj", "m2"])

    parts = stored(rows.select(vec_col).mapInArrow(moments, "i long, j long, n long, mi double, mj double, m2 double"))
    means = parts.where("j = 0").groupBy("i").agg((F.sum(F.col("n") * F.col("mi")) / F.sum("n")).alias("m")).collect()  # one row a component
    m = F.array(*[F.lit(r.m) for r in sorted(means)])
    apart = F.col("n") * (F.col("mi") - m[F.col("i").cast("int")]) * (F.col("mj") - m[F.col("j").cast("int")])
    cov = parts.groupBy("i", "j").agg((F.sum(F.col("m2") + apart) / F.sum("n")).alias("c"))
    return cov.agg(F.max(F.abs(F.col("c") - F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0)))).first()[0]


def whiten(vectors: DataFrame, components: int = 8, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """A row for each vector and component: id, component from 1, n, deviation, whitened, explained, identity_error.

    The fit takes all vectors that are not null, not empty, and without null or non-finite entries; should lengths differ, those of the
    commonest (of two as common, the longer). Others have no rows. Rows that repeat count as often as they stand. Where
    vectors have fewer dimensions than `components`, so many components. A component without variance (one vector only, constant
    or dependent dimensions) has explained 0 and whitened null, and identity_error looks at the others, null if there are none. An entry
    beyond +-2**53 in integer form counts as that bound. A deviation that no long holds is null. No vectors, no rows. Ids may be null or
    repeat; other columns are not looked at.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    named = lambda df: df.withColumnRenamed("id", id_col)
    rows, d = usable(vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")), "v")
    if not d:
        return named(spark.createDataFrame([], schema))
    n, total, top = sums(rows, "v", d)
    width = min(components, d)
    values, directions = decomposed(triangle(rows, "v", d, n, total, top), width)
    trace = float(values.sum())
    real = values[:width] > NO_VARIANCE * trace if trace else np.zeros(width, bool)
    some = directions[:, real] / np.sqrt(values[:width][real] / n)
    explained = [float(v / trace) if ok else 0.0 for v, ok in zip(values[:width], real, strict=True)]
    project = lambda x: centred(x, n, total, top) @ some
    error = identity_error(rows, "v", d, project, int(real.sum())) if real.any() else None

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            if not batch.num_rows:
                continue
            x = whole(matrix(batch.column(1), d))
            y = times_n_less_sum(x, n, total, top)
            if y.dtype == object or d * int(np.abs(y).max()) ** 2 >= 2**63:
                y = y.astype(object)
            deviation = [v if v < 2**63 else None for v in map(int, (y * y).sum(axis=1))]
            w = np.full((len(x), width), np.nan)
            w[:, real] = y.astype(np.float64) / n @ some
            each = lambda a: np.repeat(a, width)
            at = pa.array(each(np.arange(len(x))))
            tiled = lambda a, t: pa.array(np.tile(np.array(a), len(x)), t)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), tiled(range(1, width + 1), pa.int32()), pa.array(np.full(len(at), n)), pa.array(deviation, pa.int64()).take(at),
                 pa.array(w.ravel(), mask=np.tile(~real, len(x))), tiled(explained, pa.float64()), pa.array([error] * len(at), pa.float64())],
                ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return named(rows.select("id", "v").mapInArrow(write, schema))
