"""Whitening of embeddings by the covariance of their distinct vectors.

Method.
1. Entries c become whole numbers x = floor(256 c); rows whose vector is null, or
   holds null or non-finite entries, are dropped.  The fit list holds each vector
   x once (a shuffle with partial aggregation, so a vector on a third of all rows
   costs a row per task) and is written as a table.
2. n and the sums S of each dimension come from one aggregate with exact whole
   numbers.  The centred rows n x - S are whole numbers too: nothing is rounded
   before they are multiplied.
3. Spark MLlib's RowMatrix over these rows gives their Gramian, by tree
   aggregation of packed triangles; divided by n (and by n**2, for the scale of
   the rows) it is the covariance V.  `eigh` runs on the driver.
4. Mean, components and scales are broadcast, and mapInPandas whitens all rows.
   The covariance of the whitened fit list is measured by one more pass.

What the driver receives, and what is broadcast, is bounded by the number of
dimensions d alone: d**2 doubles for the Gramian, up to `MOST` of them, and
`TOP` + 1 vectors of d entries for the broadcast.  Nothing grows with the rows.

Defined results: d is the most frequent length of the vectors (ties: the longer
one); vectors of another length lack entries or have too many and are dropped, as
those with null entries are; so are empty ones.  A null vec_id stays null, rows
that stand there twice are returned twice.  Components whose variance is zero, up
to rounding, can't be scaled to one and are left out, so n vectors have at most
n - 1 components, and an empty table or a single vector gives an empty result.
`deviation` is null where it exceeds a long, and floor(256 c) is the nearest long where
it exceeds one.  Signs are chosen so that a component's entry of largest size (the
first, at a tie) is positive.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discarded, made, saved, table

UNIT = 256
#: Components that are returned, and dimensions that the driver can take.
TOP, MOST = 4, 8192
#: Variances below this share of the largest one are rounding.
ROUNDING = 2.0**-46
#: Entries of a slice of rows that is whitened at once.
SLICE = 1 << 21

RESULT = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


class Fit:
    """Of the fit list: count, sums, components (d x k) with their variances, and the trace of the covariance."""

    def __init__(self, n: int, sums: list[int], covariance: np.ndarray, top: int = TOP):
        values, vectors = np.linalg.eigh(covariance)
        order = np.argsort(-values, kind="stable")[:top]
        order = order[values[order] > ROUNDING * max(values[-1], 0.0)] if len(values) else order
        vectors = vectors[:, order]
        largest = np.argmax(np.abs(vectors) > np.abs(vectors).max(axis=0) * (1 - 1e-12), axis=0)
        self.vectors = vectors * np.sign(vectors[largest, np.arange(vectors.shape[1])])
        self.n, self.sums, self.values, self.trace = n, sums, values[order], float(np.trace(covariance))

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n x - S in whole numbers: of 64 bits where they are enough."""
        if self.narrow(x):
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def narrow(self, x: np.ndarray) -> bool:
        high = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
        reach = self.n * high + max(map(abs, self.sums))
        return reach * reach * x.shape[1] < 1 << 63

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        return (centred.astype(np.float64) / self.n) @ self.vectors / np.sqrt(self.values)

    def deviations(self, centred: np.ndarray) -> pd.Series:
        whole = (centred * centred).sum(axis=1)
        if whole.dtype == object:
            return pd.Series([v if v < 1 << 63 else None for v in whole.tolist()], dtype="Int64")
        return pd.Series(whole, dtype="Int64")


def whole_vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, x) of the rows whose vectors are whole and of the most frequent length."""
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = rows.select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>")).where(F.coalesce(finite, F.lit(False)) & (F.size("embedding") > 0))
    width = rows.groupBy(F.size("embedding").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    return rows.where(F.size("embedding") == (width[0] if width else 0)).select("vec_id", F.transform("embedding", lambda c: F.floor(c * UNIT)).alias("x"))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_list()).astype(np.int64)


def partial_sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Count, sums in two halves that stay whole numbers of 64 bits, and limits of a task's vectors."""
    for frame in frames:
        if len(frame):
            x = _matrix(frame["x"])
            yield pd.DataFrame({"n": [len(x)], "high": [(x >> 24).sum(axis=0)], "low": [(x & 0xFFFFFF).sum(axis=0)], "least": [x.min(axis=0)], "most": [x.max(axis=0)]})


def counted(fit_list: DataFrame) -> tuple[int, list[int], int]:
    """n, the sums of each dimension, and the largest size of an entry."""
    parts = fit_list.mapInPandas(partial_sums, "n bigint, " + ", ".join(f"{c} array<bigint>" for c in ("high", "low", "least", "most")))
    places = parts.select("n", F.posexplode(F.arrays_zip("high", "low", "least", "most")).alias("place", "of"))
    total = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c.split(".")[-1])
    rows = places.groupBy("place").agg(total("n"), total("of.high"), total("of.low"), F.min("of.least").alias("least"), F.max("of.most").alias("most")).orderBy("place").collect()
    sums = [(int(r["high"]) << 24) + int(r["low"]) for r in rows]
    return int(rows[0]["n"]) if rows else 0, sums, max((max(abs(r["least"]), abs(r["most"])) for r in rows), default=0)


def covariance(fit_list: DataFrame, n: int, sums: list[int], largest: int) -> np.ndarray:
    """RowMatrix's Gramian of the rows n x - S, divided by n and the scale of the rows."""
    if len(sums) > MOST:
        raise ValueError(f"the driver takes covariances of up to {MOST} dimensions, not {len(sums)}")
    kind = "bigint" if 2 * n * largest < 1 << 63 else "decimal(38,0)"  # both exact
    of = F.array(*[F.lit(str(s)).cast(kind) for s in sums])
    factor = "bigint" if kind == "bigint" else "decimal(19,0)"
    rows = F.zip_with("x", of, lambda x, s: (x.cast(factor) * F.lit(n).cast(factor) - s).cast("double"))
    vectors = MLUtils.convertVectorColumnsFromML(fit_list.select(array_to_vector(rows).alias("row")), "row")
    gramian = RowMatrix(vectors, n, len(sums)).computeGramianMatrix().toArray()
    return gramian / n / float(n) ** 2


def fitted(fit_list: DataFrame) -> Fit | None:
    n, sums, largest = counted(fit_list)
    return Fit(n, sums, covariance(fit_list, n, sums, largest)) if n else None


def _slices(frame: pd.DataFrame, width: int) -> Iterator[pd.DataFrame]:
    step = max(1, SLICE // width)
    for at in range(0, len(frame), step):
        yield frame.iloc[at : at + step]


def grams(fit) -> Callable:
    """Of a task's slices: the products of their whitened vectors, summed."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part in _slices(frame, len(fit.value.sums)):
                y = fit.value.whitened(fit.value.centred(_matrix(part["x"])))
                yield pd.DataFrame({"gram": [(y.T @ y).ravel()]})

    return run


def identity_error(fit_list: DataFrame, fit) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity."""
    k = len(fit.value.values)
    cells = fit_list.mapInPandas(grams(fit), "gram array<double>").select(F.posexplode("gram").alias("place", "part"))
    total = np.zeros(k * k)
    for place, value in cells.groupBy("place").agg(F.sum("part")).collect():
        total[place] = value
    return float(np.abs(total.reshape(k, k) / fit.value.n - np.eye(k)).max())


def whitener(fit, error: float) -> Callable:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = fit.value
        k = len(own.values)
        for frame in frames:
            for part in _slices(frame, len(own.sums)):
                centred = own.centred(_matrix(part["x"]))
                out = pd.DataFrame({"vec_id": part["vec_id"].astype("Int64").repeat(k).reset_index(drop=True)})
                out["component"] = np.tile(np.arange(1, k + 1, dtype=np.int32), len(part))
                out["n"] = own.n
                out["deviation"] = own.deviations(centred).repeat(k).reset_index(drop=True)
                out["whitened"] = own.whitened(centred).ravel()
                out["explained"] = np.tile(own.values / own.trace, len(part))
                out["identity_error"] = error
                yield out

    return run


def whitened(rows: DataFrame) -> DataFrame:
    """Rows of RESULT: each vector's whitened components, with the figures of the fit."""
    spark = rows.sparkSession
    vectors, mark = whole_vectors(rows), made()
    fit_list = saved(vectors.select("x").distinct(), "fit-list")
    fit = fitted(fit_list)
    if fit is None or not len(fit.values):
        discarded(spark, mark)
        return spark.createDataFrame([], RESULT)
    sent = spark.sparkContext.broadcast(fit)
    error = identity_error(fit_list, sent)
    discarded(spark, mark)
    return vectors.mapInPandas(whitener(sent, error), RESULT)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))
