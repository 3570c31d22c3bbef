"""Random Fourier features: a linear model on them is one with the RBF kernel exp(-gamma |x - y|^2), at any number of rows.

The map is drawn once from a seed and applied to Arrow batches as one matrix product; the dot product of two mapped rows is
the kernel up to an error that shrinks with the square root of ``dims``.

``FourierSVC`` fits the machines of all classes side by side.  Mapped rows are many times as wide as the input, so they are
never stored: every step of the descent maps the rows again, batch by batch, and a task sends back one sum of gradients.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import (HasFeaturesCol, HasInputCol, HasLabelCol, HasMaxIter, HasOutputCol, HasPredictionCol,
                                     HasRawPredictionCol, HasRegParam, HasSeed, HasWeightCol)
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fourier_map(width: int, dims: int, gamma: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Directions (width x dims) and phases of the map."""
    draw = np.random.default_rng([seed, width, dims])
    return draw.normal(scale=np.sqrt(2.0 * gamma), size=(width, dims)), draw.uniform(0.0, 2.0 * np.pi, dims)


class RandomFourier(Transformer, HasInputCol, HasOutputCol, HasSeed, DefaultParamsReadable, DefaultParamsWritable):
    """A vector column to ``dims`` random Fourier features; ``gamma`` 0 stands for 1 / width (scaled features).

    Missing components count as 0, the mean of scaled features.
    """

    dims = Param(Params._dummy(), "dims", "number of features", typeConverter=TypeConverters.toInt)
    gamma = Param(Params._dummy(), "gamma", "kernel width, 0 for 1 / number of inputs", typeConverter=TypeConverters.toFloat)

    @keyword_only
    def __init__(self, inputCol: str = "features", outputCol: str = "fourier", dims: int = 256, gamma: float = 0.0, seed: int = 42):
        super().__init__()
        self._setDefault(inputCol="features", outputCol="fourier", dims=256, gamma=0.0, seed=42)
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        dims, gamma, seed = self.getOrDefault("dims"), self.getOrDefault("gamma"), self.getOrDefault("seed")

        @F.pandas_udf("array<double>")
        def mapped(rows: pd.Series) -> pd.Series:
            if not len(rows):
                return pd.Series([], dtype=object)
            x = np.nan_to_num(np.stack(rows.to_numpy()).astype(float))
            directions, phases = fourier_map(x.shape[1], dims, gamma or 1.0 / x.shape[1], seed)
            return pd.Series(list(np.sqrt(2.0 / dims) * np.cos(x @ directions + phases)))

        return dataset.withColumn(self.getOutputCol(), array_to_vector(mapped(vector_to_array(F.col(self.getInputCol())))))


class Descent:
    """L-BFGS by halved steps: ``at`` is the point whose value and gradient are to be told next.

    It ends after ``iterations`` steps taken, or when one lowers the value by less than ``tol`` of it.
    """

    def __init__(self, size: int, iterations: int, tol: float = 1e-6, memory: int = 10):
        self.x = self.at = np.zeros(size)
        self.left, self.tol, self.memory, self.value, self.pairs = iterations, tol, memory, None, []

    def told(self, value: float, gradient: np.ndarray) -> None:
        if self.value is not None:
            if not value <= self.value + 1e-4 * self.step * self.slope:
                self.step /= 2
                self.left = self.left if self.step > 1e-9 else 0
                self.at = self.x + self.step * self.way
                return
            s, y = self.at - self.x, gradient - self.gradient
            if s @ y > 1e-12 * (y @ y):
                self.pairs = [*self.pairs, (s, y)][-self.memory:]
            self.left = self.left - 1 if self.value - value > self.tol * abs(value) else 0
        self.x, self.value, self.gradient = self.at, value, gradient
        way, steps = -gradient, []
        for s, y in reversed(self.pairs):
            steps.append((s @ way) / (s @ y))
            way = way - steps[-1] * y
        if self.pairs:
            s, y = self.pairs[-1]
            way = way * ((s @ y) / (y @ y))
        for (s, y), a in zip(self.pairs, reversed(steps)):
            way = way + (a - (y @ way) / (s @ y)) * s
        self.way, self.slope = way, float(gradient @ way)
        if not self.slope < 0:
            self.way, self.slope, self.left = way, 0.0, 0
        self.step = 1.0 if self.pairs else min(1.0, 1.0 / max(float(np.sqrt(gradient @ gradient)), 1e-300))
        self.at = self.x + self.step * self.way


class FourierSVC(Estimator, HasInputCol, HasFeaturesCol, HasLabelCol, HasWeightCol, HasPredictionCol, HasRawPredictionCol, HasMaxIter, HasRegParam,
                 HasSeed, DefaultParamsReadable, DefaultParamsWritable):
    """One-vs-rest linear machines (mean hinge loss, L2) on the random Fourier features of ``inputCol``, fitted without storing them.

    ``dims``, ``gamma`` and ``seed`` are those of the RandomFourier that writes ``featuresCol``, which the model reads.
    Classes are 0 to the largest label; a row without a label belongs to none.  Features are centred and scaled in the descent, not
    in the penalty.  The input is persisted for the passes; the driver gets one row of sums from each task.
    """

    dims = Param(Params._dummy(), "dims", "number of features", typeConverter=TypeConverters.toInt)
    gamma = Param(Params._dummy(), "gamma", "kernel width, 0 for 1 / number of inputs", typeConverter=TypeConverters.toFloat)

    @keyword_only
    def __init__(self, inputCol: str = "features", featuresCol: str = "fourier", labelCol: str = "label", dims: int = 256, gamma: float = 0.0,
                 seed: int = 42, maxIter: int = 50, regParam: float = 1e-4):
        super().__init__()
        self._setDefault(inputCol="features", featuresCol="fourier", labelCol="label", dims=256, gamma=0.0, seed=42, maxIter=50, regParam=1e-4)
        self._set(**self._input_kwargs)

    def setWeightCol(self, value: str) -> FourierSVC:
        return self._set(weightCol=value)

    def _fit(self, dataset: DataFrame) -> FourierSVCModel:
        dims, lam = self.getOrDefault("dims"), self.getOrDefault("regParam")
        weight = F.col(self.getWeightCol()).cast("double") if self.isDefined("weightCol") and self.getWeightCol() else F.lit(1.0)
        rows = dataset.select(vector_to_array(F.col(self.getInputCol())).alias("x"), F.col(self.getLabelCol()).cast("double").alias("y"), weight.alias("w"))
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            weights = self._descend(rows, dims, lam)
        finally:
            rows.unpersist()
        return self._copyValues(FourierSVCModel()._set(weights=weights.ravel().tolist(), classes=len(weights)))

    def _descend(self, rows: DataFrame, dims: int, lam: float) -> np.ndarray:
        gamma, seed = self.getOrDefault("gamma"), self.getOrDefault("seed")

        def total(add: Callable, size: int) -> np.ndarray:
            """The sum over all batches of ``add``'s vector for their mapped rows, labels (-1 for none) and weights."""
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                out = np.zeros(size)
                for batch in batches:
                    if batch.num_rows:
                        x = np.nan_to_num(batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
                        y, w = (np.nan_to_num(batch.column(c).to_numpy(zero_copy_only=False).astype(float), nan=v) for c, v in (("y", -1.0), ("w", 0.0)))
                        directions, phases = fourier_map(x.shape[1], dims, gamma or 1.0 / x.shape[1], seed)
                        z = x.astype(np.float32) @ directions.astype(np.float32)
                        z += phases.astype(np.float32)
                        out += add(np.float32(np.sqrt(2.0 / dims)) * np.cos(z, out=z), y, w)
                yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["sums"])

            return sum((np.frombuffer(r.sums) for r in rows.mapInArrow(run, "sums binary").collect()), np.zeros(size))

        def moments(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
            return np.concatenate([[w.sum(), w @ w], w @ z, w @ (z * z)])

        classes = int(rows.agg(F.max("y")).first()[0]) + 1
        (n, n2), first, second = np.split(total(moments, 2 + 2 * dims), [2, 2 + dims])
        mean = first / n
        spread = np.sqrt(np.maximum(second - n * mean * mean, 0.0) / max(n - n2 / n, 1.0))
        scale = np.where(spread > 1e-9, 1.0 / np.maximum(spread, 1e-9), 0.0)
        each = [Descent(dims + 1, self.getOrDefault("maxIter")) for _ in range(classes)]

        def plain(points: list[np.ndarray]) -> np.ndarray:
            """Weights and intercepts on the features themselves."""
            w = np.array([p[:-1] * scale for p in points])
            return np.column_stack([w, [p[-1] for p in points] - w @ mean])

        while any(d.left > 0 for d in each):
            machines = plain([d.at for d in each])

            def losses(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
                sign = np.where(y[:, None] == np.arange(classes), 1.0, -1.0)
                slack = 1.0 - sign * (z @ machines[:, :-1].T.astype(np.float32) + machines[:, -1])
                pull = np.where(slack > 0, -sign * w[:, None], 0.0)
                return np.concatenate([w @ np.maximum(slack, 0.0), pull.sum(axis=0), (pull.astype(np.float32).T @ z).ravel()])

            loss, pull, along = np.split(total(losses, (2 + dims) * classes), [classes, 2 * classes])
            for k, d in enumerate(each):
                if d.left > 0:
                    v = d.at[:-1]
                    g = (along.reshape(classes, dims)[k] - mean * pull[k]) * scale / n + lam * v * scale ** 2
                    d.told(loss[k] / n + lam / 2 * float((v * scale) @ (v * scale)), np.append(g, pull[k] / n))
        return plain([d.x for d in each])


class FourierSVCModel(Model, HasFeaturesCol, HasPredictionCol, HasRawPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """The margins of all classes (``rawPrediction``) and the class of the largest, the first of equals."""

    weights = Param(Params._dummy(), "weights", "weights and intercept of each class in turn", typeConverter=TypeConverters.toListFloat)
    classes = Param(Params._dummy(), "classes", "number of classes", typeConverter=TypeConverters.toInt)

    def setFeaturesCol(self, value: str) -> FourierSVCModel:
        return self._set(featuresCol=value)

    def setPredictionCol(self, value: str) -> FourierSVCModel:
        return self._set(predictionCol=value)

    def setRawPredictionCol(self, value: str) -> FourierSVCModel:
        return self._set(rawPredictionCol=value)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        machines = np.array(self.getOrDefault("weights")).reshape(self.getOrDefault("classes"), -1)

        @F.pandas_udf("array<double>")
        def margins(rows: pd.Series) -> pd.Series:
            if not len(rows):
                return pd.Series([], dtype=object)
            return pd.Series(list(np.stack(rows.to_numpy()) @ machines[:, :-1].T + machines[:, -1]))

        raw, m = self.getRawPredictionCol(), "_margins"
        out = dataset.withColumn(m, margins(vector_to_array(F.col(self.getFeaturesCol())))).withColumn(raw, array_to_vector(F.col(m)))
        return out.withColumn(self.getPredictionCol(), (F.array_position(m, F.array_max(m)) - 1).cast("double")).drop(m)
