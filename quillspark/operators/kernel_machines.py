"""Kernel support vector machines for classes and numbers: Nystroem features and a linear fit by Newton steps over the whole table.

Landmarks are a bounded number of different rows, in order of their hash; a row's features are its kernel values with them, times the inverse root of the
landmarks' own kernel matrix. Where a table has no more different rows than LANDMARKS, these features give the kernel exactly. The loss is
squared (hinge for classes, beyond epsilon for numbers), so each step sums up a gradient and a Gram matrix of the rows that count: one pass over the table, of
which each task sends LANDMARKS squared numbers. Features are computed where they are needed and never stored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stored

LANDMARKS, STEPS, TOLERANCE = 200, 50, 1e-9


@dataclass(frozen=True)
class Kernel:
    """rbf: exp(-gamma |x - y|^2); poly: (gamma x.y + shift)^degree."""

    kind: str = "rbf"
    gamma: float = 0.1
    degree: int = 3
    shift: float = 1.0

    def __call__(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        if self.kind == "rbf":
            far = (x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T
            return np.exp(-self.gamma * np.maximum(far, 0))
        return (self.gamma * x @ y.T + self.shift) ** self.degree


@dataclass(frozen=True)
class Machine:
    """landmarks x dims, landmarks x features, and for each class (or the one number) the weights of features and a constant."""

    kernel: Kernel
    landmarks: np.ndarray
    root: np.ndarray
    weights: np.ndarray
    classes: tuple[float, ...]

    def features(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([self.kernel(x, self.landmarks) @ self.root, np.ones((len(x), 1))])

    def decide(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights.T

    def predict(self, rows: DataFrame, vector: str = "x") -> DataFrame:
        """rows with prediction: a class (of two the second if its value is above 0, of more that of the greatest value, ties to the first) or a number; null without a valid vector."""
        kept = [c for c in rows.columns if c != "prediction"]
        valid = F.forall(vector, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))) & (F.size(vector) == self.landmarks.shape[1])
        rows = rows.select(*kept, F.when(valid, F.col(vector).cast("array<double>")).alias("__x"))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                there = b["__x"].map(lambda v: v is not None).to_numpy(bool)
                out = np.full(len(b), np.nan)
                if there.any():
                    d = self.decide(np.stack(b["__x"][there].to_list()))
                    out[there] = d[:, 0] if not self.classes else np.array(self.classes)[(d[:, 0] > 0).astype(int) if len(self.classes) == 2 else d.argmax(1)]
                yield b.drop(columns="__x").assign(prediction=[None if np.isnan(v) else v for v in out])

        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__x"), "prediction double"])
        return rows.mapInPandas(run, schema)


def fit(rows: DataFrame, kernel: Kernel, c: float = 1.0, classify: bool = True, epsilon: float = 0.1, class_weights: dict[float, float] | None = None, landmarks: int = LANDMARKS) -> Machine | None:
    """The machine that minimises |w|^2 / 2 + c * sum of squared losses over rows (x, y); None without rows. Rows with nulls or non-finite numbers take no part.

    Classes are told by y; of more than two, each is fitted against the rest. class_weights multiply c for a class.
    """
    x, y = F.col("x").cast("array<double>"), F.col("y").cast("double")
    finite = lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))
    rows = stored(rows.filter(x.isNotNull() & F.forall(x, finite) & finite(y)).select(x.alias("x"), y.alias("y")), "machine-rows")  # read once a step
    marks = [r.x for r in rows.select("x").distinct().orderBy(F.xxhash64("x"), "x").limit(landmarks).collect()]  # at most so many
    if not marks:
        return None
    marks = np.array(marks)
    value, vector = np.linalg.eigh(kernel(marks, marks))
    kept = value > value.max() * 1e-12
    root = vector[:, kept] / np.sqrt(value[kept])
    classes = tuple(r.y for r in rows.select("y").distinct().orderBy("y").limit(1000).collect()) if classify else ()
    targets = [0.0] if not classify else list(classes) if len(classes) > 2 else [classes[-1]]
    width = int(kept.sum()) + 1
    machine = Machine(kernel, marks, root, np.zeros((len(targets), width)), classes)
    weights = np.stack([_newton(rows, machine, t, c, classify, epsilon, class_weights or {}) for t in targets])
    return Machine(kernel, marks, root, weights, classes)


def _newton(rows: DataFrame, machine: Machine, target: float, c: float, classify: bool, epsilon: float, class_weights: dict[float, float]) -> np.ndarray:
    """Newton steps with halving; the constant isn't held down."""
    width = machine.weights.shape[1]
    keep = np.append(np.ones(width - 1), 1e-8)

    def sums(w: np.ndarray, only_loss: bool = False) -> tuple[float, np.ndarray, np.ndarray]:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            loss, g, h = 0.0, np.zeros(width), np.zeros((width, width))
            for b in batches:
                if len(b):
                    f, y = machine.features(np.stack(b["x"].to_list())), b["y"].to_numpy()
                    weight = np.array([class_weights.get(v, 1.0) for v in y])
                    if classify:
                        sign = np.where(y == target, 1.0, -1.0)
                        short = np.maximum(1 - sign * (f @ w), 0)
                        slope = -sign * short
                    else:
                        away = f @ w - y
                        short = np.maximum(np.abs(away) - epsilon, 0)
                        slope = np.sign(away) * short
                    on = short > 0
                    loss += (weight * short**2).sum()
                    if not only_loss:
                        g += f.T @ (weight * slope)
                        h += (f[on] * weight[on, None]).T @ f[on]
            values = [loss] if only_loss else [loss, *g, *h.ravel()]
            yield pd.DataFrame({"i": np.arange(len(values)), "v": values})

        found = rows.mapInPandas(run, "i bigint, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()  # width * width numbers
        total = np.zeros(1 if only_loss else 1 + width + width * width)
        for r in found:
            total[r.i] = r.v
        return total[0], total[1 : 1 + width], total[1 + width :].reshape(-1, width)

    w = np.zeros(width)
    for _ in range(STEPS):
        loss, g, h = sums(w)
        value, slope = (keep * w * w).sum() / 2 + c * loss, keep * w + 2 * c * g
        if np.abs(slope).max() <= TOLERANCE * max(1.0, c):
            break
        step = np.linalg.solve(np.diag(keep) + 2 * c * h, slope)
        part = 1.0
        while part > 1e-6:
            new = w - part * step
            if (keep * new * new).sum() / 2 + c * sums(new, True)[0] <= value - 1e-4 * part * slope @ step:
                break
            part /= 2
        else:
            break
        w = new
    return w
