"""A perceptron with one hidden layer on counted rows.

The library's perceptron takes no weights, so equal rows would each be passed forward and back in every step.
Network and loss are the library's (logistic hidden units, softmax, mean cross-entropy, limited-memory BFGS over
all rows); a task sums loss and gradient of its distinct rows, times how often they stand.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HIDDEN, MEMORY, TOLERANCE = 100, 10, 1e-6


def _layers(w: np.ndarray, inputs: int, hidden: int, classes: int) -> Sequence[np.ndarray]:
    a, b, c = inputs * hidden, (inputs + 1) * hidden, (inputs + 1) * hidden + hidden * classes
    return w[:a].reshape(inputs, hidden), w[a:b], w[b:c].reshape(hidden, classes), w[c:]


def _forward(w: np.ndarray, x: np.ndarray, hidden: int, classes: int) -> tuple[np.ndarray, np.ndarray]:
    w1, b1, w2, b2 = _layers(w, x.shape[1], hidden, classes)
    h = 0.5 * (1.0 + np.tanh(0.5 * (x @ w1 + b1)))
    z = h @ w2 + b2
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return h, e / e.sum(axis=1, keepdims=True)


def loss_and_gradient(w: np.ndarray, x: np.ndarray, label: np.ndarray, n: np.ndarray, hidden: int, classes: int) -> np.ndarray:
    """Summed loss, rows, and gradient, one after the other."""
    h, p = _forward(w, x, hidden, classes)
    w2 = _layers(w, x.shape[1], hidden, classes)[2]
    at = np.arange(len(x)), label
    loss = -(n * np.log(np.maximum(p[at], 1e-300))).sum()
    p[at] -= 1.0
    out = p * n[:, None]
    back = (out @ w2.T) * h * (1.0 - h)
    return np.concatenate([[loss, n.sum()], (x.T @ back).ravel(), back.sum(0), (h.T @ out).ravel(), out.sum(0)])


def minimise(value: Callable[[np.ndarray], tuple[float, np.ndarray]], w: np.ndarray, max_iter: int) -> np.ndarray:
    """Limited-memory BFGS with halved steps; it stops when a step gains less than ``TOLERANCE`` of the value."""
    f, g = value(w)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(max_iter):
        d, held = -g, []
        for s, y in reversed(steps):
            held.append(s @ d / (s @ y))
            d = d - held[-1] * y
        if steps:
            s, y = steps[-1]
            d = d * (s @ y) / (y @ y)
        for (s, y), a in zip(steps, reversed(held)):
            d = d + (a - y @ d / (s @ y)) * s
        slope, step = float(g @ d), 1.0 if steps else 1.0 / max(float(np.linalg.norm(g)), 1e-12)
        if slope >= 0:
            break
        new, grad = value(w + step * d)
        while not new <= f + 1e-4 * step * slope and step > 1e-12:
            step /= 2.0
            new, grad = value(w + step * d)
        if not new < f:
            break
        if step * (grad - g) @ d > 1e-12 * (grad @ grad):
            steps = [*steps, (step * d, grad - g)][-MEMORY:]
        gained, w, f, g = f - new, w + step * d, new, grad
        if gained <= TOLERANCE * max(abs(f), 1e-12):
            break
    return w


def fit_perceptron(
    counted: DataFrame, inputs: int, classes: int, n: str, max_iter: int = 100, hidden: int = HIDDEN, seed: int = 42
) -> np.ndarray:
    """Weights from distinct rows: ``scaled`` (a vector), ``label`` and how often they stand."""
    x = vector_to_array("scaled")
    rows = counted.select(*[x[i].alias(f"x{i}") for i in range(inputs)], F.col("label").cast("int"), F.col(n).cast("double").alias("n")).persist()

    def value(w: np.ndarray) -> tuple[float, np.ndarray]:
        def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(2 + len(w))
            for pdf in batches:
                some = pdf.iloc[:, :inputs].to_numpy(float)
                total += loss_and_gradient(w, some, pdf["label"].to_numpy(), pdf["n"].to_numpy(), hidden, classes)
            yield pd.DataFrame({"sums": [total]})

        partial = rows.mapInPandas(sums, "sums array<double>").select(array_to_vector("sums").alias("sums"))
        total = partial.agg(Summarizer.sum(F.col("sums"))).first()[0].toArray()
        return total[0] / total[1], total[2:] / total[1]

    random = np.random.default_rng(seed)
    spread = lambda fan_in, size: (random.random(size) * 4.8 - 2.4) / fan_in
    start = np.concatenate([spread(inputs, (inputs + 1) * hidden), spread(hidden, (hidden + 1) * classes)])
    try:
        return minimise(value, start, max_iter)
    finally:
        rows.unpersist()


def perceived(points: DataFrame, w: np.ndarray, classes: int, keep: Sequence[str], hidden: int = HIDDEN) -> DataFrame:
    """``keep`` columns of ``points``, ``votes`` (a probability for each class) and ``prediction``, from ``scaled``."""
    rows = points.select(*[F.col(f"`{c}`") for c in keep], vector_to_array("scaled").alias("_x"))
    schema = f"{rows.drop('_x').schema.simpleString()[7:-1]}, votes array<double>, prediction double"

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                p = _forward(w, np.stack(pdf["_x"].to_list()), hidden, classes)[1]
                yield pdf.drop(columns="_x").assign(votes=list(p), prediction=p.argmax(1).astype(float))

    return rows.mapInPandas(score, schema)
