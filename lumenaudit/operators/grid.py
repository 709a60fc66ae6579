"""Ridge logistic fits of a whole grid (folds x components x C), all of them in the same passes over the rows.

A pass gives every model that has not converged its loss, gradient and curvature at once: tasks sum them with numpy over their rows, Spark adds the tasks' sums as columns,
and what reaches the driver is one matrix a model, of a size that the grid and the vector's length fix. A handful of Newton passes serves all models.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Passes before a model that still moves is taken as it is: Newton steps with halving need about eight.
PASSES = 40


def _summed(rows: DataFrame, batches, width: int) -> dict[tuple[int, int], np.ndarray]:
    """(model, line) -> sum of the lines that tasks send; Spark adds them, partly before the shuffle."""
    schema = "model int, line int, " + ", ".join(f"s{i} double" for i in range(width))
    sums = rows.mapInArrow(batches, schema).groupBy("model", "line").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(width)])
    return {(r[0], r[1]): np.array(r[2:], float) for r in sums.collect()}


def _lines(tables: dict[int, np.ndarray], width: int) -> Iterator[pa.RecordBatch]:
    """Matrices by model as rows (model, line, s0, s1, ...), padded with zeros."""
    for model, m in tables.items():
        wide = np.zeros((len(m), width))
        wide[:, : m.shape[1]] = m
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), model, np.int32)), pa.array(np.arange(len(m), dtype=np.int32)), *[pa.array(c) for c in wide.T]], ["model", "line", *[f"s{i}" for i in range(width)]])


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(-1, dims)


def fold_components(rows: DataFrame, dims: int, k: int, most: int) -> tuple[dict[int, np.ndarray], dict[int, int]]:
    """(fold -> leading principal axes of the rows outside it, fold -> their number) from one pass: moments of a fold's complement are the total's less its own."""

    def batches(it):
        moments: dict[int, np.ndarray] = {}
        for b in it:
            z, fold = _matrix(b.column(0), dims), np.asarray(b.column(1))
            z = np.hstack([z, np.ones((len(z), 1))])
            for f in np.unique(fold).tolist():
                part = z[fold == f]
                moments[f] = moments.get(f, 0) + part.T @ part
        yield from _lines(moments, dims + 1)

    sums = _summed(rows.select("z", "fold"), batches, dims + 1)
    own = {f: np.array([sums.get((f, i), np.zeros(dims + 1)) for i in range(dims + 1)]) for f in range(k)}
    total = sum(own.values())
    axes, sizes = {}, {}
    for f in range(k):
        m = total - own[f]
        n = m[dims, dims]
        sizes[f] = int(n)
        if n >= 2:
            mean = m[dims, :dims] / n
            _, vectors = np.linalg.eigh((m[:dims, :dims] - n * np.outer(mean, mean)) / (n - 1))
            axes[f] = vectors[:, ::-1][:, :most]
    return axes, sizes


class _Model:
    """One model's Newton state: the best point so far, and the point to try next."""

    def __init__(self, fold: int, n: int, c: float):
        self.fold, self.n, self.c = fold, n, c
        self.best, self.value, self.step, self.slope, self.size = np.zeros(n + 1), np.inf, np.zeros(n + 1), 0.0, 1.0
        self.next, self.done = self.best, False

    def take(self, lines: np.ndarray) -> None:
        """Take the sums at self.next: lines of the curvature, then (gradient), then (loss)."""
        n, ridge = self.n, np.append(np.full(self.n, 1 / self.c), 0.0)
        value = lines[n + 2, 0] + 0.5 * float(ridge @ self.next**2)
        if value > self.value + 1e-4 * self.size * self.slope + 1e-12 * abs(self.value):
            self.size /= 2
            self.done = self.size < 1e-6
        else:
            self.best, self.value, self.size = self.next, value, 1.0
            gradient = lines[n + 1, : n + 1] + ridge * self.best
            self.step = -np.linalg.solve(lines[: n + 1, : n + 1] + np.diag(ridge + 1e-12), gradient)
            self.slope = float(gradient @ self.step)
            self.done = -self.slope < 1e-12 * max(1.0, self.value)
        self.next = self.best + self.size * self.step


def fit_grid(rows: DataFrame, label: str, dims: int, k: int, pairs: list[tuple[int, float]]) -> list[tuple[int, int, float, np.ndarray, float]]:
    """(fold, components, C, weights on z, bias) of every fold and pair, each fitted on the rows outside its fold.

    rows has z (an array of dims numbers), fold (0 to k - 1) and the label (0 or 1). The loss is the sum over the rows plus |w|^2 / (2 C); the bias is free. A fold whose
    complement has fewer than two rows or one class is left out.
    """
    axes, _ = fold_components(rows, dims, k, max(n for n, _ in pairs))
    seen = {(r[0], r[1]): r[2] for r in rows.groupBy("fold", label).count().collect()}
    both = [f for f in axes if all(sum(n for (g, y), n in seen.items() if g != f and y == want) for want in (0, 1))]
    models = {i: _Model(f, n, c) for i, (f, n, c) in enumerate((f, n, c) for f in both for n, c in pairs)}
    width = max((m.n for m in models.values()), default=0) + 1
    data = rows.select("z", "fold", F.col(label).cast("double").alias("y"))
    for _ in range(PASSES):
        active = {i: (m.fold, m.n, m.next) for i, m in models.items() if not m.done}
        if not active:
            break

        def batches(it, active=active):
            sums = {i: np.zeros((n + 3, n + 1)) for i, (_, n, _) in active.items()}
            for b in it:
                z, fold, y = _matrix(b.column(0), dims), np.asarray(b.column(1)), np.asarray(b.column(2))
                for f in sorted({f for f, _, _ in active.values()}):
                    x, t = z[fold != f] @ axes[f], y[fold != f]
                    for i, (g, n, w) in active.items():
                        if g != f:
                            continue
                        eta = x[:, :n] @ w[:n] + w[n]
                        p = 0.5 * (1 + np.tanh(0.5 * eta))
                        xa = np.hstack([x[:, :n], np.ones((len(x), 1))])
                        sums[i][: n + 1] += xa.T @ (xa * (p * (1 - p))[:, None])
                        sums[i][n + 1] += xa.T @ (p - t)
                        sums[i][n + 2, 0] += float((np.logaddexp(0, eta) - t * eta).sum())
            yield from _lines(sums, width)

        found = _summed(data, batches, width)
        for i, (_, n, _) in active.items():
            models[i].take(np.array([found[i, line] for line in range(n + 3)]))
    return [(m.fold, m.n, m.c, axes[m.fold][:, : m.n] @ m.best[: m.n], float(m.best[m.n])) for m in models.values()]


def held_out_scores(rows: DataFrame, label: str, dims: int, models: list[tuple[int, int, float, np.ndarray, float]]) -> DataFrame:
    """model (its place in the list), label, p: every row under each model of its own fold."""
    of: dict[int, list[int]] = {}
    for i, m in enumerate(models):
        of.setdefault(m[0], []).append(i)

    def batches(it):
        for b in it:
            z, fold, y = _matrix(b.column(0), dims), np.asarray(b.column(1)), np.asarray(b.column(2))
            for f, members in of.items():
                at = fold == f
                for i in members if at.any() else ():
                    n = int(at.sum())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, i, np.int32)), pa.array(y[at].astype(np.int32)), pa.array(z[at] @ models[i][3] + models[i][4])], ["model", label, "p"])

    return rows.select("z", "fold", F.col(label).cast("int")).mapInArrow(batches, f"model int, {label} int, p double")
