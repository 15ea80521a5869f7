"""Batched Newton fits of linear classifiers.

All problems -- one for each group of rows (layer, seed, ...) and class -- are
fitted together.  A step is one Spark job: every task sums loss, gradient and
Hessian blocks of its rows for all problems (Arrow batches as matrices), the
sums are added up per group, and only these blocks, whose size is that of the
models, come back to be solved.  About ten steps replace thousands of jobs of
a first-order method per class.

Losses, all with strength C = 1 on the sum over rows:

* ``squared_hinge``  one class against the rest; the intercept is penalized
  like the other coefficients.
* ``logistic``       one label against its absence; the intercept is free.
* ``softmax``        all classes of a group jointly; the intercepts are free.

Rows may carry a weight, so several samples of one table are several groups or
weights of the same rows.  Steps are damped until the loss falls; a problem is
done when its gradient vanishes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame

from tessera.session import ship_package

MAX_ITER = 2000
TOLERANCE = 1e-9
LOSSES = ("squared_hinge", "logistic", "softmax")


@dataclass
class Fit:
    """A group's coefficients: one row per output, the intercept last."""

    coef: np.ndarray
    iterations: int
    converged: bool
    loss: float


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def with_intercept(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.ones((len(x), 1))])


def _sums(loss: str, x: np.ndarray, y: np.ndarray, weight: np.ndarray, coef: np.ndarray) -> np.ndarray:
    """(losses, gradients, Hessians) of some rows as one flat array.

    ``y`` has a column per output: +1 / -1 for the hinge, 0 / 1 otherwise."""
    score = x @ coef.T
    outputs, d = coef.shape
    if loss == "squared_hinge":
        gap = np.maximum(0.0, 1.0 - y * score)
        value = weight @ (gap * gap)
        gradient = (-2.0 * weight[:, None] * gap * y).T @ x
        curve = 2.0 * weight[:, None] * (gap > 0)
    elif loss == "logistic":
        chance = 0.5 * (1.0 + np.tanh(0.5 * score))
        value = weight @ (np.logaddexp(0.0, score) - y * score)
        gradient = (weight[:, None] * (chance - y)).T @ x
        curve = weight[:, None] * chance * (1.0 - chance)
    else:
        top = score.max(axis=1, keepdims=True)
        logs = top[:, 0] + np.log(np.exp(score - top).sum(axis=1))
        chance = np.exp(score - logs[:, None])
        value = np.array([weight @ (logs - (y * score).sum(axis=1))])
        gradient = (weight[:, None] * (chance - y)).T @ x
        hessian = np.empty((outputs, d, outputs, d))
        for k in range(outputs):
            for m in range(k, outputs):
                bend = weight * chance[:, k] * ((k == m) - chance[:, m])
                hessian[k, :, m, :] = hessian[m, :, k, :] = x.T @ (x * bend[:, None])
        return np.concatenate([value, gradient.ravel(), hessian.ravel()])
    hessian = np.stack([x.T @ (x * curve[:, k:k + 1]) for k in range(outputs)])
    return np.concatenate([value, gradient.ravel(), hessian.ravel()])


def _unpack(loss: str, flat: np.ndarray, outputs: int, d: int):
    n = 1 if loss == "softmax" else outputs
    size = outputs * d
    return flat[:n], flat[n:n + size].reshape(outputs, d), flat[n + size:].reshape(
        (size, size) if loss == "softmax" else (outputs, d, d))


def _pass(rows: DataFrame, loss: str, coefs: dict) -> dict:
    """Sums of all rows at the given coefficients, per group."""
    held = rows.sparkSession.sparkContext.broadcast(coefs)  # of the models' size

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for batch in batches:
            group = batch.column("group").to_numpy(zero_copy_only=False)
            weight = batch.column("weight").to_numpy(zero_copy_only=False)
            for g in np.unique(group).tolist():
                if g in held.value:
                    own = group == g
                    x, y = (matrix(batch.column(c).filter(pa.array(own))) for c in ("x", "y"))
                    found = _sums(loss, with_intercept(x), y, weight[own], held.value[g])
                    total[g] = total[g] + found if g in total else found
        if total:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.list_(pa.float64()))],
                ["group", "sums"])

    parts = rows.mapInArrow(summed, "group long, sums array<double>")
    out = parts.groupBy("group").agg(Summarizer.metrics("sum").summary(array_to_vector("sums")).alias("s")).select(
        "group", vector_to_array("s.sum").alias("sums")).collect()
    held.destroy()
    return {r["group"]: np.array(r["sums"]) for r in out}


def _step(loss: str, gradient: np.ndarray, hessian: np.ndarray) -> np.ndarray:
    if loss == "softmax":
        # all intercepts may move together, so the system has no full rank
        return np.linalg.lstsq(hessian, gradient.ravel(), rcond=1e-12)[0].reshape(gradient.shape)
    return np.stack([np.linalg.lstsq(h, g, rcond=1e-12)[0] for h, g in zip(hessian, gradient)])


def fit(rows: DataFrame, loss: str, outputs: dict[int, tuple[int, int]], *, strength: float = 1.0,
        max_iter: int = MAX_ITER, tolerance: float = TOLERANCE) -> dict[int, Fit]:
    """Fit all groups.  ``rows``: group (long), x and y (array<double>) and
    weight (double), cached for the fit; ``outputs``: columns of y and
    features per group.

    Outputs of one group are separate problems unless the loss is ``softmax``."""
    if loss not in LOSSES:
        raise ValueError(f"loss {loss!r} is none of {LOSSES}")
    ship_package(rows.sparkSession)
    # every pass reads the rows again: as many tasks as cores, columns computed once
    rows = rows.coalesce(rows.sparkSession.sparkContext.defaultParallelism).cache()
    try:
        return _newton(rows, loss, outputs, strength, max_iter, tolerance)
    finally:
        rows.unpersist()


def _newton(rows: DataFrame, loss: str, outputs: dict[int, tuple[int, int]], strength: float, max_iter: int,
            tolerance: float) -> dict[int, Fit]:
    free = loss != "squared_hinge"
    here = {g: np.zeros((k, d + 1)) for g, (k, d) in outputs.items()}
    # per output: the last accepted loss, the step to it and its damping
    state = {g: {"coef": c, "loss": None, "step": np.zeros_like(c), "scale": np.ones(1 if loss == "softmax" else len(c)),
                 "slope": None, "done": np.zeros(1 if loss == "softmax" else len(c), dtype=bool)} for g, c in here.items()}
    fits: dict[int, Fit] = {}
    for iteration in range(1, max_iter + 1):
        sums = _pass(rows, loss, here)
        for g in list(here):
            s = state[g]
            at = here[g]
            if g not in sums:  # no row at all: nothing but the penalty
                fits[g] = Fit(np.zeros_like(at), iteration, True, 0.0)
                del here[g]
                continue
            penalty = np.ones(at.shape[1])
            penalty[-1] = 0.0 if free else 1.0
            value, gradient, hessian = _unpack(loss, sums[g], *at.shape)
            value = strength * value + 0.5 * (
                (at * at * penalty).sum(keepdims=True).ravel() if loss == "softmax" else (at * at * penalty).sum(axis=1))
            gradient = strength * gradient + at * penalty
            if loss == "softmax":
                hessian = strength * hessian + np.diag(np.tile(penalty, len(at)))
            else:
                hessian = strength * hessian + np.diag(penalty)
            fell = np.ones(len(value), dtype=bool) if s["loss"] is None else (
                (value <= s["loss"] + 1e-4 * s["scale"] * s["slope"] + 1e-12 * np.abs(s["loss"])) | s["done"])
            size = np.abs(gradient).max(axis=1) if loss != "softmax" else np.abs(gradient).max(keepdims=True).ravel()
            flat = size <= tolerance * np.maximum(1.0, np.abs(value))
            step = -_step(loss, gradient, hessian)
            slope = (step * gradient).sum(axis=1) if loss != "softmax" else (step * gradient).sum(keepdims=True).ravel()
            # accept where the loss fell, else try half the step from the last accepted point
            take = fell if loss != "softmax" else np.repeat(fell, len(at))
            s["coef"] = np.where(take[:, None], at, s["coef"])
            s["step"] = np.where(take[:, None], step, s["step"])
            s["slope"] = slope if s["slope"] is None else np.where(fell, slope, s["slope"])
            s["loss"] = value if s["loss"] is None else np.where(fell, value, s["loss"])
            s["scale"] = np.where(fell, 1.0, s["scale"] / 2)
            s["done"] = s["done"] | (fell & flat) | (s["scale"] < 1e-10)
            if s["done"].all():
                fits[g] = Fit(s["coef"], iteration, bool((s["scale"] >= 1e-10).all()), float(s["loss"].sum()))
                del here[g]
                continue
            scale = np.where(s["done"], 0.0, s["scale"])
            scale = scale if loss != "softmax" else np.repeat(scale, len(at))
            here[g] = s["coef"] + scale[:, None] * s["step"]
        if not here:
            return fits
    for g in here:
        fits[g] = Fit(state[g]["coef"], max_iter, False, float(state[g]["loss"].sum()))
    return fits


def scores(rows: DataFrame, fits: dict[int, Fit], *keep: str) -> DataFrame:
    """Decision values (array<double>, one per output) of rows with group and
    x; ``keep`` are columns that stay."""
    ship_package(rows.sparkSession)
    held = rows.sparkSession.sparkContext.broadcast({g: f.coef for g, f in fits.items()})  # of the models' size
    slim = rows.select("group", *keep, "x")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group = batch.column("group").to_numpy(zero_copy_only=False)
            out = [None] * len(group)
            for g in np.unique(group).tolist():
                if g in held.value:
                    own = group == g
                    x = with_intercept(matrix(batch.column("x").filter(pa.array(own))))
                    for i, row in zip(np.flatnonzero(own).tolist(), x @ held.value[g].T):
                        out[i] = row
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("group", *keep)], pa.array(out, pa.list_(pa.float64()))],
                ["group", *keep, "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema if f.name != "x")
    return slim.mapInArrow(scored, kinds + ", score array<double>")
