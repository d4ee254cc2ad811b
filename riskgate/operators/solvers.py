"""Solvers for the probes in few passes over a distributed training set.

A pass is one Spark job: each task adds up what its rows contribute (a loss, a gradient,
a d x d matrix), as matrix products over Arrow batches, and the small sums are combined
in a tree of FAN_IN. The driver holds weights and sums only, never rows.

Logistic probes need one pass per Newton step: loss, gradient and Hessian at the present
weights. Without the L1 penalty the step solves a linear system; with it, coordinate
descent minimises the same quadratic model plus the penalty. A step that does not
decrease the objective enough is halved. All probes of a fit share their passes. The
Hessian makes a pass cost d * d numbers per task, which suits up to about a thousand
dimensions.

The ReLU network is fitted by L-BFGS on the full gradient, one pass per trial point, with
early stopping on held-out rows, whose figures come from the same passes.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAN_IN = 32
ARMIJO = 1e-4
LBFGS_MEMORY = 10
Layers = Sequence[tuple[np.ndarray, np.ndarray]]


# -- passes -------------------------------------------------------------------------

def summed(rows: DataFrame, vec: str, columns: Sequence[str], work: Callable[..., np.ndarray]) -> np.ndarray:
    """The sum over all rows of ``work(x, *columns)``, which gets a batch as a matrix and
    vectors of doubles and returns a vector of fixed length. Without rows, ``work`` of
    an empty batch decides the length."""
    names = list(columns)

    def run(batches):
        import pyarrow as pa

        total = None
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                more = work(x, *[batch.column(1 + k).to_numpy(zero_copy_only=False) for k in range(len(names))])
                total = more if total is None else total + more
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    def combine(batches):
        import pyarrow as pa

        total = None
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                more = np.frombuffer(raw)
                total = more if total is None else total + more
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    cast = [F.col(vec).cast("array<double>"), *[F.col(c).cast("double").alias(f"_c{k}") for k, c in enumerate(names)]]
    sums = rows.select(*cast).mapInArrow(run, "sums binary")
    parts = rows.rdd.getNumPartitions()
    while parts > FAN_IN:
        parts = -(-parts // FAN_IN)
        sums = sums.repartition(parts).mapInArrow(combine, "sums binary")
    found = [np.frombuffer(r[0]) for r in sums.collect()]
    if not found:
        return work(np.empty((0, 0)), *[np.empty(0) for _ in names])
    return np.sum(found, axis=0)


# -- logistic probes -----------------------------------------------------------------

@dataclass
class Logistic:
    """One probe: minimises the mean log loss of ``label`` plus ``penalty`` times half the
    squared weights, or their absolute sum with ``l1``; the intercept is not penalised.
    ``theta`` holds the weights, then the intercept; ``objective`` its history."""
    label: str
    penalty: float
    l1: bool
    theta: np.ndarray = field(default_factory=lambda: np.empty(0))
    objective: list[float] = field(default_factory=list)
    residual: float = np.inf

    @property
    def weights(self) -> np.ndarray:
        return self.theta[:-1]

    @property
    def intercept(self) -> float:
        return float(self.theta[-1])

    def cost(self, theta: np.ndarray) -> float:
        w = theta[:-1]
        return self.penalty * (np.abs(w).sum() if self.l1 else w @ w / 2)


def optimality(probe: Logistic, theta: np.ndarray, g: np.ndarray) -> np.ndarray:
    """How far each coordinate is from the condition of a minimum, with ``g`` the gradient
    of the mean loss."""
    r = np.append(np.full(len(theta) - 1, probe.penalty), 0.0)
    if not probe.l1:
        return np.abs(g + r * theta)
    return np.where((theta != 0) | (r == 0), np.abs(g + r * np.sign(theta)), np.maximum(0.0, np.abs(g) - r))


def logistic_sums(x: np.ndarray, y: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """(sum of losses, gradient, Hessian) of some rows, as one vector."""
    a = np.hstack([x.reshape(len(y), len(theta) - 1), np.ones((len(y), 1))])
    z = a @ theta
    p = 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700)))
    loss = np.logaddexp(0.0, z) - y * z
    return np.concatenate([[loss.sum()], a.T @ (p - y), ((a * (p * (1 - p))[:, None]).T @ a).ravel()])


def _newton_step(probe: Logistic, theta: np.ndarray, g: np.ndarray, hessian: np.ndarray) -> np.ndarray:
    d = len(theta)
    h = hessian + 1e-12 * np.eye(d)
    r = np.append(np.full(d - 1, probe.penalty), 0.0)
    if not probe.l1:
        return -np.linalg.solve(h + np.diag(r), g + r * theta)
    new, slope = theta.copy(), g.copy()  # slope of the quadratic model at `new`
    for _ in range(1000):
        moved = 0.0
        for j in range(d):
            old = new[j]
            free = old - slope[j] / h[j, j]
            new[j] = np.sign(free) * max(0.0, abs(free) - r[j] / h[j, j])
            if new[j] != old:
                slope += h[:, j] * (new[j] - old)
                moved = max(moved, abs(new[j] - old))
        if moved < 1e-13:
            break
    return new - theta


def fit_logistic(rows: DataFrame, vec: str, probes: Sequence[Logistic], dim: int, n: int,
                 scale: tuple[np.ndarray, np.ndarray], max_passes: int = 100) -> Sequence[Logistic]:
    """Fits the probes on ``rows`` scaled by (means, stds), all in the same passes, until
    the optimality conditions hold to a ten-thousandth of the penalty (at most 1e-8)."""
    mean, std = scale
    size = 1 + (dim + 1) + (dim + 1) ** 2
    for probe in probes:
        probe.theta = np.zeros(dim + 1)
    trials = [p.theta for p in probes]
    steps: list = [None] * len(probes)  # (direction, length, expected decrease)
    open_ = list(range(len(probes)))
    for _ in range(max_passes):
        at = [(k, trials[k]) for k in open_]

        def work(x, *labels, at=at):
            x = (x.reshape(-1, dim) - mean) / std
            return np.concatenate([logistic_sums(x, labels[k], theta) for k, theta in at])

        total = summed(rows, vec, [p.label for p in probes], work) / n
        for i, (k, theta) in enumerate(at):
            probe, own = probes[k], total[i * size:(i + 1) * size]
            loss, g, hessian = own[0], own[1:dim + 2], own[dim + 2:].reshape(dim + 1, dim + 1)
            value = loss + probe.cost(theta)
            if steps[k] is not None:
                direction, length, decrease = steps[k]
                if value > probe.objective[-1] + ARMIJO * length * decrease + 1e-13 * abs(value) and length > 1e-6:
                    steps[k] = (direction, length / 2, decrease)
                    trials[k] = probe.theta + length / 2 * direction
                    continue
            probe.theta = theta
            probe.objective.append(float(value))
            probe.residual = float(optimality(probe, theta, g).max())
            if probe.residual <= min(1e-8, 1e-4 * probe.penalty):
                open_.remove(k)
                continue
            direction = _newton_step(probe, theta, g, hessian)
            decrease = float(g @ direction + probe.cost(theta + direction) - probe.cost(theta))
            steps[k] = (direction, 1.0, decrease)
            trials[k] = theta + direction
        if not open_:
            return probes
    raise RuntimeError(f"no convergence in {max_passes} passes: residuals {[probes[k].residual for k in open_]}")


# -- the ReLU network -------------------------------------------------------------------

def first_layers(sizes: Sequence[int], seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Uniform starting weights, scaled by the sizes of the layers on either side."""
    draw = np.random.default_rng(seed)
    out = []
    for a, b in zip(sizes[:-1], sizes[1:], strict=True):
        bound = np.sqrt(6.0 / (a + b))
        out.append((draw.uniform(-bound, bound, (a, b)), draw.uniform(-bound, bound, b)))
    return out


def packed(layers: Layers) -> np.ndarray:
    return np.concatenate([v for w, b in layers for v in (w.ravel(), b)])


def unpacked(theta: np.ndarray, sizes: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    for a, b in zip(sizes[:-1], sizes[1:], strict=True):
        out.append((theta[at:at + a * b].reshape(a, b), theta[at + a * b:at + a * b + b]))
        at += a * b + b
    return out


def forward(x: np.ndarray, layers: Layers) -> tuple[list[np.ndarray], np.ndarray]:
    """(input of each layer, class probabilities)."""
    inputs, h = [], x
    for k, (w, b) in enumerate(layers):
        inputs.append(h)
        h = h @ w + b
        if k < len(layers) - 1:
            h = np.maximum(h, 0.0)
    e = np.exp(h - h.max(axis=1, keepdims=True, initial=-np.inf))
    return inputs, e / e.sum(axis=1, keepdims=True)


def network_sums(x: np.ndarray, classes: np.ndarray, held: np.ndarray, theta: np.ndarray,
                 sizes: Sequence[int]) -> np.ndarray:
    """(rows, sum of losses, gradient) of the training rows, then (rows, hits, sum of
    losses) of the held-out ones, as one vector."""
    layers = unpacked(theta, sizes)
    x, classes = x.reshape(len(classes), sizes[0]), classes.astype(np.int64)
    out, row = held > 0, np.arange(len(classes))
    inputs, p = forward(x, layers)
    loss = -np.log(np.maximum(p[row, classes], 1e-300))
    delta = p.copy()
    delta[row, classes] -= 1.0
    delta[out] = 0.0
    parts = []
    for k in range(len(layers) - 1, -1, -1):
        parts.append((inputs[k].T @ delta, delta.sum(axis=0)))
        if k:
            delta = (delta @ layers[k][0].T) * (inputs[k] > 0)
    hits = p.argmax(axis=1) == classes
    return np.concatenate([[np.count_nonzero(~out), loss[~out].sum()], packed(parts[::-1]),
                           [np.count_nonzero(out), np.count_nonzero(hits & out), loss[out].sum()]])


class Point(NamedTuple):
    """Objective and gradient at some weights, and accuracy and loss on the held-out rows."""
    theta: np.ndarray
    loss: float
    gradient: np.ndarray
    held_accuracy: float | None
    held_loss: float | None


class Network:
    """The objective of a ReLU network with softmax output over ``rows`` (columns: vector,
    class, 1 for held-out rows): mean log loss plus ``l2`` / 2 of the squared weights."""

    def __init__(self, rows: DataFrame, vec: str, label: str, held: str, sizes: Sequence[int],
                 scale: tuple[np.ndarray, np.ndarray], l2: float):
        self.rows, self.vec, self.columns, self.sizes, self.scale, self.l2 = rows, vec, [label, held], list(sizes), scale, l2
        self.penalised = packed([(np.ones((a, b)), np.zeros(b)) for a, b in zip(sizes[:-1], sizes[1:], strict=True)])

    def at(self, *thetas: np.ndarray) -> list[Point]:
        """All points in one pass."""
        (mean, std), sizes, length = self.scale, self.sizes, len(self.penalised) + 5

        def work(x, classes, held):
            x = (x.reshape(-1, sizes[0]) - mean) / std
            return np.concatenate([network_sums(x, classes, held, t, sizes) for t in thetas])

        total = summed(self.rows, self.vec, self.columns, work).reshape(len(thetas), length)
        out = []
        for theta, own in zip(thetas, total, strict=True):
            n, m = max(own[0], 1.0), own[-3]
            kept = theta * self.penalised
            out.append(Point(theta, own[1] / n + self.l2 * (kept @ kept) / 2, own[2:-3] / n + self.l2 * kept,
                             own[-2] / m if m else None, own[-1] / m if m else None))
        return out


def _lbfgs_direction(g: np.ndarray, pairs: Sequence[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    q, used = g.copy(), []
    for s, y in reversed(pairs):
        a = (s @ q) / (s @ y)
        q -= a * y
        used.append(a)
    if pairs:
        s, y = pairs[-1]
        q *= (s @ y) / (y @ y)
    for (s, y), a in zip(pairs, reversed(used), strict=True):
        q += (a - (y @ q) / (s @ y)) * s
    return -q


def descend(network: Network, start: np.ndarray, steps: int):
    """Yields the start and then one accepted point per L-BFGS step; every one has a
    smaller objective than the one before. Ends early at a minimum."""
    (point,) = network.at(start)
    yield point
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        direction = _lbfgs_direction(point.gradient, pairs)
        slope = float(direction @ point.gradient)
        length = 1.0 if pairs else 1.0 / max(1.0, float(np.linalg.norm(point.gradient)))
        while True:
            (new,) = network.at(point.theta + length * direction)
            if new.loss <= point.loss + ARMIJO * length * slope and new.loss < point.loss:
                break
            length /= 2
            if length < 1e-10:
                return
        s, y = new.theta - point.theta, new.gradient - point.gradient
        if s @ y > 1e-12 * (y @ y):
            pairs = [*pairs, (s, y)][-LBFGS_MEMORY:]
        point = new
        yield point


def fit_network(network: Network, seed: int, steps_per_round: int, max_rounds: int, patience: int) -> Point:
    """The point of best held-out accuracy (then loss): it is looked at after every round
    of steps, and the fit stops after ``patience`` rounds without a gain."""
    best, stale = None, 0
    for k, point in enumerate(descend(network, packed(first_layers(network.sizes, seed)), steps_per_round * max_rounds)):
        if k == 0 or k % steps_per_round:
            last = point
            continue
        last = point
        if point.held_accuracy is None:
            best = point
        elif best is None or (point.held_accuracy, -point.held_loss) > (best.held_accuracy, -best.held_loss):
            best, stale = point, 0
        else:
            stale += 1
            if stale >= patience:
                return best
    return best or last
