"""Semirings on Python values, for machines that are walked within a task.

Single precision weights are rounded after each product, as the Column builders do."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

INF = float("inf")


@dataclass(frozen=True)
class Scalar:
    zero: object
    one: object
    plus: Callable
    times: Callable
    idempotent: bool = True
    #: A key whose ascending order is best first; None without a natural order.
    order: Callable | None = None
    #: What is left of a weight behind another (null where it has no answer); None without division.
    divide: Callable | None = None
    #: Whether a residual that changed a sum from old (None: there was none) to new goes on.
    moves: Callable = lambda old, new, residual, delta: old is None or new != old


def _single(x: float) -> float:
    return float(np.float32(x))


def _log_plus(a: float, b: float) -> float:
    low, high = min(a, b), max(a, b)
    return low if high == INF else low - math.log1p(math.exp(low - high))


def _sum() -> Scalar:
    return Scalar(0.0, 1.0, lambda a, b: a + b, lambda a, b: a * b, False, divide=lambda a, b: a / b if b else None, moves=lambda old, new, residual, delta: abs(residual) > delta)


SCALARS = {
    "tropical": Scalar(INF, 0.0, min, lambda a, b: _single(a + b), order=lambda a: a, divide=lambda a, b: INF if a == INF else _single(a - b)),
    "log": Scalar(INF, 0.0, _log_plus, lambda a, b: a + b, False, divide=lambda a, b: INF if a == INF else a - b, moves=lambda old, new, residual, delta: old is None or abs(new - old) > delta),
    "probability": _sum(),
    "real": _sum(),
    "integer": Scalar(0, 1, lambda a, b: a + b, lambda a, b: a * b, False, moves=lambda old, new, residual, delta: residual != 0),
    "boolean": Scalar(False, True, lambda a, b: a or b, lambda a, b: a and b, order=lambda a: not a),
    "min": Scalar(INF, -INF, min, max, order=lambda a: a),
    "max": Scalar(-INF, INF, max, min, order=lambda a: -a),
}
