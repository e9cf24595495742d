"""Small linear models trained with numpy on bounded samples."""

from __future__ import annotations

import numpy as np


def sigmoid(x):  # stays in the type of ``x``: matrices of samples are 32-bit
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def _descend(x: np.ndarray, grad, rounds: int):
    """Accelerated gradient descent for ``grad(weights, bias) -> (gw, gb)`` with a fixed step."""
    w, b = np.zeros(x.shape[1], x.dtype), 0.0
    vw, vb = w.copy(), b
    step = x.dtype.type(1.0 / max(1e-9, _largest(x)))
    for k in range(rounds):
        gw, gb = grad(vw, vb)
        nw, nb = vw - step * gw, vb - step * gb
        m = x.dtype.type(k / (k + 3.0))
        vw, vb = nw + m * (nw - w), nb + m * (nb - b)
        w, b = nw, nb
    return w, b


def _largest(x: np.ndarray) -> float:
    """An estimate of the largest eigenvalue of the mean of outer products, with the bias."""
    if not x.shape[1]:
        return 1.1
    v = np.full(x.shape[1], x.shape[1] ** -0.5, x.dtype)
    u = 1.0
    value = 1.0
    for _ in range(20):
        p = x @ v + u
        v, u = x.T @ p / len(x), float(p.mean())
        value = float(np.sqrt(v @ v + u * u))
        v, u = v / value, u / value
    return 1.1 * value


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-4, rounds: int = 300, balanced: bool = False):
    """Weights and bias of a logistic regression on 0/1 labels."""
    # In columns of mean 0 and variance 1, rare features are learned as fast as common ones.
    mean = x.mean(axis=0)
    scale = 1.0 / np.sqrt(np.maximum(x.var(axis=0), x.dtype.type(1e-6)))
    x = (x - mean) * scale
    c = np.where(y > 0, 0.5 / max(1e-9, y.mean()), 0.5 / max(1e-9, 1 - y.mean())) if balanced else np.ones(len(y))

    def grad(w, b):
        r = (c * (sigmoid(x @ w + b) - y) / len(y)).astype(x.dtype)
        return x.T @ r + x.dtype.type(l2) * w, float(r.sum())

    w, b = _descend(x, grad, rounds)
    w = w * scale
    return w, float(b - mean @ w)


def svm(x: np.ndarray, y: np.ndarray, l2: float = 1e-4, rounds: int = 300):
    """Weights and bias of a linear support vector machine (squared hinge) on -1/1 labels."""

    def grad(w, b):
        short = np.maximum(0.0, 1.0 - y * (x @ w + b))
        r = (-y * short / len(y)).astype(x.dtype)
        return x.T @ r + x.dtype.type(l2) * w, float(r.sum())

    return _descend(x, grad, rounds)
