"""Linear models fitted with numpy on bounded samples, and the byte-gram features that they read."""

from __future__ import annotations

import numpy as np

from tidemark.llm.shingles import LOWER

#: Byte pairs and triples go to this many hashed places each.
PAIRS, TRIPLES = 1024, 4096
# ASCII bytes other than letters read as spaces; other bytes stay.
LETTERS = np.where((LOWER >= 97) & (LOWER <= 122) | (LOWER >= 128), LOWER, 32).astype(np.uint32)


def gram_features(data: np.ndarray, offsets: np.ndarray, pairs: int = PAIRS, triples: int = TRIPLES) -> np.ndarray:
    """Rows of square-rooted shares of hashed byte pairs and triples of every whole text, of length one."""
    x = LETTERS[data]
    two = x[:-1] * np.uint32(0x9E3779B1) + x[1:] * np.uint32(0x85EBCA77)
    three = two[:-1] * np.uint32(0xC2B2AE3D) + x[2:] * np.uint32(0x27D4EB2F)
    two, three = (two >> np.uint32(12)) % np.uint32(pairs), (three >> np.uint32(12)) % np.uint32(triples)
    out = np.zeros((len(offsets) - 1, pairs + triples), np.float32)
    for n, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        if b - a >= 2:
            out[n, :pairs] = np.bincount(two[a : b - 1], minlength=pairs)
            out[n, pairs:] = np.bincount(three[a : max(a, b - 2)], minlength=triples)
    np.sqrt(out, out=out)
    size = np.sqrt((out * out).sum(1, keepdims=True))
    return out / np.maximum(size, 1e-9)


def descend(x: np.ndarray, slope, weights: np.ndarray, ridge: float, steps: int) -> np.ndarray:
    """Accelerated gradient descent for a linear model with a bias as its last weight. slope(scores) is the loss's
    derivative for each row, with a second derivative of at most 2."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float32)
    share = (weights / weights.sum()).astype(np.float32)
    step = np.float32(1 / (2 * float((share * (x * x).sum(1)).sum()) + ridge))
    w = ahead = np.zeros(x.shape[1], np.float32)
    t = 1.0
    for _ in range(steps):
        down = x.T @ (share * slope(x @ ahead).astype(np.float32))
        down[:-1] += np.float32(ridge) * ahead[:-1]
        new = ahead - step * down
        t, was = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        ahead = new + np.float32((was - 1) / t) * (new - w)
        w = new
    return w


def balanced(y: np.ndarray) -> np.ndarray:
    return np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum()))


def svm(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4, steps: int = 200) -> np.ndarray:
    """A linear support vector machine with squared hinge loss; y is 1 or -1, both classes weigh the same."""
    return descend(x, lambda s: -2 * y * np.maximum(0, 1 - y * s), balanced(y), ridge, steps)


def logistic(x: np.ndarray, y: np.ndarray, weights: np.ndarray | None = None, ridge: float = 1e-3, steps: int = 300) -> np.ndarray:
    """Logistic regression; y is 0 or 1."""
    return descend(x, lambda s: sigmoid(s) - y, np.ones(len(y)) if weights is None else weights, ridge, steps)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def score(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]
