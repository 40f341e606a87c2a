"""Learned partitions of a vector space: a balanced cut of a neighbour graph, and a router.

From a bounded sample, the nearest-neighbour graph is cut into equally large parts that few
edges cross, and a small network learns to name the part of a vector. Everything here is numpy
on that sample; the whole table is only ever routed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

NEIGHBOURS = 10
HIDDEN = 128


def neighbour_graph(vectors: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
    """Indices of each vector's ``k`` nearest others by inner product, in blocks of rows."""
    n = len(vectors)
    k = min(k, n - 1)
    out = np.empty((n, k), dtype=np.int64)
    single = vectors.astype(np.float32)
    for begin in range(0, n, 1024):
        near = single[begin:begin + 1024] @ single.T
        near[np.arange(len(near)), begin + np.arange(len(near))] = -np.inf
        out[begin:begin + 1024] = np.argpartition(-near, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(graph: np.ndarray, n_parts: int, rng: np.random.Generator,
                   rounds: int = 40) -> np.ndarray:
    """Part of each node; sizes differ by one at most where ``n_parts`` is a power of two.

    A set of nodes is halved at the median of a smooth function on the graph: a random vector
    averaged over neighbours again and again, which flattens it within tight groups first.
    """
    n = len(graph)
    part = np.zeros(n, dtype=np.int64)
    source = np.repeat(np.arange(n), graph.shape[1])
    target = graph.ravel()
    for _ in range(int(np.log2(n_parts))):
        inside = part[source] == part[target]
        a, b = source[inside], target[inside]
        degree = np.bincount(a, minlength=n) + np.bincount(b, minlength=n) + 1.0
        x = rng.standard_normal(n)
        size = np.bincount(part)
        for _ in range(rounds):
            x = (x + np.bincount(a, x[b], n) + np.bincount(b, x[a], n)) / degree
            x -= (np.bincount(part, x) / size)[part]
            x /= np.sqrt(np.bincount(part, x * x) / size)[part] + 1e-12
        order = np.lexsort((np.arange(n), x, part))
        place = np.empty(n, dtype=np.int64)
        place[order] = np.arange(n) - (np.cumsum(size) - size)[part[order]]
        part = 2 * part + (place >= size[part] / 2)
    return part


@dataclass
class Router:
    """A network with one hidden layer that names the most probable parts of vectors."""

    scale: float
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    @property
    def n_parts(self) -> int:
        return len(self.b2)

    def logits(self, vectors: np.ndarray) -> np.ndarray:
        hidden = np.maximum(vectors / self.scale @ self.w1 + self.b1, 0)
        return hidden @ self.w2 + self.b2

    def top(self, vectors: np.ndarray, probes: int) -> np.ndarray:
        """The ``probes`` most probable parts of each vector, most probable first."""
        return np.argsort(-self.logits(vectors), axis=1, kind="stable")[:, :probes]


def train_router(vectors: np.ndarray, part: np.ndarray, n_parts: int, rng: np.random.Generator,
                 hidden: int = HIDDEN, epochs: int = 30, batch: int = 256, rate: float = 3e-3) -> Router:
    """Cross-entropy by Adam in small batches."""
    dim = vectors.shape[1]
    scale = float(np.sqrt((vectors ** 2).mean())) or 1.0
    weights = [rng.standard_normal((dim, hidden)) * np.sqrt(2 / dim), np.zeros(hidden),
               rng.standard_normal((hidden, n_parts)) * np.sqrt(1 / hidden), np.zeros(n_parts)]
    first = [np.zeros_like(w) for w in weights]
    second = [np.zeros_like(w) for w in weights]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(vectors))
        for begin in range(0, len(order), batch):
            rows = order[begin:begin + batch]
            x = vectors[rows] / scale
            h = np.maximum(x @ weights[0] + weights[1], 0)
            z = h @ weights[2] + weights[3]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), part[rows]] -= 1
            p /= len(rows)
            back = (p @ weights[2].T) * (h > 0)
            step += 1
            pace = rate * (1 - epoch / epochs) * np.sqrt(1 - 0.999 ** step) / (1 - 0.9 ** step)
            for i, g in enumerate((x.T @ back, back.sum(0), h.T @ p, p.sum(0))):
                first[i] += 0.1 * (g - first[i])
                second[i] += 0.001 * (g * g - second[i])
                weights[i] -= pace * first[i] / (np.sqrt(second[i]) + 1e-8)
    return Router(scale, *weights)


def learn(vectors: np.ndarray, n_parts: int, seed: int = 5) -> Router:
    """A router for ``n_parts`` (a power of two) learned from a sample."""
    rng = np.random.default_rng(seed)
    if n_parts <= 1:
        dim = vectors.shape[1] if vectors.ndim == 2 else 1
        return Router(1.0, np.zeros((dim, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))
    part = balanced_parts(neighbour_graph(vectors), n_parts, rng)
    return train_router(vectors, part, n_parts, rng)
