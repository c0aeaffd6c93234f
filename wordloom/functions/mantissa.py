"""Models of mantissas from what stands before them in a row: boosted trees, a small network, bit contexts.

Each model gives, for the places of all rows at a time, probabilities of the seven bits of a mantissa (highest first)
from a feature matrix; so one lockstep coder serves all. Features are causal: exponent, sign, the mantissa before and
the one before that.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

WIDTH = 7
#: Trees for each bit, bins of a feature, share of each tree's step.
TREES, BINS, RATE = 16, 32, 0.25


def features(sign: np.ndarray, exponent: np.ndarray, before: np.ndarray, earlier: np.ndarray) -> np.ndarray:
    """Four features of BINS bins at most."""
    return np.stack([exponent >> 3, sign, before >> 2, earlier >> 2], axis=-1).astype(np.int64)


def shifted(mantissas: np.ndarray, by: int) -> np.ndarray:
    """Mantissas of a row `by` places before; 0 where there are none."""
    out = np.zeros_like(mantissas)
    out[:, by:] = mantissas[:, :-by]
    return out


def row_features(words: np.ndarray) -> np.ndarray:
    m = words & 127
    return features(words >> 15, words >> 7 & 255, shifted(m, 1), shifted(m, 2))


def bits_of(mantissas: np.ndarray) -> np.ndarray:
    return mantissas[..., None] >> np.arange(WIDTH - 1, -1, -1) & 1


@dataclass
class Trees:
    """For each bit, trees of depth two: (feature, cut) at the root and below, and four leaves."""

    base: np.ndarray = field(default_factory=lambda: np.zeros(WIDTH))
    trees: list[list[tuple]] = field(default_factory=list)

    @staticmethod
    def _cut(x: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, int]:
        """The feature and cut with the largest gain of squared gradients over curvature."""
        best = (-np.inf, 0, 1)
        for f in range(x.shape[1]):
            gs, hs = (np.cumsum(np.bincount(x[:, f], w, BINS)) for w in (g, h))
            gain = gs**2 / (hs + 1e-6) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + 1e-6)
            k = int(gain[:-1].argmax())
            best = max(best, (float(gain[k]), -f, k + 1))
        return -best[1], best[2]

    @staticmethod
    def _leaves(tree: tuple, x: np.ndarray) -> np.ndarray:
        (f, c), (fa, ca), (fb, cb), _ = tree
        low = x[:, f] < c
        return np.where(low, np.where(x[:, fa] < ca, 0, 1), np.where(x[:, fb] < cb, 2, 3))

    @classmethod
    def fitted(cls, x: np.ndarray, mantissas: np.ndarray) -> Trees:
        out, y_all = cls(), bits_of(mantissas)
        for bit in range(WIDTH):
            y = y_all[:, bit]
            share = np.clip(y.mean(), 1e-4, 1 - 1e-4)
            out.base[bit] = np.log(share / (1 - share))
            score, grown = np.full(len(y), out.base[bit]), []
            for _ in range(TREES):
                p = 1 / (1 + np.exp(-score))
                g, h = p - y, np.maximum(p * (1 - p), 1e-6)
                root = cls._cut(x, g, h)
                low = x[:, root[0]] < root[1]
                below = [cls._cut(x[s], g[s], h[s]) if s.any() else (0, 1) for s in (low, ~low)]
                tree = (root, *below, None)
                leaf = cls._leaves(tree, x)
                values = -np.bincount(leaf, g, 4) / (np.bincount(leaf, h, 4) + 1e-6)
                grown.append((*tree[:3], values))
                score = score + RATE * values[leaf]
            out.trees.append(grown)
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """x (places x features) to probabilities of a one (places x bits)."""
        out = np.zeros((len(x), WIDTH))
        for bit, grown in enumerate(self.trees):
            score = np.full(len(x), self.base[bit])
            for tree in grown:
                score += RATE * tree[3][self._leaves(tree, x)]
            out[:, bit] = 1 / (1 + np.exp(-score))
        return out


@dataclass
class Network:
    """One hidden layer of rectifiers and a softmax over the 128 mantissas; bits follow from sums of it, so that a bit
    knows those above it."""

    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: np.ndarray

    @staticmethod
    def _scaled(x: np.ndarray) -> np.ndarray:
        return x / np.array([31.0, 1.0, 31.0, 31.0])

    @classmethod
    def fitted(cls, x: np.ndarray, mantissas: np.ndarray, hidden: int = 32, passes: int = 6, batch: int = 4096, rate: float = 0.05, seed: int = 0) -> Network:
        rng = np.random.default_rng(seed)
        own = cls(rng.normal(0, 0.1, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 0.05, (hidden, 128)), np.zeros(128))
        inputs = cls._scaled(x)
        for _ in range(passes):
            order = rng.permutation(len(inputs))
            for i in range(0, len(order), batch):
                at = order[i : i + batch]
                layer = np.maximum(inputs[at] @ own.first + own.first_bias, 0)
                error = own._softmax(layer)
                error[np.arange(len(at)), mantissas[at]] -= 1
                error /= len(at)
                back = (error @ own.second.T) * (layer > 0)
                own.second -= rate * layer.T @ error
                own.second_bias -= rate * error.sum(axis=0)
                own.first -= rate * inputs[at].T @ back
                own.first_bias -= rate * back.sum(axis=0)
        return own

    def _softmax(self, layer: np.ndarray) -> np.ndarray:
        z = layer @ self.second + self.second_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def classes(self, x: np.ndarray) -> np.ndarray:
        return self._softmax(np.maximum(self._scaled(x) @ self.first + self.first_bias, 0))


def bit_given_prefix(classes: np.ndarray, bit: int, prefix: np.ndarray) -> np.ndarray:
    """Of probabilities of mantissas (places x 128): that of a one at `bit`, given the bits above it as a number."""
    tree = classes.reshape(len(classes), 1 << bit, 2, -1).sum(axis=3)[np.arange(len(classes)), prefix]
    return tree[:, 1] / np.maximum(tree.sum(axis=1), 1e-300)


@dataclass
class Contexts:
    """Counts of each bit by the same bit of the `depth` mantissas before it, half a count more for each value."""

    depth: int
    ones: np.ndarray
    all: np.ndarray

    @staticmethod
    def _context(mantissas: np.ndarray, depth: int) -> np.ndarray:
        """rows x places x bits: the same bit of the places before, as a number."""
        out = np.zeros((*mantissas.shape, WIDTH), np.int64)
        for by in range(1, depth + 1):
            out = out | bits_of(shifted(mantissas, by)) << (by - 1)
        return out

    @classmethod
    def fitted(cls, rows: np.ndarray, depth: int = 2) -> Contexts:
        context, bits = cls._context(rows, depth), bits_of(rows)
        shape = (WIDTH, 1 << depth)
        key = (np.arange(WIDTH) << depth) + context
        return cls(depth, np.bincount(key.reshape(-1), bits.reshape(-1), WIDTH << depth).reshape(shape), np.bincount(key.reshape(-1), minlength=WIDTH << depth).reshape(shape))

    def probabilities(self, context: np.ndarray) -> np.ndarray:
        bit = np.arange(WIDTH)
        return (self.ones[bit, context] + 0.5) / (self.all[bit, context] + 1)


def couplings(rows: np.ndarray, layers: int = 3) -> list[np.ndarray]:
    """Tables that move one of a pair of columns back by the commonest partner of the other, in turns."""
    out, work = [], rows.copy()
    for layer in range(layers):
        source, target = (work[:, 0:-1:2], work[:, 1::2]) if layer % 2 == 0 else (work[:, 1::2], work[:, 0:-1:2])
        counts = np.bincount((source * 128 + target).reshape(-1), minlength=128 * 128).reshape(128, 128)
        table = np.where(counts.sum(axis=1) > 0, -counts.argmax(axis=1) & 127, 0)
        out.append(table)
        target[:] = (target + table[source]) & 127
    return out


def coupled(rows: np.ndarray, tables: list[np.ndarray], back: bool = False) -> np.ndarray:
    work = rows.copy()
    for layer, table in reversed(list(enumerate(tables))) if back else enumerate(tables):
        source, target = (work[:, 0:-1:2], work[:, 1::2]) if layer % 2 == 0 else (work[:, 1::2], work[:, 0:-1:2])
        target[:] = (target + (-table[source] if back else table[source])) & 127
    return work
