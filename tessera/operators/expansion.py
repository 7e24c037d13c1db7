"""Sums over all pairs of points in a cube by expansions: cells of a grid, halved level by level, stand for their points by masses at Chebyshev nodes wherever two cells of a level aren't neighbours.

Cells of the last level that are neighbours are left to the caller, pair by pair. Kernels are functions of the difference vector, in units of a cell's width.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

import numpy as np


def nodes(order: int) -> np.ndarray:
    """Chebyshev nodes within a cell, from -0.5 to 0.5."""
    return 0.5 * np.cos((2 * np.arange(order) + 1) * np.pi / (2 * order))


def basis(x: np.ndarray, order: int) -> np.ndarray:
    """The value at each x (in -0.5 to 0.5) of the polynomial that is 1 at a node and 0 at the others, for each node."""
    t = lambda y: np.cos(np.arange(order) * np.arccos(np.clip(2 * y, -1, 1))[:, None])
    weight = np.full(order, 2.0 / order)
    weight[0] = 1.0 / order
    return (t(x) * weight) @ t(nodes(order)).T


def products(x: np.ndarray, order: int) -> np.ndarray:
    """basis() of points (n, dims) for all nodes of a cell: n x order^dims."""
    return reduce(lambda a, b: (a[:, :, None] * b[:, None]).reshape(len(x), -1), [basis(x[:, i], order) for i in range(x.shape[1])])


def child(order: int) -> np.ndarray:
    """For either half of a cell: the parent's basis at the half's nodes."""
    return np.stack([basis(nodes(order) / 2 + s, order) for s in (-0.25, 0.25)])


def upward(masses: np.ndarray, levels: int, dims: int, order: int) -> list[np.ndarray]:
    """masses: cells of the last level (in the order of their coordinates) x order^dims. The same for levels 0 to the last."""
    c, out = child(order), [masses]
    for level in range(levels, 0, -1):
        m = 1 << (level - 1)
        a = out[0].reshape([m, 2] * dims + [order] * dims)
        for i in range(dims):  # the halves and the nodes of one dimension become the parent's nodes, put last
            a = np.tensordot(a, c, axes=([i + 1, 2 * dims - i], [0, 1]))
        out.insert(0, a.reshape(m**dims, order**dims))
    return out


def offsets(dims: int) -> list[tuple[int, ...]]:
    """What may lie between two cells that aren't neighbours, but whose parents are."""
    return [o for o in product(range(-3, 4), repeat=dims) if max(map(abs, o)) > 1]


def number(cells: np.ndarray, level: int) -> np.ndarray:
    return reduce(lambda a, b: (a << level) + b, [cells[:, i] for i in range(cells.shape[1])])


def downward(masses: list[np.ndarray], tops: np.ndarray, kernel, parts: int, unit, dims: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the last level under the cells `tops` of level 2, and each one's values (parts x order^dims) at its nodes by all that isn't next to it.

    kernel(differences, each of them nodes x nodes): `parts` matrices. unit(level): what they are to be multiplied by there, and what to add to the first for each mass.
    """
    levels, size, x = len(masses) - 1, order**dims, nodes(order)
    grid = np.stack([g.ravel() for g in np.meshgrid(*[x] * dims, indexing="ij")])
    at = {2: tops}
    for level in range(3, levels + 1):
        at[level] = np.concatenate([2 * at[level - 1] + np.array(s) for s in product((0, 1), repeat=dims)])
    got = {level: np.zeros((len(cells), parts, size)) for level, cells in at.items()}
    for o in offsets(dims):
        k = np.concatenate(kernel([grid[i][None] - grid[i][:, None] - o[i] for i in range(dims)]), 1)  # of mass nodes, by value nodes
        for level, cells in at.items():
            from_ = cells + np.array(o)
            low, high = 2 * (cells // 2 - 1), 2 * (cells // 2 + 1) + 1
            ok = ((from_ >= np.maximum(low, 0)) & (from_ <= np.minimum(high, (1 << level) - 1))).all(1)
            if ok.any():
                m = masses[level][number(from_[ok], level)]
                by, plus = unit(level)
                got[level][ok] += (m @ k).reshape(-1, parts, size) * by
                if plus:  # of energy, the first part
                    got[level][ok, 0] += (plus * m.sum(1))[:, None]
    c = child(order)
    for level in range(3, levels + 1):
        n = len(at[level - 1])
        for j, s in enumerate(product((0, 1), repeat=dims)):
            down = reduce(np.kron, [c[h] for h in s])  # the child's nodes by the parent's
            got[level][j * n : (j + 1) * n] += got[level - 1] @ down.T
    return at[levels], got[levels]
