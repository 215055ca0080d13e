"""Distances, regions and trees on one image or tree a row or group: sweeps by anti-diagonals, levels of a tree at a time.

The kernels are plain functions of arrays; ``images.map_images`` and ``by_tree`` apply them to tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame

#: Fixed values of the geodesic distance: farther than anything, and the order of the sweeps (down, right).
FAR, TURNS = 1e10, ((1, 1), (-1, 1), (-1, -1), (1, -1))


def _diagonals(h: int, w: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places with equal row + column: what a sweep from the corner may do at once."""
    for s in range(h + w - 1):
        i = np.arange(max(0, s - w + 1), min(h, s + 1))
        yield i, s - i


def _sweep(cost: np.ndarray, far: np.ndarray, label: np.ndarray) -> float:
    change = 0.0
    for i, j in _diagonals(*cost.shape):
        up, left = np.where(i > 0, far[i - 1, j], FAR), np.where(j > 0, far[i, j - 1], FAR)
        c, gap = cost[i, j], np.abs(up - left)
        t = np.where(gap > c, np.minimum(up, left) + c, 0.5 * (up + left + np.sqrt(np.maximum(2 * c * c - gap * gap, 0))))
        better = t < far[i, j]
        if better.any():
            change = max(change, float((far[i, j] - t)[better].max()))
            source = np.where(up < left, label[i - 1, j], label[i, j - 1])
            far[i[better], j[better]] = t[better]
            label[i[better], j[better]] = source[better]
    return change


def geodesic(cost: np.ndarray, seeds: np.ndarray, sweeps: int = 40, least: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """(distance, label): the least cost of a path from a seed, by sweeps in four directions, and the seed's label.

    ``seeds`` has a label at each seed and -1 elsewhere. A turn is finished after the last change over ``least``;
    there are four sweeps at least, ``sweeps`` at most. Without seeds all is FAR and -1.
    """
    far, label = np.where(seeds >= 0, 0.0, FAR), seeds.copy()
    n, end = 0, 4
    while n < end:
        n += 1
        down, right = TURNS[(n - 1) % 4]
        if _sweep(cost[::down, ::right], far[::down, ::right], label[::down, ::right]) > least:
            end = min(sweeps, n + 3)
    return far, label


def barrier(image: np.ndarray, seeds: list[tuple[float, float]], factor: float = 0.0, sweeps: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(distance, label): squared range of the values along a path from a seed (x, y), plus ``factor`` * squared way to it.

    Sweeps from the first and the last corner by turns; approximate, as a pixel keeps one path. Pixels not reached have inf and -1.
    """
    h, w = image.shape
    high, low = image.astype(float), image.astype(float)
    far, label = np.full((h, w), np.inf), np.full((h, w), -1)
    sx, sy = (np.asarray([s[k] for s in seeds], float) for k in (0, 1))
    for k, (x, y) in enumerate(seeds):
        far[int(y + 0.5), int(x + 0.5)], label[int(y + 0.5), int(x + 0.5)] = 0, k
    ys, xs = np.mgrid[:h, :w]
    for n in range(sweeps if seeds else 0):
        way = slice(None, None, -1 if n % 2 else 1)
        g, hi, lo, f, lab, px, py = (a[way, way] for a in (image, high, low, far, label, xs, ys))
        for i, j in _diagonals(h, w):
            for di, dj in ((1, 0), (0, 1)):
                inside = (i >= di) & (j >= dj)
                a, b = i[inside], j[inside]
                source = lab[a - di, b - dj]
                top, bottom = np.maximum(hi[a - di, b - dj], g[a, b]), np.minimum(lo[a - di, b - dj], g[a, b])
                t = (top - bottom) ** 2 + factor * ((sx[source] - px[a, b]) ** 2 + (sy[source] - py[a, b]) ** 2)
                ok = (source >= 0) & (t < f[a, b])
                at = (a[ok], b[ok])
                f[at], lab[at], hi[at], lo[at] = t[ok], source[ok], top[ok], bottom[ok]
    return far, label


def regions(labels: np.ndarray) -> np.ndarray:
    """Parts of equal label that hang together by sides, numbered by their first pixel in reading order."""
    n = labels.size
    at = np.arange(n).reshape(labels.shape)
    a = np.concatenate((at[:, :-1][labels[:, :-1] == labels[:, 1:]], at[:-1][labels[:-1] == labels[1:]]))
    b = np.concatenate((at[:, 1:][labels[:, :-1] == labels[:, 1:]], at[1:][labels[:-1] == labels[1:]]))
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return np.unique(root, return_inverse=True)[1].reshape(labels.shape)
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def merge_small(labels: np.ndarray, least: int) -> np.ndarray:
    """``regions``, those under ``least`` pixels joined to the one left of their first pixel, or above it; numbered anew."""
    part = regions(labels)
    flat, w = part.ravel(), part.shape[1]
    first, size = np.unique(flat, return_index=True)[1], np.bincount(flat)
    name = np.arange(len(first))
    for k in np.flatnonzero(size < least):
        p = first[k]
        if p:
            name[k] = name[flat[p - 1 if p % w else p - w]]
    return regions(name[part])


def superpixels(image: np.ndarray, step: int, compactness: float = 10.0, rounds: int = 10) -> np.ndarray:
    """Labels of about h * w / step^2 compact regions of like colour: (h, w, channels), of which Lab suits best.

    Centres start on a grid, at the flattest of nine pixels; a pixel goes to the nearest centre within ``step``
    either way, by colour and place. Regions under a quarter of step^2 are merged.
    """
    image = image.reshape(*image.shape[:2], -1).astype(float)
    h, w, _ = image.shape
    dy, dx = (np.gradient(image, axis=k) if image.shape[k] > 1 else np.zeros_like(image) for k in (0, 1))
    slope = (dy**2 + dx**2).sum(2)
    centres = []
    for cy in range(min(step // 2, h - 1), h, step):
        for cx in range(min(step // 2, w - 1), w, step):
            y0, x0 = max(0, cy - 1), max(0, cx - 1)
            k = np.unravel_index(slope[y0 : cy + 2, x0 : cx + 2].argmin(), slope[y0 : cy + 2, x0 : cx + 2].shape)
            centres.append([y0 + k[0], x0 + k[1], *image[y0 + k[0], x0 + k[1]]])
    centre = np.asarray(centres, float)
    ys, xs = np.mgrid[:h, :w]
    points = np.concatenate((np.stack((ys, xs), 2), image), 2).reshape(h * w, -1)
    by_place = (compactness / step) ** 2
    for _ in range(rounds):
        far, label = np.full((h, w), np.inf), np.zeros((h, w), int)
        for k, c in enumerate(centre):
            rows, columns = (slice(max(0, int(v) - step), int(v) + step + 1) for v in c[:2])
            d = ((image[rows, columns] - c[2:]) ** 2).sum(2) + by_place * ((ys[rows, columns] - c[0]) ** 2 + (xs[rows, columns] - c[1]) ** 2)
            better = d < far[rows, columns]
            far[rows, columns][better] = d[better]
            label[rows, columns][better] = k
        n = np.bincount(label.ravel(), minlength=len(centre))
        total = np.stack([np.bincount(label.ravel(), weights=points[:, c], minlength=len(centre)) for c in range(points.shape[1])], 1)
        centre = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centre)
    return merge_small(label, max(1, step * step // 4))


def levels(parent: np.ndarray) -> list[np.ndarray]:
    """Nodes by depth, roots (parent -1) first. Nodes on a cycle, or under one, are an error."""
    order = np.argsort(parent, kind="stable")
    ranked = parent[order]
    out = [np.flatnonzero(parent < 0)]
    while len(out[-1]):
        lo, hi = np.searchsorted(ranked, out[-1]), np.searchsorted(ranked, out[-1], "right")
        spans = [order[x:y] for x, y in zip(lo, hi, strict=True) if x < y]
        out.append(np.concatenate(spans) if spans else np.zeros(0, int))
    if sum(map(len, out)) != len(parent):
        raise ValueError("the parents hold a cycle")
    return out[:-1]


def tree_filter(parent: np.ndarray, length: np.ndarray, values: np.ndarray, sigma: float) -> np.ndarray:
    """Of each node, the sum of all nodes' values by exp(-way through the tree / sigma); ``length`` is the way to the parent."""
    near = np.exp(-length / sigma)
    up = values.astype(float).copy()
    depth = levels(parent)
    for nodes in reversed(depth[1:]):
        np.add.at(up, parent[nodes], near[nodes] * up[nodes])
    out = up.copy()
    for nodes in depth[1:]:
        s = near[nodes]
        out[nodes] = up[nodes] + s * (out[parent[nodes]] - s * up[nodes])
    return out


def tree_nearest(parent: np.ndarray, length: np.ndarray, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(way, node): the nearest marked node through the tree, of equally near ones the least; inf and -1 without any."""
    far, best = np.where(marked, 0.0, np.inf), np.where(marked, np.arange(len(parent)), -1)
    depth = levels(parent)
    for nodes in reversed(depth[1:]):
        over = nodes[np.isfinite(far[nodes])]
        order = np.lexsort((best[over], far[over] + length[over], parent[over]))
        over = over[order]
        over = over[np.unique(parent[over], return_index=True)[1]]
        p, d = parent[over], far[over] + length[over]
        closer = (d < far[p]) | ((d == far[p]) & (best[over] < best[p]))
        far[p[closer]], best[p[closer]] = d[closer], best[over[closer]]
    for nodes in depth[1:]:
        p = parent[nodes]
        d = far[p] + length[nodes]
        closer = (d < far[nodes]) | ((d == far[nodes]) & np.isfinite(d) & (best[p] < best[nodes]))
        far[nodes[closer]], best[nodes[closer]] = d[closer], best[p[closer]]
    return far, best


def by_tree(nodes: DataFrame, key: str, fn: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """key, node, value: ``fn`` (parents, lengths, values) of each tree (key, node, parent, length, value); a null parent is a root.

    A tree is one group of one task, so it is bounded by an image. Node numbers may be any, but not repeat in a tree.
    """

    def run(k, pdf):
        import pandas as pd

        pdf = pdf.sort_values("node")
        node = pdf.node.to_numpy()
        known = pdf.parent.notna().to_numpy()
        parent = np.full(len(node), -1)
        at = np.searchsorted(node, pdf.parent[known].to_numpy())
        if (at == len(node)).any() or (node[at] != pdf.parent[known].to_numpy()).any():
            raise ValueError(f"a parent is no node of tree {k[0]}")
        parent[known] = at
        return pd.DataFrame({key: k[0], "node": node, "value": fn(parent, pdf.length.fillna(0).to_numpy(float), pdf.value.fillna(0).to_numpy(float))})

    return nodes.select(key, "node", "parent", "length", "value").groupBy(key).applyInPandas(run, f"`{key}` {dict(nodes.dtypes)[key]}, node long, value double")
