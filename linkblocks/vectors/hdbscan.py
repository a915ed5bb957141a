"""Density clustering by a hierarchy of mutual-reachability distances (Campello et al. 2013), in numpy."""

from __future__ import annotations

import heapq

import numpy as np


def between(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """Distances by a matrix product."""
    if metric == "cosine":
        unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        d = unit(x) @ unit(y).T
        return np.maximum(np.subtract(1, d, out=d), 0, out=d)
    d = x @ y.T
    d *= -2
    d += (x * x).sum(1)[:, None]
    d += (y * y).sum(1)[None]
    return np.sqrt(np.maximum(d, 0, out=d), out=d)


def reach(d: np.ndarray, core: np.ndarray, alpha: float) -> np.ndarray:
    """Mutual reachability of rows with these distances among each other, in place of them."""
    d /= alpha
    np.maximum(d, core[:, None], out=d)
    return np.maximum(d, core[None], out=d)


def _mutual(x: np.ndarray, min_samples: int, metric: str, alpha: float) -> np.ndarray:
    d = between(x, x, metric)
    np.fill_diagonal(d, 0)
    core = np.partition(d, min(min_samples, len(x)) - 1, axis=1)[:, min(min_samples, len(x)) - 1]
    return reach(d, core, alpha)


def tree(d: np.ndarray) -> np.ndarray:
    """Edges (a, b, weight) of a minimum spanning tree, ascending."""
    n = len(d)
    best, parent, out = np.full(n, np.inf), np.zeros(n, int), []
    inside = np.zeros(n, bool)
    at = 0
    for _ in range(n - 1):
        inside[at] = True
        closer = (d[at] < best) & ~inside
        best[closer], parent[closer] = d[at][closer], at
        at = int(np.where(inside, np.inf, best).argmin())
        out.append((parent[at], at, best[at]))
    edges = np.array(out).reshape(-1, 3)
    return edges[np.argsort(edges[:, 2], kind="stable")]


def across(d: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Edges of a least spanning tree of two groups from the trees of both and the weights between them; places of the second follow those of the first."""
    n, m = d.shape
    near: list[list] = [[] for _ in range(n + m)]
    for edges, first in ((left, 0), (right, n)):
        for a, b, w in edges.tolist():
            a, b = int(a) + first, int(b) + first
            near[a].append((b, w))
            near[b].append((a, w))
    # low: of places outside, -inf inside, where nothing is nearer; far: the same, inf inside
    low, far, parent, out = np.full(n + m, np.inf), np.full(n + m, np.inf), np.zeros(n + m, int), []
    ends, back = (slice(n, n + m), slice(0, n)), np.ascontiguousarray(d.T)
    at = 0
    for _ in range(n + m - 1):
        low[at], far[at] = -np.inf, np.inf
        row, there = (d[at], ends[0]) if at < n else (back[at - n], ends[1])
        closer = row < low[there]
        np.copyto(low[there], row, where=closer)
        np.copyto(far[there], row, where=closer)
        parent[there][closer] = at
        for b, w in near[at]:
            if w < low[b]:
                low[b] = far[b] = w
                parent[b] = at
        at = int(far.argmin())
        out.append((parent[at], at, far[at]))
    return np.array(out, float).reshape(-1, 3)


def forest(edges: np.ndarray) -> np.ndarray:
    """Those of the edges (a, b, weight) that a least spanning forest keeps: each tree takes its least edge outwards, round by round."""
    edges = edges[np.lexsort((edges[:, 1], edges[:, 0], edges[:, 2]))]
    ids, ends = np.unique(edges[:, :2].astype(np.int64), return_inverse=True)
    a, b = ends.reshape(-1, 2).T
    at, rest, kept = np.arange(len(ids)), np.arange(len(edges)), []
    while True:
        x, y = at[a[rest]], at[b[rest]]
        out = x != y
        rest, x, y = rest[out], x[out], y[out]
        if not len(rest):
            return edges[np.sort(np.concatenate(kept))] if kept else edges[:0]
        # the order of edges decides ties, so no circle can close
        least = np.full(len(ids), len(edges))
        np.minimum.at(least, x, rest)
        np.minimum.at(least, y, rest)
        new = np.unique(least[least < len(edges)])
        kept.append(new)
        root = np.arange(len(ids))
        one, two = at[a[new]], at[b[new]]
        while True:  # labels fall to the least of what is joined
            low = np.minimum(root[one], root[two])
            before = root.copy()
            np.minimum.at(root, root[one], low)
            np.minimum.at(root, root[two], low)
            root = root[root]
            if (root == before).all():
                break
        at = root[at]


def grown(edges: np.ndarray, n: int) -> np.ndarray:
    """The edges of a tree of n nodes as ``tree`` finds them from node 0, ascending."""
    near: list[list] = [[] for _ in range(n)]
    for a, b, w in edges.tolist():
        near[int(a)].append((w, int(b), int(a)))
        near[int(b)].append((w, int(a), int(b)))
    inside, heap, out = [False] * n, near[0], []
    heapq.heapify(heap)
    inside[0] = True
    while heap:
        w, at, parent = heapq.heappop(heap)
        if inside[at]:
            continue
        inside[at] = True
        out.append((parent, at, w))
        for x in near[at]:
            if not inside[x[1]]:
                heapq.heappush(heap, x)
    found = np.array(out, float).reshape(-1, 3)
    return found[np.argsort(found[:, 2], kind="stable")]


def hdbscan(x: np.ndarray, min_cluster_size: int = 5, min_samples: int | None = None, epsilon: float = 0.0, metric: str = "euclidean", alpha: float = 1.0, method: str = "eom") -> np.ndarray:
    """A label for each row, -1 for noise; ``method`` is eom or leaf."""
    edges = tree(_mutual(np.asarray(x, float), min_samples or min_cluster_size, metric, alpha)) if len(x) > 1 else np.zeros((0, 3))
    return labelled(len(x), edges, min_cluster_size, epsilon, method)


def labelled(n: int, edges: np.ndarray, min_cluster_size: int = 5, epsilon: float = 0.0, method: str = "eom") -> np.ndarray:
    """The labels that ascending edges (a, b, weight) of a least spanning tree give to n rows."""
    if method not in ("eom", "leaf"):
        raise ValueError("method is eom or leaf")
    if n < max(2, min_cluster_size):
        return np.full(n, -1)
    # single linkage: node n + i joins two earlier nodes at a distance
    parent, size = list(range(2 * n - 1)), [1] * n + [0] * (n - 1)
    merges = []

    def root(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for i, (a, b, w) in enumerate(edges.tolist()):
        a, b = root(int(a)), root(int(b))
        merges.append((a, b, w))
        parent[a] = parent[b] = n + i
        size[n + i] = size[a] + size[b]

    def points(node: int) -> list[int]:
        out, stack = [], [node]
        while stack:
            k = stack.pop()
            if k < n:
                out.append(k)
            else:
                stack += merges[k - n][:2]
        return out

    # condensed: cluster -> births, children and when points leave
    birth, children, stability, lost = {0: 0.0}, {0: []}, {0: 0.0}, {0: []}
    above, stack, new = {0: None}, [(2 * n - 2, 0)], 1
    while stack:
        node, c = stack.pop()
        a, b, w = merges[node - n]
        lam = 1 / w if w > 0 else 1e12
        big = [k for k in (a, b) if size[k] >= min_cluster_size]
        if len(big) == 2:
            for k in big:
                birth[new], children[new], stability[new], lost[new], above[new] = lam, [], 0.0, [], c
                children[c].append(new)
                stability[c] += size[k] * (lam - birth[c])
                if k < n:
                    lost[new].append(k)
                else:
                    stack.append((k, new))
                new += 1
            continue
        for k in (a, b):
            if k in big and k >= n:
                stack.append((k, c))
            else:
                gone = points(k)
                lost[c] += gone
                stability[c] += len(gone) * (lam - birth[c])
    order = sorted(birth, reverse=True)
    chosen = set()
    if method == "leaf":
        chosen = {c for c in order if not children[c] and c}
    else:
        value = dict(stability)
        for c in order:
            if c == 0:
                continue
            below = sum(value[k] for k in children[c])
            if children[c] and below > stability[c]:
                value[c] = below
            else:
                chosen -= _under(c, children)
                chosen.add(c)
    if epsilon > 0:
        lifted = set()
        for c in chosen:
            while above[c] not in (None, 0) and 1 / birth[c] < epsilon:
                c = above[c]
            lifted.add(c)
        chosen = {c for c in lifted if not any(c in _under(p, children) for p in lifted)}
    labels = np.full(n, -1)
    for k, c in enumerate(sorted(chosen)):
        for q in [c, *_under(c, children)]:
            labels[lost[q]] = k
    return labels


def _under(c: int, children: dict) -> set[int]:
    out, stack = set(), list(children[c])
    while stack:
        k = stack.pop()
        out.add(k)
        stack += children[k]
    return out
