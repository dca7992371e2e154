"""Single-graph kernels by their definitions, one pair, source or edge at a time: what the stacked ones are held against."""

import numpy as np


def lengths_of(w: np.ndarray) -> np.ndarray:
    """Lengths 1 / w, infinite where there is no edge, 0 on the diagonal."""
    out = np.full(w.shape, np.inf)
    np.divide(1.0, w, out=out, where=w > 0)
    np.fill_diagonal(out, 0)
    return out


def floyd_warshall(d: np.ndarray) -> np.ndarray:
    d = d.copy()
    for k in range(len(d)):
        np.minimum(d, d[:, k, None] + d[None, k, :], out=d)
    return d


def local_efficiency(w: np.ndarray) -> np.ndarray:
    """For each node, over pairs of its neighbours: cube root of both weights over their distance among the neighbours."""
    out = np.zeros(len(w))
    for u in range(len(w)):
        near = np.flatnonzero(w[u])
        k = len(near)
        if k < 2:
            continue
        d = floyd_warshall(lengths_of(w[np.ix_(near, near)]))
        np.fill_diagonal(d, np.inf)
        pairs = np.cbrt(np.outer(w[u, near], w[u, near]) / d)
        out[u] = pairs.sum() / (k * (k - 1))
    return out


def betweenness(length: np.ndarray) -> np.ndarray:
    """Shortest paths through each node over ordered pairs; of several shortest paths each counts its share.

    Distances come from Floyd-Warshall. Paths are counted along the edges that some shortest path uses, in order of
    distance from the source, and dependencies are added up in the reverse order."""
    n = len(length)
    d = floyd_warshall(length)
    out = np.zeros(n)
    edge = np.isfinite(length) & ~np.eye(n, dtype=bool)
    for s in range(n):
        near = np.where(np.isfinite(d[s]))[0]
        order = near[np.argsort(d[s, near], kind="stable")]
        tight = edge & np.isclose(d[s][:, None] + length, d[s][None, :], rtol=1e-12, atol=0)
        paths = np.zeros(n)
        paths[s] = 1
        for v in order[1:]:
            paths[v] = paths[tight[:, v]].sum()
        share = np.zeros(n)
        for v in order[:0:-1]:
            before = tight[:, v]
            share[before] += paths[before] / paths[v] * (1 + share[v])
            out[v] += share[v]
    return out


def transport(a: np.ndarray, b: np.ndarray, cost: np.ndarray) -> float:
    """Least cost of moving distribution a to b, exactly: successive cheapest paths in the residual network of the transport problem."""
    n, m = len(a), len(b)
    flow, supply, demand = np.zeros((n, m)), a.astype(float).copy(), b.astype(float).copy()
    while supply.max(initial=0) > 1e-12 and demand.max(initial=0) > 1e-12:
        left, right = np.where(supply > 1e-12, 0.0, np.inf), np.full(m, np.inf)
        from_l, from_r = np.full(n, -1), np.full(m, -1)
        for _ in range(n + m):  # cheapest paths to each side by Bellman-Ford, all edges at once
            reach = left[:, None] + cost
            step = reach.min(axis=0)
            better = step < right - 1e-12
            right[better], from_r[better] = step[better], reach.argmin(axis=0)[better]
            back = np.where(flow > 1e-12, right[None, :] - cost, np.inf)
            step = back.min(axis=1)
            better = step < left - 1e-12
            left[better], from_l[better] = step[better], back.argmin(axis=1)[better]
            if not better.any():
                break
        j = int(np.where(demand > 1e-12, right, np.inf).argmin())
        path, most, end = [], demand[j], j
        while True:
            i = from_r[end]
            path.append((i, end, 1))
            if from_l[i] < 0:
                most = min(most, supply[i])
                break
            path.append((i, from_l[i], -1))
            most = min(most, flow[i, from_l[i]])
            end = from_l[i]
        for i, k, sign in path:
            flow[i, k] += sign * most
        supply[path[-1][0] if path[-1][2] == 1 else path[-2][0]] -= most
        demand[j] -= most
    return float((flow * cost).sum())


def ricci_curvature(w: np.ndarray, alpha: float = 0.5) -> np.ndarray:
    """Ollivier-Ricci curvature of each node: mean over its edges of 1 - W / d, W the transport distance of the two ends' lazy
    neighbour distributions (alpha stays, the rest goes to neighbours in proportion to weight), d the path length."""
    n = len(w)
    d = floyd_warshall(lengths_of(w))
    s = w.sum(axis=1)
    measure = alpha * np.eye(n) + (1 - alpha) * np.divide(w, s[:, None], out=np.zeros_like(w), where=s[:, None] > 0)
    total, count = np.zeros(n), np.zeros(n)
    for i, j in zip(*np.nonzero(np.triu(w, 1))):
        common = np.minimum(measure[i], measure[j])  # mass in common stays where it is, because distances are a metric
        a, b = measure[i] - common, measure[j] - common
        x, y = np.flatnonzero(a > 0), np.flatnonzero(b > 0)
        k = 1 - transport(a[x], b[y], d[np.ix_(x, y)]) / d[i, j]
        for v in (i, j):
            total[v] += k
            count[v] += 1
    return np.divide(total, count, out=np.zeros(n), where=count > 0)
