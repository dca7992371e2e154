"""Graph measures that iterate: numpy kernels over stacks of graphs (graph, node, node), so a task works on many subjects at once.

Graphs are the unit of distribution: a subject's edges go through Arrow once, whatever is computed. Memory follows the
stack, whose number of graphs is bounded, and within a kernel a bounded number of array entries.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortgraph.operators.network import whole_graphs

#: Graphs that are worked on at once, and array entries that a kernel holds at once besides.
STACK, ENTRIES = 256, 1 << 22


def lengths_of(w: np.ndarray, weights_are_lengths: bool = False) -> np.ndarray:
    """Lengths 1 / w, or w itself; infinite where there is no edge, 0 on the diagonal."""
    with np.errstate(divide="ignore"):
        out = np.where(w > 0, w if weights_are_lengths else 1 / w, np.inf)
    n = w.shape[-1]
    out[..., np.arange(n), np.arange(n)] = 0
    return out


def floyd_warshall(d: np.ndarray) -> np.ndarray:
    d = d.copy()
    for k in range(d.shape[-1]):
        np.minimum(d, d[..., :, k, None] + d[..., None, k, :], out=d)
    return d


def clustering(w: np.ndarray) -> np.ndarray:
    """Twice the triangles' sum of weights' cube roots, multiplied, over k (k - 1)."""
    r, k = np.cbrt(w), (w > 0).sum(axis=-1)
    t = np.einsum("bij,bji->bi", r @ r, r)
    return np.divide(t, k * (k - 1), out=np.zeros(t.shape), where=k > 1)


def local_efficiency(w: np.ndarray) -> np.ndarray:
    """For each node, over pairs of its neighbours: cube root of both weights over their distance among the neighbours.

    Neighbourhoods of as many nodes are a stack of their own, whatever graphs they come from."""
    out, degree = np.zeros(w.shape[:2]), (w > 0).sum(axis=-1)
    for k in np.unique(degree[degree > 1]).tolist():
        g, u = np.nonzero(degree == k)
        for lo in range(0, len(g), max(1, ENTRIES // (k * k))):
            a, b = g[lo : lo + max(1, ENTRIES // (k * k))], u[lo : lo + max(1, ENTRIES // (k * k))]
            near = np.nonzero(w[a, b] > 0)[1].reshape(-1, k)
            d = floyd_warshall(lengths_of(w[a[:, None, None], near[:, :, None], near[:, None, :]]))
            d[:, np.arange(k), np.arange(k)] = np.inf
            own = np.take_along_axis(w[a, b], near, axis=1)
            out[a, b] = np.cbrt(own[:, :, None] * own[:, None, :] / d).sum(axis=(1, 2)) / (k * (k - 1))
    return out


def betweenness(length: np.ndarray) -> np.ndarray:
    """Shortest paths through each node over ordered pairs; of several shortest paths each counts its share.

    tight[s, u, v] tells that an edge lies on a shortest path from s. Paths are counted by steps along tight edges from all
    sources at once, and shares flow back along the same edges; both end after as many steps as the longest path has edges."""
    n, out = length.shape[-1], np.zeros(length.shape[:2])
    step = max(1, ENTRIES // n**3)
    edge = np.isfinite(length) & ~np.eye(n, dtype=bool)
    for lo in range(0, len(length), step):
        own = length[lo : lo + step]
        d = floyd_warshall(own)
        with np.errstate(invalid="ignore"):
            tight = (np.isclose(d[:, :, :, None] + own[:, None], d[:, :, None, :], rtol=1e-12, atol=0) & edge[lo : lo + step, None]).astype(float)
        paths = front = np.broadcast_to(np.eye(n), d.shape)
        while front.any():
            front = (front[:, :, None, :] @ tight)[:, :, 0]
            paths = paths + front
        # From u to v goes the share paths[u] / paths[v] of what v passes on.
        tight *= np.divide(paths[..., None], paths[:, :, None, :], out=np.zeros_like(tight), where=paths[:, :, None, :] > 0)
        share = np.zeros(d.shape)
        front = (np.isfinite(d) & ~np.eye(n, dtype=bool)).astype(float)
        while front.any():
            front = (tight @ front[..., None])[..., 0]
            share += front
        share[:, np.arange(n), np.arange(n)] = 0
        out[lo : lo + step] = share.sum(axis=1)
    return out


def louvain(w: np.ndarray, gamma: float = 1.0, seed: int = 0, tolerance: float = 1e-10) -> tuple[np.ndarray, float]:
    """(community of each node, modularity) of the last level."""
    return louvain_levels(w, gamma, seed, tolerance)[-1]


def louvain_levels(w: np.ndarray, gamma: float = 1.0, seed: int = 0, tolerance: float = 1e-10) -> list[tuple[np.ndarray, float]]:
    """(community of each node, modularity) of each level: moves to the best neighbouring module, then pooling, until Q stops
    growing. A graph without edges has one level, of single nodes."""
    total = w.sum()
    member, levels = np.arange(len(w)), []
    if not total:
        return [(member, 0.0)]
    rng = np.random.default_rng(seed)
    graph, best = w.astype(float), -1.0
    while True:
        n = len(graph)
        label, k = np.arange(n), graph.sum(axis=1)
        weight = k.copy()
        for _ in range(1000):
            moved = False
            for u in rng.permutation(n):
                to = np.bincount(label, graph[u], minlength=n)
                own = label[u]
                gain = to - to[own] + graph[u, u] - gamma * k[u] * (weight - weight[own] + k[u]) / total
                gain[own] = 0
                c = int(np.argmax(gain))
                if gain[c] > tolerance:
                    weight[own] -= k[u]
                    weight[c] += k[u]
                    label[u], moved = c, True
            if not moved:
                break
        _, label = np.unique(label, return_inverse=True)
        pool = np.zeros((label.max() + 1,) * 2)
        np.add.at(pool, (label[:, None], label[None, :]), graph)
        share = pool / total
        q = float(np.trace(share) - gamma * (share.sum(axis=0) * share.sum(axis=1)).sum())
        if q - best < tolerance:
            return levels
        member, best, graph = label[member], q, pool
        levels.append((member, q))


def louvain_stack(w: np.ndarray, seeds: Sequence[int], gamma: float = 1.0, tolerance: float = 1e-10) -> np.ndarray:
    """(graph, node): the modules of louvain() with each graph's own seed, all graphs at once. In a step every graph that still
    moves looks at the next node of its own order; graphs pooled to fewer nodes than others are padded."""
    graphs, n = w.shape[:2]
    out, total = np.tile(np.arange(n), (graphs, 1)), w.reshape(graphs, -1).sum(axis=1)
    rngs, best, size = [np.random.default_rng(s) for s in seeds], np.full(graphs, -1.0), np.full(graphs, n)
    who = np.flatnonzero(total)
    graph = w[who].astype(float)
    while len(who):
        n, all_w, own_size = graph.shape[1], total[who], size[who]
        label, k = np.tile(np.arange(n), (len(who), 1)), graph.sum(axis=2)
        weight, beyond, moving = k.copy(), np.arange(n) >= own_size[:, None], np.arange(len(who))
        for _ in range(1000):
            order, moved = np.full((len(moving), n), n), np.zeros(len(who), bool)
            for row, g in zip(order, moving):
                row[: own_size[g]] = rngs[who[g]].permutation(own_size[g])
            for u in order.T:
                g, u = moving[u < n], u[u < n]
                at = np.arange(len(g))
                line, own, ku = graph[g, u], label[g, u], k[g, u]
                to = np.bincount((at[:, None] * n + label[g]).ravel(), line.ravel(), minlength=len(g) * n).reshape(-1, n)
                gain = to - to[at, own][:, None] + line[at, u][:, None] - gamma * ku[:, None] * (weight[g] - weight[g, own][:, None] + ku[:, None]) / all_w[g][:, None]
                gain[at, own] = 0
                gain[beyond[g]] = -np.inf
                c = gain.argmax(axis=1)
                on = gain[at, c] > tolerance
                g, u, own, c, ku = g[on], u[on], own[on], c[on], ku[on]
                weight[g, own] -= ku
                weight[g, c] += ku
                label[g, u], moved[g] = c, True
            moving = moving[moved[moving]]
            if not len(moving):
                break
        used = np.zeros((len(who), n), bool)
        used[np.arange(len(who))[:, None], np.where(beyond, label[:, :1], label)] = True
        label = np.take_along_axis(np.cumsum(used, axis=1) - 1, label, axis=1)
        fewer = used.sum(axis=1)
        pool = np.zeros((len(who), fewer.max(), fewer.max()))
        g, i, j = np.nonzero(graph)
        np.add.at(pool, (g, label[g, i], label[g, j]), graph[g, i, j])
        share = pool / all_w[:, None, None]
        q = np.trace(share, axis1=1, axis2=2) - gamma * (share.sum(axis=1) * share.sum(axis=2)).sum(axis=1)
        on = q - best[who] >= tolerance
        who = who[on]
        out[who], best[who], size[who], graph = np.take_along_axis(label[on], out[who], axis=1), q[on], fewer[on], pool[on]
    return out


def participation(w: np.ndarray, label: np.ndarray) -> np.ndarray:
    """1 - sum over communities of (weight into it / strength) squared; 0 for isolated nodes. label (graph, node) from 0."""
    into = w @ np.eye(label.max(initial=0) + 1)[label]
    s = into.sum(axis=-1)
    return np.where(s > 0, 1 - np.divide((into**2).sum(axis=-1), s**2, out=np.zeros(s.shape), where=s > 0), 0.0)


def neighbour_degree(w: np.ndarray) -> np.ndarray:
    """Weighted mean degree of the neighbours; not a number for isolated nodes."""
    k, s = (w > 0).sum(axis=-1).astype(float), w.sum(axis=-1)
    return np.divide((w @ k[..., None])[..., 0], s, out=np.full(s.shape, np.nan), where=s > 0)


#: Transport problems that pivot together: their arrays stay in a core's cache.
PROBLEMS = 2048


def transport(supply: np.ndarray, demand: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Least cost of moving each problem's supply to its demand: (problem, source), (problem, sink), (problem, source, sink).

    Exact, by a dual simplex of many problems at once. Supply and demand have the same sum. Places with nothing to give or take
    pad the shorter problems."""
    if np.abs(supply.sum(axis=1) - demand.sum(axis=1)).max(initial=0) > 1e-9:
        raise ValueError("supply and demand must have the same sum")
    out = [_transport(supply[lo : lo + PROBLEMS], demand[lo : lo + PROBLEMS], cost[lo : lo + PROBLEMS]) for lo in range(0, len(cost), PROBLEMS)]
    return np.concatenate(out) if out else np.zeros(0)


def _transport(supply: np.ndarray, demand: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """The source with most to give, the hub, serves all sinks at first, and each other source gives all it has to the sink where
    that saves most. No other cell is cheaper at these prices, but the hub may have to take back. A pivot takes the most
    negative flow out, which cuts the basis tree in two, and the cheapest cell that joins both parts in.

    Arrays have problems last. The inverse of a tree's basis is, for each of its cells, the part that it cuts off and a sign: part
    holds its nodes, sources then sinks, as bits, and sign is that of its sources; sinks have the other. The hub's own row has the
    whole tree. Costs are moved by some 1e-12 of the largest, so that no two ways tie and pivots end."""
    p, m, n = cost.shape
    out, size = np.zeros(p), m + n
    if not m or not n:
        return out
    cost = np.where((supply > 0)[:, :, None] & (demand > 0)[:, None, :], cost, 0.0)
    c = np.ascontiguousarray((cost + 1e-12 * cost.max(axis=(1, 2))[:, None, None] * np.random.default_rng(0).random((m, n))).transpose(1, 2, 0))
    who, k, hub = np.arange(p), np.arange(p), supply.argmax(axis=1)
    to = c[hub, :, k].T
    saved = c - to
    best = saved.argmin(axis=1)
    price = np.concatenate([saved.min(axis=1), to])
    price[hub, k] = 0
    basis = np.concatenate([np.arange(m)[:, None] * n + best, hub * n + np.arange(n)[:, None]])
    flow, sign = np.concatenate([supply.T, demand.T]).astype(float), np.ones((size, p), np.int8)
    sign[m:] = -1
    bits = np.zeros((-(-size // 64), size), np.uint64)
    bits[np.arange(size) // 64, np.arange(size)] = np.uint64(1) << (np.arange(size) % 64).astype(np.uint64)
    part = np.repeat(bits[:, :, None], p, axis=2)
    for i in range(m):
        own = np.flatnonzero(hub != i)
        flow[m + best[i, own], own] -= supply[own, i]
        part[:, m + best[i, own], own] |= bits[:, i, None]
    part[:, hub, k] = bits.sum(axis=1)[:, None]
    flow[hub, k] = 0
    while True:
        leave = flow.argmin(axis=0)
        low = flow[leave, k]
        on = low < -1e-12
        live = np.count_nonzero(on)
        if live <= 0.7 * len(k):
            row, column = np.divmod(basis[:, ~on], n)
            out[who[~on]] = (cost[who[~on], row, column] * flow[:, ~on]).sum(axis=0)
            if not live:
                return out
            kept = np.flatnonzero(on)
            who, leave, low, on, k = who[kept], leave[kept], low[kept], on[kept], np.arange(live)
            c, price, basis, flow, part, sign = (x.take(kept, axis=-1) for x in (c, price, basis, flow, part, sign))
        cut, cut_sign = part[:, leave, k], sign[leave, k]
        inside = ((cut[:, None] & bits[:, :, None]) != 0).any(axis=0)
        gives = cut_sign < 0  # sources of the part take the new cell in, else its sinks do
        r = c - np.where(inside[:m] == gives, price[:m], -np.inf)[:, None]
        r -= np.where(inside[m:] != gives, price[m:], -np.inf)
        best = r.min(axis=1)
        i = best.argmin(axis=0)
        j = r[i, :, k].argmin(axis=1)
        by, step = np.where(on, best[i, k] * cut_sign, 0.0), np.where(on, -low, 0.0)
        price[:m] -= by * inside[:m]
        price[m:] += by * inside[m:]
        source, sink = (((part & b[:, None]) != 0).any(axis=0) for b in (bits[:, i], bits[:, m + j]))
        change = sign * (source.view(np.int8) - sink.view(np.int8))
        flow -= step * change
        flow[leave, k] = np.where(on, step, low)
        # Parts of the cells on the way round change by what is cut off; one inside it turns to the rest of it.
        change *= on
        moved = change != 0
        moved[leave, k] = False
        within = moved & ((part & ~cut[:, None]) == 0).all(axis=0)
        sign = np.where(within, change * cut_sign, sign)
        part ^= np.where(moved, cut[:, None], np.uint64(0))
        sign[leave, k] = np.where(on, -cut_sign, cut_sign)
        basis[leave, k] = np.where(on, i * n + j, basis[leave, k])


def ricci_curvature(w: np.ndarray, alpha: float = 0.5) -> np.ndarray:
    """Ollivier-Ricci curvature of each node: mean over its edges of 1 - W / d, W the transport distance of the two ends' lazy
    neighbour distributions (alpha stays, the rest goes to neighbours in proportion to weight), d the path length.

    Each edge is a transport problem. What both ends have in common stays where it is, as distances are a metric, so one
    end's nodes are sources and the other's sinks; problems of like size are solved together."""
    n = w.shape[-1]
    d, s = floyd_warshall(lengths_of(w)), w.sum(axis=-1)
    measure = alpha * np.eye(n) + (1 - alpha) * np.divide(w, s[..., None], out=np.zeros_like(w, float), where=s[..., None] > 0)
    g, i, j = np.nonzero(np.triu(w, 1))
    total, count, k = np.zeros(w.shape[:2]), np.zeros(w.shape[:2]), np.zeros(len(g))
    sizes = np.zeros(len(g), int)
    for lo in range(0, len(g), 65_536):
        z = slice(lo, lo + 65_536)
        more = measure[g[z], i[z]] - measure[g[z], j[z]]
        sizes[z] = ((more > 0).sum(axis=1) + 1) // 2 * 1000 + ((more < 0).sum(axis=1) + 1) // 2
    order, lo = np.argsort(sizes, kind="stable"), 0
    while lo < len(order):
        same = int(np.searchsorted(sizes[order], sizes[order[lo]], "right"))
        x, y = 2 * (sizes[order[lo]] // 1000), 2 * (sizes[order[lo]] % 1000)
        own = order[lo : min(same, lo + max(1, ENTRIES // max(1, 8 * x * y)))]
        lo += len(own)
        a, b, c = g[own], i[own], j[own]
        if x and y:
            more = measure[a, b] - measure[a, c]
            from_, to = np.argsort(-more, axis=1, kind="stable")[:, :x], np.argsort(more, axis=1, kind="stable")[:, :y]
            supply, demand = np.maximum(np.take_along_axis(more, from_, axis=1), 0), np.maximum(-np.take_along_axis(more, to, axis=1), 0)
            cost = d[a[:, None, None], from_[:, :, None], to[:, None, :]]
            k[own] = transport(supply, demand, np.where(np.isfinite(cost), cost, 1e12))  # only padding is out of reach
        k[own] = 1 - k[own] / d[a, b, c]
    for v in (i, j):
        np.add.at(total, (g, v), k)
        np.add.at(count, (g, v), 1)
    return np.divide(total, count, out=np.zeros(total.shape), where=count > 0)


def _gathered(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Parts of whole graphs, put together until they have a stack of them."""
    held, graphs = [], 0
    for pdf in parts:
        held.append(pdf)
        graphs += pdf["subject"].nunique()
        if graphs >= STACK:
            yield pd.concat(held, ignore_index=True)
            held, graphs = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def stacks(batches: Iterator[pd.DataFrame], n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(subjects, symmetric weight matrices) of sorted edges, a bounded number of whole graphs at a time. Batches are put together
    until they have as many, as few graphs at once cost a task more for each."""
    for pdf in _gathered(whole_graphs(batches, ["subject"])):
        subjects, at = np.unique(pdf["subject"].to_numpy(), return_inverse=True)
        i, j, w = pdf["i"].to_numpy() - 1, pdf["j"].to_numpy() - 1, pdf["w"].to_numpy(float)
        for lo in range(0, len(subjects), STACK):
            own = (at >= lo) & (at < lo + STACK)
            m = np.zeros((min(STACK, len(subjects) - lo), n, n))
            m[at[own] - lo, i[own], j[own]] = w[own]
            yield subjects[lo : lo + STACK], np.maximum(m, m.swapaxes(1, 2))


def distances(edges: DataFrame, n: int, weighted: bool = True) -> DataFrame:
    """(subject, i, j, d): shortest path lengths of reachable ordered pairs, lengths 1 / w, or 1 unweighted; many graphs at once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for subjects, w in stacks(batches, n):
            d = floyd_warshall(lengths_of(w if weighted else (w > 0).astype(float)))
            s, i, j = np.nonzero(np.isfinite(d) & ~np.eye(n, dtype=bool))
            yield pd.DataFrame({"subject": subjects[s], "i": (i + 1).astype(np.int32), "j": (j + 1).astype(np.int32), "d": d[s, i, j]})

    return _sorted(edges).mapInPandas(run, "subject long, i int, j int, d double")


def community_levels(edges: DataFrame, n: int) -> DataFrame:
    """(subject, level, node, community, q): the hierarchy that pooling goes through, level 1 first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for subjects, w in stacks(batches, n):
            for s, m in zip(subjects.tolist(), w):
                for level, (label, q) in enumerate(louvain_levels(m, seed=_seed(s)), 1):
                    yield pd.DataFrame({"subject": s, "level": np.int32(level), "node": np.arange(1, n + 1, dtype=np.int32), "community": (label + 1).astype(np.int32), "q": q})

    return _sorted(edges).mapInPandas(run, "subject long, level int, node int, community int, q double")


def _seed(subject: int) -> int:
    return zlib.crc32(str(subject).encode())


def communities(subjects: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Louvain's modules (graph, node) from 0, each graph with a seed of its subject."""
    return louvain_stack(w, [_seed(s) for s in subjects.tolist()])


#: Measures of nodes, in the order of feature vectors. They take subjects and weights, and what modules are known.
NODE_MEASURES: dict[str, Callable[[np.ndarray, np.ndarray, np.ndarray | None], np.ndarray]] = {
    "clustering": lambda s, w, c: clustering(w), "local_efficiency": lambda s, w, c: local_efficiency(w), "degree": lambda s, w, c: (w > 0).sum(axis=-1),
    "betweenness": lambda s, w, c: betweenness(lengths_of(w, weights_are_lengths=True)), "participation": lambda s, w, c: participation(w, c), "neighbour_degree": lambda s, w, c: neighbour_degree(w),
    "curvature": lambda s, w, c: ricci_curvature(w), "community": lambda s, w, c: c + 1, "inverse_betweenness": lambda s, w, c: betweenness(lengths_of(w)),
    "unit_betweenness": lambda s, w, c: betweenness(lengths_of((w > 0).astype(float))) / max(1, (w.shape[-1] - 1) * (w.shape[-1] - 2)),
}
#: The measures of a feature vector: each graph's two, then a block of nodes for each other.
GLOBAL_FEATURES = ("path_length", "global_efficiency")
NODE_FEATURES = ("clustering", "local_efficiency", "degree", "betweenness", "participation", "neighbour_degree", "curvature")


def _sorted(edges: DataFrame) -> DataFrame:
    """Little data and much work: at least a few tasks a core, which Spark does not merge."""
    spark = edges.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return edges.select("subject", "i", "j", F.col("w").cast("double").alias("w")).repartition(tasks, "subject").sortWithinPartitions("subject")


def node_measures(edges: DataFrame, n: int, which: tuple[str, ...] = ("local_efficiency", "betweenness")) -> DataFrame:
    """(subject, node, measure, value): several iterative measures in one pass. betweenness takes weights as lengths,
    inverse_betweenness 1 / w, unit_betweenness edges, as a share of all ordered pairs of other nodes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for subjects, w in stacks(batches, n):
            modules = communities(subjects, w) if {"participation", "community"} & set(which) else None
            for m in which:
                value = NODE_MEASURES[m](subjects, w, modules)
                yield pd.DataFrame({"subject": np.repeat(subjects, n), "node": np.tile(np.arange(1, n + 1, dtype=np.int32), len(subjects)), "measure": m, "value": value.astype(float).ravel()})

    return _sorted(edges).mapInPandas(run, "subject long, node int, measure string, value double")


def feature_names(n: int) -> list[str]:
    """The entries of a feature vector in order."""
    return [*GLOBAL_FEATURES, *(f"{m}_{k}" for m in NODE_FEATURES for k in range(1, n + 1))]


def measure_vectors(edges: DataFrame, n: int) -> DataFrame:
    """(subject, at array<int>, value array<double>): all measures of a graph in one pass, as a sparse vector in the order of
    feature_names(n), zeros left out. The path length is the mean over all reachable ordered pairs and the diagonal; measures
    that are not defined for a node are 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for subjects, w in stacks(batches, n):
            d = floyd_warshall(lengths_of(w))
            known, off = np.isfinite(d), ~np.eye(n, dtype=bool)
            with np.errstate(divide="ignore"):
                inverse = np.where(known & off, 1 / d, 0.0)
            whole = [np.where(known, d, 0.0).sum(axis=(1, 2)) / known.sum(axis=(1, 2)), inverse.sum(axis=(1, 2)) / max(1, n * (n - 1))]
            modules = communities(subjects, w)
            rows = np.concatenate([np.stack(whole, axis=1), *(np.nan_to_num(NODE_MEASURES[m](subjects, w, modules).astype(float)) for m in NODE_FEATURES)], axis=1)
            at = [np.flatnonzero(r).astype(np.int32) for r in rows]
            yield pd.DataFrame({"subject": subjects, "at": at, "value": [r[k] for r, k in zip(rows, at)]})

    return _sorted(edges).mapInPandas(run, "subject long, at array<int>, value array<double>")
