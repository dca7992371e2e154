import itertools
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortgraph.functions import distributions as dist
import plain_kernels
from cohortgraph.operators import kernels, learn, measures, network, spectral, stats


def graph(n, pairs):
    w = np.zeros((n, n))
    for i, j, *x in pairs:
        w[i, j] = w[j, i] = x[0] if x else 1
    return w


def unit_lengths(w):
    d = np.where(w > 0, 1.0, np.inf)
    np.fill_diagonal(d, 0)
    return d


def _graph(seed):
    u = np.triu(np.random.default_rng(seed).integers(0, 4, (7, 7)), 1)
    return (u + u.T).astype(float)


def one(f):
    """A kernel of stacks on a single graph."""
    return lambda w: f(w[None])[0]


random_graph = st.integers(0, 10**6).map(_graph)


def test_complete_graph():
    w = 3.0 * (np.ones((6, 6)) - np.eye(6))
    assert one(kernels.betweenness)(unit_lengths(w)) == pytest.approx(0)
    d = kernels.floyd_warshall(kernels.lengths_of(w))
    assert d[0, 1] == pytest.approx(1 / 3)
    assert (one(kernels.ricci_curvature)(w) > 0).all()


def test_star():
    w = graph(6, [(0, k) for k in range(1, 6)])
    assert one(kernels.betweenness)(unit_lengths(w)).tolist() == pytest.approx([20, 0, 0, 0, 0, 0])
    assert one(kernels.local_efficiency)(w) == pytest.approx(0)


def test_two_cliques_and_a_bridge():
    w = graph(8, [*itertools.combinations(range(4), 2), *itertools.combinations(range(4, 8), 2), (3, 4)])
    label, q = kernels.louvain(w)
    assert len(set(label[:4])) == len(set(label[4:])) == 1 and label[0] != label[7] and q > 0.3
    b = one(kernels.betweenness)(unit_lengths(w))
    assert b[3] == b[4] == max(b)


@settings(max_examples=30, deadline=None)
@given(random_graph)
def test_betweenness_counts_paths(w):
    """Against enumeration of all shortest paths."""
    n = len(w)
    d = kernels.floyd_warshall(unit_lengths(w))
    want = np.zeros(n)
    for s, t in itertools.permutations(range(n), 2):
        if not np.isfinite(d[s, t]):
            continue
        paths = [[s]]
        while paths[0][-1] != t:
            paths = [p + [v] for p in paths for v in range(n) if w[p[-1], v] and d[v, t] == d[p[-1], t] - 1]
        for p in paths:
            for v in p[1:-1]:
                want[v] += 1 / len(paths)
    assert one(kernels.betweenness)(unit_lengths(w)) == pytest.approx(want)


@settings(max_examples=30, deadline=None)
@given(random_graph, st.integers(0, 100))
def test_relabelling_nodes_permutes_results(w, seed):
    order = np.random.default_rng(seed).permutation(len(w))
    moved = w[np.ix_(order, order)]
    for f in (one(kernels.local_efficiency), one(kernels.ricci_curvature), lambda x: one(kernels.betweenness)(unit_lengths(x))):
        assert f(moved) == pytest.approx(f(w)[order], abs=1e-9)


@settings(max_examples=30, deadline=None)
@given(random_graph)
def test_louvain_reports_its_own_modularity(w):
    label, q = kernels.louvain(w)
    if w.sum():
        same = label[:, None] == label[None, :]
        k = w.sum(axis=1)
        assert q == pytest.approx(((w - np.outer(k, k) / w.sum()) * same).sum() / w.sum())
        alone = -((k / w.sum()) ** 2).sum()
        assert q >= alone - 1e-12


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.integers(0, 1000))
def test_transport_equals_a_brute_force(n, m, seed):
    rng = np.random.default_rng(seed)
    size = n * m
    a, b = np.full(n, 1 / n), np.full(m, 1 / m)
    cost = rng.random((n, m))
    left, right = np.repeat(np.arange(n), m), np.repeat(np.arange(m), n)
    if size <= 6:
        want = min(cost[left, list(p)].sum() / size for p in itertools.permutations(right))
        assert kernels.transport(a[None], b[None], cost[None])[0] == pytest.approx(want)
    assert kernels.transport(a[None], b[None], cost[None])[0] >= cost.min() - 1e-12


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 9))
def test_stacks_equal_single_graphs(seed, n):
    """Isolated nodes, graphs in pieces and without edges; and many transport problems of different sizes at once."""
    rng = np.random.default_rng(seed)
    w = np.triu(rng.integers(1, 9, (6, n, n)) * (rng.random((6, n, n)) < rng.random((6, 1, 1))), 1).astype(float)
    w += w.swapaxes(1, 2)
    for stacked, plain in (
        (kernels.local_efficiency, plain_kernels.local_efficiency), (kernels.ricci_curvature, plain_kernels.ricci_curvature), (lambda x: kernels.betweenness(kernels.lengths_of(x)), lambda x: plain_kernels.betweenness(plain_kernels.lengths_of(x))),
    ):
        assert np.allclose(stacked(w), np.stack([plain(x) for x in w]), atol=1e-9)
    sizes = rng.integers(1, 6, (8, 2))
    supply, demand, cost = np.zeros((8, 5)), np.zeros((8, 5)), rng.random((8, 5, 5))
    for k, (a, b) in enumerate(sizes):
        supply[k, :a], demand[k, :b] = rng.dirichlet(np.ones(a)), rng.dirichlet(np.ones(b))
    want = [plain_kernels.transport(supply[k, :a], demand[k, :b], cost[k, :a, :b]) for k, (a, b) in enumerate(sizes)]
    assert np.allclose(kernels.transport(supply, demand, cost), want, atol=1e-9)


def test_feature_vectors_equal_the_single_measures(spark):
    """Two measures of each graph and seven blocks of nodes, against each measure's own plan."""
    rng, n = np.random.default_rng(4), 7
    graphs = {s: _graph(int(rng.integers(10**6))) for s in range(12)}
    edges = spark.createDataFrame([(s, i + 1, j + 1, float(w[i, j])) for s, w in graphs.items() for i, j in itertools.combinations(range(n), 2) if w[i, j]], "subject long, i int, j int, w double").persist()
    nodes = spark.range(1, n + 1).selectExpr("cast(id as int) as node")
    names = kernels.feature_names(n)
    got = {r.subject: {names[k]: v for k, v in zip(r.at, r.value)} for r in kernels.measure_vectors(edges, n).collect()}
    assert len(names) == 2 + 7 * n and got.keys() == {r.subject for r in edges.select("subject").distinct().collect()}
    labels = kernels.node_measures(edges, n, ("community",)).selectExpr("subject", "node", "cast(value as int) as ci")
    d = kernels.distances(edges, n)
    single = {
        "clustering": measures.clustering(edges, nodes), "degree": measures.degree(edges, nodes), "neighbour_degree": measures.neighbour_degree(edges, nodes), "participation": measures.participation(edges, labels, nodes),
    } | {m: kernels.node_measures(edges, n, (m,)).withColumnRenamed("value", m) for m in ("local_efficiency", "betweenness", "curvature")}
    for m, df in single.items():
        for r in df.collect():
            assert got[r.subject].get(f"{m}_{r.node}", 0.0) == pytest.approx(r[m] or 0.0, abs=1e-9), m
    for m, df in {"path_length": measures.path_length(d, n, include_diagonal=True, include_infinite=False), "global_efficiency": measures.efficiency(d, n)}.items():
        for r in df.collect():
            assert got[r.subject][m] == pytest.approx(r[1])
    entries = learn.vector_entries(kernels.measure_vectors(edges, n), names).collect()
    assert {(r.subject, r.feature): r.value for r in entries} == {(s, names[k]): got[s].get(names[k], 0.0) for s in got for k in range(len(names))}


def test_distribution_tails():
    assert dist.t_two_sided(2.0, 10) == pytest.approx(0.0733880, abs=1e-6)
    assert dist.f_sf(3.0, 4, 20) == pytest.approx(0.0432, abs=2e-4)
    assert dist.chi2_sf(5.991, 2) == pytest.approx(0.05, abs=1e-4)
    assert dist.chi2_sf(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert dist.normal_quantile(np.array([0.975]))[0] == pytest.approx(1.959964, abs=1e-6)


def test_shapiro_tells_normal_from_skewed():
    rng = np.random.default_rng(1)
    assert stats.shapiro_wilk(rng.normal(size=200))[1] > 0.05
    assert stats.shapiro_wilk(rng.exponential(size=200))[1] < 1e-6


def test_frechet_distance_of_equal_matrices_is_zero():
    a = np.array([[2.0, 0.5], [0.5, 1.0]])
    assert spectral.frechet_distance(a, a) == pytest.approx(0, abs=1e-9)
    assert spectral.frechet_distance(np.eye(2), 4 * np.eye(2)) == pytest.approx(2)


@settings(max_examples=30, deadline=None)
@given(random_graph)
def test_threshold_free_scores_by_definition(w):
    i, j = np.nonzero(np.triu(w))
    stat = w[i, j] + np.arange(len(i)) / 100
    h = np.linspace(0.5, 3, 6)
    want = np.zeros(len(i))
    for level in h:
        on = np.flatnonzero(stat > level)
        label = network._labels(i[on], j[on], len(w))
        for k in on:
            want[k] += (label[i[on]] == label[i[k]]).sum() ** 0.5 * level**3
    assert network._scores(stat, i, j, h, 0.5, 3.0) == pytest.approx(want)


@settings(max_examples=30, deadline=None)
@given(random_graph)
def test_labels_are_reachability(w):
    i, j = np.nonzero(np.triu(w))
    reach = np.linalg.matrix_power((w > 0) + np.eye(len(w)), len(w)) > 0
    assert network._labels(i, j, len(w)).tolist() == [int(np.flatnonzero(r)[0]) for r in reach]


def test_components_of_many_graphs(spark):
    rng = np.random.default_rng(2)
    rows = [(g, int(i), int(j)) for g in range(40) for i, j in rng.integers(0, 30, (20, 2)) if i < j]
    rows = list(dict.fromkeys(rows))
    got = {(r.g, r.i, r.j): (r.component, r.size) for r in network.components(spark.createDataFrame(rows, "g long, i int, j int"), ["g"]).collect()}
    for g in range(40):
        own = [(i, j) for x, i, j in rows if x == g]
        label = network._labels(np.array([i for i, _ in own], int), np.array([j for _, j in own], int), 30)
        assert all(got[g, i, j] == (label[i], sum(label[a] == label[i] for a, _ in own)) for i, j in own)


def test_nbs_by_definition(spark):
    rng = np.random.default_rng(3)
    stat = rng.normal(1, 1, (51, 10, 10))
    pairs = list(itertools.combinations(range(10), 2))
    rows = [(p, i, j, float(stat[p, i, j])) for p in range(51) for i, j in pairs]
    got = {(r.threshold, r.component): (r.size, r.p) for r in network.nbs(spark.createDataFrame(rows, "perm int, i int, j int, stat double"), [1.5, 2.0], 50).collect()}

    def sizes(p, t):
        on = [(i, j) for i, j in pairs if stat[p, i, j] > t]
        label = network._labels(np.array([i for i, _ in on], int), np.array([j for _, j in on], int), 10)
        return {int(c): sum(label[i] == c for i, _ in on) for c in {label[i] for i, _ in on}}

    for t in (1.5, 2.0):
        null = [max(sizes(p, t).values(), default=0) for p in range(1, 51)]
        want = {(t, c): (n, pytest.approx(sum(x >= n for x in null) / 50)) for c, n in sizes(0, t).items()}
        assert {k: v for k, v in got.items() if k[0] == t} == want


def test_threshold_free_test_by_definition(spark):
    rng = np.random.default_rng(5)
    pairs = [(i + 1, j + 1) for i, j in itertools.combinations(range(6), 2)]
    stat = rng.exponential(1, (31, len(pairs)))
    rows = [(p, i, j, float(stat[p, k])) for p in range(31) for k, (i, j) in enumerate(pairs)]
    got = {(r.i, r.j): r for r in network.threshold_free_test(spark.createDataFrame(rows, "perm int, i int, j int, stat double"), 6, 30, 20).collect()}
    i, j = np.array(pairs).T
    scores = []
    for x in stat:
        full = np.zeros((7, 7))
        full[i, j] = full[j, i] = x
        hi = np.percentile(full[1:, 1:], 99.5)
        scores.append(network._scores(x, i, j, x.min() + np.arange(20) * (hi - x.min()) / 20, 0.5, 2.75))
    scores = np.array(scores)
    for k, pair in enumerate(pairs):
        assert (got[pair].score, got[pair].p) == pytest.approx((scores[0, k], (scores[1:, k] >= scores[0, k]).mean()))
        assert got[pair].t_max == pytest.approx(np.sort(scores[1:].max(axis=1))[::-1][1])
    masks = network.threshold_free_masks(spark.createDataFrame([(1, 2, 5.0, 0.02, 4.0), (1, 3, 3.0, 0.0, 4.0), (1, 4, 3.0, 0.2, 4.0)], "i int, j int, score double, p double, t_max double")).collect()
    assert [tuple(r) for r in masks] == [(1, 2, 1, 0.98), (1, 3, 0, 0.0), (1, 4, 0, 0.0)]


def test_benjamini_hochberg_by_definition(spark):
    rng = np.random.default_rng(6)
    p = np.round(rng.random(300) ** 3, 3)
    got = {r.k: r.q for r in stats.benjamini_hochberg(spark.createDataFrame([(k, float(x)) for k, x in enumerate(p)], "k int, p double")).collect()}
    order = np.argsort(p, kind="stable")
    q = np.minimum.accumulate((p[order] * 300 / np.arange(1, 301))[::-1])[::-1]
    assert [got[k] for k in order.tolist()] == pytest.approx(np.minimum(q, 1).tolist())


def _logs(spark, seed=7, subjects=12, n=3):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(subjects, n, n))
    m = m + m.swapaxes(1, 2)
    m[:5] += 2
    rows = [(s, i + 1, j + 1, float(m[s, i, j])) for s in range(subjects) for i in range(n) for j in range(n)]
    groups = [(s, "patient" if s < 5 else "control") for s in range(subjects)]
    return m, spark.createDataFrame(rows, "subject long, i int, j int, v double"), spark.createDataFrame(groups, "subject long, cohort string")


def expm(m):
    values, vectors = np.linalg.eigh(m)
    return (vectors * np.exp(values)) @ vectors.T


def test_permuted_frechet_means(spark):
    m, logs, groups = _logs(spark)
    every = spectral.mean_permutations(logs, groups, 3, 40, 1).collect()
    obs = {(r.i, r.j): r.difference for r in every if r.perm == 0}
    want = np.abs(expm(m[:5].mean(axis=0)) - expm(m[5:].mean(axis=0)))
    assert [obs[i + 1, j + 1] for i in range(3) for j in range(3)] == pytest.approx(want.ravel().tolist())
    splits = {tuple(np.round(np.abs(expm(m[list(a)].mean(axis=0)) - expm(np.delete(m, a, axis=0).mean(axis=0))).ravel(), 6)) for a in itertools.combinations(range(12), 5)}
    for p in range(41):
        x = sorted((r.i, r.j, r.difference) for r in every if r.perm == p)
        assert tuple(np.round([v for *_, v in x], 6)) in splits, "each permutation is a split of the subjects into 5 and 7"
    test = {(r.i, r.j): r.p for r in spectral.mean_permutation_test(logs, groups, 3, 40, 1).collect()}
    assert test == {k: pytest.approx(sum(r.difference >= v for r in every if r.perm and (r.i, r.j) == k) / 40) for k, v in obs.items()}


def test_resampled_counts_find_a_planted_difference(spark):
    m, logs, groups = _logs(spark)
    far = logs.withColumn("v", stats.F.when(stats.F.expr("subject < 5 and i = 1 and j = 2 or subject < 5 and i = 2 and j = 1"), stats.F.col("v") + 4).otherwise(stats.F.col("v")))
    draws = spectral.resamples(groups, 10, 5, 7)
    assert draws.groupBy("draw", "cohort").count().select("cohort", "count").distinct().collect().__len__() == 2
    got = {(r.i, r.j): r.n for r in spectral.resampled_counts(far, draws, 3, 50, 0.05).collect()}
    assert got[1, 1] == got[2, 2] == got[3, 3] == 0 and got[1, 2] == got[2, 1] > 5


def test_path_length_switches(spark):
    from cohortgraph.operators import measures

    d = spark.createDataFrame([(1, 1, 2, 1.0), (1, 2, 1, 1.0), (1, 1, 3, 2.0), (1, 3, 1, 2.0), (1, 2, 3, 1.0), (1, 3, 2, 1.0), (2, 1, 2, 4.0), (2, 2, 1, 4.0)], "subject long, i int, j int, d double")
    of = lambda **how: {r.subject: r.path_length for r in measures.path_length(d, 3, **how).collect()}
    assert of() == {1: pytest.approx(8 / 6), 2: float("inf")}
    assert of(include_infinite=False) == {1: pytest.approx(8 / 6), 2: 4.0}
    assert of(include_infinite=False, include_diagonal=True) == {1: pytest.approx(8 / 9), 2: pytest.approx(8 / 5)}


def test_marked_nodes_and_atlas(spark):
    from cohortgraph.operators import edges

    tests = spark.createDataFrame([(1, 0.01), (2, 0.05), (3, None), (4, float("nan"))], "node int, p double")
    marked = edges.marked_nodes(tests, 0.05)
    assert {r.node: r.marked for r in marked.collect()} == {1: True, 2: False, 3: False, 4: False}
    atlas = spark.createDataFrame([(1, 1.0, 2.0, 3.0), (2, 4.0, 5.0, 6.0)], "node int, x double, y double, z double")
    assert sorted(tuple(r) for r in edges.marked_atlas(atlas, marked).collect()) == [(1, 1.0, 2.0, 3.0), (2, 0.0, 0.0, 0.0)]


@pytest.mark.parametrize("block_bytes", [1 << 23, 16 * 25 * 4])
def test_frechet_pairs_equal_a_loop(spark, monkeypatch, block_bytes):
    """Thirty subjects, in blocks of at most four and of four by bytes; every unordered pair once."""
    monkeypatch.setattr(spectral, "BLOCK_BYTES", block_bytes)
    rng, n = np.random.default_rng(6), 5
    made = {int(s): (lambda x: x @ x.T + 0.1 * np.eye(n))(rng.normal(size=(n, n))) for s in rng.permutation(30) * 7}
    rows = [(s, i + 1, j + 1, float(m[i, j])) for s, m in made.items() for i in range(n) for j in range(n)]
    groups = spark.createDataFrame([(s, "patient" if s % 2 else "control") for s in made], "subject long, cohort string")
    got = {(r.a, r.b): (r.pair_class, r.distance) for r in spectral.frechet_pairs(spark.createDataFrame(rows, "subject long, i int, j int, v double"), groups, n).collect()}
    want = {(a, b): ("-".join(sorted("patient" if s % 2 else "control" for s in (a, b))), pytest.approx(spectral.frechet_distance(made[a], made[b]), abs=1e-9)) for a, b in itertools.combinations(sorted(made), 2)}
    assert got == want


def test_stacked_distances_and_levels_equal_single_graphs(spark):
    rng = np.random.default_rng(9)
    graphs = {s: _graph(int(rng.integers(10**6))) for s in range(30)}
    rows = [(s, i + 1, j + 1, float(w[i, j])) for s, w in graphs.items() for i, j in itertools.combinations(range(7), 2) if w[i, j]]
    edges = spark.createDataFrame(rows, "subject long, i int, j int, w double")
    for weighted in (True, False):
        got = {(r.subject, r.i, r.j): r.d for r in kernels.distances(edges, 7, weighted).collect()}
        for s, w in graphs.items():
            d = kernels.floyd_warshall(kernels.lengths_of(w if weighted else (w > 0).astype(float)))
            assert {(i + 1, j + 1): pytest.approx(d[i, j]) for i in range(7) for j in range(7) if i != j and np.isfinite(d[i, j])} == {k[1:]: v for k, v in got.items() if k[0] == s}
    levels = kernels.community_levels(edges, 7).collect()
    for s, w in graphs.items():
        if not w.any():
            continue
        import zlib

        last = max(r.level for r in levels if r.subject == s)
        label = {r.node: r.community for r in levels if r.subject == s and r.level == last}
        want, q = kernels.louvain(w, seed=zlib.crc32(str(s).encode()))
        assert [label[v + 1] for v in range(7)] == (want + 1).tolist()
        qs = [next(r.q for r in levels if r.subject == s and r.level == k) for k in range(1, last + 1)]
        assert qs == sorted(qs) and qs[-1] == pytest.approx(q)


def _dense_graphs(count, n=25, seed=11):
    rng = np.random.default_rng(seed)
    w = np.triu(rng.integers(1, 9, (count, n, n)) * (rng.random((count, n, n)) < 0.6), 1).astype(float)
    return w + w.swapaxes(1, 2)


def test_large_transport_problems_equal_plain_ones():
    """More nodes than bits of a word, ties in cost, places with nothing."""
    rng = np.random.default_rng(12)
    for n, m in ((45, 40), (31, 33), (1, 7), (7, 1)):
        supply, demand, cost = rng.dirichlet(np.ones(n), 4), rng.dirichlet(np.ones(m), 4), rng.integers(0, 5, (4, n, m)).astype(float)
        supply[0, 1:], supply[0, 0] = 0, 1
        assert kernels.transport(supply, demand, cost) == pytest.approx([plain_kernels.transport(*x) for x in zip(supply, demand, cost)], abs=1e-9)
    with pytest.raises(ValueError):
        kernels.transport(np.ones((1, 2)), np.ones((1, 3)), np.ones((1, 2, 3)))


def test_curvature_of_many_graphs_takes_a_small_part_of_one_at_a_time():
    """CPU seconds a graph of 25 nodes, against the plain version on the same machine; a sixth of it before."""
    w = _dense_graphs(160)
    start = time.process_time()
    want = [plain_kernels.ricci_curvature(x) for x in w[:4]]
    plain = (time.process_time() - start) / 4
    kernels.ricci_curvature(w[:16])
    start = time.process_time()
    got = kernels.ricci_curvature(w)
    assert np.allclose(got[:4], want, atol=1e-9)
    assert (time.process_time() - start) / len(w) < plain / 20


def test_tasks_and_stacks_follow_the_work(spark):
    """Graphs of few edges still go to several tasks a core, and small batches are put together to whole stacks."""
    rows = [(s, i + 1, j + 1, float(w[i, j])) for s, w in enumerate(_dense_graphs(40, 6)) for i, j in itertools.combinations(range(6), 2) if w[i, j]]
    edges = spark.createDataFrame(rows, "subject long, i int, j int, w double")
    assert kernels.node_measures(edges, 6, ("curvature",)).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    pdf = edges.orderBy("subject").toPandas()
    got = list(kernels.stacks((pdf.iloc[lo : lo + 50] for lo in range(0, len(pdf), 50)), 6))
    assert [s.tolist() for s, _ in got] == [sorted(set(pdf["subject"]))]
    assert (got[0][1] == _dense_graphs(40, 6)).all()


def test_louvain_of_a_stack_equals_single_graphs():
    w = np.concatenate([_dense_graphs(30, 9), np.zeros((1, 9, 9))])
    w[:15] *= np.kron(np.eye(3), np.ones((3, 3)))
    assert (kernels.louvain_stack(w, range(31)) == [kernels.louvain(x, seed=s)[0] for s, x in enumerate(w)]).all()


def test_logarithms_are_worked_out_once(spark):
    """Numbers of entries, sums, whole sums and both sides of the test read one checkpoint."""
    _, logs, groups = _logs(spark)
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    test = spectral.mean_permutation_test(logs.mapInPandas(count, logs.schema), groups, 3, 40, 1)
    assert len(test.collect()) == 9 and seen.value == 12 * 9
