import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortgraph.functions import shuffles
from cohortgraph.operators import resample, stats


@pytest.mark.parametrize("n", [1, 2, 5, 64, 1000])
def test_places_are_permutations(n):
    got = shuffles.places(n, np.arange(n), np.arange(50), 3)
    assert (np.sort(got, axis=1) == np.arange(n)).all()
    some = np.arange(0, n, 3)
    assert (shuffles.places(n, some, np.arange(50), 3) == got[:, some]).all(), "a place depends on nothing but itself"


def test_places_are_even():
    got = shuffles.places(10, np.arange(10), np.arange(20_000), 1)
    share = np.stack([(got == k).mean(axis=0) for k in range(10)])
    assert abs(share - 0.1).max() < 0.01
    pairs = ((got[:, 0] < 5) & (got[:, 1] < 5)).mean()
    assert pairs == pytest.approx(0.5 * 4 / 9, abs=0.015)


@pytest.fixture(scope="module")
def cohort():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(23, 3)) * (rng.random((23, 3)) < 0.7)
    x[:9, 1] += 2.5
    return x, np.arange(23) < 9


def frames(spark, x, in_a):
    rows = [(s, v, float(x[s, v])) for s in range(len(x)) for v in range(x.shape[1]) if x[s, v]]
    subjects = [(s, "patient" if a else "control") for s, a in enumerate(in_a.tolist())]
    return spark.createDataFrame(rows, "subject long, node int, value double"), spark.createDataFrame(subjects, "subject long, cohort string")


def welch_of(x, a):
    va, vb = x[a].var(axis=0, ddof=1) / a.sum(), x[~a].var(axis=0, ddof=1) / (~a).sum()
    return (x[a].mean(axis=0) - x[~a].mean(axis=0)) / np.sqrt(va + vb)


def places_of(spark, subjects):
    """Places as the operator deals them: group a first, each numbered."""
    sides = [resample.numbered(subjects.where(F.col("cohort") == c), ["subject"], "k").orderBy("k").collect() for c in ("patient", "control")]
    assert [[r.k for r in s] for s in sides] == [list(range(len(s))) for s in sides]
    return [r.subject for s in sides for r in s]


@pytest.mark.parametrize("blocks", [(2048, 512, 500), (4, 2, 7)])
def test_statistics_equal_plain_permutations(spark, cohort, monkeypatch, blocks):
    for name, size in zip(("SUBJECTS", "VARIABLES", "PERMS"), blocks):
        monkeypatch.setattr(resample, name, size)
    x, in_a = cohort
    rows, subjects = frames(spark, x, in_a)
    got = {(r.perm, r.node): r.stat for r in resample.permuted(rows, subjects, ["node"], 20, seed=5).collect()}
    order = places_of(spark, subjects)
    at = shuffles.places(23, np.arange(23), np.arange(1, 21), 5)
    for p in range(21):
        a = in_a.copy()
        if p:
            a = np.zeros(23, bool)
            a[[order[k] for k in np.flatnonzero(at[p - 1] < 9)]] = True
        assert [got[p, v] for v in range(3)] == pytest.approx(welch_of(x, a).tolist())
    assert len(got) == 21 * 3


def test_p_values_by_definition(spark, cohort):
    x, in_a = cohort
    rows, subjects = frames(spark, x, in_a)
    t = resample.permuted(rows, subjects, ["node"], 200, seed=1)
    table = np.zeros((201, 3))
    for r in t.collect():
        table[r.perm, r.node] = r.stat
    for tail, f in (("both", np.abs), ("right", lambda z: z), ("left", lambda z: -z)):
        far = f(table)
        got = {r.node: (r.p, r.p_max) for r in resample.p_values(t, ["node"], 200, tail).collect()}
        for v in range(3):
            assert got[v] == pytest.approx(((far[1:, v] >= far[0, v]).mean(), (far[1:].max(axis=1) >= far[0, v]).mean()))
    assert resample.critical(t, 0.05, 200).first().t_max == pytest.approx(np.sort(np.abs(table[1:]).max(axis=1))[::-1][10])
    with pytest.raises(stats.MethodError):
        resample.p_values(t, ["node"], 200, "middle")


def test_counts_in_blocks_give_the_same_p_values(spark, cohort):
    """Three blocks of permutations; only counts and furthest values leave the tasks."""
    x, in_a = cohort
    rows, subjects = frames(spark, np.round(x), in_a)
    t = resample.permuted(rows, subjects, ["node"], 1200, seed=1).persist()
    for tail in ("both", "right", "left"):
        want = {r.node: tuple(r) for r in resample.p_values(t, ["node"], 1200, tail).collect()}
        p, maxima = resample.tested(rows, subjects, ["node"], 1200, tail=tail, seed=1)
        assert {r.node: tuple(r) for r in p.collect()} == {k: pytest.approx(v) for k, v in want.items()} and len(maxima) == 1200
    p, maxima = resample.tested(rows, subjects, ["node"], 200, seed=1)
    assert maxima[::-1][10] == pytest.approx(resample.critical(t.where("perm <= 200"), 0.05, 200).first().t_max)
    plan = p._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    with pytest.raises(stats.MethodError):
        resample.tested(rows, subjects, ["node"], 200, tail="middle")


def test_bootstrap_keeps_group_sizes(cohort):
    x, in_a = cohort
    a, b = resample._weights(np.arange(23), in_a, np.arange(1, 400), 23, 9, 2, True)
    assert (a.sum(axis=1) == 9).all() and (b.sum(axis=1) == 14).all()
    whole = a + b
    assert (whole[:, :9].sum(axis=1) == 9).all() and (whole[:, 9:].sum(axis=1) == 14).all(), "each cohort is drawn from itself"
    assert ((a > 0) & (b > 0)).any(), "copies of a subject part ways"
    halves = [resample._weights(np.arange(lo, hi), in_a[lo:hi], np.arange(1, 400), 23, 9, 2, True)[0] for lo, hi in ((0, 10), (10, 23))]
    assert (np.concatenate(halves, axis=1) == a).all()


@pytest.mark.parametrize("size", [3, 8, 64])
def test_bootstrap_blocks_follow_the_law(size):
    """Exact group sizes over any blocks; each subject's copies and their part in group a have the means, variances and covariances
    of drawing with replacement and shuffling."""
    n, na, rounds = 20, 8, 20_000
    blocks = [shuffles.bootstrap_block(n, na, size, leaf, rounds, 3, 5) for leaf in range(-(-n // size))]
    copies, first = (np.concatenate([b[k] for b in blocks], axis=1) for k in (0, 1))
    assert (copies[:, :na].sum(axis=1) == na).all() and (copies[:, na:].sum(axis=1) == n - na).all() and (first.sum(axis=1) == na).all()
    assert (first <= copies).all() and (first >= 0).all()
    for own in (slice(0, na), slice(na, n)):
        k = own.stop - own.start
        assert np.allclose(copies[:, own].mean(axis=0), 1, atol=0.04) and np.allclose(copies[:, own].var(axis=0), 1 - 1 / k, atol=0.06)
        cov = np.cov(copies[:, own].T)[~np.eye(k, dtype=bool)]
        assert np.allclose(cov, -1 / k, atol=0.05)
    assert np.allclose(first.mean(axis=0), na / n, atol=0.03)
    # A copy is in group a with chance na / n, two copies both with na (na - 1) / (n (n - 1)).
    two = na * (na - 1) / (n * (n - 1))
    assert (first * (first - 1)).mean() == pytest.approx((copies * (copies - 1)).mean() * two, rel=0.06)
    assert (first[:, :1] * first[:, 1:na]).mean() == pytest.approx((1 - 1 / na) * two, rel=0.06)
    assert (first[:, :1] * first[:, na:]).mean() == pytest.approx(two, rel=0.06)


def test_rank_sums_equal_mann_whitney(spark, cohort):
    x, in_a = cohort
    x = np.abs(x).round(1)
    rows, subjects = frames(spark, x, in_a)
    ranks = resample.centred_ranks(rows, subjects, ["node"])
    got = {r.node: r.stat for r in resample.permuted(ranks, subjects, ["node"], 1, resample.rank_sum_z).where("perm = 0").collect()}
    dense = spark.createDataFrame([(s, v, "patient" if in_a[s] else "control", float(x[s, v])) for s in range(23) for v in range(3)], "subject long, node int, cohort string, value double")
    want = {r.node: r.u1 - 9 * 14 / 2 for r in stats.mann_whitney(dense, ["node"]).collect()}
    assert got == pytest.approx(want)


def test_sums_leave_in_a_bounded_number_of_pieces(spark, cohort, monkeypatch):
    """23 blocks of subjects in four pieces: as many rows of sums as pieces, whatever the number of subjects."""
    monkeypatch.setattr(resample, "SUBJECTS", 1)
    monkeypatch.setattr(resample, "PIECES", 4)
    x, in_a = cohort
    rows, subjects = frames(spark, x, in_a)
    held = resample.block_sums(rows, subjects, ["node"], 20, seed=5)
    assert held.blocks.count() == 4
    got = {(r.perm, r.node): r.stat for r in resample.permuted(rows, subjects, ["node"], 20, seed=5).collect()}
    monkeypatch.undo()
    assert got == pytest.approx({(r.perm, r.node): r.stat for r in resample.permuted(rows, subjects, ["node"], 20, seed=5).collect()})


def test_values_are_worked_out_once(spark, cohort):
    """Observed statistics, numbers of variables and sums all read one checkpoint. A node without values has its row."""
    x, in_a = cohort
    rows, subjects = frames(spark, x, in_a)
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    given = rows.union(spark.createDataFrame([(0, 7, 0.0)], rows.schema))
    p, _ = resample.tested(given.mapInPandas(count, rows.schema), subjects, ["node"], 20, seed=5)
    assert {r.node: r.p for r in p.collect()}.keys() == {0, 1, 2, 7} and seen.value == given.count()
