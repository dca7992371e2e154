import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from cohortgraph.operators import learn


def long_features(spark, n=60, seed=1):
    """Features 1 and 2 tell the labels apart, the others are noise."""
    rng = np.random.default_rng(seed)
    label = np.arange(n) % 2
    x = rng.normal(size=(n, 6))
    x[:, 1] += 6 * label
    x[:, 2] -= 5 * label
    rows = [(s, int(label[s]), f, float(x[s, f])) for s in range(n) for f in range(6)]
    return spark.createDataFrame(rows, "subject long, label int, feature int, value double")


def test_svm_per_split_finds_the_telling_features(spark):
    features = long_features(spark)
    splits = learn.shuffle_splits(features.select("subject").distinct(), 3, 0.2)
    results, chosen = learn.svm_per_split(features, splits, 2)
    assert {r.split: r.accuracy for r in results.collect()} == {0: 1.0, 1: 1.0, 2: 1.0}
    assert {(r.split, r.rank, r.feature) for r in chosen.collect()} == {(s, k, f) for s in range(3) for k, f in ((1, 1), (2, 2))}
    union = learn.best_split_features(results, chosen)
    assert sorted((r.feature, r.first.split, r.first.rank) for r in union.collect()) == [(1, 0, 1), (2, 0, 2)]
    assert learn.svm_mean_accuracy(features, splits, union).first().accuracy == 1.0


def test_only_the_best_splits_count(spark):
    results = spark.createDataFrame([(0, 0.5), (1, 1.0), (2, 1.0)], "split int, accuracy double")
    chosen = spark.createDataFrame([(0, 9, 1), (1, 4, 1), (1, 5, 2), (2, 5, 1), (2, 6, 2)], "split int, feature int, rank int")
    assert sorted((r.feature, tuple(r.first)) for r in learn.best_split_features(results, chosen).collect()) == [(4, (1, 1)), (5, (1, 2)), (6, (2, 2))]


def test_nearest_neighbours_in_any_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x, label = rng.integers(0, 4, (90, 3)).astype(float), rng.integers(0, 3, 90)
    train = spark.createDataFrame([(i, int(label[i]), x[i].tolist()) for i in range(90)], "id long, label int, vector array<double>")
    want = {}
    for q in range(0, 90, 7):
        near = sorted((((x[q] - x[i]) ** 2).sum(), i) for i in range(90) if i != q)[:5]
        votes = np.bincount([label[i] for _, i in near])
        want[q] = int(votes.argmax())
    for rows, asks in ((8192, 4096), (20, 4)):
        monkeypatch.setattr(learn, "TRAIN_ROWS", rows)
        monkeypatch.setattr(learn, "QUERY_ROWS", asks)
        assert {r.id: r.predicted for r in learn.knn(train, train.where("id % 7 = 0"), 5).collect()} == want


def test_boosted_stumps_learn_what_one_stump_cannot(spark):
    rows = [(float(1 <= k % 3 < 2), Vectors.dense([float(k % 3)])) for k in range(60)]
    data = spark.createDataFrame(rows, ["label", "features"])
    predicted = learn.boosted_stumps(data, 8)(data)
    assert predicted.where("predicted = label").count() == 60
    assert learn.hard_auc(predicted).first().auc == pytest.approx(1.0)


def test_svms_of_all_splits_equal_single_ones(spark):
    """Noisy labels, different features and train parts for each split; against long gradient descents on the same loss."""
    rng, n = np.random.default_rng(3), 120
    x = rng.normal(size=(n, 5)) * [1, 5, 0.1, 2, 1]
    y = (x[:, 0] + x[:, 1] / 5 + rng.normal(size=n) > 0).astype(int)
    features = spark.createDataFrame([(s, int(y[s]), f, float(x[s, f])) for s in range(n) for f in range(5)], "subject long, label int, feature int, value double")
    part = rng.random((3, n)) < 0.3
    splits = spark.createDataFrame([(k, s, "test" if part[k, s] else "train") for k in range(3) for s in range(n)], "split int, subject long, part string")
    own = {0: [0, 1], 1: [0, 2, 3], 2: [0, 1, 2, 3, 4]}
    chosen = spark.createDataFrame([(k, f) for k, fs in own.items() for f in fs], "split int, feature int")
    got = {r.split: r.accuracy for r in learn.svm_accuracy(features, splits, chosen).collect()}
    for k, fs in own.items():
        z = np.column_stack((x[:, fs] / x[~part[k]][:, fs].std(axis=0), np.ones(n)))
        t, sign = z[~part[k]], 2 * y[~part[k]] - 1
        ridge, w = np.array([0.01] * len(fs) + [1e-9]), np.zeros(len(fs) + 1)
        for _ in range(20_000):
            slack = np.maximum(1 - sign * (t @ w), 0)
            w -= 0.05 * (-2 * (sign * slack) @ t / len(t) + ridge * w)
        assert got[k] == pytest.approx(((z[part[k]] @ w > 0) == y[part[k]]).mean())


def test_entries_of_vectors_take_labels_along(spark):
    """Nothing is joined row by row, and no entry is searched for: the work follows the entries."""
    names = [f"x{k}" for k in range(50)]
    rows = spark.range(30).selectExpr("id as subject", "cast(id % 2 as int) as label", "transform(sequence(0, 48, 2), x -> cast(x as int)) as at", "transform(sequence(0, 48, 2), x -> cast(x + 1 as double)) as value")
    every = learn.vector_entries(rows, names)
    got = {r.label: (r.n, r.s) for r in every.groupBy("label").agg(F.count("feature").alias("n"), F.sum("value").alias("s")).collect()}
    assert got == {c: (15 * 50, 15 * 625.0) for c in (0, 1)} and "element_at" not in every._jdf.queryExecution().toString()
    few = learn.vector_entries(rows.where("subject = 1"), names, zeros=False).collect()
    assert {(r.label, r.feature): r.value for r in few} == {(1, f"x{k}"): k + 1.0 for k in range(0, 50, 2)}


def test_cross_validation_in_few_parts_equals_sparks_own(spark, monkeypatch):
    """Rows in 40 partitions come to as many as their bytes fill; scores are those of Spark's CrossValidator."""
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator

    data = learn.wide(long_features(spark, 90, 5).withColumn("feature", F.col("feature").cast("string")), [str(k) for k in (0, 3, 1)]).repartition(40)
    assert learn.in_few_parts(data).rdd.getNumPartitions() == 1
    monkeypatch.setattr(learn, "FIT_BYTES", 90 * 24 // 3)
    assert learn.in_few_parts(data).rdd.getNumPartitions() == 3
    folds = learn.stratified_folds(data, 3)
    got = {(r.estimator, r.params): r.mean_score for r in learn.cross_validated(data, folds, ["naive_bayes"]).collect()}
    table = data.join(folds.select("subject", "fold"), "subject").withColumn("label", F.col("label").cast("double")).persist()
    for name in ("naive_bayes",):  # fits of the SVM take minutes
        model, grid = learn.estimators()[name]
        means = CrossValidator(estimator=model, estimatorParamMaps=grid, evaluator=MulticlassClassificationEvaluator(metricName="f1"), numFolds=3, foldCol="fold").fit(table).avgMetrics
        assert [got[name, ", ".join(sorted(f"{p.name}={v}" for p, v in params.items()))] for params in grid] == pytest.approx(means, abs=1e-6)
