"""Feature selection, splits and classification over features(subject, label, feature, value)."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortgraph.operators.lineage import checkpointed, placed


def wide(features: DataFrame, names: Sequence[str]) -> DataFrame:
    """(subject, label, features): one vector for each subject, in the order of names; absent values are 0."""
    from pyspark.ml.feature import VectorAssembler

    columns = [str(x) for x in names]
    table = features.groupBy("subject", "label").pivot("feature", list(names)).agg(F.first("value")).fillna(0.0, columns)
    return VectorAssembler(inputCols=columns, outputCol="features").transform(table).select("subject", "label", "features")


def vector_entries(vectors: DataFrame, names: Sequence[str], zeros: bool = True) -> DataFrame:
    """(subject, feature, value), with or without zeros, from sparse vectors (subject, at, value) over names; other columns come
    along. names are few: entries of one vector. A vector is filled up once, so the work follows its entries."""
    import numpy as np

    width, others = len(names), [c for c in vectors.columns if c not in ("at", "value")]

    @F.pandas_udf("array<double>")
    def filled(at: pd.Series, value: pd.Series) -> pd.Series:
        out = np.zeros((len(at), width))
        for row, k, v in zip(out, at, value):
            row[k] = v
        return pd.Series(list(out))

    if zeros:
        rows = vectors.select(*others, filled("at", "value").alias("v")).select(*others, F.posexplode("v").alias("k", "value"))
    else:
        rows = vectors.select(*others, F.explode(F.arrays_zip("at", "value")).alias("e")).select(*others, F.col("e.at").alias("k"), F.col("e.value").alias("value")).where("value <> 0")
    return rows.select(*others, F.get(F.array(*map(F.lit, names)), F.col("k")).alias("feature"), "value")


def fisher_scores(features: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, feature, score): between-class over within-class scatter, for labels 0 and 1; null where nothing varies within."""
    v, one = F.col("value"), F.col("label") == 1
    m = features.groupBy(*by, "feature").agg(
        F.avg(v).alias("m"), F.count_if(one).alias("n1"), F.count_if(~one).alias("n0"), F.avg(F.when(one, v)).alias("m1"), F.avg(F.when(~one, v)).alias("m0"),
        F.var_pop(F.when(one, v)).alias("v1"), F.var_pop(F.when(~one, v)).alias("v0"),
    )
    top = F.col("n1") * F.pow(F.col("m1") - F.col("m"), 2) + F.col("n0") * F.pow(F.col("m0") - F.col("m"), 2)
    return m.select(*by, "feature", F.try_divide(top, F.col("n1") * F.col("v1") + F.col("n0") * F.col("v0")).alias("score"))


def ranked(scores: DataFrame) -> DataFrame:
    """scores with rank from 1, best first, ties by feature."""
    return placed(scores, [], [F.desc_nulls_last("score"), "feature"]).withColumn("rank", (F.col("place") + 1).cast("int")).drop("place")


def top_features(scores: DataFrame, k: int = 20) -> DataFrame:
    return scores.orderBy(F.desc_nulls_last("score"), "feature").limit(k)


def shuffle_splits(subjects: DataFrame, splits: int = 10, test: float = 0.03) -> DataFrame:
    """(split, subject, part): independent random splits, by an MD5 of split and subject; the test part is rounded up."""
    drawn = subjects.select("subject", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))).alias("split"))
    order = drawn.withColumn("h", F.md5(F.concat_ws("|", "split", "subject")))
    part = F.when(F.col("place") < F.ceil(test * F.col("n")), "test").otherwise("train")
    return placed(order, ["split"], ["h", "subject"], total="n").select("split", "subject", part.alias("part"))


def stratified_folds(labelled: DataFrame, folds: int = 10) -> DataFrame:
    """(subject, label, fold): each label dealt over the folds in order of subject."""
    return placed(labelled.select("subject", "label"), ["label"], ["subject"]).select("subject", "label", (F.col("place") % folds).cast("int").alias("fold"))


def svm_per_split(features: DataFrame, splits: DataFrame, k: int = 20) -> tuple[DataFrame, DataFrame]:
    """results(split, accuracy) and chosen(split, feature, rank): in each split the k features of best Fisher score in the train
    part, and a linear SVM on them, judged on the test part. All splits are scored, fitted and judged together."""
    train = features.join(splits.where("part = 'train'").select("split", "subject"), "subject")
    best = Window.partitionBy("split").orderBy(F.desc_nulls_last("score"), "feature")
    chosen = checkpointed(fisher_scores(train, ["split"]).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("split", "feature", "rank"))
    return svm_accuracy(features, splits, chosen), chosen


def svm_mean_accuracy(features: DataFrame, splits: DataFrame, names: DataFrame) -> DataFrame:
    """(accuracy, n): mean accuracy over the splits of a linear SVM on the features named."""
    each = splits.select("split").distinct().crossJoin(names.select("feature").distinct())
    return svm_accuracy(features, splits, each).agg(F.avg("accuracy").alias("accuracy"), F.count("*").alias("n"))


def svm_accuracy(features: DataFrame, splits: DataFrame, chosen: DataFrame, penalty: float = 0.01, rounds: int = 40) -> DataFrame:
    """(split, accuracy) of linear SVMs with squared hinge loss, one for each split on its chosen features, by Newton steps.

    A step is one pass over the subjects' vectors for all splits: tasks add up gradients and curvatures, which have as
    many entries as features in a split squared, and the driver solves for the next weights. Features are scaled by their
    deviation in the train part. The loss is piecewise quadratic, so few steps end at its minimum."""
    import numpy as np

    spark = features.sparkSession
    wanted = chosen.select("split", "feature").distinct()
    place = Window.partitionBy("split").orderBy("feature")  # the features of one split
    numbered = checkpointed(wanted.withColumn("k", F.row_number().over(place) - 1))
    sizes = {r["split"]: r["n"] for r in numbered.groupBy("split").agg(F.count("*").alias("n")).collect()}
    parts = splits.select("split", "subject", "part").join(features.select("subject", F.col("label").cast("int").alias("label")).distinct(), "subject")
    values = features.join(numbered, "feature").groupBy("split", "subject").agg(F.collect_list("k").alias("at"), F.collect_list(F.col("value").cast("double")).alias("value"))
    rows = checkpointed(parts.join(values, ["split", "subject"], "left"))
    train = rows.where("part = 'train'").select("split", "label", F.explode(F.arrays_zip("at", "value")).alias("e")).groupBy("split", F.col("e.at").alias("k"))
    people = rows.where("part = 'train'").groupBy("split").agg(F.count("*").alias("n"))
    v = F.col("e.value")
    spread = train.agg(F.sum(v).alias("s"), F.sum(v * v).alias("q")).join(people, "split").select("split", "k", F.sqrt(F.greatest(F.col("q") / F.col("n") - F.pow(F.col("s") / F.col("n"), 2), F.lit(0.0))).alias("sd"))
    scale = {split: np.ones(n) for split, n in sizes.items()}
    for r in spread.collect():  # a row for each split and feature
        scale[r["split"]][r["k"]] = 1 / r["sd"] if r["sd"] and r["sd"] > 1e-12 else 0.0
    count = {r["split"]: r["n"] for r in people.collect()}

    def vectors(pdf: pd.DataFrame):
        for split, own in pdf.groupby("split"):
            x = np.zeros((len(own), sizes.get(split, 0) + 1))
            x[:, -1] = 1
            for r, (at, value) in enumerate(zip(own["at"], own["value"])):
                if at is not None and len(at):
                    x[r, at] = value
            if split in scale:
                x[:, :-1] *= scale[split]
            yield split, x, own

    weights = {split: np.zeros(n + 1) for split, n in sizes.items()}

    def judged(w):
        def run(batches):
            for pdf in batches:
                for split, x, own in vectors(pdf):
                    said = (x @ w[split] > 0).astype(int) if split in w else np.zeros(len(own), int)
                    yield pd.DataFrame({"split": [split], "right": [int((said == own["label"].to_numpy()).sum())], "n": [len(own)]})

        return run

    def slopes(w):
        def run(batches):
            for pdf in batches:
                for split, x, own in vectors(pdf):
                    if split not in w:
                        continue
                    y = 2 * own["label"].to_numpy() - 1
                    slack = 1 - y * (x @ w[split])
                    on = slack > 0
                    g, h = -2 * (y[on] * slack[on]) @ x[on], 2 * x[on].T @ x[on]
                    both = np.concatenate((g, h.ravel()))
                    yield pd.DataFrame({"split": split, "at": np.arange(len(both), dtype=np.int32), "x": both})

        return run

    open_ = set(weights)
    for _ in range(rounds):
        now = {split: weights[split] for split in open_}
        sums = rows.where("part = 'train'").mapInPandas(slopes(now), "split int, at int, x double").groupBy("split", "at").agg(F.sum("x").alias("x"))
        found = {split: np.zeros((n + 1) + (n + 1) ** 2) for split, n in sizes.items()}
        for r in sums.collect():  # the entries of a gradient and a curvature for each split
            found[r["split"]][r["at"]] = r["x"]
        for split in list(open_):
            n, w = sizes[split] + 1, weights[split]
            ridge = np.full(n, penalty)
            ridge[-1] = 1e-9  # the offset is free
            total = max(count.get(split, 0), 1)
            g, h = found[split][:n] / total + ridge * w, found[split][n:].reshape(n, n) / total + np.diag(ridge)
            step = np.linalg.solve(h, g)
            weights[split] = w - step
            if np.abs(step).max() < 1e-8 * max(1.0, np.abs(weights[split]).max()):
                open_.discard(split)
        if not open_:
            break
    right = rows.where("part = 'test'").mapInPandas(judged(weights), "split int, right long, n long")
    return right.groupBy("split").agg((F.sum("right") / F.sum("n")).alias("accuracy"))


def best_split_features(results: DataFrame, chosen: DataFrame) -> DataFrame:
    """(feature, first): features chosen in the splits of best accuracy, in order of first appearance.

    results(split, accuracy), chosen(split, feature, rank)."""
    top = results.agg(F.max("accuracy").alias("top"))
    best = results.crossJoin(F.broadcast(top)).where("accuracy = top").select("split")
    return chosen.join(best, "split").groupBy("feature").agg(F.min(F.struct("split", "rank")).alias("first"))


#: Training rows and queries of a block.
TRAIN_ROWS, QUERY_ROWS = 8192, 4096


def knn(train: DataFrame, queries: DataFrame, k: int = 5, dimensions: str = "vector") -> DataFrame:
    """(id, predicted): majority label of the k nearest training vectors by Euclidean distance, ties by smaller id and label.

    Every query meets every training row, in blocks: both are dealt to blocks of bounded size, a task keeps the k best of a
    block of rows for each query of a block, and only those are merged. train(id, label, vector), queries(id, vector)."""
    blocks, asks = (max(1, -(-df.count() // size)) for df, size in ((train, TRAIN_ROWS), (queries, QUERY_ROWS)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    t = train.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), every(asks).alias("ask"), "id", "label", F.col(dimensions).alias("x"))
    q = queries.select(every(blocks).alias("block"), F.pmod(F.xxhash64("id"), F.lit(asks)).cast("int").alias("ask"), "id", F.lit(None).cast("int").alias("label"), F.col(dimensions).alias("x"))

    def nearest(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        empty = pd.DataFrame({"id": pd.Series(dtype="int64"), "near": pd.Series(dtype="int64"), "label": pd.Series(dtype="int32"), "d": pd.Series(dtype="float64")})
        if not len(left) or not len(right):
            return empty
        a, b = np.stack(left["x"].to_numpy()).astype(float), np.stack(right["x"].to_numpy()).astype(float)
        names, own, out = left["id"].to_numpy(), right["id"].to_numpy(), []
        for lo in range(0, len(b), 64):
            d = np.zeros((min(64, len(b) - lo), len(a)))
            for c in range(a.shape[1]):  # one dimension after another: exact differences without a cube of them
                d += (b[lo : lo + 64, c, None] - a[None, :, c]) ** 2
            d[own[lo : lo + 64, None] == names[None, :]] = np.inf
            order = np.lexsort((np.broadcast_to(names, d.shape), d), axis=1)[:, :k]
            rows = np.arange(len(d))[:, None]
            out.append(pd.DataFrame({"id": np.repeat(own[lo : lo + 64], order.shape[1]), "near": names[order].ravel(), "label": left["label"].to_numpy()[order].ravel().astype("int32"), "d": d[rows, order].ravel()}))
        return pd.concat(out)

    found = t.groupBy("block", "ask").cogroup(q.groupBy("block", "ask")).applyInPandas(nearest, "id long, near long, label int, d double")
    best = found.where("id <> near").withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("d", "near"))).where(F.col("r") <= k)
    votes = best.groupBy("id", "label").agg(F.count("*").alias("n"))
    return votes.groupBy("id").agg(F.max_by("label", F.struct("n", (-F.col("label")).alias("low"))).alias("predicted"))


def estimators(seed: int = 0) -> dict:
    """Named Spark ML classifiers with the parameter grids that are searched. What Spark ML does not have (bagging, extra trees, boosted
    stumps, nearest neighbours) and many masks at once are in ensembles."""
    from pyspark.ml import classification as c
    from pyspark.ml.tuning import ParamGridBuilder

    forest, boosted, svm, tree = c.RandomForestClassifier(seed=seed), c.GBTClassifier(seed=seed), c.LinearSVC(), c.DecisionTreeClassifier(seed=seed)
    return {
        "naive_bayes": (c.NaiveBayes(modelType="gaussian"), [{}]),
        "decision_tree": (tree, ParamGridBuilder().addGrid(tree.impurity, ["gini", "entropy"]).build()),
        "random_forest": (forest, ParamGridBuilder().addGrid(forest.numTrees, [16, 32]).build()),
        "gradient_boosting": (boosted, ParamGridBuilder().addGrid(boosted.maxIter, [16, 32]).addGrid(boosted.stepSize, [0.8, 1.0]).build()),
        "linear_svm": (svm, ParamGridBuilder().addGrid(svm.regParam, [0.01, 0.1]).build()),
    }


#: Bytes of features that one task of a fit goes through at least.
FIT_BYTES = 1 << 23


def in_few_parts(table: DataFrame) -> DataFrame:
    """table(features, ..) in no more partitions than the bytes of its features fill."""
    first = table.select("features").head()
    size = table.count() * 8 * len(first[0]) if first else 0
    return table.coalesce(max(1, -(-size // FIT_BYTES)))


def cross_validated(data: DataFrame, folds: DataFrame, which: Sequence[str] = ("naive_bayes", "linear_svm"), metric: str = "f1") -> DataFrame:
    """(estimator, params, mean_score): cross-validated scores by given folds, best first. data(subject, label, features).

    A fit is some hundred jobs over its rows, one after another, so rows lie in no more partitions than their bytes ask for, and
    fits of all folds and parameters run side by side. Each fits and judges the rows that Spark's CrossValidator would."""
    from multiprocessing.pool import ThreadPool

    from pyspark import inheritable_thread_target
    from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator

    spark, known = data.sparkSession, estimators()
    table = in_few_parts(checkpointed(data.join(folds.select("subject", "fold"), "subject").withColumn("label", F.col("label").cast("double")))).persist()
    judge = BinaryClassificationEvaluator() if metric == "roc_auc" else MulticlassClassificationEvaluator(metricName=metric)
    n = table.agg(F.max("fold")).first()[0] + 1

    def score(task) -> float:
        name, params, fold = task
        model = known[name][0].fit(table.where(F.col("fold") != fold), params)
        return judge.evaluate(model.transform(table.where(F.col("fold") == fold)))

    each = [(name, params) for name in which for params in known[name][1]]
    pool = ThreadPool(max(4, spark.sparkContext.defaultParallelism))
    try:
        scores = pool.map(inheritable_thread_target(spark)(score), [(*e, fold) for e in each for fold in range(n)], chunksize=1)
    finally:
        pool.close()
    table.unpersist()
    rows = [(name, ", ".join(sorted(f"{p.name}={v}" for p, v in params.items())), sum(scores[k * n : (k + 1) * n]) / n) for k, (name, params) in enumerate(each)]
    return spark.createDataFrame(rows, "estimator string, params string, mean_score double").orderBy(F.desc("mean_score"))


def hard_auc(predictions: DataFrame) -> DataFrame:
    """(auc): area under the curve of hard labels, the mean of both recalls. predictions(label, predicted)."""
    right = F.col("label") == F.col("predicted")
    rate = lambda v: F.try_divide(F.count_if(right & (F.col("label") == v)), F.count_if(F.col("label") == v))
    return predictions.agg(((rate(1) + rate(0)) / 2).alias("auc"))


def boosted_stumps(data: DataFrame, rounds: int = 16):
    """AdaBoost: decision stumps on reweighted rows. A function from a DataFrame with features to one with predicted (0 or 1)."""
    from pyspark.ml.classification import DecisionTreeClassifier

    rows, models = data.withColumn("w", F.lit(1.0)), []
    for _ in range(rounds):
        model = DecisionTreeClassifier(maxDepth=1, weightCol="w").fit(rows)
        scored = model.transform(rows)
        wrong = F.col("prediction") != F.col("label")
        e = scored.agg(F.sum(F.when(wrong, F.col("w")).otherwise(0.0)) / F.sum("w")).first()[0]
        if e >= 0.5:
            break
        alpha = 0.5 * math.log((1 - e) / max(e, 1e-10))
        models.append((model, alpha))
        if e < 1e-10:
            break
        rows = scored.withColumn("w", F.col("w") * F.exp(F.when(wrong, alpha).otherwise(-alpha))).drop("prediction", "rawPrediction", "probability")
        rows = checkpointed(rows)

    def predict(table: DataFrame) -> DataFrame:
        out, votes = table, []
        for k, (model, alpha) in enumerate(models):
            out = model.transform(out).withColumnRenamed("prediction", f"__p{k}").drop("rawPrediction", "probability")
            votes.append((F.col(f"__p{k}") * 2 - 1) * alpha)
        total = reduce(lambda a, b: a + b, votes, F.lit(0.0))
        return out.withColumn("predicted", (total > 0).cast("int")).drop(*(f"__p{k}" for k in range(len(models))))

    return predict
