"""Registered queries over the derived cohort. Each takes (spark, sf_dir) and reads whole tables; doubles are rounded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortgraph.operators import adjust, cohort, ensembles, kernels, learn, measures, network, permute, resample, spectral, stats
from cohortgraph.operators import edges as E
from cohortgraph.operators.lineage import checkpointed
from cohortgraph.plans import fixture as fx
from cohortgraph.plans.oracles import ORACLE  # noqa: F401

N = fx.NODES
QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def r6(name: str, c: Column | None = None) -> Column:
    return F.round(F.col(name).cast("double") if c is None else c.cast("double"), 6).alias(name)


def long(name: str) -> Column:
    return F.col(name).cast("long").alias(name)


def n_subjects(spark: SparkSession, d: str) -> int:
    return fx.subjects(spark, d).count()


def valued(spark: SparkSession, d: str, name: str = "strength") -> DataFrame:
    """(subject, node, cohort, value): one node measure with cohorts."""
    e, nodes = fx.edges(spark, d), fx.nodes(spark)
    made = {"strength": measures.strength, "degree": measures.degree, "clustering": measures.clustering}[name](e, nodes)
    return made.join(fx.subjects(spark, d).select("subject", "cohort"), "subject").select("subject", "node", "cohort", F.col(name).cast("double").alias("value"))


def edge_values(spark: SparkSession, d: str) -> DataFrame:
    """(subject, i, j, cohort, value): weights of all edges for all subjects, 0 where absent."""
    s = fx.subjects(spark, d)
    return E.densify(fx.edges(spark, d), s).join(s.select("subject", "cohort"), "subject").select("subject", "i", "j", "cohort", F.col("w").alias("value"))


def sparse_values(spark: SparkSession, d: str) -> DataFrame:
    """(subject, i, j, cohort, value): weights of the edges that are there. Tests of moments count the rest from the cohorts' sizes."""
    return weights(spark, d).join(fx.subjects(spark, d).select("subject", "cohort"), "subject")


def perms(spark: SparkSession, d: str, n: int) -> DataFrame:
    s = fx.subjects(spark, d)
    return permute.labels(spark, s, n, s.where("cohort = 'patient'").count())


def permuted(spark: SparkSession, d: str, keys: list[str], rows: DataFrame, n: int, statistic=resample.welch, bootstrap: bool = False) -> DataFrame:
    return resample.permuted(rows, fx.subjects(spark, d).select("subject", "cohort"), keys, n, statistic, seed=3, bootstrap=bootstrap)


def tested(spark: SparkSession, d: str, keys: list[str], rows: DataFrame, n: int, statistic=resample.welch, tail: str = "both"):
    return resample.tested(rows, fx.subjects(spark, d).select("subject", "cohort"), keys, n, statistic, tail, seed=3)


def weights(spark: SparkSession, d: str) -> DataFrame:
    return fx.edges(spark, d).select("subject", "i", "j", F.col("w").alias("value"))


# Graphs and node measures


@query
def cohort_edges(spark, d):
    return fx.edges(spark, d).select("subject", "i", "j", long("w"))


@query
def node_degree(spark, d):
    return measures.degree(fx.edges(spark, d), fx.nodes(spark)).select("subject", "node", long("degree"))


@query
def node_strength(spark, d):
    return measures.strength(fx.edges(spark, d), fx.nodes(spark)).select("subject", "node", r6("strength"))


@query
def clustering_coefficient(spark, d):
    return measures.clustering(fx.edges(spark, d), fx.nodes(spark)).select("subject", "node", r6("clustering"))


@query
def measure_summary_by_cohort(spark, d):
    return stats.summary_by_cohort(valued(spark, d, "clustering"), ["node"]).select("cohort", "node", long("n"), r6("mean"), r6("std"))


@query
def welch_t_by_node(spark, d):
    return stats.welch(valued(spark, d, "clustering"), ["node"]).select("node", r6("t"), r6("df"))


@query
def welch_p_by_node(spark, d):
    t = stats.welch(valued(spark, d), ["node"])
    return t.select("node", r6("t"), r6("p", stats.t_p(F.col("t"), F.col("df"))))


# Cohorts


@query
def cohort_classify(spark, d):
    s = fx.subjects(spark, d).select("subject", "name")
    return cohort.classify(s, ["lgp"], ["060", "dep", "dpr", "S", "TI", "DEP"])


@query
def cohort_cap(spark, d):
    return cohort.capped(fx.subjects(spark, d), 50).select("subject", "name", "cohort")


@query
def exclude_subjects(spark, d):
    s = fx.subjects(spark, d)
    return cohort.excluding(s, s.where("subject % 7 = 3")).groupBy("cohort").agg(F.count("*").alias("n"))


@query
def restrict_subjects(spark, d):
    s = fx.subjects(spark, d)
    return cohort.restricted(fx.edges(spark, d), s.where("cohort = 'patient' and duration > 10")).groupBy("subject").agg(F.count("*").alias("n"))


@query
def match_ids_by_digits(spark, d):
    left = fx.subjects(spark, d).select("subject", "name")
    right = fx.read(spark, d, "customer").select(F.col("c_name").alias("other"), F.col("c_custkey").alias("k"))
    padded = right.select(F.concat(F.lit("R"), F.lpad(F.col("k").cast("string"), 5, "0"), F.lit("-x")).alias("other"), "k")
    return cohort.matched_by_digits(left, padded, "name", "other").select("subject", "name", "other", "k")


@query
def qc_matrices(spark, d):
    kept = fx.edges(spark, d).where("subject % 11 <> 5")
    return cohort.quality(kept, fx.subjects(spark, d)).select("subject", long("entries"), long("off_diagonal"), "state")


@query
def qc_zero_diagonal(spark, d):
    own = fx.items(spark, d).groupBy("subject", "b").agg(F.count("*").alias("w")).where("w > 2").select("subject", F.col("b").alias("i"), F.col("b").alias("j"), "w")
    return cohort.without_diagonal(own, fx.subjects(spark, d), fx.nodes(spark)).select("subject", "node")


@query
def demographics(spark, d):
    return cohort.demographics(fx.subjects(spark, d)).select("cohort", long("n"), long("male"), long("female"), r6("age_mean"), r6("age_std"))


@query
def flag_percentages(spark, d):
    flags = fx.subjects(spark, d).where("cohort = 'patient'").select((F.col("subject") % 2).alias("a"), (F.col("subject") % 5 == 0).cast("int").alias("b"), (F.col("age") - 40).alias("c"))
    return cohort.flag_shares(flags, ["a", "b", "c"], n_subjects(spark, d)).select("flag", r6("percent"))


@query
def crosstab_chi2(spark, d):
    t = cohort.crosstab(fx.subjects(spark, d).withColumn("band", (F.col("age") / 20).cast("int")), "cohort", "band")
    return t.select("cohort", "band", long("observed"), r6("expected"), r6("part"))


@query
def crosstab_statistic(spark, d):
    cells = cohort.crosstab(fx.subjects(spark, d).withColumn("band", (F.col("age") / 20).cast("int")), "cohort", "band")
    return cohort.crosstab_test(cells, "cohort", "band").select(r6("chi2"), long("df"))


@query
def crosstab_p(spark, d):
    cells = cohort.crosstab(fx.subjects(spark, d).withColumn("band", (F.col("age") / 20).cast("int")), "cohort", "band")
    return cohort.crosstab_test(cells, "cohort", "band").select(r6("chi2"), long("df"), r6("p"))


@query
def load_summary(spark, d):
    """Years of a patient's illness for each started decade of age, as a load."""
    return cohort.load_summary(fx.subjects(spark, d).where("cohort = 'patient'"), F.col("duration") / F.ceil(F.col("age") / 10)).select(long("n"), r6("mean"), r6("std"))


@query
def volume_summary(spark, d):
    return cohort.volume_summary(fx.volumes(spark, d)).select("node", r6("mean"), r6("std"))


# Edges


@query
def density_sum(spark, d):
    return E.density(fx.edges(spark, d), fx.volumes(spark, d), "sum").select("subject", "i", "j", r6("w"))


@query
def density_mean(spark, d):
    return E.density(fx.edges(spark, d), fx.volumes(spark, d), "mean").select("subject", "i", "j", r6("w"))


@query
def consensus_threshold(spark, d):
    return E.consensus(fx.edges(spark, d), n_subjects(spark, d), 0.42).select("subject", "i", "j", long("w"))


@query
def consensus_removed_edges(spark, d):
    return E.consensus_removed(fx.edges(spark, d), n_subjects(spark, d), 0.42).select("subject", "i", "j", long("w"))


@query
def edges_removed_per_subject(spark, d):
    gone = E.consensus_removed(fx.edges(spark, d), n_subjects(spark, d), 0.42)
    return cohort.removed_counts(gone, 50).select("subject", long("n_removed"))


@query
def presence_threshold(spark, d):
    return E.present_in(fx.edges(spark, d), n_subjects(spark, d), 0.55).select("subject", "i", "j", long("w"))


@query
def presence_dropped_edges(spark, d):
    return E.dropped_edges(fx.edges(spark, d), n_subjects(spark, d), 0.55)


@query
def filter_weights_cumulative(spark, d):
    return E.heaviest(fx.edges(spark, d), 0.5).select("subject", "i", "j", long("w"))


@query
def threshold_edges(spark, d):
    return E.above(fx.edges(spark, d), 3).select("subject", "i", "j", long("w"))


@query
def isolated_nodes(spark, d):
    return E.isolated_nodes(E.above(fx.edges(spark, d), 3), fx.nodes(spark)).select("subject", "node")


@query
def graph_at_least(spark, d):
    return E.binary(E.at_least(fx.edges(spark, d), 2)).select("subject", "i", "j", r6("w"))


@query
def invert_weights(spark, d):
    return E.inverse(fx.edges(spark, d)).select("subject", "i", "j", r6("w"))


@query
def cube_root_weights(spark, d):
    return E.cube_root(fx.edges(spark, d)).select("subject", "i", "j", r6("w"))


@query
def log_weights(spark, d):
    return E.log_weights(fx.edges(spark, d)).select("subject", "i", "j", r6("w"))


@query
def symmetrize(spark, d):
    return E.symmetric(fx.edges(spark, d)).select("subject", "i", "j", long("w"))


@query
def adjacency(spark, d):
    return E.adjacency(E.above(fx.edges(spark, d), 6)).select("i", "j", long("w"))


@query
def gather_significant_edges(spark, d):
    t = stats.welch(sparse_values(spark, d), ["i", "j"], subjects=fx.subjects(spark, d)).where("abs(t) > 1.5")
    mirrored = t.select("i", "j").union(t.select("j", "i"))
    return E.gather(fx.edges(spark, d), mirrored).select("subject", "i", "j", long("w"))


@query
def bounded_p_map(spark, d):
    return _edge_p(spark, d).select("i", "j", r6("shown", E.bounded_p(F.col("p"), 0.2)))


@query
def masked_statistics(spark, d):
    t = stats.welch(sparse_values(spark, d), ["i", "j"], subjects=fx.subjects(spark, d))
    return E.masked(t, t.where("abs(t) > 2").select("i", "j")).select("i", "j", r6("t"))


@query
def union_regions(spark, d):
    hits = [stats.welch(valued(spark, d, m), ["node"]).where("abs(t) > 1").select("node") for m in ("strength", "degree", "clustering")]
    return hits[0].union(hits[1]).union(hits[2]).distinct()


# Paths and communities


@query
def shortest_paths_weighted(spark, d):
    return kernels.distances(fx.edges(spark, d), N).select("subject", "i", "j", r6("d"))


@query
def bfs_distance(spark, d):
    return kernels.distances(E.above(fx.edges(spark, d), 2), N, weighted=False).select("subject", "i", "j", long("d"))


@query
def global_efficiency(spark, d):
    return measures.efficiency(kernels.distances(fx.edges(spark, d), N), N).select("subject", r6("efficiency"))


@query
def characteristic_path(spark, d):
    return measures.path_summary(kernels.distances(E.above(fx.edges(spark, d), 2), N, weighted=False)).select("subject", r6("path_length"), long("diameter"))


@query
def mean_weight(spark, d):
    return measures.mean_weight(fx.edges(spark, d), N).select("subject", r6("mean_weight"))


@query
def global_clustering(spark, d):
    return measures.global_mean(measures.clustering(fx.edges(spark, d), fx.nodes(spark)), "clustering", N).select("subject", r6("clustering"))


@query
def participation_coef(spark, d):
    return measures.participation(fx.edges(spark, d), fx.communities(spark), fx.nodes(spark)).select("subject", "node", r6("participation"))


@query
def participation_out(spark, d):
    """Edges taken as going from the lower to the higher node."""
    return measures.participation(fx.edges(spark, d), fx.communities(spark), fx.nodes(spark), "out").select("subject", "node", r6("participation"))


@query
def participation_in(spark, d):
    return measures.participation(fx.edges(spark, d), fx.communities(spark), fx.nodes(spark), "in").select("subject", "node", r6("participation"))


@query
def path_length_with_diagonal(spark, d):
    found = kernels.distances(E.above(fx.edges(spark, d), 2), N, weighted=False)
    return measures.path_length(found, N, include_diagonal=True, include_infinite=False).select("subject", r6("path_length"))


@query
def marked_nodes(spark, d):
    t = stats.welch(valued(spark, d), ["node"])
    return E.marked_nodes(t.select("node", stats.t_p(F.col("t"), F.col("df")).alias("p")), 0.2)


@query
def avg_neighbor_degree(spark, d):
    return measures.neighbour_degree(fx.edges(spark, d), fx.nodes(spark)).select("subject", "node", r6("neighbour_degree"))


@query
def module_graph(spark, d):
    return measures.module_graph(fx.edges(spark, d), fx.communities(spark)).select("subject", "ci", "cj", r6("w"))


@query
def modularity_q(spark, d):
    return measures.modularity(fx.edges(spark, d), fx.communities(spark)).select("subject", r6("q"))


@query
def graph_summary(spark, d):
    s = measures.summary(E.above(fx.edges(spark, d), 1), fx.nodes(spark))
    return s.select("subject", long("n_nodes"), long("n_edges"), long("max_degree"), long("min_degree"), r6("mean_degree"), r6("median_degree"))


@query
def transitivity(spark, d):
    return measures.transitivity(E.above(fx.edges(spark, d), 1), fx.nodes(spark)).select("subject", r6("transitivity"), r6("mean_clustering"))


@query
def degree_histogram(spark, d):
    return measures.degree_histogram(fx.edges(spark, d), fx.nodes(spark)).select("subject", long("degree"), long("n"))


@query
def local_efficiency(spark, d):
    return kernels.node_measures(fx.edges(spark, d), N, ("local_efficiency",)).select("subject", "node", r6("value"))


@query
def betweenness(spark, d):
    return kernels.node_measures(fx.edges(spark, d), N, ("betweenness",)).select("subject", "node", r6("value"))


@query
def unit_betweenness(spark, d):
    return kernels.node_measures(fx.edges(spark, d), N, ("unit_betweenness",)).select("subject", "node", r6("value"))


@query
def louvain(spark, d):
    return kernels.node_measures(fx.edges(spark, d), N, ("community",)).select("subject", "node", long("value"))


@query
def louvain_levels(spark, d):
    return kernels.community_levels(fx.edges(spark, d), N).select("subject", "level", "node", "community", r6("q"))


@query
def curvature(spark, d):
    return kernels.node_measures(fx.edges(spark, d), N, ("curvature",)).select("subject", "node", r6("value"))


def _found_communities(spark, d):
    """Each subject's own modules, as Louvain finds them."""
    return kernels.node_measures(fx.edges(spark, d), N, ("community",)).select("subject", "node", F.col("value").cast("int").alias("ci"))


@query
def participation_found(spark, d):
    """Participation in each subject's own communities."""
    return measures.participation(fx.edges(spark, d), _found_communities(spark, d), fx.nodes(spark)).select("subject", "node", r6("participation"))


@query
def modularity_found(spark, d):
    """Modularity of each subject's own communities."""
    return measures.modularity(fx.edges(spark, d), _found_communities(spark, d)).select("subject", r6("q"))


@query
def global_strength(spark, d):
    return measures.global_mean(measures.strength(fx.edges(spark, d), fx.nodes(spark)), "strength", N).select("subject", r6("strength"))


@query
def measure_vectors(spark, d):
    """Two measures of each graph and seven blocks of nodes as one sparse vector a subject."""
    return learn.vector_entries(kernels.measure_vectors(fx.edges(spark, d), N), kernels.feature_names(N), zeros=False).select("subject", "feature", r6("value"))


def _measure_features(spark, d):
    """All graph measures as features, label 1 for patients."""
    labels = fx.subjects(spark, d).select("subject", (F.col("cohort") == "patient").cast("int").alias("label"))
    vectors = kernels.measure_vectors(fx.edges(spark, d), N).join(labels, "subject")
    return learn.vector_entries(vectors, kernels.feature_names(N)).select("subject", "label", "feature", "value")


@query
def measure_fisher_rank(spark, d):
    return learn.ranked(learn.fisher_scores(_measure_features(spark, d))).select("feature", r6("score"), long("rank"))


@query
def measure_svm(spark, d):
    """Ten splits: the best measures by Fisher score in the train part, and a linear SVM on them."""
    features = checkpointed(_measure_features(spark, d))
    return learn.svm_per_split(features, learn.shuffle_splits(features.select("subject").distinct()))[0].select("split", r6("accuracy"))


# Adjustment and tests


def _covered(spark, d):
    return valued(spark, d).join(fx.subjects(spark, d).select("subject", "age", "gender", "duration"), "subject")


@query
def glm_residual_2cov(spark, d):
    return adjust.residuals(_covered(spark, d), ["node"], ["age", "gender"]).select("subject", "node", r6("value"))


@query
def glm_adjusted_2cov(spark, d):
    return adjust.residuals(_covered(spark, d), ["node"], ["age", "gender"], keep_mean=True).select("subject", "node", r6("value"))


@query
def glm_residual_3cov(spark, d):
    return adjust.residuals(_covered(spark, d), ["node"], ["age", "gender", "duration"]).select("subject", "node", r6("value"))


@query
def glm_edges(spark, d):
    v = edge_values(spark, d).join(fx.subjects(spark, d).select("subject", "age", "gender"), "subject")
    return adjust.residuals(v, ["i", "j"], ["age", "gender"]).select("subject", "i", "j", r6("value"))


@query
def centred_age(spark, d):
    return adjust.centred(fx.subjects(spark, d).select("subject", "age"), "age").select("subject", r6("age"))


@query
def pooled_t(spark, d):
    return stats.pooled_t(sparse_values(spark, d), ["i", "j"], subjects=fx.subjects(spark, d)).select("i", "j", r6("t"), long("df"))


@query
def variance_ratio_f(spark, d):
    return stats.variance_ratio(sparse_values(spark, d), ["i", "j"], subjects=fx.subjects(spark, d)).select("i", "j", r6("f"), long("d1"), long("d2"))


@query
def mann_whitney_u(spark, d):
    return stats.mann_whitney(edge_values(spark, d), ["i", "j"]).select("i", "j", r6("u1"), r6("u2"), r6("ties"))


@query
def levene_w(spark, d):
    return stats.levene(valued(spark, d), ["node"]).select("node", r6("w"), long("df"))


@query
def outliers_iqr(spark, d):
    return stats.outliers(valued(spark, d), ["node"], 1.0).select("subject", "node", r6("value"))


@query
def outliers_per_subject(spark, d):
    return stats.outliers(valued(spark, d), ["node"], 1.0).groupBy("subject").agg(F.count("*").alias("n"))


@query
def normal_fit(spark, d):
    return stats.normal_fit(valued(spark, d), ["node"]).select("node", r6("mu"), r6("sigma"))


@query
def histogram_bins(spark, d):
    return stats.histogram(valued(spark, d), ["node"], 20).select("node", "bin", long("n"))


@query
def shapiro(spark, d):
    return stats.shapiro(valued(spark, d), ["node"]).select("node", r6("w"), r6("p"))


def _edge_p(spark, d):
    return stats.mann_whitney_p(stats.mann_whitney(edge_values(spark, d), ["i", "j"])).select("i", "j", "p")


@query
def mann_whitney_p(spark, d):
    return _edge_p(spark, d).select("i", "j", r6("p"))


@query
def bh_adjust(spark, d):
    return stats.benjamini_hochberg(_edge_p(spark, d)).select("i", "j", r6("p"), r6("q"))


@query
def bonferroni(spark, d):
    return stats.bonferroni(_edge_p(spark, d)).select("i", "j", r6("q"))


@query
def event_type_tests(spark, d):
    """One-dimensional tests on events: purchases of even against odd users, for each hour."""
    e = fx.read(spark, d, "events").select(F.hour("ts").alias("hour"), F.when(F.col("user_id") % 2 == 0, "patient").otherwise("control").alias("cohort"), "value")
    return stats.welch(e, ["hour"]).select("hour", r6("t"))


# Permutations

#: Of the relational plans, which SQL repeats. The large tests have their own numbers.
PERMS = 20
TFNBS_PERMS = 5_000


@query
def perm_labels(spark, d):
    return perms(spark, d, PERMS).select("perm", "subject", "cohort")


@query
def perm_welch_maxstat(spark, d):
    return permute.max_welch(valued(spark, d), perms(spark, d, PERMS), ["node"]).select("perm", r6("stat"))


@query
def critical_value(spark, d):
    null = permute.max_welch(valued(spark, d), perms(spark, d, PERMS), ["node"])
    return permute.critical(null, 0.05, PERMS).select(r6("t_max"))


@query
def significant_nodes(spark, d):
    rows = valued(spark, d)
    null = permute.max_welch(rows, perms(spark, d, PERMS), ["node"])
    t = stats.welch(rows, ["node"]).crossJoin(F.broadcast(permute.critical(null, 0.5, PERMS)))
    return t.where("t > t_max").select("node", r6("t"))


@query
def perm_mwu_pvalue(spark, d):
    return permute.p_of_min_u(valued(spark, d), perms(spark, d, PERMS), ["node"], PERMS).select("node", r6("obs"), r6("p"))


@query
def perm_global_pvalue(spark, d):
    rows = measures.mean_weight(fx.edges(spark, d), N).join(fx.subjects(spark, d).select("subject", "cohort"), "subject").select("subject", "cohort", F.lit("mean_weight").alias("measure"), F.col("mean_weight").alias("value"))
    null = stats.welch(rows.drop("cohort").join(perms(spark, d, PERMS), "subject"), ["perm", "measure"]).withColumnRenamed("t", "stat")
    obs = stats.welch(rows, ["measure"]).select("measure", F.col("t").alias("obs"))
    return permute.p_two_sided(null, obs, ["measure"], PERMS).select("measure", r6("obs"), r6("p"))


@query
def perm_welch_many(spark, d):
    """Node strengths under the number of permutations of a main result."""
    return tested(spark, d, ["node"], valued(spark, d).select("subject", "node", "value"), 100_000)[0].select("node", r6("t", F.col("stat")), r6("p"), r6("p_max"))


@query
def significant_nodes_many(spark, d):
    """Nodes beyond the 5 % critical value of the largest statistic."""
    t, maxima = tested(spark, d, ["node"], valued(spark, d).select("subject", "node", "value"), 5_000)
    t_max = F.lit(float(maxima[::-1][int(0.05 * 5_000)]))
    return t.select("node", r6("stat"), r6("t_max", t_max), (F.abs("stat") > t_max).alias("significant"))


@query
def perm_mwu_many(spark, d):
    """Rank sums of node strengths: both sides, each node and the furthest of all."""
    subjects, rows = fx.subjects(spark, d), valued(spark, d).select("subject", "node", "value")
    ranks = resample.centred_ranks(rows, subjects, ["node"])
    return tested(spark, d, ["node"], ranks, 5_000, resample.rank_sum_z)[0].select("node", r6("u_less_mean", F.col("stat")), r6("p"), r6("p_max"))


@query
def perm_global_one_sided(spark, d):
    """Mean weight of whole graphs, whether patients have less."""
    rows = measures.mean_weight(fx.edges(spark, d), N).select("subject", F.lit("mean_weight").alias("measure"), F.col("mean_weight").alias("value"))
    return tested(spark, d, ["measure"], rows, 5_000, tail="left")[0].select("measure", r6("t", F.col("stat")), r6("p"))


@query
def first_measure_per_node(spark, d):
    order = ["clustering", "degree", "strength"]
    hits = [stats.welch(valued(spark, d, m), ["node"]).where("abs(t) > 1").select("node", F.lit(m).alias("measure")) for m in order]
    return permute.first_significant(hits[0].union(hits[1]).union(hits[2]), fx.nodes(spark), order).select("node", "measure")


# Networks


def _edge_stats(spark, d, limit: float | None = None):
    s = stats.raw_statistic(sparse_values(spark, d), ["i", "j"], "welch", subjects=fx.subjects(spark, d))
    return s if limit is None else network.above(s, limit)


@query
def suprathreshold_edges(spark, d):
    return _edge_stats(spark, d, 1.0).select("i", "j", r6("stat"))


@query
def connected_components(spark, d):
    c = network.components(E.above(fx.edges(spark, d), 4).select("subject", "i", "j"), ["subject"])
    return c.select("subject", "i", "j", "component")


@query
def nbs_component_sizes(spark, d):
    c = network.components(E.above(fx.edges(spark, d), 4).select("subject", "i", "j"), ["subject"])
    return c.select("subject", "component", long("size")).distinct()


@query
def nbs_prune_isolated(spark, d):
    return network.without_single_edges(_edge_stats(spark, d, 1.8).select("i", "j"))


@query
def nbs_relabel(spark, d):
    c = network.components(_edge_stats(spark, d, 1.5).select(F.lit(0).alias("g"), "i", "j"), ["g"])
    return network.relabelled(network.larger_components(c, 2)).select("i", "j", long("component"))


@query
def nbs(spark, d):
    t = permuted(spark, d, ["i", "j"], weights(spark, d), 1_000)
    return network.nbs(t, [1.0, 1.2, 1.4, 1.6, 1.8, 2.0], 1_000).select(r6("threshold"), "component", long("size"), r6("p"))


@query
def tfnbs_ladder(spark, d):
    return network.ladder(_edge_stats(spark, d), N, 100).select("r", r6("h"))


@query
def tfnbs_score(spark, d):
    s = _edge_stats(spark, d)
    return network.threshold_free(s, network.ladder(s, N, 40)).select("i", "j", r6("score"))


@query
def tfnbs_test(spark, d):
    return _tfnbs(spark, d).select("i", "j", r6("score"), r6("p"), r6("t_max"))


@query
def tfnbs_masks(spark, d):
    return network.threshold_free_masks(_tfnbs(spark, d)).select("i", "j", "corrected", r6("shown"))


def _tfnbs(spark, d):
    """Ratios of variances with subjects drawn with replacement, 100 thresholds."""
    t = permuted(spark, d, ["i", "j"], weights(spark, d), TFNBS_PERMS, resample.variance_ratio, bootstrap=True)
    return network.threshold_free_test(t, N, TFNBS_PERMS)


def _logits(spark, d):
    return network.logit_difference(_edge_p(spark, d))


@query
def ddt_moments(spark, d):
    return network.ddt_moments(_logits(spark, d), N).select(r6("e_bar"), r6("v_bar"), long("m"), r6("mu"), r6("sigma2"))


@query
def ddt_observed_degree(spark, d):
    return network.observed_degree(_logits(spark, d), fx.nodes(spark), 0.5).select("node", long("degree"))


@query
def ddt(spark, d):
    tests = stats.mann_whitney_p(stats.mann_whitney(edge_values(spark, d), ["i", "j"]))
    return network.difference_degree(network.logit_difference(tests), fx.nodes(spark), N, u=1_000, draws=1_000_000).select("node", long("degree"), r6("null_p"), long("kept"))


@query
def eddt(spark, d):
    """The same with the threshold from the null networks."""
    tests = stats.mann_whitney_p(stats.mann_whitney(edge_values(spark, d), ["i", "j"]))
    return network.difference_degree(network.logit_difference(tests), fx.nodes(spark), N, "eddt").select("node", long("degree"), r6("null_p"), long("kept"))


@query
def ddt_diagnostics(spark, d):
    """Means and variance of the null networks' entries."""
    p = network.ddt_moments(_logits(spark, d), N).first()
    return network.null_diagnostics(network.null_networks(spark, N, p["m"], p["mu"], p["sigma2"], 1_000)).select(r6("off_mean"), r6("off_var"), r6("diagonal_mean"))


@query
def network_degree(spark, d):
    """Edges of each node in the network of edges beyond a threshold."""
    t = stats.welch(sparse_values(spark, d), ["i", "j"], subjects=fx.subjects(spark, d)).where("abs(t) > 1.5")
    return network.network_degree(t, fx.nodes(spark)).select("node", long("degree"))


@query
def raw_rank_statistic(spark, d):
    return stats.raw_statistic(edge_values(spark, d), ["i", "j"], "mannwhitneyu").select("i", "j", r6("stat"))


@query
def significant_counts(spark, d):
    """Nodes with p below 0.2, for each measure."""
    tests = [stats.welch(valued(spark, d, m), ["node"]).select(F.lit(m).alias("measure"), stats.t_p(F.col("t"), F.col("df")).alias("p")) for m in ("strength", "degree", "clustering")]
    return stats.counts_below(tests[0].union(tests[1]).union(tests[2]), ["measure"], 0.2)


# Matrices


@query
def laplacian_total(spark, d):
    return spectral.laplacian(fx.edges(spark, d), fx.nodes(spark), "total").select("subject", "i", "j", r6("v"))


@query
def laplacian_degree(spark, d):
    return spectral.laplacian(fx.edges(spark, d), fx.nodes(spark), "degree", 0.01).select("subject", "i", "j", r6("v"))


@query
def normalized_laplacian(spark, d):
    return spectral.normalised_laplacian(fx.edges(spark, d), fx.nodes(spark)).select("subject", "i", "j", r6("v"))


@query
def laplacian_by_degrees(spark, d):
    return spectral.laplacian_by_degrees(fx.edges(spark, d), fx.nodes(spark)).select("subject", "i", "j", r6("v"))


@query
def gram_matrix(spark, d):
    v = fx.edges(spark, d).groupBy("i", F.col("subject").alias("k")).agg(F.sum("w").cast("double").alias("v"))
    return spectral.gram(v).select("i", "j", r6("v"))


def _density_laplacian(spark, d):
    e = E.density(fx.edges(spark, d), fx.volumes(spark, d), "sum")
    return spectral.laplacian(e, fx.nodes(spark), "degree", 0.01)


@query
def frechet_mean(spark, d):
    means = spectral.frechet_means(spectral.logarithms(_density_laplacian(spark, d), N), fx.subjects(spark, d), N)
    return means.select("cohort", "i", "j", r6("v"))


@query
def frechet_mean_difference(spark, d):
    means = spectral.frechet_means(spectral.logarithms(_density_laplacian(spark, d), N), fx.subjects(spark, d), N)
    return spectral.mean_difference(means, "patient", "control").select("i", "j", r6("difference"))


@query
def frechet_permutation(spark, d):
    logs = spectral.logarithms(_density_laplacian(spark, d), N)
    return spectral.mean_permutation_test(logs, fx.subjects(spark, d), N, 1_000).select("i", "j", r6("difference"), r6("p"))


@query
def frechet_resampled_counts(spark, d):
    """100 draws of 12 patients and 5 controls with 100 permutations each: how often an entry differs."""
    logs = spectral.logarithms(_density_laplacian(spark, d), N)
    return spectral.resampled_counts(logs, spectral.resamples(fx.subjects(spark, d), 100), N).select("i", "j", long("n"))


@query
def frechet_pairs(spark, d):
    """Distances of all pairs of subjects, by the classes of their cohorts."""
    return spectral.pair_summary(spectral.frechet_pairs(_density_laplacian(spark, d), fx.subjects(spark, d), N)).select("pair_class", long("n"), r6("mean"), r6("std"))


# Features and classifiers


def _features(spark, d):
    """Embedding entries as features, label 1 for even classes."""
    v = fx.read(spark, d, "embeddings").select(F.col("vec_id").alias("subject"), (F.col("label") % 2 == 0).cast("int").alias("label"), F.posexplode("embedding").alias("feature", "value"))
    return v.withColumn("value", F.col("value").cast("double"))


@query
def fisher_score_rank(spark, d):
    return learn.ranked(learn.fisher_scores(_features(spark, d))).select("feature", r6("score"), long("rank"))


@query
def top_features(spark, d):
    """The 20 features of best score: a top-k report."""
    return learn.top_features(learn.fisher_scores(_features(spark, d)), 20).select("feature", r6("score"))


@query
def shuffle_split(spark, d):
    return learn.shuffle_splits(fx.subjects(spark, d)).select("split", "subject", "part")


@query
def stratified_folds(spark, d):
    return learn.stratified_folds(fx.subjects(spark, d).withColumn("label", (F.col("cohort") == "patient").cast("int"))).select("subject", "label", "fold")


@query
def knn_predict(spark, d):
    v = fx.read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"))
    return learn.knn(v, v.where("id % 100 = 0"), 5).select("id", "predicted")


@query
def hard_label_auc(spark, d):
    s = fx.subjects(spark, d)
    p = s.select((F.col("cohort") == "patient").cast("int").alias("label"), (F.col("age") > 45).cast("int").alias("predicted"))
    return learn.hard_auc(p).select(r6("auc"))


@query
def cv_summary(spark, d):
    data = learn.wide(_features(spark, d), [str(i) for i in range(64)])
    return learn.cross_validated(data, learn.stratified_folds(data)).select("estimator", "params", r6("mean_score"))


@query
def cv_trees(spark, d):
    data = learn.wide(_features(spark, d), [str(i) for i in range(64)])
    return learn.cross_validated(data, learn.stratified_folds(data), ["decision_tree", "random_forest"]).select("estimator", "params", r6("mean_score"))


def _splits(spark, d):
    return learn.shuffle_splits(_features(spark, d).select("subject").distinct())


@query
def svm_per_split(spark, d):
    return learn.svm_per_split(_features(spark, d), _splits(spark, d))[0].select("split", r6("accuracy"))


@query
def svm_best_features(spark, d):
    """Features of the best splits, in order of first appearance."""
    return learn.best_split_features(*learn.svm_per_split(_features(spark, d), _splits(spark, d))).select("feature", F.col("first.split").alias("split"), F.col("first.rank").alias("rank"))


@query
def svm_mean_accuracy(spark, d):
    features, splits = _features(spark, d), _splits(spark, d)
    names = learn.best_split_features(*learn.svm_per_split(features, splits))
    return learn.svm_mean_accuracy(features, splits, names).select(r6("accuracy"), long("n"))


@query
def boosted_stumps(spark, d):
    """AdaBoost on nine folds, judged on the tenth: the area under the curve of its hard labels."""
    data = learn.wide(_features(spark, d), [str(i) for i in range(64)])
    parts = data.join(learn.stratified_folds(data).select("subject", "fold"), "subject").withColumn("label", F.col("label").cast("double"))
    predict = learn.boosted_stumps(parts.where("fold <> 0"))
    return learn.hard_auc(predict(parts.where("fold = 0"))).select(r6("auc"))


#: Thresholds on Welch's statistic under which edges are left out of a classifier.
GRID = (0.8, 1.2, 1.6, 2.0)


@query
def threshold_grid(spark, d):
    """For each threshold the edges beyond it as features: every estimator with every parameter, scored over ten folds by f1 and by
    the area under the curve; best marks the first of a threshold and metric."""
    s = fx.subjects(spark, d).select("subject", (F.col("cohort") == "patient").cast("int").alias("label"))
    edge = F.concat_ws("-", F.col("i").cast("string"), F.col("j").cast("string"))
    features = weights(spark, d).join(s, "subject").select("subject", "label", edge.alias("feature"), "value")
    t = stats.welch(sparse_values(spark, d), ["i", "j"], subjects=fx.subjects(spark, d)).select(edge.alias("feature"), F.abs("t").alias("t"))
    masks = t.select(F.explode(F.array(*(F.struct(F.lit(k).alias("mask"), F.lit(x).alias("least")) for k, x in enumerate(GRID)))).alias("m"), "feature", "t").where("t > m.least").select("m.mask", "feature")
    folds = learn.stratified_folds(s).select("subject", "fold", "label")
    summary = checkpointed(ensembles.grid(*map(checkpointed, (features, folds, masks))))
    best = ensembles.best_of(summary).select("mask", "metric", "estimator", "params", F.lit(True).alias("best"))
    threshold = F.get(F.array(*map(F.lit, GRID)), F.col("mask"))
    return summary.join(best, ["mask", "metric", "estimator", "params"], "left").select(threshold.alias("threshold"), "metric", "estimator", "params", r6("mean_score"), r6("std_score"), F.coalesce("best", F.lit(False)).alias("best"))
