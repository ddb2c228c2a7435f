"""Clusters, components and samples of the score vectors."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import PCA, PCAModel, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.normal import level_ordinal, signed_score

SCORES = ["textblob_polarity", "vader_compound", "transformer_sentiment", "distilbert_sentiment"]


def with_signed_scores(df: DataFrame) -> DataFrame:
    """Add both classifier scores with the sign of their label."""
    return df.withColumns(
        {
            "transformer_sentiment": signed_score("transformer_label", "transformer_score"),
            "distilbert_sentiment": signed_score("distilbert_label", "distilbert_score"),
        }
    )


def score_vectors(df: DataFrame, scores: list[str] = SCORES) -> DataFrame:
    """Rows with all scores present, with the scores as one vector."""
    whole = df.na.drop(subset=scores)
    return VectorAssembler(inputCols=scores, outputCol="features").transform(whole)


def fit_clusters(vectors: DataFrame, k: int = 3, seed: int = 42) -> KMeansModel:
    return KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(vectors)


def cluster_scores(df: DataFrame, k: int = 3, seed: int = 42) -> DataFrame:
    """Cluster of each complete row, numbered by the order of the centres."""
    vectors = score_vectors(df)
    model = fit_clusters(vectors, k, seed)
    return by_centre(model.transform(vectors), model)


def by_centre(assigned: DataFrame, model: KMeansModel) -> DataFrame:
    """Number clusters by their centres, which the order of the rows does not change."""
    centres = [tuple(c) for c in model.clusterCenters()]
    number = [sorted(centres).index(c) for c in centres]
    names = F.array(*[F.lit(n) for n in number])
    return assigned.withColumn("cluster", F.get(names, F.col("cluster")))


def in_nearest_cluster(df: DataFrame, k: int = 3, seed: int = 42) -> DataFrame:
    """Whether each complete row is in the cluster with the nearest centre."""
    vectors = score_vectors(df)
    model = fit_clusters(vectors, k, seed)
    place = vector_to_array("features")
    far = [
        F.sqrt(sum(((place[i] - float(x)) ** 2 for i, x in enumerate(c)), F.lit(0.0))) for c in model.clusterCenters()
    ]
    own = F.get(F.array(*far), F.col("cluster"))
    return model.transform(vectors).withColumn("nearest", own <= F.least(*far) + 1e-9)


def project_scores(df: DataFrame, k: int = 2) -> DataFrame:
    """Principal components of the centred score vectors, as columns ``pc1``, ``pc2``…"""
    vectors = score_vectors(df)
    scaler = StandardScaler(withMean=True, withStd=False, inputCol="features", outputCol="centred")
    centred = scaler.fit(vectors).transform(vectors)
    model: PCAModel = PCA(k=k, inputCol="centred", outputCol="components").fit(centred)
    loadings = model.pc.toArray()
    # the largest loading of a component is positive
    signs = [1.0 if loadings[abs(loadings[:, i]).argmax(), i] >= 0 else -1.0 for i in range(k)]
    parts = vector_to_array("components")
    projected = model.transform(centred)
    return projected.withColumns({f"pc{i + 1}": parts[i] * signs[i] for i in range(k)})


#: Hex digits of the sampling hash that are counted to find the cut: 16^5 values.
_CUT_DIGITS = 5


def seeded_sample(df: DataFrame, n: int = 1000, seed: int = 42, id_col: str = "id") -> DataFrame:
    """The ``n`` rows with the smallest seeded hash of their id; all rows if fewer.

    A count per hash prefix gives the prefix below which ``n`` rows lie for sure, so
    only about ``n`` rows (and not ``n`` per task) reach the final sort.
    """
    keyed = df.withColumn("_hash", F.md5(F.concat(F.lit(f"{seed}|"), F.col(id_col).cast("string"))))
    prefix = F.substring("_hash", 1, _CUT_DIGITS)
    tally = keyed.groupBy(prefix.alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
    # at most 16^5 prefixes, so the running total is of bounded size
    reached = tally.select("prefix", F.sum("n").over(W.orderBy("prefix")).alias("reached"))
    cut = reached.where(F.col("reached") >= n).agg(F.min("prefix"))
    last = F.lit("f" * _CUT_DIGITS)
    return (
        keyed.where(prefix <= F.coalesce(cut.scalar(), last))
        .orderBy("_hash", id_col)
        .limit(n)
        .drop("_hash")
    )


def assign_clusters(df: DataFrame, sample: DataFrame, k: int = 3, seed: int = 42) -> DataFrame:
    """Clusters fitted on all rows, assigned to a sample."""
    model = fit_clusters(score_vectors(df), k, seed)
    return by_centre(model.transform(score_vectors(sample)), model)


def feature_importance(df: DataFrame, trees: int = 20, depth: int = 5, seed: int = 42) -> DataFrame:
    """Weight of each score in a forest that predicts the level."""
    labelled = df.withColumn("label", level_ordinal().cast("double")).where(F.col("label").isNotNull())
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed)
    model = forest.fit(score_vectors(labelled))
    rows = list(zip(SCORES, [float(v) for v in model.featureImportances.toArray()]))
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")
